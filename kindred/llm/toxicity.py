"""Toxicity by a factorization machine over hashed terms.

A document's terms are its distinct chunks between white space, lower-cased; a chunk's features are its letter runs
and their starts of four, five and six letters, hashed. The score is the logistic of a bias, linear weights, and all
pairwise interactions of the features present, factored through `rank` dimensions: a pair that is toxic only together
(an insult and whom it is aimed at) gets weight that no sum of single weights gives. Interactions are summed in linear
time from per-chunk vectors, which a worker computes once and keeps.

Training data is bounded: at most `max_rows` labelled documents, those of least hash among the rows that may be
learned from. Their features go to the driver; everything else (scoring) covers every document, whole.

Defined results: a null or empty text, or one without letters, has the score of the bias alone; labels that are null
are ignored, and of repeated labels of one document the largest counts; without any label to learn from every score is
0.5, and with labels of one class only, the smoothed share of that class; repeated documents get equal scores;
documents with a null doc_id are scored, never learned from; an empty table gives an empty result. Columns other than
id and text are ignored, or handed through in one struct, so that their names can't clash with the result's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.llm.common import claim, map_batches, slim, texts, with_carried

#: Hashed features; the model's size, whatever the corpus.
BUCKETS = 1 << 20
#: Labelled documents to learn from, at most.
MAX_ROWS = 10_000
#: Features seen in fewer training documents get no weight, nor do those that are neither common (in this share of the
#: training documents) nor seen with one label more often than chance would have it (in standard deviations), alone or with another.
MIN_DOCS = 4
COMMON = 0.05
DEVIATIONS = 3.5
#: Features that are kept for a pair's sake: of the PAIRED most frequent ones that no single test keeps, those of pairs that
#: one label has more often than chance would have it (a likelihood ratio, in nats, over what so many pairs give anyway).
PAIRED = 2048
PAIR_SURPRISE = 8.0
STARTS = (4, 5, 6)
#: Chunks whose vectors a worker keeps before it starts afresh.
CACHE_ENTRIES = 120_000

_RUNS = re.compile(r"[^\W\d_]+")


def chunk_features(chunk: str) -> list[int]:
    """Hashed features of one lower-cased chunk."""
    out = []
    for run in _RUNS.findall(chunk):
        raw = run.encode()
        out.append(xxhash.xxh32_intdigest(raw) % BUCKETS)
        out.extend(xxhash.xxh32_intdigest(run[:n].encode(), seed=n) % BUCKETS for n in STARTS if len(run) > n)
    return out


@dataclass(frozen=True)
class Model:
    """bias, and for each kept feature (sorted ids) a linear weight and a vector."""

    bias: float
    ids: np.ndarray
    linear: np.ndarray
    factors: np.ndarray

    def rows(self, features: list[list[int]]) -> np.ndarray:
        """Per list of features: sum of linear weights, of vectors, and of squared vectors."""
        out = np.zeros((len(features), 2 + self.factors.shape[1]))
        if len(self.ids):
            flat = np.array([f for fs in features for f in fs], np.int64)
            owner = np.repeat(np.arange(len(features)), [len(f) for f in features])
            at = np.minimum(np.searchsorted(self.ids, flat), len(self.ids) - 1)
            known = self.ids[at] == flat
            at, owner = at[known], owner[known]
            table = np.concatenate([self.linear[:, None], (self.factors**2).sum(1, keepdims=True), self.factors], 1)
            np.add.at(out, owner, table[at])
        return out

    def scores(self, sums: np.ndarray) -> np.ndarray:
        z = self.bias + sums[:, 0] + 0.5 * ((sums[:, 2:] ** 2).sum(1) - sums[:, 1])
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def paired_features(features: list[np.ndarray], labels: np.ndarray, candidates: np.ndarray, share: float, min_docs: int = 8, surprise: float = PAIR_SURPRISE) -> np.ndarray:
    """Those of the candidates (sorted ids) that tell the labels only together with another one of them.

    Equal documents count once, so that a document with many copies doesn't speak for its words.
    """
    if len(candidates) < 2:
        return candidates[:0]
    rows: dict[bytes, int] = {}
    for k, f in enumerate(features):
        rows.setdefault(np.unique(f).tobytes(), k)
    kept = np.array(sorted(rows.values()))
    both = np.zeros((2, len(candidates), len(candidates)), np.float32)
    for a in range(0, len(kept), 1024):
        part = kept[a : a + 1024]
        there = np.zeros((len(part), len(candidates)), np.float32)
        for r, k in enumerate(part):
            at = np.searchsorted(candidates, features[k])
            at[at == len(candidates)] = 0
            there[r, at[candidates[at] == features[k]]] = 1
        for y in (0, 1):
            mine = there[labels[part] == y]
            both[y] += mine.T @ mine
    n = both[0] + both[1]
    with np.errstate(divide="ignore", invalid="ignore"):
        p = both[1] / n
        gain = n * (np.nan_to_num(p * np.log(p / share)) + np.nan_to_num((1 - p) * np.log((1 - p) / (1 - share))))
    told = (n >= min_docs) & (gain >= surprise + 2 * np.log(len(candidates)))
    np.fill_diagonal(told, False)
    return candidates[told.any(1)]


def fit(features: list[np.ndarray], labels: np.ndarray, rank: int = 6, epochs: int = 12, rate: float = 0.15, penalty: float = 2e-4, batch: int = 128, min_docs: int = MIN_DOCS, seed: int = 11) -> Model:
    """Logistic factorization machine by AdaGrad over mini-batches, in a fixed order of seeds."""
    empty = Model(0.0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, rank)))
    if not len(labels):
        return empty
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    bias = float(np.log(share / (1 - share)))
    if labels.min() == labels.max():
        return Model(bias, *[getattr(empty, k) for k in ("ids", "linear", "factors")])
    counts, toxic = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
    for f, y in zip(features, labels, strict=True):
        own = np.unique(f)
        counts[own] += 1
        if y:
            toxic[own] += 1
    deviation = np.abs(toxic - counts * share) / np.sqrt(np.maximum(counts, 1) * share * (1 - share))
    alone = (counts >= min_docs) & ((deviation >= DEVIATIONS) | (counts >= max(50, COMMON * len(labels))))
    others = np.flatnonzero(~alone & (counts >= max(min_docs, 8)))
    others = np.sort(others[np.argsort(-counts[others], kind="stable")[:PAIRED]])
    ids = np.union1d(np.flatnonzero(alone), paired_features(features, labels, others, share))
    rng = np.random.default_rng(seed)
    local = []
    for f in features:
        at = np.searchsorted(ids, f)
        at[at == len(ids)] = 0
        local.append(at[ids[at] == f] if len(ids) else at[:0])
    w, v = np.zeros(len(ids)), rng.normal(0, 0.02, (len(ids), rank))
    gw, gv, gb = np.full(len(ids), 1e-6), np.full((len(ids), rank), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            flat = np.concatenate([local[r] for r in rows])
            owner = np.repeat(np.arange(len(rows)), [len(local[r]) for r in rows])
            own = v[flat]
            sums = np.zeros((len(rows), rank))
            np.add.at(sums, owner, own)
            linear = np.bincount(owner, w[flat], len(rows))
            squares = np.bincount(owner, (own**2).sum(1), len(rows))
            z = bias + linear + 0.5 * ((sums**2).sum(1) - squares)
            g = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - labels[rows]
            used, back = np.unique(flat, return_inverse=True)
            dw = np.bincount(back, g[owner], len(used)) / len(rows) + penalty * w[used]
            each = g[owner, None] * (sums[owner] - own)
            dv = np.stack([np.bincount(back, each[:, k], len(used)) for k in range(rank)], 1) / len(rows) + penalty * v[used]
            db = g.mean()
            gw[used] += dw**2
            gv[used] += dv**2
            gb += db**2
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= 0.2 * rate * dv / np.sqrt(gv[used])
            bias -= rate * db / gb**0.5
    return Model(bias, ids, w, v)


def held_out(id_col: str = "doc_id"):
    """Rows that no label may be learned from: crc32 of the id as text leaves 1 when divided by 3. Null ids count too."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, **options) -> Model:
    """A model from at most `max_rows` labelled rows outside the held-out third."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL").where(~held_out())
    chosen = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(max_rows)
    rows = slim(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.array([f for c in set(t.lower().split()) for f in chunk_features(c)], "<i4").tobytes() for t in texts(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], ["doc_id", "label", "features"])

    got = map_batches(rows, "doc_id long, label int, features binary", work).toArrow()
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    # views into the Arrow buffers: the features are held once
    lists = [np.frombuffer(x.as_buffer(), "<i4") for x in got["features"]]
    return fit([lists[i] for i in order], got["label"].to_numpy()[order].astype(float), **options)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score, predicted of each text; with `carry` also text and `carried`, a struct of the columns named, unchanged."""
    whole = with_carried(docs, id_col, text_col, carry)
    held = docs.sparkSession.sparkContext.broadcast(model)
    through = whole.schema.fields[1:] if carry else []
    schema = T.StructType([*T.StructType.fromDDL("doc_id long, score double, predicted int").fields, *through])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity", lambda: None)
        own = held.value
        at: dict[str, int] = {}
        table = np.zeros((0, 2 + own.factors.shape[1]))
        for batch in batches:
            sums = []
            for a in range(0, batch.num_rows, 512):
                part = [list(set(t.lower().split())) for t in texts(batch.column(1).slice(a, 512))]
                if len(at) > CACHE_ENTRIES:
                    at, table = {}, table[:0]
                new = list(set().union(*part).difference(at))
                table = np.concatenate([table, own.rows([chunk_features(c) for c in new])])
                at.update(zip(new, range(len(at), len(at) + len(new)), strict=True))
                flat = np.array([i for chunks in part for i in map(at.__getitem__, chunks)], np.int64)
                lengths = np.array([len(c) for c in part])
                total = np.zeros((len(part), table.shape[1]))
                full = np.flatnonzero(lengths)
                if len(full):
                    total[full] = np.add.reduceat(table[flat], (np.cumsum(lengths) - lengths)[full])
                sums.append(total)
            got = own.scores(np.concatenate(sums)) if sums else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got), pa.array((got >= threshold).astype(np.int32)), *(batch.columns[1:] if carry else [])], schema.names)

    return whole.mapInArrow(run, schema)

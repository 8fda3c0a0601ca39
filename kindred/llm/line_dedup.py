"""Line dedup by a sharded minimal perfect hash.

Lines are keyed by the hash of the line stripped of ASCII white space and with A-Z lowered. The distinct hashes that
occur in enough documents are dealt to shards of bounded size; each shard becomes a minimal perfect hash (levels of
bits with ranks) over three arrays: fingerprint, document count and largest document id. Documents probe the arrays,
so no line text is ever joined or shuffled: only (hash, doc_id) pairs and, past the broadcast bound, the ids to drop.

Defined results: a null or empty text is one empty line; lines whose key has fewer than `min_chars` code points are
always kept; a line repeated inside the document that keeps it stays repeated; rows that repeat a doc_id count as one
document and each gets its own result row; rows with a null doc_id hold no line (they are not counted) and keep all
of theirs; an empty table gives an empty result. Other columns of the input are ignored, or handed through in one struct,
so that their names can't clash with the result's.

The fingerprint is the full 64 bits of the hash: with 32 bits one unindexed line in four billion would be dropped
wrongly, which a corpus of 10^12 lines would notice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.llm.common import map_batches, raw_texts, with_carried
from kindred.plans.session import cut

#: Keys of a shard on average; shards are dealt by hash, so none is much larger.
SHARD_KEYS = 1 << 16
#: Indexes up to this many bytes are broadcast; larger ones are probed where they lie.
BROADCAST_BYTES = 48 << 20
#: Probes that one task holds of a shard, on the path without a broadcast: a shard with more is probed by several tasks.
SALT_PROBES = 1 << 20

_SHARD_SCHEMA = "shard long, sizes array<long>, bits binary, fingerprint binary, n_docs binary, last_doc binary"


def line_key(line: bytes, min_chars: int) -> int | None:
    """Signed 64-bit hash of the line's key, or None where the key is too short."""
    key = line.strip().lower()
    if len(key) < min_chars or (not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    h = xxhash.xxh3_64_intdigest(key)
    return h - (1 << 64) if h >> 63 else h


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys.view(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct int64 keys: a key's slot is the rank of its bit in the level that isolates it."""

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        self.starts = np.cumsum([0, *sizes])[:-1]

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 1.6) -> PerfectHash:
        sizes, levels, left = [], [], keys
        while len(left):
            size = -(-int(len(left) * gamma + 64) // 64) * 64
            at = (_mix(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, np.uint64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where no level holds a bit for it. Keys outside the set may get any slot."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, start) in enumerate(zip(self.sizes, self.starts, strict=True)):
            if not len(open_):
                break
            at = (_mix(keys[open_], level) % np.uint64(size)).astype(np.int64) + start
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[hit]] = self.ranks[at[hit] >> 6] + below[hit]
            open_ = open_[~hit]
        return out


class Shard:
    """Arrays of one shard behind its perfect hash."""

    def __init__(self, sizes, bits: bytes, fingerprint: bytes, n_docs: bytes, last_doc: bytes):
        self.hash = PerfectHash([int(s) for s in sizes], np.frombuffer(bits, np.uint64))
        self.fingerprint, self.n_docs, self.last_doc = np.frombuffer(fingerprint, np.int64), np.frombuffer(n_docs, np.uint32), np.frombuffer(last_doc, np.int64)

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document count and largest document of each key; count 0 where the shard has no such key."""
        n, last = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        if len(self.fingerprint):
            slot = self.hash.slots(keys)
            known = (slot >= 0) & (self.fingerprint[slot] == keys)
            n[known], last[known] = self.n_docs[slot[known]], self.last_doc[slot[known]]
        return n, last


def _build_shard(key, group: pd.DataFrame) -> pd.DataFrame:
    keys = group["h"].to_numpy(np.int64)
    mph = PerfectHash.build(keys)
    slot = mph.slots(keys)
    fingerprint, n_docs, last = np.empty(len(keys), np.int64), np.empty(len(keys), np.uint32), np.empty(len(keys), np.int64)
    fingerprint[slot], n_docs[slot], last[slot] = keys, np.minimum(group["n_docs"].to_numpy(np.int64), 0xFFFFFFFF), group["last_doc"].to_numpy(np.int64)
    return pd.DataFrame([{"shard": key[0], "sizes": mph.sizes, "bits": mph.words.tobytes(), "fingerprint": fingerprint.tobytes(), "n_docs": n_docs.tobytes(), "last_doc": last.tobytes()}])


def document_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h, doc_id): each long key of each document, once per row."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        hs, ids = [], []
        for doc, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
            if doc is not None:
                found = {h for line in text.split(b"\n") if len(line) >= min_chars and (h := line_key(line, min_chars)) is not None}
                hs.extend(found)
                ids.extend([doc] * len(found))
        return pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(ids, pa.int64())], ["h", "doc_id"])

    return map_batches(docs, "h long, doc_id long", work)


def build_index(keys: DataFrame, min_docs: int) -> tuple[DataFrame, int, int]:
    """Shards of the keys found in `min_docs` documents or more, how many shards there are, and how many keys."""
    counted = cut(keys.distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc")).where(F.col("n_docs") >= min_docs))
    n = counted.count()
    shards = max(1, -(-n // SHARD_KEYS))
    index = counted.withColumn("shard", F.pmod("h", F.lit(shards))).groupBy("shard").applyInPandas(_build_shard, _SHARD_SCHEMA)
    return cut(index), shards, n


def _drop(text: bytes, doc: int, drops: set[int], min_chars: int) -> tuple[int, int, bytes]:
    lines = text.split(b"\n")
    if not drops:
        return len(lines), 0, text
    kept = [line for line in lines if len(line) < min_chars or line_key(line, min_chars) not in drops]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def _result(batch: pa.RecordBatch, drops_of, min_chars: int) -> pa.RecordBatch:
    """The batch, its text replaced by the kept lines, with the two counts."""
    rows = [_drop(text, doc, drops, min_chars) for doc, text, drops in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), drops_of, strict=True)]
    columns = [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary()).cast(pa.string())]
    carried = [n for n in batch.schema.names if n == "carried"]
    return pa.RecordBatch.from_arrays([*columns, *[batch.column(n) for n in carried]], ["doc_id", "n_lines", "n_dropped", "kept_text", *carried])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, carry: tuple[str, ...] = (), broadcast_bytes: int = BROADCAST_BYTES, salt_probes: int = SALT_PROBES) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text of each row of `docs`.

    A line goes if its key is found in `min_docs` documents or more and this document is not the largest of them.
    An index of at most `broadcast_bytes` is sent to every executor and documents are read once more; a larger one
    stays sharded, the documents' hashes travel to it, and only the hashes to drop travel back. Columns named in
    `carry` come through unchanged as fields of a struct `carried`.
    """
    whole = with_carried(docs, id_col, text_col, carry)
    keys = document_keys(whole.select("doc_id", "text"), min_chars)
    index, shards, n = build_index(keys, min_docs)
    schema = T.StructType.fromDDL("doc_id long, n_lines long, n_dropped long, kept_text string")
    schema = T.StructType([*schema.fields, *whole.schema.fields[2:]])
    if n * 24 <= broadcast_bytes:
        held = docs.sparkSession.sparkContext.broadcast({r.shard: (r.sizes, bytes(r.bits), bytes(r.fingerprint), bytes(r.n_docs), bytes(r.last_doc)) for r in index.toLocalIterator()})

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            local = {k: Shard(*v) for k, v in held.value.items()}
            for batch in batches:
                ids = batch.column(0).to_pylist()
                found = [(i, h) for i, (doc, text) in enumerate(zip(ids, raw_texts(batch.column(1)), strict=True)) if doc is not None for line in text.split(b"\n") if len(line) >= min_chars and (h := line_key(line, min_chars)) is not None]
                drops = [set() for _ in ids]
                rows, hs = np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64)
                for s, shard in local.items():
                    mine = np.flatnonzero(hs % shards == s)
                    count, last = shard.probe(hs[mine])
                    for at in mine[(count > 0) & (last != np.array([ids[r] for r in rows[mine]], np.int64))]:
                        drops[rows[at]].add(int(hs[at]))
                yield _result(batch, drops, min_chars)

        return whole.mapInArrow(probe, schema)

    probes = cut(keys.distinct().withColumn("shard", F.pmod("h", F.lit(shards))))
    # each shard has as many salts as its own probes need: a line of very many documents loads one shard alone
    salts = F.floor((F.col("probes") - 1) / salt_probes + 1)
    dealt = probes.groupBy("shard").agg(F.count(F.lit(1)).alias("probes")).select("shard", salts.alias("salts")).where("salts > 1")
    many = {r.shard: r.salts for r in dealt.toLocalIterator()}  # at most probes / salt_probes shards
    table = F.broadcast(docs.sparkSession.createDataFrame(sorted(many.items()), "shard long, salts long"))
    probes = probes.join(table, "shard", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1)))).drop("salts")
    salted = index.join(table, "shard", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")

    def routed(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        hs, ids = left["h"].to_numpy(np.int64), left["doc_id"].to_numpy(np.int64)
        gone = np.zeros(len(hs), bool)
        for r in right.itertuples():
            count, last = Shard(r.sizes, r.bits, r.fingerprint, r.n_docs, r.last_doc).probe(hs)
            gone |= (count > 0) & (last != ids)
        return pd.DataFrame({"doc_id": ids[gone], "h": hs[gone]})

    drops = probes.groupBy("shard", "salt").cogroup(salted.groupBy("shard", "salt")).applyInPandas(routed, "doc_id long, h long")
    drops = drops.groupBy("doc_id").agg(F.collect_list("h").alias("_drops"))

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        return _result(batch, [set(d or ()) for d in batch.column("_drops").to_pylist()], min_chars)

    return map_batches(whole.join(drops, "doc_id", "left").select(*whole.columns, "_drops"), schema, apply)

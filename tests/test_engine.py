import re
import hashlib
import itertools
import math
import os
import struct
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.functions.decide import Thresholds, decide
from kindred.functions.features import fingerprint_distance, l2_normalize
from kindred.functions import texts
from kindred.functions.texts import with_features
from kindred.operators import candidates
from kindred.operators.candidates import hamming_pairs, one_sided, top_k
from kindred.operators.cluster import chain_labels, linkage_labels, split_groups
from kindred.operators.components import connected_components
from kindred.operators.evidence import best_decided, best_pairs, decided
from kindred.operators.quality import QualityLimits
from kindred.operators.representatives import keep
from kindred.operators.select import METHODS, select_representatives
from kindred.plans import catalogue
from kindred.sources import cache as store
from kindred.sources.records import scan_files

SF = "/root/testdata/sf0.001"


def expected(same, dist, cos):
    known = cos is not None and not math.isnan(cos)
    if same:
        return "exact"
    if dist is not None and dist <= 4:
        return "high"
    if known and cos >= 0.97:
        return "high"
    if known and dist is not None and cos >= 0.90 and dist <= 8:
        return "verified"
    if known and 0.85 <= cos < 0.90:
        return "review"
    return "ignored"


def test_every_boundary_of_the_decision(spark):
    cases = list(itertools.product([True, False], [None, 4, 5, 8, 9], [None, float("nan"), 0.849, 0.85, 0.899, 0.90, 0.969, 0.97]))
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, s boolean, d int, c double")
    got = {r.i: r.v.confidence for r in rows.withColumn("v", decide(F.col("s"), F.col("d"), F.col("c"), Thresholds())).collect()}
    assert got == {i: expected(*c) for i, c in enumerate(cases)}
    with pytest.raises(ValueError):
        Thresholds(cosine_review=0.95)


def test_fingerprints_that_are_none(spark):
    rows = spark.createDataFrame([("", "00"), ("zz", "00"), (None, "00"), ("f" * 16, "0"), ("1g", "0")], "a string, b string")
    assert [r[0] for r in rows.select(fingerprint_distance(F.col("a"), F.col("b"))).collect()] == [None, None, None, 64, None]


def test_zero_vector_has_no_division(spark):
    rows = spark.createDataFrame([([0.0, 0.0],), ([1e-20, 0.0],)], "v array<float>")
    got = [r[0] for r in rows.select(l2_normalize(F.col("v"))).collect()]
    assert got[0] == [0.0, 0.0] and got[1][0] < 1e-7


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, x) for x in range(101, 160)] + [(200, 200), (None, 3), (5, 5)]
    got = {r.idx: r.group_id for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 160)}, 200: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("at_once", [3, 1000])
def test_components_from_stars_of_each_task(spark, monkeypatch, at_once):
    """One task ends what is small, rounds end what isn't; both find what the rounds alone find."""
    from kindred.operators import components

    monkeypatch.setattr(components, "EDGES_HELD", 7)
    rng = np.random.default_rng(13)
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, x) for x in range(101, 160)] + [(200, 200), (None, 3), (5, 5)] + [(int(x), int(y)) for x, y in rng.integers(300, 500, (90, 2))]
    frame = spark.createDataFrame(edges, "a long, b long").repartition(9)
    got = sorted(connected_components(frame, at_once=at_once).collect())
    assert got == sorted(connected_components(frame).collect())
    assert connected_components(spark.createDataFrame([], "a long, b long"), at_once=at_once).count() == 0


def test_hamming_join_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**63, 40)]
    prints = base + [b ^ sum(1 << int(i) for i in rng.choice(64, int(rng.integers(1, 11)), replace=False)) for b in base]
    rows = spark.createDataFrame([(i, f"{p:016x}") for i, p in enumerate(prints)] + [(500, None), (501, "zz")], "idx long, phash string")
    got = {(r.a, r.b): r.distance for r in hamming_pairs(rows, 8).collect()}
    want = {(i, j): (prints[i] ^ prints[j]).bit_count() for i, j in itertools.combinations(range(len(prints)), 2) if (prints[i] ^ prints[j]).bit_count() <= 8}
    assert got == want and want


def test_top_k_is_one_sided_and_counts_itself(spark):
    vectors = [[1.0, 0.0], [0.999, 0.045], [0.995, 0.1], [0.99, 0.14], [0.0, 1.0]]
    unit = [(np.array(v) / np.linalg.norm(v)).tolist() for v in vectors]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(unit)] + [(9, None)], "idx long, embedding array<double>")
    full = top_k(rows, 2, block_rows=2)
    assert {(r.a, r.b) for r in full.collect()} >= {(0, 0), (0, 1)}
    # 1 is nearer to 0 than to 2, and 2 to 3, so nobody's list holds the pair (1, 2) from its lower side
    assert {(r.a, r.b) for r in one_sided(full, 0.85).collect()} == {(0, 1), (2, 3)}
    assert full.groupBy("a").count().where("count > 2").count() == 0


def test_best_partners_under_running_bounds(monkeypatch):
    """What rules a pair out early changes no list, ties and copies included."""
    monkeypatch.setattr(candidates, "TILE_COLUMNS", 16)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(20, 8))
    rows = np.concatenate([base[rng.integers(0, 20, 200)] + 0.1 * rng.normal(size=(200, 8)), np.repeat(base[:2], 60, axis=0)])
    rows = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    scores = np.round(rows @ rows.T, 6)
    for k in (1, 3, 1 << 30):
        want = {(i, int(j)) for i in range(len(rows)) for j in np.argsort(-scores[i], kind="stable")[:k] if scores[i, j] >= 0.9}
        assert {(int(i), int(j)) for p, q, _ in candidates._best(rows, rows, k, 0.9) for i, j in zip(p, q, strict=True)} == want


@pytest.mark.parametrize("held", [1 << 22, 300])
def test_one_product_serves_both_sides(monkeypatch, held):
    """Both directions of a meeting hold the k best over the floors, ties and copies included, however few are held at once."""
    for name, value in (("WIDE_TILE", 48), ("GROUP", 8), ("MOST_HELD", held), ("PAIRS_AT_ONCE", 64)):
        monkeypatch.setattr(candidates, name, value)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(20, 8))
    rows = np.concatenate([base[rng.integers(0, 20, 200)] + 0.1 * rng.normal(size=(200, 8)), np.repeat(base[:2], 60, axis=0)])
    rows = rng.permutation(rows / np.linalg.norm(rows, axis=1, keepdims=True))
    x, y = rows[:150], rows[150:]

    def want(u, v, floor, k):
        scores = np.round(u @ v.T, 6)
        return {(i, int(j)) for i in range(len(u)) for j in np.argsort(-scores[i], kind="stable")[:k] if scores[i, j] >= floor[i]}

    told = lambda found: {(int(p), int(q)) for p, q, _ in [found] for p, q in zip(p, q, strict=True)}
    for k in (1, 3, 1 << 30):
        floors = np.where(np.arange(320) % 3, 0.9, 0.97)
        one, other = candidates._best_of_both(x, y, (floors[:150], floors[150:]), k)
        assert told(one) == want(x, y, floors[:150], k) and told(other) == want(y, x, floors[150:], k)
        alone, none = candidates._best_of_both(rows, None, (floors, floors), k)
        assert told(alone) == want(rows, rows, floors, k) and none is None
        # products beyond single precision are all scored in double precision
        huge = x * 1e200, y * 1e-200
        assert told(next(iter(candidates._best_of_both(*huge, (floors[:150], floors[150:]), k)))) == want(*huge, floors[:150], k)


@pytest.mark.parametrize("held", [1 << 22, 300])
def test_tiles_meet_only_rows_near_their_box(monkeypatch, held):
    """Where floors are high most rows aren't met, and both directions hold the k best over the floors all the same."""
    for name, value in (("NEAR_TILE", 16), ("WIDE_TILE", 48), ("GROUP", 8), ("AXES", 5), ("MOST_HELD", held), ("PAIRS_AT_ONCE", 64)):
        monkeypatch.setattr(candidates, name, value)
    rng = np.random.default_rng(14)
    base = rng.normal(size=(30, 8))
    rows = np.concatenate([base[rng.integers(0, 30, 400)] + 0.1 * rng.normal(size=(400, 8)), np.repeat(base[:2], 60, axis=0)])
    rows = rng.permutation(rows / np.linalg.norm(rows, axis=1, keepdims=True))
    x, y = rows[:230], rows[230:]
    met = []
    near = candidates._Boxes.near
    monkeypatch.setattr(candidates._Boxes, "near", lambda self, tile: met.append(len(found := near(self, tile))) or found)

    def want(u, v, floor, k):
        scores = np.round(u @ v.T, 6)
        return {(i, int(j)) for i in range(len(u)) for j in np.argsort(-scores[i], kind="stable")[:k] if scores[i, j] >= floor[i]}

    told = lambda found: {(int(p), int(q)) for p, q, _ in [found] for p, q in zip(p, q, strict=True)}
    for k in (1, 3, 1 << 30):
        floors = np.where(np.arange(len(rows)) % 3, 0.97, 0.985)
        one, other = candidates._best_of_both(x, y, (floors[:230], floors[230:]), k)
        assert told(one) == want(x, y, floors[:230], k) and told(other) == want(y, x, floors[230:], k)
        assert max(met) < len(y) and np.mean(met) < 0.5 * len(y)
        alone, none = candidates._best_of_both(rows, None, (floors, floors), k)
        assert told(alone) == want(rows, rows, floors, k) and none is None
        met.clear()
    # vectors of one number have a box of one axis
    one, other = candidates._best_of_both(np.sign(x[:, :1]), np.sign(y[:, :1]), (np.full(230, 0.97), np.full(len(y), 0.97)), 5)
    assert told(one) == want(np.sign(x[:, :1]), np.sign(y[:, :1]), np.full(230, 0.97), 5)


def test_near_fingerprints_by_bands():
    """Each pair once, whatever bands its bits lie in."""
    rng = np.random.default_rng(10)
    x = rng.integers(0, 2**63, 60).astype(np.uint64)
    y = np.concatenate([x, x] + [x ^ np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 11), replace=False)) for _ in x], np.uint64) for _ in range(6)])
    for radius in (0, 4, 8):
        got = [(int(p), int(q), int(d)) for u, v, w in candidates._near_by_bands(x, y, radius) for p, q, d in zip(u, v, w, strict=True)]
        want = {(i, j, d) for i in range(len(x)) for j in range(len(y)) if (d := int(x[i] ^ y[j]).bit_count()) <= radius}
        assert len(got) == len(want) and set(got) == want


def test_floors_rule_out_no_partner_and_most_others(spark):
    """No more than a few times k partners of a row reach its floor, and always its k best; no row gets lost."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(4, 16))
    v = base[rng.integers(0, 4, 2000)] + 0.3 * rng.normal(size=(2000, 16))
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v[i].tolist() if i % 50 else None) for i in range(2000)], "idx long, embedding array<double>")
    floor = {r.idx: r.floor for r in candidates.with_floors(rows, 5, 0.8, cell_rows=600).collect()}
    assert sorted(floor) == list(range(2000)) and all(floor[i] == 0.8 for i in range(0, 2000, 50))
    there = [i for i in range(2000) if i % 50]
    scores = np.round(v[there] @ v[there].T, 6)
    f = np.array([floor[i] for i in there])
    fifth = np.partition(scores, -5, axis=1)[:, -5]
    assert (f <= np.maximum(fifth, 0.8)).all()
    assert (scores >= f[:, None]).sum() < 0.1 * (scores >= 0.8).sum()
    assert candidates.with_floors(rows.where("embedding IS NULL"), 5, 0.8, cell_rows=10).count() == 40


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_pairs_come_with_their_evidence(spark, block_rows):
    """No pair is joined with its records, whichever blocks they lie in; missing features satisfy nothing."""
    rng = np.random.default_rng(4)
    prints = [int(x) for x in rng.integers(0, 2**63, 4)]
    rows = []
    for i in range(40):
        v = rng.normal(size=4)
        rows.append((i, f"{prints[i % 4] ^ (1 << (i % 11)):016x}" if i % 9 else None, (v / np.linalg.norm(v)).tolist() if i % 7 else None, ["x", "y", "", None][i % 4]))
    frame = spark.createDataFrame(rows, "idx long, phash string, embedding array<double>, sha256 string")
    pairs = candidates.near_pairs(frame, 2, 5, 0.8, block_rows=block_rows)
    assert "Join" not in pairs._jdf.queryExecution().executedPlan().toString()
    got = {(r.a, r.b, r.arm): (r.cosine, r.phash_distance, r.same_sha256) for r in pairs.collect()}
    cosine = lambda a, b: None if a[2] is None or b[2] is None else round(float(np.dot(a[2], b[2])), 6)
    apart = lambda a, b: None if a[1] is None or b[1] is None else (int(a[1], 16) ^ int(b[1], 16)).bit_count()
    told = lambda a, b: (cosine(a, b), apart(a, b), bool(a[3]) and a[3] == b[3])
    want = {(a[0], b[0], 1): told(a, b) for a, b in itertools.combinations(rows, 2) if apart(a, b) is not None and apart(a, b) <= 2}
    for a in rows:
        best = sorted((-cosine(a, b), b[0]) for b in rows if cosine(a, b) is not None and cosine(a, b) >= 0.8)[:5]
        want |= {(a[0], j, 2): told(a, rows[j]) for _, j in best if j > a[0]}
    assert got == want


def test_text_features_need_no_shuffle(spark):
    """Fingerprint and vector by the definitions, of rows that stay where they are; null and empty texts have their own."""
    texts = [None, "", " \t\n", "One one TWO\x0bthree", "a b a c " * 50, "\u00c4pfel \u4e2d\u6587 x\u00a0y"]
    out = with_features(spark.createDataFrame(list(enumerate(texts)), "idx long, text string"))
    assert not {"Exchange", "Join", "Aggregate"} & set(re.findall("Exchange|Join|Aggregate", out._jdf.queryExecution().executedPlan().toString()))
    for r in out.collect():
        words = (texts[r.idx] or "").lower().encode().split()
        hashes = [int.from_bytes(hashlib.md5(w).digest()[:8], "big") for w in set(words)]
        bits = sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))
        assert r.phash == (None if texts[r.idx] is None else f"{bits:016x}")
        counts = np.bincount([hashlib.md5(w).digest()[0] % 64 for w in words], minlength=64) - len(words) / 64
        assert r.embedding is None if not words else np.allclose(r.embedding, counts / np.linalg.norm(counts), rtol=0, atol=1e-15)


def test_fingerprints_of_more_words_than_a_byte_counts():
    """Texts of more than 255 different words, over several steps, without a step's end changing a bit."""
    rng = np.random.default_rng(12)
    hashes = rng.integers(0, 2**63, 3000).astype(np.uint64)
    owner = np.repeat([0, 2, 3], [900, 260, 3000])
    word = np.concatenate([rng.integers(0, 700, 900), np.arange(260), np.arange(3000)])
    want = []
    for i in range(5):
        mine = {int(hashes[w]) for o, w in zip(owner, word, strict=True) if o == i}
        want.append(f"{sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in mine) > len(mine)):016x}")
    for step in (100, 100_000):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(texts, "WORDS_AT_ONCE", step)
            assert texts.simhashes(owner, word, hashes, 5) == want


def test_words_hashed_side_by_side():
    """Digests of words of one block and of more, from the middle of a column."""
    rng = np.random.default_rng(15)
    words = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in range(130)]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(texts, "HASHED_AT_ONCE", 9)
        got = texts.word_hashes(pa.array([b"before", *words], pa.binary()).slice(1))
    assert got.tolist() == [int.from_bytes(hashlib.md5(w).digest()[:8], "big") for w in words]
    assert texts.word_hashes(pa.array([], pa.string())).tolist() == []


def test_best_evidence_by_rank_then_cosine_then_arm(spark):
    cols = "a long, b long, arm int, cosine double, phash_distance int, same_sha256 boolean, decision string, reason string, confidence string"
    rows = [(1, 2, 0, None, 0, True, "duplicate", "x", "e"), (1, 2, 1, 0.9, 0, True, "duplicate", "y", "e"), (1, 2, 2, 0.9, 0, True, "duplicate", "z", "e"), (3, 4, 2, 0.99, 9, False, "ignore", "n", "i"), (5, 6, 2, 0.86, 9, False, "review", "r", "r")]
    got = {(r.a, r.b): r.arm for r in best_pairs(spark.createDataFrame(rows, cols)).collect()}
    assert got == {(1, 2): 1, (5, 6): 2}


def test_pairs_grouped_as_numbers_are_decided_the_same(spark):
    """One decision a pair, after grouping; no text is shuffled."""
    t = Thresholds()
    cases = itertools.product([None, 0, 4, 5, 9], [None, float("nan"), 0.8, 0.86, 0.93, 0.98], [True, False], [(0,), (1, 2), (0, 1), (2,)])
    rows = [(i, i + 1000, arm, None if arm == 0 else cos, dist, same) for i, (dist, cos, same, arms) in enumerate(cases) for arm in arms]
    arms = spark.createDataFrame(rows, "a long, b long, arm int, cosine double, phash_distance int, same_sha256 boolean").repartition(3)
    new, old = best_decided(arms, t), best_pairs(decided(arms, t))
    assert sorted(map(str, new.collect())) == sorted(map(str, old.select(new.columns).collect())) and new.columns == old.columns
    exchange = new._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[1]
    assert "reason" not in exchange


@pytest.mark.parametrize("query", ["best_pair", "decision_counts", "review_only"])
def test_queries_on_pairs_make_no_groups(spark, monkeypatch, query):
    from kindred.plans import workflows

    monkeypatch.setattr(workflows, "groups_of", lambda pairs: pytest.fail("no groups are asked for"))
    assert catalogue.QUERIES[query](spark, SF).count()


@pytest.mark.parametrize("query", ["group_sizes", "keep_largest", "report_quality", "report_groups", "agglomerative_complete"])
def test_queries_on_groups_look_for_duplicates_alone(spark, monkeypatch, query):
    from kindred.operators import evidence

    least, near = [], evidence.near_pairs
    monkeypatch.setattr(evidence, "near_pairs", lambda records, radius, k, floor: least.append(floor) or near(records, radius, k, floor))
    assert catalogue.QUERIES[query](spark, SF).columns and least == [Thresholds().cosine_auto]


def test_duplicates_alone_are_those_of_all_pairs(spark):
    from kindred.plans import workflows
    from kindred.sources.records import document_records

    records = document_records(spark, "/root/testdata/sf0.01")
    whole, alone = workflows.match(records), workflows.match(records, duplicates_only=True)
    assert sorted(map(str, alone.pairs.collect())) == sorted(map(str, whole.pairs.where("decision = 'duplicate'").collect())) and whole.pairs.where("decision = 'review'").count()
    assert sorted(alone.components.collect()) == sorted(whole.components.collect())


def test_keep_policies_with_ties(spark):
    rows = spark.createDataFrame([(1, "b", 5, 1.0, 2, 2, 9.0, 127.0, None), (2, "a", 5, 1.0, 2, 2, 9.0, 127.0, None), (3, "c", 4, 0.0, 1, None, 9.0, 127.0, "blurry")], "idx long, path string, size long, mtime double, width int, height int, blur_score double, brightness double, rejection_reason string")
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "idx long, group_id long")
    got = {p: keep(groups, rows, p).first().keep for p in ("lexi", "smallest", "largest", "highest-resolution", "newest", "oldest", "best-quality")}
    assert got == {"lexi": 2, "smallest": 3, "largest": 1, "highest-resolution": 1, "newest": 1, "oldest": 3, "best-quality": 1}
    with pytest.raises(ValueError):
        keep(groups, rows, "other")


def test_agglomerative_rules(spark):
    v = lambda deg: [math.cos(math.radians(deg)), math.sin(math.radians(deg))]
    records = spark.createDataFrame([(1, v(0)), (2, v(80)), (3, v(0)), (4, v(1)), (5, v(90)), (6, v(0)), (7, None), (8, v(90))], "idx long, embedding array<double>")
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (6, 6), (7, 6), (8, 6)], "idx long, group_id long")
    got = {r.idx: r.group_id for r in split_groups(groups, records, 0.97).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 6: 6, 7: 6, 8: 6}
    exact = np.array([[1.0, 0.0], [0.5, math.sqrt(0.75)]])
    assert len(set(linkage_labels(exact, float(exact[0] @ exact[1]) + 1e-12, "complete"))) == 2


@pytest.mark.parametrize("linkage", ["complete", "average"])
def test_merges_look_at_the_whole_matrix_once(linkage):
    """The pair that merges is the first of the nearest ones in the matrix, ties included, without a look at all of it."""

    def plain(v, reach, w):
        d, label = 1 - np.clip(v @ v.T, -1, 1), np.arange(len(v))
        np.fill_diagonal(d, np.inf)
        size = w.astype(float)
        for _ in range(len(v) - 1):
            i, j = sorted(divmod(int(d.argmin()), len(v)))
            if not d[i, j] < reach:
                break
            row = np.maximum(d[i], d[j]) if linkage == "complete" else (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
            d[i], d[:, i] = row, row
            d[i, i] = d[j] = d[:, j] = np.inf
            size[i] += size[j]
            label[label == label[j]] = label[i]
        return label

    rng = np.random.default_rng(17)
    for digits in (1, 2, 9):
        v = rng.normal(size=(120, 3))
        v = np.round(v / np.linalg.norm(v, axis=1, keepdims=True), digits)
        w = rng.integers(1, 5, 120)
        with pytest.MonkeyPatch.context() as m:
            m.setattr("kindred.operators.cluster.DISTANCES_AT_ONCE", 500)
            assert linkage_labels(v, 0.9, linkage, w).tolist() == plain(v, 1 - 0.9, w).tolist()
    looks = []
    seen = type("Seen", (np.ndarray,), {"argmin": lambda self, *a, **b: looks.append(self.shape) or np.asarray(self).argmin(*a, **b)})
    linkage_labels(v.view(seen), 0.9, linkage, w)
    assert looks.count((120, 120)) == 1


@pytest.mark.parametrize("batch", [1, 3, 10_000])
def test_agglomerative_tells_many_groups_at_once(spark, batch):
    """Groups of every size, wherever a batch ends in them; none is a call of its own."""
    rng = np.random.default_rng(16)
    base = rng.normal(size=(40, 3))
    v = base[rng.integers(0, 40, 200)] + 0.05 * rng.normal(size=(200, 3)) * (rng.random((200, 1)) < 0.7)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    heads = np.sort(rng.choice(200, 60, replace=False))
    heads[0] = 0
    group = heads[np.searchsorted(heads, np.arange(200), side="right") - 1]
    rows = spark.createDataFrame([(i, int(group[i]), x.tolist() if i % 41 else None) for i, x in enumerate(v)], "idx long, group_id long, embedding array<double>")
    want = {}
    for g in heads:
        own = np.flatnonzero(group == g)
        if len(own) < 3 or (own % 41 == 0).any():
            want |= dict.fromkeys(own.tolist(), int(g))
            continue
        for x in _sets(linkage_labels(v[own], 0.97, "complete")):
            part = own[sorted(x)]
            want |= dict.fromkeys(part.tolist(), int(part[0])) if len(part) > 1 else {}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = split_groups(rows.select("idx", "group_id"), rows.select("idx", "embedding"), 0.97)
        assert "FlatMapGroups" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert {r.idx: r.group_id for r in found.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def _sets(labels):
    return {frozenset(np.flatnonzero(labels == x)) for x in set(labels)}


@pytest.mark.parametrize("linkage", ["complete", "average"])
def test_chain_finds_the_clusters_of_the_matrix(linkage):
    rng = np.random.default_rng(6)
    for least, dims, kept in ((0.97, 3, 0), (0.9, 4, 10**6), (-0.2, 3, 0), (1.0, 3, 0)):
        v = rng.normal(size=(300, dims))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        w = rng.integers(1, 5, 300)
        assert _sets(chain_labels(v, least, linkage, w, kept)) == _sets(linkage_labels(v, least, linkage, w))
        # a row of weight w is w equal rows
        if least < 1:
            many = linkage_labels(np.repeat(v, w, axis=0), least, linkage)
            assert {frozenset(np.repeat(np.arange(300), w)[list(x)]) for x in _sets(many)} == _sets(linkage_labels(v, least, linkage, w))


@pytest.mark.parametrize("linkage", ["complete", "average"])
def test_agglomerative_splits_groups_past_the_matrix(spark, linkage):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(60, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v = np.concatenate([v, v[:20], np.repeat(v[:1], 6000, axis=0), np.zeros((2, 3))])
    rows = spark.createDataFrame([(i, 0, x.tolist()) for i, x in enumerate(v)], "idx long, group_id long, embedding array<double>")
    few = np.concatenate([np.arange(80), [len(v) - 2, len(v) - 1]])
    w = np.ones(82, int)
    w[0] += 6000
    labels = linkage_labels(v[few], 0.9, linkage, w)
    want = {}
    for x in _sets(labels):
        part = few[list(x)]
        if len(part) > 1 or 0 in part:
            want |= dict.fromkeys([int(i) for i in part] + (list(range(80, 6080)) if 0 in part else []), int(part.min()))
    for most in (5000, 10):
        got = split_groups(rows.select("idx", "group_id"), rows.select("idx", "embedding"), 0.9, linkage, most).collect()
        assert len(got) == len(want) and {r.idx: r.group_id for r in got} == want


def test_selection_is_exact_repeatable_and_blind_to_scale(spark):
    base = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (3, [0.1, 0.9]), (4, [-1.0, 0.0])]
    rows = spark.createDataFrame(base, "idx long, embedding array<float>")
    scaled = spark.createDataFrame([(i, [x * k for x in v]) for (i, v), k in zip(base, (100.0, 0.1, 25.0, 3.0, 0.5), strict=True)], "idx long, embedding array<float>")
    for method in METHODS:
        one = [r.idx for r in select_representatives(spark, rows, 3, method, 7).orderBy("position").collect()]
        assert len(set(one)) == 3
        assert [r.idx for r in select_representatives(spark, scaled, 3, method, 7).orderBy("position").collect()] == one
    with pytest.raises(ValueError):
        select_representatives(spark, rows, 6)


def test_cache_of_a_subset_forgets_the_rest(spark, tmp_path):
    held = store.Snapshots(spark, f"file://{tmp_path}/cache")
    assert held.read().count() == 0
    rows = spark.createDataFrame([("a", 1, 1.0, "s", "p", 1, 1), ("b", 2, 2.0, "s", "p", 1, 1)], "path string, size long, mtime double, sha256 string, phash string, width int, height int")
    vectors = spark.createDataFrame([("a", 1, 1.0, [1.0, 0.0]), ("b", 2, 2.0, [0.0, 1.0])], "path string, size long, mtime double, embedding array<float>")
    held.write(store.save_embeddings(store.upsert_metadata(held.read(), rows), vectors, "m"))
    held.write(store.save_embeddings(held.read(), vectors.where("path = 'b'").withColumn("embedding", F.array(F.lit(0.5), F.lit(0.5)).cast("array<float>")), "m"))
    got = {r.path: r.embedding for r in store.lookup(rows.select("path", "size", "mtime"), held.read(), "m").collect()}
    assert got == {"a": None, "b": [0.5, 0.5]}
    assert store.lookup(rows.select("path", "size", "mtime"), held.read(), "other").where("embedding IS NOT NULL").count() == 0


def test_scan_keeps_hidden_files_and_skips_pruned_folders(tmp_path):
    for name in (".h.png", "_x.png", "b.PNG", "node_modules/x.png", "t.txt", "sub/c.jpeg"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"x")
    got = scan_files([str(tmp_path), str(tmp_path / "sub")])
    assert [os.path.relpath(r[2], tmp_path) for r in got] == [".h.png", "_x.png", "b.PNG", "sub/c.jpeg"] and [r[0] for r in got] == [0, 1, 2, 3]


def png(path, gray, side=32):
    raw = b"".join(b"\0" + bytes([gray] * 3 * side) for _ in range(side))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", side, side, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_pictures_are_measured(spark, tmp_path):
    from kindred.functions.images import measure_pictures
    from kindred.operators.quality import rejection_reason

    png(tmp_path / "a.png", 0)
    (tmp_path / "b.png").write_bytes(b"no picture")
    got = {os.path.basename(r.path): r for r in measure_pictures(spark, str(tmp_path)).withColumn("reason", rejection_reason(QualityLimits(64, 64))).collect()}
    assert (got["a.png"].width, got["a.png"].height, got["a.png"].brightness, got["a.png"].reason) == (32, 32, 0.0, "too_small")
    assert got["b.png"].phash is None and got["b.png"].reason == "unreadable"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(catalogue.ORACLES[name])
    cols = [c[0] for c in want.description]
    got = catalogue.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    norm = lambda row: tuple(repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v) for v in row)
    assert sorted(map(norm, got.select(*cols).collect())) == sorted(map(norm, want.fetchall()))

import gzip
import hashlib
import os
import struct
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kindred.llm import bpe, html_extract, jaccard_join, line_dedup, matroska, packing, sharding, simhash, toxicity, warc

PATH = public_tokenizers.path("byte_bpe_50k.json")
LONG = "the very same line that is repeated in many documents of this corpus"
CASES = [(1, None), (2, ""), (3, "   \n\t"), (4, "one"), (5, "two words"), (6, f"x\n  {LONG.upper()} \ny"), (7, LONG), (8, f"{LONG}\nown"), (9, LONG), (10, f"{LONG}\n{LONG}"), (10, f"{LONG}\n{LONG}"), (None, LONG), (11, "long " * 30000), (12, "naïve café " * 30), (13, "naïve café " * 30)]


@pytest.fixture
def docs(spark):
    rows = [(i, t, "en", 7, 1) for i, t in CASES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_lines int, score int").repartition(4)


@pytest.fixture
def empty(docs):
    return docs.where("false")


def test_line_dedup_both_paths_against_brute_force(spark, docs, empty):
    holders = {}
    keys = lambda t: [line.strip().lower() for line in (t or "").encode().split(b"\n")]
    for i, t in CASES:
        for k in keys(t):
            if i is not None and len(k.decode()) >= 40:
                holders.setdefault(k, set()).add(i)
    want = Counter()
    for i, t in CASES:
        lines = (t or "").encode().split(b"\n")
        kept = [line for line, k in zip(lines, keys(t), strict=True) if i is None or len(holders.get(k, ())) < 5 or max(holders[k]) == i]
        want[(i, len(lines), len(lines) - len(kept), b"\n".join(kept).decode())] += 1
    for limit, salt in ((1 << 20, 1 << 20), (0, 1 << 20), (0, 2)):
        got = line_dedup.dedup_lines(docs, carry=("lang", "n_lines"), broadcast_bytes=limit, salt_probes=salt).select("doc_id", "n_lines", "n_dropped", "kept_text", "carried").collect()
        assert Counter(tuple(r)[:4] for r in got) == want and {tuple(r.carried) for r in got} == {("en", 7)}
    assert line_dedup.dedup_lines(empty).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 20000))
    mph = line_dedup.PerfectHash.build(keys)
    assert sorted(mph.slots(keys)) == list(range(len(keys)))


def test_warc_revisits(spark):
    answer = lambda code, *h: f"HTTP/1.1 {code} X\r\n".encode() + b"".join(f"{x}\r\n".encode() for x in h) + b"\r\n"
    files = [
        (1, warc.record_bytes("response", "http://www.A.com/p?b=2&a=1&utm_source=x#f", "2024-01-01T00:00:00Z", answer(200, "ETag: \"1\"", "Content-Type: t", "Cache-Control: old") + b"body")),
        (2, warc.record_bytes("revisit", "https://a.com/p?a=1&b=2", "2024-01-03T00:00:00Z", answer(304, "ETag: W/\"1\"", "Cache-Control: new", "Content-Type: no", "X-N: 1"))),
        (3, warc.record_bytes("revisit", "http://a.com/p?a=1&b=2", "2023-01-01T00:00:00Z", answer(304, "ETag: \"1\""))),
        (4, warc.record_bytes("revisit", "http://a.com/p?a=1&b=2", "2024-01-01T00:00:10Z", answer(304, "ETag: \"2\""))),
        (5, warc.record_bytes("revisit", "nothing", "2024-01-01T00:00:10Z", answer(304))),
        (6, b"WARC/1.1\r\nbroken"), (7, None), (8, b""),
    ]
    records = warc.parse_warc(spark.createDataFrame(files, "source long, content binary"))
    assert [r.source for r in records.where("error IS NOT NULL").collect()] == [6]
    got = {r.source: r for r in warc.resolve_revisits(records).collect()}
    assert {k: r.status for k, r in got.items()} == {2: "resolved", 3: "no_response", 4: "validator_mismatch", 5: "no_url"}
    assert got[2].headers == {"etag": 'W/"1"', "content-type": "t", "cache-control": "new"} and got[2].payload_sha256 == hashlib.sha256(b"body").hexdigest()
    assert warc.resolve_revisits(records.where("false")).count() == 0


def test_warc_damage_dates_and_repeated_fields(spark):
    answer = lambda code, *h: f"HTTP/1.1 {code} X\r\n".encode() + b"".join(f"{x}\r\n".encode() for x in h) + b"\r\n"
    full = warc.record_bytes("response", "http://a/p", "2024-01-01T00:00:00Z", answer(200, "ETag: x", "Set-Cookie: a=1, 2", "Set-Cookie: b=2", "Via: p", "Via: q") + b"body")
    whole, broken = gzip.compress(full), bytearray(gzip.compress(full * 50))
    broken[30] ^= 0xFF
    again = warc.record_bytes("revisit", "http://a/p", "no date", answer(304, "ETag: x"))
    later = warc.record_bytes("revisit", "http://a/p", "2024-01-02T00:00:00Z", answer(304, "ETag: x"))
    files = [(1, whole + bytes(broken)), (2, again), (3, later), (3, later)]
    records = warc.parse_warc(spark.createDataFrame(files, "source long, content binary")).cache()
    assert [(r.source, r.record) for r in records.where("error IS NOT NULL").collect()] == [(1, 1)]
    got = warc.resolve_revisits(records).collect()
    assert Counter((r.source, r.status) for r in got) == {(2, "no_url"): 1, (3, "resolved"): 2}
    headers = next(r.headers for r in got if r.source == 3)
    assert headers["set-cookie"] == "a=1, 2\nb=2" and headers["via"] == "p, q"


def test_toxicity_learns_a_pair_that_no_sum_can(spark, docs, empty):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(1500):
        a, b = rng.integers(0, 2, 2)
        rows.append((i, " ".join(["fool"] * a + ["people"] * b + [f"w{x}" for x in rng.integers(0, 30, 6)])))
        labels.append((i, int(a and b)))
    table, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    scored = toxicity.score(table, toxicity.train(table, marks)).withColumn("held", toxicity.held_out()).where("held").collect()
    truth = dict(labels)
    assert np.mean([r.predicted == truth[r.doc_id] for r in scored]) > 0.97
    none = toxicity.train(docs, marks.where("false"))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}
    carried = toxicity.score(docs, none, carry=("score", "doc_id")).collect()
    assert toxicity.score(empty, none).count() == 0 and Counter((r.doc_id, r.carried.doc_id, r.text, r.carried.score) for r in carried) == Counter((i, i, t, 1) for i, t in CASES)


def test_toxicity_keeps_words_that_tell_the_label_only_in_pairs():
    rng = np.random.default_rng(1)
    letters, rows, labels = list("abcdefghijklmnopqrstuvwxyz"), [], []
    filler = ["".join(rng.choice(letters, 7)) for _ in range(400)]
    for _ in range(6000):
        words, y = list(rng.choice(filler, 20)), int(rng.random() < 0.5)
        if rng.random() < 0.08:
            a, b = rng.integers(2), rng.integers(2)
            words, y = [*words, ("trottel", "blume")[a], ("volk", "garten")[b]], int(a == b)
        rows.append(np.array([f for w in set(words) for f in toxicity.chunk_features(w)], "<i4"))
        labels.append(y)
    model = toxicity.fit(rows, np.array(labels, float))
    got = model.scores(model.rows([toxicity.chunk_features(a) + toxicity.chunk_features(b) for a in ("trottel", "blume") for b in ("volk", "garten")]))
    assert got[0] > 0.9 and got[3] > 0.9 and got[1] < 0.1 and got[2] < 0.1


def test_shards_are_exact_and_gapless(spark, docs, empty):
    rows = sharding.shuffle_to_shards(docs.unionByName(docs), shards=4, block_rows=4).collect()
    by = Counter(r.shard for r in rows)
    assert max(by.values()) - min(by.values()) <= 1 and len(rows) == 2 * len(CASES)
    for s, n in by.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter({k: 2 * v for k, v in Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in CASES).items()})
    assert sharding.shuffle_to_shards(empty).count() == 0
    matrix = sharding.communication_matrix(np.array([3, 0, 10, 7]), 6, 1)
    assert matrix.sum(1).tolist() == [3, 0, 10, 7] and set(matrix.sum(0)) <= {3, 4}


def test_draws_from_very_many_rows_are_exact():
    class Exact:
        """Draws whole numbers only: no limit law stands in for the hypergeometric one."""

        def __init__(self, seed):
            rng = np.random.default_rng(seed)
            self.integers, self.hypergeometric = rng.integers, rng.hypergeometric

    total, rng = 3 * 10**9, Exact(3)
    got = Counter(sharding._draw(rng, total // 4, total - total // 4, 2) for _ in range(20_000))
    assert all(abs(got[k] / 20_000 - p) < 0.02 for k, p in ((0, 9 / 16), (1, 6 / 16), (2, 1 / 16)))
    # the other ways round: few marked rows, and all but a few drawn
    got = Counter(sharding._draw(rng, 2, total - 2, total // 4) for _ in range(20_000))
    assert all(abs(got[k] / 20_000 - p) < 0.02 for k, p in ((0, 9 / 16), (1, 6 / 16), (2, 1 / 16)))
    assert sharding._draw(rng, total - 5, 5, total - 1) in (total - 5, total - 6)
    matrix = sharding.communication_matrix(np.array([total, 40_000, 7]), 1, 1)
    assert matrix.tolist() == [[total], [40_000], [7]]


def test_html_by_host_paths(spark):
    page = lambda body: f"<html><head><title>t</title></head><body><nav>menu</nav><div class='ad-1'>buy</div>{body}<footer>f</footer>"
    main = "<div class='c12 x'><h1>Ti&amp;le</h1><p>First <b>bo</b>ld<br>line<p>two &lt;3<script>var a='</p>'</script></div><section class=comments><p>long long long reader comment</p></section>"
    rows = [(1, "http://h/1", page(main)), (2, "http://H/2", page(main.replace("c12", "c7"))), (3, "http://h/3", None), (4, None, "plain text"), (5, "http://h/5", "<p>only"), (5, "http://h/5", "<p>only")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (1000, 0):
        got = Counter((r.page_id, r.text) for r in html_extract.extract_pages(frame, broadcast_hosts=limit).collect())
        text = "Ti&le First bold line two <3"
        assert got == Counter({(1, text): 1, (2, text): 1, (3, ""): 1, (4, "plain text"): 1, (5, "only"): 2})
    assert html_extract.extract_pages(frame.where("false")).count() == 0


def test_html_paths_hold_the_whole_chain(spark):
    """The article alone, below more than 400 characters of chain and where siblings differ in the third mark only."""
    deep = "".join(f"<section class='builder-section layout-{x} stretched'><div class='builder-container width-{x}'><div class='builder-column size-{x}'><div class='builder-wrap populated-{x}'>" for x in ("outer", "middle", "inner", "last"))
    text, teaser = "the text of the article itself " * 9, "teaser of another page "
    marked = f"<div class='col pad article-body'>{text}</div><div class='col pad teaser-list'>{teaser}</div>"
    rows = [(1, "http://deep/1", f"<body>{deep}<article>{text}</article><p>{teaser}</p></body>"), (2, "http://wide/1", f"<body>{marked}</body>"), (3, "http://wide/2", f"<body>{marked.replace('col pad article-body', 'pad article-body col')}</body>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (1000, 0):
        got = html_extract.extract_pages(frame, broadcast_hosts=limit).collect()
        assert {r.page_id: r.text for r in got} == dict.fromkeys((1, 2, 3), text.strip())
        assert {len(r.path) for r in got} == {32} and len({r.path for r in got}) == 2


def test_html_wrappers_named_after_what_they_sit_beside(spark):
    text, note = "the text of the article itself " * 9, "a note that nobody asked for "
    junk = f"<div class='share-buttons'>{note}</div><div class='comments-area'>{note * 40}</div><section class='comments'><article>{note * 40}</article></section><div class='sidebar'><article>{note}</article></div>"
    bodies = [f"<div class='{c}'><div class='entry'><h2 class='section-header'>Head</h2><p>{text}</p></div></div>{junk}" for c in ("content-sidebar-wrap", "has-sidebar", "site-content no-sidebar", "side-by-side", "entry-content social-enabled", "entry comments-open", "content-comments-wrap")]
    bodies += [f"<div class='sidebar'><article><h2 class='section-header'>Head</h2><p>{text}</p></article></div>{junk}", f"<div class='discussion'><main><h2>Head</h2>{text}</main></div>{junk}"]
    # nothing is left without the wrapper, so the page is taken without the rule
    bodies += [f"<div class='search'><h2>Head</h2>{text}</div>"]
    # a comment inside the article goes, however long it is
    bodies += [f"<article><h2>Head</h2>{text}<div id='comments'><article>{note * 40}</article></div></article>"]
    rows = [(i, f"http://host{i}/", f"<body>{b}</body>") for i, b in enumerate(bodies)]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == dict.fromkeys(range(len(bodies)), f"Head {text}".strip())


def brute_print(text):
    """The fingerprint of a text by plain voting; word pairs hashed as Spark's xxhash64 does, each column seeding the next."""
    words = [w for w in (text or "").lower().replace("\x0b", " ").split() if w]
    pairs = list(zip(words, words[1:], strict=False)) or [(w,) for w in words]
    votes = [0] * 128
    for pair in pairs:
        h = 42
        for w in pair:
            h = xxhash.xxh64_intdigest(w.encode(), seed=h)
        g = xxhash.xxh64_intdigest(struct.pack("<i", 1), seed=xxhash.xxh64_intdigest(struct.pack("<Q", h), seed=42))
        for half, value in enumerate((h, g)):
            for bit in range(64):
                votes[64 * half + bit] += 1 if value >> bit & 1 else -1
    return "".join(f"{sum(1 << b for b in range(64) if votes[64 * half + b] > 0):016x}" for half in (0, 1))


def test_simhash_columns_against_brute_force(spark, empty):
    rng = np.random.default_rng(2)
    # sparse, hashed and null ids, repeated ids with other texts, equal texts
    rows = [(int(i), t) for i, t in zip(rng.integers(-(2**62), 2**62, len(CASES)), [t for _, t in CASES], strict=True)] + [(None, f"null {k} id") for k in range(5)] + [(7, f"same id {k}") for k in range(5)]
    tie = lambda t: (h := xxhash.xxh64_intdigest((t or "").encode(), seed=42)) - ((h >> 63) << 64)
    ordered = sorted(rows, key=lambda c: (c[0] is not None, c[0] or 0, tie(c[1])))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in simhash.edited_fingerprints(frame).collect())
    want = Counter()
    like = lambda a, b: round(1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128, 9)
    for (i, t), (_, nxt) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        t, nxt = t or "", nxt or ""
        m = len(t) // 2
        edited = t[: len(t) - m] + nxt[:m]
        a, b, c = brute_print(t), brute_print(edited), brute_print(nxt)
        want[(i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, like(a, b), like(a, c))] += 1
    assert got == want
    assert simhash.edited_fingerprints(empty).count() == 0


@pytest.mark.parametrize("bucket_rows, level", [(64, 1024), (2, 4), (1, 1024)])
def test_next_rows_over_buckets(spark, bucket_rows, level):
    rows = [(int(i) ** 3, f"t{i}") for i in range(37)] + [(None, "n1"), (None, "n2"), (5, "five"), (5, "six")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    tie = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), seed=42)) - ((h >> 63) << 64)
    ordered = [t for _, t in sorted(rows, key=lambda c: (c[0] is not None, c[0] or 0, tie(c[1])))]
    got = {r.text: r.next_text for r in simhash.with_next(frame, ["text"], bucket_rows, level).collect()}
    assert got == dict(zip(ordered, ordered[1:] + ordered[:1], strict=True))


def test_near_fingerprints_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [int.from_bytes(rng.bytes(16), "big") for _ in range(15)]
    prints = base + [b ^ sum(1 << int(i) for i in rng.choice(128, k, replace=False)) for b in base for k in (0, 2, 3, 4)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = spark.createDataFrame([(i, signed(p >> 64), signed(p & (1 << 64) - 1)) for i, p in enumerate(prints)], "doc_id long, f0 long, f1 long")
    pairs, members = simhash.near_pairs(rows, 3)
    first = {p: prints.index(p) for p in prints}
    want = {frozenset((first[p], first[q])) for p in first for q in first if p != q and (p ^ q).bit_count() <= 3}
    assert {frozenset((r.a, r.b)) for r in pairs.collect()} == want and members.count() == len(prints)
    counted = {(r.f0 % (1 << 64) << 64) + r.f1 % (1 << 64): r.n_near for r in simhash.near_counts(rows.select("f0", "f1"), 3).collect()}
    assert counted == {p: sum(first[p] in pair for pair in want) for p in first}


def brute_components(rows, words, t):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()
    comp = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and comp[i] != comp[j] and len(sets[i] & sets[j]) * t.denominator >= len(sets[i] | sets[j]) * t.numerator:
                a, b = sorted((comp[i], comp[j]))
                comp = {k: a if c == b else c for k, c in comp.items()}
    return {i: (len(sets[i]), comp[i]) for i in sets}


@pytest.mark.parametrize("small_region, few_blocks", [(2048, 16), (3, 1), (3, 16)])
def test_jaccard_components_against_brute_force(spark, small_region, few_blocks):
    rng = np.random.default_rng(9)
    passage = [f"p{i}" for i in range(25)]
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A b"), (5, "a b c")]
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(60)]
        for c in range(9):
            w = list(base)
            for _ in range(c // 2):
                w[int(rng.integers(0, 60))] = f"n{int(rng.integers(0, 1000))}"
            rows.append((100 + 20 * g + c, " ".join(w)))
    rows += [(300 + i, " ".join(passage + [f"o{i}x{k}" for k in range(int(rng.integers(2, 20)))])) for i in range(25)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame, 4, "0.85", small_region=small_region, few_blocks=few_blocks).collect()}
    assert got == brute_components(rows, 4, Fraction("0.85"))


def test_jaccard_defined_cases(spark, docs, empty):
    got = jaccard_join.jaccard_components(docs, 5, "0.8").collect()
    assert len(got) == len(CASES) and all(r.component_id is None for r in got if r.doc_id is None)
    want = brute_components([(i, t) for i, t in CASES if i is not None], 5, Fraction("0.8"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_jaccard_reads_only_sets_that_may_be_linked(spark):
    """A passage that all documents quote is less than what linked sets share, so none of their sets is read."""
    passage = [f"p{i}" for i in range(12)]
    rows = [(i, " ".join(passage + [f"o{i}x{k}" for k in range(200)])) for i in range(30)]
    near = [f"n{k}" for k in range(200)]
    rows += [(100 + i, " ".join(near[:150] + [f"e{i}"] + near[151:])) for i in range(3)]
    join = jaccard_join.JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string"), 5, Fraction("0.8"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in join.components().collect()}
    assert got == brute_components(rows, 5, Fraction("0.8"))
    assert join.members.count() == 3
    # a part travels as a word and a tag, whatever the number of shared ones
    packs = join.dealt_parts().agg(F.sum(F.octet_length("parts")).alias("bytes")).first()
    assert 0 < packs.bytes <= 8 * sum(n for n, _ in got.values())


def test_jaccard_sets_of_equal_tags_meet(spark, monkeypatch):
    """Tags that tell no sets apart lose no link."""
    keys = jaccard_join._set_keys
    monkeypatch.setattr(jaccard_join, "_set_keys", lambda *a: keys(*a) & np.uint64(0xFFFFFFFF00000000))
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join([f"x{i}"] + base[1:])) for i in range(4)] + [(9, "a b c d e f")]
    join = jaccard_join.JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string"), 3, Fraction("0.8"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in join.components().collect()} == brute_components(rows, 3, Fraction("0.8"))


@pytest.mark.parametrize("few_blocks", [1, 16])
def test_voronoi_regions_and_blocks_lose_no_link(spark, few_blocks):
    """One large region of near copies, in which pivots and blocks must meet all linked sets."""
    rng = np.random.default_rng(12)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for i in range(120):
        words = list(base)
        for at in rng.choice(80, int(rng.integers(0, 7)), replace=False):
            words[at] = f"x{i}y{at}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 2, "0.85", small_region=8, few_blocks=few_blocks).collect()}
    assert got == brute_components(rows, 2, Fraction("0.85"))


def test_packing(spark, docs, empty):
    tokenizer = Tokenizer.from_file(PATH)
    rows = packing.pack_documents(docs, PATH, capacity=64, group_pieces=32).collect()
    want = Counter()
    for i, t in CASES:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want.update((i, s, len(ids[s : s + 64]), zlib.crc32(np.array(ids[s : s + 64], "<u4").tobytes()), len(ids)) for s in range(0, len(ids), 64))
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(empty, PATH).count() == 0


def test_packing_keeps_large_ids_beside_null_ones(spark):
    ids = [(1 << 60) + 1, (1 << 60) + 3, None, None, None]
    frame = spark.createDataFrame([(i, "a few words") for i in ids], "doc_id long, text string")
    rows = packing.pack_documents(frame, PATH, group_pieces=64).collect()
    assert Counter(r.doc_id for r in rows) == Counter(ids) and len({(r.sequence_id, r.offset) for r in rows}) == 5


def test_packing_ids_are_the_librarys():
    tokenizer, own = Tokenizer.from_file(PATH), packing.TextIds(PATH)
    rng = np.random.default_rng(7)
    # the long run of white space is more than the compiled encoder's pattern engine takes
    texts = ["".join(rng.choice(list(" \n\ta.'s1é<|é 9日"), int(rng.integers(0, 40)))) for _ in range(1000)] + ["x" + " " * 300_000 + "y", "a<|endoftext|> b", "ab" * 50_000, ""]
    assert own.compiled and [own.ids(t).tolist() for t in texts] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_best_fit_is_the_tightest():
    rng = np.random.default_rng(2)
    lengths = np.sort(rng.integers(1, 101, 400))[::-1]
    window, offset = packing.best_fit_decreasing(lengths, 100)
    left = []
    for n, w, o in zip(lengths, window, offset, strict=True):
        fits = [x for x in left if x >= n]
        if fits:
            assert 100 - o == min(fits) == left[w]
            left[w] -= n
        else:
            assert w == len(left) and o == 0
            left.append(100 - n)


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 9000, 200_000])
def test_matroska_round_trip(n):
    payload = matroska.padded(os.urandom(n))
    data = matroska.write(payload)
    assert matroska.read_payload(data) == payload and len(payload) % 576 == 0
    found, cues, scale, codecs = matroska.packets(data)
    assert [p.timestamp + p.frame * 576 for p in found] == list(range(0, len(payload), 576)) and cues and codecs == {1: "A_PCM/INT/LIT"}
    with pytest.raises(ValueError):
        matroska.packets(data[:-1])


def test_matroska_queries(spark, docs, empty):
    media = matroska.store_texts(docs)
    for r in matroska.read_features(media).collect():
        assert r.payload_bytes % 576 == 0 and r.payload_bytes >= max(576, r.n_bytes)
    table = matroska.packet_table(media)
    assert table.where("error IS NOT NULL").count() == 0 and table.where("byte_length = 576").count() == table.count()
    assert matroska.packet_table(spark.createDataFrame([(1, b"x"), (2, None)], "doc_id long, media binary")).where("error IS NOT NULL").count() == 2
    assert matroska.read_features(matroska.store_texts(empty)).count() == 0


def test_bpe_is_the_library(spark, docs, empty):
    tokenizer = Tokenizer.from_file(PATH)
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list(" \n\ta.'s1é<|é 9日"), int(rng.integers(0, 30)))) for _ in range(1500)] + ["a  b <|endoftext|>\n x", "a" * 5000, *[t or "" for _, t in CASES]]
    for own in (bpe.Encoder(PATH), bpe.Encoder(PATH, speculate=False)):
        got = [np.frombuffer(x, "<u4").tolist() for x in own.encode_batch(texts)]
        want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert got == want
    assert [own.decode(x) for x in want] == [tokenizer.decode(x, skip_special_tokens=False) for x in want]
    assert all(own.merge(b) == [i] for i, b in enumerate(own.token_bytes) if b and i not in own.special.values())
    assert {r.doc_id: r.decoded for r in bpe.round_trip(docs, PATH).collect()}[12] == dict(CASES)[12]
    assert bpe.round_trip(empty, PATH).count() == 0 and bpe.decode_ids(bpe.encode_documents(docs, PATH), PATH).count() == len(CASES)


def test_pipeline_keeps_and_drops(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{sf}/documents.parquet")
    docs = source
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == source.columns and 0.7 * docs.count() <= after.count() <= docs.count(), name
        docs = after.cache()
    left = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").distinct().collect()} == left


def test_pipeline_defined_cases(spark, tmp_path):
    """Null and repeated ids, empty and long texts, repeated rows, an empty table, and columns named like the operators' own."""
    import corpus_pipeline

    copy = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, copy), (2, copy), (2, "a text of its own that nobody else in this table has written"), (3, copy), (3, copy), (None, "nobody knows whose text this one is but it is whole"), (None, copy), (4, None), (5, ""), (6, "long " * 20000)]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, "k", [3], 0.5, 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n_lines int, n_dropped int, kept_text string, _drops array<int>, score double, carried int")
    labels = spark.createDataFrame([(i, 0, int(i == 3)) for i in range(1, 5)], "doc_id long, quality int, toxic int")
    for name, table in (("whole", frame), ("empty", frame.where("false"))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        sf = f"{tmp_path}/{name}"
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        stages = dict(corpus_pipeline.STAGES)
        for stage in ("toxicity", "line_dedup", "jaccard_join"):
            out = stages[stage](spark, docs, sf)
            assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            if stage == "jaccard_join":
                left = Counter((r.doc_id, r.text) for r in out.collect())
                assert left == (Counter((i, t) for i, t in rows if t != copy) + Counter([(1, copy)]) if name == "whole" else Counter())
            else:
                assert out.count() == (len(rows) if name == "whole" else 0)
        assert corpus_pipeline.run(spark, sf).count() == (7 if name == "whole" else 0) or name == "whole"

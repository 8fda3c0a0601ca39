"""SimHash in DataFrame operations only, and permuted block tables to search it.

A text's terms are its pairs of adjacent words (a lone word is a term); each occurrence votes once, so a term weighs
as often as it occurs. A term's 128-bit hash votes for a bit where it has a one and against it where it has a zero.
Votes are counted packed, two 32-bit counters in one long, as plain sums that combine before any shuffle: one row per
text crosses the network, whatever its length.

`near_pairs` finds all fingerprints within a Hamming radius: with the bits cut into blocks, two fingerprints that
differ in `radius` bits agree on all blocks but `radius` at least once; there is one table per choice of blocks that
may differ, keyed by the others, so each table is an equi-join.

Defined results: a null or empty text, or one of white space, has the fingerprint of all zeros; a tied bit is zero;
equal texts have equal fingerprints; documents follow each other by (doc_id, hash of the text), null ids first, and the last
one is followed by the first, so that a lone document follows itself; repeated rows follow each other; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import slim
from kindred.plans.session import cut

#: Fixed value: a word is a run of anything but these (the white space of the contracts).
WORD_BREAK = r"[ \t\n\x0B\f\r]+"
#: Rows of a bucket at least, and buckets at most (two levels of bounds, LEVEL each, 16 bytes a bound).
BUCKET_ROWS, LEVEL = 64, 1024
_PACK = 0x0000000100000001
BITS = 128
#: Bits in which two fingerprints may differ and still be found by the block tables.
RADIUS = 3


def _place() -> Column:
    """What orders rows: the id (null first), then a hash of the text. Rows equal in both hold equal texts, in any order."""
    return F.struct(F.col("doc_id"), F.xxhash64("text").alias("tie"))


def bucket_bounds(rows: DataFrame, bucket_rows: int = BUCKET_ROWS, level: int = LEVEL) -> list[tuple]:
    """The first place of each bucket, in order: places are sorted by range, numbered, and each so-manieth one is taken.

    Buckets hold equal numbers of places however the ids are spread. The driver gets one row per written partition and
    at most level * level bounds.
    """
    places = rows.select(_place().alias("p")).distinct()
    ordered = cut(places.repartitionByRange("p").sortWithinPartitions("p").select("p", F.monotonically_increasing_id().alias("at")))
    sizes = {r.part: r.n for r in ordered.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    step = max(bucket_rows, -(-sum(sizes.values()) // (level * level)))
    if not sizes:
        return []
    before, shift = 0, []
    for part in sorted(sizes):
        shift.append((part, before))
        before += sizes[part]
    offsets = rows.sparkSession.createDataFrame(shift, "part long, before long")
    at = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    taken = ordered.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(offsets), "part").where(at % step == 0).select("p.doc_id", "p.tie", at.alias("at"))
    return [(r.doc_id, r.tie) for r in sorted(taken.toLocalIterator(), key=lambda r: r.at)]


def _rank(bounds: Column, place: Column) -> Column:
    """How many bounds are at most `place`, less one."""
    return F.size(F.filter(bounds, lambda b: b <= place)) - 1


def with_next(rows: DataFrame, columns: list[str], bucket_rows: int = BUCKET_ROWS, level: int = LEVEL) -> DataFrame:
    """`rows` (doc_id, text and more) with next_<column> of the following row, the first row following the last, and _bucket.

    Rows are dealt to buckets of neighbours, and the first row of each bucket goes to the bucket before it as well: one
    shuffle of the rows, and no window spans the table. The result stays dealt by _bucket.
    """
    bounds = bucket_bounds(rows, bucket_rows, level)
    kind = "array<struct<doc_id:bigint,tie:bigint>>"
    table = rows.sparkSession.createDataFrame([(k, bounds[a : a + level]) for k, a in enumerate(range(0, len(bounds), level))], f"_upper int, _bounds {kind}")
    first = F.array(*[F.struct(F.lit(i).cast("long").alias("doc_id"), F.lit(t).cast("long").alias("tie")) for i, t in bounds[::level]]).cast(kind)
    # at most `level` rows of `level` bounds
    known = rows.withColumn("_p", _place()).withColumn("_upper", _rank(first, F.col("_p"))).join(F.broadcast(table), "_upper")
    known = known.withColumn("_lower", _rank(F.col("_bounds"), F.col("_p"))).withColumn("_own", F.col("_upper").cast("long") * level + F.col("_lower"))
    last = len(bounds) - 1
    before = F.when(F.col("_own") > 0, F.col("_own") - 1).otherwise(F.lit(max(last, 0)).cast("long"))
    own = F.struct(F.col("_own").alias("b"), F.lit(False).alias("guest"))
    guest = F.struct(before.alias("b"), F.lit(True).alias("guest"))
    copies = F.when(F.get("_bounds", F.col("_lower")) == F.col("_p"), F.array(own, guest)).otherwise(F.array(own))
    dealt = known.withColumn("_copy", F.explode(copies)).select(*rows.columns, F.col("_p"), F.col("_copy.b").alias("_bucket"), F.col("_copy.guest").alias("_guest"))
    order = Window.partitionBy("_bucket").orderBy("_guest", "_p")
    found = dealt.withColumn("_next", F.lead(F.struct(*[F.col(c) for c in columns])).over(order)).where("NOT _guest")
    return found.select(*rows.columns, "_bucket", *[F.col("_next").getField(c).alias(f"next_{c}") for c in columns])


def _voted(hashes: list[Column]) -> list[Column]:
    """Sums that count, for each bit of each hash, the terms that have it set: two counters in each long."""
    return [F.sum(F.shiftright(h, j).bitwiseAND(F.lit(_PACK))).alias(f"s{k}_{j}") for k, h in enumerate(hashes) for j in range(32)]


def _word(k: int) -> Column:
    """64 bits of the fingerprint from the counters: a bit is set where more than half of the terms have it."""
    out = F.lit(0).cast("long")
    for j in range(32):
        s = F.coalesce(F.col(f"s{k}_{j}"), F.lit(0).cast("long"))
        low, high = s.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(s, 32)
        out = out.bitwiseOR(F.when(low * 2 > F.col("terms"), F.lit(1 << j)).otherwise(F.lit(0).cast("long")))
        out = out.bitwiseOR(F.when(high * 2 > F.col("terms"), F.lit((1 << (j + 32)) - (1 << 64 if j == 31 else 0))).otherwise(F.lit(0).cast("long")))
    return out


def fingerprint_texts(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """`keys` with f0, f1 (the fingerprint's halves) of the text of each key; keys must tell the rows apart."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), WORD_BREAK), lambda w: w != "")
    each = rows.select(*keys, words.alias("_words")).select(*keys, "_words", F.posexplode_outer("_words").alias("_at", "_word"))
    # a pair starts at each word but the last; a lone word stands for itself
    first = F.when((F.col("_at") + 1 < F.size("_words")) | (F.size("_words") == 1), F.xxhash64("_word", F.get("_words", F.col("_at") + 1)))
    terms = each.select(*keys, first.alias("_h0")).withColumn("_h1", F.when(F.col("_h0").isNotNull(), F.xxhash64("_h0", F.lit(1))))
    counted = terms.groupBy(*keys).agg(F.count("_h0").alias("terms"), *_voted([F.col("_h0"), F.col("_h1")]))
    return counted.select(*keys, _word(0).alias("f0"), _word(1).alias("f1"))


def hex_of(f0: str, f1: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(f0), 16, "0"), F.lpad(F.hex(f1), 16, "0")))


def likeness(a: tuple[str, str], b: tuple[str, str]) -> Column:
    """Share of equal bits."""
    return 1 - sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(a, b, strict=True)), F.lit(0)) / F.lit(float(BITS))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, f0, f1 of each row."""
    rows = slim(docs, id_col, text_col).withColumn("_row", F.monotonically_increasing_id())
    return fingerprint_texts(rows, ["_row", "doc_id"], "text").select("doc_id", hex_of("f0", "f1").alias("fingerprint"), "f0", "f1")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document: the columns of the contract."""
    rows = slim(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    half = F.expr("cast(n_chars div 2 as int)")
    pair = with_next(rows, ["text"]).withColumn("n_chars", F.length("text").cast("long"))
    pair = pair.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars - n_chars div 2 as int))"), F.substring(F.col("next_text"), F.lit(1), half)))
    both = pair.withColumn("_row", F.monotonically_increasing_id()).select(
        "_bucket", "_row", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.xxhash64("text").alias("_tie"), F.xxhash64("next_text").alias("_next"), F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("body")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("body")))).alias("one")
    )
    # with _bucket among the keys the votes are counted where the rows already lie
    keys = ["_bucket", "_row", "doc_id", "n_chars", "edited_sha256", "_tie", "_next", "which"]
    found = fingerprint_texts(both.select(*keys[:-1], "one.which", "one.body"), keys, "body")
    mine = lambda which, c: F.max(F.when(F.col("which") == which, F.col(c)))
    wide = cut(found.groupBy(*keys[:-1]).agg(mine(0, "f0").alias("f0"), mine(0, "f1").alias("f1"), mine(1, "f0").alias("e0"), mine(1, "f1").alias("e1")))
    # equal texts have equal fingerprints, so the next document's is any one of its text's
    prints = wide.groupBy(F.col("_tie").alias("_next")).agg(F.min("f0").alias("next_f0"), F.min("f1").alias("next_f1"))
    near = near_counts(wide.select("f0", "f1"))
    return wide.join(prints, "_next").join(near, ["f0", "f1"]).select(
        "doc_id", "n_chars", "edited_sha256", hex_of("f0", "f1").alias("fingerprint"), hex_of("e0", "e1").alias("edited_fingerprint"),
        likeness(("f0", "f1"), ("e0", "e1")).alias("near_edited"), likeness(("f0", "f1"), ("next_f0", "next_f1")).alias("near_next"), "n_near",
    )


def _apart() -> Column:
    return F.bit_count(F.col("a.f0").bitwiseXOR(F.col("b.f0"))) + F.bit_count(F.col("a.f1").bitwiseXOR(F.col("b.f1")))


def near_counts(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """f0, f1 of each different fingerprint, with n_near, how many other fingerprints are within `radius` bits.

    One table per block, of radius + 1; a pair counts in the first table in which it meets, so that no pair is handed on.
    """
    classes = cut(prints.distinct())
    blocks = radius + 1
    # blocks of equal numbers of bits, none across the halves
    keyed = classes.select("f0", "f1", F.array(*_blocks(blocks)).alias("blocks")).select("*", F.posexplode("blocks").alias("t", "key"))
    a, b = keyed.alias("a"), keyed.alias("b")
    met = a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.key") == F.col("b.key")) & ((F.col("a.f0") != F.col("b.f0")) | (F.col("a.f1") != F.col("b.f1"))) & (_apart() <= radius))
    earlier = F.exists(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: (i < F.col("a.t")) & (F.get(F.col("a.blocks"), i) == F.get(F.col("b.blocks"), i)))
    counted = met.where(~earlier).groupBy(F.col("a.f0").alias("f0"), F.col("a.f1").alias("f1")).agg(F.count(F.lit(1)).alias("n_near"))
    return classes.join(counted, ["f0", "f1"], "left").select("f0", "f1", F.coalesce("n_near", F.lit(0)).alias("n_near"))


def _blocks(blocks: int) -> list[Column]:
    """The bits of f0, f1 in blocks, as text where a block lies across the halves."""
    bounds = [round(i * BITS / blocks) for i in range(blocks + 1)]
    out = []
    for first, end in zip(bounds, bounds[1:], strict=False):
        parts = []
        for half, base in (("f0", 0), ("f1", 64)):
            lo, hi = max(first, base) - base, min(end, base + 64) - base
            if hi > lo:
                mask = (1 << (hi - lo)) - 1
                parts.append(F.shiftrightunsigned(F.col(half), lo).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
        out.append(F.xxhash64(*parts))
    return out


def near_pairs(prints: DataFrame, radius: int = RADIUS, blocks: int = 6) -> tuple[DataFrame, DataFrame]:
    """All pairs of different fingerprints within `radius` bits, and the members of each fingerprint.

    `prints` has doc_id, f0, f1. The first table is (a, b, distance) between class representatives (least doc_id, a < b
    by fingerprint); the second is (class_id, doc_id). Equal fingerprints meet in the membership, never as pairs.
    """
    if blocks <= radius:
        raise ValueError("more blocks than bits that may differ are needed")
    classes = prints.groupBy("f0", "f1").agg(F.min("doc_id").alias("class_id"))
    own = _blocks(blocks)
    tables = [F.struct(F.lit(t).alias("t"), F.concat_ws("|", *[own[i] for i in range(blocks) if i not in may_differ]).alias("key")) for t, may_differ in enumerate(combinations(range(blocks), radius))]
    keyed = classes.select("f0", "f1", "class_id", F.explode(F.array(*tables)).alias("slot")).select("f0", "f1", "class_id", "slot.t", "slot.key")
    a, b = keyed.alias("a"), keyed.alias("b")
    apart = _apart()
    before = (F.col("a.f0") < F.col("b.f0")) | ((F.col("a.f0") == F.col("b.f0")) & (F.col("a.f1") < F.col("b.f1")))
    pairs = a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.key") == F.col("b.key")) & before & (apart <= radius))
    pairs = pairs.select(F.col("a.class_id").alias("a"), F.col("b.class_id").alias("b"), apart.alias("distance")).distinct()
    return pairs, prints.join(classes, ["f0", "f1"]).select("class_id", "doc_id")

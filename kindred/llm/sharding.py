"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

The rows (id, size, crc) are written once, which fixes the blocks they lie in. For each block a row of the matrix says
how many of its rows go to each shard; the rows are drawn from multivariate hypergeometric laws, so that the matrix
has just the distribution it would have under a uniform shuffle, and its column sums are the shard sizes, exactly.
Each block is permuted locally and cut by its matrix row, the rows are exchanged, and each shard is permuted again
(in buckets whose sizes are counted, so that no shard has to fit into one task).

The law is `rows`: the counts of any two shards differ by one at most, whatever the rows hold. Groups of equal texts
are spread like any other rows, so a hot text cannot load one shard.

Defined results: a null text has size 1 and crc32 0, like an empty one; null and repeated doc_ids are rows like any
others; with fewer rows than shards some shards get none; an empty table gives an empty result; other columns are ignored. Draws depend on the
seed and on the block sizes alone, so a repeated run over the same files gives the same result.

The driver holds the matrix alone, one row of counts per block: 16 counts for 2^15 rows, 40 MB at 10^10 rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import slim
from kindred.plans.session import cut

#: Rows of a block at most, and of a bucket of a shard on average: what one window holds.
BLOCK_ROWS = 1 << 15
#: Rows drawn at once where the total is past numpy's limit.
DRAWN_AT_ONCE = 1 << 20


def communication_matrix(blocks: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Rows to send from each block to each shard: row sums are `blocks`, column sums differ by one at most."""
    total = int(blocks.sum())
    left = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    rng = np.random.default_rng(seed)
    out = np.zeros((len(blocks), shards), np.int64)
    for i, n in enumerate(blocks):
        # a chain of univariate draws: exact for any population size, as the multivariate one with "marginals" would be
        need, rest = int(n), int(left.sum())
        for s in range(shards):
            rest -= int(left[s])
            out[i, s] = _draw(rng, int(left[s]), rest, need)
            need -= int(out[i, s])
        left -= out[i]
    return out


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    if not n or not good:
        return 0
    if not bad:
        return n
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    # past numpy's limit: marked and drawn rows, and drawn and left ones, can change places without changing the law
    total = good + bad
    if n > total - n:
        return good - _draw(rng, good, bad, total - n)
    if good < n:
        return _draw(rng, n, total - n, good)
    # the least of the counts is drawn row by row, some at a time, without repeats
    found = 0
    while n:
        some = min(n, DRAWN_AT_ONCE)
        rows = np.unique(rng.integers(0, total, some))
        while len(rows) < some:
            rows = np.union1d(rows, rng.integers(0, total, some - len(rows)))
        hits = int((rows < good).sum())
        found, good, total, n = found + hits, good - hits, total - some, n - some
    return found


def shuffle_to_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, seed: int = 7, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of `docs`."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = cut(slim(docs, id_col, text_col).select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("rid")))
    # the low 33 bits of rid count within the partition, so a block is a stretch of one written partition
    rows = rows.withColumn("block", F.expr(f"(rid >> 33) * {(1 << 33) // block_rows} + (rid & {(1 << 33) - 1}) div {block_rows}"))
    sizes = sorted(rows.groupBy("block").agg(F.count(F.lit(1)).alias("n")).toLocalIterator(), key=lambda r: r.block)
    matrix = communication_matrix(np.array([r.n for r in sizes], np.int64), shards, seed)
    cuts = spark.createDataFrame([(r.block, [int(x) for x in np.cumsum(m)]) for r, m in zip(sizes, matrix, strict=True)], "block long, cuts array<long>")
    mixed = F.xxhash64("rid", F.lit(seed))
    local = rows.withColumn("rank", F.row_number().over(Window.partitionBy("block").orderBy(mixed, "rid")))
    sent = local.join(cuts, "block").withColumn("shard", F.expr("cast(size(filter(cuts, c -> c < rank)) as int)"))
    buckets = max(1, -(-sum(r.n for r in sizes) // (shards * block_rows)))
    again = F.xxhash64("rid", F.lit(seed + 1))
    sent = sent.withColumn("again", again).withColumn("bucket", F.pmod(F.shiftrightunsigned("again", 40), F.lit(buckets)))
    sent = cut(sent.select("doc_id", "size", "text_crc32", "rid", "shard", "bucket", "again"))
    counts = sent.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("first", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = sent.withColumn("at", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("again", "rid")))
    return ranked.join(before.drop("n"), ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("first") + F.col("at") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )

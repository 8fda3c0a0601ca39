"""Row numbers over a whole table without a window that spans it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.plans.session import cut

_IN_PART = (1 << 33) - 1


def numbered(rows: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """`rows` with `name`, 0 and up without gaps, in `order`: sorted by range, and each partition's count shifts the later ones.

    `order` must tell rows apart for the numbers to be repeatable. The driver gets one row per partition.
    """
    ordered = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = sorted((r.part, r.n) for r in ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).toLocalIterator())
    shifts, before = [], 0
    for k, n in sizes:
        shifts.append((k, before))
        before += n
    table = rows.sparkSession.createDataFrame(shifts, "_part long, _before long")
    placed = ordered.withColumn("_part", part).join(F.broadcast(table), "_part")
    return placed.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit(_IN_PART))).drop("_at", "_part", "_before")


def chunked(rows: DataFrame, order: list[str], chunks: int, name: str = "chunk") -> DataFrame:
    """`rows` with `name`, 1 to `chunks`: contiguous stretches of the order whose sizes differ by one at most, larger ones first."""
    placed = numbered(rows, order, "_place")
    total = placed.count()
    small, larger = divmod(total, chunks)
    edge = larger * (small + 1)
    after = F.expr(f"(_place - {edge}) div {max(small, 1)}") + larger
    return placed.withColumn(name, (F.when(F.col("_place") < edge, F.expr(f"_place div {small + 1}")).otherwise(after) + 1).cast("int")).drop("_place")

"""Which record of a group to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.features import pixels

POLICIES = ("lexi", "smallest", "largest", "highest-resolution", "newest", "oldest", "best-quality")


def quality_key() -> Column:
    """Not rejected, sharpness, closeness to mid brightness, pixels, size, path; without metrics the lowest of all."""
    known = F.col("blur_score").isNotNull()
    return F.struct(
        F.when(known, F.when(F.col("rejection_reason").isNull(), 1).otherwise(0)).otherwise(0).alias("ok"), F.coalesce("blur_score", F.lit(0.0)).alias("blur"),
        F.when(known, -F.abs(F.col("brightness") - 127.5)).otherwise(F.lit(-255.0)).alias("light"), F.when(known, pixels(F.col("width"), F.col("height"))).otherwise(F.lit(0).cast("long")).alias("px"), "size", "path",
    )


def _order(policy: str) -> tuple[Column, bool]:
    """Ordering key and whether the largest wins; ties go to the lowest idx."""
    px = pixels(F.col("width"), F.col("height"))
    keys = {
        "lexi": (F.struct("path", "idx"), False), "smallest": (F.struct("size", "idx"), False), "largest": (F.struct(F.col("size"), -F.col("idx")), True),
        "highest-resolution": (F.struct(px, F.col("size"), -F.col("idx")), True), "newest": (F.struct(F.col("mtime"), -F.col("idx")), True), "oldest": (F.struct("mtime", "idx"), False),
        "best-quality": (F.struct(quality_key(), -F.col("idx")), True),
    }
    if policy not in keys:
        raise ValueError(f"unknown keep policy {policy!r}; one of {', '.join(POLICIES)}")
    return keys[policy]


def keep(components: DataFrame, records: DataFrame, policy: str) -> DataFrame:
    """(group_id, keep): one partial aggregation, whatever the size of a group."""
    order, largest = _order(policy)
    members = components.join(records, "idx").withColumn("_order", order)
    return members.groupBy("group_id").agg((F.max_by if largest else F.min_by)("idx", "_order").alias("keep"))

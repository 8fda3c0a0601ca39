"""Reports: flat rows and nested documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUALITY = ["width", "height", "blur_score", "brightness", "rejection_reason"]
EVIDENCE = ["reason", "cosine", "phash_distance", "same_sha256", "confidence"]


def best_evidence(components: DataFrame, kept: DataFrame, pairs: DataFrame) -> DataFrame:
    """(group_id, keep, idx, EVIDENCE): per removed record its direct pair with the kept one, else its incident duplicate pair
    of best cosine (least partner on ties), else `grouped`."""
    gone = components.join(kept, "group_id").where("idx <> keep")
    dup = pairs.where("decision = 'duplicate'")
    either = dup.select(F.col("a").alias("idx"), F.col("b").alias("other"), *EVIDENCE).unionByName(dup.select(F.col("b").alias("idx"), F.col("a").alias("other"), *EVIDENCE))
    body = F.struct(*EVIDENCE)
    direct = gone.alias("g").join(either.alias("e"), (F.col("g.idx") == F.col("e.idx")) & (F.col("g.keep") == F.col("e.other"))).select(F.col("g.idx").alias("idx"), F.struct(*[F.col(f"e.{c}") for c in EVIDENCE]).alias("direct"))
    incident = either.groupBy("idx").agg(F.max_by(body, F.struct(F.coalesce("cosine", F.lit(-1.0)), -F.col("other"))).alias("incident"))
    none = F.struct(F.lit("grouped_duplicate").alias("reason"), F.lit(None).cast("double").alias("cosine"), F.lit(None).cast("int").alias("phash_distance"), F.lit(False).alias("same_sha256"), F.lit("grouped").alias("confidence"))
    found = gone.join(direct, "idx", "left").join(incident, "idx", "left").withColumn("p", F.coalesce("direct", "incident", none))
    return found.select("group_id", "keep", "idx", *[F.col(f"p.{c}").alias(c) for c in EVIDENCE])


def report_rows(components: DataFrame, kept: DataFrame, pairs: DataFrame, records: DataFrame) -> DataFrame:
    """One row per removed record, with paths."""
    path = records.select("idx", "path")
    rows = best_evidence(components, kept, pairs).join(path.withColumnRenamed("path", "duplicate_path"), "idx")
    return rows.join(path.select(F.col("idx").alias("keep"), F.col("path").alias("keep_path")), "keep").select("group_id", "keep_path", "duplicate_path", *EVIDENCE)


def with_quality(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """report_rows with `quality` of the duplicate and `keep_quality`, by path; NULL where a record has no quality."""
    own = judged.select("path", F.struct(*QUALITY).alias("q"))
    found = rows.join(own.select(F.col("path").alias("duplicate_path"), F.col("q").alias("quality")), "duplicate_path", "left")
    return found.join(own.select(F.col("path").alias("keep_path"), F.col("q").alias("keep_quality")), "keep_path", "left").select(*rows.columns, "quality", "keep_quality")


def report_groups(components: DataFrame, kept: DataFrame, pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Nested: group_id, keep, duplicates ARRAY<STRUCT<path, EVIDENCE>> sorted by path; with quality, also keep_quality and the
    quality of each duplicate. A group's members meet in one row here, so this form is for reports; report_rows is the one
    that scales with a group."""
    rows = report_rows(components, kept, pairs, records)
    if set(QUALITY) <= set(records.columns):
        rows = with_quality(rows, records)
        body = F.sort_array(F.collect_list(F.struct(F.col("duplicate_path").alias("path"), *EVIDENCE, "quality")))
        return rows.groupBy("group_id", F.col("keep_path").alias("keep")).agg(F.first("keep_quality").alias("keep_quality"), body.alias("duplicates"))
    return rows.groupBy("group_id", F.col("keep_path").alias("keep")).agg(F.sort_array(F.collect_list(F.struct(F.col("duplicate_path").alias("path"), *EVIDENCE))).alias("duplicates"))


def summary(components: DataFrame, pairs: DataFrame, records: DataFrame) -> DataFrame:
    """One row: total, duplicate_groups, duplicates_to_remove, duplicate_pairs, review_pairs."""
    sizes = components.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    groups = sizes.agg(F.count(F.lit(1)).alias("duplicate_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates_to_remove"))
    counted = pairs.agg(F.count_if(F.col("decision") == "duplicate").alias("duplicate_pairs"), F.count_if(F.col("decision") == "review").alias("review_pairs"))
    total = records.agg(F.count(F.lit(1)).alias("total"))
    return total.crossJoin(groups).crossJoin(counted)  # one row each


def selection_funnel(records: DataFrame, rejected: DataFrame, duplicates: DataFrame, failed: DataFrame, selected: DataFrame) -> DataFrame:
    """One row of counters; not_selected + selected is what was eligible after dedup."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = count(records, "total").crossJoin(count(rejected, "rejected_quality")).crossJoin(count(duplicates, "duplicates_removed"))
    out = out.crossJoin(count(failed, "embedding_failed")).crossJoin(count(selected, "selected"))
    eligible = F.col("total") - F.col("rejected_quality") - F.col("duplicates_removed") - F.col("embedding_failed")
    return out.withColumn("eligible_after_dedup", eligible).withColumn("not_selected", F.col("eligible_after_dedup") - F.col("selected"))


def rejected_list(quality: DataFrame, duplicates: DataFrame, failed: DataFrame, unselected: DataFrame, not_exported: DataFrame) -> DataFrame:
    """(reason, path) in the order of the stages; each input has `path`, quality also `rejection_reason`."""
    parts = [quality.select(F.lit(0).alias("stage"), F.col("rejection_reason").alias("reason"), "path")]
    for k, (df, reason) in enumerate(((duplicates, "duplicate"), (failed, "embedding_failed"), (unselected, "not_selected"), (not_exported, "export_failed")), 1):
        parts.append(df.select(F.lit(k).alias("stage"), F.lit(reason).alias("reason"), "path").distinct())
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

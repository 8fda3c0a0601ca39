"""The three workflows over folders of pictures, from options to report files and file actions."""

from __future__ import annotations

import os
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.decide import Thresholds
from kindred.functions.features import l2_normalize, parent, sha256
from kindred.functions.images import literal, measure_pictures
from kindred.operators import report
from kindred.operators.quality import QualityLimits, rejection_reason
from kindred.plans import workflows
from kindred.plans.session import cut
from kindred.sinks import files, preview, reports
from kindred.sources import cache
from kindred.sources.records import OWN_FOLDER, SUFFIXES, scan_table

#: Names of pictures for Spark's readers, whose patterns tell cases apart.
PICTURES = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in x[1:]) for x in SUFFIXES) + "}"


#: Files without cached features up to this many are read by name; if there are more, all files are.
BY_NAME = 10_000


def pictures(spark: SparkSession, scanned: DataFrame, places: list[str]) -> DataFrame:
    """Records of scanned files with digest, size, hash, quality and unit vector, read once and written. A file that can't be decoded,
    or whose name Spark's listing hides, stays as a record without them."""
    scanned = scanned.withColumn("parent", parent(F.col("path")))
    if not places:
        empty = {"sha256": "string", "width": "int", "height": "int", "phash": "string", "blur_score": "double", "brightness": "double", "embedding": "array<double>"}
        return scanned.withColumns({k: F.lit(None).cast(v) for k, v in empty.items()})
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", PICTURES).load([literal(p) for p in places])
    digests = raw.select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), sha256(F.col("content")).alias("sha256"))
    measured = measure_pictures(spark, places, vectors=True).withColumn("embedding", l2_normalize(F.col("embedding")))
    return cut(scanned.join(digests, "path", "left").join(measured, "path", "left"))


def cached_pictures(spark: SparkSession, scanned: DataFrame, places: list[str], root: str, model: str) -> DataFrame:
    """`pictures` without quality: features of unchanged files (path, size, mtime) come from the cache below `root`, the others
    are made and put there. Files that couldn't be decoded are tried again each time; rows of other folders stay."""
    store = cache.Snapshots(spark, os.path.join(os.path.realpath(root), OWN_FOLDER, "cache"))
    held = store.read()
    found = cut(cache.lookup(scanned.withColumn("parent", parent(F.col("path"))), held, model))
    complete = " AND ".join(f"{c} IS NOT NULL" for c in [*cache.METADATA, "embedding"])
    missing = found.where(f"NOT ({complete})").select(*scanned.columns)
    n = missing.count()
    if n == 0:
        return found.drop("cached")
    # at most BY_NAME names; a listing hides names that begin with a dot or underscore, so these are left out here too
    names = [r.path for r in missing.where("NOT element_at(split(path, '/'), -1) RLIKE '^[._]'").select("path").collect()] if n <= BY_NAME else places
    made = pictures(spark, missing, names).drop("blur_score", "brightness").withColumn("embedding", F.col("embedding").cast("array<float>"))
    rows = cut(found.where(complete).drop("cached").unionByName(made))
    fresh = rows.join(missing.select("idx"), "idx", "left_semi")
    store.write(cache.save_embeddings(cache.upsert_metadata(held, fresh), fresh, model, merge=True))
    return rows


def _records(spark: SparkSession, o: SimpleNamespace, scanned: DataFrame, places: list[str], quality: bool) -> DataFrame:
    """Quality isn't cached, so a run that needs it reads all files."""
    return pictures(spark, scanned, places) if quality else cached_pictures(spark, scanned, places, o.root, o.model)


def _thresholds(o: SimpleNamespace) -> Thresholds:
    return Thresholds(o.cosine_auto, o.cosine_verify, o.cosine_review, o.phash_auto_distance, o.phash_verify_distance)


def _matching(o: SimpleNamespace) -> dict:
    split = {"linkage": o.agglomerative_linkage, "split_at": o.agglomerative_cosine_threshold} if o.grouping == "agglomerative" else {}
    return {"t": _thresholds(o), "k": o.k, "cross_folder_only": getattr(o, "cross_folder_only", False), **split}


def _discard(o: SimpleNamespace, paths: DataFrame) -> dict | None:
    """Without `inplace` or `hard_delete` nothing is touched."""
    if not (o.inplace or o.hard_delete):
        return None
    return files.discard((r[0] for r in paths.toLocalIterator()), o.folders, o.hard_delete)


def dedup(spark: SparkSession, o: SimpleNamespace) -> dict:
    places = [os.path.realpath(f) for f in o.folders]
    quality = o.keep_policy == "best-quality"
    records = _records(spark, o, scan_table(spark, o.folders), places, quality).withColumn("rejection_reason", F.lit(None).cast("string"))
    if o.save_faiss_index:
        vectors = records.where("embedding IS NOT NULL").select("idx", "path", "embedding")
        vectors.write.mode("overwrite").parquet(os.path.join(os.path.realpath(o.root), OWN_FOLDER, "vectors"))
    found, kept, rows = workflows.dedup(records, o.keep_policy, **_matching(o))
    rows = cut(rows)  # the report and the actions speak of the same rows
    head = {} if o.no_report else reports.dedup_report(o.report, found, kept, records, o.keep_policy)
    return {"report": head, "removed": _discard(o, rows.orderBy("group_id", "duplicate_path").select("duplicate_path"))}


def remove_like(spark: SparkSession, o: SimpleNamespace) -> dict:
    """The reference picture may lie in the folder or elsewhere; it always stays."""
    image, rows = os.path.realpath(o.image), cut(scan_table(spark, o.folders))
    places, found = [os.path.realpath(o.folder)], rows.where(F.col("path") == image).first()
    idx = found.idx if found else rows.count()
    if not found:
        stat = os.stat(image)
        rows = rows.unionByName(spark.createDataFrame([(idx, len(o.folders), image, stat.st_size, stat.st_mtime)], rows.schema))
        places.append(image)
    records = _records(spark, o, rows, places, False)
    pairs = cut(workflows.remove_like(records.where(F.col("idx") != idx), records.where(F.col("idx") == idx), _thresholds(o)))
    head = {} if o.no_report else reports.reference_report(o.report, pairs, records, image, idx)
    other = F.when(F.col("a") == idx, F.col("b")).otherwise(F.col("a"))
    gone = pairs.where("decision = 'duplicate'").select(other.alias("idx")).join(records, "idx").orderBy("idx")
    return {"report": head, "removed": _discard(o, gone.select("path"))}


def select(spark: SparkSession, o: SimpleNamespace) -> dict:
    files.check_output(o.folder, o.output, o.force)
    limits = QualityLimits(o.min_width, o.min_height, o.min_blur_score, o.min_brightness, o.max_brightness) if o.reject_low_quality else None
    records = _records(spark, o, scan_table(spark, o.folders), [os.path.realpath(o.folder)], bool(limits) or o.keep_policy == "best-quality")
    fine = records.withColumn("rejection_reason", rejection_reason(limits) if limits else F.lit(None).cast("string")).where("rejection_reason IS NULL")
    components = workflows.match(fine, **_matching(o)).components
    s = workflows.select(spark, records, o.num, o.selection_method, o.seed, o.keep_policy, limits, components)
    # at most `num` paths, which the user asked for
    chosen = [r.path for r in s.selected.join(records, "idx").orderBy("position").select("path").collect()]
    rejected = cut(report.rejected_list(s.rejected, s.duplicates, s.failed, s.unselected, records.where("false")))
    n = s.funnel.first()
    with files.staged(o.folder, o.output, o.force) as new:
        exports = list(files.export(chosen, o.folder, new, o.copy_mode))
        for e in exports:
            e["output"] = os.path.join(os.path.abspath(o.output), os.path.relpath(e["output"], os.path.realpath(new)))
        failed = sum(e["status"] != "exported" for e in exports)
        # fixed values: the names of the counters
        funnel = {
            "input": n.total, "quality_rejected": n.rejected_quality, "eligible_after_quality": n.total - n.rejected_quality, "duplicate_groups": components.select("group_id").distinct().count(),
            "duplicates_removed": n.duplicates_removed, "embedding_failed": n.embedding_failed, "eligible_after_dedup": n.eligible_after_dedup, "selected": len(exports) - failed, "export_failed": failed,
        }
        settings = {"requested": o.num, "selection_method": o.selection_method, "seed": o.seed, "model": o.model, "copy_mode": o.copy_mode}
        if o.make_preview:
            preview.contact_sheet(spark, chosen, os.path.join(new, "previews", "selected.jpg"), o.preview_columns, o.preview_size)
        reports.selection_reports(os.path.join(new, "reports"), {"input_root": o.folder, "output_root": o.output, "configuration": settings}, funnel, exports, rejected)
    return {"funnel": funnel, "exports": exports}


WORKFLOWS = {"dedup": dedup, "remove-like": remove_like, "select": select}

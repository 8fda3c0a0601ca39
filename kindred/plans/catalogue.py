"""The engine's queries over the driver's tables, and the SQL that says the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.decide import Thresholds
from kindred.functions.embed import batch_size, embed
from kindred.functions.features import base_name, fingerprint_distance, l2_normalize, relative_to, suffix, unit_or_zero
from kindred.functions.images import measure_gray
from kindred.operators import candidates, report
from kindred.operators.evidence import all_evidence
from kindred.operators.number import chunked, numbered
from kindred.operators.quality import QualityLimits, rejection_reason
from kindred.operators.representatives import POLICIES, keep
from kindred.operators.select import select_farthest, select_representatives
from kindred.plans import workflows
from kindred.plans.session import checkpoint_dir, cut
from kindred.sources import cache as store
from kindred.sources.records import document_records, from_documents, plain_records

T = Thresholds()
LIMITS = QualityLimits(min_width=5, min_height=5, min_blur=50.0, min_brightness=10.0, max_brightness=245.0)


def _matched(spark: SparkSession, d: str, duplicates_only: bool = False) -> tuple[DataFrame, workflows.Matches]:
    records = document_records(spark, d)
    return records, workflows.match(records, duplicates_only=duplicates_only)


def _grouped(spark: SparkSession, d: str) -> tuple[DataFrame, workflows.Matches]:
    """Groups and their evidence, for queries that tell nothing of pairs to review."""
    return _matched(spark, d, True)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pairs alone, for queries that need no groups."""
    return workflows.best_of_all_arms(document_records(spark, d))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("idx"), "embedding")


def _r6(name: str):
    return F.round(F.col(name), 6).alias(name)


def scan_records(spark: SparkSession, d: str) -> DataFrame:
    return from_documents(spark.read.parquet(f"{d}/documents.parquet")).select("idx", "path", "parent", "size", "mtime", "sha256", "width", "height", base_name(F.col("path")).alias("name"), relative_to(F.col("path"), "src1").alias("relative"))


def ext_filter(spark: SparkSession, d: str) -> DataFrame:
    pages = spark.read.parquet(f"{d}/pages.parquet").withColumn("bare", F.regexp_replace("url", "[?#].*$", ""))
    return pages.select("page_id", suffix(F.col("bare")).alias("suffix")).where(~F.col("suffix").isin(".png", ".jpg"))


def exact_pairs(spark: SparkSession, d: str) -> DataFrame:
    return candidates.exact_pairs(plain_records(spark, d))


def exact_groups(spark: SparkSession, d: str) -> DataFrame:
    return candidates.exact_groups(plain_records(spark, d))


def fingerprint_bits(spark: SparkSession, d: str) -> DataFrame:
    return document_records(spark, d, vectors=False).select("idx", "phash")


def hamming_pairs(spark: SparkSession, d: str) -> DataFrame:
    return candidates.hamming_pairs(document_records(spark, d, vectors=False), T.phash_verify)


def hamming_pairs_cross(spark: SparkSession, d: str) -> DataFrame:
    records = document_records(spark, d, vectors=False)
    own = records.select("idx", "parent")
    pairs = candidates.hamming_pairs(records, T.phash_verify).join(own.toDF("a", "pa"), "a").join(own.toDF("b", "pb"), "b")
    return pairs.where("pa <> pb").select("a", "b", "distance")


def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("idx"), "embedding")
    return candidates.top_k(rows, 1 << 30, 0.4).where("a < b").select("a", "b", _r6("cosine"))


def topk_neighbors(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("idx"), "embedding")
    return candidates.top_k(rows, 10).select("a", "b", "rank", _r6("cosine"))


def topk_one_sided(spark: SparkSession, d: str) -> DataFrame:
    return candidates.one_sided(candidates.top_k(document_records(spark, d, prints=False), 50, T.cosine_review), T.cosine_review).select("a", "b", _r6("cosine"))


def decide_pairs(spark: SparkSession, d: str) -> DataFrame:
    return all_evidence(document_records(spark, d), T).select("a", "b", "arm", _r6("cosine"), "phash_distance", "same_sha256", "decision", "reason", "confidence")


def best_pair(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("a", "b", _r6("cosine"), "phash_distance", "same_sha256", "decision", "reason", "confidence")


def review_only(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).where("decision = 'review'").select("a", "b", _r6("cosine"))


def decision_counts(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).groupBy("decision", "confidence").agg(F.count(F.lit(1)).alias("n"))


def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return _grouped(spark, d)[1].components


def group_sizes(spark: SparkSession, d: str) -> DataFrame:
    sizes = _grouped(spark, d)[1].components.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    return numbered(sizes, ["group_id"], "number").withColumn("number", F.col("number") + 1)


def removals(spark: SparkSession, d: str) -> DataFrame:
    return _grouped(spark, d)[1].components.groupBy("group_id").agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.sum("n").alias("removals"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return plain_records(spark, d).withColumn("rejection_reason", rejection_reason(LIMITS))


def _keeper(policy: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return keep(_grouped(spark, d)[1].components, _judged(spark, d), policy)

    return query


def _kept(records: DataFrame, found: workflows.Matches) -> DataFrame:
    return keep(found.components, records, "highest-resolution")


def best_evidence(spark: SparkSession, d: str) -> DataFrame:
    records, found = _grouped(spark, d)
    return report.best_evidence(found.components, _kept(records, found), found.pairs).select("group_id", "keep", "idx", "reason", _r6("cosine"), "phash_distance", "same_sha256", "confidence")


def report_rows(spark: SparkSession, d: str) -> DataFrame:
    records, found = _grouped(spark, d)
    return report.report_rows(found.components, _kept(records, found), found.pairs, records).select("group_id", "keep_path", "duplicate_path", "reason", _r6("cosine"), "phash_distance", "same_sha256", "confidence")


def report_summary(spark: SparkSession, d: str) -> DataFrame:
    records, found = _matched(spark, d)
    return report.summary(found.components, found.pairs, records)


def remove_like(spark: SparkSession, d: str) -> DataFrame:
    records = document_records(spark, d)
    reference = records.where(F.col("idx") == records.agg(F.min("idx")).first()[0])
    return workflows.remove_like(records, reference, Thresholds(0.6, 0.4, 0.2, 4, 20)).select("b", _r6("cosine"), "phash_distance", "decision", "confidence")


def quality_reject(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).where("rejection_reason IS NOT NULL").select("path", "width", "height", "blur_score", "brightness", "rejection_reason")


def quality_funnel(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).groupBy(F.coalesce("rejection_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def _cached(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Records, and a cache that knows two thirds of them, a tenth of those with another time."""
    records = document_records(spark, d, vectors=False).select("idx", *store.KEY, *store.METADATA)
    old = records.where("idx % 3 <> 0").withColumn("mtime", F.when(F.col("idx") % 10 == 1, F.col("mtime") + 1).otherwise(F.col("mtime")))
    return records, old.select(*store.KEY, *store.METADATA, F.array(F.col("idx").cast("float")).alias("embedding"), F.when(F.col("idx") % 2 == 0, "m1").otherwise("m2").alias("model_version"))


def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    records, held = _cached(spark, d)
    return store.lookup(records.select("idx", *store.KEY), held, "m1").select("idx", "cached", F.col("embedding").isNotNull().alias("vector"))


def cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    records, held = _cached(spark, d)
    return store.upsert_metadata(held, records.where("idx % 5 = 0")).select(*store.KEY, "sha256", F.col("embedding").isNotNull().alias("vector"))


def missing_vectors(spark: SparkSession, d: str) -> DataFrame:
    vectors = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("idx"), "embedding")
    records = plain_records(spark, d)
    none = vectors.where("false")
    return store.needs_embedding(store.feature_matrix(records, none, vectors)).select("idx")


def _agglomerative(linkage: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        from kindred.operators.cluster import split_groups

        records, found = _grouped(spark, d)
        return split_groups(found.components, records, T.cosine_auto, linkage)

    return query


def _selector(method: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("idx"), "embedding")
        return select_representatives(spark, rows, 12, method, 42)

    return query


def _rejected(spark: SparkSession, d: str) -> DataFrame:
    """All five stages; every fourth record stands for one that wasn't selected, every ninth for one whose export failed."""
    records, found = _matched(spark, d)
    judged = records.withColumn("rejection_reason", rejection_reason(LIMITS))
    gone = found.components.join(_kept(records, found), "group_id").where("idx <> keep").select("idx")
    return report.rejected_list(judged.where("rejection_reason IS NOT NULL"), judged.join(gone, "idx", "left_semi"), judged.where("embedding IS NULL"), judged.where("idx % 4 = 0"), judged.where("idx % 9 = 0"))


def rejected_list(spark: SparkSession, d: str) -> DataFrame:
    return _rejected(spark, d)


def rejected_order(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the list of rejected paths, by stage and path, each once."""
    return numbered(_rejected(spark, d).select("stage", "path").distinct(), ["stage", "path"], "line")


def candidate_set(spark: SparkSession, d: str) -> DataFrame:
    records, found = _matched(spark, d)
    gone = found.components.join(_kept(records, found), "group_id").where("idx <> keep").select("idx")
    return records.join(gone, "idx", "left_anti").select("idx", "path")


def split_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Balanced contiguous chunks of the whole list, the larger ones first."""
    return chunked(plain_records(spark, d).select("idx", "parent"), ["idx"], 3)


def record_order(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of the records by folder and path."""
    return numbered(plain_records(spark, d).select("idx", "parent", "path"), ["parent", "path"])


def _scaled(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of other lengths, each seventh all zeros."""
    return _vectors(spark, d).withColumn("v", F.transform("embedding", lambda x: x.cast("double") * (F.col("idx") % 7)))


def _told(rows: DataFrame) -> DataFrame:
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return rows.select("idx", F.round(F.col("v")[0], 6).alias("first"), F.round(total, 6).alias("total"))


def normalized_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _told(_scaled(spark, d).withColumn("v", l2_normalize(F.col("v"))))


def unit_or_zero_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _told(_scaled(spark, d).withColumn("v", unit_or_zero(F.col("v"))))


def print_distances(spark: SparkSession, d: str) -> DataFrame:
    """Distances to one fingerprint from texts of which some are none."""
    i = F.col("idx")
    text = F.when(i % 5 == 0, "").when(i % 5 == 1, "zz").when(i % 5 == 2, F.lit(None)).when(i % 5 == 3, "f" * 16).otherwise(F.lower(F.hex(i)))
    return plain_records(spark, d).select("idx", fingerprint_distance(text, F.lit("0f")).alias("distance"))


def needs_hash(spark: SparkSession, d: str) -> DataFrame:
    records, held = _cached(spark, d)
    return store.needs_hash(store.lookup(records.select("idx", *store.KEY), held, "m1")).select("idx")


def topk_cross(spark: SparkSession, d: str) -> DataFrame:
    """Top-k first, then only pairs of different folders."""
    records = document_records(spark, d)
    pairs = all_evidence(records, T, cross_folder_only=True).where("arm = 2")
    return pairs.select("a", "b", _r6("cosine"))


def no_vectors(spark: SparkSession, d: str) -> DataFrame:
    """What is found where no record has a vector."""
    records = document_records(spark, d, vectors=False).withColumn("embedding", F.lit(None).cast("array<double>"))
    return workflows.match(records).pairs.select("a", "b", "phash_distance", "same_sha256", "decision", "reason", "confidence")


def report_quality(spark: SparkSession, d: str) -> DataFrame:
    """Report rows with the quality of both sides."""
    records, found = _grouped(spark, d)
    judged = records.withColumn("rejection_reason", rejection_reason(LIMITS))
    rows = report.with_quality(report.report_rows(found.components, _kept(records, found), found.pairs, records), judged)
    return rows.select("keep_path", "duplicate_path", F.col("quality.width").alias("width"), F.col("quality.blur_score").alias("blur_score"), F.col("quality.rejection_reason").alias("rejection_reason"), F.col("keep_quality.height").alias("keep_height"), F.col("keep_quality.brightness").alias("keep_brightness"))


def report_groups(spark: SparkSession, d: str) -> DataFrame:
    """The nested report, its lists as text."""
    records, found = _grouped(spark, d)
    rows = report.report_groups(found.components, _kept(records, found), found.pairs, records.drop("blur_score"))
    lines = F.transform("duplicates", lambda x: F.concat_ws(" ", x["path"], x["reason"], x["confidence"]))
    return rows.select("keep", F.size("duplicates").cast("long").alias("n"), F.array_join(lines, ", ").alias("duplicates"))


def remove_like_counts(spark: SparkSession, d: str) -> DataFrame:
    return remove_like(spark, d).groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.max("b").alias("last"))


def pixel_quality(spark: SparkSession, d: str) -> DataFrame:
    """Blur score and brightness of vectors taken as pictures of 8 by 8."""
    rows = _vectors(spark, d).withColumn("gray", F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 1000) % 256))
    return measure_gray(rows, "idx", "gray", 8).select("idx", _r6("blur_score"), _r6("brightness"))


def picture_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Perceptual hashes of pictures of 32 by 32, made from vectors."""
    def pixel(k):
        return (F.floor(F.abs(F.element_at("embedding", (k % 64 + 1).cast("int")).cast("double")) * 1000) + F.floor(k / 32) * 7 + k % 32 * 3) % 256

    rows = _vectors(spark, d).withColumn("gray", F.transform(F.sequence(F.lit(0), F.lit(1023)), pixel))
    return measure_gray(rows, "idx", "gray", 32).select("idx", "phash")


def cache_versions(spark: SparkSession, d: str) -> DataFrame:
    """A store after three writes: metadata, vectors of even records, vectors of every third, which forgets the others."""
    held = store.Snapshots(spark, f"{checkpoint_dir(spark)}/cache-{uuid.uuid4().hex}")
    records = document_records(spark, d, vectors=False)
    held.write(store.upsert_metadata(held.read(), records))
    vector = records.withColumn("embedding", F.array(F.col("idx").cast("float")))
    held.write(store.save_embeddings(held.read(), vector.where("idx % 2 = 0"), "m1"))
    held.write(store.save_embeddings(held.read(), vector.where("idx % 3 = 0"), "m2"))
    return held.read().select("path", "sha256", F.col("embedding")[0].cast("double").alias("value"), "model_version")


def batch_sizes(spark: SparkSession, d: str) -> DataFrame:
    gb = F.when(F.col("idx") % 10 != 0, F.col("size") % 50)
    return plain_records(spark, d).select("idx", batch_size((F.col("idx") % 150 + 1).cast("int"), gb).alias("batch"))


def embedded_texts(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of the default embedder."""
    rows = embed(spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("idx"), "text"), "text").where("embedding IS NOT NULL")
    return rows.select("idx", F.round(F.col("embedding")[0], 6).alias("first"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.abs(x)), 6).alias("total"), "model_version")


def run_names(spark: SparkSession, d: str) -> DataFrame:
    """Times as reports and run ids write them."""
    events = spark.read.parquet(f"{d}/events.parquet")
    return events.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("generated_at"), F.date_format("ts", "'run_'yyyyMMdd_HHmmss").alias("run_id"))


def farthest_from_first(spark: SparkSession, d: str) -> DataFrame:
    """Farthest-point choices that begin with the record of least number."""
    rows = cut(_vectors(spark, d).select("idx", unit_or_zero(F.col("embedding")).alias("v")))
    picked = select_farthest(rows, 12, 0, [rows.agg(F.min("idx")).first()[0]])
    return spark.createDataFrame(list(enumerate(picked)), "position int, idx long")


def selection_workflow(spark: SparkSession, d: str) -> DataFrame:
    """The whole select workflow's funnel; `selected` is exact, whatever the method."""
    return workflows.select(spark, document_records(spark, d), 20, "kmeans", 42, limits=LIMITS).funnel


QUERIES = {f.__name__: f for f in (
    scan_records, ext_filter, exact_pairs, exact_groups, fingerprint_bits, hamming_pairs, hamming_pairs_cross, cosine_pairs, topk_neighbors, topk_one_sided, decide_pairs, best_pair, review_only, decision_counts,
    duplicate_groups, group_sizes, removals, best_evidence, report_rows, report_summary, remove_like, quality_reject, quality_funnel, cache_hits, cache_upsert, missing_vectors, rejected_list, rejected_order, candidate_set, split_chunks, selection_workflow,
    record_order, normalized_vectors, unit_or_zero_vectors, print_distances, needs_hash, topk_cross, no_vectors, report_quality, report_groups, remove_like_counts, pixel_quality, picture_hashes, cache_versions, batch_sizes, embedded_texts, run_names,
    farthest_from_first,
)}
QUERIES |= {f"keep_{p.replace('-', '_')}": _keeper(p) for p in POLICIES}
QUERIES |= {f"agglomerative_{x}": _agglomerative(x) for x in ("complete", "average")} | {f"select_{m}": _selector(m) for m in ("kmeans", "farthest", "hybrid")}

# -- the same in SQL ----------------------------------------------------------------------------------------------------

_REC = """records AS (
  SELECT doc_id AS idx, source || '/' || doc_id AS path, source AS parent, strlen(text)::BIGINT AS size, (doc_id * 7919 % 1000)::DOUBLE AS mtime, sha256(text) AS sha256,
    (n_chars % 97 + 1)::INT AS width, (n_chars % 53 + 1)::INT AS height, (strlen(text) % 1000)::DOUBLE AS blur_score, (n_chars * 31 % 256)::DOUBLE AS brightness, text,
    CASE WHEN n_chars % 97 + 1 < 5 OR n_chars % 53 + 1 < 5 THEN 'too_small' WHEN strlen(text) % 1000 < 50 THEN 'blurry' WHEN n_chars * 31 % 256 < 10 THEN 'too_dark' WHEN n_chars * 31 % 256 > 245 THEN 'too_bright' END AS rejection_reason
  FROM documents)"""
_FP = (
    _REC
    + """, words AS (SELECT idx, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS w FROM records),
hashed AS (SELECT DISTINCT idx, w, ('0x' || substr(md5(w), 1, 16))::UBIGINT AS h FROM words),
votes AS (SELECT idx, i, sum(CASE WHEN (h >> i) & 1 = 1 THEN 1 ELSE -1 END) AS s FROM hashed, range(64) t(i) GROUP BY idx, i),
voted AS (SELECT idx, sum(CASE WHEN s > 0 THEN (1::HUGEINT << i) ELSE 0 END)::UBIGINT AS bits FROM votes GROUP BY idx),
fp AS (SELECT r.idx, parent, sha256, coalesce(v.bits, 0::UBIGINT) AS bits FROM records r LEFT JOIN voted v USING (idx))"""
)
_HAM = _FP + ", ham AS (SELECT a.idx AS a, b.idx AS b, bit_count(xor(a.bits, b.bits))::INT AS distance, a.parent AS pa, b.parent AS pb FROM fp a JOIN fp b ON a.idx < b.idx AND bit_count(xor(a.bits, b.bits)) <= 8)"
_VEC = (
    _FP
    + """, buckets AS (SELECT idx, (('0x' || substr(md5(w), 1, 2))::UBIGINT % 64)::INT AS bucket, count(*) AS n FROM words GROUP BY ALL),
totals AS (SELECT idx, sum(n) AS total FROM buckets GROUP BY idx),
cells AS (SELECT t.idx, i.i AS i, coalesce(b.n, 0)::DOUBLE - t.total / 64.0 AS x FROM totals t CROSS JOIN range(64) i(i) LEFT JOIN buckets b ON b.idx = t.idx AND b.bucket = i.i),
lens AS (SELECT idx, greatest(sqrt(sum(x * x)), 1e-12) AS len FROM cells GROUP BY idx),
vec AS (SELECT c.idx, list(c.x / l.len ORDER BY c.i) AS v FROM cells c JOIN lens l USING (idx) GROUP BY c.idx),
scored AS (SELECT a.idx AS a, b.idx AS b, round(list_dot_product(a.v, b.v), 6) AS cosine FROM vec a, vec b),
ranked AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS rank FROM scored WHERE cosine >= 0.85),
one AS (SELECT a, b, cosine FROM ranked WHERE rank <= 50 AND a < b)"""
)
_DECIDED = (
    _VEC
    + """, ham AS (SELECT a.idx AS a, b.idx AS b FROM fp a JOIN fp b ON a.idx < b.idx AND bit_count(xor(a.bits, b.bits)) <= 8),
arms AS (
  SELECT a.idx AS a, b.idx AS b, 0 AS arm, NULL::DOUBLE AS cosine FROM records a JOIN records b ON a.sha256 = b.sha256 AND a.idx < b.idx
  UNION ALL SELECT h.a, h.b, 1, s.cosine FROM ham h LEFT JOIN scored s ON s.a = h.a AND s.b = h.b
  UNION ALL SELECT a, b, 2, cosine FROM one),
full_ AS (SELECT x.a, x.b, x.arm, x.cosine, bit_count(xor(p.bits, q.bits))::INT AS phash_distance, p.sha256 = q.sha256 AS same_sha256 FROM arms x JOIN fp p ON p.idx = x.a JOIN fp q ON q.idx = x.b),
ruled AS (SELECT *, CASE WHEN same_sha256 THEN 1 WHEN phash_distance <= 4 THEN 2 WHEN cosine >= 0.97 THEN 3 WHEN cosine >= 0.90 AND phash_distance <= 8 THEN 4 WHEN cosine >= 0.85 AND cosine < 0.90 THEN 5 ELSE 6 END AS rule FROM full_),
decided AS (SELECT a, b, arm, cosine, phash_distance, same_sha256,
  CASE WHEN rule <= 4 THEN 'duplicate' WHEN rule = 5 THEN 'review' ELSE 'ignore' END AS decision,
  ['same_sha256', 'phash_distance<=4', 'cosine>=0.97', 'cosine>=0.90_and_phash<=8', '0.85<=cosine<0.90', 'not_confident'][rule] AS reason,
  ['exact', 'high', 'high', 'verified', 'review', 'ignored'][rule] AS confidence FROM ruled)"""
)
_BEST = (
    _DECIDED
    + """, best AS (SELECT a, b, cosine, phash_distance, same_sha256, decision, reason, confidence FROM decided
  QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY CASE decision WHEN 'duplicate' THEN 2 WHEN 'review' THEN 1 ELSE 0 END DESC, coalesce(cosine, -1) DESC, arm) = 1 AND decision <> 'ignore')"""
)
_COMP = (
    _BEST
    + """, edges AS (SELECT a, b FROM best WHERE decision = 'duplicate' UNION SELECT b, a FROM best WHERE decision = 'duplicate'),
reach AS (SELECT a AS idx, a AS other FROM edges UNION SELECT r.idx, e.b FROM reach r JOIN edges e ON e.a = r.other),
comp AS (SELECT idx, min(other) AS group_id FROM reach GROUP BY idx),
members AS (SELECT c.group_id, r.*, r.width::BIGINT * r.height AS px FROM comp c JOIN records r USING (idx))"""
)
_ORDERS = {
    "lexi": "path, idx", "smallest": "size, idx", "largest": "size DESC, idx", "highest-resolution": "px DESC, size DESC, idx", "newest": "mtime DESC, idx", "oldest": "mtime, idx",
    "best-quality": "(rejection_reason IS NULL) DESC, blur_score DESC, abs(brightness - 127.5), px DESC, size DESC, path DESC, idx",
}
_KEPT = _COMP + f", kept AS (SELECT group_id, first(idx ORDER BY {_ORDERS['highest-resolution']}) AS keep FROM members GROUP BY group_id), gone AS (SELECT c.group_id, c.idx, k.keep FROM comp c JOIN kept k USING (group_id) WHERE c.idx <> k.keep)"
_EVIDENCE = (
    _KEPT
    + """, either AS (SELECT a AS idx, b AS other, reason, cosine, phash_distance, same_sha256, confidence FROM best WHERE decision = 'duplicate'
  UNION ALL SELECT b, a, reason, cosine, phash_distance, same_sha256, confidence FROM best WHERE decision = 'duplicate'),
evidence AS (SELECT g.group_id, g.keep, g.idx, coalesce(e.reason, 'grouped_duplicate') AS reason, e.cosine, e.phash_distance, coalesce(e.same_sha256, false) AS same_sha256, coalesce(e.confidence, 'grouped') AS confidence
  FROM gone g LEFT JOIN either e USING (idx)
  QUALIFY row_number() OVER (PARTITION BY g.idx ORDER BY (e.other = g.keep) DESC, coalesce(e.cosine, -1) DESC, e.other) = 1)"""
)
_W, _R = "WITH ", "WITH RECURSIVE "
_CACHE = _REC + """, held AS (SELECT path, size, CASE WHEN idx % 10 = 1 THEN mtime + 1 ELSE mtime END AS mtime, sha256, idx % 2 = 0 AS m1 FROM records WHERE idx % 3 <> 0)"""
_EMB = "v AS (SELECT vec_id AS idx, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.idx AS a, b.idx AS b, round(list_dot_product(a.e, b.e), 6) AS cosine FROM v a, v b)"

ORACLES = {
    "scan_records": _W + _REC + " SELECT idx, path, parent, size, mtime, sha256, width, height, idx::VARCHAR AS name, idx::VARCHAR AS relative FROM records",
    "ext_filter": r"WITH p AS (SELECT page_id, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '(\.[^./]*)$', 1)) AS suffix FROM pages) SELECT page_id, suffix FROM p WHERE suffix NOT IN ('.png', '.jpg')",
    "exact_pairs": _W + _REC + " SELECT a.idx AS a, b.idx AS b FROM records a JOIN records b ON a.sha256 = b.sha256 AND a.idx < b.idx",
    "exact_groups": _W + _REC + " SELECT sha256, count(*) AS n, min(idx) AS first_idx FROM records GROUP BY sha256 HAVING count(*) > 1",
    "fingerprint_bits": _W + _FP + " SELECT idx, lpad(lower(to_hex(bits)), 16, '0') AS phash FROM fp",
    "hamming_pairs": _W + _HAM + " SELECT a, b, distance FROM ham",
    "hamming_pairs_cross": _W + _HAM + " SELECT a, b, distance FROM ham WHERE pa <> pb",
    "cosine_pairs": _W + _EMB + " SELECT a, b, cosine FROM s WHERE cosine >= 0.4 AND a < b",
    "topk_neighbors": _W + _EMB + " SELECT a, b, rank, cosine FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS rank FROM s) WHERE rank <= 10",
    "topk_one_sided": _W + _VEC + " SELECT a, b, cosine FROM one",
    "decide_pairs": _W + _DECIDED + " SELECT a, b, arm, cosine, phash_distance, same_sha256, decision, reason, confidence FROM decided",
    "best_pair": _W + _BEST + " SELECT * FROM best",
    "review_only": _W + _BEST + " SELECT a, b, cosine FROM best WHERE decision = 'review'",
    "decision_counts": _W + _BEST + " SELECT decision, confidence, count(*) AS n FROM best GROUP BY ALL",
    "duplicate_groups": _R + _COMP + " SELECT idx, group_id FROM comp",
    "group_sizes": _R + _COMP + " SELECT group_id, count(*) AS n, dense_rank() OVER (ORDER BY group_id) AS number FROM comp GROUP BY group_id",
    "removals": _R + _COMP + " SELECT sum(n)::BIGINT AS removals FROM (SELECT count(*) - 1 AS n FROM comp GROUP BY group_id)",
    "best_evidence": _R + _EVIDENCE + " SELECT * FROM evidence",
    "report_rows": _R + _EVIDENCE + " SELECT e.group_id, k.path AS keep_path, r.path AS duplicate_path, reason, cosine, phash_distance, same_sha256, confidence FROM evidence e JOIN records r ON r.idx = e.idx JOIN records k ON k.idx = e.keep",
    "report_summary": _R + _COMP + " SELECT (SELECT count(*) FROM records) AS total, (SELECT count(DISTINCT group_id) FROM comp) AS duplicate_groups, (SELECT count(*) - count(DISTINCT group_id) FROM comp) AS duplicates_to_remove, (SELECT count(*) FROM best WHERE decision = 'duplicate') AS duplicate_pairs, (SELECT count(*) FROM best WHERE decision = 'review') AS review_pairs",
    "remove_like": _W + _VEC + """, ref AS (SELECT f.*, v.v FROM fp f LEFT JOIN vec v USING (idx) WHERE idx = (SELECT min(idx) FROM fp)),
e AS (SELECT f.idx AS b, round(list_dot_product(v.v, ref.v), 6) AS cosine, bit_count(xor(f.bits, ref.bits))::INT AS phash_distance, f.sha256 = ref.sha256 AS same FROM fp f LEFT JOIN vec v USING (idx), ref WHERE f.idx <> ref.idx),
d AS (SELECT *, CASE WHEN same THEN 1 WHEN phash_distance <= 4 THEN 2 WHEN cosine >= 0.6 THEN 3 WHEN cosine >= 0.4 AND phash_distance <= 20 THEN 4 WHEN cosine >= 0.2 AND cosine < 0.4 THEN 5 ELSE 6 END AS rule FROM e)
SELECT b, cosine, phash_distance, CASE WHEN rule <= 4 THEN 'duplicate' ELSE 'review' END AS decision, ['exact', 'high', 'high', 'verified', 'review'][rule] AS confidence FROM d WHERE rule < 6""",
    "quality_reject": _W + _REC + " SELECT path, width, height, blur_score, brightness, rejection_reason FROM records WHERE rejection_reason IS NOT NULL",
    "quality_funnel": _W + _REC + " SELECT coalesce(rejection_reason, 'kept') AS reason, count(*) AS n FROM records GROUP BY ALL",
    "cache_hits": _W + _CACHE + " SELECT r.idx, h.path IS NOT NULL AS cached, coalesce(h.m1, false) AS vector FROM records r LEFT JOIN held h ON h.path = r.path AND h.size = r.size AND h.mtime = r.mtime",
    "cache_upsert": _W + _CACHE + " SELECT path, size, mtime, sha256, true AS vector FROM held WHERE path NOT IN (SELECT path FROM records WHERE idx % 5 = 0) UNION ALL SELECT path, size, mtime, sha256, false FROM records WHERE idx % 5 = 0",
    "missing_vectors": "SELECT doc_id AS idx FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "rejected_list": _R + _KEPT + ", nov AS (SELECT r.path FROM records r WHERE NOT EXISTS (SELECT 1 FROM vec v WHERE v.idx = r.idx)) SELECT 0 AS stage, rejection_reason AS reason, path FROM records WHERE rejection_reason IS NOT NULL UNION ALL SELECT 1, 'duplicate', r.path FROM gone g JOIN records r USING (idx) UNION ALL SELECT 2, 'embedding_failed', path FROM nov UNION ALL SELECT 3, 'not_selected', path FROM records WHERE idx % 4 = 0 UNION ALL SELECT 4, 'export_failed', path FROM records WHERE idx % 9 = 0",
    "candidate_set": _R + _KEPT + " SELECT idx, path FROM records WHERE idx NOT IN (SELECT idx FROM gone)",
    "split_chunks": _W + _REC + " SELECT idx, parent, ntile(3) OVER (ORDER BY idx)::INT AS chunk FROM records",
}
ORACLES |= {f"keep_{p.replace('-', '_')}": _R + _COMP + f" SELECT group_id, first(idx ORDER BY {_ORDERS[p]}) AS keep FROM members GROUP BY group_id" for p in POLICIES}

_SCALED = "WITH v AS (SELECT vec_id AS idx, list_transform(embedding, lambda x: x::DOUBLE * (vec_id % 7)) AS v FROM embeddings), l AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS len FROM v) "
_PIXELS = "WITH RECURSIVE px AS (SELECT vec_id AS idx, i // {side} AS y, i % {side} AS x, ({pixel}) % 256 AS g FROM embeddings, range({side} * {side}) t(i))"
_FINE = _COMP.replace("records AS (", "everyone AS (", 1).replace("FROM documents)", "FROM documents), records AS (SELECT * FROM everyone WHERE rejection_reason IS NULL)", 1)
ORACLES |= {
    "rejected_order": f"WITH r AS (SELECT DISTINCT stage, path FROM ({ORACLES['rejected_list']})) SELECT stage, path, row_number() OVER (ORDER BY stage, path) - 1 AS line FROM r",
    "record_order": _W + _REC + " SELECT idx, parent, path, row_number() OVER (ORDER BY parent, path) - 1 AS position FROM records",
    "normalized_vectors": _SCALED + "SELECT idx, round(v[1] / greatest(len, 1e-12), 6) AS first, round(list_sum(list_transform(v, lambda x: x / greatest(len, 1e-12))), 6) AS total FROM l",
    "unit_or_zero_vectors": _SCALED + "SELECT idx, CASE WHEN len > 0 THEN round(v[1] / len, 6) ELSE 0.0 END AS first, CASE WHEN len > 0 THEN round(list_sum(list_transform(v, lambda x: x / len)), 6) ELSE 0.0 END AS total FROM l",
    "print_distances": _W + _REC + " SELECT idx, CASE idx % 5 WHEN 3 THEN 60 WHEN 4 THEN bit_count(xor(idx, 15))::INT END AS distance FROM records",
    "needs_hash": _W + _CACHE + " SELECT r.idx FROM records r LEFT JOIN held h ON h.path = r.path AND h.size = r.size AND h.mtime = r.mtime WHERE h.path IS NULL OR h.sha256 IS NULL",
    "topk_cross": _W + _VEC + " SELECT o.a, o.b, o.cosine FROM one o JOIN records x ON x.idx = o.a JOIN records y ON y.idx = o.b WHERE x.parent <> y.parent",
    "no_vectors": _W + _FP + """, met AS (SELECT a.idx AS a, b.idx AS b, bit_count(xor(a.bits, b.bits))::INT AS phash_distance, a.sha256 = b.sha256 AS same_sha256 FROM fp a JOIN fp b ON a.idx < b.idx AND bit_count(xor(a.bits, b.bits)) <= 4)
SELECT *, 'duplicate' AS decision, CASE WHEN same_sha256 THEN 'same_sha256' ELSE 'phash_distance<=4' END AS reason, CASE WHEN same_sha256 THEN 'exact' ELSE 'high' END AS confidence FROM met""",
    "report_quality": _R + _KEPT + " SELECT k.path AS keep_path, r.path AS duplicate_path, r.width, r.blur_score, r.rejection_reason, k.height AS keep_height, k.brightness AS keep_brightness FROM gone g JOIN records r ON r.idx = g.idx JOIN records k ON k.idx = g.keep",
    "report_groups": _R + _EVIDENCE + " SELECT k.path AS keep, count(*) AS n, string_agg(r.path || ' ' || reason || ' ' || confidence, ', ' ORDER BY r.path) AS duplicates FROM evidence e JOIN records r ON r.idx = e.idx JOIN records k ON k.idx = e.keep GROUP BY e.group_id, k.path",
    "remove_like_counts": "SELECT decision, count(*) AS n, max(b) AS last FROM (" + ORACLES["remove_like"] + ") GROUP BY decision",
    "pixel_quality": _PIXELS.format(side=8, pixel="floor(abs(embedding[i + 1]::DOUBLE) * 1000)::INT") + """, edge AS (
  SELECT c.idx, least(greatest(9 * any_value(c.g) - sum(n.g), 0), 255)::DOUBLE AS e FROM px c JOIN px n ON n.idx = c.idx AND abs(n.y - c.y) <= 1 AND abs(n.x - c.x) <= 1 WHERE c.y BETWEEN 1 AND 6 AND c.x BETWEEN 1 AND 6 GROUP BY c.idx, c.y, c.x),
blur AS (SELECT idx, round(var_pop(e), 6) AS blur_score FROM edge GROUP BY idx)
SELECT idx, blur_score, round(avg(g::DOUBLE), 6) AS brightness FROM px JOIN blur USING (idx) GROUP BY idx, blur_score""",
    "picture_hashes": _PIXELS.format(side=32, pixel="floor(abs(embedding[i % 64 + 1]::DOUBLE) * 1000)::INT + i // 32 * 7 + i % 32 * 3") + """, k AS (SELECT range AS k FROM range(8)),
across AS (SELECT idx, y, k, sum(g * 2 * cos(pi() * k * (2 * x + 1) / 64)) AS s FROM px, k GROUP BY idx, y, k),
both_ AS (SELECT a.idx, k.k AS u, a.k AS v, sum(a.s * 2 * cos(pi() * k.k * (2 * a.y + 1) / 64)) AS c FROM across a, k GROUP BY a.idx, k.k, a.k),
middle AS (SELECT idx, median(c) AS m FROM both_ GROUP BY idx)
SELECT idx, lpad(lower(to_hex(sum(CASE WHEN c > m THEN 1::HUGEINT << (63 - 8 * u - v)::INT ELSE 0 END)::UBIGINT)), 16, '0') AS phash FROM both_ JOIN middle USING (idx) GROUP BY idx""",
    "cache_versions": _W + _REC + " SELECT path, sha256, CASE WHEN idx % 3 = 0 THEN idx::DOUBLE END AS value, CASE WHEN idx % 3 = 0 THEN 'm2' END AS model_version FROM records",
    "batch_sizes": _W + _REC + ", m AS (SELECT idx, CASE WHEN idx % 10 <> 0 THEN size % 50 END AS gb FROM records) SELECT idx, least(idx % 150 + 1, CASE WHEN gb >= 40 THEN 128 WHEN gb >= 24 THEN 96 WHEN gb >= 16 THEN 64 WHEN gb >= 12 THEN 48 ELSE 32 END)::INT AS batch FROM m",
    "embedded_texts": _W + _VEC + " SELECT idx, round(v[1], 6) AS first, round(list_sum(list_transform(v, lambda x: abs(x))), 6) AS total, 'words-64' AS model_version FROM vec",
    "run_names": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS generated_at, strftime(ts, 'run_%Y%m%d_%H%M%S') AS run_id FROM events",
    "farthest_from_first": """WITH RECURSIVE n AS (SELECT vec_id AS idx, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS len FROM embeddings),
u AS (SELECT idx, list_transform(e, lambda x: x / len) AS v FROM n), d AS (SELECT a.idx AS a, b.idx AS b, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) ** 2)) AS x FROM u a, u b),
steps AS (SELECT 0 AS position, [(SELECT min(idx) FROM u)] AS chosen
  UNION ALL SELECT position + 1, list_append(chosen, (SELECT b FROM (SELECT d.b, min(d.x) AS m FROM d WHERE list_contains(steps.chosen, d.a) AND NOT list_contains(steps.chosen, d.b) GROUP BY d.b) ORDER BY m DESC, b LIMIT 1)) FROM steps WHERE position < 11)
SELECT position, chosen[position + 1] AS idx FROM steps""",
    "selection_workflow": _R + _FINE + """, able AS (SELECT r.* FROM records r JOIN vec v USING (idx)),
kept AS (SELECT c.group_id, first(a.idx ORDER BY (a.rejection_reason IS NULL) DESC, a.blur_score DESC, abs(a.brightness - 127.5), a.width::BIGINT * a.height DESC, a.size DESC, a.path DESC, a.idx) AS keep FROM comp c JOIN able a USING (idx) GROUP BY c.group_id),
lost AS (SELECT c.idx FROM comp c JOIN kept k USING (group_id) WHERE c.idx <> k.keep),
counted AS (SELECT (SELECT count(*) FROM everyone) AS total, (SELECT count(*) FROM everyone WHERE rejection_reason IS NOT NULL) AS rejected_quality, (SELECT count(*) FROM lost) AS duplicates_removed,
  (SELECT count(*) FROM records WHERE idx NOT IN (SELECT idx FROM lost) AND idx NOT IN (SELECT idx FROM able)) AS embedding_failed)
SELECT *, 20::BIGINT AS selected, total - rejected_quality - duplicates_removed - embedding_failed AS eligible_after_dedup, total - rejected_quality - duplicates_removed - embedding_failed - 20 AS not_selected FROM counted""",
}

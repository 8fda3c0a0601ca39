"""The queries of this package over the driver's tables, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import bpe, html_extract, jaccard_join, line_dedup, matroska, packing, sharding, simhash, toxicity, warc


def vocabulary() -> str:
    return os.environ.get("KINDRED_VOCABULARY", public_tokenizers.path("byte_bpe_50k.json"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), min_chars=40, min_docs=5)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.parse_warc(warc.pages_as_warc(_table(spark, sf_dir, "pages")))
    return warc.resolve_revisits(records).select(
        F.col("source").alias("page_id"), "canonical_url", "date", "status", F.col("response_source").alias("response_page_id"), "payload_sha256", "payload_bytes", warc.header_lines(F.col("headers")).alias("headers")
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shuffle_to_shards(_table(spark, sf_dir, "documents"), shards=16)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract_pages(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"), words=4, threshold="0.85")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary())


def op9_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.read_features(matroska.store_texts(_table(spark, sf_dir, "documents")))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.round_trip(_table(spark, sf_dir, "documents"), vocabulary())
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_warc_revisits, op3_toxicity, op4_sharding, op5_html_extraction, op6_simhash, op7_jaccard_join, op8_packing, op9_matroska, op10_bpe)}

#: Fixed value: the white space of the contracts, as a DuckDB string.
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLES = {
    "op1_line_dedup": f"""
WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM texts),
keyed AS (SELECT *, translate(trim(line, {_SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT keyed.*, common.k IS NOT NULL AND common.keeper <> doc_id AS gone FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op2_warc_revisits": """
WITH parts AS (
  SELECT page_id, coalesce(html, '') AS html, page_id AS n, regexp_replace(url, '#.*$', '') AS bare FROM pages),
named AS (
  SELECT page_id, html, n,
    regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), '^www\\.', ''), ':(80|443)$', '') AS host,
    regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1) AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|fbclid|gclid|msclkid|ref|sessionid|phpsessid|sid)(=.*)?$'))), '&') AS query
  FROM parts),
pages2 AS (
  SELECT page_id, n, html, host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical_url,
    '"' || substr(md5(html), 1, 16) || '"' AS tag, 'day ' || (n % 365) AS since, 10 * n AS t0, 10 * n + 5 + 3600 * (n % 7) AS t1
  FROM named),
ranked AS (
  SELECT r.page_id, r.canonical_url, r.n, r.tag, r.since, r.t1, f.page_id AS fp, f.tag AS ftag, f.since AS fsince, f.html AS fhtml, f.n AS fn,
    row_number() OVER (PARTITION BY r.page_id ORDER BY f.t0 DESC, f.page_id DESC) AS k
  FROM pages2 r JOIN pages2 f ON f.canonical_url = r.canonical_url AND f.t0 < r.t1),
checked AS (SELECT *, CASE WHEN n % 11 = 0 THEN since = fsince ELSE tag = ftag END AS ok FROM ranked WHERE k = 1)
SELECT page_id, canonical_url, strftime(TIMESTAMP '2024-01-01' + to_seconds(t1), '%Y-%m-%dT%H:%M:%SZ') AS date,
  CASE WHEN ok THEN 'resolved' ELSE 'validator_mismatch' END AS status, CASE WHEN ok THEN fp END AS response_page_id,
  CASE WHEN ok THEN sha256(fhtml) END AS payload_sha256, CASE WHEN ok THEN strlen(fhtml)::BIGINT END AS payload_bytes,
  CASE WHEN ok THEN 'cache-control: max-age=' || (n % 1000) || chr(10) || 'content-length: ' || strlen(fhtml) || chr(10) || 'content-type: text/html' || chr(10)
    || 'etag: ' || CASE WHEN n % 11 <> 0 AND n % 13 = 0 THEN 'W/' ELSE '' END || ftag || chr(10)
    || 'last-modified: ' || fsince || chr(10) || 'x-page: ' || fn END AS headers
FROM checked""",
    "op7_jaccard_join": """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS other FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other),
comp AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(comp.component_id, d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)""",
}

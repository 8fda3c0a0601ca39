"""A training corpus from raw documents: toxic documents go, repeated lines go, one of each near-copy stays, the rest is packed.

Defined results, for the table of each stage: null, empty and white-space texts are never toxic enough alone to go, hold
no repeated line, are copies of nothing and are packed as an end id; texts of any length are read whole; null and repeated
doc_ids are rows like others, and each row is judged by its own text; of repeated rows, as of any near copies, the one of
least doc_id stays (null ids last; among equal ids the first in the table); an empty table stays empty. Columns beside
doc_id, text and n_chars come through unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import jaccard_join, line_dedup, packing, toxicity
from kindred.llm.common import quoted
from kindred.llm.queries import vocabulary
from kindred.plans.session import cut

#: Dropped rows up to this many (8 bytes each) are broadcast; more are joined.
BROADCAST_ROWS = 1_000_000


def _as(docs: DataFrame, out: DataFrame, **own) -> DataFrame:
    """`out` with the columns of `docs`: `own` names those an operator returns, the others are in `carried`."""
    return out.select(*[own[c].cast(docs.schema[c].dataType).alias(c) if c in own else F.col("carried")[c].alias(c) for c in docs.columns])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under the threshold."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    others = tuple(c for c in docs.columns if c != "text")
    kept = toxicity.score(docs, model, carry=others).where("predicted = 0")
    return _as(docs, kept, text=F.col("text"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that five documents or more share, but in the last of them."""
    others = tuple(c for c in docs.columns if c != "text")
    kept = line_dedup.dedup_lines(docs, carry=others)
    own = {"text": F.col("kept_text")} | ({"n_chars": F.length("kept_text")} if "n_chars" in docs.columns else {})
    return _as(docs, kept, **own)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies (five words, similarity 0.8). Rows are told apart by their place in the table."""
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = cut(docs)  # only a plain scan gives its rows the same places each time
    columns, place = docs.columns, "_place"
    while place in columns:
        place += "_"
    placed = docs.withColumn(place, F.monotonically_increasing_id())
    found = jaccard_join.jaccard_components(placed, words=5, threshold="0.8", id_col=place)
    grouped = found.select(F.col("doc_id").alias("at"), "component_id")
    grouped = cut(grouped.join(grouped.where("at <> component_id").select("component_id").distinct(), "component_id"))
    ids = placed.select(F.col(place).alias("at"), F.col("doc_id").alias("id"))
    first = grouped.join(ids, "at").groupBy("component_id").agg(F.min_by("at", F.struct(F.col("id").isNull(), "id", "at")).alias("at"))
    gone = cut(grouped.select("at").join(first.select("at"), "at", "left_anti")).withColumnRenamed("at", place)
    small = gone.count() <= BROADCAST_ROWS
    return placed.join(F.broadcast(gone) if small else gone, place, "left_anti").select(*[F.col(quoted(c)) for c in columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, each with its place in a training sequence."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [("toxicity", reject_toxic), ("line_dedup", drop_lines), ("jaccard_join", drop_near_copies), ("packing", pack)]

#: SQL cannot express the toxicity model; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's output is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs

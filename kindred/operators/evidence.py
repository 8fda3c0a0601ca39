"""Evidence of pairs from all arms, decided, and the best of it per pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.decide import Thresholds, decide, rank
from kindred.functions.features import fingerprint_distance
from kindred.operators.candidates import exact_pairs, near_pairs

#: Edges (16 bytes each) that one task groups.
EDGES_AT_ONCE = 2_000_000


def decided(pairs: DataFrame, t: Thresholds) -> DataFrame:
    """pairs(a, b, arm, cosine, phash_distance, same_sha256) with the decision."""
    verdict = decide(F.col("same_sha256"), F.col("phash_distance"), F.col("cosine"), t)
    return pairs.withColumn("v", verdict).select("a", "b", "arm", "cosine", "phash_distance", "same_sha256", "v.decision", "v.reason", "v.confidence")


def all_evidence(records: DataFrame, t: Thresholds, k: int = 50, cross_folder_only: bool = False) -> DataFrame:
    """Decided candidates of the arms: 0 equal digests, 1 near fingerprints, 2 one-sided top-k."""
    return decided(candidate_arms(records, t, k, cross_folder_only), t)


def candidate_arms(records: DataFrame, t: Thresholds, k: int = 50, cross_folder_only: bool = False, duplicates_only: bool = False) -> DataFrame:
    """What `all_evidence` decides. With `duplicates_only` partners below cosine_auto don't come from the top-k: as duplicates
    they are near fingerprints or equal digests as well, which have the same evidence where equal digests have equal features."""
    own = records.select("idx", "phash")
    equal = exact_pairs(records).join(own.toDF("a", "pa"), "a").join(own.toDF("b", "pb"), "b")
    arms = equal.select("a", "b", F.lit(0).alias("arm"), F.lit(None).cast("double").alias("cosine"), fingerprint_distance(F.col("pa"), F.col("pb")).alias("phash_distance"), F.lit(True).alias("same_sha256"))
    arms = arms.unionByName(near_pairs(records, t.phash_verify, k, t.cosine_auto if duplicates_only else t.cosine_review))
    if cross_folder_only:
        folder = records.select("idx", "parent")
        arms = arms.join(folder.toDF("a", "fa"), "a").join(folder.toDF("b", "fb"), "b").where("fa <> fb").drop("fa", "fb")
    return arms


def best_pairs(evidence: DataFrame) -> DataFrame:
    """One row per pair: highest decision, then highest cosine (none counts as -1), then the first arm; ignored pairs go."""
    held = F.struct("arm", "cosine", "phash_distance", "same_sha256", "decision", "reason", "confidence")
    order = F.struct(rank(F.col("decision")), F.coalesce("cosine", F.lit(-1.0)), -F.col("arm"))
    return evidence.groupBy("a", "b").agg(F.max_by(held, order).alias("p")).select("a", "b", "p.*").where("decision <> 'ignore'")


def best_decided(arms: DataFrame, t: Thresholds, duplicates_only: bool = False) -> DataFrame:
    """`best_pairs` of `decided`, where a pair's evidence differs between arms only in what is missing.

    Evidence is grouped as numbers and decided once a pair: a decision's rank stands for it meanwhile.
    """
    verdict = rank(decide(F.col("same_sha256"), F.col("phash_distance"), F.col("cosine"), t)["decision"])
    ranked = arms.withColumn("_rank", verdict).where(F.col("_rank") > (1 if duplicates_only else 0))
    order = F.struct("_rank", F.coalesce("cosine", F.lit(-1.0)).alias("_cosine"), (-F.col("arm")).alias("_arm"))
    held = F.struct("arm", "cosine", "phash_distance", "same_sha256")
    return decided(ranked.groupBy("a", "b").agg(F.max_by(held, order).alias("p")).select("a", "b", "p.*"), t)


def groups_of(pairs: DataFrame) -> DataFrame:
    """(idx, group_id) over duplicate pairs; review pairs never group."""
    from kindred.operators.components import connected_components

    return connected_components(pairs.where("decision = 'duplicate'"), at_once=EDGES_AT_ONCE)

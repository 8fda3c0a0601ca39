"""The three workflows as plans over a record table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.decide import Thresholds, decide
from kindred.operators import report
from kindred.operators.candidates import against_reference
from kindred.operators.cluster import split_groups
from kindred.operators.evidence import best_decided, candidate_arms, groups_of
from kindred.operators.quality import QualityLimits, rejection_reason
from kindred.operators.representatives import keep
from kindred.operators.select import select_representatives
from kindred.plans.session import cut


@dataclass(frozen=True)
class Matches:
    """Pairs that aren't ignored, and groups."""

    pairs: DataFrame
    components: DataFrame


def best_of_all_arms(records: DataFrame, t: Thresholds = Thresholds(), k: int = 50, cross_folder_only: bool = False, duplicates_only: bool = False) -> DataFrame:
    """Candidates of all arms, decided; the best per pair, without those that are ignored. With `duplicates_only`, the duplicates
    alone; that asks for equal features where digests are equal, and looks for fewer candidates."""
    return best_decided(candidate_arms(records, t, k, cross_folder_only, duplicates_only), t, duplicates_only)


def match(records: DataFrame, t: Thresholds = Thresholds(), k: int = 50, cross_folder_only: bool = False, linkage: str | None = None, split_at: float | None = None, duplicates_only: bool = False) -> Matches:
    """`best_of_all_arms`, and components of the duplicates, split if a linkage is given."""
    pairs = cut(best_of_all_arms(records, t, k, cross_folder_only, duplicates_only))
    components = groups_of(pairs)
    if linkage:
        components = split_groups(components, records, t.cosine_auto if split_at is None else split_at, linkage)
    return Matches(pairs, cut(components))


def dedup(records: DataFrame, policy: str = "highest-resolution", **options) -> tuple[Matches, DataFrame, DataFrame]:
    """Matches, kept records, and a report row per removed record."""
    found = match(records, **options)
    kept = keep(found.components, records, policy)
    return found, kept, report.report_rows(found.components, kept, found.pairs, records)


def remove_like(records: DataFrame, reference: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Records that match the one reference row, decided on all evidence; the reference itself is never among them."""
    pairs = against_reference(records, reference).withColumn("v", decide(F.col("same_sha256"), F.col("phash_distance"), F.col("cosine"), t))
    return pairs.select("a", "b", "cosine", "phash_distance", "same_sha256", "v.decision", "v.reason", "v.confidence").where("decision <> 'ignore'")


@dataclass(frozen=True)
class Selection:
    """Selected rows (position, idx), the tables that were left out, and the funnel."""

    selected: DataFrame
    rejected: DataFrame
    duplicates: DataFrame
    failed: DataFrame
    unselected: DataFrame
    funnel: DataFrame


def select(spark: SparkSession, records: DataFrame, count: int, method: str = "kmeans", seed: int = 42, policy: str = "best-quality", limits: QualityLimits | None = None, components: DataFrame | None = None, **options) -> Selection:
    """Quality, duplicates (one per group among members with a vector stays), then exactly `count` diverse records."""
    judged = records.withColumn("rejection_reason", rejection_reason(limits) if limits else F.lit(None).cast("string"))
    rejected, fine = judged.where("rejection_reason IS NOT NULL"), judged.where("rejection_reason IS NULL")
    groups = components if components is not None else match(fine, **options).components
    able = fine.where("embedding IS NOT NULL")
    within = groups.join(able.select("idx"), "idx", "left_semi")
    kept = keep(within, fine, policy)
    # a group no member of which has a vector is left alone: its members count as failed, not as duplicates
    lost = groups.join(kept, "group_id").where("idx <> keep").select("idx")
    duplicates = fine.join(lost, "idx", "left_semi")
    rest = fine.join(lost, "idx", "left_anti")
    failed, eligible = rest.where("embedding IS NULL"), cut(rest.where("embedding IS NOT NULL"))
    there = eligible.count()
    if there < count:
        raise ValueError(f"only {there} records are left to select {count} from")
    # selection numbers its rows by path, as ties go by that order
    chosen = select_representatives(spark, eligible, count, method, seed)
    unselected = eligible.join(chosen, "idx", "left_anti")
    funnel = report.selection_funnel(records, rejected, duplicates, failed, chosen)
    return Selection(chosen, rejected, duplicates, failed, unselected, funnel)

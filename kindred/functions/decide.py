"""The decision of a pair, as one CASE over its evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Thresholds:
    cosine_auto: float = 0.97
    cosine_verify: float = 0.90
    cosine_review: float = 0.85
    phash_auto: int = 4
    phash_verify: int = 8

    def __post_init__(self) -> None:
        if not self.cosine_review <= self.cosine_verify <= self.cosine_auto:
            raise ValueError("review <= verify <= auto must hold")


def no_nan(c: Column) -> Column:
    """NaN as NULL: Spark holds NaN above every number, the rules hold it below all."""
    return F.when(~F.isnan(c), c)


def decide(same_sha: Column, distance: Column, cosine: Column, t: Thresholds) -> Column:
    """struct(decision, reason, confidence). NULL evidence satisfies nothing. Reasons are formatted here, on the driver."""
    cos = no_nan(cosine)

    def out(decision: str, reason: str, confidence: str) -> Column:
        return F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason"), F.lit(confidence).alias("confidence"))

    return (
        F.when(F.coalesce(same_sha, F.lit(False)), out("duplicate", "same_sha256", "exact"))
        .when(distance <= t.phash_auto, out("duplicate", f"phash_distance<={t.phash_auto}", "high"))
        .when(cos >= t.cosine_auto, out("duplicate", f"cosine>={t.cosine_auto:.2f}", "high"))
        .when((cos >= t.cosine_verify) & (distance <= t.phash_verify), out("duplicate", f"cosine>={t.cosine_verify:.2f}_and_phash<={t.phash_verify}", "verified"))
        .when((cos >= t.cosine_review) & (cos < t.cosine_verify), out("review", f"{t.cosine_review:.2f}<=cosine<{t.cosine_verify:.2f}", "review"))
        .otherwise(out("ignore", "not_confident", "ignored"))
    )


def rank(decision: Column) -> Column:
    return F.when(decision == "duplicate", 2).when(decision == "review", 1).otherwise(0)

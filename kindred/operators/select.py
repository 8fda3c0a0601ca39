"""Exactly M diverse records: k-means, farthest-point, or both."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.features import unit_or_zero
from kindred.plans.session import cut

#: Choices after which the least distances are written.
WRITTEN_EVERY = 8
#: k-means is fitted so often, from other starts; the fit of least cost counts.
RESTARTS = 3
METHODS = ("kmeans", "farthest", "hybrid")


def _nearest_unique(rows: DataFrame, centres: list[np.ndarray]) -> list[int]:
    """For each centre in turn the nearest unused row, lowest idx on ties. Executors send each centre's M best; M rows
    are always enough, as M - 1 are used at most."""
    m, table = len(centres), np.stack(centres)

    def best(batches):
        for pdf in batches:
            d = ((np.stack(pdf["v"].to_list())[:, None, :] - table[None]) ** 2).sum(2) if len(pdf) * table.size < 5e7 else None
            for c in range(m):
                own = d[:, c] if d is not None else ((np.stack(pdf["v"].to_list()) - table[c]) ** 2).sum(1)
                order = np.lexsort((pdf["idx"].to_numpy(), own))[:m]
                yield pd.DataFrame({"centre": c, "idx": pdf["idx"].to_numpy()[order], "d": own[order]})

    from pyspark.sql import Window

    found = rows.mapInPandas(best, "centre int, idx long, d double")
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("centre").orderBy("d", "idx"))).where(F.col("r") <= m)
    out: list[int] = []
    used: set[int] = set()
    for _, group in ranked.toPandas().sort_values(["centre", "r"]).groupby("centre"):
        pick = next((int(i) for i in group["idx"] if int(i) not in used), None)
        if pick is not None:
            used.add(pick)
            out.append(pick)
    return out


def select_farthest(rows: DataFrame, count: int, seed: int, start: list[int] | None = None) -> list[int]:
    """Seeded first row, then always the row farthest from all chosen, lowest idx on ties.

    Each pass finds the next choice and lowers every row's least distance by the last one alone; the distances are written
    every so many passes, so a choice costs one look at each row, and only one row of each batch travels.
    """
    chosen = list(start or [])
    if not chosen:
        at = int(np.random.default_rng(seed).integers(rows.count()))
        chosen = [rows.select("idx").orderBy("idx").offset(at).first().idx]
    new, state = list(chosen), rows.withColumn("least", F.lit(float("inf")))
    while len(chosen) < count:
        table = [(r.idx, np.array(r.v)) for r in state.where(F.col("idx").isin(new)).collect()]

        def lowered(batches, table=table):
            for pdf in batches:
                if len(pdf):
                    v = np.stack(pdf["v"].to_list())
                    for idx, t in table:
                        pdf["least"] = np.minimum(pdf["least"], ((v - t) ** 2).sum(1))
                        pdf.loc[pdf["idx"] == idx, "least"] = -1.0  # chosen
                yield pdf

        state = state.mapInPandas(lowered, state.schema)
        if len(chosen) % WRITTEN_EVERY == 0:
            state = cut(state)
        chosen.append(state.where("least >= 0").agg(F.min_by("idx", F.struct(-F.col("least"), "idx"))).first()[0])
        new = chosen[-1:]
    return chosen


def select_kmeans(rows: DataFrame, count: int, seed: int) -> list[int]:
    """The row nearest to each of `count` centres; farthest rows fill up where centres coincide."""
    if count == rows.count():
        return [r.idx for r in rows.select("idx").orderBy("idx").collect()]
    points = rows.select(array_to_vector("v").alias("f"))
    fits = [KMeans(k=count, seed=seed + i, featuresCol="f", maxIter=20).fit(points) for i in range(RESTARTS)] if count > 1 else []
    fitted = min(fits, key=lambda m: m.summary.trainingCost, default=None)
    centres = [np.asarray(c) for c in fitted.clusterCenters()] if fitted else [np.array(rows.select(*[F.avg(F.col("v")[i]) for i in range(len(rows.first().v))]).first())]
    picked = _nearest_unique(rows, centres)
    return picked if len(picked) == count else select_farthest(rows, count, seed, picked)


def select_hybrid(rows: DataFrame, count: int, seed: int, oversample: int = 3) -> list[int]:
    """k-means to three times as many, farthest-point among those."""
    total = rows.count()
    if count == total:
        return [r.idx for r in rows.select("idx").orderBy("idx").collect()]
    pool = select_kmeans(rows, min(total, oversample * count), seed)
    return select_farthest(cut(rows.where(F.col("idx").isin(pool))), count, seed)


def select_representatives(spark: SparkSession, records: DataFrame, count: int, method: str = "kmeans", seed: int = 42) -> DataFrame:
    """(position, idx) of exactly `count` records with vectors, in the order of choice; scaling a vector changes nothing."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; one of {', '.join(METHODS)}")
    rows = cut(records.where("embedding IS NOT NULL").select("idx", unit_or_zero(F.col("embedding")).alias("v")))
    total = rows.count()
    if not 1 <= count <= total:
        raise ValueError(f"{count} of {total} records can't be selected")
    picked = {"kmeans": select_kmeans, "farthest": select_farthest, "hybrid": select_hybrid}[method](rows, count, seed)
    return spark.createDataFrame(list(enumerate(picked)), "position int, idx long")

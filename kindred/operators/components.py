"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.plans.session import cut, few

#: Edges (16 bytes each) that a task holds before it makes stars of them.
EDGES_HELD = 1_000_000


def _rows(*pairs: tuple[str, str]):
    """Several (u, v) from one row. No union, so that a table in one partition stays there and needs no shuffle."""
    return F.inline(F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in pairs]))


def _written(edges: DataFrame) -> tuple[DataFrame, tuple[int, int, int]]:
    """The edges, written and read back by as few tasks as they need; their number, their digest, and how many are loops."""
    out = cut(edges)
    r = out.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.count_if(F.col("u") == F.col("v")).alias("loops")).first()
    return few(out, r.n), (r.n, r.x or 0, r.loops)


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex links its larger neighbours to the smallest vertex it knows."""
    both = edges.select(_rows(("u", "v"), ("v", "u")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex links its smaller neighbours and itself to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(_rows(("v", "m"), ("u", "m"))).where("u <> v").distinct()


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of the edges, and the least one that each can reach."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    root = np.arange(len(names))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    return names, names[root]


def _stars(batches):
    """The edges (u, v) of a task as (vertex, least one it can reach); at most EDGES_HELD and two for each vertex are held."""
    u, v, held, many = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        many += batch.num_rows
        if many >= EDGES_HELD:
            u, v = least_reached(*(np.concatenate(c) for c in zip((u, v), *held, strict=True)))
            held, many = [], 0
    u, v = least_reached(*(np.concatenate(c) for c in zip((u, v), *held, strict=True)))
    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", at_once: int = 0) -> DataFrame:
    """(idx, group_id) for every vertex that has an edge; group_id is the least vertex it can reach.

    Loops, repeated edges and edges with a null end are allowed and change nothing. Every round is written to the
    checkpoint folder, so neither the lineage nor what a lost executor costs grows with the rounds. Rounds grow with
    the logarithm of the longest chain. Rounds over edges that one task can read back shuffle nothing. With `at_once`
    each task first makes stars of its edges, and one task ends it if there are no more than that.
    """
    clean = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    if at_once:
        stars = cut(clean.coalesce(edges.sparkSession.sparkContext.defaultParallelism).mapInArrow(_stars, "u long, v long"))
        if stars.count() <= at_once:
            return stars.coalesce(1).mapInArrow(_stars, "u long, v long").toDF("idx", "group_id")
        clean = stars
    first, mark = _written(clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    loops, now = mark[2], first
    if loops:
        now, mark = _written(first.where("u <> v"))
    while mark[0]:
        before = mark
        now, mark = _written(_small_star(_large_star(now)))
        if mark == before:
            break
    members = now.select(_rows(("u", "v"), ("v", "v"))).distinct().toDF("idx", "group_id")
    if not loops:
        return members
    alone = first.where("u = v").select(F.col("u").alias("idx")).join(members, "idx", "left_anti")
    return members.unionByName(alone.select("idx", F.col("idx").alias("group_id")))

"""Agglomerative splitting of groups.

Equal unit vectors of a group are one weighted row: their distance is 0 (or rounding), so they merge before others do.
Up to MOST_MEMBERS different vectors of a group are clustered on their square matrix; more by a chain of nearest
neighbours, which holds the vectors and some rows of distances and finds the same clusters, but where distances tie.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.plans.session import cut

#: Different vectors of a group that one task holds as a square matrix.
MOST_MEMBERS = 5000
#: Distances (8 bytes each) that a chain keeps, and that it makes at once.
KEPT_DISTANCES, DISTANCES_AT_ONCE = 16_000_000, 4_000_000
SALTS = 16


def linkage_labels(vectors: np.ndarray, least_cosine: float, linkage: str, weights: np.ndarray | None = None) -> np.ndarray:
    """Cluster number per row: merge the two nearest clusters while they are nearer than 1 - least_cosine (strictly)."""
    distance = 1 - np.clip(vectors @ vectors.T, -1, 1)
    np.fill_diagonal(distance, np.inf)
    n, size, label = len(vectors), np.ones(len(vectors)) if weights is None else weights.astype(float), np.arange(len(vectors))
    # each row's nearest, the first of equal ones, so that a merge looks at the whole matrix no more
    nearest = distance.argmin(1)
    least = distance[label, nearest]
    while n > 1:
        i = int(least.argmin())
        j = int(nearest[i])
        i, j = min(i, j), max(i, j)
        if not distance[i, j] < 1 - least_cosine:
            break
        merged = np.maximum(distance[i], distance[j]) if linkage == "complete" else (size[i] * distance[i] + size[j] * distance[j]) / (size[i] + size[j])
        distance[i], distance[:, i] = merged, merged
        distance[i, i] = distance[j] = distance[:, j] = np.inf
        size[i] += size[j]
        label[label == label[j]] = label[i]
        n -= 1
        lost = (nearest == i) | (nearest == j)
        lost[[i, j]] = True
        closer = ~lost & ((distance[:, i] < least) | (distance[:, i] == least) & (i < nearest))
        nearest[closer], least[closer] = i, distance[closer, i]
        for part in np.array_split(np.flatnonzero(lost), max(1, len(lost) * int(lost.sum()) // DISTANCES_AT_ONCE)):
            nearest[part] = distance[part].argmin(1)
            least[part] = distance[part, nearest[part]]
    return label


def chain_labels(vectors: np.ndarray, least_cosine: float, linkage: str, weights: np.ndarray | None = None, kept: int = KEPT_DISTANCES) -> np.ndarray:
    """What `linkage_labels` returns (the numbers may differ), without the square matrix.

    A chain goes from each cluster to its nearest one until two are nearest to each other, which then merge; for these
    linkages no merge brings a third cluster nearer, so the order doesn't matter. A cluster without another one in reach
    is done. A cluster's row holds its largest (complete) or its summed (average) distance to each vector.
    """
    n, reach = len(vectors), 1 - least_cosine
    weight = np.ones(n) if weights is None else weights.astype(float)
    label, size, members, open_ = np.arange(n), weight.copy(), {i: [i] for i in range(n)}, np.ones(n, bool)
    rows: OrderedDict[int, np.ndarray] = OrderedDict()
    most = max(2, kept // max(n, 1))

    def keep(c: int, row: np.ndarray) -> np.ndarray:
        rows[c] = row
        rows.move_to_end(c)
        if len(rows) > most:
            rows.popitem(last=False)
        return row

    def row_of(c: int) -> np.ndarray:
        if c in rows:
            rows.move_to_end(c)
            return rows[c]
        out = np.full(n, -np.inf) if linkage == "complete" else np.zeros(n)
        step = max(1, DISTANCES_AT_ONCE // n)
        for at in range(0, len(members[c]), step):
            some = members[c][at : at + step]
            distance = 1 - np.clip(vectors[some] @ vectors.T, -1, 1)
            out = np.maximum(out, distance.max(0)) if linkage == "complete" else out + weight[some] @ distance
        return keep(c, out)

    chain: list[int] = []
    start = 0
    while True:
        if not chain:
            while start < n and not (open_[start] and label[start] == start):
                start += 1
            if start == n:
                return label
            chain.append(start)
        tip = chain[-1]
        row = row_of(tip)
        if linkage == "complete":
            to = np.full(n, -np.inf)
            np.maximum.at(to, label, row)
        else:
            to = np.bincount(label, weights=row * weight, minlength=n) / (size * size[tip])
        to[~open_] = np.inf
        to[tip] = np.inf
        nearest = int(to.argmin())
        if not to[nearest] < reach:
            # only the first of a chain has nothing in reach: the others were reached from the one before
            open_[tip] = False
            chain.pop()
            continue
        # distances fall along the chain, so coming back to an earlier one is a tie but for rounding
        if len(chain) > 1 and (to[chain[-2]] <= to[nearest] or nearest in chain):
            nearest = chain[-2]
            chain = chain[:-2]
            other = row_of(nearest)
            keep(tip, np.maximum(row, other) if linkage == "complete" else row + other)
            rows.pop(nearest, None)
            label[members[nearest]] = tip
            members[tip] += members.pop(nearest)
            size[tip] += size[nearest]
            open_[nearest] = False
            # the merged cluster may lie behind `start`
            if not chain:
                chain.append(tip)
        else:
            chain.append(nearest)


def split_groups(components: DataFrame, records: DataFrame, least_cosine: float, linkage: str = "complete", most: int = MOST_MEMBERS) -> DataFrame:
    """(idx, group_id) after splitting: groups under three, or with a member without vector, stay; singletons go."""
    if linkage not in ("complete", "average"):
        raise ValueError("linkage is complete or average")
    if not -1 <= least_cosine <= 1:
        raise ValueError("the cosine threshold lies in [-1, 1]")

    def told(held: list) -> pa.RecordBatch:
        """Parts of whole groups, which lie together in order of their first members."""
        table = pa.Table.from_batches(held).combine_chunks()
        group, first, n = (table[c].to_numpy() for c in ("group_id", "first", "n"))
        edges = np.flatnonzero(np.diff(group, prepend=group[0] - 1, append=group[-1] + 1))
        vectors = table["embedding"].combine_chunks()
        whole = vectors.is_valid().to_numpy(zero_copy_only=False)
        splits = (np.add.reduceat(n, edges[:-1]) > 2) & np.logical_and.reduceat(whole, edges[:-1])
        part, stays = group.copy(), np.ones(len(group), bool)
        for lo, hi in zip(edges[:-1][splits].tolist(), edges[1:][splits].tolist(), strict=True):
            own = vectors.slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(hi - lo, -1)
            if hi - lo == 1:
                label = np.zeros(1, int)
            else:
                label = (linkage_labels if hi - lo <= most else chain_labels)(own, least_cosine, linkage, n[lo:hi])
            _, head, label = np.unique(label, return_index=True, return_inverse=True)
            part[lo:hi] = first[lo:hi][head[label]]
            stays[lo:hi] = (np.bincount(label, weights=n[lo:hi]) > 1)[label]
        return pa.RecordBatch.from_arrays([pa.array(first[stays]), pa.array(part[stays])], ["first", "part"])

    def split(batches):
        held: list = []
        for batch in batches:
            groups = batch.column("group_id").to_numpy()
            if not len(groups):
                continue
            last = int(np.searchsorted(groups, groups[-1]))  # where the group begins that may go on
            if held and (last or groups[0] != held[-1].column("group_id")[-1].as_py()):
                yield told([*held, batch.slice(0, last)] if last else held)
                held = []
            elif last:
                yield told([batch.slice(0, last)])
            held.append(batch.slice(last))
        if held:
            yield told(held)

    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    # equal vectors are one row where their distance is 0 and in reach; others (zero vectors) stay apart by their idx
    alike = (F.abs(norm - 1) <= 1e-6) & (F.least(norm, F.lit(1.0)) > least_cosine)
    members = components.join(records.select("idx", F.col("embedding")), "idx")
    members = cut(members.select("idx", "group_id", "embedding", F.when(F.col("embedding").isNull() | alike, F.lit(-1)).otherwise(F.col("idx")).alias("own")))
    distinct = cut(members.groupBy("group_id", "embedding", "own").agg(F.min("idx").alias("first"), F.count(F.lit(1)).alias("n")))
    # groups under three, most of all, go through with the others: a task tells many groups at once
    parts = distinct.repartition("group_id").sortWithinPartitions("group_id", "first").select("group_id", "first", "n", "embedding").mapInArrow(split, "first long, part long")
    # a vector may belong to very many members, which are dealt by a salt as well
    found = distinct.join(parts, "first").select(F.col("group_id").alias("_g"), F.col("embedding").alias("_e"), F.col("own").alias("_o"), "part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = members.withColumn("salt", F.pmod(F.xxhash64("idx"), F.lit(SALTS)).cast("int"))
    same = (F.col("group_id") == F.col("_g")) & (F.col("own") == F.col("_o")) & F.col("embedding").eqNullSafe(F.col("_e")) & (F.col("salt") == F.col("_salt"))
    return salted.join(found, same).select("idx", F.col("part").alias("group_id"))

"""The three candidate arms: equal digests, near fingerprints, top-k inner products; and one record against all."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from kindred.functions.decide import no_nan
from kindred.functions.features import dot, fingerprint_bits
from kindred.plans.session import cut

#: Rows of a block of the exact inner-product scan: two blocks and their scores are what one task holds.
BLOCK_ROWS = 16384
#: Rows of a block of the scans by threshold from which on tables are many blocks rather than larger ones.
LARGE_BLOCK, LEAST_BLOCKS = 65536, 8
#: Rows of a tile of such a scan, and pairs that a task scores or holds before it hands them on.
TILE, TILE_COLUMNS, PAIRS_AT_ONCE = 128, 8192, 1 << 16
#: Rows and columns of a tile where both sides look for partners, rows whose best product is looked at first, and partners held.
WIDE_TILE, GROUP, MOST_HELD = 1024, 32, 1 << 22
#: Rows of a cell of like vectors, in which floors are found, and rows that choose the cells.
CELL_ROWS, CELL_SAMPLE = 16384, 8192
#: Squared distance of partners up to which a tile meets only rows near its box; rows of such a tile, axes of the box, and rows that floors come from then.
NEAR, NEAR_TILE, AXES, NEAR_CELL = 0.125, 512, 16, 2048
#: Bands of a fingerprint, and pairs from which on they are looked up.
BANDS, LEAST_LOOKUP = 3, 1 << 26


def exact_pairs(records: DataFrame) -> DataFrame:
    """(a, b), a < b, of records with equal digests; null and empty digests match nothing."""
    keyed = records.where("sha256 IS NOT NULL AND sha256 <> ''").select("idx", "sha256")
    a, b = keyed.alias("a"), keyed.alias("b")
    return a.join(b, (F.col("a.sha256") == F.col("b.sha256")) & (F.col("a.idx") < F.col("b.idx"))).select(F.col("a.idx").alias("a"), F.col("b.idx").alias("b"))


def exact_groups(records: DataFrame) -> DataFrame:
    """(sha256, n, first_idx) of digests held more than once."""
    return records.where("sha256 IS NOT NULL AND sha256 <> ''").groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx")).where("n > 1")


def hamming_pairs(records: DataFrame, radius: int, bands: int = 4) -> DataFrame:
    """(a, b, distance), a < b, of all records whose fingerprints differ in at most `radius` bits.

    Multi-index hashing: of `bands` bands one differs in at most radius // bands bits, so one side probes each band
    with all its neighbours within that radius and the join is an equi-join, rechecked and made distinct.
    """
    width = 64 // bands
    flips = [sum(1 << i for i in c) for n in range(radius // bands + 1) for c in combinations(range(width), n)]
    bits = records.select("idx", fingerprint_bits(F.col("phash")).alias("bits")).where("bits IS NOT NULL")
    band = F.posexplode(F.array(*[F.shiftrightunsigned("bits", i * width).bitwiseAND(F.lit((1 << width) - 1)) for i in range(bands)]))
    held = bits.select("idx", "bits", band.alias("band", "value"))
    probes = held.select("idx", "bits", "band", F.explode(F.transform(F.array(*[F.lit(f).cast("long") for f in flips]), lambda m: F.col("value").bitwiseXOR(m))).alias("value"))
    a, b = probes.alias("a"), held.alias("b")
    apart = F.bit_count(F.col("a.bits").bitwiseXOR(F.col("b.bits")))
    met = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.idx") < F.col("b.idx")) & (apart <= radius))
    return met.select(F.col("a.idx").alias("a"), F.col("b.idx").alias("b"), apart.alias("distance")).distinct()


def _meetings(rows: DataFrame, block_rows: int, columns: list[str], meet, schema: str) -> DataFrame:
    """What `meet(left, right)` yields for any two blocks of `rows`, each two once in a task of its own; of a block by itself right is None."""
    many = rows.count()
    blocks = max(1, -(-many // max(block_rows, min(LARGE_BLOCK, many // LEAST_BLOCKS))))
    block, other = F.col("_block"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64("idx"), F.lit(blocks)).cast("int")).withColumn("_other", other)
    low, high = F.least("_block", "_other"), F.greatest("_block", "_other")
    dealt = dealt.select((F.expr("greatest(_block, _other) * (greatest(_block, _other) + 1) div 2") + low).cast("int").alias("_at"), (block == high).alias("_right"), (low == high).alias("_alone"), *columns)

    def run(batches):
        held = [b for b in batches if b.num_rows]  # one meeting to a task
        if not held:
            return
        table = pa.Table.from_batches(held)
        if table["_alone"][0].as_py():
            yield from meet(table, None)
            return
        yield from meet(table.filter(pc.invert(table["_right"])), table.filter(table["_right"]))

    return dealt.repartitionById(blocks * (blocks + 1) // 2, F.col("_at")).mapInArrow(run, schema)


def _best(left: np.ndarray, right: np.ndarray, k: int, least: float):
    """(p, q, cosine) by place: of each left row its k best right ones at or above `least`; right rows are in order of their ids.

    Products in single precision leave open what lies within their error of the threshold; what they don't rule out is
    scored in double precision.
    """
    short, base = left.astype(np.float32), np.ascontiguousarray(right.astype(np.float32).T)
    size = np.sqrt((left * left).sum(1)).max(initial=0) * np.sqrt((right * right).sum(1)).max(initial=0)
    # the error of a sum of products, and the last digit of a rounded score
    fast = bool(np.isfinite(size) and size < 1e30)
    error = size * 2.0**-23 * (left.shape[1] + 4) + 1e-6
    for i in range(0, len(left), TILE):
        rows = min(TILE, len(left) - i)
        cut, held, many = np.full((rows, 1), least - error, np.float32), [], 0
        for j in range(0, len(right), TILE_COLUMNS):
            wide = min(TILE_COLUMNS, len(right) - j)
            if not fast:
                x, y = np.divmod(np.arange(rows * wide), wide)
                held.append((x, y + j, np.zeros(len(x), np.float32)))
                continue
            product = short[i : i + TILE] @ base[:, j : j + wide]
            at = np.flatnonzero(product >= cut)
            x, y = np.divmod(at, wide)
            held.append((x, y + j, product.ravel()[at]))
            many += len(at)
            if many > 3 * k * rows:
                # a row's k best so far rule out what is lower by more than the error of either
                x, y, about = (np.concatenate(c) for c in zip(*held, strict=True))
                order = np.lexsort((-about, x))
                last = np.searchsorted(x[order], np.arange(rows)) + k - 1
                full = last < np.searchsorted(x[order], np.arange(rows), side="right")
                cut[full, 0] = np.maximum(cut[full, 0], about[order[last[full]]] - np.float32(2 * error))
                kept = about >= cut[x, 0]
                held, many = [(x[kept], y[kept], about[kept])], int(kept.sum())
        x, y, about = (np.concatenate(c) for c in zip(*held, strict=True))
        fine = about >= cut[x, 0] if fast else np.ones(len(x), bool)
        p, q = x[fine] + i, y[fine]
        steps = range(0, len(p), PAIRS_AT_ONCE)
        score = np.concatenate([np.round(np.einsum("ij,ij->i", left[p[at : at + PAIRS_AT_ONCE]], right[q[at : at + PAIRS_AT_ONCE]]), 6) + 0.0 for at in steps] or [np.zeros(0)])
        order = np.lexsort((q, -score, p))
        order = order[score[order] >= least]
        p, q, score = p[order], q[order], score[order]
        inside = np.arange(len(p)) - np.searchsorted(p, np.arange(i, i + TILE))[p - i] < k
        if len(p):
            yield p[inside], q[inside], score[inside]


def _near(x: np.ndarray, y: np.ndarray, radius: int):
    """(p, q, distance) by place, of fingerprints that differ in at most `radius` bits."""
    if radius // BANDS <= 2 and len(x) * len(y) >= LEAST_LOOKUP:
        yield from _near_by_bands(x, y, radius)
        return
    rows, wide = TILE // 2, TILE_COLUMNS // 2  # half a tile's xors stay in the cache
    for i in range(0, len(x), rows):
        for j in range(0, len(y), wide):
            apart = np.bitwise_count(x[i : i + rows, None] ^ y[None, j : j + wide])
            p, q = np.divmod(np.flatnonzero(apart <= radius), apart.shape[1])
            for at in range(0, len(p), PAIRS_AT_ONCE):
                u, v = p[at : at + PAIRS_AT_ONCE], q[at : at + PAIRS_AT_ONCE]
                yield u + i, v + j, apart[u, v].astype(np.int32)


def _near_by_bands(x: np.ndarray, y: np.ndarray, radius: int):
    """`_near` by multi-index hashing: one of the bands differs in at most radius // BANDS bits; a pair counts in the first such band."""
    least = radius // BANDS
    edges = [64 * b // BANDS for b in range(BANDS + 1)]
    masks = [np.uint64((1 << hi) - (1 << lo)) for lo, hi in zip(edges, edges[1:], strict=False)]
    for b, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        mine, theirs = (((z & masks[b]) >> np.uint64(lo)).astype(np.int64) for z in (x, y))
        many = np.bincount(theirs, minlength=1 << (hi - lo))
        order, held, end = np.argsort(theirs, kind="stable"), many > 0, np.cumsum(many)
        for flip in (sum(1 << i for i in c) for n in range(least + 1) for c in combinations(range(hi - lo), n)):
            probe = mine ^ flip
            found = np.flatnonzero(held[probe])
            count = many[probe[found]]
            upto = np.cumsum(count)
            at = 0
            while at < len(found):
                # as many probes as meet PAIRS_AT_ONCE fingerprints, one at least
                done = upto[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(upto, done + PAIRS_AT_ONCE, side="right")))
                some, n = found[at:to], count[at:to]
                inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                p, q = np.repeat(some, n), order[np.repeat(end[probe[some]] - n, n) + inside]
                apart = np.bitwise_count(x[p] ^ y[q])
                fine = apart <= radius
                for mask in masks[:b]:
                    fine &= np.bitwise_count((x[p] ^ y[q]) & mask) > least
                if fine.any():
                    yield p[fine], q[fine], apart[fine].astype(np.int32)
                at = to


def _error(vectors: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Of each vector, what a product with the others in single precision may be off, and the last digit of a rounded score."""
    size = np.sqrt((vectors * vectors).sum(1)) * np.sqrt((others * others).sum(1)).max(initial=0)
    return size * 2.0**-23 * (vectors.shape[1] + 4) + 1e-6


def _firsts(owner: np.ndarray, partner: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each owner, in order; equal scores by the lower partner."""
    order = np.lexsort((partner, -score, owner))
    mine = owner[order]
    return order[np.arange(len(mine)) - np.searchsorted(mine, mine) < k]


class _Lists:
    """The best partners so far of the rows of a block, trimmed to k each whenever MOST_HELD are held."""

    def __init__(self, floor: np.ndarray, k: int):
        self.floor, self.k, self.held, self.many = floor.copy(), k, [], 0

    def add(self, owner: np.ndarray, partner: np.ndarray, score: np.ndarray) -> bool:
        """Whether floors rose."""
        fine = score >= self.floor[owner]
        self.held.append((owner[fine], partner[fine], score[fine]))
        self.many += int(fine.sum())
        if self.many < MOST_HELD:
            return False
        owner, partner, score = self.best()
        self.held, self.many = [(owner, partner, score)], len(owner)
        # what is still there is no reason to trim again
        self.many -= min(self.many, MOST_HELD // 2)
        last = np.searchsorted(owner, np.arange(len(self.floor)), side="right") - 1
        full = np.bincount(owner, minlength=len(self.floor)) >= self.k
        self.floor[full] = score[last[full]]
        return True

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        owner, partner, score = (np.concatenate(c) for c in zip(*self.held, strict=True)) if self.held else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        first = _firsts(owner, partner, score, self.k)
        return owner[first], partner[first], score[first]


def _alike(vectors: np.ndarray, most: int) -> list[np.ndarray]:
    """Places of the rows in parts of at most `most` like ones: halved along the axis of most spread, again and again."""
    parts = [np.arange(len(vectors))]
    while len(parts[0]) > most:  # parts differ by one row at most, the first is among the largest
        halves = []
        for part in parts:
            own = vectors[part]
            along = np.argpartition(own[:, own.var(0).argmax()], len(part) // 2) if len(part) > 1 else np.arange(len(part))
            half = -(-len(part) // 2)
            halves += [part[along[:half]], part[along[half:]]]
        parts = halves
    return [part for part in parts if len(part)]


class _Boxes:
    """Right rows near a box of left rows, by the leading axes of the left ones; what it leaves out is farther than `reach`."""

    def __init__(self, left: np.ndarray, right: np.ndarray, reach: float):
        way = np.linalg.eigh(np.atleast_2d(np.cov(left.T)))[1][:, ::-1][:, :AXES]
        self.left, self.right, self.reach = left @ way, np.ascontiguousarray((right @ way).T), reach + 1e-6

    def near(self, rows: np.ndarray) -> np.ndarray:
        """Places of right rows that may lie within reach of some of the left rows, in order."""
        low, high = self.left[rows].min(0), self.left[rows].max(0)
        found, far = np.arange(self.right.shape[1]), 0.0
        for axes in (slice(0, 3), slice(3, None)):
            along = self.right[axes] if axes.start == 0 else self.right[axes, found]
            off = np.maximum(np.maximum(low[axes, None] - along, along - high[axes, None]), 0)
            far = far + np.einsum("ij,ij->j", off, off)
            fine = far <= self.reach
            found, far = found[fine], far[fine]
        return found


def _best_of_both(left: np.ndarray, right: np.ndarray | None, floors: tuple[np.ndarray, np.ndarray], k: int):
    """(p, q, score) by place twice: of each left row its k best right ones at or above its floor, and the other way round.

    One product serves both. Without `right` the left rows meet each other and themselves, and the second is None. Rows
    are in order of their ids. Products in single precision are compared less their error; what they leave is scored in
    double precision. Rows of like floors lie together, so the largest product of a group tells that none of it counts.
    Where floors leave only near partners, like rows lie together instead, and a tile meets the rows near its box.
    """
    alone = right is None
    right = left if alone else right
    order = [np.argsort(f, kind="stable") for f in floors]
    lists = [_Lists(floors[0], k)] + [_Lists(floors[1], k)] * (not alone)
    mine, theirs = lists[0], lists[-1]
    off = _error(left, right), _error(right, left)
    fast = bool(all(np.isfinite(e).all() and e.max(initial=0) < 1 for e in off))
    boxes, tiles = None, [np.arange(at, min(at + WIDE_TILE, len(left))) for at in range(0, len(left), WIDE_TILE)]
    if fast and len(left) > 1:
        # |u - v|^2 = |u|^2 + |v|^2 - 2 uv, and uv is at least the lower floor, less its error
        reach = (left * left).sum(1).max() + (right * right).sum(1).max() - 2 * min((f - e).min() for f, e in zip(floors, off, strict=True))
        if reach <= NEAR:
            boxes = _Boxes(left, right, reach)
            parts = _alike(boxes.left, min(NEAR_TILE, WIDE_TILE))
            edges = np.cumsum([0, *map(len, parts)])
            tiles = [np.arange(lo, hi) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
            order[0] = np.concatenate(parts)
            if alone:
                order[1] = order[0]
    place = np.argsort(order[1])
    x, y = (v[o].astype(np.float32) for v, o in zip((left, right), order, strict=True))
    error = off[0][order[0]], off[1][order[1]]

    def bounds():
        return (mine.floor[order[0]] - error[0]).astype(np.float32), (theirs.floor[order[1]] - error[1]).astype(np.float32)

    def scored(p: np.ndarray, q: np.ndarray) -> bool:
        rose = False
        for at in range(0, len(p), PAIRS_AT_ONCE):
            u, v = order[0][p[at : at + PAIRS_AT_ONCE]], order[1][q[at : at + PAIRS_AT_ONCE]]
            score = np.round(np.einsum("ij,ij->i", left[u], right[v]), 6) + 0.0
            rose |= mine.add(u, v, score)
            other = u != v if alone else slice(None)
            rose |= theirs.add(v[other], u[other], score[other])
        return rose

    below, above = bounds()
    room = np.empty(WIDE_TILE * WIDE_TILE, np.float32)
    for tile in tiles:
        i, rows = tile[0], len(tile)
        full = -(-rows // GROUP)
        met = np.arange(len(y)) if boxes is None else np.sort(place[boxes.near(order[0][tile])])
        met = met[met >= i] if alone else met
        for j in range(0, len(met), WIDE_TILE):
            some = met[j : j + WIDE_TILE]
            wide = len(some)
            if fast:
                product = room[: full * GROUP * wide].reshape(full * GROUP, wide)
                np.matmul(x[i : i + rows], y[some].T, out=product[:rows])
                product[rows:] = -np.inf
                own = np.full(full * GROUP, np.inf, np.float32)
                own[:rows] = below[i : i + rows]
                own = own.reshape(full, GROUP)
                grouped = product.reshape(full, GROUP, wide)
                g, c = np.divmod(np.flatnonzero(grouped.max(1) >= np.minimum(own.min(1)[:, None], above[some])), wide)
                n, r = np.divmod(np.flatnonzero(grouped[g, :, c] >= np.minimum(own[g], above[some[c]][:, None])), GROUP)
                p, q = g[n] * GROUP + r + i, some[c[n]]
            else:
                p, q = (z.ravel() for z in np.meshgrid(np.arange(i, i + rows), some, indexing="ij"))
            if alone:
                p, q = p[p <= q], q[p <= q]
            if scored(p, q):
                below, above = bounds()
    yield mine.best()
    yield None if alone else theirs.best()


def _tree(sample: np.ndarray, depth: int) -> list[list[tuple[np.ndarray, float]]]:
    """Directions and bounds that halve the sample `depth` times, level by level."""
    levels, parts = [], [sample]
    for _ in range(depth):
        level, halves = [], []
        for part in parts:
            centred = part - part.mean(0) if len(part) else np.zeros((1, sample.shape[1]))
            way = np.linalg.eigh(centred.T @ centred)[1][:, -1]
            along = part @ way
            bound = float(np.median(along)) if len(part) else 0.0
            level.append((way, bound))
            halves += [part[along <= bound], part[along > bound]]
        levels.append(level)
        parts = halves
    return levels


def _cells(vectors: np.ndarray, levels: list) -> np.ndarray:
    at = np.zeros(len(vectors), np.int64)
    for level in levels:
        along = np.einsum("ij,ij->i", vectors, np.stack([way for way, _ in level])[at])
        at = 2 * at + (along > np.array([bound for _, bound in level])[at])
    return at


def _floors(vectors: np.ndarray, k: int, least: float) -> np.ndarray:
    """Of each vector a score that k of these, itself among them, reach; `least` where they don't reach that."""
    out, n = np.full(len(vectors), least), len(vectors)
    step = max(1, min(8, n // (2 * k)))  # the k best of groups of rows, each by its best, reach no more than the k best rows
    fit = n // step * step
    error = _error(vectors, vectors)
    if fit // step < k or not (np.isfinite(error).all() and error.max(initial=0) < 1):
        return out
    single = vectors.astype(np.float32)
    for i in range(0, n, TILE):
        product = single[:fit] @ single[i : i + TILE].T
        best = product.reshape(fit // step, step, -1).max(1)
        reach = (best >= least).sum(0) >= k
        if reach.any():
            kth = np.partition(best[:, reach], best.shape[0] - k, axis=0)[best.shape[0] - k]
            out[i : i + TILE][reach] = np.maximum(least, kth.astype(np.float64) - error[i : i + TILE][reach])
    return out


def with_floors(rows: DataFrame, k: int, least: float, cell_rows: int | None = None) -> DataFrame:
    """`rows` with `floor`: a score of at least `least` below which no partner is among the k best of the row.

    Like vectors meet in cells, chosen by a sample, and a row's k-th best partner there is its floor. Which cells these are
    changes how high floors are, never which pairs are found.
    """
    cell_rows = cell_rows or CELL_ROWS
    sample = rows.where("embedding IS NOT NULL").select("embedding", F.xxhash64("idx").alias("_h")).orderBy("_h").limit(CELL_SAMPLE).toArrow()["embedding"].combine_chunks()
    some = sample.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sample), -1) if len(sample) else np.zeros((0, 0))
    some = some[np.isfinite(some).all(1) & (np.abs(some) < 1e30).all(1)]
    depth = max(0, int(np.ceil(np.log2(max(1, rows.count()) / cell_rows)))) if some.size else 0
    levels = _tree(some, depth)
    schema = rows.schema

    def vectors_of(table) -> tuple[np.ndarray, np.ndarray]:
        found = table["embedding"]
        found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
        whole = found.is_valid().to_numpy(zero_copy_only=False)
        flat = found.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return whole, flat.reshape(int(whole.sum()), -1) if len(flat) else np.zeros((int(whole.sum()), 0))

    def place(batches):
        for batch in batches:
            whole, vectors = vectors_of(batch)
            cell = np.arange(batch.num_rows) % (1 << depth)  # rows without a vector go anywhere
            if vectors.size:
                cell[whole] = _cells(vectors, levels)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], [*schema.names, "_cell"])

    def find(batches):
        def told(held):
            table = pa.Table.from_batches(held).drop_columns(["_cell"]).combine_chunks()
            whole, vectors = vectors_of(table)
            floor = np.full(len(table), least)
            if vectors.size:
                # the few partners of a high score are among the most alike
                parts = _alike(vectors, NEAR_CELL) if 2 - 2 * least <= NEAR else [np.arange(len(vectors))]
                for part in parts:
                    floor[np.flatnonzero(whole)[part]] = _floors(vectors[part], k, least)
            yield from table.append_column("floor", pa.array(floor)).to_batches()

        held, many = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, cell_rows):
                part = batch.slice(at, cell_rows)
                if many + part.num_rows > 2 * cell_rows:
                    yield from told(held)
                    held, many = [], 0
                held.append(part)
                many += part.num_rows
        if many:
            yield from told(held)

    dealt = rows.mapInArrow(place, StructType([*schema.fields, StructField("_cell", IntegerType())]))
    return dealt.repartitionById(1 << depth, F.col("_cell")).mapInArrow(find, StructType([*schema.fields, StructField("floor", DoubleType())]))


class _Block:
    """Records of a block in order of their ids; rows without a vector or fingerprint are told by `whole` and `printed`."""

    def __init__(self, table: pa.Table):
        table = table.take(pc.sort_indices(table, [("idx", "ascending")])).combine_chunks()
        self.ids = table["idx"].to_numpy()
        vectors = table["embedding"].combine_chunks()
        self.whole = vectors.is_valid().to_numpy(zero_copy_only=False)
        flat, self.n = vectors.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64), len(table)
        self.vectors = np.zeros((self.n, len(flat) // max(1, int(self.whole.sum()))))
        self.vectors[self.whole] = flat.reshape(int(self.whole.sum()), -1) if len(flat) else 0
        if "bits" in table.column_names:
            bits = table["bits"].combine_chunks()
            self.printed, self.bits = bits.is_valid().to_numpy(zero_copy_only=False), bits.fill_null(0).to_numpy().view(np.uint64)
            self.sha, self.floor = table["sha256"].combine_chunks(), table["floor"].to_numpy()

    def best(self, other: _Block, k: int, least: float):
        """`_best` between the rows that have vectors, by their places in the blocks."""
        mine, theirs = np.flatnonzero(self.whole), np.flatnonzero(other.whole)
        if len(mine) and len(theirs):
            for p, q, score in _best(self.vectors[mine], other.vectors[theirs], k, least):
                yield mine[p], theirs[q], score


def _number(l: _Block, r: _Block) -> None:
    """Numbers in place of digests: equal ones are equal in both blocks, null and empty ones are -1."""
    parts = [b.sha for b in ((l,) if l is r else (l, r))]
    codes = pc.index_in(pa.chunked_array(parts), pc.unique(pa.chunked_array(parts))).to_numpy()
    codes = np.where(pc.fill_null(pc.not_equal(pa.chunked_array(parts), ""), False).to_numpy(), codes, -1)
    l.digest, r.digest = codes[: l.n], codes[len(codes) - r.n :]


def _above(records: DataFrame, k: int, least: float, block_rows: int) -> DataFrame:
    """(a, b, cosine) at or above `least`, of each record and block the k best."""

    def meet(left: pa.Table, right: pa.Table | None):
        l = _Block(left)
        r = l if right is None else _Block(right)
        for own, other in ((l, r),) if right is None else ((l, r), (r, l)):
            for p, q, score in own.best(other, k, least):
                yield pa.RecordBatch.from_arrays([pa.array(own.ids[p]), pa.array(other.ids[q]), pa.array(score)], ["a", "b", "cosine"])

    return _meetings(records, block_rows, ["idx", "embedding"], meet, "a long, b long, cosine double")


def near_pairs(records: DataFrame, radius: int, k: int, least: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, arm, cosine, phash_distance, same_sha256), a < b: arm 1 of fingerprints within `radius`, arm 2 of the one-sided top-k.

    Blocks meet blocks with all that the evidence is made of, so no pair is joined with its records.
    """
    names = ["a", "b", "arm", "cosine", "phash_distance", "same_sha256"]

    def told(l: _Block, r: _Block, arm: int, p: np.ndarray, q: np.ndarray, cosine: np.ndarray | None) -> pa.RecordBatch:
        # each way round for the top-k, whose ranks count partners on both sides
        if cosine is None:
            cosine = np.round(np.einsum("ij,ij->i", l.vectors[p], r.vectors[q]), 6) + 0.0 if l.vectors.shape[1] == r.vectors.shape[1] else np.zeros(len(p))
        apart = np.bitwise_count(l.bits[p] ^ r.bits[q]).astype(np.int32)
        same = (l.digest[p] == r.digest[q]) & (l.digest[p] >= 0)
        a, b = l.ids[p], r.ids[q]
        if arm == 1:
            a, b = np.minimum(a, b), np.maximum(a, b)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(p), arm, np.int32)), pa.array(cosine, mask=~(l.whole[p] & r.whole[q])), pa.array(apart, mask=~(l.printed[p] & r.printed[q])), pa.array(same)], names)

    def meet(left: pa.Table, right: pa.Table | None):
        l = _Block(left)
        r = l if right is None else _Block(right)
        _number(l, r)
        mine, theirs = np.flatnonzero(l.printed), np.flatnonzero(r.printed)
        for p, q, _ in _near(l.bits[mine], r.bits[theirs], radius):
            p, q = mine[p], theirs[q]
            if right is None:
                p, q = p[l.ids[p] < r.ids[q]], q[l.ids[p] < r.ids[q]]
            yield told(l, r, 1, p, q, None)
        mine, theirs = np.flatnonzero(l.whole), np.flatnonzero(r.whole)
        if len(mine) and len(theirs):
            both = _best_of_both(l.vectors[mine], None if right is None else r.vectors[theirs], (l.floor[mine], r.floor[theirs]), k)
            for (own, other, x, y), found in zip(((l, r, mine, theirs), (r, l, theirs, mine)), both, strict=True):
                if found is not None:
                    p, q, score = found
                    for at in range(0, len(p), PAIRS_AT_ONCE):
                        part = slice(at, at + PAIRS_AT_ONCE)
                        yield told(own, other, 2, x[p[part]], y[q[part]], score[part])

    rows = cut(with_floors(records.select("idx", fingerprint_bits(F.col("phash")).alias("bits"), "embedding", "sha256"), k, least))
    met = _meetings(rows, block_rows, ["idx", "bits", "embedding", "sha256", "floor"], meet, "a long, b long, arm int, cosine double, phash_distance int, same_sha256 boolean")
    order = Window.partitionBy("arm", "a").orderBy(F.col("cosine").desc(), "b")
    return met.withColumn("rank", F.row_number().over(order)).where(f"arm = 1 OR rank <= {k} AND a < b").select(*names)


def top_k(records: DataFrame, k: int, least: float | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, cosine, rank): the k best partners of each record, itself among them, by exact inner product.

    Scores are rounded to six digits; equal ones rank by idx. Blocks meet blocks, each meeting keeps its own k best per
    record, and a window merges them. With `least`, scores below it are dropped early, which changes no rank above it.
    """
    rows = records.where("embedding IS NOT NULL").select("idx", "embedding")
    order = Window.partitionBy("a").orderBy(F.col("cosine").desc(), "b")
    if least is not None:
        return _above(rows, k, least, block_rows).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    blocks = max(1, -(-rows.count() // block_rows))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("idx"), F.lit(blocks)).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = dealt.select("idx", "embedding", F.col("block").alias("x"), others.alias("y"))
    right = dealt.select("idx", "embedding", others.alias("x"), F.col("block").alias("y"))

    def meet(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(l) or not len(r):
            return pd.DataFrame({"a": [], "b": [], "cosine": []})
        base, ids = np.stack(r["embedding"].to_list()).astype(np.float64), r["idx"].to_numpy()
        by_id = np.argsort(ids, kind="stable")  # equal scores then go by idx
        base, ids, out = base[by_id], ids[by_id], []
        for at in range(0, len(l), 512):
            part = l.iloc[at : at + 512]
            scores = np.round(np.stack(part["embedding"].to_list()).astype(np.float64) @ base.T, 6) + 0.0
            own = part["idx"].to_numpy()
            c = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            r, c = np.repeat(np.arange(len(own)), c.shape[1]), c.ravel()
            out.append(pd.DataFrame({"a": own[r], "b": ids[c], "cosine": scores[r, c]}))
        return pd.concat(out)

    met = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInPandas(meet, "a long, b long, cosine double")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def one_sided(ranked: DataFrame, review: float) -> DataFrame:
    """(a, b, cosine): pairs found from the lower side only, at or above the review threshold."""
    return ranked.where((F.col("a") < F.col("b")) & (F.col("cosine") >= review)).select("a", "b", "cosine")


def against_reference(records: DataFrame, reference: DataFrame) -> DataFrame:
    """Every record beside the one reference row, with all evidence; the reference itself (same path) is left out."""
    r = F.broadcast(reference.select(F.col("idx").alias("a"), F.col("sha256").alias("ref_sha"), F.col("phash").alias("ref_phash"), F.col("embedding").alias("ref_vec"), F.col("path").alias("ref_path")).limit(1))
    from kindred.functions.features import fingerprint_distance

    both = records.crossJoin(r).where("path <> ref_path")
    return both.select("a", F.col("idx").alias("b"), F.round(no_nan(dot(F.col("embedding"), F.col("ref_vec"))), 6).alias("cosine"), fingerprint_distance(F.col("phash"), F.col("ref_phash")).alias("phash_distance"), (F.coalesce(F.col("sha256") == F.col("ref_sha"), F.lit(False)) & (F.col("sha256") != "")).alias("same_sha256"))

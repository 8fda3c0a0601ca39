"""Exact Jaccard similarity join of word-shingle sets, as connected components.

The Jaccard distance d = 1 - J is a metric. Pivots that are documents drawn from the corpus would give Voronoi regions
that prune nothing: almost every document lies at distance 1 from every pivot, so almost every document would be
replicated to almost every region. The top level therefore takes its regions from projections of the metric space.
The bits of the shingle hashes form a tree, and a set is cut along it until no part has more than s members, s being
the largest number for which s of s + 1 falls below the threshold. If two sets reach the threshold t, then at every
node of a path from the root their parts reach t too (of two fractions, one is no less than the fraction of their
sums), and at the end of the path, where one part has at most s members, reaching t means being equal. So any two
linked sets share a part, exactly, without a cap; sets that share one form a region.

The least set of each part is a pivot; the sets that share one of a pivot's parts are its region, each once. Every
member's distance to the pivot is found exactly. Sets within the radius r = 1 - t form the pivot's ball and belong to its
component; two members are compared only where the triangle inequality leaves them open (their distances to the pivot
differ by r at most), their sizes allow it, and they are not known to be connected. Regions whose members all are
connected are done: a group of copies, however large, costs one distance per member.

Regions that are still open and larger than a task takes are joined block by block if they are few blocks, each pair of
blocks in a task of its own. Larger ones are joined again, recursively. First their documents are dealt anew by their locally
rarest shingles (a prefix that any two linked sets must share), which takes apart regions held together by a passage that
many documents quote. What is still large becomes Voronoi regions of new pivots: counts of hashed shingles, by the sum of
their differences, are a metric space in which linked sets x and y lie within n_x (1 - t) / t of each other; each set is
dealt to its nearest pivot, and as a boundary document to every other one that is at most twice that farther, so that any
two linked sets meet in the nearest region of either. What the pivots can't take apart either is joined block by block.

Bounds by counts of hashed shingles (a lower bound of the symmetric difference) spare most exact distances.

Defined results: a null or empty text, or one of white space, has no shingle and is linked with nothing; a text with
fewer words than a shingle is one shingle; rows with equal sets are one component whatever their number; a row with a
null doc_id has its count of shingles and no component; repeated doc_ids give a row each; an empty table gives an
empty result; other columns are ignored. Sets are told apart by 64-bit hashes, of shingles and of whole sets.
"""

from __future__ import annotations

from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import map_batches, raw_texts, slim
from kindred.llm.shingles import leaves, mix, shingle_sets
from kindred.operators.components import connected_components
from kindred.plans.session import cut, settle

#: Members of an open region up to which one task bounds its open pairs, on sizes and counters (about 300 bytes a member).
SMALL_REGION = 2048
#: Regions of up to so many small regions are joined block by block at once: each member is copied so often at most.
FEW_BLOCKS = 16
#: Pivots of a large region's Voronoi regions.
PIVOTS = 16
#: Counters of the bound on the symmetric difference, one byte each; sums of FOLD of them give a coarser, faster bound.
COUNTERS = 256
FOLD = 4
#: Open pairs that a task holds before it hands them on.
HELD_PAIRS = 1 << 20
#: Texts handled at a time in a worker.
SLICE = 256
#: Ids up to this many (8 bytes each) are broadcast to fetch their texts; more are joined.
BROADCAST_IDS = 1_000_000
#: Parts are dealt by so many bits of their signatures; parts that a task holds before it hands them on.
BUCKET_BITS, HELD_PARTS = 10, 1 << 21
#: Rows of a written table that one task reads back.
SETS_PER_TASK = 20_000


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _set_keys(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    key = np.zeros(n, np.uint64)
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    if len(starts):
        key[owner[starts]] = mix(np.add.reduceat(mix(hashes), starts))
    return key


class JaccardJoin:
    """One join; keeps what its steps share."""

    def __init__(self, docs: DataFrame, words: int, threshold: Fraction, small_region: int = SMALL_REGION, few_blocks: int = FEW_BLOCKS):
        self.docs, self.words, self.t, self.small_region, self.few_blocks = docs, words, threshold, small_region, few_blocks
        # s / (s + 1) < t, and a part of s + 1 members is never matched by one of s
        self.most = max(1, ceil(threshold / (1 - threshold)) - 1) if threshold < 1 else 1 << 30

    # -- what a text gives ------------------------------------------------------------------------------------------

    def scan(self) -> DataFrame:
        """(doc_id, key, n) of every row."""
        words = self.words

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw, keys, sizes = raw_texts(batch.column(1)), [], []
            for a in range(0, len(raw), SLICE):
                part = raw[a : a + SLICE]
                owner, hashes = shingle_sets(part, words)
                keys.append(_set_keys(owner, hashes, len(part)))
                sizes.append(np.bincount(owner, minlength=len(part)))
            return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), _signed(np.concatenate(keys)), pa.array(np.concatenate(sizes))], ["doc_id", "key", "n"])

        return map_batches(self.docs, "doc_id long, key long, n long", work)

    def dealt_parts(self) -> DataFrame:
        """(bucket, parts): the parts of every set, once per task and set, in packs by the top bits of their signatures.

        A part is a word, its further bits with its size in the last four, and the tag of its set: eight bytes.
        """
        words, most = self.words, self.most

        def packs(sigs: np.ndarray, sizes: np.ndarray, tags: np.ndarray) -> pa.RecordBatch:
            order = np.argsort(sigs)
            sigs, tags = sigs[order], tags[order]
            bucket = (sigs >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
            low = (sigs >> np.uint64(32 - BUCKET_BITS)).astype(np.uint32) & np.uint32(~15 & 0xFFFFFFFF) | np.minimum(sizes[order], 15).astype(np.uint32)
            starts = np.flatnonzero(np.diff(bucket, prepend=-1))
            held = [low[a:b].tobytes() + tags[a:b].tobytes() for a, b in zip(starts, [*starts[1:], len(sigs)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int32()), pa.array(held, pa.binary())], ["bucket", "parts"])

        def work(batches):
            seen: set[int] = set()
            held, many = [], 0
            for batch in batches:
                raw, known = raw_texts(batch.column(1)), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
                for a in range(0, len(raw), SLICE):
                    part = raw[a : a + SLICE]
                    owner, hashes = shingle_sets(part, words)
                    keys, new = _set_keys(owner, hashes, len(part)), np.zeros(len(part), bool)
                    for i in np.unique(owner[known[a : a + SLICE][owner]]).tolist():
                        k = int(keys[i])
                        if k not in seen:
                            new[i] = True
                            seen.add(k)
                    if len(seen) > 1_000_000:
                        seen.clear()
                    pick = new[owner]
                    of, sigs, sizes = leaves(owner[pick], hashes[pick], most)
                    held.append((sigs, sizes, keys.astype(np.uint32)[of]))
                    many += len(sigs)
                    if many > HELD_PARTS:
                        yield packs(*map(np.concatenate, zip(*held, strict=True)))
                        held, many = [], 0
            if many:
                yield packs(*map(np.concatenate, zip(*held, strict=True)))

        return self.docs.mapInArrow(work, "bucket int, parts binary")

    def shared_parts(self) -> DataFrame:
        """(sig, tag, size) of the parts that sets of several tags hold."""

        def several(bucket: int, packs: list[bytes]) -> pa.RecordBatch:
            halves = [np.frombuffer(p, np.uint32).reshape(2, -1).astype(np.uint64) for p in packs]
            parts = np.unique(np.concatenate([low << np.uint64(32) | tags for low, tags in halves]))
            low = parts >> np.uint64(32)
            same = np.zeros(len(low) + 1, bool)
            same[1:-1] = low[1:] == low[:-1]
            held = same[:-1] | same[1:]
            low, tags = low[held].astype(np.int64), (parts[held] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(bucket << 32 | low), pa.array(tags), pa.array(low & 15)], ["sig", "tag", "size"])

        def stream(batches):
            at, held = None, []
            for batch in batches:
                for bucket, pack in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if bucket != at and held:
                        yield several(at, held)
                        held = []
                    at = bucket
                    held.append(pack)
            if held:
                yield several(at, held)

        return self.dealt_parts().repartition("bucket").sortWithinPartitions("bucket").mapInArrow(stream, "sig long, tag long, size long")

    def parts(self, nodes: DataFrame) -> DataFrame:
        """(sig, key) of the shared parts of the sets that may be linked.

        The parts that linked sets x and y share hold (t (s + 1) - s) |x or y| shingles at least: where their parts differ,
        at most s of s + 1 shingles are common. Sets whose shared parts hold fewer are linked with nothing. Tags stand for
        keys up to here; sets of equal tags, of which no part tells them apart, are a region of their own.
        """
        num, den, s = self.t.numerator, self.t.denominator, self.most
        found = settle(self.shared_parts(), SETS_PER_TASK * 10)
        tagged = nodes.select("key", "n", F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("tag"))
        able = tagged.join(found.groupBy("tag").agg(F.sum("size").alias("held")), "tag")
        # sizes from 15 on aren't told
        able = able.where(f"held * {den} >= n * {num * (s + 1) - s * den}") if s < 15 else able
        parts = found.join(self.small(able.select("tag", "key")), "tag").select("sig", "key")
        twins = tagged.groupBy("tag").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("tag")
        return settle(parts.union(tagged.join(self.small(twins), "tag").select(F.xxhash64("tag"), "key")))

    def read_sets(self, keys: DataFrame, nodes: DataFrame) -> DataFrame:
        """(key, members, sketch): the sorted shingle hashes, and counts of them by class, of the sets with these keys, from the
        texts of their first rows; written once."""
        words = self.words
        ids = settle(keys.join(nodes, "key").select(F.col("first_doc").alias("doc_id")).distinct())
        rows = self.docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id").select("doc_id", "text")

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw, out_keys, out_sets, sketches = raw_texts(batch.column(1)), [], [], []
            for a in range(0, len(raw), SLICE):
                part = raw[a : a + SLICE]
                owner, hashes = shingle_sets(part, words)
                out_keys.append(_set_keys(owner, hashes, len(part)))
                ends = np.cumsum(np.bincount(owner, minlength=len(part)))
                out_sets += [hashes[s:e].tobytes() for s, e in zip([0, *ends[:-1]], ends, strict=True)]
                cells = np.bincount(owner * COUNTERS + (mix(hashes) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=len(part) * COUNTERS)
                sketches += [c.tobytes() for c in np.minimum(cells, 255).astype(np.uint8).reshape(len(part), COUNTERS)]
            return pa.RecordBatch.from_arrays([_signed(np.concatenate(out_keys)), pa.array(out_sets, pa.binary()), pa.array(sketches, pa.binary())], ["key", "members", "sketch"])

        # a doc_id may be repeated with other texts, and a text with other rows of the same id
        found = settle(map_batches(rows, "key long, members binary, sketch binary", work).join(self.small(keys), "key", "left_semi"), SETS_PER_TASK)
        return found if found.count() == found.select("key").distinct().count() else settle(found.dropDuplicates(["key"]), SETS_PER_TASK)

    @staticmethod
    def small(keys: DataFrame) -> DataFrame:
        """Keys, written; to be broadcast where they are few, so that what they are joined with isn't shuffled."""
        keys = settle(keys)
        return F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys

    def sets(self, keys: DataFrame) -> DataFrame:
        return self.members.join(self.small(keys), "key", "left_semi")

    # -- exact distances ----------------------------------------------------------------------------------------------

    def bounded(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """The pairs (a, b) of keys whose sizes and counters leave a link open."""
        num, den = self.t.numerator, self.t.denominator
        sized = pairs.join(nodes.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a").join(
            nodes.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b"
        )
        sized = sized.where(f"least(na, nb) * {den} >= greatest(na, nb) * {num}")

        def bound(batch: pa.RecordBatch) -> pa.RecordBatch:
            sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, COUNTERS).astype(np.int64) for c in ("sa", "sb"))
            n = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            # J >= t means that the sets differ in at most (1 - t) / (1 + t) of their added sizes
            open_ = np.abs(sa - sb).sum(1) * (den + num) <= n * (den - num)
            return pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(open_)) for c in ("a", "b")], ["a", "b"])

        return map_batches(sized.select("a", "b", "na", "nb", "sa", "sb"), "a long, b long", bound)

    def verify(self, pairs: DataFrame) -> DataFrame:
        """(a, b, both, either, linked) of the pairs (a, b) of keys, from their sets."""
        num, den = self.t.numerator, self.t.denominator
        left = settle(pairs)
        keys = left.select(F.col("a").alias("key")).union(left.select("b")).distinct()
        sets = self.sets(keys)
        both = left.join(sets.select(F.col("key").alias("a"), F.col("members").alias("ma")), "a").join(sets.select(F.col("key").alias("b"), F.col("members").alias("mb")), "b")

        def exact(batch: pa.RecordBatch) -> pa.RecordBatch:
            shared, either = [], []
            for x, y in zip(batch.column("ma").to_pylist(), batch.column("mb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                s = len(np.intersect1d(x, y, assume_unique=True))
                shared.append(s)
                either.append(len(x) + len(y) - s)
            s, e = np.array(shared, np.int64), np.array(either, np.int64)
            return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(s), pa.array(e), pa.array(s * den >= e * num)], ["a", "b", "both", "either", "linked"])

        return settle(map_batches(both.select("a", "b", "ma", "mb"), "a long, b long, both long, either long, linked boolean", exact))

    # -- regions ------------------------------------------------------------------------------------------------------

    def by_pivot(self, parts: DataFrame) -> DataFrame:
        """(region, pivot, key) from (sig, key): each part's least set is its pivot, and a pivot's parts are one region."""
        pivots = parts.groupBy("sig").agg(F.min("key").alias("pivot"))
        return settle(parts.join(pivots, "sig").select(F.col("pivot").alias("region"), "pivot", "key").distinct())

    def star(self, regions: DataFrame, nodes: DataFrame) -> DataFrame:
        """Exact distances from the pivots to the members of their regions."""
        pairs = regions.where("key <> pivot").select(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b")).distinct()
        return self.verify(self.bounded(pairs, nodes))

    def open_regions(self, regions: DataFrame, links: DataFrame) -> DataFrame:
        """(region, pivot, key, comp, size) of the regions of three or more whose members aren't all connected yet."""
        comps = connected_components(links)
        named = regions.join(comps.select(F.col("idx").alias("key"), F.col("group_id").alias("comp")), "key", "left").select("region", "pivot", "key", F.coalesce("comp", "key").alias("comp"))
        named = settle(named)
        state = named.groupBy("region").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi AND size > 2")
        return settle(named.join(state.select("region", "size"), "region"))

    def voronoi(self, large: DataFrame, nodes: DataFrame, seed: int) -> DataFrame:
        """(region, pivot, key): large regions dealt to nearest pivots, boundary documents to all that the triangle inequality leaves open."""
        num, den = self.t.numerator, self.t.denominator
        order = F.xxhash64("key", F.lit(seed))
        drawn = large.groupBy("region", F.pmod(order, F.lit(PIVOTS)).alias("c")).agg(F.min_by("key", order).alias("key")).join(nodes.select("key", "sketch"), "key")
        pivots = drawn.groupBy("region").agg(F.sort_array(F.collect_list(F.struct("key", "sketch"))).alias("pivots"))  # PIVOTS at most
        rows = large.select("region", "key").join(nodes.select("key", "n", "sketch"), "key").join(pivots, "region")

        def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for region, key, n, sketch, drawn in zip(*[batch.column(c).to_pylist() for c in ("region", "key", "n", "sketch", "pivots")], strict=True):
                own = np.frombuffer(sketch, np.uint8).astype(np.int64)
                apart = np.abs(np.frombuffer(b"".join(p["sketch"] for p in drawn), np.uint8).reshape(-1, COUNTERS) - own).sum(1)
                out += [(region, drawn[k]["key"], key) for k in np.flatnonzero((apart - apart.min()) * num <= 2 * n * (den - num))]
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(3)], ["region", "pivot", "key"])

        dealt = map_batches(rows.select("region", "key", "n", "sketch", "pivots"), "region long, pivot long, key long", deal)
        return settle(dealt.select(F.xxhash64("region", "pivot").alias("region"), "pivot", "key"))

    def blocks(self, large: DataFrame) -> DataFrame:
        """Large regions as regions of two blocks each, `side` telling them apart; a block by itself has side 0 alone."""
        many = F.ceil(F.col("size") / self.small_region).cast("long")
        cut_up = large.withColumn("many", many).withColumn("block", F.pmod(F.xxhash64("key", "region"), many))
        pairs = cut_up.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)))
        lo, hi = F.least("block", "other"), F.greatest("block", "other")
        return pairs.select(F.xxhash64("region", lo, hi).alias("region"), "pivot", "key", "comp", "size", F.when(lo == hi, -1).otherwise((F.col("block") == hi).cast("int")).alias("side"))

    def within(self, opened: DataFrame, measured: DataFrame, nodes: DataFrame, nearest: bool) -> DataFrame:
        """Distances within open regions, of the pairs that component, size, triangle inequality and counters leave open.

        With `nearest`, only of each member's pair of least bound: those links connect most of what is connected at
        all, and leave fewer pairs open for the call that takes them all.
        """
        r, num, den = float(1 - self.t) + 1e-9, self.t.numerator, self.t.denominator
        far = measured.select("a", "b", (1 - F.col("both") / F.col("either")).alias("d"))
        far = far.union(far.select("b", "a", "d")).select(F.col("a").alias("key"), F.col("b").alias("pivot"), "d")
        rows = opened.where("key <> pivot").join(far, ["key", "pivot"], "left").join(nodes.select("key", "n", "sketch"), "key")
        rows = rows.select("region", "key", "comp", "n", "sketch", "d", F.col("side").cast("int").alias("side") if "side" in opened.columns else F.lit(-1).alias("side"))

        def region(part: pa.Table) -> list[np.ndarray]:
            key, comp, n, side = (part.column(c).to_numpy() for c in ("key", "comp", "n", "side"))
            d = part.column("d").to_numpy()  # null is nan, which rules nothing out
            sketch = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint8).reshape(-1, COUNTERS).astype(np.int16)
            coarse = sketch.reshape(len(key), -1, FOLD).sum(2, dtype=np.int16)
            upto = np.searchsorted(n, n * den // num, side="right")  # sorted by n: partners lie between here and there
            out = []
            for i in range(len(key) - 1):
                j = np.arange(i + 1, upto[i])
                j = j[(comp[j] != comp[i]) & ~(np.abs(d[j] - d[i]) > r) & ((side[j] != side[i]) | (side[i] < 0))]
                for counters in (coarse, sketch):
                    if len(j):
                        apart = np.abs(counters[j] - counters[i]).sum(1, dtype=np.int64)
                        near = apart * (den + num) <= (n[j] + n[i]) * (den - num)
                        j, apart = j[near], apart[near]
                if len(j):
                    j = j[[np.argmin(apart / (n[j] + n[i]))]] if nearest else j
                    out.append(np.stack([np.minimum(key[j], key[i]), np.maximum(key[j], key[i])]))
            return out

        def stream(batches):
            """Regions come one after another; the one that a batch ends in waits for the next batch."""
            rest, held, many = None, [], 0
            for batch in batches:
                table = pa.Table.from_batches([batch])
                table = table if rest is None else pa.concat_tables([rest, table])
                names = table.column("region").to_numpy()
                starts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else []
                for a, b in zip(starts[:-1], starts[1:], strict=True):
                    found = region(table.slice(a, b - a))
                    held, many = held + found, many + sum(x.shape[1] for x in found)
                    if many > HELD_PAIRS:
                        held = [np.unique(np.concatenate(held, axis=1), axis=1)]
                        if held[0].shape[1] > HELD_PAIRS // 2:
                            yield emit(held)
                            held = []
                        many = sum(x.shape[1] for x in held)
                rest = table.slice(starts[-1]) if len(starts) else None
            held += region(rest) if rest is not None else []
            if held:
                yield emit(held)

        def emit(found: list[np.ndarray]) -> pa.RecordBatch:
            a, b = np.unique(np.concatenate(found, axis=1), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        return self.verify(rows.repartition("region").sortWithinPartitions("region", "n", "key").mapInArrow(stream, "a long, b long").distinct())

    def prefixes(self, keys: DataFrame) -> DataFrame:
        """Parts (sig, key) by the rarest shingles of each set, rarity being counted among these sets."""
        num, den = self.t.numerator, self.t.denominator

        def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
            members = [np.frombuffer(m, np.int64) for m in batch.column("members").to_pylist()]
            owner = np.repeat(batch.column("key").to_numpy(), [len(m) for m in members])
            return pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.concatenate(members))], ["key", "sig"])

        rows = map_batches(self.sets(keys), "key long, sig long", spread)
        common = cut(rows.groupBy("sig").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
        ranked = rows.join(common, "sig", "left").withColumn("df", F.coalesce("df", F.lit(1)))
        rank = F.row_number().over(Window.partitionBy("key").orderBy("df", "sig"))
        size = F.count(F.lit(1)).over(Window.partitionBy("key"))
        # two linked sets share one of the first n - ceil(t n) + 1 in any common order
        kept = ranked.select("sig", "key", "df", rank.alias("rank"), size.alias("n")).where(f"rank <= n - ceil(n * {num} / {den}) + 1 AND df > 1")
        return cut(kept.select("sig", "key"))

    def components(self) -> DataFrame:
        """doc_id, n_shingles, component_id of each row."""
        docs = cut(self.scan())
        nodes = settle(docs.where("n > 0 AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.min("n").alias("n")))
        parts = self.parts(nodes)
        self.members = self.read_sets(parts.select("key").distinct(), nodes)
        sketched = settle(self.members.select("key", F.expr("octet_length(members) div 8").alias("n"), "sketch"))
        regions = self.by_pivot(parts)
        measured = self.star(regions, sketched)
        links = measured.where("linked").select("a", "b")
        level = 0
        while True:
            for nearest in (True, False):
                opened = self.open_regions(regions, links)
                found = self.within(opened.where(F.col("size") <= self.small_region), measured, sketched, nearest)
                links = settle(links.union(found.where("linked").select("a", "b")).distinct())
            large = opened.where(F.col("size") > self.small_region)
            # block by block: what is few blocks, and at last all that nothing took apart
            blockwise = large if level == 2 else large.where(F.col("size") <= self.few_blocks * self.small_region)
            if not blockwise.isEmpty():
                for nearest in (True, False):
                    left = self.open_regions(blockwise.select("region", "pivot", "key"), links)
                    found = self.within(self.blocks(left), measured, sketched, nearest)
                    links = settle(links.union(found.where("linked").select("a", "b")).distinct())
            large = large.where(F.col("size") > self.few_blocks * self.small_region)
            if level == 2 or large.isEmpty():
                break
            regions = self.by_pivot(self.prefixes(large.select("key").distinct())) if level == 0 else self.voronoi(large, sketched, level)
            measured = self.star(regions, sketched)
            links = settle(links.union(measured.where("linked").select("a", "b")).distinct())
            level += 1
        comps = connected_components(links)
        named = nodes.join(comps.withColumnRenamed("idx", "key"), "key", "left").select("key", "first_doc", F.coalesce("group_id", "key").alias("group_id"))
        least = named.groupBy("group_id").agg(F.min("first_doc").alias("component_id"))
        labels = settle(named.join(least, "group_id").select("key", "component_id"))
        own = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
        return docs.join(labels, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))


def jaccard_components(docs: DataFrame, words: int = 5, threshold: float | str = 0.8, id_col: str = "doc_id", text_col: str = "text", small_region: int = SMALL_REGION, few_blocks: int = FEW_BLOCKS) -> DataFrame:
    """doc_id, n_shingles, component_id: documents linked by Jaccard similarity of `threshold` or more, transitively."""
    t = Fraction(str(threshold))
    if not 0 < t <= 1:
        raise ValueError("the threshold must be over 0 and at most 1")
    return JaccardJoin(slim(docs, id_col, text_col), words, t, small_region, few_blocks).components()

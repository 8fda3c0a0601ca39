"""Packing by best-fit decreasing.

A document's ids are cut into full windows and one remainder. Pieces are dealt to groups of bounded size; within a
group the longest piece comes first and goes to the tightest window that can still hold it, found by a segment tree
over remaining capacity; where none can, a new window opens. With thousands of pieces in a group the padding is as
small as over all pieces together, while no task ever holds more than its group.

Ids come from a compiled byte-pair encoder with the given vocabulary. Texts that its pattern engine gives up on (runs of
white space longer than its stack) and vocabularies whose ids don't follow the order of merges go to this package's own
exact encoder, which gives the same ids.

Defined results: a null or empty text is the end id alone; pieces of equal length are placed in order of (doc_id,
start), null ids last; null and repeated doc_ids are packed like others, and repeated rows are dealt to different groups;
one very long document is cut into pieces that go to many groups; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.bpe import PATTERN, Encoder, encoder, forget
from kindred.llm.common import claim, map_batches, slim, texts
from kindred.plans.session import cut

#: Pieces of a group on average; groups are dealt by hash, so none is much larger.
GROUP_PIECES = 1 << 13


class Windows:
    """Open windows by remaining capacity, in a segment tree whose inner nodes know whether a window lies below them."""

    def __init__(self, capacity: int):
        self.base = 1 << (capacity + 1 - 1).bit_length()
        self.capacity, self.tree = capacity, bytearray(2 * self.base)
        self.stacks: dict[int, list[int]] = {}
        self.opened = 0

    def _mark(self, remaining: int, there: int) -> None:
        at = self.base + remaining
        self.tree[at] = there
        while at > 1:
            at >>= 1
            now = self.tree[2 * at] | self.tree[2 * at + 1]
            if self.tree[at] == now:
                return
            self.tree[at] = now

    def tightest(self, need: int) -> int | None:
        """The smallest remaining capacity that is at least `need`."""
        at = self.base + need
        if self.tree[at]:
            return need
        while at > 1:
            if not at & 1 and self.tree[at + 1]:
                at += 1
                while at < self.base:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.base
            at >>= 1
        return None

    def place(self, length: int) -> tuple[int, int]:
        """Window and offset for a piece."""
        remaining = self.tightest(length)
        if remaining is None:
            window, remaining = self.opened, self.capacity
            self.opened += 1
        else:
            stack = self.stacks[remaining]
            window = stack.pop()
            if not stack:
                self._mark(remaining, 0)
        left = remaining - length
        if left:
            stack = self.stacks.setdefault(left, [])
            stack.append(window)
            if len(stack) == 1:
                self._mark(left, 1)
        return window, self.capacity - remaining


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece, in the order given; lengths must already fall."""
    windows = Windows(capacity)
    placed = [windows.place(n) for n in lengths.tolist()]
    return np.array([p[0] for p in placed], np.int64), np.array([p[1] for p in placed], np.int64)


class TextIds:
    """Ids of texts with one vocabulary file; made once per worker."""

    def __init__(self, path: str):
        self.path, own = path, Encoder(path)
        specials = set(own.special.values())
        ranks = {raw: i for i, raw in enumerate(own.token_bytes) if raw and i not in specials}
        # the compiled encoder takes a token's id for its rank
        ordered = bool(np.all(np.diff(own.made) > 0)) and len(ranks) == len(own.vocab)
        self.compiled = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=own.special) if ordered else None

    def ids(self, text: str) -> np.ndarray:
        if self.compiled:
            try:
                return self.compiled.encode_to_numpy(text, allowed_special="all")
            except ValueError:
                pass  # the pattern engine's stack is too small for a run of white space in this text
        return np.frombuffer(encoder(self.path, speculate=False, holder="packing").encode_batch([text])[0], "<u4")


@lru_cache(maxsize=2)
def _text_ids(path: str) -> TextIds:
    return TextIds(path)


def _clear() -> None:
    _text_ids.cache_clear()
    forget()


def text_ids(path: str) -> TextIds:
    """This worker's; workers are reused, so the vocabulary is read once."""
    claim("packing", _clear)
    return _text_ids(path)


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids, if asked for) of each piece of each document."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(6)]
        own = text_ids(vocabulary)
        for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
            ids = np.append(own.ids(text), np.uint32(end_id)).astype("<u4")
            for start in range(0, len(ids), capacity):
                piece = ids[start : start + capacity]
                for c, v in zip(cols, (doc, start, len(piece), zlib.crc32(piece), len(ids), piece.astype(np.int32) if with_ids else None), strict=True):
                    c.append(v)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
        arrays = [pa.array(c, pa.int64()) for c in cols[:5]] + ([pa.array(cols[5], pa.list_(pa.int32()))] if with_ids else [])
        return pa.RecordBatch.from_arrays(arrays, names[: len(arrays)])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return map_batches(slim(docs, id_col, text_col), schema, work)


def pack_pieces(pieces: DataFrame, capacity: int = 2048, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """`pieces` with sequence_id and offset. The pieces are written once, so that counting them costs no second encoding."""
    pieces = cut(pieces)
    groups = max(1, -(-pieces.count() // group_pieces))
    # the place in the written table is part of the hash, so that equal rows are dealt apart
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))

    def pack(table: pa.Table) -> pa.Table:
        order = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]
        table = table.sort_by(order)
        window, offset = best_fit_decreasing(table["length"].to_numpy(), capacity)
        group = table["_group"].to_numpy()
        return table.drop_columns("_group").append_column("sequence_id", pa.array((group << 32) + window)).append_column("offset", pa.array(offset))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return dealt.groupBy("_group").applyInArrow(pack, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", group_pieces: int = GROUP_PIECES, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece (and ids, if asked for)."""
    return pack_pieces(token_pieces(docs, vocabulary, capacity, end_id, id_col, text_col, with_ids), capacity, group_pieces)

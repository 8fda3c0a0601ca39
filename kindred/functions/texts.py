"""Fingerprints and vectors of texts, made in Arrow batches: a word is looked up and hashed once per batch, and no row is shuffled."""

from __future__ import annotations

import math
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from kindred.functions.features import DIM

#: Texts and words handled at a time (64 votes of a byte each), words hashed at a time, and most letters of a digest's only block.
ROWS_AT_ONCE, WORDS_AT_ONCE, HASHED_AT_ONCE, ONE_BLOCK = 2500, 100_000, 8192, 55


_SHIFTS = np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], np.uint32)
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]


def _md5_starts(block: np.ndarray) -> np.ndarray:
    """The first eight bytes of the digests, as numbers, of padded messages of one block: 16 rows of words, a message to a column."""
    first = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(block.shape[1], x) for x in first)
    for i in range(64):
        turn = i // 16
        if turn == 0:
            mixed, word = d ^ (b & (c ^ d)), i
        elif turn == 1:
            mixed, word = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif turn == 2:
            mixed, word = b ^ c ^ d, (3 * i + 5) % 16
        else:
            mixed, word = c ^ (b | ~d), 7 * i % 16
        mixed += a
        mixed += _SINES[i]
        mixed += block[word]
        by = _SHIFTS[turn, i % 4]
        a, d, c, b = d, c, b, b + ((mixed << by) | (mixed >> (np.uint32(32) - by)))
    start = np.stack([a + first[0], b + first[1]], axis=1).astype("<u4")
    return start.view(">u8").ravel().astype(np.uint64)


def word_hashes(words: pa.Array) -> np.ndarray:
    """The first eight bytes of each word's MD5 digest, as a number. Short words, almost all, are hashed side by side."""
    words = words.cast(pa.large_binary())
    edges = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    letters = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    size, out = np.diff(edges), np.zeros(len(words), np.uint64)
    for k in np.flatnonzero(size > ONE_BLOCK):
        out[k] = int.from_bytes(md5(letters[edges[k] : edges[k + 1]].tobytes()).digest()[:8], "big")
    short = np.flatnonzero(size <= ONE_BLOCK)
    for at in range(0, len(short), HASHED_AT_ONCE):
        some = short[at : at + HASHED_AT_ONCE]
        n = size[some]
        row, inside = np.repeat(np.arange(len(some)), n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        block = np.zeros((len(some), 64), np.uint8)
        block[row, inside] = letters[np.repeat(edges[some], n) + inside]
        block[np.arange(len(some)), n] = 0x80
        block.view("<u8")[:, 7] = 8 * n
        out[some] = _md5_starts(np.ascontiguousarray(block.view("<u4").T))
    return out


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner and number of every word, and the hash of each number; only different words leave Arrow."""
    lists = pc.ascii_split_whitespace(texts)
    owner, flat = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists)
    some = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(some).dictionary_encode()
    return owner[some.to_numpy(zero_copy_only=False)].astype(np.int64), coded.indices.to_numpy().astype(np.int64), word_hashes(coded.dictionary)


def simhashes(owner: np.ndarray, word: np.ndarray, hashes: np.ndarray, n: int) -> list[str]:
    """64-bit SimHash of each owner's distinct words, as 16 hex digits; zeros without words."""
    many = max(1, len(hashes))
    each = np.sort(owner * many + word)
    fresh = np.ones(len(each), bool)
    fresh[1:] = each[1:] != each[:-1]
    owner, word = np.divmod(each[fresh], many)
    votes, terms = np.zeros((n, 64), np.int64), np.bincount(owner, minlength=n)
    for at in range(0, len(owner), WORDS_AT_ONCE):
        mine = owner[at : at + WORDS_AT_ONCE]
        bits = np.unpackbits(hashes[word[at : at + WORDS_AT_ONCE]].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        # runs of one owner and of at most 255 words, so that eight counts of a byte add up as one number
        new = np.diff(mine, prepend=-1) != 0
        first = np.flatnonzero(new)
        inside = np.arange(len(mine)) - np.repeat(first, np.diff(first, append=len(mine)))
        starts = np.flatnonzero(inside % 255 == 0)
        counts = np.add.reduceat(bits.view(np.uint64), starts, axis=0).view(np.uint8)
        owners = np.flatnonzero(np.diff(mine[starts], prepend=-1))
        votes[mine[first]] += np.add.reduceat(counts, owners, axis=0, dtype=np.int64)
    return [b.tobytes().hex() for b in np.packbits(votes * 2 > terms[:, None], axis=1)]


def bucket_vectors(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Word counts in buckets by the first byte of the hash, less their mean, of unit length."""
    bucket = (hashes >> np.uint64(56)).astype(np.int64) % DIM
    counts = np.bincount(owner * DIM + bucket, minlength=n * DIM).reshape(n, DIM).astype(np.float64)
    centred = counts - counts.sum(1, keepdims=True) / DIM
    return centred / np.maximum(np.sqrt((centred * centred).sum(1, keepdims=True)), 1e-12)


def with_features(rows: DataFrame, prints: bool = True, vectors: bool = True) -> DataFrame:
    """`rows` without `text`, with phash (NULL for a NULL text) and embedding (NULL for a text without words) as asked for.

    Words are parts of the lower-cased text between white space, [\\x20\\x09-\\x0D].
    """
    others = [c for c in rows.columns if c != "text"]
    fields = [rows.schema[c] for c in others]
    fields += [StructField("phash", StringType())] * prints + [StructField("embedding", ArrayType(DoubleType()))] * vectors

    def work(batches):
        for batch in (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE)):
            n = batch.num_rows
            texts = batch.column("text")
            owner, word, hashes = _words(texts)
            columns = [batch.column(c) for c in others]
            if prints:
                found = simhashes(owner, word, hashes, n)
                columns.append(pa.array(found, pa.string(), mask=texts.is_null().to_numpy(zero_copy_only=False)))
            if vectors:
                flat = bucket_vectors(owner, hashes[word], n).ravel()
                none = pa.array(np.bincount(owner, minlength=n) == 0)
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * DIM, pa.int32()), pa.array(flat), mask=none))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return rows.withColumn("text", F.lower("text")).mapInArrow(work, StructType(fields))

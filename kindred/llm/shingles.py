"""Word-shingle sets as sorted arrays of 64-bit hashes, for batches of whole texts."""

from __future__ import annotations

import numpy as np
import xxhash

from kindred.llm.common import claim

#: Words whose hashes a worker keeps before it starts afresh.
CACHE_ENTRIES = 200_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Hashes()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(raw: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner (position in `raw`) and hash of every distinct shingle, sorted by both.

    A word is a run of anything but [\\x20\\x09-\\x0D], with A-Z lowered; a text with fewer than `words` words is one
    shingle, without words none.
    """
    claim("shingles", _words.clear)
    if len(_words) > CACHE_ENTRIES:
        _words.clear()
    get = _words.__getitem__
    split = [t.lower().split() for t in raw]
    counts = np.array([len(s) for s in split], np.int64)
    flat = np.fromiter((h for s in split for h in map(get, s)), np.uint64, int(counts.sum()))
    owner = np.repeat(np.arange(len(raw)), counts)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
    rolled = np.zeros(len(flat), np.uint64)
    last = np.minimum(counts, words)[owner]  # words of a shingle of this text
    for k in range(words):
        here = np.zeros(len(flat), np.uint64)
        if k < len(flat):
            here[: len(flat) - k] = flat[k:]
        rolled = np.where(k < last, mix(rolled + here * _GOLD + np.uint64(k + 1)), rolled)
    starts = at <= counts[owner] - last
    owner, rolled = owner[starts], rolled[starts]
    order = np.lexsort((rolled, owner))
    owner, rolled = owner[order], rolled[order]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (rolled[1:] != rolled[:-1])
    return owner[fresh], rolled[fresh]


def leaves(owner: np.ndarray, hashes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut each owner's set along the bits of its hashes until no part has more than `most` members.

    Returns owner, signature and size of every part; a signature tells the bits that lead to the part and what it holds.
    """
    out_owner, out_sig, out_size = [], [], []
    mixed = mix(hashes + _GOLD)
    for level in range(65):
        if not len(owner):
            break
        prefix = hashes >> np.uint64(64 - level) if level else np.zeros(len(hashes), np.uint64)
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (prefix[1:] != prefix[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(owner)))
        small = sizes <= most
        if small.any():
            sums = np.add.reduceat(mixed, starts)[small]
            out_owner.append(owner[starts[small]])
            out_size.append(sizes[small])
            out_sig.append(mix(sums + prefix[starts[small]] * _GOLD + np.uint64(level)))
        keep = np.repeat(~small, sizes)
        owner, hashes, mixed = owner[keep], hashes[keep], mixed[keep]
    if not out_owner:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out_owner), np.concatenate(out_sig), np.concatenate(out_size)

"""Byte-level BPE by speculation: propose greedily, verify in bulk, merge only what fails.

For each distinct word the longest vocabulary match from the left is proposed. A proposal is the true BPE encoding if
and only if each adjacent pair of its tokens is what BPE makes of the pair's own bytes; that test walks both tokens
back through their merges and is done for all pairs of a batch at once, on arrays. Words with a failing pair are
merged exactly. Words are found through a cache of space-separated chunks, so a text costs one lookup a chunk.

Defined results: a null or empty text has no ids and decodes to an empty text; the vocabulary's special tokens are
recognised inside a text as the tokenizers library does; texts of any length are encoded whole; repeated rows and
repeated texts are rows like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from kindred.llm.common import claim, map_batches, slim, texts

#: Fixed value: the byte-level split pattern of the public vocabularies (see public_tokenizers.PATTERN).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries the two generations of a cache hold together: bounds a worker's memory, not what is encoded.
CACHE_ENTRIES = 400_000
#: Bytes of a word up to which failing words are merged side by side on arrays; longer ones are merged on a heap.
LOCKSTEP_BYTES = 64
#: Characters encoded at a time: bounds a worker's memory.
CHUNK_CHARS = 1 << 20
_NEVER = np.int64(1) << 40
#: Characters that end a chunk as a word of their own.
_STOPS = frozenset(".,;!?)")


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairTable:
    """Rank of a pair of tokens, for arrays of pairs: layers of hashed slots, each holding keys that meet no other there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.layers = []
        while len(keys):
            shift = np.uint64(64 - max(10, int(len(keys) * 6).bit_length()))
            at = self._slot(keys, len(self.layers), shift)
            _, first = np.unique(at, return_index=True)
            held, ranks = np.full(1 << int(64 - shift), -1, np.int64), np.full(1 << int(64 - shift), _NEVER, np.int64)
            held[at[first]], ranks[at[first]] = keys[first], values[first]
            self.layers.append((held, ranks, shift))
            keys, values = np.delete(keys, first), np.delete(values, first)

    @staticmethod
    def _slot(keys: np.ndarray, layer: int, shift: np.uint64) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * 0x1234567 * layer)) >> shift).astype(np.int64)

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), _NEVER, np.int64)
        for layer, (held, ranks, shift) in enumerate(self.layers):
            at = self._slot(keys, layer, shift)
            np.copyto(out, ranks[at], where=held[at] == keys)
        return out


class Encoder:
    """Encodes and decodes with one vocabulary file; made once per worker.

    With `speculate` off, every new word is merged exactly, which gives the same ids.
    """

    def __init__(self, path: str, speculate: bool = True):
        self.speculate = speculate
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        stand_in = byte_alphabet()
        raw = lambda s: bytes(stand_in[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {raw(s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.token_bytes: list[bytes] = [b""] * size
        for s, i in vocab.items():
            self.token_bytes[i] = s
        for s, i in self.special.items():
            self.token_bytes[i] = s.encode()
        self.vocab, self.size = vocab, size
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.rank = np.full(size, -1, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = (raw(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            ids = vocab[a], vocab[b], vocab[a + b]
            self.merges[ids[:2]] = (r, ids[2])
            self.left[ids[2]], self.right[ids[2]], self.rank[ids[2]] = ids[0], ids[1], r
        self.pairs = PairTable(np.array([a * size + b for a, b in self.merges], np.int64), np.array([r for r, _ in self.merges.values()], np.int64))
        self.made = np.array([i for _, i in self.merges.values()], np.int64)
        self.byte_ids = np.array([vocab[bytes([b])] for b in range(256)], np.int64)
        # lengths to try for each four first bytes, longest first: what such a start can become, down to one byte
        lengths: dict[bytes, set[int]] = {}
        for s in vocab:
            for k in range(1, min(4, len(s)) + 1):
                lengths.setdefault(s[:k], set())
        for s in vocab:
            if len(s) >= 4:
                lengths[s[:4]].add(len(s))
        for s in sorted(lengths, key=len):
            lengths[s].update(k for k in range(1, len(s) + 1) if s[:k] in vocab)
        self.lengths = {k: sorted(v, reverse=True) for k, v in lengths.items()}
        self.pattern = regex.compile(PATTERN)
        # runs of white space that a split at single spaces would cut where the pattern doesn't
        self.unsafe = regex.compile(r"\s \s|\s \Z")
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # words used since the last change of generations, and those of the generation before
        self.spaced: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}
        self.old_spaced: dict[str, bytes] = {}
        self.old_plain: dict[str, bytes] = {}
        self.failed = self.proposed = 0

    def propose(self, word: bytes) -> list[int]:
        """Longest match from the left."""
        out, at, n, vocab, lengths = [], 0, len(word), self.vocab, self.lengths
        while at < n:
            start = word[at : at + 4]
            while start not in lengths:
                start = start[:-1]
            for k in lengths[start]:
                if at + k <= n and (i := vocab.get(word[at : at + k])) is not None:
                    break
            out.append(i)
            at += k
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves the tokens of each pair (a, b) as they are when their bytes stand side by side.

        Merges are undone latest first on either side of the border. Whenever the two tokens at the border could
        have merged with each other before the merge just undone, the pair is not what BPE would give. Of merges
        with equal rank the leftmost comes first, hence the border merge also beats an equal one on its right.
        """
        ok = np.ones(len(a), bool)
        live, x, y = np.arange(len(a)), a.copy(), b.copy()
        before = np.full(len(a), _NEVER, np.int64)
        while len(live):
            bad = self.pairs.ranks(x * self.size + y) < before
            ok[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~bad & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[go], x[go], y[go], rx[go], ry[go]
            undo_left = rx > ry
            before = np.where(undo_left, rx, ry + 1)
            x, y = np.where(undo_left, self.right[x], x), np.where(undo_left, y, self.left[y])
        return ok

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: lowest rank first, leftmost first among equals."""
        ids = [self.vocab[word[i : i + 1]] for i in range(len(word))]
        n = len(ids)
        after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] < n:
                prior[after[j]] = i
                if m := self.merges.get((new, ids[after[j]])):
                    heapq.heappush(heap, (m[0], i, new, ids[after[j]], m[1]))
            if prior[i] >= 0 and (m := self.merges.get((ids[prior[i]], new))):
                heapq.heappush(heap, (m[0], prior[i], ids[prior[i]], new, m[1]))
        return [i for i in ids if i >= 0]

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """Exact merging of many short words at once, one merge of each word a round; ids as in encode_words."""
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        out: list[bytes] = [b""] * len(words)
        while len(ids):
            rank = np.full(len(ids), _NEVER, np.int64)
            inner = np.flatnonzero(word[:-1] == word[1:])
            rank[inner] = self.pairs.ranks(ids[inner] * self.size + ids[inner + 1])
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            lengths = np.diff(np.append(starts, len(ids)))
            least = np.minimum.reduceat(rank, starts)
            done = least == _NEVER
            packed = ids.astype("<u4").tobytes()
            for w, a, n in zip(word[starts[done]].tolist(), starts[done].tolist(), lengths[done].tolist(), strict=True):
                out[w] = packed[4 * a : 4 * (a + n)]
            hit = np.flatnonzero((rank == np.repeat(least, lengths)) & (rank != _NEVER))
            hit = hit[np.diff(word[hit], prepend=-1) != 0]  # the leftmost of a word
            ids[hit] = self.made[rank[hit]]
            keep = ~np.repeat(done, lengths)
            keep[hit + 1] = False
            ids, word = ids[keep], word[keep]
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit numbers."""
        raw = [w.encode() for w in words]
        if not self.speculate:
            short = [k for k, w in enumerate(raw) if len(w) <= LOCKSTEP_BYTES]
            exact = dict(zip(short, self.merge_all([raw[k] for k in short]), strict=True))
            return [exact[k] if k in exact else np.array(self.merge(w), "<u4").tobytes() for k, w in enumerate(raw)]
        guess = [self.propose(w) for w in raw]
        flat = np.array([i for g in guess for i in g], np.int64)
        ends = np.cumsum([len(g) for g in guess]) if guess else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(guess)), [len(g) for g in guess])
        inner = np.ones(len(flat), bool)
        inner[ends - 1] = False
        first = np.flatnonzero(inner)
        pairs, back = np.unique(flat[first] * self.size + flat[first + 1], return_inverse=True) if len(first) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        fine = self.compatible(pairs // self.size, pairs % self.size)
        failing = set(owner[first[~fine[back]]].tolist())
        self.proposed, self.failed = self.proposed + len(words), self.failed + len(failing)
        short = [k for k in failing if len(raw[k]) <= LOCKSTEP_BYTES]
        exact = dict(zip(short, self.merge_all([raw[k] for k in short]), strict=True))
        packed = flat.astype("<u4").tobytes()
        out, start = [], 0
        for k, end in enumerate(ends.tolist()):
            if k not in failing:
                out.append(packed[4 * start : 4 * end])
            else:
                out.append(exact[k] if k in exact else np.array(self.merge(raw[k]), "<u4").tobytes())
            start = end
        return out

    def _learn(self, spaced: list[str], plain: list[str]) -> None:
        """Put chunks that follow a space, and words and chunks that don't, into the caches."""
        find, known, bare = self.pattern.findall, self.spaced, self.plain
        # chunks of one word each, by cache; the others in parts, whose words may be new too
        one, two, several = set(), set(), []
        for c in spaced:
            if c.isalpha():
                one.add(c)
            elif c[-1:] in _STOPS and c[:-1].isalpha():
                several.append((known, c, [" " + c[:-1], c[-1]]))
            else:
                several.append((known, c, find(" " + c)))
        for c in plain:
            if c.isalpha():
                two.add(c)
            else:
                several.append((bare, c, find(c)))
        for _, _, parts in several:
            for w in parts:
                if w[0] == " " and len(w) > 1:
                    one.add(w[1:])
                else:
                    two.add(w)
        one, two = self._missing(one, known, self.old_spaced), self._missing(two, bare, self.old_plain)
        first, second = list(one), list(two)
        ids = self.encode_words([" " + c for c in first] + second)
        known.update(zip(first, ids, strict=False))
        bare.update(zip(second, ids[len(first) :], strict=True))
        for into, chunk, parts in several:
            if chunk not in into:
                into[chunk] = b"".join([known[w[1:]] if w[0] == " " and len(w) > 1 else bare[w] for w in parts])

    @staticmethod
    def _missing(wanted: set[str], cache: dict[str, bytes], old: dict[str, bytes]) -> set[str]:
        """What neither generation holds; what the old one holds is taken over into the new one."""
        wanted = wanted.difference(cache)
        found = {c for c in wanted if c in old}
        cache.update((c, old[c]) for c in found)
        return wanted - found

    def _encode(self, group: list[str]) -> list[bytes]:
        if len(self.spaced) > CACHE_ENTRIES // 2:
            self.spaced, self.old_spaced = {}, self.spaced
        if len(self.plain) > CACHE_ENTRIES // 2:
            self.plain, self.old_plain = {}, self.plain
        plans = []
        for text in group:
            plan: list[tuple[str | int, list[str]]] = []
            for k, part in enumerate(self.split_special.split(text)) if self.split_special and any(s in text for s in self.special) else [(0, text)]:
                if k % 2:
                    plan.append((self.special[part], []))
                elif self.unsafe.search(part):
                    # "'s" and the like, and white space, keep their meaning alone, so the words are looked up as they are
                    plan.append(("words", self.pattern.findall(part)))
                elif part:
                    head, *tail = part.split(" ")
                    plan.append((head, tail))
            plans.append(plan)
        spaced = {c for p in plans for kind, tail in p if kind != "words" for c in tail}
        plain = {kind for p in plans for kind, _ in p if isinstance(kind, str) and kind != "words"}
        plain |= {w for p in plans for kind, ws in p if kind == "words" for w in ws}
        self._learn(list(self._missing(spaced, self.spaced, self.old_spaced)), list(self._missing(plain, self.plain, self.old_plain)))
        out = []
        for plan in plans:
            got = []
            for kind, tail in plan:
                if kind == "words":
                    got.extend(map(self.plain.__getitem__, tail))
                elif isinstance(kind, int):
                    got.append(kind.to_bytes(4, "little"))
                else:
                    got.append(self.plain[kind] + b"".join(map(self.spaced.__getitem__, tail)))
            out.append(b"".join(got))
        return out

    def encode_batch(self, batch: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers, side by side."""
        out: list[bytes] = []
        group, chars = [], 0
        for text in batch:
            group.append(text)
            chars += len(text)
            if chars >= CHUNK_CHARS:
                out += self._encode(group)
                group, chars = [], 0
        return out + self._encode(group)

    def decode(self, ids: list[int]) -> str:
        """The tokens' bytes as text; what is not UTF-8 becomes U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _encoder(path: str, speculate: bool) -> Encoder:
    return Encoder(path, speculate)


def forget() -> None:
    """Give back what this worker's encoders hold."""
    _encoder.cache_clear()


def encoder(path: str, speculate: bool = True, holder: str = "bpe") -> Encoder:
    """This worker's encoder for the operator `holder`; workers are reused, so the vocabulary is read once."""
    if holder == "bpe":
        claim("bpe", forget)
    return _encoder(path, speculate)


def id_lists(packed: list[bytes]) -> pa.Array:
    offsets = np.cumsum([0, *[len(p) // 4 for p in packed]])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32)))


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of each text. `vocabulary` is a path that every executor can open."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), id_lists(encoder(vocabulary).encode_batch(texts(batch.column(1))))], ["doc_id", "ids"])

    return map_batches(slim(docs, id_col, text_col), "doc_id long, ids array<int>", work)


def _decoded(own: Encoder, lists: pa.ListArray) -> pa.Array:
    flat, lengths = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    ends = np.cumsum(lengths)
    return pa.array([own.decode(flat[b - n : b].tolist()) for n, b in zip(lengths.tolist(), ends.tolist(), strict=True)], pa.string())


def decode_ids(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids, decoded: the text that each list of ids stands for."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("ids")
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, _decoded(encoder(vocabulary), lists)], ["doc_id", "ids", "decoded"])

    return map_batches(encoded, "doc_id long, ids array<int>, decoded string", work)


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, decoded of each text: decode_ids over encode_documents, in one worker."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = encoder(vocabulary)
        lists = id_lists(own.encode_batch(texts(batch.column(1))))
        return pa.RecordBatch.from_arrays([batch.column(0), lists, _decoded(own, lists)], ["doc_id", "ids", "decoded"])

    return map_batches(slim(docs, id_col, text_col), "doc_id long, ids array<int>, decoded string", work)

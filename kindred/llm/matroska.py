"""Matroska: payloads stored as 8-bit samples, and a reader that turns EBML into packet tables.

`write` lays samples out as one audio track (unsigned 8-bit PCM): an EBML header, a segment with info, tracks, cues
and clusters of simple blocks. Frames are laced in turn by each of the four lacings, so that every reader path is
used by every long payload. `packets` reads any Matroska bytes: variable-length ids and sizes (unknown sizes too),
clusters, simple blocks and block groups, the four lacings, and cues.

Defined results: a null or empty text is stored as one frame of 576 bytes 255; a damaged file raises ValueError that
names the offset (`packet_table` gives such a file one row with `error` set instead); nothing depends on time or
place, so equal payloads give equal bytes. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import map_batches, raw_texts, slim

#: Element ids of the Matroska specification (RFC 9559, RFC 8794).
EBML, DOC_TYPE, SEGMENT, INFO, TIMESTAMP_SCALE, DURATION = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, AUDIO, RATE, CHANNELS, BIT_DEPTH = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
LACINGS = ("none", "xiph", "fixed", "ebml")

FRAME = 576
RATE_HZ = 8000
FRAMES_A_BLOCK = 16
BLOCKS_A_CLUSTER = 8


class Packet(NamedTuple):
    """One frame: track, timestamp of its block in ticks, its number in the lace, lacing, and where its bytes lie."""

    track: int
    timestamp: int
    frame: int
    lacing: str
    start: int
    length: int


def vint(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer, in the fewest bytes or in `width`."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def _uint(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def read_vint(data, at: int, end: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """Value, position after it, and whether all its bits are set (an unknown size)."""
    if at >= end or not data[at]:
        raise ValueError(f"no variable-length integer at {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise ValueError(f"variable-length integer at {at} is cut off")
    n = int.from_bytes(data[at : at + width], "big")
    bare = n & ~(1 << 7 * width)
    return n if keep_marker else bare, at + width, bare == (1 << 7 * width) - 1


def _block(track: int, relative: int, frames: list[bytes], lacing: int) -> bytes:
    flags = 0x80 | lacing << 1
    head = vint(track) + struct.pack(">hB", relative, flags)
    if lacing == 0:
        return head + frames[0]
    head += bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if lacing == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == 3 and len(sizes) > 1:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1))
            head += vint(b - a + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def write(payload: bytes, frame: int = FRAME) -> bytes:
    """The payload, a multiple of `frame` bytes, as a Matroska file of 8-bit samples."""
    frames = [payload[i : i + frame] for i in range(0, len(payload), frame)]
    blocks, i = [], 0
    while i < len(frames):
        lacing = len(blocks) % 4
        n = 1 if lacing == 0 else min(FRAMES_A_BLOCK, len(frames) - i)
        blocks.append((i * frame, (lacing, frames[i : i + n])))
        i += n
    clusters = []
    for c in range(0, len(blocks), BLOCKS_A_CLUSTER):
        base = blocks[c][0]
        # ticks are samples; a cluster's blocks stay within the 16 bits of a block's relative time
        body, opened = _uint(CLUSTER_TIME, base), base
        for at, (lacing, own) in blocks[c : c + BLOCKS_A_CLUSTER]:
            if at - opened > 32767:
                clusters.append((opened, element(CLUSTER, body)))
                body, opened = _uint(CLUSTER_TIME, at), at
            body += element(SIMPLE_BLOCK, _block(1, at - opened, own, lacing))
        clusters.append((opened, element(CLUSTER, body)))
    info = element(INFO, _uint(TIMESTAMP_SCALE, 10**9 // RATE_HZ) + element(DURATION, struct.pack(">d", len(payload))))
    audio = element(AUDIO, element(RATE, struct.pack(">d", RATE_HZ)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    # cues come before the clusters, with positions in eight bytes, so that their own length is known first
    point = lambda t, pos: element(CUE_POINT, element(CUE_TIME, t.to_bytes(8, "big")) + element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + element(CUE_CLUSTER, pos.to_bytes(8, "big"))))
    before = len(info) + len(tracks) + len(element(CUES, b"".join(point(0, 0) for _ in clusters)))
    positions = before + np.cumsum([0, *[len(c) for _, c in clusters]])
    cues = element(CUES, b"".join(point(t, int(p)) for (t, _), p in zip(clusters, positions, strict=False)))
    head = element(EBML, element(DOC_TYPE, b"matroska"))
    return head + element(SEGMENT, info + tracks + cues + b"".join(c for _, c in clusters))


def _children(data, at: int, end: int):
    """(id, body start, body end) of each element; one of unknown size reaches to the end of its parent."""
    while at < end:
        ident, at, _ = read_vint(data, at, end, keep_marker=True)
        size, at, unknown = read_vint(data, at, end)
        stop = end if unknown else at + size
        if stop > end:
            raise ValueError(f"element {ident:X} at {at} reaches past its parent")
        yield ident, at, stop
        at = stop


#: Elements that end a cluster of unknown size.
_TOP = {INFO, TRACKS, CLUSTER, CUES}


def _frames(data, at: int, end: int, base: int) -> list[Packet]:
    track, at, _ = read_vint(data, at, end)
    if at + 3 > end:
        raise ValueError(f"block at {at} is cut off")
    relative, flags = struct.unpack_from(">hB", data, at)
    at, lacing = at + 3, flags >> 1 & 3
    if lacing == 0:
        return [Packet(track, base + relative, 0, LACINGS[0], at, end - at)]
    if at >= end:
        raise ValueError(f"lace at {at} is cut off")
    n, at = data[at] + 1, at + 1
    sizes = []
    if lacing == 1:
        for _ in range(n - 1):
            size = 0
            while True:
                if at >= end:
                    raise ValueError(f"lace at {at} is cut off")
                size, last, at = size + data[at], data[at], at + 1
                if last < 255:
                    break
            sizes.append(size)
    elif lacing == 3:
        for k in range(n - 1):
            start = at
            value, at, _ = read_vint(data, at, end)
            sizes.append(value if k == 0 else sizes[-1] + value - ((1 << 7 * (at - start) - 1) - 1))
    else:
        if (end - at) % n:
            raise ValueError(f"fixed lace at {at} doesn't divide")
        sizes = [(end - at) // n] * (n - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"lace at {at} has a negative size")
    out = []
    for k, size in enumerate(sizes):
        out.append(Packet(track, base + relative, k, LACINGS[lacing], at, size))
        at += size
    return out


def packets(data: bytes) -> tuple[list[Packet], list[tuple[int, int]], int, dict[int, str]]:
    """Packets in file order, cues as (time, byte offset of the cluster in the file), nanoseconds a tick, codecs by track."""
    out, cues, scale, codecs = [], [], 1_000_000, {}
    number = lambda a, b: int.from_bytes(data[a:b], "big")

    def cluster(at: int, end: int) -> int:
        base = 0
        while at < end:
            ident, body, _ = read_vint(data, at, end, keep_marker=True)
            if ident in _TOP:
                return at
            size, body, unknown = read_vint(data, body, end)
            stop = end if unknown else body + size
            if stop > end:
                raise ValueError(f"element {ident:X} at {at} reaches past its cluster")
            if ident == CLUSTER_TIME:
                base = number(body, stop)
            elif ident == SIMPLE_BLOCK:
                out.extend(_frames(data, body, stop, base))
            elif ident == BLOCK_GROUP:
                for inner, a, b in _children(data, body, stop):
                    if inner == BLOCK:
                        out.extend(_frames(data, a, b, base))
            at = stop
        return at

    top = list(_children(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise ValueError("no EBML header at 0")
    for ident, start, end in top[1:]:
        if ident != SEGMENT:
            continue
        at = start
        while at < end:
            inner, body, _ = read_vint(data, at, end, keep_marker=True)
            size, body, unknown = read_vint(data, body, end)
            stop = end if unknown else body + size
            if stop > end:
                raise ValueError(f"element {inner:X} at {at} reaches past the segment")
            if inner == CLUSTER:
                at = cluster(body, stop)
                continue
            if inner == INFO:
                scale = next((number(a, b) for i, a, b in _children(data, body, stop) if i == TIMESTAMP_SCALE), scale)
            elif inner == TRACKS:
                for entry, a, b in _children(data, body, stop):
                    if entry == TRACK_ENTRY:
                        own = {i: data[x:y] for i, x, y in _children(data, a, b)}
                        codecs[int.from_bytes(own.get(TRACK_NUMBER, b"\0"), "big")] = own.get(CODEC_ID, b"").decode("ascii", "replace")
            elif inner == CUES:
                for p, a, b in _children(data, body, stop):
                    if p == CUE_POINT:
                        own = {i: (x, y) for i, x, y in _children(data, a, b)}
                        where = {i: (x, y) for i, x, y in _children(data, *own[CUE_POSITIONS])} if CUE_POSITIONS in own else {}
                        if CUE_TIME in own and CUE_CLUSTER in where:
                            cues.append((number(*own[CUE_TIME]), start + number(*where[CUE_CLUSTER])))
            at = stop
    return out, cues, scale, codecs


def read_payload(data: bytes) -> bytes:
    """The frames of the file in order, checked against its cues."""
    found, cues, _, _ = packets(data)
    for _, offset in cues:
        if data[offset : offset + 4] != CLUSTER.to_bytes(4, "big"):
            raise ValueError(f"a cue points at {offset}, where no cluster begins")
    return b"".join([data[p.start : p.start + p.length] for p in found])


def padded(text: bytes, frame: int = FRAME) -> bytes:
    return text + b"\xff" * (-len(text) % frame or (0 if text else frame))


def feature(samples: bytes, n_packets: int, n_cues: int) -> str:
    """Packets, cues, mean, deviation and sign changes of the samples, as a short text."""
    x = np.frombuffer(samples, np.uint8)
    high = x >= 128
    crossings = int(np.count_nonzero(high[1:] != high[:-1]))
    total = int(x.sum(dtype=np.int64))
    squares = int((x.astype(np.uint32) ** 2).sum(dtype=np.int64))
    mean = total / len(x)
    return f"packets={n_packets};cues={n_cues};mean={mean:.4f};sd={max(0.0, squares / len(x) - mean * mean) ** 0.5:.4f};crossings={crossings}"


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (the Matroska bytes): each text as a media column."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = raw_texts(batch.column(1))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([write(padded(x)) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_batches(slim(docs, id_col, text_col), "doc_id long, n_bytes long, media binary", work)


def read_features(media: DataFrame) -> DataFrame:
    """Digests and features of each media column, from its packets: the columns of the contract."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(6)]
        for data in batch.column("media").to_pylist():
            found, cues, _, _ = packets(data)
            payload = b"".join([data[p.start : p.start + p.length] for p in found])
            for c, v in zip(cols, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload, len(found), len(cues))), strict=True):
                c.append(v)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return map_batches(media, schema, work)


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per frame: doc_id, packet, track, codec, pts_ns, frame, lacing, byte_start, byte_length, error."""
    schema = "doc_id long, packet long, track long, codec string, pts_ns long, frame int, lacing string, byte_start long, byte_length long, error string"

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                found, _, scale, codecs = packets(data or b"")
                rows += [(doc, i, p.track, codecs.get(p.track), p.timestamp * scale, p.frame, p.lacing, p.start, p.length, None) for i, p in enumerate(found)]
            except ValueError as e:
                rows.append((doc, None, None, None, None, None, None, None, None, str(e)))
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return map_batches(media.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{media_col}`").alias("media")), schema, work)

"""Pixel kernels over Spark's decoded images: grey values, perceptual hash, quality. Pictures are turned upright as their Exif says."""

from __future__ import annotations

import os
import re
import struct
from typing import BinaryIO
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from kindred.operators.quality import measure

PICTURE_SCHEMA = "path string, width int, height int, phash string, blur_score double, brightness double"
VECTOR_SIDE = 16


def gray_of(data: bytes, height: int, width: int, channels: int, on_white: bool = False) -> np.ndarray:
    """Grey values from interleaved blue, green, red (and alpha) bytes, with the usual luma weights. Alpha is left out of
    account, or with `on_white` lets white through."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    gray = a[:, :, 0] if channels == 1 else (a[:, :, 2] * 299 + a[:, :, 1] * 587 + a[:, :, 0] * 114) / 1000
    return 255 + (gray - 255) * a[:, :, 3] / 255 if on_white and channels == 4 else gray


def local_path(uri: str) -> str:
    """The path that the image reader's `file:` name, an encoded URI, stands for."""
    return unquote(re.sub("^file:(//)?", "", uri))


def literal(path: str) -> str:
    """The pattern that matches this path alone, as Spark's readers take paths for patterns."""
    return re.sub(r"([][{}*?\\])", r"\\\1", path)


def _exif_value(tiff: bytes) -> int:
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None:
        return 1
    at = struct.unpack_from(order + "I", tiff, 4)[0]
    for k in range(struct.unpack_from(order + "H", tiff, at)[0]):
        tag, _, _, value = struct.unpack_from(order + "HHIH", tiff, at + 2 + 12 * k)
        if tag == 0x0112:
            return value if 1 <= value <= 8 else 1
    return 1


def orientation(f: BinaryIO) -> int:
    """The Exif orientation (1 to 8) of a JPEG file; 1 for other files and where it is absent or damaged. Reads the segments' heads alone."""
    try:
        if f.read(2) != b"\xff\xd8":
            return 1
        while True:
            mark, kind, length = struct.unpack(">BBH", f.read(4))
            if mark != 0xFF or kind == 0xDA or length < 2:
                return 1
            if kind == 0xE1 and (body := f.read(length - 2)).startswith(b"Exif\0\0"):
                return _exif_value(body[6:])
            if kind != 0xE1:
                f.seek(length - 2, os.SEEK_CUR)
    except struct.error:
        return 1


def orientation_at(path: str) -> int:
    try:
        with open(path, "rb") as f:
            return orientation(f)
    except OSError:
        return 1


def upright(a: np.ndarray, turn: int) -> np.ndarray:
    """A picture as its Exif orientation wants it to be seen: 5 to 8 swap the axes, then either may be reversed."""
    a = a.T if turn >= 5 else a
    return a[:: -1 if turn in (3, 4, 7, 8) else 1, :: -1 if turn in (2, 3, 6, 7) else 1]


def _resize(gray: np.ndarray, side: int) -> np.ndarray:
    """Windowed-sinc (Lanczos, three lobes) resampling to a square."""

    def weights(n: int) -> np.ndarray:
        scale = n / side
        reach = max(1.0, scale) * 3
        centre = (np.arange(side) + 0.5) * scale
        x = (np.arange(n) + 0.5 - centre[:, None]) / max(1.0, scale)
        w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0) * (np.abs(np.arange(n) + 0.5 - centre[:, None]) < reach)
        return w / w.sum(1, keepdims=True)

    return np.clip(np.round(weights(gray.shape[0]) @ gray @ weights(gray.shape[1]).T), 0, 255)


def perceptual_hash(gray: np.ndarray, side: int = 32, low: int = 8) -> str:
    """64 bits of the low frequencies against their median, as 16 hex digits."""
    x = _resize(gray, side)
    k = np.arange(side)
    basis = 2 * np.cos(np.pi * k[:, None] * (2 * k[None] + 1) / (2 * side))
    block = (basis @ x @ basis.T)[:low, :low]
    return f"{int(''.join('1' if b else '0' for b in (block > np.median(block)).ravel()), 2):016x}"


def picture_vector(gray: np.ndarray, side: int = VECTOR_SIDE) -> list[float]:
    """A deterministic stand-in for a model's vector: the small grey picture against its mean, and a constant, so that none is zero."""
    small = _resize(gray, side).ravel()
    return [*(small - small.mean()).tolist(), 1.0]


def measure_pictures(spark: SparkSession, places: str | list[str], vectors: bool = False) -> DataFrame:
    """PICTURE_SCHEMA, and with `vectors` also embedding, of the pictures under `places`; those that can't be decoded have NULL
    sizes, hash and vector and zero quality."""
    schema = PICTURE_SCHEMA + (", embedding array<float>" if vectors else "")
    rows = spark.read.format("image").option("recursiveFileLookup", "true").load([literal(p) for p in ([places] if isinstance(places, str) else places)]).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def work(batches):
        for pdf in batches:
            out = []
            for origin, h, w, c, data in pdf.itertuples(index=False):
                if h <= 0 or w <= 0:
                    out.append((local_path(origin), None, None, None, 0.0, 0.0, *[None] * vectors))
                    continue
                path = local_path(origin)
                turn = orientation_at(path)
                gray = upright(gray_of(data, h, w, c), turn)
                vector = [picture_vector(upright(gray_of(data, h, w, c, on_white=True), turn) if c == 4 else gray)] if vectors else []
                out.append((path, gray.shape[1], gray.shape[0], perceptual_hash(gray), *measure(gray), *vector))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")]).astype({"width": "Int32", "height": "Int32"})

    return rows.mapInPandas(work, schema)


def measure_gray(rows: DataFrame, id_col: str, pixels: str, side: int) -> DataFrame:
    """(id, phash, blur_score, brightness) of square grey pictures held as arrays of side * side values."""

    def work(batches):
        for pdf in batches:
            out = []
            for key, values in pdf.itertuples(index=False):
                gray = np.asarray(values, np.float64).reshape(side, side)
                out.append((key, perceptual_hash(gray), *measure(gray)))
            yield pd.DataFrame(out, columns=[id_col, "phash", "blur_score", "brightness"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, pixels).mapInPandas(work, f"{id_col} {kind}, phash string, blur_score double, brightness double")

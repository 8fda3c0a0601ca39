"""Scalar functions over records: digests, fingerprints, vectors, paths. All of them are plan columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VALID_PRINT = r"^[0-9a-fA-F]{1,16}$"
DIM = 64


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def fingerprint_bits(print_hex: Column) -> Column:
    """64 bits of a hex fingerprint; missing, empty or non-hex gives NULL. Base -10 keeps the upper half signed."""
    return F.when(print_hex.rlike(VALID_PRINT), F.conv(print_hex, 16, -10).cast("long"))


def fingerprint_distance(a: Column, b: Column) -> Column:
    """Differing bits of two hex fingerprints, NULL if either isn't one."""
    return F.bit_count(fingerprint_bits(a).bitwiseXOR(fingerprint_bits(b)))


def dot(u: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(u, v, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column, eps: float = 1e-12) -> Column:
    """Divide by the larger of norm and eps: the matching arm's rule."""
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm(v), F.lit(eps)))


def unit_or_zero(v: Column) -> Column:
    """Divide where the norm is positive, else all zeros: the selection's rule."""
    return F.transform(v, lambda x: F.when(norm(v) > 0, x.cast("double") / norm(v)).otherwise(F.lit(0.0)))


def parent(path: Column) -> Column:
    """Direct parent folder."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def relative_to(path: Column, root: str) -> Column:
    """Path below `root`; the base name where it lies outside."""
    top = root.rstrip("/") + "/"
    return F.when(path.startswith(top), F.substring(path, len(top) + 1, 1 << 30)).otherwise(base_name(path))


def pixels(width: Column, height: Column) -> Column:
    return F.coalesce(width.cast("long") * height.cast("long"), F.lit(0).cast("long"))

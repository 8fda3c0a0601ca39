"""Helpers that the operators share: Arrow batches in and out, and the byte-level text rules of the contracts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: ASCII white space of the contracts, [\x20\x09-\x0D]. bytes.split(), bytes.strip() use just this set.
SPACE = " \t\n\x0b\x0c\r"

#: Rows that a worker turns into output at a time.
SLICE_ROWS = 1024


def quoted(name: str) -> str:
    """A column's name as Spark's expressions take it, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def slim(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, so that no other column of the caller can clash with its own."""
    return df.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text"))


def with_carried(df: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    """The two columns an operator reads, and those it hands through, as fields of one struct `carried`: their names can't
    clash with any column of the operator's own."""
    own = [F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text")]
    return df.select(*own, F.struct(*[F.col(quoted(c)).alias(c) for c in carry]).alias("carried")) if carry else df.select(*own)


def map_batches(df: DataFrame, schema, work: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> DataFrame:
    """Apply `work` to slices of each Arrow batch; the slice is the unit of what a worker holds besides its input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                if (out := work(batch.slice(at, SLICE_ROWS))) is not None:
                    yield out

    return df.mapInArrow(run, schema)


def raw_texts(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """Texts; null is empty."""
    return ["" if x is None else x for x in column.to_pylist()]


_holders: dict[str, Callable[[], None]] = {}


def claim(name: str, clear: Callable[[], None]) -> None:
    """Say that this worker now works for `name`, whose caches `clear` empties: workers are reused by other operators,
    and what an earlier one kept is given back first."""
    _holders[name] = clear
    others = [k for k in _holders if k != name]
    for other in others:
        _holders.pop(other)()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library can give freed memory back
            ctypes.CDLL(None).malloc_trim(0)

"""Embedders: whatever turns the content of records into vectors, run in batches by the executors.

An embedder is a name (kept beside cached vectors as their model version) and `load`, which a worker calls once and which
returns a function from a list of contents to a matrix of one row each. A content that can't be read is None and gets
no vector. Weights, devices and batch sizes are the embedder's own matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.features import DIM

#: Gigabytes of memory from which a batch size is allowed; below them all, and without a device, the last.
BATCH_STEPS = ((40, 128), (24, 96), (16, 64), (12, 48))
LEAST_BATCH = 32


@dataclass(frozen=True)
class Embedder:
    name: str
    load: Callable[[], Callable[[list], np.ndarray]]
    batch: int = 128


def batch_size(wanted: Column, memory_gb: Column) -> Column:
    """The batch asked for, or the most that a device with so much memory takes; NULL memory stands for no device."""
    most = F.lit(LEAST_BATCH)
    for least, size in reversed(BATCH_STEPS):
        most = F.when(memory_gb >= least, size).otherwise(most)
    return F.least(wanted, most)


@lru_cache(maxsize=1 << 16)
def _bucket(word: str) -> int:
    return hashlib.md5(word.encode()).digest()[0] % DIM


def _load_words() -> Callable[[list], np.ndarray]:
    def run(contents: list) -> np.ndarray:
        out = np.zeros((len(contents), DIM))
        for k, text in enumerate(contents):
            np.add.at(out[k], [_bucket(w) for w in text.lower().split()], 1)
        return out - out.mean(1, keepdims=True)

    return run


#: The default: counts of words in hashed buckets less their mean. It needs no weights.
WORDS = Embedder("words-64", _load_words)


def embed(rows: DataFrame, content: str, embedder: Embedder = WORDS, id_col: str = "idx") -> DataFrame:
    """(id, embedding of unit length, model_version) of each row; NULL where there is no content or the vector is all zeros.

    A task that is lost is run again on its own rows, so no row is lost with a device.
    """

    def work(batches):
        run = embedder.load()
        for batch in batches:
            ids, contents = batch.column(0), batch.column(1).to_pylist()
            vectors: list = [None] * len(contents)
            able = [k for k, c in enumerate(contents) if c is not None]
            for a in range(0, len(able), embedder.batch):
                part = able[a : a + embedder.batch]
                found = np.asarray(run([contents[k] for k in part]), np.float64)
                length = np.sqrt((found**2).sum(1))
                for k, v, n in zip(part, found, length, strict=True):
                    vectors[k] = (v / n).tolist() if n > 0 else None
            yield pa.RecordBatch.from_arrays([ids, pa.array(vectors, pa.list_(pa.float64()))], [id_col, "embedding"])

    kind = rows.schema[id_col].dataType.simpleString()
    out = rows.select(id_col, content).mapInArrow(work, f"{id_col} {kind}, embedding array<double>")
    return out.withColumn("model_version", F.when(F.col("embedding").isNotNull(), embedder.name))

"""Records: from a table of documents, or from folders of files."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.features import parent, sha256, suffix
from kindred.functions.texts import with_features
from kindred.operators.number import numbered
from kindred.plans.session import cut

#: What a scan takes, and the folders it never enters.
SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tif", ".tiff")
PRUNED = {".git", "__pycache__", "node_modules"}
#: The engine's own folder, which holds the trash, isn't entered either.
OWN_FOLDER = ".kindred"

FILE_SCHEMA = "idx long, folder_ord int, path string, size long, mtime double"
_ENTRY_SCHEMA = "folder_ord int, path string, size long, mtime double, is_folder boolean"


def from_documents(docs: DataFrame) -> DataFrame:
    """The record view of documents: path source/doc_id, and deterministic stand-ins for what images have."""
    i = F.col("doc_id")
    return docs.select(
        i.alias("idx"), F.concat_ws("/", "source", i.cast("string")).alias("path"), F.octet_length("text").cast("long").alias("size"), (i * 7919 % 1000).cast("double").alias("mtime"),
        sha256(F.col("text")).alias("sha256"), (F.col("n_chars") % 97 + 1).cast("int").alias("width"), (F.col("n_chars") % 53 + 1).cast("int").alias("height"),
        (F.octet_length("text") % 1000).cast("double").alias("blur_score"), (F.col("n_chars") * 31 % 256).cast("double").alias("brightness"), F.col("text"),
    ).withColumn("parent", parent(F.col("path")))


def plain_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the documents table without fingerprint and vector; nothing is computed that isn't selected."""
    return from_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text")


def document_records(spark: SparkSession, sf_dir: str, prints: bool = True, vectors: bool = True) -> DataFrame:
    """Records of the documents table with the features asked for, written once so that a plan may read them often."""
    rows = from_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return cut(with_features(rows, prints, vectors))


def entries(folder: str) -> Iterator[tuple[str, int, float, bool]]:
    """(path, size, mtime, is folder) of what a scan takes from one folder; what can't be read is left out.

    Spark's own file listing hides names that begin with a dot or underscore, so folders are listed here. Links to
    folders are not followed.
    """
    try:
        found = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError:
        return
    for e in found:
        if e.is_dir(follow_symlinks=False):
            if e.name not in PRUNED and e.name != OWN_FOLDER:
                yield e.path, 0, 0.0, True
        elif e.name.lower().endswith(SUFFIXES) and not e.name.lower() in SUFFIXES:
            try:
                found_stat = e.stat()
            except OSError:
                continue
            if not e.is_dir():
                yield e.path, found_stat.st_size, found_stat.st_mtime, False


def scan_table(spark: SparkSession, folders: list[str]) -> DataFrame:
    """FILE_SCHEMA of the supported files below the folders, each path once (for the first folder that holds it), numbered by
    folder and path. Folders are listed by the executors, one job a level, so the driver never holds the names."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, folder in zip(pdf["folder_ord"], pdf["path"], strict=True):
                rows = [(k, *e) for e in entries(folder)]
                yield pd.DataFrame(rows, columns=["folder_ord", "path", "size", "mtime", "is_folder"])

    level = spark.createDataFrame([(k, os.path.realpath(f)) for k, f in enumerate(folders)], "folder_ord int, path string")
    found: DataFrame | None = None
    while not level.isEmpty():
        here = cut(level.repartition(spark.sparkContext.defaultParallelism, "path").mapInPandas(listed, _ENTRY_SCHEMA))
        found = here if found is None else found.unionByName(here)
        level = here.where("is_folder").select("folder_ord", "path")
    once = found.where("NOT is_folder").groupBy("path").agg(F.min_by(F.struct("folder_ord", "size", "mtime"), "folder_ord").alias("f"))
    return numbered(once.select("f.folder_ord", "path", "f.size", "f.mtime"), ["folder_ord", "path"], "idx").select("idx", "folder_ord", "path", "size", "mtime")


def scan_files(folders: list[str]) -> list[tuple]:
    """The rows of scan_table as a list, for callers without a session; folders are listed here, one after another."""
    first: dict[str, tuple] = {}
    for k, folder in enumerate(folders):
        waiting = [os.path.realpath(folder)]
        for place in waiting:  # grows while it is read
            for path, size, mtime, is_folder in entries(place):
                if is_folder:
                    waiting.append(path)
                else:
                    first.setdefault(path, (k, path, size, mtime))
    return [(i, *row) for i, row in enumerate(sorted(first.values()))]


def files_frame(spark: SparkSession, folders: list[str]) -> DataFrame:
    return scan_table(spark, folders).withColumn("parent", parent(F.col("path")))


def with_supported_suffix(rows: DataFrame, column: str = "path") -> DataFrame:
    return rows.where(suffix(F.col(column)).isin(*SUFFIXES))

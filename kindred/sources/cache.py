"""The feature cache: a versioned Parquet snapshot, joined on (path, size, mtime)."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("size", T.LongType()), T.StructField("mtime", T.DoubleType()), T.StructField("sha256", T.StringType()), T.StructField("phash", T.StringType())]
    + [T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("model_version", T.StringType())]
)
KEY = ["path", "size", "mtime"]
METADATA = ["sha256", "phash", "width", "height"]


def lookup(records: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Records (KEY and more, without features) with cached metadata, `cached`, and the vector if it is of this model.

    A row that matches is a hit even if its fields are NULL; another model's vector is no hit for the vector.
    """
    held = cache.select(*KEY, *METADATA, F.lit(True).alias("cached"), F.when(F.col("model_version") == model, F.col("embedding")).alias("embedding"))
    return records.join(held, KEY, "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def needs_hash(rows: DataFrame) -> DataFrame:
    return rows.where(" OR ".join(f"{c} IS NULL" for c in METADATA))


def needs_embedding(rows: DataFrame) -> DataFrame:
    return rows.where("embedding IS NULL")


def upsert_metadata(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows replace those of equal path and have no vector until one is saved."""
    new = rows.select(*KEY, *METADATA, F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("model_version"))
    return cache.join(new.select("path"), "path", "left_anti").unionByName(new)


def save_embeddings(cache: DataFrame, rows: DataFrame, model: str, merge: bool = False) -> DataFrame:
    """The vectors of `rows` (KEY, embedding) become the cache's; those of other paths are dropped unless `merge`."""
    new = rows.where("embedding IS NOT NULL").select(*KEY, F.col("embedding").alias("_new"))
    joined = cache.join(new, KEY, "left")
    old = F.col("embedding") if merge else F.lit(None).cast("array<float>")
    version = F.col("model_version") if merge else F.lit(None).cast("string")
    return joined.select(*KEY, *METADATA, F.coalesce("_new", old).cast("array<float>").alias("embedding"), F.when(F.col("_new").isNotNull(), F.lit(model)).otherwise(version).alias("model_version"))


def feature_matrix(records: DataFrame, new: DataFrame, cached: DataFrame) -> DataFrame:
    """(idx, embedding): the new vector if there is one, else the cached one, else NULL."""
    fresh, old = new.select("idx", F.col("embedding").alias("_new")), cached.select("idx", F.col("embedding").alias("_old"))
    return records.select("idx").join(fresh, "idx", "left").join(old, "idx", "left").select("idx", F.coalesce("_new", "_old").alias("embedding"))


class Snapshots:
    """Versions of the cache under one folder of any store that Spark writes.

    Names sort by the time they were begun, and a version counts once Spark has put its success mark into it, as the last
    step of writing. The newest such version is the current one, so there is no step at which a reader or a crash could
    find none.
    """

    def __init__(self, spark: SparkSession, root: str, kept: int = 2):
        self.spark, self.root, self.kept = spark, root.rstrip("/"), kept
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[str]:
        """Names of the complete versions, oldest first."""
        if not self.fs.exists(self.path(self.root)):
            return []
        names = (s.getPath().getName() for s in self.fs.listStatus(self.path(self.root)))
        return sorted(n for n in names if n.startswith("v-") and self.fs.exists(self.path(f"{self.root}/{n}/_SUCCESS")))

    def read(self) -> DataFrame:
        """The current version; empty before the first write."""
        found = self.versions()
        return self.spark.read.schema(SCHEMA).parquet(f"{self.root}/{found[-1]}") if found else self.spark.createDataFrame([], SCHEMA)

    def write(self, cache: DataFrame) -> str:
        """Write a new version; the older ones but `kept` of them go afterwards, as a plan may still read the last."""
        last = self.versions()
        stamp = max(time.time_ns(), int(last[-1].split("-")[1]) + 1) if last else time.time_ns()
        name = f"v-{stamp:020d}-{uuid.uuid4().hex}"
        cache.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMA.fields]).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.root}/{name}")
        for old in self.versions()[: -self.kept]:
            self.fs.delete(self.path(f"{self.root}/{old}"), True)
        return name

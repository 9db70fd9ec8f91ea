"""Content-addressed response cache and resume table as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CACHE = "key string, value string, stored_at timestamp"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at ``path``, in whatever file system."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def open_cache(spark: SparkSession, path: str | None) -> DataFrame:
    """The cache at ``path``; an absent one is empty, and corrupt files in it are skipped. Other failures to read are raised."""
    if path and exists(spark, path):
        return spark.read.schema(CACHE).option("ignoreCorruptFiles", "true").parquet(path)
    return spark.createDataFrame([], CACHE)


def current(cache: DataFrame) -> DataFrame:
    """The last value of each key; of equal times any one, they answer the same prompt."""
    return cache.groupBy("key").agg(F.max_by("value", F.coalesce("stored_at", F.lit(0).cast("timestamp"))).alias("value"))


def misses(prompts: DataFrame, cache: DataFrame) -> DataFrame:
    """One row of ``prompts`` per key that the cache lacks; null keys are dropped."""
    return prompts.where("key is not null").dropDuplicates(["key"]).join(cache.select("key").distinct(), "key", "left_anti")


def answered(prompts: DataFrame, cache: DataFrame) -> DataFrame:
    """``prompts`` with the cached ``value``, null where there is none."""
    return prompts.join(current(cache), "key", "left")


def append(rows: DataFrame, path: str) -> None:
    """Add (key, value) rows to the cache at ``path``; earlier files are never rewritten."""
    rows.select("key", "value", F.current_timestamp().alias("stored_at")).write.mode("append").parquet(path)


def compact(spark: SparkSession, path: str, to: str) -> None:
    """Write the current values to another folder, one row per key."""
    current(open_cache(spark, path)).select("key", "value", F.current_timestamp().alias("stored_at")).write.mode("overwrite").parquet(to)


def resume(files: DataFrame, progress: DataFrame, path_col: str = "path") -> tuple[DataFrame, DataFrame]:
    """Files still to process, and the stored rows of the others."""
    done = progress.join(files.select(path_col).distinct(), path_col, "left_semi")
    return files.join(progress.select(path_col).distinct(), path_col, "left_anti"), done

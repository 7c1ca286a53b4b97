"""The cache of replies as a keyed store: one row a key counts, the last one written.

Rows lie in a folder for each of the first two digits of their key, which is an MD5, so 256 of them
grow evenly.  Every append adds files with a later ``version``; reading keeps the latest row of a key.
Games look only into the folders that their keys can be in, and Spark filters what it scans there by
the games' keys.  ``compact`` replaces folders of several files by one with the rows that count.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.sources.tables import stored

COLUMNS = ["cache_key", "gpt_choice", "gpt_output"]
SCHEMA = "cache_key string, gpt_choice string, gpt_output string, version long, bucket string"


def _bucket(key: str = "cache_key"):
    return F.substring(key, 1, 2)


def append(rows: DataFrame, path: str) -> None:
    """Add rows ``cache_key, gpt_choice, gpt_output``; they count from now on for their keys."""
    later = rows.select(*COLUMNS).withColumn("version", F.lit(time.time_ns())).withColumn("bucket", _bucket())
    # A folder's rows come from one task, so that an append adds one file to it.
    later.repartition("bucket").write.mode("append").partitionBy("bucket").option("parquet.bloom.filter.enabled#cache_key", "true").parquet(path)


def _latest(rows: DataFrame) -> DataFrame:
    last = F.max(F.struct("version", "gpt_choice", "gpt_output")).alias("x")
    return rows.groupBy("bucket", "cache_key").agg(last).select("cache_key", "x.gpt_choice", "x.gpt_output", "x.version", "bucket")


def read(spark: SparkSession, path: str, games: DataFrame | None = None) -> DataFrame:
    """``cache_key, gpt_choice, gpt_output``, a row a key; with ``games(cache_key)`` only of folders that can have their keys."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    if games is not None:
        wanted = [r.b for r in games.select(_bucket().alias("b")).distinct().collect()]  # 256 at most
        rows = rows.where(F.col("bucket").isin(wanted)).join(games.select("cache_key").distinct(), "cache_key", "left_semi")
    return _latest(rows).select(*COLUMNS)


def compact(spark: SparkSession, path: str, files: int = 2) -> int:
    """Replace every folder of ``files`` files or more by one file; gives how many were.  Nothing may append meanwhile."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    parts = rows.select("bucket", F.col("_metadata.file_path").alias("f")).groupBy("bucket").agg(F.count_distinct("f").alias("n"))
    many = [r.bucket for r in parts.where(F.col("n") >= files).collect()]  # 256 at most
    if many:
        # The rows are safe in a table of their own before the folders are replaced.
        kept = stored(_latest(rows.where(F.col("bucket").isin(many))))
        writer = kept.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket")
        writer.option("parquet.bloom.filter.enabled#cache_key", "true").parquet(path)
    return len(many)

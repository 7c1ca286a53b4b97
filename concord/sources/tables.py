"""Intermediate tables in the shared folder, and places of rows in an order without a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.sources.sinks import scratch


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read again: lineage is cut, and lost executors lose nothing."""
    path = f"{scratch(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_order(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with a column ``name`` that numbers its rows from 0 in an order.

    The rows are sorted by ranges, each range in a task of its own; only how many rows each has comes
    to the driver, from which the ranges' first numbers follow.  Rows that are equal in ``order`` get
    any of their numbers.
    """
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = stored(df.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_at": at}))
    firsts, total = [], 0
    for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect():
        firsts.append((r["_part"], total))
        total += r.n
    starts = df.sparkSession.createDataFrame(firsts, "_part int, _first long")  # a row a task
    return rows.join(F.broadcast(starts), "_part").withColumn(name, F.col("_first") + F.col("_at")).drop("_part", "_at", "_first")

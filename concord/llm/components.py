"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import Table


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the node's least neighbour (itself included)."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and all its lesser neighbours are tied to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u")
    return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``; the root is the least node reachable.

    Rows never exceed the number of edges, every step is a partial minimum and an equi-join, and
    each round's edges are written to the shared folder, so lineage stays one round deep.  Null
    ends and loops are left out; an empty table gives an empty result.
    """
    now = Table(
        edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    mark = _mark(now.df)
    for _ in range(limit):
        if mark[0] == 0:
            break
        large = _large_star(now.df).distinct()
        after = Table(_small_star(large).where("u <> v").distinct(), "edges")
        now.drop()
        now, last, mark = after, mark, _mark(after.df)
        if mark == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    stars = now.df
    roots = stars.select(F.col("v").alias("node")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))


def least_ids(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """``(key, component_id)`` of every node ``(key, first)``: the least ``first`` of its component in ``found(node, root)``."""
    rooted = nodes.join(found.withColumnRenamed("node", "key"), "key", "left").select("key", "first", F.coalesce("root", "key").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("key", "component_id")

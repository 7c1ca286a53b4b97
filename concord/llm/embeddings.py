"""Near-duplicate embeddings: Euclidean p-stable hashing into several tables, then exact cosines.

Vectors of length 1 at cosine c are ``sqrt(2 - 2c)`` apart.  A projection on a normal vector, shifted
and cut into steps of ``WIDTH``, gives two vectors the same step with a known probability that falls
with their distance; ``depth`` steps together are a vector's bucket in one of several tables.
``depth`` grows with the logarithm of the number of vectors, so that buckets hold few unrelated ones
(those below a cosine of ``UNRELATED``), and the number of tables is what meets a pair at the threshold in
at least one of them with a probability of ``RECALL``; closer pairs meet more surely.

Equal vectors of one label are one node with a weight, so copies are never paired.  Buckets are cut
into pairs of bounded blocks, whose cosines are matrix products in double precision.  A pair that
meets in several tables counts in the first one only.  From a pair of blocks come the sum of links of
each vector and a star for each connected part, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, erf, exp, log, log1p, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.blocks import block_pairs, whole_runs
from concord.llm.common import Table, small_batches
from concord.llm.components import components, least_ids

COSINE, RECALL, UNRELATED, WIDTH, BLOCK, SEED = 0.98, 0.995, 0.5, 1.5, 512, 13


def same_step(cosine: float, width: float = WIDTH) -> float:
    """The probability that one projection puts two unit vectors of this cosine into the same step."""
    r = width / sqrt(2 - 2 * cosine)
    return erf(r / sqrt(2)) - 2 / (sqrt(2 * pi) * r) * (1 - exp(-r * r / 2))


def shape_for(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """``(depth, tables)`` for n vectors: chance buckets of some 64 vectors, pairs at the threshold found with ``recall``."""
    depth = max(8, ceil(log(max(n, 1) / 64 + 1) / -log(same_step(UNRELATED))))
    return depth, ceil(log(1 - recall) / log1p(-(same_step(cosine) ** depth)))


def _units(column: pa.Array) -> np.ndarray:
    """Vectors of one dimension as rows of length 1; scaled first, so that nothing under- or overflows."""
    rows = column.flatten().to_numpy().reshape(len(column), -1)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _hashed(nodes: DataFrame, depth: int, tables: int, seed: int) -> DataFrame:
    """``node, label, e, n, codes``: the bucket of every node in each table as a hash of its steps."""
    lines: dict[int, tuple] = {}

    def drawn(dim: int) -> tuple:
        if dim not in lines:
            rng = np.random.default_rng([seed, dim])
            lines[dim] = rng.standard_normal((dim, tables * depth)), rng.random(tables * depth) * WIDTH, rng.integers(1, 1 << 62, depth) * 2 + 1
        return lines[dim]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).value_lengths().to_numpy()
            for dim in np.unique(dims):
                own = batch.take(pa.array(np.flatnonzero(dims == dim)))
                for start in range(0, own.num_rows, 2048):
                    b = own.slice(start, 2048)
                    normal, shift, odd = drawn(int(dim))
                    steps = np.floor((_units(b.column(2)) @ normal + shift) / WIDTH).astype(np.int64)
                    codes = (steps.reshape(b.num_rows, tables, depth) * odd).sum(2)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * tables), pa.array(codes.ravel()))
                    yield pa.record_batch([*(b.column(k) for k in range(4)), lists], names=["node", "label", "e", "n", "codes"])

    return nodes.select("node", "label", "e", "n").mapInArrow(run, "node long, label string, e array<double>, n long, codes array<long>")


def _parts(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each of n members' connected parts, by links i to j."""
    of = np.arange(n)
    while True:
        before = of.copy()
        np.minimum.at(of, i, before[j])
        np.minimum.at(of, j, before[i])
        of = of[of]
        if (of == before).all():
            return of


def _compared(met: DataFrame, cosine: float) -> DataFrame:
    """``u, v, links``: for nodes with links, the weights of the linked nodes and one node of their part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, cuts in whole_runs(batches):
            number = lambda name: b.column(b.schema.get_field_index(name)).to_numpy()
            node, n, table, own, lo, hi = (number(c) for c in ("node", "n", "t", "own", "lo", "hi"))
            vectors, lists = b.column(b.schema.get_field_index("e")), b.column(b.schema.get_field_index("codes"))
            codes = lists.flatten().to_numpy().reshape(b.num_rows, -1)
            dims, us, vs, links = vectors.value_lengths().to_numpy(), [], [], []
            for s, e in zip(cuts[:-1], cuts[1:]):
                # Runs are told apart by a hash; rows that only share that are not compared.
                for dim in np.unique(dims[s:e]):
                    at = s + np.flatnonzero(dims[s:e] == dim)
                    if len(at) < 2:
                        continue
                    unit = _units(vectors.take(pa.array(at)))
                    i, j = np.nonzero(np.triu(unit @ unit.T >= cosine, 1))
                    x, y, t = at[i], at[j], table[at[i]]
                    good = (t == table[y]) & (lo[x] == lo[y]) & (hi[x] == hi[y]) & ((own[x] != own[y]) | (lo[x] == hi[x]))
                    good &= codes[x, t] == codes[y, t]
                    i, j, x, y, t = i[good], j[good], x[good], y[good], t[good]
                    first = ((codes[x] == codes[y]) & (np.arange(codes.shape[1]) < t[:, None])).any(1)
                    i, j = i[~first], j[~first]
                    if not len(i):
                        continue
                    total = np.bincount(i, n[at[j]], len(at)) + np.bincount(j, n[at[i]], len(at))
                    part, some = _parts(len(at), i, j), np.flatnonzero(total)
                    us.append(node[at[some]])
                    vs.append(node[at[part[some]]])
                    links.append(total[some].astype(np.int64))
            if us:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in (us, vs, links)], names=["u", "v", "links"])

    columns = ["run", "t", "own", "lo", "hi", "node", "n", "e", "codes"]
    return met.select(columns).repartition("run").sortWithinPartitions("run").mapInArrow(run, "u long, v long, links long")


def _usable(e: Column, label: Column) -> Column:
    """Whether a vector can have links: it and its label are there, all components are finite and one is not 0."""
    broken = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(label.isNotNull() & e.isNotNull() & ~broken & F.exists(e, lambda x: x != 0), F.lit(False))


def near_vectors(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    cosine: float = COSINE, recall: float = RECALL, block: int = BLOCK, seed: int = SEED,
) -> DataFrame:
    """``id, n_links, component_id, kept`` for every row; other columns are ignored.

    Vectors are compared only within a label and a dimension.  Rows whose vector or label is null, or
    whose vector is zero, empty or holds a null or not finite component, have no link and are their
    own component.  Repeated rows are vectors like any others, linked to each other.  A component's id is
    its least id that is not null, null if it has none; rows that have their component's id are kept.
    """
    spark = rows.sparkSession
    small_batches(spark)
    all_rows = rows.select(rows[id_col].cast("long").alias("id"), rows[label_col].cast("string").alias("label"), rows[vector_col].cast("array<double>").alias("e"))
    usable = _usable(F.col("e"), F.col("label"))
    grouped = all_rows.where(usable).groupBy("label", "e").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    # Numbers are fixed when the table is written.
    nodes = Table(grouped.select(F.monotonically_increasing_id().alias("node"), "label", "e", "first", "n"), "nodes")
    depth, tables = shape_for(nodes.df.count(), cosine, recall)
    hashed = Table(_hashed(nodes.df, depth, tables, seed), "codes")
    posts = hashed.df.select("node", F.posexplode("codes").alias("t", "code"), "label", F.size("e").alias("dim"))
    posts = posts.select("node", "t", F.xxhash64("label", "dim", "t", "code").alias("key"))
    met = block_pairs(posts, "key", "node", block).join(hashed.df.select("node", "n", "e", "codes"), "node")
    pairs = Table(_compared(met, cosine), "links")
    hashed.drop()
    links = pairs.df.groupBy("u").agg(F.sum("links").alias("links")).withColumnRenamed("u", "key")
    found = components(pairs.df.select("u", "v"))
    of_node = least_ids(nodes.df.select(F.col("node").alias("key"), "first"), found).join(links, "key", "left").withColumnRenamed("key", "node")
    own = nodes.df.select("node", F.col("label").alias("label2"), F.col("e").alias("e2"), "n").join(of_node, "node")
    own = Table(own.select("label2", "e2", F.lit(True).alias("known"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "near")
    for x in (nodes, pairs):
        x.drop()
    joined = all_rows.withColumn("usable", usable).join(own.df, F.col("usable") & (F.col("label") == F.col("label2")) & (F.col("e") == F.col("e2")), "left")
    root = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("id"))
    out = joined.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def near_vectors_sql() -> str:
    """All pairs of ``embeddings`` in DuckDB's SQL, which agrees unless the tables miss a pair."""
    return f"""
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
        ), u AS (
            SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS size FROM v
            WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
        ), link AS MATERIALIZED (
            SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
            WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= {COSINE}
        ), reach(a, b) AS (
            SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
        ), least AS (
            SELECT a, min(b) AS b FROM reach GROUP BY a
        ), counted AS (
            SELECT a, count(*) AS n FROM link GROUP BY a
        )
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(least.b, vec_id))::BIGINT AS component_id,
               vec_id <= coalesce(least.b, vec_id) AS kept
        FROM v LEFT JOIN least ON least.a = vec_id LEFT JOIN counted ON counted.a = vec_id
    """

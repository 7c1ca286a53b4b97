"""Average linkage over weighted signatures, flat cuts, and what judges a clustering.

A cluster is its number of rows and, for each model, how often it has each label.  The summed
disagreement of two clusters follows from these: ``models * n1 * n2`` less the sum over labels of the
products of their counts.  So no table of pairs is ever made: distances are matrix products of label
counts, the height of two clusters is their summed disagreement over ``n1 * n2``, and sums of whole
numbers do not drift (they are exact in double precision below 2**53).

Ties go to the pair whose first rows come first.  Two clusters that are each other's nearest in this
order stay so until they merge, whatever else merges (average linkage is reducible, and a merged
cluster keeps the lesser of its numbers), so all such pairs merge at once and the tree is exactly that
of one merge at a time.  Rounds of this go on until ``local_clusters`` are left, which one task links.

All functions take tables of several draws, told apart by the columns in ``by``, and do them at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.config import DEFAULTS
from concord.sources.tables import in_order, stored

BLOCK, WIDTH = 1024, 2048


def merges_of(codes: np.ndarray, weights: np.ndarray) -> list[tuple[int, int, float]]:
    """The merges of a weighted UPGMA over rows of label codes; ``b`` joins ``a``, and a < b."""
    w = weights.astype(np.float64)
    sums = np.zeros((len(w), len(w)))
    for column in codes.T:
        sums += column[:, None] != column
    return _merges(sums * (w[:, None] * w), w)


def _merges(sums: np.ndarray, size: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges from the summed disagreements of clusters in order of their first rows.

    Each row keeps its nearest later row; only rows that lose theirs are searched again.
    """
    n = len(size)
    size, alive = size.copy(), np.ones(n, bool)
    near, best = np.full(n, -1), np.full(n, np.inf)

    def search(i: int) -> None:
        later = np.flatnonzero(alive[i + 1 :]) + i + 1
        if not len(later):
            best[i] = np.inf
            return
        h = sums[i, later] / (size[i] * size[later])
        k = int(np.argmin(h))
        near[i], best[i] = later[k], h[k]

    for i in range(n):
        search(i)
    out = []
    for _ in range(n - 1):
        a = int(np.argmin(best))
        b = int(near[a])
        out.append((a, b, float(best[a])))
        sums[a] += sums[b]
        sums[:, a] += sums[:, b]
        size[a] += size[b]
        alive[b] = False
        best[b] = np.inf
        search(a)
        for i in np.flatnonzero(alive[:b]):
            if i == a:
                continue
            if near[i] in (a, b):
                search(i)
            elif i < a:
                h = sums[i, a] / (size[i] * size[a])
                if h < best[i] or (h == best[i] and a < near[i]):
                    near[i], best[i] = a, h
    return out


def _products(rows: np.ndarray, keys: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """For all pairs of n clusters the sum over labels of the products of their counts, from entries ``(row, key, count)``."""
    _, column = np.unique(keys, return_inverse=True)
    out, width = np.zeros((n, n)), int(column.max(initial=-1)) + 1
    for start in range(0, width, WIDTH):
        some = (column >= start) & (column < start + WIDTH)
        dense = np.zeros((n, min(WIDTH, width - start)))
        np.add.at(dense, (rows[some], column[some] - start), counts[some])
        out += dense @ dense.T
    return out


def _clusters(sigs: DataFrame, by: list[str]) -> DataFrame:
    """``by, c, n, labels``: every signature as a cluster, its labels a map from a hash of model and label to rows."""
    w = F.col("w").cast("double")
    entries = F.transform("sig", lambda x, k: F.struct(F.xxhash64(k, x.isNull(), x).alias("key"), w.alias("n")))
    return sigs.select(*by, F.col("sid").alias("c"), w.alias("n"), F.map_from_entries(entries).alias("labels"), F.size("sig").alias("models"))


def _entries(labels: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, key, count)`` of a column of maps."""
    sizes = np.diff(labels.offsets.to_numpy())
    first = labels.offsets[0].as_py()
    keys, counts = (x.slice(first, sizes.sum()).to_numpy() for x in (labels.keys, labels.items))
    return np.repeat(np.arange(len(sizes)), sizes), keys, counts


def _sums(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Summed disagreements of all pairs of a batch's clusters, and the clusters' sizes."""
    column = lambda name: b.column(b.schema.get_field_index(name))
    n, models = column("n").to_numpy(), column("models").to_numpy()
    return models[:, None] * (n[:, None] * n) - _products(*_entries(column("labels")), len(n)), n


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Sorted batches cut into one for each run of equal values of ``columns``."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(b.schema.get_field_index(c)).to_numpy() for c in columns], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), b.num_rows]
        for s, e in zip(cuts[:-1], cuts[1:]):
            if held and (keys[s] != last).any():
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(b.slice(s, e - s))
            last = keys[s]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _nearest(now: DataFrame, by: list[str], blocks: int) -> DataFrame:
    """``by, c, best (height, other)``: every cluster's nearest, of equally near ones the first, by pairs of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _runs(batches, [*by, "lo", "hi"]):
            column = lambda name: b.column(b.schema.get_field_index(name))  # noqa: B023, E731
            c, own, lo, hi = (column(x).to_numpy() for x in ("c", "own", "lo", "hi"))
            order = np.argsort(c)
            sums, n = _sums(b.take(pa.array(order)))
            h = sums / (n[:, None] * n)
            np.fill_diagonal(h, np.inf)
            c, own = c[order], own[order]
            if lo[0] != hi[0]:
                h[own[:, None] == own] = np.inf
            h = np.minimum(h, h.T)
            other = h.argmin(1)
            found = h[np.arange(len(c)), other]
            there = np.flatnonzero(np.isfinite(found))
            yield pa.record_batch([*(column(x).take(pa.array(order[there])) for x in by), pa.array(c[there]), pa.array(found[there]), pa.array(c[other[there]])], names=[*by, "c", "height", "other"])

    rows = now.withColumn("own", F.pmod(F.xxhash64("c"), F.lit(blocks)).cast("int")).withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.withColumns({"lo": F.least("own", "_to"), "hi": F.greatest("own", "_to")}).drop("_to")
    # Little data makes much work here, so as many tasks as there are pairs of blocks, up to some.
    tasks = min(blocks * (blocks + 1) // 2, 4 * now.sparkSession.sparkContext.defaultParallelism)
    dealt = rows.repartition(max(1, tasks), *by, "lo", "hi").sortWithinPartitions(*by, "lo", "hi")
    found = dealt.mapInArrow(run, ", ".join([*(f"{x} int" for x in by), "c long", "height double", "other long"]))
    return found.groupBy(*by, "c").agg(F.min(F.struct("height", "other")).alias("best"))


def _merged(now: DataFrame, pairs: DataFrame, by: list[str]) -> DataFrame:
    """The clusters after the merges ``by, a, b``."""
    gone = now.join(pairs.select(*by, F.col("b").alias("c"), F.col("a").alias("into")), [*by, "c"])
    gone = gone.select(*by, F.col("into").alias("c"), F.col("n").alias("n2"), F.col("labels").alias("labels2"))
    left = now.join(pairs.select(*by, F.col("b").alias("c")), [*by, "c"], "left_anti").join(gone, [*by, "c"], "left")
    both = F.map_zip_with("labels", "labels2", lambda _, x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))
    return left.select(*by, "c", (F.col("n") + F.coalesce("n2", F.lit(0.0))).alias("n"), F.when(F.col("n2").isNull(), F.col("labels")).otherwise(both).alias("labels"), "models")


def _most(df: DataFrame, by: list[str]) -> int:
    """Rows of the largest draw."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def dendrogram(sigs: DataFrame, by: tuple[str, ...] = (), local: int = DEFAULTS.local_clusters, block: int = BLOCK) -> DataFrame:
    """``by, step, a, b, height`` of every merge of ``signatures``: ``b`` joins ``a``, and a < b.

    The columns ``by`` are integers.  Labels are told apart by 64-bit hashes.
    """
    by = list(by)

    def link(key: tuple, table: pa.Table) -> pa.Table:
        b = table.sort_by("c").combine_chunks().to_batches()
        columns = {x: [] for x in [*by, "step", "a", "b", "height"]}
        if b:
            (b,) = b
            c = b.column(b.schema.get_field_index("c")).to_numpy()
            found = _merges(*_sums(b))
            columns |= {"step": range(len(found)), "a": [c[x] for x, _, _ in found], "b": [c[x] for _, x, _ in found], "height": [x for _, _, x in found]}
            columns |= {x: [k.as_py()] * len(found) for x, k in zip(by, key)}
        return pa.table(columns, schema=pa.schema([*((x, pa.int32()) for x in by), ("step", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("height", pa.float64())]))

    schema = ", ".join([*(f"{x} int" for x in by), "step long, a long, b long, height double"])
    now, rounds = _clusters(sigs, by), []
    while (most := _most(now, by)) > local:
        near = stored(_nearest(now, by, ceil(most / block)).select(*by, "c", F.col("best.height").alias("height"), F.col("best.other").alias("other")))
        back = near.select(*by, F.col("c").alias("other"), F.col("other").alias("c"))
        pairs = stored(near.join(back, [*by, "c", "other"]).where("c < other").select(*by, F.col("c").alias("a"), F.col("other").alias("b"), "height"))
        rounds.append(pairs)
        now = stored(_merged(now, pairs, by))
    last = now.groupBy(*(by or [F.lit(1).alias("_one")])).applyInArrow(link, schema)
    if not rounds:
        return last
    # The rounds find merges out of order; in that of heights, then of first rows, it is one merge at a time.
    every = reduce(DataFrame.unionByName, [*rounds, last.drop("step")])
    steps = in_order(every, [F.col(x) for x in [*by, "height", "a", "b"]], "step")
    if by:
        starts = steps.groupBy(*by).agg(F.min("step").alias("_start"))
        steps = steps.join(starts, by).withColumn("step", F.col("step") - F.col("_start"))
    return steps.select(*by, "step", "a", "b", "height")


def cut(sigs: DataFrame, tree: DataFrame, ks: list[int], by: tuple[str, ...] = (), local: int = DEFAULTS.local_clusters) -> DataFrame:
    """``by, k, sid, cluster`` for every k, from one dendrogram; clusters are numbered by first row, from 0.

    With fewer tuples than k every tuple is its own cluster.  Trees of more than ``local`` tuples are
    followed to the most clusters asked for by doubling steps, and from there, where only as many
    clusters are left, like small ones.
    """
    by, most = list(by), max(ks, default=1)

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids, right = np.sort(left["sid"].to_numpy()), right.sort_values("step")
        a, b, out = np.searchsorted(ids, right["a"]), np.searchsorted(ids, right["b"]), []
        for k in ks:
            of = np.arange(len(ids))
            for x, y in zip(a[: max(0, len(ids) - k)], b[: max(0, len(ids) - k)]):
                of[of == y] = x
            _, number = np.unique(of, return_inverse=True)
            out.append(pd.DataFrame({**dict(zip(by, key)), "k": k, "sid": ids, "cluster": number}))
        return pd.concat(out) if out and len(ids) else pd.DataFrame(columns=[*by, "k", "sid", "cluster"])

    schema = ", ".join([*(f"{x} int" for x in by), "k int, sid long, cluster int"])
    keys = by or [F.lit(1).alias("_one")]
    if _most(sigs, by) <= max(local, most):
        return sigs.select(*by, "sid").groupBy(*keys).cogroup(tree.groupBy(*keys)).applyInPandas(run, schema)
    sizes = sigs.groupBy(*(by or [F.lit(1).alias("_one")])).agg(F.count(F.lit(1)).alias("_n"))
    steps = tree.join(sizes, by) if by else tree.crossJoin(F.broadcast(sizes.drop("_one")))  # one row
    low = F.col("step") < F.col("_n") - most
    up = stored(steps.where(low).select(*by, F.col("b").alias("sid"), F.col("a").alias("root")))
    while True:
        ahead = up.select(*by, F.col("sid").alias("root"), F.col("root").alias("_next"))
        up = stored(up.join(ahead, [*by, "root"], "left").select(*by, "sid", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        if up.where("_moved").isEmpty():
            break
        up = up.drop("_moved")
    roots = stored(sigs.select(*by, "sid").join(up.drop("_moved"), [*by, "sid"], "left").select(*by, "sid", F.coalesce("root", "sid").alias("root")))
    tops = roots.select(*by, F.col("root").alias("sid")).distinct()
    few = tops.groupBy(*keys).cogroup(steps.where(~low).select(*by, "step", "a", "b").groupBy(*keys)).applyInPandas(run, schema)
    return roots.join(few.withColumnRenamed("sid", "root"), [*by, "root"]).select(*by, "k", "sid", "cluster")


def _counts(sigs: DataFrame, cuts: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """``by, k, cluster, m, label, hit``: rows of every cluster with each label; and ``by, k, cluster, n``: its rows."""
    rows = sigs.join(cuts, [*by, "sid"])
    cells = rows.select(*by, "k", "cluster", "w", F.posexplode("sig").alias("m", "label"))
    return cells.groupBy(*by, "k", "cluster", "m", "label").agg(F.sum("w").alias("hit")), rows.groupBy(*by, "k", "cluster").agg(F.sum("w").alias("n"))


def silhouette(sigs: DataFrame, cuts: DataFrame, models: int, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, k, silhouette``: mean over rows of (b - a) / max(a, b), 0 for rows alone in their cluster.

    A tuple's summed disagreement with a cluster of n rows is the sum over models of n less the rows
    with its label.  A cluster that shares no label with it is at the distance ``models``, the greatest.
    """
    by = list(by)
    hits, sizes = _counts(sigs, cuts, by)
    cells = sigs.select(*by, "sid", F.posexplode("sig").alias("m", "label"))
    there = hits.select(*by, "k", "cluster", F.col("m").alias("m2"), F.col("label").alias("label2"), "hit")
    same = [F.col(x) == F.col(f"{x}2") for x in by] + [F.col("m") == F.col("m2"), F.col("label").eqNullSafe(F.col("label2"))]
    met = cells.join(there.withColumnsRenamed({x: f"{x}2" for x in by}), reduce(Column.__and__, same))
    shared = met.groupBy(*by, "k", "sid", "cluster").agg(F.sum("hit").alias("hit")).join(sizes, [*by, "k", "cluster"])
    own = cuts.withColumnRenamed("cluster", "own")
    d = F.lit(models) * F.col("n") - F.col("hit")
    mine = F.col("cluster") == F.col("own")
    per = shared.join(own, [*by, "k", "sid"]).groupBy(*by, "k", "sid").agg(
        F.max(F.when(mine, F.col("n"))).alias("n"),
        F.max(F.when(mine & (F.col("n") > 1), d / (F.col("n") - 1))).alias("a"),
        F.min(F.when(~mine, d / F.col("n"))).alias("b"),
        F.count(F.lit(1)).alias("met"),
    )
    every = sizes.groupBy(*by, "k").agg(F.count(F.lit(1)).alias("clusters"))
    per = per.join(every, [*by, "k"]).join(sigs.select(*by, "sid", "w"), [*by, "sid"])
    b = F.when(F.col("clusters") > F.col("met"), F.least("b", F.lit(float(models)))).otherwise(F.col("b"))
    top = F.greatest("a", b)
    s = F.when((F.col("n") > 1) & (top > 0), (b - F.col("a")) / top).otherwise(0.0)
    return per.groupBy(*by, "k").agg(F.round(F.sum(F.col("w") * s) / F.sum("w"), 9).alias("silhouette"))


def dispersion(sigs: DataFrame, cuts: DataFrame, models: int, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, k, wk``: the sum over clusters of all their distances over twice their rows."""
    by = list(by)
    hits, sizes = _counts(sigs, cuts, by)
    alike = hits.groupBy(*by, "k", "cluster").agg(F.sum(F.col("hit").cast("double") * F.col("hit")).alias("alike"))
    n = F.col("n").cast("double")
    d = (F.lit(models) * n * n - F.col("alike")) / (2.0 * models * n)
    return alike.join(sizes, [*by, "k", "cluster"]).groupBy(*by, "k").agg(F.round(F.sum(d), 9).alias("wk"))


def best_silhouette(scores: DataFrame) -> DataFrame:
    """The row of the best score, the least k of equals."""
    return scores.orderBy(F.desc("silhouette"), "k").limit(1)


def drawn(sigs: DataFrame, draws: int, seed: int = DEFAULTS.sample_seed) -> DataFrame:
    """``draw, sid, sig, w``: the signatures as they are (draw 0), and in ``draws`` other orders, by MD5 of seed and place."""
    n = sigs.count()
    rows = sigs.select(F.explode(F.sequence(F.lit(0), F.lit(draws))).alias("draw"), "sid", "sig", "w")
    digest = F.when(F.col("draw") > 0, F.md5(F.concat_ws("_", (F.col("draw") + F.lit(seed - 1)).cast("string"), F.col("sid").cast("string"))))
    placed = in_order(rows, [F.col("draw"), digest, F.col("sid")], "_place")
    return placed.select("draw", (F.col("_place") - F.col("draw") * F.lit(n)).cast("long").alias("sid"), "sig", "w")


def gap(sigs: DataFrame, ks: list[int], models: int, draws: int = DEFAULTS.reference_draws, local: int = DEFAULTS.local_clusters) -> DataFrame:
    """``k, gap``: mean log dispersion of reference clusterings less that of the data; all draws are linked at once.

    A reference is the data in another order, which leaves all distances as they are.  The gap is
    therefore 0 but for how ties fall, and should not be used to choose k; it is here for parity.
    """
    by, rows = ("draw",), drawn(sigs, draws)
    cuts = cut(rows, dendrogram(rows, by, local), ks, by, local)
    logs = dispersion(rows, cuts, models, by).select("draw", "k", F.log(F.col("wk") + F.lit(1e-10)).alias("x"))
    own, refs = F.max(F.when(F.col("draw") == 0, F.col("x"))), F.avg(F.when(F.col("draw") > 0, F.col("x")))
    return logs.groupBy("k").agg(F.round(refs - own, 9).alias("gap"))


def consensus(matrix: DataFrame, models: list[str], sigs: DataFrame, cuts: DataFrame, keys: list[str], name: str = "consensus_label") -> DataFrame:
    """``keys`` and the consensus label of every row, joined through its signature."""
    sig = F.array(*[F.col(m).cast("string") for m in models])
    label = sigs.join(cuts, "sid").select(F.col("sig").alias("sig2"), F.col("cluster").alias(name))
    rows = matrix.withColumn("sig", sig)
    return rows.join(label, F.col("sig").eqNullSafe(F.col("sig2"))).select(*keys, name)


def adjusted_rands(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``a, b, ari`` of each pair of labelings: agreement beyond chance, rows without either left out; 1 if neither splits.

    All pairs are counted in one pass over the rows; a pair without rows has null.
    """
    label = lambda c: F.col(f"`{c}`").cast("string")
    sides = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), label(a).alias("x"), label(b).alias("y")) for a, b in pairs])
    cells = df.select(F.inline(sides)).where("x IS NOT NULL AND y IS NOT NULL").groupBy("a", "b", "x", "y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    # Cells, and their sums by either label, in one aggregation of several groupings.
    sums = cells.groupingSets([["a", "b", "x", "y"], ["a", "b", "x"], ["a", "b", "y"], ["a", "b"]], "a", "b", "x", "y").agg(F.sum("n").alias("n"), F.grouping("x").alias("no_x"), F.grouping("y").alias("no_y"))
    two = F.col("n") * (F.col("n") - 1) / 2
    part = lambda x, y, value: F.sum(F.when((F.col("no_x") == x) & (F.col("no_y") == y), value))
    met = sums.groupBy("a", "b").agg(part(0, 0, two).alias("c"), part(0, 1, two).alias("pa"), part(1, 0, two).alias("pb"), part(1, 1, two).alias("every"))
    asked = df.sparkSession.createDataFrame(list(dict.fromkeys(pairs)), "a string, b string")
    expected = F.col("pa") * F.col("pb") / F.nullif("every", F.lit(0.0))
    top = (F.col("pa") + F.col("pb")) / 2 - expected
    ari = F.when((F.col("every") == 0) | (top == 0), 1.0).otherwise((F.col("c") - expected) / F.nullif(top, F.lit(0.0)))
    return asked.join(met, ["a", "b"], "left").select("a", "b", F.round(ari, 9).alias("ari"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``ari``: that of one pair of labelings."""
    return adjusted_rands(df, [(a, b)]).select("ari")

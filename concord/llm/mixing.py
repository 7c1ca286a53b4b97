"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size gives every document of it a fractional number of copies.
Its whole part is sure.  The fractions are rounded together: the longest fractional document of a
group is paired with all shorter ones as one partner.  By a fair draw one side gains words and the
other loses as many, the partner's by an equal change of all its members' fractions, until a
document of either side is integral.  So every document keeps its expectation, the group keeps its
sum, long documents are decided while the short ones can still make up for them, and what is left
over is a short document wherever that is possible.

Documents are dealt into buckets of about ``bucket`` rows by a hash; each bucket leaves at most one
fractional document, and these meet again in a tree of ``fan`` buckets to one until one is left, together
with a dozen decided documents of each, from its median length to its shortest.  Its
own draw decides it.  In a source with few documents that one may be long, and the words that the
draw adds or takes are then dealt in the same way, as fractions of a copy, over documents of the
group that are no longer than what is missing, until less is missing than the shortest of them has
or than ``NEAR`` of the target.  No document gets more than ``most`` copies.

No task sees more than a bucket's rows, however large a source is, and each holds only one at a time.
Rows that agree in id, source and text are one row with a count until the end, so that no number of
repeated rows makes a bucket large.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.common import WORD, Table, text_of

WEIGHTS, SHARE, MOST, SEED, NEAR = (5, 2, 1), 1.5, 2.0, 20240501, 0.001
_EPS = 1e-9


def n_words(text: Column) -> Column:
    """Maximal runs of anything but ASCII white space."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``(source, docs, source_size, target)`` from ``(source, size)`` rows.

    Sources in order of code points, null last, take the weights in turn.  ``share`` of all words
    is dealt by weight; a source stops at ``most`` times its size and the excess goes to the rest
    by weight, until none is above.  Each round is one aggregate over the sources.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    # Ranges of sources in order: a source's place is its own in the range after all those of earlier ranges.
    ranges = Table(total.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "ranges")
    counts = ranges.df.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row per range
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = ranges.df.withColumn("own", own).join(before, "part").select("source", "source_size", "docs", (F.col("own") + F.col("before")).alias("place"))
    turn = F.lit(list(map(float, weights)))[(F.col("place") % len(weights)).cast("int")]
    table = Table(ranked.withColumn("weight", turn), "sources")
    ranges.drop()
    most_words = F.col("source_size") * F.lit(most)
    rate, words, before = math.inf, (table.df.agg(F.sum("source_size")).first()[0] or 0) * share, -1
    while words:
        capped = most_words < F.col("weight") * F.lit(rate) if before >= 0 else F.lit(False)
        sure, heavy, n = table.df.agg(
            F.sum(F.when(capped, most_words)), F.sum(F.when(~capped, F.col("weight"))), F.count(F.when(capped, 1))
        ).first()
        if not heavy or n == before:
            break
        rate, before = (words - (sure or 0.0)) / heavy, n
    target = F.least(most_words, F.col("weight") * F.lit(rate)) if words else F.lit(0.0)
    return table.df.select("source", "docs", "source_size", target.alias("target"))


def _draw(seed: int, *keys) -> float:
    return xxhash.xxh64_intdigest("|".join(map(str, keys)), seed) / 2.0**64


def _open(p: np.ndarray) -> np.ndarray:
    return (p > _EPS) & (p < 1 - _EPS)


def settled(sizes: np.ndarray, p: np.ndarray, draw: Callable[[int], float]) -> tuple[np.ndarray, int | None]:
    """Fractions ``p`` of documents, the longest first, rounded by pivotal steps; and which one stays fractional, if any.

    A step pairs the first fractional document with all later ones.  ``draw(k)`` is the k-th step's
    draw, uniform in 0 to 1.  The sum of ``p * sizes`` is kept, and so is each one's expectation.
    """
    p = np.where(p < _EPS, 0.0, np.where(p > 1 - _EPS, 1.0, p))
    alive, k = np.flatnonzero(_open(p)), 0
    while len(alive) > 1:
        lead, rest = alive[0], alive[1:]
        a, words, own = sizes[lead], sizes[rest].sum(), p[rest]
        up, down = min((1 - p[lead]) * a, own.min() * words), min(p[lead] * a, (1 - own.max()) * words)
        move = up if draw(k) * (up + down) < down else -down
        p[lead] += move / a
        p[rest] -= move / words
        x = p[alive]
        p[alive] = np.where(x < _EPS, 0.0, np.where(x > 1 - _EPS, 1.0, x))
        alive, k = alive[_open(p[alive])], k + 1
    return p, int(alive[0]) if len(alive) else None


def finished(sizes: np.ndarray, copies: np.ndarray, most: np.ndarray, last: int | None, p: float, near: float, draw: Callable[[int, int], float]) -> np.ndarray:
    """Whole ``copies`` after the last fractional document's draw, and after making up for what that draw added or took.

    Document ``last`` has ``p`` of a copy beside its ``copies``.  The words that its draw adds or takes
    are dealt by ``settled`` over documents no longer than that which have a copy to lose or room
    (under ``most``) for one; these leave one fractional document again, and so on.
    """
    copies, sign, turn = copies.copy(), 1, 0
    while last is not None:
        took = draw(turn, -1) < p
        excess = sign * ((1 - p) if took else -p) * sizes[last]
        copies[last] += sign * took
        turn, sign = turn + 1, -1 if excess > 0 else 1
        room = copies > 0 if sign < 0 else copies < most
        group = np.flatnonzero(room & (sizes > 0) & (sizes <= abs(excess)))
        if abs(excess) <= near or not len(group):
            break
        share = min(1.0, abs(excess) / sizes[group].sum())
        own, left = settled(sizes[group], np.full(len(group), share), lambda k, t=turn: draw(t, k))
        copies[group] += sign * (own > 0.5) * ~_open(own)
        last, p = (None, 0.0) if left is None else (int(group[left]), float(own[left]))
    return copies


def _round(level: int, fan: int, most: float, seed: int):
    """Round sorted rows, group by group; what stays fractional comes out as the group's residual, unless the group is the source's last."""

    def settle(rows: list[dict]) -> list[dict]:
        sizes, p = (np.array([r[k] for r in rows], float) for k in ("size", "p"))
        key = (level, rows[0]["place"], rows[0]["bucket"], rows[0]["id"], rows[0]["tie"])
        p, last = settled(sizes, np.where(sizes > 0, p, 0.0), lambda k: _draw(seed, *key, k))
        if rows[0]["buckets"] <= fan**level:
            copies, left = np.array([r["whole"] for r in rows], np.int64), 0.0 if last is None else p[last]
            copies += (p > 0.5) & ~_open(p)
            room = np.array([int(r["n"] * most) for r in rows])
            copies = finished(sizes, copies, room, last, left, NEAR * rows[0]["target"], lambda t, k: _draw(seed, *key, t, k))
            return [r | {"whole": int(c), "p": 0.0, "done": True} for r, c in zip(rows, copies)]
        written = int((sizes > 0).sum())
        spare = {written - 1 - (written >> j) for j in range(1, 13)} | {written - 1}
        return [r | {"p": float(x), "done": k != last and k not in spare} for k, (r, x) in enumerate(zip(rows, p))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if held and (row["place"], row["bucket"]) != (held[0]["place"], held[0]["bucket"]):
                    out += settle(held)
                    held = []
                held.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema)
        if held:
            yield pa.RecordBatch.from_pylist(settle(held), schema=batch.schema)

    return run


def _taken(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST,
    seed: int = SEED, bucket: int = 4096, fan: int = 64,
) -> DataFrame:
    """``id, place, tie, size, source_size, target, n, total`` for all rows that agree in id, source and text: how many, and their copies."""
    text = text_of(docs, text_col)
    sizes = docs.select(
        docs[id_col].cast("long").alias("id"), docs[source_col].cast("string").alias("source"), n_words(text).alias("size"), F.xxhash64(text).alias("tie")
    )
    sizes = Table(sizes, "sizes")
    goal = Table(targets(sizes.df, weights, share, most), "targets")
    per = goal.df.withColumn("place", F.xxhash64(F.col("source").isNull(), "source"))
    per = per.select("place", F.col("source").alias("s"), "docs", "source_size", "target")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    same = sizes.df.groupBy("id", "source", "size", "tie").agg(F.count(F.lit(1)).alias("n"))
    wide = same.join(per, F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", F.when(F.col("size") > 0, copies * F.col("n")).otherwise(0.0))
    rows = wide.select(
        "id", "tie", "n", "size", "source_size", "target", "place",
        F.floor("copies").alias("whole"), (F.col("copies") - F.floor("copies")).alias("p"),
        F.pmod(F.xxhash64("id", "tie", F.lit(seed)), F.ceil(F.col("docs") / bucket)).alias("bucket"),
        F.ceil(F.col("docs") / bucket).alias("buckets"), F.lit(False).alias("done"),
    )
    buckets = math.ceil((goal.df.agg(F.max("docs")).first()[0] or 1) / bucket)
    done = []
    for level in range(math.ceil(math.log(buckets, fan) - 1e-9) + 1):
        dealt = rows.repartition("place", "bucket").sortWithinPartitions("place", "bucket", F.desc("size"), F.xxhash64("id", "tie", F.lit(seed + level)), "id", "tie")
        table = Table(dealt.mapInArrow(_round(level, fan, most, seed), dealt.schema), "rounded")
        done.append(table.df.where("done"))
        rows = table.df.where("NOT done").withColumn("bucket", F.floor(F.col("bucket") / fan))
    for x in (sizes, goal):
        x.drop()
    total = F.col("whole") + F.round("p").cast("long")
    return reduce(DataFrame.unionByName, done).select("id", "place", "tie", "size", "source_size", "target", "n", total.alias("total"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``id, place, tie, size, source_size, target, copies`` for every row of ``docs``.

    Null texts and texts without a word have size 0 and no copies; a null source is a source of
    its own, the last; ids may be null or repeat; rows that agree in id, source and text share
    their copies as evenly as they go (``tie`` tells texts apart, ``place`` sources).  All draws are
    hashes of the rows that meet, so reruns agree whatever the partitioning.  Other columns are
    ignored.  Options: ``weights, share, most, seed, bucket, fan``.
    """
    taken = _taken(docs, id_col, text_col, source_col, **options)
    # Long runs of equal rows come as pieces of at most 10,000.
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 10_000)))
    pieces = taken.withColumn("piece", piece)
    turns = F.sequence(F.col("piece") * 10_000, F.least(F.col("n"), (F.col("piece") + 1) * 10_000) - 1)
    each = pieces.withColumn("turn", F.explode(turns))
    copies = F.floor(F.col("total") / F.col("n")) + F.when(F.col("turn") < F.col("total") % F.col("n"), 1).otherwise(0)
    return each.select("id", "place", "tie", "size", "source_size", "target", copies.alias("copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with all its columns."""
    per = _taken(docs, id_col, text_col, source_col, **options).where("total > 0").select("id", "place", "tie", "n", "total")
    names = [f"_{k}" for k in range(len(docs.columns))]
    own = dict(zip(docs.columns, names))
    source = F.col(own[source_col]).cast("string")
    keyed = docs.toDF(*names).withColumns(
        {"id_": F.col(own[id_col]).cast("long"), "place_": F.xxhash64(source.isNull(), source), "tie_": F.xxhash64(F.coalesce(F.col(own[text_col]).cast("string"), F.lit("")))}
    )
    key = F.col("id_").eqNullSafe(F.col("id")) & (F.col("place_") == F.col("place")) & (F.col("tie_") == F.col("tie"))
    turn = F.row_number().over(Window.partitionBy("id_", "place_", "tie_").orderBy("id_"))
    joined = keyed.join(per, key).withColumn("turn", turn)
    copies = F.floor(F.col("total") / F.col("n")) + F.when(F.col("turn") <= F.col("total") % F.col("n"), 1).otherwise(0)
    taken = joined.withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int"))))
    return taken.select(*[F.col(own[c]).alias(c) for c in docs.columns])

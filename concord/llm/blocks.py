"""Groups of any size as pairs of bounded blocks, each pair in one place of one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def block_pairs(posts: DataFrame, key: str, member: str, size: int, having: Column | None = None) -> DataFrame:
    """The rows of ``posts`` that are not alone with their ``key``, with ``own, lo, hi`` and ``run``.

    A group of n rows is cut into ``ceil(n / size)`` blocks by a hash of ``member``.  A row goes once
    to every pair of blocks that its own is part of, so any two rows of a group meet, and no run has
    many more than ``2 * size`` rows.  ``having`` is a condition on groups, as an aggregate.
    """
    n = posts.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), (F.lit(True) if having is None else having).alias("_wanted"))
    cuts = n.where("_n > 1 AND _wanted").select(key, F.ceil(F.col("_n") / F.lit(size)).cast("int").alias("_blocks"))
    own = F.pmod(F.xxhash64(F.lit(1), member), "_blocks").cast("int")
    rows = posts.join(cuts, key).withColumn("own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.withColumns({"lo": F.least("own", "_other"), "hi": F.greatest("own", "_other")}).drop("_blocks", "_other")
    return rows.withColumn("run", F.xxhash64(key, "lo", "hi"))


def whole_runs(batches: Iterator[pa.RecordBatch], column: str = "run") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted batches cut anew, so that runs of equal values are whole, with the places where runs begin and the last ends."""
    held = None
    for b in batches:
        if held is not None and held.num_rows:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0] if b.num_rows else held
        if not b.num_rows:
            continue
        keys = b.column(b.schema.get_field_index(column)).to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if not len(cuts):
            held = b
            continue
        yield b.slice(0, cuts[-1]), np.concatenate([[0], cuts])
        held = b.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield held, np.array([0, held.num_rows])

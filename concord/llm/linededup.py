"""Line dedup over overlapping three-line windows.

Lines are what ``\\n`` separates; only lines with a word form windows, blank ones are passed over
and kept.  A window is three such lines in a row.  Every window but its first occurrence, by
document and position, is a repeat, and the lines that any repeat covers are removed together.

Documents are ordered by ``(id, digest of the text)`` with null ids last.  Rows equal in both are
copies that cannot be told apart: they count as one occurrence and all get the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.common import Table, byte_texts, free, others, sized, small_batches

WINDOW = 3
_SPACE = b" \t\n\r\x0b\x0c"


def written(lines: list) -> list[int]:
    """Positions of the lines that have a word."""
    return [k for k, line in enumerate(lines) if line.strip(_SPACE if isinstance(line, bytes) else _SPACE.decode())]


def _windows(rows: DataFrame, size: int) -> DataFrame:
    """``(id, digest, n, key)``: the n-th window of each document and its 128-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sized(batches):
            of, n, keys = [], [], []
            for k, text in enumerate(byte_texts(b, "t")):
                lines = text.split(b"\n")
                at = written(lines)
                for j in range(len(at) - size + 1):
                    of.append(k)
                    n.append(j)
                    keys.append(blake2b(b"\n".join(lines[x] for x in at[j : j + size]), digest_size=16).digest())
            take = pa.array(of, pa.int64())
            yield pa.record_batch([b.column(0).take(take), b.column(1).take(take), pa.array(n, pa.int32()), pa.array(keys, pa.binary())], names=["id", "digest", "n", "key"])

    return rows.select("id", "digest", "t").mapInArrow(run, "id long, digest binary, n int, key binary")


def _cutter(size: int):
    @F.pandas_udf("struct<text: string, lines: long, removed: long>")
    def cut(texts: pd.Series, repeats: pd.Series) -> pd.DataFrame:
        out = []
        for text, starts in zip(texts, repeats):
            lines = text.split("\n")
            if starts is None or not len(starts):
                out.append((text, len(lines), 0))
                continue
            at = written(lines)
            gone = {at[s + k] for s in starts for k in range(size)}
            out.append(("\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone)))
        return pd.DataFrame(out, columns=["text", "lines", "removed"])

    return cut


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, out: str = "cut") -> DataFrame:
    """All columns of ``docs`` plus ``out``: a struct of the kept ``text``, ``lines`` and ``removed``.

    A column of that name is replaced.  A null text counts as empty and comes back as empty; an empty
    text has one line.  Only hashes
    of windows meet in a shuffle.  A window that very many documents share is one row per map task
    after partial aggregation, and the join back to its occurrences is one that AQE can split.
    """
    small_batches(docs.sparkSession)
    names = [f"_{k}" for k in range(len(docs.columns))]
    kept = docs.toDF(*names)
    own = dict(zip(docs.columns, names))
    t = F.coalesce(F.col(own[text_col]).cast("string"), F.lit(""))
    rows = kept.withColumns({"id": F.col(own[id_col]).cast("long"), "t": t, "digest": F.unhex(F.md5(t))})
    # Written once: what repeats is looked up in it, and then where.
    windows = Table(_windows(rows, size), "windows")
    seen = windows.df
    place = F.struct(F.col("id").isNull().alias("a"), "id", "digest", "n")
    first = seen.groupBy("key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    repeats = seen.join(first, "key").where(place > F.col("first")).select("id", "digest", "n")
    by_doc = repeats.groupBy("id", "digest").agg(F.collect_set("n").alias("starts"))
    by_doc = Table(by_doc.select(F.col("id").alias("id2"), F.col("digest").alias("digest2"), "starts"), "starts").df.hint("shuffle_hash")
    windows.drop()
    joined = rows.join(by_doc, rows["id"].eqNullSafe(by_doc["id2"]) & (rows["digest"] == by_doc["digest2"]), "left")
    done = joined.withColumn("cut", _cutter(size)(F.col("t"), F.col("starts")))
    return done.select(*[F.col(own[c]).alias(c) for c in others(docs.columns, out)], F.col("cut").alias(out))


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """``docs`` with the repeated lines gone from its text column; every row and column stays."""
    name = free(docs.columns, "cut")
    out = dedup_lines(docs, id_col, text_col, size, name)
    return out.select(*[out[name]["text"].alias(c) if c == text_col else out[c] for c in docs.columns])


def digest_of(text: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of a text in UTF-8."""
    return F.sha2(text.cast("binary"), 256)

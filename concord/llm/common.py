"""What the corpus operators share: shared-folder tables and column handling."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where intermediate tables go when a session on one machine names no shared folder, as in tests.
FALLBACK_DIR = "/tmp/checkpoints"
#: Spark's settings of the size of batches for Python, and that removes a query's shuffle files once its result is written.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Words are maximal runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver see: ``spark.checkpoint.dir``.

    Where it is unset, a session on one machine gets a local folder and a cluster an error, since
    its executors would write to folders that the others do not see.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or FALLBACK_DIR


class Table:
    """A table written once to the shared folder, so that later reads survive lost executors.

    The shuffle files of the query that fills it go once it is written.  A table goes with
    ``drop``, else when the driver ends.
    """

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(self.path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        self.schema = df.schema
        system, path = self._files()
        system.deleteOnExit(path)

    def _files(self):
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(conf), path

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; call only when nothing lazy still reads them."""
        system, path = self._files()
        system.delete(path, True)


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The text column as a string, null as empty."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def byte_texts(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    """UTF-8 bytes of a string column's values, null as empty."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())
    return (x.as_py() or b"" for x in column)


def sized(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, which bounds what a worker makes of them at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def portions(texts: list, rows: int, size: int = 4_000_000) -> Iterator[list]:
    """Texts in order, in lists of at most ``rows`` and, if of more than one, ``size`` characters or bytes."""
    part, held = [], 0
    for t in texts:
        if part and (len(part) >= rows or held + len(t) > size):
            yield part
            part, held = [], 0
        part.append(t)
        held += len(t)
    if part:
        yield part


def small_batches(spark: SparkSession, size: str = "32m") -> None:
    """Batches that go to Python workers hold about ``size`` bytes at most, unless the session sets a limit itself."""
    if spark.conf.get(BATCH_BYTES, None) in (None, str((1 << 31) - 1), "-1"):
        spark.conf.set(BATCH_BYTES, size)


def free(columns: list[str], name: str) -> str:
    """``name``, with underscores before it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def others(columns: list[str], name: str) -> list[str]:
    """The columns that a result column ``name`` does not replace."""
    return [c for c in columns if c.lower() != name.lower()]

"""Writers; each replaces or appends whole files, so that a retried job leaves no halves."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions.text import file_name


def write_verdicts(verdicts: DataFrame, path: str) -> None:
    """JSON lines, one folder per repetition; running a repetition again replaces it."""
    writer = verdicts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("repetition").option("ignoreNullFields", False).json(path)


def write_batch(verdicts: DataFrame, path: str, number: int) -> None:
    """The verdicts of one batch as JSON lines; writing it again replaces it."""
    verdicts.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/{number}")


def write_ranking(ranked: DataFrame, path: str) -> None:
    """One ordered CSV; a ranking has a row per competitor."""
    ranked.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_consensus(labels: DataFrame, path: str, id_col: str, label: str, carry: DataFrame | None = None) -> None:
    """``id, label`` and, if asked for, the original columns of ``carry`` by id."""
    out = labels.select(id_col, label)
    if carry is not None:
        side = carry.select(F.col(id_col).alias("_id"), *[c for c in carry.columns if c not in out.columns])
        out = out.join(side, out[id_col].eqNullSafe(side["_id"]), "left").drop("_id")
    out.write.mode("overwrite").option("header", True).csv(path)


def write_audit(result: DataFrame, directory: str) -> str:
    """One JSON object for an audit, in a folder of ``directory`` named after its data set; gives that path."""
    name = result.select(file_name(F.coalesce("dataset_name", F.lit("dataset")))).first()[0]
    path = f"{directory.rstrip('/')}/{name}_second_round.json"
    result.select(F.to_json(F.struct(*result.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)
    return path


def scratch(spark: SparkSession) -> str:
    """A new folder for files that go when the driver ends: in ``spark.checkpoint.dir``, or locally where a single machine names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{(named or '/tmp/checkpoints').rstrip('/')}/scratch-{uuid.uuid4().hex}"
    system, there = _file(spark, path)
    system.mkdirs(there)
    system.deleteOnExit(there)
    return path


def _file(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file, such as an image, through Spark's file systems."""
    system, there = _file(spark, path)
    stream = system.create(there, True)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()

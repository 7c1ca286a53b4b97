"""An optional extra: the ranking kept up to date over an append-only folder of verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from concord import schemas
from concord.operators import tournament


def read_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """Verdicts as they come in, at most ``files`` files at a time."""
    reader = spark.readStream.schema(schemas.VERDICT)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).json(path)


def tallies(stream: DataFrame) -> DataFrame:
    """The tally as a streaming aggregate; state has one row per competitor.  Write in ``complete`` mode."""
    return tournament.tally(stream)


def settled(stream: DataFrame, log: str, out: str) -> DataFrame:
    """The tally once all files that are there have come in; each batch replaces the table in ``out``."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    query = tallies(stream).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", log).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(out)

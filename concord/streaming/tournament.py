"""A tournament that can be stopped at any time and goes on where it was.

Games lie in files, one for each batch of them.  A batch's replies are written to a folder of their
own before anything is made of them, and a folder that is complete is never judged again; verdicts and
cache are made from it and replace what an earlier attempt at the batch left.  So each batch counts
once, whatever happens between two steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.operators import judges
from concord.sources import cache, files, sinks

BATCH = 500


def put_games(games: DataFrame, path: str, batch: int = BATCH) -> None:
    """Write games with their ``cache_key`` in files of about ``batch``; each key is in one file."""
    games.repartition(max(1, -(-games.count() // batch)), "cache_key").write.mode("errorifexists").parquet(path)


def _complete(spark: SparkSession, path: str) -> bool:
    return bool(files.matching(spark, f"{path}/_SUCCESS"))


def judge_batch(games: DataFrame, number: int, out: str, judge: judges.Judge, cached: str | None = None) -> None:
    """Judge one batch, once: replies to ``out/replies``, then verdicts to ``out/verdicts`` and new rows to the cache."""
    spark, replies = games.sparkSession, f"{out}/replies/batch={number}"
    if not _complete(spark, replies):
        known = cache.read(spark, cached, games) if cached and files.matching(spark, f"{cached}/*") else None
        rows, _ = judges.judged(games, known, judge)
        rows.write.mode("overwrite").parquet(replies)
    rows = spark.read.parquet(replies)
    sinks.write_batch(judges.verdicts(rows), f"{out}/verdicts", number)
    if cached and not _complete(spark, f"{out}/cached/batch={number}"):
        # Repeating this after a stop adds equal rows, of which one counts.
        cache.append(rows.where(~F.col("gpt_output").startswith(judges.FAILED)), cached)
        spark.range(1).write.mode("overwrite").parquet(f"{out}/cached/batch={number}")


def play_games(spark: SparkSession, games: str, out: str, judge: judges.Judge, cached: str | None = None, after=None) -> DataFrame:
    """Judge all games in the files under ``games`` that are not judged yet; gives all verdicts so far.

    The stream's own log is in ``out/log``.  ``after(number)`` is called when a batch is judged.
    """
    base = out.rstrip("/")

    def run(batch: DataFrame, number: int) -> None:
        judge_batch(batch, number, base, judge, cached)
        if after:
            after(number)

    rows = spark.readStream.schema(spark.read.parquet(games).schema).option("maxFilesPerTrigger", 1).parquet(games)
    query = rows.writeStream.foreachBatch(run).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return files.read_verdicts(spark, f"{base}/verdicts/*")

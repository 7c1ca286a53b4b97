"""Judges of games, and the runner that puts a cache before them.

A judge takes games ``(model1, model2, repetition, ...)`` and adds ``gpt_choice, gpt_output``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.config import DEFAULTS
from concord.functions import text

Judge = Callable[[DataFrame], DataFrame]
FAILED = "[API ERROR] "


def expression_judge(choice: Column) -> Judge:
    """A judge that is a column expression; its output is the choice itself."""
    return lambda games: games.withColumn("gpt_output", choice).withColumn("gpt_choice", text.parsed_choice(F.col("gpt_output")))


def replay_judge(recorded: DataFrame) -> Judge:
    """A judge that looks replies up in ``(model1, model2, repetition, gpt_output)``; none is a failure."""

    def judge(games: DataFrame) -> DataFrame:
        out = games.join(recorded, ["model1", "model2", "repetition"], "left")
        out = out.withColumn("gpt_choice", text.parsed_choice(F.col("gpt_output")))
        return out.withColumn("gpt_output", F.coalesce("gpt_output", F.lit(FAILED + "no recorded reply")))

    return judge


def ask(call: Callable[[dict], str], game: dict, attempts: int = DEFAULTS.attempts, backoff: float = DEFAULTS.backoff, sleep=time.sleep) -> str:
    """One reply; waits ``backoff ** attempt`` seconds after every failure, then raises the last."""
    error: Exception | None = None
    for attempt in range(1, attempts + 1):
        try:
            return call(game) or ""
        except Exception as e:  # noqa: BLE001
            error = e
            sleep(backoff**attempt)
    raise error


def callable_judge(call: Callable[[dict], str], parallel: int = 8, attempts: int = DEFAULTS.attempts, backoff: float = DEFAULTS.backoff) -> Judge:
    """A judge that calls out, ``parallel`` games at a time; a failure is a row with its message, hence a tie."""

    def judge(games: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                replies = []
                for game in batch.to_dict("records"):
                    try:
                        replies.append(ask(call, game, attempts, backoff))
                    except Exception as e:  # noqa: BLE001
                        replies.append(f"{FAILED}{e}")
                yield batch.assign(gpt_output=replies)

        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in games.schema), "gpt_output string"])
        out = games.repartition(parallel).mapInPandas(run, schema)
        failed = F.col("gpt_output").startswith(FAILED)
        return out.withColumn("gpt_choice", F.when(~failed, text.parsed_choice(F.col("gpt_output"))))

    return judge


def keyed(games: DataFrame, mode: str, model: str, temperature: float, effort: str, **extended: Column) -> DataFrame:
    """Games with their cache key."""
    parts = [F.col("model1"), F.col("model2"), F.col("repetition"), F.lit(mode), F.lit(model), F.lit(str(float(temperature))), F.lit(effort)]
    return games.withColumn("cache_key", text.cache_key(*parts, **extended))


def judged(games: DataFrame, cache: DataFrame | None, judge: Judge) -> tuple[DataFrame, DataFrame]:
    """All games with their verdicts, and the rows to add to the cache (no failures).

    ``games`` have a ``cache_key``; ``cache`` is ``(cache_key, gpt_choice, gpt_output)``.  Write both
    before using either again: a judge that calls out need not say the same twice.
    """
    names = [*games.columns, "gpt_choice", "gpt_output"]
    if cache is None:
        fresh = judge(games).select(names)
        return fresh, fresh.where(~F.col("gpt_output").startswith(FAILED)).select("cache_key", "gpt_choice", "gpt_output")
    hits = games.join(cache, "cache_key").select(names)
    fresh = judge(games.join(cache.select("cache_key"), "cache_key", "left_anti")).select(names)
    return hits.unionByName(fresh), fresh.where(~F.col("gpt_output").startswith(FAILED)).select("cache_key", "gpt_choice", "gpt_output")


def verdicts(rows: DataFrame) -> DataFrame:
    """Judged games in the form of verdict records."""
    return rows.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("ts"), F.col("model1").alias("model1_label"),
        F.col("model2").alias("model2_label"), "gpt_choice", "gpt_output", F.col("repetition").cast("int").alias("repetition"),
    )

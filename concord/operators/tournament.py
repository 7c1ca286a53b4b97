"""Round-robin tournaments: pairs, schedules, cache probes, tallies and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.functions import text


def pairs(models: DataFrame) -> DataFrame:
    """``(model1, model2)`` for every two of the distinct names in ``model``, the lesser one first.

    Every unordered pair is the definition of a round robin, so the result is quadratic in the
    number of competitors and in nothing else.
    """
    names = models.select("model").where("model IS NOT NULL").distinct()
    a, b = names.withColumnRenamed("model", "model1"), names.withColumnRenamed("model", "model2")
    return a.join(b, F.col("model1") < F.col("model2"))


def schedule(paired: DataFrame, repetitions: int) -> DataFrame:
    """Every pair once in each repetition, numbered from 1."""
    every = F.explode(F.sequence(F.lit(1), F.lit(repetitions)))
    return paired.withColumn("repetition", every)


def with_payloads(games: DataFrame, images: DataFrame) -> DataFrame:
    """Both sides' data URLs, from ``images(model, data_url)``."""
    one = images.select(F.col("model").alias("model1"), F.col("data_url").alias("image1"))
    two = images.select(F.col("model").alias("model2"), F.col("data_url").alias("image2"))
    return games.join(one, "model1").join(two, "model2")


def probe(games: DataFrame, cache: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """Games whose key is in the cache, with the cached row, and games still to be judged."""
    return games.join(cache, key), games.join(cache.select(key), key, "left_anti")


def valid(verdicts: DataFrame) -> DataFrame:
    """Verdicts that name both sides."""
    return verdicts.where(text.named(F.col("model1_label")) & text.named(F.col("model2_label")))


def tally(verdicts: DataFrame) -> DataFrame:
    """Games, wins, losses, ties, points (1 and 0.5) and win rate of each model.

    Each verdict becomes two rows without a shuffle; the only one is the aggregate's, by model and
    after partial aggregation.
    """
    choice = text.canonical_choice(F.col("gpt_choice"))
    sides = F.array(
        F.struct(F.col("model1_label").alias("model"), (choice == "first").alias("won"), (choice == "second").alias("lost")),
        F.struct(F.col("model2_label").alias("model"), (choice == "second").alias("won"), (choice == "first").alias("lost")),
    )
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    found = valid(verdicts).select(F.inline(sides)).groupBy("model").agg(
        F.count(F.lit(1)).alias("games"), count(F.col("won")).alias("wins"), count(F.col("lost")).alias("losses"),
        count(~F.col("won") & ~F.col("lost")).alias("ties"),
    )
    points = F.col("wins") + F.lit(0.5) * F.col("ties")
    return found.withColumn("points", F.round(points, 4)).withColumn("win_rate", F.round(points / F.col("games"), 6))


def ranking(verdicts: DataFrame) -> DataFrame:
    """The tally, best first; equals go by points, games and name, all descending."""
    return tally(verdicts).orderBy(*(F.desc(c) for c in ("win_rate", "points", "games", "model")))


def numbered(ranked: DataFrame) -> DataFrame:
    """A ranking with the place of each model, from 1; one row per competitor."""
    order = Window.orderBy(*(F.desc(c) for c in ("win_rate", "points", "games", "model")))
    return ranked.withColumn("place", F.row_number().over(order))


def counters(verdicts: DataFrame) -> DataFrame:
    """How many verdicts there are and how many count."""
    used = text.named(F.col("model1_label")) & text.named(F.col("model2_label"))
    return verdicts.agg(F.count(F.lit(1)).alias("total_rows"), F.count(F.when(used, 1)).alias("used_rows"))

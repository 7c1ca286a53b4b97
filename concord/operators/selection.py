"""Which competitors go on: fixed top-k, elbow, by name, or by an audit."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.config import DEFAULTS
from concord.functions.text import normalized_name

RATE_COLUMNS, MODEL_COLUMNS = ("win_rate", "winning_rate", "WinningRate"), ("model", "Model")


def columns_of(ranked: DataFrame) -> tuple[str, str]:
    """Model and rate column of a ranking that may be foreign: known names, else first and last."""
    model = next((c for c in MODEL_COLUMNS if c in ranked.columns), ranked.columns[0])
    rate = next((c for c in RATE_COLUMNS if c in ranked.columns), ranked.columns[-1])
    return model, rate


def placed(ranked: DataFrame, pos: str | None = None) -> DataFrame:
    """``(model, win_rate, place)``: descending rate, ties in file order (``pos``) or else by name descending."""
    model, rate = columns_of(ranked)
    tie = F.asc(pos) if pos else F.desc(model)
    order = Window.orderBy(F.col(rate).desc_nulls_last(), tie)
    return ranked.select(F.col(model).alias("model"), F.col(rate).cast("double").alias("win_rate"), F.row_number().over(order).alias("place"))


def top_fixed(ranked: DataFrame, top_k: int = DEFAULTS.top_k, pos: str | None = None) -> DataFrame:
    """The best ``top_k``, or all if there are fewer."""
    if not top_k or top_k < 1:
        raise ValueError("top_k must be a positive number")
    return placed(ranked, pos).where(F.col("place") <= top_k)


def top_elbow(ranked: DataFrame, top_k: int = DEFAULTS.top_k, pos: str | None = None) -> DataFrame:
    """Up to the largest drop between neighbours (the first of equals), within 3 and ``top_k``.

    Two models or fewer are all selected; three stay even if ``top_k`` is less.
    """
    rows = placed(ranked, pos)
    drop = F.col("win_rate") - F.lead("win_rate").over(Window.orderBy("place"))
    cut = rows.withColumn("drop", drop).agg(
        F.count(F.lit(1)).alias("n"), F.max_by("place", F.struct("drop", -F.col("place"))).alias("elbow")
    )
    keep = F.when(F.col("n") <= 2, F.col("n")).otherwise(F.greatest(F.lit(3), F.least("elbow", F.lit(top_k))))
    return rows.crossJoin(F.broadcast(cut.select(keep.alias("keep")))).where("place <= keep").drop("keep")  # one row


def clamped(ranked: DataFrame, top_k: int = DEFAULTS.top_k) -> int:
    """``top_k``, or, with a warning, how many models there are if that is less."""
    if not top_k or top_k < 1:
        raise ValueError("top_k must be a positive number")
    there = ranked.limit(top_k).count()
    if there < top_k:
        warnings.warn(f"top_k is {top_k}, but there are {there} models", stacklevel=2)
    return min(top_k, there)


def select_top(ranked: DataFrame, mode: str = "fixed", top_k: int = DEFAULTS.top_k, pos: str | None = None) -> DataFrame:
    if mode not in ("fixed", "elbow"):
        raise ValueError(f"unknown mode: {mode}")
    return (top_fixed if mode == "fixed" else top_elbow)(ranked, top_k, pos)


def missing(wanted: DataFrame, ranked: DataFrame) -> DataFrame:
    """Wanted names that the ranking does not have."""
    model, _ = columns_of(ranked)
    return wanted.join(ranked.select(F.col(model).alias("model")), "model", "left_anti")


def select_named(ranked: DataFrame, names: list[str]) -> DataFrame:
    """Exactly the given names, in the given order; unknown ones are an error."""
    spark = ranked.sparkSession
    wanted = spark.createDataFrame([(n, k + 1) for k, n in enumerate(dict.fromkeys(names))], "model string, place int")
    lost = [r.model for r in missing(wanted, ranked).select("model").collect()]
    if lost:
        raise ValueError(f"models not in the ranking: {sorted(lost)}")
    return wanted


def excluded(selected: DataFrame, kept: DataFrame) -> DataFrame:
    """Selected models that an audit did not keep."""
    return selected.join(kept, "model", "left_anti")


def by_normalized(ranked: DataFrame) -> DataFrame:
    """``normalized, model``: of ranked names that normalise alike the last one in the table's order (``pos``) or else by name wins."""
    model, _ = columns_of(ranked)
    order = F.struct(*([F.col("pos")] if "pos" in ranked.columns else []), F.col(model))
    rows = ranked.groupBy(normalized_name(F.col(model)).alias("normalized")).agg(F.max_by(F.col(model), order).alias("model"), F.count_distinct(model).alias("n"))
    if twice := [r.normalized for r in rows.where("n > 1").orderBy("normalized").limit(20).collect()]:
        warnings.warn(f"ranked names that normalise alike, of which the last counts: {twice}", stacklevel=2)
    return rows.select("normalized", "model")


def resolve(ranked: DataFrame, manual: list[str] | None = None, audited: list[str] | None = None, top_k: int = DEFAULTS.top_k) -> list[str]:
    """Names by precedence: given by hand, else an audit's, else the best ``top_k``; at least two."""
    chosen = select_named(ranked, manual or audited) if manual or audited else top_fixed(ranked, top_k)
    names = [r.model for r in chosen.orderBy("place").limit(DEFAULTS.max_models + 1).collect()]
    if len(names) > DEFAULTS.max_models:
        raise ValueError(f"more than {DEFAULTS.max_models} models are chosen")
    if len(names) < 2:
        raise ValueError("at least two models are needed")
    return names

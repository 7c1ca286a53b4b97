"""The audit of selected competitors: what it is told, and what its reply means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.config import DEFAULTS
from concord.functions import text

INSTRUCTIONS = (
    "Several labelings of the same data were compared in pairs. Decide which of them fit together well enough to be "
    "merged, and leave out those that contradict the rest. Do not rank them. Reply with one JSON object: "
    '"final_keep_ids" lists the ids to keep and "per_model_notes" gives one short reason for every id.'
)
STRICT = (
    "You compare labelings of {dataset}. Judge only how well each agrees with the evidence, the reference image above all if "
    "there is one. Smooth or tidy borders are no merit in themselves, and scattered labels no fault where the data are "
    "scattered; a clean border in the wrong place is worse than a ragged one in the right place. Begin with the single word "
    "First or Second, then give one short paragraph on each labeling, 200 words at most in all."
)
COMPARE = (
    "Two labelings of {dataset} are shown, the first one first. Say which fits the data better, in a few words, "
    "and end with the single word First or Second."
)


def compare_prompt(dataset: Column, reference: Column, mode: str = "simple") -> Column:
    """What a judge is asked about a pair; ``reference`` says whether a reference image comes first.

    ``simple`` asks for the better one, ``complex`` for a judgement by the evidence with reasons.
    """
    if mode not in ("simple", "complex"):
        raise ValueError(f"unknown mode: {mode}")
    body = F.replace(F.lit(COMPARE if mode == "simple" else STRICT), F.lit("{dataset}"), F.coalesce(dataset, F.lit("a data set")))
    return F.when(reference, F.concat(F.lit("A reference image comes before both. "), body)).otherwise(body)


def messages(prompt: Column, *urls: Column) -> Column:
    """A chat of one user turn: the prompt, then the images there are."""
    part = lambda kind, t, u: F.struct(F.lit(kind).alias("type"), t.cast("string").alias("text"), u.cast("string").alias("url"))
    none = F.lit(None)
    parts = F.array(part("text", prompt, none), *[part("image_url", none, u) for u in urls])
    kept = F.filter(parts, lambda p: (p["type"] == "text") | p["url"].isNotNull())
    return F.array(F.struct(F.lit("user").alias("role"), kept.alias("content")))


def generic_ids(models: DataFrame) -> DataFrame:
    """``(generic, model)``: ``model_1``, ``model_2`` ... in order of the real names; one row per selected model."""
    place = F.row_number().over(Window.orderBy("model"))
    return models.select(F.concat(F.lit("model_"), place.cast("string")).alias("generic"), "model")


def within(verdicts: DataFrame, selected: DataFrame) -> DataFrame:
    """Verdicts whose both sides are selected."""
    one, two = (selected.select(F.col("model").alias(c)) for c in ("model1_label", "model2_label"))
    return verdicts.join(one, "model1_label", "left_semi").join(two, "model2_label", "left_semi")


def summary(verdicts: DataFrame, rows: int = DEFAULTS.summary_rows) -> DataFrame:
    """One row ``summary``: the first comparisons, a line each, and how many more there are."""
    line = F.concat(
        F.lit("Rep "), F.col("repetition").cast("string"), F.lit(": "), F.col("model1_label"), F.lit(" vs "), F.col("model2_label"),
        F.lit(" -> "), text.winner(F.col("gpt_choice"), F.col("model1_label"), F.col("model2_label")),
    )
    order = ["repetition", "model1_label", "model2_label", "line"]
    first = verdicts.withColumn("line", line).orderBy(*order).limit(rows)
    total = verdicts.agg(F.count(F.lit(1)).alias("n"))
    shown = first.agg(F.sort_array(F.collect_list(F.struct(*order))).alias("l"))  # at most ``rows``
    body = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    more = F.when(F.col("n") > rows, F.concat(F.lit("\n("), (F.col("n") - rows).cast("string"), F.lit(" more)"))).otherwise("")
    return shown.crossJoin(total).select(F.concat(body, more).alias("summary"))  # one row each


def prompt(ids: DataFrame, rates: DataFrame, digest: DataFrame) -> DataFrame:
    """One row ``prompt``: instructions, the models with their win rates, the summary."""
    rate = F.format_string("%.3f", F.coalesce(F.col("win_rate"), F.lit(0.0)))
    line = F.concat(F.col("generic"), F.lit(" ("), F.col("model"), F.lit("): win_rate = "), rate)
    rows = ids.join(rates.select("model", "win_rate"), "model", "left").select("model", line.alias("line"))
    listed = rows.agg(F.sort_array(F.collect_list(F.struct("model", "line"))).alias("l"))  # one per selected model
    body = F.concat_ws("\n\n", F.lit(INSTRUCTIONS), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.col("summary"))
    return listed.crossJoin(digest).select(body.alias("prompt"))


def kept(replies: DataFrame, ids: DataFrame, reply: str = "reply") -> DataFrame:
    """``pos, generic, model, note``: the ids that a reply keeps, in its order, unknown ones left out."""
    parsed = replies.select(text.parsed_reply(F.col(reply)).alias("r"))
    named = parsed.select(F.posexplode("r.final_keep_ids").alias("pos", "generic"), F.col("r.per_model_notes").alias("notes"))
    return named.join(ids, "generic").select("pos", "generic", "model", F.try_element_at("notes", F.col("generic")).alias("note")).orderBy("pos")

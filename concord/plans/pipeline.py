"""Tournament, selection and consensus as one plan."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord import schemas
from concord.config import DEFAULTS
from concord.functions import text
from concord.operators import audit, judges, labels, linkage, selection, tournament
from concord.sources import cache as store
from concord.sources import files, sinks


@dataclass(frozen=True)
class KChoice:
    """How many clusters: ``fixed``, or a method of those that read it off the data."""

    method: str = "median_from_models"
    fixed: int | None = None
    k_range: tuple[int, ...] = DEFAULTS.k_range
    #: Rows that silhouette and gap look at, all of them if none is given.
    sample: int | None = None


def play(images: DataFrame, judge: judges.Judge, repetitions: int = DEFAULTS.repetitions, cache: DataFrame | None = None, mode: str = "simple", model: str = "judge", temperature: float = 1.0, effort: str = "medium") -> tuple[DataFrame, DataFrame]:
    """A whole tournament over ``images(model, data_url)``: verdict records, and rows to add to the cache.

    Every two models meet once a repetition, the lesser name first; only games that the cache lacks
    are judged.  Fewer than two models are an error.  Write the result before using it twice.
    """
    if images.select("model").distinct().limit(2).count() < 2:
        raise ValueError("fewer than two models to compare")
    games = tournament.schedule(tournament.pairs(images), repetitions)
    shown = tournament.with_payloads(judges.keyed(games, mode, model, temperature, effort), images)
    rows, fresh = judges.judged(shown, cache, judge)
    return judges.verdicts(rows), fresh


def asked(games: DataFrame, dataset: str, reference: DataFrame | None = None, mode: str = "simple") -> DataFrame:
    """Games with payloads and the chat ``messages`` that a judge is sent: the prompt of the mode, then the images."""
    shown = games if reference is None else games.crossJoin(F.broadcast(reference.select(F.col("data_url").alias("reference")).limit(1)))  # one row
    has = F.lit(reference is not None)
    urls = ([] if reference is None else [F.col("reference")]) + [F.col("image1"), F.col("image2")]
    return shown.withColumn("messages", audit.messages(audit.compare_prompt(F.lit(dataset), has, mode), *urls))


def run_tournament(
    spark: SparkSession, images: str, out: str, judge: judges.Judge, dataset: str = "a data set", repetitions: int = DEFAULTS.repetitions, mode: str = "simple", skip: bool = False
) -> DataFrame:
    """A tournament over a folder of images: verdicts, cache and ranking are written under ``out``; gives the ranking.

    Games that ``out/cache`` has are not judged again.  With ``skip`` the ranking stored there is read
    instead, and it is an error if there is none.
    """
    stored = f"{out.rstrip('/')}/ranking"
    if skip:
        if not files.matching(spark, stored):
            raise FileNotFoundError(f"no ranking in {out}; play the tournament first")
        return files.read_ranking(spark, stored)
    reference, models = files.read_images(spark, images)
    given = None if reference.isEmpty() else reference
    ask = lambda games: judge(asked(games, dataset, given, mode))
    cached = f"{out.rstrip('/')}/cache"
    cache = files.read_cache(spark, cached) if files.matching(spark, cached) else None
    verdicts, fresh = play(models, ask, repetitions, cache, mode)
    sinks.write_verdicts(verdicts, f"{out.rstrip('/')}/verdicts")
    if cache is None or not fresh.isEmpty():
        store.append(fresh, cached)
    ranked = tournament.ranking(files.read_verdicts(spark, f"{out.rstrip('/')}/verdicts"))
    sinks.write_ranking(ranked, stored)
    return files.read_ranking(spark, stored)


def run_all(
    spark: SparkSession, images: str, assignments: str | list[str], id_col: str | None, out: str, judge: judges.Judge, manual: list[str] | None = None, top_k: int = DEFAULTS.top_k,
    choice: KChoice = KChoice(), repetitions: int = DEFAULTS.repetitions, skip: bool = False, separate: bool = False, truth: str | None = None, audited: bool = True,
) -> DataFrame:
    """Images and assignments to a consensus, which is written to ``out/consensus`` too.

    The models are those given, else (if ``audited``) those that a stored audit kept, else the best
    ``top_k``.  Assignments are one file with the column ``id_col``, or, with ``separate``, a file for each
    model, whose first column is the id: a list of them, or their folder.  With ``truth``, a column of
    the one file or of the first, the agreement with it goes to ``out/agreement``.
    """
    ranked, base = run_tournament(spark, images, out, judge, repetitions=repetitions, skip=skip), out.rstrip("/")
    names = selection.resolve(ranked, manual, files.read_audit(spark, out) if audited and not manual else None, top_k)
    if separate:
        paths = assignments if isinstance(assignments, list) else files.locate(spark, assignments, names)
        frames = files.read_separate(spark, paths, names)
        given = frames[names[0]]
        key, models = given.columns[0], [f"label_{k}" for k in range(len(names))]
        matrix = labels.align(dict(zip(models, (frames[n] for n in names))), ground_truth=truth).withColumnRenamed("id", key)
    else:
        if id_col is None:
            raise ValueError("a file of all assignments needs its id column")
        given = matrix = files.read_combined(spark, assignments, id_col)
        columns = labels.match_columns(names, [c for c in matrix.columns if c not in (id_col, "pos", truth)])
        key, models = id_col, [columns[n] for n in names]
    # File order numbers the tuples; the id stands beside it.
    found = run_consensus(matrix, models, ["pos", key], choice)
    sinks.write_consensus(found, f"{base}/consensus", key, "consensus_label")
    if truth:
        scored = agreement(found, given, key, truth)
        if scored is None:
            warnings.warn(f"no column {truth!r} to compare with", stacklevel=2)
        else:
            scored.write.mode("overwrite").json(f"{base}/agreement")
    return found.drop("pos")


def run_audit(verdicts: DataFrame, images: DataFrame, call: Callable[[dict], str], dataset: str, top_k: int = DEFAULTS.top_k) -> DataFrame:
    """The audit of the best ``top_k`` models, as one row in the form of ``schemas.AUDIT``.

    Models without an image are left out; fewer than two with one are an error, and so is a reply
    that is not the JSON asked for.  One row per selected model is all that reaches the driver.
    """
    ranked = tournament.ranking(verdicts)
    top = selection.top_fixed(ranked, top_k).join(images.select("model"), "model", "left_semi")
    ids = audit.generic_ids(top.select("model"))
    if ids.count() < 2:
        raise ValueError("fewer than two selected models have an image")
    digest = audit.summary(audit.within(verdicts, top))
    prompt = audit.prompt(ids, ranked, digest).first().prompt
    urls = [r.data_url for r in images.join(ids, "model").orderBy("model").select("data_url").collect()]
    reply = judges.ask(call, {"prompt": prompt, "images": urls})
    raw = ids.sparkSession.createDataFrame([(reply,)], "raw_response string")
    parsed = raw.withColumn("r", text.parsed_reply(F.col("raw_response")))
    if parsed.where("r.final_keep_ids IS NULL").count():
        raise ValueError("the reply is not the JSON asked for")
    real = F.map_from_entries(F.collect_list(F.struct("generic", "model")))
    names = ids.agg(real.alias("names"))  # one row
    keep, notes = F.col("r.final_keep_ids"), F.coalesce("r.per_model_notes", F.create_map().cast("map<string,string>"))
    known = F.filter(keep, lambda g: F.map_contains_key("names", g))
    return parsed.crossJoin(names).select(
        keep.alias("final_keep_ids"),
        F.transform(known, lambda g: F.element_at("names", g)).alias("final_model_ids"),
        notes.alias("per_model_notes_generic"),
        F.transform_keys(F.map_filter(notes, lambda k, v: F.map_contains_key("names", k)), lambda k, v: F.element_at("names", k)).alias("per_model_notes"),
        F.lit(dataset).alias("dataset_name"),
        "raw_response",
    ).to(schemas.AUDIT)


def agreement(found: DataFrame, truth: DataFrame, key: str, truth_col: str, name: str = "consensus_label") -> DataFrame | None:
    """Adjusted Rand index of a consensus and a ground truth aligned by key; None if there is no such column."""
    if truth_col not in truth.columns:
        return None
    joined = found.join(truth.select(F.col(key), F.col(truth_col).alias("_truth")), key, "left")
    return linkage.adjusted_rand(joined, name, "_truth")


def choose_k(matrix: DataFrame, models: list[str], sigs: DataFrame, tree: DataFrame, choice: KChoice, keys: list[str] | None = None) -> int:
    """One number; the methods are the median or mode of the models' counts, silhouette and gap.

    With ``choice.sample`` the latter two look at that many rows, chosen by their ``keys``.
    """
    if choice.method == "fixed":
        if choice.fixed is None:
            raise ValueError("fixed needs a number of clusters")
        return choice.fixed
    if choice.method in ("median_from_models", "mode_from_models"):
        counts = labels.k_counts(matrix, models)
        how = labels.k_median if choice.method == "median_from_models" else labels.k_mode
        row = how(counts, choice.k_range).first()
        if row is None or row.k is None:
            raise ValueError(f"no model's number of clusters is within {choice.k_range}")
        return row.k
    if choice.method not in ("silhouette", "gap_statistic"):
        raise ValueError(f"unknown method: {choice.method}")
    if choice.sample:
        if not keys:
            raise ValueError("a sample needs the keys of the rows")
        sigs = labels.signatures(labels.bottom_rows(matrix, keys, choice.sample), models, keys)
        tree = linkage.dendrogram(sigs)
    n = sigs.count()
    ks = [k for k in choice.k_range if 2 <= k < n]
    if not ks:
        raise ValueError("no k in range to try")
    if choice.method == "silhouette":
        return linkage.best_silhouette(linkage.silhouette(sigs, linkage.cut(sigs, tree, ks), len(models))).first().k
    scores = linkage.gap(sigs, ks, len(models))
    return scores.orderBy(scores["gap"].desc(), "k").first().k


def run_consensus(matrix: DataFrame, models: list[str], keys: list[str], choice: KChoice = KChoice(), name: str = "consensus_label") -> DataFrame:
    """Consensus labels of all rows of a label matrix over the given models, each counted once."""
    models = list(dict.fromkeys(models))
    if len(models) < 2:
        raise ValueError("at least two models are needed")
    sigs = labels.signatures(matrix, models, keys)
    if sigs.isEmpty():
        raise ValueError("there are no rows to label")
    tree = linkage.dendrogram(sigs)
    k = choose_k(matrix, models, sigs, tree, choice, keys)
    return linkage.consensus(matrix, models, sigs, linkage.cut(sigs, tree, [k]), keys, name)


def run(verdicts: DataFrame, matrix: DataFrame, keys: list[str], manual: list[str] | None = None, audited: list[str] | None = None, top_k: int = DEFAULTS.top_k, choice: KChoice = KChoice()) -> DataFrame:
    """Verdicts to ranking, ranking to selected models, their labels to a consensus."""
    names = selection.resolve(tournament.ranking(verdicts), manual, audited, top_k)
    columns = labels.match_columns(names, [c for c in matrix.columns if c not in keys])
    return run_consensus(matrix, [columns[n] for n in names], keys, choice)

"""Readers of images, rankings, assignments, verdicts, caches and audits."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord import schemas
from concord.config import DEFAULTS
from concord.functions import text
from concord.operators.selection import columns_of
from concord.sources import cache
from concord.sources.records import read_records

#: Image extensions in order of preference, with their rank.
EXTENSIONS = (("png", 0), ("jpg", 1), ("jpeg", 1))


def named_files(paths: DataFrame, path: str = "path") -> DataFrame:
    """``path, file, stem, ext`` of image paths whose extension is known (lower case only)."""
    file = F.regexp_extract(path, r"([^/]*)$", 1)
    out = paths.withColumn("file", file).withColumn("stem", F.regexp_extract("file", r"^(.*)\.([^.]*)$", 1)).withColumn("ext", F.regexp_extract("file", r"\.([^.]*)$", 1))
    return out.where(F.col("ext").isin([e for e, _ in EXTENSIONS]))


def one_per_stem(files: DataFrame) -> DataFrame:
    """One file for each stem: png before jpg before jpeg."""
    order = F.lit(None)
    for k, (e, _) in reversed(list(enumerate(EXTENSIONS))):
        order = F.when(F.col("ext") == e, k).otherwise(order)
    rank = F.row_number().over(Window.partitionBy("stem").orderBy(order, "path"))
    return files.withColumn("rank", rank).where("rank = 1").drop("rank")


def split_reference(files: DataFrame, basename: str = DEFAULTS.reference_image) -> tuple[DataFrame, DataFrame]:
    """The reference image (if there) and the models' images.

    A basename with a dot is one exact file; without, it is the best extension of that stem.
    """
    if "." in basename:
        is_ref = F.col("file") == basename
        return files.where(is_ref), one_per_stem(files.where(~is_ref))
    is_ref = F.col("stem") == basename
    return one_per_stem(files.where(is_ref)), one_per_stem(files.where(~is_ref))


def literal_path(path: str) -> str:
    """A path in which nothing is a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def read_images(spark: SparkSession, directory: str, basename: str = DEFAULTS.reference_image) -> tuple[DataFrame, DataFrame]:
    """``(model, data_url)`` of the reference image and of the models; fewer than two models are an error.

    The files are chosen by their names alone.  Only chosen ones are then read, each by the task that
    encodes it, so no content is shuffled.  There may be ``max_models`` of them.
    """
    named = named_files(spark.read.format("binaryFile").load(directory).select("path"))
    reference, models = (df.select("path").limit(DEFAULTS.max_models + 1).collect() for df in split_reference(named, basename))
    if len(models) < 2:
        raise ValueError(f"fewer than two images in {directory}")
    if len(models) > DEFAULTS.max_models:
        raise ValueError(f"more than {DEFAULTS.max_models} images in {directory}")

    def read(chosen: list) -> DataFrame:
        if not chosen:
            return spark.createDataFrame([], "model string, data_url string")
        raw = spark.read.format("binaryFile").load([literal_path(r.path) for r in chosen]).select("path", "content")
        return named_files(raw).select(F.col("stem").alias("model"), text.data_url(F.col("path"), F.col("content")).alias("data_url"))

    return read(reference), read(models)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A delimited file, or a folder of them, with a header as strings, spellings of missing values as null, and ``pos`` in file order."""
    raw = read_records(spark, path)
    return raw.select(*[text.not_missing(F.col(f"`{c}`")).alias(c) for c in raw.columns if c != "pos"], "pos")


def read_ranking(spark: SparkSession, path: str) -> DataFrame:
    """``model, win_rate`` and the other columns of a ranking in file order; foreign headers are resolved."""
    rows = read_table(spark, path)
    plain = rows.drop("pos")
    if len(plain.columns) < 2 and "win_rate" not in plain.columns:
        raise ValueError(f"{path}: a ranking has a model and a rate column")
    model, rate = columns_of(plain)
    out = rows.withColumn(rate, F.col(rate).cast("double"))
    return out.withColumnsRenamed({model: "model", rate: "win_rate"})


def read_combined(spark: SparkSession, path: str, id_col: str) -> DataFrame:
    """One wide file: the id column, label columns, ``pos``; names that normalise alike are an error."""
    rows = read_table(spark, path)
    columns = [c for c in rows.columns if c != "pos"]
    if id_col not in columns:
        raise ValueError(f"no column {id_col!r}; there are {columns}")
    if len(columns) < 2:
        raise ValueError("no label column")
    seen: dict[str, str] = {}
    for c in columns:
        if c == id_col:
            continue
        key = "".join(x for x in c if x.isascii() and x.isalnum()).lower()
        if key in seen:
            raise ValueError(f"columns {seen[key]!r} and {c!r} have the same normalised name")
        seen[key] = c
    return rows


def locate(spark: SparkSession, directory: str, models: list[str]) -> dict[str, str]:
    """Each model's assignment file by its usual names; all that lack one are reported together."""
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(directory)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    found, lost = {}, []
    for m in models:
        tries = [f"{directory.rstrip('/')}/{m}{end}" for end in (".csv", "_pred_label.csv", "_labels.csv")]
        path = next((p for p in tries if fs.exists(jvm.org.apache.hadoop.fs.Path(p))), None)
        if path:
            found[m] = path
        else:
            lost.append(m)
    if lost:
        raise ValueError(f"no assignment file for {lost} in {directory}")
    return found


def by_model(paths: list[str], models: list[str]) -> dict[str, str]:
    """Assignment files by model: the model whose name the file's stem is (with its usual endings), else, if none is, by place."""
    stems = {}
    for p in paths:
        stem = p.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
        for end in ("_pred_label", "_labels"):
            stem = stem.removesuffix(end)
        if stem in stems:
            raise ValueError(f"{stems[stem]!r} and {p!r} are of one model")
        stems[stem] = p
    if any(m in stems for m in models):
        if lost := [m for m in models if m not in stems]:
            raise ValueError(f"no assignment file for {lost}")
        return {m: stems[m] for m in models}
    if len(paths) != len(models):
        raise ValueError(f"{len(paths)} files for {len(models)} models")
    return dict(zip(models, paths))


def read_separate(spark: SparkSession, paths: dict[str, str] | list[str], models: list[str] | None = None) -> dict[str, DataFrame]:
    """One frame per model, in order; ``labels.align`` joins them and checks their rows.  A list of files is matched by ``by_model``."""
    named = paths if isinstance(paths, dict) else by_model(paths, models or [])
    return {m: read_table(spark, p) for m, p in named.items()}


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, in order; none is no error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(x.getPath().toString() for x in found or [])


def scanned_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """A row for every line of verdict files, its fields null if it is blank or broken; no files, no rows."""
    found = matching(spark, path)
    if not found:
        return spark.createDataFrame([], schemas.VERDICT)
    schema = T.StructType([*schemas.VERDICT.fields, T.StructField("_corrupt", T.StringType())])
    folder = path if len(found) == 1 and "*" not in path else found
    lines = spark.read.text(folder).withColumn("v", F.from_json("value", schema, {"columnNameOfCorruptRecord": "_corrupt"}))
    ok = F.coalesce(F.col("v._corrupt").isNull() & (text.stripped(F.col("value")) != ""), F.lit(False))
    fields = {f.name: F.when(ok, F.col(f"v.{f.name}")) for f in schemas.VERDICT.fields}
    if "repetition" in lines.columns:
        fields["repetition"] = F.when(ok, F.coalesce(F.col("v.repetition"), F.col("repetition").cast("int")))
    return lines.select(*[c.alias(n) for n, c in fields.items()], ok.alias("_read"))


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """Verdict records; blank and broken lines are left out.  Folders by repetition are read as such; a missing file is empty."""
    rows = scanned_verdicts(spark, path)
    return rows.where("_read").drop("_read") if "_read" in rows.columns else rows


def read_run(spark: SparkSession, directory: str) -> DataFrame:
    """Verdicts of a run's files by repetition; a missing repetition is passed over."""
    return read_verdicts(spark, f"{directory.rstrip('/')}/pairwise_results_rep*.jsonl")


def read_cache(spark: SparkSession, path: str, games: DataFrame | None = None) -> DataFrame | None:
    """``cache_key, gpt_choice, gpt_output`` of the store, of ``games`` only if these are given; None if there is no cache or it cannot be read."""
    try:
        rows = cache.read(spark, path, games)
        rows.limit(1).collect()
    except Exception as e:  # noqa: BLE001
        warnings.warn(f"cannot read the cache {path}: {str(e)[:200]}", stacklevel=2)
        return None
    return rows


def read_audit(spark: SparkSession, directory: str) -> list[str] | None:
    """Models that the newest audit kept, of those in ``directory`` and its folder ``pairwise``.

    None if there is none, if it cannot be read or if it kept nothing.
    """
    base = directory.rstrip("/")
    found = [p for d in (f"{base}/pairwise", base) for p in matching(spark, f"{d}/*second_round*.json")]
    if not found:
        return None
    rows = spark.read.schema(schemas.AUDIT).option("multiLine", True).json(found)
    last = rows.select("final_model_ids", F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_path").alias("f"))
    row = last.orderBy(F.desc("t"), F.desc("f")).limit(1).collect()
    return list(row[0].final_model_ids) if row and row[0].final_model_ids and None not in row[0].final_model_ids else None

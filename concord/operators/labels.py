"""Label matrices: alignment, name matching, signatures and co-association."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from concord.config import DEFAULTS
from concord.functions.text import normalized_name
from concord.sources.tables import in_order, stored


def collisions(names: DataFrame, col: str = "name") -> DataFrame:
    """Normalised names that more than one name has, with those names."""
    grouped = names.groupBy(normalized_name(F.col(col)).alias("normalized")).agg(F.sort_array(F.collect_set(col)).alias("names"))
    return grouped.where(F.size("names") > 1)


def match_columns(models: list[str], columns: list[str]) -> dict[str, str]:
    """Column of each model by normalised name; ambiguous columns and unmatched models are errors."""
    plain = lambda s: "".join(c for c in s if c.isascii() and c.isalnum()).lower()
    by: dict[str, str] = {}
    for c in columns:
        if plain(c) in by:
            raise ValueError(f"columns {by[plain(c)]!r} and {c!r} have the same normalised name")
        by[plain(c)] = c
    lost = [m for m in models if plain(m) not in by]
    if lost:
        raise ValueError(f"no column for {lost}; there are {columns}")
    return {m: by[plain(m)] for m in models}


def label_column(df: DataFrame, id_col: str, ground_truth: str | None = None) -> str:
    """The first column that is neither the id nor the ground truth."""
    rest = [c for c in df.columns if c not in (id_col, ground_truth)]
    if not rest:
        raise ValueError(f"no label column beside {id_col}")
    return rest[0]


def align(frames: dict[str, DataFrame], pos: str = "pos", ground_truth: str | None = None) -> DataFrame:
    """``id, pos`` of the first frame and one label column per model, matched on the first column.

    Frames must have as many rows as the first and no id twice; ids that the first lacks are dropped
    and ids that another lacks get null.  A missing id is matched like any other.  A column
    ``ground_truth`` is no label column.

    All frames meet in one aggregation by id, however many they are, and what the errors depend on
    is observed on its way to a table.
    """
    names, parts = list(frames), []
    for k, (name, df) in enumerate(frames.items()):
        own = df.drop(pos)
        label = F.col(f"`{label_column(own, own.columns[0], ground_truth)}`")
        place = F.col(pos) if k == 0 else F.lit(None)
        parts.append(df.select(F.col(f"`{own.columns[0]}`").alias("id"), F.lit(k).alias("_of"), place.alias("_pos"), label.alias(f"_label{k}")))
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    each = [x for k in range(len(names)) for x in (F.max(f"_label{k}").alias(f"_label{k}"), F.count(F.when(F.col("_of") == k, 1)).alias(f"_n{k}"))]
    seen = Observation()
    sums = [x for k in range(len(names)) for x in (F.sum(f"_n{k}").alias(f"rows{k}"), F.max(f"_n{k}").alias(f"most{k}"))]
    met = stored(rows.groupBy("id").agg(F.max("_pos").alias(pos), *each).observe(seen, *sums))
    counts = {name: seen.get[f"rows{k}"] or 0 for k, name in enumerate(names)}
    for k, name in enumerate(names):
        if (seen.get[f"most{k}"] or 0) > 1:
            raise ValueError(f"{name}: ids repeat")
    if len(set(counts.values())) > 1:
        raise ValueError(f"row counts differ: {counts}")
    return met.where("_n0 > 0").select("id", pos, *[F.col(f"_label{k}").alias(name) for k, name in enumerate(names)])


def recoded(df: DataFrame, label: str, out: str = "code") -> DataFrame:
    """``df`` with codes of a label column in its order, from 0; missing is -1.

    Only the distinct labels are numbered, by ranges; the rows get their codes by a join.
    """
    codes = df.select(F.col(label).alias("_label")).where("_label IS NOT NULL").distinct()
    codes = in_order(codes, [F.col("_label")], "_code").withColumn("_code", F.col("_code").cast("int"))
    return df.join(codes, F.col(label) == F.col("_label"), "left").withColumn(out, F.coalesce("_code", F.lit(-1))).drop("_label", "_code")


def bottom_rows(matrix: DataFrame, keys: list[str], size: int, seed: int = DEFAULTS.sample_seed) -> DataFrame:
    """A sample of ``size`` rows, or all if there are fewer: those whose keys have the least hashes.

    Each task keeps the least of its own and these are merged, so any partitioning gives the same rows;
    rows that share their keys also share their hash and are taken in the order of their values.
    """
    digest = F.md5(F.concat_ws("_", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))
    return matrix.orderBy(digest, *matrix.columns).limit(size)


def signatures(matrix: DataFrame, models: list[str], first: list[str]) -> DataFrame:
    """One row per distinct label tuple: ``sid, sig (array), w`` (rows) in order of first occurrence.

    Rows with one tuple are at distance 0 and at equal distance to all others, so clustering needs
    only tuples and their weights.  ``first`` are the columns that order the rows; tuples whose first
    rows are equal in these go by value.  The matrix is read once; the tuples are numbered by ranges.
    """
    sig = F.array(*[F.col(f"`{m}`").cast("string") for m in models])
    grouped = matrix.groupBy(sig.alias("sig")).agg(F.count(F.lit(1)).alias("w"), F.min(F.struct(*first)).alias("first"))
    return in_order(grouped, [F.col("first"), F.col("sig")], "sid").select("sid", "sig", "w")


def disagreement(a: Column, b: Column) -> Column:
    """In how many places two tuples differ; missing agrees with missing."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1)), F.lit(0), lambda s, x: s + x)


def coassociation(sigs: DataFrame, shared: int = 0) -> DataFrame:
    """``i, j, wi, wj, disagree, distance`` for signatures i < j that share ``shared`` labels or more.

    With ``shared`` above 0 only those meet that have one of their rarest labels in common: of M labels
    in one order of rarity, two tuples that share t have one of the first M - t + 1 of each in common.
    With 0 the result is every pair, by definition.
    """
    d = disagreement(F.col("si"), F.col("sj"))
    a = sigs.select(F.col("sid").alias("i"), F.col("sig").alias("si"), F.col("w").alias("wi"))
    b = sigs.select(F.col("sid").alias("j"), F.col("sig").alias("sj"), F.col("w").alias("wj"))
    if shared < 1:
        met = a.join(b, F.col("i") < F.col("j"))
    else:
        cells = sigs.select("sid", F.size("sig").alias("models"), F.posexplode("sig").alias("m", "label"))
        often = cells.groupBy(F.col("m").alias("m2"), F.col("label").alias("label2")).agg(F.count(F.lit(1)).alias("often"))
        place = F.row_number().over(Window.partitionBy("sid").orderBy("often", "m"))
        known = cells.join(often, (F.col("m") == F.col("m2")) & F.col("label").eqNullSafe(F.col("label2"))).withColumn("place", place)
        posts = stored(known.where((F.col("place") <= F.col("models") - shared + 1) & (F.col("often") > 1)).select("sid", "m", "label"))
        other = posts.toDF("j", "m2", "label2")
        pairs = posts.withColumnRenamed("sid", "i").join(other, (F.col("m") == F.col("m2")) & F.col("label").eqNullSafe(F.col("label2")) & (F.col("i") < F.col("j")))
        met = pairs.select("i", "j").distinct().join(a, "i").join(b, "j").where(d <= F.size("si") - shared)
    return met.select("i", "j", "wi", "wj", d.alias("disagree"), (d / F.size("si")).alias("distance"))


def k_counts(matrix: DataFrame, models: list[str]) -> DataFrame:
    """``sel_pos, model, k``: distinct labels of each model, a missing one counting once, in one pass."""
    aggs = [x for m in models for x in (F.count_distinct(m).alias(f"d_{m}"), F.max(F.col(m).isNull().cast("int")).alias(f"n_{m}"))]
    one = matrix.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(k).alias("sel_pos"), F.lit(m).alias("model"), (F.col(f"d_{m}") + F.col(f"n_{m}")).cast("long").alias("k")) for k, m in enumerate(models)])
    return one.select(F.inline(rows))


def _in_range(counts: DataFrame, k_range) -> DataFrame:
    return counts.where(F.col("k").isin(*map(int, k_range)))


def k_median(counts: DataFrame, k_range=DEFAULTS.k_range) -> DataFrame:
    """One row ``k``: the median of the counts in range, halves to even; null if none is in range."""
    return _in_range(counts, k_range).agg(F.bround(F.median("k"), 0).cast("int").alias("k"))


def k_mode(counts: DataFrame, k_range=DEFAULTS.k_range) -> DataFrame:
    """One row ``k``: the most common count in range, the first selected one of equals."""
    grouped = _in_range(counts, k_range).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("sel_pos").alias("p"))
    return grouped.orderBy(F.desc("n"), "p").limit(1).select(F.col("k").cast("int").alias("k"))


def stacked(matrix: DataFrame, models: list[str], keys: list[str]) -> DataFrame:
    """A label matrix in long form: ``keys, model, label``."""
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).cast("string").alias("label")) for m in models])
    return matrix.select(*keys, F.inline(rows))



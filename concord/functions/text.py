"""Scalar functions over names, verdicts and replies, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord import schemas

#: Spellings of a missing value in delimited files.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
#: MIME types by file extension; anything else counts as the default.
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg"}
MIME_DEFAULT = "image/jpeg"


def normalized_name(name: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.lower(F.regexp_replace(name, "[^0-9A-Za-z]+", ""))


def parsed_choice(reply: Column) -> Column:
    """The first whole word ``first`` or ``second`` of a reply, in lower case; else null."""
    return F.nullif(F.lower(F.regexp_extract(reply, r"(?i)\b(first|second)\b", 1)), F.lit(""))


#: White space of any kind at either end.
_BLANK = r"[\x09-\x0D\x1C-\x20\x{85}\p{Z}]+"


def stripped(value: Column) -> Column:
    """A string without white space of any kind, line ends included, at its ends."""
    return F.regexp_replace(value, f"^{_BLANK}|{_BLANK}$", "")


def canonical_choice(choice: Column) -> Column:
    """``first`` or ``second``; everything else, failures included, is a ``tie``."""
    plain = F.lower(stripped(F.coalesce(choice, F.lit(""))))
    return F.when(plain.isin("first", "second"), plain).otherwise("tie")


def winner(choice: Column, one: Column, two: Column) -> Column:
    """The winning side's name, or ``tie``."""
    verdict = canonical_choice(choice)
    return F.when(verdict == "first", one).when(verdict == "second", two).otherwise("tie")


def named(value: Column) -> Column:
    """Whether a side's name is there and not empty."""
    return F.coalesce(value != "", F.lit(False))


def cache_key(*parts: Column, dataset: Column | None = None, content: Column | None = None) -> Column:
    """MD5 of the parts joined by ``_``; missing parts read ``None``.

    The plain key does not tell data sets or image contents apart; give ``dataset`` and ``content``
    (a digest) for one that does.
    """
    every = [F.coalesce(p.cast("string"), F.lit("None")) for p in (*parts, *(x for x in (dataset, content) if x is not None))]
    return F.md5(F.concat_ws("_", *every))


def unfenced(reply: Column) -> Column:
    """A reply without the fences around its JSON."""
    return F.trim(F.regexp_replace(reply, r"```json\s*|\s*```", ""))


def parsed_reply(reply: Column) -> Column:
    """An auditor's reply as a struct; null if it is not JSON."""
    return F.from_json(unfenced(reply), schemas.REPLY)


def file_name(name: Column) -> Column:
    """A data set's name as part of a file name: words, blanks as ``_``, dashes."""
    kept = F.regexp_replace(name, r"[^\p{L}\p{M}\p{N}_\s-]", "")
    return F.regexp_replace(F.trim(kept), " ", "_")


def data_url(path: Column, content: Column) -> Column:
    """Bytes as a data URL whose type follows the path's extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1))
    mime = F.lit(MIME_DEFAULT)
    for k, v in MIME.items():
        mime = F.when(ext == k, v).otherwise(mime)
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))


def not_missing(value: Column) -> Column:
    """A delimited file's field, with the spellings of a missing value as null."""
    return F.when(~value.isin(*MISSING), value)


def clean_distance(value: Column) -> Column:
    """A distance within 0 and 1: not-a-number and plus infinity count as 1, minus infinity as 0."""
    return F.when(F.isnan(value), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))


def hygienic(distances: DataFrame) -> DataFrame:
    """``i, j, distance`` made clean: both directions averaged, the diagonal 0, all within 0 and 1.

    A direction that is not there counts as the other one; not-a-number is 1.
    """
    filled = F.when(F.isnan("distance"), 1.0).otherwise(F.col("distance").cast("double"))
    plain = F.when(filled == float("inf"), 1.0).when(filled == float("-inf"), 0.0).otherwise(filled)
    both = distances.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), plain.alias("d"))
    mean = both.groupBy("i", "j").agg(F.avg("d").alias("d"))
    clean = mean.withColumn("distance", F.when(F.col("i") == F.col("j"), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("d")))))
    turned = clean.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "distance")
    return clean.select("i", "j", "distance").unionByName(turned)


def provider_parts(messages: Column) -> Column:
    """Chat messages with their parts renamed for a provider that calls them inputs."""

    def part(p):
        return F.struct(
            F.when(p["type"] == "text", "input_text").when(p["type"] == "image_url", "input_image").otherwise(p["type"]).alias("type"),
            p["text"].alias("text"), p["url"].alias("url"),
        )

    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), F.transform(m["content"], part).alias("content")))

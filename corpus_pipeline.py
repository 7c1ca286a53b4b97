"""A corpus pipeline of five of the text operators, each stage written and read again by the next.

Quality classifier, line dedup, SimHash near-dedup, mixing to target weights, BPE.  Every stage but
the last returns the columns of ``documents``; every one works on all that the one before kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import bpe, linededup, mixing, quality, simhash
from concord.llm.common import Table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; null and empty texts are rejected, repeated rows fare alike."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.filtered(docs.select(COLUMNS), labels)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go from the texts; a text may end up empty, a null one does.

    Rows of equal id and text count as one occurrence; a null id is later than any other.
    """
    out = linededup.cleaned(docs.select(COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, likeness 0.8) the document with the least id stays.

    Null, empty and blank texts are one group.  Of rows with the least id that of the least hash stays,
    once; of groups without any id one row of each text.
    """
    return simhash.representatives(docs.select(COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: those without a word never, equal rows as evenly as it goes; a null source is the last."""
    return mixing.mixed(docs.select(COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document in the mix, a row for each copy; a null text has no token."""
    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", dedup_lines),
    ("simhash near-dedup", dedup_near),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The field and the draws of the mix have no counterpart in SQL; tests hold ``run`` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, with a table in the shared folder after each but the last."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            table = Table(docs, "stage")
            if before:
                before.drop()
            docs, before = table.df, table
    return docs

"""The registered query of each corpus operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import bpe, embeddings, extract, licences, linededup, minhash, mixing, phrases, quality, rules, simhash, spelling, substring


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality classifier: every document's score by the field fitted to the labels not held out."""
    out = quality.scored(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return out.select("doc_id", "judged.held_out", "judged.score", "judged.predicted")


def op2_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML extraction: the main text of every page."""
    out = extract.extracted(_read(spark, sf_dir, "pages"))
    return out.select("page_id", "url", F.col("main").alias("text"), F.length("main").cast("long").alias("n_chars"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixing: the words that the mix takes of every document, beside its source's target."""
    out = mixing.mix(_read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules: counts and verdict for every document."""
    out = rules.measured(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", *[f"rules.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BPE: every document's token ids and their decoding, as digests."""
    out = bpe.digests(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.withColumnRenamed("id", "doc_id")


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring dedup: what every document keeps once 13-word windows of earlier documents are gone."""
    out = substring.dedup_substrings(_read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence scans: the licences that every document states."""
    return licences.scanned(_read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they look."""
    out = minhash.fingerprinted(_read(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup: how many lines every document loses to repeated windows, and a digest of the rest."""
    out = linededup.dedup_lines(_read(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", F.col("cut.lines").alias("n_lines"), F.col("cut.removed").alias("n_removed"), linededup.digest_of(F.col("cut.text")).alias("kept_sha256")
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates: every document with its fingerprint and component."""
    out = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants: every word with its form, its root and how many words are near."""
    return spelling.variants(_read(spark, sf_dir, "documents"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations: each language's best phrases of two to five words."""
    return phrases.collocations(_read(spark, sf_dir, "documents"))


def op13_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding near-dedup: every vector's links and component."""
    return embeddings.near_vectors(_read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_extract": op2_extract,
    "op3_mixing": op3_mixing,
    "op4_rules": op4_rules,
    "op5_bpe": op5_bpe,
    "op6_substring": op6_substring,
    "op7_licences": op7_licences,
    "op8_minhash": op8_minhash,
    "op9_linededup": op9_linededup,
    "op10_simhash": op10_simhash,
    "op11_spelling": op11_spelling,
    "op12_phrases": op12_phrases,
    "op13_embeddings": op13_embeddings,
}
ORACLE_SQL: dict[str, str] = {
    "op4_rules": rules.rules_sql(),
    "op7_licences": licences.scan_sql(),
    "op12_phrases": phrases.collocations_sql(),
    "op13_embeddings": embeddings.near_vectors_sql(),
    "op6_substring": r"""
        WITH word AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), win AS (
            SELECT doc_id, n, array_to_string(w[n:n + 12], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS n FROM word WHERE len(w) >= 13)
        ), first AS (
            SELECT s, min(doc_id) AS low FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)
        ), gone AS (
            SELECT doc_id, list_distinct(flatten(list(range(n, n + 13)))) AS pos FROM win JOIN first USING (s) WHERE doc_id > low GROUP BY doc_id
        ), kept AS (
            SELECT doc_id, w, len(coalesce(pos, [])) AS removed,
                   CASE WHEN pos IS NULL THEN w WHEN len(pos) = len(w) THEN [] ELSE
                   (SELECT list(x.v ORDER BY x.k) FROM (SELECT unnest(w) AS v, unnest(range(1, len(w) + 1)) AS k) x WHERE NOT list_contains(pos, x.k)) END AS rest
            FROM word LEFT JOIN gone USING (doc_id)
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, removed::BIGINT AS n_removed, sha256(array_to_string(coalesce(rest, []), ' ')) AS kept_sha256 FROM kept
    """,
    "op9_linededup": r"""
        WITH line AS (
            SELECT doc_id, pos, s FROM (
                SELECT doc_id, unnest(l) AS s, unnest(range(len(l))) AS pos
                FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
        ), worded AS (
            SELECT *, row_number() OVER w - 1 AS n, lead(s) OVER w AS s2, lead(s, 2) OVER w AS s3
            FROM line WHERE regexp_matches(s, '[^\x20\x09-\x0D]') WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
        ), repeated AS (
            SELECT doc_id, n FROM (
                SELECT doc_id, n, row_number() OVER (PARTITION BY s, s2, s3 ORDER BY doc_id, n) AS k FROM worded WHERE s3 IS NOT NULL)
            WHERE k > 1
        ), gone AS (
            SELECT DISTINCT w.doc_id, w.pos FROM worded w JOIN repeated r ON w.doc_id = r.doc_id AND w.n BETWEEN r.n AND r.n + 2
        )
        SELECT line.doc_id, count(*)::BIGINT AS n_lines, count(gone.pos)::BIGINT AS n_removed,
               sha256(coalesce(string_agg(s, chr(10) ORDER BY line.pos) FILTER (WHERE gone.pos IS NULL), '')) AS kept_sha256
        FROM line LEFT JOIN gone ON line.doc_id = gone.doc_id AND line.pos = gone.pos GROUP BY line.doc_id
    """,
}

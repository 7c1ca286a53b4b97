"""Quality rules, line first: bad lines go, then documents that lose too much of their text.

Everything is a DataFrame expression over one row, so nothing is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.common import SPACE, WORD, free, others

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Phrases that mark a line as boilerplate.
BOILERPLATE = (
    "all rights reserved", "accept cookies", "cookie policy", "privacy policy", "terms of use", "terms of service",
    "enable javascript", "click here", "sign in to", "log in to", "subscribe to our", "share this", "back to top", "skip to content",
    "alle rechte vorbehalten", "cookies akzeptieren", "datenschutzerklärung", "nutzungsbedingungen", "hier klicken", "zum seitenanfang",
    "tous droits réservés", "accepter les cookies", "politique de confidentialité", "conditions d.utilisation", "cliquez ici", "haut de page",
    "todos los derechos reservados", "aceptar cookies", "política de privacidad", "términos de uso", "haga clic aquí", "volver arriba",
)
#: What a line of prose ends with.
ENDS = r"[.!?…:;,)\]\"'”’»。！？]\z"
#: A stock phrase as whole words.
STOCK = rf"(?:^|[^\p{{L}}])(?:{'|'.join(BOILERPLATE)})(?:[^\p{{L}}]|\z)"
#: Parts of a line that hold a decorated word, such as ``word***`` or ``WORD!!``.
DECORATED = r"[^\x20\x09-\x0D](?:[#*$%&<>]{2,}|!{2,})(?=[\x20\x09-\x0D]|$)"
SEPARATOR = r"(?:^|[\x20\x09-\x0D])[|>»·•](?=[\x20\x09-\x0D]|$)"


def words_of(text: Column) -> Column:
    """The words of a text as an array."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def line_fails(line: Column, words: Column, min_words: int = 3) -> Column:
    """Whether a line breaks a rule; ``words`` is how many words it has.

    Punctuation: it has fewer than ``min_words`` words and no end mark, or a fifth of its words are
    decorated by symbols.  Navigation: separators stand beside a sixth of its words or more.
    Boilerplate: it is short and holds a stock phrase.
    """
    bare = (words < min_words) & ~line.rlike(ENDS)
    # Looking for single characters is cheap, and most lines have none.
    has = lambda marks: reduce(lambda a, b: a | b, [F.contains(line, F.lit(c)) for c in marks])
    decorated = has([*"#*$%&<>", "!!"]) & (F.regexp_count(line, F.lit(DECORATED)) * 5 >= words)
    menu = has("|>»·•") & (F.regexp_count(line, F.lit(SEPARATOR)) * 6 >= words)
    stock = (words <= 20) & F.lower(line).rlike(STOCK)
    return bare | decorated | menu | stock


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur more than once, given a column of word arrays.

    Windows are sorted with their places; equal neighbours are repeats.  The places then cover
    three words each, less the overlap with the next.
    """
    places = F.array_sort(F.transform(words, lambda x: x["n"]))
    following = F.concat(F.slice(places, 2, F.greatest(F.size(places), F.lit(1))), F.array(F.lit(1 << 30)))
    spans = F.zip_with(places, following, lambda a, b: F.least(F.lit(3), b - a))
    covered = F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(F.size(words) > 0, covered).otherwise(F.lit(0).cast("long"))


def measured(docs: DataFrame, text_col: str = "text", lost: float = 0.5, min_words: int = 50, out: str = "rules") -> DataFrame:
    """``docs`` with a struct column ``out`` (in place of one of that name): the base counts, ``base_failed`` and ``kept``.

    ``kept`` is false if a document has too few words, repeats more than half of them, or loses
    more than ``lost`` of its word characters with its bad lines.  ``clean`` is the text of the good
    lines.  Null texts count as empty.
    """
    names = [f"_{k}" for k in range(len(docs.columns))]
    own = dict(zip(docs.columns, names))
    rows = docs.toDF(*names)
    t = F.coalesce(F.col(own[text_col]).cast("string"), F.lit(""))
    rows = rows.withColumn("t", t).withColumn("w", words_of(F.col("t"))).withColumn("lines", F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD)))
    n, w = F.size("w"), F.col("w")
    windows = F.greatest(n - 2, F.lit(0))
    parts = [F.slice(w, k, windows).alias(c) for k, c in enumerate("abc", 1)]
    rows = rows.withColumn("parts", F.arrays_zip(*parts).cast("array<struct<a:string,b:string,c:string>>"))
    rows = rows.withColumn("hashes", F.transform("parts", lambda x: F.xxhash64(x["a"], x["b"], x["c"])))
    # Equal windows have equal hashes, so texts in which all differ need no more; the words still decide between equal ones.
    zipped = F.zip_with("parts", "hashes", lambda x, h: F.struct(h.alias("h"), x["a"].alias("a"), x["b"].alias("b"), x["c"].alias("c")))
    zipped = F.transform(zipped, lambda x, k: F.struct(x["h"].alias("h"), x["a"].alias("a"), x["b"].alias("b"), x["c"].alias("c"), k.alias("n")))
    rows = rows.withColumn("sorted", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.sort_array(zipped)))
    s = F.col("sorted")

    def same(x, k):
        y = F.get(s, k)
        return F.coalesce((x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))

    # Null where no window is found twice.
    twice = F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))
    # A line's words are counted once, not in each rule.
    counted = F.transform("lines", lambda x: F.struct(x.alias("line"), F.regexp_count(x, F.lit(WORD)).alias("words")))
    rows = rows.withColumn("twice", twice).withColumn("counted", counted)
    good = F.filter("counted", lambda x: ~line_fails(x["line"], x["words"]))
    rows = rows.withColumn("good", F.transform(good, lambda x: x["line"]))
    chars = lambda c: F.length(F.regexp_replace(c, SPACE, "")).cast("long")
    found = rows.select(
        *names,
        F.array_join("good", "\n").alias("clean"),
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("twice")).alias("n_repeat_words"),
        chars(F.array_join("good", "")).alias("good_chars"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    found = found.withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (F.col("good_chars") >= F.col("word_chars") * F.lit(1 - lost))
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "clean"]
    return found.select(*[F.col(own[c]).alias(c) for c in others(docs.columns, out)], F.struct(*fields).alias(out))


def filtered(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that are kept, with only their good lines."""
    name = free(docs.columns, "rules")
    out = measured(docs, text_col, out=name, **options)
    # A condition is not pushed below what makes rows, so the counts are made once, above all steps that they refer to.
    out = out.select(*others(out.columns, name), F.explode(F.array(name)).alias(name))
    return out.where(out[name]["kept"]).select(*[out[name]["clean"].alias(c) if c == text_col else out[c] for c in docs.columns])


def rules_sql() -> str:
    """Counts and verdict over ``documents`` in DuckDB's SQL."""
    word = r"[^\x20\x09-\x0D]+"
    return rf"""
        WITH doc AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents
        ), win AS (
            SELECT doc_id, n, w[n] AS a, w[n + 1] AS b, w[n + 2] AS c
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS n FROM doc WHERE len(w) > 2)
        ), rep AS (
            SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (
                SELECT doc_id, unnest([n, n + 1, n + 2]) AS p FROM (
                    SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM win) WHERE k > 1)
            GROUP BY doc_id
        ), line AS (
            SELECT doc_id, l, regexp_extract_all(l, '{word}') AS lw FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM doc)
        ), judged AS (
            SELECT doc_id, l, length(array_to_string(lw, '')) AS chars,
                   (len(lw) < 3 AND NOT regexp_matches(l, '{ENDS.replace("'", "''")}'))
                   OR len(list_filter(lw, lambda x: regexp_matches(x, '(?s).([#*$%&<>]{{2,}}|!{{2,}})$'))) * 5 >= len(lw)
                   OR len(list_filter(lw, lambda x: x IN ('|', '>', '»', '·', '•'))) * 6 >= len(lw)
                   OR (len(lw) <= 20 AND regexp_matches(lower(l), '{STOCK}')) AS fails
            FROM line WHERE len(lw) > 0
        ), by_line AS (
            SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines, coalesce(sum(chars) FILTER (WHERE NOT fails), 0) AS good FROM judged GROUP BY doc_id
        ), found AS (
            SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                   length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
                   coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(good, 0) AS good
            FROM doc LEFT JOIN rep USING (doc_id) LEFT JOIN by_line USING (doc_id)
        ), based AS (
            SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM found
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND good >= word_chars * 0.5 AS kept FROM based
    """

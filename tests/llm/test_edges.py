"""Every operator and stage on nulls, empty and long texts, ties, repeats, clashing columns and empty tables."""

import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from concord.llm import bpe, extract, licences, linededup, minhash, mixing, quality, rules, simhash, substring

LONG = " ".join(f"word{k % 977}" for k in range(20_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, t string, fp string, starts string, key string, w string, `_0` string, cut string"
ROWS = [
    (1, "one two three four five six\nseven eight nine\nten eleven.", "en", "a", 3),
    (1, "one two three four five six\nseven eight nine\nten eleven.", "en", "a", 3),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, LONG, "en", "b", 5),
    (5, LONG, None, None, 5),
    (None, "one two three four five six\nseven eight nine\nten eleven.", "en", "b", 1),
    (None, None, "en", None, 1),
    (6, "  \n\n \t", "en", "", 1),
    (7, "x" * 50_000, "de", "c", 1),
]
EXTRA = (9, "t", "fp", "s", "k", "w", "_0", "cut")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([r + EXTRA for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, None), (5, None, None), (3, 0, 0)], "doc_id long, quality int, toxic int")


def operators(labels, tokenizer):
    return {
        "quality": lambda d: quality.scored(d, labels),
        "extract": lambda d: extract.extracted(d, "text"),
        "mix": mixing.mix,
        "rules": rules.measured,
        "bpe": lambda d: bpe.digests(d, tokenizer),
        "substring": substring.dedup_substrings,
        "licences": licences.scanned,
        "minhash": minhash.fingerprinted,
        "linededup": linededup.dedup_lines,
        "simhash": simhash.near_duplicates,
    }


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


NAMES = ["quality", "extract", "mix", "rules", "bpe", "substring", "licences", "minhash", "linededup", "simhash"]


@pytest.mark.parametrize("name", NAMES)
def test_one_row_each(docs, labels, tokenizer, name):
    run = operators(labels, tokenizer)[name]
    assert len(run(docs).collect()) == len(ROWS)
    assert run(docs.limit(0)).collect() == []


def test_values_of_edge_rows(docs, labels, tokenizer):
    by_op = operators(labels, tokenizer)
    cut = by_op["substring"](docs).collect()
    # Equal ids are not compared; a null id is larger than all others.
    assert sorted((r.id if r.id is not None else 99, r.n_words, r.n_removed) for r in cut)[:2] == [(1, 11, 0), (1, 11, 0)]
    assert next(r for r in cut if r.id == 5).n_removed == 20_000
    lines = {(r.doc_id, r.text): r.cut for r in by_op["linededup"](docs).collect()}
    assert lines[(1, ROWS[0][1])].removed == 0 and lines[(None, ROWS[0][1])].removed == 3
    assert lines[(2, None)].text == "" and lines[(2, None)].lines == 1
    near = by_op["simhash"](docs).collect()
    assert {r.component_id for r in near if r.id in (2, 3, 6)} == {2}
    assert {r.component_id for r in near if r.id in (4, 5)} == {4}
    assert next(r for r in near if r.id is None and r.fp != 0).component_id == 1
    judged = {r.doc_id: r.judged for r in by_op["quality"](docs).collect()}
    assert judged[2].score == 0.0 and judged[3].score == 0.0 and 0 < judged[4].score < 1
    prints = by_op["minhash"](docs).collect()
    assert {r.fingerprint for r in prints if r.id in (2, 3, 6)} == {""}
    assert len({r.fingerprint for r in prints if r.id in (4, 5)}) == 1
    assert next(r for r in by_op["bpe"](docs).collect() if r.id == 2).n_tokens == 0


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, docs, labels, tmp_path, stage):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    name, run = corpus_pipeline.STAGES[stage]
    out = run(spark, docs, str(tmp_path))
    assert out.count() > 0
    if stage < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == corpus_pipeline.COLUMNS
    assert run(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_clashing_columns_come_back(docs):
    out = rules.measured(docs)
    assert out.columns == [*docs.columns, "rules"]
    cut = linededup.cleaned(docs)
    assert cut.columns == docs.columns and {r.cut for r in cut.select("cut").collect()} == {"cut"}
    assert out.select(F.col("t")).distinct().collect()[0].t == "t"


def test_every_operator_that_returns_its_input_keeps_clashing_columns(spark, docs, labels):
    kept = {
        "quality": quality.filtered(docs, labels), "mixed": mixing.mixed(docs), "near": simhash.representatives(docs), "rules": rules.filtered(docs, min_words=1),
        "lines": linededup.cleaned(docs),
    }
    for out in kept.values():
        assert out.columns == docs.columns and out.count() > 0
        assert {tuple(r) for r in out.select("id", "t", "fp", "_0").collect()} == {(9, "t", "fp", "_0")}
    judged, read = quality.scored(docs, labels, out="fp"), extract.extracted(docs, "text", out="cut")
    assert sorted(judged.columns) == sorted(docs.columns) and sorted(read.columns) == sorted(docs.columns)
    left = kept["near"].select("doc_id", "text").collect()
    assert len({r.text for r in left if r.text and r.text.strip()}) == 3 and len(left) == 4


def test_long_texts_are_filtered_in_little_time(spark):
    rows = [(k, " ".join(f"word{j % (900 + k)}" for j in range(20_000))) for k in range(4)] + [(9, ("a b c d e f g. " * 40 + "\n") * 3 + "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    start = time.time()
    assert rules.filtered(docs).count() == 0 and rules.filtered(docs, min_words=1).collect() == []
    prose = spark.createDataFrame([(1, ". ".join(f"One{j} two{j} three{j} four{j}" for j in range(5_000)) + ".\nmenu"), (2, None)], "doc_id long, text string")
    kept = rules.filtered(prose).collect()
    assert [r.doc_id for r in kept] == [1] and kept[0].text.endswith("four4999.") and time.time() - start < 60


def test_phrases_are_whole_words(spark):
    lines = ["A new design in the spring was shown.", "There was a long dialog in the hall today.", "They subscribe to reason and nothing else."]
    stock = ["Please sign in to go on reading this.", "Bitte alle Cookies akzeptieren, danke sehr.", "Tous droits réservés, bien entendu, ici."]
    frame = spark.createDataFrame([(x, len(x.split())) for x in lines + stock], "l string, n int")
    got = frame.select("l", rules.line_fails(F.col("l"), F.col("n")).alias("bad")).collect()
    assert [r.l for r in got if r.bad] == stock


def test_a_lines_words_are_counted_once(spark):
    """The count of a line's words stands once in the plan of the rules, not in each rule; windows found twice still count."""
    docs = spark.createDataFrame([(1, "a b c a b c"), (2, "a b c d")], "doc_id long, text string")
    out = rules.measured(docs)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(f", {rules.WORD}, 0)") == 1
    assert [r.rules.n_repeat_words for r in out.orderBy("doc_id").collect()] == [6, 0]

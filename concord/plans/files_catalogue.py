"""Registered queries of readers, writers, drivers and the rest of the scalar rules, with their SQL.

Readers and writers work on files that the query first puts into a scratch folder of its own.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord import schemas
from concord.functions import text
from concord.operators import audit, judges, labels, selection, tournament
from concord.plans import pipeline
from concord.plans.catalogue import (
    _CUTS_SQL, _DOC_SQL, _LINES_SQL, _M3, _ORDERS_SQL, _SUMS_SQL, _TALLY_SQL,
    _ari_sql, _cut_sql, _KS, _keyed_games, _line_matrix, _LINE_KEYS, _literal, _order_verdicts, _read, _tree_sql, _values, query,
)
from concord.sources import cache, files, sinks
from concord.streaming import ranking as stream_ranking
from concord.streaming import tournament as stream_tournament

# --- files ---------------------------------------------------------------------------------------

_MIME_SQL = "CASE ext WHEN 'png' THEN 'image/png' ELSE 'image/jpeg' END"


@query(f"""
    WITH p AS (SELECT p_partkey, p_name, CASE p_partkey % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' WHEN 2 THEN 'jpeg' ELSE 'gif' END AS ext FROM part)
    SELECT p_partkey, 'data:' || {_MIME_SQL} || ';base64,' || to_base64(encode(p_name)) AS data_url FROM p
""")
def image_encode(spark, sf_dir):
    ext = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'JPG' WHEN 2 THEN 'jpeg' ELSE 'gif' END")
    rows = _read(spark, sf_dir, "part").withColumn("path", F.concat(F.lit("/d/x."), ext))
    return rows.select("p_partkey", text.data_url(F.col("path"), F.col("p_name").cast("binary")).alias("data_url"))


def _regions(spark, sf_dir) -> list[str]:
    return sorted(r.r_name for r in _read(spark, sf_dir, "region").select("r_name").collect())  # five names


def _image_folder(spark, sf_dir) -> str:
    """A folder with an image for each region, one of them twice, and a reference."""
    folder = f"{sinks.scratch(spark)}/images"
    for name in _regions(spark, sf_dir):
        sinks.put(spark, f"{folder}/{name}.png", name.encode())
    sinks.put(spark, f"{folder}/{name}.jpg", b"not this one")
    sinks.put(spark, f"{folder}/notes.txt", b"no image")
    sinks.put(spark, f"{folder}/he.png", b"reference")
    return folder


@query("""
    SELECT r_name AS model, 'data:image/png;base64,' || to_base64(encode(r_name)) AS data_url, false AS reference FROM region
    UNION ALL SELECT 'he', 'data:image/png;base64,' || to_base64(encode('reference')), true
""")
def images_found(spark, sf_dir):
    reference, models = files.read_images(spark, _image_folder(spark, sf_dir))
    return models.withColumn("reference", F.lit(False)).unionByName(reference.withColumn("reference", F.lit(True)))


_STEMS = "'/d/' || (CASE n_regionkey WHEN 0 THEN 'he' WHEN 1 THEN 'he2' ELSE left(n_name, 1) END) || (CASE n_nationkey % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' WHEN 2 THEN '.gif' ELSE '.jpeg' END)"


@query(f"""
    WITH f AS (SELECT DISTINCT {_STEMS} AS path FROM nation),
    e AS (SELECT path, regexp_extract(path, '/([^/]*)[.]', 1) AS stem, CASE WHEN path LIKE '%.png' THEN 0 ELSE 1 END AS place FROM f WHERE path NOT LIKE '%.gif')
    SELECT path, stem = 'he' AS reference FROM e QUALIFY row_number() OVER (PARTITION BY stem ORDER BY place, path) = 1
""")
def reference_stem(spark, sf_dir):
    paths = _read(spark, sf_dir, "nation").select(F.expr(_STEMS).alias("path")).distinct()
    found = files.split_reference(files.named_files(paths), "he")
    return found[0].select("path", F.lit(True).alias("reference")).unionByName(found[1].select("path", F.lit(False).alias("reference")))


@query(f"WITH {_ORDERS_SQL}, {_TALLY_SQL} SELECT model, games::VARCHAR AS games, win_rate FROM ranked")
def ranking_file(spark, sf_dir):
    path = f"{sinks.scratch(spark)}/ranking"
    sinks.write_ranking(tournament.ranking(_order_verdicts(spark, sf_dir)), path)
    return files.read_ranking(spark, path).select("model", "games", "win_rate")


@query("SELECT n_name AS model, n_nationkey / 25.0::DOUBLE AS win_rate FROM nation")
def ranking_foreign(spark, sf_dir):
    path = f"{sinks.scratch(spark)}/ranking"
    rows = _read(spark, sf_dir, "nation").select(F.col("n_name").alias("Model"), "n_regionkey", (F.col("n_nationkey") / 25.0).alias("WinningRate"))
    sinks.write_ranking(rows, path)
    return files.read_ranking(spark, path).select("model", "win_rate")


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_brand, CASE WHEN p_size % 7 <> 0 THEN p_size::VARCHAR END AS p_size FROM part")
def assignments_combined(spark, sf_dir):
    path = f"{sinks.scratch(spark)}/all.csv"
    size = F.when(F.col("p_size") % 7 == 0, "NA").otherwise(F.col("p_size").cast("string")).alias("p_size")
    _read(spark, sf_dir, "part").select("p_partkey", "p_brand", size).write.option("header", True).csv(path)
    return files.read_combined(spark, path, "p_partkey").drop("pos")


def _separate(spark, sf_dir) -> str:
    folder, rows = sinks.scratch(spark), _read(spark, sf_dir, "part")
    rows.select("p_partkey", "p_brand").write.option("header", True).csv(f"{folder}/m1.csv")
    rows.select("p_partkey", "p_type", "p_name").repartition(3, "p_type").write.option("header", True).csv(f"{folder}/m2_pred_label.csv")
    return folder


_SEPARATE_SQL = "SELECT p_partkey::VARCHAR AS id, p_brand AS m1, p_type AS m2 FROM part"


@query(_SEPARATE_SQL)
def assignments_separate(spark, sf_dir):
    found = files.locate(spark, _separate(spark, sf_dir), ["m1", "m2"])
    return labels.align(files.read_separate(spark, found)).select("id", "m1", "m2")


@query(_SEPARATE_SQL)
def assignments_by_stem(spark, sf_dir):
    folder = _separate(spark, sf_dir)
    given = [f"{folder}/m2_pred_label.csv", f"{folder}/m1.csv"]
    return labels.align(files.read_separate(spark, given, ["m1", "m2"])).select("id", "m1", "m2")


@query(f"WITH {_ORDERS_SQL} SELECT m1 AS model1_label, m2 AS model2_label, rep AS repetition, nullif(choice, 'tie') AS gpt_choice FROM verdict")
def verdict_files(spark, sf_dir):
    path = f"{sinks.scratch(spark)}/verdicts"
    sinks.write_verdicts(_order_verdicts(spark, sf_dir).withColumn("gpt_choice", F.lit(None).cast("string")), path)
    sinks.write_verdicts(_order_verdicts(spark, sf_dir), path)  # again: replaces
    return files.read_verdicts(spark, path).select("model1_label", "model2_label", "repetition", "gpt_choice")


@query(f"WITH {_ORDERS_SQL} SELECT 3 * count(*)::BIGINT AS total_rows, count(*)::BIGINT AS used_rows FROM verdict")
def verdict_scan(spark, sf_dir):
    """Counters over a file where every other line is blank or broken."""
    path = f"{sinks.scratch(spark)}/rep1.jsonl"
    rows = _order_verdicts(spark, sf_dir)
    lines = F.array(F.to_json(F.struct(*rows.columns)), F.lit(" \t"), F.lit("{broken"))
    rows.select(F.explode(lines).alias("value")).write.text(path)
    missing = files.scanned_verdicts(spark, path + "-none").select("model1_label", "model2_label")
    return tournament.counters(files.scanned_verdicts(spark, path).select("model1_label", "model2_label").unionByName(missing))


@query(f"""
    WITH {_ORDERS_SQL}, {_TALLY_SQL}, top AS (SELECT model FROM placed WHERE place <= 3)
    SELECT rep AS repetition, m1 AS model1_label, m2 AS model2_label FROM verdict
    WHERE m1 IN (SELECT model FROM top) AND m2 IN (SELECT model FROM top)
""")
def audit_scan(spark, sf_dir):
    """Verdicts among the best three, from one file per repetition."""
    folder, rows = sinks.scratch(spark), _order_verdicts(spark, sf_dir)
    for (rep,) in rows.select("repetition").distinct().collect():  # seven years
        rows.where(F.col("repetition") == rep).select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(f"{folder}/pairwise_results_rep{rep}.jsonl")
    top = selection.top_fixed(tournament.tally(rows), 3)
    return audit.within(files.read_run(spark, folder), top).select("repetition", "model1_label", "model2_label")


@query(f"""
    WITH {_ORDERS_SQL}, keyed AS (SELECT md5(m1 || '_' || m2 || '_' || rep || '_simple_judge_1.0_medium') AS cache_key, rep FROM verdict)
    SELECT cache_key, CASE WHEN rep % 2 = 0 THEN 'first' ELSE 'second' END AS gpt_choice FROM keyed
""")
def cache_files(spark, sf_dir):
    path, games = f"{sinks.scratch(spark)}/cache", _keyed_games(spark, sf_dir)
    if files.read_cache(spark, path + "-none") is not None:
        raise AssertionError("a cache that is not there was read")
    for rest, choice in ((0, "first"), (1, "second")):
        replies = games.where(F.col("repetition") % 2 == rest).select("cache_key", F.lit(choice).alias("gpt_choice"), F.lit(choice).alias("gpt_output"))
        cache.append(replies.withColumn("gpt_choice", F.lit("neither")), path)  # the next append counts
        cache.append(replies, path)
    cache.compact(spark, path)
    return files.read_cache(spark, path, games).select("cache_key", "gpt_choice")


@query("SELECT r_name AS model, row_number() OVER (ORDER BY r_name DESC)::INTEGER - 1 AS pos, 'about ' || r_name AS note FROM region WHERE r_regionkey < 3")
def audit_newest(spark, sf_dir):
    """Of two audits of the regions, in either folder, the later one counts; its notes are read back from the file."""
    folder, regions = sinks.scratch(spark), _regions(spark, sf_dir)
    first = [r.r_name for r in _read(spark, sf_dir, "region").where("r_regionkey < 3").orderBy(F.desc("r_name")).collect()]  # three
    for place, kept in ((f"{folder}/pairwise", regions), (folder, first)):
        row = ([f"model_{k}" for k in range(len(kept))], kept, {}, {m: f"about {m}" for m in kept}, "My data (v1)", "{}")
        path = sinks.write_audit(spark.createDataFrame([row], schemas.AUDIT), place)
        if not path.endswith("/My_data_v1_second_round.json"):
            raise AssertionError(path)
    kept = spark.createDataFrame(list(enumerate(files.read_audit(spark, folder))), "pos int, model string")
    notes = spark.read.schema(schemas.AUDIT).json(path).select(F.explode("per_model_notes").alias("model", "note"))
    return kept.join(notes, "model").select("model", "pos", "note")


@query("""
    SELECT CASE WHEN doc_id % 9 <> 0 THEN doc_id::VARCHAR END AS doc_id, (doc_id % 4)::VARCHAR AS consensus_label,
           CASE WHEN doc_id % 9 <> 0 AND doc_id % 5 <> 0 THEN lang END AS lang FROM documents
""")
def consensus_file(spark, sf_dir):
    """Labels with carried columns; an id that is null or not carried keeps its row."""
    path, docs = f"{sinks.scratch(spark)}/consensus", _read(spark, sf_dir, "documents")
    found = docs.select(F.when(F.col("doc_id") % 9 != 0, F.col("doc_id")).alias("doc_id"), (F.col("doc_id") % 4).alias("consensus_label"))
    sinks.write_consensus(found, path, "doc_id", "consensus_label", docs.where("doc_id % 5 <> 0").select("doc_id", "lang"))
    return files.read_table(spark, path).drop("pos")


# --- scalar rules --------------------------------------------------------------------------------

_CHOICES = [(1, "first\n"), (2, "\tsecond"), (3, " First "), (4, " second\r\n"), (5, "tie"), (6, None), (7, ""), (8, "first second"), (9, "\x1csecond\x85")]


@query(rf"""
    SELECT event_id, CASE WHEN c IN ('first', 'second') THEN c ELSE 'tie' END AS verdict
    FROM (SELECT event_id, lower(regexp_replace(coalesce(c, ''), '^[\x09-\x0D\x1C-\x20\x85\p{{Z}}]+|[\x09-\x0D\x1C-\x20\x85\p{{Z}}]+$', '', 'g')) AS c
          FROM events JOIN {_values(_CHOICES)} t(n, c) ON n = event_id % 9 + 1)
""")
def verdict_spelling(spark, sf_dir):
    """Every event says its choice in one of nine ways of writing."""
    ways = F.create_map(*[F.lit(x) for n, c in _CHOICES for x in (n, c or "")])
    said = _read(spark, sf_dir, "events").select("event_id", F.element_at(ways, (F.col("event_id") % 9 + 1).cast("int")).alias("c"))
    return said.select("event_id", text.canonical_choice(F.col("c")).alias("verdict"))


@query("SELECT p_partkey, p_brand AS label FROM part")
def label_column(spark, sf_dir):
    parts = _read(spark, sf_dir, "part")
    return parts.select("p_partkey", F.col(labels.label_column(parts, "p_partkey", "p_name")).alias("label"))


_QUOTED = {m: t.replace("'", "''") for m, t in (("simple", audit.COMPARE), ("complex", audit.STRICT))}


@query(" UNION ALL ".join(
    f"SELECT n_name, '{m}' AS mode, {str(r).lower()} AS reference, {repr('A reference image comes before both. ') if r else repr('')} || replace('{t}', '{{dataset}}', n_name) AS prompt FROM nation"
    for m, t in _QUOTED.items() for r in (True, False)
))
def compare_prompts(spark, sf_dir):
    rows = _read(spark, sf_dir, "nation").select("n_name")
    parts = [rows.select("n_name", F.lit(m).alias("mode"), F.lit(r).alias("reference"), audit.compare_prompt(F.col("n_name"), F.lit(r), m).alias("prompt")) for m in _QUOTED for r in (True, False)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"""
    WITH {_ORDERS_SQL}, {_TALLY_SQL}, ids AS (SELECT 'model_' || row_number() OVER (ORDER BY model) AS g, model, win_rate FROM placed)
    SELECT '{audit.INSTRUCTIONS.replace("'", "''")}' || chr(10) || chr(10) || string_agg(g || ' (' || model || '): win_rate = ' || printf('%.3f', win_rate), chr(10) ORDER BY model)
           || chr(10) || chr(10) || 'as said' AS prompt FROM ids
""")
def audit_prompt(spark, sf_dir):
    ranked = tournament.tally(_order_verdicts(spark, sf_dir))
    return audit.prompt(audit.generic_ids(ranked.select("model")), ranked, _literal(spark, [("as said",)], "summary string"))


@query("""
    SELECT n_name, 0 AS pos, 'input_text' AS type, 'about ' || n_name AS text, NULL::VARCHAR AS url FROM nation
    UNION ALL SELECT n_name, 1, 'input_image', NULL, 'data:' || n_nationkey FROM nation WHERE n_regionkey <> 1
    UNION ALL SELECT n_name, CASE WHEN n_regionkey <> 1 THEN 2 ELSE 1 END, 'input_image', NULL, 'data:x' FROM nation
""")
def provider_messages(spark, sf_dir):
    rows = _read(spark, sf_dir, "nation")
    url = F.when(F.col("n_regionkey") != 1, F.concat(F.lit("data:"), F.col("n_nationkey").cast("string")))
    chat = text.provider_parts(audit.messages(F.concat(F.lit("about "), "n_name"), url, F.lit("data:x")))
    parts = rows.select("n_name", F.explode(chat).alias("m")).select("n_name", F.posexplode("m.content").alias("pos", "p"))
    return parts.select("n_name", "pos", "p.type", "p.text", "p.url")


@query("""
    WITH d AS (SELECT a.n_nationkey AS i, b.n_nationkey AS j, CASE WHEN (a.n_nationkey * 7 + b.n_nationkey) % 11 = 0 THEN 1.0 WHEN (a.n_nationkey * 7 + b.n_nationkey) % 11 = 1 THEN 0.0
                      ELSE ((a.n_nationkey * 7 + b.n_nationkey) % 11) / 8.0 END::DOUBLE AS d FROM nation a, nation b)
    SELECT x.i, x.j, CASE WHEN x.i = x.j THEN 0.0 ELSE least(1.0, (x.d + y.d) / 2) END::DOUBLE AS distance FROM d x JOIN d y ON x.i = y.j AND x.j = y.i
""")
def distance_hygiene(spark, sf_dir):
    n = _read(spark, sf_dir, "nation")
    both = n.select(F.col("n_nationkey").alias("i")).join(n.select(F.col("n_nationkey").alias("j")), F.expr("i >= 0 AND j >= i - 1000"))
    rest = (F.col("i") * 7 + F.col("j")) % 11
    return text.hygienic(both.withColumn("distance", F.when(rest == 0, float("nan")).when(rest == 1, float("-inf")).otherwise(rest / 8.0)))


# --- joins and selection -------------------------------------------------------------------------


@query("""
    SELECT a.n_name AS model1, b.n_name AS model2, 'data:' || a.n_nationkey AS image1, 'data:' || b.n_nationkey AS image2 FROM nation a JOIN nation b ON a.n_name < b.n_name
""")
def payload_join(spark, sf_dir):
    images = _read(spark, sf_dir, "nation").select(F.col("n_name").alias("model"), F.concat(F.lit("data:"), F.col("n_nationkey").cast("string")).alias("data_url"))
    return tournament.with_payloads(tournament.pairs(images), images)


@query(f"WITH {_DOC_SQL}, x AS ({_ari_sql('m1', 'm3', 'mat')}) SELECT ari FROM x")
def ground_truth_ari(spark, sf_dir):
    found = _read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("consensus_label"))
    truth = _read(spark, sf_dir, "labels")
    if pipeline.agreement(found, truth, "doc_id", "no such column") is not None:
        raise AssertionError("a ground truth that is not there was compared")
    return pipeline.agreement(found, truth, "doc_id", "quality")


@query("SELECT n_name AS model, lower(replace(n_name, ' ', '_')) || '-' AS col FROM nation")
def fuzzy_columns(spark, sf_dir):
    names = [r.n_name for r in _read(spark, sf_dir, "nation").select("n_name").collect()]  # 25
    wide = _read(spark, sf_dir, "nation").groupBy().pivot("n_name", names).agg(F.first("n_nationkey"))
    wide = wide.select(F.lit(1).alias("id"), *[F.col(f"`{n}`").alias(n.lower().replace(" ", "_") + "-") for n in names])
    return _literal(spark, list(labels.match_columns(names, wide.columns).items()), "model string, col string")


@query("""
    WITH r AS (SELECT n_name AS model, n_nationkey AS pos FROM nation UNION ALL SELECT lower(replace(n_name, ' ', '-')), 24 - n_nationkey + 0.5 FROM nation)
    SELECT lower(regexp_replace(model, '[^0-9A-Za-z]+', '', 'g')) AS normalized, arg_max(model, pos) AS model FROM r GROUP BY ALL
""")
def ranked_by_normalized(spark, sf_dir):
    """Of ranked names that normalise alike the last counts."""
    nation = _read(spark, sf_dir, "nation")
    other = nation.select(F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))).alias("model"), (24 - F.col("n_nationkey") + 0.5).alias("pos"))
    rows = nation.select(F.col("n_name").alias("model"), F.col("n_nationkey").cast("double").alias("pos")).unionByName(other)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return selection.by_normalized(rows.select("model", F.lit(0.5).alias("win_rate"), "pos"))


@query(f"""
    WITH {_ORDERS_SQL}, {_TALLY_SQL}, pl AS (SELECT model, row_number() OVER (ORDER BY win_rate DESC, model DESC)::INTEGER AS place FROM ranked)
    SELECT 'fixed' AS mode, model, place FROM pl WHERE place <= 2 UNION ALL SELECT 'elbow', model, place FROM pl WHERE place <= 3
""")
def top_selected(spark, sf_dir):
    """Both modes with 2 asked for; the elbow keeps three."""
    ranked = tournament.tally(_order_verdicts(spark, sf_dir))
    one, two = (selection.select_top(ranked, m, 2).select(F.lit(m).alias("mode"), "model", "place") for m in ("fixed", "elbow"))
    return one.unionByName(two)


@query(f"WITH {_ORDERS_SQL}, {_TALLY_SQL} SELECT least(50, count(*))::INTEGER AS top_k FROM ranked")
def top_clamped(spark, sf_dir):
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        k = selection.clamped(tournament.tally(_order_verdicts(spark, sf_dir)), 50)
    if not said:
        raise AssertionError("no warning of fewer models")
    return _literal(spark, [(k,)], "top_k int")


@query(f"""
    WITH {_ORDERS_SQL}, {_TALLY_SQL}
    SELECT 'manual' AS by, '5-LOW' AS model, 1 AS place UNION ALL SELECT 'manual', '1-URGENT', 2 UNION ALL SELECT 'audited', '2-HIGH', 1 UNION ALL SELECT 'audited', '5-LOW', 2
    UNION ALL SELECT 'top', model, row_number() OVER (ORDER BY win_rate DESC, model DESC)::INTEGER FROM placed QUALIFY row_number() OVER (ORDER BY win_rate DESC, model DESC) <= 3
""")
def names_resolved(spark, sf_dir):
    """By hand before an audit before the best; fewer than two are an error."""
    ranked = tournament.tally(_order_verdicts(spark, sf_dir))
    by_hand, audited = ["5-LOW", "1-URGENT"], ["2-HIGH", "5-LOW"]
    cases = {"manual": (by_hand, audited), "audited": (None, audited), "top": (None, None)}
    rows = [(by, m, k + 1) for by, (a, b) in cases.items() for k, m in enumerate(selection.resolve(ranked, a, b, 3))]
    try:
        selection.resolve(ranked, ["5-LOW"])
    except ValueError:
        return _literal(spark, rows, "by string, model string, place int")
    raise AssertionError("one model was enough")


# --- number of clusters --------------------------------------------------------------------------


@query(f"""
    WITH RECURSIVE {_LINES_SQL}, {_CUTS_SQL}, {_SUMS_SQL}, cnt AS (
        SELECT 0 AS sel_pos, count(DISTINCT m1) AS k FROM mat UNION ALL SELECT 1, count(DISTINCT m2) FROM mat UNION ALL SELECT 2, count(DISTINCT m3) FROM mat),
    per AS (SELECT k, sid, w, max(n) FILTER (WHERE own = cluster) AS n, max(d / nullif(n - 1, 0)) FILTER (WHERE own = cluster) AS a,
                   min(d / n) FILTER (WHERE own <> cluster) AS b FROM sums GROUP BY k, sid, w),
    sil AS (SELECT k, round(sum(w * CASE WHEN n > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END)::DOUBLE / sum(w), 9) AS s FROM per GROUP BY k)
    SELECT 'fixed' AS method, 4 AS k
    UNION ALL SELECT 'median_from_models', round_even(median(k), 0)::INTEGER FROM cnt WHERE k BETWEEN 2 AND 6
    UNION ALL (SELECT 'mode_from_models', k::INTEGER FROM cnt WHERE k BETWEEN 2 AND 6 GROUP BY k ORDER BY count(*) DESC, min(sel_pos) LIMIT 1)
    UNION ALL (SELECT 'silhouette', k::INTEGER FROM sil ORDER BY s DESC, k LIMIT 1)
""")
def k_chosen(spark, sf_dir):
    """The dispatcher's choice by each method that has a definite answer, of 2 to 6 clusters."""
    matrix = _line_matrix(spark, sf_dir)
    sigs = labels.signatures(matrix, _M3, _LINE_KEYS)
    tree = pipeline.linkage.dendrogram(sigs)
    ways = ("fixed", "median_from_models", "mode_from_models", "silhouette")
    rows = [(m, pipeline.choose_k(matrix, _M3, sigs, tree, pipeline.KChoice(m, 4 if m == "fixed" else None, _KS))) for m in ways]
    return _literal(spark, rows, "method string, k int")


# --- judges and drivers --------------------------------------------------------------------------


def _reply(game: dict) -> str:
    """A judge for tests: the longer name wins, one repetition in three is lost to an error."""
    if game["repetition"] % 3 == 0:
        raise ConnectionError("no answer")
    return "I say Second" if len(game["model2"]) > len(game["model1"]) else "first, clearly"


_REPLY_SQL = "CASE WHEN r % 3 = 0 THEN NULL WHEN length(m2) > length(m1) THEN 'second' ELSE 'first' END"


@query(f"""
    WITH g AS (SELECT a.n_name AS m1, b.n_name AS m2, r FROM nation a JOIN nation b ON a.n_name < b.n_name CROSS JOIN (SELECT unnest(range(1, 6)) AS r))
    SELECT m1 AS model1, m2 AS model2, r::INTEGER AS repetition, {_REPLY_SQL} AS gpt_choice, r % 3 = 0 AS failed FROM g
""")
def judge_calls(spark, sf_dir):
    """A judge that calls out, with the rows of its failures."""
    games = tournament.schedule(tournament.pairs(_read(spark, sf_dir, "nation").select(F.col("n_name").alias("model"))), 5)
    out = judges.callable_judge(_reply, backoff=0.0)(games)
    return out.select("model1", "model2", "repetition", "gpt_choice", F.col("gpt_output").startswith(judges.FAILED).alias("failed"))


def _longer(games: DataFrame) -> DataFrame:
    longer = F.length("model2") > F.length("model1")
    return judges.expression_judge(F.when(F.col("repetition") % 3 == 0, "neither").when(longer, "Second").otherwise("First"))(games)


_PLAYED_SQL = f"""
    g AS (SELECT a.r_name AS m1, b.r_name AS m2, r FROM region a JOIN region b ON a.r_name < b.r_name CROSS JOIN (SELECT unnest(range(1, 6)) AS r)),
    verdict AS (SELECT m1, m2, r AS rep, {_REPLY_SQL} AS choice FROM g), {_TALLY_SQL.replace("choice = 'first'", "coalesce(choice = 'first', false)").replace("choice = 'second'", "coalesce(choice = 'second', false)")}
"""


@query(f"WITH {_PLAYED_SQL} SELECT model, games::VARCHAR AS games, win_rate, skip FROM ranked CROSS JOIN (SELECT unnest([false, true]) AS skip)")
def tournament_from_images(spark, sf_dir):
    """From a folder of images to a ranking, then the stored ranking alone."""
    folder, out = _image_folder(spark, sf_dir), sinks.scratch(spark)
    pipeline.run_tournament(spark, folder, out, _longer)
    again = pipeline.run_tournament(spark, folder, out, judges.replay_judge(spark.createDataFrame([], "model1 string, model2 string, repetition int, gpt_output string")))
    stored = pipeline.run_tournament(spark, folder, out, _longer, skip=True)
    shown = lambda df, skip: df.select("model", "games", "win_rate", F.lit(skip).alias("skip"))
    return shown(again, False).unionByName(shown(stored, True))


def _auditor(request: dict) -> str:
    return '```json\n{"final_keep_ids": ["model_3", "model_7", "model_1"], "per_model_notes": {"model_1": "agrees"}}\n```'


@query(f"""
    WITH {_ORDERS_SQL}, {_TALLY_SQL}, ids AS (SELECT row_number() OVER (ORDER BY model) AS n, model FROM placed WHERE place <= 4)
    SELECT model, CASE n WHEN 3 THEN 0 ELSE 1 END AS pos, CASE n WHEN 1 THEN 'agrees' END AS note, 'orders' AS dataset_name FROM ids WHERE n IN (1, 3)
""")
def audit_run(spark, sf_dir):
    rows = _order_verdicts(spark, sf_dir)
    images = tournament.tally(rows).select("model", F.concat(F.lit("data:"), "model").alias("data_url"))
    done = pipeline.run_audit(rows, images, _auditor, "orders", 4)
    kept = done.select(F.posexplode("final_model_ids").alias("pos", "model"), "per_model_notes", "dataset_name")
    return kept.select("model", "pos", F.try_element_at("per_model_notes", F.col("model")).alias("note"), "dataset_name")


_PARTS = {"alpha": "p_size % 2", "betas": "p_size % 5", "gamma-3": "p_partkey % 3"}


@query(f"""
    WITH RECURSIVE mat AS (SELECT p_partkey, {", ".join(f"({e})::VARCHAR AS m{k + 1}" for k, e in enumerate(_PARTS.values()))} FROM part),
    sig AS (SELECT row_number() OVER (ORDER BY o) - 1 AS sid, m1, m2, m3, w FROM (SELECT m1, m2, m3, count(*) AS w, min(p_partkey) AS o FROM mat GROUP BY ALL)),
    pair AS (SELECT a.sid AS i, b.sid AS j, a.w AS wi, b.w AS wj, ((a.m1 <> b.m1)::INT + (a.m2 <> b.m2)::INT + (a.m3 <> b.m3)::INT) AS disagree FROM sig a JOIN sig b ON a.sid < b.sid),
    {_tree_sql(3)}, c AS ({_cut_sql("3")})
    SELECT p_partkey::VARCHAR AS p_partkey, cluster AS consensus_label FROM mat JOIN sig USING (m1, m2, m3) JOIN c USING (sid)
""")
def full_run(spark, sf_dir):
    """Images, a tournament, the best three, their assignments and a consensus, all from files."""
    out = sinks.scratch(spark)
    for m in _PARTS:
        sinks.put(spark, f"{out}/images/{m}.png", m.encode())
    rows = _read(spark, sf_dir, "part").orderBy("p_partkey").coalesce(1)
    rows.select("p_partkey", *[F.expr(e).alias(m.replace("-", "_").upper()) for m, e in _PARTS.items()]).write.option("header", True).csv(f"{out}/parts.csv")
    return pipeline.run_all(spark, f"{out}/images", f"{out}/parts.csv", "p_partkey", f"{out}/run", _longer)


@query(f"""
    WITH RECURSIVE mat AS (SELECT p_partkey, {", ".join(f"({e})::VARCHAR AS m{k + 1}" for k, e in enumerate(_PARTS.values()))}, (p_size % 4)::VARCHAR AS truth FROM part),
    sig AS (SELECT row_number() OVER (ORDER BY o) - 1 AS sid, m1, m2, m3, w FROM (SELECT m1, m2, m3, count(*) AS w, min(p_partkey) AS o FROM mat GROUP BY ALL)),
    pair AS (SELECT a.sid AS i, b.sid AS j, a.w AS wi, b.w AS wj, ((a.m1 <> b.m1)::INT + (a.m2 <> b.m2)::INT + (a.m3 <> b.m3)::INT) AS disagree FROM sig a JOIN sig b ON a.sid < b.sid),
    {_tree_sql(3)}, c AS ({_cut_sql("3")}), scored AS (SELECT p_partkey, cluster AS consensus_label, truth FROM mat JOIN sig USING (m1, m2, m3) JOIN c USING (sid)),
    x AS ({_ari_sql("consensus_label", "truth", "scored")})
    SELECT p_partkey::VARCHAR AS p_partkey, consensus_label, ari FROM scored CROSS JOIN x
""")
def full_run_separate(spark, sf_dir):
    """The whole run with a file for each model, one of which has the ground truth."""
    out = sinks.scratch(spark)
    for m in _PARTS:
        sinks.put(spark, f"{out}/images/{m}.png", m.encode())
    rows = _read(spark, sf_dir, "part").orderBy("p_partkey")
    for (m, e), end in zip(_PARTS.items(), (".csv", "_pred_label.csv", "_labels.csv")):
        rows.select("p_partkey", (F.col("p_size") % 4).alias("truth"), F.expr(e).alias("cluster")).write.option("header", True).csv(f"{out}/parts/{m}{end}")
    found = pipeline.run_all(spark, f"{out}/images", f"{out}/parts", None, f"{out}/run", _longer, separate=True, truth="truth")
    ari = spark.read.schema("ari double").json(f"{out}/run/agreement")
    return found.crossJoin(F.broadcast(ari))  # one row


# --- streams -------------------------------------------------------------------------------------


@query(f"WITH {_ORDERS_SQL}, {_TALLY_SQL} SELECT model, games, wins, losses, ties, points, win_rate FROM ranked")
def streaming_tally(spark, sf_dir):
    """The tally kept up to date over verdict files that come in one by one."""
    folder, rows = sinks.scratch(spark), _order_verdicts(spark, sf_dir)
    rows.repartition(4, "repetition").write.option("ignoreNullFields", False).json(f"{folder}/verdicts")
    stream = stream_ranking.read_stream(spark, f"{folder}/verdicts", 1)
    return stream_ranking.settled(stream, f"{folder}/log", f"{folder}/tally")


@query(f"WITH {_ORDERS_SQL} SELECT m1 AS model1_label, m2 AS model2_label, rep AS repetition, nullif(choice, 'tie') AS gpt_choice FROM verdict")
def tournament_resumed(spark, sf_dir):
    """A tournament whose driver stops after a batch; started again, it judges the rest."""
    folder, known = sinks.scratch(spark), _order_verdicts(spark, sf_dir)
    recorded = known.select(F.col("model1_label").alias("model1"), F.col("model2_label").alias("model2"), "repetition", "gpt_output")
    stream_tournament.put_games(_keyed_games(spark, sf_dir), f"{folder}/games", 20)

    def stop(number: int) -> None:
        if number == 1:
            raise RuntimeError("stopped")

    try:
        stream_tournament.play_games(spark, f"{folder}/games", f"{folder}/out", judges.replay_judge(recorded), f"{folder}/cache", stop)
    except Exception:  # noqa: BLE001
        pass
    else:
        raise AssertionError("the first run was not stopped")
    rows = stream_tournament.play_games(spark, f"{folder}/games", f"{folder}/out", judges.replay_judge(recorded), f"{folder}/cache")
    return rows.select("model1_label", "model2_label", "repetition", "gpt_choice")

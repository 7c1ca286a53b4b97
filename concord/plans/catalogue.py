"""Registered queries over the test tables and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.config import DEFAULTS
from concord.functions import text
from concord.operators import audit, judges, labels, linkage, selection, tournament
from concord.plans import pipeline
from concord.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _values(rows: list[tuple]) -> str:
    cell = lambda x: "NULL" if x is None else str(x) if isinstance(x, int | float) else "'" + x.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")"


# --- pairs and schedules -------------------------------------------------------------------------


@query("SELECT a.n_name AS model1, b.n_name AS model2 FROM nation a JOIN nation b ON a.n_name < b.n_name")
def pairs_theta(spark, sf_dir):
    return tournament.pairs(_read(spark, sf_dir, "nation").select(F.col("n_name").alias("model")))


@query("""
    WITH m AS (SELECT DISTINCT event_type AS model FROM events)
    SELECT a.model AS model1, b.model AS model2, r::INTEGER AS repetition
    FROM m a JOIN m b ON a.model < b.model CROSS JOIN (SELECT unnest(range(1, 6)) AS r)
""")
def pairs_by_rep(spark, sf_dir):
    models = _read(spark, sf_dir, "events").select(F.col("event_type").alias("model"))
    return tournament.schedule(tournament.pairs(models), 5)


# --- scalar functions ----------------------------------------------------------------------------

_INJECTED = "CASE conv_id % 4 WHEN 0 THEN concat(text, ' I say Second!') WHEN 1 THEN concat('FIRST ', text) WHEN 2 THEN concat('firstly ', text) ELSE text END"


@query(f"""
    WITH t AS (SELECT conv_id, turn, {_INJECTED} AS reply FROM conversations),
    p AS (SELECT conv_id, turn, nullif(lower(regexp_extract(reply, '(?i)\\b(first|second)\\b', 1)), '') AS choice FROM t)
    SELECT conv_id, turn, choice, coalesce(choice, 'tie') AS verdict,
           CASE choice WHEN 'first' THEN 'a' WHEN 'second' THEN 'b' ELSE 'tie' END AS winner FROM p
""")
def verdict_parse(spark, sf_dir):
    rows = _read(spark, sf_dir, "conversations").withColumn("choice", text.parsed_choice(F.expr(_INJECTED)))
    win = text.winner(F.col("choice"), F.lit("a"), F.lit("b"))
    return rows.select("conv_id", "turn", "choice", text.canonical_choice(F.col("choice")).alias("verdict"), win.alias("winner"))


@query("SELECT p_partkey, lower(regexp_replace(p_name, '[^0-9A-Za-z]+', '', 'g')) AS normalized FROM part")
def normalize_names(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", text.normalized_name(F.col("p_name")).alias("normalized"))


_NAMES = "replace(p_brand, '#', CASE p_partkey % 3 WHEN 0 THEN '-' WHEN 1 THEN '_' ELSE ' v' END)"


@query(f"""
    SELECT normalized, array_to_string(list_sort(list(DISTINCT name)), '|') AS names
    FROM (SELECT name, lower(regexp_replace(name, '[^0-9A-Za-z]+', '', 'g')) AS normalized FROM (SELECT {_NAMES} AS name FROM part))
    GROUP BY normalized HAVING count(DISTINCT name) > 1
""")
def name_collisions(spark, sf_dir):
    names = _read(spark, sf_dir, "part").select(F.expr(_NAMES).alias("name"))
    return labels.collisions(names).withColumn("names", F.array_join("names", "|"))


_PATHS = """
    CASE WHEN p_partkey % 50 = 1 THEN '/d/he.png' ELSE '/d/' || replace(p_brand, '#', '.') ||
    (CASE p_partkey % 5 WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' WHEN 2 THEN '.jpeg' WHEN 3 THEN '.gif' ELSE '.PNG' END) END
"""


@query(f"""
    WITH f AS (SELECT path, regexp_extract(path, '([^/]*)$', 1) AS file FROM (SELECT DISTINCT {_PATHS} AS path FROM part WHERE p_size > 25)),
    e AS (SELECT *, regexp_extract(file, '^(.*)[.]([^.]*)$', 1) AS stem, regexp_extract(file, '[.]([^.]*)$', 1) AS ext FROM f),
    r AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY CASE ext WHEN 'png' THEN 0 WHEN 'jpg' THEN 1 ELSE 2 END, path) AS n
          FROM e WHERE ext IN ('png', 'jpg', 'jpeg') AND file <> 'he.png')
    SELECT path, stem FROM r WHERE n = 1
""")
def image_dedup(spark, sf_dir):
    paths = _read(spark, sf_dir, "part").where("p_size > 25").select(F.expr(_PATHS).alias("path")).distinct()
    return files.split_reference(files.named_files(paths))[1].select("path", "stem")


@query("""
    SELECT c_custkey, replace(trim(regexp_replace(c_mktsegment || ' (' || c_name || ')', '[^\\w\\s-]', '', 'g')), ' ', '_') AS file_name FROM customer
""")
def file_names(spark, sf_dir):
    name = F.concat("c_mktsegment", F.lit(" ("), "c_name", F.lit(")"))
    return _read(spark, sf_dir, "customer").select("c_custkey", text.file_name(name).alias("file_name"))


@query("SELECT p_partkey, (CASE WHEN p_brand IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY p_brand) - 1 END)::INTEGER AS code FROM part")
def label_recode(spark, sf_dir):
    return labels.recoded(_read(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand").select("p_partkey", "code")


@query("SELECT event_id, least(1.0, greatest(0.0, CASE WHEN value > 400 THEN 'inf'::DOUBLE WHEN value < 5 THEN '-inf'::DOUBLE ELSE value / 100 END)) AS distance FROM events")
def matrix_hygiene(spark, sf_dir):
    d = F.when(F.col("value") > 400, float("inf")).when(F.col("value") < 5, float("-inf")).otherwise(F.col("value") / 100)
    return _read(spark, sf_dir, "events").select("event_id", text.clean_distance(d).alias("distance"))


# --- tournament ----------------------------------------------------------------------------------

#: Competitors are order priorities; each year the larger revenue of two wins, within 2 % it is a tie.
_ORDERS_SQL = """
    rev AS (SELECT o_orderpriority AS model, year(o_orderdate)::INTEGER AS rep, round(sum(o_totalprice), 2) AS x FROM orders GROUP BY ALL),
    verdict AS (
        SELECT a.model AS m1, b.model AS m2, a.rep,
               CASE WHEN abs(a.x - b.x) <= 0.02 * greatest(a.x, b.x) THEN 'tie' WHEN a.x > b.x THEN 'first' ELSE 'second' END AS choice
        FROM rev a JOIN rev b ON a.rep = b.rep AND a.model < b.model)
"""
_TALLY_SQL = """
    side AS (SELECT m1 AS model, choice = 'first' AS won, choice = 'second' AS lost FROM verdict
             UNION ALL SELECT m2, choice = 'second', choice = 'first' FROM verdict),
    ranked AS (
        SELECT model, count(*)::BIGINT AS games, count(*) FILTER (WHERE won)::BIGINT AS wins, count(*) FILTER (WHERE lost)::BIGINT AS losses,
               count(*) FILTER (WHERE NOT won AND NOT lost)::BIGINT AS ties,
               round(sum(CASE WHEN won THEN 1.0 WHEN lost THEN 0.0 ELSE 0.5 END)::DOUBLE, 4) AS points,
               round(sum(CASE WHEN won THEN 1.0 WHEN lost THEN 0.0 ELSE 0.5 END)::DOUBLE / count(*), 6) AS win_rate
        FROM side GROUP BY model),
    placed AS (SELECT *, row_number() OVER (ORDER BY win_rate DESC, points DESC, games DESC, model DESC)::INTEGER AS place FROM ranked)
"""


def _games(rev: DataFrame, tie: float) -> DataFrame:
    """Verdicts from ``(model, rep, x)``: the larger x wins."""
    a = rev.select(F.col("model").alias("model1"), F.col("rep").alias("repetition"), F.col("x").alias("x1"))
    b = rev.select(F.col("model").alias("model2"), F.col("rep").alias("repetition"), F.col("x").alias("x2"))
    games = a.join(b, "repetition").where("model1 < model2")
    near = F.abs(F.col("x1") - F.col("x2")) <= tie * F.greatest("x1", "x2")
    judge = judges.expression_judge(F.when(near, "tie").when(F.col("x1") > F.col("x2"), "first").otherwise("second"))
    return judges.verdicts(judge(games))


def _order_verdicts(spark, sf_dir) -> DataFrame:
    orders = _read(spark, sf_dir, "orders")
    rev = orders.groupBy(F.col("o_orderpriority").alias("model"), F.year("o_orderdate").alias("rep")).agg(F.round(F.sum("o_totalprice"), 2).alias("x"))
    return _games(rev, 0.02)


@query(f"WITH {_ORDERS_SQL} SELECT m1 AS model1_label, m2 AS model2_label, rep AS repetition, nullif(choice, 'tie') AS gpt_choice FROM verdict")
def judge_by_expression(spark, sf_dir):
    return _order_verdicts(spark, sf_dir).select("model1_label", "model2_label", "repetition", "gpt_choice")


@query(f"WITH {_ORDERS_SQL}, {_TALLY_SQL} SELECT model, games, wins, losses, ties, points, win_rate FROM ranked")
def tournament_tally(spark, sf_dir):
    return tournament.tally(_order_verdicts(spark, sf_dir))


@query(f"WITH {_ORDERS_SQL}, {_TALLY_SQL} SELECT * FROM placed")
def ranking(spark, sf_dir):
    return tournament.numbered(tournament.ranking(_order_verdicts(spark, sf_dir)))


_EVENTS_SQL = """
    rev AS (SELECT event_type AS model, hour(ts)::INTEGER AS rep, round(avg(value), 4) AS x FROM events GROUP BY ALL),
    verdict AS (SELECT a.model AS m1, b.model AS m2, a.rep,
                       CASE WHEN abs(a.x - b.x) <= 0.01 * greatest(a.x, b.x) THEN 'tie' WHEN a.x > b.x THEN 'first' ELSE 'second' END AS choice
                FROM rev a JOIN rev b ON a.rep = b.rep AND a.model < b.model)
"""


@query(f"WITH {_EVENTS_SQL}, {_TALLY_SQL} SELECT * FROM placed")
def ranking_events(spark, sf_dir):
    rev = _read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model"), F.hour("ts").alias("rep")).agg(F.round(F.avg("value"), 4).alias("x"))
    return tournament.numbered(tournament.ranking(_games(rev, 0.01)))


@query(f"""
    WITH {_ORDERS_SQL}, every AS (SELECT CASE WHEN rep % 3 = 0 THEN NULL WHEN rep % 3 = 1 AND m1 LIKE '1%' THEN '' ELSE m1 END AS m1, m2 FROM verdict)
    SELECT count(*)::BIGINT AS total_rows, count(*) FILTER (WHERE m1 <> '' AND m2 <> '')::BIGINT AS used_rows FROM every
""")
def verdict_counters(spark, sf_dir):
    rows = _order_verdicts(spark, sf_dir)
    m1, rep = F.col("model1_label"), F.col("repetition")
    broken = F.when(rep % 3 == 0, None).when((rep % 3 == 1) & m1.startswith("1"), "").otherwise(m1)
    return tournament.counters(rows.withColumn("model1_label", broken))


_KEY_SQL = "md5(m1 || '_' || m2 || '_' || rep || '_simple_judge_1.0_medium')"


def _keyed_games(spark, sf_dir) -> DataFrame:
    rows = _order_verdicts(spark, sf_dir)
    games = rows.select(F.col("model1_label").alias("model1"), F.col("model2_label").alias("model2"), "repetition")
    return judges.keyed(games, "simple", "judge", 1.0, "medium")


@query(f"WITH {_ORDERS_SQL} SELECT m1 AS model1, m2 AS model2, rep AS repetition, {_KEY_SQL} AS cache_key FROM verdict")
def cache_key(spark, sf_dir):
    return _keyed_games(spark, sf_dir)


@query(f"""
    WITH {_ORDERS_SQL}, keyed AS (SELECT *, {_KEY_SQL} AS cache_key FROM verdict)
    SELECT m1 AS model1, m2 AS model2, rep AS repetition, cache_key < '8' AS hit FROM keyed
""")
def cache_probe(spark, sf_dir):
    games = _keyed_games(spark, sf_dir)
    cache = games.where("cache_key < '8'").select("cache_key", F.lit("first").alias("gpt_choice"))
    hits, misses = tournament.probe(games, cache)
    shown = lambda df, hit: df.select("model1", "model2", "repetition", F.lit(hit).alias("hit"))
    return shown(hits, True).unionByName(shown(misses, False))


@query(f"""
    WITH {_ORDERS_SQL}, keyed AS (SELECT *, {_KEY_SQL} AS k FROM verdict)
    SELECT m1 AS model1, m2 AS model2, rep AS repetition,
           CASE WHEN k < '8' THEN 'first' WHEN rep % 2 = 0 THEN NULL ELSE nullif(choice, 'tie') END AS gpt_choice FROM keyed
""")
def judge_runner(spark, sf_dir):
    games = _keyed_games(spark, sf_dir)
    cache = games.where("cache_key < '8'").select("cache_key", F.lit("first").alias("gpt_choice"), F.lit("First").alias("gpt_output"))
    known = _order_verdicts(spark, sf_dir).where("repetition % 2 <> 0")
    recorded = known.select(F.col("model1_label").alias("model1"), F.col("model2_label").alias("model2"), "repetition", "gpt_output")
    rows, _ = judges.judged(games, cache, judges.replay_judge(recorded))
    return rows.select("model1", "model2", "repetition", "gpt_choice")


# --- selection -----------------------------------------------------------------------------------


@query(f"WITH {_ORDERS_SQL}, {_TALLY_SQL} SELECT model, win_rate, place FROM placed WHERE place <= 3")
def topk_fixed(spark, sf_dir):
    return selection.top_fixed(tournament.tally(_order_verdicts(spark, sf_dir)), 3)


@query(f"""
    WITH {_ORDERS_SQL}, {_TALLY_SQL},
    pl AS (SELECT model, win_rate, row_number() OVER (ORDER BY win_rate DESC, model DESC)::INTEGER AS place FROM ranked),
    dr AS (SELECT place, win_rate - lead(win_rate) OVER (ORDER BY place) AS d, count(*) OVER () AS n FROM pl),
    cut AS (SELECT CASE WHEN max(n) <= 2 THEN max(n) ELSE greatest(3, least((SELECT place FROM dr WHERE d IS NOT NULL ORDER BY d DESC, place LIMIT 1), 5)) END AS k FROM dr)
    SELECT pl.* FROM pl, cut WHERE place <= k
""")
def topk_elbow(spark, sf_dir):
    return selection.top_elbow(tournament.tally(_order_verdicts(spark, sf_dir)), 5)


_WANTED = [("1-URGENT",), ("9-NEVER",), ("5-LOW",), ("0-NONE",)]


@query(f"WITH {_ORDERS_SQL}, {_TALLY_SQL} SELECT model FROM {_values(_WANTED)} w(model) WHERE model NOT IN (SELECT model FROM ranked)")
def select_manual_missing(spark, sf_dir):
    return selection.missing(_literal(spark, _WANTED, "model string"), tournament.tally(_order_verdicts(spark, sf_dir)))


@query(f"WITH {_ORDERS_SQL}, {_TALLY_SQL} SELECT model FROM placed WHERE place <= 4 AND model NOT IN ('1-URGENT', '5-LOW')")
def audit_excluded(spark, sf_dir):
    top = selection.top_fixed(tournament.tally(_order_verdicts(spark, sf_dir)), 4)
    return selection.excluded(top.select("model"), _literal(spark, [("1-URGENT",), ("5-LOW",)], "model string"))


# --- labels --------------------------------------------------------------------------------------


@query("""
    SELECT d.doc_id AS id, d.lang AS m1, l.quality AS m2 FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def align_separate(spark, sf_dir):
    docs, marks = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    one = docs.select("doc_id", "lang", F.col("doc_id").alias("pos"))
    # ``align`` asks for as many rows on both sides, so ids without a label are filled by others that the first side lacks.
    fill = docs.select("doc_id").join(marks, "doc_id", "left_anti").select((-1 - F.col("doc_id")).alias("doc_id"), F.lit(0).alias("quality"))
    two = marks.select("doc_id", "quality").unionByName(fill).withColumn("pos", F.col("doc_id"))
    return labels.align({"m1": one, "m2": two}).select("id", "m1", "m2")


_DOC_SQL = """
    mat AS (SELECT doc_id, lang AS m1, source AS m2, l.quality::VARCHAR AS m3 FROM documents d LEFT JOIN labels l USING (doc_id))
"""


def _doc_matrix(spark, sf_dir) -> DataFrame:
    docs, marks = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    joined = docs.select("doc_id", "lang", "source").join(marks.select("doc_id", "quality"), "doc_id", "left")
    return joined.select("doc_id", F.col("lang").alias("m1"), F.col("source").alias("m2"), F.col("quality").cast("string").alias("m3"))


_M3 = ["m1", "m2", "m3"]
_COUNTS_SQL = """
    cnt AS (SELECT 0 AS sel_pos, 'm1' AS model, count(DISTINCT m1) + max((m1 IS NULL)::INT) AS k FROM mat
            UNION ALL SELECT 1, 'm2', count(DISTINCT m2) + max((m2 IS NULL)::INT) FROM mat
            UNION ALL SELECT 2, 'm3', count(DISTINCT m3) + max((m3 IS NULL)::INT) FROM mat)
"""


@query(f"WITH {_DOC_SQL}, {_COUNTS_SQL} SELECT sel_pos::INTEGER AS sel_pos, model, k::BIGINT AS k FROM cnt")
def k_counts(spark, sf_dir):
    return labels.k_counts(_doc_matrix(spark, sf_dir), _M3)


@query(f"WITH {_DOC_SQL}, {_COUNTS_SQL} SELECT round_even(median(k), 0)::INTEGER AS k FROM cnt WHERE k BETWEEN 2 AND 15")
def k_median(spark, sf_dir):
    return labels.k_median(labels.k_counts(_doc_matrix(spark, sf_dir), _M3))


@query(f"WITH {_DOC_SQL}, {_COUNTS_SQL} SELECT k::INTEGER AS k FROM cnt WHERE k BETWEEN 2 AND 15 GROUP BY k ORDER BY count(*) DESC, min(sel_pos) LIMIT 1")
def k_mode(spark, sf_dir):
    return labels.k_mode(labels.k_counts(_doc_matrix(spark, sf_dir), _M3))


#: Line items, three labelings; signatures are numbered by their first row.
_LINES_SQL = """
    mat AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag AS m1, l_linestatus AS m2,
                   floor(l_quantity / 10)::BIGINT::VARCHAR AS m3 FROM lineitem),
    sig AS (SELECT row_number() OVER (ORDER BY o, m1, m2, m3) - 1 AS sid, m1, m2, m3, w FROM (
                SELECT m1, m2, m3, count(*) AS w, min(row(l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS o FROM mat GROUP BY m1, m2, m3)),
    pair AS (SELECT a.sid AS i, b.sid AS j, a.w AS wi, b.w AS wj,
                    ((a.m1 IS DISTINCT FROM b.m1)::INT + (a.m2 IS DISTINCT FROM b.m2)::INT + (a.m3 IS DISTINCT FROM b.m3)::INT) AS disagree
             FROM sig a JOIN sig b ON a.sid < b.sid)
"""
_LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _line_matrix(spark, sf_dir) -> DataFrame:
    tens = F.floor(F.col("l_quantity") / 10).cast("string")
    return _read(spark, sf_dir, "lineitem").select(*_LINE_KEYS, F.col("l_returnflag").alias("m1"), F.col("l_linestatus").alias("m2"), tens.alias("m3"))


def _line_signatures(spark, sf_dir) -> DataFrame:
    return labels.signatures(_line_matrix(spark, sf_dir), _M3, _LINE_KEYS)


@query(f"WITH {_LINES_SQL} SELECT i, j, wi, wj, disagree::INTEGER AS disagree, disagree / 3.0::DOUBLE AS distance FROM pair")
def coassoc_pairs(spark, sf_dir):
    return labels.coassociation(_line_signatures(spark, sf_dir))


def _tree_sql(k: int, name: str = "step", sig: str = "sig", pair: str = "pair") -> str:
    """Average linkage cut at k, as a recursion over pair sums ('p') and memberships ('m')."""
    return f"""
    {name}(n, kind, a, b, v) AS (
        SELECT 0, 'p', i::BIGINT, j::BIGINT, (wi * wj * disagree)::DOUBLE FROM {pair} UNION ALL SELECT 0, 'm', sid::BIGINT, sid::BIGINT, w::DOUBLE FROM {sig}
        UNION ALL (
            WITH size AS (SELECT b AS c, sum(v) AS s FROM {name} WHERE kind = 'm' GROUP BY b),
            best AS (SELECT p.a AS x, p.b AS y FROM {name} p JOIN size g ON g.c = p.a JOIN size h ON h.c = p.b
                     WHERE p.kind = 'p' ORDER BY p.v / (g.s * h.s), p.a, p.b LIMIT 1),
            moved AS (SELECT t.n, t.kind, CASE WHEN t.kind = 'p' AND t.a = y THEN x ELSE t.a END AS a, CASE WHEN t.b = y THEN x ELSE t.b END AS b, t.v
                      FROM {name} t, best WHERE NOT (t.kind = 'p' AND t.a = x AND t.b = y))
            SELECT n + 1, kind, CASE WHEN kind = 'p' THEN least(a, b) ELSE a END, CASE WHEN kind = 'p' THEN greatest(a, b) ELSE b END, sum(v)
            FROM moved WHERE n < (SELECT count(*) FROM {sig}) - {k}
            GROUP BY n, kind, CASE WHEN kind = 'p' THEN least(a, b) ELSE a END, CASE WHEN kind = 'p' THEN greatest(a, b) ELSE b END))
    """


def _cut_sql(k: str, name: str = "step") -> str:
    return f"SELECT a AS sid, (dense_rank() OVER (ORDER BY b) - 1)::INTEGER AS cluster FROM {name} WHERE kind = 'm' AND n = (SELECT max(n) FROM {name})"


@query(f"WITH RECURSIVE {_LINES_SQL}, {_tree_sql(4)} {_cut_sql('4')}")
def eac_consensus(spark, sf_dir):
    sigs = _line_signatures(spark, sf_dir)
    return linkage.cut(sigs, linkage.dendrogram(sigs), [4]).select("sid", "cluster")


@query(f"""
    WITH RECURSIVE {_LINES_SQL}, {_tree_sql(4)}, c AS ({_cut_sql('4')})
    SELECT cluster, count(*)::BIGINT AS signatures, sum(w)::BIGINT AS n FROM c JOIN sig USING (sid) GROUP BY cluster
""")
def eac_sizes(spark, sf_dir):
    sigs = _line_signatures(spark, sf_dir)
    cuts = linkage.cut(sigs, linkage.dendrogram(sigs), [4])
    return sigs.join(cuts, "sid").groupBy("cluster").agg(F.count(F.lit(1)).alias("signatures"), F.sum("w").alias("n"))


_KS = (2, 3, 4, 5, 6)
_ALL_CUTS = ", ".join(f"{_tree_sql(k, f's{k}')}, c{k} AS ({_cut_sql(str(k), f's{k}')})" for k in _KS)
_CUTS_SQL = f"{_ALL_CUTS}, cuts AS ({' UNION ALL '.join(f'SELECT {k} AS k, * FROM c{k}' for k in _KS)})"
_SUMS_SQL = """
    mutual AS (SELECT sid AS x, sid AS y, 0 AS d FROM sig UNION ALL SELECT i, j, disagree FROM pair UNION ALL SELECT j, i, disagree FROM pair),
    sums AS (SELECT a.k, b.x AS sid, sx.w, a.cluster AS own, c.cluster, sum(sy.w) AS n, sum(sy.w * b.d)::DOUBLE AS d
             FROM mutual b JOIN cuts a ON a.sid = b.x JOIN cuts c ON c.sid = b.y AND c.k = a.k JOIN sig sx ON sx.sid = b.x JOIN sig sy ON sy.sid = b.y
             GROUP BY a.k, b.x, sx.w, a.cluster, c.cluster)
"""


def _line_cuts(spark, sf_dir):
    sigs = _line_signatures(spark, sf_dir)
    return sigs, linkage.cut(sigs, linkage.dendrogram(sigs), list(_KS))


@query(f"""
    WITH RECURSIVE {_LINES_SQL}, {_CUTS_SQL}, {_SUMS_SQL},
    per AS (SELECT k, sid, w, max(n) FILTER (WHERE own = cluster) AS n, max(d / nullif(n - 1, 0)) FILTER (WHERE own = cluster) AS a,
                   min(d / n) FILTER (WHERE own <> cluster) AS b FROM sums GROUP BY k, sid, w)
    SELECT k, round(sum(w * CASE WHEN n > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END)::DOUBLE / sum(w), 9) AS silhouette FROM per GROUP BY k
""")
def silhouette_by_k(spark, sf_dir):
    sigs, cuts = _line_cuts(spark, sf_dir)
    return linkage.silhouette(sigs, cuts, 3)


@query(f"""
    WITH RECURSIVE {_LINES_SQL}, {_CUTS_SQL}, {_SUMS_SQL},
    per AS (SELECT k, cluster, n, sum(w * d) AS d FROM sums WHERE own = cluster GROUP BY k, cluster, n)
    SELECT k, round(sum(d / (2.0 * 3 * n))::DOUBLE, 9) AS wk FROM per GROUP BY k
""")
def wk_by_k(spark, sf_dir):
    sigs, cuts = _line_cuts(spark, sf_dir)
    return linkage.dispersion(sigs, cuts, 3)


#: The signatures in their own order (draw 0) and in ten others, and every draw's tree down to two clusters in one recursion.
_DRAWS_SQL = """
    dsig AS MATERIALIZED (
        SELECT 0 AS draw, sid, m1, m2, m3, w FROM sig
        UNION ALL SELECT d, row_number() OVER (PARTITION BY d ORDER BY md5((2024 + d)::VARCHAR || '_' || sid::VARCHAR), sid) - 1, m1, m2, m3, w FROM sig CROSS JOIN (SELECT unnest(range(1, 11)) AS d)),
    dpair AS MATERIALIZED (
        SELECT a.draw, a.sid AS i, b.sid AS j, a.w AS wi, b.w AS wj,
               ((a.m1 IS DISTINCT FROM b.m1)::INT + (a.m2 IS DISTINCT FROM b.m2)::INT + (a.m3 IS DISTINCT FROM b.m3)::INT) AS disagree
        FROM dsig a JOIN dsig b ON a.draw = b.draw AND a.sid < b.sid),
    dstep(n, draw, kind, a, b, v) AS (
        SELECT 0, draw::BIGINT, 'p', i::BIGINT, j::BIGINT, (wi * wj * disagree)::DOUBLE FROM dpair
        UNION ALL SELECT 0, draw::BIGINT, 'm', sid::BIGINT, sid::BIGINT, w::DOUBLE FROM dsig
        UNION ALL (
            WITH size AS (SELECT draw, b AS c, sum(v) AS s FROM dstep WHERE kind = 'm' GROUP BY draw, b),
            best AS (SELECT draw, x, y FROM (
                SELECT p.draw, p.a AS x, p.b AS y, row_number() OVER (PARTITION BY p.draw ORDER BY p.v / (g.s * h.s), p.a, p.b) AS r
                FROM dstep p JOIN size g ON g.draw = p.draw AND g.c = p.a JOIN size h ON h.draw = p.draw AND h.c = p.b WHERE p.kind = 'p') WHERE r = 1),
            moved AS (SELECT t.n, t.draw, t.kind, CASE WHEN t.kind = 'p' AND t.a = y THEN x ELSE t.a END AS a, CASE WHEN t.b = y THEN x ELSE t.b END AS b, t.v
                      FROM dstep t JOIN best ON best.draw = t.draw WHERE NOT (t.kind = 'p' AND t.a = x AND t.b = y))
            SELECT n + 1, draw, kind, CASE WHEN kind = 'p' THEN least(a, b) ELSE a END, CASE WHEN kind = 'p' THEN greatest(a, b) ELSE b END, sum(v)
            FROM moved WHERE n < (SELECT count(*) FROM sig) - 2
            GROUP BY n, draw, kind, CASE WHEN kind = 'p' THEN least(a, b) ELSE a END, CASE WHEN kind = 'p' THEN greatest(a, b) ELSE b END)),
    dcut AS MATERIALIZED (SELECT draw, ((SELECT count(*) FROM sig) - n)::INTEGER AS k, a AS sid, b AS cluster, v AS w FROM dstep WHERE kind = 'm' AND (SELECT count(*) FROM sig) - n BETWEEN 2 AND 15),
    dwk AS (
        SELECT draw, k, round(sum(d / (2.0 * 3 * n))::DOUBLE, 9) AS wk
        FROM (SELECT draw, k, cluster, sum(w) AS n FROM dcut GROUP BY ALL)
        LEFT JOIN (SELECT p.draw, x.k, x.cluster, sum(2.0 * p.wi * p.wj * p.disagree) AS d
                   FROM dpair p JOIN dcut x ON x.draw = p.draw AND x.sid = p.i JOIN dcut y ON y.draw = p.draw AND y.sid = p.j AND y.k = x.k AND y.cluster = x.cluster
                   GROUP BY ALL) USING (draw, k, cluster)
        GROUP BY draw, k)
"""


@query(f"""
    WITH RECURSIVE {_LINES_SQL}, {_DRAWS_SQL}
    SELECT k, round(avg(ln(wk + 1e-10)) FILTER (WHERE draw > 0) - max(ln(wk + 1e-10)) FILTER (WHERE draw = 0), 9) AS gap FROM dwk GROUP BY k
""")
def gap_by_k(spark, sf_dir):
    return linkage.gap(_line_signatures(spark, sf_dir), list(DEFAULTS.k_range), 3)


@query(f"WITH {_LINES_SQL} SELECT i, j, wi, wj, disagree::INTEGER AS disagree, disagree / 3.0::DOUBLE AS distance FROM pair WHERE 3 - disagree >= 2")
def coassoc_shared(spark, sf_dir):
    """Pairs of label tuples that share two labels or more, found by their rarest labels."""
    return labels.coassociation(_line_signatures(spark, sf_dir), 2)


_SAMPLE_SQL = """
    few AS (SELECT m1, m2, m3, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM mat
            ORDER BY md5('2025_' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey), m1, m2, m3 LIMIT 5000)
"""


@query(f"""
    WITH {_LINES_SQL}, {_SAMPLE_SQL}
    SELECT row_number() OVER (ORDER BY o, m1, m2, m3) - 1 AS sid, m1, m2, m3, w
    FROM (SELECT m1, m2, m3, count(*) AS w, min(row(l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS o FROM few GROUP BY m1, m2, m3)
""")
def rows_sampled(spark, sf_dir):
    """Label tuples of the sample that silhouette and gap can be asked to look at."""
    few = labels.bottom_rows(_line_matrix(spark, sf_dir), _LINE_KEYS, DEFAULTS.sample_rows)
    return labels.signatures(few, _M3, _LINE_KEYS).select("sid", *[F.get("sig", F.lit(k)).alias(m) for k, m in enumerate(_M3)], "w")


def _ari_sql(a: str, b: str, source: str) -> str:
    return f"""
        SELECT '{a}' AS a, '{b}' AS b, round(CASE WHEN (pa + pb) / 2 - pa * pb / t = 0 THEN 1.0 ELSE (c - pa * pb / t) / ((pa + pb) / 2 - pa * pb / t) END, 9) AS ari
        FROM (WITH cell AS (SELECT {a}, {b}, count(*)::DOUBLE AS n FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a}, {b})
              SELECT (SELECT sum(n * (n - 1) / 2) FROM cell) AS c, (SELECT sum(n) * (sum(n) - 1) / 2 FROM cell) AS t,
                     (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM cell GROUP BY {a})) AS pa,
                     (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM cell GROUP BY {b})) AS pb)
    """


@query(f"WITH {_DOC_SQL} " + " UNION ALL ".join(_ari_sql(a, b, "mat") for a, b in (("m1", "m2"), ("m1", "m3"), ("m1", "m1"))))
def ari_pairwise(spark, sf_dir):
    return linkage.adjusted_rands(_doc_matrix(spark, sf_dir), [("m1", "m2"), ("m1", "m3"), ("m1", "m1")])


# --- audit ---------------------------------------------------------------------------------------

_REPLY = '```json\n{"final_keep_ids": ["model_2", "model_9", "model_1"], "per_model_notes": {"model_1": "agrees", "model_2": "fine"}}\n```'


@query(f"""
    WITH ids AS (SELECT 'model_' || row_number() OVER (ORDER BY r_name) AS generic, r_name AS model FROM region),
    r AS (SELECT trim(regexp_replace(reply, '```json\\s*|\\s*```', '', 'g')) AS j FROM {_values([(_REPLY,)])} t(reply)),
    k AS (SELECT unnest(range(json_array_length(j, '$.final_keep_ids')::BIGINT)) AS pos, j FROM r)
    SELECT pos::INTEGER AS pos, generic, model, json_extract_string(j, '$.per_model_notes.' || generic) AS note
    FROM (SELECT pos, j, json_extract_string(j, '$.final_keep_ids[' || pos || ']') AS g FROM k) JOIN ids ON generic = g
""")
def audit_keep_map(spark, sf_dir):
    ids = audit.generic_ids(_read(spark, sf_dir, "region").select(F.col("r_name").alias("model")))
    return audit.kept(_literal(spark, [(_REPLY,)], "reply string"), ids)


@query(f"""
    WITH {_ORDERS_SQL}, {_TALLY_SQL},
    v AS (SELECT *, 'Rep ' || rep || ': ' || m1 || ' vs ' || m2 || ' -> ' || CASE choice WHEN 'first' THEN m1 WHEN 'second' THEN m2 ELSE 'tie' END AS line
          FROM verdict WHERE m1 IN (SELECT model FROM placed WHERE place <= 4) AND m2 IN (SELECT model FROM placed WHERE place <= 4)),
    f AS (SELECT * FROM v ORDER BY rep, m1, m2 LIMIT 20)
    SELECT (SELECT string_agg(line, chr(10) ORDER BY rep, m1, m2) FROM f) || CASE WHEN count(*) > 20 THEN chr(10) || '(' || (count(*) - 20) || ' more)' ELSE '' END AS summary FROM v
""")
def audit_summary(spark, sf_dir):
    rows = _order_verdicts(spark, sf_dir)
    top = selection.top_fixed(tournament.tally(rows), 4)
    return audit.summary(audit.within(rows, top))


# --- flagship ------------------------------------------------------------------------------------

#: Five labelings of line items compete by the share of price variance that they explain, year by year.
_LABELINGS = {
    "flag": ("l_returnflag", "l_returnflag"),
    "status": ("l_linestatus", "l_linestatus"),
    "quantity": ("cast(floor(l_quantity / 10) as string)", "floor(l_quantity / 10)::BIGINT::VARCHAR"),
    "line": ("cast(l_linenumber as string)", "l_linenumber::VARCHAR"),
    "discount": ("cast(floor(l_discount * 100 / 4) as string)", "floor(l_discount * 100 / 4)::BIGINT::VARCHAR"),
}
_LONG_SQL = " UNION ALL ".join(
    f"SELECT rid, l_orderkey, l_linenumber, l_partkey, l_suppkey, year(l_shipdate)::INTEGER AS rep, l_extendedprice AS p, '{m}' AS model, {sql} AS label FROM item"
    for m, (_, sql) in _LABELINGS.items()
)
_FLAGSHIP_SQL = f"""
    item AS MATERIALIZED (SELECT *, row_number() OVER () AS rid FROM lineitem),
    long AS MATERIALIZED ({_LONG_SQL}),
    cell AS (SELECT model, rep, label, count(*) AS n, sum(p) AS s, sum(p * p) AS q FROM long GROUP BY ALL),
    rev AS (SELECT model, rep, round((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (sum(q) - sum(s) * sum(s) / sum(n)), 4) AS x FROM cell GROUP BY model, rep),
    verdict AS (SELECT a.model AS m1, b.model AS m2, a.rep, CASE WHEN a.x = b.x THEN 'tie' WHEN a.x > b.x THEN 'first' ELSE 'second' END AS choice
                FROM rev a JOIN rev b ON a.rep = b.rep AND a.model < b.model),
    {_TALLY_SQL}
"""


def _flagship_matrix(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select(*_LINE_KEYS, F.year("l_shipdate").alias("rep"), F.col("l_extendedprice").alias("p"), *[F.expr(e).alias(m) for m, (e, _) in _LABELINGS.items()])


def _flagship_verdicts(matrix: DataFrame) -> DataFrame:
    sides = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("label")) for m in _LABELINGS])
    cell = matrix.select("rep", "p", F.inline(sides)).groupBy("model", "rep", "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")
    )
    s, n = F.sum("s"), F.sum("n")
    share = (F.sum(F.col("s") * F.col("s") / F.col("n")) - s * s / n) / (F.sum("q") - s * s / n)
    return _games(cell.groupBy("model", "rep").agg(F.round(share, 4).alias("x")), 0.0)


@query(f"WITH {_FLAGSHIP_SQL} SELECT * FROM placed")
def flagship_ranking(spark, sf_dir):
    return tournament.numbered(tournament.ranking(_flagship_verdicts(_flagship_matrix(spark, sf_dir))))


@query(f"""
    WITH RECURSIVE {_FLAGSHIP_SQL},
    top AS (SELECT model, place FROM placed WHERE place <= 3),
    kk AS (SELECT round_even(median(k), 0)::INTEGER AS k FROM (SELECT count(DISTINCT label) AS k FROM long JOIN top USING (model) GROUP BY model) WHERE k BETWEEN 2 AND 15),
    row_sig AS (SELECT rid, l_orderkey, l_linenumber, l_partkey, l_suppkey, list(label ORDER BY place) AS t
                FROM long JOIN top USING (model) GROUP BY rid, l_orderkey, l_linenumber, l_partkey, l_suppkey),
    sig AS MATERIALIZED (SELECT row_number() OVER (ORDER BY o, t) - 1 AS sid, t, w FROM (
                SELECT t, count(*) AS w, min(row(l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS o FROM row_sig GROUP BY t)),
    pair AS MATERIALIZED (SELECT a.sid AS i, b.sid AS j, a.w AS wi, b.w AS wj, (a.t[1] <> b.t[1])::INT + (a.t[2] <> b.t[2])::INT + (a.t[3] <> b.t[3])::INT AS disagree
             FROM sig a JOIN sig b ON a.sid < b.sid),
    {_tree_sql("(SELECT k FROM kk)")}, c AS ({_cut_sql("")})
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, cluster AS consensus_label FROM row_sig JOIN sig USING (t) JOIN c USING (sid)
""")
def flagship_consensus(spark, sf_dir):
    """Ranking of five labelings, the best three, the median of their class counts, consensus of every line item."""
    matrix = _flagship_matrix(spark, sf_dir)
    rows = pipeline.run(_flagship_verdicts(matrix), matrix.select(*_LINE_KEYS, *_LABELINGS), _LINE_KEYS, top_k=3)
    return rows

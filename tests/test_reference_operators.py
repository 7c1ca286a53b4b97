"""Small cases worked out by hand, properties, and one test per error."""

import hashlib
import json
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord import schemas
from concord.functions import text
from concord.operators import audit, judges, labels, linkage, selection, tournament
from concord.plans import pipeline
from concord.sources import files, sinks


def verdicts(spark, rows):
    return spark.createDataFrame([(None, a, b, c, None, 1) for a, b, c in rows], schemas.VERDICT)


def test_tally_counts_ties_and_skips_unnamed_sides(spark):
    rows = verdicts(spark, [("A", "B", "FIRST "), ("A", "B", None), ("", "B", None), ("A", "B", "second")])
    got = [tuple(r) for r in tournament.ranking(rows).collect()]
    assert got == [("B", 3, 1, 1, 1, 1.5, 0.5), ("A", 3, 1, 1, 1, 1.5, 0.5)]
    assert tuple(tournament.counters(rows).first()) == (4, 3)


def test_tally_balances(spark):
    rnd = random.Random(1)
    rows = [(f"m{rnd.randrange(5)}", f"n{rnd.randrange(5)}", rnd.choice(["first", "second", "tie", None])) for _ in range(300)]
    t = tournament.tally(verdicts(spark, rows)).agg(F.sum("wins"), F.sum("losses"), F.sum("points"), F.sum("games")).first()
    assert t[0] == t[1] and t[2] == 300 and t[3] == 600


def test_scalars(spark):
    replies = ["I say Second!", "none", "firstly, second", "second, then first", None]
    df = spark.createDataFrame([(r,) for r in replies], "r string")
    assert [x[0] for x in df.select(text.parsed_choice(F.col("r"))).collect()] == ["second", None, "second", "second", None]
    names = spark.createDataFrame([("GraphST_v1",), ("Graph-ST (v1)",), ("SpaGCN.png",)], "name string")
    assert [x[0] for x in names.select(text.normalized_name(F.col("name"))).collect()] == ["graphstv1", "graphstv1", "spagcnpng"]
    assert labels.collisions(names).first()["names"] == ["Graph-ST (v1)", "GraphST_v1"]
    d = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (0.4,)], "d double")
    assert [x[0] for x in d.select(text.clean_distance(F.col("d"))).collect()] == [1.0, 1.0, 0.0, 0.4]


def test_cache_key_is_the_plain_md5(spark):
    import hashlib

    key = spark.range(1).select(text.cache_key(F.lit("a"), F.lit("b"), F.lit(1), F.lit(None))).first()[0]
    assert key == hashlib.md5(b"a_b_1_None").hexdigest()


@pytest.mark.parametrize(("counts", "median", "mode"), [([2, 3], 2, 2), ([3, 4], 4, 3), ([1, 20], None, None), ([7, 3, 3, 7], 5, 7)])
def test_k_by_median_and_mode(spark, counts, median, mode):
    df = spark.createDataFrame([(k, f"m{k}", c) for k, c in enumerate(counts)], "sel_pos int, model string, k long")
    assert labels.k_median(df).first().k == median
    row = labels.k_mode(df).first()
    assert (row.k if row else None) == mode


def matrix(spark, *columns):
    rows = [(i, *row) for i, row in enumerate(zip(*columns))]
    return spark.createDataFrame(rows, "pos int, " + ", ".join(f"m{k + 1} string" for k in range(len(columns))))


def test_missing_labels_are_a_cluster_and_agree(spark):
    m = matrix(spark, ["b", None, "a", None])
    assert labels.k_counts(m, ["m1"]).first().k == 3
    assert labels.signatures(m, ["m1"], ["pos"]).count() == 3


def clusters(spark, m, k):
    names = [c for c in m.columns if c != "pos"]
    out = pipeline.run_consensus(m, names, ["pos"], pipeline.KChoice("fixed", k))
    return [r.consensus_label for r in out.orderBy("pos").collect()]


def test_consensus_by_hand(spark):
    m = matrix(spark, "aabb", "xxyy", "pqqq")
    assert clusters(spark, m, 2) == [0, 0, 1, 1]
    assert clusters(spark, m, 3) == [0, 1, 2, 2]
    tie = matrix(spark, "aabb", "xxxy")
    assert clusters(spark, tie, 2) == [0, 0, 0, 1]


def naive_upgma(rows, k):
    """Full matrix, one row a cluster, ties by first rows."""
    groups = [[i] for i in range(len(rows))]
    d = lambda a, b: sum(x != y for x, y in zip(rows[a], rows[b]))
    while len(groups) > k:
        best = min(((sum(d(a, b) for a in g for b in h) / (len(g) * len(h)), i, j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j))
        _, i, j = best
        groups[i] = groups[i] + groups.pop(j)
        groups.sort(key=min)
    out = [0] * len(rows)
    for n, g in enumerate(sorted(groups, key=min)):
        for i in g:
            out[i] = n
    return out


def test_linkage_over_signatures_equals_the_full_matrix():
    rnd = random.Random(3)
    for _ in range(60):
        n, m = rnd.randint(2, 24), rnd.randint(2, 4)
        rows = [tuple(rnd.randrange(3) for _ in range(m)) for _ in range(n)]
        sigs = list(dict.fromkeys(rows))
        weights = np.array([rows.count(s) for s in sigs])
        merges = linkage.merges_of(np.array(sigs), weights)
        for k in range(1, len(sigs) + 1):
            of = np.arange(len(sigs))
            for a, b, _ in merges[: len(sigs) - k]:
                of[of == b] = a
            number = {c: i for i, c in enumerate(np.unique(of))}
            assert [number[of[sigs.index(r)]] for r in rows] == naive_upgma(rows, k)


def test_identical_models_are_their_own_consensus(spark):
    m = matrix(spark, "abcab", "abcab")
    assert clusters(spark, m, 3) == [0, 1, 2, 0, 1]
    assert linkage.adjusted_rand(m, "m1", "m2").first().ari == 1.0


def test_silhouette_and_dispersion_against_brute_force(spark):
    rows = list(zip("aaabbbcc", "xxyyyzzz"))
    m = matrix(spark, *zip(*rows))
    sigs = labels.signatures(m, ["m1", "m2"], ["pos"])
    cuts = linkage.cut(sigs, linkage.dendrogram(sigs), [2, 3])
    d = lambda i, j: sum(x != y for x, y in zip(rows[i], rows[j])) / 2
    for k in (2, 3):
        own = clusters(spark, m, k)
        groups = {c: [i for i in range(8) if own[i] == c] for c in set(own)}
        scores, wk = [], 0.0
        for g in groups.values():
            wk += sum(d(i, j) for i in g for j in g) / (2 * len(g))
        for i in range(8):
            mine = groups[own[i]]
            if len(mine) == 1:
                scores.append(0.0)
                continue
            a = sum(d(i, j) for j in mine) / (len(mine) - 1)
            b = min(sum(d(i, j) for j in g) / len(g) for c, g in groups.items() if c != own[i])
            scores.append((b - a) / max(a, b) if max(a, b) else 0.0)
        assert linkage.silhouette(sigs, cuts, 2).where(f"k = {k}").first().silhouette == pytest.approx(sum(scores) / 8, abs=1e-8)
        assert linkage.dispersion(sigs, cuts, 2).where(f"k = {k}").first().wk == pytest.approx(wk, abs=1e-8)


@pytest.mark.parametrize(
    ("rates", "top_k", "n"), [([0.9, 0.8, 0.3, 0.2, 0.1], 5, 3), ([0.9, 0.8, 0.3, 0.2, 0.1], 2, 3), ([0.9, 0.1], 5, 2), ([0.9, 0.8, 0.7, 0.6, 0.1], 5, 4)]
)
def test_elbow(spark, rates, top_k, n):
    df = spark.createDataFrame([(f"m{k}", r) for k, r in enumerate(rates)], "model string, win_rate double")
    assert selection.top_elbow(df, top_k).count() == n


def test_selection_precedence_and_errors(spark):
    df = spark.createDataFrame([("a", 0.9), ("b", 0.5), ("c", 0.1)], "Model string, WinningRate double")
    assert selection.resolve(df, ["c", "a"], ["b", "a"]) == ["c", "a"]
    assert selection.resolve(df, None, ["b", "a"]) == ["b", "a"]
    assert selection.resolve(df, top_k=2) == ["a", "b"]
    for bad in (lambda: selection.resolve(df, ["z", "a"]), lambda: selection.resolve(df, ["a"]), lambda: selection.top_fixed(df, 0), lambda: selection.select_top(df, "best")):
        with pytest.raises(ValueError):
            bad()


def test_alignment_keeps_the_first_frames_ids(spark):
    one = spark.createDataFrame([(3, "a", 0), (1, "b", 1), (2, "c", 2)], "id int, x string, pos int")
    two = spark.createDataFrame([(1, "p", 0), (2, "q", 1), (9, "r", 2)], "id int, y string, pos int")
    got = [tuple(r) for r in labels.align({"m1": one, "m2": two}).orderBy("pos").select("id", "m1", "m2").collect()]
    assert got == [(3, "a", None), (1, "b", "p"), (2, "c", "q")]
    with pytest.raises(ValueError, match="differ"):
        labels.align({"m1": one, "m2": two.limit(2)})
    with pytest.raises(ValueError, match="repeat"):
        labels.align({"m1": one.union(one.limit(1)), "m2": two})


def test_matching_columns():
    assert labels.match_columns(["Spa-GCN"], ["spagcn", "x"]) == {"Spa-GCN": "spagcn"}
    for bad in ((["a"], ["A_", "a"]), (["q"], ["a"])):
        with pytest.raises(ValueError):
            labels.match_columns(*bad)


def test_consensus_errors(spark):
    m = matrix(spark, "ab", "xy")
    for models, choice in ((["m1", "m1"], pipeline.KChoice()), (["m1", "m2"], pipeline.KChoice("fixed")), (["m1", "m2"], pipeline.KChoice("best")), (["m1", "m2"], pipeline.KChoice(k_range=(7, 8)))):
        with pytest.raises(ValueError):
            pipeline.run_consensus(m, models, ["pos"], choice).collect()
    with pytest.raises(ValueError):
        pipeline.run_consensus(m.limit(0), ["m1", "m2"], ["pos"])


def test_audit_reply(spark):
    ids = audit.generic_ids(spark.createDataFrame([("b",), ("a",)], "model string"))
    reply = '```json\n{"final_keep_ids": ["model_2", "model_9", "model_1"], "per_model_notes": {"model_1": "x"}}\n```'
    got = audit.kept(spark.createDataFrame([(reply,)], "reply string"), ids).collect()
    assert [r.model for r in got] == ["b", "a"] and got[1].note == "x"
    rates = spark.createDataFrame([("a", 0.5)], "model string, win_rate double")
    many = verdicts(spark, [("a", "b", "first")] * 23)
    digest = audit.summary(many)
    assert digest.first().summary.endswith("(3 more)")
    assert "model_2 (b): win_rate = 0.000" in audit.prompt(ids, rates, digest).first().prompt


def test_judges_retry_cache_and_fail_as_ties(spark):
    waits, calls = [], []

    def flaky(game):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("down")
        return "Second"

    assert judges.ask(flaky, {}, 3, 1.5, waits.append) == "Second" and waits == [1.5, 2.25]
    games = judges.keyed(tournament.schedule(tournament.pairs(spark.createDataFrame([("a",), ("b",), ("c",)], "model string")), 2), "simple", "m", 1, "low")

    def call(game):
        if game["model2"] == "c":
            raise OSError("down")
        return "first wins"

    rows, fresh = judges.judged(games, None, judges.callable_judge(call, 2, 1, 0.0))
    assert rows.count() == 6 and fresh.count() == 2
    t = {r.model: r.ties for r in tournament.tally(judges.verdicts(rows)).collect()}
    assert t == {"a": 2, "b": 2, "c": 4}
    again, more = judges.judged(games, fresh, judges.callable_judge(call, 2, 1, 0.0))
    assert again.count() == 6 and more.count() == 0


def test_files_round_trip(spark, tmp_path):
    images = tmp_path / "images"
    images.mkdir()
    for name in ("he.png", "X.jpg", "X.png", "Y.jpeg", "Y.jpg", "Z.PNG"):
        (images / name).write_bytes(name.encode())
    ref, models = files.read_images(spark, str(images))
    got = {r.model: r.data_url for r in models.collect()}
    assert set(got) == {"X", "Y"} and got["X"].startswith("data:image/png;base64,") and ref.first().model == "he"
    (tmp_path / "r.csv").write_text("Model,WinningRate\na,0.5\nNA,0.25\n")
    assert [tuple(r) for r in files.read_ranking(spark, str(tmp_path / "r.csv")).select("model", "win_rate").collect()] == [("a", 0.5), (None, 0.25)]
    (tmp_path / "w.csv").write_text("id,A b,c\n1,x,\n2,null,y\n")
    wide = files.read_combined(spark, str(tmp_path / "w.csv"), "id")
    assert [tuple(r) for r in wide.orderBy("pos").select("id", "A b", "c").collect()] == [("1", "x", None), ("2", None, "y")]
    with pytest.raises(ValueError):
        files.read_combined(spark, str(tmp_path / "w.csv"), "nope")
    (tmp_path / "bad.csv").write_text("id,A_,a\n1,x,y\n")
    with pytest.raises(ValueError):
        files.read_combined(spark, str(tmp_path / "bad.csv"), "id")
    (tmp_path / "m1_labels.csv").write_text("id,l\n1,x\n")
    assert files.locate(spark, str(tmp_path), ["m1"])["m1"].endswith("m1_labels.csv")
    with pytest.raises(ValueError, match="m2"):
        files.locate(spark, str(tmp_path), ["m1", "m2"])


def test_verdict_log(spark, tmp_path):
    good = {"ts": "t", "model1_label": "A", "model2_label": "B", "gpt_choice": "first", "gpt_output": "é", "repetition": 1}
    (tmp_path / "v.jsonl").write_text(json.dumps(good) + "\n\nnot json\n")
    rows = files.read_verdicts(spark, str(tmp_path / "v.jsonl"))
    assert [r.gpt_choice for r in rows.collect()] == ["first"]
    out = str(tmp_path / "log")
    sinks.write_verdicts(rows, out)
    sinks.write_verdicts(rows, out)
    assert files.read_verdicts(spark, out).count() == 1


def test_audit_file(spark, tmp_path):
    row = spark.createDataFrame([(["model_1"], ["a"], {}, {}, "d", "{}")], schemas.AUDIT)
    assert files.read_audit(spark, str(tmp_path)) is None
    assert sinks.write_audit(row, str(tmp_path / "pairwise")).endswith("/d_second_round.json")
    assert files.read_audit(spark, str(tmp_path)) == ["a"]
    (tmp_path / "x_second_round.json").write_text("{broken")
    assert files.read_audit(spark, str(tmp_path)) is None


def test_more_names_than_the_driver_holds(spark, monkeypatch):
    monkeypatch.setattr(selection, "DEFAULTS", replace(selection.DEFAULTS, max_models=2))
    ranked = spark.createDataFrame([(m, 0.5) for m in "abc"], "model string, win_rate double")
    assert selection.resolve(ranked, top_k=2) == ["c", "b"]
    with pytest.raises(ValueError, match="more than 2"):
        selection.resolve(ranked, top_k=3)


def test_gap_against_brute_force(spark):
    """Every draw is the data in another order: log dispersions by plain sums over pairs of rows."""
    rnd = random.Random(3)
    rows = [(k, rnd.choice("ab"), rnd.choice("xyz"), rnd.choice("pq")) for k in range(40)]
    m = spark.createDataFrame(rows, "pos long, m1 string, m2 string, m3 string")
    sigs = labels.signatures(m, ["m1", "m2", "m3"], ["pos"])
    ks = [2, 3, 5]

    def wk(ordered, k):
        codes = np.array([[ord(x[0]) for x in r.sig] for r in ordered])
        weights = np.array([r.w for r in ordered])
        of = np.arange(len(ordered))
        for a, b, _ in linkage.merges_of(codes, weights)[: max(0, len(ordered) - k)]:
            of[of == b] = a
        total = 0.0
        for c in set(of):
            i = np.flatnonzero(of == c)
            d = (codes[i][:, None] != codes[i][None]).mean(2)
            total += (d * weights[i][:, None] * weights[i]).sum() / (2 * weights[i].sum())
        return np.log(total + 1e-10)

    own = sigs.orderBy("sid").collect()
    draws = [sorted(own, key=lambda x: hashlib.md5(f"{2025 + r}_{x.sid}".encode()).hexdigest()) for r in range(4)]
    found = {r.k: r.gap for r in linkage.gap(sigs, ks, 3, draws=4).collect()}
    for k in ks:
        assert found[k] == pytest.approx(np.mean([wk(d, k) for d in draws]) - wk(own, k), abs=1e-6)


def test_streaming_tally_equals_batch(spark, tmp_path):
    from concord.streaming import ranking

    rows = verdicts(spark, [("A", "B", "first"), ("A", "C", "second")])
    rows.write.json(str(tmp_path / "in"))
    q = ranking.tallies(ranking.read_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("live").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("live").collect())) == sorted(map(tuple, tournament.tally(rows).collect()))


def test_tournament_audit_and_consensus_end_to_end(spark):
    images = spark.createDataFrame([(m, f"data:{m}") for m in "abc"], "model string, data_url string")
    rows, fresh = pipeline.play(images, judges.expression_judge(F.lit("First")), 2)
    assert rows.count() == 6 and fresh.count() == 6
    ranked = [r.model for r in tournament.ranking(rows).collect()]
    assert ranked == ["a", "b", "c"]
    asked = []

    def call(game):
        asked.append(game)
        return '{"final_keep_ids": ["model_2", "model_1", "model_7"], "per_model_notes": {"model_1": "fine", "model_7": "?"}}'

    result = pipeline.run_audit(rows, images, call, "d s").first()
    assert result.final_model_ids == ["b", "a"] and result.per_model_notes == {"a": "fine"}
    assert asked[0]["images"] == ["data:a", "data:b", "data:c"] and "win_rate" in asked[0]["prompt"]
    m = matrix(spark, "aabb", "xxyy", "pqqq").withColumnsRenamed({"m1": "A", "m2": "b", "m3": "c"})
    out = pipeline.run(rows, m, ["pos"], audited=result.final_model_ids, choice=pipeline.KChoice("fixed", 2))
    truth = spark.createDataFrame([(0, 1), (1, 1), (2, 2), (3, 2)], "pos int, t int")
    assert pipeline.agreement(out, truth, "pos", "t").first().ari == 1.0
    assert pipeline.agreement(out, truth, "pos", "nope") is None
    for bad in (lambda: pipeline.play(images.limit(1), judges.expression_judge(F.lit("x"))), lambda: pipeline.run_audit(rows, images, lambda g: "no json", "d"), lambda: pipeline.run_audit(rows, images.limit(1), call, "d")):
        with pytest.raises(ValueError):
            bad()


def test_messages(spark):
    df = spark.createDataFrame([("u1", None)], "a string, b string")
    chat = audit.messages(audit.compare_prompt(F.lit("tissue"), F.lit(True)), F.col("a"), F.col("b"))
    (turn,) = df.select(text.provider_parts(chat).alias("m")).first().m
    assert [p.type for p in turn.content] == ["input_text", "input_image"] and "tissue" in turn.content[0].text

"""What replaces single tasks: linkage in rounds, sums by histogram, one-pass alignment and agreement, samples."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.operators import labels, linkage
from concord.sources.tables import in_order

MODELS = ["m1", "m2", "m3"]


def made_up(spark, rows, labels_each, seed, missing=0.1):
    rnd = random.Random(seed)
    cell = lambda n: None if rnd.random() < missing else f"l{rnd.randrange(n)}"
    data = [(k, *(cell(n) for n in labels_each)) for k in range(rows)]
    return spark.createDataFrame(data, "pos int, " + ", ".join(f"m{k + 1} string" for k in range(len(labels_each))))


def tree_by_hand(sigs):
    rows = sorted(sigs.collect(), key=lambda r: r.sid)
    codes = np.array([[hash((k, x)) for k, x in enumerate(r.sig)] for r in rows])
    return linkage.merges_of(codes, np.array([r.w for r in rows]))


@pytest.mark.parametrize("shape", [(60, (3, 3, 3)), (150, (4, 9)), (120, (2, 2, 2, 2, 3)), (200, (14, 14))])
def test_linkage_in_rounds_is_that_of_one_merge_at_a_time(spark, shape):
    """Few labels, so that nearly all heights are tied."""
    m = made_up(spark, *shape, seed=shape[0])
    sigs = labels.signatures(m, m.columns[1:], ["pos"])
    want = tree_by_hand(sigs)
    got = [(r.step, r.a, r.b, r.height) for r in linkage.dendrogram(sigs, local=5, block=7).collect()]
    assert sorted(got) == [(k, a, b, h) for k, (a, b, h) in enumerate(want)]
    assert [(r.step, r.a, r.b, r.height) for r in linkage.dendrogram(sigs).orderBy("step").collect()] == sorted(got)


def test_cuts_in_rounds(spark):
    m = made_up(spark, 150, (5, 6, 4), 3)
    sigs = labels.signatures(m, MODELS, ["pos"])
    tree = linkage.dendrogram(sigs)
    ks = [1, 2, 3, 9]
    one = {tuple(r) for r in linkage.cut(sigs, tree, ks).collect()}
    assert {tuple(r) for r in linkage.cut(sigs, tree, ks, local=12).collect()} == one
    assert len(one) == 4 * sigs.count() and {r[2] for r in one if r[0] == 1} == {0}


def test_draws_do_not_mix(spark):
    m = made_up(spark, 90, (4, 4, 4), 5)
    sigs = labels.signatures(m, MODELS, ["pos"])
    draws = linkage.drawn(sigs, 3)
    n = sigs.count()
    assert sorted(r.sid for r in draws.where("draw = 2").collect()) == list(range(n)) and draws.count() == 4 * n
    trees = linkage.dendrogram(draws, ("draw",), local=6, block=9)
    cuts = linkage.cut(draws, trees, [2, 5], ("draw",), local=7)
    for d in range(4):
        own = draws.where(F.col("draw") == d).drop("draw")
        assert sorted((r.step, r.a, r.b, r.height) for r in trees.where(F.col("draw") == d).collect()) == [(k, *x) for k, x in enumerate(tree_by_hand(own))]
        alone = linkage.cut(own, linkage.dendrogram(own), [2, 5])
        assert {(r.k, r.sid, r.cluster) for r in cuts.where(F.col("draw") == d).collect()} == {tuple(r) for r in alone.collect()}
    assert linkage.gap(sigs, [2, 4], 3, draws=3, local=8).collect() == linkage.gap(sigs, [2, 4], 3, draws=3).collect()


def test_linkage_of_thousands_in_rounds(spark):
    """No task sees all tuples; the tree is that of the plain matrix."""
    m = made_up(spark, 6000, (40, 40, 40), 8, 0.0)
    sigs = labels.signatures(m, MODELS, ["pos"])
    assert sigs.count() > 4500
    got = sorted((r.step, r.a, r.b, r.height) for r in linkage.dendrogram(sigs, local=1000).collect())
    assert got == [(k, a, b, h) for k, (a, b, h) in enumerate(tree_by_hand(sigs))]


def test_no_pairs_of_tuples_in_the_plans(spark):
    sigs = labels.signatures(made_up(spark, 40, (3, 3, 3), 1), MODELS, ["pos"])
    cuts = linkage.cut(sigs, linkage.dendrogram(sigs), [2, 3])
    for df in (linkage.silhouette(sigs, cuts, 3), linkage.dispersion(sigs, cuts, 3), labels.coassociation(sigs, 2)):
        plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
        assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("seed", range(3))
def test_scores_from_counts_equal_sums_over_pairs(spark, seed):
    m = made_up(spark, 30, (3, 4, 2), seed)
    rows = [tuple(r)[1:] for r in m.orderBy("pos").collect()]
    sigs = labels.signatures(m, MODELS, ["pos"])
    ks = [2, 3, 8, 25]
    cuts = linkage.cut(sigs, linkage.dendrogram(sigs), ks)
    of = {(r.k, tuple(r.sig)): r.cluster for r in cuts.join(sigs, "sid").collect()}
    d = lambda i, j: sum(x != y for x, y in zip(rows[i], rows[j])) / 3
    sil, wk = ({r.k: r[1] for r in f(sigs, cuts, 3).collect()} for f in (linkage.silhouette, linkage.dispersion))
    for k in ks:
        own = [of[k, r] for r in rows]
        groups = {c: [i for i in range(30) if own[i] == c] for c in set(own)}
        assert wk[k] == pytest.approx(sum(sum(d(i, j) for i in g for j in g) / (2 * len(g)) for g in groups.values()), abs=1e-7)
        scores = []
        for i in range(30):
            mine = groups[own[i]]
            a = sum(d(i, j) for j in mine) / max(1, len(mine) - 1)
            b = min(sum(d(i, j) for j in g) / len(g) for c, g in groups.items() if c != own[i])
            scores.append((b - a) / max(a, b) if len(mine) > 1 and max(a, b) else 0.0)
        assert sil[k] == pytest.approx(sum(scores) / 30, abs=1e-7)


@pytest.mark.parametrize("shared", [1, 2, 3, 4])
def test_pairs_by_rare_labels(spark, shared):
    sigs = labels.signatures(made_up(spark, 120, (5, 6, 4, 9), 2), [*MODELS, "m4"], ["pos"])
    want = {tuple(r) for r in labels.coassociation(sigs).where(f"4 - disagree >= {shared}").collect()}
    assert {tuple(r) for r in labels.coassociation(sigs, shared).collect()} == want and (want or shared == 4)


def test_alignment_is_one_exchange(spark):
    frames = {f"m{k}": spark.createDataFrame([(i, f"x{i % (k + 2)}", i) for i in range(30)] + [(None, "none", 99)], "id int, label string, pos int") for k in range(4)}
    out = labels.align(frames)
    got = {r.id: tuple(r)[2:] for r in out.collect()}
    assert len(got) == 31 and got[5] == ("x1", "x2", "x1", "x0") and got[None] == ("none",) * 4 and out.columns == ["id", "pos", "m0", "m1", "m2", "m3"]
    with pytest.raises(ValueError, match="m2: ids repeat"):
        labels.align(frames | {"m2": frames["m2"].limit(30).union(frames["m2"].limit(1))})
    with pytest.raises(ValueError, match="m1: ids repeat"):
        labels.align(frames | {"m1": frames["m1"].where("id > 0 OR id IS NULL").union(frames["m1"].where("id IS NULL"))})
    with pytest.raises(ValueError, match="differ"):
        labels.align(frames | {"m3": frames["m3"].limit(3)})


def test_agreement_of_all_pairs(spark):
    m = made_up(spark, 200, (3, 4, 2), 6)
    pairs = [("m1", "m2"), ("m1", "m3"), ("m2", "m3"), ("m2", "m2")]
    got = {(r.a, r.b): r.ari for r in linkage.adjusted_rands(m, pairs).collect()}
    rows = m.collect()
    two = lambda n: n * (n - 1) / 2
    for a, b in pairs:
        both = [(r[a], r[b]) for r in rows if r[a] is not None and r[b] is not None]
        count = lambda xs: sum(two(xs.count(x)) for x in set(xs))
        c, pa, pb, t = count(both), count([x for x, _ in both]), count([y for _, y in both]), two(len(both))
        assert got[a, b] == pytest.approx((c - pa * pb / t) / ((pa + pb) / 2 - pa * pb / t), abs=1e-8)
    one = spark.createDataFrame([("a", "b"), ("a", None)], "m1 string, m2 string")
    assert linkage.adjusted_rand(one, "m1", "m2").first().ari == 1.0
    assert linkage.adjusted_rand(one.limit(0), "m1", "m2").first().ari is None
    plan = linkage.adjusted_rands(m, pairs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") <= 2  # the rows, and the list of pairs


def test_samples_do_not_depend_on_partitions(spark):
    m = made_up(spark, 500, (3, 4, 2), 6)
    one = {r.pos for r in labels.bottom_rows(m.repartition(1), ["pos"], 50).collect()}
    assert len(one) == 50 and {r.pos for r in labels.bottom_rows(m.repartition(7), ["pos"], 50).collect()} == one
    assert labels.bottom_rows(m, ["pos"], 900).count() == 500


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")).repartition(9)
    assert [(r.x, r.n) for r in in_order(df, [F.desc("x")], "n").orderBy("n").collect()] == [(999 - k, k) for k in range(1000)]
    assert in_order(df.limit(0), [F.col("x")], "n").collect() == []

"""The cache as a keyed store, and tournaments that are stopped and go on."""

import pytest
from pyspark.sql import functions as F

from concord.operators import judges, tournament
from concord.sources import cache, files
from concord.streaming import tournament as streamed


def rows_of(spark, pairs):
    return spark.createDataFrame([(k, c, c) for k, c in pairs], "key string, gpt_choice string, gpt_output string").select(F.md5("key").alias("cache_key"), "gpt_choice", "gpt_output")


def test_the_last_write_of_a_key_counts(spark, tmp_path):
    path = str(tmp_path / "c")
    cache.append(rows_of(spark, [(f"k{n}", "first") for n in range(40)]), path)
    cache.append(rows_of(spark, [(f"k{n}", "second") for n in range(0, 40, 2)]), path)
    cache.append(rows_of(spark, [("k0", None), ("k1", "first")]), path)
    want = {r.cache_key: r.gpt_choice for r in rows_of(spark, [(f"k{n}", None if n == 0 else "second" if n % 2 == 0 else "first") for n in range(40)]).collect()}
    shown = lambda: {r.cache_key: r.gpt_choice for r in cache.read(spark, path).collect()}
    assert shown() == want and spark.read.parquet(path).count() == 62
    assert cache.compact(spark, path) >= 20 and shown() == want
    assert spark.read.parquet(path).count() == 40 and cache.compact(spark, path) == 0
    assert {r.gpt_choice for r in files.read_cache(spark, path).collect()} == {None, "first", "second"}


def test_a_probe_reads_the_buckets_of_its_keys(spark, tmp_path):
    path = str(tmp_path / "c")
    cache.append(rows_of(spark, [(f"k{n}", "first") for n in range(600)]), path)
    games = rows_of(spark, [("k7", "x"), ("k8", "x"), ("none", "x")]).select("cache_key")
    got = cache.read(spark, path, games)
    assert sorted(r.cache_key for r in got.collect()) == sorted(r.cache_key for r in games.limit(2).collect())
    read = [f for f in got.select("cache_key").inputFiles()]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("PartitionFilters: [isnotnull(bucket), bucket", "PartitionFilters: [bucket") and len(read) > 3
    assert cache.read(spark, path, games.limit(0)).count() == 0


def games_of(spark, n):
    names = spark.createDataFrame([(f"m{k}",) for k in range(n)], "model string")
    return judges.keyed(tournament.schedule(tournament.pairs(names), 2), "simple", "m", 1, "low")


def counting_judge(log):
    """Notes every call in a file of its own; one game always fails."""

    def call(game):
        import uuid

        (log / f"{game['model1']}-{game['model2']}-{game['repetition']}-{uuid.uuid4().hex}").write_text("")
        if game["model1"] == "m0" and game["model2"] == "m1":
            raise OSError("down")
        return "First" if game["repetition"] == 1 else "Second"

    return judges.callable_judge(call, 2, 1, 0.0)


@pytest.mark.parametrize("broken", ["after the batch", "after the replies", "in the verdicts"])
def test_a_stopped_tournament_judges_nothing_twice(spark, tmp_path, monkeypatch, broken):
    log, out = tmp_path / "calls", str(tmp_path / "out")
    log.mkdir()
    games = games_of(spark, 6)
    streamed.put_games(games, str(tmp_path / "games"), 8)
    judge, n = counting_judge(log), games.count()

    def stop(number):
        if number == 1:
            raise RuntimeError("killed")

    with monkeypatch.context() as m:
        if broken == "after the replies":
            real = judges.verdicts
            m.setattr(streamed.judges, "verdicts", lambda rows: stop(1) if len(list((tmp_path / "out/replies").glob("batch=*/_SUCCESS"))) == 2 else real(rows))
        if broken == "in the verdicts":
            real_write = streamed.sinks.write_batch

            def half(rows, path, number):
                real_write(rows.limit(1), path, number)
                stop(number)
                real_write(rows, path, number)

            m.setattr(streamed.sinks, "write_batch", half)
        with pytest.raises(Exception, match="killed"):
            streamed.play_games(spark, str(tmp_path / "games"), out, judge, str(tmp_path / "cache"), stop if broken == "after the batch" else None)
    before = len(list(log.iterdir()))
    assert 0 < before < n
    rows = streamed.play_games(spark, str(tmp_path / "games"), out, judge, str(tmp_path / "cache"))
    assert len(list(log.iterdir())) == n  # every game was judged once
    got = [(r.model1_label, r.model2_label, r.repetition) for r in rows.collect()]
    assert len(got) == n == len(set(got))
    assert rows.where("gpt_choice IS NULL").count() == 2
    kept = cache.read(spark, str(tmp_path / "cache"))
    assert kept.count() == n - 2 == kept.select("cache_key").distinct().count()
    # Started once more, there is nothing to do; with new files only these are judged, or found in the cache.
    assert streamed.play_games(spark, str(tmp_path / "games"), out, judge, str(tmp_path / "cache")).count() == n
    assert len(list(log.iterdir())) == n
    games.where("repetition = 1").write.mode("append").parquet(str(tmp_path / "games"))
    streamed.play_games(spark, str(tmp_path / "games"), out, judge, str(tmp_path / "cache"))
    assert len(list(log.iterdir())) == n + 1  # the one that failed

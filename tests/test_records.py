"""Delimited files in file order, whatever blocks they are cut into; images by name."""

import csv
import io
import random

import pytest

from concord.sources import files
from concord.sources.records import read_records


@pytest.fixture(params=[24, 100, 10**7])
def tiny_blocks(spark, request):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def made_up(seed, rows, end):
    rnd = random.Random(seed)
    field = lambda: rnd.choice(["a", "b c", 'say "x"', "two\nlines", "\n\n", ",", "é" * 9, '"', 'a\n"b",\nc' * rnd.randrange(1, 9), " pad "])
    data = [[str(k), field(), field()] for k in range(rows)]
    out = io.StringIO(newline="")
    w = csv.writer(out, lineterminator=end)
    w.writerow(["id", "A \"b\"", "long\nname"])
    for r in data:
        w.writerow(r)
        if rnd.random() < 0.1:
            out.write(end)
    return data, out.getvalue()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_files_of_any_blocks_keep_their_order(spark, tmp_path, tiny_blocks, end):
    want = []
    for k in range(3):
        rows, content = made_up(k, 40, end)
        (tmp_path / f"part-{k}.csv").write_text(content, newline="")
        want += rows
    got = read_records(spark, str(tmp_path))
    assert got.columns == ["id", 'A "b"', "long\nname", "pos"]
    rows = sorted(got.collect(), key=lambda r: r.pos)
    assert [r.pos for r in rows] == list(range(120)) and [list(r)[:3] for r in rows] == want
    assert got.rdd.getNumPartitions() > 9 or tiny_blocks > 100


def test_short_blocks_and_plain_headers(spark, tmp_path, tiny_blocks):
    (tmp_path / "x.csv").write_text('id,v\n1,"a\nb\nc\nd\ne\nf\ng\nh\ni\nj\nk\nl\nm\nn\no"\n2,plain\n\n3,"q""q"\n4\n5,,6\n')
    rows = [tuple(r) for r in read_records(spark, f"{tmp_path}/x.csv").orderBy("pos").collect()]
    assert rows == [("1", "a\nb\nc\nd\ne\nf\ng\nh\ni\nj\nk\nl\nm\nn\no", 0), ("2", "plain", 1), ("3", 'q"q', 2), ("4", None, 3), ("5", None, 4)]


def test_a_header_must_fit_its_block(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,"' + "a\n" * 40 + '"\n1,2\n')
    assert read_records(spark, f"{tmp_path}/x.csv").collect()[0][0] == "1"
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30")
    try:
        with pytest.raises(ValueError, match="longer than a block"):
            read_records(spark, f"{tmp_path}/x.csv")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x,x\n1,2,3\n")
    assert read_records(spark, f"{tmp_path}/a.csv").columns == ["id", "x", "x.1", "pos"]
    (tmp_path / "b.csv").write_text("id,y\n1,2\n")
    with pytest.raises(ValueError, match="different headers"):
        read_records(spark, str(tmp_path))
    (tmp_path / "none.csv").write_text("")
    with pytest.raises(ValueError, match="no header"):
        read_records(spark, f"{tmp_path}/none.csv")
    (tmp_path / "only.csv").write_text("id,y\n")
    assert read_records(spark, f"{tmp_path}/only.csv").collect() == []


def test_images_are_chosen_before_they_are_read(spark, tmp_path):
    for name in ("he.png", "A [1].jpg", "A [1].png", "B{x}.jpeg", "C*.png", "C d.png", "D.gif"):
        (tmp_path / name).write_bytes(name.encode())
    reference, models = files.read_images(spark, str(tmp_path))
    assert sorted(r.model for r in models.collect()) == ["A [1]", "B{x}", "C d", "C*"] and [r.model for r in reference.collect()] == ["he"]
    plan = models._jdf.queryExecution().executedPlan().toString()
    assert "content" in plan and "Exchange" not in plan and "Join" not in plan
    with pytest.raises(ValueError, match="fewer than two"):
        files.read_images(spark, f"{tmp_path}/D.gif")

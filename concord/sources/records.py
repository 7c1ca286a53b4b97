"""Delimited files in file order, read by as many tasks as they have blocks, though quotes may span lines.

Whether a line starts a record depends on all quotes before it.  A first pass counts, for every block
of a file, its quotes and the records that start in it, whether it begins inside quotes or not.  A
row for each block comes to the driver, which sums them up in file order, so that every block knows how
it begins and the place of its first record.  The second pass cuts records; the few that go on
into other blocks are put together by one small aggregation.  No rows are sorted.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Block:
    """What is known of a block before it is cut; places count all records of all files, headers too."""

    inside: bool  # whether it begins in quotes
    first: int  # the place of its first record
    owner: int  # the place of the record that it begins in
    header: int  # the place of its file's header
    headers: int  # how many headers there are up to its own file's


def _lines(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[str]]]:
    """Stretches of lines of one block, in order."""
    for b in batches:
        if not b.num_rows:
            continue
        starts, paths = b.column(2).to_numpy(), b.column(1).to_pylist()
        cuts = [0, *(k for k in range(1, b.num_rows) if starts[k] != starts[k - 1] or paths[k] != paths[k - 1]), b.num_rows]
        lines = b.column(0).to_pylist()
        for s, e in zip(cuts[:-1], cuts[1:]):
            yield paths[s], int(starts[s]), lines[s:e]


def _quoted(lines: list[str], inside: bool) -> tuple[list[bool], list[bool], bool]:
    """Which lines begin in quotes, which begin a record (blank ones do not), and whether what follows begins in quotes."""
    within, starts = [], []
    for line in lines:
        within.append(inside)
        starts.append(not inside and line not in ("", "\r"))
        inside ^= line.count('"') % 2 == 1
    return within, starts, inside


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``path, start, outside, inside, turned, head``: of a stretch of lines, the records that start in it if it begins outside or inside of quotes, and the first record of a file."""
    for path, start, lines in _by_block(batches):
        within, starts, turned = _quoted(lines, False)
        head = None
        if start == 0 and any(starts):
            first = starts.index(True)
            more = next((k for k in range(first + 1, len(lines)) if not within[k]), len(lines))
            head = "\n".join(lines[first:more])
        values = [path], [start], [sum(starts)], [sum(_quoted(lines, True)[1])], [turned], [head]
        yield pa.record_batch([pa.array(v, t) for v, t in zip(values, _KINDS)], names=["path", "start", "outside", "inside", "turned", "head"])


_KINDS = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())


def _planned(rows: list) -> tuple[dict[tuple[str, int], Block], list[str]]:
    """The blocks of all files in order of their names, from their counted stretches in the order they were read, and the files' headers."""
    stretches: dict[tuple[str, int], list] = {}
    for r in rows:
        stretches.setdefault((r.path, r.start), []).append(r)
    out: dict[tuple[str, int], Block] = {}
    heads, path, place = [], None, 0
    for key in sorted(stretches):
        if key[0] != path:
            path, inside, owner, header, found = key[0], False, -1, place, 0
        block = out[key] = Block(inside, place, owner, header, 0)
        for r in stretches[key]:
            if r.head is not None and not found:
                if r.turned and r.outside == 1:
                    raise ValueError(f"{path}: the header is longer than a block")
                heads.append(r.head)
            seen = r.inside if inside else r.outside
            found, place = found + seen, place + seen
            inside ^= r.turned
        owner = place - 1 if found else -1
        block.headers = len(heads)
    return out, heads


def _cut(shared):
    """Records as ``pos, part, text, whole``; one that goes on in other blocks has several parts, the first of them -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = shared.value
        block, now, held, inside, place, count = None, None, [], False, None, 0
        rows: list[tuple] = []

        def flush(last: bool) -> None:
            # A block's last record may go on in the next; what it begins with may belong to one before.
            at = block.owner if place is None else place
            if held and at != block.header:
                rows.append((at - block.headers, now[1] if place is None else -1, "\n".join(held), place is not None and not (last and inside)))

        for path, start, lines in _by_block(batches):
            if (path, start) != now:
                if block:
                    flush(True)
                now, block = (path, start), blocks[path, start]
                held, inside, place, count = [], block.inside, None, block.first
            within, starts, inside_after = _quoted(lines, inside)
            for line, goes_on, begins in zip(lines, within, starts):
                if begins:
                    flush(False)
                    held, place, count = [line], count, count + 1
                elif goes_on:
                    held.append(line)
            inside = inside_after
            if rows:
                yield _batch(rows)
                rows.clear()
        if block:
            flush(True)
        if rows:
            yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["pos", "part", "text", "whole"])


def _names(heads: list[str], path: str) -> list[str]:
    """Column names of the files, which must agree; the second of equal names is called ``name.1``, and so on."""
    if not heads:
        raise ValueError(f"{path}: no header")
    found = [next(csv.reader(io.StringIO(h.removesuffix("\r"), newline=""))) for h in heads]
    if any(f != found[0] for f in found):
        raise ValueError(f"{path}: its files have different headers")
    return [f"{n}.{found[0][:k].count(n)}" if n in found[0][:k] else n for k, n in enumerate(found[0])]


def read_records(spark: SparkSession, path: str, pos: str = "pos") -> DataFrame:
    """The columns of delimited files with a header each, as strings, and their place in file order from 0.

    Quotes inside quoted fields are doubled; fields that a record lacks are null and blank lines are
    no records.  Files come in the order of their names.
    """
    lines = _lines(spark, path)
    counted = lines.mapInArrow(_counted, "path string, start long, outside long, inside long, turned boolean, head string").collect()  # a row a block, or some
    blocks, heads = _planned(counted)
    names = _names(heads, path)
    cut = lines.mapInArrow(_cut(spark.sparkContext.broadcast(blocks)), "pos long, part long, text string, whole boolean")
    rows = cut
    if any(b.inside for b in blocks.values()):
        parts = F.array_sort(F.collect_list(F.struct("part", "text")))
        broken = cut.where("NOT whole").groupBy("pos").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))
        rows = cut.where("whole").select("pos", "text").unionByName(broken)
    schema = ", ".join(f"_{k} string" for k in range(len(names)))
    fields = F.from_csv(F.regexp_replace("text", r"\r\z", ""), schema, {"quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    parsed = rows.select("pos", fields.alias("f"))
    return parsed.select(*[F.col(f"f._{k}").alias(n) for k, n in enumerate(names)], F.col("pos").alias(pos))

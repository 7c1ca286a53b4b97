"""Substring dedup with a count-min prefilter.

A window is 13 consecutive words of one document.  A word goes if a window over it also starts in a
document with a smaller id.

First pass: every task hashes its windows, once per document, into two rows of cells and emits the
sorted cells as byte-sized gaps.  The tasks' sketches are merged by ranges of cells into counters
that stop at 2, and two bitmaps say which cells counted 2 or more.  Merged counts are never too low,
so a window with a cell below 2 in either row occurs in one document only.  Second pass: windows
whose cells are both marked, and no others, are grouped exactly, by a 128-bit digest of their words.
Wrongly marked windows cost a row each and change nothing; none that repeats is lost.  (Within one
document, places are told apart by the 64-bit hash alone.)

The bitmaps are what every task is sent.  They have four to eight cells per window, a power of two,
and at most ``2 ** log_cells`` cells a row (2 x 64 MB by default).  A table of more than half a window
per cell is cut by ranges of the hashes, each with bitmaps of its own and its own two passes over
the texts, up to ``passes`` ranges.  Beyond that the filter lets more windows through and the exact
grouping has more to do, with the same result.

The windows that pass are written once to the shared folder; both the grouping and the join that
takes each window's first document back to its occurrences read them there, so the texts are not
hashed again, the grouping combines before its shuffle, and the join is one that AQE can split where
a window is very frequent.

Whole copies would send every window of theirs to the exact pass.  The digests and first ids of the
``HEAVY`` groups of equal word sequences with most members are sent along (a bounded table); a later member
of these has all its windows in the first, so it needs neither counting nor grouping.  Other copies
go through both passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b, md5, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import SPACE, Table, byte_texts, sized, small_batches, text_of

WINDOW = 13
MIN_LOG_CELLS, MAX_LOG_CELLS, PASSES, SHARDS, HEAVY = 16, 29, 4, 64, 65_536
_BLOCK = 65_536
_CHUNK = 4_000_000
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _UNBASE)):
            _powers[k] = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(n, 1 << 16), b, np.uint64)]))
    return _powers


def window_hashes(words: list[bytes], size: int = WINDOW) -> np.ndarray:
    """A 64-bit rolling hash of each run of ``size`` words, joined by blanks."""
    n = len(words) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    up, down = _grown(len(raw))
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * down[: len(raw)], out=prefix[1:])
    ends = np.flatnonzero(raw == 32)
    starts = np.concatenate([[0], ends[: n - 1] + 1])
    h = (prefix[ends[size - 1 :]] - prefix[starts]) * up[starts]
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (32, 0xD6E8FEB86659FD93)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return h ^ (h >> np.uint64(32))


def _blocks(words: list[bytes], size: int) -> Iterator[tuple[int, list[bytes]]]:
    """Stretches of a long text that overlap by a window less one word."""
    for k in range(0, max(1, len(words) - size + 1), _BLOCK):
        yield k, words[k : k + _BLOCK + size - 1]


def _all_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Hashes of every window of a text of any length."""
    return np.concatenate([window_hashes(part, size) for _, part in _blocks(words, size)])


def _in_range(hashes: np.ndarray, part: tuple[int, int]) -> np.ndarray:
    """Which hashes belong to the ``k``-th of ``n`` ranges, ``part`` being ``(k, n)``."""
    k, n = part
    return (hashes % np.uint64(n)) == np.uint64(k) if n > 1 else np.ones(len(hashes), bool)


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    """Cell of each hash in one of the two rows."""
    return (hashes * np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[row])) >> np.uint64(64 - bits)


def pack_gaps(cells: np.ndarray) -> bytes:
    """Sorted cells as gaps of one byte; each 255 stands for 255 cells without an entry."""
    gaps = np.diff(cells.astype(np.int64), prepend=0)
    long = gaps // 255
    ends = np.cumsum(long + 1) - 1
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 255, np.uint8)
    out[ends] = gaps % 255
    return out.tobytes()


def unpack_gaps(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(packed, np.uint8)
    return np.cumsum(raw, dtype=np.int64)[raw != 255]


def _sketches(rows: DataFrame, size: int, bits: int, part: tuple[int, int], copies) -> DataFrame:
    """``(r, shard, gaps)``: cells of each task's windows, sorted, each at most twice."""
    shard_bits = bits - (SHARDS - 1).bit_length()

    def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
        hashes, rs, shards, gaps = np.concatenate(parts), [], [], []
        for r in (0, 1):
            cells = np.sort(_cells(hashes, r, bits))
            thrice = np.zeros(len(cells), bool)
            thrice[2:] = cells[2:] == cells[:-2]
            cells = cells[~thrice]
            cuts = np.searchsorted(cells, np.arange(SHARDS + 1, dtype=np.uint64) << np.uint64(shard_bits))
            for s in range(SHARDS):
                if cuts[s] < cuts[s + 1]:
                    rs.append(r)
                    shards.append(s)
                    gaps.append(pack_gaps(cells[cuts[s] : cuts[s + 1]] - (np.uint64(s) << np.uint64(shard_bits))))
        return pa.record_batch([pa.array(rs, pa.int32()), pa.array(shards, pa.int32()), pa.array(gaps, pa.binary())], names=["r", "shard", "gaps"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in sized(batches):
            for key, text in zip(b.column(0).to_pylist(), byte_texts(b, "t")):
                words = text.split()
                if _is_copy(copies.value, key, words):
                    continue
                hashes = np.unique(_all_hashes(words, size))
                hashes = hashes[_in_range(hashes, part)]
                parts.append(hashes)
                held += len(hashes)
                if held >= _CHUNK:
                    yield flush(parts)
                    parts, held = [], 0
        if held:
            yield flush(parts)

    return rows.select("id", "t").mapInArrow(run, "r int, shard int, gaps binary")


def _marked(sketches: DataFrame, bits: int) -> list[np.ndarray]:
    """The two bitmaps of cells that counted 2 or more; of bounded size, so the driver may hold them."""
    width = 1 << (bits - (SHARDS - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, counts = None, np.zeros(width, np.uint8)

        def out():
            return pa.record_batch([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([np.packbits(counts >= 2, bitorder="little").tobytes()])], names=["r", "shard", "marks"])

        for b in sized(batches, 16):
            for r, shard, gaps in zip(*(b.column(k).to_pylist() for k in range(3))):
                if (r, shard) != key:
                    if key:
                        yield out()
                    key, counts = (r, shard), np.zeros(width, np.uint8)
                cells = unpack_gaps(gaps)
                twice = cells[1:][cells[1:] == cells[:-1]]
                counts[cells] += 1
                counts[twice] += 1
                np.minimum(counts, 2, out=counts)
        if key:
            yield out()

    merged = sketches.repartition("r", "shard").sortWithinPartitions("r", "shard").mapInArrow(run, "r int, shard int, marks binary")
    table = Table(merged, "marks")
    maps = [np.zeros(SHARDS * width // 8, np.uint8) for _ in (0, 1)]
    for r, shard, marks in table.df.toLocalIterator():
        maps[r][shard * width // 8 : (shard + 1) * width // 8] = np.frombuffer(marks, np.uint8)
    table.drop()
    return maps


def _copies(rows: DataFrame, heavy: int) -> dict[bytes, int]:
    """First id of each of the largest groups of equal word sequences, by MD5; at most ``heavy`` entries."""
    words = F.trim(F.regexp_replace("t", SPACE, " "))
    groups = rows.groupBy(F.unhex(F.md5(words)).alias("digest")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    top = groups.where("n > 1 AND first IS NOT NULL").orderBy(F.desc("n"), "digest").limit(heavy)
    return {bytes(r.digest): r.first for r in top.select("digest", "first").collect()}


def _is_copy(copies: dict[bytes, int], key: int | None, words: list[bytes]) -> bool:
    """Whether a document of a smaller id is known to have the same words."""
    first = copies.get(md5(b" ".join(words)).digest()) if copies else None
    return first is not None and (key is None or key > first)


def _suspects(rows: DataFrame, size: int, bits: int, part: tuple[int, int], maps, copies) -> DataFrame:
    """``(k1, k2, id, at)``: digest, document and first place of every window with two marked cells.

    ``at`` packs 32 bits of the text's hash over the window's first word, so that rows which share
    an id but not a text stay apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = maps.value
        for b in sized(batches, 64):
            of, keys, at = [], [], []
            ids = b.column(0).to_pylist()
            tags = b.column(2).to_numpy(zero_copy_only=False)
            for k, text in enumerate(byte_texts(b, "t")):
                words = text.split()
                if _is_copy(copies.value, ids[k], words):
                    continue
                hashes, places = np.unique(_all_hashes(words, size), return_index=True)
                hit = _in_range(hashes, part)
                for r in (0, 1):
                    cells = _cells(hashes, r, bits)
                    hit &= (marks[r][cells >> np.uint64(3)] >> (cells & np.uint64(7)).astype(np.uint8)) & 1 == 1
                found = np.sort(places[hit])
                of.extend([k] * len(found))
                at.append((int(tags[k]) << 32) + found)
                keys += [blake2b(b" ".join(words[i : i + size]), digest_size=16).digest() for i in found]
            both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            place = np.concatenate(at).astype(np.int64) if at else np.empty(0, np.int64)
            docs = b.column(0).take(pa.array(of, pa.int64()))
            yield pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1]), docs, pa.array(place)], names=["k1", "k2", "id", "at"])

    return rows.select("id", "t", "tag").mapInArrow(run, "k1 long, k2 long, id long, at long")


def _cutter(size: int, copies):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sized(batches, 64):
            n, removed, digests, kept = [], [], [], []
            ids, starts = b.column(0).to_pylist(), b.column(2)
            for k, text in enumerate(byte_texts(b, "t")):
                words = text.split()
                keep = np.ones(len(words) + 1, np.int64)
                found = starts[k].values
                if len(words) >= size and _is_copy(copies.value, ids[k], words):
                    keep[:] = 0
                elif found is not None and len(found):
                    # One place stands for all of the document where the same window starts.
                    hashes = _all_hashes(words, size)
                    s = np.flatnonzero(np.isin(hashes, hashes[found.to_numpy()]))
                    edge = np.zeros(len(words) + size + 1, np.int64)
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + size, -1)
                    keep = np.cumsum(edge) == 0
                rest = [w for w, good in zip(words, keep) if good]
                text = b" ".join(rest)
                n.append(len(words))
                removed.append(len(words) - len(rest))
                digests.append(sha256(text).hexdigest())
                kept.append(text.decode("utf-8", "replace"))
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, heavy: int = HEAVY, log_cells: int = MAX_LOG_CELLS, passes: int = PASSES
) -> DataFrame:
    """``id, n_words, n_removed, kept_sha256, kept`` for every row of ``docs``.

    Words are cut at ASCII white space and kept ones are joined by one blank.  Windows are judged
    on the input.  A null or empty text has no words; a null id counts as larger than any other;
    rows that share an id are not compared with each other; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    t = text_of(docs, text_col)
    rows = docs.select(docs[id_col].cast("long").alias("id"), t.alias("t")).withColumn("tag", F.xxhash64("t").bitwiseAND(F.lit(0x7FFFFFFF)))
    windows = int(rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // 6
    ranges = min(passes, max(1, -(-windows >> (log_cells - 1))))
    bits = min(log_cells, max(MIN_LOG_CELLS, (windows // ranges).bit_length() + 2))
    context = docs.sparkSession.sparkContext
    copies = context.broadcast(_copies(rows, heavy))
    tables = []
    for part in ((k, ranges) for k in range(ranges)):
        maps = context.broadcast(_marked(_sketches(rows, size, bits, part, copies), bits))
        tables.append(Table(_suspects(rows, size, bits, part, maps, copies), "suspects"))
        maps.destroy()
    seen = reduce(DataFrame.union, [x.df for x in tables])
    last = F.coalesce("id", F.lit((1 << 63) - 1))
    # Least and greatest, not a count of rows: a window may come twice in one document.
    first = seen.groupBy("k1", "k2").agg(F.min(last).alias("first"), F.max(last).alias("last")).where("first < last").select("k1", "k2", "first")
    first = Table(first, "first")
    later = seen.join(first.df, ["k1", "k2"]).where(last > F.col("first"))
    by_doc = later.groupBy("id", F.shiftright("at", 32).alias("tag2")).agg(F.collect_list(F.col("at").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("starts"))
    by_doc = Table(by_doc.select(F.col("id").alias("id2"), "tag2", "starts"), "starts").df.hint("shuffle_hash")
    for x in (*tables, first):
        x.drop()
    joined = rows.join(by_doc, rows["id"].eqNullSafe(by_doc["id2"]) & (rows["tag"] == by_doc["tag2"]), "left")
    return joined.select("id", "t", "starts").mapInArrow(_cutter(size, copies), "id long, n_words long, n_removed long, kept_sha256 string, kept string")

"""SimHash near-duplicates: fingerprints, a byte-position inverted index with count filtering, components.

Two fingerprints share a positional byte if they have the same byte at the same position.  Lists of
one positional byte hold a 256th of all fingerprints each, so tallying over them costs the square of
the table; a posting is therefore keyed by several positional bytes at once.

**Within a few bits** (``links``, ``near_duplicates``).  Fingerprints of eight bytes that differ in at
most ``MAX_BITS`` = 2 bits differ in at most two bytes, so they share at least six.  Postings are keyed
by the four positional bytes of each of the 14 blocks of the Steiner system S(3,4,8): any two positions
leave exactly three blocks untouched, any three leave one, four at most one.  A pair hence meets in
three lists or more if, and only if, it shares six bytes or more.  The lists in which each pair meets
are tallied, pairs below three go, and what is left is verified by its Hamming distance.

Lists longer than ``long_list`` would give the square of their length in pairs.  Their members, each
once, go into lists of six positional bytes instead, of which any pair that shares six bytes has one
in common.  Lists of these that are still too long hold fingerprints that differ in two bytes only.
They are verified without pairs: each member names the 17 values within one bit of it in those bytes,
two members within 2 bits have such a value in common, and any two that have one are within 2 bits.

**By likeness** (``alike``, ``representatives``).  Documents are near copies if their sets of five-word
shingles have a Jaccard likeness of 0.8 or more.  Such sets differ in about 15 of 100 fingerprint
bits, far beyond what eight bytes can index, so the fingerprint is longer: 192 bytes.  Postings are keyed
by three positional bytes, 64 lists a document for each of ``CLASSES`` ways to cut the 192 into threes.
A pair that meets is kept if it shares ``MIN_SHARED`` = 24 positional bytes or more, which is guaranteed up
to 168 differing bits and is under half of what a likeness of 0.8 leads to expect (51); unrelated texts share
one.  The sets themselves are then compared.  A pair of likeness 0.8 can fail to meet in any list;
the README gives the measured share.

Three bytes are also shared by chance and by texts that are half alike, more often the more texts there
are.  A posting therefore carries 64 bits of its fingerprint, and two members of a list count as met
only if ``LEAST_BITS`` = 40 of these agree or more; a likeness of 0.8 leads to expect 54.  Lists are sorted and
compared where they lie, so only those who meet become rows.

A group of many near copies would give the square of its size in pairs.  Some first lists of each
document link what is most alike.  From then on only members of different components count as met.
Each list has hubs, and each member is compared with those ``EACH`` of its lists' hubs that it meets most
often: first with any member of the first lists, then, in all of them, with those closest to the
middle.  Where members of a list of up to ``SHORT`` are still not connected, all their pairs are compared.
Those of longer ones are compared if they share one of their rarest shingles, by the prefix filter
for sets, which finds every pair alike enough and leaves what all copies share unread; so it stands
for their short lists too.  So every link counts that joins two components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.blocks import whole_runs
from concord.llm.common import Table, byte_texts, sized, small_batches, text_of
from concord.llm.components import components, least_ids

SHINGLE, SEED, MAX_BITS = 3, 42, 2
#: Blocks of four of the eight positions: those whose numbers have an exclusive or of 0.
BLOCKS = [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]
MIN_LISTS = 3
SIXES = list(combinations(range(8), 6))

WIDE_SHINGLE, LIKENESS, WIDE, CLASSES, MIN_SHARED, EACH, SHORT = 5, 0.8, 192, 3, 24, 8, 16
#: Of a posting's 64 bits, how many agree in a pair; how many lists come first; of how many others each member of a longer list is compared with.
LEAST_BITS, FIRST_LISTS, FEW = 40, 16, 32
_EPS = 1e-9
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, WIDE // 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Which bits are set in each byte value, least significant first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _grams(text: bytes, shingle: int) -> list[bytes]:
    """Shingles of a lower-cased text, repeats included; of fewer words the whole sequence, of none nothing."""
    words = text.lower().split()
    if len(words) < shingle:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of one UTF-8 text, as an unsigned integer; 0 if it has no word."""
    grams = _grams(text, shingle)
    n, digest = len(grams), xxhash.xxh64_intdigest
    if not n:
        return 0
    rows = np.fromiter((digest(g, seed) for g in grams), dtype="<u8", count=n).view(np.uint8).reshape(n, 8)
    ones = np.concatenate([np.bincount(rows[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(id, tag, fp)`` of every row: a hash of the text and the fingerprint's 64 bits, as signed integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sized(batches):
            fps = np.array([fingerprint(t, shingle) for t in byte_texts(b, "t")], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(fps)], names=["id", "tag", "fp"])

    rows = docs.select(docs[id_col].cast("long").alias("id"), text_of(docs, text_col).alias("t"))
    return rows.select("id", F.xxhash64("t").alias("tag"), "t").mapInArrow(run, "id long, tag long, fp long")


def _bytes_at(positions: tuple[int, ...]) -> Column:
    """The bytes of ``fp`` at these positions, side by side in one integer."""
    parts = [F.shiftleft(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)), 8 * k) for k, p in enumerate(positions)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def _postings(prints: DataFrame, keys: list[tuple[int, ...]]) -> DataFrame:
    """``(list, fp)``: every fingerprint in one list for each tuple of positions; the list's number is above its bytes."""
    lists = [F.lit(n << 8 * len(key)).cast("long").bitwiseOR(_bytes_at(key)) for n, key in enumerate(keys)]
    return prints.select(F.explode(F.array(*lists)).alias("list"), "fp")


def _split(posts: DataFrame, longest: int) -> tuple[DataFrame, DataFrame]:
    """Postings of the lists with at most ``longest`` members, and those of the others."""
    over = posts.groupBy("list").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > longest).select("list")
    over = Table(over, "lists").df
    return posts.join(over, "list", "left_anti"), posts.join(over, "list", "left_semi")


def _pairs(posts: DataFrame) -> DataFrame:
    """``(u, v)``, once for each list in which both are."""
    return posts.withColumnRenamed("fp", "u").join(posts.withColumnRenamed("fp", "v"), "list").where("u > v").select("u", "v")


def links(distinct: DataFrame, long_list: int = 256) -> DataFrame:
    """``(u, v)`` edges that connect exactly the fingerprints within ``MAX_BITS`` of each other.

    ``distinct(fp)`` holds each fingerprint once.  Members of very long lists are tied to a star per
    value between them, all others to each fingerprint within the distance.
    """
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS
    few, many = _split(_postings(distinct, BLOCKS), long_list)
    tallied = _pairs(few).groupBy("u", "v").agg(F.count(F.lit(1)).alias("lists")).where(F.col("lists") >= MIN_LISTS).select("u", "v").where(near)
    members = Table(many.select("fp").distinct(), "members").df
    few, many = _split(_postings(members, SIXES), long_list)
    six = _pairs(few).where(near).distinct()
    free = [[8 * p + b for p in range(8) if p not in key for b in range(8)] for key in SIXES]
    flips = F.array(*[F.array(*[F.lit(x).cast("long") for x in (0, *(1 << b if b < 63 else -(1 << 63) for b in bits))]) for bits in free])
    own = F.get(flips, F.shiftrightunsigned("list", 48).cast("int"))
    between = many.select("list", "fp", F.explode(F.transform(own, lambda m: F.col("fp").bitwiseXOR(m))).alias("mid"))
    hubs = between.groupBy("list", "mid").agg(F.min("fp").alias("v"), F.max("fp").alias("top")).where("v < top").select("list", "mid", "v")
    stars = between.join(hubs, ["list", "mid"]).where("fp > v").select(F.col("fp").alias("u"), "v").distinct()
    return tallied.union(six).union(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_list: int = 256) -> DataFrame:
    """One row per input row: ``id, tag, fp`` and ``component_id``, the least id reachable by links.

    Texts are lower-cased (A-Z), cut into words at ASCII white space and shingled by three words;
    texts without a word have fingerprint 0 and link like any other.  Rows with equal fingerprints
    are one node.  A null id is kept and gets its component's least id (null if the component has
    none); null texts count as empty; other columns are ignored; repeated rows repeat.
    """
    small_batches(docs.sparkSession)
    prints = Table(with_fingerprint(docs, id_col, text_col), "prints")
    nodes = Table(prints.df.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    found = components(links(nodes.df.select("fp"), long_list))
    by_print = Table(least_ids(nodes.df.select(F.col("fp").alias("key"), "first"), found), "roots")
    nodes.drop()
    # The side with one row per fingerprint is small beside the documents but grows with them: no broadcast hint.
    return prints.df.join(by_print.df.withColumnRenamed("key", "fp"), "fp").select("id", "tag", "fp", "component_id")


def shingles(text: bytes, shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """Sorted hashes of a text's different shingles."""
    return np.unique(np.array([xxhash.xxh64_intdigest(g, SEED) for g in _grams(text, shingle)], dtype="<u8"))


def wide_fingerprint(own: np.ndarray, block: int = 2048) -> bytes:
    """SimHash of a set in ``WIDE`` bytes: each member's hash is mixed with one factor for every eight of them."""
    ones = np.zeros(8 * WIDE, np.int64)
    for k in range(0, len(own), block):
        h = own[k : k + block, None] * _FACTORS
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        ones += np.unpackbits(h.view(np.uint8).reshape(len(h), WIDE), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return np.packbits(2 * ones > len(own), bitorder="little").tobytes()


def _threes(classes: int) -> np.ndarray:
    """Positions of each list's three bytes, 64 lists a class; no two lists of a class share a position."""
    j = np.arange(WIDE // 3)
    ways = [np.stack([3 * j, 3 * j + 1, 3 * j + 2], 1)]
    ways += [np.stack([j, (a * j + b) % 64 + 64, (c * j + d) % 64 + 128], 1) for a, b, c, d in ((1, 0, 1, 0), (5, 21, 9, 43), (3, 11, 7, 3))]
    return np.concatenate(ways[:classes])


def _wide_postings(nodes: DataFrame, at: np.ndarray) -> DataFrame:
    """``(list, bits)`` and all columns of ``nodes`` but ``wide``: every node in its lists; the list's number is above its three bytes."""
    above = np.arange(len(at), dtype=np.int64) << 24
    names = [c for c in nodes.columns if c != "wide"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sized(batches):
            own = np.frombuffer(b"".join(byte_texts(b, "wide")), np.uint8).reshape(-1, WIDE)
            rows, bits = own.astype(np.int64), np.ascontiguousarray(own[:, -8:]).view("<i8").ravel()
            lists = rows[:, at[:, 0]] << 16 | rows[:, at[:, 1]] << 8 | rows[:, at[:, 2]] | above
            carried = [np.repeat(b.column(k).to_numpy(zero_copy_only=False), len(at)) for k in range(len(names))]
            yield pa.record_batch([pa.array(x) for x in (lists.ravel(), np.repeat(bits, len(at)), *carried)], names=["list", "bits", *names])

    types = ", ".join(f"{c} {nodes.schema[c].dataType.simpleString()}" for c in names)
    return nodes.select(*names, "wide").mapInArrow(run, f"list bigint, bits bigint, {types}")


def _edges_of(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal numbers start, and how long each is."""
    starts = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]])) if len(runs) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(runs)))


def _mixed(at: np.ndarray, runs: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Those of the places ``at``, in order of ``runs``, in whose run there is more than one root."""
    if not len(at):
        return at
    starts, sizes = _edges_of(runs[at])
    more = np.minimum.reduceat(root[at], starts) < np.maximum.reduceat(root[at], starts)
    return at[np.repeat(more, sizes)]


def _close(bits: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits[a] ^ bits[b]) <= 64 - LEAST_BITS


def _hubs(key: np.ndarray, root: np.ndarray, bits: np.ndarray, runs: np.ndarray, middle: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Members and hubs of other roots that are close to each other.

    A run's hub is its first member or, if ``middle``, the one closest to the majority of each bit.  Those
    that are close to it are done; the others, if there are any, have a hub of their own.
    """
    at = np.arange(len(key))
    while len(at):
        starts, sizes = _edges_of(runs[at])
        if middle:
            each = np.unpackbits(bits[at].view(np.uint8).reshape(-1, 8), axis=1)
            most = np.packbits(2 * np.add.reduceat(each, starts, axis=0, dtype=np.int64) > sizes[:, None], axis=1).view(np.uint64).ravel()
            at = at[np.lexsort((key[at], np.bitwise_count(bits[at] ^ np.repeat(most, sizes)), runs[at]))]
        hub = np.repeat(at[starts], sizes)
        close = _close(bits, at, hub)
        apart = close & (root[at] != root[hub])
        yield at[apart], hub[apart]
        at = _mixed(at[~close], runs, root)


def _all_close(root: np.ndarray, bits: np.ndarray, runs: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of other roots that are close to each other, in runs of up to ``longest``."""
    starts, sizes = _edges_of(runs)
    at = np.flatnonzero(np.repeat(sizes <= longest, sizes))
    for step in range(1, int(sizes[sizes <= longest].max(initial=0))):
        a, b = at[:-step], at[step:]
        same = runs[a] == runs[b]
        a, b = a[same], b[same]
        found = (root[a] != root[b]) & _close(bits, a, b)
        yield a[found], b[found]


def _apart(root: np.ndarray, bits: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Whether each member can be close to one of another root in its run; more than ``FEW`` outside a run's largest root all can."""
    marked = np.zeros(len(runs), bool)
    for a, b in _all_close(root, bits, runs, FEW):
        marked[a] = marked[b] = True
    starts, sizes = _edges_of(runs)
    for start, n in zip(starts[sizes > FEW], sizes[sizes > FEW]):
        own = np.arange(start, start + n)
        roots, counts = np.unique(root[own], return_counts=True)
        rest = own[root[own] != roots[counts.argmax()]]
        if len(rest) > FEW:
            marked[own] = True
            continue
        for k in rest:
            found = own[(root[own] != root[k]) & _close(bits, own, np.full(n, k))]
            marked[found] = True
            marked[k] |= len(found) > 0
    return marked


def _met(nodes: DataFrame, at: np.ndarray, ways: tuple[str, ...], short: int = SHORT) -> DataFrame:
    """``(key, other, long)`` of the members of ``nodes(key, wide, root)`` that meet members of other roots in a list.

    ``first`` and ``middle`` give a row for each member and hub, ``pairs`` for each two members of a list of up
    to ``short``, less pairs of two that ``nodes`` calls ``long``.  ``apart`` gives a row without ``other`` for each
    member that can meet any, with whether that is in a longer list; members that ``nodes`` calls ``seen``
    give one only if that tells more: 1, in a list that is not longer, 2, in a longer one.
    """

    def found(b: pa.RecordBatch, cuts: np.ndarray) -> Iterator[tuple]:
        column = lambda c: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
        runs = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        rows = _mixed(np.arange(len(runs)), runs, column("root"))
        rows = rows[np.lexsort((column("key")[rows], runs[rows]))]
        key, root, bits, runs = column("key")[rows], column("root")[rows], column("bits")[rows].view(np.uint64), runs[rows]
        if not len(rows):
            return
        for way in ways:
            if way == "apart":
                sizes = _edges_of(runs)[1]
                marked, many = _apart(root, bits, runs), np.repeat(sizes > short, sizes)
                if "seen" in b.schema.names:
                    marked &= column("seen")[rows] < np.where(many, 2, 1)
                longer = np.unique(key[marked & many])
                for own, is_long in (longer, True), (np.setdiff1d(key[marked], longer), False):
                    yield own, None, np.full(len(own), is_long)
                continue
            for x, y in _all_close(root, bits, runs, short) if way == "pairs" else _hubs(key, root, bits, runs, way == "middle"):
                if way == "pairs":
                    both = column("long")[rows]
                    both = both[x] & both[y]
                    x, y = x[~both], y[~both]
                yield key[x], key[y], np.zeros(len(x), bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, cuts in whole_runs(batches, "list"):
            for key, other, is_long in found(b, cuts):
                if len(key):
                    other = pa.nulls(len(key), pa.int64()) if other is None else pa.array(other)
                    yield pa.record_batch([pa.array(key), other, pa.array(is_long)], names=["key", "other", "long"])

    posts = _wide_postings(nodes, at).repartition("list").sortWithinPartitions("list")
    return posts.mapInArrow(run, "key long, other long, long boolean")


def _in_turns(nodes: DataFrame, at: np.ndarray, ways: tuple[str, ...], short: int = SHORT) -> list[Table]:
    """The rows of ``_met``, of the first lists and then of the others.

    A member of a large group can meet others in many of its lists.  Those that the first lists show give no
    row again in the others, unless it tells more.
    """
    first = Table(_met(nodes, at[:FIRST_LISTS], ways, short), "met")
    seen = first.df.where("other IS NULL").groupBy("key").agg((F.max(F.col("long").cast("int")) + 1).alias("seen"))
    nodes = nodes.join(seen, "key", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    return [first, Table(_met(nodes, at[FIRST_LISTS:], ways, short), "met")]


def _sharing(pairs: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """Those of the pairs ``(u, v)`` whose fingerprints share at least ``least`` positional bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sized(batches, 4096):
            x, y = (np.frombuffer(b"".join(byte_texts(b, c)), np.uint8).reshape(-1, WIDE) for c in ("x", "y"))
            yield pa.record_batch([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array((x == y).sum(1) >= least))

    wide = nodes.select("key", "wide")
    return pairs.join(wide.toDF("u", "x"), "u").join(wide.toDF("v", "y"), "v").select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def _sets(keys: DataFrame, rows: DataFrame, nodes: DataFrame, shingle: int) -> Table:
    """``key, own``: the sorted shingle hashes of the nodes in ``keys(key)``, from one row of each."""
    wanted = nodes.select("key", F.col("tag").alias("tag2"), F.col("first").alias("id2")).join(keys.distinct(), "key", "left_semi")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sized(batches, 64):
            yield pa.record_batch([b.column(0), pa.array([shingles(t, shingle).tobytes() for t in byte_texts(b, "t")], pa.binary())], names=["key", "own"])

    # One row of each node, so that its copies stay where they are.
    own = (F.col("tag") == F.col("tag2")) & F.col("id").eqNullSafe(F.col("id2"))
    texts = rows.join(wanted, own).select("key", "t").dropDuplicates(["key"])
    return Table(texts.mapInArrow(cut, "key long, own binary"), "sets")


def _verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, shingle: int, likeness: float) -> Table:
    """Those of the pairs ``(u, v)`` of nodes that share enough bytes and whose sets are as alike as ``likeness``."""
    near = Table(_sharing(pairs, nodes, MIN_SHARED), "pairs")
    sets = _sets(near.df.select(F.col("u").alias("key")).union(near.df.select("v")), rows, nodes, shingle)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sized(batches):
            alike = []
            for x, y in zip(byte_texts(b, "a"), byte_texts(b, "b")):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = np.intersect1d(x, y, assume_unique=True).size
                alike.append(both >= likeness * (x.size + y.size - both) - _EPS)
            yield pa.record_batch([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(alike, pa.bool_()))

    a, b = sets.df.toDF("u", "a"), sets.df.toDF("v", "b")
    edges = Table(near.df.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(check, "u long, v long"), "edges")
    near.drop()
    sets.drop()
    return edges


def _rarest(members: DataFrame, rows: DataFrame, nodes: DataFrame, shingle: int, likeness: float) -> Table:
    """``(u, v)``: all pairs of ``members(key, root)`` of different roots that can be as alike as ``likeness``, by their rarest shingles.

    Sets of sizes s and t so alike share ``o = likeness / (1 + likeness) * (s + t)`` members or more.  With
    all sets in one order, the first ``s - o + 1`` of one and the first ``t - o + 1`` of the other have one in
    common.  The order is by rarity among these members, so what a large group of copies shares
    comes last and is hardly ever looked up.
    """
    sets = _sets(members.select("key"), rows, nodes, shingle)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sized(batches, 64):
            own = [np.frombuffer(x, "<i8") for x in byte_texts(b, "own")]
            sizes = np.array([len(x) for x in own], np.int64)
            keys, roots = (np.repeat(b.column(k).to_numpy(), sizes) for k in (0, 2))
            yield pa.record_batch([pa.array(keys), pa.array(roots), pa.array(np.concatenate(own)), pa.array(np.repeat(sizes, sizes))], names=["key", "root", "gram", "size"])

    grams = sets.df.join(members, "key").select("key", "own", "root").mapInArrow(spread, "key long, root long, gram long, size long")
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    place = F.row_number().over(Window.partitionBy("key").orderBy("often", "gram"))
    first = grams.join(often, "gram").withColumn("place", place).where((F.col("place") <= F.col("size") * F.lit(1 - likeness) + F.lit(1 + _EPS)) & (F.col("often") > 1))
    posts = Table(first.select("gram", "key", "root", "size", "place"), "posts")
    shared = F.ceil((F.col("size") + F.col("size2")) * F.lit(likeness / (1 + likeness)) - F.lit(_EPS))
    reach = (F.col("place") <= F.col("size") - shared + 1) & (F.col("place2") <= F.col("size2") - shared + 1)
    met = posts.df.join(posts.df.toDF("gram", "key2", "root2", "size2", "place2"), "gram").where((F.col("key") < F.col("key2")) & (F.col("root") != F.col("root2")) & reach)
    pairs = Table(met.select(F.col("key").alias("u"), F.col("key2").alias("v")).distinct(), "pairs")
    sets.drop()
    posts.drop()
    return pairs


def _wide_links(rows: DataFrame, nodes: DataFrame, shingle: int, likeness: float, classes: int, short: int) -> DataFrame:
    """``(u, v)`` edges between nodes that connect those of likeness ``likeness`` or more which meet in a list."""
    at, wide = _threes(classes), nodes.select("key", "wide")

    def rooted(some: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
        found = components(edges)
        return found, some.join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))

    def joined(found: DataFrame, pairs: DataFrame) -> DataFrame:
        met.append(Table(pairs.join(reduce(DataFrame.union, [x.df for x in met]), ["u", "v"], "left_anti"), "pairs"))
        # What is connected already stays so as stars, which takes few rounds to connect again.
        return found.select(F.col("node").alias("u"), F.col("root").alias("v")).union(_verified(met[-1].df, rows, nodes, shingle, likeness).df)

    first = _met(wide.withColumn("root", F.col("key")), at[:FIRST_LISTS], ("first",))
    met = [Table(_most_met(first), "pairs")]
    found, roots = rooted(wide, _verified(met[0].df, rows, nodes, shingle, likeness).df)
    # In which lists is not asked yet, so all count as longer ones.
    tables = _in_turns(roots, at, ("middle", "apart"), 0)
    some = tables[0].df.union(tables[1].df)
    edges = joined(found, _most_met(some.where("other IS NOT NULL")))
    # Only these can meet members of other components still.
    found, roots = rooted(wide.join(some.where("other IS NULL").select("key").distinct(), "key", "left_semi"), edges)
    tables += _in_turns(roots, at, ("apart",), short)
    marks = tables[-2].df.union(tables[-1].df).groupBy("key").agg(F.max("long").alias("long"))
    tables.append(Table(roots.join(marks, "key"), "left"))
    left = tables[-1].df.select("key", "root", "long", "wide")
    near = _met(left, at, ("pairs",), short).select(F.least("key", "other").alias("u"), F.greatest("key", "other").alias("v"))
    tables.append(_rarest(left.where("long").select("key", "root"), rows, nodes, shingle, likeness))
    edges = joined(found, near.union(tables[-1].df).distinct())
    for x in (*met, *tables):
        x.drop()
    return edges


def _most_met(hubs: DataFrame) -> DataFrame:
    """``(u, v)``: every member ``key`` with those ``EACH`` of its lists' hubs ``other`` that it meets most often."""
    turn = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("lists"), "other"))
    few = hubs.groupBy("key", "other").agg(F.count(F.lit(1)).alias("lists")).withColumn("turn", turn).where(F.col("turn") <= EACH)
    return few.select(F.least("key", "other").alias("u"), F.greatest("key", "other").alias("v")).distinct()


def alike(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WIDE_SHINGLE, likeness: float = LIKENESS, classes: int = CLASSES, short: int = SHORT) -> DataFrame:
    """One row per input row: ``id, tag`` and ``component_id``, the least id reachable by links of likeness ``likeness``.

    Words, null and repeated ids, null texts and texts without a word are treated as in
    ``near_duplicates``; a text of fewer words than a shingle is one shingle.  Texts with equal sets
    of shingles are one node, so copies always meet.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("id"), text_of(docs, text_col).alias("t"))
    rows = rows.select("id", F.xxhash64("t").alias("tag"), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sized(batches, 128):
            found = [shingles(t, shingle) for t in byte_texts(b, "t")]
            keys = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in found], dtype=np.uint64).view(np.int64)
            wide = pa.array([wide_fingerprint(x) for x in found], pa.binary())
            yield pa.record_batch([b.column(0), b.column(1), pa.array(keys), wide], names=["id", "tag", "key", "wide"])

    prints = Table(rows.mapInArrow(run, "id long, tag long, key long, wide binary"), "prints")
    # Of each node the row with the least id (null last), by which its text is found again.
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tag"))
    nodes = prints.df.groupBy("key").agg(least.alias("m"), F.min("wide").alias("wide"))
    nodes = Table(nodes.select("key", F.col("m.id").alias("first"), F.col("m.tag").alias("tag"), "wide"), "nodes")
    found = components(_wide_links(rows, nodes.df, shingle, likeness, classes, short))
    by_key = Table(least_ids(nodes.df.select("key", "first"), found), "roots")
    nodes.drop()
    return prints.df.select("id", "tag", "key").join(by_key.df, "key").select("id", "tag", "component_id")


def kept(docs: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component of ``marks(id, tag, component_id)``, that with its least id.

    Of several such rows the one with the least hash of its text stays, once.  In components without
    any id one row of each text stays.  Documents without a word are alike, hence one component.
    """
    names = [f"_{k}" for k in range(len(docs.columns))]
    own = dict(zip(docs.columns, names))
    rows = docs.toDF(*names).withColumns({"id_": F.col(own[id_col]).cast("long"), "tag_": F.xxhash64(F.coalesce(F.col(own[text_col]).cast("string"), F.lit("")))})
    least = marks.where("id = component_id").groupBy("id").agg(F.min("tag").alias("tag"))
    keys = least.union(marks.where("component_id IS NULL").select("id", "tag").distinct())
    chosen = rows.join(keys, F.col("id_").eqNullSafe(F.col("id")) & (F.col("tag_") == F.col("tag")))
    turn = F.row_number().over(Window.partitionBy("id_", "tag_").orderBy("tag_"))
    return chosen.withColumn("turn", turn).where("turn = 1").select(*[F.col(own[c]).alias(c) for c in docs.columns])


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WIDE_SHINGLE, likeness: float = LIKENESS) -> DataFrame:
    """``docs`` without near copies: of each component of ``alike`` only the row that ``kept`` chooses stays."""
    return kept(docs, alike(docs, id_col, text_col, shingle, likeness), id_col, text_col)

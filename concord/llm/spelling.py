"""Spelling variants: words within one edit of each other, by a positional q-gram index with a count filter.

A word of L code points has ``L - Q + 1`` q-grams with their positions.  One edit destroys at most
``Q`` of them and moves none of the others by more than one place, so words within one edit have at
least ``L - 2 * Q + 1`` in common, L being the longer length, at positions that differ by one at most.

The index is dealt out by several grams at once, since lists of one gram hold a good part of all
words.  In the order of their rarity, then of their positions, at least ``SHARED`` of the first ``Q + SHARED``
grams of either word are among those that the edit spares, and the spared ones have the same order
in both.  A word is therefore posted under each ``SHARED`` of its first ``Q + SHARED`` grams with their
positions and its own length (home).  For the words that have one code point more it is posted under the
next length, with the later of the positions moved by one (guest); a code point put in destroys
``Q - 1`` of its grams at most, so the first ``Q - 1 + SHARED`` do.  Words within one edit meet under at
least one key.

Under a key, the members' grams are an inverted index again.  The postings of a word's grams, at the
positions that a spared gram can have, are merged from a heap; what comes up often enough is
verified.  Keys with many members are cut into pairs of bounded blocks.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from heapq import merge
from itertools import combinations, groupby
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.blocks import block_pairs, whole_runs
from concord.llm.common import Table, small_batches, text_of

Q, SHARED, BLOCK = 2, 3, 512
MIN_LENGTH, MIN_COUNT, RATIO, EVERY = 6, 5, 5, 199
#: Fixed value: the letters that make up words.
LETTERS = r"A-Za-zÀ-ÿ"


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: words of ``MIN_LENGTH`` or more code points that occur ``MIN_COUNT`` times or more.

    Runs of letters with A-Z lower-cased lose one code point where ``EVERY`` divides the CRC-32 of
    ``<id>:<run>``; a null id is written as nothing.
    """
    runs = F.regexp_extract_all(text_of(docs, text_col), F.lit(f"[{LETTERS}]{{{MIN_LENGTH},}}"), F.lit(0))
    rows = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("id", F.translate("run", ascii_uppercase, ascii_lowercase).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    words = rows.select(F.when(F.pmod("h", F.lit(EVERY)) == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= MIN_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_COUNT)


@lru_cache(100_000)
def grams(word: str) -> tuple[tuple[int, str], ...]:
    """The q-grams of a word with their positions."""
    return tuple((i, word[i : i + Q]) for i in range(len(word) - Q + 1))


def _ranks(words: DataFrame) -> dict[str, int]:
    """Every gram's place in the order of rarity; there are no more grams than pairs of letters, some 8,000."""
    all_grams = F.transform(F.sequence(F.lit(1), F.length("word") - Q + 1), lambda k: F.col("word").substr(k, F.lit(Q)))
    counted = words.select(F.explode(F.array_distinct(all_grams)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return {r.gram: k for k, r in enumerate(sorted(counted.collect(), key=lambda r: (r.n, r.gram)))}


def keys_of(word: str, ranks: dict[str, int]) -> tuple[list[int], list[int]]:
    """The keys under which a word is posted, as hashes: those of its own length, and those of the next."""
    rarest = sorted((ranks[g], p) for p, g in grams(word))[: Q + SHARED]
    here, there = ({x: struct.pack("<2q", x[1] + d, x[0]) for x in rarest} for d in (0, 1))
    own, longer = struct.pack("<q", len(word)), struct.pack("<q", len(word) + 1)
    by_place = lambda some: sorted(some, key=lambda x: x[1])
    key, home, guest = xxhash.xxh64_intdigest, [], []
    for some in combinations(by_place(rarest), SHARED):
        home.append(key(own + b"".join([here[x] for x in some])) - (1 << 63))
    for some in combinations(by_place(rarest[: Q - 1 + SHARED]), SHARED):
        still, moved = [here[x] for x in some], [there[x] for x in some]
        guest += [key(longer + b"".join(still[:k] + moved[k:])) - (1 << 63) for k in range(SHARED + 1)]
    return home, guest


def _postings(words: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """``key, home, word``."""
    shared = words.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                own, keys, at, homes = batch.column(0).slice(start, 4096), [], [], []
                for k, word in enumerate(own.to_pylist()):
                    home, guest = keys_of(word, shared.value)
                    keys += home + guest
                    at += [k] * (len(home) + len(guest))
                    homes += [True] * len(home) + [False] * len(guest)
                yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(homes, pa.bool_()), own.take(pa.array(at, pa.int64()))], names=["key", "home", "word"])

    return words.select("word").mapInArrow(run, "key long, home boolean, word string")


def one_edit(a: str, b: str) -> bool:
    """Whether words differ by exactly one code point put in, left out or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def near_members(words: list[str], homes: list[bool], owns: list[int], across: bool) -> Iterator[tuple[str, str]]:
    """Pairs of words within one edit, one of them at home; ``across`` pairs only different blocks."""
    length = max((len(w) for w, home in zip(words, homes) if home), default=0)
    index: dict[tuple[int, str], list[int]] = defaultdict(list)
    least = length - 2 * Q + 1

    def often_met(lists: list[list[int]]) -> Iterator[int]:
        # A word is in each list once at most, so fewer lists than matches needed give none.
        if len(lists) >= least:
            for other, hits in groupby(merge(*lists)):
                if sum(1 for _ in hits) >= least:
                    yield other

    # Words at home look up those before them, guests all of them.
    for k in sorted(range(len(words)), key=lambda k: not homes[k]):
        own, word = grams(words[k]), words[k]
        if homes[k] and len(word) == length:
            found = often_met([index[x] for x in own if x in index])
        elif not homes[k] and len(word) == length - 1:
            found = often_met([index[x] for p, g in own for x in ((p, g), (p + 1, g)) if x in index])
        else:
            continue
        for other in found:
            if not (across and owns[k] == owns[other]) and one_edit(word, words[other]):
                yield word, words[other]
        if homes[k]:
            for x in own:
                index[x].append(k)


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """``u, v``: each two of the different ``words(word)`` that are within one edit, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, cuts in whole_runs(batches):
            column = lambda name: b.column(b.schema.get_field_index(name))  # noqa: B023, E731
            names, homes, owns = (column(c).to_pylist() for c in ("word", "home", "own"))
            across = (column("lo").to_numpy() != column("hi").to_numpy()).tolist()
            found = {tuple(sorted(x)) for s, e in zip(cuts[:-1], cuts[1:]) if e - s > 1 for x in near_members(names[s:e], homes[s:e], owns[s:e], across[s])}
            if found:
                yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*sorted(found))], names=["u", "v"])

    posts = Table(_postings(words, _ranks(words)), "postings")
    met = block_pairs(posts.df, "key", "word", block, F.max("home"))
    met = met.select("run", "lo", "hi", "own", "home", "word").repartition("run").sortWithinPartitions("run")
    pairs = Table(met.mapInArrow(run, "u string, v string").distinct(), "pairs")
    posts.drop()
    return pairs.df


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for every word of ``forms(word, form)``: the end of the chain of forms, by doubling of steps."""
    now = Table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.df.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = Table(now.df.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        done = after.df.where("moved").isEmpty()
        now.drop()
        now = after
        if done:
            return now.df.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every counted word.

    A word's form is its near word of largest n, of equal ones the first by code points, if it is
    ``RATIO`` times as frequent or more; the root is where the forms lead.  Null and empty texts have
    no words; repeated rows and ids count each; other columns are ignored; without words there is no row.
    """
    small_batches(docs.sparkSession)
    words = Table(counted_words(docs, id_col, text_col), "words")
    pairs = near_words(words.df, block)
    both = pairs.union(pairs.select("v", "u")).toDF("word", "near").join(words.df.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    per = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = words.df.join(per, "word", "left")
    enough = -F.col("best.less") >= RATIO * F.col("n")
    formed = Table(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "forms")
    words.drop()
    roots = _roots(formed.df.where("form IS NOT NULL").select("word", "form"))
    return formed.df.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

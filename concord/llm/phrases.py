"""Phrase collocations from depth-limited count tries.

Each task counts its texts into tries, one for each portion of some ``CHUNK`` words: a node is a
run of words within a piece of text, its path the 63-bit hashes of its words (seeded by the
language, so that languages are different roots).  A trie is written out as rows in the order of its
paths.  The rows are dealt by ranges of the hashed first two words, so that a very frequent first
word is not one range, come together by a merge of sorted runs (Spark's own, which spills), and are
added up in one walk: on the way to a node all its ancestors have been passed, and their counts are
those of its left parts.  Right parts are found by suffix links: a join on the path less its first words.

Tries are as deep as ``DEPTHS`` says, one pass over the texts each.  What is frequent has only frequent
parts, so the second pass enters a node only where all pairs of its words were found frequent by the
first.  The tasks know these by a bitmap of their hashes, of at most ``2 ** MAX_LOG_CELLS`` bits (64 MB):
a pair that is wrongly marked costs rows and changes nothing.

Two words of one hash would be counted together; every word carries 30 bits of another hash, and
two that differ in them stop the job with an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.common import Table, byte_texts, sized, small_batches, text_of

LONGEST, MIN_COUNT, TOP, SCALE = 5, 100, 2000, 1000
DEPTHS = (2, LONGEST)
CHUNK, STRETCH = 4_000_000, 4_000_000
MIN_LOG_CELLS, MAX_LOG_CELLS, SHARDS, SALTS = 16, 29, 64, 64
#: What ends a piece, and what stands between words.
ENDS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b" \t"
_TABLE = bytes.maketrans(ENDS + BLANKS, b"\n" * len(ENDS) + b" " * len(BLANKS))
_ROOT = 2


def _stretches(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text and, as ``\\n``, the ends of its pieces; long texts are cut at blanks."""
    start = 0
    while start < len(text):
        end = start + STRETCH
        if end < len(text):
            part = text[start:end].translate(_TABLE)
            last = max(part.rfind(b" "), part.rfind(b"\n"))
            if last < 0:
                # A word longer than a stretch goes on to its end.
                found = [k for k in (text.find(bytes([c]), end) for c in ENDS + BLANKS) if k >= 0]
                end = min(found, default=len(text))
            else:
                end = start + last + 1
        yield text[start:end].lower().translate(_TABLE).replace(b"\n", b" \n ").split(b" ")
        start = end


class Vocabulary(dict):
    """Numbers of the words of one language; all languages number into one list."""

    def __init__(self, lang: str, words: list):
        super().__init__({b"\n": -1})
        self.lang, self.words = lang, words

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append((self.lang, word))
        return n


def _root_hash(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode()) >> 1


def _hashes(words: list[tuple[str, bytes]]) -> np.ndarray:
    """Odd 63-bit hashes of words, seeded by their language."""
    return np.array([xxhash.xxh64_intdigest(w, _root_hash(lang)) >> 1 | 1 for lang, w in words], np.int64)


def _cell(path: list[np.ndarray], bits: int) -> np.ndarray:
    """The bitmap's cell of each path; hashes are random, so turned ones may be laid over each other."""
    x = np.zeros(len(path[0]), np.uint64)
    for k, h in enumerate(path):
        h, turn = h.view(np.uint64), np.uint64(1 + 17 * k % 63)
        x ^= h << turn | h >> (np.uint64(64) - turn)
    return (x >> np.uint64(64 - bits)).astype(np.int64)


class Shard:
    """The numbered words of a portion of a task's texts, and their trie."""

    def __init__(self, depth: int, base: int, marks: np.ndarray | None):
        self.depth, self.base, self.marks = depth, base, marks
        self.words, self.by_lang, self.ids, self.held = [], {}, [], 0

    def add(self, lang: str, text: bytes) -> Iterator[pa.RecordBatch]:
        if lang not in self.by_lang:
            self.by_lang[lang] = Vocabulary(lang, self.words)
        for words in _stretches(text):
            number = self.by_lang[lang].__getitem__
            self.ids.append(np.fromiter(map(number, filter(None, words)), np.int64))
            self.held += len(self.ids[-1])
            if self.held >= CHUNK:
                yield from self.flush(self.depth - 1)
        self.ids.append(np.array([-1]))

    def flush(self, keep: int = 0) -> Iterator[pa.RecordBatch]:
        """The trie of the runs that start before the last ``keep`` words, which open the next portion."""
        ids = np.concatenate(self.ids) if self.ids else np.empty(0, np.int64)
        upto, words = max(0, len(ids) - keep), self.words
        if len(words):
            yield from self.rows(ids, upto, _hashes(words))
        rest, langs = ids[upto:], list(self.by_lang)
        self.words, self.by_lang, self.held = [], {}, len(rest)
        for lang in langs if keep else ():
            self.by_lang[lang] = Vocabulary(lang, self.words)
        self.ids = [np.array([self.by_lang[words[k][0]][words[k][1]] if k >= 0 else -1 for k in rest.tolist()], np.int64)]

    def rows(self, ids: np.ndarray, upto: int, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(ids >= 0)
        if self.marks is None:
            at = at[at < upto]
            counts = np.bincount(ids[at], minlength=len(hashes))
            other = np.array([xxhash.xxh32_intdigest(w) & 0x3FFFFFFF for _, w in self.words], np.int64)
            langs = sorted(self.by_lang)
            code = {lang: k for k, lang in enumerate(langs)}
            totals = np.bincount(np.array([code[lang] for lang, _ in self.words]), counts, len(langs)).astype(np.int64)
            yield self.batch([hashes], counts, check=other)
            yield self.batch([np.array([_root_hash(x) for x in langs], np.int64), np.full(len(langs), _ROOT)], totals)
            flag = None
        else:
            # Places where a frequent pair (or longer run that the pass before counted) starts.
            flag = np.zeros(len(ids), bool)
            whole = at
            for k in range(1, self.base):
                whole = whole[whole + k < len(ids)]
                whole = whole[ids[whole + k] >= 0]
            bits = 3 + (len(self.marks) - 1).bit_length()
            cells = _cell([hashes[ids[whole + k]] for k in range(self.base)], bits)
            flag[whole] = self.marks[cells >> 3] >> (cells & 7).astype(np.uint8) & 1 == 1
            used = np.unique(np.concatenate([ids[np.flatnonzero(flag) + k] for k in range(self.base)]))
            named = [self.words[k] for k in used.tolist()]
            langs = sorted({lang for lang, _ in named})
            yield self.batch([np.concatenate([hashes[used], np.array([_root_hash(x) for x in langs], np.int64)])], np.zeros(len(used) + len(langs), np.int64), names=named + [(x, None) for x in langs])
            at = np.flatnonzero(flag[:upto])
        code = ids[at]
        for k in range(2, self.depth + 1):
            good = at + k - 1 < len(ids)
            at, code = at[good], code[good]
            good = ids[at + k - 1] >= 0
            if flag is not None and k > self.base:
                good &= flag[at + k - self.base]
            at, code = at[good], code[good]
            if not len(at):
                return
            _, first, code, counts = np.unique(code << 32 | ids[at + k - 1], return_index=True, return_inverse=True, return_counts=True)
            yield self.batch([hashes[ids[at[first] + j]] for j in range(k)], counts)

    def batch(self, path: list[np.ndarray], counts: np.ndarray, check: np.ndarray | None = None, names: list | None = None) -> pa.RecordBatch:
        n = len(counts)
        order = np.lexsort(path[::-1])
        columns = [pa.array(c[order].astype(np.int64)) for c in path] + [pa.array(np.zeros(n, np.int64))] * (self.depth - len(path))
        columns += [pa.array(counts[order].astype(np.int64)), pa.array(np.full(n, -1) if check is None else check[order])]
        said = [names[k] if names else (None, None) for k in order] if names else [(None, None)] * n
        columns += [pa.array([x for x, _ in said], pa.string()), pa.array([w.decode("utf-8", "replace") if w is not None else None for _, w in said], pa.string())]
        return pa.record_batch(columns, names=[*_path(self.depth), "n", "check", "lang", "word"])


def _path(depth: int) -> list[str]:
    return [f"h{k}" for k in range(1, depth + 1)]


def _tries(rows: DataFrame, depth: int, base: int = 0, marks=None) -> DataFrame:
    """Nodes of every shard's trie: ``h1 .. h<depth>`` (0 beyond its depth), ``n, check``; with ``marks`` also names of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(depth, base, None if marks is None else marks.value)
        for b in sized(batches):
            for lang, text in zip(b.column(0).to_pylist(), byte_texts(b, "t")):
                yield from shard.add(lang, text)
        yield from shard.flush()

    columns = ", ".join(f"{c} long" for c in [*_path(depth), "n", "check"])
    return rows.select("lang", "t").mapInArrow(run, f"{columns}, lang string, word string")


def _merged(tries: DataFrame, depth: int, least: int) -> DataFrame:
    """``path, n, lefts`` of the nodes that count ``least`` or more, and of the roots; ``lefts`` are the counts of ancestors of two words or more."""
    names = _path(depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, check = None, 0, -1
        above = np.zeros(depth + 1, np.int64)  # the latest node of each depth
        for b in batches:
            if not b.num_rows:
                continue
            paths = np.stack([b.column(k).to_numpy() for k in range(depth)], 1)
            counts, checks = b.column(depth).to_numpy(), b.column(depth + 1).to_numpy()
            new = np.concatenate([[key is None or bool((paths[0] != key).any())], (paths[1:] != paths[:-1]).any(1)])
            starts = np.flatnonzero(new)
            same = ~new
            if (same[1:] & (checks[1:] != checks[:-1])).any() or same[0] and checks[0] != check:
                raise ValueError("two words have one hash; take another seed")
            if not len(starts):
                n += int(counts.sum())
                continue
            sums = np.add.reduceat(counts, starts)
            if key is not None:
                # The node at the end of the batch before is over now.
                n += int(counts[: starts[0]].sum())
                done, total = np.concatenate([key[None], paths[starts[:-1]]]), np.concatenate([[n], sums[:-1]])
            else:
                done, total = paths[starts[:-1]], sums[:-1]
            key, n, check = paths[-1], int(sums[-1]), int(checks[-1])
            yield walked(done, total, above)
        if key is not None:
            yield walked(key[None], np.array([n]), above)

    def walked(done: np.ndarray, total: np.ndarray, above: np.ndarray) -> pa.RecordBatch:
        deep = (done != 0).sum(1)
        lefts = np.zeros((len(done), depth + 1), np.int64)
        for k in range(2, depth):
            last = np.maximum.accumulate(np.where(deep == k, np.arange(len(done)), -1))
            lefts[:, k] = np.where(last >= 0, total[last], above[k])
            if len(last) and last[-1] >= 0:
                above[k] = total[last[-1]]
        good = (total >= least) | ((deep == 2) & (done[:, 1] == _ROOT if depth > 1 else False))
        done, total, deep, lefts = done[good], total[good], deep[good], lefts[good]
        cut = np.maximum(deep - 2, 0)
        inner = (np.arange(depth + 1) >= 2) & (np.arange(depth + 1) < deep[:, None])
        lists = lambda sizes, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))
        return pa.record_batch([lists(deep, done[done != 0]), pa.array(total.astype(np.int64)), lists(cut, lefts[inner])], names=["path", "n", "lefts"])

    dealt = tries.select(*names, "n", "check").repartition(*names[:2]).sortWithinPartitions(*names)
    return dealt.mapInArrow(run, "path array<long>, n long, lefts array<long>")


def _bitmap(paths: DataFrame, size: int, count: int) -> np.ndarray:
    """Bits of the cells of all paths of ``size`` words; bounded, so the driver may hold it."""
    bits = min(MAX_LOG_CELLS, max(MIN_LOG_CELLS, count.bit_length() + 4))
    width = (1 << bits) // SHARDS

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                path = b.column(0).flatten().to_numpy().reshape(-1, size)
                cell = np.unique(_cell([np.ascontiguousarray(path[:, k]) for k in range(size)], bits))
                yield pa.record_batch([pa.array((cell // width).astype(np.int32)), pa.array(cell % width)], names=["shard", "cell"])

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            shards, cell = b.column(0).to_numpy(), b.column(1).to_numpy()
            for s in np.unique(shards):
                held.setdefault(int(s), np.zeros(width, bool))[cell[shards == s]] = True
        for s, on in held.items():
            yield pa.record_batch([pa.array([s], pa.int32()), pa.array([np.packbits(on, bitorder="little").tobytes()])], names=["shard", "marks"])

    table = Table(paths.select("path").mapInArrow(cells, "shard int, cell long").repartition("shard").mapInArrow(marks, "shard int, marks binary"), "marks")
    out = np.zeros((1 << bits) // 8, np.uint8)
    for s, on in table.df.toLocalIterator():
        out[s * width // 8 : (s + 1) * width // 8] = np.frombuffer(on, np.uint8)
    table.drop()
    return out


def _linked(nodes: DataFrame, words: DataFrame) -> DataFrame:
    """``path, n, lefts, lang, phrase, first, rights``: every phrase's words, the count of its first, and of all its right parts by suffix link."""
    known = nodes.select("path", "n", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("word")).union(words.select(F.array("h"), "n", "lang", "word"))
    known = known.toDF("part", "f", "lang", "word")
    size = F.size("path")
    # Each word, and each suffix of two words or more, by where it starts.
    single = F.transform("path", lambda h, k: F.struct((k + 1).alias("start"), F.array(h).alias("part")))
    suffixes = F.transform(F.when(size > 2, F.sequence(F.lit(2), size - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.struct(k.alias("start"), F.slice("path", k, size - k + 1).alias("part")))
    wanted = nodes.select("path", F.inline(F.concat(single, suffixes)))
    met = wanted.join(known, "part").select("path", F.struct("start", F.size("part").alias("length"), "f", "lang", "word").alias("x"))
    grouped = met.groupBy("path").agg(F.sort_array(F.collect_list("x")).alias("x"))
    ones = F.filter("x", lambda x: x["length"] == 1)
    # Right parts are the suffixes from the second word on; the last word is the shortest of them.
    right = F.transform(F.sequence(F.lit(2), F.size("path")), lambda k: F.get(F.filter("x", lambda x: (x["start"] == k) & (x["length"] == F.size("path") - k + 1)), F.lit(0))["f"])
    return grouped.select(
        "path", F.get(ones, F.lit(0))["lang"].alias("lang"), F.array_join(F.transform(ones, lambda x: x["word"]), " ").alias("phrase"),
        F.get(ones, F.lit(0))["f"].alias("first"), right.alias("rights"),
    ).join(nodes, "path")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's best phrases.

    Null and empty texts have no words, a null language is ``und``; repeated rows count each; other
    columns are ignored.  A phrase's score is that of its worst cut (ties: after fewest words).
    Phrases that are always part of a longer one go.  Languages without a phrase have no row.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), text_of(docs, text_col).alias("t"))
    short = Table(_merged(_tries(rows, DEPTHS[0]), DEPTHS[0], least), "nodes")
    is_root = (F.size("path") == 2) & (F.get("path", F.lit(1)) == _ROOT)
    frequent, tables = short.df.where((F.size("path") == DEPTHS[0]) & ~is_root), [short]
    for base, depth in zip(DEPTHS, DEPTHS[1:]):
        marks = spark.sparkContext.broadcast(_bitmap(frequent, base, frequent.count()))
        tries = Table(_tries(rows, depth, base, marks), "tries")
        nodes = Table(_merged(tries.df.where("lang IS NULL"), depth, least), "nodes")
        marks.destroy()
        frequent = nodes.df.where(F.size("path") == depth)
        tables += [tries, nodes]
    # Words wrongly marked frequent are no phrase's, as counts are exact.
    names = tries.df.where("lang IS NOT NULL").select(F.col("h1").alias("h"), "lang", "word").distinct()
    counts = short.df.where((F.size("path") == 1) | is_root).select(F.get("path", F.lit(0)).alias("h"), "n")
    named = Table(names.join(counts, "h"), "words")
    words, totals = named.df.where("word IS NOT NULL"), named.df.where("word IS NULL").select("lang", F.col("n").alias("total"))
    linked = Table(_linked(nodes.df.where(F.size("path") >= 2), words).join(totals, "lang"), "linked")
    for x in (*tables, named):
        x.drop()
    left = F.concat(F.array("first"), F.col("lefts"))
    cuts = F.zip_with(left, "rights", lambda l, r: F.struct(l.alias("l"), r.alias("r")))  # noqa: E741
    cuts = linked.df.select("path", "lang", "phrase", F.col("n").alias("a"), "total", "first", "lefts", "rights", F.posexplode(cuts).alias("k", "c"))
    exact = "(cast(a AS decimal(38,0)) * {scale} * cast(total AS decimal(38,0))) div (cast(c.l AS decimal(38,0)) * cast(c.r AS decimal(38,0)))"
    score = F.expr(exact.format(scale=SCALE))
    worst = F.min(F.struct(score.alias("score"), "k", "c.l", "c.r"))
    scored = cuts.groupBy("path", "lang", "phrase", "a", "total").agg(worst.alias("w"))
    # What is always followed or preceded by one certain word.
    longer = linked.df.where(F.size("path") > 2)
    before, after = F.try_element_at("lefts", F.lit(-1)) == F.col("n"), F.get("rights", F.lit(0)) == F.col("n")
    inside = longer.where(before).select(F.slice("path", 1, F.size("path") - 1).alias("path")).union(longer.where(after).select(F.slice("path", 2, F.size("path") - 1).alias("path")))
    left_over = scored.join(inside.distinct(), "path", "left_anti").select("lang", "phrase", "a", "w.l", "w.r", F.col("total").alias("n"), "w.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # A language's phrases may be many: the best of each part first.
    salted = left_over.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    part = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations_sql() -> str:
    """The same over ``documents`` in DuckDB's SQL."""
    return rf"""
        WITH piece AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
        ), worded AS (
            SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece
        ), gram AS (
            SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g
            FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded) JOIN (SELECT unnest(range(1, {LONGEST + 1})) AS k) ON i + k - 1 <= len(w)
        ), f AS (
            SELECT lang, k, g, count(*)::HUGEINT AS f FROM gram GROUP BY ALL
        ), total AS (
            SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang
        ), cut AS (
            SELECT lang, g, k, f AS a, w, s FROM (SELECT *, string_split(g, ' ') AS w, unnest(range(1, k)) AS s FROM f WHERE k >= 2 AND f >= {MIN_COUNT})
        ), part AS (
            SELECT c.*, x.f AS l, y.f AS r, n, ({SCALE} * a * n) // (x.f * y.f) AS score
            FROM cut c JOIN total USING (lang)
            JOIN f x ON x.lang = c.lang AND x.k = c.s AND x.g = array_to_string(c.w[1:c.s], ' ')
            JOIN f y ON y.lang = c.lang AND y.k = c.k - c.s AND y.g = array_to_string(c.w[c.s + 1:c.k], ' ')
        ), worst AS (
            SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, s) AS place FROM part
        ), inside AS (
            SELECT lang, array_to_string(w[1:k - 1], ' ') AS g FROM part WHERE s = k - 1 AND l = a AND k > 2
            UNION SELECT lang, array_to_string(w[2:k], ' ') FROM part WHERE s = 1 AND r = a AND k > 2
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank
            FROM worst WHERE place = 1 AND (lang, g) NOT IN (SELECT (lang, g) FROM inside)
        )
        SELECT lang, rank::BIGINT AS rank, g AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= {TOP}
    """

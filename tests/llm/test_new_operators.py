"""Spelling variants, phrases and embeddings against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from concord.llm import embeddings, phrases, queries, spelling
from concord.llm.blocks import block_pairs, whole_runs

SF = "/root/testdata/sf0.001"


def words_by_hand(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def cut_out(word):
    """The word with a mark in place of each code point, and between all."""
    return {word[:k] + "\0" + word[k + d :] for k in range(len(word) + 1) for d in (0, 1) if k + d <= len(word)}


def variants_by_hand(n):
    holes = defaultdict(set)
    for w in n:
        for x in cut_out(w):
            holes[x].add(w)
    near = {w: {v for x in cut_out(w) for v in holes[x] if v != w and (len(v) != len(w) or sum(a != b for a, b in zip(v, w)) == 1) and abs(len(v) - len(w)) <= 1} for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def test_spelling_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = variants_by_hand(words_by_hand(docs))
    got = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in queries.QUERIES["op11_spelling"](spark, SF).collect()]
    assert len(got) == len(want) > 100 and set(got) == want


@pytest.mark.parametrize("block", [3, 512])
def test_dense_words_in_any_blocks(spark, block):
    rnd = random.Random(4)
    base, words = [], set()
    for _ in range(40):
        base.append("".join(rnd.choice("aabé") for _ in range(rnd.randrange(6, 11))))
    for w in base * 12:
        k = rnd.randrange(len(w))
        words |= {w, w[:k] + w[k + 1 :], w[:k] + rnd.choice("abé") + w[k:], w[:k] + rnd.choice("abé") + w[k + 1 :]}
    words = sorted(w for w in words if len(w) >= 6) + ["a" * 3000, "a" * 3001, "a" * 1500 + "b" + "a" * 1500]
    texts = [" ".join([w] * rnd.choice([5, 6, 30, 200])) for w in words] + [None, "", "!!"]
    docs = spark.createDataFrame([(k if k % 7 else None, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, word string")
    want = variants_by_hand(words_by_hand([(k if k % 7 else None, t) for k, t in enumerate(texts)]))
    got = spelling.variants(docs, block=block).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert sum(r.n_near for r in got) > 2 * len(got)


def test_chains_of_forms_lead_to_the_last(spark):
    chain = ["abcdef", "abcdefg", "abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijk"]
    forms = spark.createDataFrame(list(zip(chain, chain[1:])) + [("zzzzzz", "zzzzzy")], "word string, form string")
    got = {r.word: r.root for r in spelling._roots(forms).collect()}
    assert got == {**dict.fromkeys(chain[:-1], chain[-1]), "zzzzzz": "zzzzzy"}


def test_one_edit():
    assert spelling.one_edit("abc", "abcd") and spelling.one_edit("xabc", "abc") and spelling.one_edit("abc", "axc") and spelling.one_edit("aab", "aaab")
    assert not any(spelling.one_edit(*p) for p in (("abc", "abc"), ("abc", "acb"), ("abc", "abcde"), ("abcd", "xbcy")))


def counted(docs):
    f = defaultdict(Counter)
    for lang, text in docs:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = re.findall("[^ \t]+", piece)
            for k in range(1, 6):
                f[lang if lang is not None else "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return f


def phrases_by_hand(docs, least, top):
    out = set()
    for lang, f in counted(docs).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        known = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {q[i:j] for q, b in known.items() for i in range(len(q)) for j in range(i + 2, len(q) + 1) if j - i < len(q) and b >= f[q[i:j]]}
        rows = []
        for p, a in known.items():
            if p not in gone:
                score, _, l, r = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))  # noqa: E741
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        out |= {(lang, k, p.decode(), -a, l, r, n, -s) for k, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)}
    return out


def made_up_texts(n, seed):
    rnd = random.Random(seed)
    words = ["a", "b", "c", "É", "der", "x\x1cy", "z-z"]
    fixed = ["New york city hall", "in front of the", "a b a b a b"]
    out = []
    for _ in range(n):
        parts = [rnd.choice(fixed) if rnd.random() < 0.3 else rnd.choice(words) for _ in range(rnd.randrange(40))]
        out.append((rnd.choice(["en", "en", "en", "de", None, "und"]), "".join(p + rnd.choice([" ", " ", "  ", "\t", ", ", "\n", ".", " ; "]) for p in parts)))
    return out + [("en", None), (None, ""), ("fr", "  ,, ")]


@pytest.mark.parametrize("least, top", [(5, 40), (2, 2000)])
def test_phrases_equal_brute_force(spark, least, top):
    docs = made_up_texts(150, 3)
    frame = spark.createDataFrame([(*d, "p") for d in docs], "lang string, text string, phrase string").repartition(5)
    got = phrases.collocations(frame, least=least, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    rows = [tuple(r) for r in got.collect()]
    want = phrases_by_hand(docs, least, top)
    assert len(rows) == len(want) > 20 and set(rows) == want


def test_large_counts_are_exact(spark):
    text = "p q " * 400_000
    docs = spark.createDataFrame([("en", text), ("en", "p, q. " * 1000)], "lang string, text string")
    assert {tuple(r) for r in phrases.collocations(docs).collect()} == phrases_by_hand([("en", text), ("en", "p, q. " * 1000)], 100, 2000)


@pytest.mark.parametrize("chunk, stretch", [(1, 3), (7, 10), (50, 4_000_000), (4_000_000, 5)])
@pytest.mark.parametrize("depth", [2, 5])
def test_shards_count_every_run_once(monkeypatch, chunk, stretch, depth):
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    monkeypatch.setattr(phrases, "STRETCH", stretch)
    docs = made_up_texts(40, 5) + [("en", "w" * 100 + " v" * 30)]
    marks = None if depth == 2 else np.full(1 << 13, 255, np.uint8)
    shard, got, batches = phrases.Shard(depth, 2, marks), Counter(), []
    for lang, text in docs:
        batches += shard.add(lang or "und", (text or "").encode())
    batches += shard.flush()
    want, names = Counter(), {}
    for lang, f in counted(docs).items():
        for p, a in f.items():
            h = phrases._hashes([(lang, w.encode()) for w in p])
            names |= {int(x): (lang, w) for x, w in zip(h, p)}
            if len(p) <= depth and (marks is None or len(p) > 1):
                want[tuple(map(int, h))] += a
    for b in batches:
        columns = [b.column(k).to_pylist() for k in range(depth)]
        if b.column("lang").null_count == b.num_rows:
            assert columns == [list(c) for c in zip(*sorted(zip(*columns)))] or not b.num_rows  # in order
            for path, n in zip(zip(*columns), b.column("n").to_pylist()):
                if len(path) < 2 or path[1] != phrases._ROOT:
                    got[tuple(x for x in path if x)] += n
        else:
            for h, lang, word in zip(columns[0], b.column("lang").to_pylist(), b.column("word").to_pylist()):
                assert word is None or names[h] == (lang, word)
    assert +got == +want


def test_colliding_words_stop_the_job(spark):
    tries = spark.createDataFrame([(5, 0, 3, 1, None, None), (5, 0, 4, 2, None, None)], "h1 long, h2 long, n long, check long, lang string, word string")
    with pytest.raises(Exception, match="one hash"):
        phrases._merged(tries, 2, 1).collect()


def test_bitmap_holds_every_path(spark):
    rng = np.random.default_rng(1)
    paths = rng.integers(1, 1 << 62, (5000, 2))
    frame = spark.createDataFrame([(p.tolist(),) for p in paths], "path array<long>")
    marks = phrases._bitmap(frame, 2, 5000)
    bits = 3 + (len(marks) - 1).bit_length()
    on = lambda x: (lambda c: marks[c >> 3] >> (c & 7).astype(np.uint8) & 1)(phrases._cell([np.ascontiguousarray(x[:, k]) for k in (0, 1)], bits))
    assert on(paths).all() and on(rng.integers(1, 1 << 62, (5000, 2))).mean() < 0.1


def vectors_by_hand(rows, cosine=0.98):
    good = [k for k, (_, label, v) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {k: np.array(rows[k][2], float) / np.abs(rows[k][2]).max() for k in good}
    unit = {k: x / np.linalg.norm(x) for k, x in unit.items()}
    links = {k: [j for j in good if j != k and rows[j][1] == rows[k][1] and len(unit[j]) == len(unit[k]) and unit[k] @ unit[j] >= cosine] for k in good}
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((i, len(links.get(k, [])), least, i == least))
    return out


def made_up_vectors(seed, dim=16):
    """Groups around centres, chains, copies, scaled copies and all that cannot link."""
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for label in (1, 1, 1, 2, 2, 7):
        centre = rng.standard_normal(dim)
        for _ in range(60):
            x = centre + rng.standard_normal(dim) * rng.choice([0.01, 0.1, 0.16])
            rows.append((k, label, (x * rng.choice([1.0, 1e-150, 1e150])).tolist()))
            k += 1
        rows += [(k + j, label, rows[-1][2]) for j in range(30)]
        k += 30
    a, b = np.eye(dim)[0], np.eye(dim)[1]
    for j in range(40):  # each links to its neighbours only
        t = j * 0.15
        rows.append((k, 3, (a * np.cos(t) + b * np.sin(t)).tolist()))
        k += 1
    odd = [None, [], [0.0] * dim, [None] * dim, [float("nan")] * dim, [float("inf")] * dim, [1.0, 2.0], [2.0, 4.0], [-1.0, -2.0]]
    rows += [(k + j, 1, v) for j, v in enumerate(odd)] + [(k + 20, None, rows[0][2]), (None, 1, rows[0][2]), (None, None, None), (0, 1, rows[0][2])]
    random.Random(seed).shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [5, 512])
def test_embeddings_equal_brute_force(spark, block):
    rows = made_up_vectors(2)
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, label int, embedding array<double>, node int").repartition(6)
    got = sorted(map(str, map(tuple, embeddings.near_vectors(frame, recall=0.99999, block=block).collect())))
    assert got == sorted(map(str, vectors_by_hand(rows)))


def test_recall_at_the_threshold():
    """Pairs at a cosine of 0.98 meet in a table about as often as computed."""
    depth, tables = embeddings.shape_for(2000)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((3000, 64))
    y -= (x * y).sum(1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    normal, shift = rng.standard_normal((64, depth * tables)), rng.random(depth * tables) * embeddings.WIDTH
    same = (np.floor((x @ normal + shift) / embeddings.WIDTH) == np.floor((y @ normal + shift) / embeddings.WIDTH)).reshape(3000, tables, depth).all(2)
    assert same.any(1).mean() >= embeddings.RECALL - 0.005
    assert abs(same.mean() - embeddings.same_step(0.98) ** depth) < 0.02


def test_embedding_links_do_not_depend_on_partitions(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").limit(200)
    twice = frame.union(frame.withColumn("vec_id", F.col("vec_id") + 10_000)).union(frame.select(F.col("vec_id") + 20_000, F.transform("embedding", lambda x: x * F.lit(2).cast("float")), "label"))
    one = {tuple(r) for r in embeddings.near_vectors(twice.repartition(1)).collect()}
    two = {tuple(r) for r in embeddings.near_vectors(twice.repartition(9, "vec_id")).collect()}
    assert one == two and all(r[1] == 2 and r[2] == r[0] % 10_000 for r in one)


def test_blocks_let_every_two_meet_once(spark):
    posts = spark.createDataFrame([(k % 3, f"m{k}") for k in range(50)] + [(9, "alone")], "key int, member string")
    rows = block_pairs(posts, "key", "member", 4).collect()
    met = Counter()
    for run in {r.run for r in rows}:
        own = [r for r in rows if r.run == run]
        assert len(own) <= 20
        for i, a in enumerate(own):
            for b in own[:i]:
                if a.lo == a.hi or a.own != b.own:
                    met[frozenset((a.member, b.member))] += 1
    assert met == {frozenset((f"m{i}", f"m{j}")): 1 for i in range(50) for j in range(i) if i % 3 == j % 3}


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_runs_stay_whole(size):
    keys = [1, 1, 1, 2, 3, 3, 4, 4, 4, 4, 4, 5]
    batches = [pa.record_batch([pa.array(keys[k : k + size])], names=["run"]) for k in range(0, len(keys), size)]
    got = [b.column(0).to_pylist()[s:e] for b, cuts in whole_runs(iter(batches)) for s, e in zip(cuts[:-1], cuts[1:])]
    assert got == [[1] * 3, [2], [3] * 2, [4] * 5, [5]]
    assert list(whole_runs(iter([]))) == []


@pytest.mark.parametrize("run", [
    lambda s: spelling.variants(s.createDataFrame([], "doc_id long, text string")),
    lambda s: phrases.collocations(s.createDataFrame([], "lang string, text string")),
    lambda s: embeddings.near_vectors(s.createDataFrame([], "vec_id long, label int, embedding array<float>")),
    lambda s: spelling.variants(s.createDataFrame([(1, None), (None, "")], "doc_id long, text string")),
    lambda s: phrases.collocations(s.createDataFrame([(None, None), ("en", "")], "lang string, text string")),
])
def test_nothing_gives_nothing(spark, run):
    assert run(spark).collect() == []

"""Quality classifier: a linear-chain conditional random field over a document's lines.

Each line has features of its own and of its neighbours; the field labels it good or bad, and
forward-backward gives each line's probability of being good.  The mean of these, weighted by the
lines' lengths, is a document's quality, and a logistic curve turns it into the probability of label 1.

Labels are known for documents only, so a document's lines are all learnt with its label; lines that
occur in good and bad documents alike come out undecided.  The fit uses at most ``sample`` labelled
documents, the first by a hash of their ids, of these only as many as have ``lines`` lines together,
and never one that is held out.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass
from math import log1p
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.common import byte_texts, free, others, portions, sized, small_batches, text_of

SAMPLE, LINES, FOLDS, THRESHOLD = 4000, 200_000, 5, 0.3
#: Lines, padding included, that are worked on at once.
CELLS = 262_144
_UPPER, _DIGITS, _SYMBOLS = string.ascii_uppercase.encode(), string.digits.encode(), b"#*$%&|<>!{}[]\\^~=_@"
_MARKS, _SPACE = b".,;:?'\"()-", b" \t\n\r\x0b\x0c"
_ENDS = (b".", b"!", b"?", b":", b'"', b"'", b")", b"\xe2\x80\xa6", b"\xe2\x80\x9d", b"\xe3\x80\x82")
OWN = 16


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows and lengths (bytes that are not white space) of a text's lines with a word.

    A row is the line's own features, then those of the line before and of the line after (zeros
    and a flag at the ends), then whether it equals either.
    """
    rows, sizes, lines = [], [], []
    for line in text.split(b"\n"):
        words = line.split()
        if not words:
            continue
        solid = line.translate(None, _SPACE)
        n, k = len(solid), len(words)
        upper, digits, symbols, marks = ((n - len(solid.translate(None, x))) / n for x in (_UPPER, _DIGITS, _SYMBOLS, _MARKS))
        again = sum(map(eq, words, words[1:])) / k
        rows.append(
            (
                1.0, upper, digits, symbols, marks, len(set(words)) / k, min(n / k, 30.0) / 10, log1p(k) / 5, again,
                upper > 0.3, symbols > 0.03, marks > 0.2, again > 0.2,
                line.rstrip(_SPACE).endswith(_ENDS), words[0][:1].isupper(), k < 4,
            )
        )
        sizes.append(n)
        lines.append(line)
    own = np.array(rows, np.float64).reshape(-1, OWN)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    same = np.array([a == b for a, b in zip(lines, lines[1:])], bool)
    alike = np.zeros((len(lines), 2))
    alike[1:, 0], alike[:-1, 1] = same, same
    return np.hstack([own, before, after, alike]), np.array(sizes, np.float64)


@dataclass
class Field:
    """Weights of a line's features for good over bad, and scores of one label following another."""

    weights: np.ndarray
    steps: np.ndarray  # [before, after], 0 bad and 1 good
    curve: tuple[float, float] = (1.0, 0.0)  # slope and offset of the logistic curve

    def marginals(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of good for every line of each document; documents of like length go together."""
        out: list[np.ndarray] = [np.empty(0)] * len(rows)
        order = sorted((k for k in range(len(rows)) if len(rows[k])), key=lambda k: -len(rows[k]))
        while order:
            part, order = order[: max(1, CELLS // len(rows[order[0]]))], order[max(1, CELLS // len(rows[order[0]])) :]
            lengths = np.array([len(rows[k]) for k in part])
            own = np.zeros((len(part), lengths[0], 2))
            at = np.arange(lengths[0]) < lengths[:, None]
            own[..., 1][at] = np.concatenate([rows[k] for k in part]) @ self.weights
            good = forward_backward(own, at, self.steps)[0][..., 1]
            for place, k in enumerate(part):
                out[k] = good[place, : lengths[place]]
        return out


def forward_backward(own: np.ndarray, at: np.ndarray, steps: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Marginals (documents, lines, 2), expected label pairs summed, and log partition functions.

    ``own`` are line scores, ``at`` which lines exist; documents are sorted from long to short, so
    that the ones still running at a line are a prefix.
    """
    n, m, _ = own.shape
    live = at.sum(0)
    a, b = np.zeros((n, m, 2)), np.zeros((n, m, 2))
    a[:, 0] = own[:, 0]
    for t in range(1, m):
        k = live[t]
        s = a[:k, t - 1, :, None] + steps
        a[:k, t] = np.logaddexp(s[:, 0], s[:, 1]) + own[:k, t]
    for t in range(m - 2, -1, -1):
        k = live[t + 1]
        s = steps + (own[:k, t + 1] + b[:k, t + 1])[:, None, :]
        b[:k, t] = np.logaddexp(s[..., 0], s[..., 1])
    ends = np.maximum(at.sum(1) - 1, 0)
    last = a[np.arange(n), ends]
    z = np.logaddexp(last[:, 0], last[:, 1])
    marginals = np.exp(a + b - z[:, None, None]) * at[..., None]
    expected = None
    if pairs:
        s = a[:, :-1, :, None] + steps + (own[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]
        expected = (np.exp(np.minimum(s, 0)) * at[:, 1:, None, None]).sum((0, 1))
    return marginals, expected, z


def fit(rows: list[np.ndarray], labels: list[np.ndarray], rounds: int = 150, piece: int = 32, rate: float = 0.15, decay: float = 2e-5) -> Field:
    """Maximum likelihood by Adam over documents cut into pieces of at most ``piece`` lines.

    ``labels`` hold 1 or 0 per line.
    """
    cut = [(x[k : k + piece], y[k : k + piece]) for x, y in zip(rows, labels) for k in range(0, len(x), piece)]
    cut.sort(key=lambda p: -len(p[0]))
    lengths = np.array([len(x) for x, _ in cut])
    at = np.arange(lengths[0]) < lengths[:, None]
    x = np.zeros((*at.shape, cut[0][0].shape[1]))
    y = np.full(at.shape, np.nan)
    x[at], y[at] = np.concatenate([p[0] for p in cut]), np.concatenate([p[1] for p in cut])
    clamp = np.zeros((*at.shape, 2))
    clamp[..., 1][y == 0] = clamp[..., 0][y == 1] = -1e9
    theta = np.zeros(x.shape[2] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        weights, steps = theta[:-4], theta[-4:].reshape(2, 2)
        own = np.zeros((*at.shape, 2))
        own[..., 1] = x @ weights
        free, free_pairs, _ = forward_backward(own, at, steps, True)
        held, held_pairs, _ = forward_backward(own + clamp, at, steps, True)
        g = np.concatenate([np.einsum("nt,ntf->f", held[..., 1] - free[..., 1], x), (held_pairs - free_pairs).ravel()]) / at.sum() - decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Field(theta[:-4], theta[-4:].reshape(2, 2))


def held_out(key: Column, folds: int = FOLDS) -> Column:
    """Whether a document is never learnt from: the CRC-32 of its id's decimal text divides by ``folds``."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, lines: int = LINES) -> Field | None:
    """A field fitted to at most ``sample`` labelled documents and ``lines`` lines; None if both labels are not there.

    The sample is the first by hash of the id, without documents that have a twentieth of ``lines`` or
    more; of texts that share an id the one with the least hash.  Only features of its lines come to the driver.
    """
    known = labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("y"))
    known = known.where("id IS NOT NULL AND y IS NOT NULL").where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    texts = docs.select(docs[id_col].cast("long").alias("id"), text_of(docs, text_col).alias("t"))
    ids = texts.select("id").join(known, "id", "left_semi").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    chosen = known.join(F.broadcast(ids), "id")  # at most ``sample`` ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sized(batches):
            packed = [[a.astype(np.float32).tobytes() for a in line_features(t)] for t in byte_texts(b, "t")]
            x, n = (pa.array([p[k] for p in packed], pa.binary()) for k in (0, 1))
            yield pa.record_batch([b.column(0), b.column(1), x, n], names=["id", "y", "x", "n"])

    own = texts.join(F.broadcast(chosen), "id").withColumns({"n": F.regexp_count("t", F.lit("\n")) + 1, "h": F.xxhash64("t")}).where(F.col("n") < max(2, lines // 20))
    first = own.groupBy("id", "y").agg(F.min("h").alias("h"), F.min_by("n", "h").alias("n"))
    # At most ``sample`` rows of numbers meet in one task.
    held = first.withColumn("before", F.sum("n").over(Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0))).where(F.col("before") <= lines)
    chosen_rows = own.join(F.broadcast(held.select("id", "h")), ["id", "h"]).dropDuplicates(["id"])
    found = chosen_rows.select("id", "y", "t").mapInArrow(run, "id long, y int, x binary, n binary").toPandas()
    found = found.sort_values(["id", "x"], kind="stable")
    width = 3 * OWN + 2
    rows = [np.frombuffer(x, np.float32).reshape(-1, width).astype(np.float64) for x in found["x"]]
    used = [(x, float(y > 0)) for x, y in zip(rows, found["y"]) if len(x)]
    if len({y for _, y in used}) < 2:
        return None
    rows = [x for x, _ in used]
    field = fit(rows, [np.full(len(x), y) for x, y in used])
    sizes = [np.frombuffer(n, np.float32).astype(np.float64) for x, n in zip(found["x"], found["n"]) if len(x)]
    quality = np.array([p @ n / n.sum() for p, n in zip(field.marginals(rows), sizes)])
    field.curve = _curve(quality, np.array([y for _, y in used]))
    return field


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _curve(quality: np.ndarray, labels: np.ndarray, rounds: int = 50, decay: float = 0.05) -> tuple[float, float]:
    """Slope and offset of the logistic regression of labels on log-odds of quality, by Newton's method."""
    x, w = np.stack([_log_odds(quality), np.ones(len(labels))], 1), np.array([1.0, 0.0])
    pull, middle = decay * np.eye(2), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (labels - p) - pull @ (w - middle)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, g)
        w = w + step / max(1.0, np.abs(step).max())
    return max(float(w[0]), 1e-3), float(w[1])


def score_texts(field: Field | None, texts: list[bytes]) -> np.ndarray:
    """Probability of label 1 from the length-weighted mean of the lines' marginals; 0 for a text without a word, 1 without a field."""
    parts = [line_features(t) for t in texts]
    if field is None:
        return np.array([float(len(s) > 0) for _, s in parts])
    good = field.marginals([x for x, _ in parts])
    slope, offset = field.curve
    odds = _log_odds(np.array([p @ s / s.sum() if len(s) else 0.5 for p, (_, s) in zip(good, parts)]))
    scores = 1 / (1 + np.exp(-np.clip(slope * odds + offset, -30, 30)))
    return np.where([len(s) > 0 for _, s in parts], scores, 0.0)


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, threshold: float = THRESHOLD, out: str = "judged") -> DataFrame:
    """All columns of ``docs`` and a struct ``out``: ``held_out``, ``score`` and ``predicted``.

    A column of that name is replaced.  The score depends on the text alone.  Null and empty texts score 0.  Null ids count as not held
    out and are never learnt from; repeated rows get equal scores.  Without labels of both kinds
    every text with a word scores 1.
    """
    small_batches(docs.sparkSession)
    field = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, id_col, text_col, label_col, sample))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            raw = [t.encode() for t in texts]
            yield pd.Series(np.concatenate([score_texts(field.value, part) for part in portions(raw, 256)] or [np.empty(0)]))

    names = [f"_{k}" for k in range(len(docs.columns))]
    own = dict(zip(docs.columns, names))
    rows = docs.toDF(*names)
    rows = rows.withColumn("score", score(F.coalesce(F.col(own[text_col]).cast("string"), F.lit(""))))
    judged = F.struct(held_out(F.col(own[id_col]).cast("long")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
    return rows.select(*[F.col(own[c]).alias(c) for c in others(docs.columns, out)], judged.alias(out))


def filtered(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are not rejected, with their columns."""
    name = free(docs.columns, "judged")
    out = scored(docs, labels, out=name, **options)
    return out.where(out[name]["predicted"] == 1).select(*[out[c] for c in docs.columns])

"""One-permutation MinHash fingerprints with optimal densification and packed low-order bits.

Every five-word shingle is hashed once.  The hash's top bits choose one of ``BINS`` bins and each
bin keeps its least hash.  An empty bin copies a full one: bin i probes the bins ``c[i] + a[i] * t``
for t = 0, 1, ... (modulo BINS, a odd, so that all are reached) and takes the first full one, which
chooses alike in every document and independently per bin.  Each bin keeps the four low bits of its
hash, mixed with the bin's number so that copies of one hash do not agree by chance together, packed
as one hexadecimal digit.  Digits agree by chance once in 16, so a share m of agreeing digits
estimates the likeness (m - 1/16) / (1 - 1/16).

All of it is expressions over one row: the bins' largest values are added to the hashes and sorted
with them, so the first value of each bin is its minimum, or that mark if the bin is empty.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.common import text_of
from concord.llm.rules import words_of

SHINGLE, LOG_BINS, BITS, PROBES, KEPT = 5, 9, 4, 24, 40
BINS = 1 << LOG_BINS
_LOW = (1 << (64 - LOG_BINS)) - 1


def _probing(seed: int = 11) -> tuple[list[int], list[int], list[int]]:
    """Offset, odd step and the step's inverse for each bin."""
    rnd = random.Random(seed)
    c, a = [rnd.randrange(BINS) for _ in range(BINS)], [rnd.randrange(BINS) | 1 for _ in range(BINS)]
    return c, a, [pow(x, -1, BINS) for x in a]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprint(df: DataFrame, text: str, out: str, shingle: int = SHINGLE) -> DataFrame:
    """``df`` with column ``out``: the fingerprint of string column ``text``; empty if it has no word.

    A text of fewer words than a shingle is one shingle.  Column names starting with ``out`` and an
    underscore are used on the way.
    """
    w, h, v, d, full = (f"{out}_{k}" for k in "whvdf")
    offsets, steps, inverses = _probing()
    c, inverse = F.lit(offsets), F.lit(inverses)
    # The bins that bin i probes, t steps on, as constants.
    probed = [F.expr(f"array({', '.join(str((x + y * t) % BINS) for x, y in zip(offsets, steps))})") for t in range(PROBES)]
    n = F.size(w)
    words = F.col(w)
    grams = F.transform(F.sequence(F.lit(0), n - shingle), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(shingle)]))
    hashes = F.when(n >= shingle, grams).otherwise(F.array(F.xxhash64(F.array_join(w, " "))))
    marks = F.lit([_signed(b << (64 - LOG_BINS) | _LOW) for b in range(BINS)]).cast("array<bigint>")
    bin_of = lambda x: F.shiftrightunsigned(x, 64 - LOG_BINS)
    step = df.withColumn(w, words_of(F.col(text))).withColumn(h, F.sort_array(F.concat(hashes, marks)))
    least = F.filter(h, lambda x, k: (k == 0) | (bin_of(x) != bin_of(F.get(F.col(h), k - 1))))
    # A full bin's entry holds its place above its hash's low bits.
    low = F.lit((1 << KEPT) - 1)
    entry = F.transform(least, lambda x, k: F.when(x.bitwiseAND(F.lit(_LOW)) != _LOW, F.shiftleft(k.cast("long"), KEPT) + x.bitwiseAND(low)))
    step = step.withColumn(v, entry).withColumn(full, F.array_compact(v))
    probe = lambda i, t: F.get(F.col(v), F.get(probed[t], i))
    # Where many probes have failed few bins are full, and the first of them in probing order is found directly.
    turn = lambda q, i: ((F.shiftright(q, KEPT).cast("int") - F.get(c, i)) * F.get(inverse, i)).bitwiseAND(F.lit(BINS - 1))
    first = lambda i: F.array_min(F.transform(full, lambda q: F.shiftleft(turn(q, i).cast("long"), KEPT + LOG_BINS) + q))
    filled = F.transform(v, lambda x, i: F.coalesce(x, *[probe(i, t) for t in range(PROBES)], first(i)).bitwiseAND(low))
    step = step.withColumn(d, filled)
    shown = F.expr("array('" + "', '".join("0123456789abcdef") + "')")
    digits = F.array_join(F.transform(d, lambda x, i: F.get(shown, F.xxhash64(x, i).bitwiseAND(F.lit(15)).cast("int"))), "")
    return step.withColumn(out, F.when(n > 0, digits).otherwise(F.lit(""))).drop(w, h, v, d, full)


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles, 0 to 1; two texts without words are alike, one is unlike."""
    part = lambda s, k: F.conv(F.substring(s, k * 16 + 1, F.lit(16)), 16, -10).cast("long")

    def differing(k):
        x = part(a, k).bitwiseXOR(part(b, k))
        folded = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        return F.bit_count(folded.bitwiseAND(F.lit(0x1111111111111111)))

    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(BINS // 16 - 1)), differing), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-BITS
    estimate = F.greatest(F.lit(0.0), (1 - total / BINS - chance) / (1 - chance))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(estimate)


def _ranged(rows: DataFrame, parts: int) -> DataFrame:
    """``rows`` with ``part``: in which of about ``parts`` ranges of ``(id, mark)`` a row is, ascending, null ids below all.

    The cut points of ids are approximate quantiles, a bounded list, searched by halves.  Ids that
    take up a whole range or more, and null ones, are cut again by ``mark``, 31 bits of the text's hash.
    """
    at = [k / parts for k in range(1, parts)]
    cuts = rows.agg(F.percentile_approx("id", F.lit(at), 10_000)).first()[0] or [] if at else []
    often = sorted({a for a, b in zip(cuts, cuts[1:]) if a == b})
    bounds = sorted({x + k for x in cuts for k in ((0, 1) if x in set(often) and x < (1 << 63) - 1 else (0,))})
    place = F.lit(0)
    if bounds:
        table = F.expr(f"array({', '.join(f'bigint({x})' for x in bounds)})")
        halves = F.expr(f"array({', '.join(str(1 << k) for k in range(len(bounds).bit_length() - 1, -1, -1))})")
        place = F.aggregate(halves, F.lit(0), lambda low, step: F.when(F.get(table, low + step - 1) <= F.col("id"), low + step).otherwise(low))
    sub = F.floor(F.col("mark") * parts / F.lit(1 << 31)).cast("int")
    split = F.col("id").isNull() | F.col("id").isin(often) if often else F.col("id").isNull()
    return rows.withColumn("part", F.when(F.col("id").isNull(), -1).otherwise(place).cast("long") * F.lit(1 << 20) + F.when(split, sub).otherwise(0))


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 2000) -> DataFrame:
    """``id, n_chars, text, fingerprint``, and the same of the edited text, with both likenesses.

    The next document is the one before in descending order of ids (null ids last, equal ids by a
    hash of the text); the last one's next is the first.  Documents are cut into ranges of that
    order, neighbours meet inside a range, and only each range's first document is passed to the
    range above.  A null text counts as empty; a table of one row is its own next.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), text_of(docs, text_col).alias("text"))
    rows = rows.withColumn("mark", F.shiftrightunsigned(F.xxhash64("text"), 33))
    count = rows.count()
    rows = _ranged(rows, min(10_000, max(1, count // rows_per_range)))
    own = with_fingerprint(rows, "text", "fingerprint")
    order = Window.partitionBy("part").orderBy(F.desc("id"), F.desc("mark"), F.desc("text"))
    # One shuffle carries the texts; the row that ends a range looks up the head of the next one.
    led = own.withColumns({"next_text": F.lead("text").over(order), "next_fp": F.lead("fingerprint").over(order), "last": F.lead(F.lit(1)).over(order).isNull()})
    heads = rows.groupBy("part").agg(F.max(F.struct("id", "mark", "text"))["text"].alias("head_text"))
    heads = with_fingerprint(heads, "head_text", "head_fp")
    # Numbers of ranges only, of which there is a bounded count, meet in one task.
    numbers = rows.select("part").distinct()
    down, every = Window.orderBy(F.desc("part")), Window.partitionBy()
    links = numbers.select(F.col("part").alias("above"), F.lit(True).alias("ends"), F.coalesce(F.lead("part").over(down), F.max("part").over(every)).alias("below"))
    links = links.join(heads, F.col("below") == F.col("part")).select("above", "ends", F.col("head_text").alias("below_text"), F.col("head_fp").alias("below_fp"))
    met = led.join(links, (F.col("part") == F.col("above")) & (F.col("last") == F.col("ends")), "left")
    half = F.floor(F.length("text") / 2).cast("int")
    following = F.coalesce("next_text", "below_text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(following, F.lit(1), half))
    met = met.select("id", "text", "fingerprint", edited.alias("edited"), F.coalesce("next_fp", "below_fp").alias("next_fp"))
    met = with_fingerprint(met, "edited", "edited_fingerprint")
    return met.select(
        "id", "text", "edited", F.length("text").cast("long").alias("n_chars"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fp")).alias("near_next"),
    )

"""BPE as a bounded-lookahead streaming transducer, and an incremental decoder.

A tokenizer file of the ``word_bpe`` family is read: NFC, white-space runs to one blank, lower case,
a split into pre-tokens, bytes shown as characters, merges by rank with an end-of-word suffix.

**Lookahead.**  Text that has not been read yet can change the tokens before it only through a
chain of merges.  Whether merge ``(u, v)`` removes the boundary between its parts depends on what
follows through one thing alone: a token ``s`` at the right edge of ``v`` (``v`` itself or a part
on its right spine) may first be taken by a merge ``(s, x)`` of lower rank.  Hence with
``D(u, v) = len(v) + max D(s, x)`` over those merges, a boundary with at least ``max D`` symbols
after it is final.  ``sufficient_lookahead`` computes this from the merge list in one pass by rank.

**Transducer.**  ``Transducer`` holds a window of symbols, merges it, emits the tokens that end
``lookahead`` or more symbols before its end and goes on with the rest, so memory is constant for a
word of any length.  A text is cut into words first; a bounded table remembers recent words.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from concord.llm.common import byte_texts, sized, small_batches, text_of

#: White space as the tokenizer's patterns see it; str.split() would also split at U+001C to U+001F.
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORDS = regex.compile(f"[^{_BLANK}]+")
_ODD = regex.compile("[\x1c-\x1f]")


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [], 0x100
    for b in range(256):
        if b in shown:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


_SHOWN = byte_characters()
_BYTE_OF = {c: b for b, c in enumerate(_SHOWN)}


def sufficient_lookahead(merges: list[tuple[str, str]], length) -> int:
    """Symbols after a boundary that make it final, for merges in rank order.

    ``length(token)`` counts a token's symbols.  Raises ValueError if a merge uses a token that no
    earlier merge made, since then a low-rank pair could appear late and the bound would not hold.
    """
    made: dict[str, tuple[int, str]] = {}  # token: rank of its merge, right part
    by_left: dict[str, tuple[list[int], list[int]]] = {}  # left part: ranks, running maximum of D
    most = 1
    for rank, (u, v) in enumerate(merges):
        if any(length(x) > 1 and x not in made for x in (u, v)):
            raise ValueError(f"merge {rank} uses a token that is not made before it")
        far, part, before = 0, v, rank
        while True:
            ranks, maxima = by_left.get(part, ((), ()))
            if k := bisect_left(ranks, before):
                far = max(far, maxima[k - 1])
            if part not in made:
                break
            before, part = made[part]
        d = length(v) + far
        most = max(most, d)
        ranks, maxima = by_left.setdefault(u, ([], []))
        ranks.append(rank)
        maxima.append(max(d, maxima[-1]) if maxima else d)
        if u + v in made:
            raise ValueError(f"token of merge {rank} is made twice")
        made[u + v] = (rank, v)
    return most


@dataclass
class Model:
    """A tokenizer file's vocabulary, merges and patterns, in the form that workers need."""

    pattern: str
    tokens: list[str]
    ids: dict[str, int]
    ranks: dict[tuple[int, int], int]
    made: list[int]
    suffix: str
    added: dict[str, int]
    lookahead: int

    @classmethod
    def read(cls, source: str) -> Model:
        """From the content of a tokenizer file (JSON); other kinds than the one described raise ValueError."""
        data = json.loads(source)
        model, steps = data["model"], [x["type"] for x in data["normalizer"]["normalizers"]]
        split, level = data["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or level["type"] != "ByteLevel" or data["decoder"] is not None:
            raise ValueError("not a tokenizer of this family")
        ids, suffix = model["vocab"], model["end_of_word_suffix"]
        added = {x["content"]: x["id"] for x in data["added_tokens"]}
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        tokens = [""] * (max([*ids.values(), *added.values()]) + 1)
        for token, i in {**ids, **added}.items():
            tokens[i] = token
        far = sufficient_lookahead(pairs, lambda t: len(t.removesuffix(suffix)))
        ranks = {(ids[u], ids[v]): rank for rank, (u, v) in enumerate(pairs)}
        return cls(split["pattern"]["Regex"], tokens, ids, ranks, [ids[u + v] for u, v in pairs], suffix, added, far)


def merged(ids: list[int], ranks: dict[tuple[int, int], int], token: list[int]) -> list[int]:
    """All merges applied to a list of symbols, lowest rank first and from the left."""
    none, get = len(token), ranks.get
    pairs = [get(p, none) for p in zip(ids, ids[1:])]
    while pairs and (best := min(pairs)) < none:
        k = pairs.index(best)
        ids[k] = token[best]
        del ids[k + 1], pairs[k]
        if k < len(pairs):
            pairs[k] = get((ids[k], ids[k + 1]), none)
        if k:
            pairs[k - 1] = get((ids[k - 1], ids[k]), none)
    return ids


class Transducer:
    """Symbols of one word in, final tokens out, with a window of bounded size."""

    def __init__(self, model: Model):
        self.model, self.held = model, []
        self.window = 4 * model.lookahead
        #: Symbols per token, to know where a token ends.
        self.width = [len(t.removesuffix(model.suffix)) for t in model.tokens]

    def feed(self, symbols: Iterable[int]) -> Iterator[int]:
        """Take symbols and give the tokens that nothing to come can change."""
        for s in symbols:
            self.held.append(s)
            if len(self.held) >= self.window:
                yield from self._stable()

    def _stable(self) -> Iterator[int]:
        end, at = len(self.held) - self.model.lookahead, 0
        for token in merged(self.held.copy(), self.model.ranks, self.model.made):
            if at + self.width[token] > end:
                break
            at += self.width[token]
            yield token
        del self.held[:at]

    def finish(self) -> Iterator[int]:
        """The word is over: its last symbol has been fed in its end-of-word form."""
        held, self.held = self.held, []
        yield from merged(held, self.model.ranks, self.model.made)

    def word(self, symbols: list[int]) -> list[int]:
        """A whole word; nothing of it comes out before the window is full or it is over."""
        return [*self.feed(symbols), *self.finish()]


class Decoder:
    """Token ids to text, a token at a time; state is the bytes of an unfinished character.

    ``spaced`` joins the vocabulary's own strings by one blank, as a tokenizer without a decoder
    does; each is whole text, so the state is only whether a blank is due.  Otherwise the tokens'
    bytes become text, where a character may span tokens, and an end of word becomes a blank.
    """

    def __init__(self, model: Model, spaced: bool = True):
        self.model, self.spaced, self.due = model, spaced, ""
        self.state = None if spaced else codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, token: int) -> str:
        text = self.model.tokens[token]
        if self.spaced:
            due, self.due = self.due, " "
            return due + text
        if text in self.model.added:
            return self.state.decode(b"", True) + text
        body = text.removesuffix(self.model.suffix)
        return self.state.decode(bytes(_BYTE_OF[c] for c in body) + (b" " if body != text else b""))

    def finish(self) -> str:
        return self.state.decode(b"", True) if self.state else ""

    def run(self, ids: Iterable[int]) -> str:
        """All tokens at once: the same text as feeding them one by one."""
        if self.spaced:
            text = " ".join(map(self.model.tokens.__getitem__, ids))
            due, self.due = self.due if text else "", " " if text else self.due
            return due + text
        return "".join([*map(self.feed, ids), self.finish()])


class Codec:
    """Encodes and decodes texts; remembers recent words, up to ``keep`` characters of words and ids."""

    def __init__(self, model: Model, keep: int = 16_000_000, chunk: int = 65_536):
        self.model, self.keep, self.chunk = model, keep, chunk
        self.split = regex.compile(model.pattern.replace(r"\s", _BLANK))
        self.specials = regex.compile("|".join(map(regex.escape, model.added)) or r"(?!)")
        self.inner = [model.ids[c] for c in _SHOWN]
        self.last = [model.ids[c + model.suffix] for c in _SHOWN]
        self.names = list(map(str, range(len(model.tokens))))
        self.transducer = Transducer(model)
        self.words: dict[str, tuple[str, list[int]]] = _Recent(self._word)
        self.pieces: dict[str, list[int]] = _Recent(self._piece)

    def _piece(self, piece: str) -> list[int]:
        raw = piece.encode()
        symbols = list(map(self.inner.__getitem__, raw))
        symbols[-1] = self.last[raw[-1]]
        return self.transducer.word(symbols)

    def _word(self, word: str) -> tuple[str, list[int]]:
        pieces = self.split.findall(word)
        ids = self.pieces[pieces[0]] if len(pieces) == 1 else [i for p in pieces for i in self.pieces[p]]
        return self._shown(ids)

    def _shown(self, ids: list[int]) -> tuple[str, list[int]]:
        return " ".join(map(self.names.__getitem__, ids)), ids

    def _clean(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        # One letter's lower case depends on its neighbours in str.lower(); here no letter's may.
        return text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()

    def parts(self, text: str) -> Iterator[list[tuple[str, list[int]]]]:
        """Chunks of ``(ids joined by one blank, ids)`` per word, in order."""
        at, cuts = 0, list(self.specials.finditer(text)) if "<|" in text else []
        for cut in [*cuts, None]:
            clean = self._clean(text[at : cut.start() if cut else None])
            words = _WORDS.findall(clean) if _ODD.search(clean) else clean.split()
            for k in range(0, len(words), self.chunk):
                for memory in (self.words, self.pieces):
                    if memory.held > self.keep:
                        memory.clear()
                        memory.held = 0
                yield list(map(self.words.__getitem__, words[k : k + self.chunk]))
            if cut:
                at = cut.end()
                yield [self._shown([self.model.added[cut[0]]])]

    def encode(self, text: str) -> list[int]:
        """Token ids of a text."""
        return [i for chunk in self.parts(text) for _, ids in chunk for i in ids]

    def decode(self, ids: Iterable[int], spaced: bool = True) -> str:
        """Text of token ids."""
        return Decoder(self.model, spaced).run(ids)

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, and SHA-256 of the ids and of the text that the decoder makes of them, without holding either."""
        ids, decoded, n, blank, decoder = hashlib.sha256(), hashlib.sha256(), 0, "", Decoder(self.model)
        for chunk in self.parts(text):
            if not chunk:
                continue
            own = list(chain.from_iterable(x for _, x in chunk))
            n += len(own)
            ids.update((blank + " ".join([x for x, _ in chunk])).encode())
            decoded.update(decoder.run(own).encode())
            blank = " "
        return n, ids.hexdigest(), decoded.hexdigest()


class _Recent(dict):
    """Computes what is missing and keeps it if the word is not long; ``held`` counts what is kept."""

    def __init__(self, make, longest: int = 200):
        super().__init__()
        self.make, self.longest, self.held = make, longest, 0

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            self[key] = value
            self.held += len(key) + 50
        return value


_codecs: dict[str, Codec] = {}


def _codec(source: str) -> Codec:
    """A worker's codec for a tokenizer file's content, made once."""
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(Model.read(source))
    return _codecs[key]


def digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256`` for every row; null texts count as empty.

    ``tokenizer`` is a file's path on the driver; its content (1.7 MB) travels with the tasks, so
    executors need no such file.  Ids may be null or repeat; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(content.value)
        for b in sized(batches):
            rows = [codec.digest(t.decode("utf-8", "replace")) for t in byte_texts(b, "t")]
            n, ids, decoded = zip(*rows) if rows else ((), (), ())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(docs[id_col].cast("long").alias("id"), text_of(docs, text_col).alias("t"))
    return rows.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and the token ids as an array, for training; nulls as in ``digests``."""
    small_batches(docs.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(content.value)
        for b in sized(batches, 64):
            ids = [codec.encode(t.decode("utf-8", "replace")) for t in byte_texts(b, "t")]
            yield pa.record_batch([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    rows = docs.select(docs[id_col].cast("long").alias("id"), text_of(docs, text_col).alias("t"))
    return rows.mapInArrow(run, "id long, ids array<int>")

"""Byte-pair encoding and decoding by batched merge rounds over flat numpy arrays."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import base

#: White space as the normalizer's pattern sees it.
BLANKS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANK, LETTER, NUMBER, OTHER = range(4)
#: What the word pattern cuts off after an apostrophe.
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")
#: Longest word (in characters) that is looked up by its hash; longer ones are merged each time.
HASHED_CHARS = 64
#: Words the per-worker table holds before it starts anew.
TABLE_WORDS = 2_000_000
#: New words merged together in one call.
ROUND_WORDS = 100_000

_LOADED: dict[str, "WordBPE"] = {}


def byte_symbols() -> list[str]:
    """One printable character for each byte: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def normalized(text: str) -> str:
    """NFC, then the lower case of each character by itself (a final capital sigma is no exception)."""
    return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()


def character_classes() -> np.ndarray:
    """Class of every code point: blank, letter, number or other."""
    points = np.r_[0:0xD800, 0xE000:0x110000]
    every = points.astype("<u4").tobytes().decode("utf-32-le")
    classes = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, f"[{BLANKS}]+")):
        for m in regex.finditer(pattern, every):
            classes[points[m.start() : m.end()]] = kind
    return classes


def spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every span, one span after the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


class WordBPE:
    """Vocabulary with word ends, read from a tokenizers file: lower case, white space dropped."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.specials.items()}
        self.special_pattern = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.specials, key=len, reverse=True)) + ")")
        self.classes = character_classes()
        symbols = byte_symbols()
        self.inner = np.array([self.vocab[s] for s in symbols], np.int64)
        self.final = np.array([self.vocab[s + self.end] for s in symbols], np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.size = max(self.tokens) + 1
        keys = np.array([self.vocab[a] * self.size + self.vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([self.vocab[a + b] for a, b in merges], np.int64)
        made = {m: r for r, m in reversed(list(enumerate(self.merged.tolist())))}
        #: A pair's parts are made by earlier merges, so no merge of one rank can bring forth a pair of a lower one.
        self.ordered = all(made.get(self.vocab[x], -1) < r for r, pair in enumerate(merges) for x in pair)
        rng = np.random.default_rng(9)
        self.code = rng.integers(1, 1 << 63, 1 << 16, np.uint64)
        self.power = np.cumprod(np.full(1 << 16, 0x9E3779B97F4A7C15, np.uint64))
        self.token_bytes, self.token_start, self.token_length = self._table(self.tokens)
        self.number_bytes, self.number_start, self.number_length = self._table({i: str(i) for i in self.tokens})
        self._empty()

    def _empty(self) -> None:
        self.known, self.start, self.length, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _table(self, of: dict[int, str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts of all ids, each followed by a space, end to end; where each begins and how long it is."""
        each = [(of[i] + " ").encode() if i in of else b"" for i in range(self.size)]
        length = np.array([len(x) for x in each], np.int64)
        return np.frombuffer(b"".join(each), np.uint8), np.cumsum(length) - length, length

    def pair_ranks(self, left: np.ndarray, right: np.ndarray, same_word: np.ndarray) -> np.ndarray:
        """Merge ranks of symbol pairs by binary search; pairs without a merge, or of two words, come after all."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & same_word, self.ranks[at], len(self.merged))

    def merge(self, data: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words whose bytes lie end to end in ``data``, and how many each has.

        Each round joins, in all words at once, the pair of lowest rank of each word.
        """
        ends = np.cumsum(length)
        symbol = self.inner[data]
        symbol[ends - 1] = self.final[data[ends - 1]]
        word = np.repeat(np.arange(len(length)), length)
        none = len(self.merged)
        rank = np.full(len(symbol), none, np.int64)  # of the pair that begins here
        rank[:-1] = self.pair_ranks(symbol[:-1], symbol[1:], word[:-1] == word[1:])
        done_symbol, done_word = [], []
        while len(symbol):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(word)]))
            active = low < none
            if not active.all():
                done_symbol.append(symbol[~active])
                done_word.append(word[~active])
                symbol, word, rank, low = symbol[active], word[active], rank[active], low[active]
                if not len(symbol):
                    break
            pick = rank == low
            if not self.ordered:  # one pair a word and round, the leftmost
                at = np.flatnonzero(pick)
                pick[at[~np.r_[True, word[at[1:]] != word[at[:-1]]]]] = False
            elif (pick[1:] & pick[:-1]).any():  # equal symbols in a row: pairs from the left, without overlap
                start = np.where(pick & ~np.r_[False, pick[:-1]], np.arange(len(pick)), 0)
                pick &= (np.arange(len(pick)) - np.maximum.accumulate(start)) % 2 == 0
            symbol[pick] = self.merged[rank[pick]]
            keep = ~np.r_[False, pick[:-1]]
            symbol, word, rank = symbol[keep], word[keep], rank[keep]
            at = np.flatnonzero(pick[keep])  # only the pairs beside a new symbol change
            at = np.unique(np.r_[at, at[at > 0] - 1])
            rank[at] = none
            at = at[at + 1 < len(symbol)]
            rank[at] = self.pair_ranks(symbol[at], symbol[at + 1], word[at] == word[at + 1])
        symbol, word = np.concatenate(done_symbol), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return symbol[order].astype(np.int32), np.bincount(word, minlength=len(length))

    def cut(self, points: np.ndarray, text_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of the words of normalized texts that lie end to end as code points."""
        kind = self.classes[points]
        starts = np.ones(len(points), bool)
        starts[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        starts[text_ends[(text_ends > 0) & (text_ends < len(points))]] = True
        at = np.flatnonzero((points == ord("'")) & starts)
        at = at[(at + 1 < len(points))]
        at = at[starts[at + 1] & (kind[at + 1] == LETTER)]
        if len(at):
            padded = np.r_[points, 0, 0]
            edge = np.zeros(len(points) + 3, bool)
            edge[text_ends] = True
            for ending in ENDINGS:
                n = len(ending)
                fits = np.all([padded[at + 1 + i] == ord(c) for i, c in enumerate(ending)], axis=0)
                fits &= ~np.any([edge[at + 1 + i] for i in range(n)], axis=0)
                starts[at[fits] + 1] = False
                after = at[fits] + 1 + n
                starts[after[after < len(points)]] = True
        start = np.flatnonzero(starts)
        length = np.diff(np.r_[start, len(points)])
        real = kind[start] != BLANK
        return start[real], length[real]

    def learn(self, points: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as spans of code points, and how many each has."""
        ids, counts = [], []
        for a in range(0, len(start), ROUND_WORDS):
            some = points[spans(start[a : a + ROUND_WORDS], length[a : a + ROUND_WORDS])]
            wide = 1 + (some > 0x7F) + (some > 0x7FF) + (some > 0xFFFF)
            size = np.add.reduceat(wide, np.r_[0, np.cumsum(length[a : a + ROUND_WORDS])[:-1]])
            found, n = self.merge(np.frombuffer(some.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8), size)
            ids.append(found)
            counts.append(n)
        return np.concatenate(ids), np.concatenate(counts)

    def encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of normalized texts without special tokens, end to end, and where each text ends."""
        points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
        text_ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        start, length = self.cut(points, text_ends)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        # polynomial word hashes; equal words, equal hashes, and words too long to be told apart safely get none
        n = np.minimum(length, HASHED_CHARS)
        place = spans(np.zeros(len(n), np.int64), n)
        chars = points[spans(start, n)]
        code = self.code[chars & 0xFFFF] + (chars >> 16).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        hashes = np.add.reduceat(code * self.power[place], np.r_[0, np.cumsum(n)[:-1]])
        hashes ^= length.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        long = np.flatnonzero(length > HASHED_CHARS)
        unique, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(unique) > TABLE_WORDS:
            self._empty()
        at = np.searchsorted(self.known, unique)
        new = np.ones(len(unique), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != unique[inside]
        if new.any():
            ids, counts = self.learn(points, start[first[new]], length[first[new]])
            self.start = np.insert(self.start, at[new], len(self.pool) + np.cumsum(counts) - counts)
            self.length = np.insert(self.length, at[new], counts)
            self.known = np.insert(self.known, at[new], unique[new])
            self.pool = np.r_[self.pool, ids]
            at = np.searchsorted(self.known, unique)
        word_start, word_count, pool = self.start[at][which], self.length[at][which], self.pool
        if len(long):
            ids, counts = self.learn(points, start[long], length[long])
            word_start[long], word_count[long] = len(pool) + np.cumsum(counts) - counts, counts
            pool = np.r_[pool, ids]
        words_before = np.searchsorted(start, text_ends, "left")
        return pool[spans(word_start, word_count)], np.r_[0, np.cumsum(word_count)][words_before]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, end to end, and where each text ends. Special tokens written out in a text are themselves."""
        special = {}
        for i, t in enumerate(texts):
            if any(x in t for x in self.specials):
                special[i] = self.special_pattern.split(t)
        plain = [normalized(p) for i, t in enumerate(texts) for p in special.get(i, (t,)) if p not in self.specials]
        ids, ends = self.encode_plain(plain)
        if not special:
            return ids, ends
        pieces, counts, at, begin = [], [], 0, 0
        for i, t in enumerate(texts):
            own = []
            for p in special.get(i, (t,)):
                if p in self.specials:
                    own.append(np.array([self.specials[p]], np.int32))
                else:
                    own.append(ids[begin : ends[at]])
                    begin, at = ends[at], at + 1
            pieces += own
            counts.append(sum(map(len, own)))
        return np.concatenate(pieces), np.cumsum(counts, dtype=np.int64)

    def encode(self, text: str) -> list[int]:
        """Ids of one text."""
        return self.encode_all([text])[0].tolist()

    def texts_of(self, ids: np.ndarray, ends: np.ndarray, numbers: bool) -> Iterator[bytes]:
        """Of every id list: its tokens, or its decimal ids, joined by one space, in UTF-8."""
        data, start, length = (self.number_bytes, self.number_start, self.number_length) if numbers else (self.token_bytes, self.token_start, self.token_length)
        size = length[ids]
        joined = data[spans(start[ids], size)].tobytes()
        edges = np.r_[0, np.cumsum(size)][np.r_[0, ends]].tolist()
        for a, b in zip(edges, edges[1:]):
            yield joined[a : max(a, b - 1)]

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by spaces, as a vocabulary without a decoder of its own gives them back; unknown ids are left out."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def tokenizer(path: str) -> WordBPE:
    """One loaded vocabulary per worker and path."""
    if path not in _LOADED:
        _LOADED[path] = WordBPE(path)
    return _LOADED[path]


def _mapped(docs: DataFrame, path: str, keep: tuple[str, ...], part_bytes: int, columns: str, make) -> DataFrame:
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col("text").cast("string").alias("t"))
    kinds = dict(rows.dtypes)
    own = [c.split(" ")[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            _, offsets = base.flat(batch.column("t"))
            for a, b in base.parts(offsets, part_bytes):
                some = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*[some.column(c) for c in names], *make(bpe, base.strings(some.column("t")))], [*names, *own])

    out = rows.mapInArrow(run, ", ".join([*[f"{c} {kinds[c]}" for c in names], columns]))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], *own)


def encode_texts(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), part_bytes: int = 1 << 22) -> DataFrame:
    """Ids of every whole text: ``keep`` and ids (array of int). Null text: no ids. No shuffle."""

    def make(bpe: WordBPE, texts: list[str]) -> list[pa.Array]:
        ids, ends = bpe.encode_all(texts)
        return [pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids, pa.int32()))]

    return _mapped(docs, path, keep, part_bytes, "ids array<int>", make)


def decode_ids(frame: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Decoded text of every id list: ``keep`` and text. A null list counts as empty; null or unknown ids are left out."""
    names = [f"k{i}" for i in range(len(keep))]
    rows = frame.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(ids).cast("array<int>").alias("t"))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array([bpe.decode(x or []) for x in batch.column("t").to_pylist()], pa.string())], [*names, "text"])

    out = rows.mapInArrow(run, ", ".join([*[f"{c} {kinds[c]}" for c in names], "text string"]))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "text")


def code_digests(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), part_bytes: int = 1 << 22) -> DataFrame:
    """Encode every whole text, decode the ids again and return digests of both.

    Returns ``keep``, n_tokens, ids_sha256 (decimal ids joined by one space) and decoded_sha256 (decoded text in
    UTF-8), both lowercase hex. A null text counts as empty (no tokens, digests of the empty string); repeated rows
    and null keys are kept one for one; other columns are ignored; an empty table gives an empty result. Texts are
    taken in parts of about ``part_bytes``; a longer text is one part. The per-worker table of coded words is bounded by
    ``TABLE_WORDS``. No shuffle.
    """

    def make(bpe: WordBPE, texts: list[str]) -> list[pa.Array]:
        ids, ends = bpe.encode_all(texts)
        digests = [[hashlib.sha256(t).hexdigest() for t in bpe.texts_of(ids, ends, numbers)] for numbers in (True, False)]
        return [pa.array(np.diff(np.r_[0, ends])), *[pa.array(d, pa.string()) for d in digests]]

    return _mapped(docs, path, keep, part_bytes, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)

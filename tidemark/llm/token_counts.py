"""Token counts: batch encoding inside Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import base

SPACE = "▁"

_LOADED: dict[str, object] = {}


class Counter:
    """Counts the tokens of texts with one vocabulary file (``.json``: tokenizers, ``.model``: sentencepiece)."""

    def __init__(self, path: str) -> None:
        self.pieces = path.endswith(".model")
        if self.pieces:
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.split_safe = self._spaces_start_pieces()
        else:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(path)
            self.model.no_truncation()
            self.model.no_padding()
            self.split_safe = False

    def _spaces_start_pieces(self) -> bool:
        """True if no piece has a space after another character, and one leading space is added to a text and none removed.

        Then no merge crosses the place between a character and a following space, and a text cut there,
        without that space, has as many tokens as before.
        """
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if SPACE in piece.lstrip(SPACE):
                return False
        probe = self.model.encode("a  b ", out_type=str)
        return probe[0].startswith(SPACE) and "".join(probe) == f"{SPACE}a{SPACE}{SPACE}b{SPACE}"

    def split(self, text: str, limit: int) -> list[str]:
        """Pieces of about ``limit`` characters, cut only where no token can cross; a text without such a place stays whole."""
        if not self.split_safe or len(text) <= limit:
            return [text]
        out, start = [], 0
        while len(text) - start > limit:
            cut = text.find(" ", start + limit)
            while cut >= 0 and (text[cut - 1] in (" ", SPACE) or cut + 1 == len(text)):
                cut = text.find(" ", cut + 1)
            if cut < 0:
                break
            out.append(text[start:cut])
            start = cut + 1
        return [*out, text[start:]]

    def lengths(self, texts: list[str]) -> list[int]:
        if self.pieces:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        return [len(x.ids) for x in self.model.encode_batch(texts, add_special_tokens=False)]


def counter(path: str) -> Counter:
    """One loaded vocabulary per worker and path."""
    if path not in _LOADED:
        _LOADED[path] = Counter(path)
    return _LOADED[path]


def count_texts(texts: list[str], path: str, piece_chars: int, batch_chars: int) -> np.ndarray:
    """Tokens of every text; calls get about ``batch_chars`` characters, whatever the lengths of the texts."""
    c = counter(path)
    owner, piece = [], []
    for i, text in enumerate(texts):
        for p in c.split(text, piece_chars):
            owner.append(i)
            piece.append(p)
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in piece], dtype=np.int64)]) if piece else np.zeros(1, np.int64)
    found = [n for a, b in base.parts(offsets, batch_chars) for n in c.lengths(piece[a:b])]
    return np.bincount(np.array(owner, np.int64), weights=np.array(found, float), minlength=len(texts)).astype(np.int64)


def token_counts(
    docs: DataFrame, path: str, text: str | Column = "text", limit: int = 4096, keep: tuple[str, ...] = ("doc_id",),
    piece_chars: int = 1 << 15, batch_chars: int = 1 << 19,
) -> DataFrame:
    """Token count of every whole text under the vocabulary at ``path``.

    ``docs``: any frame; ``text`` is its text column, ``keep`` names columns carried along (other columns, whatever
    their names, are ignored). Returns ``keep``, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``).
    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null keys are kept one for one; an empty
    table gives an empty result. Texts longer than ``piece_chars`` are cut before single spaces where no token can
    cross; calls take about ``batch_chars`` characters, so memory does not follow the longest batch of texts.
    No shuffle: partitions are encoded where they are read.
    """
    column = F.col(text) if isinstance(text, str) else text
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], column.cast("string").alias("t"))
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = base.flat(batch.column("t"))
            n = count_texts(base.strings(batch.column("t")), path, piece_chars, batch_chars)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], [*names, "n_bytes", "n_tokens", "over_limit"])

    kinds = dict(rows.dtypes)
    out = rows.mapInArrow(run, ", ".join([*[f"{c} {kinds[c]}" for c in names], "n_bytes long, n_tokens long, over_limit boolean"]))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "n_bytes", "n_tokens", "over_limit")

"""Spelling variants: FM-index search schemes over the delimited vocabulary, read forwards and backwards, with one error."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import base, terms

PART_BYTES = 1 << 21
#: Code points that words meet on: of two words of six or more, one edit apart, the first or the last three are equal.
SIDE = 3
#: Longest run whose checksum is taken column by column; longer ones go to zlib one at a time.
COLUMNS = 48
#: Words looked up together.
TOGETHER = 4000


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


CRC = _crc_table()


def checksums(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of each range of bytes, continued from a checksum each: a column of bytes at a time over all ranges."""
    length = end - start
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    crc = ~state[order]
    first = int(np.searchsorted(-length, -COLUMNS, "left"))  # longer ranges come before
    for i in range(first):
        crc[i] = ~np.uint32(zlib.crc32(data[start[i] : start[i] + length[i]].tobytes(), int(~crc[i])))
    for column in range(int(length[first]) if first < len(length) else 0):
        some = slice(first, int(np.searchsorted(-length, -column, "left")))
        crc[some] = CRC[(crc[some] ^ data[start[some] + column]) & np.uint32(0xFF)] ^ (crc[some] >> np.uint32(8))
    out = np.empty(len(crc), np.uint32)
    out[order] = ~crc
    return out


def letter_bytes(data: np.ndarray) -> np.ndarray:
    """Bytes of the letters A-Z, a-z and U+00C0 to U+00FF (two bytes, the first 0xC3) in UTF-8."""
    member = ((data | 32) >= 97) & ((data | 32) <= 122)
    lead = data == 0xC3
    member |= lead
    member[1:] |= lead[:-1] & (data[1:] >= 0x80) & (data[1:] < 0xC0)
    return member


def observed(data: np.ndarray, offsets: np.ndarray, ids: list[str], every: int) -> pa.Array:
    """The letter runs of a part of text, one Latin-1 byte a letter, with a letter left out where the checksum says so."""
    low = terms.lowered(data)
    start, end, row = terms.runs(letter_bytes(low), offsets)
    if not len(start):
        return pa.array([], pa.large_binary())
    heads = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    crc = checksums(heads[row], low, start, end)
    # Latin-1: the second byte of a pair moves up, the first goes
    single = np.where((low >= 0x80) & (low < 0xC0), low + np.uint8(0x40), low)
    kept = low != 0xC3
    place = np.cumsum(kept) - kept
    start, end = place[start], np.r_[place, place[-1] + kept[-1]][end]
    letters = single[kept]
    dropped = np.flatnonzero(crc % np.uint32(every) == 0)
    if len(dropped):
        gone = start[dropped] + crc[dropped].astype(np.int64) % (end - start)[dropped]
        stays = np.ones(len(letters), bool)
        stays[gone] = False
        place = np.r_[0, np.cumsum(stays)]
        start, end, letters = place[start], place[end], letters[stays]
    return terms.as_array(letters, start, end)


def vocabulary(docs: DataFrame, least_length: int = 6, least_count: int = 5, every: int = 199) -> DataFrame:
    """word (Latin-1 bytes) and n: the distinct observed runs of at least ``least_length`` code points and ``least_count`` occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            data, offsets = base.flat(batch.column("t"))
            ids = ["" if x is None else str(x) for x in batch.column("doc_id").to_pylist()]
            for a, b in base.parts(offsets, PART_BYTES):
                runs = observed(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ids[a:b], every)
                runs = runs.filter(pa.array(np.diff(np.frombuffer(runs.buffers()[1], np.int64)[: len(runs) + 1]) >= least_length)) if len(runs) else runs
                for r in runs.value_counts().to_pylist():
                    held[r["values"]] = held.get(r["values"], 0) + r["counts"]
                if len(held) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])
                    held = {}
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])

    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("t"))
    return rows.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Index:
    """FM-index of words, read from their first letter on.

    Its text is every word backwards with a mark (0) behind, so a step of backward search reads a word's next letter. Suffixes
    are ordered up to their mark, equal ones by word. ``before`` holds the letter before each suffix (0: the suffix
    is a whole word), and ``steps`` its (letter, rank) pairs in order: the place of a pair in it is the step's new rank.
    """

    def __init__(self, words: list[bytes]) -> None:
        length = np.array([len(w) for w in words], np.int64)
        n = int(length.sum()) + len(words)
        text = np.frombuffer(b"".join(w[::-1] + b"\0" for w in words), np.uint8)
        mark = np.flatnonzero(text == 0)
        left = np.repeat(mark, length + 1) - np.arange(n)  # letters from here to the mark
        packed = np.zeros(n, np.uint64)
        for i in range(8):
            letter = np.zeros(n, np.uint64)
            letter[: n - i] = text[i:]
            letter[left <= i] = 0
            packed = (packed << np.uint64(8)) | letter
        order = np.argsort(packed, kind="stable")
        rank = self._ranks(packed[order], order)
        known = 8
        while known < int(length.max(initial=0)):
            # order by twice as many letters: the rank of what follows those known
            follow = np.zeros(n, np.int64)
            some = np.flatnonzero(left > known)
            follow[some] = rank[some + known] + 1
            key = rank * np.int64(n + 1) + follow
            order = np.argsort(key, kind="stable")
            rank = self._ranks(key[order], order)
            known *= 2
        self.n = n
        before = np.r_[np.uint8(0), text[:-1]][order]
        self.before = before
        step = before.astype(np.int64) * (n + 1) + np.arange(n)
        by_letter = np.argsort(before, kind="stable")
        self.steps = step[by_letter]
        owner = np.repeat(np.arange(len(words)), length + 1)
        self.word = owner[order[by_letter[: len(words)]]]  # words by the rank of their whole suffix
        self.words = len(words)

    @staticmethod
    def _ranks(sorted_key: np.ndarray, order: np.ndarray) -> np.ndarray:
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(np.r_[False, sorted_key[1:] != sorted_key[:-1]])
        return rank

    def step(self, lo: np.ndarray, hi: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals after reading one letter more (empty where no word goes on so)."""
        base_key = letter.astype(np.int64) * (self.n + 1)
        return np.searchsorted(self.steps, base_key + lo), np.searchsorted(self.steps, base_key + hi)

    def next_letters(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every way on from each interval: number of the interval, letter, and the interval it leads to."""
        both, inverse = np.unique(lo * np.int64(self.n + 1) + hi, return_inverse=True)
        lo, hi = both // (self.n + 1), both % (self.n + 1)
        owner = np.repeat(np.arange(len(lo)), hi - lo)
        pair = np.unique(owner * 256 + self.before[terms.gather(lo, hi - lo)])
        pair = pair[pair % 256 > 0]
        owner, letter = pair // 256, pair % 256
        to_lo, to_hi = self.step(lo[owner], hi[owner], letter)
        begin, end = np.searchsorted(owner, inverse, "left"), np.searchsorted(owner, inverse, "right")
        at = terms.gather(begin, end - begin)
        return np.repeat(np.arange(len(inverse)), end - begin), letter[at], to_lo[at], to_hi[at]

    def ends(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The word that ends at each interval: number of the interval, word."""
        a, b = np.searchsorted(self.steps, lo), np.searchsorted(self.steps, hi)
        a, b = np.minimum(a, self.words), np.minimum(b, self.words)
        hit = np.flatnonzero(b > a)
        return hit, self.word[a[hit]]

    def one_error(self, words: list[bytes], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (looked-up word, indexed word) one edit apart whose first ``exact`` letters agree.

        The first letters are read exactly; from there on, every interval without error branches once: into another letter (replaced),
        into a letter more (inserted), or over a letter (deleted), and reads the rest exactly.
        """
        found: list[tuple[np.ndarray, np.ndarray]] = []
        order = sorted(range(len(words)), key=words.__getitem__)  # neighbours share intervals
        for a in range(0, len(order), TOGETHER):
            some = np.array(order[a : a + TOGETHER])
            length = np.array([len(words[i]) for i in some])
            width = int(length.max(initial=0)) + 1
            letters = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in some), np.uint8).reshape(len(some), width)
            start = exact[some]
            who = np.arange(len(some))
            lo, hi = np.zeros(len(some), np.int64), np.full(len(some), self.words, np.int64)  # suffixes that are the mark alone
            erring: tuple[np.ndarray, ...] = (np.zeros(0, np.int64),) * 3
            for at in range(width):
                going = at <= length[who]
                who, lo, hi = who[going], lo[going], hi[going]
                # states with one error whose word is read to its end are done
                over = length[erring[0]] == at
                hit, word = self.ends(erring[1][over], erring[2][over])
                found.append((some[erring[0][over][hit]], word))
                erring = tuple(x[~over] for x in erring)
                branch = start[who] <= at
                b_who, b_lo, b_hi = who[branch], lo[branch], hi[branch]
                own = letters[b_who, at]
                number, letter, to_lo, to_hi = self.next_letters(b_lo, b_hi)
                other = letter != own[number]
                number, to_lo, to_hi = number[other], to_lo[other], to_hi[other]
                inserted = (b_who[number], to_lo, to_hi)  # the word's own letter is still to be read
                inner = at < length[b_who[number]]
                replaced = (b_who[number][inner], to_lo[inner], to_hi[inner])
                inside = at < length[b_who]
                deleted = (b_who[inside], b_lo[inside], b_hi[inside])
                ready = tuple(np.concatenate(x) for x in zip(erring, inserted))
                over = length[ready[0]] == at
                hit, word = self.ends(ready[1][over], ready[2][over])
                found.append((some[ready[0][over][hit]], word))
                ready = tuple(x[~over] for x in ready)
                e_lo, e_hi = self.step(ready[1], ready[2], letters[ready[0], at])
                alive = e_hi > e_lo
                erring = tuple(np.concatenate(x) for x in zip((ready[0][alive], e_lo[alive], e_hi[alive]), replaced, deleted))
                inside = at < length[who]
                who, lo, hi = who[inside], lo[inside], hi[inside]
                lo, hi = self.step(lo, hi, letters[who, at])
                alive = hi > lo
                who, lo, hi = who[alive], lo[alive], hi[alive]
        pairs = np.unique(np.concatenate([w * np.int64(max(1, self.words)) + v for w, v in found])) if found else np.zeros(0, np.int64)
        return pairs // max(1, self.words), pairs % max(1, self.words)


def near_words(targets: list[bytes], words: list[bytes], forwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (word, target) one edit apart, by one of the two schemes: the first half exact and the error after it, read forwards;
    or the second half exact and the error before it, read backwards."""
    half = np.array([len(w) // 2 for w in words], np.int64)
    if forwards:
        return Index(targets).one_error(words, half)
    return Index([t[::-1] for t in targets]).one_error([w[::-1] for w in words], np.array([len(w) for w in words], np.int64) - half)


def near_pairs(known: DataFrame, words_together: int = 50_000) -> DataFrame:
    """word, near, near_n: every pair of words (Latin-1 bytes, at least six) one inserted, deleted or replaced letter apart.

    Words are filed under their first and under their last three letters; by each scheme a word's near words share one of them.
    A group of such files holds about ``words_together`` words. Larger groups (a hot beginning or ending) are cut, and every piece
    of words is looked up in an index of every piece, so no task gets more than a piece of both.
    """
    total = known.count()
    groups = max(1, -(-total // words_together))
    filed = known.select("word", "n", F.explode(F.array(
        F.struct(F.lit(1).alias("side"), F.expr(f"substring(word, 1, {SIDE})").alias("key")),
        F.struct(F.lit(0).alias("side"), F.expr(f"substring(word, length(word) - {SIDE - 1}, {SIDE})").alias("key")))).alias("f")).select("word", "n", "f.side", F.pmod(F.xxhash64("f.key"), F.lit(groups)).cast("int").alias("part"))
    sizes = filed.groupBy("side", "part").agg(F.ceil(F.count(F.lit(1)) / F.lit(2 * words_together)).cast("int").alias("pieces"))  # one row for each group: at most two a group
    cut = filed.join(F.broadcast(sizes), ["side", "part"]).withColumn("piece", F.pmod(F.xxhash64("word", F.lit(1)), F.col("pieces")).cast("int"))
    role = cut.select("side", "part", "word", "n", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda other: F.array(
        F.struct(F.lit(0).alias("role"), other.alias("looked"), F.col("piece").alias("indexed")),
        F.struct(F.lit(1).alias("role"), F.col("piece").alias("looked"), other.alias("indexed")))))).alias("r")).select("side", "part", "word", "n", "r.role", "r.looked", "r.indexed")

    def look(group: pa.Table) -> pa.Table:
        target = group.filter(pa.compute.equal(group.column("role"), 0))
        targets, counts = target.column("word").to_pylist(), target.column("n").to_numpy()
        words = group.filter(pa.compute.equal(group.column("role"), 1)).column("word").to_pylist()
        if not targets or not words:
            return pa.table({"word": pa.array([], pa.binary()), "near": pa.array([], pa.binary()), "near_n": pa.array([], pa.int64())})
        a, b = near_words(targets, words, group.column("side")[0].as_py() == 1)
        return pa.table({"word": pa.array(words, pa.binary()).take(pa.array(a)), "near": pa.array(targets, pa.binary()).take(pa.array(b)), "near_n": pa.array(counts[b], pa.int64())})

    return role.groupBy("side", "part", "looked", "indexed").applyInArrow(look, "word binary, near binary, near_n long").distinct()


def variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, every: int = 199, times: int = 5, words_together: int = 50_000) -> DataFrame:
    """Words of the texts, the likely form of each misspelt one, and the root of its chain of forms.

    Runs of A-Z, a-z and U+00C0 to U+00FF are words, only A-Z lower-cased; where ``every`` divides the crc32 of
    "doc_id:run" the run loses one letter (planted misspellings). Words with at least ``least_length`` letters and ``least_count``
    occurrences are kept. Returns word, form, root, n, n_near, form_n: form is the near word (one edit) of largest n,
    ties to the smaller in code-point order, if that is at least ``times`` the word's n.

    Null and empty texts have no words; a row without doc_id counts with an empty id; repeated rows count each; other columns are
    ignored; an empty table gives an empty result.
    """
    known = base.stage(vocabulary(docs, least_length, least_count, every))
    near = near_pairs(known, words_together).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w"))).alias("best"))
    joined = known.join(near, "word", "left")
    has_form = F.coalesce(-F.col("best.n") >= F.lit(times) * F.col("n"), F.lit(False))
    found = base.stage(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has_form, F.col("best.w")).alias("form"), F.when(has_form, -F.col("best.n")).alias("form_n")))
    # counts grow at least ``times``-fold along a chain, so chains are short; each round doubles the way already gone
    roots = found.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        roots = base.stage(roots)
        onwards = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if roots.join(onwards, "root", "left_semi").isEmpty():
            break
        roots = roots.join(onwards, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    text = lambda c: F.decode(F.col(c), "ISO-8859-1")
    return found.join(roots, "word", "left").select(
        text("word").alias("word"), text("form").alias("form"), F.coalesce(text("root"), text("word")).alias("root"), "n", "n_near", "form_n")

"""Ranked lexical search: range-maximum tables on posting lists, and document intervals taken best first."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import base, terms

#: Bytes of terms: ASCII digits and letters, and all bytes of other characters.
TERM_BYTE = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
PART_BYTES = 1 << 21
#: Postings of the documents that are searched together.
BLOCK_POSTINGS = 1_000_000
#: An interval of at most so many documents is scored instead of being split.
LEAF = 64
#: Intervals taken from the queue together.
TAKEN = 64
#: Stands for a document without doc_id: it comes after all others of its score.
NO_ID = np.iinfo(np.int64).max


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Postings:
    """Posting lists of a block of documents, ordered by doc_id, with one sparse table of range maxima.

    The lists lie end to end, ordered by (term, document); a range asked for never leaves its list, so one table over all
    of them is a table for each. Entry (k, i) is the place of the largest of the 2^k impacts from i on.
    """

    def __init__(self, ids: np.ndarray, m: np.ndarray, term: np.ndarray, doc: np.ndarray, tf: np.ndarray) -> None:
        by_id = np.argsort(ids, kind="stable")
        self.ids, m = ids[by_id], m[by_id]
        place = np.empty(len(ids), np.int64)
        place[by_id] = np.arange(len(ids))
        key = term * np.int64(len(ids)) + place[doc]
        order = np.argsort(key, kind="stable")
        self.key, self.doc, tf = key[order], place[doc][order], tf[order]
        self.impact = ((10**9 * tf) // (1000 * tf + 20 * m[self.doc])).astype(np.int32)
        longest = int(np.bincount(term).max()) if len(term) else 1
        levels = [np.arange(len(order), dtype=np.int32)]
        while 2 << (len(levels) - 1) <= longest:
            half = 1 << (len(levels) - 1)
            a, b = levels[-1][:-half], levels[-1][half:]
            best = np.where(self.impact[a] >= self.impact[b], a, b)
            levels.append(np.r_[best, levels[-1][len(best) :]])
        self.table = np.stack(levels)
        self.log = np.r_[0, np.floor(np.log2(np.arange(1, longest + 1))).astype(np.int64)]

    def place(self, term: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """First place of each term's list that is not before the document: (documents, terms)."""
        return np.searchsorted(self.key, term[None, :] * np.int64(len(self.ids)) + doc[:, None])

    def largest(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and impact of the range maxima (empty range: impact 0)."""
        some = hi > lo
        level = self.log[np.where(some, hi - lo, 1)]
        a = self.table[level, np.where(some, lo, 0)]
        b = self.table[level, np.where(some, hi - (1 << level), 0)]
        best = np.where(self.impact[a] >= self.impact[b], a, b)
        return best, np.where(some, self.impact[best], 0).astype(np.int64)


class Best:
    """The k best documents of an item so far: largest score first, then smallest id."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.scores = self.ids = np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        use = scores > 0
        if len(self.scores) == self.k:
            use &= scores >= self.scores[-1]
        if use.any():
            scores, ids = np.r_[self.scores, scores[use]], np.r_[self.ids, ids[use]]
            order = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[order], ids[order]

    def beyond(self, bound: int, least_id: int) -> bool:
        """Whether documents of at most this score and at least this id cannot enter any more."""
        if bound <= 0:
            return True
        if len(self.scores) < self.k:
            return False
        return bound < self.scores[-1] or (bound == self.scores[-1] and least_id > self.ids[-1])


def search_block(p: Postings, term: np.ndarray, weight: np.ndarray, best: Best) -> None:
    """Bring the block's best documents for one item into ``best``.

    The queue holds disjoint document intervals by the sum of their terms' range maxima, an upper bound of every score inside.
    The largest are taken: a short one is scored whole; of a longer one the document of the largest single impact is scored
    and the interval is split around it. What remains below the k-th score is never looked at.
    """
    if not len(p.key) or not len(term):
        return
    n = len(p.ids)
    ends = p.place(term, np.array([0, n]))
    _, impact = p.largest(ends[:1], ends[1:])
    queue = [(-int((impact * weight).sum()), 0, n)]
    while queue:
        taken = []
        while queue and len(taken) < TAKEN:
            bound, a, b = heapq.heappop(queue)
            if not best.beyond(-bound, p.ids[a]):
                taken.append((a, b))
            elif -bound < (best.scores[-1] if len(best.scores) == best.k else 1):
                queue = []
        if not taken:
            break
        a, b = np.array(taken, np.int64).T
        lo, hi = p.place(term, a), p.place(term, b)
        short = b - a <= LEAF
        if short.any():
            length = (hi - lo)[short].ravel()
            at = terms.gather(lo[short].ravel(), length)
            value = np.repeat(np.tile(weight, int(short.sum())), length) * p.impact[at]
            total = np.bincount(p.doc[at], value, minlength=n).astype(np.int64)  # sums below 2^53 are exact
            found = np.flatnonzero(total)
            best.add(total[found], p.ids[found])
        if short.all():
            continue
        a, b, lo, hi = a[~short], b[~short], lo[~short], hi[~short]
        place, impact = p.largest(lo, hi)
        strongest = np.argmax(impact * weight, axis=1)
        middle = p.doc[place[np.arange(len(a)), strongest]]
        at = p.place(term, middle)
        safe = np.minimum(at, len(p.key) - 1)
        hit = (at < len(p.key)) & (p.key[safe] == term[None, :] * np.int64(n) + middle[:, None])
        best.add((np.where(hit, p.impact[safe], 0) * weight).sum(axis=1), p.ids[middle])
        for x, y, left, right in ((a, middle, lo, at), (middle + 1, b, at + hit, hi)):
            bounds = (p.largest(left, right)[1] * weight).sum(axis=1)
            for bound, i, j in zip(bounds.tolist(), x.tolist(), y.tolist()):
                if j > i and not best.beyond(bound, p.ids[i]):
                    heapq.heappush(queue, (-bound, i, j))


def term_counts(docs: DataFrame, wanted: list[bytes]) -> DataFrame:
    """doc_id, n (terms of the whole text, with repeats), and the wanted terms met (numbers) with their counts; documents without any term are left out."""
    known = pa.array(wanted, pa.large_binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = base.flat(batch.column("t"))
            for a, b in base.parts(offsets, PART_BYTES):
                part, ends = terms.lowered(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a]
                start, end, row = terms.runs(TERM_BYTE[part], ends)
                n = np.bincount(row, minlength=b - a)
                number = pc.fill_null(pc.index_in(terms.as_array(part, start, end), value_set=known), -1).to_numpy(zero_copy_only=False)
                met = number >= 0
                pair, tf = np.unique(row[met] * np.int64(max(1, len(wanted))) + number[met], return_counts=True)
                kept = np.flatnonzero(n)
                of = pair // max(1, len(wanted))
                bounds = pa.array(np.r_[np.searchsorted(of, kept), len(of)].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(a + kept)), pa.array(n[kept].astype(np.int64)),
                     pa.ListArray.from_arrays(bounds, pa.array((pair % max(1, len(wanted))).astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(tf.astype(np.int32)))],
                    ["doc_id", "n", "terms", "tf"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("t"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


def _search(index: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): the best k documents of every task, block by block; later blocks start at the k-th score so far."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, postings = [], 0
        for batch in batches:
            held.append(batch)
            postings += len(batch.column("terms").flatten())
            if postings >= BLOCK_POSTINGS:
                yield pa.Table.from_batches(held)
                held, postings = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items]
        for block in blocks(batches):
            block = block.combine_chunks()
            ids = pc.fill_null(block.column("doc_id"), NO_ID).to_numpy()
            lists = block.column("terms").combine_chunks()
            doc = np.repeat(np.arange(len(ids)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            term = lists.flatten().to_numpy().astype(np.int64)
            tf = block.column("tf").combine_chunks().flatten().to_numpy().astype(np.int64)
            p = Postings(ids, 50 + (50 * block.column("n").to_numpy() * n_docs) // n_terms, term, doc, tf)
            present = np.unique(term)
            for (some, weight), found in zip(items, best):
                use = np.isin(some, present, assume_unique=True)
                search_block(p, some[use], weight[use], found)
        for i, found in enumerate(best):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(found.ids), i, np.int32)), pa.array(found.ids, mask=found.ids == NO_ID), pa.array(found.scores)], ["item", "doc_id", "score"])

    return index.mapInArrow(run, "item int, doc_id long, score long")


def item_terms(text: str | Column) -> Column:
    """Distinct terms of a text (null: none)."""
    column = F.col(text) if isinstance(text, str) else text
    lower = F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.coalesce(F.regexp_extract_all(lower, F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), F.lit(1)), F.array().cast("array<string>")))


def search(docs: DataFrame, items: DataFrame, k: int = 50, items_together: int = 2000) -> DataFrame:
    """The ``k`` best documents of every item: item_id, rank, doc_id, score.

    Terms are runs of ASCII digits and letters and of characters beyond ASCII, only A-Z lower-cased. Statistics are of all
    documents. Documents are never shuffled: each task keeps the posting lists of its own documents a block at a time,
    and only ``k`` rows an item leave it. Items are searched ``items_together`` at a time, each time in one pass over
    the documents, so what goes to the tasks is bounded.

    Rows with the same item_id are one item with all their terms; an item without terms, or whose terms no document has, gets no
    row. Repeated documents are ranked each; a document without doc_id counts like any other and comes after others
    of its score. Null and empty texts have no terms. Other columns are ignored; empty tables give an empty result.
    """
    spark = docs.sparkSession
    wanted = base.stage(items.select("item_id", F.explode(item_terms(F.col("text").cast("string"))).alias("term")).distinct())
    n_items = wanted.select("item_id").distinct().count()
    groups = -(-n_items // items_together)
    kind = dict(items.dtypes)["item_id"]
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for group in range(groups):
        rows = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == group).collect()
        names = sorted({r.item_id for r in rows}, key=lambda x: (x is None, x))
        known = sorted({r.term.encode() for r in rows})
        number = {t: i for i, t in enumerate(known)}
        index = base.stage(term_counts(docs, known))
        n_docs, n_terms = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = {r.term: r.df for r in index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
        place = {x: i for i, x in enumerate(names)}
        of: list[list[int]] = [[] for _ in names]
        for r in rows:
            t = number[r.term.encode()]
            if t in df:
                of[place[r.item_id]].append(t)
        found = [np.array(sorted(x), np.int64) for x in of]
        weighted = [(x, np.array([term_weight(n_docs, df[t]) for t in x.tolist()], np.int64)) for x in found]
        ranked = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        top = _search(index, weighted, n_docs, max(1, n_terms), k).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
        listed = F.broadcast(spark.createDataFrame([(i, x) for i, x in enumerate(names)], f"item int, item_id {kind}"))
        out = out.unionAll(top.join(listed, "item").select("item_id", "rank", "doc_id", "score"))
    return out

"""Document fingerprints: bottom-k sketches of shingle hashes that can be merged and compared."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import base, terms
from tidemark.llm.hashing import Hashes

#: Words of a shingle; a text of fewer words is one shingle.
WORDS = 5
#: Hashes a sketch keeps.
K = 128
#: Hashes have 48 bits: enough to count some 10^13 distinct shingles, and six bytes each.
HASH_BITS = 48
PART_BYTES = 1 << 21
WORD_BYTE = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every shingle of the texts: words between ASCII white space, A-Z lower-cased, joined by one space."""
    start, end, row = terms.runs(WORD_BYTE[data], offsets)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    length = end - start + 1  # each word with a space behind
    flat = np.full(int(length.sum()), 0x20, np.uint8)
    first = np.cumsum(length) - length
    flat[terms.gather(first, length - 1)] = terms.lowered(data)[terms.gather(start, length - 1)]
    known, begin, count = np.unique(row, return_index=True, return_counts=True)
    shingles = np.maximum(count - words + 1, 1)
    at = terms.gather(begin, shingles)
    last = np.minimum(at + words, np.repeat(begin + count, shingles)) - 1
    return Hashes(flat).of(first[at], first[last] + length[last] - 1) >> np.uint64(64 - HASH_BITS), np.repeat(known, shingles)


def bottom(hashes: np.ndarray, row: np.ndarray, rows: int, k: int = K) -> list[np.ndarray]:
    """The k smallest distinct hashes of every row, rising."""
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.r_[True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])] if len(row) else np.zeros(0, bool)
    hashes, row = hashes[new], row[new]
    bounds = np.searchsorted(row, np.arange(rows + 1))
    return [hashes[a : min(b, a + k)] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def sketches(texts: list[bytes], words: int = WORDS, k: int = K) -> list[np.ndarray]:
    """Sketches of UTF-8 texts; long texts are taken by themselves, so memory stays that of one text."""
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    out = []
    for a, b in base.parts(offsets, PART_BYTES):
        out += bottom(*shingle_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words), b - a, k)
    return out


def pack(sketch: np.ndarray) -> str:
    """A sketch as text: base64 of its hashes, six bytes each, rising; nothing for a text without words."""
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - HASH_BITS // 8 :].tobytes()).decode()


def unpack(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, HASH_BITS // 8)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 8 - HASH_BITS // 8 :] = raw
    return wide.view(">u8").ravel().astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of both texts' shingles together."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of the shingles of either text that both have, as met among the k smallest of both (two empty sketches: 1)."""
    both = merge(a, b, k)
    if not len(both):
        return 1.0
    return float(np.isin(both, a, assume_unique=True).__and__(np.isin(both, b, assume_unique=True)).sum()) / len(both)


def distinct(sketch: np.ndarray, k: int = K) -> float:
    """Number of distinct shingles: exact below k, estimated from the k-th smallest hash otherwise."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) / ((float(sketch[k - 1]) + 1) / 2.0**HASH_BITS)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of the first text's shingles that the second has: the resemblance times the union over the first (empty first: 1)."""
    if not len(a):
        return 1.0
    if len(a) < k and len(b) < k:
        return float(np.isin(a, b, assume_unique=True).sum()) / len(a)
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def fingerprints(docs: DataFrame, words: int = WORDS, k: int = K, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, fingerprint (text) and distinct_shingles of every whole text (null: empty). No shuffle."""
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col("text").cast("string").alias("t"))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sketches([(x or "").encode() for x in batch.column("t").to_pylist()], words, k)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array([pack(x) for x in found], pa.string()), pa.array([distinct(x, k) for x in found], pa.float64())], [*names, "fingerprint", "distinct_shingles"])

    got = rows.mapInArrow(run, ", ".join([*[f"{n} {kinds[n]}" for n in names], "fingerprint string, distinct_shingles double"]))
    return got.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "fingerprint", "distinct_shingles")


def merged(prints: DataFrame, by: str, k: int = K) -> DataFrame:
    """``by`` and the fingerprint of all its rows' shingles together, with their estimated distinct number.

    Merged in the map tasks first (at most one sketch a task and key is shuffled), so a hot key sends no more than others.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(prints.schema[by].dataType)

    def listed(held: dict[object, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), kind), pa.array([pack(x) for x in held.values()], pa.string()), pa.array([distinct(x, k) for x in held.values()], pa.float64())], ["key", "fingerprint", "distinct_shingles"])

    def in_the_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, np.ndarray] = {}
        for batch in batches:
            for key, x in zip(batch.column("key").to_pylist(), batch.column("fingerprint").to_pylist()):
                held[key] = merge(held.get(key, np.zeros(0, np.uint64)), unpack(x or ""), k)
            if len(held) > 20_000:
                yield listed(held)
                held = {}
        yield listed(held)

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, np.ndarray] = {}
        for batch in batches:
            for key, x in zip(batch.column("key").to_pylist(), batch.column("fingerprint").to_pylist()):
                if key not in held and len(held) > 1000:  # the keys before this one are complete
                    yield listed(held)
                    held = {}
                held[key] = merge(held.get(key, np.zeros(0, np.uint64)), unpack(x), k)
        yield listed(held)

    shape = f"key {dict(prints.dtypes)[by]}, fingerprint string, distinct_shingles double"
    partial = prints.select(F.col(by).alias("key"), "fingerprint").mapInArrow(in_the_task, shape).select("key", "fingerprint")
    whole = partial.repartition("key").sortWithinPartitions("key").mapInArrow(in_order, shape)
    return whole.select(F.col("key").alias(by), "fingerprint", "distinct_shingles")


def edited_texts(docs: DataFrame, words: int = WORDS, k: int = K, rows_together: int = 4000, most_blocks: int = 2000) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they are.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document, by falling doc_id (after the last: the first). Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited (resemblance to the edited text's fingerprint), near_next (to the next document's) and
    distinct_shingles.

    Documents go once over the network, to blocks of neighbouring ids; the first document of a block is also sent to the block
    before it, so that every document meets its next one in one ordered pass that holds one document at a time.
    Null texts are empty; rows without doc_id come last, rows of the same doc_id stand in the order of their text's
    hash (all rows of one doc_id, or of none, are in one block). There are at most ``most_blocks`` blocks, each sorted
    by Spark with spilling: raise it with the cluster. An empty table gives an empty result, and
    a single document is its own next. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    n = rows.count()
    blocks = min(most_blocks, -(-n // rows_together))
    cuts = []
    if blocks > 1:
        share = [i / blocks for i in range(1, blocks)]
        cuts = sorted(set(rows.agg(F.percentile_approx("doc_id", share, 20 * blocks)).first()[0] or []))
    # ids fall, so an id's block is the number of cuts that are not below it
    cut_list = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    last = len(cuts) + 1

    def block_of(column: Column) -> Column:
        return F.when(column.isNull(), F.lit(last)).otherwise(F.size(F.filter(cut_list, lambda c: c >= column))).cast("int")

    keyed = rows.withColumn("h", F.xxhash64("t")).withColumn("block", block_of(F.col("doc_id")))
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not(F.coalesce(F.col("doc_id"), F.lit(0).cast("long"))).alias("falling"), "h")
    heads = keyed.groupBy("block").agg(F.min(first).alias("head"), F.count(F.lit(1)).alias("n"))
    # block table: one row a block; the block before a block is the nearest one with rows, before the first the last
    listed = sorted(heads.collect(), key=lambda r: r.block)
    if not listed:
        return _edited(keyed.withColumn("order", F.lit(0)), words, k)
    before = [(r.block, listed[i - 1].block, ~r.head.falling if not r.head.none else None, r.head.h) for i, r in enumerate(listed)]
    spark = docs.sparkSession
    borrowed = F.broadcast(spark.createDataFrame(before, "head_block int, to_block int, head_id long, head_h long"))
    extra = keyed.join(borrowed, (F.col("block") == F.col("head_block")) & F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("h") == F.col("head_h")))
    one = Window.partitionBy("to_block").orderBy("t")
    extra = extra.withColumn("copy", F.row_number().over(one)).where("copy = 1").select("doc_id", "t", "h", F.col("to_block").alias("block"), F.lit(1).alias("order"))
    return _edited(keyed.withColumn("order", F.lit(0)).select("doc_id", "t", "h", "block", "order").unionAll(extra), words, k)


def _edited(rows: DataFrame, words: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # (block, order, doc_id, text, its sketch)
        out: list[list] = [[] for _ in range(8)]
        for batch in batches:
            texts = batch.column("t").to_pylist()
            own = sketches([t.encode() for t in texts], words, k)
            here = list(zip(batch.column("block").to_pylist(), batch.column("order").to_pylist(), batch.column("doc_id").to_pylist(), texts, own))
            pairs = []
            for nxt in here:
                if held is not None and held[0] == nxt[0] and held[1] == 0:
                    n = len(held[3])
                    pairs.append((held, nxt, held[3][: n - n // 2] + nxt[3][: n // 2]))
                held = nxt
            raw = [e.encode() for _, _, e in pairs]
            for (doc, nxt, _), b, sketch in zip(pairs, raw, sketches(raw, words, k)):
                row = (doc[2], len(doc[3]), hashlib.sha256(b).hexdigest(), pack(doc[4]), pack(sketch), resemblance(doc[4], sketch, k), resemblance(doc[4], nxt[4], k), distinct(doc[4], k))
                for column, x in zip(out, row):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, shape)], schema=shape)
            out = [[] for _ in range(8)]

    shape = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                       ("near_edited", pa.float64()), ("near_next", pa.float64()), ("distinct_shingles", pa.float64())])
    sorted_rows = rows.repartition("block").sortWithinPartitions("block", "order", F.col("doc_id").desc_nulls_last(), "h", "t")
    return sorted_rows.select("block", "order", "doc_id", "t").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, distinct_shingles double")

"""SimHash near-duplicates: pigeonhole blocks propose, Hamming distance decides."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import base
from tidemark.llm.components import components

BITS = 64
SEED = 42
#: Shingles whose bits are counted at once.
COUNT_ROWS = 1 << 14


def fingerprint(text: bytes, words: int = 3) -> int:
    """Majority bits of the shingle hashes of one text: lower-cased ASCII, words between ASCII white space; none: 0."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = list(accumulate(map(len, parts)))
    last = [e + i for i, e in enumerate(ends)]  # with the spaces before
    first = [0, *(e + 1 for e in last)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first, last[words - 1 :])], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), COUNT_ROWS):
        ones += np.unpackbits(hashes[a : a + COUNT_ROWS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and fp (the fingerprint as a signed long) of every row; a null text has no words."""
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col("text").cast("string").alias("t"))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = base.flat(batch.column("t"))
            found = np.array([fingerprint(data[a:b].tobytes(), words) for a, b in zip(offsets, offsets[1:])], np.uint64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(found.view(np.int64))], [*names, "fp"])

    out = rows.mapInArrow(run, ", ".join([*[f"{n} {kinds[n]}" for n in names], "fp long"]))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "fp")


def block_keys(fp: Column, blocks: int, shared: int) -> Column:
    """One (which, bits) per choice of ``shared`` of the ``blocks`` equal parts of a fingerprint."""
    width = BITS // blocks
    keys = []
    for which, chosen in enumerate(combinations(range(blocks), shared)):
        mask = sum(((1 << width) - 1) << (width * b) for b in chosen)
        keys.append(F.struct(F.lit(which).alias("which"), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("bits")))
    return F.explode(F.array(*keys))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(classes: DataFrame, distance: int = 2, blocks: int = 4, hot_rows: int = 64) -> DataFrame:
    """Links (a, b) between the ids of distinct fingerprints (fp, id) that connect every pair within ``distance``.

    Two fingerprints within d bits share at least ``blocks`` - d whole blocks, so they meet under some choice of that many;
    rows that meet are compared. The fingerprints of a block value with more than ``hot_rows`` of them are not compared
    all with all: each is filed under itself and under all values one bit from it. Two within 2 bits share
    a value, and all rows under one value (65 at most) are within 2 bits of each other, so a star per value keeps every
    connection.
    """
    if distance != 2:
        raise ValueError("links are built for two differing bits")
    keyed = base.stage(classes.select("fp", "id", block_keys(F.col("fp"), blocks, blocks - distance).alias("key")).select("fp", "id", "key.which", "key.bits"))
    crowded = base.stage(keyed.groupBy("which", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("which", "bits", (F.col("n") > hot_rows).alias("hot")))
    met = keyed.join(crowded, ["which", "bits"])
    cold = met.where("not hot")
    left, right = cold.select("which", "bits", F.col("fp").alias("fp_a"), F.col("id").alias("a")), cold.select("which", "bits", F.col("fp").alias("fp_b"), F.col("id").alias("b"))
    pair = [left.which == right.which, left.bits == right.bits, left.fp_a < right.fp_b, hamming(left.fp_a, right.fp_b) <= distance]
    compared = left.join(right, pair).select("a", "b")
    # the value itself and its 64 neighbours
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i).cast("long") for i in range(BITS)])
    filed = (
        met.where("hot").select("fp", "id").distinct()
        .select("id", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("value"))
    )
    stars = filed.groupBy("value").agg(F.min("id").alias("a"), F.collect_list("id").alias("ids")).where("size(ids) > 1").select("a", F.explode("ids").alias("b")).where("a != b")
    return compared.unionAll(stars).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 2, blocks: int = 4, hot_rows: int = 64, keep: tuple[str, ...] = ()) -> DataFrame:
    """Fingerprint and component of every document.

    Input columns: doc_id, text; others are ignored, except those named in ``keep`` (carried along). Returns doc_id,
    fingerprint (16 hex digits) and component_id: the smallest doc_id reachable over links of at most ``distance``
    differing bits, the document's own included. Equal texts collapse to one fingerprint before anything is joined.
    Null or empty texts have fingerprint zero and are linked like any other. A row without doc_id keeps its
    fingerprint, belongs to the component of the others with that fingerprint, and is no node itself (component null if
    there are no others). Repeated rows are returned each; an empty table gives an empty result.
    """
    marked = base.stage(fingerprints(docs, words, ("doc_id", *keep)).withColumn("doc_id", F.col("doc_id").cast("long")))
    classes = base.stage(marked.groupBy("fp").agg(F.min("doc_id").alias("id")))
    roots = components(links(classes.where("id is not null"), distance, blocks, hot_rows))
    named = classes.join(roots, classes.id == roots.node, "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", *keep)


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One row of each component, unchanged: the one of smallest doc_id (then of smallest text hash)."""
    last = F.lit((1 << 63) - 1)
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    found = near_duplicates(docs.select("doc_id", "text", text.alias("sum")), keep=("sum",), **options)
    group = F.coalesce(F.col("component_id").cast("string"), F.col("fingerprint"))
    kept = base.stage(found.groupBy(group.alias("g")).agg(F.min(F.struct(F.coalesce("doc_id", last).alias("id__"), F.col("sum").alias("sum__"))).alias("k")).select("k.*"))
    keyed = docs.select("*", F.coalesce(F.col("doc_id").cast("long"), last).alias("id__"), text.alias("sum__"))
    out = keyed.join(kept, ["id__", "sum__"], "left_semi")
    if found.groupBy("doc_id", "sum").count().where("count > 1").head(1):  # rows that repeat both doc_id and text
        out = out.dropDuplicates(["id__", "sum__"])
    return out.select(*docs.columns)

"""Suffix-array dedup: bytes covered by a string of a given length that starts earlier in the corpus are removed."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import base
from tidemark.llm.hashing import MULTIPLIER, Hashes, mixed
from tidemark.llm.repeats import classes

#: Bytes of the gram by which a string is filed; a string's anchor is its gram of least hash, the leftmost if several.
GRAM = 24
#: Bytes of text looked at together in one task.
PART_BYTES = 1 << 20
#: Text bytes whose anchors meet in one bucket; segment bytes that are sorted together.
ANCHOR_BUCKET_BYTES = 32 << 20
SEGMENT_BUCKET_BYTES = 1 << 20
#: An anchor in more than this share of the sampled anchors is spread over its strings.
HOT_SHARE = 1 / 20_000
#: A known anchor with more different segments than this is filed again by longer grams, and beyond the second number, as one
#: line may be in all of them, spread over its strings as well.
WIDE_SEGMENTS, WIDEST_SEGMENTS = 2000, 50_000
#: Bytes that a task gathers before it deals them out to buckets, so that the pieces of a bucket do not get smaller as buckets get more.
GATHERED_BYTES = 8 << 20

ANCHOR = np.dtype([("key", "<u8"), ("seg", "<u8"), ("doc", "<i8"), ("sum", "<i8"), ("first", "<i4"), ("last", "<i4")])
SPAN = np.dtype([("doc", "<i8"), ("sum", "<i8"), ("first", "<i4"), ("last", "<i4")])

def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[: len(x) - done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def least_grams(hashes: Hashes, width: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the grams of ``width`` bytes, and for each string of ``length`` bytes the place of its gram of least hash."""
    gram = hashes.grams(width)
    packed = (gram >> np.uint64(32) << np.uint64(32)) | np.arange(len(gram), dtype=np.uint64)
    return gram, (sliding_least(packed, length - width + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[Hashes | None, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring strings with one anchor: (row, first start, last start, hash of the anchor's gram).

    Starts are places in ``data``. Every string of ``length`` bytes inside a row is in exactly one run, and equal strings have
    anchors of equal grams at equal places in them.
    """
    nothing = np.zeros(0, np.int64)
    sizes = np.diff(offsets)
    if len(data) < length or not (sizes >= length).any():
        return None, nothing, nothing, nothing, np.zeros(0, np.uint64)
    hashes = Hashes(data)
    gram, anchor = least_grams(hashes, GRAM, length)
    row = np.repeat(np.arange(len(sizes)), sizes)[: len(anchor)]
    whole = np.arange(len(anchor)) + length <= offsets[1:][row]
    start = np.flatnonzero(whole)
    cut = np.ones(len(start), bool)
    cut[1:] = (np.diff(start) > 1) | (np.diff(anchor[start]) != 0) | (np.diff(row[start]) != 0)
    at = np.flatnonzero(cut)
    first, last = start[at], start[np.r_[at[1:], len(start)] - 1]
    return hashes, row[first], first, last, gram[anchor[first]]


def long_gram(length: int) -> int:
    """Bytes of the gram by which the strings of a wide anchor are filed: half-way from the anchor's to the string."""
    return (GRAM + length) // 2


def by_long_gram(hashes: Hashes, row: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs cut where the strings' longer gram of least hash changes: row, first, last and that gram's hash. Equal strings have equal ones."""
    gram, least = least_grams(hashes, long_gram(length), length)
    n = last - first + 1
    ends = np.cumsum(n)
    start = np.arange(ends[-1]) + np.repeat(first - (ends - n), n)
    cut = np.zeros(len(start), bool)
    cut[ends - n] = True
    at = least[start]
    cut[1:] |= at[1:] != at[:-1]
    head = np.flatnonzero(cut)
    return np.repeat(row, n)[head], start[head], start[np.r_[head[1:], len(start)] - 1], gram[at[head]]


def each_string(hashes: Hashes, row: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The strings of runs one by one: row, start, and two hashes of the whole string."""
    n = last - first + 1
    ends = np.cumsum(n)
    start = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - n), n)
    half = length // 2
    a, b = hashes.of(start, start + half), hashes.of(start + half, start + length)
    return np.repeat(row, n), start, mixed(a * np.uint64(3) + b), mixed(a ^ (b * np.uint64(MULTIPLIER)))


def earliest(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows sorted by key and segment, and True at the first (by document, then place) of equal ones.

    A place that comes more than once, from rows that are one document, counts once.
    """
    found = found[np.lexsort((found["first"], found["sum"], found["doc"], found["seg"], found["key"]))]
    if len(found):
        found = found[np.r_[True, np.any([found[c][1:] != found[c][:-1] for c in ("key", "seg", "doc", "sum", "first")], axis=0)]]
    head = np.ones(len(found), bool)
    head[1:] = (found["key"][1:] != found["key"][:-1]) | (found["seg"][1:] != found["seg"][:-1])
    return found, head


def joined(spans: np.ndarray) -> np.ndarray:
    """Runs of starts put together where they meet within a document; sorted."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["first"], spans["sum"], spans["doc"]))]
    new = np.ones(len(spans), bool)
    new[1:] = (spans["doc"][1:] != spans["doc"][:-1]) | (spans["sum"][1:] != spans["sum"][:-1])
    group = np.cumsum(new)
    wide = np.int64(1) << 33
    reach = np.maximum.accumulate(group * wide + spans["last"]) - group * wide
    new[1:] |= spans["first"][1:] > reach[:-1] + 1
    out = spans[new].copy()
    out["last"] = reach[np.r_[np.flatnonzero(new)[1:], len(spans)] - 1]
    return out


def pack(x: np.ndarray) -> bytes:
    """An array as bytes, column by column, compressed."""
    raw = b"".join(np.ascontiguousarray(x[c]).tobytes() for c in x.dtype.names)
    return len(x).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blobs: list[bytes], kind: np.dtype) -> np.ndarray:
    parts = []
    for blob in blobs:
        n = int.from_bytes(blob[:8], "little")
        raw = pa.decompress(blob[8:], n * kind.itemsize, codec="zstd", asbytes=True)
        part, at = np.empty(n, kind), 0
        for c in kind.names:
            size = n * kind[c].itemsize
            part[c] = np.frombuffer(raw[at : at + size], kind[c])
            at += size
        parts.append(part)
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def per_document(spans: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(doc, sum, rows) for each document of rows sorted by document."""
    if len(spans):
        edge = np.flatnonzero(np.r_[True, (spans["doc"][1:] != spans["doc"][:-1]) | (spans["sum"][1:] != spans["sum"][:-1])])
        for a, b in zip(edge, np.r_[edge[1:], len(spans)]):
            yield int(spans["doc"][a]), int(spans["sum"][a]), spans[a:b]


#: kind: 0 anchors and 3 segments of a bucket, 1 starts to remove, 2 segments to look up (bucket: their bytes).
FLOW = "kind int, bucket long, doc long, sum long, blob binary"


def flow(rows: list[tuple[int, int, int, int, bytes]]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    columns = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["kind", "bucket", "doc", "sum", "blob"])


def removals(spans: np.ndarray, buckets: int = 1) -> list[tuple[int, int, int, int, bytes]]:
    return [(1, doc % buckets, doc, check, pack(own[["first", "last"]])) for doc, check, own in per_document(joined(spans))]


def as_spans(found: np.ndarray) -> np.ndarray:
    out = np.empty(len(found), SPAN)
    for c in SPAN.names:
        out[c] = found[c]
    return out


def scan_anchors(length: int, buckets: int, hot: np.ndarray) -> Callable:
    """Per part of text: anchors by bucket, after the copies within the part have been set aside for removal."""

    def dealt(gathered: list[np.ndarray]) -> pa.RecordBatch:
        found = np.concatenate(gathered)
        bucket = (found["key"] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        found, bucket = found[order], bucket[order]
        edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
        return flow([(0, int(bucket[i]), 0, 0, pack(found[i:j])) for i, j in zip(edge, np.r_[edge[1:], len(bucket)])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, size = [], 0
        for batch in batches:
            data, offsets = base.flat(batch.column("t"))
            docs, sums = batch.column("doc").to_numpy(), batch.column("sum").to_numpy()
            for a, b in base.parts(offsets, PART_BYTES):
                own = offsets[a : b + 1] - offsets[a]
                hashes, row, first, last, key = anchors(data[offsets[a] : offsets[b]], own, length)
                if hashes is None:
                    continue
                seg = hashes.of(first, last + length)
                spread = np.isin(key, hot)
                if spread.any():
                    more_row, start, more_key, more_seg = each_string(hashes, row[spread], first[spread], last[spread], length)
                    stay = ~spread
                    row, key, seg = np.r_[row[stay], more_row], np.r_[key[stay], more_key], np.r_[seg[stay], more_seg]
                    first, last = np.r_[first[stay], start], np.r_[last[stay], start]
                found = np.empty(len(row), ANCHOR)
                found["key"], found["seg"], found["doc"], found["sum"] = key, seg, docs[a:b][row], sums[a:b][row]
                found["first"], found["last"] = first - own[row], last - own[row]
                found, head = earliest(found)
                yield flow(removals(as_spans(found[~head]), buckets))
                gathered.append(found[head])
                size += gathered[-1].nbytes
                if size >= GATHERED_BYTES:
                    yield dealt(gathered)
                    gathered, size = [], 0
        if gathered:
            yield dealt(gathered)

    return run


#: Keys of segments that are looked up by longer grams or by their single strings, instead of by the anchor.
BY_LONG_GRAM, BY_STRING = np.uint64(0), np.uint64(1)


def match_anchors(length: int, wide: int, widest: int) -> Callable:
    """One bucket of anchors: segments that appear earlier are removed whole, different segments of one anchor are looked up."""

    def run(table: pa.Table) -> pa.Table:
        anchored = np.array(table.column("kind")) == 0
        found, head = earliest(unpack(table.filter(pa.array(anchored)).column("blob").to_pylist(), ANCHOR))
        rows = removals(as_spans(found[~head]))
        found = found[head]
        new = np.ones(len(found), bool)
        new[1:] = found["key"][1:] != found["key"][:-1]
        segments = np.diff(np.r_[np.flatnonzero(new), len(found)])
        several = np.repeat(segments, segments)
        some, several = found[several > 1], several[several > 1]
        order = np.lexsort((some["first"], some["sum"], some["doc"]))
        some, several = some[order], several[order]
        some["key"] = np.where(several > widest, BY_STRING, np.where(several > wide, BY_LONG_GRAM, np.maximum(some["key"], np.uint64(2))))
        # starts of a run that share a longer gram, on average
        run_of = (length - long_gram(length)) // 2 + 1
        for doc, check, own in per_document(some):
            n = own["last"].astype(np.int64) - own["first"]
            size = np.where(own["key"] == BY_STRING, (n + 1) * length, np.where(own["key"] == BY_LONG_GRAM, n + length * (1 + n // run_of), n + length)).sum()
            rows.append((2, int(size), doc, check, pack(own[["key", "first", "last"]])))
        return pa.concat_tables([pa.Table.from_batches([flow(rows)]), table.filter(pa.array(~anchored)).select(["kind", "bucket", "doc", "sum", "blob"])])

    return run


LOOKUP = np.dtype([("key", "<u8"), ("first", "<i4"), ("last", "<i4")])
SEGMENT = np.dtype([("doc", "<i8"), ("sum", "<i8"), ("first", "<i4"), ("size", "<i4")])


def cut_segments(length: int, buckets: int) -> Callable:
    """Bytes of the wanted segments, by bucket of their anchor (or, if that is wide, of their longer grams or each string)."""

    def dealt(gathered: list[tuple[np.ndarray, np.ndarray, bytes]]) -> pa.RecordBatch:
        bucket, head = np.concatenate([x[0] for x in gathered]), np.concatenate([x[1] for x in gathered])
        text = b"".join([x[2] for x in gathered])
        ends = np.cumsum(head["size"].astype(np.int64))
        order = np.argsort(bucket, kind="stable")
        bucket, head, ends = bucket[order], head[order], ends[order]
        starts = ends - head["size"]
        edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
        rows = []
        for i, j in zip(edge, np.r_[edge[1:], len(bucket)]):
            own = b"".join([text[x:y] for x, y in zip(starts[i:j], ends[i:j])])
            blob = pack(head[i:j])
            rows.append((3, int(bucket[i]), 0, 0, len(blob).to_bytes(8, "little") + blob + pa.compress(own, codec="zstd", asbytes=True)))
        return flow(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, held = [], 0
        for batch in batches:
            data, offsets = base.flat(batch.column("t"))
            docs, sums = batch.column("doc").to_numpy(), batch.column("sum").to_numpy()
            wanted = batch.column("blobs").to_pylist()
            for a, b in base.parts(offsets, PART_BYTES):
                part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                some = [unpack(w, LOOKUP) for w in wanted[a:b]]
                row = np.repeat(np.arange(b - a), [len(x) for x in some])
                look = np.concatenate(some)
                first, last, key = own[row] + look["first"], own[row] + look["last"], look["key"]
                wide, widest = key == BY_LONG_GRAM, key == BY_STRING
                if wide.any() or widest.any():
                    hashes, stay = Hashes(part), ~wide & ~widest
                    several = [(row[stay], first[stay], last[stay], key[stay])]
                    if wide.any():
                        several.append(by_long_gram(hashes, row[wide], first[wide], last[wide], length))
                    if widest.any():
                        more_row, start, more_key, _ = each_string(hashes, row[widest], first[widest], last[widest], length)
                        several.append((more_row, start, start, more_key))
                    row, first, last, key = [np.concatenate(x) for x in zip(*several)]
                bucket = (mixed(key) % np.uint64(buckets)).astype(np.int64)
                head = np.empty(len(row), SEGMENT)
                head["doc"], head["sum"], head["first"], head["size"] = docs[a:b][row], sums[a:b][row], first - own[row], last - first + length
                whole = part.tobytes()
                gathered.append((bucket, head, b"".join([whole[x:y] for x, y in zip(first.tolist(), (last + length).tolist())])))
                held += len(gathered[-1][2])
                if held >= GATHERED_BYTES:
                    yield dealt(gathered)
                    gathered, held = [], 0
        if gathered:
            yield dealt(gathered)

    return run


def match_segments(length: int) -> Callable:
    """One bucket of segments: of equal strings all but the earliest are removed."""

    def run(table: pa.Table) -> pa.Table:
        heads, texts = [], []
        for blob in table.column("blob").to_pylist():
            n = int.from_bytes(blob[:8], "little")
            head = unpack([blob[8 : 8 + n]], SEGMENT)
            heads.append(head)
            texts.append(pa.decompress(blob[8 + n :], int(head["size"].sum()), codec="zstd", asbytes=True))
        head = np.concatenate(heads)
        ends = np.cumsum(head["size"].astype(np.int64))
        place, number = classes(np.frombuffer(b"".join(texts), np.uint8), ends, length)
        row = np.searchsorted(ends, place, "right")
        start = head["first"][row] + (place - np.r_[0, ends][row])
        doc, check = head["doc"][row], head["sum"][row]
        order = np.lexsort((start, check, doc, number))
        later = np.zeros(len(order), bool)
        later[1:] = number[order[1:]] == number[order[:-1]]
        later = order[later]
        spans = np.empty(len(later), SPAN)
        spans["doc"], spans["sum"], spans["first"], spans["last"] = doc[later], check[later], start[later], start[later]
        return pa.Table.from_batches([flow(removals(spans))])

    return run


STARTS = np.dtype([("first", "<i4"), ("last", "<i4")])


def covered(blobs: list[bytes] | None, length: int) -> np.ndarray:
    """Maximal removed runs (begin, end) of a document."""
    found = unpack(blobs or [], STARTS)
    begin, end = np.sort(found["first"]).astype(np.int64), None
    order = np.argsort(found["first"], kind="stable")
    end = np.maximum.accumulate(found["last"][order].astype(np.int64) + length) if len(found) else begin
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1]
    at = np.flatnonzero(new)
    return np.stack([begin[at], end[np.r_[at[1:], len(begin)] - 1] if len(at) else begin], axis=1)


def kept_bytes(text: bytes, runs: np.ndarray) -> bytes:
    edges = [0, *runs.ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def hot_anchors(rows: DataFrame, length: int, total: int) -> np.ndarray:
    """Anchors in many places, from a sample of documents that grows with the root of the corpus; only spreads work, decides nothing."""
    sample = rows.where(F.pmod(F.xxhash64("doc"), F.lit(max(1, int((total / 1e6) ** 0.5)))) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = base.flat(batch.column("t"))
            for a, b in base.parts(offsets, PART_BYTES):
                key, n = np.unique(anchors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length)[4], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    counted = base.stage(sample.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    least = max(64, int((counted.agg(F.sum("n")).first()[0] or 0) * HOT_SHARE))
    # at most 1 / HOT_SHARE keys can have so large a share
    return np.array([r.key for r in counted.where(F.col("n") > least).select("key").collect()], np.int64).view(np.uint64)


def repeats(docs: DataFrame, keep: tuple[str, ...], length: int = 100) -> tuple[DataFrame, DataFrame]:
    """Identified rows (doc, sum, t and ``keep`` as k0, k1, ...) and their starts to remove (doc, sum, blobs).

    Every string of ``length`` bytes is filed by its anchor; strings that are equal have equal anchors, so only
    segments whose anchors meet are compared. Equal segments are settled by their hashes (two of 64 bits), copies first within
    a part of text, so a hot group leaves one row per part. Anchors with several different
    segments are settled on the bytes: the segments of a bucket are put through a Burrows-Wheeler transform.
    Anchors with many segments are filed again by longer grams; those that fill a large share, or have very many segments, are
    spread over their strings.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    identified = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64(text).alias("sum"), text.alias("t"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    rows = identified.select("doc", "sum", "t")
    spark = docs.sparkSession
    ids = base.stage(rows.select("doc", "sum", F.octet_length("t").alias("size")))
    total = ids.agg(F.sum("size")).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(tasks, -(-total // ANCHOR_BUCKET_BYTES))
    filed = rows.mapInArrow(scan_anchors(length, buckets, hot_anchors(rows, length, total)), FLOW)
    first = base.stage(filed.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(match_anchors(length, WIDE_SEGMENTS, WIDEST_SEGMENTS), FLOW), ["kind"])
    wanted = first.where("kind = 2").groupBy("doc", "sum").agg(F.collect_list("blob").alias("blobs"))
    # rows that repeat doc_id and text are one document: its segments are cut once
    repeated = ids.where(F.col("size") >= length).groupBy("doc", "sum").count().where("count > 1").head(1)
    texts = rows.dropDuplicates(["doc", "sum"]) if repeated else rows
    size = first.where("kind = 2").agg(F.sum("bucket")).first()[0] or 0
    parts = max(tasks, -(-size // SEGMENT_BUCKET_BYTES))
    cut = texts.where(F.octet_length("t") >= length).join(wanted, ["doc", "sum"]).mapInArrow(cut_segments(length, parts), FLOW)
    second = base.stage(cut.repartition(parts, "bucket").groupBy("bucket").applyInArrow(match_segments(length), FLOW))
    starts = first.where("kind = 1").select("doc", "sum", "blob").unionAll(second.select("doc", "sum", "blob"))
    return identified, starts.groupBy("doc", "sum").agg(F.collect_list("blob").alias("blobs"))


def dedup(docs: DataFrame, length: int = 100) -> DataFrame:
    """What exact dedup removes from every document.

    Input columns: doc_id, text; others are ignored. A text is its UTF-8 bytes (null: empty). Every byte is removed that is
    covered by a string of ``length`` bytes which also starts earlier: in a document of smaller doc_id, or earlier in the
    same one; matches do not cross documents. Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs)
    and kept_sha256. Rows without doc_id come after all others. Rows that repeat both doc_id and text
    are one document and get the same result each; rows that repeat only doc_id are documents of their own, ordered
    by a hash of the text. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = base.flat(batch.column("t"))
            removed, spans, kept = [], [], []
            for a, b, blobs in zip(offsets, offsets[1:], batch.column("blobs").to_pylist()):
                runs = covered(blobs, length)
                removed.append(int((runs[:, 1] - runs[:, 0]).sum()))
                spans.append(len(runs))
                kept.append(hashlib.sha256(kept_bytes(data[a:b].tobytes(), runs)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("k0"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    identified, starts = repeats(docs, ("doc_id",), length)
    kind = dict(identified.dtypes)["k0"]
    return identified.join(starts, ["doc", "sum"], "left").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """``docs`` with the removed bytes gone from text (invalid UTF-8 left by a cut inside a character is dropped)."""
    names = [c for c in docs.columns if c != "text"]
    identified, starts = repeats(docs, tuple(names), length)
    own = [f"k{i}" for i in range(len(names))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = base.flat(batch.column("t"))
            texts = [kept_bytes(data[a:b].tobytes(), covered(blobs, length)).decode("utf-8", "ignore") for a, b, blobs in zip(offsets, offsets[1:], batch.column("blobs").to_pylist())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], pa.array(texts, pa.string())], [*own, "t"])

    kinds = dict(identified.dtypes)
    out = identified.join(starts, ["doc", "sum"], "left").mapInArrow(run, ", ".join([*[f"{c} {kinds[c]}" for c in own], "t string"]))
    return out.select(*[F.col("t").alias(c) if c == "text" else F.col(own[names.index(c)]).alias(c) for c in docs.columns])

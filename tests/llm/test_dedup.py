import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest_llm import ODD
from pyspark.sql import functions as F

from tidemark.llm import suffix_dedup
from tidemark.llm.components import components
from tidemark.llm.repeats import classes
from tidemark.llm.simhash import links, near_duplicates, one_of_each
from tidemark.llm.suffix_dedup import dedup, without_repeats


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w)] if len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(nodes):
    """Smallest id reachable over two differing bits, by all pairs."""
    root = {i: i for i, _ in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, f) in enumerate(nodes):
        for j, g in nodes[:n]:
            if (f ^ g).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i, _ in nodes}


def near_copies(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choices(words, k=150) for _ in range(5)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append((i * 3 + 10, " ".join(w)))
    return out


def test_simhash_equals_all_pairs(documents):
    rows = [*near_copies(60, 1), (1, None), (2, ""), (3, "One two"), (4, "one TWO"), (4, "one TWO"), (9, "a b c d")]
    prints = [(i, fingerprint(t)) for i, t in rows]
    expected = groups(list(dict(prints).items()))
    got = near_duplicates(documents(rows)).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{f:016x}", expected[i]) for i, f in prints)
    assert near_duplicates(documents([])).collect() == []


def test_rows_without_id(documents):
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(documents(ODD)).collect()}
    assert (None, f"{fingerprint('one two three four'):016x}", 3) in got
    assert (None, "0" * 16, 1) in got and (2, "0" * 16, 1) in got


@pytest.mark.parametrize("hot_rows", [2, 64])
def test_crowded_blocks_lose_no_link(spark, hot_rows):
    rng = np.random.default_rng(0)
    centres = [int(x) for x in rng.integers(0, 1 << 63, 4)]
    prints = sorted({int(np.bitwise_xor.reduce([np.uint64(centres[i % 4]), *(np.uint64(1) << np.uint64(b) for b in rng.choice(64, rng.integers(0, 6), replace=False))])) for i in range(300)})
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)], "fp long, id long")
    got = {r.node: r.root for r in components(links(frame, hot_rows=hot_rows)).collect()}
    expected = groups(list(enumerate(prints)))
    assert {i: got.get(i, i) for i in expected} == expected


def test_a_long_chain_is_one_component(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).orderBy(F.rand(1))
    assert {(r.root) for r in components(chain).collect()} == {0}


def test_one_of_each_keeps_rows_whole(documents):
    rows = near_copies(40, 2)
    expected = {i for i, r in groups([(i, fingerprint(t)) for i, t in rows]).items() if i == r}
    docs = documents([*rows, rows[0], (None, "x y z q"), (None, "x y z q")])
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([*map(str, expected), "None"])


def removed(rows, length):
    """Coverage by sets of strings, in the order of the rows."""
    seen, out = set(), []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def passages(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghé", k=rng.randint(1, 8)))
    shared = [" ".join(word() for _ in range(40)) for _ in range(4)]
    out = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, 30)
            parts += [s[a : a + rng.randint(60, 260)], word()]
        out.append((i, " ".join(parts)))
    return [*out, (n, "a" * 450), (n + 1, "ab" * 300), (n + 2, out[0][1]), (n + 3, "a" * 99), (n + 4, out[1][1] * 3)]


@pytest.mark.parametrize("hot, wide", [(1 / 20_000, 2000), (0.0, 2000), (1 / 20_000, 1)])
def test_suffix_dedup_equals_sets_of_strings(documents, monkeypatch, hot, wide):
    monkeypatch.setattr(suffix_dedup, "HOT_SHARE", hot)
    monkeypatch.setattr(suffix_dedup, "WIDE_SEGMENTS", wide)
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 3000)
    rows = [*passages(60, 3), (900, None), (901, ""), (None, passages(60, 3)[2][1])]
    expected = removed(rows, 100)
    got = dedup(documents(rows)).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str(x[:5]) for x in expected)
    kept = without_repeats(documents(rows))
    assert kept.columns == documents(rows).columns
    assert {r.doc_id: r.text for r in kept.collect()} == {x[0]: x[5].decode("utf-8", "ignore") for x in expected}


def test_suffix_dedup_of_odd_rows(documents):
    long = "0123456789" * 30
    rows = [(1, long), (1, long), (2, long[:150]), (2, "z" + long[:120]), (3, None)]
    got = {(r.doc_id, r.n_bytes): (r.n_removed, r.n_spans) for r in dedup(documents(rows)).collect()}
    assert len(dedup(documents(rows)).collect()) == 5
    assert got[(1, 300)] == (290, 1) and got[(2, 150)] == (150, 1) and got[(2, 121)] == (120, 1) and got[(3, 0)] == (0, 0)
    assert dedup(documents([])).collect() == []


@pytest.mark.parametrize("letters, length", [(1, 9), (2, 20), (3, 8), (20, 100)])
def test_classes_are_equal_strings(letters, length):
    rng = random.Random(letters)
    for _ in range(30):
        base = [bytes(rng.choices(range(97, 97 + letters), k=rng.randint(0, 150))) for _ in range(3)]
        some = [rng.choice(base)[rng.randint(0, 40) :] + rng.choice(base)[: rng.randint(0, 60)] for _ in range(rng.randint(1, 8))]
        flat, ends = b"".join(some), np.cumsum([len(t) for t in some])
        place, number = classes(np.frombuffer(flat, np.uint8), ends, length)
        starts = [e - len(t) + i for t, e in zip(some, ends) for i in range(len(t) - length + 1)]
        assert place.tolist() == starts
        by = {}
        assert all(by.setdefault(flat[p : p + length], c) == c for p, c in zip(starts, number)) and len(set(by.values())) == len(by)


def wide_segments(n, length, seed=1):
    """One text a row, each with one gram in the middle of other bytes, and the wanted segments around the gram."""
    rng = random.Random(seed)
    texts = ["".join(rng.choices("abcdefghij ", k=length)) + "the gram they all have in common" + "".join(rng.choices("abcdefghij ", k=length)) for _ in range(n)]
    look = np.zeros(1, suffix_dedup.LOOKUP)
    look["first"], look["last"] = 40, 100
    return pa.RecordBatch.from_pydict({"t": texts, "doc": list(range(n)), "sum": [0] * n, "blobs": pa.array([[suffix_dedup.pack(look)]] * n, pa.list_(pa.binary()))})


def test_segments_of_a_wide_anchor_are_cut_at_longer_grams(monkeypatch):
    """Single strings were 6,100 bytes a segment, in a piece a bucket for every part of text."""
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 1000)
    n, buckets = 60, 8
    rows = pa.Table.from_batches(list(suffix_dedup.cut_segments(100, buckets)(iter([wide_segments(n, 100)])))).to_pylist()
    assert len(rows) <= buckets
    heads = [suffix_dedup.unpack([r["blob"][8 : 8 + int.from_bytes(r["blob"][:8], "little")]], suffix_dedup.SEGMENT) for r in rows]
    found = np.concatenate(heads)
    assert found["size"].sum() < n * 1500
    strings = sorted((int(d), int(f) + i) for d, f, size in zip(found["doc"], found["first"], found["size"]) for i in range(size - 99))
    assert strings == [(d, p) for d in range(n) for p in range(40, 101)]


@pytest.mark.parametrize("wide, widest", [(1, 50_000), (0, 1)])
def test_wide_anchors_lose_no_string(documents, monkeypatch, wide, widest):
    monkeypatch.setattr(suffix_dedup, "WIDE_SEGMENTS", wide)
    monkeypatch.setattr(suffix_dedup, "WIDEST_SEGMENTS", widest)
    rows = passages(80, 5)
    got = dedup(documents(rows)).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str(x[:5]) for x in removed(rows, 100))

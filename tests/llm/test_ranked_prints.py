import hashlib
import math
import random
import re

import numpy as np
import pytest
from conftest_llm import ODD

from tidemark.llm import fingerprints as fp
from tidemark.llm import ranked_search as rs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def items(spark):
    return lambda rows: spark.createDataFrame([(*r, "x") for r in rows], "item_id long, text string, term string")


def ranked(docs, items, k):
    """Scores by the definition, document by document."""
    bags = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, b in bags if b), sum(len(b) for _, b in bags)
    df = {}
    for _, b in bags:
        for t in set(b):
            df[t] = df.get(t, 0) + 1
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for i, some in asked.items():
        scored = []
        for d, b in bags:
            m = 50 + (50 * len(b) * n_docs) // max(1, n_terms)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b.count(t)) // (1000 * b.count(t) + 20 * m)) for t in some if t in b)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=lambda r: (r[0], r[1]))


def words(rng, n):
    return " ".join(rng.choice("the of Éa bÀb x1 zeta eta theta iota kappa lambda mu nu xi omicron pi rho".split()) for _ in range(n))


@pytest.mark.parametrize("leaf,taken,block", [(64, 64, 1_000_000), (1, 1, 40), (3, 2, 500)])
def test_ranked_search_equals_scoring_all(documents, items, monkeypatch, leaf, taken, block):
    monkeypatch.setattr(rs, "LEAF", leaf)
    monkeypatch.setattr(rs, "TAKEN", taken)
    monkeypatch.setattr(rs, "BLOCK_POSTINGS", block)
    rng = random.Random(4)
    docs = [(i, words(rng, rng.randint(0, 40))) for i in range(150)] + [(200 + i, "Theta iota, theta!") for i in range(30)] + [(7, "theta pi"), (None, "kappa mu")] + ODD
    asked = [(1, "theta iota"), (2, "The kappa; mu MU"), (3, None), (4, "nothing here"), (1, "rho"), (5, words(rng, 30))]
    for k in (1, 5, 50):
        got = rs.search(documents(docs).repartition(3), items(asked), k, items_together=2).collect()
        assert sorted(map(tuple, got), key=lambda r: (r[0], r[1])) == ranked(docs, asked, k)


def test_ranked_search_of_nothing(documents, items):
    assert rs.search(documents([]), items([(1, "a")])).collect() == []
    assert rs.search(documents([(1, "a")]), items([])).collect() == []
    assert rs.search(documents([(1, None), (2, "")]), items([(1, "a")])).collect() == []


def shingles(text, n=5):
    w = [x.translate(LOWER) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_sketches_hold_the_smallest_shingle_hashes():
    rng = random.Random(2)
    texts = ["", "  \n", "One", "one  two\tTHREE four", *[words(rng, n) for n in (5, 6, 40, 400, 3000)]]
    got = fp.sketches([t.encode() for t in texts], k=32)
    for text, sketch in zip(texts, got):
        alone = [x.encode() for x in sorted(shingles(text))]
        hashes = sorted({int(fp.shingle_hashes(np.frombuffer(s, np.uint8), np.array([0, len(s)]))[0][0]) for s in alone})
        assert sketch.tolist() == hashes[:32]
        assert fp.unpack(fp.pack(sketch)).tolist() == sketch.tolist()


def test_estimates_are_near_the_truth():
    rng = random.Random(9)
    pool = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(4000)]
    a, b = " ".join(pool[:3000]), " ".join(pool[1500:])
    x, y = fp.sketches([a.encode(), b.encode()])
    sa, sb = shingles(a), shingles(b)
    assert fp.resemblance(x, y) == pytest.approx(len(sa & sb) / len(sa | sb), abs=0.12)
    assert fp.containment(x, y) == pytest.approx(len(sa & sb) / len(sa), abs=0.15)
    assert fp.distinct(x) == pytest.approx(len(sa), rel=0.25)
    assert fp.distinct(fp.merge(x, y)) == pytest.approx(len(sa | sb), rel=0.25)
    short, long = fp.sketches([b"a b c d e f", b"a b c d e f g"])
    assert fp.containment(short, long) == 1.0 and fp.resemblance(short, long) == pytest.approx(2 / 3)
    nothing = fp.sketches([b""])[0]
    assert fp.resemblance(nothing, nothing) == 1.0 and fp.resemblance(nothing, short) == 0.0


@pytest.mark.parametrize("together", [2, 7, 4000])
def test_edited_texts_by_hand(documents, together):
    rng = random.Random(3)
    rows = [(3 * i, words(rng, rng.randint(0, 30))) for i in range(60)] + [r for r in ODD if r[0] is not None and r[0] not in {3 * i for i in range(60)}]
    rows = list({r[0]: r for r in rows}.values())
    got = {r.doc_id: r for r in fp.edited_texts(documents(rows), rows_together=together).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for here, nxt in zip(order, order[1:] + order[:1]):
        text, other = here[1] or "", nxt[1] or ""
        edited = text[: len(text) - len(text) // 2] + other[: len(text) // 2]
        r = got[here[0]]
        one, two, three = fp.sketches([text.encode(), edited.encode(), other.encode()])
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fp.pack(one), fp.pack(two))
        assert (r.near_edited, r.near_next) == (fp.resemblance(one, two), fp.resemblance(one, three))


def test_edited_texts_of_odd_tables(documents):
    assert fp.edited_texts(documents([])).collect() == []
    (only,) = fp.edited_texts(documents([(5, "a b c d e f")])).collect()
    assert only.near_next == 1.0 and only.edited_sha256 == hashlib.sha256(b"a b c " + b"a b c").hexdigest()
    rows = [(1, "a b"), (1, "a b"), (1, "c d"), (None, "x y"), (None, None), (2, "q " * 5000)]
    got = fp.edited_texts(documents(rows), rows_together=2).collect()
    assert len(got) == len(rows) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert len({r.fingerprint for r in got if r.doc_id == 1 and r.n_chars == 3}) == 2


def test_fingerprints_merge_over_parts(documents):
    rng = random.Random(5)
    rows = [(i, words(rng, 60), "en", "s%d" % (i % 3)) for i in range(90)]
    prints = fp.fingerprints(documents(rows).repartition(5), keep=("doc_id", "source"))
    got = {r.source: r for r in fp.merged(prints, "source").collect()}
    assert len(got) == 3
    for source, r in got.items():
        whole = set().union(*[shingles(t) for _, t, _, s in rows if s == source])
        one = fp.sketches([x.encode() for x in sorted(whole)])
        together = np.unique(np.concatenate(one))[: fp.K]
        assert r.fingerprint == fp.pack(together) and r.distinct_shingles == fp.distinct(together)

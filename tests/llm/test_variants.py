import random
import re
import zlib

import numpy as np
import pytest
from conftest_llm import ODD

from tidemark.llm import variants as v

LETTERS = "abcdeéà"


def edits(word, alphabet):
    out = set()
    for i in range(len(word) + 1):
        for c in alphabet:
            out.add(word[:i] + c + word[i:])
            if i < len(word):
                out.add(word[:i] + c + word[i + 1 :])
        if i < len(word):
            out.add(word[:i] + word[i + 1 :])
    return out - {word}


def by_hand(rows, least_length=6, least_count=5, every=199, times=5):
    counts = {}
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    known = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    alphabet = sorted({c for w in known for c in w})
    near = {w: sorted((x for x in edits(w, alphabet) if x in known), key=lambda x: (-known[x], x)) for w in known}
    form = {w: near[w][0] if near[w] and known[near[w][0]] >= times * known[w] else None for w in known}
    out = []
    for w in known:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, known[w], len(near[w]), known.get(form[w])))
    return sorted(out)


def texts(seed, n, alphabet=LETTERS):
    """Documents of a few frequent words and many of their misspellings."""
    rng = random.Random(seed)
    roots = ["".join(rng.choices(alphabet, k=rng.randint(6, 12))) for _ in range(25)] + ["abcabc" + c for c in "abcdeé"]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 60)):
            x = rng.choice(roots[: rng.choice((3, 25, 31))])
            for _ in range(rng.choice((0, 0, 0, 1, 2))):
                x = rng.choice(sorted(edits(x, alphabet)))
            w.append(x.upper() if rng.random() < 0.1 else x)
        rows.append((i, " ".join(w) + rng.choice(("", ".", " 12 日本 ÿ×÷"))))
    return rows


@pytest.mark.parametrize("together,every", [(50_000, 199), (20, 3), (1, 7)])
def test_variants_equal_those_by_hand(documents, together, every):
    rows = texts(1, 150) + [(500, "abcabca " * 300), (None, "aébcda " * 9), *ODD]
    got = v.variants(documents(rows).repartition(3), every=every, words_together=together).collect()
    assert sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got)) == by_hand(rows, every=every)


def test_chains_reach_their_last_word(documents):
    rows = [(1, "aaaaaa " * 6 + "aaaaab " * 40 + "aaaabb " * 300 + "aaabbb " * 2000 + "aabbbb " * 15000)]
    got = {r.word: r for r in v.variants(documents(rows), every=10**9).collect()}
    assert got["aaaaaa"].form == "aaaaab" and got["aaaaaa"].root == "aabbbb" and got["aabbbb"].form is None and got["aabbbb"].root == "aabbbb"


def test_nothing_and_ties(documents):
    assert v.variants(documents([])).collect() == []
    assert v.variants(documents([(1, None), (2, "short ab")])).collect() == []
    rows = [(1, "wordsa " * 50 + "wordsb " * 50 + "wordsc " * 10 + "wordsàé " * 9)]
    got = {r.word: (r.form, r.n_near) for r in v.variants(documents(rows), every=10**9).collect()}
    assert got == {"wordsa": (None, 2), "wordsb": (None, 2), "wordsc": ("wordsa", 2), "wordsàé": (None, 0)}


@pytest.mark.parametrize("seed", range(6))
def test_each_scheme_finds_all_of_its_pairs(seed):
    rng = random.Random(seed)
    words = sorted({bytes(rng.choices(b"abc\xe9", k=rng.randint(6, 20 if seed % 2 else 8))) for _ in range(400)})
    words += [w[:i] + w[i + 1 :] for w in words[:80] for i in (0, len(w) // 2) if len(w) > 6]
    words = sorted(set(words))
    alphabet = [bytes([c]) for c in b"abc\xe9"]
    known = {w: i for i, w in enumerate(words)}
    expected = set()
    for w in words:
        around = {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in alphabet} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in alphabet} | {w[:i] + w[i + 1 :] for i in range(len(w))}
        expected |= {(known[w], known[x]) for x in around - {w} if x in known}
    found = set()
    for forwards in (True, False):
        a, b = v.near_words(words, words, forwards)
        found |= set(zip(a.tolist(), b.tolist()))
    assert found == expected


def test_the_index_orders_suffixes_and_steps():
    words = [b"banana", b"ananas", b"bandana", b"a" * 40, b"a" * 39 + b"b"]
    index = v.Index(words)
    for prefix in (b"", b"b", b"ban", b"a" * 39, b"anan", b"x"):
        lo, hi = np.array([0]), np.array([len(words)])
        for c in prefix:
            lo, hi = index.step(lo, hi, np.array([c]))
        assert hi[0] - lo[0] == sum(w.startswith(prefix) for w in words)
        _, ended = index.ends(lo, hi)
        assert [words[i] for i in ended] == [w for w in words if w == prefix]


def test_checksums_are_those_of_zlib():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    start = rng.integers(0, 4800, 300)
    end = start + rng.integers(0, 200, 300)
    state = rng.integers(0, 1 << 32, 300).astype(np.uint32)
    assert v.checksums(state, data, start, end).tolist() == [zlib.crc32(data[a:b].tobytes(), int(s)) for a, b, s in zip(start, end, state)]

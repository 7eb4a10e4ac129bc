import numpy as np
import pytest

from tidemark.llm.hamming import sign_codes, top_k
from tidemark.llm.neighbours import nearest


def signed(x):
    return int(x) - (1 << 64) if int(x) >> 63 else int(x)


def closest(rows, queries, k):
    out = []
    for q, a in queries:
        ranked = sorted(((a ^ b).bit_count(), i) for i, b in rows)
        out += [(q, n + 1, i, d) for n, (d, i) in enumerate(ranked[:k])]
    return sorted(out)


@pytest.mark.parametrize("kind", ["clustered", "random", "copies"])
def test_code_search_equals_brute_force(spark, kind):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 3)
    codes = []
    for i in range(150):
        x = int(rng.integers(0, 1 << 63)) if kind == "random" else int(centres[i % 3])
        for b in rng.integers(0, 64, 0 if kind == "copies" else 4):
            x ^= 1 << int(b)
        codes.append((i, x))
    frame = spark.createDataFrame([(i, signed(x)) for i, x in codes] + [(0, signed(codes[0][1])), (None, 5), (900, None)], "id long, code long")
    queries = [c for c in codes if c[0] % 50 == 0]
    got = top_k(frame, frame.where("id % 50 = 0"), k=7)
    assert sorted(tuple(r) for r in got.collect()) == closest(codes, queries, 7)


def test_code_search_with_few_rows(spark):
    frame = spark.createDataFrame([(0, 3), (1, -1)], "id long, code long")
    assert sorted(tuple(r) for r in top_k(frame, frame, k=5).collect()) == [(0, 1, 0, 0), (0, 2, 1, 62), (1, 1, 1, 0), (1, 2, 0, 62)]
    assert top_k(frame.limit(0), frame.limit(0)).collect() == [] and top_k(frame.limit(0), frame).collect() == []


def test_sign_codes(spark):
    rows = [(1, [0.5, -1.0, None, float("nan"), 2.0]), (2, None), (3, []), (4, [-1.0] * 63 + [1.0] + [9.0])]
    got = {r.id: r.code for r in sign_codes(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {1: 17, 2: None, 3: 0, 4: -(1 << 63)}


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as rep", "2 as v", "3 as leaf")


def test_neighbours_equal_brute_force_on_few_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 8)).astype(np.float32)
    x[50:60] = x[0]  # equal vectors: ties by id
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [(300, None), (350, [0.0] * 8), (400, [1.0] * 7 + [None]), (450, [float("inf")] * 8), (500, [1.0] * 3), (None, rows[1][1]), rows[100], rows[100]]
    got = nearest(vectors(spark, [*rows, *odd])).collect()
    expected = []
    d = x.astype(np.float64)
    for q in range(0, 200, 50):
        score = d @ d[q] / np.linalg.norm(d, axis=1) / np.linalg.norm(d[q])
        others = sorted((i for i in range(200) if i != q), key=lambda i: (-round(score[i], 12), i))[:5]
        expected += [(q, n + 1, i, round(float(score[i]), 9)) for n, i in enumerate(others)]
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got) == sorted(expected)


def test_neighbours_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    got = nearest(vectors(spark, [(i, [float(c) for c in v]) for i, v in enumerate(x)]), trees=8, leaf_rows=64, leaves=40).collect()
    d = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 50):
        score = d @ d[q]
        score[q] = -2
        hits += len({r.vec_id for r in got if r.query_id == q} & set(np.argsort(-score)[:5].tolist()))
    assert hits / (60 * 5) >= 0.9


def test_neighbours_of_empty_and_lonely_rows(spark):
    assert nearest(vectors(spark, [])).collect() == []
    assert nearest(vectors(spark, [(0, [1.0, 0.0])])).collect() == []
    assert [(r.query_id, r.vec_id) for r in nearest(vectors(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])])).collect()] == [(0, 1)]


def test_neighbours_visit_as_many_leaves_as_recall_needs(spark):
    x = np.random.default_rng(4).normal(size=(4000, 16)).astype(np.float32)
    got = nearest(vectors(spark, [(i, [float(c) for c in v]) for i, v in enumerate(x)]), trees=4, leaf_rows=32, leaves=4).collect()
    d = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 4000, 50):
        score = d @ d[q]
        score[q] = -2
        hits += len({r.vec_id for r in got if r.query_id == q} & set(np.argsort(-score)[:5].tolist()))
    assert hits / (80 * 5) >= 0.9


def test_neighbours_of_each_vector_length(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.normal(size=8 if i % 3 else 4).astype(np.float32)]) for i in range(150)]
    got = nearest(vectors(spark, rows), k=3).collect()
    expected = []
    for q in (0, 50, 100):
        a = np.array(rows[q][1])
        score = {i: np.array(v) @ a / np.linalg.norm(v) / np.linalg.norm(a) for i, v in rows if len(v) == len(a) and i != q}
        expected += [(q, n + 1, i, round(float(score[i]), 9)) for n, i in enumerate(sorted(score, key=lambda i: -score[i])[:3])]
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got) == expected

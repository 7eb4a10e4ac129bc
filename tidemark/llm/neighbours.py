"""Approximate nearest neighbours: a forest of random-projection trees under one priority queue, exact reranking."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import base


@dataclass
class Tree:
    """Inner nodes: a normal, a threshold and two children; a child below zero is leaf -1 - child."""

    normal: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaves: int

    def route(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every vector."""
        node = np.zeros(len(x), np.int64)
        if not len(self.threshold):
            return node
        going = np.arange(len(x))
        while len(going):
            at = node[going]
            below = np.einsum("ij,ij->i", x[going], self.normal[at]) < self.threshold[at]
            node[going] = np.where(below, self.left[at], self.right[at])
            going = going[node[going] >= 0]
        return -1 - node


def grow(sample: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    """Split at the median of a projection on the difference of two random sample vectors, until ``leaf`` vectors are left."""
    normal, threshold, left, right = [], [], [], []
    leaves = 0
    todo: list[tuple[np.ndarray, int, bool]] = [(np.arange(len(sample)), -1, False)]
    while todo:
        rows, parent, is_left = todo.pop()
        child = None
        if len(rows) > leaf:
            for _ in range(5):
                a, b = rng.choice(rows, 2, replace=False)
                way = sample[a] - sample[b]
                if not way.any():
                    continue
                value = sample[rows] @ way
                middle = np.median(value)
                below = value < middle
                if 0 < below.sum() < len(rows):
                    child = len(normal)
                    scale = np.linalg.norm(way)
                    normal.append(way / scale)
                    threshold.append(middle / scale)
                    left.append(0)
                    right.append(0)
                    todo += [(rows[below], child, True), (rows[~below], child, False)]
                    break
        if child is None:
            leaves += 1
            child = -leaves
        if parent >= 0:
            (left if is_left else right)[parent] = child
    size = sample.shape[1]
    return Tree(np.array(normal, np.float64).reshape(-1, size), np.array(threshold), np.array(left, np.int64), np.array(right, np.int64), leaves)


def search(forest: list[Tree], x: np.ndarray, leaves: int) -> list[tuple[int, int]]:
    """The ``leaves`` most promising (tree, leaf): one queue over all trees, by the least margin on the way."""
    margins = [t.normal @ x - t.threshold for t in forest]
    queue = [(-np.inf, i, 0 if len(t.threshold) else -1) for i, t in enumerate(forest)]
    found = []
    while queue and len(found) < leaves:
        minus, i, node = heapq.heappop(queue)
        while node >= 0:
            m = margins[i][node]
            near, far = (forest[i].left[node], forest[i].right[node]) if m < 0 else (forest[i].right[node], forest[i].left[node])
            heapq.heappush(queue, (max(minus, abs(m)), i, far))
            node = near
        found.append((i, int(-1 - node)))
    return found


def reach(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The least margin on the way to every leaf, for every vector: ``search`` visits leaves in this order."""
    margin = x @ tree.normal.T - tree.threshold
    node, leaf = np.full(margin.shape, -np.inf), np.full((len(x), tree.leaves), -np.inf)
    for i in range(len(tree.threshold)):  # parents come before their children
        past = np.maximum(node[:, i], np.abs(margin[:, i]))
        below = margin[:, i] < 0
        for child, value in ((tree.left[i], np.where(below, node[:, i], past)), (tree.right[i], np.where(below, past, node[:, i]))):
            if child >= 0:
                node[:, child] = value
            else:
                leaf[:, -1 - child] = value
    return leaf


def leaves_needed(forest: list[Tree], x: np.ndarray, owner: np.ndarray, found: np.ndarray, recall: float, chunk: int = 32) -> int:
    """How many leaves a query has to visit until it meets the share ``recall`` of ``found``; row i is sought by the query ``x[owner[i]]``."""
    places = [t.route(found) for t in forest]
    needed = np.zeros(len(found), np.int64)
    for a in range(0, len(x), chunk):
        ways = [reach(t, x[a : a + chunk]) for t in forest]
        order = np.sort(np.concatenate(ways, axis=1), axis=1)
        for i in np.flatnonzero((owner >= a) & (owner < a + chunk)):
            least = min(way[owner[i] - a, place[i]] for way, place in zip(ways, places))
            needed[i] = np.searchsorted(order[owner[i] - a], least, "right")
    return int(np.sort(needed)[int(np.ceil(recall * len(needed))) - 1]) if len(needed) else 0


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v) of rows whose vector is not null, not zero and has finite components only."""
    v = F.col(embedding)
    v = v if dict(vectors.select(v.alias("v")).dtypes)["v"] == "array<float>" else v.cast("array<double>")
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(
        "vec_id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x != 0)"
    )


def exact(entries: DataFrame, q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` entries nearest to each of a few queries (ids ``q``, unit vectors ``x``), by one pass over all: the query of each and its unit vector."""
    kind = dict(entries.dtypes)["v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cosine = x @ unit(matrix(batch.column("v"))).T
            cosine[q[:, None] == batch.column("rep").to_numpy()] = -np.inf
            at = np.argsort(-cosine, axis=1)[:, :k]
            taken = batch.select(["rep", "v"]).take(pa.array(at.ravel()))
            owner = np.repeat(np.arange(len(q), dtype=np.int64), at.shape[1])
            new = pa.Table.from_arrays([pa.array(owner), pa.array(np.take_along_axis(cosine, at, 1).ravel()), taken.column("rep"), taken.column("v")], ["owner", "score", "rep", "v"])
            both = pa.concat_tables([best, new]) if best is not None else new
            owner = both.column("owner").to_numpy()
            order = np.lexsort((both.column("rep").to_numpy(), -both.column("score").to_numpy(), owner))
            place = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
            best = both.take(pa.array(order[place < k])).combine_chunks()
        if best is not None:
            yield from best.to_batches()

    top = Window.partitionBy("owner").orderBy(F.col("score").desc(), "rep")
    found = entries.select("rep", "v").mapInArrow(run, f"owner long, score double, rep long, v {kind}").where("score > double('-infinity')")
    rows = found.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k).select("owner", "v").collect()  # len(q) x k at most
    return np.array([r.owner for r in rows], np.int64), unit(np.array([r.v for r in rows], np.float64)) if rows else np.zeros((0, x.shape[1]))


def nearest(
    vectors: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", embedding: str = "embedding",
    trees: int = 24, leaf_rows: int = 256, leaves: int = 170, sample_rows: int = 20_000, seed: int = 5, recall: float = 0.95, tried: int = 256,
) -> DataFrame:
    """The ``k`` nearest rows by cosine of every row whose id is divisible by ``every``.

    The forest is grown on at most ``sample_rows`` vectors (in the order of a hash); every row is then filed in a leaf
    of each tree. A query visits its best leaves of the whole forest; their rows are scored exactly, in double
    precision, leaf by leaf. Returns query_id, rank, vec_id, score; ties go to the smaller vec_id.

    How many leaves that takes grows with the table, so it is measured on it: the nearest rows of ``tried`` queries are found by
    one pass over all rows, and as many leaves are visited as the share ``recall`` of them needs (``leaves`` at least).

    Equal vectors are one entry, which keeps its k + 1 smallest ids: no other can be among k nearest. Vectors that are null,
    zero or hold a null or non-finite component take no part, nor do rows without id; other columns are ignored. Vectors of
    each length are searched among themselves, with a forest of their own. Rows that repeat an id with different vectors are candidates each, a
    query's own id excepted; repeated equal rows count once. An empty table gives an empty result.
    """
    rows = base.stage(usable(vectors, vec_id, embedding).distinct())
    sizes = sorted((r.length, r["count"]) for r in rows.groupBy(F.size("v").alias("length")).count().collect()) or [(0, 0)]
    groups = [_pairs(rows.where(F.size("v") == length), n, k, every, trees, leaf_rows, leaves, sample_rows, seed, recall, tried) for length, n in sizes]
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    pairs = reduce(DataFrame.unionByName, groups)
    return pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _pairs(
    rows: DataFrame, n: int, k: int, every: int, trees: int, leaf_rows: int, leaves: int, sample_rows: int, seed: int, recall: float, tried: int,
) -> DataFrame:
    """(query_id, vec_id, score) with at least the ``k`` nearest found among ``n`` rows of one vector length."""
    ranked = Window.partitionBy("v").orderBy("vec_id")
    entries = base.stage(
        rows.withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= k + 1)
        .groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("rep", F.col("ids")[0])
    )
    sample = unit(np.array([r.v for r in entries.orderBy(F.xxhash64("rep"), "rep").limit(sample_rows).select("v").collect()] or [[1.0]]))
    rng = np.random.default_rng(seed)
    forest = [grow(sample, max(8, int(leaf_rows * len(sample) / max(1, n))), rng) for _ in range(trees)]
    asked = rows.where(F.col("vec_id") % every == 0).join(entries.select(F.col("rep").alias("q"), "v"), "v").select("vec_id", "q", "v")
    if leaves < sum(t.leaves for t in forest):
        tries = asked.select("q", "v").distinct().orderBy(F.xxhash64("q"), "q").limit(tried).collect()
        if tries:
            x = unit(np.array([r.v for r in tries], np.float64))
            leaves = max(leaves, leaves_needed(forest, x, *exact(entries, np.array([r.q for r in tries], np.int64), x, k), recall))
    first = np.cumsum([0, *(t.leaves for t in forest)])

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(matrix(batch.column("v"))) if batch.num_rows else np.zeros((0, sample.shape[1]))
            for i, t in enumerate(forest):
                yield pa.RecordBatch.from_arrays([pa.array(first[i] + t.route(x)), batch.column("rep"), batch.column("v")], ["leaf", "rep", "v"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"))
            found = [(int(first[i]) + j, row) for row in range(len(x)) for i, j in search(forest, x[row] / np.linalg.norm(x[row]), leaves)]
            at = pa.array([row for _, row in found], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([j for j, _ in found], pa.int64()), batch.column("q").take(at), batch.column("v").take(at)], ["leaf", "q", "v"])

    def score(queries: pa.Table, filed: pa.Table) -> pa.Table:
        q, x, rep = matrix(queries.column("v")), matrix(filed.column("v")), filed.column("rep").to_numpy()
        out: list[list[np.ndarray]] = [[], [], []]
        if len(q) and len(x):
            q_ids, norm_q, norm_x = queries.column("q").to_numpy(), np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
            for a in range(0, len(q), 256):
                cosine = (q[a : a + 256] @ x.T) / norm_q[a : a + 256, None] / norm_x
                for i, c in enumerate(cosine, a):
                    if len(c) > k + 1:
                        least = np.partition(c, -(k + 1))[-(k + 1)]
                        best = np.flatnonzero(c >= least - 1e-12)
                    else:
                        best = np.arange(len(c))
                    exact = np.einsum("ij,j->i", x[best], q[i]) / (norm_q[i] * norm_x[best])
                    best, exact = (y[np.lexsort((rep[best], -exact))[: k + 1]] for y in (best, exact))
                    for o, y in zip(out, (np.full(len(best), q_ids[i]), rep[best], exact)):
                        o.append(y)
        arrays = [pa.array(np.concatenate(o) if o else np.zeros(0), kind) for o, kind in zip(out, (pa.int64(), pa.int64(), pa.float64()))]
        return pa.Table.from_arrays(arrays, ["q", "rep", "score"])

    kind = dict(entries.dtypes)["v"]
    filed = entries.select("rep", "v").mapInArrow(file, f"leaf long, rep long, v {kind}")
    visited = asked.select("q", "v").distinct().mapInArrow(visit, f"leaf long, q long, v {kind}")
    scored = visited.groupBy("leaf").cogroup(filed.groupBy("leaf")).applyInArrow(score, "q long, rep long, score double")
    best = scored.groupBy("q", "rep").agg(F.max("score").alias("score"))
    top = Window.partitionBy("q").orderBy(F.col("score").desc(), "rep")
    best = base.stage(best.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1).drop("r").join(entries.select("rep", "ids"), "rep"))
    return asked.select(F.col("vec_id").alias("query_id"), "q").join(best, "q").select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id != query_id")

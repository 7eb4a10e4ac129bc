"""Quality: random-indexing word vectors pooled per document, a two-layer network, temperature-calibrated."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import base
from tidemark.llm.hashing import Hashes
from tidemark.llm.labelled import fold, training_rows

#: Rows of the hashed vocabulary and dimensions of the vectors.
VOCABULARY = 1 << 14
DIMENSIONS = 32
#: Words on either side that make up a context.
WINDOW = 2
#: Non-zero places of an index vector.
NONZERO = 4
PART_BYTES = 1 << 20
#: Rows of the vector table that are summed together.
BLOCK = 256

BLANK, WORD, SIGN = range(3)


def _classes() -> np.ndarray:
    kind = np.full(256, SIGN, np.uint8)
    kind[[0x20, *range(0x09, 0x0E)]] = BLANK
    kind[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = WORD
    return kind


CLASS = _classes()


def index_vectors() -> np.ndarray:
    """Sparse random vectors of +1 and -1, one per row of the vocabulary."""
    rng = np.random.default_rng(1)
    out = np.zeros((VOCABULARY, DIMENSIONS), np.float32)
    place = np.argsort(rng.random(out.shape), axis=1)[:, :NONZERO]
    np.put_along_axis(out, place, rng.choice([-1.0, 1.0], place.shape).astype(np.float32), axis=1)
    return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vocabulary row and text row of every token: runs of letters and digits, and runs of signs."""
    nothing = np.zeros(0, np.int64)
    if not len(data):
        return nothing, nothing
    upper = (data >= 65) & (data <= 90)
    folded = data + np.where(upper, 32, 0).astype(np.uint8)
    kind = CLASS[data]
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[offsets[:-1][np.diff(offsets) > 0]] = True
    start = np.flatnonzero(new)
    end = np.r_[start[1:], len(data)]
    real = kind[start] != BLANK
    start, end = start[real], end[real]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[start]
    return (Hashes(folded).of(start, end) % np.uint64(VOCABULARY)).astype(np.int64), row


def contexts(token: np.ndarray, row: np.ndarray, index: np.ndarray, into: np.ndarray) -> None:
    """Add the index vectors of each token's neighbours in its text to the token's row of ``into``."""
    if not len(token):
        return
    context = np.zeros((len(token), DIMENSIONS), np.float32)
    for d in range(1, WINDOW + 1):
        if len(token) > d:
            together = (row[d:] == row[:-d])[:, None]
            context[d:] += index[token[:-d]] * together
            context[:-d] += index[token[d:]] * together
    order = np.argsort(token, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(token[order]) != 0])
    into[token[order][first]] += np.add.reduceat(context[order], first, axis=0)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Random-indexing vectors of the hashed vocabulary over all documents, each of length one (unseen: zero).

    Every task adds up its own table, a fixed number of bytes whatever it reads; the tables are summed by blocks of
    rows, in two steps so that many tasks do not meet in one group. The result has a fixed size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        index, total = index_vectors(), np.zeros((VOCABULARY, DIMENSIONS), np.float64)
        for batch in batches:
            data, offsets = base.flat(batch.column("t"))
            for a, b in base.parts(offsets, PART_BYTES):
                contexts(*tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), index, total)
        blocks = [i for i in range(VOCABULARY // BLOCK) if total[i * BLOCK : (i + 1) * BLOCK].any()]
        salt = TaskContext.get().partitionId() % 256
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([salt] * len(blocks), pa.int32()), pa.array([total[i * BLOCK : (i + 1) * BLOCK].astype(np.int64).tobytes() for i in blocks], pa.binary())], ["block", "salt", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("sums").to_pylist())
        return pa.table({"block": table.column("block")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    rows = docs.select(F.col("text").cast("string").alias("t"))
    tables = rows.mapInArrow(run, "block int, salt int, sums binary").groupBy("block", "salt").applyInArrow(add, "block int, sums binary")
    out = np.zeros((VOCABULARY, DIMENSIONS))
    for r in tables.groupBy("block").applyInArrow(add, "block int, sums binary").collect():  # VOCABULARY x DIMENSIONS numbers
        out[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.sums, np.int64).reshape(BLOCK, DIMENSIONS)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.maximum(length, 1e-9)).astype(np.float32)


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Per text: mean and mean square of its word vectors, mean product of neighbouring ones, and the logarithm of the word count."""
    rows = len(offsets) - 1
    out = np.zeros((rows, 3 * DIMENSIONS + 1), np.float32)
    token, row = tokens(data, offsets)
    if not len(token):
        return out
    first = np.flatnonzero(np.r_[True, np.diff(row) != 0])
    which, count = row[first], np.diff(np.r_[first, len(row)])[:, None]
    x = vectors[token]
    near = np.zeros_like(x)
    near[1:] = x[1:] * x[:-1] * (row[1:] == row[:-1])[:, None]
    for i, values in enumerate((x, x * x, near)):
        out[which, i * DIMENSIONS : (i + 1) * DIMENSIONS] = np.add.reduceat(values, first, axis=0) / count
    out[which, -1] = np.log1p(count[:, 0])
    return out


@dataclass
class Network:
    """Two layers on standardized features; logits are divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -50, 50)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 80, batch: int = 256, rate: float = 3e-3, decay: float = 1e-4, seed: int = 3) -> Network:
    """Adam on the logistic loss; the temperature is fitted on a fifth of the rows that training does not see."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    apart, seen = order[: len(x) // 5], order[len(x) // 5 :]
    net = Network(x[seen].mean(0), np.maximum(x[seen].std(0), 1e-6), rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), 0.0)
    z = (x - net.mean) / net.scale
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        rng.shuffle(seen)
        for a in range(0, len(seen), batch):
            part = seen[a : a + batch]
            h = np.tanh(z[part] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -50, 50)))
            d = (p - y[part]) / len(part)
            dh = np.outer(d, params[2]) * (1 - h * h)
            step += 1
            for i, g in enumerate((z[part].T @ dh + decay * params[0], dh.sum(0), h.T @ d + decay * params[2], d.sum(keepdims=True))):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    if len(apart):
        logit = net.logit(x[apart])
        grid = np.geomspace(0.25, 8, 61)
        loss = [np.logaddexp(0, -np.where(y[apart] == 1, 1, -1) * logit / t).mean() for t in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, bound: int = 20_000, threshold: float = 0.7) -> DataFrame:
    """Fit on at most ``bound`` labelled rows outside the held-out fold and score every whole text.

    Word vectors are learned from all documents. Returns doc_id, held_out, score and predicted (score >= ``threshold``).
    Null and empty texts are scored as texts without words; a null doc_id has held_out null. Repeated rows are
    scored each; other columns are ignored; an empty table gives an empty result. With one label only, or none, the score is
    that label's constant (none: 0.5).
    """
    vectors = word_vectors(docs)
    wanted = training_rows(labels, "quality", folds, held_out, bound)
    rows = docs.select(F.col("doc_id").alias("k"), F.col("text").cast("string").alias("t"))
    known = rows.join(F.broadcast(wanted), rows.k == wanted.doc_id).select("label", "t")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = base.flat(batch.column("t"))
            parts = [pooled(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], vectors) for a, b in base.parts(offsets, PART_BYTES)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([x.tobytes() for p in parts for x in p], pa.binary())], ["label", "x"])

    seen = known.mapInArrow(features, "label int, x binary").collect()
    x = np.array([np.frombuffer(r.x, np.float32) for r in seen], np.float64).reshape(len(seen), 3 * DIMENSIONS + 1)
    y = np.array([r.label == 1 for r in seen], float)
    order = np.lexsort((*x.T[:4], y)) if len(x) else np.zeros(0, int)  # whatever order the rows came in
    x, y = x[order], y[order]
    net = train(x, y) if len(set(y.tolist())) == 2 else None
    constant = float(y[0]) if len(y) else 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = base.flat(batch.column("t"))
            found = [net.probability(pooled(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], vectors)) if net else np.full(b - a, constant) for a, b in base.parts(offsets, PART_BYTES)]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(np.concatenate(found) if found else np.zeros(0))], ["k", "score"])

    scored = rows.mapInArrow(run, f"k {dict(rows.dtypes)['k']}, score double").withColumnRenamed("k", "doc_id")
    return scored.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

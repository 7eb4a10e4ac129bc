"""Toxicity: a gapped subsequence kernel between words, summed over sentences, with Nyström landmarks and a support vector machine learned from labelled sentences."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import base, terms
from tidemark.llm.hashing import Hashes
from tidemark.llm.labelled import fold, training_rows

#: Offsets (second, third letter) of the subsequences of three letters, up to two letters left out in between.
TRIPLES = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
#: Weight of a subsequence for each letter left out.
DECAY = 0.6
#: Power of the kernel: sums over a sentence are then carried by its few words that resemble a landmark.
POWER = 4
LETTERS = 64
#: Strongest sentences of a document that its score is made of.
STRONGEST = 3
PART_BYTES = 1 << 21
#: Words that resemble no insult landmark at least this much count nothing.
ALIKE = 0.45
#: Words a task remembers as unlike all insults (a power of two).
REMEMBERED = 1 << 20
#: Words that are compared together, and words whose exact kernel values are computed together.
SIFTED, CHUNK = 20_000, 4000
#: Similarity histogram of a landmark candidate: bins between 0 and 1.
BINS = 100


def _letter_codes() -> np.ndarray:
    """ASCII letters fold to 1..26; bytes of other letters share the codes up to 63; everything else is 0."""
    code = np.zeros(256, np.uint8)
    for i in range(26):
        code[ord("a") + i] = code[ord("A") + i] = i + 1
    code[128:] = 27 + np.arange(128) % 37
    return code


CODE = _letter_codes()
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
SENTENCE_END = np.isin(np.arange(256), [ord(c) for c in ".!?\n"])


@dataclass
class Words:
    """Words of a part of text: letters only, so characters inserted between them are gone."""

    letters: np.ndarray  # folded bytes
    start: np.ndarray
    length: np.ndarray
    row: np.ndarray
    sentence: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words between ASCII white space; runs of single letters ("i d i o t") are one word."""
    nothing = np.zeros(0, np.int64)
    if not len(data):
        return Words(data, nothing, nothing, nothing, nothing)
    folded = data.copy()
    accented = np.zeros(len(data), bool)  # capital letters of the Latin-1 block
    accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    folded[accented] += 0x20
    upper = (data >= 65) & (data <= 90)
    folded[upper] += 32
    edge = BLANK[data]
    begins = offsets[:-1][np.diff(offsets) > 0]
    first = np.zeros(len(data), bool)
    first[begins] = True
    ended = np.zeros(len(data), bool)  # a full stop inside a word ("i.d.i.o.t") ends nothing
    ended[1:] = edge[1:] & SENTENCE_END[data[:-1]]
    ended |= data == 0x0A
    sentence = np.cumsum(ended | first)
    word = np.cumsum(edge | first)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.flatnonzero(CODE[data] > 0)
    letters, word = folded[at], word[at]
    new = np.ones(len(at), bool)
    new[1:] = word[1:] != word[:-1]
    start = np.flatnonzero(new)
    length = np.diff(np.r_[start, len(at)])
    single = length == 1
    if len(start):
        spelled = single[1:] & single[:-1] & (row[at[start[1:]]] == row[at[start[:-1]]])
        start = start[np.r_[True, ~spelled]]
        length = np.diff(np.r_[start, len(at)])
    return Words(letters, start, length, row[at[start]], sentence[at[start]])


def framed(letters: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of the given words with a mark (0) before and after each, end to end, and the word of each place."""
    owner = np.repeat(np.arange(len(start)), length + 2)
    first = np.cumsum(length + 2) - (length + 2)
    within = np.arange(len(owner)) - np.repeat(first, length + 2) - 1
    inside = (within >= 0) & (within < np.repeat(length, length + 2))
    code = np.zeros(len(owner), np.int32)
    code[inside] = CODE[letters[(np.repeat(start, length + 2) + within)[inside]]]
    return code, owner


def subsequences(code: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, number and weight of every subsequence of three letters."""
    found = []
    for a, b in TRIPLES:
        if len(code) > b:
            i = np.flatnonzero(owner[b:] == owner[:-b])
            found.append((owner[i], (code[i] * LETTERS + code[i + a]) * LETTERS + code[i + b], np.full(len(i), DECAY ** (b - 2), np.float32)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32)
    return tuple(np.concatenate(x) for x in zip(*found))


def norms(owner: np.ndarray, number: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Length of every word's vector of subsequence weights (a repeated subsequence adds up)."""
    key = owner * LETTERS**3 + number
    order = np.argsort(key, kind="stable")
    key = key[order]
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    sums = np.add.reduceat(weight[order].astype(float), begin) if len(key) else np.zeros(0)
    return np.sqrt(np.maximum(np.bincount(key[begin] // LETTERS**3, sums * sums, minlength=n), 1e-9))


class Landmarks:
    """Landmark words with their subsequence weights, ready for kernel values. The first ``insults`` of them decide which words count."""

    def __init__(self, some: list[bytes], insults: int | None = None) -> None:
        self.words = list(some)
        self.insults = len(some) if insults is None else insults
        owner, number, weight = subsequences(*framed(*_flat(self.words)))
        used, column = np.unique(number, return_inverse=True)
        self.dense = np.zeros((len(used), len(some)), np.float32)
        np.add.at(self.dense, (column, owner), weight)
        self.dense /= norms(owner, number, weight, len(some))
        self.place = np.full(LETTERS**3, -1, np.int32)
        self.place[used] = np.arange(len(used))
        self.most = np.zeros(LETTERS**3, np.float32)  # largest weight of a subsequence in any insult
        self.most[used] = self.dense[:, : self.insults].max(axis=1, initial=0)

    def __getstate__(self) -> dict:
        return {name: value for name, value in self.__dict__.items() if name != "_unlike"}

    def remembered(self) -> np.ndarray:
        """Hashes of words met in this task that resemble no insult, each at its place."""
        if not hasattr(self, "_unlike"):
            self._unlike = np.zeros(REMEMBERED, np.uint64)
        return self._unlike

    def exact(self, letters: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Normalized kernel values of words against the landmarks."""
        out = np.zeros((len(start), len(self.words)), np.float32)
        for a in range(0, len(start), CHUNK):
            n = min(CHUNK, len(start) - a)
            owner, number, weight = subsequences(*framed(letters, start[a : a + n], length[a : a + n]))
            size = norms(owner, number, weight, n)
            at = self.place[number]
            hit = np.flatnonzero(at >= 0)
            hit = hit[np.argsort(owner[hit], kind="stable")]
            if len(hit):
                own = owner[hit]
                begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                out[a + own[begin]] = np.add.reduceat(self.dense[at[hit]] * weight[hit][:, None], begin, axis=0)
            out[a : a + n] /= size[:, None]
        return np.minimum(out, 1, out=out)

    def alike(self, letters: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words that resemble an insult landmark by ``ALIKE`` or more, and their kernel values with all landmarks.

        A word is compared exactly only if its subsequences, each with the largest weight that any insult gives it, could reach that.
        """
        found = []
        for a in range(0, len(start), SIFTED):
            n = min(SIFTED, len(start) - a)
            code, owner = framed(letters, start[a : a + n], length[a : a + n])
            bound, size = np.zeros(len(code), np.float32), np.zeros(len(code), np.float32)
            for x, y in TRIPLES:
                if len(code) > y:
                    value = self.most[(code[:-y] * LETTERS + code[x : len(code) - y + x]) * LETTERS + code[y:]] * np.float32(DECAY ** (y - 2))
                    inside = owner[y:] == owner[:-y]
                    bound[:-y] += value * inside
                    size[:-y] += inside * np.float32(DECAY ** (2 * (y - 2)))
            begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            reach = np.add.reduceat(bound, begin) >= 0.999 * ALIKE * np.sqrt(np.add.reduceat(size, begin))
            found.append(a + np.flatnonzero(reach))
        maybe = np.concatenate(found) if found else np.zeros(0, np.int64)
        k = self.exact(letters, start[maybe], length[maybe])
        use = k[:, : self.insults].max(axis=1, initial=0) >= ALIKE
        return maybe[use], k[use]

    def kernel(self, some: list[bytes]) -> np.ndarray:
        return self.exact(*_flat(some)).astype(float)


def _flat(some: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    length = np.array([len(x) for x in some], np.int64)
    return np.frombuffer(b"".join(some), np.uint8), np.cumsum(length) - length, length


def kernel(some: list[bytes], landmarks: list[bytes]) -> np.ndarray:
    """Normalized kernel values of words against landmarks."""
    return Landmarks(landmarks).kernel(some)


@dataclass
class Found:
    """The words of a part of text that resemble an insult, each once for every document, at its first place."""

    row: np.ndarray
    sentence: np.ndarray  # number within the part
    kernel: np.ndarray  # powered kernel values with all landmarks
    word: list[bytes]

    @staticmethod
    def of(landmarks: Landmarks, data: np.ndarray, offsets: np.ndarray) -> Found:
        """A word counts once a document, so repeated lines add nothing. Words already known to be unlike all insults are skipped."""
        w = words(data, offsets)
        if not len(w.start):
            return Found(w.row, w.sentence, np.zeros((0, len(landmarks.words)), np.float32), [])
        value = Hashes(w.letters).of(w.start, w.start + w.length)
        known = landmarks.remembered()
        slot = (value & np.uint64(REMEMBERED - 1)).astype(np.int64)
        fresh = np.flatnonzero(known[slot] != value)
        once, first, number = np.unique(value[fresh], return_index=True, return_inverse=True)
        first = fresh[first]
        at, k = landmarks.alike(w.letters, w.start[first], w.length[first])
        like = np.full(len(once), -1)
        like[at] = np.arange(len(at))
        unlike = once[like < 0]
        known[(unlike & np.uint64(REMEMBERED - 1)).astype(np.int64)] = unlike
        place = np.flatnonzero(like[number] >= 0)
        which, place = like[number[place]], fresh[place]
        _, kept = np.unique(w.row[place] * np.int64(max(1, len(at))) + which, return_index=True)
        kept.sort()
        which, place = which[kept], place[kept]
        raw = w.letters.tobytes()
        text = [raw[x : x + n] for x, n in zip(w.start[first[at]].tolist(), w.length[first[at]].tolist())]
        return Found(w.row[place], w.sentence[place], k[which] ** POWER, [text[i] for i in which.tolist()])


@dataclass
class Model:
    landmarks: Landmarks | None
    beta: np.ndarray
    theta: np.ndarray = field(default_factory=lambda: np.zeros(STRONGEST + 1))  # of the strongest sentences; the last is the shift

    def strongest(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Largest sentence values of every row, in falling order; a sentence's value is the sum over its words, at least 0."""
        out = np.zeros((len(offsets) - 1, STRONGEST))
        if self.landmarks is None:
            return out
        f = Found.of(self.landmarks, data, offsets)
        known, sentence = np.unique(f.sentence, return_inverse=True)
        row = np.zeros(len(known), np.int64)
        row[sentence] = f.row
        value = np.maximum(np.bincount(sentence, f.kernel @ self.beta, minlength=len(known)), 0)
        order = np.lexsort((-value, row))
        row = row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        top = rank < STRONGEST
        out[row[top], rank[top]] = value[order[top]]
        return out

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.strongest(data, offsets) @ self.theta[:-1] + self.theta[-1]

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(margin, -50, 50)))


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine with squared hinge loss: Newton steps, halved until the loss falls."""
    x = np.c_[x, np.ones(len(x))]
    diagonal = np.r_[np.full(x.shape[1] - 1, ridge), ridge * 1e-3]
    w, f = np.zeros(x.shape[1]), np.zeros(len(x))

    def loss(f: np.ndarray, w: np.ndarray) -> float:
        return float((weight * np.maximum(1 - y * f, 0) ** 2).sum() + (diagonal * w * w).sum())

    least = loss(f, w)
    for _ in range(rounds):
        active = y * f < 1
        xa = x[active] * weight[active, None]
        step = np.linalg.solve(xa.T @ x[active] + np.diag(diagonal), xa.T @ y[active]) - w
        along, size = x @ step, 1.0
        while size > 1e-6 and loss(f + size * along, w + size * step) >= least - 1e-9 * abs(least):
            size /= 2
        if size <= 1e-6:
            break
        w, f = w + size * step, f + size * along
        least = loss(f, w)
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, label: np.ndarray, weight: np.ndarray | float = 1.0, balance: float = 0.5, ridge: float = 1e-3, rounds: int = 200) -> np.ndarray:
    """Weights and shift of a logistic curve: Newton steps, halved until the loss falls, so they cannot cycle.

    Rows of label 1 weigh (clean rows / toxic rows) ** balance times their weight. No weight is negative: such a column is left out.
    """
    use = np.ones(x.shape[1], bool)
    share = np.where(label == 1, (max(1, (label != 1).sum()) / max(1, (label == 1).sum())) ** balance, 1.0) * weight
    while True:
        z = np.c_[x[:, use], np.ones(len(x))]
        theta = np.zeros(z.shape[1])

        def loss(theta: np.ndarray) -> float:
            f = z @ theta
            return float((share * (np.logaddexp(0, f) - label * f)).sum() + ridge * (theta @ theta))

        least = loss(theta)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ theta, -50, 50)))
            curve = (z * (share * p * (1 - p))[:, None]).T @ z + 2 * ridge * np.eye(len(theta))
            step = np.linalg.solve(curve, z.T @ (share * (label - p)) - 2 * ridge * theta)
            size = 1.0
            while size > 1e-8 and loss(theta + size * step) >= least:
                size /= 2
            if size <= 1e-8:
                break
            theta = theta + size * step
            fell, least = least - loss(theta), loss(theta)
            if fell < 1e-9:
                break
        if (theta[:-1] >= 0).all() or not use.any():
            out = np.zeros(x.shape[1] + 1)
            out[np.r_[use, True]] = theta
            return out
        use[np.flatnonzero(use)[theta[:-1] < 0]] = False


def _spelled(rows: DataFrame) -> DataFrame:
    """(doc_id, label, word): every document's distinct words."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = base.flat(batch.column("t"))
            for a, b in base.parts(offsets, PART_BYTES):
                w = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if not len(w.start):
                    continue
                _, first, word = np.unique(Hashes(w.letters).of(w.start, w.start + w.length), return_index=True, return_inverse=True)
                entry = np.unique(w.row * len(first) + word)
                text = terms.as_array(w.letters, w.start[first], w.start[first] + w.length[first]).cast(pa.binary())
                at = pa.array(a + entry // len(first))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("label").take(at), text.take(pa.array(entry % len(first)))], ["doc_id", "label", "word"])

    return rows.mapInArrow(spell, "doc_id long, label int, word binary")


def _resemblance(spelled: DataFrame, counted: DataFrame, candidates: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Documents by label, candidate and bin of their largest kernel value with the candidate (values under ``ALIKE`` are not counted)."""
    marks = Landmarks(candidates)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, k = marks.alike(*_flat(batch.column("word").to_pylist()))
            word, mark = np.nonzero(k >= ALIKE)
            yield pa.RecordBatch.from_arrays(
                [batch.column("word").take(pa.array(at[word])), pa.array(mark.astype(np.int32)), pa.array(np.minimum(k[word, mark] * BINS, BINS - 1).astype(np.int32))], ["word", "mark", "bin"])

    near = base.stage(counted.select("word").mapInArrow(pairs, "word binary, mark int, bin int"))
    met = spelled.join(near, "word").groupBy("doc_id", "label", "mark").agg(F.max("bin").alias("bin"))
    counts = np.zeros((2, len(candidates), BINS))
    for r in met.groupBy("label", "mark", "bin").count().collect():
        counts[int(r.label == 1), r.mark, r.bin] += r["count"]
    return counts[1], counts[0]


def _significant(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, tail: float) -> np.ndarray:
    """Evidence of every candidate: log likelihood ratio of the toxic documents that resemble it more than all but ``tail`` of the clean ones."""
    above = np.cumsum(clean[:, ::-1], axis=1)[:, ::-1]
    edge = np.minimum((above > tail * n_clean).sum(axis=1), BINS - 1)
    at = np.arange(len(edge))
    found, missed = np.cumsum(toxic[:, ::-1], axis=1)[:, ::-1][at, edge], above[at, edge]
    expected = (missed + 0.5) / n_clean * n_toxic
    return np.where(found > expected, found * np.log(np.maximum(found, 1e-9) / expected) - (found - expected), 0.0)


def _with_letter(word: bytes, turn: int) -> bytes:
    """The word with one more letter inside, chosen from its own bytes."""
    at = 1 + (sum(word) + 7 * turn) % (len(word) - 1)
    return word[:at] + bytes([97 + (sum(word) * 5 + 11 * turn) % 26]) + word[at:]


def _witnesses(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Every document's strongest sentence: label, number of the sentence, landmark features; and the strongest word of it.

    A document without any word that resembles an insult brings an empty sentence.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = base.flat(batch.column("t"))
            for a, b in base.parts(offsets, PART_BYTES):
                f = Found.of(model.landmarks, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                value = f.kernel @ model.beta
                known, sentence = np.unique(f.sentence, return_inverse=True)
                row = np.zeros(len(known), np.int64)
                row[sentence] = f.row
                features = np.zeros((len(known), len(model.beta)), np.float32)
                np.add.at(features, sentence, f.kernel)
                best = np.full(b - a, -1)
                order = np.lexsort((features @ model.beta, row))
                best[row[order]] = order  # the last of a row is its strongest
                top = np.full(len(known), -1)
                order = np.lexsort((value, sentence))
                top[sentence[order]] = order
                has = best >= 0
                out = np.zeros((b - a, len(model.beta)), np.float32)
                out[has] = features[best[has]]
                first = np.searchsorted(row, np.arange(b - a))
                number = np.where(has, best - first, -1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("label").slice(a, b - a), pa.array(number.astype(np.int32)), pa.array([x.tobytes() for x in out], pa.binary()),
                     pa.array([f.word[top[i]] if i >= 0 else b"" for i in best.tolist()], pa.binary())],
                    ["doc_id", "label", "sentence", "features", "word"])

    got = rows.mapInArrow(run, "doc_id long, label int, sentence int, features binary, word binary").toArrow()
    features = np.frombuffer(b"".join(got.column("features").to_pylist()), np.float32).reshape(got.num_rows, len(model.beta))
    number = np.c_[got.column("doc_id").to_numpy(), got.column("sentence").to_numpy()]
    return got.column("label").to_numpy(), number, features, got.column("word").to_pylist()


def _machine(rows: DataFrame, model: Model, insults: list[tuple[bytes, float]], ridge: float, rounds: int) -> tuple[float, dict[bytes, float]]:
    """Fit ``model.beta`` in turns: toxic documents bring their strongest sentence, clean ones every sentence that was once their strongest.

    Insults are sentences of one word. Returns the bias and, for the strongest words of
    the clean sentences, how far they stand above the clean margin.
    """
    k = model.landmarks.kernel(model.landmarks.words) ** POWER
    size, vectors = np.linalg.eigh((k + k.T) / 2)
    root = vectors[:, size > 1e-3] / np.sqrt(size[size > 1e-3])
    alone = model.landmarks.kernel([w for w, _ in insults]) ** POWER
    alone_weight = np.array([n for _, n in insults])
    clean: dict[tuple[int, int], tuple[np.ndarray, bytes]] = {}
    bias = 0.0
    for _ in range(rounds):
        label, number, features, strongest = _witnesses(rows, model)
        for i in np.flatnonzero(label != 1):
            clean.setdefault((int(number[i, 0]), int(number[i, 1])), (features[i], strongest[i]))
        toxic = features[label == 1]
        against = np.stack([x for x, _ in clean.values()]) if clean else np.zeros((0, len(model.beta)), np.float32)
        x = np.r_[toxic.astype(float), alone, against] @ root
        y = np.r_[np.ones(len(toxic) + len(alone)), -np.ones(len(against))]
        w, bias = squared_hinge(x, y, np.r_[np.ones(len(toxic)), alone_weight, np.ones(len(against))], ridge)
        model.beta = root @ w
    above: dict[bytes, float] = {}
    for (features, word), value in zip(clean.values(), against @ model.beta + bias):
        above[word] = above.get(word, 0.0) + max(0.0, float(value) + 1)
    return bias, above


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, bound: int = 20_000, candidates: int = 400, landmarks: int = 96, clean_landmarks: int = 64, landmark_bytes: int = 64, ridge: float = 0.1) -> Model:
    """Learn from at most ``bound`` labelled documents outside the held-out fold.

    Landmarks: the ``candidates`` words (of at most ``landmark_bytes``) that toxic documents have most often against clean ones are
    compared with the words of all training documents; those that toxic documents *resemble* significantly more often stay, and
    the ``landmarks`` of most evidence that differ from each other are chosen.
    Sentences: every sentence of a clean document is clean; of a toxic one, the strongest is toxic, which is learned in turns.
    Insults alone, and insults with a letter put in, are toxic sentences too, so that the machine tolerates insertions.
    The clean words that the machine rates highest become up to ``clean_landmarks`` further landmarks (one for
    twenty clean documents), and it is fitted again with the clean sentences it then mistakes.
    A document's score is a logistic curve over its three strongest sentences. Without both labels, or without
    any significant word, the score is constant: below 0.5, or above it where no row is clean.
    """
    wanted = training_rows(labels, "toxic", folds, held_out, bound)
    rows = base.stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("t")).join(F.broadcast(wanted), "doc_id").repartition(16))
    sizes = {r.label: r.n for r in wanted.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sum(n for x, n in sizes.items() if x != 1)
    constant = Model(None, np.zeros(0), np.r_[np.zeros(STRONGEST), 20.0 if n_toxic and not n_clean else -20.0])
    if not n_toxic or not n_clean:
        return constant
    spelled = base.stage(_spelled(rows))
    counted = base.stage(spelled.groupBy("word").agg(F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("label") == 1, 0).otherwise(1)).alias("b")))
    odds = F.log((F.col("a") + 0.1) / n_toxic) - F.log((F.col("b") + 0.1) / n_clean)
    strong = counted.where((F.col("a") >= 2) & (F.length("word") >= 3) & (F.length("word") <= landmark_bytes) & (odds > 2)).orderBy((odds * F.sqrt("a")).desc(), "word").limit(candidates).collect()
    if not strong:
        return constant
    candidate, often = [bytes(r.word) for r in strong], np.array([float(r.a) for r in strong])
    evidence = _significant(*_resemblance(spelled, counted, candidate), n_toxic, n_clean, 0.01)
    real = np.flatnonzero(evidence > 3)
    if not len(real):
        return constant
    alike = kernel([candidate[i] for i in real], [candidate[i] for i in real]) ** POWER
    chosen: list[int] = []
    left = np.ones(len(real))
    while len(chosen) < min(landmarks, len(real)):
        best = int(np.argmax(evidence[real] * left))
        if left[best] <= 1e-6:
            break
        chosen.append(best)
        left = np.minimum(left, 1 - np.minimum(alike[best], 1) ** 2)
        left[best] = 0
    insults = [(candidate[i], often[i]) for i in real]
    insults += [(_with_letter(w, t), 0.25 * n) for w, n in insults if len(w) >= 4 for t in range(2)]
    model = Model(Landmarks([candidate[real[i]] for i in chosen]), np.full(len(chosen), 1 / len(chosen)))
    _, above = _machine(rows, model, insults, ridge, 2)
    known = set(model.landmarks.words)
    further = [w for w, x in sorted(above.items(), key=lambda p: (-p[1], p[0])) if x > 0 and w not in known and 0 < len(w) <= landmark_bytes][: min(clean_landmarks, n_clean // 20)]
    model = Model(Landmarks([*model.landmarks.words, *further], len(chosen)), np.r_[model.beta, np.zeros(len(further))])
    _machine(rows, model, insults, ridge, 3)
    seen = _strongest(rows, model, ("label",)).toPandas()
    alone = np.zeros((len(insults), STRONGEST))
    alone[:, 0] = model.landmarks.kernel([w for w, _ in insults]) ** POWER @ model.beta
    weight = np.array([n for _, n in insults])
    x = np.r_[seen[[f"s{i}" for i in range(STRONGEST)]].to_numpy(), alone]
    label = np.r_[(seen["label"] == 1).to_numpy().astype(float), np.ones(len(alone))]
    model.theta = logistic(x, label, np.r_[np.ones(len(seen)), weight * n_toxic / weight.sum() / 4])
    return model


def _strongest(rows: DataFrame, model: Model, keep: tuple[str, ...], text: str = "t") -> DataFrame:
    kinds = dict(rows.dtypes)
    names = [f"s{i}" for i in range(STRONGEST)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = base.flat(batch.column(text))
            found = [model.strongest(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in base.parts(offsets, PART_BYTES)]
            found = np.concatenate(found) if found else np.zeros((0, STRONGEST))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(found[:, i]) for i in range(STRONGEST)]], [*keep, *names])

    return rows.mapInArrow(run, ", ".join([*[f"{c} {kinds[c]}" for c in keep], *[f"{n} double" for n in names]]))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, score and predicted (score >= 0.5) of every row, by its whole text (null: empty). No shuffle."""
    names = tuple(f"k{i}" for i in range(len(keep)))
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], *([] if "text" in keep else [F.col("text").cast("string").alias("t")]))
    margin = F.lit(float(model.theta[-1]))
    for i in range(STRONGEST):
        margin = margin + F.lit(float(model.theta[i])) * F.col(f"s{i}")
    curve = 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), margin))))
    found = _strongest(rows, model, names, names[keep.index("text")] if "text" in keep else "t")
    return found.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], curve.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, bound: int = 20_000) -> DataFrame:
    """Fit on the labelled rows outside the held-out fold and score every document.

    Returns doc_id, held_out, score and predicted. Null and empty texts get the score of a text without words; a null
    doc_id is held out of nothing (held_out null). Repeated rows are scored each; other columns are ignored; an
    empty table gives an empty result.
    """
    model = fit(docs, labels, folds, held_out, bound)
    return score(docs, model).select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score", "predicted")

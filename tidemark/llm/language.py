"""Language of web pages: text likelihood, declared language, address suffix and host priors fused by Bayes' rule."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import base

#: Hashed letter trigrams.
GRAMS = 1 << 16
#: Rows of the count tables that are summed together.
BLOCK = 1 << 13
PART_BYTES = 1 << 21
#: A text counts as at most so many independent trigrams: neighbours repeat each other's evidence.
EVIDENCE = 60.0
#: Pseudo-pages by which a host leans on its domain, a domain on its suffix, a suffix on all pages; and a declaration on all.
PRIOR_PAGES = 4.0
#: Languages whose tables a task holds at once; all are told apart.
AT_ONCE = 64

MARKUP = re.compile(rb"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")


def _letters() -> np.ndarray:
    code = np.zeros(256, np.uint32)
    for i in range(26):
        code[ord("a") + i] = code[ord("A") + i] = i + 1
    code[128:] = np.arange(128) + 27
    return code


LETTER = _letters()


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of letters (other characters: one blank between words) and the row of each."""
    nothing = np.zeros(0, np.int64)
    if not len(data):
        return nothing, nothing
    code = LETTER[data]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keep = code > 0
    keep[1:] |= (code[1:] == 0) & (code[:-1] > 0) & (row[1:] == row[:-1])
    code, row = code[keep].astype(np.uint64), row[keep]
    if len(code) < 3:
        return nothing, nothing
    key = (code[:-2] * np.uint64(155) + code[1:-1]) * np.uint64(155) + code[2:]
    inside = (row[2:] == row[:-2]) & (code[1:-1] > 0)
    return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)[inside], row[2:][inside]


def visible(page: bytes) -> bytes:
    """Text of a page without markup, scripts and comments."""
    return html.unescape(MARKUP.sub(b" ", page).decode("utf-8", "replace")).encode()


def gram_tables(docs: DataFrame, languages: list[str], at_once: int = AT_ONCE) -> DataFrame:
    """Trigram counts over all documents of the languages, in rows (block, sums) of BLOCK counts. A task adds up ``at_once`` tables of fixed size and hands them on when others come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = {x: i for i, x in enumerate(languages)}
        held: dict[int, int] = {}
        total = np.zeros((at_once, GRAMS), np.int64)
        salt = TaskContext.get().partitionId() % 256

        def sums() -> pa.RecordBatch:
            rows = [(i, at, j) for i, at in held.items() for j in range(GRAMS // BLOCK) if total[at, j * BLOCK : (j + 1) * BLOCK].any()]
            tables = [total[at, j * BLOCK : (j + 1) * BLOCK].tobytes() for _, at, j in rows]
            return pa.RecordBatch.from_arrays([pa.array([i * (GRAMS // BLOCK) + j for i, _, j in rows], pa.int32()), pa.array([salt] * len(rows), pa.int32()), pa.array(tables, pa.binary())], ["block", "salt", "sums"])

        for batch in batches:
            data, offsets = base.flat(batch.column("t"))
            lang = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            for a, b in base.parts(offsets, PART_BYTES):
                gram, row = grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                found = np.unique(lang[a:b])
                for c in range(0, len(found), at_once):
                    some = found[c : c + at_once].tolist()
                    if len(held.keys() | set(some)) > at_once:
                        yield sums()
                        held.clear()
                        total[:] = 0
                    for i in some:
                        held.setdefault(i, len(held))
                    place = np.full(len(languages), -1)
                    place[some] = [held[i] for i in some]
                    at = place[lang[a:b]][row]
                    total += np.bincount((at * GRAMS + gram)[at >= 0], minlength=total.size).reshape(total.shape)
        yield sums()

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("sums").to_pylist())
        return pa.table({"block": table.column("block")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    rows = docs.where(F.col("lang").isin(languages)).select(F.col("lang"), F.col("text").cast("string").alias("t"))
    tables = rows.mapInArrow(run, "block int, salt int, sums binary").groupBy("block", "salt").applyInArrow(add, "block int, sums binary")
    return tables.groupBy("block").applyInArrow(add, "block int, sums binary")


def dense(tables: DataFrame, start: int, end: int) -> np.ndarray:
    """Trigram counts (language x GRAMS) of the languages ``start`` to ``end``."""
    out = np.zeros((end - start) * GRAMS)
    first, last = start * (GRAMS // BLOCK), end * (GRAMS // BLOCK)
    for r in tables.where((F.col("block") >= first) & (F.col("block") < last)).collect():  # (end - start) x GRAMS numbers at most
        out[(r.block - first) * BLOCK : (r.block - first + 1) * BLOCK] = np.frombuffer(r.sums, np.int64)
    return out.reshape(-1, GRAMS)


def gram_counts(docs: DataFrame, languages: list[str]) -> np.ndarray:
    """Trigram counts (language x GRAMS) over all documents of the languages."""
    return dense(gram_tables(docs, languages, min(AT_ONCE, len(languages))), 0, len(languages))


def log_rates(counts: np.ndarray) -> np.ndarray:
    """Smoothed log probability of every trigram in every language."""
    return np.log(counts + 0.5) - np.log(counts.sum(1, keepdims=True) + 0.5 * GRAMS)


def text_posterior(data: np.ndarray, offsets: np.ndarray, rates: np.ndarray | Iterable[np.ndarray]) -> np.ndarray:
    """Posterior of the languages by text alone, with equal priors; flat for a text without trigrams. The rates may come in blocks of languages."""
    gram, row = grams(data, offsets)
    n = len(offsets) - 1
    count = np.bincount(row, minlength=n)
    parts = []
    for block in [rates] if isinstance(rates, np.ndarray) else rates:
        part = np.zeros((n, len(block)))
        if len(gram):
            for i, r in enumerate(block):
                part[:, i] = np.bincount(row, weights=r[gram], minlength=n)
        parts.append(part)
    out = np.concatenate(parts, axis=1)
    out *= (np.minimum(1.0, EVIDENCE / np.maximum(count, 1)))[:, None]
    out = np.exp(out - out.max(1, keepdims=True))
    return out / out.sum(1, keepdims=True)


def _loaded(blocks: list[Broadcast]) -> Iterator[np.ndarray]:
    """The blocks one after another; a single one stays in memory, of several only the one in use."""
    for b in blocks:
        yield b.value if len(blocks) == 1 or b._path is None else b.load_from_path(b._path)


def evidence(pages: DataFrame, blocks: list[Broadcast], page_id: str) -> DataFrame:
    """page_id, host, domain, suffix, declared and the posterior by text (p) of every page."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.nullif(host, F.lit("")).alias("host"),
        F.nullif(F.lower(F.regexp_extract(F.coalesce(F.col("html"), F.lit("")), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,8})", 1)), F.lit("")).alias("declared"),
        F.col("html").cast("string").alias("t"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = base.flat(batch.column("t"))
            found = []
            for a, b in base.parts(offsets, PART_BYTES):
                texts = [visible((x or "").encode()) for x in batch.column("t").slice(a, b - a).to_pylist()]
                ends = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
                found.append(text_posterior(np.frombuffer(b"".join(texts), np.uint8), ends, _loaded(blocks)))
            p = np.concatenate(found) if found else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), batch.column("declared"), pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))], ["page_id", "host", "declared", "p"])

    out = rows.mapInArrow(run, f"page_id {dict(rows.dtypes)['page_id']}, host string, declared string, p array<double>")
    labels = F.split(F.col("host"), r"\.")
    return out.select("page_id", "host", F.when(F.size(labels) > 1, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(F.col("host")).alias("domain"), F.element_at(labels, -1).alias("suffix"), "declared", "p")


def _sums(rows: DataFrame, n: int, *keys: str, at_once: int = AT_ONCE) -> DataFrame:
    """Element-wise sums of p per key, in blocks of ``at_once`` languages."""
    piece = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit((n - 1) // at_once)), lambda i: F.slice("p", i * at_once + 1, at_once)))
    parts = rows.select(*keys, piece.alias("i", "piece")).groupBy(*keys, "i").agg(*[F.sum(F.get("piece", F.lit(j))).alias(f"s{j}") for j in range(min(n, at_once))])
    blocks = parts.select(*keys, F.struct("i", F.array(*[F.col(f"s{j}") for j in range(min(n, at_once))]).alias("s")).alias("b"))
    whole = F.flatten(F.transform(F.sort_array(F.collect_list("b")), lambda b: b["s"]))
    return blocks.groupBy(*keys).agg(F.slice(whole, 1, n).alias("sums"))


def _less(sums: Column, own: Column) -> Column:
    """Sums without the page's own share (never below zero)."""
    return F.when(sums.isNotNull(), F.zip_with(sums, own, lambda s, x: F.greatest(s - x, F.lit(0.0))))


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def _lean(sums: Column, parent: Column) -> Column:
    """A level's distribution, smoothed towards its parent by PRIOR_PAGES pages; the parent itself where the level is unknown."""
    mixed = F.zip_with(sums, parent, lambda s, p: (s + PRIOR_PAGES * p) / (_total(sums) + PRIOR_PAGES))
    return F.when(sums.isNotNull(), mixed).otherwise(parent)


def identify(pages: DataFrame, docs: DataFrame, page_id: str = "page_id", at_once: int = AT_ONCE) -> DataFrame:
    """Language of every page, among all languages of ``docs``; ``at_once`` of them are held in memory together.

    ``docs`` (text, lang) teach the trigram rates, all of them; ``pages`` need ``page_id``, url and html. The posterior
    by text of all pages is summed per suffix, domain, host and declared language; a page's prior is its
    host's distribution without the page itself, smoothed towards domain, suffix and all pages in turn, and its declared
    language counts by how often pages of each language declare it. The posterior is proportional to text
    likelihood x prior x declaration.

    Returns page_id, lang (ties: first by name), confidence, text_lang (by text alone), declared, host. Missing urls, hosts and
    declarations are no evidence; a page without letters is decided by the rest. Repeated rows are
    returned each; other columns are ignored. Without any document of known language lang is null; an empty table gives
    an empty result.
    """
    languages = sorted(r.lang for r in docs.where("lang is not null").select("lang").distinct().collect())
    n = len(languages)
    tables = base.stage(gram_tables(docs, languages, min(at_once, n))) if n else None
    share = pages.sparkSession.sparkContext.broadcast
    blocks = [share(log_rates(dense(tables, a, min(n, a + at_once)))) for a in range(0, n, at_once)] or [share(np.zeros((1, GRAMS)))]
    rows = base.stage(evidence(pages, blocks, page_id))
    for b in blocks:
        b.destroy()
    if not n:
        return rows.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("text_lang"), "declared", "host")
    everything = base.stage(_sums(rows.withColumn("one", F.lit(0)), n, "one", at_once=at_once)).first()
    everywhere = F.array(*[F.lit(float(x)) for x in (everything.sums if everything else [0.0] * n)])
    joined = rows
    for key in ("suffix", "domain", "host", "declared"):
        joined = joined.join(base.stage(_sums(rows.where(F.col(key).isNotNull()), n, key, at_once=at_once)).withColumnRenamed("sums", f"{key}_sums"), key, "left")
    joined = joined.withColumn("level", F.transform(_less(everywhere, F.col("p")), lambda s: s + 0.5))
    joined = joined.withColumn("rate", F.transform("level", lambda s: s)).withColumn("level", F.transform("level", lambda s: s / _total(F.col("rate"))))
    joined = joined.withColumn("everyone", F.col("level"))
    for key in ("suffix", "domain", "host"):
        joined = joined.withColumn(f"{key}_own", _less(F.col(f"{key}_sums"), F.col("p"))).withColumn("level", _lean(F.col(f"{key}_own"), F.col("level")))
    # how often a page of each language declares what this one does, leaning on how often any page does
    said = _less(F.col("declared_sums"), F.col("p"))
    often = (_total(F.col("said")) + 0.5) / (_total(F.col("rate")) + 1.0)
    joined = joined.withColumn("said", said).withColumn(
        "declares", F.when(F.col("said").isNotNull(), F.zip_with("said", "rate", lambda s, r: (s + PRIOR_PAGES * often) / (r + PRIOR_PAGES))).otherwise(F.transform("p", lambda x: F.lit(1.0)))
    )
    joined = joined.withColumn("joint", F.zip_with(F.zip_with("p", "level", lambda a, b: a * b), "declares", lambda a, b: a * b))
    names = F.array(*[F.lit(x) for x in languages])
    best = lambda x: F.element_at(names, F.array_position(x, F.array_max(x)).cast("int"))
    return joined.select("page_id", best(F.col("joint")).alias("lang"), (F.array_max("joint") / _total(F.col("joint"))).alias("confidence"), best(F.col("p")).alias("text_lang"), "declared", "host")

"""Registered queries of this package, their SQL, and the corpus pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import base

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle.strip()
        return fn

    return wrap


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file on this machine (every node has them installed)."""
    import public_tokenizers

    return public_tokenizers.path(name)


MIXING_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS n FROM d GROUP BY source),
w AS (SELECT *, [1, 2, 3][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::HUGEINT AS w, 3 * n AS cap, sum(n) OVER () AS total FROM s),
r AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS given,
             sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS w_left FROM w),
c AS (SELECT *, cap * w_left < w * (total - given) AS capped FROM r),
t AS (
  SELECT source, n, CASE WHEN capped THEN cap::DOUBLE ELSE
    ((total - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0)) * w)::DOUBLE / (sum(CASE WHEN NOT capped THEN w END) OVER ())::DOUBLE END AS target
  FROM c),
o AS (
  SELECT d.doc_id, d.size, t.n, t.target, d.source, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN n > 0 THEN floor(target)::BIGINT // n::BIGINT ELSE 0 END AS epochs FROM o)
SELECT doc_id, size, n::BIGINT AS source_size, target,
       (epochs * size + greatest(0, least(floor(target)::BIGINT - epochs * n::BIGINT - before, size)))::BIGINT AS taken, source
FROM e
"""


@query("op1_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality import quality

    return quality(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "labels"))


@query("op2_source_mix", MIXING_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixing import mix

    return mix(base.table(spark, sf_dir, "documents"))


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.toxicity import toxicity

    return toxicity(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "labels"))


@query("op4_language")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.language import identify

    return identify(base.table(spark, sf_dir, "pages"), base.table(spark, sf_dir, "documents"))


HAMMING_SQL = """
WITH c AS (
  SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 AND NOT isnan(embedding[i]) THEN 1::HUGEINT << (i - 1)::INT ELSE 0::HUGEINT END))::HUGEINT AS code
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS id, bit_count(xor(q.code, c.code))::INT AS distance FROM c q, c WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY distance, id))::INT AS rank, id, distance
FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= 10
"""


@query("op5_code_search", HAMMING_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.hamming import sign_codes, top_k

    codes = base.stage(sign_codes(base.table(spark, sf_dir, "embeddings")))
    return top_k(codes, codes.where("id % 100 = 0"))


@query("op6_simhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.simhash import near_duplicates

    return near_duplicates(base.table(spark, sf_dir, "documents"))


@query("op7_suffix_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.suffix_dedup import dedup

    return dedup(base.table(spark, sf_dir, "documents"))


@query("op8_neighbours")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.neighbours import nearest

    return nearest(base.table(spark, sf_dir, "embeddings"))


@query("op9_word_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.word_bpe import code_digests

    return code_digests(base.table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.token_counts import token_counts

    return token_counts(base.table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


RANKED_SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
c AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM t WHERE term IN (SELECT term FROM i) GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
m AS (SELECT doc_id, (50 + (50 * n * n_docs) // n_terms)::BIGINT AS m FROM d, c),
s AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM i JOIN p USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""


@query("op11_ranked_search", RANKED_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.ranked_search import search

    return search(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "benchmark"))


@query("op12_fingerprints")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.fingerprints import edited_texts

    return edited_texts(base.table(spark, sf_dir, "documents"))


@query("op13_variants")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.variants import variants

    return variants(base.table(spark, sf_dir, "documents"))

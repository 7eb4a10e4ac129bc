"""The corpus pipeline: stages over the documents table, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import base
from tidemark.llm.mixing import mixed_documents
from tidemark.llm.queries import vocabulary
from tidemark.llm.simhash import one_of_each
from tidemark.llm.suffix_dedup import without_repeats
from tidemark.llm.toxicity import fit, score
from tidemark.llm.word_bpe import code_digests

#: Tables staged by the stage before; its result is written by the time the next stage begins.
_STAGED: list[str] = []


def stage(work):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        base.prepare(spark)
        base.release(spark, _STAGED)
        with base.collecting(_STAGED):
            return work(spark, docs, sf_dir)

    return run


@stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents predicted toxic by the model of the labelled rows outside the held-out fold."""
    model = fit(docs, base.table(spark, sf_dir, "labels"))
    return score(docs, model, tuple(docs.columns)).where("predicted = 0").select(*docs.columns)


@stage
def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group of near duplicates."""
    return one_of_each(docs)


@stage
def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out of every text what repeats 100 bytes of an earlier place; n_chars follows the text."""
    return without_repeats(docs).withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))


@stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give every source its share of the words; a document may be repeated or left out."""
    return mixed_documents(docs).withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))


@stage
def word_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode every text: token count and digests."""
    return code_digests(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("simhash", simhash), ("suffix_dedup", suffix_dedup), ("source_mix", source_mix), ("word_bpe", word_bpe)]

#: The learned and the byte-level stages have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written to the shared folder and read again.

    A stage that keeps no row of a table that had some stops the run: that is a failed model, not a result.
    """
    docs = base.table(spark, sf_dir, "documents")
    for name, work in STAGES[:-1]:
        had_rows = not docs.isEmpty()
        docs = base.stage(work(spark, docs, sf_dir))
        if had_rows and docs.isEmpty():
            raise RuntimeError(f"stage {name} kept no document")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Labelled rows for the classifiers: a bounded sample chosen by hash, and the held-out fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the doc_id as text, modulo ``folds`` (null doc_id: null)."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(folds))


def training_rows(labels: DataFrame, label: str, folds: int, held_out: int, bound: int) -> DataFrame:
    """(doc_id, label) of at most ``bound`` labelled documents outside the held-out fold, in the order of a hash.

    Rows without doc_id or label are left out; a document labelled more than once gets its largest label.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null")
    learn = known.where(fold("doc_id", folds) != held_out).groupBy("doc_id").agg(F.max("label").alias("label"))
    return learn.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)

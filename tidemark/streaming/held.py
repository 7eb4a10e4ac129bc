"""Held sends: rows that wait in a table for their next check, and a sink that decides the due ones."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.rows import keep_first
from tidemark.sinks.tables import expire_table, has_rows
from tidemark.streaming.jobs import _of_batch, _put, run_once

START = -62_135_596_800_000_000  # year 1, before any clock
DAY_US = 86_400_000_000
CLOCK = T.StructType([T.StructField("us", T.LongType())])


@dataclass(frozen=True)
class DueSends:
    """A stream of held rows, the key of a row, and the clock that makes it due."""

    held: DataFrame
    keys: Sequence[str]
    next_at: str
    received: str
    disorder: str


def due_sends(held: DataFrame, keys: Sequence[str], next_at: str, received: str, disorder: str = "1 hour") -> DueSends:
    """The held rows whose check has come: all their columns, with due_at and checks (how many until now).

    A stream of held rows waits until ``next_at``, one row a key of ``keys``: a redelivery of a waiting key changes nothing, so the check
    never slides. The clock is the largest ``received`` so far, the time the service took a row in, less ``disorder``. A row whose check has
    passed already is due at once (also one without ``next_at``), however late it comes. ``run_held`` gives the due rows to a sink.
    """
    return DueSends(held, list(keys), next_at, received, disorder)


def held_table(folder: str, due: DueSends, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink that keeps waiting rows in a table and hands those whose check has come to ``sink``.

    A row is written once, by the day of its check and the batch that brought it, and is due in the first batch whose clock has reached
    it. So whether it still waits follows from the clocks, and nothing is rewritten or marked: a batch reads the rows due between the clock before
    and its own, and of the others that wait only their keys. Days behind the clock are deleted.

    Every batch owns its partitions of the table and of the clock, so a replayed batch changes nothing.
    """
    table, clocks = f"{folder}/waiting", f"{folder}/clock"
    keys, body = due.keys, [c for c in due.held.columns if c != "checks"]
    order = [f.name for f in due.held.schema.fields if f.name not in keys and not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    at = lambda us: datetime(1970, 1, 1) + timedelta(microseconds=us)
    day = lambda us: F.lit(at(us).date().isoformat()).cast("date")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = _of_batch(spark, clocks, CLOCK, batch_id - 1).first() if batch_id else (START,)
        if last is None:
            raise RuntimeError(f"no clock of batch {batch_id - 1} in {folder}: its waiting rows are not here")
        before = last[0]
        seen = batch.agg(F.unix_micros(F.max(due.received) - F.expr(f"INTERVAL {due.disorder}"))).first()[0]
        clock = max(before, START if seen is None else seen)

        checks = F.col("checks").cast("int") if "checks" in batch.columns else F.lit(0)
        due_us = F.coalesce(F.unix_micros(due.next_at), F.unix_micros(due.received), F.lit(START))
        rows = batch.withColumn("checks", checks).withColumn("due_us", due_us).withColumn("due_day", F.date_from_unix_date(F.expr(f"cast((due_us - pmod(due_us, {DAY_US})) div {DAY_US} as int)")))
        stored = T.StructType([*rows.schema.fields, T.StructField("batch_id", T.LongType())])
        earlier = (F.col("batch_id") < batch_id) & (F.col("due_day") >= day(before))
        new = rows.withColumn("_new", F.lit(1))
        if has_rows(spark, table):
            expire_table(spark, table, "due_day", at(before), 0)
            # a key that waits stands before what arrives now
            known = spark.read.schema(stored).parquet(table).where(earlier & (F.col("due_us") > before))
            new = new.unionByName(known.select(*keys, F.lit(0).alias("_new")), allowMissingColumns=True)
        first = keep_first(new, keys, [F.col(c) for c in ("_new", due.received, "due_us", *order)]).where("_new = 1").drop("_new")
        _put(first.hint("rebalance", "due_day"), table, batch_id, "due_day")
        _put(spark.range(0, 1, 1, 1).select(F.lit(clock).cast("bigint").alias("us")), clocks, batch_id)

        own = F.col("batch_id") == batch_id
        come = (F.col("due_day") <= day(clock)) & (own | earlier) & (F.col("due_us") <= clock) & (own | (F.col("due_us") > before))
        ready = spark.read.schema(stored).parquet(table).where(come)
        sink(ready.select(*body, F.timestamp_micros("due_us").alias("due_at"), (F.col("checks") + 1).alias("checks")), batch_id)

    return write


def decide_due(folder: str, decide: Callable[[DataFrame, Column], DataFrame], next_at: str, received: str, again_s: int, deadline: str = "deadline_at") -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: due rows are decided as of their check; those still held wait again.

    ``decide(rows, now)`` returns the rows with ``status`` and their ``deadline``. Pending and skipped rows go to ``out``; a row
    that is still held is written to ``again`` with its next check ``again_s`` later, but not after one second past its
    deadline, when it is decided for the last time. ``again`` has the columns of the held stream: union it with the
    source. Every batch owns one partition of each table, so a replayed batch changes nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        columns = batch.columns
        decided = decide(batch, F.col("due_at")).persist()
        later = F.least(F.unix_micros("due_at") + again_s * 1_000_000, F.greatest(F.unix_micros(deadline), F.unix_micros("due_at")) + 1_000_000)
        still = F.col("status") == "held"
        waiting = decided.where(still).select(*[c for c in columns if c not in (next_at, received, "due_at")], F.col("due_at").alias(received), F.timestamp_micros(later).alias(next_at))
        for name, rows in (("out", decided.where(~still)), ("again", waiting), ("checked", decided)):
            rows.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{folder}/{name}")
        decided.unpersist()

    return write


def run_held(due: DueSends, sink: Callable[[DataFrame, int], None], checkpoint: str, state_partitions: int = 8) -> None:
    """Process what is there and stop; what still waits stays beside the checkpoint for the next run."""
    run_once(due.held, held_table(f"{checkpoint}/held", due, sink), checkpoint, "append", state_partitions)

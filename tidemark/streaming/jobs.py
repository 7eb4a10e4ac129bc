"""Structured Streaming forms of the ingestion jobs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.rows import keep_first
from tidemark.sinks.tables import KEY_BUCKET, has_rows, logged, with_bucket


def dedup(stream: DataFrame, key: str, received: str, remember: str = "35 days") -> DataFrame:
    """Each source record once; redeliveries inside the memory window are dropped."""
    return stream.withWatermark(received, remember).dropDuplicatesWithinWatermark([key])


def _put(df: DataFrame, path: str, batch_id: int, *partitions: str) -> None:
    """Write a batch's own partitions of a table; a replay overwrites them."""
    df.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions, "batch_id").parquet(path)


def _of_batch(spark: SparkSession, path: str, schema: T.StructType, batch_id: int) -> DataFrame:
    """A batch's own partition of a table, read without listing the others (none: no rows)."""
    one = f"{path}/batch_id={batch_id}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(one)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(one)


def park(folder: str, keys: Sequence[str], event_id: str, max_park_s: int, look_back_s: int, disorder_s: int = 3600, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink that holds each event until its partner or its deadline, and loses none.

    The stream carries both sides: ``side`` ('event' or 'partner'), the join ``keys``, ``event_id``, ``at`` and payload
    columns. A waiting event is resolved by the earliest partner of its keys within [at - look back, at + park]; other partners
    of the key do not hide it. Once the largest time seen has passed the deadline by ``disorder_s`` it leaves as
    degraded; until then it is parked. Nothing is dropped as late: an event that arrives after its deadline is joined with the stored
    partners like any other and leaves in the same batch. An event is decided once: ids are kept in a log
    bucketed by their hash, and a delivery of a decided id is dropped after a look into its bucket. A delivery of a parked id
    changes nothing, so the deadline never slides.

    Every batch owns one partition of each table (partners by day, parked, clock, decided, out), so a replayed batch changes
    nothing. Partners are read by day partition: only those that can still serve a waiting event.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.persist()
        dated = T.StructType([*batch.schema.fields, T.StructField("day", T.DateType()), T.StructField("batch_id", T.LongType())])
        _put(rows.where("side = 'partner'").withColumn("day", F.to_date("at")), f"{folder}/partners", batch_id, "day")
        # the clock only grows: the batch before holds the largest time so far
        before = _of_batch(spark, f"{folder}/clock", T.StructType([T.StructField("at", T.TimestampType())]), batch_id - 1)
        clock = rows.select("at").unionByName(before).agg(F.max("at")).first()[0]
        arrived = with_bucket(rows.where("side = 'event'"), [event_id], buckets)
        known_ids = logged(spark, f"{folder}/decided", arrived, f"`{event_id}` {dict(batch.dtypes)[event_id]}", batch_id="bigint")
        if known_ids is not None:
            arrived = arrived.join(known_ids.where(F.col("batch_id") < batch_id).select(event_id), event_id, "left_anti")
        waiting = arrived.select(*batch.columns, F.lit(1).alias("_new"))
        waiting = waiting.unionByName(_of_batch(spark, f"{folder}/parked", batch.schema, batch_id - 1).withColumn("_new", F.lit(0)))
        waiting = keep_first(waiting, [event_id], [F.col("_new"), F.col("at")]).drop("_new").persist()
        oldest, newest = waiting.agg(F.min("at"), F.max("at")).first()
        payload = [c for c in batch.columns if c not in (*keys, event_id, "side", "at")]
        if oldest is None or not has_rows(spark, f"{folder}/partners"):
            partners = spark.createDataFrame([], dated)
        else:
            days = F.col("day").between(F.lit((oldest - timedelta(seconds=look_back_s)).date()), F.lit((newest + timedelta(seconds=max_park_s)).date()))
            partners = spark.read.schema(dated).parquet(f"{folder}/partners").where(days & (F.col("batch_id") <= batch_id))
        p = partners.select(*keys, F.struct(F.col("at").alias("partner_at"), *payload).alias("partner"))
        gap = F.unix_micros("partner.partner_at") - F.unix_micros("at")
        near = (gap <= max_park_s * 1_000_000) & (gap >= -look_back_s * 1_000_000)
        hits = waiting.select(*keys, event_id, "at").join(p, list(keys)).where(near).groupBy(event_id).agg(F.min("partner").alias("partner"))
        known = waiting.join(hits, event_id, "left")
        over = F.unix_micros("at") + (max_park_s + disorder_s) * 1_000_000 < F.unix_micros(F.lit(clock))
        status = F.when(F.col("partner").isNotNull(), "resolved").when(over, "degraded")
        decided = known.withColumn("status", status).persist()
        _put(decided.where("status is not null").drop("side"), f"{folder}/out", batch_id)
        _put(decided.where("status is null").select(*batch.columns), f"{folder}/parked", batch_id)
        _put(spark.createDataFrame([(clock,)], "at timestamp"), f"{folder}/clock", batch_id)
        _put(with_bucket(decided.where("status is not null").select(event_id), [event_id], buckets), f"{folder}/decided", batch_id, KEY_BUCKET)
        for x in (decided, waiting, rows):
            x.unpersist()

    return write


def park_and_join(events: DataFrame, partners: DataFrame, key: str, received: str, partner_received: str, max_park: str, look_back: str, salts: int = 8, disorder: str = "1 hour") -> DataFrame:
    """Out-of-order join: an event waits for its partner up to a fixed deadline, then leaves as degraded.

    A left outer stream-stream join with watermarks holds the parked rows in state; the deadline is the
    event's own time plus ``max_park`` and never slides. Events of a key are spread over ``salts`` state
    partitions and its (few) partner rows are repeated for each, so a hot key is not one state store entry list.
    ``disorder`` is how far arrival may lag behind event order: rows further behind are not seen by the join. Where
    every row must get an answer, use ``park``.
    """
    left = events.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in events.columns]), F.lit(salts)).cast("int")).withWatermark(received, disorder)
    p = partners.withWatermark(partner_received, disorder).dropDuplicatesWithinWatermark([key])
    keep = [c for c in partners.columns if c != key]
    right = p.select(F.col(key).alias("_pk"), *keep, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_ps"))
    on = (F.col(key) == F.col("_pk")) & (F.col("_salt") == F.col("_ps")) & (F.col(partner_received) <= F.col(received) + F.expr(f"INTERVAL {max_park}")) & (F.col(partner_received) >= F.col(received) - F.expr(f"INTERVAL {look_back}"))
    status = F.when(F.col("_pk").isNotNull(), "resolved").otherwise("degraded")
    return left.join(right, on, "left_outer").withColumn("status", status).drop("_salt", "_ps", "_pk")


def settle(spark: SparkSession, folder: str, stream_schema: T.StructType) -> DataFrame:
    """All decided events; those still parked count as degraded, for a stream that has ended.

    ``stream_schema`` is the schema of the stream given to ``park``: with it the tables can be read even where one was never filled.
    """
    fields = [f for f in stream_schema.fields if f.name != "side"]
    batch = T.StructField("batch_id", T.LongType())
    number = spark.read.schema(T.StructType([batch])).parquet(f"{folder}/clock").agg(F.max("batch_id")).first()[0]
    held = spark.read.schema(T.StructType([*fields, batch])).parquet(f"{folder}/parked").where(F.col("batch_id") == number)
    still = held.drop("batch_id").withColumn("status", F.lit("degraded"))
    partner = _partner_type(stream_schema, folder, spark)
    out = spark.read.schema(T.StructType([*fields, *partner, T.StructField("status", T.StringType()), batch])).parquet(f"{folder}/out").drop("batch_id")
    return out.unionByName(still, allowMissingColumns=True)


def _partner_type(stream_schema: T.StructType, folder: str, spark: SparkSession) -> list[T.StructField]:
    """The partner column as written, read from a table that has rows; before any decision it is unknown and left out."""
    try:
        return [f for f in spark.read.parquet(f"{folder}/out").schema.fields if f.name == "partner"]
    except Exception as error:
        if "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        return []


def split_outputs(folder: str, bad: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: rows whose ``bad`` test holds go to the dead-letter table, the others on.

    Each micro-batch owns one partition and overwrites it, so a replayed batch changes nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        x = batch.withColumn("batch_id", F.lit(batch_id)).persist()
        for name, part in (("dead_letter", x.where(bad)), ("accepted", x.where(f"not ({bad})"))):
            part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{folder}/{name}")
        x.unpersist()

    return write


def first_write_wins(folder: str, key: str, order: Sequence[str] = (), buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """foreachBatch ledger: a key is written once, by the first batch that brings it and the first row by ``order``
    (by default: all columns) in it.

    The ledger is partitioned by a hash of the key: a batch looks only into the buckets of its own keys.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = with_bucket(keep_first(batch, [key], [F.col(c) for c in (order or batch.columns)]), [key], buckets).persist()
        # rows of this very batch (a replay) do not count as earlier writes
        known = logged(batch.sparkSession, folder, rows, f"`{key}` {dict(batch.dtypes)[key]}", batch_id="bigint")
        new = rows if known is None else rows.join(known.where(F.col("batch_id") < batch_id).select(key), key, "left_anti")
        _put(new.select(*rows.columns), folder, batch_id, KEY_BUCKET)
        rows.unpersist()

    return write


def decide_once(folder: str, key: str, at: str, remember_days: int, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink of decisions that never change: the first proposal of a key to arrive is stored (within a batch the first by
    ``at``), later ones are ignored, whatever they say.

    A proposal meets the decisions dated from ``remember_days`` before it on; beyond that it is a new decision. Decisions
    are partitioned by day and by a hash of the key, so a batch reads the days within memory and the buckets of
    its keys, and expiry deletes whole days (``sinks.tables.expire_table`` with the column ``day``).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        firsts = keep_first(batch, [key], [F.col(at), *[F.col(c) for c in batch.columns if c not in (key, at)]])
        rows = with_bucket(firsts.withColumn("day", F.to_date(at)), [key], buckets).persist()
        first = rows.agg(F.min("day")).first()[0]
        stored = logged(batch.sparkSession, folder, rows, f"`{key}` {dict(batch.dtypes)[key]}", day="date", batch_id="bigint")
        new = rows
        if stored is not None and first is not None:
            live = stored.where((F.col("batch_id") < batch_id) & (F.col("day") >= F.lit(first - timedelta(days=remember_days))))
            remembered = live.select(F.col(key).alias("_key"), F.col("day").alias("_day"))
            new = rows.join(remembered, (F.col(key) == F.col("_key")) & (F.col("day") <= F.date_add("_day", remember_days)), "left_anti")
        _put(new.select(*rows.columns), folder, batch_id, "day", KEY_BUCKET)
        rows.unpersist()

    return write


def retry(folder: str, failing: Callable[[DataFrame], DataFrame], max_attempts: int) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink that tries rows again in later batches and gives them up after ``max_attempts`` failures.

    ``failing`` adds a boolean column ``failed`` to rows that carry ``attempts`` (failures so far). A failed row is kept with one more
    attempt and tried with the next batch; its last allowed failure moves it to the dead letters, with the number
    of attempts. Each row stands alone: one that fails holds back no other. Every batch owns one partition of each table
    (accepted, retry, dead_letter), so a replayed batch changes nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("attempts", F.lit(0))
        rows = rows.unionByName(_of_batch(spark, f"{folder}/retry", rows.schema, batch_id - 1))
        tried = failing(rows).withColumn("failed", F.coalesce("failed", F.lit(True))).withColumn("attempts", F.col("attempts") + F.col("failed").cast("int")).persist()
        _put(tried.where("not failed").drop("failed"), f"{folder}/accepted", batch_id)
        _put(tried.where(F.col("failed") & (F.col("attempts") >= max_attempts)).drop("failed"), f"{folder}/dead_letter", batch_id)
        _put(tried.where(F.col("failed") & (F.col("attempts") < max_attempts)).drop("failed"), f"{folder}/retry", batch_id)
        tried.unpersist()

    return write


def versions(folder: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink of changed keys: one partition per batch; the newest version of a key wins on read."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(folder)

    return write


def newest_version(df: DataFrame, key: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in (*key, "batch_id")]
    return df.groupBy(*key).agg(F.max(F.struct("batch_id", *rest)).alias("m")).select(*key, *[F.col(f"m.{c}").alias(c) for c in rest])


def max_state(stream: DataFrame, key: str, cumulative: str) -> DataFrame:
    """Largest cumulative amount per key; a lower late value changes nothing (update mode)."""
    return stream.groupBy(key).agg(F.max(cumulative).alias(cumulative))


def latest_state(stream: DataFrame, key: str, order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Newest state per key by event order, whatever the arrival order (update mode)."""
    return stream.groupBy(key).agg(F.max(F.struct(*order, *payload)).alias("m")).select(key, *[F.col(f"m.{c}").alias(c) for c in (*order, *payload)])


def sla_value(decided: DataFrame, floor: float) -> DataFrame:
    """Value of parked purchases: the earliest score within the SLA, or the cash where none came in time.

    ``decided``: rows of ``settle`` with cash_value and partner.predicted_profit.
    """
    scored = F.col("status") == "resolved"
    cents = lambda c: F.floor(c * 100 + 0.5) / 100
    value = F.when(scored, F.greatest(cents(F.col("partner.predicted_profit")), F.lit(floor))).otherwise(cents(F.col("cash_value")))
    return decided.select("event_id", F.when(scored, "predicted_profit_90d").otherwise("cash_fallback").alias("basis"), value.alias("value"))


def touched_days(source: DataFrame, uploaded: str, day: str, now: datetime, lookback_days: int, max_late_days: int) -> DataFrame:
    """All known rows of every event day that received rows recently; rows of older days are not picked up."""
    known = source.where(F.col(uploaded) <= F.lit(now))
    recent = F.unix_micros(uploaded) >= F.unix_micros(F.lit(now)) - lookback_days * 86_400_000_000
    fresh_day = F.col(day) >= F.date_sub(F.lit(now).cast("date"), max_late_days)
    days = known.where(recent & fresh_day).select(day).distinct()
    return known.where(fresh_day).join(F.broadcast(days), day, "left_semi")


def run_once(
    stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", state_partitions: int | None = None,
) -> None:
    """Process what is there in micro-batches and stop.

    The number of state partitions is fixed by the first run of a checkpoint, so it is chosen for the
    expected state (see ``state_partitions_for``), not taken from whatever batch jobs use.
    """
    conf = stream.sparkSession.conf
    before = conf.get("spark.sql.shuffle.partitions")
    if state_partitions:
        conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    try:
        q = stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set("spark.sql.shuffle.partitions", before)
    q.awaitTermination()


def state_partitions_for(rows: int, rows_per_partition: int = 500_000, least: int = 8) -> int:
    """State partitions that keep each state store at a size one task restores quickly."""
    return max(least, -(-rows // rows_per_partition))

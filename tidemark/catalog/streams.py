"""Streaming queries: the event table is replayed as files, one micro-batch each, and the sink is read back."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.catalog.cte import add, sql
from tidemark.catalog.dispatch import NOW as DISPATCH_NOW
from tidemark.catalog.dispatch import decided
from tidemark.catalog.registry import query
from tidemark.catalog.sinks import scratch
from tidemark.plans.dispatch import dispatch_plan
from tidemark.sinks import tables as K
from tidemark.sources import driver_tables as D
from tidemark.streaming import held as H
from tidemark.streaming import jobs as J

END = datetime(2024, 6, 1)


def run(s, d, stream, sink, mode="append"):
    """One availableNow run with the state sized by the event table."""
    J.run_once(stream, sink, scratch(s), mode, J.state_partitions_for(D.table(s, d, "events").count()))


def replay(s, df, order, files=3):
    """Write a table slice after slice in time order and read the files as a stream in several micro-batches."""
    p = scratch(s)
    span = F.floor(F.unix_micros(order) / (86_400_000_000 * 12)).cast("int")
    base = K.stage(df.withColumn("_slice", span))  # counted and cut into slices: computed once
    per_batch = max(1, base.count() // 1_000_000)
    for i in range(files):
        lo, hi = 1643 + i, 1644 + i
        part = base.where((F.col("_slice") >= (lo if i else -10_000)) & (F.col("_slice") < (hi if i < files - 1 else 10_000_000)))
        part.drop("_slice").repartition(per_batch).write.mode("append").parquet(p)  # one micro-batch a slice
    return s.readStream.schema(df.schema).option("maxFilesPerTrigger", per_batch).parquet(p)


@query("str_1_inbox_dedup", sql("SELECT event_id, user_id FROM ev"))
def _(s, d):
    out = scratch(s)
    src = replay(s, D.deliveries(s, d).select("event_id", "user_id", "received_at"), "received_at")
    run(s, d, J.dedup(src, "event_id", "received_at"), J.versions(out))
    return s.read.parquet(out).select("event_id", "user_id")


def parked(s, d):
    """Purchases wait for a click that carries their key; every seventh arrives 24 days late, far behind the rest."""
    e = D.ev(s, d)
    rows = e.where("event_type in ('purchase', 'click')").select(
        F.when(F.col("event_type") == "purchase", "event").otherwise("partner").alias("side"),
        F.concat_ws(":", F.col("user_id").cast("string"), (F.col("k") % 10).cast("string")).alias("dep_key"), "event_id", F.col("ts").alias("at"),
        F.timestamp_micros(F.unix_micros("ts") + F.when((F.col("event_type") == "purchase") & (F.col("k") % 7 == 0), 24 * 86_400_000_000).otherwise(0)).alias("arrived"))
    out = scratch(s)
    # every fourth event is delivered again with the last files
    again = rows.where("event_id % 4 = 0").withColumn("arrived", F.lit(END))
    run(s, d, replay(s, rows.unionByName(again), "arrived").drop("arrived"), J.park(out, ["dep_key"], "event_id", 3 * 86_400, 5 * 86_400))
    return J.settle(s, out, rows.drop("arrived").schema)


add("dep", "SELECT user_id || ':' || (k % 10) AS dep_key, ts AS at2 FROM ev WHERE event_type = 'click'")
add("parked", "SELECT event_id, CASE WHEN EXISTS (SELECT 1 FROM dep WHERE dep_key = p.user_id || ':' || (p.k % 10) AND at2 BETWEEN p.ts - INTERVAL 5 DAY AND p.ts + INTERVAL 3 DAY) THEN 'resolved' ELSE 'degraded' END AS status FROM ev p WHERE event_type = 'purchase'")


@query("str_2_park_and_join", sql("SELECT * FROM parked"))
def _(s, d):
    return parked(s, d).select("event_id", "status")


@query("str_3_deadline_split", sql("SELECT event_id, CASE WHEN status = 'degraded' THEN 'dead_letter' ELSE 'accepted' END AS output FROM parked"))
def _(s, d):
    out = scratch(s)
    J.split_outputs(out, "status = 'degraded'")(parked(s, d).select("event_id", "status"), 0)
    read = lambda n: s.read.parquet(f"{out}/{n}").select("event_id", F.lit(n).alias("output"))
    return read("dead_letter").unionByName(read("accepted"))


@query("str_4_first_write_wins", sql("SELECT event_id, user_id, min(received_at) AS received_at FROM deliveries GROUP BY 1, 2"))
def _(s, d):
    out = scratch(s)
    src = replay(s, D.deliveries(s, d).select("event_id", "user_id", "received_at"), "received_at")
    run(s, d, src, J.first_write_wins(out, "event_id", ["received_at"]))
    return s.read.parquet(out).select("event_id", "user_id", "received_at")


@query("str_6_monotone_refunds", sql("SELECT user_id, max(k) AS cumulative FROM ev WHERE event_type = 'error' GROUP BY 1"))
def _(s, d):
    out = scratch(s)
    src = replay(s, D.ev(s, d).where("event_type = 'error'").select("user_id", F.col("k").alias("cumulative"), "ts"), "ts")
    run(s, d, J.max_state(src, "user_id", "cumulative"), J.versions(out), "update")
    return J.newest_version(s.read.parquet(out), ["user_id"])


# half an hour steps after the purchase; k % 5 = 4: an early and a late score, and one dated before the purchase
add("sla", "SELECT 'purchase_' || event_id AS event_id, cents, k, k % 8 <= 4 AND k % 5 < 3 AS one, k % 5 = 4 AND k % 8 <= 3 AS two FROM ev WHERE event_type = 'purchase'")


@query("str_7_value_sla", sql("SELECT event_id, CASE WHEN one OR two THEN 'predicted_profit_90d' ELSE 'cash_fallback' END AS basis, CASE WHEN one OR two THEN greatest(floor((k - 40) / 4.0::DOUBLE * 100 + 0.5) / 100, 1) ELSE floor(cents / 100.0::DOUBLE * 100 + 0.5) / 100 END AS value FROM sla"))
def _(s, d):
    out = scratch(s)
    p = D.purchase(s, d)
    none = F.lit(None).cast("double")
    buy = p.select(F.lit("event").alias("side"), "event_id", "user_id", F.col("occurred_at").alias("at"), (F.col("cash_minor") / 100).alias("cash_value"), none.alias("predicted_profit"))
    # (rows it exists for, half hours after the purchase, added to the score)
    profit = (F.col("k") - 40) / 4
    kinds = (("k % 5 < 3", F.col("k") % 8, 0.0), ("k % 5 = 4", F.col("k") % 8 + 1, 0.0), ("k % 5 = 4", F.col("k") % 8 + 2, 50.0), ("k % 5 = 4", F.lit(-1), 70.0))
    for test, steps, more in kinds:
        score = p.where(test).select(F.lit("partner").alias("side"), "event_id", "user_id", F.timestamp_micros(F.unix_micros("occurred_at") + steps.cast("bigint") * 1_800_000_000).alias("at"), none.alias("cash_value"), (profit + more).alias("predicted_profit"))
        buy = buy.unionByName(score)
    # another user's score of the same purchase serves nobody
    other = p.where("k % 5 = 3").select(F.lit("partner").alias("side"), "event_id", (F.col("user_id") + 1).alias("user_id"), F.col("occurred_at").alias("at"), none.alias("cash_value"), profit.alias("predicted_profit"))
    run(s, d, replay(s, buy.unionByName(other), "at"), J.park(out, ["event_id", "user_id"], "event_id", 2 * 3600, 0))
    return J.sla_value(J.settle(s, out, buy.schema), 1.0)


@query("str_3b_dead_letters", sql("""SELECT event_id, CASE WHEN k % 6 < 3 THEN 'accepted' ELSE 'dead_letter' END AS output, CAST(least(k % 6, 3) AS INT) AS attempts FROM ev WHERE event_type IN ('purchase', 'error')"""))
def _(s, d):
    out = scratch(s)
    rows = D.ev(s, d).where("event_type in ('purchase', 'error')").select("event_id", "k", "ts")
    # a row goes through once it has failed k % 6 times; three failures are the limit
    sink = J.retry(out, lambda x: x.withColumn("failed", F.col("attempts") < F.col("k") % 6), 3)
    run(s, d, replay(s, rows, "ts"), sink)
    empty = s.createDataFrame([], rows.schema)
    for batch in (3, 4, 5):  # the sweeps after the stream's last batch
        sink(empty, batch)
    read = lambda n: s.read.parquet(f"{out}/{n}").select("event_id", F.lit(n).alias("output"), "attempts")
    return read("dead_letter").unionByName(read("accepted"))


@query("str_7b_first_decision", sql("""SELECT user_id, min(ts) AS decided_at, arg_min(k, (ts, event_id)) AS value FROM ev WHERE event_type = 'purchase' GROUP BY user_id"""))
def _(s, d):
    out = scratch(s)
    rows = D.ev(s, d).where("event_type = 'purchase'").select("user_id", F.col("ts").alias("decided_at"), "event_id", F.col("k").alias("value"))
    proposals = replay(s, rows, "decided_at")
    run(s, d, proposals, J.decide_once(out, "user_id", "decided_at", 3650))
    # the whole stream once more, with other values: nothing changes
    J.decide_once(out, "user_id", "decided_at", 3650)(rows.withColumn("value", F.col("value") + 1), 3)
    return s.read.parquet(out).select("user_id", "decided_at", "value")


@query("str_8_held_queue", sql("""SELECT event_id, platform, CASE WHEN skip IS NOT NULL THEN 'skipped' WHEN fix AND platform <> 'meta' THEN 'held' ELSE 'pending' END AS status FROM (SELECT *, CASE WHEN platform <> 'meta' AND platform <> 'google_ads' THEN 'platform_disabled' WHEN NOT send THEN 'no'
    WHEN event_name = 'purchase_first' AND platform = 'meta' AND k % 3 <> 0 THEN 'no' WHEN block IS NOT NULL THEN block WHEN occurred_at > TIMESTAMP '2024-01-28' + INTERVAL 300 SECOND THEN 'no'
    WHEN TIMESTAMP '2024-01-28' > occurred_at + to_seconds(least(days * 86400, CASE WHEN twin AND tw IS NOT NULL THEN tw ELSE days * 86400 END)) THEN 'no' WHEN fix AND platform = 'meta' AND occurred_at < TIMESTAMP '2024-01-27' THEN 'no' END AS skip FROM dspc WHERE k % 2 = 0)"""))
def _(s, d):
    live = D.seed_from(s, [("purchase_first", "meta", "2024-01-27 00:00:00")], "event_name string, platform string, live_at timestamp")
    # every second purchase is due at the time of dispatch, the others stay in the state
    held = decided(s, d).withColumn("next_at", F.when(F.col("k") % 2 == 0, F.lit(DISPATCH_NOW)).otherwise(F.lit(END))).withColumn("value_pending", F.lit(False)).withColumn("received_at", F.col("occurred_at"))
    nothing = {"event_id": F.lit("clock"), "platform": F.lit("clock"), "next_at": F.lit(END), "received_at": F.lit(DISPATCH_NOW + timedelta(days=9))}
    clock = s.range(1).select(*[nothing.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in held.schema.fields])
    out = scratch(s)
    due = H.due_sends(replay(s, held.unionByName(clock), "received_at"), ["event_id", "platform"], "next_at", "received_at", "0 seconds")
    # deciding a due row is the same plan as its first decision, as of its check
    sink = H.decide_due(out, lambda rows, now: dispatch_plan(rows, now, ("meta", "google_ads"), live, True, True), "next_at", "received_at", 3600)
    H.run_held(due, sink, scratch(s), J.state_partitions_for(D.table(s, d, "events").count()))
    return s.read.parquet(f"{out}/checked").select("event_id", "platform", "status")


@query("str_9_latest_state", sql("SELECT user_id, max(ts) AS ts, arg_max(event_type, ts) AS event_type FROM ev GROUP BY 1"))
def _(s, d):
    out = scratch(s)
    # arrival order is the reverse of event order: the newest event arrives first
    e = D.ev(s, d).select("user_id", "ts", "event_id", "event_type", F.timestamp_micros(F.lit(3_410_000_000_000_000) - F.unix_micros("ts")).alias("arrived"))
    src = replay(s, e, "arrived")
    run(s, d, J.latest_state(src, "user_id", ["ts", "event_id"], ["event_type"]), J.versions(out), "update")
    x = s.read.parquet(out)
    return x.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m")).select("user_id", "m.ts", "m.event_type")


@query("str_10_retention", sql("SELECT event_id FROM ev WHERE CAST(ts AS DATE) >= DATE '2024-01-15' AND user_id % 10 <> 3"))
def _(s, d):
    out, table = scratch(s), scratch(s)
    src = replay(s, D.ev(s, d).select("event_id", "user_id", "ts"), "ts")
    run(s, d, src, J.versions(out))
    K.overwrite_days(s.read.parquet(out).drop("batch_id").withColumn("day", F.to_date("ts")), table, "day")
    gone = D.ev(s, d).where("user_id % 10 = 3").select("user_id", F.lit(datetime(2024, 1, 1)).alias("requested_at"))
    K.erase_table(s, table, "day", gone, datetime(2024, 1, 30), 24)
    K.expire_table(s, table, "day", datetime(2024, 1, 30), 15)
    return s.read.parquet(table).select("event_id")

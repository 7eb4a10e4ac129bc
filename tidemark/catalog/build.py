"""The whole revenue run over raw deliveries made from orders and line items."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from tidemark.catalog.cte import add, sql
from tidemark.catalog.registry import query, shared
from tidemark.catalog.sinks import scratch
from tidemark.params import Params
from tidemark.plans import build as W
from tidemark.sources import driver_tables as D
from tidemark.sources import schemas as S

AS_OF = Params(as_of=datetime(2030, 1, 1))
PLANS = [("price_m", "product", "plan", "essential", "month"), ("price_y", "product", "plan", "wonder", "year")]


def raw_deliveries(s, d):
    """Paid invoices of all orders, two cumulative refunds of every fifth, a dispute (lost or won) of every seventh; every third event comes twice."""
    key = F.col("o_orderkey")
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    o = D.table(s, d, "orders").select(
        key, text("cus_", F.col("o_custkey")).alias("customer"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("t"))
    line = F.struct(text("il_", key).alias("id"), F.col("cents").alias("amount"), F.lit(1).alias("quantity"), F.struct(F.when(key % 2 == 0, "price_m").otherwise("price_y").alias("id")).alias("price"))
    paid = F.struct(
        text("in_", key).alias("id"), F.col("customer"), F.lit("paid").alias("status"), F.when(key % 4 == 0, "subscription_create").otherwise("subscription_cycle").alias("billing_reason"), F.lit("usd").alias("currency"),
        F.col("cents").alias("amount_paid"), F.col("cents").alias("total"), F.col("t").alias("created"), text("sub_", key).alias("subscription"), text("ch_", key).alias("charge"), F.struct(F.array(line).alias("data")).alias("lines"))
    back = lambda share: F.struct(text("ch_", key).alias("id"), F.col("customer"), F.lit("usd").alias("currency"), F.col("cents").alias("amount"), F.floor(F.col("cents") * share / 4).alias("amount_refunded"))
    lost = F.struct(text("dp_", key).alias("id"), text("ch_", key).alias("charge"), F.lit("usd").alias("currency"), F.col("cents").alias("amount"), F.col("t").alias("created"),
                    F.when(key % 2 == 0, "lost").otherwise("won").alias("status"))
    cases = [(F.lit(True), "invoice.paid", "a", 0, paid), (key % 5 == 0, "charge.refunded", "b", 3600, back(1)), (key % 5 == 0, "charge.refunded", "c", 7200, back(2)),
             (key % 7 == 0, "charge.dispute.created", "d", 10_800, lost.withField("created", F.col("t") + 10_800))]
    events = None
    for rule, kind, tag, later, body in cases:
        part = o.where(rule).select(text("evt_" + tag, key).alias("id"), F.lit(kind).alias("type"), (F.col("t") + later).alias("created"), F.lit(True).alias("livemode"),
                                    F.to_json(F.struct(body.alias("object"))).alias("data"), F.timestamp_seconds(F.col("t") + later + 60).alias("received_at"), (key % 3 == 0).alias("_twice"))
        events = part if events is None else events.unionByName(part)
    again = events.where("_twice").withColumn("received_at", F.timestamp_seconds(F.unix_seconds("received_at") + 86_400))
    return events.unionByName(again).drop("_twice")


@shared
def built(s, d):
    """The run over JSON deliveries and CSV seeds in a folder of its own; where its tables are."""
    folder = scratch(s)
    raw_deliveries(s, d).write.option("compression", "gzip").json(f"{folder}/inbox")
    seeds = {"plan_catalog": [(*plan, *[None] * 6) for plan in PLANS], "fx_rates": [("USD", date(1990, 1, 1), 1.0, "fixed")], "currency_minor_units": [("USD", 2, "fixed")]}
    for name, rows in seeds.items():
        s.createDataFrame(rows, S.SEEDS[name]).write.option("header", True).csv(f"{folder}/seeds/{name}.csv")
    W.run(s, f"{folder}/inbox", f"{folder}/seeds", f"{folder}/warehouse", AS_OF, {name: len(rows) for name, rows in seeds.items()})
    return f"{folder}/warehouse"


add("paid_order", """SELECT o_orderkey AS k, 'cus_' || o_custkey AS user_id, CAST(o_orderdate AS TIMESTAMP) AS paid_at, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders""")
add("order_out", """SELECT *, CASE WHEN k % 5 = 0 THEN cents * 2 // 4 ELSE 0 END AS refunded, k % 7 = 0 AS disputed, k % 14 = 0 AS lost FROM paid_order""")
add("order_net", """SELECT 'purchase_in_' || k AS event_id, user_id, paid_at AS occurred_at, CASE WHEN k % 4 = 0 THEN 'purchase_first' ELSE 'purchase_renewal' END AS event_name, CASE WHEN k % 2 = 0 THEN 'essential' ELSE 'wonder' END AS plan_tier,
    cents AS gross_minor, CASE WHEN lost THEN cents ELSE refunded END AS taken_minor FROM order_out""")


@query("bld_1_net_cash", sql("SELECT *, gross_minor - taken_minor AS restated_minor, round((gross_minor - taken_minor) / 100.0::DOUBLE, 6) AS restated_reporting FROM order_net"))
def _(s, d):
    return W.read_marts(s, built(s, d))["net_cash"].select(
        "event_id", "user_id", "occurred_at", "event_name", "plan_tier", F.col("cash_value_minor").alias("gross_minor"), "taken_minor", "restated_minor", F.round("restated_reporting", 6).alias("restated_reporting"))


@query("bld_2_money_out", sql("""SELECT 'refund_ch_' || k || '_' || (cents // 4) AS event_id, 'purchase_in_' || k AS adjusts_event_id, paid_at + INTERVAL 1 HOUR AS occurred_at, 'refund' AS disposition, -(cents // 4) AS ledger_minor, cents - cents // 4 AS restated_minor FROM order_out WHERE k % 5 = 0
    UNION ALL SELECT 'refund_ch_' || k || '_' || refunded, 'purchase_in_' || k, paid_at + INTERVAL 2 HOUR, 'refund', cents // 4 - refunded, cents - refunded FROM order_out WHERE k % 5 = 0
    UNION ALL SELECT 'chargeback_dp_' || k, 'purchase_in_' || k, paid_at + INTERVAL 3 HOUR, CASE WHEN lost THEN 'chargeback' ELSE 'dispute_won_or_inquiry' END, CASE WHEN lost THEN refunded - cents ELSE 0 END, CASE WHEN lost THEN 0 ELSE cents - refunded END FROM order_out WHERE disputed"""))
def _(s, d):
    return W.read_marts(s, built(s, d))["adjustments"].select(
        "event_id", "adjusts_event_id", "occurred_at", "disposition", F.col("ledger_cash_value_minor").alias("ledger_minor"), F.col("restated_order_value_minor").alias("restated_minor"))


@query("bld_3_revenue_daily", sql("""SELECT CAST(occurred_at AS DATE) AS day, event_name, 'USD' AS currency, count(*) AS purchases, CAST(sum(gross_minor) AS BIGINT) AS gross_minor, CAST(sum(taken_minor) AS BIGINT) AS taken_minor, CAST(sum(gross_minor - taken_minor) AS BIGINT) AS restated_minor FROM order_net GROUP BY 1, 2"""))
def _(s, d):
    W.views(W.read_marts(s, built(s, d)))
    return s.table("rpt_revenue_daily")

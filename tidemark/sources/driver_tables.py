"""Adapters: the given tables seen as the growth-analytics inputs.

Orders and line items play invoices and invoice lines, parts the price catalogue,
events the product export (purchases, usage, clicks, exposures). Everything is a
projection or filter of the given tables, so the work grows with them.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = datetime(2024, 1, 31)
CURRENCIES = ("USD", "EUR", "GBP", "JPY", "KWD", "XXX")
FLAGS = ("suite-default-model-create-image", "suite-default-model-create-video")
TIERS = ("essential", "advanced", "infinite", "wonder")

# Dated exchange rates and exponents used on both sides of the comparison (fixed values).
FX = [
    ("USD", "1990-01-01", 1.0), ("EUR", "1990-01-01", 1.25), ("EUR", "1998-01-01", 1.125), ("EUR", "2024-01-15", 1.0625),
    ("GBP", "1990-01-01", 1.5), ("GBP", "1999-06-01", 1.625), ("JPY", "1990-01-01", 0.0078125), ("KWD", "1997-01-01", 3.25),
]
MINOR_UNITS = [("USD", 2), ("EUR", 2), ("GBP", 2), ("JPY", 0), ("KWD", 3)]


def pick(index, values):
    """values[index] for a small fixed list."""
    return F.try_element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cents(c: str):
    return F.round(F.col(c) * 100).cast("bigint")


def ev(spark, d) -> DataFrame:
    """Typed events of a folder. Whoever reads them many times stages them and hands them on in place of the folder."""
    if isinstance(d, DataFrame):
        return d
    e = table(spark, d, "events")
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", cents("value").alias("cents"),
        F.get_json_object("props", "$.k").cast("int").alias("k"), "props",
    )


def signup(spark, d) -> DataFrame:
    return ev(spark, d).where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("signup_at"))


def usage(spark, d) -> DataFrame:
    e = ev(spark, d).where("event_type in ('view', 'click', 'error')")
    return e.select(
        F.col("event_id").alias("usage_id"), "user_id", F.col("ts").alias("created_at"), "k",
        F.col("cents").alias("cost_cents"), (F.col("k") + 1).cast("bigint").alias("credits"),
        F.concat(F.lit("m"), (F.col("k") % 7).cast("string")).alias("model_id"),
        F.when(F.col("k") % 3 == 0, "video").otherwise("image").alias("media_type"),
        F.when(F.col("k") % 4 == 0, "trial_credit_balance").when(F.col("k") % 4 == 1, "one_time_pack_credit")
        .otherwise("subscription_monthly_credit").alias("credit_field"),
        (F.col("event_type") == "error").alias("is_failed"),
    )


def purchase(spark, d) -> DataFrame:
    e = ev(spark, d).where("event_type = 'purchase'")
    m = F.col("k") % 10
    name = (
        F.when(m < 3, "purchase_first").when(m < 6, "purchase_renewal").when(m < 8, "purchase_one_time_pack")
        .when(m == 8, "purchase_upgrade").otherwise("purchase_add_on")
    )
    pack = (m == 6) | (m == 7)
    return e.select(
        F.concat(F.lit("purchase_"), F.col("event_id").cast("string")).alias("event_id"), name.alias("event_name"),
        "user_id", F.col("ts").alias("occurred_at"), F.col("cents").alias("cash_minor"),
        (F.col("cents") - F.expr("cents div 10")).alias("revenue_minor"),
        pick(F.col("user_id") % 4, CURRENCIES[:4]).alias("currency"),
        F.when(~pack, pick(F.col("k") % 4, TIERS)).alias("plan_tier"),
        F.when(~pack, F.when(F.col("k") % 2 == 0, "month").otherwise("year")).alias("billing_interval"),
        F.concat(F.lit("sub_"), F.col("user_id").cast("string"), F.lit("_"), (F.col("k") % 3).cast("string")).alias("subscription_id"),
        "k",
    )


def adjustment(spark, d) -> DataFrame:
    """Refunds (every sixth k, half the amount) and chargebacks (every eleventh k, all of it)."""
    p = purchase(spark, d)
    shared = [F.col("event_id").alias("adjusts_event_id"), "user_id"]
    refund = p.where("k % 6 = 0").select(
        F.concat(F.lit("refund_"), "event_id").alias("event_id"), F.lit("refund").alias("event_name"), *shared,
        F.timestamp_micros(F.unix_micros("occurred_at") + F.col("k").cast("bigint") * 3_600_000_000).alias("occurred_at"),
        (-F.expr("cash_minor div 2")).alias("cash_minor"),
    )
    chargeback = p.where("k % 11 = 0").select(
        F.concat(F.lit("chargeback_"), "event_id").alias("event_id"), F.lit("chargeback").alias("event_name"), *shared,
        F.timestamp_micros(F.unix_micros("occurred_at") + F.col("k").cast("bigint") * 7_200_000_000).alias("occurred_at"),
        (-F.col("cash_minor")).alias("cash_minor"),
    )
    return refund.unionByName(chargeback)


CLICK_KEYS = ("gclid", "fbclid", "ttclid", "msclkid")
# key, platform, channel, precedence (fixed values)
CLICK_PLATFORMS = [
    ("gclid", "google_ads", "paid_google", 1), ("fbclid", "meta", "paid_meta", 2),
    ("ttclid", "tiktok", "paid_tiktok", 3), ("msclkid", "microsoft_ads", "paid_microsoft", 4),
]


def click(spark, d) -> DataFrame:
    e = ev(spark, d).where("event_type = 'click'")
    return e.select(
        "event_id", "user_id", pick(F.col("k") % 4, CLICK_KEYS).alias("click_id_key"),
        F.concat(F.lit("v"), F.col("k").cast("string")).alias("click_id_value"), F.col("ts").alias("click_id_created_at"),
        F.timestamp_micros(F.unix_micros("ts") + (F.col("k") % 3).cast("bigint") * 3_600_000_000).alias("known_at"),
        (F.col("k") % 2 + 1).alias("source_priority"),
    )


UTM_KEYS = ("utm_source", "utm_medium", "utm_campaign")
UTM_VALUES = ("tolt", "google", "cpc", "affiliate", "newsletter")


def utm(spark, d) -> DataFrame:
    e = ev(spark, d).where("event_type = 'view' and k < 40")
    return e.select(
        "event_id", "user_id", pick(F.col("k") % 3, UTM_KEYS).alias("utm_key"), pick(F.col("k") % 5, UTM_VALUES).alias("utm_value"),
        F.col("ts").alias("captured_at"),
        F.timestamp_micros(F.unix_micros("ts") + (F.col("k") % 4).cast("bigint") * 1_800_000_000).alias("known_at"),
        (F.col("k") % 2 + 1).alias("source_priority"),
    )


def exposure_rows(spark, d) -> DataFrame:
    e = ev(spark, d).where("event_type = 'view' and k >= 30")
    return e.select(
        "event_id", "user_id", pick(F.col("k") % 2, FLAGS).alias("flag_key"),
        F.concat(F.lit("arm_"), (F.col("k") % 3).cast("string")).alias("arm"), F.col("ts").alias("event_time"),
        F.when(F.col("k") % 5 == 0, 2).otherwise(1).alias("source_priority"),
    )


def device_events(spark, d) -> DataFrame:
    return ev(spark, d).select(
        "event_id", "user_id", F.col("ts").alias("event_time"), F.concat(F.lit("dev"), (F.col("k") % 3).cast("string")).alias("device_id"), "k",
    )


def deliveries(spark, d) -> DataFrame:
    """Events with every third one delivered again an hour later."""
    e = ev(spark, d).withColumn("received_at", F.col("ts"))
    again = e.where("event_id % 3 = 0").withColumn("received_at", F.timestamp_micros(F.unix_micros("ts") + 3_600_000_000))
    return again.unionByName(e)


def invoice(spark, d) -> DataFrame:
    o = table(spark, d, "orders").withColumn("c", cents("o_totalprice"))
    m = F.col("o_orderkey") % 10
    reason = (
        F.when(m < 3, "subscription_create").when(m < 7, "subscription_cycle").when(m < 9, "subscription_update").otherwise("manual")
    )
    return o.select(
        F.concat(F.lit("in_"), F.col("o_orderkey").cast("string")).alias("invoice_id"),
        F.concat(F.lit("evt_"), F.col("o_orderkey").cast("string")).alias("paid_event_id"),
        F.concat(F.lit("cus_"), F.col("o_custkey").cast("string")).alias("user_id"),
        F.concat(F.lit("sub_"), F.col("o_custkey").cast("string")).alias("subscription_id"),
        F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86400 * 1_000_000).alias("paid_at"),
        F.lit("paid").alias("invoice_status"), reason.alias("billing_reason"),
        F.col("c").alias("amount_paid_minor"), F.col("c").alias("total_minor"),
        F.when(m != 5, F.col("c") - F.expr("c div 11")).alias("total_excluding_tax_minor"),
        pick(F.col("o_custkey") % 6, CURRENCIES).alias("currency"), F.col("o_orderkey").alias("orderkey"),
    )


def invoice_line(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("c", cents("l_extendedprice"))
    return li.select(
        F.concat(F.lit("in_"), F.col("l_orderkey").cast("string")).alias("invoice_id"),
        F.concat_ws("_", F.lit("il"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("line_id"),
        F.when(F.col("l_returnflag") == "R", -F.col("c")).otherwise(F.col("c")).alias("amount_minor"),
        F.concat(F.lit("price_"), F.col("l_partkey").cast("string")).alias("price_id"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        (F.col("l_linestatus") == "F").alias("is_proration"),
        F.col("l_shipdate").cast("timestamp").alias("line_period_end"),
    )


def plan_catalog(spark, d) -> DataFrame:
    p = table(spark, d, "part").where("p_type <> 'SMALL'")
    item = F.when(F.col("p_type") == "PROMO", "credit_pack").when(F.col("p_type") == "ECONOMY", "one_time_pack").otherwise("plan")
    return p.select(
        F.concat(F.lit("price_"), F.col("p_partkey").cast("string")).alias("price_id"), item.alias("item_type"),
        pick(F.col("p_size") % 4, TIERS).alias("plan_tier"), (F.col("p_size") % 4 + 1).cast("bigint").alias("plan_tier_code"),
        F.when(F.col("p_size") % 2 == 0, "month").otherwise("year").alias("billing_interval"),
        cents("p_retailprice").alias("unit_amount_minor"), (F.col("p_size") * 100).cast("bigint").alias("monthly_credits"),
    )


def seed_from(spark: SparkSession, rows, ddl: str) -> DataFrame:
    """A fixed list as a local relation, so the optimizer knows its exact (tiny) size."""
    fields = [f.strip().split(" ") for f in ddl.split(",")]
    body = ", ".join(
        "(" + ", ".join(
            f"CAST({'NULL' if v is None else repr(v)} AS {t})" if not isinstance(v, bool) else f"CAST({str(v).lower()} AS {t})" for v, (_, t) in zip(r, fields)
        ) + ")" for r in rows
    )
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(n for n, _ in fields)})")


def fx_seed(spark) -> DataFrame:
    return seed_from(spark, FX, "currency string, rate_date date, usd_per_unit double")


def minor_units_seed(spark) -> DataFrame:
    return seed_from(spark, MINOR_UNITS, "currency string, minor_unit_digits bigint")


def click_platforms_seed(spark) -> DataFrame:
    return seed_from(spark, CLICK_PLATFORMS, "click_id_key string, platform string, acquisition_channel string, precedence bigint")


# ---- billing extras derived from orders and line items -----------------------

def invoice_full(spark, d) -> DataFrame:
    """Invoices with legacy keys: odd orders carry their charge on the invoice itself."""
    return invoice(spark, d).select(
        "*", F.when(F.col("orderkey") % 2 == 1, F.concat(F.lit("ch_"), F.col("orderkey").cast("string"))).alias("legacy_charge_id"),
        F.lit(None).cast("string").alias("legacy_payment_intent_id"),
        F.timestamp_micros(F.unix_micros("paid_at") + 30 * 86_400_000_000).alias("period_end"),
    )


def payment(spark, d) -> DataFrame:
    key = F.col("orderkey").cast("string")
    return invoice(spark, d).where("orderkey % 2 = 0").select(
        F.concat(F.lit("inpay_"), key).alias("invoice_payment_id"), "invoice_id", F.concat(F.lit("pi_"), key).alias("payment_intent_id"),
        F.concat(F.lit("ch_"), key).alias("charge_id"), F.col("paid_at").alias("payment_created_at"),
    )


def session(spark, d) -> DataFrame:
    """Checkout sessions: one-time packs for every tenth order, subscription checkouts for another tenth."""
    i = invoice(spark, d).where("orderkey % 10 in (0, 9)")
    pack = F.col("orderkey") % 10 == 9
    return i.select(
        F.concat(F.lit("cs_live_"), F.col("orderkey").cast("string")).alias("checkout_session_id"), F.col("paid_event_id").alias("completed_event_id"),
        F.col("paid_at").alias("completed_at"), F.when(pack, "payment").otherwise("subscription").alias("checkout_mode"),
        F.lit("complete").alias("session_status"), F.lit("paid").alias("payment_status"), "user_id",
        F.when(~pack | (F.col("orderkey") % 20 == 9), F.col("invoice_id")).alias("invoice_id"),
        F.when(pack, F.concat(F.lit("pi_"), F.col("orderkey").cast("string"))).alias("payment_intent_id"),
        F.col("amount_paid_minor").alias("amount_total_minor"), F.expr("amount_paid_minor div 11").alias("amount_tax_minor"), "currency",
        F.lit(None).cast("string").alias("ga_client_id"), F.lit(None).cast("string").alias("ga_session_id"), F.lit(None).cast("string").alias("tolt_referral"),
    )


def sub_change(spark, d) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderkey % 5 = 2")
    return o.select(
        F.concat(F.lit("sev_"), F.col("o_orderkey").cast("string")).alias("stripe_event_id"),
        F.concat(F.lit("sub_"), F.col("o_custkey").cast("string")).alias("subscription_id"), F.col("o_orderdate").cast("timestamp").alias("changed_at"),
        F.when(F.col("o_orderkey") % 50 == 2, "customer.subscription.deleted").otherwise("customer.subscription.updated").alias("event_type"),
    )


def sub_item(spark, d) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderkey % 5 = 2")
    return o.select(
        F.concat(F.lit("sev_"), F.col("o_orderkey").cast("string")).alias("stripe_event_id"),
        F.concat(F.lit("price_"), (F.col("o_orderkey") % 200).cast("string")).alias("price_id"), (F.col("o_orderkey") % 7).alias("quantity"),
    )


def _money_out(spark, d, where: str) -> DataFrame:
    li = table(spark, d, "lineitem").where(where)
    o = table(spark, d, "orders").select("o_orderkey", pick(F.col("o_custkey") % 6, CURRENCIES).alias("currency"))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).withColumn(
        "line_ref", F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").cast("string"))
    ).withColumn("key", F.col("l_orderkey").cast("string")).withColumn("c", F.expr("cast(round(l_extendedprice * 100) as bigint)"))


def refund_event(spark, d) -> DataFrame:
    """Returned lines as cumulative refund events of the order's charge."""
    return _money_out(spark, d, "l_returnflag = 'R'").select(
        F.concat(F.lit("evt_r_"), "line_ref").alias("stripe_event_id"), F.col("l_shipdate").cast("timestamp").alias("refunded_at"), F.concat(F.lit("ch_"), "key").alias("charge_id"),
        F.lit(None).cast("string").alias("user_id"), F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("pi_"), "key")).alias("payment_intent_id"),
        F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit("in_"), "key")).alias("legacy_invoice_id"), F.col("c").alias("amount_refunded_cumulative_minor"), "currency",
    )


def dispute_event(spark, d) -> DataFrame:
    """Life of a dispute for some accepted lines: opened, perhaps an inquiry, closed or reinstated."""
    x = _money_out(spark, d, "l_returnflag = 'A' and l_partkey % 4 = 0").dropDuplicates(["line_ref"])
    kind = F.col("l_partkey") % 16
    end = F.when(kind == 0, F.struct(F.lit("charge.dispute.closed").alias("t"), F.lit("won").alias("s"))).when(
        kind == 4, F.struct(F.lit("charge.dispute.closed").alias("t"), F.lit("lost").alias("s"))).when(
        kind == 8, F.struct(F.lit("charge.dispute.updated").alias("t"), F.lit("warning_needs_response").alias("s"))).otherwise(
        F.struct(F.lit("charge.dispute.funds_reinstated").alias("t"), F.lit("under_review").alias("s")))
    start = F.struct(F.lit("charge.dispute.created").alias("t"), F.lit("needs_response").alias("s"))
    x = x.select("*", F.posexplode(F.array(start, end)).alias("i", "e"))
    opened = F.unix_micros(F.col("l_shipdate").cast("timestamp"))
    return x.select(
        F.concat(F.lit("dp_"), "line_ref").alias("dispute_id"), F.concat_ws("_", F.lit("evt_d"), "line_ref", F.col("i").cast("string")).alias("stripe_event_id"),
        F.col("e.t").alias("event_type"), F.timestamp_micros(opened + F.col("i") * 86_400_000_000).alias("created_at"), (opened / 1_000_000).cast("bigint").alias("created"),
        F.concat(F.lit("ch_"), "key").alias("charge"), F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("pi_"), "key")).alias("payment_intent"),
        F.col("c").alias("amount"), "currency", F.when(F.col("l_partkey") % 3 == 0, "fraudulent").otherwise("general").alias("reason"), F.col("e.s").alias("status"),
    )

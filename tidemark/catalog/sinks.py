"""Source and sink queries: derived tables are written to a scratch folder and read back."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from tidemark.catalog.cte import sql
from tidemark.catalog.money import json_deliveries
from tidemark.catalog.registry import query
from tidemark.catalog.usage import ledger as usage_ledger
from tidemark.functions import columns as C
from tidemark.session import checkpoint_folder
from tidemark.sinks import tables as K
from tidemark.sources import driver_tables as D
from tidemark.sources import readers as R
from tidemark.streaming import jobs as J


def scratch(s) -> str:
    return f"{checkpoint_folder(s)}/scratch/{uuid.uuid4().hex}"


@query("src_1_billing_events", sql("SELECT paid_event_id AS id, orderkey % 10 <> 4 AS livemode, CASE WHEN orderkey % 3 = 0 THEN 2 ELSE 1 END AS deliveries, amount_paid_minor FROM invoice_full"))
def _(s, d):
    p = scratch(s)
    json_deliveries(s, d).write.json(p)
    x = R.read_billing_events(s, p)
    return x.groupBy("id", "livemode", C.json_int("data", "object", "amount_paid").alias("amount_paid_minor")).agg(F.count(F.lit(1)).alias("deliveries"))


@query("src_2_product_events", sql("SELECT event_id AS uuid, user_id, ts AS event_time, CAST(k AS BIGINT) AS k FROM ev WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-08'"))
def _(s, d):
    p = scratch(s)
    e = D.ev(s, d).select(F.col("event_id").cast("string").alias("uuid"), "event_type", F.col("user_id").cast("string").alias("user_id"), F.col("ts").alias("event_time"), F.col("props").alias("event_properties"), F.to_date("ts").alias("event_date"))
    e.write.partitionBy("event_date").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(p)
    x = R.read_product_events(s, p).where("event_date between date'2024-01-05' and date'2024-01-08'")
    return x.select(F.col("uuid").cast("bigint").alias("uuid"), F.col("user_id").cast("bigint").alias("user_id"), "event_time", C.json_int("event_properties", "k").alias("k"))


@query("src_3_usage_ledger", sql("SELECT 'u' || event_id AS id, CASE WHEN k <> 50 THEN CAST(user_id AS VARCHAR) END AS user_id, 'm' || (k % 7) || ':text-to-image' AS business_type, 2 AS details, k % 12 AS first_unit_credits FROM ev WHERE event_type IN ('view', 'click', 'error')"))
def _(s, d):
    p = scratch(s)
    usage_ledger(s, d).write.json(p)
    x = R.read_usage_ledger(s, p)
    return x.select("id", F.col("userId").alias("user_id"), F.col("reference.businessType").alias("business_type"), F.size("businessDetails").alias("details"), F.col("businessDetails")[0]["unitCredits"].alias("first_unit_credits"))


@query("src_4_click_posts", sql("SELECT user_id, ts AS received_at, 'v' || k AS gclid, ts - INTERVAL 1 SECOND AS gclid_at FROM ev WHERE event_type = 'click'".replace("ts - INTERVAL 1 SECOND", "make_timestamp((epoch_us(ts) // 1000 - 1000) * 1000)")))
def _(s, d):
    p = scratch(s)
    e = D.ev(s, d).where("event_type = 'click'")
    body = F.to_json(F.struct(F.concat(F.lit("v"), F.col("k").cast("string")).alias("gclid"), (F.unix_millis("ts") - 1000).alias("gclid_created_at")))
    e.select(F.col("user_id").cast("string").alias("user_id"), F.col("ts").alias("received_at"), body.alias("payload")).write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(p)
    x = R.read_click_posts(s, p)
    return x.select(F.col("user_id").cast("bigint").alias("user_id"), "received_at", C.json_str("payload", "gclid").alias("gclid"), C.from_unix_millis(C.json_int("payload", "gclid_created_at")).alias("gclid_at"))


@query("src_5_accounts", sql("SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 2 = 0 THEN 'google' ELSE 'email' END AS provider, 3 AS columns FROM customer"))
def _(s, d):
    p = scratch(s)
    c = D.table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("email"), F.lit("2023-12-31T00:00:00Z").alias("account_created_at"), F.when(F.col("c_custkey") % 2 == 0, "google").otherwise("email").alias("provider"))
    c.write.json(p)
    x = R.read_accounts(s, p)
    return x.select("id", "provider", F.lit(len(x.columns)).alias("columns"))


@query("src_6_lookup_attempts", sql("SELECT o_custkey AS user_id, count(*) AS attempts, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS failed, sum(CASE WHEN o_orderkey % 3 <> 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) END) AS amount_minor FROM orders GROUP BY 1"))
def _(s, d):
    p = scratch(s)
    o = D.table(s, d, "orders")
    ok = F.col("o_orderkey") % 3 != 0
    o.select(F.col("o_custkey").cast("string").alias("user_id"), F.concat(F.lit("cs_"), F.col("o_orderkey").cast("string")).alias("checkout_session_id"), F.col("o_orderdate").cast("timestamp").alias("requested_at"), F.when(ok, 200).otherwise(500).alias("http_status"),
             F.when(ok, F.struct(F.lit(True).alias("isValidInvoice"), D.cents("o_totalprice").alias("amountMinor"))).alias("response")).write.json(p)
    x = R.read_lookup_attempts(s, p)
    return x.groupBy(F.col("user_id").cast("bigint").alias("user_id")).agg(F.count(F.lit(1)).alias("attempts"), C.tally(F.col("http_status") != 200).alias("failed"), F.sum("response.amountMinor").alias("amount_minor"))


@query("src_7_crm", sql("SELECT conv_id, turn, 'https://x.test/p' AS page_url, role AS company_size, length(text) AS n FROM conversations"))
def _(s, d):
    from tidemark.functions.segments import clean_url
    p = scratch(s)
    c = D.table(s, d, "conversations")
    field = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    c.select(F.lit(1).alias("portal_id"), F.lit("g").alias("form_guid"), F.concat_ws("-", "conv_id", "turn").alias("conversionId"), F.lit(1700000000000).alias("submittedAt"), F.lit("https://x.test/p?utm=1#f").alias("pageUrl"), F.array(field("company_size", F.col("role")), field("note", F.col("text"))).alias("values")).write.json(p)
    x = R.read_form_submissions(s, p).select("conversionId", clean_url("pageUrl").alias("page_url"), F.explode("values").alias("f"))
    y = x.groupBy("conversionId", "page_url").pivot("f.name", ["company_size", "note"]).agg(F.max("f.value"))
    part = lambda i: F.split_part("conversionId", F.lit("-"), F.lit(i)).cast("bigint")
    return y.select(part(1).alias("conv_id"), part(2).alias("turn"), "page_url", "company_size", F.length("note").cast("bigint").alias("n"))


@query("src_7b_property_changes", sql("SELECT event_id, event_type AS stage, ts_ms AS occurred_ms FROM (SELECT *, epoch_us(ts) // 1000 AS ts_ms FROM ev WHERE event_type <> 'error')"))
def _(s, d):
    from tidemark.operators.rows import keep_first
    p = scratch(s)
    e = D.ev(s, d).select(F.col("event_id").alias("eventId"), F.unix_millis("ts").alias("occurredAt"), F.explode(F.array(F.lit(2), F.lit(0), F.lit(1))).alias("attemptNumber"), F.col("user_id").alias("objectId"), F.when(F.col("event_type") == "error", "email").otherwise("lifecyclestage").alias("propertyName"), F.col("event_type").alias("propertyValue"))
    e.write.json(p)
    x = keep_first(R.read_property_changes(s, p).where("propertyName = 'lifecyclestage'"), ["eventId"], [F.col("attemptNumber")])
    return x.select(F.col("eventId").alias("event_id"), F.col("propertyValue").alias("stage"), F.unix_millis(C.from_unix_millis("occurredAt")).alias("occurred_ms"))


@query("src_8_platform_reports", sql("SELECT o_orderpriority AS platform, CAST(o_orderdate AS DATE) AS report_date, count(*) AS reports, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS value_minor FROM orders GROUP BY 1, 2"))
def _(s, d):
    p = scratch(s)
    o = D.table(s, d, "orders")
    o.select(F.col("o_orderpriority").alias("platform"), F.lit("a").alias("account_id"), F.lit("tag_received").alias("report_layer"), F.lit("conversion").alias("date_basis"), F.lit("UTC").alias("account_timezone"), F.col("o_orderdate").cast("date").alias("report_date"), F.lit("7d").alias("attribution_setting"),
             F.lit(1.0).alias("conversions"), F.col("o_totalprice").alias("conversion_value"), F.lit("usd").alias("currency"), F.lit("x").alias("data_origin")).write.option("header", True).csv(p)
    x = R.read_platform_reports(s, p)
    return x.groupBy("platform", "report_date").agg(F.count(F.lit(1)).alias("reports"), F.sum(F.round(F.col("conversion_value") * 100).cast("bigint")).alias("value_minor"))


@query("src_9_seed", sql("SELECT price_id, item_type, unit_amount_minor, monthly_credits FROM plan_catalog"))
def _(s, d):
    folder = scratch(s)
    c = D.plan_catalog(s, d).select("price_id", F.lit("prod").alias("product_id"), "item_type", "plan_tier", "billing_interval", "unit_amount_minor", "plan_tier_code", "monthly_credits", F.lit(0).alias("credits_per_unit"), F.lit("e").alias("amount_evidence"), F.lit("s").alias("source"))
    c.write.option("header", True).csv(f"{folder}/plan_catalog.csv")
    return R.read_seed(s, folder, "plan_catalog").select("price_id", "item_type", "unit_amount_minor", "monthly_credits")


@query("src_11_counts", sql("SELECT 'orders' AS \"table\", count(*) AS rows, CAST(1 AS BIGINT) AS expected FROM orders UNION ALL SELECT 'nation', count(*), NULL FROM nation"))
def _(s, d):
    frames = {n: D.table(s, d, n) for n in ("orders", "region", "nation")}
    return R.assert_counts(frames, {"orders": 1, "region": 5})


@query("src_12_freshness", sql("SELECT max(ts) AS newest, CAST(floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts))) / 3600000000) AS BIGINT) AS age_hours, 'warn' AS status FROM ev"))
def _(s, d):
    return R.freshness(D.ev(s, d), "ts", datetime(2024, 2, 1), 12, 48)


# ---- sinks ---------------------------------------------------------------------

@query("snk_1_layer", sql("SELECT user_id, sum(cents) AS cents FROM ev GROUP BY 1"))
def _(s, d):
    return s.read.parquet(K.write_layer(D.ev(s, d).groupBy("user_id").agg(F.sum("cents").alias("cents")), scratch(s), "marts", "spend"))


@query("snk_2_partitioned_mart", sql("SELECT event_id, event_name, user_id FROM purchase"))
def _(s, d):
    p = scratch(s)
    # the first load also holds the errors; a refresh takes their days away
    old = D.ev(s, d).select(F.col("event_id").cast("string").alias("event_id"), F.col("event_type").alias("event_name"), "user_id", F.timestamp_micros(F.unix_micros("ts") - 60 * 86_400_000_000).alias("occurred_at"))
    K.write_mart(old, p, "occurred_at", ["event_name", "user_id"])
    K.write_mart(D.purchase(s, d).select("event_id", "event_name", "user_id", "occurred_at"), p, "occurred_at", ["event_name", "user_id"], files_per_day=2)
    return s.read.parquet(p).select("event_id", "event_name", "user_id")


@query("snk_3_overwrite_days", sql("SELECT CAST(ts AS DATE) AS day, CASE WHEN CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' THEN sum(cents) ELSE count(*) END AS v FROM ev GROUP BY CAST(ts AS DATE)"))
def _(s, d):
    p = scratch(s)
    e = D.ev(s, d).withColumn("day", F.to_date("ts"))
    K.overwrite_days(e.groupBy("day").agg(F.count(F.lit(1)).alias("v")), p, "day")
    K.overwrite_days(e.where("day between date'2024-01-10' and date'2024-01-12'").groupBy("day").agg(F.sum("cents").alias("v")), p, "day")
    return s.read.parquet(p).select("day", "v")


@query("snk_4_append_log", sql("SELECT event_id, CASE WHEN k < 50 THEN 'a' ELSE 'b' END AS load FROM ev"))
def _(s, d):
    p = scratch(s)
    e = D.ev(s, d)
    K.append_new(p, e.where("k < 50").select("event_id", F.lit("a").alias("load")), ["event_id"])
    K.append_new(p, e.select("event_id", F.lit("b").alias("load")), ["event_id"])
    K.append_new(p, e.select("event_id", F.lit("c").alias("load")), ["event_id"])
    return K.read_log(s, p)


@query("snk_5_param_registry", sql("SELECT 'r1' AS ref, n_name AS name, 1 AS version FROM nation UNION ALL SELECT 'r2', n_name, 3 FROM nation"))
def _(s, d):
    p = scratch(s)
    n = D.table(s, d, "nation")
    for version, ref in ((1, "r1"), (2, "r1"), (3, "r2")):
        K.append_param_set(p, n.select(F.lit(ref).alias("ref"), F.col("n_name").alias("name"), F.lit(version).alias("version")), "ref")
    return s.read.parquet(p)


@query("snk_6_export_jsonl", sql("SELECT event_id, strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS occurred_at, 'x' || k AS nested, plan_tier FROM purchase"))
def _(s, d):
    p = scratch(s)
    x = D.purchase(s, d).select("event_id", "occurred_at", F.to_json(F.struct(F.concat(F.lit("x"), F.col("k").cast("string")).alias("v"))).alias("extra"), "plan_tier")
    K.export_jsonl(x, p, ["event_id", "occurred_at", "extra", "plan_tier"], ["extra"], ["event_id"])
    t = s.read.text(p)
    return t.select(*[C.json_str("value", c).alias(c) for c in ("event_id", "occurred_at")], C.json_str("value", "extra", "v").alias("nested"), C.json_str("value", "plan_tier").alias("plan_tier"))


@query("snk_7_views", sql("SELECT event_name, count(*) AS n FROM purchase GROUP BY 1"))
def _(s, d):
    K.create_views({"rpt_purchases": D.purchase(s, d)}, ["user_id", "event_id"])
    return s.sql("SELECT event_name, count(*) AS n FROM rpt_purchases GROUP BY event_name")


@query("snk_8_erasure", sql("SELECT event_id, user_id FROM ev WHERE user_id NOT IN (SELECT user_id FROM ev WHERE event_type = 'error' AND k = 0 AND ts <= TIMESTAMP '2024-01-30' - INTERVAL 48 HOUR)"))
def _(s, d):
    req = D.ev(s, d).where("event_type = 'error' and k = 0").select("user_id", F.col("ts").alias("requested_at"))
    p = scratch(s)
    e = D.ev(s, d).select("event_id", "user_id", "ts")
    # days of their own for rows of erased users only: they end up empty
    alone = e.join(req.where("requested_at <= timestamp'2024-01-28 00:00:00'").select("user_id").distinct(), "user_id", "left_semi")
    alone = alone.withColumn("ts", F.timestamp_micros(F.unix_micros("ts") - 90 * 86_400_000_000)).select(*e.columns)
    # every thirteenth event has no day
    K.overwrite_days(e.unionByName(alone).withColumn("day", F.when(F.col("event_id") % 13 != 0, F.to_date("ts"))), p, "day")
    K.erase_table(s, p, "day", req, datetime(2024, 1, 30), 48)
    return s.read.parquet(p).select("event_id", "user_id")


@query("snk_9_retention", sql("SELECT event_id FROM ev WHERE CAST(ts AS DATE) >= DATE '2024-01-20'"))
def _(s, d):
    p = scratch(s)
    K.overwrite_days(D.ev(s, d).select("event_id", F.to_date("ts").alias("day")), p, "day")
    K.expire_table(s, p, "day", datetime(2024, 1, 30), 10)
    return s.read.parquet(p).select("event_id")


@query("str_5_touched_days", sql("SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM deliveries WHERE received_at <= TIMESTAMP '2024-01-20' AND CAST(ts AS DATE) IN (SELECT CAST(ts AS DATE) FROM deliveries WHERE received_at <= TIMESTAMP '2024-01-20' AND received_at >= TIMESTAMP '2024-01-17') GROUP BY 1"))
def _(s, d):
    src = D.deliveries(s, d).withColumn("day", F.to_date("ts"))
    return J.touched_days(src, "received_at", "day", datetime(2024, 1, 20), 3, 30).groupBy("day").agg(F.count(F.lit(1)).alias("n"))

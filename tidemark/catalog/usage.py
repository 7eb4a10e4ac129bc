"""Usage ledger, priced settings and generation cost."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.catalog.cte import add, sql
from tidemark.catalog.registry import query
from tidemark.params import Params
from tidemark.plans import usage_cost as U
from tidemark.sources import driver_tables as D

P = Params(as_of=datetime(2024, 1, 31), vendor_discount_pct=0.1, vendor_discounts={"fal": 0.25}, failed_cost_share=0.5)
SOURCES = ("https://fal.ai/x", "ESTIMATE gpu", "https://ai.google.dev/p", "https://platform.openai.com", "https://other.example")
OVERRIDES = [
    ("o1", "m1:text-to-image", None, "batch", "fal", None, None, 0.5, None, None), ("o2", "m1:text-to-image", None, None, None, 0.02, None, None, "2024-01-10", "2024-01-20"),
    ("o3", "m2:text-to-image", "s3", None, "deal", None, 0.001, None, "2024-01-05", None),
]
OVERRIDE_DDL = "override_id string, business_type string, setting string, route string, vendor string, unit_cost_usd double, cost_per_credit_usd double, discount_pct double, valid_from date, valid_to date"


def ledger(s, d):
    """Views, clicks and errors as usage rows with two sub-generations; every seventh k is a refund of an earlier row."""
    k = F.col("k")
    e = D.ev(s, d).where("event_type in ('view', 'click', 'error')")
    detail = lambda q, c, o, sub: F.struct(
        q.cast("bigint").alias("quantity"), c.cast("bigint").alias("unitCredits"), sub.alias("subBusinessType"),
        F.struct(F.lit("p").alias("projectId"), F.lit("image").alias("mediaType"), F.lit("web").alias("source"), F.lit(0.0).alias("discountPct"), o.cast("bigint").alias("originalUnitCredits")).alias("metadata"))
    cap = F.concat(F.lit("m"), (k % 7).cast("string"), F.lit(":text-to-image"))
    return e.select(
        F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("id"), F.when(F.col("event_type") == "error", "REFUND").otherwise("CONSUME").alias("type"), F.lit(-1).cast("bigint").alias("amount"),
        F.lit("subscription_monthly_credit").alias("creditField"), F.lit(0).cast("bigint").alias("balanceBefore"), F.lit(0).cast("bigint").alias("balanceAfter"),
        F.struct(cap.alias("businessType"), (k % 10).cast("string").alias("businessId")).alias("reference"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("createdAt"),
        F.when(k != 50, F.col("user_id").cast("string")).alias("userId"),
        F.array(detail(k % 3 + 1, k % 12, k % 5, F.lit("x")), detail(F.lit(1), F.lit(0), F.lit(0), F.when(k % 2 == 0, F.lit("m8:image-to-image")))).alias("businessDetails"))


def settings(s, d):
    p = D.table(s, d, "part")
    return p.select(
        F.concat(F.lit("m"), (F.col("p_size") % 5).cast("string"), F.lit(":text-to-image")).alias("business_type"), F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("setting"),
        (F.col("p_partkey") % 13).alias("credits"), (F.col("p_retailprice") / 1000).alias("list_cost_usd"), D.pick(F.col("p_partkey") % 5, SOURCES).alias("source_url"))


VENDOR = "CASE p_partkey % 5 WHEN 0 THEN 'fal' WHEN 1 THEN 'self_hosted' WHEN 2 THEN 'google' WHEN 3 THEN 'openai' ELSE 'unknown' END"
add("priced", f"""SELECT 'm' || (p_size % 5) || ':text-to-image' AS business_type, 's' || p_partkey AS setting, p_partkey % 13 AS credits, p_retailprice / 1000 AS list_cost_usd, {VENDOR} AS vendor,
    CASE WHEN p_partkey % 5 = 0 THEN CAST(0.25 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END AS discount, p_retailprice / 1000 / (p_partkey % 13) AS cpc FROM part WHERE p_partkey % 13 > 0""")


@query("prj_19_price_settings", sql("SELECT setting, vendor, discount, round(cpc, 9) AS cpc FROM priced"))
def _(s, d):
    return U.price_settings(settings(s, d), P).select("setting", "vendor", F.col("vendor_discount_pct").alias("discount"), F.round("list_cost_per_credit_usd", 9).alias("cpc"))


@query("job_18_model_costs", sql("SELECT business_type, vendor, count(*) AS settings, min(list_cost_usd) AS cheapest, max(credits) AS max_credits FROM priced GROUP BY 1, 2"))
def _(s, d):
    return U.price_settings(settings(s, d), P).groupBy("business_type", "vendor").agg(F.count(F.lit(1)).alias("settings"), F.min("list_cost_usd").alias("cheapest"), F.max("credits").alias("max_credits"))


add("gen", """SELECT 'u' || event_id AS id, pos, user_id, ts, k, 'm' || (k % 7) || ':text-to-image' AS bt, CASE WHEN pos = 1 AND k % 2 = 0 THEN 'm8:image-to-image' ELSE 'm' || (k % 7) || ':text-to-image' END AS cbt,
    CASE WHEN pos = 0 THEN k % 3 + 1 ELSE 1 END AS quantity, CASE WHEN pos = 0 THEN k % 12 ELSE 0 END AS uc, CASE WHEN pos = 0 THEN CASE WHEN k % 12 > 0 THEN k % 12 WHEN k % 5 > 0 THEN k % 5 END END AS cuc
    FROM ev, (VALUES (0), (1)) p(pos) WHERE event_type IN ('view', 'click') AND k <> 50""")
add("gen_failed", "SELECT user_id, k % 7 AS m, k % 10 AS h, min(ts) AS refunded_at FROM ev WHERE event_type = 'error' AND k <> 50 GROUP BY 1, 2, 3")
add("exact", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY business_type, credits ORDER BY list_cost_usd DESC, setting) AS n FROM priced) WHERE n = 1")
add("cheap", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY business_type ORDER BY credits, list_cost_usd, setting) AS n FROM priced) WHERE n = 1")
add("capmean", "SELECT business_type, avg(cpc) AS mean_cpc, max(vendor) AS vendor, max(discount) AS discount FROM priced GROUP BY 1")
add("costed", """SELECT g.*, f.refunded_at IS NOT NULL AS failed, e.setting AS em_setting, o.oid,
    CASE WHEN o.oid = 'o3' THEN 'override_setting' WHEN o.oid IS NOT NULL THEN 'override_capability' WHEN e.setting IS NOT NULL AND g.uc > 0 THEN 'exact_setting' WHEN e.setting IS NOT NULL THEN 'unlimited_original_credits'
         WHEN g.uc = 0 AND c.setting IS NOT NULL THEN 'unlimited_cheapest_setting' WHEN m.business_type IS NOT NULL THEN 'capability_mean_per_credit' ELSE 'default_per_credit' END AS cost_basis,
    coalesce(CASE o.oid WHEN 'o1' THEN 'fal' WHEN 'o3' THEN 'deal' END, e.vendor, c.vendor, m.vendor, 'unknown') AS vendor,
    CASE WHEN o.oid = 'o2' THEN 0.02 * g.quantity WHEN o.oid = 'o3' THEN CAST(0.001 AS DOUBLE) * g.quantity * coalesce(g.cuc, 0)
      ELSE coalesce(CASE WHEN e.setting IS NOT NULL THEN e.list_cost_usd WHEN g.uc = 0 AND c.setting IS NOT NULL THEN c.list_cost_usd WHEN m.business_type IS NOT NULL THEN m.mean_cpc * g.cuc ELSE CAST(0.002 AS DOUBLE) * g.cuc END, 0) * g.quantity
        * (1 - CASE WHEN o.oid = 'o1' THEN CAST(0.5 AS DOUBLE) ELSE coalesce(e.discount, c.discount, m.discount, CAST(0.1 AS DOUBLE)) END) END * CASE WHEN f.refunded_at IS NOT NULL THEN CAST(0.5 AS DOUBLE) ELSE 1 END AS cost
    FROM gen g LEFT JOIN gen_failed f ON f.user_id = g.user_id AND f.m = g.k % 7 AND f.h = g.k % 10 LEFT JOIN exact e ON e.business_type = g.cbt AND e.credits = g.cuc LEFT JOIN cheap c ON c.business_type = g.cbt
    LEFT JOIN capmean m ON m.business_type = g.cbt LEFT JOIN LATERAL (SELECT CASE WHEN g.cbt = 'm1:text-to-image' AND CAST(g.ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' AND false THEN 'o2'
      WHEN g.cbt = 'm1:text-to-image' THEN 'o1' WHEN g.cbt = 'm2:text-to-image' AND e.setting = 's3' AND CAST(g.ts AS DATE) >= DATE '2024-01-05' THEN 'o3' END AS oid) o ON true""")


def generation_cost(s, d):
    entries, _quarantined = U.usage_entries(ledger(s, d), P)
    refunds = entries.where("entry_type = 'REFUND'").select("user_id", "business_type", "business_id", "created_at")
    overrides = D.seed_from(s, OVERRIDES, OVERRIDE_DDL)
    return U.generation_cost(U.usage_details(entries), refunds, U.price_settings(settings(s, d), P), overrides, P)


@query("exp_3_usage_details", sql("SELECT id AS ledger_entry_id, pos AS detail_position, quantity, uc AS unit_credits FROM gen"))
def _(s, d):
    entries, _quarantined = U.usage_entries(ledger(s, d), P)
    return U.usage_details(entries).select("ledger_entry_id", "detail_position", "quantity", "unit_credits")


@query("job_19_generation_cost", sql("""SELECT id || ':' || pos AS generation_id, cost_basis, vendor, failed AS is_failed_generation, quantity * uc AS credits_charged, quantity * coalesce(cuc, 0) AS credits_costed, round(cost, 6) AS cost_usd FROM costed"""))
def _(s, d):
    return generation_cost(s, d).select("generation_id", "cost_basis", "vendor", "is_failed_generation", "credits_charged", "credits_costed", "cost_usd")

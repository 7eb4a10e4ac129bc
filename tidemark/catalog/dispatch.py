"""Dispatch and value-decision queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.catalog.cte import add, sql
from tidemark.catalog.registry import query
from tidemark.functions import columns as C
from tidemark.plans import dispatch as X
from tidemark.sources import driver_tables as D

NOW = datetime(2024, 1, 28)
PLATFORMS = ("meta", "tiktok", "google_ads", "linkedin", "reddit")
MAP = [
    ("purchase_first", "meta", True, "{event_id}", True, True, 7, 172800, False), ("purchase_first", "google_ads", True, "{order_id}", True, False, 90, None, True), ("purchase_first", "tiktok", True, "{event_id}", False, False, 28, None, False),
    ("purchase_renewal", "meta", True, "{missing}", False, False, 7, None, False), ("purchase_renewal", "reddit", True, "r-{user_id}", True, False, 20, 1209600, False), ("purchase_one_time_pack", "google_ads", False, "{order_id}", False, False, 90, None, False),
    ("purchase_upgrade", "linkedin", True, "{event_id}", False, False, 30, None, False), ("purchase_add_on", "google_ads", True, "{event_id}", False, True, 10, None, False),
]
MAP_DDL = "canonical_event string, platform string, send boolean, dedup_template string, browser_twin boolean, requires_web_fix boolean, max_age_days bigint, twin_window_seconds bigint, twin_observed boolean"


def events(s, d):
    k = F.col("k")
    return D.purchase(s, d).select(
        "event_id", "event_name", F.concat(F.lit("sub_"), "event_id").alias("order_id"), "user_id", "occurred_at", (k % 3 == 0).alias("is_first_purchase"), D.pick(k % 5, ("US", "DE", "XX", "US-CA", "BR")).alias("region"),
        *[D.pick((k + o) % m, ("granted", "unknown", "granted", "unknown", "denied")[:m]).alias(n) for n, o, m in (("ad_storage", 0, 4), ("ad_user_data", 1, 5), ("ad_personalization", 2, 4), ("analytics_storage", 0, 2))],
        F.when(k % 2 == 0, "cmp").otherwise("none").alias("consent_source"), F.when(k % 17 == 0, True).alias("gpc"), F.lit(None).cast("boolean").alias("opt_out_sale_sharing"), F.when(k % 3 == 0, "10.0.0.1").alias("client_ip"), "cash_minor", "k")


def mapping(s):
    return D.seed_from(s, MAP, MAP_DDL)


add("mapping", "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else (str(v).lower() if isinstance(v, (bool, int)) else f"'{v}'") for v in r) + ")" for r in MAP) + ") t(event_name, platform, send, tpl, twin, fix, days, tw, observed)")
G5 = "(['granted', 'unknown', 'granted', 'unknown', 'denied'])"
add("dsp", f"""SELECT p.*, m.*, {G5}[k % 4 + 1] AS ad_storage, {G5}[(k + 1) % 5 + 1] AS aud, k % 2 = 0 AS cmp, (['US', 'DE', NULL, 'US', 'BR'])[k % 5 + 1] AS country FROM (SELECT event_id, event_name AS en, user_id, occurred_at, cash_minor, k FROM purchase) p JOIN mapping m ON m.event_name = p.en""")
add("dspc", """SELECT *, CASE WHEN k % 17 = 0 THEN 'gpc_or_sale_opt_out' WHEN aud = 'denied' AND (country = 'DE' OR country IS NULL) THEN 'consent_denied' WHEN country IS NULL AND NOT (cmp AND aud = 'granted' AND ad_storage = 'granted') THEN 'consent_region_unknown'
    WHEN cmp AND aud = 'granted' AND ad_storage = 'granted' THEN NULL WHEN country = 'DE' THEN 'consent_required_regulated_region' WHEN aud = 'denied' THEN CASE WHEN platform = 'meta' AND country <> 'US' THEN 'meta_ldu_us_only' WHEN platform = 'tiktok' AND k % 3 <> 0 THEN 'tiktok_ldu_requires_ip' WHEN platform = 'linkedin' THEN 'consent_denied_no_limited_mode' END END AS block FROM dsp""")


def decided(s, d):
    return X.platform_consent(X.expand_mapping(events(s, d), mapping(s)), ("DE", "FR"), opt_out="limited")


@query("dsp_8_mapping", sql("""SELECT event_id, platform, send, fix AS requires_web_fix, CASE tpl WHEN '{event_id}' THEN event_id WHEN '{order_id}' THEN 'sub_' || event_id WHEN 'r-{user_id}' THEN 'r-' || user_id ELSE tpl END AS dedup_key FROM dsp"""))
def _(s, d):
    return X.expand_mapping(events(s, d), mapping(s)).select("event_id", "platform", "send", "requires_web_fix", "dedup_key")


@query("dsp_1_platform_consent", sql("SELECT event_id, platform, block AS block_reason, CASE WHEN block IS NOT NULL THEN NULL WHEN cmp AND aud = 'granted' AND ad_storage = 'granted' THEN 'granted' WHEN aud = 'denied' THEN 'restricted' ELSE 'unspecified' END AS consent_mode FROM dspc"))
def _(s, d):
    return decided(s, d).select("event_id", "platform", "block_reason", "consent_mode")


add("cstate", f"""SELECT user_id, arg_max(k, ts) AS k FROM ev WHERE event_type = 'view' AND ts <= TIMESTAMP '2024-01-28' GROUP BY 1""")


@query("dsp_2_consent_merge", sql(f"""SELECT p.event_id, CASE WHEN {G5}[(p.k + 1) % 5 + 1] = 'denied' OR s.k % 7 = 0 THEN 'denied' WHEN s.k % 2 = 0 THEN 'granted' ELSE {G5}[(p.k + 1) % 5 + 1] END AS ad_user_data, CASE WHEN s.k % 2 = 0 THEN 'cmp' WHEN p.k % 2 = 0 THEN 'cmp' ELSE 'none' END AS consent_source FROM purchase p LEFT JOIN cstate s USING (user_id)"""))
def _(s, d):
    v = D.ev(s, d).where("event_type = 'view'")
    k = F.col("k")
    states = v.select("user_id", F.col("ts").alias("updated_at"), F.col("event_id").alias("state_id"), F.lit("unknown").alias("ad_storage"), F.when(k % 7 == 0, "denied").otherwise("granted").alias("ad_user_data"), F.lit("unknown").alias("ad_personalization"),
                      F.lit("unknown").alias("analytics_storage"), F.when(k % 2 == 0, "cmp").otherwise("none").alias("source"), F.lit(None).cast("boolean").alias("gpc"))
    return X.consent_as_of(events(s, d), states, NOW).select("event_id", "ad_user_data", "consent_source")


@query("dsp_3_dispatch_plan", sql("""SELECT event_id, platform, CASE WHEN skip IS NOT NULL THEN 'skipped' WHEN hold IS NOT NULL THEN 'held' ELSE 'pending' END AS status, coalesce(skip, hold) AS reason FROM (SELECT *, CASE WHEN platform = 'linkedin' THEN 'platform_disabled' WHEN NOT send THEN 'not_sent_by_mapping'
    WHEN event_name = 'purchase_first' AND platform IN ('meta', 'tiktok') AND k % 3 <> 0 THEN 'not_first_purchase' WHEN block IS NOT NULL THEN block WHEN occurred_at > TIMESTAMP '2024-01-28' + INTERVAL 300 SECOND THEN 'event_time_in_future'
    WHEN twin AND tw IS NOT NULL AND tw < days * 86400 AND TIMESTAMP '2024-01-28' > occurred_at + to_seconds(tw) AND TIMESTAMP '2024-01-28' <= occurred_at + to_days(days::INT) THEN 'twin_window_expired' WHEN TIMESTAMP '2024-01-28' > occurred_at + to_seconds(least(days * 86400, CASE WHEN twin AND tw IS NOT NULL THEN tw ELSE days * 86400 END)) THEN 'window_expired'
    WHEN fix AND platform = 'meta' AND occurred_at < TIMESTAMP '2024-01-27' THEN 'predates_web_fix' END AS skip,
    CASE WHEN fix AND platform <> 'meta' THEN 'awaiting_web_fix' WHEN platform = 'google_ads' AND observed THEN 'awaiting_google_multi_source' WHEN platform = 'reddit' AND twin THEN 'awaiting_reddit_dedup' WHEN k % 4 = 0 THEN 'awaiting_value_score' END AS hold FROM dspc)"""))
def _(s, d):
    live = D.seed_from(s, [("purchase_first", "meta", "2024-01-27 00:00:00")], "event_name string, platform string, live_at timestamp")
    x = decided(s, d).withColumn("value_pending", F.col("k") % 4 == 0)
    return X.dispatch_plan(x, NOW, ("meta", "tiktok", "google_ads", "reddit"), live, False, False).select("event_id", "platform", "status", "reason")


@query("dsp_4_restated_value", sql("""SELECT a.event_id, CASE WHEN a.c < max(a.c) OVER (PARTITION BY a.charge) THEN 'superseded_by_later_refund' ELSE 'pending' END AS status, CASE WHEN NOT a.c < max(a.c) OVER (PARTITION BY a.charge) THEN floor(coalesce(CASE WHEN p.k % 2 = 0 THEN (p.k + 1)::DOUBLE END, p.cash_minor / power(10, 2)) * greatest(p.cash_minor - a.c, 0) / p.cash_minor * 100 + 0.5) / 100 END AS restated_value,
    greatest(p.cash_minor - a.c, 0) = 0 AS full_refund FROM (SELECT event_id || '_' || i AS event_id, event_id AS pid, event_id AS charge, cash_minor * i // 3 AS c FROM purchase, range(1, 4) r(i) WHERE cash_minor > 0) a JOIN purchase p ON p.event_id = a.pid"""))
def _(s, d):
    p = D.purchase(s, d).where("cash_minor > 0")
    i = F.explode(F.array(*[F.lit(n) for n in (1, 2, 3)])).alias("i")
    adj = p.select("*", i).select(F.concat_ws("_", "event_id", F.col("i").cast("string")).alias("event_id"), F.lit("refund").alias("event_name"), F.col("event_id").alias("adjusts_event_id"), F.col("event_id").alias("charge_id"),
                                                     F.expr("cash_minor * i div 3").alias("cumulative_minor"), F.lit(-1).cast("bigint").alias("cash_minor"))
    sends = p.select("event_id", F.lit("google_ads").alias("platform"), F.when(F.col("k") % 2 == 0, (F.col("k") + 1).cast("double")).alias("sent_value"), F.lit("USD").alias("sent_currency"))
    return X.restate(adj, p.withColumn("digits", F.lit(2)), sends).select("event_id", "status", "restated_value", "full_refund")


@query("dsp_5_resolve_clicks", sql("""SELECT p.event_id, CASE WHEN p.k % 4 = 0 THEN 'own' ELSE CASE WHEN g.event_id IS NOT NULL AND p.occurred_at - g.click_id_created_at <= INTERVAL 2 DAY THEN g.click_id_value END END AS gclid, CASE WHEN f.event_id IS NOT NULL AND p.occurred_at - f.click_id_created_at <= INTERVAL 2 DAY THEN f.click_id_value END AS fbclid FROM purchase p
    ASOF LEFT JOIN (SELECT * FROM click WHERE click_id_key = 'gclid') g ON g.user_id = p.user_id AND p.occurred_at >= g.click_id_created_at ASOF LEFT JOIN (SELECT * FROM click WHERE click_id_key = 'fbclid') f ON f.user_id = p.user_id AND p.occurred_at >= f.click_id_created_at"""))
def _(s, d):
    own = F.when(F.col("k") % 4 == 0, F.create_map(F.lit("gclid"), F.lit("own")))
    e = D.purchase(s, d).select("event_id", "user_id", "occurred_at", own.alias("own_click_ids"))
    store = D.click(s, d).select("user_id", "click_id_key", "click_id_value", F.col("click_id_created_at").alias("created_at"))
    x = X.resolve_clicks(e, store, ["gclid", "fbclid"], 2 * 86_400)
    return x.select("event_id", F.try_element_at("click_ids", F.lit("gclid")).alias("gclid"), F.try_element_at("click_ids", F.lit("fbclid")).alias("fbclid"))


def value_inputs(s, d):
    p = D.purchase(s, d)
    score = p.where("k % 5 < 3").select("event_id", "user_id", F.timestamp_micros(F.unix_micros("occurred_at") + (F.col("k") % 8).cast("bigint") * 1_800_000_000).alias("scored_at"), ((F.col("k") - 40) / 4).alias("predicted_profit"))
    old = p.where("k % 13 = 0").select("event_id")
    return p.select("event_id", "user_id", "occurred_at", (F.col("cash_minor") / 100).alias("cash_value"), (F.col("event_name") != "purchase_renewal").alias("acquisition")), score, old


add("vdec", """SELECT event_id, occurred_at, CASE WHEN event_name = 'purchase_renewal' THEN 'cash' WHEN k % 5 < 3 AND k % 8 <= 4 AND occurred_at + to_minutes(30 * (k % 8)) <= TIMESTAMP '2024-01-28' THEN 'predicted_profit_90d' WHEN TIMESTAMP '2024-01-28' >= occurred_at + INTERVAL 2 HOUR THEN 'cash_fallback' ELSE 'pending' END AS basis,
    (k - 40) / 4.0::DOUBLE AS sc, cash_minor, k FROM purchase WHERE k % 13 <> 0""")
add("vout", "SELECT *, CASE WHEN basis = 'predicted_profit_90d' THEN greatest(floor(sc * 100 + 0.5) / 100, 1) ELSE floor(cash_minor / 100.0::DOUBLE * 100 + 0.5) / 100 END AS value, basis = 'predicted_profit_90d' AND floor(sc * 100 + 0.5) / 100 < 1 AS floored FROM vdec")


@query("dsp_6_value_decision", sql("SELECT event_id, basis, value, floored FROM vout"))
def _(s, d):
    p, score, old = value_inputs(s, d)
    return X.decide_value(p, score, old, NOW, 7200, 1.0)


@query("dsp_7_value_health", sql("""SELECT p.platform, count(v.event_id) AS conversions, count(*) FILTER (WHERE v.basis = 'predicted_profit_90d') AS predicted, count(*) FILTER (WHERE v.basis = 'cash_fallback') AS cash_fallback, count(DISTINCT CASE WHEN v.k % 4 <> 3 THEN v.value END) AS distinct_values,
    floor(count(*) FILTER (WHERE v.floored) / nullif(count(v.event_id), 0) * 10000 + 0.5) / 10000 AS floor_share, coalesce(count(v.event_id) >= 30 AND count(DISTINCT CASE WHEN v.k % 4 <> 3 THEN v.value END) >= 5 AND floor(max(CASE WHEN v.k % 4 <> 3 THEN v.value END) / min(CASE WHEN v.k % 4 <> 3 THEN v.value END) * 100 + 0.5) / 100 >= 3, false) AS thresholds_ok
    FROM (VALUES ('meta'), ('tiktok'), ('google_ads')) p(platform) LEFT JOIN (SELECT *, (['meta', 'tiktok'])[k % 2 + 1] AS platform FROM vout WHERE occurred_at >= TIMESTAMP '2024-01-14' AND occurred_at <= TIMESTAMP '2024-01-28') v USING (platform) GROUP BY 1"""))
def _(s, d):
    p, score, old = value_inputs(s, d)
    k = D.purchase(s, d).select("event_id", "occurred_at", "k")
    x = X.decide_value(p, score, old, NOW, 7200, 1.0).join(k, "event_id").select("*", D.pick(F.col("k") % 2, ("meta", "tiktok")).alias("platform"), (F.col("k") % 4 != 3).alias("in_reporting_currency"))
    return X.value_health(x, ("meta", "tiktok", "google_ads"), NOW).select("platform", "conversions", "predicted", "cash_fallback", "distinct_values", "floor_share", "thresholds_ok")

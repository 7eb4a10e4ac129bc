"""Sizing queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.catalog.cte import add, sql
from tidemark.catalog.experiment import E as EX
from tidemark.catalog.registry import query
from tidemark.catalog.scores import usage
from tidemark.plans import sizing as Z
from tidemark.sources import driver_tables as D

START, END, NOW = datetime(2024, 1, 1), datetime(2024, 1, 20), datetime(2024, 1, 31)


@query("siz_0_inventory", sql("SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE k IS NOT NULL) AS with_k, count(*) FILTER (WHERE value > 100) AS high_value FROM ev GROUP BY 1"))
def _(s, d):
    return Z.event_inventory(D.ev(s, d), {"with_k": F.col("k").isNotNull(), "high_value": F.col("value") > 100})


def device_log(s, d):
    k = F.col("k")
    return D.ev(s, d).select(
        F.col("event_id").alias("uuid"), F.concat(F.lit("d"), F.col("user_id").cast("string"), F.lit("_"), (k % 5).cast("string")).alias("device_id"), F.col("ts").alias("event_time"), F.floor(F.unix_micros("ts") / 172_800_000_000).alias("session_id"), (k % 4 == 0).alias("has_fbclid"),
        (F.col("event_type") == "view").alias("is_page_view"), (k % 3 == 0).alias("is_app_page"), (k % 10 == 0).alias("url_has_fbclid"), D.pick(k % 3, ("Android Instagram", "Windows", "Mac")).alias("ua_hint"), D.pick(k % 7, ("m.facebook.com", "google.com", "", "tiktok.com", "x.org", "y.org", "facebook.com.evil")).alias("referring_domain"),
        (k % 8 == 0).alias("paid_click"), (F.col("event_type") == "signup").alias("signed_in"))


add("dlog", """SELECT *, 'd' || user_id || '_' || (k % 5) AS dev, epoch_us(ts) // 172800000000 AS sess FROM ev""")
add("ndev", "SELECT dev, min(ts) AS f FROM dlog WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1 HAVING min(ts) >= TIMESTAMP '2024-01-01' AND min(ts) + INTERVAL 7 DAY <= TIMESTAMP '2024-01-31'")
add("dev7", "SELECT l.* FROM dlog l JOIN ndev USING (dev) WHERE ts < f + INTERVAL 7 DAY")
add("dview", "SELECT *, row_number() OVER (PARTITION BY dev ORDER BY ts, event_id) AS vn FROM dev7 WHERE event_type = 'view' AND dev IN (SELECT dev FROM dev7 WHERE k % 4 = 0)")


@query("siz_1_journeys", sql("""SELECT journey_type, count(*) AS devices, 100 * count(*) / sum(count(*)) OVER () AS pct FROM (SELECT CASE WHEN a.dev IS NULL THEN 'never_reached_app' WHEN a.k % 10 = 0 THEN 'direct_hop' WHEN a.sess = l.sess AND a.vn - l.vn <= 1 THEN 'direct_hop' WHEN a.sess = l.sess THEN 'multi_hop_same_session' ELSE 'return_visit' END AS journey_type
    FROM (SELECT DISTINCT dev FROM dev7 WHERE k % 4 = 0) m LEFT JOIN (SELECT * FROM dview WHERE vn = 1) l USING (dev) LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dev ORDER BY vn) AS rn FROM dview WHERE k % 3 = 0) WHERE rn = 1) a USING (dev)) GROUP BY 1"""))
def _(s, d):
    e = device_log(s, d)
    return Z.journey_types(e, Z.new_devices(e, START, END, NOW))


@query("siz_2_blocker_proxy", sql("""SELECT CAST(date_trunc('week', signup_at) AS DATE) AS signup_week, count(*) AS signups, count(*) FILTER (WHERE NOT seen) AS without_events, count(*) FILTER (WHERE pays) AS payers, count(*) FILTER (WHERE pays AND NOT seen) AS payers_without_events, 100 * count(*) FILTER (WHERE NOT seen) / count(*) AS pct_without_events
    FROM (SELECT *, EXISTS (SELECT 1 FROM ev e WHERE e.user_id = s.user_id AND e.event_type <> 'signup' AND e.ts >= s.signup_at - INTERVAL 1 DAY AND e.ts < s.signup_at + INTERVAL 7 DAY) AS seen, EXISTS (SELECT 1 FROM purchase p WHERE p.user_id = s.user_id AND p.cash_minor > 0) AS pays FROM signup s) GROUP BY 1"""))
def _(s, d):
    # product events: all but the signup itself; payers: whoever paid anything
    e = D.ev(s, d).where("event_type <> 'signup'").select("user_id", F.col("ts").alias("event_time"))
    return Z.blocker_proxy(D.signup(s, d), e, D.purchase(s, d).where("cash_minor > 0"))


@query("siz_3_landing_context", sql("""SELECT landing_context, count(*) AS devices, count(*) FILTER (WHERE paid) AS with_paid_click, count(*) FILTER (WHERE si) AS signed_in, count(*) FILTER (WHERE paid AND NOT si) AS paid_never_signed_in, 100 * count(*) FILTER (WHERE si) / count(*) AS pct_signed_in FROM (SELECT CASE WHEN k % 3 = 0 THEN 'in_app_browser (user agent)' WHEN k % 7 IN (0, 3) THEN 'social_referrer (proxy)' ELSE 'other' END AS landing_context,
    k % 8 = 0 AS paid, si FROM (SELECT dev, arg_min(k, ts) AS k, bool_or(event_type = 'signup') AS si FROM dev7 GROUP BY 1)) GROUP BY 1"""))
def _(s, d):
    e = device_log(s, d)
    return Z.landing_context(e, Z.new_devices(e, START, END, NOW))


@query("siz_4_cost_per_arm", sql("""SELECT flag_key, arm, count(*) AS users, count(*) FILTER (WHERE n > 0) AS active_users, sum(c1) AS cost_24h_micros, sum(c30) AS cost_30d_micros, sum(c30) / 1000000 / count(*) AS cost_30d_per_user FROM (SELECT x.*, (SELECT count(*) FROM usage u WHERE u.user_id = x.user_id AND u.created_at >= x.first_exposed_at AND u.created_at < x.first_exposed_at + INTERVAL 30 DAY) AS n,
    coalesce((SELECT sum(cost_cents * 10000) FROM usage u WHERE u.user_id = x.user_id AND u.created_at >= x.first_exposed_at AND u.created_at < x.first_exposed_at + INTERVAL 1 DAY), 0) AS c1, coalesce((SELECT sum(cost_cents * 10000) FROM usage u WHERE u.user_id = x.user_id AND u.created_at >= x.first_exposed_at AND u.created_at < x.first_exposed_at + INTERVAL 30 DAY), 0) AS c30 FROM exposure x) GROUP BY 1, 2"""))
def _(s, d):
    return Z.cost_per_arm(EX.exposures(D.exposure_rows(s, d)), usage(s, d))


@query("siz_5_revenue_after_first", sql("""SELECT CASE WHEN n = 1 THEN 'first' ELSE 'later' END AS kind, datediff('month', f, CAST(paid_at AS DATE)) AS months_after, count(*) AS invoices, sum(amount_paid_minor) AS paid_minor FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY paid_at, invoice_id) AS n, CAST(min(paid_at) OVER (PARTITION BY user_id) AS DATE) AS f FROM invoice) GROUP BY 1, 2"""))
def _(s, d):
    return Z.revenue_after_first(D.invoice(s, d))


@query("siz_6_time_to_first", sql("""SELECT purchase_timing, count(*) AS first_subscriptions, sum(cash_minor) AS amount_minor, 100 * count(*) / sum(count(*)) OVER () AS pct FROM (SELECT *, CASE WHEN h < 0 THEN 'before signup (check the join)' WHEN h < 24 THEN '0-24h' WHEN h < 72 THEN '1-3d' WHEN h < 168 THEN '3-7d' WHEN h < 336 THEN '7-14d' WHEN h < 720 THEN '14-30d' ELSE '30-60d' END AS purchase_timing
    FROM (SELECT p.*, (epoch_us(p.occurred_at) - epoch_us(s.signup_at)) / 3600000000.0::DOUBLE AS h FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY occurred_at, event_id) AS n FROM purchase WHERE event_name = 'purchase_first') p JOIN signup s USING (user_id) WHERE n = 1)) GROUP BY 1"""))
def _(s, d):
    subs = D.purchase(s, d).where("event_name = 'purchase_first'").select("user_id", F.col("event_id").alias("id"), F.col("occurred_at").alias("purchased_at"), F.col("cash_minor").alias("amount_minor"))
    return Z.time_to_first(D.signup(s, d), subs)


@query("siz_7_currency_mix", sql("SELECT currency, count(*) AS invoices, sum(amount_paid_minor) AS paid_minor, count(*) FILTER (WHERE total_excluding_tax_minor < total_minor) AS taxed, count(*) FILTER (WHERE total_excluding_tax_minor IS NULL) AS tax_unknown, 100 * count(*) / sum(count(*)) OVER () AS pct_invoices FROM invoice GROUP BY 1"))
def _(s, d):
    return Z.currency_mix(D.invoice(s, d))


@query("siz_8_exposure_hygiene", sql("""SELECT flag_key, allocation_slice, first_arm, users, contaminated, 100 * users / sum(users) OVER (PARTITION BY flag_key, allocation_slice) AS pct_of_slice, 100 * sum(users) OVER (PARTITION BY flag_key, allocation_slice) / sum(users) OVER (PARTITION BY flag_key) AS slice_pct_of_flag FROM
    (SELECT flag_key, CASE WHEN user_id % 10 <= 5 THEN 'holdout' ELSE 'bandit' END AS allocation_slice, first_arm, count(*) AS users, count(*) FILTER (WHERE arms > 1) AS contaminated FROM (SELECT user_id, flag_key, arg_min(arm, event_time) AS first_arm, count(DISTINCT arm) AS arms FROM exposure_rows GROUP BY 1, 2) GROUP BY 1, 2, 3)"""))
def _(s, d):
    return Z.exposure_hygiene(D.exposure_rows(s, d))

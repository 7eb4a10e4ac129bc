"""Identity, acquisition, lifecycle events and the conversion ledger."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.catalog.cte import add, sql
from tidemark.catalog.registry import query, shared
from tidemark.functions import columns as C
from tidemark.params import Params
from tidemark.plans import identity as I
from tidemark.plans import ledger as L
from tidemark.operators.rows import keep_first
from tidemark.sinks.tables import stage
from tidemark.sources import driver_tables as D

NOW = datetime(2024, 1, 25)
CLICK_PLATFORMS = D.CLICK_PLATFORMS


def seen_events(s, d):
    k = F.col("k")
    return D.ev(s, d).select(
        "user_id", F.col("event_id").alias("event_uuid"), F.col("ts").alias("event_time"), F.concat(F.lit("dev"), (k % 3).cast("string")).alias("device_id"),
        F.when(k % 3 == 0, F.concat(F.lit("NATION_"), (k % 25).cast("string"))).alias("country"), F.when(k % 5 == 1, D.pick(k % 2, ("desktop", "mobile"))).alias("ep_device"),
        F.when(k % 2 == 0, F.lit("Apple iPhone")).otherwise(F.lit("PC")).alias("device_type"), F.lit("os").alias("os_name"), F.lit("Web").alias("platform"))


@query("job_9_first_seen", sql("""SELECT user_id, count(*) AS amplitude_events, min(ts) AS first_event_at, arg_min(CASE WHEN k % 3 = 0 THEN 'NATION_' || (k % 25) END, ts) AS first_country,
    min(ts) FILTER (WHERE k % 3 = 0) AS first_country_at, arg_min(CASE k % 2 WHEN 0 THEN 'desktop' ELSE 'mobile' END, ts) FILTER (WHERE k % 5 = 1) AS first_device_class,
    arg_min(CASE k % 2 WHEN 0 THEN 'Apple iPhone' ELSE 'PC' END, ts) FILTER (WHERE k % 5 = 1) AS first_device_type, arg_min('dev' || (k % 3), ts) AS first_device_id FROM ev GROUP BY 1"""))
def _(s, d):
    return I.first_seen(seen_events(s, d), "event_uuid").select("user_id", "amplitude_events", "first_event_at", "first_country", "first_country_at", "first_device_class", "first_device_type", "first_device_id")


def profile(s, d):
    seen = I.first_seen(seen_events(s, d), "event_uuid")
    grants = D.ev(s, d).where("event_type = 'signup' and k < 80").select("user_id", F.col("ts").alias("created_at"))
    accounts = D.table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("2023-12-31").cast("timestamp").alias("account_created_at"))
    countries = D.table(s, d, "nation").select(F.col("n_name").alias("country_name"), F.concat(F.lit("C"), F.col("n_nationkey").cast("string")).alias("iso2"), (F.col("n_regionkey") == 3).alias("is_eea_uk_ch"))
    qa = D.table(s, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    orders = D.table(s, d, "orders").select(F.col("o_custkey").alias("user_id"))
    return I.profile([D.ev(s, d), orders, accounts], grants, accounts, seen, countries, qa)


add("profile", """SELECT u.user_id, coalesce(g.at, CASE WHEN c.c_custkey IS NOT NULL THEN TIMESTAMP '2023-12-31' END) AS signup_at, CASE WHEN g.at IS NOT NULL THEN 'credit_ledger_trial_grant' WHEN c.c_custkey IS NOT NULL THEN 'app_account_created_at' END AS signup_source,
    coalesce(f.n, 0) AS amplitude_events, 'C' || n.n_nationkey AS country_code, n.n_regionkey = 3 AS is_eea_uk_ch, coalesce(c.c_acctbal < 0, false) AS is_qa_account, f.first_device_id
    FROM (SELECT user_id FROM ev UNION SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer) u LEFT JOIN customer c ON c.c_custkey = u.user_id
    LEFT JOIN (SELECT user_id, min(ts) AS at FROM ev WHERE event_type = 'signup' AND k < 80 GROUP BY 1) g ON g.user_id = u.user_id
    LEFT JOIN (SELECT user_id, count(*) AS n, arg_min('dev' || (k % 3), ts) AS first_device_id, arg_min(CASE WHEN k % 3 = 0 THEN 'NATION_' || (k % 25) END, ts) AS country FROM ev GROUP BY 1) f ON f.user_id = u.user_id
    LEFT JOIN nation n ON n.n_name = f.country""")


@query("job_8_profile", sql("SELECT user_id, signup_at, signup_source, amplitude_events, country_code, is_eea_uk_ch, is_qa_account FROM profile"))
def _(s, d):
    return profile(s, d).select("user_id", "signup_at", "signup_source", "amplitude_events", "country_code", "is_eea_uk_ch", "is_qa_account")


add("timeline", "SELECT user_id, device_id, event_time AS device_since FROM (SELECT *, lag(device_id) OVER (PARTITION BY user_id ORDER BY event_time, event_id) AS p FROM device_events) WHERE p IS NULL OR p <> device_id")


@query("job_10_device_timeline", sql("SELECT user_id, device_id, count(*) AS switches, min(device_since) AS first_at, max(device_since) AS last_at FROM timeline GROUP BY 1, 2"))
def _(s, d):
    t = I.device_timeline(D.device_events(s, d), "event_id")
    return t.groupBy("user_id", "device_id").agg(F.count(F.lit(1)).alias("switches"), F.min("device_since").alias("first_at"), F.max("device_since").alias("last_at"))


KEYS = ["gclid", "fbclid"]


def posts(s, d):
    k = F.col("k")
    return D.ev(s, d).where("event_type = 'click'").select(
        "user_id", F.col("ts").alias("received_at"), F.when(k % 2 == 0, F.concat(F.lit("g"), (k % 5).cast("string"))).alias("gclid"), F.when(k % 3 == 0, F.concat(F.lit("f"), (k % 4).cast("string"))).alias("fbclid"),
        F.when(k % 4 == 0, C.add_seconds("ts", -60)).alias("gclid_created_at"), F.lit(None).cast("timestamp").alias("fbclid_created_at"),
        F.when(k % 2 == 0, F.concat(F.lit("s"), (k % 5).cast("string"))).alias("utm_source"), F.when(k % 3 == 0, "cpc").alias("utm_medium"), F.when(k % 6 == 0, C.add_seconds("ts", -600)).alias("context_captured_at"))


def props(s, d):
    k = F.col("k")
    return D.ev(s, d).where("event_type = 'view'").select(
        "user_id", F.col("event_id").alias("event_uuid"), F.col("ts").alias("event_time"), F.when(k % 2 == 1, F.concat(F.lit("p"), k.cast("string"))).alias("initial_gclid"), F.when(k % 5 == 0, F.lit("fb")).alias("initial_fbclid"),
        F.when(k % 2 == 1, F.concat(F.lit("a"), k.cast("string"))).alias("initial_utm_source"), F.when(k % 7 == 0, F.lit("paid")).alias("initial_utm_medium"))


@query("job_11_click_history", sql("""SELECT user_id, key AS click_id_key, v AS click_id_value, min(coalesce(c, ts)) AS click_id_created_at, min(ts) AS known_at, 1 AS source_priority FROM
    (SELECT user_id, ts, 'gclid' AS key, 'g' || (k % 5) AS v, CASE WHEN k % 4 = 0 THEN ts - INTERVAL 60 SECOND END AS c FROM ev WHERE event_type = 'click' AND k % 2 = 0 UNION ALL SELECT user_id, ts, 'fbclid', 'f' || (k % 4), NULL FROM ev WHERE event_type = 'click' AND k % 3 = 0) GROUP BY 1, 2, 3
    UNION ALL SELECT user_id, 'gclid', arg_min('p' || k, ts), min(ts), min(ts), 2 FROM ev WHERE event_type = 'view' AND k % 2 = 1 GROUP BY 1 UNION ALL SELECT user_id, 'fbclid', 'fb', min(ts), min(ts), 2 FROM ev WHERE event_type = 'view' AND k % 5 = 0 GROUP BY 1"""))
def _(s, d):
    return I.click_history(posts(s, d), props(s, d), KEYS)


@query("job_12_utm_history", sql("""SELECT user_id, 'utm_source' AS utm_key, v AS utm_value, c AS captured_at, ts AS known_at, 1 AS source_priority FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c, ts) AS n FROM (SELECT user_id, ts, 's' || (k % 5) AS v, CASE WHEN k % 6 = 0 THEN ts - INTERVAL 600 SECOND ELSE ts END AS c FROM ev WHERE event_type = 'click' AND k % 2 = 0)) WHERE n = 1
    UNION ALL SELECT user_id, 'utm_medium', 'cpc', c, ts, 1 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c, ts) AS n FROM (SELECT user_id, ts, CASE WHEN k % 6 = 0 THEN ts - INTERVAL 600 SECOND ELSE ts END AS c FROM ev WHERE event_type = 'click' AND k % 3 = 0)) WHERE n = 1
    UNION ALL SELECT user_id, 'utm_source', arg_min('a' || k, ts), min(ts), min(ts), 2 FROM ev WHERE event_type = 'view' AND k % 2 = 1 GROUP BY 1 UNION ALL SELECT user_id, 'utm_medium', 'paid', min(ts), min(ts), 2 FROM ev WHERE event_type = 'view' AND k % 7 = 0 GROUP BY 1"""))
def _(s, d):
    return I.utm_history(posts(s, d), props(s, d), ["utm_source", "utm_medium"])


def acquisition(s, d, inclusive=True):
    p = D.purchase(s, d).select(F.col("event_id").alias("anchor_key"), "user_id", F.col("occurred_at").alias("anchor_at"))
    return I.acquisition_as_of(p, D.click(s, d), D.utm(s, d), CLICK_PLATFORMS, inclusive, D.UTM_KEYS)


add("acq_click", """SELECT * FROM (SELECT b.*, row_number() OVER (PARTITION BY anchor_key ORDER BY click_id_created_at DESC, precedence, click_id_key) AS m FROM (SELECT p.event_id AS anchor_key, c.*, q.platform, q.acquisition_channel, q.precedence,
    row_number() OVER (PARTITION BY p.event_id, c.click_id_key ORDER BY c.source_priority, c.click_id_created_at DESC, c.click_id_value) AS n FROM purchase p JOIN click c ON c.user_id = p.user_id AND c.known_at <= p.occurred_at JOIN click_platforms q USING (click_id_key)) b WHERE n = 1) WHERE m = 1""")
add("acq_utm", """SELECT anchor_key, max(utm_value) FILTER (WHERE utm_key = 'utm_source') AS utm_source, max(utm_value) FILTER (WHERE utm_key = 'utm_medium') AS utm_medium, max(known_at) AS utm_known_at FROM
    (SELECT p.event_id AS anchor_key, u.*, row_number() OVER (PARTITION BY p.event_id, u.utm_key ORDER BY u.source_priority, u.known_at, u.utm_value) AS n FROM purchase p JOIN utm u ON u.user_id = p.user_id AND u.known_at <= p.occurred_at) WHERE n = 1 GROUP BY 1""")
add("acquisition", """SELECT p.event_id AS anchor_key, coalesce(c.acquisition_channel, CASE WHEN u.utm_source = 'tolt' OR u.utm_medium = 'affiliate' THEN 'affiliate' WHEN u.utm_medium IN ('cpc') THEN 'paid_other' WHEN u.utm_source IS NOT NULL THEN 'referral_other' ELSE 'organic' END) AS acquisition_channel,
    c.platform AS acquisition_platform, c.click_id_key AS acquisition_click_id_key, c.click_id_created_at AS acquisition_click_at, u.utm_source, u.utm_known_at FROM purchase p LEFT JOIN acq_click c ON c.anchor_key = p.event_id LEFT JOIN acq_utm u ON u.anchor_key = p.event_id""")


@query("job_13_acquisition", sql("SELECT * FROM acquisition"))
def _(s, d):
    return acquisition(s, d).select("anchor_key", "acquisition_channel", "acquisition_platform", "acquisition_click_id_key", "acquisition_click_at", "utm_source", "utm_known_at")


@query("job_14_merge_touches", sql("""SELECT user_id, arg_min('s' || (k % 6), ts) AS first_source, min(ts) AS first_at, arg_max('s' || (k % 6), ts) FILTER (WHERE k % 4 <> 0) AS last_source, max(ts) FILTER (WHERE k % 4 <> 0) AS last_at,
    (SELECT count(*) FROM ev z WHERE z.user_id = x.user_id AND z.event_type = 'click') AS records, CASE WHEN (SELECT bool_and(k < 97) FROM ev z WHERE z.user_id = x.user_id AND z.event_type = 'click') THEN 'full' ELSE 'utm-only' END AS consent_mode
    FROM (SELECT e.*, (SELECT max(ts) - INTERVAL 5 DAY FROM ev m WHERE m.user_id = e.user_id) AS cut FROM ev e WHERE event_type = 'click') x WHERE ts <= cut GROUP BY 1"""))
def _(s, d):
    e = D.ev(s, d)
    touch = F.struct(F.col("ts").alias("at"), F.when(F.col("k") % 4 == 0, "direct").otherwise("paid").alias("type"), F.concat(F.lit("s"), (F.col("k") % 6).cast("string")).alias("source"))
    r = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("device_id"), F.when(F.col("k") < 97, "full").otherwise("utm-only").alias("consent_mode"), F.col("ts").alias("updated_at"), touch.alias("first_touch"), touch.alias("last_touch"))
    cut = e.groupBy("user_id").agg(C.add_seconds(F.max("ts"), -5 * 86400).alias("signup_at"))
    return I.merge_touches(r, cut).drop("device_id")


add("replay_obs", "SELECT DISTINCT user_id, click_id_key, 'v' || (k % 3) AS v, least(ts, TIMESTAMP '2024-01-25') AS seen FROM (SELECT c.*, e.k, e.ts FROM click c JOIN ev e USING (event_id)) WHERE least(ts, TIMESTAMP '2024-01-25') > TIMESTAMP '2024-01-25' - INTERVAL 20 DAY")


@query("job_21_click_replay", sql("""SELECT user_id, click_id_key, arg_max(v, row(seen, v)) AS click_id_value, max(seen) AS click_id_at FROM (SELECT *, lag(v) OVER (PARTITION BY user_id, click_id_key ORDER BY seen, v) AS p FROM replay_obs) WHERE p IS NULL OR p <> v GROUP BY 1, 2"""))
def _(s, d):
    obs = D.click(s, d).withColumn("k", F.substring("click_id_value", 2, 9).cast("int")).select(
        "user_id", "click_id_key", F.concat(F.lit("v"), (F.col("k") % 3).cast("string")).alias("click_id_value"), F.col("click_id_created_at").alias("observed_at"))
    return I.resolve_clicks_replay(obs, NOW, 20 * 86400)


AGENTS = ("Mozilla/5.0 (Windows NT 10.0)", "Mozilla/5.0 (compatible; Googlebot/2.1)", "curl/8.0", "Mozilla/5.0 CUBOT X30")


@query("job_22_page_visits", sql("SELECT event_id FROM ev WHERE k % 4 IN (0, 3) AND k % 7 NOT IN (1, 2, 3) AND k % 5 <> 1 AND k % 6 NOT IN (2, 3, 4, 5)"))
def _(s, d):
    k = F.col("k")
    req = D.ev(s, d).select(
        "event_id", F.when(k % 7 == 1, "POST").otherwise("GET").alias("method"), F.when(k % 7 == 2, "/static/App.JS").when(k % 7 == 3, "/Assets/logo").when(k % 7 == 4, "/v1.2/assets").otherwise("/pricing").alias("path"),
        F.when(k % 5 == 1, "image").when(k % 5 == 2, "document").alias("fetch_dest"), F.when(k % 5 == 3, "navigate").alias("fetch_mode"), F.lit("text/html,*/*").alias("accept"),
        F.when(k % 6 == 2, "Prefetch;anonymous").alias("sec_purpose"), F.when(k % 6 == 3, " Preview").when(k % 6 == 0, "prefetch;x").alias("purpose"), F.when(k % 6 == 4, "prefetch").when(k % 6 == 1, "previewed").alias("x_purpose"),
        F.when(k % 6 == 5, "PREFETCH").when(k % 6 == 0, "preview").alias("x_moz"), D.pick(k % 4, AGENTS).alias("user_agent"))
    return I.page_visits(req, ("/assets/",)).select("event_id")


@query("job_23_enrich", sql("""SELECT e.event_id, coalesce(CASE WHEN e.k % 2 = 0 THEN 'own' END, f.dev) AS device_id, coalesce(CASE WHEN e.k % 3 = 0 THEN 'arm_own' END, f.arm) AS arm, 'fb.1.' || (epoch_us(f.at) // 1000) || '.' || f.v AS click_ref FROM ev e
    LEFT JOIN (SELECT user_id, arg_min('dev' || (k % 3), ts) AS dev, arg_min('arm_' || (k % 3), ts) AS arm, min(ts) FILTER (WHERE event_type = 'click') AS at, arg_min('v' || k, ts) FILTER (WHERE event_type = 'click') AS v FROM ev GROUP BY 1) f USING (user_id)"""))
def _(s, d):
    e = D.ev(s, d)
    order = [F.col("ts"), F.col("event_id")]
    click = F.col("event_type") == "click"
    users = e.groupBy("user_id").agg(
        C.first_by(F.concat(F.lit("dev"), (F.col("k") % 3).cast("string")), order).alias("user_device_id"), C.first_by(F.concat(F.lit("arm_"), (F.col("k") % 3).cast("string")), order).alias("user_arm"),
        C.first_by(F.col("ts"), order, click).alias("click_seen_at"), C.first_by(F.concat(F.lit("v"), F.col("k").cast("string")), order, click).alias("click_id_value"))
    x = e.select("event_id", "user_id", F.when(F.col("k") % 2 == 0, "own").alias("device_id"), F.when(F.col("k") % 3 == 0, "arm_own").alias("arm"))
    return I.enrich(x, users).select("event_id", "device_id", "arm", "click_ref")


# ---- lifecycle events and the ledger -------------------------------------------

def lifecycle_parts(s, d):
    e = D.ev(s, d)
    grants = e.where("event_type = 'signup' and k < 80").select("user_id", F.col("ts").alias("created_at"), F.col("event_id").alias("ledger_entry_id"))
    accounts = D.table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("2023-12-31").cast("timestamp").alias("account_created_at"))
    entries = D.usage(s, d).where("not is_failed").select("user_id", "created_at", F.col("usage_id").alias("ledger_entry_id"), "model_id", "credits", F.lit(True).alias("is_generation"))
    check = e.where("event_type = 'click' and k > 90").select(
        F.lit("subscription_started").alias("event_type"), F.col("event_id").alias("event_uuid"), F.col("ts").alias("event_time"), "user_id", D.pick(F.col("k") % 3, ("Essential", "gold", "WONDER")).alias("tier"), D.pick(F.col("k") % 2, ("month", "week")).alias("interval"))
    return L.signups(grants, accounts), L.activations(entries), L.checkouts(check)


add("lifecycle", """SELECT 'reg_' || user_id AS event_id, 'signup' AS event_name, min(ts) AS occurred_at, user_id, NULL AS plan_tier, NULL AS billing_interval FROM ev WHERE event_type = 'signup' AND k < 80 GROUP BY user_id
    UNION ALL SELECT 'reg_' || c_custkey, 'signup', TIMESTAMP '2023-12-31', c_custkey, NULL, NULL FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM ev WHERE event_type = 'signup' AND k < 80)
    UNION ALL SELECT 'activation_' || user_id, 'activation_first_generation', min(created_at), user_id, NULL, NULL FROM usage WHERE NOT is_failed GROUP BY user_id
    UNION ALL SELECT 'checkout_' || event_id, 'checkout_started', ts, user_id, CASE k % 3 WHEN 0 THEN 'essential' WHEN 2 THEN 'wonder' END, CASE WHEN k % 2 = 0 THEN 'month' END FROM ev WHERE event_type = 'click' AND k > 90""")


@query("job_15_lifecycle_events", sql("SELECT * FROM lifecycle"))
def _(s, d):
    a, b, c = lifecycle_parts(s, d)
    ids = ["event_id", "event_name", "occurred_at", "user_id"]
    empty = D.purchase(s, d).select(*ids).where("false")
    out = L.canonical_events(a, b, c, empty, empty.withColumn("is_ledger_event", F.lit(True)))
    return out.select(*ids, "plan_tier", "billing_interval")


def all_events(s, d):
    a, b, c = lifecycle_parts(s, d)
    p = D.purchase(s, d).withColumn("order_id", F.concat(F.lit("sub_"), "event_id")).drop("k")
    adj = D.adjustment(s, d).withColumn("is_ledger_event", F.col("cash_minor") < 0)
    return L.canonical_events(a, b, c, p, adj)


@query("job_16_canonical_events", sql("""SELECT event_id, event_name, occurred_at, user_id, plan_tier, billing_interval, NULL AS cash_minor, NULL AS adjusts_event_id FROM lifecycle
    UNION ALL SELECT event_id, event_name, occurred_at, user_id, plan_tier, billing_interval, cash_minor, NULL FROM purchase UNION ALL SELECT event_id, event_name, occurred_at, user_id, NULL, NULL, cash_minor, adjusts_event_id FROM adjustment WHERE cash_minor < 0"""))
def _(s, d):
    return all_events(s, d).select("event_id", "event_name", "occurred_at", "user_id", "plan_tier", "billing_interval", "cash_minor", "adjusts_event_id")


def first_exposures(s, d):
    x = keep_first(D.exposure_rows(s, d), ["user_id", "flag_key"], [F.col("source_priority"), F.col("event_time"), F.col("event_id")])
    return x.select("user_id", "flag_key", "arm", F.col("event_time").alias("first_exposed_at"))


WEB_FIX = [("purchase_first", "meta", True, True), ("purchase_first", "google_ads", True, True), ("signup", "tiktok", True, True), ("refund", "meta", False, True), ("purchase_renewal", "meta", True, False)]


@shared
def conversion_ledger(s, d):
    ev = all_events(s, d)
    fix = D.seed_from(s, WEB_FIX, "canonical_event string, platform string, send boolean, requires_web_fix boolean")
    return stage(L.conversion_ledger(ev, profile(s, d), I.device_timeline(D.device_events(s, d), "event_id"), D.click(s, d), D.utm(s, d), first_exposures(s, d), fix, Params(), D.CLICK_KEYS, D.UTM_KEYS, D.FLAGS))


add("exposure", "SELECT user_id, flag_key, arm, event_time AS first_exposed_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id, flag_key ORDER BY source_priority, event_time, event_id) AS n FROM exposure_rows) WHERE n = 1")
add("all_events", """SELECT event_id, event_name, occurred_at, user_id, NULL AS order_id FROM lifecycle UNION ALL SELECT event_id, event_name, occurred_at, user_id, 'sub_' || event_id FROM purchase UNION ALL SELECT event_id, event_name, occurred_at, user_id, NULL FROM adjustment WHERE cash_minor < 0""")
LEDGER = sql("""SELECT e.event_id, coalesce(t.device_id, p.first_device_id) AS device_id, c.v AS gclid_value, u.v AS utm_source, x.arm AS image_arm,
    CASE e.event_name WHEN 'purchase_first' THEN 'google_ads,meta' WHEN 'signup' THEN 'tiktok' END AS web_fix_platforms, sha256(e.order_id) AS order_id_sha256, c.v IS NOT NULL AS has_google_click_id, u.v IS NOT NULL AS has_utm_source, p.is_qa_account,
    p.country_code IS NOT NULL AS consent_region_known
    FROM (SELECT *, occurred_at + INTERVAL 300 SECOND AS until FROM all_events) e LEFT JOIN profile p ON p.user_id = e.user_id
    ASOF LEFT JOIN timeline t ON t.user_id = e.user_id AND t.device_since <= e.until
    LEFT JOIN (SELECT * FROM (SELECT a.event_id, k.click_id_value AS v, row_number() OVER (PARTITION BY a.event_id ORDER BY k.source_priority, k.click_id_created_at DESC, k.click_id_value) AS n FROM all_events a JOIN click k ON k.user_id = a.user_id AND k.click_id_key = 'gclid'
        AND k.click_id_created_at <= a.occurred_at + INTERVAL 300 SECOND WHERE a.event_name NOT IN ('refund', 'chargeback')) WHERE n = 1) c ON c.event_id = e.event_id
    LEFT JOIN (SELECT * FROM (SELECT a.event_id, k.utm_value AS v, row_number() OVER (PARTITION BY a.event_id ORDER BY k.source_priority, k.captured_at) AS n FROM all_events a JOIN utm k ON k.user_id = a.user_id AND k.utm_key = 'utm_source'
        AND k.captured_at <= a.occurred_at + INTERVAL 300 SECOND WHERE a.event_name NOT IN ('refund', 'chargeback')) WHERE n = 1) u ON u.event_id = e.event_id
    LEFT JOIN exposure x ON x.user_id = e.user_id AND x.flag_key = 'suite-default-model-create-image' AND x.first_exposed_at <= e.until""")


@query("job_17_conversion_ledger", LEDGER)
def _(s, d):
    return conversion_ledger(s, d).select(
        "event_id", "device_id", F.try_element_at("click_ids", F.lit("gclid"))["value"].alias("gclid_value"), F.try_element_at("utm", F.lit("utm_source")).alias("utm_source"),
        F.try_element_at("experiment_arms", F.lit(D.FLAGS[0])).alias("image_arm"), "web_fix_platforms", "order_id_sha256", "has_google_click_id", "has_utm_source", "is_qa_account", "consent_region_known")


@query("prj_20_coverage_flags", sql("""SELECT e.event_name, count(*) AS events, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM click k WHERE k.user_id = e.user_id AND k.click_id_created_at <= e.occurred_at + INTERVAL 300 SECOND)) AS with_click,
    count(*) FILTER (WHERE EXISTS (SELECT 1 FROM click k WHERE k.user_id = e.user_id AND k.click_id_key = 'fbclid' AND k.click_id_created_at <= e.occurred_at + INTERVAL 300 SECOND)) AS fbc_buildable FROM all_events e
    WHERE e.event_name NOT IN ('refund', 'chargeback') GROUP BY 1"""))
def _(s, d):
    x = conversion_ledger(s, d).where(~F.col("event_name").isin(*L.MONEY_OUT))
    return x.groupBy("event_name").agg(F.count(F.lit(1)).alias("events"), C.tally(F.col("has_any_click_id")).alias("with_click"), C.tally(F.col("meta_fbc_buildable")).alias("fbc_buildable"))

"""Scans, projections, fan-out, deduplication, joins, aggregates, windows, top-k and set operations."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.catalog.cte import sql
from tidemark.catalog.registry import query
from tidemark.functions import columns as C
from tidemark.functions import segments as G
from tidemark.operators import rows as R
from tidemark.operators.running import BLOCK_ROWS, Agg, in_window, latest, lookup, running
from tidemark.sources import driver_tables as D

AS_OF = datetime(2024, 1, 20)


# ---- projections -----------------------------------------------------------

@query("prj_1_whitelist", sql("""SELECT c_custkey AS id, c_mktsegment AS segment, c_nationkey AS nation, false AS leaks_name FROM customer"""))
def _(s, d):
    c = D.table(s, d, "customer")
    raw = c.select(F.to_json(F.struct(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"),
        F.struct(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("street")).alias("address"),
    )).alias("obj"))
    kept = raw.select(R.whitelist(F.col("obj"), "id long, segment string, address struct<nation: long>").alias("o"))
    return kept.select(
        C.json_int("o", "id").alias("id"), C.json_str("o", "segment").alias("segment"), C.json_int("o", "address", "nation").alias("nation"),
        F.col("o").contains("Customer#").alias("leaks_name"),
    )


@query("prj_2_extract", sql("""SELECT event_id, json_extract_string(props, '$.k') AS k_str, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k_int,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k_float, CAST(NULL AS BOOLEAN) AS k_bool, CAST(NULL AS BIGINT) AS missing FROM events"""))
def _(s, d):
    return D.table(s, d, "events").select(
        "event_id", C.json_str("props", "k").alias("k_str"), C.json_int("props", "k").alias("k_int"), C.json_float("props", "k").alias("k_float"),
        C.json_bool("props", "k").alias("k_bool"), C.json_int("props", "absent").alias("missing"),
    )


@query("prj_3_coalesce_paths", sql("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, 'price_' || l_partkey AS price_id FROM lineitem"""))
def _(s, d):
    li = D.table(s, d, "lineitem")
    price = F.concat(F.lit("price_"), F.col("l_partkey").cast("string"))
    new = F.when(F.col("l_partkey") % 2 == 0, F.struct(F.struct(price.alias("price")).alias("price_details")))
    old = F.when(F.col("l_partkey") % 2 == 1, F.struct(price.alias("id")))
    raw = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.to_json(F.struct(new.alias("pricing"), old.alias("price"))).alias("j"))
    return raw.withColumn("price_id", F.coalesce(C.json_str("j", "pricing", "price_details", "price"), C.json_str("j", "price", "id"))).drop("j")


@query("prj_4_as_of", sql("SELECT event_id, received_at FROM deliveries WHERE received_at <= TIMESTAMP '2024-01-20'"))
def _(s, d):
    return D.deliveries(s, d).where(F.col("received_at") <= F.lit(AS_OF)).select("event_id", "received_at")


@query("prj_5_live_only", sql("SELECT event_id, k FROM ev WHERE k % 10 <> 0"))
def _(s, d):
    return D.ev(s, d).withColumn("livemode", F.col("k") % 10 != 0).where("livemode").select("event_id", "k")


HANDLED = ("signup", "purchase", "click")


@query("prj_6_handled_flag", sql("SELECT event_id, event_type IN ('signup', 'purchase', 'click') AS is_handled FROM events"))
def _(s, d):
    return D.table(s, d, "events").select("event_id", F.col("event_type").isin(*HANDLED).alias("is_handled"))


@query("prj_7_member_flag", sql("SELECT e.event_id, e.user_id, e.user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AS is_flagged FROM events e"))
def _(s, d):
    qa = D.table(s, d, "customer").where("c_acctbal < 0")
    return R.flag_in(D.table(s, d, "events").select("event_id", "user_id"), "user_id", qa, "c_custkey", "is_flagged")


CAPABILITIES = ("gpt-image-2-5-flare:text-to-image", "kling-2:image-to-video", "sync-1:lipSync", "eleven:text-to-speech", "tool:upscale", "USER_TRIAL")


@query("prj_8_business_type", sql(f"""SELECT event_id, b AS business_type,
    CASE WHEN k % 6 = 0 THEN 'gpt-image-2-5' ELSE split_part(b, ':', 1) END AS model_id, nullif(split_part(b, ':', 2), '') AS generation_mode,
    CASE k % 6 WHEN 0 THEN 'image' WHEN 1 THEN 'video' WHEN 2 THEN 'video' WHEN 3 THEN 'audio' WHEN 4 THEN 'other' END AS media_type
    FROM (SELECT event_id, k, ({list(CAPABILITIES)!r})[k % 6 + 1] AS b FROM ev)"""))
def _(s, d):
    e = D.ev(s, d).select("event_id", D.pick(F.col("k") % 6, CAPABILITIES).alias("business_type"))
    return G.parse_business_type(e)


@query("prj_9_url_params", sql(r"""SELECT page_id, regexp_replace(url, '[?#].*$', '') AS clean_url, nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '') AS page_no,
    nullif(regexp_extract(url, '[?&]ref=([a-z]+)', 1), '') AS ref FROM pages"""))
def _(s, d):
    return D.table(s, d, "pages").select(
        "page_id", G.clean_url("url").alias("clean_url"), G.url_param("url", "page", "[0-9]+").alias("page_no"), G.url_param("url", "ref", "[a-z]+").alias("ref"),
    )


@query("prj_10_unpivot", sql("""SELECT p_partkey, 'brand' AS field, p_brand AS content FROM part WHERE p_size % 3 <> 0 UNION ALL
    SELECT p_partkey, 'kind', p_type FROM part UNION ALL SELECT p_partkey, 'name', p_name FROM part WHERE p_size % 2 = 0"""))
def _(s, d):
    p = D.table(s, d, "part").select(
        "p_partkey", F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).alias("brand"), F.col("p_type").alias("kind"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("name"),
    )
    return R.unpivot_keys(p, ["p_partkey"], ["brand", "kind", "name"], "field", "content")


EVENT_TYPES = ["signup", "view", "click", "purchase", "error"]


@query("prj_11_pivot", sql("SELECT user_id, " + ", ".join(f"max(CASE WHEN event_type = '{t}' THEN value END) AS {t}" for t in EVENT_TYPES) + " FROM events GROUP BY user_id"))
def _(s, d):
    return D.table(s, d, "events").groupBy("user_id").pivot("event_type", EVENT_TYPES).agg(F.max("value"))


BUCKETS = [("nation_1", "us"), ("nation_2", "tier1"), ("nation_3", "tier1"), ("US", "us")]


@query("prj_12_segment", sql("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'unknown' WHEN c_custkey % 7 = 1 THEN 'us' WHEN n_name = 'NATION_1' THEN 'us'
    WHEN n_name IN ('NATION_2', 'NATION_3') THEN 'tier1' ELSE 'rest' END AS country_bucket,
    CASE c_custkey % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'tablet' WHEN 2 THEN 'mobile' WHEN 3 THEN 'mobile' ELSE 'desktop' END AS device,
    CASE c_custkey % 6 WHEN 0 THEN 'google_cpc' WHEN 1 THEN 'meta_paid_social' WHEN 2 THEN 'tiktok_paid_social' WHEN 3 THEN 'affiliate' WHEN 4 THEN 'other_paid' ELSE 'organic' END AS channel
    FROM customer JOIN nation ON c_nationkey = n_nationkey"""))
def _(s, d):
    k = F.col("c_custkey")
    none = F.lit(None).cast("string")
    c = D.table(s, d, "customer").join(D.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.withColumn("country", F.when(k % 7 == 0, " ").when(k % 7 == 1, " us ").otherwise(F.col("n_name")))
    seed = D.seed_from(s, BUCKETS, "country_key string, seed_bucket string")
    c = c.withColumn("country_key", G.country_key(F.col("country"))).join(seed, "country_key", "left")
    touch = {n: none for n in ("gclid", "gbraid", "wbraid", "fbclid", "ttclid", "utm_medium", "utm_source", "ref", "tolt_referral")}
    touch["wbraid"] = F.when(k % 6 == 0, "w")
    touch["fbclid"] = F.when(k % 6 == 1, "f")
    touch["ttclid"] = F.when(k % 6 == 2, "t")
    touch["utm_source"] = F.when(k % 6 == 3, "Tolt")
    touch["utm_medium"] = F.when(k % 6 == 4, "Paid_Video")
    return c.select(
        "c_custkey", G.country_bucket(F.col("country"), F.col("seed_bucket")).alias("country_bucket"),
        G.device_class(
            F.when(k % 5 == 2, "iOS").when(k % 5 == 4, "Web").otherwise(none), F.when(k % 5 == 4, "Windows").otherwise(none),
            F.when(k % 5 == 1, "Apple iPad").when(k % 5 == 3, "Google Pixel 8").otherwise(none),
        ).alias("device"),
        G.first_touch_channel(touch).alias("channel"),
    )


@query("prj_13_fold", sql("SELECT c_custkey, CAST(('0x' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 4)) AS BIGINT) % 5 AS fold FROM customer"))
def _(s, d):
    return D.table(s, d, "customer").select("c_custkey", C.fold("c_custkey", 5).alias("fold"))


@query("prj_14_uniform", sql("SELECT o_orderkey, CAST(('0x' || substr(sha256('k:' || o_orderkey), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM orders"))
def _(s, d):
    return D.table(s, d, "orders").select("o_orderkey", C.uniform(F.concat(F.lit("k:"), F.col("o_orderkey").cast("string"))).alias("u"))


@query("prj_15_slice", sql("""SELECT CASE WHEN user_id % 10 <= 5 THEN 'holdout' ELSE 'bandit' END AS slice, count(*) AS n, CAST(0.6 AS DOUBLE) AS expected_holdout_share FROM events GROUP BY 1"""))
def _(s, d):
    e = D.table(s, d, "events").select(C.holdout_slice("user_id", "[0-5]$").alias("slice"))
    return e.groupBy("slice").agg(F.count(F.lit(1)).alias("n")).withColumn("expected_holdout_share", F.lit(C.pattern_share(6)))


@query("prj_17_event_ids", sql("""SELECT event_id AS id, 'reg_' || user_id AS signup_event, 'purchase_in_' || event_id AS purchase_event, 'sub_in_' || event_id AS order_id,
    'refund_ch_' || event_id || '_' || cents AS refund_event FROM ev"""))
def _(s, d):
    e = D.ev(s, d).withColumn("invoice", F.concat(F.lit("in_"), F.col("event_id").cast("string"))).withColumn("charge", F.concat(F.lit("ch_"), F.col("event_id").cast("string")))
    return e.select(
        F.col("event_id").alias("id"), G.event_id("signup", "user_id").alias("signup_event"), G.event_id("purchase", "invoice").alias("purchase_event"),
        G.event_id("order", "invoice").alias("order_id"), G.event_id("refund", "charge", "cents").alias("refund_event"),
    )


@query("prj_18_parse_ids", sql("""SELECT event_id, CASE k % 6 WHEN 0 THEN 'signup' WHEN 1 THEN 'purchase_event' WHEN 2 THEN 'purchase_order' WHEN 3 THEN 'unstable_fallback' ELSE 'unknown' END AS kind,
    CASE k % 6 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN 'in_' || event_id WHEN 2 THEN 'cs_live_' || event_id END AS ref FROM ev"""))
def _(s, d):
    e = F.col("event_id").cast("string")
    raw = D.ev(s, d).select("event_id", F.when(F.col("k") % 6 == 0, F.concat(F.lit("reg_"), F.col("user_id").cast("string")))
        .when(F.col("k") % 6 == 1, F.concat(F.lit("purchase_in_"), e)).when(F.col("k") % 6 == 2, F.concat(F.lit("sub_cs_live_"), e))
        .when(F.col("k") % 6 == 3, F.concat(F.lit("sub_pro_1_x"), e, F.lit("_1700000000000"))).when(F.col("k") % 6 == 4, F.concat(F.lit("purchase_"), e))
        .otherwise(e).alias("id"))
    kind, ref = G.parse_dedup_id("id")
    return raw.select("event_id", kind.alias("kind"), ref.alias("ref"))


@query("prj_22_history", sql("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-17'"))
def _(s, d):
    e = D.table(s, d, "events")
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-10 00:00:00", "2024-01-17 00:00:00"))
    return e.where((F.col("ts") >= lo) & (F.col("ts") < hi)).select("event_id", "ts")


# ---- fan-out ---------------------------------------------------------------

@query("exp_1_explode_json", sql("""SELECT event_id, 0 AS item_idx, k AS a FROM ev WHERE k % 5 <> 0 AND k % 7 <> 0 UNION ALL
    SELECT event_id, 1, k * 2 FROM ev WHERE k % 5 <> 0 AND k % 7 <> 0"""))
def _(s, d):
    item = lambda x: F.struct(x.cast("bigint").alias("a"))
    arr = F.when(F.col("k") % 7 == 0, F.lit(None)).when(F.col("k") % 5 == 0, F.lit("[]")).otherwise(F.to_json(F.array(item(F.col("k")), item(F.col("k") * 2))))
    return R.explode_json(D.ev(s, d).withColumn("j", arr), "j", "struct<a: long>", "item").select("event_id", "item_idx", F.col("item.a").alias("a"))


@query("exp_5_json_keys", sql("SELECT event_type, 'k' AS json_key, count(*) AS n FROM ev GROUP BY 1 UNION ALL SELECT event_type, 'extra', count(*) FROM ev WHERE k % 4 = 0 GROUP BY 1"))
def _(s, d):
    j = F.when(F.col("k") % 4 == 0, F.to_json(F.struct("k", F.col("cents").alias("extra")))).otherwise(F.col("props"))
    return D.ev(s, d).select("event_type", F.explode(F.json_object_keys(j)).alias("json_key")).groupBy("event_type", "json_key").agg(F.count(F.lit(1)).alias("n"))


@query("exp_6_embedding_positions", sql("""SELECT label, i - 1 AS position, sum(CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT)) AS micro_sum FROM
    (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2"""))
def _(s, d):
    e = D.table(s, d, "embeddings").select("label", F.posexplode("embedding").alias("position", "x"))
    return e.groupBy("label", "position").agg(F.sum(F.round(F.col("x").cast("double") * 1_000_000).cast("bigint")).alias("micro_sum"))


# ---- deduplication ---------------------------------------------------------

@query("ded_1_first_delivery", sql("""SELECT event_id, user_id, event_type, received_at FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY received_at) AS n
    FROM deliveries WHERE received_at <= TIMESTAMP '2024-01-20' AND k % 10 <> 0) WHERE n = 1"""))
def _(s, d):
    known = D.deliveries(s, d).where((F.col("received_at") <= F.lit(AS_OF)) & (F.col("k") % 10 != 0))
    return R.keep_first(known, ["event_id"], [F.col("received_at")]).select("event_id", "user_id", "event_type", "received_at")


@query("ded_2_one_per_object", sql("""SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM ev) WHERE n = 1"""))
def _(s, d):
    return R.keep_first(D.ev(s, d), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", "ts")


@query("ded_3_export_uuid", sql("SELECT event_id, min(received_at) AS server_upload_time FROM deliveries GROUP BY 1"))
def _(s, d):
    e = D.deliveries(s, d).withColumnRenamed("received_at", "server_upload_time")
    return R.keep_first(e, ["event_id"], [F.col("server_upload_time"), F.col("ts")]).select("event_id", "server_upload_time")


@query("ded_4_ledger_split", sql("""SELECT event_id, 'kept' AS route FROM ev WHERE k % 9 <> 0 UNION ALL SELECT event_id, 'quarantine' FROM deliveries WHERE k % 9 = 0"""))
def _(s, d):
    rows = D.deliveries(s, d).withColumn("owner", F.when(F.col("k") % 9 != 0, F.col("user_id")))
    kept = R.keep_first(rows.where("owner is not null"), ["event_id"], [F.col("received_at")])
    return kept.select("event_id", F.lit("kept").alias("route")).unionByName(rows.where("owner is null").select("event_id", F.lit("quarantine").alias("route")))


@query("ded_5_best_attempt", sql("""SELECT user_id, event_id, ts, ok, attempts FROM (SELECT user_id, event_id, ts, k % 3 = 0 AS ok, count(*) OVER (PARTITION BY user_id) AS attempts,
    row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END, ts) AS n FROM ev WHERE event_type = 'view') WHERE n = 1"""))
def _(s, d):
    a = D.ev(s, d).where("event_type = 'view'").withColumn("ok", F.col("k") % 3 == 0)
    best = R.keep_first_counted(a, ["user_id"], [F.when(F.col("ok"), 0).otherwise(1), F.col("ts"), F.col("event_id")], "attempts")
    return best.select("user_id", "event_id", "ts", "ok", "attempts")


@query("ded_6_refund_step_copies", sql("SELECT user_id, k AS cumulative, min(event_id) AS event_id FROM ev WHERE event_type = 'error' AND k > 0 GROUP BY 1, 2"))
def _(s, d):
    r = D.ev(s, d).where("event_type = 'error' and k > 0").withColumn("cumulative", F.col("k"))
    return R.keep_first(r, ["user_id", "cumulative"], [F.col("ts"), F.col("event_id")]).select("user_id", "cumulative", "event_id")


@query("ded_7_lowest_attempt", sql("SELECT event_id, 1 AS attempt FROM ev"))
def _(s, d):
    rows = D.ev(s, d).select("event_id", F.explode(F.array(F.lit(3), F.lit(1), F.lit(2))).alias("attempt"))
    return R.keep_first(rows, ["event_id"], [F.col("attempt")]).select("event_id", "attempt")


@query("ded_8_distinct_hits", sql("SELECT DISTINCT user_id, event_type, date_trunc('hour', ts) AS hour FROM ev"))
def _(s, d):
    return D.ev(s, d).withColumn("hour", F.date_trunc("hour", "ts")).dropDuplicates(["user_id", "event_type", "hour"]).select("user_id", "event_type", "hour")


@query("ded_9_ledger_first_row", sql("SELECT event_id, min(received_at) AS ingested_at FROM deliveries GROUP BY 1"))
def _(s, d):
    return R.keep_first(D.deliveries(s, d), ["event_id"], [F.col("received_at")]).select("event_id", F.col("received_at").alias("ingested_at"))


# ---- joins -----------------------------------------------------------------

@query("jn_1_equi_left", sql("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'"))
def _(s, d):
    o = D.table(s, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return D.table(s, d, "customer").join(o, "c_custkey", "left").select("c_custkey", "o_orderkey")


@query("jn_2_dimension_lookup", sql("SELECT n_name, r_name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"))
def _(s, d):
    dim = D.table(s, d, "nation").join(D.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return D.table(s, d, "supplier").join(dim, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("suppliers"))


@query("jn_3_asof_latest", sql("""SELECT p.event_id, c.click_id_value, c.click_id_created_at FROM purchase p ASOF LEFT JOIN click c
    ON p.user_id = c.user_id AND p.occurred_at >= c.click_id_created_at"""))
def _(s, d):
    out = latest(D.purchase(s, d), D.click(s, d), ["user_id"], "occurred_at", "click_id_created_at",
                 [F.col("click_id_created_at"), F.col("event_id")], ["click_id_value", "click_id_created_at"], block_rows=BLOCK_ROWS)
    return out.select("event_id", "click_id_value", "click_id_created_at")


@query("jn_4_asof_skew", sql("""SELECT p.event_id, t.device_id FROM purchase p ASOF LEFT JOIN device_events t
    ON p.user_id = t.user_id AND p.occurred_at + INTERVAL 300 SECOND >= t.event_time"""))
def _(s, d):
    p = D.purchase(s, d).withColumn("until", C.add_seconds("occurred_at", 300))
    out = latest(p, D.device_events(s, d), ["user_id"], "until", "event_time", [F.col("event_time"), F.col("device_id")], ["device_id"], block_rows=BLOCK_ROWS)
    return out.select("event_id", "device_id")


@query("jn_5_asof_per_key", sql("""SELECT event_id, click_id_key, click_id_value FROM (SELECT p.event_id, c.click_id_key, c.click_id_value,
    row_number() OVER (PARTITION BY p.event_id, c.click_id_key ORDER BY c.source_priority, c.click_id_created_at DESC, c.click_id_value) AS n
    FROM purchase p JOIN click c ON c.user_id = p.user_id AND c.click_id_created_at <= p.occurred_at + INTERVAL 300 SECOND) WHERE n = 1"""))
def _(s, d):
    from tidemark.plans.identity import best_clicks_at
    p = D.purchase(s, d).withColumn("until", C.add_seconds("occurred_at", 300)).select("event_id", "user_id", "until")
    wide = best_clicks_at(p, D.click(s, d), "until", "click_id_created_at", True, D.CLICK_KEYS)
    pairs = F.array(*[F.struct(F.lit(k).alias("click_id_key"), F.col(f"click_{k}.value").alias("click_id_value")) for k in D.CLICK_KEYS])
    return wide.select("event_id", F.explode(pairs).alias("x")).select("event_id", "x.*").where("click_id_value is not null")


@query("jn_6_asof_first_touch", sql("""SELECT event_id, utm_key, utm_value FROM (SELECT p.event_id, u.utm_key, u.utm_value,
    row_number() OVER (PARTITION BY p.event_id, u.utm_key ORDER BY u.source_priority, u.captured_at) AS n
    FROM purchase p JOIN utm u ON u.user_id = p.user_id AND u.captured_at <= p.occurred_at) WHERE n = 1"""))
def _(s, d):
    from tidemark.plans.identity import first_utms_at
    wide = first_utms_at(D.purchase(s, d).select("event_id", "user_id", "occurred_at"), D.utm(s, d), "occurred_at", "captured_at", True, D.UTM_KEYS)
    pairs = F.array(*[F.struct(F.lit(k).alias("utm_key"), F.col(k).alias("utm_value")) for k in D.UTM_KEYS])
    return wide.select("event_id", F.explode(pairs).alias("x")).select("event_id", "x.*").where("utm_value is not null")


@query("jn_7_previous_record", sql("""SELECT event_id, lag(plan_tier) OVER (PARTITION BY subscription_id ORDER BY occurred_at, event_id) AS previous_tier FROM purchase"""))
def _(s, d):
    prev = Agg("p", "max", F.struct(F.unix_micros("occurred_at").alias("t"), F.col("event_id").alias("i"), F.col("plan_tier").alias("tier")))
    return running(D.purchase(s, d), ["subscription_id"], "occurred_at", ["event_id"], [prev], block_rows=BLOCK_ROWS).select("event_id", F.col("p.tier").alias("previous_tier"))


@query("jn_8_validity_range", sql("""SELECT i.invoice_id, f.per_unit, f.digits FROM invoice i LEFT JOIN fx f ON f.currency = i.currency
    AND f.valid_from <= CAST(i.paid_at AS DATE) AND (f.valid_to IS NULL OR CAST(i.paid_at AS DATE) < f.valid_to)"""))
def _(s, d):
    from tidemark.plans.money import fx_ranges, value_at
    fx = fx_ranges(D.fx_seed(s), D.minor_units_seed(s), "USD")
    return value_at(D.invoice(s, d), fx, "paid_at").select("invoice_id", F.col("reporting_per_unit").alias("per_unit"), F.col("minor_unit_digits").alias("digits"))


@query("jn_9_range_overlap", sql("""SELECT a.series, count(*) AS n, min(greatest(a.f, b.f)) AS first_from, count(*) FILTER (WHERE a.t IS NULL AND b.t IS NULL) AS open_ends FROM
    (SELECT series, f, lead(f) OVER (PARTITION BY series ORDER BY f) AS t FROM (SELECT DISTINCT user_id AS series, CAST(ts AS DATE) AS f FROM ev WHERE event_type = 'purchase')) a JOIN
    (SELECT f, lead(f) OVER (ORDER BY f) AS t FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) + INTERVAL 8000 DAY AS f FROM orders) x) b
    ON (b.t IS NULL OR a.f < b.t) AND (a.t IS NULL OR b.f < a.t) GROUP BY 1"""))
def _(s, d):
    own = D.ev(s, d).where("event_type = 'purchase'").select(F.col("user_id").alias("series"), F.to_date("ts").alias("af")).distinct()
    base = D.table(s, d, "orders").select(F.lit("base").alias("base"), F.date_add(F.col("o_orderdate").cast("date"), 8000).alias("bf")).distinct()
    hits = R.overlaps(R.to_ranges(own, ["series"], "af", "at"), R.to_ranges(base, ["base"], "bf", "bt"), ("af", "at"), ("bf", "bt"))
    both_open = F.col("at").isNull() & F.col("bt").isNull()
    return hits.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.min(F.greatest("af", "bf")).cast("timestamp_ntz").alias("first_from"), F.sum(both_open.cast("long")).alias("open_ends"))


@query("jn_10_fixed_horizon", sql("""SELECT s.user_id, count(p.event_id) AS purchases, coalesce(sum(p.cash_minor), 0) AS cash_minor FROM signup s LEFT JOIN purchase p ON p.user_id = s.user_id
    AND p.occurred_at >= s.signup_at AND p.occurred_at < s.signup_at + INTERVAL 7 DAY GROUP BY 1"""))
def _(s, d):
    su = D.signup(s, d)
    p = D.purchase(s, d).join(su, "user_id").where((F.col("occurred_at") >= F.col("signup_at")) & (F.col("occurred_at") < C.add_seconds("signup_at", 7 * 86400)))
    sums = p.groupBy("user_id").agg(F.count(F.lit(1)).alias("purchases"), F.sum("cash_minor").alias("cash_minor"))
    return su.join(sums, "user_id", "left").select("user_id", F.coalesce("purchases", F.lit(0)).alias("purchases"), F.coalesce("cash_minor", F.lit(0)).alias("cash_minor"))


@query("jn_10b_overlapping_horizons", sql("""SELECT a.event_id, count(*) AS purchases_7d, sum(b.cash_minor) AS cash_7d FROM purchase a JOIN purchase b ON b.user_id = a.user_id
    AND b.occurred_at >= a.occurred_at AND b.occurred_at < a.occurred_at + INTERVAL 7 DAY GROUP BY 1"""))
def _(s, d):
    p = D.purchase(s, d)
    a = p.select("event_id", "user_id", "occurred_at", C.add_seconds("occurred_at", 7 * 86400).alias("horizon_end"))
    out = in_window(a, p, ["user_id"], "occurred_at", "horizon_end", "occurred_at", [Agg("purchases_7d", "count"), Agg("cash_7d", "sum", F.col("cash_minor"))])
    return out.select("event_id", "purchases_7d", "cash_7d")


@query("jn_11_chained_window", sql("""SELECT s.user_id, count(*) AS adjustments, sum(a.cash_minor) AS adjusted_minor FROM signup s JOIN purchase p ON p.user_id = s.user_id AND p.occurred_at >= s.signup_at
    AND p.occurred_at < s.signup_at + INTERVAL 7 DAY JOIN adjustment a ON a.adjusts_event_id = p.event_id AND a.occurred_at < s.signup_at + INTERVAL 7 DAY GROUP BY 1"""))
def _(s, d):
    end = C.add_seconds("signup_at", 7 * 86400)
    p = D.purchase(s, d).join(D.signup(s, d), "user_id").where((F.col("occurred_at") >= F.col("signup_at")) & (F.col("occurred_at") < end))
    w = p.select("user_id", F.col("event_id").alias("adjusts_event_id"), end.alias("horizon_end"))
    a = D.adjustment(s, d).drop("user_id").join(w, "adjusts_event_id").where(F.col("occurred_at") < F.col("horizon_end"))
    return a.groupBy("user_id").agg(F.count(F.lit(1)).alias("adjustments"), F.sum("cash_minor").alias("adjusted_minor"))


@query("jn_12_linkage", sql("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE WHEN l_partkey % 3 = 0 THEN 'payment_intent' WHEN l_partkey % 3 = 1 THEN 'charge' END AS link_path,
    CASE WHEN l_partkey % 3 < 2 THEN 'in_' || o_orderkey END AS invoice_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'"""))
def _(s, d):
    li = D.table(s, d, "lineitem").where("l_returnflag = 'R'")
    key = F.col("l_orderkey").cast("string")
    child = li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("pi_"), key)).alias("payment_intent_id"),
        F.when(F.col("l_partkey") % 3 < 2, F.concat(F.lit("ch_"), key)).alias("charge_id"),
    )
    o = D.table(s, d, "orders").select(F.concat(F.lit("in_"), F.col("o_orderkey").cast("string")).alias("invoice_id"), F.col("o_orderkey").cast("string").alias("ok"))
    by_intent = R.key_map([o.select(F.concat(F.lit("pi_"), "ok").alias("payment_intent_id"), "invoice_id")], "payment_intent_id", "invoice_id")
    by_charge = R.key_map([o.select(F.concat(F.lit("ch_"), "ok").alias("charge_id"), "invoice_id")], "charge_id", "invoice_id")
    out = R.link(child, [("payment_intent", "payment_intent_id", by_intent), ("charge", "charge_id", by_charge)], "invoice_id")
    return out.drop("payment_intent_id", "charge_id")


@query("jn_13_key_map", sql("""SELECT k AS key, CAST(min(event_id) AS VARCHAR) AS parent FROM (SELECT k, event_id, CASE event_type WHEN 'click' THEN 1 ELSE 2 END AS pr,
    min(CASE event_type WHEN 'click' THEN 1 ELSE 2 END) OVER (PARTITION BY k) AS best FROM ev WHERE event_type IN ('click', 'view')) WHERE pr = best GROUP BY 1"""))
def _(s, d):
    e = D.ev(s, d).select(F.col("k").alias("key"), F.col("event_id").alias("parent"), "event_type")
    m = R.key_map([e.where("event_type = 'click'"), e.where("event_type = 'view'")], "key", "parent")
    return m.select("key", F.col("parent").cast("string").alias("parent"))


RULES = [("r1", "purchase", None, 1), ("r2", "purchase", 0, 2), ("r3", None, 1, 3), ("r4", None, None, 4)]


@query("jn_14_wildcard", sql("""SELECT event_id, CASE WHEN event_type = 'purchase' AND user_id % 4 = 0 THEN 'r2' WHEN event_type = 'purchase' AND user_id % 4 = 1 THEN 'r1'
    WHEN user_id % 4 = 1 THEN 'r3' WHEN event_type = 'purchase' THEN 'r1' ELSE 'r4' END AS rule_id FROM ev"""))
def _(s, d):
    from tidemark.plans.usage_cost import wildcard_match
    rules = D.seed_from(s, RULES, "rule_id string, event_type string, bucket long, precedence int")
    e = D.ev(s, d).select("event_id", "event_type", (F.col("user_id") % 4).alias("bucket"))
    return wildcard_match(e, rules, ["event_type", "bucket"], "rule_id").select("event_id", "rule_id")


@query("jn_15_exact_match", sql("""SELECT e.event_id, max(p.p_partkey) FILTER (WHERE p.rn = 1) AS best_part, count(p.p_partkey) AS matches FROM ev e
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) p ON p.p_size = e.k GROUP BY 1"""))
def _(s, d):
    # the best price and the number of prices depend on the key alone, so they are found per key, not per event
    best = R.keep_first_counted(D.table(s, d, "part"), ["p_size"], [F.col("p_retailprice").desc(), F.col("p_partkey")], "matches")
    e = D.ev(s, d).select("event_id", F.col("k").alias("p_size"))
    return e.join(best, "p_size", "left").select("event_id", F.col("p_partkey").alias("best_part"), F.coalesce("matches", F.lit(0)).alias("matches"))


PLATFORMS = [{"platform": "google_ads", "window_days": 30}, {"platform": "meta", "window_days": 7}, {"platform": "tiktok", "window_days": 28}]


@query("jn_16_small_fan_out", sql("SELECT p.event_id, r.platform, r.w AS window_days FROM purchase p, (VALUES ('google_ads', 30), ('meta', 7), ('tiktok', 28)) r(platform, w)"))
def _(s, d):
    return D.purchase(s, d).select("event_id", F.explode(C.small_rows(PLATFORMS)).alias("r")).select("event_id", "r.*")


@query("jn_17_signed_up_before", sql("""SELECT w.week, count(*) AS users FROM (SELECT DISTINCT CAST(date_trunc('week', signup_at) AS DATE) AS week FROM signup) w
    JOIN signup s ON CAST(date_trunc('week', s.signup_at) AS DATE) < w.week GROUP BY 1"""))
def _(s, d):
    # counts per week first (a handful of rows), so the inequality never meets user rows
    weeks = D.signup(s, d).groupBy(C.week_start("signup_at").alias("week")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("week").rowsBetween(Window.unboundedPreceding, -1))
    return weeks.select("week", before.alias("users")).where("users is not null")


@query("jn_18_predecessors", sql("""SELECT a.event_id, count(b.event_id) AS previous_purchases, max(b.occurred_at) AS previous_at FROM purchase a LEFT JOIN purchase b ON b.user_id = a.user_id
    AND (b.occurred_at < a.occurred_at OR (b.occurred_at = a.occurred_at AND b.event_id < a.event_id)) GROUP BY 1"""))
def _(s, d):
    out = running(D.purchase(s, d), ["user_id"], "occurred_at", ["event_id"], [Agg("previous_purchases", "count"), Agg("previous_at", "max", F.col("occurred_at"))])
    return out.select("event_id", "previous_purchases", "previous_at")


@query("jn_19_anti", sql("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)"))
def _(s, d):
    big = D.table(s, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return R.anti(D.table(s, d, "customer"), big, ["c_custkey"]).select("c_custkey")


@query("jn_20_not_in", sql("SELECT event_id FROM ev WHERE k NOT IN (SELECT p_size FROM part WHERE p_size IS NOT NULL AND p_size % 2 = 0)"))
def _(s, d):
    sizes = D.table(s, d, "part").where("p_size is not null and p_size % 2 = 0").select(F.col("p_size").alias("k"))
    return R.anti(D.ev(s, d), sizes, ["k"]).select("event_id")


@query("jn_21_semi", sql("SELECT event_id FROM ev WHERE CAST(ts AS DATE) IN (SELECT CAST(ts AS DATE) FROM ev WHERE event_type = 'purchase' AND value > 150)"))
def _(s, d):
    e = D.ev(s, d).withColumn("day", F.to_date("ts"))
    return R.semi(e, e.where("event_type = 'purchase' and value > 150"), ["day"]).select("event_id")


@query("jn_23_refunds_before", sql("""SELECT c.event_id, coalesce(sum(-r.cash_minor), 0) AS refunded_before FROM adjustment c LEFT JOIN adjustment r ON r.adjusts_event_id = c.adjusts_event_id AND r.event_name = 'refund'
    AND r.occurred_at < c.occurred_at WHERE c.event_name = 'chargeback' GROUP BY 1"""))
def _(s, d):
    a = D.adjustment(s, d)
    out = lookup(a.where("event_name = 'chargeback'"), a.where("event_name = 'refund'"), ["adjusts_event_id"], "occurred_at", "occurred_at",
                 [Agg("refunded_before", "sum", -F.col("cash_minor"))], inclusive=False)
    return out.select("event_id", "refunded_before")


@query("jn_24_snapshot_diff", sql("""SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN a.c_custkey IS NULL THEN 'add' WHEN b.c_custkey IS NULL THEN 'remove'
    WHEN floor(a.v / 100.0) <> floor(b.v / 100.0) THEN 'update' ELSE 'unchanged' END AS action, a.v AS prev_value, b.v AS curr_value FROM
    (SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS v FROM customer WHERE c_custkey % 5 <> 0) a FULL JOIN
    (SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) + (c_custkey % 3) * 50 AS v FROM customer WHERE c_custkey % 7 <> 0) b ON a.c_custkey = b.c_custkey"""))
def _(s, d):
    c = D.table(s, d, "customer").withColumn("v", F.floor("c_acctbal").cast("bigint"))
    prev = c.where("c_custkey % 5 <> 0")
    curr = c.where("c_custkey % 7 <> 0").withColumn("v", F.col("v") + F.col("c_custkey") % 3 * 50)
    return R.snapshot_diff(prev, curr, ["c_custkey"], "v", lambda v: v.cast("bigint") - F.pmod(v, F.lit(100)))


@query("jn_25_entity_diff", sql("""SELECT p_partkey, 'changed' AS change, 'size' AS field, CAST(p_size AS VARCHAR) AS before, CAST(p_size + 1 AS VARCHAR) AS after FROM part WHERE p_size % 2 = 0 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0
    UNION ALL SELECT p_partkey, 'changed', 'brand', NULL, p_brand FROM part WHERE p_size % 3 = 0 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0
    UNION ALL SELECT p_partkey, 'removed', 'size', CAST(p_size AS VARCHAR), NULL FROM part WHERE p_partkey % 7 = 0 AND p_partkey % 5 <> 0
    UNION ALL SELECT p_partkey, 'added', 'size', NULL, CAST(CASE WHEN p_size % 2 = 0 THEN p_size + 1 ELSE p_size END AS VARCHAR) FROM part WHERE p_partkey % 5 = 0 AND p_partkey % 7 <> 0
    UNION ALL SELECT p_partkey, 'added', 'brand', NULL, p_brand FROM part WHERE p_partkey % 5 = 0 AND p_partkey % 7 <> 0 AND p_size % 3 = 0"""))
def _(s, d):
    p = D.table(s, d, "part")
    text = lambda c: c.cast("string")
    before = p.where("p_partkey % 5 <> 0").select("p_partkey", F.create_map(F.lit("size"), text(F.col("p_size"))).alias("f"))
    size = F.when(F.col("p_size") % 2 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))
    after = p.where("p_partkey % 7 <> 0").select("p_partkey", F.map_filter(
        F.create_map(F.lit("size"), text(size), F.lit("brand"), F.when(F.col("p_size") % 3 == 0, F.col("p_brand"))), lambda k, v: v.isNotNull()).alias("f"))
    return R.entity_diff(before, after, "p_partkey", "f")


# ---- aggregates ------------------------------------------------------------

@query("agg_1_grouped", sql("SELECT o_orderpriority, count(*) AS n, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1"))
def _(s, d):
    return D.table(s, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum(D.cents("o_totalprice")).alias("cents"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))


@query("agg_2_conditional", sql("""SELECT user_id, sum(CASE WHEN event_type = 'purchase' THEN cents ELSE 0 END) AS spent, count(*) FILTER (WHERE k > 50) AS high_k,
    avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END) AS purchase_share FROM ev GROUP BY 1"""))
def _(s, d):
    buy = F.col("event_type") == "purchase"
    return D.ev(s, d).groupBy("user_id").agg(C.sum_if(buy, F.col("cents")).alias("spent"), C.tally(F.col("k") > 50).alias("high_k"), F.avg(F.when(buy, 1.0).otherwise(0.0)).alias("purchase_share"))


@query("agg_3_distinct", sql("SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT CASE WHEN k > 50 THEN k END) AS high_ks FROM ev GROUP BY 1"))
def _(s, d):
    return D.ev(s, d).groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.countDistinct(F.when(F.col("k") > 50, F.col("k"))).alias("high_ks"))


@query("agg_4_boolean_any", sql("SELECT user_id, bool_or(k = 99) AS any_99, bool_or(event_type = 'error' AND k = 0) AS any_bad FROM ev GROUP BY 1"))
def _(s, d):
    return D.ev(s, d).groupBy("user_id").agg(F.bool_or(F.col("k") == 99).alias("any_99"), F.bool_or((F.col("event_type") == "error") & (F.col("k") == 0)).alias("any_bad"))


@query("agg_5_first_by", sql("""SELECT user_id, arg_min(k, ts) AS first_k, arg_min(k, ts) FILTER (WHERE event_type = 'purchase') AS first_purchase_k FROM ev GROUP BY 1"""))
def _(s, d):
    order = [F.col("ts"), F.col("event_id")]
    return D.ev(s, d).groupBy("user_id").agg(C.first_by(F.col("k"), order).alias("first_k"), C.first_by(F.col("k"), order, F.col("event_type") == "purchase").alias("first_purchase_k"))


@query("agg_6_any_value", sql("SELECT o_custkey, min(o_orderpriority) AS a_priority FROM orders GROUP BY 1"))
def _(s, d):
    # min stands for an arbitrary value: the same row count and cost, and repeatable
    return D.table(s, d, "orders").groupBy("o_custkey").agg(F.min("o_orderpriority").alias("a_priority"))


@query("agg_7_json_object", sql("""SELECT user_id, '{' || string_agg('"' || event_type || '":' || n, ',' ORDER BY event_type) || '}' AS counts FROM
    (SELECT user_id, event_type, count(*) AS n FROM ev GROUP BY 1, 2) GROUP BY 1"""))
def _(s, d):
    n = D.ev(s, d).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("user_id").agg(C.kv_json("event_type", F.col("n")).alias("counts"))


@query("agg_8_listagg", sql("SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS nations FROM nation GROUP BY 1"))
def _(s, d):
    D.table(s, d, "nation").createOrReplaceTempView("nation_rows")
    return s.sql("SELECT n_regionkey, listagg(n_name, '|') WITHIN GROUP (ORDER BY n_name) AS nations FROM nation_rows GROUP BY n_regionkey")


@query("agg_9_sample_sd", sql("""SELECT event_type, round(stddev_samp(cents), 6) AS sd, round(var_samp(cents), 3) AS var FROM ev GROUP BY 1"""))
def _(s, d):
    return D.ev(s, d).groupBy("event_type").agg(F.round(F.stddev_samp("cents"), 6).alias("sd"), F.round(F.var_samp("cents"), 3).alias("var"))


@query("agg_10_quantile", sql("SELECT event_type, quantile_cont(cents, 0.9) AS q90, quantile_cont(cents, 0.5) AS q50 FROM ev GROUP BY 1"))
def _(s, d):
    return R.quantiles(D.ev(s, d), ["event_type"], "cents", {"q90": 0.9, "q50": 0.5})


@query("agg_11_sufficient_statistics", sql("""SELECT event_type, count(*) AS n, sum(cents) AS s, sum(CAST(cents AS DOUBLE) * cents) AS q, sum(CAST(cents AS DOUBLE) * k) AS xy FROM ev GROUP BY 1"""))
def _(s, d):
    x = F.col("cents").cast("double")
    return D.ev(s, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("s"), F.sum(x * F.col("cents")).alias("q"), F.sum(x * F.col("k")).alias("xy"))


@query("agg_12_theta", sql("""SELECT event_type, round((avg(CAST(cents AS DOUBLE) * k) - avg(cents) * avg(k)) / (avg(CAST(k AS DOUBLE) * k) - avg(k) * avg(k)), 6) AS theta FROM ev WHERE user_id % 2 = 0 GROUP BY 1"""))
def _(s, d):
    y, x = F.col("cents").cast("double"), F.col("k").cast("double")
    return D.ev(s, d).where("user_id % 2 = 0").groupBy("event_type").agg(
        F.round(C.safe_divide(F.avg(y * x) - F.avg(y) * F.avg(x), F.avg(x * x) - F.avg(x) * F.avg(x)), 6).alias("theta"))


@query("agg_13_scalar", sql("SELECT event_id FROM ev WHERE cents > (SELECT avg(cents) FROM ev WHERE event_type = 'purchase')"))
def _(s, d):
    e = D.ev(s, d)
    return e.where(F.col("cents") > e.where("event_type = 'purchase'").agg(F.avg("cents")).scalar()).select("event_id")


@query("agg_14_content_ref", sql("SELECT sha256(string_agg(n_name || '=' || n_regionkey, '|' ORDER BY n_name)) AS content_ref FROM nation"))
def _(s, d):
    from tidemark.plans.scores_24h import content_ref
    rows = D.table(s, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("value"))
    return content_ref(rows)


@query("agg_15_having", sql("SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"))
def _(s, d):
    return D.table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


@query("agg_16_share_of_total", sql("""SELECT event_type, k, n, n / sum(n) OVER (PARTITION BY event_type) AS share FROM (SELECT event_type, k, count(*) AS n FROM ev GROUP BY 1, 2)"""))
def _(s, d):
    n = D.ev(s, d).groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", C.safe_divide("n", F.sum("n").over(Window.partitionBy("event_type"))))


@query("agg_17_weighted_average", sql("""SELECT event_type, sum(n * share) / sum(n) AS weighted_share FROM (SELECT event_type, user_id % 4 AS g, count(*) AS n, floor(CAST(count(*) FILTER (WHERE k < 50) AS DOUBLE) * 64 / count(*)) AS share
    FROM ev GROUP BY 1, 2) GROUP BY 1"""))
def _(s, d):
    g = D.ev(s, d).groupBy("event_type", (F.col("user_id") % 4).alias("g")).agg(F.count(F.lit(1)).alias("n"), F.floor(C.tally(F.col("k") < 50) * 64 / F.count(F.lit(1))).alias("share"))
    return g.groupBy("event_type").agg(C.safe_divide(F.sum(F.col("n") * F.col("share")), F.sum("n")).alias("weighted_share"))


# ---- windows ---------------------------------------------------------------

@query("win_1_latest_row", sql("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1"))
def _(s, d):
    return R.keep_first(D.table(s, d, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey")


@query("win_2_rank", sql("SELECT event_type, g, n, rank() OVER (PARTITION BY event_type ORDER BY n DESC) AS rank FROM (SELECT event_type, k % 20 AS g, count(*) // 10 AS n FROM ev GROUP BY 1, 2)"))
def _(s, d):
    a = D.ev(s, d).groupBy("event_type", (F.col("k") % 20).alias("g")).agg(F.floor(F.count(F.lit(1)) / 10).alias("n"))
    return a.withColumn("rank", F.rank().over(Window.partitionBy("event_type").orderBy(F.desc("n"))))


@query("win_3_percent_rank", sql("SELECT c_custkey, percent_rank() OVER (ORDER BY c_acctbal) AS pr FROM customer"))
def _(s, d):
    r = R.global_rank(D.table(s, d, "customer"), "c_acctbal")
    return r.select("c_custkey", F.coalesce(C.safe_divide(F.col("rank_min") - 1, F.col("total") - 1), F.lit(0.0)).alias("pr"))


@query("win_4_cumulative_steps", sql("""SELECT user_id, cum, cum - coalesce(lag(cum) OVER (PARTITION BY user_id ORDER BY cum), 0) AS step FROM (SELECT DISTINCT user_id, k AS cum FROM ev WHERE event_type = 'error' AND k > 0)"""))
def _(s, d):
    from tidemark.plans.billing import cumulative_steps
    c = D.ev(s, d).where("event_type = 'error' and k > 0").select("user_id", F.col("k").cast("bigint").alias("cum")).distinct()
    return cumulative_steps(c, ["user_id"], "cum", "step")


@query("win_5_change_points", sql("""SELECT user_id, device_id, event_time AS device_since FROM (SELECT *, lag(device_id) OVER (PARTITION BY user_id ORDER BY event_time, event_id) AS p FROM device_events) WHERE p IS NULL OR p <> device_id"""))
def _(s, d):
    from tidemark.plans.identity import device_timeline
    return device_timeline(D.device_events(s, d), "event_id").select("user_id", "device_id", "device_since")


@query("win_6_stage_changes", sql("""SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_stage, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 AS first_reach FROM ev"""))
def _(s, d):
    from tidemark.plans.ledger import stage_changes
    e = D.ev(s, d).select("event_id", F.col("user_id").alias("contact_id"), F.col("event_type").alias("lifecycle_stage"), F.col("ts").alias("occurred_at"))
    return stage_changes(e, "event_id").select("event_id", F.col("previous_lifecycle_stage").alias("previous_stage"), "first_reach")


@query("win_7_to_ranges", sql("""SELECT n_regionkey, day, lead(day) OVER (PARTITION BY n_regionkey ORDER BY day) AS day_end FROM (SELECT DISTINCT n_regionkey, CAST(o_orderdate AS DATE) AS day FROM orders
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""))
def _(s, d):
    c = D.table(s, d, "customer").join(D.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_regionkey")
    days = D.table(s, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("n_regionkey", F.col("o_orderdate").cast("date").alias("day")).distinct()
    return R.to_ranges(days, ["n_regionkey"], "day", "day_end")


@query("win_8_sum_before", sql("SELECT event_id, coalesce(sum(cash_minor) OVER (PARTITION BY user_id ORDER BY occurred_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_minor FROM purchase"))
def _(s, d):
    return running(D.purchase(s, d), ["user_id"], "occurred_at", ["event_id"], [Agg("before_minor", "sum", F.col("cash_minor"))], block_rows=BLOCK_ROWS).select("event_id", "before_minor")


@query("win_9_running_sum", sql("SELECT event_id, sum(cash_minor) OVER (PARTITION BY user_id ORDER BY occurred_at, event_id ROWS UNBOUNDED PRECEDING) AS running_minor FROM purchase"))
def _(s, d):
    return running(D.purchase(s, d), ["user_id"], "occurred_at", ["event_id"], [Agg("running_minor", "sum", F.col("cash_minor"))], include_current=True, block_rows=BLOCK_ROWS).select("event_id", "running_minor")


@query("win_10_partition_count", sql("SELECT event_id, count(*) OVER (PARTITION BY user_id) AS n FROM purchase"))
def _(s, d):
    p = D.purchase(s, d)
    return p.select("event_id", "user_id").join(p.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "user_id").select("event_id", "n")


@query("win_11_first_flag", sql("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY occurred_at, event_id) = 1 AS is_first FROM purchase"))
def _(s, d):
    from tidemark.plans.money import mark_first
    return mark_first(D.purchase(s, d), "user_id", ["occurred_at", "event_id"], "is_first").select("event_id", "is_first")


@query("win_12_total_over_groups", sql("SELECT currency, n, n / sum(n) OVER () AS share FROM (SELECT currency, count(*) AS n FROM invoice GROUP BY 1)"))
def _(s, d):
    n = D.invoice(s, d).groupBy("currency").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", C.safe_divide("n", n.agg(F.sum("n")).scalar()))


# ---- top-k and sets ----------------------------------------------------------

@query("top_1_per_group", sql("SELECT user_id, k AS top_k FROM (SELECT user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, k) AS n FROM ev GROUP BY user_id, k) WHERE n = 1"))
def _(s, d):
    n = D.ev(s, d).groupBy("user_id", "k").agg(F.count(F.lit(1)).alias("n"))
    return R.keep_first(n, ["user_id"], [F.desc("n"), F.col("k")]).select("user_id", F.col("k").alias("top_k"))


@query("top_2_recent_groups", sql("SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n FROM ev GROUP BY 1 ORDER BY 1 DESC LIMIT 3"))
def _(s, d):
    return D.ev(s, d).groupBy(C.week_start("ts").alias("week")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("week")).limit(3)


@query("top_3_top_fraction", sql("""SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= (SELECT min(c_acctbal) FROM (SELECT c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC) AS n FROM customer)
    WHERE n <= (SELECT (count(*) + 9) // 10 FROM customer))"""))
def _(s, d):
    return R.top_fraction(D.table(s, d, "customer"), "c_acctbal", 1, 10).select("c_custkey", "c_acctbal")


@query("top_4_order_limit", sql("SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_partkey LIMIT 25"))
def _(s, d):
    return D.table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_partkey").limit(25)


@query("set_1_union_by_name", sql("""SELECT event_id, event_name, user_id, cash_minor, plan_tier, NULL AS adjusts_event_id FROM purchase UNION ALL
    SELECT event_id, event_name, user_id, cash_minor, NULL, adjusts_event_id FROM adjustment"""))
def _(s, d):
    p = D.purchase(s, d).select("event_id", "event_name", "user_id", "cash_minor", "plan_tier")
    a = D.adjustment(s, d).select("event_id", "event_name", "user_id", "cash_minor", "adjusts_event_id")
    return p.unionByName(a, allowMissingColumns=True)


@query("set_2_union_distinct", sql("SELECT user_id FROM ev UNION SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer"))
def _(s, d):
    a = D.ev(s, d).select("user_id").distinct()
    b = D.table(s, d, "orders").select(F.col("o_custkey").alias("user_id")).distinct()
    return a.unionByName(b).unionByName(D.table(s, d, "customer").select(F.col("c_custkey").alias("user_id"))).distinct()


@query("set_3_distinct", sql("SELECT DISTINCT plan_tier, plan_tier_code FROM plan_catalog WHERE item_type = 'plan'"))
def _(s, d):
    return D.plan_catalog(s, d).where("item_type = 'plan'").select("plan_tier", "plan_tier_code").distinct()


# ---- scalar functions ----------------------------------------------------------

@query("fn_strings", sql(r"""SELECT c_custkey, sha256(c_name) AS h, CAST('0x' || substr(sha256(c_name), 1, 6) AS BIGINT) AS hex6, regexp_matches(c_name, '#0+1') AS has_1, nullif(split_part(c_name, '#', 2), '') AS part2,
    nullif(split_part(c_name, '#', 3), '') AS part3, regexp_replace(c_name, '0', '', 'g') AS stripped FROM customer"""))
def _(s, d):
    return D.table(s, d, "customer").select(
        "c_custkey", C.sha256_hex("c_name").alias("h"), C.hex_prefix_to_int(C.sha256_hex("c_name"), 6).alias("hex6"), F.col("c_name").rlike("#0+1").alias("has_1"),
        C.part_or_null("c_name", "#", 2).alias("part2"), C.part_or_null("c_name", "#", 3).alias("part3"), F.regexp_replace("c_name", "0", "").alias("stripped"))


@query("fn_numbers", sql("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, CASE WHEN l_discount <> 0 THEN l_tax / l_discount END AS ratio, greatest(l_tax, l_discount) AS hi, least(l_tax, l_discount) AS lo,
    round(ln(l_quantity), 9) AS lnq, round(exp(l_tax), 9) AS et, round(power(l_quantity, 2), 6) AS p2, round(sqrt(l_quantity), 9) AS sq, l_orderkey % 7 AS m7 FROM lineitem"""))
def _(s, d):
    t, q = F.col("l_tax"), F.col("l_quantity")
    return D.table(s, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", C.safe_divide("l_tax", "l_discount").alias("ratio"), C.greatest_of(t, F.col("l_discount"), 0).alias("hi"),
        C.least_of(t, F.col("l_discount"), 0).alias("lo"), F.round(F.log(q), 9).alias("lnq"), F.round(F.exp(t), 9).alias("et"), F.round(F.pow(q, F.lit(2)), 6).alias("p2"),
        F.round(F.sqrt(q), 9).alias("sq"), (F.col("l_orderkey") % 7).alias("m7"))


@query("fn_json", sql("""SELECT event_id, CAST(k AS BIGINT) AS k_int, 2 AS arr_len, k % 2 = 0 AS flag, 'x' || k AS hyphen FROM ev"""))
def _(s, d):
    j = F.to_json(F.struct(F.col("k").alias("k"), F.array("k", "cents").alias("arr"), (F.col("k") % 2 == 0).alias("f"), F.concat(F.lit("x"), F.col("k").cast("string")).alias("a-b")))
    e = D.ev(s, d).select("event_id", j.alias("j"))
    return e.select("event_id", C.json_int("j", "k").alias("k_int"), F.json_array_length(C.json_str("j", "arr")).alias("arr_len"), C.json_bool("j", "f").alias("flag"), C.json_str("j", "a-b").alias("hyphen"))


@query("fn_time", sql("""SELECT event_id, epoch_us(ts) // 1000000 AS unix_s, ts + INTERVAL 90 SECOND AS plus_90, epoch_us(ts) / 1000000.0::DOUBLE AS secs, CAST(timezone('America/Los_Angeles', timezone('UTC', ts)) AS DATE) AS la_date,
    CAST(date_trunc('month', ts) AS DATE) AS month, CAST(date_trunc('week', ts) AS DATE) AS week, CAST(ts AS DATE) + 5 AS d5, strftime(ts, '%Y%m%d') AS compact, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM ev"""))
def _(s, d):
    e = D.ev(s, d)
    return e.select(
        "event_id", F.unix_timestamp("ts").alias("unix_s"), C.add_seconds("ts", 90).alias("plus_90"), C.diff_seconds("ts", F.lit("1970-01-01").cast("timestamp")).alias("secs"),
        C.date_in_zone("ts", "America/Los_Angeles").alias("la_date"), C.month_start(F.to_date("ts")).alias("month"), C.week_start("ts").alias("week"),
        F.date_add(F.to_date("ts"), 5).alias("d5"), C.date_compact("ts").alias("compact"), C.iso_millis("ts").alias("iso"))


@query("fn_money_month", sql("""SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) / power(10, o_orderkey % 4) AS major, datediff('month', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS months FROM orders"""))
def _(s, d):
    o = D.table(s, d, "orders").withColumn("digits", F.col("o_orderkey") % 4).withColumn("minor", D.cents("o_totalprice"))
    return o.select("o_orderkey", C.minor_to_major("minor", "digits").alias("major"), C.month_diff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).alias("months"))

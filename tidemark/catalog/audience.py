"""Audience queries."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from tidemark.catalog.cte import add, sql
from tidemark.catalog.registry import query, shared
from tidemark.functions import columns as C
from tidemark.params import Params
from tidemark.plans import audiences as A
from tidemark.sinks.tables import stage
from tidemark.sources import driver_tables as D

REQUIRED = ("C3", "C5", "DE", "FR", "GB")
PLATFORMS = ("google_ads", "meta", "reddit")
P = dataclasses.replace(Params(), seed_min_profit=100.0, low_profit_threshold=500.0)


def scored(s, d):
    o = D.table(s, d, "orders")
    return o.select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").cast("timestamp").alias("occurred_at"), ((D.cents("o_totalprice") - 5_000_000) / 10_000).alias("predicted_profit"))


def money_out(s, d):
    o = D.table(s, d, "orders").where("o_orderkey % 40 < 3")
    return o.select(F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderkey") % 40 == 0, "chargeback").otherwise("refund").alias("event_name"), F.when(F.col("o_orderkey") % 80 == 0, "fraudulent").alias("dispute_reason"))


def mart(s, d):
    active = D.table(s, d, "orders").where("o_orderkey % 17 = 0").select(F.col("o_custkey").alias("user_id"))
    users = D.table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_nationkey") != 0, F.concat(F.lit("C"), F.col("c_nationkey").cast("string"))).alias("country_code"))
    regions = D.seed_from(s, [("C3",), ("C5",)], "iso2 string")
    return A.candidates(scored(s, d), money_out(s, d), active, users, regions, P)


add("aud_first", "SELECT user_id, profit FROM (SELECT o_custkey AS user_id, (CAST(round(o_totalprice * 100) AS BIGINT) - 5000000) / 10000.0::DOUBLE AS profit, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
add("aud_out", "SELECT o_custkey AS user_id, bool_or(o_orderkey % 40 <> 0) AS refund, bool_or(o_orderkey % 40 = 0) AS cb, bool_or(o_orderkey % 80 = 0) AS fraud FROM orders WHERE o_orderkey % 40 < 3 GROUP BY 1")
add("aud_user", """SELECT f.*, percent_rank() OVER (ORDER BY profit) AS pr, coalesce(o.refund, false) AS refund, coalesce(o.cb, false) AS cb, coalesce(o.fraud, false) AS fraud, EXISTS (SELECT 1 FROM orders a WHERE a.o_custkey = f.user_id AND a.o_orderkey % 17 = 0) AS active,
    CASE WHEN c_nationkey <> 0 THEN 'C' || c_nationkey END AS cc FROM aud_first f LEFT JOIN aud_out o USING (user_id) LEFT JOIN customer ON c_custkey = f.user_id""")


@query("aud_1_candidates", sql("""SELECT user_id, list_name, reason, round(profit, 6) AS predicted_profit, round(pr, 6) AS percentile, cc IS NOT NULL AND cc NOT IN ('C3', 'C5') AS upload_allowed, CASE WHEN cc IS NULL THEN 'region_unknown' WHEN cc IN ('C3', 'C5') THEN 'consent_required_region_without_consent' END AS upload_block_reason FROM (
    SELECT *, 'oa_high_predicted_profit_90d' AS list_name, 'high_predicted_profit' AS reason FROM aud_user WHERE pr >= 1 - 0.2::DOUBLE AND profit >= 100 AND NOT (refund OR cb OR fraud) UNION ALL SELECT *, 'oa_paying_customers_suppress', 'paying_customer_suppression' FROM aud_user WHERE active
    UNION ALL SELECT *, 'oa_refund_or_chargeback_suppress', 'refund_or_chargeback_suppression' FROM aud_user WHERE refund OR cb OR fraud UNION ALL SELECT *, 'oa_low_predicted_profit_suppress', CASE WHEN profit < 0 THEN 'negative_predicted_profit_suppression' ELSE 'low_predicted_profit_suppression' END FROM aud_user WHERE profit < 500)"""))
def _(s, d):
    return mart(s, d).select("user_id", "list_name", "reason", "predicted_profit", "percentile", "upload_allowed", "upload_block_reason")


def people(s, d):
    k = F.col("c_custkey")
    c = D.table(s, d, "customer")
    state = lambda m, off: D.pick((k + off) % m, ("granted", "unknown", "denied", "granted", "unknown", "granted", "unknown")[:m])
    email = F.when(k % 11 == 0, "not-an-address").otherwise(F.concat(F.lit(" User."), ((k - k % 2) / 2).cast("int").cast("string"), F.lit("+tag@"), D.pick(k % 3, ("Gmail.com", "example.org", "mail.test")), F.lit(" ")))
    return c.select(
        k.alias("user_id"), email.alias("email"), F.when(k % 3 == 0, F.concat(F.lit("+1 (415) 555-"), F.lpad((k % 10000).cast("string"), 4, "0"))).when(k % 3 == 1, "0123").alias("phone"), F.col("c_acctbal").alias("predicted_profit"),
        D.pick(k % 5, ("US", "DE", "xx", "gb-eng", "JP")).alias("region"), D.pick(k % 4, ("US", "FR", "", "BR")).alias("country"), F.when(k % 2 == 0, "cmp").otherwise("none").alias("consent_source"),
        F.lit("unknown").alias("ad_storage"), state(7, 0).alias("ad_user_data"), state(4, 1).alias("ad_personalization"), F.lit("unknown").alias("analytics_storage"), F.when(k % 23 == 0, True).alias("gpc"), F.lit(None).cast("boolean").alias("opt_out_sale_sharing"),
        (k % 13 == 0).alias("is_active_subscriber"), (k % 29 == 0).alias("is_fraud"), (k % 19 == 0).alias("has_chargeback"), (k % 14 == 0).alias("has_refund"))


add("people", """SELECT *, CASE WHEN c_custkey % 23 = 0 THEN 'opted_out_gpc_or_sale_sharing' WHEN aud = 'denied' OR adp = 'denied' THEN 'explicit_denial' WHEN NOT (unk OR req) THEN 'default_eligible' WHEN c_custkey % 2 = 0 AND aud = 'granted' AND adp = 'granted' THEN 'granted' WHEN unk THEN 'unknown_region_needs_cmp_grant' ELSE 'consent_required_needs_cmp_grant' END AS reason FROM (
    SELECT *, (['granted', 'unknown', 'denied', 'granted', 'unknown', 'granted', 'unknown'])[c_custkey % 7 + 1] AS aud, (['granted', 'unknown', 'denied', 'granted'])[(c_custkey + 1) % 4 + 1] AS adp, c_custkey % 5 = 2 AND c_custkey % 4 = 2 AS unk, c_custkey % 5 IN (1, 3) OR c_custkey % 4 = 1 AS req FROM customer)""")


@query("aud_3_consent_gate", sql("SELECT c_custkey AS user_id, reason AS consent_reason, reason IN ('default_eligible', 'granted') AS eligible FROM people"))
def _(s, d):
    return A.consent_gate(people(s, d), REQUIRED).select("user_id", "consent_reason", "eligible")


@shared
def selection(s, d):
    return stage(A.select_audiences(people(s, d), REQUIRED))


add("sel", """SELECT c_custkey AS user_id, list_name, c_acctbal AS profit FROM (SELECT *, c_custkey % 29 = 0 OR c_custkey % 19 = 0 OR c_custkey % 14 = 0 AS tainted FROM people WHERE reason IN ('default_eligible', 'granted')), LATERAL (SELECT unnest([
    CASE WHEN c_acctbal > 0 AND NOT tainted AND c_acctbal >= (SELECT min(c_acctbal) FROM (SELECT c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC) AS n FROM customer) WHERE n <= (SELECT (count(*) + 9) // 10 FROM customer)) THEN 'oa_seed_top_decile_predicted_profit' END,
    CASE WHEN c_acctbal > 0 AND NOT tainted THEN 'oa_seed_positive_predicted_profit' END, CASE WHEN c_custkey % 13 = 0 THEN 'oa_excl_active_subscribers' END, CASE WHEN c_custkey % 29 = 0 OR c_custkey % 19 = 0 THEN 'oa_excl_fraud_or_chargeback' END,
    CASE WHEN c_custkey % 14 = 0 THEN 'oa_excl_refunded' END, CASE WHEN c_acctbal < 0 THEN 'oa_excl_low_predicted_profit' END]) AS list_name) WHERE list_name IS NOT NULL""")


@query("aud_2_selection", sql("SELECT user_id, list_name FROM sel"))
def _(s, d):
    return selection(s, d).select("user_id", "list_name")


add("ident", """SELECT c_custkey AS user_id, platform, CASE WHEN c_custkey % 11 <> 0 THEN sha256(CASE WHEN platform = 'reddit' OR (platform = 'google_ads' AND c_custkey % 3 = 0) THEN 'user' || (c_custkey // 2) ELSE 'user.' || (c_custkey // 2) || '+tag' END || '@' || (['gmail.com', 'example.org', 'mail.test'])[c_custkey % 3 + 1]) END AS email_sha256,
    CASE WHEN c_custkey % 3 = 0 THEN sha256(CASE WHEN platform = 'meta' THEN '' ELSE '+' END || '1415555' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')) END AS phone_sha256, CASE WHEN platform = 'meta' THEN sha256(CAST(c_custkey AS VARCHAR)) END AS external_id_sha256
    FROM customer, (VALUES ('google_ads'), ('meta'), ('reddit')) p(platform)""")


@query("aud_4_hash_identifiers", sql("SELECT * FROM ident"))
def _(s, d):
    return A.hash_identifiers(people(s, d).select("user_id", "email", "phone"), PLATFORMS).select("user_id", "platform", "email_sha256", "phone_sha256", "external_id_sha256")


@query("aud_4b_hash_documents", sql("SELECT doc_id, sha256(lower(trim(text))) AS h FROM documents WHERE trim(text) <> ''"))
def _(s, d):
    # the string rules over whole document texts
    return D.table(s, d, "documents").where("trim(text) <> ''").select("doc_id", F.sha2(F.lower(F.trim("text")), 256).alias("h"))


add("mem", """SELECT platform, list_name, key, min(user_id) AS user_id, count(*) AS copies, arg_min(profit, user_id) AS profit FROM (SELECT i.*, s.list_name, s.profit, CASE WHEN coalesce(email_sha256, phone_sha256, external_id_sha256) IS NOT NULL THEN concat_ws('|', coalesce(email_sha256, '-'), coalesce(phone_sha256, '-'), coalesce(external_id_sha256, '-')) END AS key
    FROM sel s JOIN ident i USING (user_id)) WHERE key IS NOT NULL GROUP BY 1, 2, 3""")


@query("aud_5_members", sql("SELECT platform, list_name, key AS member_key, user_id, copies, CASE WHEN list_name LIKE 'oa_seed%' THEN floor(greatest(profit, 0) * 100 + 0.5) / 100 END AS value FROM mem"))
def _(s, d):
    return A.members(selection(s, d), PLATFORMS).select("platform", "list_name", "member_key", "user_id", "copies", "value")


@query("aud_5b_member_counts", sql("""SELECT t.platform, t.list_name, t.selected, coalesce(m.members, 0) AS members, coalesce(m.dup, 0) AS duplicates, t.selected - coalesce(m.members, 0) - coalesce(m.dup, 0) AS skipped_no_identifier FROM (SELECT platform, list_name, count(*) AS selected FROM sel, (VALUES ('google_ads'), ('meta'), ('reddit')) p(platform) GROUP BY 1, 2) t
    LEFT JOIN (SELECT platform, list_name, count(*) AS members, sum(copies - 1) AS dup FROM mem GROUP BY 1, 2) m USING (platform, list_name)"""))
def _(s, d):
    return A.member_counts(selection(s, d), PLATFORMS)


@shared
def changes(s, d):
    """Two versions of the member table: the earlier one lacks some users and holds others at older values."""
    now = A.members(selection(s, d), PLATFORMS)
    prev = now.where("user_id % 5 <> 0").withColumn("value", F.col("value") * F.when(F.col("user_id") % 3 == 0, 2.0).otherwise(1.0))
    curr = now.where("user_id % 7 <> 0")
    dropped = D.table(s, d, "customer").where("c_custkey % 14 = 0").select(F.col("c_custkey").alias("user_id"))
    cands = D.table(s, d, "customer").where("c_custkey % 21 <> 0").select(F.col("c_custkey").alias("user_id"))
    return stage(A.audience_diff(prev, curr, dropped, cands, ["oa_seed_positive_predicted_profit"]))


add("memv", "SELECT *, CASE WHEN list_name LIKE 'oa_seed%' THEN floor(greatest(profit, 0) * 100 + 0.5) / 100 END AS value FROM mem")
add("bucketed", """SELECT *, CASE WHEN user_id % 5 = 0 THEN 'add' WHEN user_id % 7 = 0 THEN 'remove' WHEN list_name = 'oa_seed_positive_predicted_profit' AND user_id % 3 = 0 AND value > 0 AND
    (CASE WHEN value < 1 THEN '<1' ELSE CAST(CAST(floor(ln(value) / ln(1.2::DOUBLE) + 1e-9) AS BIGINT) AS VARCHAR) END) <> (CASE WHEN value * 2 < 1 THEN '<1' ELSE CAST(CAST(floor(ln(value * 2) / ln(1.2::DOUBLE) + 1e-9) AS BIGINT) AS VARCHAR) END) THEN 'update' ELSE 'unchanged' END AS action FROM memv WHERE NOT (user_id % 5 = 0 AND user_id % 7 = 0)""")


@query("aud_6_diff", sql("""SELECT platform, list_name, key AS member_key, user_id, action, CASE action WHEN 'remove' THEN CASE WHEN user_id % 14 = 0 THEN 'consent_withdrawn' WHEN user_id % 21 = 0 THEN 'no_longer_a_candidate' ELSE 'no_longer_qualifies' END WHEN 'update' THEN 'value_changed' END AS change_reason FROM bucketed"""))
def _(s, d):
    return changes(s, d).select("platform", "list_name", "member_key", "user_id", "action", "change_reason")


@query("aud_7_plan_summary", sql("""SELECT *, adds + updates + unchanged < 10 AS held, CASE WHEN adds + updates + unchanged < 10 THEN 0 ELSE adds END AS sent_adds, CASE WHEN adds + updates + unchanged < 10 THEN 0 ELSE updates END AS sent_updates FROM (SELECT platform, list_name, count(*) FILTER (WHERE action = 'add') AS adds,
    count(*) FILTER (WHERE action = 'remove') AS removes, count(*) FILTER (WHERE action = 'update') AS updates, count(*) FILTER (WHERE action = 'unchanged') AS unchanged, count(*) FILTER (WHERE action = 'remove' AND user_id % 14 = 0) AS withdrawn FROM bucketed GROUP BY 1, 2)"""))
def _(s, d):
    return A.plan_summary(changes(s, d), 10)


@query("aud_7b_next_snapshot", sql("""SELECT platform, list_name, count(*) AS members FROM (SELECT *, count(*) FILTER (WHERE action <> 'remove') OVER (PARTITION BY platform, list_name) < 10 AS held FROM bucketed) WHERE action <> 'remove' AND NOT (held AND action = 'add') GROUP BY 1, 2"""))
def _(s, d):
    return A.next_snapshot(changes(s, d), 10).groupBy("platform", "list_name").agg(F.count(F.lit(1)).alias("members"))


@query("aud_8_from_lists", sql("""SELECT user_id, lists, country_code, contact FROM (SELECT o_custkey AS user_id, count(*) AS lists, min(CASE WHEN o_custkey % 10 = 0 THEN 'c' || (o_orderkey % 2) ELSE 'c' END) AS country_code, count(DISTINCT CASE WHEN o_custkey % 10 = 0 THEN 'c' || (o_orderkey % 2) ELSE 'c' END) AS n, bool_and(o_orderkey % 50 <> 0) AS ok
    FROM orders GROUP BY 1) LEFT JOIN (SELECT c_custkey, c_name AS contact FROM customer WHERE c_custkey % 4 <> 0) ON c_custkey = user_id WHERE n = 1 AND ok"""))
def _(s, d):
    o = D.table(s, d, "orders").select(F.col("o_custkey").alias("user_id"), F.when(F.col("o_custkey") % 10 == 0, F.concat(F.lit("c"), (F.col("o_orderkey") % 2).cast("string"))).otherwise("c").alias("country_code"), (F.col("o_orderkey") % 50 != 0).alias("upload_allowed"))
    contacts = D.table(s, d, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("contact"))
    users, _clash = A.candidates_from_lists(o, contacts, ["country_code"])
    return users.select("user_id", "lists", "country_code", "contact")

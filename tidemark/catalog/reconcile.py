"""Reconciliation and quarantine queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import money as MO
from tidemark.catalog.cte import add, sql
from tidemark.catalog.registry import query, shared
from tidemark.plans import billing as B
from tidemark.plans import reconciliation as R
from tidemark.sinks.tables import stage
from tidemark.sources import driver_tables as D

RULES = [
    {"platform": "google_ads", "scope": "every_subscription_checkout", "value_rule": "invoice_amount", "events_per_purchase": 2, "accepts_fallback_value": False, "click_window_days": 3, "date_basis": "click", "account_timezone": "America/Los_Angeles"},
    {"platform": "meta", "scope": "first_valid_purchase", "value_rule": "ltv_else_amount", "events_per_purchase": 1, "accepts_fallback_value": True, "click_window_days": 1, "date_basis": "conversion", "account_timezone": "Asia/Tokyo"},
    {"platform": "tiktok", "scope": "every_subscription_checkout", "value_rule": "none", "events_per_purchase": 1, "accepts_fallback_value": True, "click_window_days": 7, "date_basis": "conversion", "account_timezone": "UTC"},
]
FALLBACK = [(t, i, 16.0 * (n + 1)) for n, t in enumerate(D.TIERS) for i in ("month", "year")]


def attempts(s, d):
    """One or two lookups per purchase; the first of a pair fails."""
    p = D.purchase(s, d).where("k % 4 <> 1")
    pair = F.explode(F.when(F.col("k") % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("i")
    x = p.select("*", pair)
    good = (F.col("i") == 1) | (F.col("k") % 3 == 0)
    return x.select("user_id", F.concat(F.lit("cs_"), "event_id").alias("checkout_session_id"), F.timestamp_micros(F.unix_micros("occurred_at") + F.col("i") * 1_000_000).alias("requested_at"), F.when(good, 200).otherwise(500).alias("http_status"),
                    F.struct(good.alias("isValidInvoice"), F.when(good & (F.col("k") % 5 == 0), (F.col("k") + 1).cast("double") * 4).alias("ltvValueMajor"), F.lit("usd").alias("ltvCurrency")).alias("response"))


add("answers", """SELECT 'cs_' || event_id AS checkout_session_id, user_id, CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END AS attempts, k % 2 = 0 OR k % 3 = 0 AS lookup_ok, CASE WHEN k % 5 = 0 AND (k % 2 = 0 OR k % 3 = 0) THEN (k + 1)::DOUBLE * 4 END AS ltv FROM purchase WHERE k % 4 <> 1""")


@query("rec_7_lookups", sql("SELECT checkout_session_id, user_id, attempts, lookup_ok, ltv AS ltv_value FROM answers"))
def _(s, d):
    return R.lookups(attempts(s, d)).select("checkout_session_id", "user_id", "attempts", "lookup_ok", "ltv_value")


def facts(s, d):
    p = D.purchase(s, d).select("event_id", "event_name", "user_id", "occurred_at", (F.col("cash_minor") / 100).alias("gross_usd"), (F.col("k") % 2 == 0).alias("is_first_purchase"), F.concat(F.lit("cs_"), "event_id").alias("checkout_session_id"), "plan_tier", "billing_interval")
    a = D.adjustment(s, d).select("adjusts_event_id", (-F.col("cash_minor") / 100).alias("out_usd"))
    kinds = {"gclid": "google_ads", "fbclid": "meta", "ttclid": "tiktok"}
    c = D.click(s, d).where(F.col("click_id_key").isin(*kinds)).select("user_id", F.when(F.col("click_id_key") == "gclid", "google_ads").when(F.col("click_id_key") == "fbclid", "meta").otherwise("tiktok").alias("platform"), F.col("click_id_created_at").alias("clicked_at"))
    users = D.ev(s, d).select("user_id").distinct().withColumn("has_amplitude_events", F.col("user_id") % 7 != 0)
    fb = D.seed_from(s, FALLBACK, "plan_tier string, billing_interval string, fallback_value double")
    return R.recon_facts(p, a, c, users, R.lookups(attempts(s, d)), fb, RULES)


@shared
def staged_facts(s, d):
    return stage(facts(s, d))


def _local(t, zone):
    return f"CAST(date_trunc('month', timezone({zone}, timezone('UTC', {t}))) AS DATE)"


add("rules", "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v).lower() for v in r.values()) + ")" for r in RULES) + ") t(platform, scope, value_rule, epp, accepts, wd, basis, tz)")
add("pclick", """SELECT p.event_id, q.platform, max(c.click_id_created_at) AS click_at FROM purchase p JOIN click c ON c.user_id = p.user_id AND c.click_id_created_at <= p.occurred_at JOIN click_platforms q USING (click_id_key) WHERE q.platform <> 'microsoft_ads' GROUP BY 1, 2""")
add("rfact", f"""SELECT p.event_id, r.platform, r.value_rule, r.epp, p.cash_minor / 100.0::DOUBLE AS gross, p.cash_minor / 100.0::DOUBLE - coalesce((SELECT sum(-cash_minor) FROM adjustment a WHERE a.adjusts_event_id = p.event_id) / 100.0::DOUBLE, 0) AS net,
    p.event_name = 'purchase_first' AND (r.scope = 'every_subscription_checkout' OR p.k % 2 = 0) AS in_scope, p.user_id % 7 <> 0 AS can_send, coalesce(l.lookup_ok, true) OR r.accepts AS delivered,
    CASE r.value_rule WHEN 'invoice_amount' THEN p.cash_minor / 100.0::DOUBLE WHEN 'ltv_else_amount' THEN coalesce(l.ltv, p.cash_minor / 100.0::DOUBLE) ELSE 0 END AS rule_value,
    CASE WHEN coalesce(l.lookup_ok, true) THEN CASE r.value_rule WHEN 'invoice_amount' THEN p.cash_minor / 100.0::DOUBLE WHEN 'ltv_else_amount' THEN coalesce(l.ltv, p.cash_minor / 100.0::DOUBLE) ELSE 0 END
      WHEN r.accepts THEN CASE WHEN r.value_rule = 'none' THEN 0 ELSE coalesce(CASE p.plan_tier WHEN 'essential' THEN 16 WHEN 'advanced' THEN 32 WHEN 'infinite' THEN 48 WHEN 'wonder' THEN 64 END, 0) END ELSE 0 END AS sent_value,
    c.click_at IS NOT NULL AS attributed, coalesce(p.occurred_at - c.click_at <= to_days(r.wd::INT), false) AS near, CAST(date_trunc('month', p.occurred_at) AS DATE) AS mu, {_local('p.occurred_at', 'r.tz')} AS ma,
    CASE WHEN r.basis = 'click' AND c.click_at IS NOT NULL THEN {_local('c.click_at', 'r.tz')} ELSE {_local('p.occurred_at', 'r.tz')} END AS mr
    FROM purchase p, rules r LEFT JOIN answers l ON l.checkout_session_id = 'cs_' || p.event_id LEFT JOIN pclick c ON c.event_id = p.event_id AND c.platform = r.platform""")


@query("rec_1_facts", sql("SELECT event_id, platform, round(gross, 2) AS gross_usd, round(net, 2) AS net_usd, in_scope, can_send AS browser_can_send, delivered, round(rule_value, 2) AS rule_value, round(sent_value, 2) AS sent_value, attributed, near AS within_window, mu AS month_utc, ma AS month_account, mr AS month_report FROM rfact"))
def _(s, d):
    return staged_facts(s, d).select("event_id", "platform", F.round("gross_usd", 2).alias("gross_usd"), F.round("net_usd", 2).alias("net_usd"), "in_scope", "browser_can_send", "delivered", "rule_value", "sent_value", "attributed", "within_window", "month_utc", "month_account", "month_report")


def truth(s, d):
    return R.billing_truth(D.invoice_full(s, d), D.session(s, d), D.payment(s, d), B.refund_steps(D.refund_event(s, d)), B.dispute_lifecycle(D.dispute_event(s, d)), MO.fx(s))


add("intent", "SELECT DISTINCT payment_intent_id, purchase_key FROM (SELECT payment_intent_id, invoice_id AS purchase_key FROM payment UNION ALL SELECT payment_intent_id, coalesce(invoice_id, checkout_session_id) FROM session WHERE checkout_mode = 'payment')")
add("tin", """SELECT invoice_id AS purchase_key, user_id, paid_at AS at2, amount_paid_minor AS cash, currency FROM invoice_full i WHERE amount_paid_minor > 0 AND NOT EXISTS (SELECT 1 FROM session s WHERE s.checkout_mode = 'payment' AND s.invoice_id = i.invoice_id)
    UNION ALL SELECT coalesce(invoice_id, checkout_session_id), user_id, completed_at, amount_total_minor, currency FROM session WHERE checkout_mode = 'payment'""")
add("tout", """SELECT k.purchase_key, r.refunded_at AS at2, r.step AS out FROM refund_step r JOIN intent k USING (payment_intent_id) UNION ALL
    SELECT k.purchase_key, x.disputed_at, least(x.amount_minor, greatest(t.cash - coalesce((SELECT sum(r.step) FROM refund_step r JOIN intent k2 USING (payment_intent_id) WHERE k2.purchase_key = k.purchase_key AND r.refunded_at < x.disputed_at), 0), 0))
    FROM dispute x JOIN intent k USING (payment_intent_id) JOIN tin t ON t.purchase_key = k.purchase_key WHERE x.is_money_lost""")


@query("rec_2_billing_truth", sql("""SELECT t.purchase_key, t.user_id, t.cash AS cash_minor, t.cash - coalesce(o.out, 0) AS net_minor FROM tin t LEFT JOIN (SELECT purchase_key, sum(out) AS out FROM tout GROUP BY 1) o USING (purchase_key)"""))
def _(s, d):
    return truth(s, d).select("purchase_key", "user_id", F.col("cash").alias("cash_minor"), "net_minor")


def wide(s, d):
    f = staged_facts(s, d)
    t = D.purchase(s, d).select(F.col("occurred_at").alias("purchased_at"), (F.col("cash_minor") / 100).alias("net_usd"))
    return R.recon_wide(f, t, R.expected_reports(f), RULES)


add("rsum", """SELECT platform, 'u' AS base, mu AS m, sum(net) AS net, sum(gross) AS gross, sum(CASE WHEN in_scope THEN gross ELSE 0 END) AS scope_v, count(*) FILTER (WHERE in_scope AND can_send) AS sent_n, sum(CASE WHEN in_scope AND can_send AND delivered THEN round(sent_value, 2) * epp ELSE 0 END) AS dv, sum(CASE WHEN in_scope AND can_send AND delivered THEN epp ELSE 0 END) AS dn FROM rfact GROUP BY 1, 3
    UNION ALL SELECT platform, 'a', ma, 0, 0, 0, 0, sum(CASE WHEN in_scope AND can_send AND delivered THEN round(sent_value, 2) * epp ELSE 0 END), sum(CASE WHEN in_scope AND can_send AND delivered THEN epp ELSE 0 END) FROM rfact GROUP BY 1, 3
    UNION ALL SELECT platform, 'r', mr, 0, 0, 0, 0, sum(CASE WHEN in_scope AND can_send AND delivered AND attributed AND near THEN round(sent_value, 2) * epp ELSE 0 END), sum(CASE WHEN in_scope AND can_send AND delivered AND attributed AND near THEN epp ELSE 0 END) FROM rfact GROUP BY 1, 3""")
add("months", "SELECT DISTINCT m, r.platform FROM rsum, rules r")


@query("rec_3_wide", sql("""SELECT g.m AS period_month, g.platform, round(coalesce(u.net, 0), 2) AS w_v, round(coalesce(u.scope_v, 0), 2) AS scope_v, coalesce(u.sent_n, 0)::DOUBLE AS sent_n, coalesce(u.dn, 0)::DOUBLE AS delivered_n, round(coalesce(a.dv, 0), 2) AS tag_v, coalesce(a.dn, 0)::DOUBLE AS tag_n, round(coalesce(r.dv, 0), 2) AS ads_v, coalesce(r.dn, 0)::DOUBLE AS ads_n
    FROM months g LEFT JOIN rsum u ON u.base = 'u' AND u.m = g.m AND u.platform = g.platform LEFT JOIN rsum a ON a.base = 'a' AND a.m = g.m AND a.platform = g.platform LEFT JOIN rsum r ON r.base = 'r' AND r.m = g.m AND r.platform = g.platform"""))
def _(s, d):
    return wide(s, d).select("period_month", "platform", F.round("w_v", 2).alias("w_v"), F.round("scope_v", 2).alias("scope_v"), "sent_n", "delivered_n", F.round("tag_v", 2).alias("tag_v"), "tag_n", F.round("ads_v", 2).alias("ads_v"), "ads_n")


@query("rec_4_waterfall", sql("""SELECT g.m AS period_month, g.platform, l.l AS report_layer, CASE l.l WHEN 'tag_received' THEN 13 ELSE 16 END AS steps, round(CASE l.l WHEN 'tag_received' THEN coalesce(a.dv, 0) ELSE coalesce(r.dv, 0) END, 2) AS reported_value, 0.0::DOUBLE AS residual
    FROM months g LEFT JOIN rsum a ON a.base = 'a' AND a.m = g.m AND a.platform = g.platform LEFT JOIN rsum r ON r.base = 'r' AND r.m = g.m AND r.platform = g.platform, (VALUES ('tag_received'), ('ads_attributed')) l(l)"""))
def _(s, d):
    w = R.waterfall(wide(s, d))
    g = w.groupBy("period_month", "platform", "report_layer").agg(F.count(F.lit(1)).alias("steps"), F.max(F.when(F.col("step_name") == "residual", F.col("value_running"))).alias("reported"), F.sum(F.when(F.col("step_name") == "residual", F.col("value_delta"))).alias("residual"))
    return g.select("period_month", "platform", "report_layer", "steps", (F.round("reported", 2) + 0.0).alias("reported_value"), F.abs(F.round("residual", 4)).alias("residual"))


@query("rec_5_platform_daily", sql("SELECT o_orderpriority AS platform, CAST(date_trunc('month', o_orderdate) AS DATE) AS report_month, 'USD' AS currency, count(*) AS reports FROM orders GROUP BY 1, 2"))
def _(s, d):
    o = D.table(s, d, "orders").select(F.col("o_orderpriority").alias("platform"), F.col("o_orderdate").cast("date").alias("report_date"), F.lit("usd").alias("currency"))
    return R.platform_daily(o).groupBy("platform", "report_month", "currency").agg(F.count(F.lit(1)).alias("reports"))


@query("rec_6_expected_reports", sql("""SELECT platform, m AS report_month, CASE base WHEN 'a' THEN 'tag_received' ELSE 'ads_attributed' END AS report_layer, dn AS conversions, round(dv, 2) AS conversion_value FROM rsum WHERE base <> 'u' AND dn > 0"""))
def _(s, d):
    return R.expected_reports(staged_facts(s, d)).withColumn("conversion_value", F.round("conversion_value", 2))


@shared
def issues(s, d):
    ev = D.ev(s, d).select(F.col("event_id").alias("stripe_event_id"), "event_type", (F.col("event_type") != "error").alias("is_handled_type"))
    lines = D.invoice_line(s, d).withColumn("user_id", F.lit(None).cast("string"))
    orphans = D.ev(s, d).where("k = 50").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("type"))
    accounts = D.table(s, d, "customer").where("c_acctbal >= 0").select(F.concat(F.lit("cus_"), F.col("c_custkey").cast("string")).alias("user_id"))
    return stage(R.quarantine(ev, lines, D.plan_catalog(s, d), MO.purchases(s, d), MO.adjustments(s, d), orphans, D.invoice(s, d).select("user_id"), accounts))


ISSUES = """SELECT 'stripe_event_type_not_handled' AS issue, 'flagged' AS severity, 0 AS diff FROM ev WHERE event_type = 'error'
    UNION ALL SELECT 'invoice_line_unknown_price', 'flagged', 0 FROM invoice_line WHERE price_id NOT IN (SELECT price_id FROM plan_catalog) UNION ALL SELECT 'purchase_unclassified', 'excluded', -cash FROM pur WHERE event_name IS NULL
    UNION ALL SELECT 'money_without_fx_rate', 'excluded', 0 FROM pur p WHERE NOT EXISTS (SELECT 1 FROM fx f WHERE f.currency = p.currency AND f.valid_from <= CAST(p.occurred_at AS DATE) AND (f.valid_to IS NULL OR CAST(p.occurred_at AS DATE) < f.valid_to))
    UNION ALL SELECT 'adjustment_not_linked_to_purchase', 'flagged', 0 FROM netted WHERE adjusts_event_id IS NULL
    UNION ALL SELECT 'dispute_' || CASE WHEN NOT lost THEN 'dispute_won_or_inquiry' WHEN ledger_cash = 0 THEN 'dispute_after_full_refund' ELSE 'chargeback' END, 'flagged', CASE WHEN lost AND ledger_cash <> cash THEN ledger_cash - cash ELSE 0 END FROM netted WHERE event_name = 'chargeback' AND (NOT lost OR ledger_cash = 0 OR ledger_cash <> cash)
    UNION ALL SELECT 'ledger_entry_without_user', 'excluded', 0 FROM ev WHERE k = 50 UNION ALL SELECT DISTINCT ON (o_custkey) 'stripe_customer_not_an_app_user', 'flagged', 0 FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0"""


@query("job_20_quarantine", sql(f"SELECT issue, severity, count(*) AS n, coalesce(sum(diff), 0) AS ledger_difference_minor FROM ({ISSUES}) GROUP BY 1, 2"))
def _(s, d):
    return issues(s, d).groupBy("issue", "severity").agg(F.count(F.lit(1)).alias("n"), F.sum("ledger_difference_minor").alias("ledger_difference_minor"))

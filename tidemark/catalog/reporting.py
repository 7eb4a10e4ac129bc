"""Report queries."""

from __future__ import annotations

from dataclasses import fields
from datetime import date

from pyspark.sql import functions as F

from tidemark.catalog import experiment, identity, purchase, reconcile, scores
from tidemark.catalog.cte import add, sql
from tidemark.catalog.identity import LEDGER
from tidemark.catalog.registry import query
from tidemark.functions import columns as C
from tidemark.plans import experiment as E
from tidemark.plans import purchase_value as V
from tidemark.plans import reconciliation as R
from tidemark.plans import reporting as T
from tidemark.plans import scores_24h as S
from tidemark.sources import driver_tables as D

_HEAD, _BODY = LEDGER.split("\nSELECT e.event_id", 1)
LEDGER_DAILY = _HEAD + ",\nlg AS (SELECT e.event_name, e.occurred_at, e.event_id" + _BODY + """)
SELECT CAST(occurred_at AS DATE) AS event_date, event_name, count(*) AS events, avg(CASE WHEN has_google_click_id THEN 1.0 ELSE 0.0 END) AS share_google_click_id, avg(CASE WHEN has_utm_source THEN 1.0 ELSE 0.0 END) AS share_utm_source,
    avg(CASE WHEN device_id IS NOT NULL THEN 1.0 ELSE 0.0 END) AS share_device_id, max(web_fix_platforms) AS web_fix_platforms FROM lg WHERE NOT is_qa_account GROUP BY 1, 2"""


@query("rpt_1_signal_coverage", LEDGER_DAILY)
def _(s, d):
    return T.signal_coverage_daily(identity.conversion_ledger(s, d)).select("event_date", "event_name", "events", "share_google_click_id", "share_utm_source", "share_device_id", "web_fix_platforms")


@query("rpt_7_coverage_question", LEDGER_DAILY.split("\nSELECT CAST(occurred_at AS DATE)")[0] + "\nSELECT event_name, count(*) AS events, round(avg(CASE WHEN has_google_click_id THEN 1.0 ELSE 0.0 END), 9) AS share_google_click_id FROM lg WHERE NOT is_qa_account GROUP BY 1")
def _(s, d):
    x = T.coverage_question(T.signal_coverage_daily(identity.conversion_ledger(s, d)))
    return x.select("event_name", "events", F.round("share_google_click_id", 9).alias("share_google_click_id"))


@query("rpt_2_experiment_daily", sql("SELECT exposure_date, flag_key, arm, allocation_slice, sum(exposed_users) AS exposed_users, sum(mu) AS matured_users, sum(converted_users) AS converted_users, round(sum(sp) / nullif(sum(scored_users), 0), 3) AS predicted_profit_per_scored FROM daily GROUP BY 1, 2, 3, 4"))
def _(s, d):
    x = T.experiment_daily(experiment.daily(s, d))
    return x.select("exposure_date", "flag_key", "arm", "allocation_slice", "exposed_users", "matured_users", "converted_users", F.round("predicted_profit_per_scored", 3).alias("predicted_profit_per_scored"))


@query("rpt_3_purchase_value", sql("""SELECT CAST(date_trunc('month', occurred_at) AS DATE) AS purchase_month, acquisition_channel, purchase_kind, 'pvs-v0.1-structural-eb-xf' AS model_version, count(*) AS purchases, round(sum(predicted_profit), 2) + 0.0 AS predicted_profit,
    round(sum(greatest(predicted_profit, 0)), 2) + 0.0 AS platform_value, round(avg(interval_high - interval_low), 4) AS mean_interval_width, count(*) FILTER (WHERE predicted_profit < 0) AS negative_value_purchases FROM vfinal WHERE purpose = 'serve' GROUP BY 1, 2, 3"""))
def _(s, d):
    x = T.purchase_value(V.served_values(purchase.scored(s, d), scores.P))
    return x.withColumns({c: F.round(c, 2) + 0.0 for c in ("predicted_profit", "platform_value")}).withColumn("mean_interval_width", F.round("mean_interval_width", 4))


@query("rpt_4_data_quality", sql("""SELECT CAST(ts AS DATE) AS day, 'stripe_event_type_not_handled' AS issue, 'flagged' AS severity, count(*) AS records FROM ev WHERE event_type = 'error' GROUP BY 1
    UNION ALL SELECT CAST(ts AS DATE), 'ledger_entry_without_user', 'excluded', count(*) FROM ev WHERE k = 50 GROUP BY 1"""))
def _(s, d):
    i = reconcile.issues(s, d)
    x = i.join(D.ev(s, d).select(F.col("event_id").cast("string").alias("record_id"), F.to_date("ts").alias("seen_on")), "record_id")
    return T.data_quality(x, "seen_on").drop("ledger_difference_minor")


# every measure of the arm readout: name -> (SQL over the arm statistics, places); counts and ranks have no places
_RANK = "rank() OVER (PARTITION BY flag_key ORDER BY {} DESC NULLS LAST)"
add("rranked", f"SELECT *, 1.96::DOUBLE * sqrt(coalesce(psd * psd / nullif(sc, 0), 0) + coalesce(mvar, 0)) AS half, 1.96::DOUBLE * sqrt(coalesce(svar, 0) + coalesce(mvar, 0)) AS shalf, 1.96::DOUBLE * sqrt(rate * (1 - rate) / n) AS rhalf, 1.96::DOUBLE * prsd / sqrt(mat) AS phalf, "
    + ", ".join(f"{_RANK.format(c)} AS {r}" for c, r in (("rate", "by_rate"), ("pred", "by_pred"), ("pr", "by_profit"))) + " FROM rci")
add("rwinner", "SELECT flag_key AS wk, max(pred) FILTER (WHERE by_rate = 1) AS rate_winner, max(pred) FILTER (WHERE by_pred = 1) AS pred_winner FROM rranked GROUP BY 1")
ARM_MEASURES = {
    "exposed_users": ("n", None), "contaminated_users": ("bad", None), "converters": ("conv", None), "matured_users": ("mat", None), "scored_users": ("sc", None), "residual_users": ("rn_arm", None),
    "conversion_rate": ("rate", 4), "conversion_low": ("rate - rhalf", 4), "conversion_high": ("rate + rhalf", 4), "revenue_per_exposed": ("rev", 6), "cost_per_exposed": ("cost", 6), "realised_profit_per_exposed": ("pr", 3),
    "realised_low": ("pr - phalf", 3), "realised_high": ("pr + phalf", 3), "predicted_profit_per_exposed": ("pred", 3), "predicted_low": ("pred - half", 3), "predicted_high": ("pred + half", 3), "stratified_per_exposed": ("strat", 3),
    "stratified_low": ("strat - shalf", 3), "stratified_high": ("strat + shalf", 3), "model_bias": ("bias", 3), "model_error_se": ("sqrt(mvar)", 3), "ppi_per_exposed": ("pred + coalesce(bias, 0)", 3), "cuped_theta": ("theta", 4),
    "cuped_per_exposed": ("pr - theta * (ca - cm)", 3), "value_if_converted": ("vic", 3), "min_propensity": ("min_propensity", None), "conversion_rank": ("by_rate", None), "predicted_rank": ("by_pred", None), "realised_rank": ("by_profit", None),
    "predicted_vs_conversion_winner": ("pred - rate_winner", 3), "profit_left_by_conversion_ranking": ("pred_winner - rate_winner", 3),
}


@query("rpt_5_passthrough", sql("SELECT flag_key, arm, " + ", ".join(f"{x} AS {n}" if places is None else f"round({x}, {places}) + 0.0 AS {n}" for n, (x, places) in ARM_MEASURES.items()) + " FROM rranked JOIN rwinner ON wk = flag_key"))
def _(s, d):
    from tidemark.sinks.tables import create_views
    create_views({"rpt_experiment_profit_by_arm": E.arm_readout(experiment.readout(s, d), experiment.P)}, ["user_id"])
    return s.table("rpt_experiment_profit_by_arm").select("flag_key", "arm", *[F.col(n) if places is None else (F.round(n, places) + 0.0).alias(n) for n, (_x, places) in ARM_MEASURES.items()])


_CONSTANTS = ", ".join("('{}', '{}')".format(f.name, str(getattr(scores.P, f.name)).replace("'", "''")) for f in fields(scores.P))
_FITTED = ("revenue_per_converter", "charges_per_converter", "paid_credits_per_converter", "paid_video_credit_share", "trial_cost_per_credit")
add("rparam", f"SELECT * FROM (VALUES {_CONSTANTS}) v(name, value) UNION ALL SELECT 'p_convert.' || fit_id || '.' || segment, printf('%.9f', p_convert) FROM seg_rate UNION ALL "
    + " UNION ALL ".join(f"SELECT '{c}.' || fit_id, printf('%.9f', {c}) FROM conv_val" for c in _FITTED))


@query("rpt_5b_model_parameters", sql("SELECT name, value, (SELECT sha256(string_agg(name || '=' || value, '|' ORDER BY name, value)) FROM rparam) AS fitted_params_ref FROM rparam"))
def _(s, d):
    from tidemark.sinks.tables import create_views
    _f, o, w = scores.model(s, d)
    create_views({"rpt_model_parameters": S.current_parameters(s, scores.P, S.segment_rates(o, w, scores.P), S.converter_value(o, scores.usage(s, d), w, scores.P))}, [])
    return s.table("rpt_model_parameters")


@query("rpt_5c_reconciliation", sql("""SELECT g.m AS period_month, g.platform, l.l AS report_layer, CASE l.l WHEN 'tag_received' THEN 13 ELSE 16 END AS steps, coalesce(t.dn, 0)::DOUBLE AS reported_conversions, round(coalesce(t.dv, 0), 2) + 0.0 AS reported_value
    FROM months g, (VALUES ('tag_received', 'a'), ('ads_attributed', 'r')) l(l, base) LEFT JOIN rsum t ON t.base = l.base AND t.m = g.m AND t.platform = g.platform"""))
def _(s, d):
    from tidemark.sinks.tables import create_views
    create_views({"rpt_reconciliation": R.waterfall(reconcile.wide(s, d))}, [])
    last = F.col("step_name") == "platform_reported"
    return s.table("rpt_reconciliation").groupBy("period_month", "platform", "report_layer").agg(
        F.count(F.lit(1)).alias("steps"), F.sum(F.when(last, F.col("conversions_delta"))).alias("reported_conversions"), (F.round(F.sum(F.when(last, F.col("value_delta"))), 2) + 0.0).alias("reported_value"))


add("rtruth", "SELECT CAST(date_trunc('month', occurred_at) AS DATE) AS m, count(*) AS n, sum(cash_minor) / 100.0::DOUBLE AS v FROM purchase GROUP BY 1")


@query("rpt_6_reconciliation_summary", sql("""SELECT p.platform, t.n::DOUBLE AS purchases, round(t.v, 2) AS truth_value, round(w.v, 2) AS warehouse_value, a.n::DOUBLE AS platform_conversions, round(a.v, 2) AS platform_value FROM rules p, (SELECT sum(n) AS n, sum(v) AS v FROM rtruth) t
    JOIN (SELECT platform, sum(net) AS v FROM rsum WHERE base = 'u' GROUP BY 1) w ON w.platform = p.platform JOIN (SELECT platform, sum(dn) AS n, sum(dv) AS v FROM rsum WHERE base = 'a' GROUP BY 1) a ON a.platform = p.platform"""))
def _(s, d):
    x = T.reconciliation_summary(R.waterfall(reconcile.wide(s, d)), "tag_received")
    return x.select("platform", "purchases", F.round("truth_value", 2).alias("truth_value"), F.round("warehouse_value", 2).alias("warehouse_value"), "platform_conversions", F.round("platform_value", 2).alias("platform_value"))


add("wqf", "SELECT *, in_scope AND can_send AS sent, in_scope AND can_send AND delivered AS got, round(rule_value, 2) AS rv, round(sent_value, 2) AS sv FROM rfact WHERE platform = 'meta'")
add("wqu", """SELECT count(*) AS n, sum(net) AS net, sum(gross) AS gross, count(*) FILTER (WHERE in_scope) AS scope_n, sum(gross) FILTER (WHERE in_scope) AS scope_v, count(*) FILTER (WHERE sent) AS sent_n, sum(gross) FILTER (WHERE sent) AS sent_v, sum(epp) FILTER (WHERE sent) AS counted_n,
    sum(gross * epp) FILTER (WHERE sent) AS counted_v, sum(rv * epp) FILTER (WHERE sent) AS valued_v, sum(epp) FILTER (WHERE got) AS got_n, sum(sv * epp) FILTER (WHERE got) AS got_v FROM wqf WHERE mu = DATE '2024-01-01'""")
add("wqa", "SELECT sum(epp) FILTER (WHERE got) AS n, sum(sv * epp) FILTER (WHERE got) AS v FROM wqf WHERE ma = DATE '2024-01-01'")
add("wqt", "SELECT count(*) AS n, sum(cash_minor / 100.0::DOUBLE) AS v FROM purchase WHERE occurred_at >= TIMESTAMP '2024-01-01' AND occurred_at < TIMESTAMP '2024-02-01'")
# meta values a purchase by its lifetime where known, so that and the stated value are the same state
add("wqs", """SELECT 1 AS o, 'stripe_truth' AS name, 'source' AS grp, n, v FROM wqt UNION ALL SELECT 2, 'warehouse_vs_stripe', 'pipeline', n, net FROM wqu UNION ALL SELECT 3, 'refunds_not_netted', 'valuation', n, gross FROM wqu UNION ALL SELECT 4, 'out_of_scope_purchase_types', 'definition', scope_n, scope_v FROM wqu
    UNION ALL SELECT 5, 'blocked_users', 'delivery', sent_n, sent_v FROM wqu UNION ALL SELECT 6, 'double_counting', 'counting', counted_n, counted_v FROM wqu UNION ALL SELECT 7, 'ltv_in_value', 'valuation', counted_n, valued_v FROM wqu UNION ALL SELECT 8, 'value_not_sent', 'valuation', counted_n, valued_v FROM wqu
    UNION ALL SELECT 9, 'fallback_misvaluation', 'valuation', got_n, got_v FROM wqu UNION ALL SELECT 10, 'time_zone', 'reporting', n, v FROM wqa""")


@query("rpt_6b_waterfall_question", sql("""SELECT o AS step_order, name AS step_name, grp AS step_group, (n - coalesce(lag(n) OVER (ORDER BY o), 0))::DOUBLE AS conversions_delta, round(v - coalesce(lag(v) OVER (ORDER BY o), 0), 2) + 0.0 AS value_delta, round(v, 2) + 0.0 AS value_running FROM wqs
    UNION ALL SELECT 11, 'modeled_platform_report', 'total', n::DOUBLE, round(v, 2), round(v, 2) FROM wqa UNION ALL SELECT 12, 'residual', 'residual', 0, 0, round(v, 2) FROM wqa UNION ALL SELECT 13, 'platform_reported', 'total', n::DOUBLE, round(v, 2), round(v, 2) FROM wqa"""))
def _(s, d):
    x = T.waterfall_question(R.waterfall(reconcile.wide(s, d)), date(2024, 1, 1), "meta", "tag_received")
    return x.select("step_order", "step_name", "step_group", "conversions_delta", (F.round("value_delta", 2) + 0.0).alias("value_delta"), (F.round("value_running", 2) + 0.0).alias("value_running"))


@query("rpt_7_arm_question", sql("SELECT arm, n AS exposed_users, round(rate, 4) AS conversion_rate FROM rci WHERE flag_key LIKE '%image'"))
def _(s, d):
    x = T.arm_question(E.arm_readout(experiment.readout(s, d), experiment.P), D.FLAGS[0])
    return x.select("arm", "exposed_users", F.round("conversion_rate", 4).alias("conversion_rate"))

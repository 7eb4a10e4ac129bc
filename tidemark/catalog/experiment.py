"""Experiment readout queries."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from tidemark.catalog.cte import add, sql
from tidemark.catalog.registry import query, shared
from tidemark.catalog.scores import P as SCORE_P
from tidemark.catalog.scores import events, features, model, scores, usage
from tidemark.functions import columns as C
from tidemark.plans import experiment as E
from tidemark.plans import scores_24h as S
from tidemark.sinks.tables import stage
from tidemark.sources import driver_tables as D

P = dataclasses.replace(SCORE_P, bootstrap_replicates=40, cuped_prior_users=5.0)
LOG = [
    (f, f"arm_{a}", sl, lo, hi, w[a], None)
    for f in D.FLAGS for sl, lo, hi, w in (
        ("holdout", "2024-01-01", None, (0.25, 0.25, 0.5)), ("bandit", "2024-01-01", "2024-01-03", (0.5, 0.25, 0.25)), ("bandit", "2024-01-03", None, (0.125, 0.25, 0.625)))
    for a in range(3)
]
LOG_DDL = "flag_key string, arm string, allocation_slice string, valid_from date, valid_to date, assignment_probability double, data_origin string"


@query("expt_1_exposures", sql("""SELECT x.user_id, x.flag_key, x.arm, x.first_exposed_at, n.n AS n_distinct_arms FROM exposure x JOIN (SELECT user_id, flag_key, count(DISTINCT arm) AS n FROM exposure_rows GROUP BY 1, 2) n USING (user_id, flag_key)"""))
def _(s, d):
    return E.exposures(D.exposure_rows(s, d)).drop("source_priority")


def segments(s, d):
    u = F.col("user_id")
    return events(s, d).select("user_id").distinct().select("user_id", D.pick(u % 4, ("us", "tier1", "rest", "unknown")).alias("country_bucket"), D.pick(u % 3, ("desktop", "mobile", "tablet")).alias("device"), D.pick(u % 2, ("organic", "google_cpc")).alias("acquisition_channel"))


def covariates(s, d):
    return E.cuped_covariate(model(s, d)[1], segments(s, d), P)


@shared
def readout(s, d):
    f = model(s, d)[0]
    served = S.served_scores(scores(s, d), P)
    log = E.allocation_log(s, D.seed_from(s, LOG, LOG_DDL))
    e = events(s, d)
    return stage(E.user_readout(E.exposures(D.exposure_rows(s, e)), served, D.purchase(s, e), D.adjustment(s, e), usage(s, d), e.select("user_id", F.col("ts").alias("event_time")), segments(s, d), f.select("user_id", "acquisition_channel"), log, covariates(s, d), P))


add("seg", "SELECT DISTINCT user_id, (['us', 'tier1', 'rest', 'unknown'])[user_id % 4 + 1] AS country_bucket, (['desktop', 'mobile', 'tablet'])[user_id % 3 + 1] AS device, (['organic', 'google_cpc'])[user_id % 2 + 1] AS acquisition_channel FROM ev")
add("cov", """SELECT k AS cf_fold, s.country_bucket, s.device, s.acquisition_channel, round((coalesce(sum(o.profit) FILTER (WHERE o.cf_fold <> k), 0) + 5.0::DOUBLE * any_value(f.m)) / (count(*) FILTER (WHERE o.cf_fold <> k) + 5.0::DOUBLE), 6) AS covariate
    FROM outc o JOIN seg s USING (user_id) JOIN (SELECT k, avg(profit) AS m FROM outc, range(5) r(k) WHERE complete AND cf_fold <> k GROUP BY 1) f ON true WHERE o.complete GROUP BY 1, 2, 3, 4""")


@query("expt_4_cuped_covariate", sql("SELECT cf_fold, country_bucket, device, acquisition_channel, round(covariate, 4) AS cuped_covariate FROM cov"))
def _(s, d):
    return covariates(s, d).where("country_bucket is not null").withColumn("cuped_covariate", F.round("cuped_covariate", 4))


def _log_values():
    return ", ".join("(" + ", ".join("NULL" if v is None else (f"DATE '{v}'" if i in (3, 4) else (f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE")) for i, v in enumerate(r)) + ")" for r in LOG)


add("alloc_log", f"SELECT * FROM (VALUES {_log_values()}) t(flag_key, arm, slice, valid_from, valid_to, prob, origin)")
add("rbase", """SELECT x.user_id, x.flag_key, x.arm, x.first_exposed_at, CAST(x.first_exposed_at AS DATE) AS exposure_date, (SELECT count(DISTINCT arm) FROM exposure_rows z WHERE z.user_id = x.user_id AND z.flag_key = x.flag_key) > 1 AS is_contaminated,
    CASE WHEN x.user_id % 10 <= 5 THEN 'holdout' ELSE 'bandit' END AS allocation_slice, CAST('0x' || substr(sha256(CAST(x.user_id AS VARCHAR)), 1, 4) AS BIGINT) % 5 AS cf_fold, x.first_exposed_at + INTERVAL 7 DAY <= TIMESTAMP '2024-01-31' AS is_matured,
    m.fs, coalesce(m.rev, 0) AS rev, coalesce(m.cash, 0) AS cash, m.n AS charges, coalesce(a.adj, 0) AS adj, coalesce(a.cb, 0) AS cb, coalesce(a.n, 0) AS adjs, coalesce((SELECT sum(cost_cents * 10000) FROM usage u WHERE u.user_id = x.user_id AND u.created_at >= x.first_exposed_at AND u.created_at < x.first_exposed_at + INTERVAL 7 DAY), 0) AS micros,
    (SELECT count(*) FROM ev e WHERE e.user_id = x.user_id AND e.ts < x.first_exposed_at) AS pre_exposure_events FROM exposure x
    JOIN (SELECT x.user_id, x.flag_key, min(occurred_at) FILTER (WHERE event_name = 'purchase_first') AS fs, sum(revenue_minor) AS rev, sum(cash_minor) AS cash, count(p.event_id) AS n FROM exposure x LEFT JOIN purchase p ON p.user_id = x.user_id AND p.occurred_at >= x.first_exposed_at AND p.occurred_at < x.first_exposed_at + INTERVAL 7 DAY GROUP BY 1, 2) m USING (user_id, flag_key)
    LEFT JOIN (SELECT x.user_id, x.flag_key, sum(a.cash_minor) AS adj, count(*) AS n, count(*) FILTER (WHERE a.event_name = 'chargeback') AS cb FROM exposure x JOIN purchase p ON p.user_id = x.user_id AND p.occurred_at >= x.first_exposed_at AND p.occurred_at < x.first_exposed_at + INTERVAL 7 DAY
        JOIN adjustment a ON a.adjusts_event_id = p.event_id AND a.occurred_at < x.first_exposed_at + INTERVAL 7 DAY GROUP BY 1, 2) a USING (user_id, flag_key)""")
add("rmoney", """SELECT b.*, g.country_bucket, g.device, g.acquisition_channel, rev / 100.0::DOUBLE + adj / 100.0::DOUBLE AS net, round(cash / 100.0::DOUBLE * 0.036::DOUBLE + charges * 0.3::DOUBLE + CASE WHEN f.acquisition_channel = 'affiliate' THEN rev / 100.0::DOUBLE * 0.2::DOUBLE ELSE 0 END + cb * 15.0::DOUBLE, 6) AS fee,
    l.prob AS propensity, s.user_id IS NOT NULL AS is_scored, coalesce(s.paid_within_24h, false) AS paid, coalesce(s.activated_24h, false) AS activated, coalesce(s.generations_24h + s.failed_generations_24h, 0) AS started, coalesce(s.failed_generations_24h, 0) AS failed, s.r1, s.c1, s.f1, s.k1, round(s.sig_profit, 6) AS pred, round(s.sig_p, 6) AS pc,
    round(s.sig_p, 6) * round((round(s.sig_profit, 6) + round(s.base, 6)) / s.sig_p, 6) AS evc, coalesce(c.covariate, (SELECT round(avg(profit), 6) FROM outc o WHERE o.complete AND o.cf_fold <> b.cf_fold)) AS cov
    FROM rbase b JOIN seg g USING (user_id) LEFT JOIN feat f USING (user_id) LEFT JOIN (SELECT * FROM score_out WHERE purpose = 'serve') s USING (user_id)
    LEFT JOIN alloc_log l ON l.flag_key = b.flag_key AND l.arm = b.arm AND l.slice = b.allocation_slice AND l.valid_from <= b.exposure_date AND (l.valid_to IS NULL OR b.exposure_date < l.valid_to)
    LEFT JOIN cov c ON c.cf_fold = b.cf_fold AND c.country_bucket = g.country_bucket AND c.device = g.device AND c.acquisition_channel = g.acquisition_channel""")
add("ro", """SELECT *, coalesce(fs < first_exposed_at + INTERVAL 3 DAY, false) AS convw, fs IS NOT NULL AS convh, CASE WHEN is_matured THEN round(net - micros / 1000000.0::DOUBLE - fee, 6) END AS profit, CASE WHEN is_matured THEN round(round(net - micros / 1000000.0::DOUBLE - fee, 6) - pred, 6) END AS resid,
    CASE WHEN is_matured THEN CASE WHEN fs IS NOT NULL THEN least(net - fee, 500) ELSE 0 END END AS mv, CASE WHEN is_matured THEN micros / 1000000.0::DOUBLE END AS mcost FROM rmoney""")


@query("expt_3_user_readout", sql("""SELECT user_id, flag_key, arm, exposure_date, is_contaminated, allocation_slice, cf_fold, propensity, is_scored, paid AS paid_within_24h, pre_exposure_events, convw AS converted_in_conversion_window, convh AS converted_in_horizon, is_matured,
    round(profit, 4) AS realised_profit, round(resid, 3) AS residual, round(mv, 4) AS matured_value_capped, round(cov, 4) AS cuped_covariate FROM ro"""))
def _(s, d):
    return readout(s, d).select("user_id", "flag_key", "arm", "exposure_date", "is_contaminated", "allocation_slice", "cf_fold", "propensity", "is_scored", "paid_within_24h", "pre_exposure_events", "converted_in_conversion_window", "converted_in_horizon", "is_matured",
                                F.round("realised_profit", 4).alias("realised_profit"), F.round("residual", 3).alias("residual"), F.round("matured_value_capped", 4).alias("matured_value_capped"), F.round("cuped_covariate", 4).alias("cuped_covariate"))


PROPENSITY = sql("SELECT flag_key, arm, allocation_slice, exposure_date, count(*) AS users, max(propensity) AS propensity FROM ro GROUP BY 1, 2, 3, 4")


@query("jn_22_propensity", PROPENSITY)
def _(s, d):
    return readout(s, d).groupBy("flag_key", "arm", "allocation_slice", "exposure_date").agg(F.count(F.lit(1)).alias("users"), F.max("propensity").alias("propensity"))


@query("expt_2_allocation_log", sql("SELECT r.user_id, l.flag_key, l.arm, l.slice AS allocation_slice, l.prob AS assignment_probability FROM exposure r JOIN alloc_log l ON l.flag_key = r.flag_key AND l.valid_from <= CAST(r.first_exposed_at AS DATE) AND (l.valid_to IS NULL OR CAST(r.first_exposed_at AS DATE) < l.valid_to)"))
def _(s, d):
    from tidemark.operators.rows import points_in_ranges
    log = E.allocation_log(s, D.seed_from(s, LOG, LOG_DDL)).withColumnRenamed("arm", "log_arm")
    x = readout(s, d).select("user_id", "flag_key", F.to_date("first_exposed_at").alias("day"))
    return points_in_ranges(x, "day", log, ("valid_from", "valid_to"), ["flag_key"]).select("user_id", "flag_key", F.col("log_arm").alias("arm"), "allocation_slice", "assignment_probability")


add("rflag", """SELECT flag_key, avg(CASE WHEN is_scored THEN paid::INT END) AS w, var_samp(resid) AS rv, count(resid) AS rn, avg(cov) FILTER (WHERE is_matured) AS cm,
    (avg(cov * profit) FILTER (WHERE is_matured) - avg(cov) FILTER (WHERE is_matured) * avg(profit) FILTER (WHERE is_matured)) / (avg(cov * cov) FILTER (WHERE is_matured) - avg(cov) FILTER (WHERE is_matured) * avg(cov) FILTER (WHERE is_matured)) AS theta FROM ro GROUP BY 1""")
add("rarm", """SELECT flag_key, arm, count(*) AS n, count(*) FILTER (WHERE is_contaminated) AS bad, count(*) FILTER (WHERE convh) AS conv, count(*) FILTER (WHERE is_matured) AS mat, count(*) FILTER (WHERE is_scored) AS sc, count(resid) AS rn_arm, avg(CASE WHEN is_matured THEN net END) AS rev, avg(mcost) AS cost,
    avg(profit) AS pr, stddev_samp(profit) AS prsd, avg(cov) FILTER (WHERE is_matured) AS ca, avg(pred) AS pred, stddev_samp(pred) AS psd, avg(resid) AS bias, var_samp(resid) AS rva, count(pred) FILTER (WHERE paid) AS n1, count(pred) FILTER (WHERE NOT paid) AS n0, avg(pred) FILTER (WHERE paid) AS m1,
    avg(pred) FILTER (WHERE NOT paid) AS m0, var_samp(pred) FILTER (WHERE paid) AS v1, var_samp(pred) FILTER (WHERE NOT paid) AS v0, sum(evc) / sum(pc) AS vic, min(propensity) AS min_propensity FROM ro GROUP BY 1, 2""")
add("rci", """SELECT a.*, f.*, conv / n AS rate, CASE WHEN rn_arm >= 30 THEN rva / rn_arm WHEN f.rn > 1 THEN f.rv / f.rn END AS mvar, CASE WHEN n1 > 0 AND n0 > 0 THEN w * m1 + (1 - w) * m0 ELSE pred END AS strat,
    CASE WHEN n1 > 0 AND n0 > 0 THEN w * w * coalesce(v1, 0) / n1 + (1 - w) * (1 - w) * coalesce(v0, 0) / n0 ELSE psd * psd / nullif(sc, 0) END AS svar FROM rarm a JOIN (SELECT flag_key AS fk, w, rv, rn, cm, theta FROM rflag) f ON f.fk = a.flag_key""")


@query("expt_5_arm_readout", sql("""SELECT flag_key, arm, n AS exposed_users, bad AS contaminated_users, conv AS converters, mat AS matured_users, sc AS scored_users, round(rate, 4) AS conversion_rate, round(rate - 1.96::DOUBLE * sqrt(rate * (1 - rate) / n), 4) AS conversion_low,
    round(pr, 3) AS realised_profit_per_exposed, round(pr - 1.96::DOUBLE * prsd / sqrt(mat), 3) AS realised_low, round(pred, 3) AS predicted_profit_per_exposed, round(pred - 1.96::DOUBLE * sqrt(coalesce(psd * psd / nullif(sc, 0), 0) + coalesce(mvar, 0)), 3) AS predicted_low, round(sqrt(mvar), 3) AS model_error_se, round(vic, 3) AS value_if_converted, min_propensity FROM rci"""))
def _(s, d):
    a = E.arm_readout(readout(s, d), P)
    return a.select("flag_key", "arm", "exposed_users", "contaminated_users", "converters", "matured_users", "scored_users", *[F.round(c, 4).alias(c) for c in ("conversion_rate", "conversion_low")],
                    *[F.round(c, 3).alias(c) for c in ("realised_profit_per_exposed", "realised_low", "predicted_profit_per_exposed", "predicted_low", "model_error_se", "value_if_converted")], "min_propensity")


@query("expt_6_stratified", sql("SELECT flag_key, arm, round(strat, 3) AS stratified_per_exposed, round(strat - 1.96::DOUBLE * sqrt(coalesce(svar, 0) + coalesce(mvar, 0)), 3) AS stratified_low, round(strat + 1.96::DOUBLE * sqrt(coalesce(svar, 0) + coalesce(mvar, 0)), 3) AS stratified_high FROM rci"))
def _(s, d):
    return E.arm_readout(readout(s, d), P).select("flag_key", "arm", *[F.round(c, 3).alias(c) for c in ("stratified_per_exposed", "stratified_low", "stratified_high")])


@query("expt_7_prediction_powered", sql("SELECT flag_key, arm, round(bias, 3) AS model_bias, round(pred + coalesce(bias, 0), 3) AS ppi_per_exposed FROM rci"))
def _(s, d):
    return E.arm_readout(readout(s, d), P).select("flag_key", "arm", *[F.round(c, 3).alias(c) for c in ("model_bias", "ppi_per_exposed")])


BOUNDS = "CASE WHEN u < 0.367879 THEN 0 WHEN u < 0.735759 THEN 1 WHEN u < 0.919699 THEN 2 WHEN u < 0.981012 THEN 3 WHEN u < 0.996340 THEN 4 WHEN u < 0.999406 THEN 5 ELSE 6 END"


@query("expt_8_ppi_bootstrap", sql(f"""SELECT flag_key, arm, round(quantile_cont(est, 0.025), 3) AS ppi_bootstrap_low, round(quantile_cont(est, 0.975), 3) AS ppi_bootstrap_high FROM
    (SELECT flag_key, arm, r, sum(w * pred) / nullif(sum(w), 0) + coalesce(sum(CASE WHEN resid IS NOT NULL THEN w * resid END) / nullif(sum(CASE WHEN resid IS NOT NULL THEN w END), 0), 0) AS est FROM
     (SELECT *, {BOUNDS} AS w FROM (SELECT *, CAST('0x' || substr(sha256(user_id || ':' || flag_key || ':' || r), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM ro, range(40) q(r) WHERE is_scored)) GROUP BY 1, 2, 3) GROUP BY 1, 2"""))
def _(s, d):
    b = E.bootstrap(readout(s, d), P)
    return b.select("flag_key", "arm", *[F.round(c, 3).alias(c) for c in ("ppi_bootstrap_low", "ppi_bootstrap_high")])


@query("expt_9_cuped", sql("SELECT flag_key, arm, round(theta, 4) AS cuped_theta, round(pr - theta * (ca - cm), 3) AS cuped_per_exposed FROM rci"))
def _(s, d):
    return E.arm_readout(readout(s, d), P).select("flag_key", "arm", F.round("cuped_theta", 4).alias("cuped_theta"), F.round("cuped_per_exposed", 3).alias("cuped_per_exposed"))


@query("expt_10_winners", sql("""SELECT flag_key, arm, conversion_rank, predicted_rank, realised_rank, round(max(CASE WHEN predicted_rank = 1 THEN pred END) OVER (PARTITION BY flag_key) - max(CASE WHEN conversion_rank = 1 THEN pred END) OVER (PARTITION BY flag_key), 3) AS profit_left_by_conversion_ranking FROM
    (SELECT *, rank() OVER (PARTITION BY flag_key ORDER BY rate DESC) AS conversion_rank, rank() OVER (PARTITION BY flag_key ORDER BY pred DESC NULLS LAST) AS predicted_rank, rank() OVER (PARTITION BY flag_key ORDER BY pr DESC NULLS LAST) AS realised_rank FROM rci)"""))
def _(s, d):
    return E.arm_readout(readout(s, d), P).select("flag_key", "arm", "conversion_rank", "predicted_rank", "realised_rank", F.round("profit_left_by_conversion_ranking", 3).alias("profit_left_by_conversion_ranking"))


@shared
def daily(s, d):
    return stage(E.daily_readout(readout(s, d), P))


add("daily", """SELECT exposure_date, flag_key, arm, country_bucket, device, acquisition_channel, allocation_slice, count(*) AS exposed_users, count(*) FILTER (WHERE is_scored) AS scored_users, count(*) FILTER (WHERE is_scored AND convw) AS converted_users, coalesce(sum(pred), 0) AS sp, coalesce(sum(pred * pred), 0) AS qp,
    count(*) FILTER (WHERE is_matured) AS mu, count(*) FILTER (WHERE is_matured AND convh) AS mc, coalesce(sum(mv), 0) AS sv, coalesce(sum(mv * mv), 0) AS qv, coalesce(sum(mcost), 0) AS sc, coalesce(sum(mcost * mcost), 0) AS qc, count(*) FILTER (WHERE is_matured AND convh AND adjs > 0) AS mr,
    count(*) FILTER (WHERE is_scored AND activated) AS act, coalesce(sum(started) FILTER (WHERE is_scored), 0) AS g24, coalesce(sum(failed) FILTER (WHERE is_scored), 0) AS f24, coalesce(sum(cov) FILTER (WHERE is_scored), 0) AS sx, coalesce(sum(cov * cov) FILTER (WHERE is_scored), 0) AS qx, coalesce(sum(cov * pred), 0) AS xy,
    sum(propensity) AS spr, count(resid) AS rn FROM ro GROUP BY 1, 2, 3, 4, 5, 6, 7""")


@query("expt_11_daily_readout", sql("""SELECT exposure_date, flag_key, arm, country_bucket, device, acquisition_channel, allocation_slice, exposed_users, scored_users, converted_users, round(sp, 3) AS sum_predicted_profit, mu AS matured_users, mc AS matured_converted_users, round(sv, 3) AS sum_matured_value,
    mr AS matured_refunded_users, act AS activated_users, g24 AS generations_24h, f24 AS failed_generations_24h, round(sx, 3) AS sum_covariate, spr AS sum_propensity, rn AS residual_users FROM daily"""))
def _(s, d):
    return daily(s, d).select(*E.GRAIN, "exposed_users", "scored_users", "converted_users", F.round("sum_predicted_profit", 3).alias("sum_predicted_profit"), "matured_users", "matured_converted_users", F.round("sum_matured_value", 3).alias("sum_matured_value"),
                              "matured_refunded_users", "activated_users", "generations_24h", "failed_generations_24h", F.round("sum_covariate", 3).alias("sum_covariate"), "sum_propensity", "residual_users")


@query("expt_12_validate_daily", sql("""SELECT flag_key, 'scored_users > exposed_users' AS violation, count(*) AS n FROM daily WHERE scored_users > 0 AND device = 'mobile' GROUP BY 1 UNION ALL SELECT flag_key, 'guardrail columns are all-or-none', count(*) FROM daily WHERE device = 'tablet' GROUP BY 1
    UNION ALL SELECT flag_key, 'matured_users > exposed_users', count(*) FROM daily WHERE mu > CASE WHEN device = 'mobile' AND scored_users > 0 THEN scored_users - 1 ELSE exposed_users END GROUP BY 1"""))
def _(s, d):
    # damage some rows so the checks have something to find
    x = daily(s, d).withColumn("exposed_users", F.when((F.col("device") == "mobile") & (F.col("scored_users") > 0), F.col("scored_users") - 1).otherwise(F.col("exposed_users")))
    x = x.withColumn("activated_users", F.when(F.col("device") != "tablet", F.col("activated_users")))
    v = E.validate_daily(x)
    return v.groupBy("flag_key", "violation").agg(F.count(F.lit(1)).alias("n"))

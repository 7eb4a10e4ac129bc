"""24-hour features, outcomes, fit sets, fits, scores and the parameter registry."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.catalog.cte import add, sql
from tidemark.catalog.identity import first_exposures
from tidemark.catalog.registry import query, shared
from tidemark.functions import columns as C
from tidemark.params import Params
from tidemark.plans import identity as I
from tidemark.plans import scores_24h as S
from tidemark.sinks.tables import stage
from tidemark.sources import driver_tables as D

P = Params(as_of=datetime(2024, 1, 31), horizon_days=7, maturity_days=3, backtest_weeks=3)
ARMS = [(i, f"arm_{a}") for i in (0, 1) for a in range(3)]
PLAN_CREDITS = [("essential", 4000), ("advanced", 12000), ("infinite", 24000), ("wonder", 60000)]
PACK_CREDITS = 5000.0


@shared
def events(s, d):
    """The events, their properties parsed once for all the layers that read them."""
    return stage(D.ev(s, d).drop("props"))


@shared
def exposed(s, d):
    return stage(first_exposures(s, events(s, d)))


def usage(s, d):
    return D.usage(s, events(s, d)).withColumn("cost_micros", F.col("cost_cents") * 10_000)


def features(s, d):
    e = events(s, d)
    su = D.signup(s, e)
    anchors = su.select(F.col("user_id").alias("anchor_key"), "user_id", C.add_seconds("signup_at", 86_400).alias("anchor_at"))
    acq = I.acquisition_as_of(anchors, D.click(s, e), D.utm(s, e), D.CLICK_PLATFORMS, False, D.UTM_KEYS).select(F.col("anchor_key").alias("user_id"), "acquisition_channel")
    u = usage(s, d)
    balances = u.where("credit_field = 'trial_credit_balance'").select("user_id", "created_at", F.col("usage_id").alias("entry_id"), (F.col("k") % 20).alias("balance_after"))
    return S.features_24h(su, u, D.purchase(s, e), balances, exposed(s, d), acq, D.FLAGS, P)


@shared
def model(s, d):
    """Features, outcomes and test weeks; the first two feed every fit, so they are computed once."""
    e = events(s, d)
    f = stage(features(s, d))
    o = stage(S.user_outcomes(f, D.purchase(s, e), D.adjustment(s, e), usage(s, d), P))
    return f, o, S.week_starts(S.oot_weeks(o, P))


add("anchor24", "SELECT user_id AS anchor_key, user_id, signup_at + INTERVAL 1 DAY AS anchor_at FROM signup")
add("acq24", """SELECT a.user_id, coalesce(c.channel, CASE WHEN u.src = 'tolt' OR u.med = 'affiliate' THEN 'affiliate' WHEN u.med = 'cpc' THEN 'paid_other' WHEN u.src IS NOT NULL THEN 'referral_other' ELSE 'organic' END) AS channel FROM anchor24 a
    LEFT JOIN (SELECT * FROM (SELECT anchor_key, channel, row_number() OVER (PARTITION BY anchor_key ORDER BY at2 DESC, precedence) AS m FROM (SELECT a.anchor_key, q.acquisition_channel AS channel, q.precedence, c.click_id_created_at AS at2,
        row_number() OVER (PARTITION BY a.anchor_key, c.click_id_key ORDER BY c.source_priority, c.click_id_created_at DESC, c.click_id_value) AS n FROM anchor24 a JOIN click c ON c.user_id = a.user_id AND c.known_at < a.anchor_at JOIN click_platforms q USING (click_id_key)) WHERE n = 1) WHERE m = 1) c USING (anchor_key)
    LEFT JOIN (SELECT anchor_key, max(v) FILTER (WHERE utm_key = 'utm_source') AS src, max(v) FILTER (WHERE utm_key = 'utm_medium') AS med FROM (SELECT a.anchor_key, u.utm_key, u.utm_value AS v, row_number() OVER (PARTITION BY a.anchor_key, u.utm_key ORDER BY u.source_priority, u.known_at, u.utm_value) AS n
        FROM anchor24 a JOIN utm u ON u.user_id = a.user_id AND u.known_at < a.anchor_at) WHERE n = 1 GROUP BY 1) u USING (anchor_key)""")
add("gen24", "SELECT g.*, g.cost_cents * 10000 AS cost_micros FROM usage g JOIN signup s ON s.user_id = g.user_id AND g.created_at >= s.signup_at AND g.created_at < s.signup_at + INTERVAL 1 DAY")
add("feat", """SELECT s.user_id, s.signup_at, s.signup_at + INTERVAL 1 DAY AS window_end, CAST('0x' || substr(sha256(CAST(s.user_id AS VARCHAR)), 1, 4) AS BIGINT) % 5 AS cf_fold, CAST(date_trunc('week', s.signup_at) AS DATE) AS signup_week,
    p.event_name AS fp_name, p.plan_tier, p.billing_interval, p.revenue_minor AS fp_minor, p.event_id IS NOT NULL AS paid_within_24h, coalesce(g.ok, 0) AS generations_24h, coalesce(g.bad, 0) AS failed_generations_24h, coalesce(g.ok, 0) > 0 AS activated_24h,
    coalesce(g.credits, 0) AS credits_consumed_24h, coalesce(g.micros, 0) AS cost_24h_micros, coalesce(g.models, 0) AS distinct_models_24h, t.model_id AS top_model_24h, b.bal AS trial_left, coalesce(b.bal < 5, false) AS trial_depleted_24h,
    (SELECT arm FROM exposure x WHERE x.user_id = s.user_id AND x.flag_key LIKE '%image' AND x.first_exposed_at < s.signup_at + INTERVAL 1 DAY) AS arm_0, (SELECT arm FROM exposure x WHERE x.user_id = s.user_id AND x.flag_key LIKE '%video' AND x.first_exposed_at < s.signup_at + INTERVAL 1 DAY) AS arm_1, a.channel AS acquisition_channel
    FROM signup s LEFT JOIN (SELECT user_id, count(*) FILTER (WHERE NOT is_failed) AS ok, count(*) FILTER (WHERE is_failed) AS bad, sum(credits) FILTER (WHERE NOT is_failed) AS credits, sum(cost_micros) AS micros, count(DISTINCT model_id) FILTER (WHERE NOT is_failed) AS models FROM gen24 GROUP BY 1) g USING (user_id)
    LEFT JOIN (SELECT user_id, model_id FROM (SELECT user_id, model_id, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, model_id) AS n FROM gen24 WHERE NOT is_failed GROUP BY 1, 2) WHERE n = 1) t USING (user_id)
    LEFT JOIN (SELECT u.user_id, arg_max(u.k % 20, u.created_at) AS bal FROM usage u JOIN signup z ON z.user_id = u.user_id AND u.created_at < z.signup_at + INTERVAL 1 DAY WHERE u.credit_field = 'trial_credit_balance' GROUP BY 1) b USING (user_id)
    LEFT JOIN (SELECT * FROM (SELECT q.*, row_number() OVER (PARTITION BY q.user_id ORDER BY q.occurred_at, q.event_id) AS n FROM purchase q JOIN signup z ON z.user_id = q.user_id AND q.occurred_at < z.signup_at + INTERVAL 1 DAY) WHERE n = 1) p USING (user_id) LEFT JOIN acq24 a USING (user_id)
    WHERE s.signup_at + INTERVAL 1 DAY <= TIMESTAMP '2024-01-31'""")


@query("ml_1_features_24h", sql("""SELECT user_id, cf_fold, signup_week, fp_name AS first_purchase_event_name, paid_within_24h, generations_24h, failed_generations_24h, activated_24h, credits_consumed_24h, cost_24h_micros, distinct_models_24h, top_model_24h,
    trial_left AS trial_credits_remaining_24h, trial_depleted_24h, arm_0, arm_1, acquisition_channel FROM feat"""))
def _(s, d):
    return features(s, d).where("is_window_complete").select(
        "user_id", "cf_fold", "signup_week", "first_purchase_event_name", "paid_within_24h", "generations_24h", "failed_generations_24h", "activated_24h", "credits_consumed_24h", "cost_24h_micros", "distinct_models_24h", "top_model_24h",
        "trial_credits_remaining_24h", "trial_depleted_24h", "arm_0", "arm_1", "acquisition_channel")


FEES = "m.cash / 100.0::DOUBLE * 0.036::DOUBLE + m.n * 0.3::DOUBLE + CASE WHEN f.acquisition_channel = 'affiliate' THEN m.rev / 100.0::DOUBLE * 0.2::DOUBLE ELSE 0 END + m.cb * 15.0::DOUBLE"
add("outc", f"""SELECT f.user_id, CASE WHEN f.paid_within_24h THEN 'paid_24h' WHEN NOT f.activated_24h THEN 'not_activated' WHEN f.trial_depleted_24h THEN 'activated_depleted' ELSE 'activated' END AS segment, f.signup_at, f.signup_week, f.cf_fold, f.arm_0, f.arm_1,
    f.signup_at + INTERVAL 3 DAY <= TIMESTAMP '2024-01-31' AS mature, f.signup_at + INTERVAL 7 DAY <= TIMESTAMP '2024-01-31' AS complete, coalesce(x.at2 >= f.window_end AND x.at2 < f.signup_at + INTERVAL 3 DAY, false) AS conv24,
    coalesce(x.at2 >= f.signup_at AND x.at2 < f.signup_at + INTERVAL 7 DAY, false) AS convh, CASE WHEN x.at2 >= f.window_end AND x.at2 < f.signup_at + INTERVAL 3 DAY THEN x.rev END AS first_minor, m.rev, m.cash, m.n AS charges, m.adj, m.cb, m.pc AS paid_credits, m.micros,
    round({FEES}, 6) AS fees, round(m.rev / 100.0::DOUBLE + m.adj / 100.0::DOUBLE - m.micros / 1000000.0::DOUBLE - ({FEES}), 6) AS profit
    FROM feat f LEFT JOIN (SELECT user_id, min(occurred_at) AS at2, arg_min(revenue_minor, occurred_at) AS rev FROM purchase WHERE event_name = 'purchase_first' GROUP BY 1) x USING (user_id)
    JOIN (SELECT f.user_id, coalesce((SELECT sum(revenue_minor) FROM purchase p WHERE p.user_id = f.user_id AND p.occurred_at >= f.signup_at AND p.occurred_at < f.signup_at + INTERVAL 7 DAY), 0) AS rev,
        coalesce((SELECT sum(cash_minor) FROM purchase p WHERE p.user_id = f.user_id AND p.occurred_at >= f.signup_at AND p.occurred_at < f.signup_at + INTERVAL 7 DAY), 0) AS cash,
        (SELECT count(*) FROM purchase p WHERE p.user_id = f.user_id AND p.occurred_at >= f.signup_at AND p.occurred_at < f.signup_at + INTERVAL 7 DAY) AS n,
        coalesce((SELECT sum(a.cash_minor) FROM purchase p JOIN adjustment a ON a.adjusts_event_id = p.event_id WHERE p.user_id = f.user_id AND p.occurred_at >= f.signup_at AND p.occurred_at < f.signup_at + INTERVAL 7 DAY AND a.occurred_at <= TIMESTAMP '2024-01-31'), 0) AS adj,
        (SELECT count(*) FROM purchase p JOIN adjustment a ON a.adjusts_event_id = p.event_id WHERE p.user_id = f.user_id AND p.occurred_at >= f.signup_at AND p.occurred_at < f.signup_at + INTERVAL 7 DAY AND a.occurred_at <= TIMESTAMP '2024-01-31' AND a.event_name = 'chargeback') AS cb,
        coalesce((SELECT sum(credits) FROM usage u WHERE u.user_id = f.user_id AND u.created_at >= f.signup_at AND u.created_at < f.signup_at + INTERVAL 7 DAY AND NOT is_failed AND credit_field <> 'trial_credit_balance'), 0) AS pc,
        coalesce((SELECT sum(cost_cents * 10000) FROM usage u WHERE u.user_id = f.user_id AND u.created_at >= f.signup_at AND u.created_at < f.signup_at + INTERVAL 7 DAY), 0) AS micros FROM feat f) m USING (user_id)""")


@query("ml_2_user_outcomes", sql("SELECT user_id, segment, mature AS is_conversion_mature, complete AS is_horizon_complete, conv24 AS converted_after_24h, convh AS converted_in_horizon, first_minor AS first_subscription_minor, rev AS revenue_minor, charges, adj AS adjusted_minor, cb AS chargebacks, paid_credits, fees AS fees_horizon, profit AS realized_profit FROM outc"))
def _(s, d):
    return model(s, d)[1].select("user_id", "segment", "is_conversion_mature", "is_horizon_complete", "converted_after_24h", "converted_in_horizon", "first_subscription_minor", "revenue_minor", "charges", "adjusted_minor", "chargebacks", "paid_credits", "fees_horizon", "realized_profit")


add("weeks", """SELECT 'oot_' || strftime(signup_week, '%Y%m%d') AS fit_id, signup_week AS test_week_start, signup_week + 7 AS test_week_end, count(*) AS test_week_users FROM outc WHERE signup_week + 14 <= DATE '2024-01-31'
    AND signup_week > (SELECT min(signup_week) FROM outc) GROUP BY signup_week ORDER BY signup_week DESC LIMIT 3""")
add("fits", """SELECT 'all' AS fit_id, 'all' AS fit_kind, user_id, NULL::INT AS held_out_fold, NULL::DATE AS test_week_start FROM outc UNION ALL SELECT 'xf' || k, 'crossfit', user_id, k, NULL FROM outc, range(5) r(k) WHERE cf_fold <> k
    UNION ALL SELECT w.fit_id, 'out_of_time', user_id, NULL, w.test_week_start FROM outc JOIN weeks w ON signup_week < w.test_week_start UNION ALL SELECT w.fit_id || '_xf' || k, 'out_of_time_crossfit', user_id, k, w.test_week_start FROM outc JOIN weeks w ON signup_week < w.test_week_start, range(5) r(k) WHERE cf_fold <> k""")


@query("ml_3_oot_weeks", sql("SELECT * FROM weeks"))
def _(s, d):
    return S.oot_weeks(model(s, d)[1], P)


@query("ml_4_fit_sets", sql("SELECT * FROM fits"))
def _(s, d):
    _f, o, w = model(s, d)
    return S.into_fits(o.select("user_id", "cf_fold", "signup_week"), w, P).select("fit_id", "fit_kind", "user_id", "held_out_fold", "test_week_start")


add("seg_rate", """SELECT f.fit_id, p.segment, p.prior AS prior_rate, coalesce(o.n, 0) AS matured_users, coalesce(o.x, 0) AS conversions, round((coalesce(o.x, 0) + 200.0::DOUBLE * p.prior) / (coalesce(o.n, 0) + 200.0::DOUBLE), 9) AS p_convert
    FROM (SELECT DISTINCT fit_id FROM fits) f, (VALUES ('not_activated', 0.005::DOUBLE), ('activated', 0.05::DOUBLE), ('activated_depleted', 0.08::DOUBLE)) p(segment, prior)
    LEFT JOIN (SELECT fit_id, segment, count(*) AS n, count(*) FILTER (WHERE conv24) AS x FROM fits JOIN outc USING (user_id) WHERE mature AND segment <> 'paid_24h' GROUP BY 1, 2) o ON o.fit_id = f.fit_id AND o.segment = p.segment""")


@query("ml_5_segment_rates", sql("SELECT * FROM seg_rate"))
def _(s, d):
    _f, o, w = model(s, d)
    return S.segment_rates(o, w, P)


add("conv_val", """SELECT f.fit_id, coalesce(c.n, 0) AS matured_converters, round((coalesce(c.rev / 100.0::DOUBLE, 0) + 5.0::DOUBLE * 110) / (coalesce(c.n, 0) + 5.0::DOUBLE), 9) AS revenue_per_converter, round((coalesce(c.ch, 0) + 5.0::DOUBLE * 2) / (coalesce(c.n, 0) + 5.0::DOUBLE), 9) AS charges_per_converter,
    round((coalesce(c.pc, 0) + 5.0::DOUBLE * 8000) / (coalesce(c.n, 0) + 5.0::DOUBLE), 9) AS paid_credits_per_converter, round((coalesce(u.pv, 0) + 20000.0::DOUBLE * 0.85::DOUBLE) / (coalesce(u.pc, 0) + 20000.0::DOUBLE), 9) AS paid_video_credit_share,
    round((coalesce(u.tm / 1000000.0::DOUBLE, 0) + 20000.0::DOUBLE * 0.002::DOUBLE) / (coalesce(u.tc, 0) + 20000.0::DOUBLE), 9) AS trial_cost_per_credit FROM (SELECT DISTINCT fit_id FROM fits) f
    LEFT JOIN (SELECT fit_id, count(*) AS n, sum(rev) AS rev, sum(charges) AS ch, sum(paid_credits) AS pc FROM fits JOIN outc USING (user_id) WHERE complete AND convh AND segment <> 'paid_24h' GROUP BY 1) c USING (fit_id)
    LEFT JOIN (SELECT fit_id, sum(CASE WHEN credit_field <> 'trial_credit_balance' THEN credits ELSE 0 END) AS pc, sum(CASE WHEN credit_field <> 'trial_credit_balance' AND media_type = 'video' THEN credits ELSE 0 END) AS pv,
        sum(CASE WHEN credit_field = 'trial_credit_balance' THEN credits ELSE 0 END) AS tc, sum(CASE WHEN credit_field = 'trial_credit_balance' THEN cost_cents * 10000 ELSE 0 END) AS tm FROM fits JOIN usage USING (user_id) WHERE NOT is_failed GROUP BY 1) u USING (fit_id)""")


@query("ml_6_converter_value", sql("SELECT * FROM conv_val"))
def _(s, d):
    _f, o, w = model(s, d)
    return S.converter_value(o, usage(s, d), w, P)


add("paid_use", "SELECT fit_id, media_type, CASE WHEN media_type = 'image' THEN arm_0 ELSE arm_1 END AS arm, credits, cost_cents * 10000 AS micros FROM fits JOIN outc USING (user_id) JOIN usage USING (user_id) WHERE NOT is_failed AND credit_field <> 'trial_credit_balance'")
add("arm_grid", "SELECT DISTINCT fit_id, i AS flag_index, 'arm_' || a AS arm, CASE i WHEN 0 THEN 'image' ELSE 'video' END AS media_type FROM fits, range(2) r(i), range(3) q(a)")
add("cpc", """SELECT g.*, coalesce(a.c, 0) AS measured_credits, round(coalesce(p.m / 1000000.0::DOUBLE / p.c, 0.002::DOUBLE), 9) AS pooled_cost_per_credit,
    round((coalesce(a.m / 1000000.0::DOUBLE, 0) + 20000.0::DOUBLE * coalesce(p.m / 1000000.0::DOUBLE / p.c, 0.002::DOUBLE)) / (coalesce(a.c, 0) + 20000.0::DOUBLE), 9) AS cost_per_credit FROM arm_grid g
    LEFT JOIN (SELECT fit_id, media_type, arm, sum(credits) AS c, sum(micros) AS m FROM paid_use GROUP BY 1, 2, 3) a ON a.fit_id = g.fit_id AND a.media_type = g.media_type AND a.arm = g.arm
    LEFT JOIN (SELECT fit_id, media_type, sum(credits) AS c, sum(micros) AS m FROM paid_use GROUP BY 1, 2) p ON p.fit_id = g.fit_id AND p.media_type = g.media_type""")


@query("ml_7_cost_per_credit", sql("SELECT fit_id, flag_index, arm, media_type, measured_credits, pooled_cost_per_credit, cost_per_credit FROM cpc"))
def _(s, d):
    _f, o, w = model(s, d)
    return S.cost_per_credit(o, usage(s, d), w, ARMS, P)


add("mult_base", "SELECT f.fit_id, o.*, r.p_convert AS pc, i AS flag_index, CASE i WHEN 0 THEN arm_0 ELSE arm_1 END AS arm FROM fits f JOIN outc o USING (user_id) JOIN seg_rate r ON r.fit_id = f.fit_id AND r.segment = o.segment, range(2) q(i) WHERE mature")
add("mult_stat", """SELECT a.*, ln((a.x + 0.5::DOUBLE) / (a.e + 0.5::DOUBLE)) AS lr, 1.0::DOUBLE / (a.x + 0.5::DOUBLE) AS sv, CASE WHEN a.x > 0 AND a.mv > 0 AND p.pm > 0 THEN ln(a.mv / p.pm) END AS vlr,
    CASE WHEN a.x > 0 AND p.pm > 0 THEN power(coalesce(p.sd, 0) / p.pm, 2) / a.x END AS vsv FROM (SELECT fit_id, flag_index, arm, count(*) AS n, count(*) FILTER (WHERE conv24) AS x, sum(pc) AS e, avg(first_minor) / 100 AS mv FROM mult_base WHERE arm IS NOT NULL GROUP BY 1, 2, 3) a
    LEFT JOIN (SELECT fit_id, avg(first_minor) / 100 AS pm, stddev_samp(first_minor) / 100 AS sd FROM mult_base WHERE flag_index = 0 AND conv24 GROUP BY 1) p USING (fit_id)""")
add("mult", """SELECT s.fit_id, s.flag_index, s.arm, s.n AS matured_users, s.x AS observed_conversions, s.e AS expected_conversions, b.t2, b.t2 / (b.t2 + s.sv) AS w, round(exp(b.t2 / (b.t2 + s.sv) * s.lr), 9) AS conversion_multiplier, round(coalesce(exp(b.t2v / nullif(b.t2v + s.vsv, 0) * s.vlr), 1), 9) AS value_multiplier
    FROM mult_stat s JOIN (SELECT fit_id, flag_index, greatest(coalesce(var_samp(lr) - avg(sv), 0), 0) AS t2, greatest(coalesce(var_samp(vlr) - avg(vsv), 0), 0) AS t2v FROM mult_stat GROUP BY 1, 2) b USING (fit_id, flag_index)""")


@query("ml_8_arm_multipliers", sql("SELECT fit_id, flag_index, arm, matured_users, observed_conversions, round(expected_conversions, 6) AS expected_conversions, round(t2, 6) AS tau2, round(conversion_multiplier, 6) AS conversion_multiplier, round(value_multiplier, 6) AS value_multiplier FROM mult"))
def _(s, d):
    _f, o, w = model(s, d)
    m = S.arm_multipliers(o, S.segment_rates(o, w, P), w, P)
    return m.select("fit_id", "flag_index", "arm", "matured_users", "observed_conversions", *[F.round(c, 6).alias(c) for c in ("expected_conversions", "tau2", "conversion_multiplier", "value_multiplier")])


@shared
def scores(s, d):
    f, o, w = model(s, d)
    rates = S.segment_rates(o, w, P)
    plan = D.seed_from(s, PLAN_CREDITS, "plan_tier string, plan_monthly_credits bigint")
    x = S.scoring_rows(f, w)
    return stage(S.score_24h(x, rates, S.arm_multipliers(o, rates, w, P), S.converter_value(o, usage(s, d), w, P), S.cost_per_credit(o, usage(s, d), w, ARMS, P), plan, PACK_CREDITS, P))


add("plan_credits", "SELECT a AS plan_tier, b AS credits FROM (VALUES ('essential', 4000), ('advanced', 12000), ('infinite', 24000), ('wonder', 60000)) t(a, b)")
add("score_rows", """SELECT 'serve' AS purpose, 'xf' || cf_fold AS fit_id, * FROM feat UNION ALL SELECT 'oot_test', w.fit_id, f.* FROM feat f JOIN weeks w ON f.signup_week = w.test_week_start
    UNION ALL SELECT 'oot_train_crossfit', w.fit_id || '_xf' || f.cf_fold, f.* FROM feat f JOIN weeks w ON f.signup_week < w.test_week_start""")
add("score_in", """SELECT r.*, CASE WHEN r.paid_within_24h THEN 'paid_24h' WHEN NOT r.activated_24h THEN 'not_activated' WHEN r.trial_depleted_24h THEN 'activated_depleted' ELSE 'activated' END AS seg, v.revenue_per_converter, v.charges_per_converter, v.paid_credits_per_converter,
    v.trial_cost_per_credit, v.paid_video_credit_share AS vs, coalesce(ci.cost_per_credit, (SELECT max(pooled_cost_per_credit) FROM cpc z WHERE z.fit_id = r.fit_id AND z.media_type = 'image')) AS ri, coalesce(cv.cost_per_credit, (SELECT max(pooled_cost_per_credit) FROM cpc z WHERE z.fit_id = r.fit_id AND z.media_type = 'video')) AS rv,
    coalesce(mi.conversion_multiplier, 1) * coalesce(mv.conversion_multiplier, 1) AS cm, coalesce(mi.value_multiplier, 1) * coalesce(mv.value_multiplier, 1) AS vm, pl.credits AS plan_credits, coalesce(r.fp_name = 'purchase_one_time_pack', false) AS pack, coalesce(r.billing_interval = 'month', false) AS monthly, 1.0::DOUBLE + 0.8::DOUBLE + 0.8::DOUBLE * 0.8::DOUBLE AS mo
    FROM score_rows r LEFT JOIN conv_val v ON v.fit_id = r.fit_id LEFT JOIN cpc ci ON ci.fit_id = r.fit_id AND ci.flag_index = 0 AND ci.arm = r.arm_0 LEFT JOIN cpc cv ON cv.fit_id = r.fit_id AND cv.flag_index = 1 AND cv.arm = r.arm_1
    LEFT JOIN mult mi ON mi.fit_id = r.fit_id AND mi.flag_index = 0 AND mi.arm = r.arm_0 LEFT JOIN mult mv ON mv.fit_id = r.fit_id AND mv.flag_index = 1 AND mv.arm = r.arm_1 LEFT JOIN plan_credits pl ON pl.plan_tier = r.plan_tier""")


def _variant(v, conv, val):
    lift = f"least(coalesce(p.p_convert * {conv}, 1), 1)"
    return f"""CASE WHEN i.paid_within_24h THEN 1.0::DOUBLE ELSE {lift} END AS {v}_p,
      coalesce(CASE WHEN i.paid_within_24h THEN CASE WHEN NOT i.pack AND i.monthly THEN i.fp_minor / 100.0::DOUBLE * i.mo ELSE i.fp_minor / 100.0::DOUBLE END ELSE {lift} * i.revenue_per_converter * {val} END, 0) AS {v}_rev,
      coalesce(CASE WHEN i.paid_within_24h THEN CASE WHEN NOT i.pack AND i.monthly THEN i.mo ELSE 1 END ELSE {lift} * i.charges_per_converter END, 0) AS {v}_chg,
      coalesce(CASE WHEN i.paid_within_24h THEN CASE WHEN i.pack THEN 5000 * 0.4::DOUBLE WHEN i.monthly THEN i.plan_credits * 0.4::DOUBLE * i.mo ELSE i.plan_credits * 0.4::DOUBLE * 3 END ELSE {lift} * i.paid_credits_per_converter * {val} END, 0) AS {v}_cred"""


add("score_mid", f"""SELECT i.*, i.cost_24h_micros / 1000000.0::DOUBLE + coalesce(i.trial_left, 0) * 0.5::DOUBLE * i.trial_cost_per_credit AS base, i.vs * i.rv + (1 - i.vs) * i.ri AS mix, {_variant("sig", "1.0::DOUBLE", "1.0::DOUBLE")}, {_variant("cal", "i.cm", "i.vm")}
    FROM score_in i LEFT JOIN seg_rate p ON p.fit_id = i.fit_id AND p.segment = i.seg""")
add("score_out", """SELECT *, r1 - c1 - f1 - k1 AS sig_profit, r2 - c2 - f2 - k2 AS cal_profit FROM (SELECT *, """ + ", ".join(
    f"round({v}_rev, 6) AS r{n}, round(base + {v}_cred * mix, 6) AS c{n}, round({v}_rev * 0.036::DOUBLE + {v}_chg * 0.3::DOUBLE + CASE WHEN acquisition_channel = 'affiliate' THEN {v}_rev * 0.2::DOUBLE ELSE 0 END, 6) AS f{n}, round({v}_rev * 0.025::DOUBLE + {v}_chg * 0.005::DOUBLE * 15, 6) AS k{n}"
    for n, v in ((1, "sig"), (2, "cal"))) + " FROM score_mid)")
SCORE_COLS = ("predicted_revenue", "predicted_generation_cost", "predicted_fees", "predicted_refund_risk", "predicted_profit", "predicted_profit_with_arm_terms", "unconditional_cost", "p_convert")


@query("ml_9_score_24h", sql("""SELECT purpose, fit_id, user_id, seg AS segment, r1 AS predicted_revenue, c1 AS predicted_generation_cost, f1 AS predicted_fees, k1 AS predicted_refund_risk, round(sig_profit, 6) AS predicted_profit,
    round(cal_profit, 6) AS predicted_profit_with_arm_terms, round(base, 6) AS unconditional_cost, round(sig_p, 6) AS p_convert FROM score_out"""))
def _(s, d):
    return scores(s, d).select("purpose", "fit_id", "user_id", "segment", *SCORE_COLS)


@query("ml_10_served_scores", sql("""SELECT user_id, 7 AS horizon_days, round(sig_profit, 6) AS predicted_profit, 'v0.2-heuristic-eb-xf' AS model_version, seg AS snapshot_segment, fit_id AS snapshot_fit FROM score_out WHERE purpose = 'serve'"""))
def _(s, d):
    x = S.served_scores(scores(s, d), P)
    return x.select("user_id", "horizon_days", "predicted_profit", "model_version", C.json_str("features_snapshot", "segment").alias("snapshot_segment"), C.json_str("features_snapshot", "fit_id").alias("snapshot_fit"))


@query("src_10_external_scores", sql("SELECT user_id, cf_fold + 1.5::DOUBLE AS predicted_profit, 'trained-1' AS model_version FROM feat"))
def _(s, d):
    f = features(s, d).select("user_id", *[F.lit(0.5).alias(c) for c in ("predicted_revenue", "predicted_generation_cost", "predicted_fees", "predicted_refund_risk")], (F.col("cf_fold") + 1.5).alias("predicted_profit"), F.lit("trained-1").alias("model_version"))
    return S.served_scores(scores(s, d), P, f).select("user_id", "predicted_profit", "model_version")


@query("prj_21_feature_snapshot", sql("SELECT user_id, seg AS segment, generations_24h, arm_0, paid_within_24h FROM score_out WHERE purpose = 'serve'"))
def _(s, d):
    x = S.served_scores(scores(s, d), P).select("user_id", F.from_json("features_snapshot", "segment string, generations_24h bigint, arm_0 string, paid_within_24h boolean").alias("j"))
    return x.select("user_id", "j.*")


@query("ml_17_parameters", sql("SELECT count(*) AS fitted, 1 AS refs FROM seg_rate"))
def _(s, d):
    _f, o, w = model(s, d)
    x = S.current_parameters(s, P, S.segment_rates(o, w, P), S.converter_value(o, usage(s, d), w, P))
    return x.agg(C.tally(F.col("name").startswith("p_convert.")).alias("fitted"), F.countDistinct("fitted_params_ref").alias("refs"))

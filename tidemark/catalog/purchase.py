"""Purchase value queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.cte import add, sql
from tidemark.catalog.registry import query, shared
from tidemark.catalog.scores import ARMS, PACK_CREDITS, P, events, exposed, model, usage
from tidemark.functions import columns as C
from tidemark.plans import purchase_value as V
from tidemark.plans import scores_24h as S
from tidemark.sinks.tables import stage
from tidemark.sources import driver_tables as D

CATALOG = [(t, i, 10.0 * (n + 1) * (1 if i == "month" else 10), 4000 * (n + 1)) for n, t in enumerate(D.TIERS) for i in ("month", "year")]


@shared
def feats(s, d):
    e = events(s, d)
    countries = e.where("k % 3 = 0").groupBy("user_id").agg(F.min("ts").alias("country_known_at"), F.min(F.struct("ts", D.pick(F.col("k") % 4, V.BUCKETS).alias("b")))["b"].alias("country_bucket"))
    cat = D.seed_from(s, CATALOG, "plan_tier string, billing_interval string, list_price double, plan_monthly_credits bigint")
    weeks = D.signup(s, e).select("user_id", C.week_start("signup_at").alias("signup_week"))
    f = V.purchase_features(D.purchase(s, e), usage(s, d), exposed(s, d), D.click(s, e), D.utm(s, e), countries, cat, D.FLAGS, D.CLICK_PLATFORMS, D.UTM_KEYS, P)
    return stage(f.join(weeks, "user_id", "left"))


@shared
def outs(s, d):
    e = events(s, d)
    return stage(V.purchase_outcomes(feats(s, d), D.purchase(s, e), D.adjustment(s, e), usage(s, d), P, renewal_days=5))


@shared
def known(s, d):
    return stage(V.with_outcomes(feats(s, d), outs(s, d)))


add("pfeat", """SELECT p.*, CASE WHEN p.event_name = 'purchase_one_time_pack' OR p.billing_interval IS NULL THEN 'pack' WHEN p.billing_interval = 'year' THEN 'annual' ELSE 'monthly' END AS purchase_kind, a.acquisition_channel,
    coalesce(CASE WHEN c.at2 <= p.occurred_at THEN c.b END, 'unknown') AS country_bucket, CAST('0x' || substr(sha256(CAST(p.user_id AS VARCHAR)), 1, 4) AS BIGINT) % 5 AS cf_fold, CAST(date_trunc('week', s.signup_at) AS DATE) AS signup_week
    FROM purchase p LEFT JOIN acquisition a ON a.anchor_key = p.event_id LEFT JOIN signup s ON s.user_id = p.user_id
    LEFT JOIN (SELECT user_id, min(ts) AS at2, arg_min((['us', 'tier1', 'rest', 'unknown'])[k % 4 + 1], ts) AS b FROM ev WHERE k % 3 = 0 GROUP BY 1) c ON c.user_id = p.user_id""")


@query("ml_11_purchase_features", sql("""SELECT p.event_id, p.purchase_kind, p.acquisition_channel, p.country_bucket, coalesce(u.n, 0) AS generations_before, coalesce(u.c, 0) AS credits_before, coalesce(u.v, 0) AS video_credits_before, coalesce(u.m, 0) AS cost_before_micros,
    (SELECT count(*) FROM purchase b WHERE b.user_id = p.user_id AND (b.occurred_at < p.occurred_at OR (b.occurred_at = p.occurred_at AND b.event_id < p.event_id))) AS previous_purchases,
    (SELECT arm FROM exposure x WHERE x.user_id = p.user_id AND x.flag_key LIKE '%image' AND x.first_exposed_at <= p.occurred_at) AS arm_0 FROM pfeat p
    LEFT JOIN (SELECT p.event_id, count(*) AS n, sum(g.credits) AS c, sum(CASE WHEN g.media_type = 'video' THEN g.credits ELSE 0 END) AS v, sum(g.cost_cents * 10000) AS m FROM purchase p JOIN usage g ON g.user_id = p.user_id AND g.created_at < p.occurred_at AND NOT g.is_failed GROUP BY 1) u USING (event_id)"""))
def _(s, d):
    return feats(s, d).select("event_id", "purchase_kind", "acquisition_channel", "country_bucket", "generations_before", "credits_before", "video_credits_before", "cost_before_micros", "previous_purchases", "arm_0")


add("pout", """SELECT p.event_id, p.user_id, p.plan_tier, p.country_bucket, p.cf_fold, p.signup_week, p.revenue_minor AS own, p.occurred_at + INTERVAL 7 DAY <= TIMESTAMP '2024-01-31' AS complete, m.rev, m.n, coalesce(a.adj, 0) AS adj, coalesce(a.cb, 0) AS cb, coalesce(g.cost, 0) AS cost,
    p.purchase_kind = 'monthly' AND p.event_name IN ('purchase_first', 'purchase_renewal', 'purchase_upgrade') AS opp, p.occurred_at + INTERVAL 5 DAY <= TIMESTAMP '2024-01-31' AS obs,
    EXISTS (SELECT 1 FROM purchase r WHERE r.subscription_id = p.subscription_id AND r.event_name = 'purchase_renewal' AND r.occurred_at > p.occurred_at AND r.occurred_at <= p.occurred_at + INTERVAL 5 DAY) AS renewed, p.purchase_kind
    FROM pfeat p JOIN (SELECT a.event_id, sum(b.revenue_minor) AS rev, count(*) AS n FROM purchase a JOIN purchase b ON b.user_id = a.user_id AND b.occurred_at >= a.occurred_at AND b.occurred_at < a.occurred_at + INTERVAL 7 DAY GROUP BY 1) m USING (event_id)
    LEFT JOIN (SELECT a.event_id, sum(j.cash_minor) AS adj, count(*) FILTER (WHERE j.event_name = 'chargeback') AS cb FROM purchase a JOIN purchase b ON b.user_id = a.user_id AND b.occurred_at >= a.occurred_at AND b.occurred_at < a.occurred_at + INTERVAL 7 DAY
        JOIN adjustment j ON j.adjusts_event_id = b.event_id AND j.occurred_at < a.occurred_at + INTERVAL 7 DAY GROUP BY 1) a USING (event_id)
    LEFT JOIN (SELECT a.event_id, sum(u.cost_cents * 10000) AS cost FROM purchase a JOIN usage u ON u.user_id = a.user_id AND u.created_at >= a.occurred_at AND u.created_at < a.occurred_at + INTERVAL 7 DAY GROUP BY 1) g USING (event_id)""")


@query("ml_12_purchase_outcomes", sql("SELECT event_id, complete AS is_horizon_complete, rev AS revenue_minor, n AS charges, adj AS adjusted_minor, cb AS chargebacks, cost AS cost_micros, opp AS is_renewal_opportunity, obs AS is_renewal_observable, renewed AS renewed_in_time FROM pout"))
def _(s, d):
    return outs(s, d).select("event_id", "is_horizon_complete", "revenue_minor", "charges", "adjusted_minor", "chargebacks", "cost_micros", "is_renewal_opportunity", "is_renewal_observable", "renewed_in_time")


def _fits(s, d):
    _f, o, w = model(s, d)
    return S.fit_ids(o, w, P), w


add("fit_cells", """SELECT DISTINCT c.cf_fold, c.signup_week, f.fit_id FROM (SELECT DISTINCT cf_fold, signup_week FROM pout WHERE signup_week IS NOT NULL) c JOIN (SELECT DISTINCT fit_id, held_out_fold, test_week_start FROM fits) f
    ON (f.held_out_fold IS NULL OR f.held_out_fold <> c.cf_fold) AND (f.test_week_start IS NULL OR c.signup_week < f.test_week_start)""")
add("opp", "SELECT f.fit_id, p.plan_tier, p.country_bucket, p.renewed FROM pout p JOIN fit_cells f ON f.cf_fold = p.cf_fold AND f.signup_week = p.signup_week WHERE p.opp AND p.obs")


add("renewal", """SELECT g.fit_id, g.plan_tier, g.b AS country_bucket, coalesce(c.n, 0) AS opportunities, coalesce(c.x, 0) AS renewals, round(t.p, 9) AS tier_renewal_prob, round((coalesce(c.x, 0) + 20.0::DOUBLE * t.p) / (coalesce(c.n, 0) + 20.0::DOUBLE), 9) AS renewal_prob
    FROM (SELECT DISTINCT fit_id, plan_tier, b FROM fits, (VALUES ('essential'), ('advanced'), ('infinite'), ('wonder')) v(plan_tier), (VALUES ('us'), ('tier1'), ('rest'), ('unknown')) w(b)) g
    JOIN (SELECT h.fit_id, h.plan_tier, (coalesce(sum(CASE WHEN o.renewed THEN 1 END), 0) + 10.0::DOUBLE * 0.8::DOUBLE) / (count(o.renewed) + 10.0::DOUBLE) AS p FROM (SELECT DISTINCT fit_id, plan_tier FROM fits, (VALUES ('essential'), ('advanced'), ('infinite'), ('wonder')) v(plan_tier)) h
        LEFT JOIN opp o ON o.fit_id = h.fit_id AND o.plan_tier = h.plan_tier GROUP BY 1, 2) t ON t.fit_id = g.fit_id AND t.plan_tier = g.plan_tier
    LEFT JOIN (SELECT fit_id, plan_tier, country_bucket, count(*) AS n, count(*) FILTER (WHERE renewed) AS x FROM opp GROUP BY 1, 2, 3) c ON c.fit_id = g.fit_id AND c.plan_tier = g.plan_tier AND c.country_bucket = g.b""")


@query("ml_13_renewal_rates", sql("SELECT * FROM renewal"))
def _(s, d):
    fits, w = _fits(s, d)
    return V.renewal_rates(V.with_outcomes(feats(s, d), outs(s, d)), fits, w, D.TIERS, P)


add("vpaid", """SELECT user_id, cf_fold, signup_week, least(CASE purchase_kind WHEN 'annual' THEN 12.0::DOUBLE ELSE 1.0::DOUBLE END, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(occurred_at)) / 1e6::DOUBLE / (30.4375::DOUBLE * 86400)) AS m,
    4000 * list_position([""" + ", ".join(f"'{t}'" for t in D.TIERS) + """], plan_tier) AS plan_credits FROM pfeat WHERE event_name IN ('purchase_first', 'purchase_renewal') AND purchase_kind IN ('monthly', 'annual')""")
add("vburn", """SELECT user_id, sum(CASE WHEN credit_field = 'subscription_monthly_credit' THEN credits ELSE 0 END) AS sub_c, sum(CASE WHEN credit_field = 'one_time_pack_credit' THEN credits ELSE 0 END) AS pack_c FROM usage WHERE NOT is_failed GROUP BY 1""")
add("vuser", """SELECT u.cf_fold, u.signup_week, b.sub_c, CASE WHEN u.m >= 1 THEN b.sub_c / u.m END AS b FROM (SELECT user_id, cf_fold, signup_week, sum(m) AS m FROM vpaid GROUP BY 1, 2, 3) u LEFT JOIN vburn b USING (user_id)""")
add("vparam", """SELECT f.fit_id, coalesce(m.months, 0) AS observed_months, (coalesce(a.addon, 0) + 50.0::DOUBLE * 1) / (coalesce(m.months, 0) + 50.0::DOUBLE) AS addon_per_month,
    (coalesce(u.sub_credits, 0) + 40000.0::DOUBLE * 0.4::DOUBLE) / (coalesce(m.capacity, 0) + 40000.0::DOUBLE) AS plan_utilization,
    CASE WHEN coalesce(u.bn, 0) >= 5 AND u.bs > 0 THEN sqrt(greatest((u.bq - u.bs * u.bs / u.bn) / (u.bn - 1), 0)) / (u.bs / u.bn) ELSE 0.6::DOUBLE END AS burn_cv, coalesce(k.packs, 0) AS packs,
    (coalesce(w.pack_used, 0) + 40000.0::DOUBLE * 0.4::DOUBLE) / (coalesce(k.packs, 0) * 5000.0::DOUBLE + 40000.0::DOUBLE) AS pack_utilization, (coalesce(k.future, 0) + 10.0::DOUBLE * 5) / (coalesce(k.ripe, 0) + 10.0::DOUBLE) AS pack_future_revenue,
    CASE WHEN coalesce(k.ripe, 0) >= 10 THEN k.q90 ELSE 30 END AS pack_future_q90, coalesce(g.chg, 0) AS observed_charges, (coalesce(g.rf, 0) + 200.0::DOUBLE * 0.02::DOUBLE) / (coalesce(g.chg, 0) + 200.0::DOUBLE) AS refund_rate,
    (coalesce(g.cb, 0) + 200.0::DOUBLE * 0.005::DOUBLE) / (coalesce(g.chg, 0) + 200.0::DOUBLE) AS chargeback_rate
    FROM (SELECT DISTINCT fit_id FROM fits) f
    LEFT JOIN (SELECT c.fit_id, sum(m) AS months, sum(m * plan_credits) AS capacity FROM vpaid JOIN fit_cells c USING (cf_fold, signup_week) GROUP BY 1) m USING (fit_id)
    LEFT JOIN (SELECT c.fit_id, sum(revenue_minor) / 100.0::DOUBLE AS addon FROM pfeat JOIN fit_cells c USING (cf_fold, signup_week) WHERE event_name IN ('purchase_add_on', 'purchase_upgrade') GROUP BY 1) a USING (fit_id)
    LEFT JOIN (SELECT c.fit_id, sum(coalesce(sub_c, 0))::DOUBLE AS sub_credits, count(b) AS bn, sum(b) AS bs, sum(b * b) AS bq FROM vuser JOIN fit_cells c USING (cf_fold, signup_week) GROUP BY 1) u USING (fit_id)
    LEFT JOIN (SELECT c.fit_id, count(*) AS packs, count(*) FILTER (WHERE complete) AS ripe, sum((rev - own) / 100.0::DOUBLE) FILTER (WHERE complete) AS future, quantile_cont(CASE WHEN complete THEN (rev - own) / 100.0::DOUBLE END, 0.9) AS q90
        FROM pout p JOIN fit_cells c USING (cf_fold, signup_week) WHERE purchase_kind = 'pack' GROUP BY 1) k USING (fit_id)
    LEFT JOIN (SELECT c.fit_id, sum(b.pack_c)::DOUBLE AS pack_used FROM (SELECT DISTINCT user_id, cf_fold, signup_week FROM pfeat WHERE purchase_kind = 'pack') x JOIN vburn b USING (user_id) JOIN fit_cells c USING (cf_fold, signup_week) GROUP BY 1) w USING (fit_id)
    LEFT JOIN (SELECT c.fit_id, count(*) AS chg, sum(coalesce(j.rf, 0)) AS rf, sum(coalesce(j.cb, 0)) AS cb FROM pfeat p LEFT JOIN (SELECT adjusts_event_id AS event_id, count(*) FILTER (WHERE event_name = 'refund') AS rf, count(*) FILTER (WHERE event_name = 'chargeback') AS cb FROM adjustment GROUP BY 1) j USING (event_id)
        JOIN fit_cells c USING (cf_fold, signup_week) WHERE p.occurred_at + INTERVAL 30 DAY <= TIMESTAMP '2024-01-31' GROUP BY 1) g USING (fit_id)""")
VALUE_PARAMS = ("observed_months", "addon_per_month", "plan_utilization", "burn_cv", "packs", "pack_utilization", "pack_future_revenue", "pack_future_q90", "observed_charges", "refund_rate", "chargeback_rate")


@query("ml_14_value_params", sql("SELECT fit_id, " + ", ".join(n if n in ("packs", "observed_charges") else f"round({n}, 6) AS {n}" for n in VALUE_PARAMS) + " FROM vparam"))
def _(s, d):
    fits, w = _fits(s, d)
    x = V.value_params(known(s, d), usage(s, d), D.adjustment(s, events(s, d)), fits, w, PACK_CREDITS, P)
    return x.select("fit_id", *[F.col(n) if n in ("packs", "observed_charges") else F.round(n, 6).alias(n) for n in VALUE_PARAMS])


@shared
def scored(s, d):
    _f, o, w = model(s, d)
    fits = S.fit_ids(o, w, P)
    rates = V.renewal_rates(known(s, d), fits, w, D.TIERS, P)
    params = V.value_params(known(s, d), usage(s, d), D.adjustment(s, events(s, d)), fits, w, PACK_CREDITS, P)
    rows = V.scoring_rows(known(s, d), w)
    return stage(V.score_purchase(rows, rates, params, S.converter_value(o, usage(s, d), w, P), S.cost_per_credit(o, usage(s, d), w, ARMS, P), PACK_CREDITS, P))


# what was known at each purchase, in plain range joins
add("vbefore", """SELECT p.event_id, count(*) AS n, sum(g.credits) AS credits, sum(g.cost_cents) / 100.0::DOUBLE AS cost, sum(CASE WHEN g.credit_field <> 'trial_credit_balance' THEN g.credits ELSE 0 END) AS paid_credits
    FROM purchase p JOIN usage g ON g.user_id = p.user_id AND g.created_at < p.occurred_at AND NOT g.is_failed GROUP BY 1""")
add("vmonths", """SELECT p.event_id, count(*) AS months FROM purchase p JOIN purchase b ON b.user_id = p.user_id AND (b.occurred_at, b.event_id) < (p.occurred_at, p.event_id)
    WHERE b.event_name IN ('purchase_first', 'purchase_renewal') AND b.billing_interval = 'month' GROUP BY 1""")
add("varm", """SELECT p.event_id, max(x.arm) FILTER (WHERE x.flag_key LIKE '%image') AS image_arm, max(x.arm) FILTER (WHERE x.flag_key LIKE '%video') AS video_arm FROM purchase p JOIN exposure x ON x.user_id = p.user_id AND x.first_exposed_at <= p.occurred_at GROUP BY 1""")
add("vcatalog", "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{i}', {price}::DOUBLE, {credits})" for t, i, price, credits in CATALOG) + ") v(plan_tier, billing_interval, list_price, plan_credits)")
add("vrow", """SELECT 'serve' AS purpose, 'xf' || cf_fold AS fit_id, event_id FROM pfeat WHERE cf_fold IS NOT NULL
    UNION ALL SELECT 'oot_test', w.fit_id, p.event_id FROM pout p JOIN weeks w ON w.test_week_start = p.signup_week WHERE p.complete""")
add("vrate", """SELECT fit_id, arm, media_type, any_value(cost_per_credit) AS own, any_value(pooled_cost_per_credit) AS pooled FROM cpc GROUP BY 1, 2, 3""")
add("vin", """SELECT r.purpose, r.fit_id, p.event_id, p.user_id, p.occurred_at, p.event_name, p.purchase_kind, p.acquisition_channel, p.country_bucket, p.cf_fold, p.signup_week, p.revenue_minor / 100.0::DOUBLE AS price, coalesce(p.acquisition_channel = 'affiliate', false) AS affiliate,
    CASE WHEN p.purchase_kind = 'monthly' THEN coalesce(q.renewal_prob, 0.8::DOUBLE) ELSE 0::DOUBLE END AS again, c.list_price, coalesce(c.plan_credits, 0) AS plan_credits, coalesce(b.credits, 0) AS used, b.cost, coalesce(b.paid_credits, 0) AS used_paid, coalesce(o.months, 0) AS months,
    v.paid_video_credit_share * coalesce(cv.own, pv.pooled, 0.002::DOUBLE) + (1 - v.paid_video_credit_share) * coalesce(ci.own, pi.pooled, 0.002::DOUBLE) AS arm_cost,
    """ + ", ".join(f"round(m.{c}, 9) AS {c}" for c in ("addon_per_month", "plan_utilization", "burn_cv", "pack_utilization", "pack_future_revenue", "pack_future_q90", "refund_rate", "chargeback_rate")) + """
    FROM vrow r JOIN pfeat p USING (event_id) LEFT JOIN vcatalog c ON c.plan_tier = p.plan_tier AND c.billing_interval = p.billing_interval LEFT JOIN vbefore b ON b.event_id = p.event_id LEFT JOIN vmonths o ON o.event_id = p.event_id LEFT JOIN varm a ON a.event_id = p.event_id
    LEFT JOIN renewal q ON q.fit_id = r.fit_id AND q.plan_tier = p.plan_tier AND q.country_bucket = p.country_bucket LEFT JOIN vparam m ON m.fit_id = r.fit_id LEFT JOIN conv_val v ON v.fit_id = r.fit_id
    LEFT JOIN vrate ci ON ci.fit_id = r.fit_id AND ci.media_type = 'image' AND ci.arm = a.image_arm LEFT JOIN vrate cv ON cv.fit_id = r.fit_id AND cv.media_type = 'video' AND cv.arm = a.video_arm
    LEFT JOIN (SELECT DISTINCT fit_id, media_type, pooled FROM vrate) pi ON pi.fit_id = r.fit_id AND pi.media_type = 'image' LEFT JOIN (SELECT DISTINCT fit_id, media_type, pooled FROM vrate) pv ON pv.fit_id = r.fit_id AND pv.media_type = 'video'""")
# 0, 1 and 2 renewals of a monthly plan have chance 1 - r, r - r^2 and r^2; the other kinds have none
add("vmid", f"""SELECT *, CASE WHEN event_name IN ('purchase_first', 'purchase_renewal') THEN price ELSE coalesce(list_price, price) END AS next_price, again + again * again AS renewals, CASE purchase_kind WHEN 'monthly' THEN 1 + again + again * again WHEN 'annual' THEN {P.horizon_days} / 30.4375::DOUBLE ELSE 0 END AS paid_months,
    (used * coalesce(cost / nullif(used, 0), arm_cost) + 2000.0::DOUBLE * arm_cost) / (used + 2000.0::DOUBLE) AS credit_cost, CASE WHEN months > 0 THEN (used_paid + 2.0::DOUBLE * plan_utilization * plan_credits) / (months + 2.0::DOUBLE) ELSE plan_utilization * plan_credits END AS burn,
    CASE WHEN again <= 0.9::DOUBLE THEN 0 WHEN again * again <= 0.9::DOUBLE THEN 1 ELSE 2 END AS few, CASE WHEN again <= 0.1::DOUBLE THEN 0 WHEN again * again <= 0.1::DOUBLE THEN 1 ELSE 2 END AS many FROM vin""")


def _outcome(k: str, months: str, pack_value: str, cost_factor: str) -> str:
    """Profit of a purchase if it renews k times, as SQL."""
    return f"""(price + next_price * {k} + CASE purchase_kind WHEN 'pack' THEN {pack_value} ELSE addon_per_month * {months} END) * (1 - 0.036::DOUBLE - CASE WHEN affiliate THEN 0.2::DOUBLE ELSE 0 END - refund_rate - chargeback_rate)
    - (1 + {k}) * (0.3::DOUBLE + 15.0::DOUBLE * chargeback_rate) - CASE purchase_kind WHEN 'pack' THEN {PACK_CREDITS}::DOUBLE * pack_utilization ELSE burn * {months} END * credit_cost * {cost_factor}"""


_YEAR = f"CASE purchase_kind WHEN 'annual' THEN {P.horizon_days} / 30.4375::DOUBLE ELSE 1 + "
add("vsum", f"""SELECT *, price + next_price * renewals + CASE purchase_kind WHEN 'pack' THEN pack_future_revenue ELSE addon_per_month * paid_months END AS income, CASE purchase_kind WHEN 'pack' THEN {PACK_CREDITS}::DOUBLE * pack_utilization ELSE burn * paid_months END * credit_cost AS usage_cost,
    {_outcome("few", _YEAR + "few END", "0", "(1 + 1.2816::DOUBLE * burn_cv)")} AS worst, {_outcome("many", _YEAR + "many END", "pack_future_q90", "greatest(0, 1 - 1.2816::DOUBLE * burn_cv)")} AS best FROM vmid""")
add("vscore", """SELECT *, round(predicted_revenue - predicted_generation_cost - predicted_fees - predicted_refund_risk, 6) AS predicted_profit FROM (SELECT *, round(income, 6) AS predicted_revenue, round(usage_cost, 6) AS predicted_generation_cost,
    round(income * (0.036::DOUBLE + CASE WHEN affiliate THEN 0.2::DOUBLE ELSE 0 END) + (1 + renewals) * (0.3::DOUBLE + 15.0::DOUBLE * chargeback_rate), 6) AS predicted_fees, round(income * (refund_rate + chargeback_rate), 6) AS predicted_refund_risk FROM vsum)""")
add("vfinal", "SELECT *, round(least(worst, predicted_profit), 6) AS interval_low, round(greatest(best, predicted_profit), 6) AS interval_high FROM vscore")
AMOUNTS = ("predicted_revenue", "predicted_generation_cost", "predicted_fees", "predicted_refund_risk", "predicted_profit", "interval_low", "interval_high")


def shown():
    """The amounts as scored (six decimals), without a negative zero."""
    return [(F.col(c) + 0.0).alias(c) for c in AMOUNTS]


@query("ml_15_score_purchase", sql("SELECT purpose, fit_id, purchase_kind, count(*) AS n, count(*) FILTER (WHERE interval_low < predicted_profit AND predicted_profit < interval_high) AS strictly_inside, count(*) FILTER (WHERE predicted_profit < 0) AS losses, "
    + ", ".join(f"round(sum(CAST({c} AS DECIMAL(18, 6)))::DOUBLE, 2) + 0.0 AS {c}" for c in AMOUNTS) + " FROM vfinal GROUP BY 1, 2, 3"))
def _(s, d):
    profit = F.col("predicted_profit")
    return scored(s, d).groupBy("purpose", "fit_id", "purchase_kind").agg(
        F.count(F.lit(1)).alias("n"), C.tally((F.col("interval_low") < profit) & (profit < F.col("interval_high"))).alias("strictly_inside"), C.tally(profit < 0).alias("losses"),
        *[(F.round(F.sum(F.col(c).cast("decimal(18,6)")).cast("double"), 2) + 0.0).alias(c) for c in AMOUNTS])


@query("ml_15_score_rows", sql("SELECT purpose, fit_id, event_id, purchase_kind, " + ", ".join(f"{c} + 0.0 AS {c}" for c in AMOUNTS) + " FROM vfinal"))
def _(s, d):
    return scored(s, d).select("purpose", "fit_id", "event_id", "purchase_kind", *shown())


@query("ml_16_served_values", sql(f"""SELECT event_id, user_id, occurred_at, event_name, purchase_kind, acquisition_channel, country_bucket, fit_id, cf_fold, signup_week, {P.horizon_days} AS horizon_days, '{P.pvs_model_version}' AS model_version,
    greatest(predicted_profit, 0) + 0.0 AS platform_value, """ + ", ".join(f"{c} + 0.0 AS {c}" for c in AMOUNTS) + " FROM vfinal WHERE purpose = 'serve' AND predicted_profit IS NOT NULL"))
def _(s, d):
    x = V.served_values(scored(s, d), P)
    return x.select("event_id", "user_id", "occurred_at", "event_name", "purchase_kind", "acquisition_channel", "country_bucket", "fit_id", "cf_fold", "signup_week", "horizon_days", "model_version", (F.col("platform_value") + 0.0).alias("platform_value"), *shown())

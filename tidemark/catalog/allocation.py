"""Daily-statistics queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tidemark.catalog.cte import add, sql
from tidemark.catalog.experiment import LOG, LOG_DDL, P, daily
from tidemark.catalog.registry import query
from tidemark.catalog.scores import usage
from tidemark.functions import columns as C
from tidemark.plans import allocation as A
from tidemark.plans import experiment as E
from tidemark.sources import driver_tables as D

RUN = date(2024, 1, 31)
TARGETS = [{"name": "us_or_tier1", "country_bucket": ("us", "tier1"), "device": ("desktop",)}, {"name": "phones", "device": ("mobile",)}, {"name": "rest"}]

def score_moments():
    """Count, sum and sum of squares of the score in a daily row."""
    return F.col("scored_users"), F.col("sum_predicted_profit"), F.col("sum_sq_predicted_profit")



def rows(s, d):
    return A.route(A.aged(daily(s, d), RUN, 60, 14.0), TARGETS)


def log(s, d):
    return A.expand_log(E.allocation_log(s, D.seed_from(s, LOG, LOG_DDL)), date(2023, 12, 31), RUN)


add("aged", """SELECT *, CASE WHEN country_bucket IN ('us', 'tier1') AND device = 'desktop' THEN 'us_or_tier1' WHEN device = 'mobile' THEN 'phones' ELSE 'rest' END AS target, power(0.5::DOUBLE, (datediff('day', exposure_date, DATE '2024-01-31') - 1) / 14.0::DOUBLE) AS w FROM daily
    WHERE datediff('day', exposure_date, DATE '2024-01-31') BETWEEN 1 AND 60""")


@query("expt_13_decayed_cells", sql("""SELECT flag_key, arm, country_bucket, device, acquisition_channel, round(sum(w * scored_users), 6) AS n, round(sum(w * sp), 3) AS s, round(coalesce(sum(w * scored_users) FILTER (WHERE allocation_slice = 'holdout'), 0), 6) AS holdout_n, sum(exposed_users) AS exposed_users FROM aged GROUP BY 1, 2, 3, 4, 5"""))
def _(s, d):
    x = A.decayed_cells(daily(s, d), RUN, 60, 14.0)
    return x.select("flag_key", "arm", *A.SEGMENT, F.round("n", 6).alias("n"), F.round("s", 3).alias("s"), F.round("holdout_n", 6).alias("holdout_n"), "exposed_users")


@query("expt_14_routing", sql("SELECT target, country_bucket, device, sum(exposed_users) AS users FROM aged GROUP BY 1, 2, 3"))
def _(s, d):
    return rows(s, d).groupBy("target", "country_bucket", "device").agg(F.sum("exposed_users").alias("users"))


add("logday", """SELECT flag_key, slice AS allocation_slice, arm, CAST(day AS DATE) AS day, sum(prob) AS weight FROM alloc_log, LATERAL (SELECT unnest(generate_series(greatest(valid_from, DATE '2023-12-31'), least(coalesce(valid_to - 1, DATE '2024-01-31'), DATE '2024-01-31'), INTERVAL 1 DAY)) AS day) GROUP BY 1, 2, 3, 4""")


@query("expt_15_expand_log", sql("SELECT x.flag_key, x.allocation_slice, x.arm, x.exposure_date, max(l.weight) AS weight, NULL AS problem FROM daily x JOIN logday l ON l.flag_key = x.flag_key AND l.allocation_slice = x.allocation_slice AND l.arm = x.arm AND l.day = x.exposure_date GROUP BY 1, 2, 3, 4"))
def _(s, d):
    g = log(s, d).withColumnRenamed("day", "exposure_date")
    return daily(s, d).select("flag_key", "allocation_slice", "arm", "exposure_date").distinct().join(g, ["flag_key", "allocation_slice", "arm", "exposure_date"])


add("ipw", """SELECT *, a * a / nullif(a2, 0) AS ne, ws / nullif(a, 0) AS mean, greatest(wq / nullif(a, 0) - power(ws / nullif(a, 0), 2), 0) AS var FROM (SELECT x.flag_key, target, x.arm, sum(w / weight * scored_users) AS a, sum(power(w / weight, 2) * scored_users) AS a2, sum(w / weight * sp) AS ws, sum(w / weight * qp) AS wq, sum(scored_users) AS raw_n FROM aged x
    JOIN logday l ON l.flag_key = x.flag_key AND l.allocation_slice = x.allocation_slice AND l.arm = x.arm AND l.day = x.exposure_date GROUP BY 1, 2, 3)""")


@query("expt_16_ipw_moments", sql("SELECT flag_key, target, arm, raw_n, round(coalesce(ne, 0), 5) AS n_eff, round(mean, 3) AS mean, round(sqrt(coalesce(var, 0)), 2) AS sd FROM ipw"))
def _(s, d):
    m = A.ipw_moments(rows(s, d), log(s, d), *score_moments())
    return m.select("flag_key", "target", "arm", "raw_n", F.round("n_eff", 5).alias("n_eff"), F.round("mean", 3).alias("mean"), F.round(F.sqrt("variance"), 2).alias("sd"))


add("pval", "SELECT flag_key, s / w AS vm, sqrt(greatest(q / w - power(s / w, 2), 0) / (w * w / w2)) AS vse FROM (SELECT flag_key, sum(w * mc) AS w, sum(w * w * mc) AS w2, sum(w * sv) AS s, sum(w * qv) AS q FROM aged GROUP BY 1)")


@query("expt_17_pooled_value", sql("SELECT flag_key, round(vm, 4) AS value_mean, round(vse, 4) AS value_se FROM pval"))
def _(s, d):
    v = A.pooled_value(rows(s, d))
    return v.select("flag_key", F.round("value_mean", 4).alias("value_mean"), F.round("value_se", 4).alias("value_se"))


add("cth", "SELECT flag_key, sx / n AS xb, (sxy / n - sx / n * sy / n) / (sxx / n - power(sx / n, 2)) AS th FROM (SELECT flag_key, sum(scored_users) AS n, sum(sx) AS sx, sum(qx) AS sxx, sum(sp) AS sy, sum(xy) AS sxy FROM aged GROUP BY 1)")


@query("expt_18_cuped_rows", sql("SELECT x.flag_key, x.arm, round(max(th), 5) AS theta, round(sum(sp - th * (sx - scored_users * xb)), 2) AS adj_sum FROM aged x JOIN cth USING (flag_key) GROUP BY 1, 2"))
def _(s, d):
    x = A.cuped_rows(rows(s, d))
    return x.groupBy("flag_key", "arm").agg(F.round(F.max("theta"), 5).alias("theta"), F.round(F.sum("adj_sum"), 2).alias("adj_sum"))


add("dec", "SELECT x.*, CASE WHEN mu > 0 THEN vm * mc - sc ELSE 0 END AS ys, CASE WHEN mu > 0 THEN greatest(vm * vm * mc - 2 * vm * mc * (sc / mu) + qc, 0) ELSE 0 END AS yq FROM aged x JOIN pval USING (flag_key)")


@query("expt_19_decomposed_reward", sql("SELECT flag_key, arm, sum(mu) AS y_n, round(sum(ys), 2) AS y_sum, round(sum(yq), 1) AS y_sq FROM dec GROUP BY 1, 2"))
def _(s, d):
    x = A.decomposed(rows(s, d), A.pooled_value(rows(s, d)))
    return x.groupBy("flag_key", "arm").agg(F.sum("y_n").alias("y_n"), F.round(F.sum("y_sum"), 2).alias("y_sum"), F.round(F.sum("y_sq"), 1).alias("y_sq"))


def _contrast(n, s_, q):
    return f"""SELECT flag_key, target, arm, sum(d / v) AS z, sum(1 / v) AS info, count(*) AS days, sum(tn) AS tn, sum(cn) AS cn, sum(d / v) / sum(1 / v) AS est FROM (SELECT *, greatest(s2t / tn + s2c / cn, 1e-12) AS v, ts / tn - cs / cn AS d FROM (SELECT *,
    coalesce(sum(CASE WHEN tn > 1 THEN greatest(tq - ts * ts / tn, 0) END) OVER w / sum(CASE WHEN tn > 1 THEN tn - 1 END) OVER w, greatest(sum(tq) OVER w / sum(tn) OVER w - power(sum(ts) OVER w / sum(tn) OVER w, 2), 0)) AS s2t,
    coalesce(sum(CASE WHEN cn > 1 THEN greatest(cq - cs * cs / cn, 0) END) OVER w / sum(CASE WHEN cn > 1 THEN cn - 1 END) OVER w, greatest(sum(cq) OVER w / sum(cn) OVER w - power(sum(cs) OVER w / sum(cn) OVER w, 2), 0)) AS s2c
    FROM (SELECT flag_key, target, arm, exposure_date, sum({n}) AS tn, sum({s_}) AS ts, sum({q}) AS tq FROM aged GROUP BY 1, 2, 3, 4) t JOIN (SELECT flag_key, target, exposure_date, sum({n}) AS cn, sum({s_}) AS cs, sum({q}) AS cq FROM aged WHERE allocation_slice = 'holdout' GROUP BY 1, 2, 3) c USING (flag_key, target, exposure_date)
    WHERE tn > 0 AND cn > 0 WINDOW w AS (PARTITION BY flag_key, target, arm))) GROUP BY 1, 2, 3"""


add("con", _contrast("scored_users", "sp", "qp"))
add("con_act", _contrast("scored_users", "act", "act"))
add("con_ref", _contrast("mc", "mr", "mr"))
add("con_fail", _contrast("g24", "f24", "f24"))
HALF = "sqrt((1 + {t} * info) / ({t} * info * info) * (2 * ln(1 / {a}) + ln(1 + {t} * info)))"


@query("expt_20_contrast", sql("SELECT flag_key, target, arm, days, tn AS treatment_n, cn AS control_n, round(est, 2) AS estimate FROM con"))
def _(s, d):
    x = A.contrast(rows(s, d), *score_moments())
    return x.select("flag_key", "target", "arm", "days", F.col("treatment_n").cast("bigint").alias("treatment_n"), F.col("control_n").cast("bigint").alias("control_n"), F.round("estimate", 2).alias("estimate"))


@query("expt_21_confidence_sequence", sql(f"SELECT flag_key, target, arm, round(est - {HALF.format(t='4.0::DOUBLE', a='0.05::DOUBLE')}, 1) AS lower, round(est + {HALF.format(t='4.0::DOUBLE', a='0.05::DOUBLE')}, 1) AS upper FROM con WHERE tn >= 5 AND cn >= 3"))
def _(s, d):
    x = A.confidence_sequence(A.contrast(rows(s, d), *score_moments()), 2.0, 0.05, 5, 3)
    return x.select("flag_key", "target", "arm", F.round("lower", 1).alias("lower"), F.round("upper", 1).alias("upper"))


MARGINS = {"activation": 0.05, "refunds": 0.02, "failed_generations": 0.03}


@query("expt_22_guardrails", sql(" UNION ALL ".join(
    f"SELECT flag_key, target, arm, '{m}' AS metric, round(est, 5) AS estimate, {'est + ' + HALF.format(t=f'{t}::DOUBLE', a='0.05::DOUBLE') + f' < -{g}' if m == 'activation' else 'est - ' + HALF.format(t=f'{t}::DOUBLE', a='0.05::DOUBLE') + f' > {g}'} AS breached FROM {c} WHERE tn >= 3 AND cn >= 2"
    for m, c, g, t in (("activation", "con_act", 0.05, 0.0025), ("refunds", "con_ref", 0.02, 0.0004), ("failed_generations", "con_fail", 0.03, 0.0009)))))
def _(s, d):
    g = A.guardrails(rows(s, d), MARGINS, 0.05, 3, 2)
    return g.select("flag_key", "target", "arm", "metric", F.round("estimate", 5).alias("estimate"), F.col("breach").isNotNull().alias("breached"))


@query("expt_23_srm", sql("""SELECT flag_key, served, sum(o) AS exposures, round(sum(CASE WHEN e > 0 THEN (o - e) * (o - e) / e ELSE 0 END), 4) AS chi_square, count(*) FILTER (WHERE e > 0) - 1 AS df,
    round(exp(-sum(CASE WHEN e > 0 THEN (o - e) * (o - e) / e ELSE 0 END) / 2), 6) AS p_value FROM (SELECT flag_key, served, arm, coalesce(o, 0) AS o, e FROM
    (SELECT x.flag_key, x.served, l.arm, sum(x.n * l.weight) AS e FROM (SELECT flag_key, CASE WHEN allocation_slice = 'holdout' THEN 'holdout' ELSE target END AS served, allocation_slice, exposure_date, sum(exposed_users) AS n FROM aged GROUP BY 1, 2, 3, 4) x
      JOIN logday l ON l.flag_key = x.flag_key AND l.allocation_slice = x.allocation_slice AND l.day = x.exposure_date GROUP BY 1, 2, 3) LEFT JOIN (SELECT flag_key, CASE WHEN allocation_slice = 'holdout' THEN 'holdout' ELSE target END AS served, arm, sum(exposed_users) AS o FROM aged GROUP BY 1, 2, 3) USING (flag_key, served, arm)) GROUP BY 1, 2"""))
def _(s, d):
    x = A.srm(rows(s, d), log(s, d))
    return x.select("flag_key", "served", "exposures", F.round("chi_square", 4).alias("chi_square"), "df", F.round("p_value", 6).alias("p_value"))


@query("expt_23b_holdout_share", sql("SELECT flag_key, holdout, total, round((holdout - total * 0.6::DOUBLE) * (holdout - total * 0.6::DOUBLE) / (total * 0.6::DOUBLE) + (total - holdout - total * 0.4::DOUBLE) * (total - holdout - total * 0.4::DOUBLE) / (total * 0.4::DOUBLE), 5) AS chi_square FROM (SELECT flag_key, sum(CASE WHEN allocation_slice = 'holdout' THEN exposed_users ELSE 0 END) AS holdout, sum(exposed_users) AS total FROM daily GROUP BY 1)"))
def _(s, d):
    return A.holdout_share(daily(s, d), 0.6).select("flag_key", "holdout", "total", F.round("chi_square", 5).alias("chi_square"))


@query("expt_24_coverage_spread", sql("SELECT flag_key, min(c) AS lowest, max(c) AS highest, max(c) - min(c) AS spread FROM (SELECT flag_key, arm, sum(scored_users) / sum(exposed_users) AS c FROM daily GROUP BY 1, 2) GROUP BY 1"))
def _(s, d):
    return A.coverage_spread(daily(s, d))


def posterior(s, d):
    x = rows(s, d)
    pooled = x.groupBy("flag_key").agg(*[F.sum(c).alias(a) for c, a in zip(score_moments(), ("n", "s", "q"))])
    g = A.ipw_moments(x.withColumn("target", F.lit("all")), log(s, d), *score_moments())
    return A.posteriors(A.ipw_moments(x, log(s, d), *score_moments()), g, pooled, 2.0, 2.0, 20.0)


add("ipw_all", """SELECT *, a * a / nullif(a2, 0) AS ne, ws / nullif(a, 0) AS mean, greatest(wq / nullif(a, 0) - power(ws / nullif(a, 0), 2), 0) AS var FROM (SELECT x.flag_key, x.arm, sum(w / weight * scored_users) AS a, sum(power(w / weight, 2) * scored_users) AS a2, sum(w / weight * sp) AS ws, sum(w / weight * qp) AS wq FROM aged x
    JOIN logday l ON l.flag_key = x.flag_key AND l.allocation_slice = x.allocation_slice AND l.arm = x.arm AND l.day = x.exposure_date GROUP BY 1, 2)""")
add("gpost", """SELECT flag_key, arm, (2 * m0 + ne * mean) / (2 + ne) AS mu, (v0 + ne * var / 2 + 2 * ne * power(mean - m0, 2) / (2 * (2 + ne))) / (2 + ne / 2 - 1) AS s2 FROM ipw_all JOIN (SELECT flag_key, s / n AS m0, greatest(q / n - power(s / n, 2), 1e-9) AS v0 FROM (SELECT flag_key, sum(scored_users) AS n, sum(sp) AS s, sum(qp) AS q FROM aged GROUP BY 1)) USING (flag_key)""")


@query("expt_25_posteriors", sql("SELECT i.flag_key, i.target, i.arm, round((20 * g.mu + ne * mean) / (20 + ne), 2) AS mu, round(20 + ne, 4) AS kappa, round(2 + ne / 2, 4) AS alpha FROM ipw i JOIN gpost g USING (flag_key, arm) WHERE ne > 0"))
def _(s, d):
    p = posterior(s, d).where("n_eff > 0")
    return p.select("flag_key", "target", "arm", F.round("mu", 2).alias("mu"), F.round("kappa", 4).alias("kappa"), F.round("alpha", 4).alias("alpha"))


add("npost", """SELECT i.flag_key, i.target, i.arm, CASE WHEN ne > 0 THEN (20 * g.mu + ne * mean) / (20 + ne) ELSE g.mu END AS mu, 20 + CASE WHEN ne > 0 THEN ne ELSE 0 END AS kappa, 2 + CASE WHEN ne > 0 THEN ne / 2 ELSE 0 END AS alpha,
    s2 + CASE WHEN ne > 0 THEN ne * var / 2 + 20 * ne * power(mean - g.mu, 2) / (2 * (20 + ne)) ELSE 0 END AS beta FROM ipw i JOIN gpost g USING (flag_key, arm)""")
_U = "((('0x' || substr(md5('7|' || flag_key || '|' || target || '|' || arm || '|' || draw || '|{}|' || {}), 1, 12))::BIGINT)::DOUBLE + 0.5) / 281474976710656.0::DOUBLE"
_Z = lambda purpose, j: f"sqrt(-2 * ln({_U.format(purpose, j)})) * cos(2 * pi() * ({_U.format(purpose + 1, j)}))"
add("ngam", f"""SELECT *, 1 + z / sqrt(9 * dd) AS root, power(1 + z / sqrt(9 * dd), 3) AS v FROM (SELECT p.*, draw, j, alpha - 1.0::DOUBLE / 3 AS dd, {_Z(0, 'j')} AS z, {_U.format(2, 'j')} AS u FROM npost p, range(0, 2000) r(draw), range(0, 12) c(j))""")
add("ndraw", f"""SELECT *, mu + sqrt(beta / gam / kappa) * {_Z(3, 0)} AS x FROM (SELECT flag_key, target, arm, mu, kappa, alpha, beta, draw, coalesce(arg_min(dd * v, j) FILTER (WHERE root > 0 AND ln(u) < 0.5 * z * z + dd - dd * v + dd * ln(CASE WHEN root > 0 THEN v ELSE 1 END)), arg_max(dd * v, j)) AS gam FROM ngam GROUP BY ALL)""")


@query("expt_26_p_best", sql("SELECT flag_key, target, arm, avg((x = top)::INT) AS p_best, round(avg(top - x), 4) AS expected_loss FROM (SELECT *, max(x) OVER (PARTITION BY flag_key, target, draw) AS top FROM ndraw) GROUP BY 1, 2, 3"))
def _(s, d):
    return A.p_best(posterior(s, d), 2000, 7).withColumn("expected_loss", F.round("expected_loss", 4))


@query("expt_27_required_n", sql("SELECT flag_key, arm, greatest(100, CAST(ceil(2 * power(1.959963984540054::DOUBLE + 0.8416212335729143::DOUBLE, 2) * greatest(q / n - power(s / n, 2), 0) / 250000) AS BIGINT)) AS users FROM (SELECT flag_key, arm, sum(scored_users) AS n, sum(sp) AS s, sum(qp) AS q FROM daily GROUP BY 1, 2)"))
def _(s, d):
    x = daily(s, d).groupBy("flag_key", "arm").agg(*[F.sum(c).alias(a) for c, a in zip(score_moments(), ("n", "s", "q"))])
    m = C.safe_divide("s", "n")
    return x.select("flag_key", "arm", A.required_n(F.greatest(C.safe_divide("q", "n") - m * m, F.lit(0.0)), 500.0, 100).alias("users"))


@query("expt_28_resets", sql("SELECT flag_key, exposure_date, sum(exposed_users) AS users FROM daily WHERE (flag_key LIKE '%video' OR exposure_date >= DATE '2024-01-02') AND exposure_date % 2 = 0 GROUP BY 1, 2".replace("exposure_date % 2 = 0", "exposure_date >= DATE '2024-01-01'")))
def _(s, d):
    resets = D.seed_from(s, [(D.FLAGS[0], "2023-12-01"), (D.FLAGS[0], "2024-01-02")], "flag_key string, reset_date date")
    return A.apply_resets(daily(s, d), resets).groupBy("flag_key", "exposure_date").agg(F.sum("exposed_users").alias("users"))


@query("expt_29_stats_from_interval", sql("SELECT flag_key, arm, n, round(s, 2) AS s, round(q / 1000000, 3) AS q_millions FROM (SELECT flag_key, arm, count(pred) AS n, sum(pred) AS s, sum(pred * pred) AS q FROM ro GROUP BY 1, 2)"))
def _(s, d):
    from tidemark.catalog.experiment import readout
    a = readout(s, d).groupBy("flag_key", "arm").agg(F.count("predicted_profit").alias("n"), F.avg("predicted_profit").alias("mean"), F.stddev_samp("predicted_profit").alias("sd"))
    half = 1.96 * F.col("sd") / F.sqrt("n")
    x = A.stats_from_ci(a.withColumn("low", F.col("mean") - half).withColumn("high", F.col("mean") + half), "n", "mean", "low", "high", 1.96)
    return x.select("flag_key", "arm", "n", F.round("s", 2).alias("s"), F.round(F.col("q") / 1_000_000, 3).alias("q_millions"))


@query("expt_30_outcomes_14d", sql("""SELECT s.user_id, s.signup_at + INTERVAL 14 DAY <= TIMESTAMP '2024-01-31' AS matured, least(coalesce((SELECT sum(revenue_minor) FROM purchase p WHERE p.user_id = s.user_id AND p.occurred_at >= s.signup_at AND p.occurred_at < s.signup_at + INTERVAL 14 DAY), 0), 20000) AS capped_minor,
    coalesce((SELECT sum(cost_cents * 10000) FROM usage u WHERE u.user_id = s.user_id AND u.created_at >= s.signup_at AND u.created_at < s.signup_at + INTERVAL 14 DAY), 0) AS cost_micros FROM signup s"""))
def _(s, d):
    su = D.signup(s, d).withColumn("end", C.add_seconds("signup_at", 14 * 86_400))
    inside = lambda t: (F.col(t) >= F.col("signup_at")) & (F.col(t) < F.col("end"))
    v = D.purchase(s, d).join(su, "user_id").where(inside("occurred_at")).groupBy("user_id").agg(F.sum("revenue_minor").alias("v"))
    c = usage(s, d).join(su, "user_id").where(inside("created_at")).groupBy("user_id").agg(F.sum("cost_micros").alias("c"))
    x = su.join(v, "user_id", "left").join(c, "user_id", "left")
    return x.select("user_id", (F.col("end") <= F.lit(P.as_of)).alias("matured"), F.least(F.coalesce("v", F.lit(0)), F.lit(20000)).alias("capped_minor"), F.coalesce("c", F.lit(0)).alias("cost_micros"))

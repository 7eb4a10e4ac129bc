"""Back-test queries: orders play scored units, their totals the outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.cte import add, sql
from tidemark.catalog.registry import query
from tidemark.catalog.scores import usage
from tidemark.functions import columns as C
from tidemark.plans import backtest as B
from tidemark.sources import driver_tables as D


def units(s, d):
    o = D.table(s, d, "orders")
    k = F.col("o_orderkey")
    r = D.cents("o_totalprice").cast("double") / 100 - 100_000
    p = F.floor(r / 5000) * 5000 + k % 97 * 100
    return o.select(k.alias("unit"), F.col("o_orderpriority").alias("grp"), r.alias("realised"), p.cast("double").alias("predicted"), (p - 20_000.0).alias("interval_low"), (p + 5_000.0 + k % 5 * 2_000).alias("interval_high"), F.concat(F.lit("fit"), (k % 4).cast("string")).alias("fit_id"),
                    (k % 3 == 0).alias("converted"), ((k % 50) / 100).alias("p_convert"), (k % 1000).cast("double").alias("first_charge"), "o_custkey", "o_orderstatus")


add("unit", """SELECT *, p - 20000.0::DOUBLE AS lo, p + 5000.0::DOUBLE + unit % 5 * 2000 AS hi FROM (SELECT *, floor(realised / 5000) * 5000 + unit % 97 * 100 AS p FROM (SELECT o_orderkey AS unit, o_orderpriority AS grp, o_custkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) / 100.0::DOUBLE - 100000 AS realised FROM orders))""")


@query("ml_19_calibration", sql("SELECT grp, count(*) AS n, round(regr_slope(realised, p), 7) AS slope, round(regr_intercept(realised, p), 3) AS intercept FROM unit GROUP BY 1"))
def _(s, d):
    return B.calibration(units(s, d), ["grp"]).select("grp", "n", F.round("slope", 7).alias("slope"), F.round("intercept", 3).alias("intercept"))


@query("ml_20_deciles", sql("SELECT bin, count(*) AS n, round(avg(p), 4) AS mean_predicted, round(avg(realised), 3) AS mean_realised FROM (SELECT *, CAST(floor((rank() OVER (ORDER BY p) - 1) * 10 / count(*) OVER ()) AS INT) AS bin FROM unit) GROUP BY 1"))
def _(s, d):
    return B.deciles(units(s, d)).select("bin", "n", F.round("mean_predicted", 4).alias("mean_predicted"), F.round("mean_realised", 3).alias("mean_realised"))


@query("ml_21_lift", sql("SELECT count(*) AS top_n, round(avg(realised) / (SELECT avg(realised) FROM unit), 6) AS lift FROM unit WHERE p >= (SELECT min(p) FROM (SELECT p, row_number() OVER (ORDER BY p DESC) AS n FROM unit) WHERE n <= (SELECT (count(*) + 9) // 10 FROM unit))"))
def _(s, d):
    return B.lift(units(s, d)).select("top_n", F.round("lift", 6).alias("lift"))


MAE = "abs(greatest(least(p, 50000), -50000) - greatest(least(realised, 50000), -50000))"


@query("ml_22_capped_mae", sql(f"SELECT grp, count(*) AS n, round(avg({MAE}), 3) AS capped_mae FROM unit GROUP BY 1"))
def _(s, d):
    return B.capped_mae(units(s, d), 50_000.0, ["grp"]).select("grp", "n", F.round("capped_mae", 3).alias("capped_mae"))


POIS = "CASE WHEN u < 0.367879 THEN 0 WHEN u < 0.735759 THEN 1 WHEN u < 0.919699 THEN 2 WHEN u < 0.981012 THEN 3 WHEN u < 0.996340 THEN 4 WHEN u < 0.999406 THEN 5 ELSE 6 END"


@query("ml_23_bootstrap", sql(f"""SELECT grp, round(quantile_cont(stat, 0.025), 2) AS low, round(quantile_cont(stat, 0.975), 2) AS high FROM (SELECT grp, r, sum(w * e) / nullif(sum(w), 0) AS stat FROM (SELECT grp, r, e, {POIS} AS w FROM (SELECT grp, r, {MAE} AS e, CAST('0x' || substr(sha256(unit || ':' || r), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM unit, range(20) q(r))) GROUP BY 1, 2) GROUP BY 1"""))
def _(s, d):
    x = B.bootstrap_mae(units(s, d), 50_000.0, 20, "grp")
    return x.select("grp", F.round("low", 2).alias("low"), F.round("high", 2).alias("high"))


@query("ml_24_coverage", sql("SELECT grp, o_orderstatus, count(*) AS n, round(avg(CASE WHEN realised BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END), 9) AS unit_coverage, abs(avg(p) - avg(realised)) <= 1.96 * sqrt(var_samp(realised) / count(*)) AS cell_covered FROM unit GROUP BY 1, 2"))
def _(s, d):
    return B.coverage(units(s, d), ["grp", "o_orderstatus"]).withColumn("unit_coverage", F.round("unit_coverage", 9))


@query("ml_25_baselines", sql("""SELECT u.unit, 'fit' || (u.unit % 4) AS fit_id, round(m.a, 3) AS training_mean, (u.unit % 1000)::DOUBLE AS first_charge_only, round((u.unit % 50) / 100.0::DOUBLE * m.c, 3) AS conversion_only FROM unit u JOIN (SELECT unit % 4 AS f, avg(realised) AS a, avg(realised) FILTER (WHERE unit % 3 = 0) AS c FROM unit WHERE o_orderstatus <> 'P' GROUP BY 1) m ON m.f = u.unit % 4 WHERE u.o_orderstatus = 'P'"""))
def _(s, d):
    u = units(s, d)
    x = B.baselines(u.where("o_orderstatus <> 'P'"), u.where("o_orderstatus = 'P'"), "fit_id")
    return x.select("unit", "fit_id", F.round("training_mean", 3).alias("training_mean"), "first_charge_only", F.round("conversion_only", 3).alias("conversion_only"))


@query("ml_26_window_truth", sql("""SELECT f.user_id, coalesce(sum(p.revenue_minor), 0) AS revenue_minor, count(p.event_id) AS charges, coalesce((SELECT sum(a.cash_minor) FROM purchase q JOIN adjustment a ON a.adjusts_event_id = q.event_id WHERE q.user_id = f.user_id AND q.occurred_at >= f.signup_at AND q.occurred_at < f.signup_at + INTERVAL 7 DAY AND a.occurred_at < f.signup_at + INTERVAL 7 DAY), 0) AS adjusted_minor
    FROM signup f LEFT JOIN purchase p ON p.user_id = f.user_id AND p.occurred_at >= f.signup_at AND p.occurred_at < f.signup_at + INTERVAL 7 DAY GROUP BY f.user_id, f.signup_at"""))
def _(s, d):
    a = D.signup(s, d).withColumnRenamed("signup_at", "anchor_at")
    return B.window_truth(a, D.purchase(s, d), D.adjustment(s, d), usage(s, d), 7).select("user_id", "revenue_minor", "charges", "adjusted_minor")


@query("ml_18_cell_scores", sql("""SELECT c.grp, c.o_orderstatus, c.n, round((c.s + 50.0::DOUBLE * ((p.s + 50.0::DOUBLE * a.s / a.n) / (p.n + 50))) / (c.n + 50), 3) AS mean_realised FROM (SELECT grp, o_orderstatus, count(*) AS n, sum(realised) AS s FROM unit GROUP BY 1, 2) c JOIN (SELECT grp, count(*) AS n, sum(realised) AS s FROM unit GROUP BY 1) p USING (grp), (SELECT count(*) AS n, sum(realised) AS s FROM unit) a"""))
def _(s, d):
    x = B.component_scores(units(s, d), ["grp", "o_orderstatus"], ["grp"], ["realised"], 50.0)
    return x.select("grp", "o_orderstatus", "n", F.round("mean_realised", 3).alias("mean_realised"))

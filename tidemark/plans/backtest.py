"""Back-test statistics of a score: calibration, deciles, lift, capped error, bootstrap, coverage, baselines.

Inputs carry ``predicted`` and ``realised`` (and ``unit``, a unique key).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators.rows import global_rank, top_fraction


def calibration(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Least-squares line of realised on predicted."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("realised", "predicted").alias("slope"), F.regr_intercept("realised", "predicted").alias("intercept"))


def deciles(df: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-count bins of the score; equal scores share a bin."""
    r = global_rank(df, "predicted")
    b = F.floor((F.col("rank_min") - 1) * bins / F.col("total")).cast("int")
    return r.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("predicted").alias("mean_predicted"), F.avg("realised").alias("mean_realised"))


def lift(df: DataFrame, numerator: int = 1, denominator: int = 10) -> DataFrame:
    """Mean realised value of the best-scored share over the mean of all."""
    top = top_fraction(df, "predicted", numerator, denominator).agg(F.avg("realised").alias("top_mean"), F.count(F.lit(1)).alias("top_n"))
    return top.withColumn("all_mean", df.agg(F.avg("realised")).scalar()).withColumn("lift", C.safe_divide("top_mean", "all_mean"))


def capped_mae(df: DataFrame, cap: float, by: Sequence[str] = ()) -> DataFrame:
    e = F.abs(C.clamp(F.col("predicted"), -cap, cap) - C.clamp(F.col("realised"), -cap, cap))
    return df.groupBy(*by).agg(F.avg(e).alias("capped_mae"), F.count(F.lit(1)).alias("n"))


def bootstrap_mae(df: DataFrame, cap: float, reps: int, by: str) -> DataFrame:
    """Percentile interval of the capped error from Poisson(1) replicates, folded in the scanning tasks."""
    e = F.abs(C.clamp(F.col("predicted"), -cap, cap) - C.clamp(F.col("realised"), -cap, cap))
    x = df.select(by, "unit", e.alias("e"), F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    w = C.poisson_weight(C.uniform(F.concat_ws(":", F.col("unit").cast("string"), F.col("rep").cast("string"))))
    r = x.withColumn("w", w).groupBy(by, "rep").agg(C.safe_divide(F.sum(F.col("w") * F.col("e")), F.sum("w")).alias("stat"))
    return r.groupBy(by).agg(C.quantile("stat", 0.025).alias("low"), C.quantile("stat", 0.975).alias("high"))


def coverage(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of units whose outcome lies in its interval, and whether the cell mean does (by its own variance)."""
    inside = F.col("realised").between(F.col("interval_low"), F.col("interval_high"))
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(inside.cast("double")).alias("unit_coverage"), F.avg("predicted").alias("mp"), F.avg("realised").alias("mr"), F.var_samp("realised").alias("v"))
    return g.withColumn("cell_covered", F.abs(F.col("mp") - F.col("mr")) <= 1.96 * F.sqrt(F.col("v") / F.col("n"))).drop("mp", "mr", "v")


def baselines(train: DataFrame, test: DataFrame, fit: str) -> DataFrame:
    """Baseline predictions of each test unit: training mean, first charge, conversion-only."""
    m = train.groupBy(fit).agg(F.avg("realised").alias("training_mean"), F.avg(F.when(F.col("converted"), F.col("realised"))).alias("converter_mean"))
    x = test.join(m, fit, "left")
    return x.select("unit", fit, "training_mean", F.col("first_charge").alias("first_charge_only"), (F.col("p_convert") * F.col("converter_mean")).alias("conversion_only"))


def window_truth(anchors: DataFrame, purchases: DataFrame, money_out: DataFrame, usage: DataFrame, horizon_days: int) -> DataFrame:
    """Realised window economics by a plain join path (cross-check of the outcome jobs); one anchor per user."""
    h = horizon_days * 86_400
    a = anchors.withColumn("end", C.add_seconds("anchor_at", h))
    inside = lambda t: (F.col(t) >= F.col("anchor_at")) & (F.col(t) < F.col("end"))
    w = purchases.join(a, "user_id").where(inside("occurred_at"))
    p = w.groupBy("user_id").agg(F.sum("revenue_minor").alias("revenue_minor"), F.count(F.lit(1)).alias("charges"))
    o = w.select("user_id", F.col("event_id").alias("adjusts_event_id"), "end").join(money_out.select("adjusts_event_id", F.col("occurred_at").alias("out_at"), F.col("cash_minor").alias("out")), "adjusts_event_id").where(F.col("out_at") < F.col("end"))
    o = o.groupBy("user_id").agg(F.sum("out").alias("adjusted_minor"))
    u = usage.join(a, "user_id").where(inside("created_at")).groupBy("user_id").agg(F.sum("cost_micros").alias("cost_micros"))
    x = a.select("user_id").join(p, "user_id", "left").join(o, "user_id", "left").join(u, "user_id", "left")
    return x.na.fill(0)


def component_scores(rows: DataFrame, cell: Sequence[str], parent: Sequence[str], components: Sequence[str], k: float) -> DataFrame:
    """Mean components per cell, shrunk to the parent, the parent to the overall mean (cell-mean score model)."""
    sums = lambda by: rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in components])
    c, p, a = sums(cell), sums(parent), sums([])
    p = p.select(*parent, F.col("n").alias("pn"), *[F.col(x).alias(f"p_{x}") for x in components])
    x = c.join(p, list(parent))
    for n in ["n", *components]:
        x = x.withColumn(f"a_{n}", a.select(n).scalar())
    for n in components:
        overall = F.col(f"a_{n}") / F.col("a_n")
        x = x.withColumn(f"mean_{n}", C.shrink(F.col(n), F.col("n"), C.shrink(F.col(f"p_{n}"), F.col("pn"), overall, k), k))
    return x.select(*cell, "n", *[f"mean_{n}" for n in components])

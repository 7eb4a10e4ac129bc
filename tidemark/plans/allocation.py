"""Statistics over daily experiment rows: weights, moments, contrasts, posteriors.

Inputs are aggregates (days x arms x segments), so everything here is small columns
of sums; only the draws of ``p_best`` and the chi-square tail need NumPy.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.functions import columns as C

SEGMENT = ("country_bucket", "device", "acquisition_channel")
Z_975, Z_80 = 1.959963984540054, 0.8416212335729143


def aged(rows: DataFrame, run_date: date, lookback: int, half_life: float | None) -> DataFrame:
    """Exposure days 1..lookback before the run, with the half-life weight of their age."""
    x = rows.withColumn("age", F.datediff(F.lit(run_date), "exposure_date")).where(F.col("age").between(1, lookback))
    return x.withColumn("decay", F.lit(1.0) if half_life is None else F.pow(F.lit(0.5), (F.col("age") - 1) / F.lit(half_life)))


def decayed_cells(rows: DataFrame, run_date: date, lookback: int, half_life: float | None) -> DataFrame:
    """Decayed count, sum and sum of squares per flag, arm and segment; the holdout slice also apart."""
    x = aged(rows, run_date, lookback, half_life)
    held = F.col("allocation_slice") == "holdout"
    w = F.col("decay")
    return x.groupBy("flag_key", "arm", *SEGMENT).agg(
        F.sum(w * F.col("scored_users")).alias("n"), F.sum(w * F.col("sum_predicted_profit")).alias("s"), F.sum(w * F.col("sum_sq_predicted_profit")).alias("q"),
        F.sum(F.when(held, w * F.col("scored_users")).otherwise(0.0)).alias("holdout_n"), F.sum("scored_users").alias("scored_users"), F.sum("exposed_users").alias("exposed_users"),
        C.sum_if(held, F.col("exposed_users")).alias("holdout_exposed"))


def route(rows: DataFrame, targets: Sequence[dict]) -> DataFrame:
    """Target of each segment: the first of an ordered list whose named dimensions all match (None matches all)."""
    out = F.lit(None).cast("string")
    for t in reversed(targets):
        test = F.lit(True)
        for dim in SEGMENT:
            if t.get(dim) is not None:
                test = test & F.col(dim).isin(*t[dim])
        out = F.when(test, F.lit(t["name"])).otherwise(out)
    return rows.withColumn("target", out)


def expand_log(log: DataFrame, first: date, last: date) -> DataFrame:
    """Dated intervals to daily weights; ``problem`` names overlaps and sums that differ from one."""
    end = F.least(F.coalesce(F.date_sub("valid_to", 1), F.lit(last)), F.lit(last))
    x = log.withColumn("_a", F.greatest("valid_from", F.lit(first))).withColumn("_b", end).where("_a <= _b")
    days = x.select("flag_key", "allocation_slice", "arm", "assignment_probability", F.explode(F.sequence("_a", "_b")).alias("day"))
    per_arm = days.groupBy("flag_key", "allocation_slice", "day", "arm").agg(F.sum("assignment_probability").alias("weight"), F.count(F.lit(1)).alias("copies"))
    w = Window.partitionBy("flag_key", "allocation_slice", "day")
    total, copies = F.sum("weight").over(w), F.max("copies").over(w)
    return per_arm.withColumn("problem", F.when(copies > 1, "overlap").when(F.abs(total - 1) > 1e-6, "sum_not_one")).drop("copies")


def ipw_moments(rows: DataFrame, log: DataFrame, n: Column, s: Column, q: Column) -> DataFrame:
    """Inverse-propensity weighted moments per target and arm, and the effective sample that reproduces them."""
    g = log.select("flag_key", F.col("allocation_slice"), "arm", F.col("day").alias("exposure_date"), F.col("weight").alias("p"))
    x = rows.join(g, ["flag_key", "allocation_slice", "arm", "exposure_date"], "left")
    w = F.when(F.col("p") > 0, F.col("decay") / F.col("p")).otherwise(0.0)
    m = x.withColumn("_w", w).groupBy("flag_key", "target", "arm").agg(
        F.sum(F.col("_w") * n).alias("a"), F.sum(F.col("_w") * F.col("_w") * n).alias("a2"), F.sum(F.col("_w") * s).alias("ws"), F.sum(F.col("_w") * q).alias("wq"),
        F.sum(F.when(F.col("_w") > 0, n)).alias("raw_n"), C.tally(F.col("p").isNull()).alias("unlogged_rows"))
    mean = C.safe_divide("ws", "a")
    var = F.greatest(C.safe_divide("wq", "a") - mean * mean, F.lit(0.0))
    return m.select("flag_key", "target", "arm", "raw_n", "unlogged_rows", F.coalesce(C.safe_divide(F.col("a") * F.col("a"), "a2"), F.lit(0.0)).alias("n_eff"), mean.alias("mean"), F.coalesce(var, F.lit(0.0)).alias("variance"))


def pooled_value(rows: DataFrame) -> DataFrame:
    """Decay-weighted value per conversion over all arms of a flag, with its standard error."""
    c, w = F.col("matured_converted_users"), F.col("decay")
    m = rows.groupBy("flag_key").agg(F.sum(w * c).alias("w"), F.sum(w * w * c).alias("w2"), F.sum(w * F.col("sum_matured_value")).alias("s"), F.sum(w * F.col("sum_sq_matured_value")).alias("q"))
    mean = C.safe_divide("s", "w")
    var = F.greatest(C.safe_divide("q", "w") - mean * mean, F.lit(0.0))
    return m.select("flag_key", mean.alias("value_mean"), F.sqrt(var / (F.col("w") * F.col("w") / F.col("w2"))).alias("value_se"))


def cuped_rows(rows: DataFrame) -> DataFrame:
    """Covariate adjustment of the score moments of each row, with one theta per flag."""
    t = rows.groupBy("flag_key").agg(F.sum("scored_users").alias("n"), *[F.sum(c).alias(a) for c, a in (
        ("sum_covariate", "sx"), ("sum_sq_covariate", "sxx"), ("sum_predicted_profit", "sy"), ("sum_sq_predicted_profit", "syy"), ("sum_predicted_profit_x_covariate", "sxy"))])
    xbar = C.safe_divide("sx", "n")
    vx, vy = C.safe_divide("sxx", "n") - xbar * xbar, C.safe_divide("syy", "n") - C.safe_divide("sy", "n") * C.safe_divide("sy", "n")
    cov = C.safe_divide("sxy", "n") - xbar * C.safe_divide("sy", "n")
    usable = (vx > 1e-12) & (vy > 0)
    theta = t.select("flag_key", xbar.alias("xbar"), F.when(usable, cov / vx).otherwise(0.0).alias("theta"), F.when(usable, cov * cov / (vx * vy)).otherwise(0.0).alias("variance_reduction"))
    # one row per flag
    x = rows.join(theta, "flag_key")
    n, sx, sxx, sy, syy, sxy, th, xb = (F.col(c) for c in ("scored_users", "sum_covariate", "sum_sq_covariate", "sum_predicted_profit", "sum_sq_predicted_profit", "sum_predicted_profit_x_covariate", "theta", "xbar"))
    sq = syy - 2 * th * (sxy - xb * sy) + th * th * (sxx - 2 * xb * sx + n * xb * xb)
    return x.withColumn("adj_sum", sy - th * (sx - n * xb)).withColumn("adj_sq", F.greatest(sq, F.lit(0.0)))


def decomposed(rows: DataFrame, value: DataFrame) -> DataFrame:
    """Moments of value x conversion - cost per matured user (cross term by independence)."""
    x = rows.join(value.select("flag_key", "value_mean"), "flag_key")
    n, conv, cost, cq, v = F.col("matured_users"), F.col("matured_converted_users"), F.col("sum_matured_cost"), F.col("sum_sq_matured_cost"), F.col("value_mean")
    some = n > 0
    return x.withColumn("y_n", n).withColumn("y_sum", F.when(some, v * conv - cost).otherwise(0.0)).withColumn(
        "y_sq", F.when(some, F.greatest(v * v * conv - 2 * v * conv * (cost / n) + cq, F.lit(0.0))).otherwise(0.0))


def contrast(rows: DataFrame, n: Column, s: Column, q: Column, keys: Sequence[str] = ("flag_key", "target")) -> DataFrame:
    """Day-matched, inverse-variance weighted difference of each arm from the holdout control.

    Treatment: all users of the arm; control: the holdout users of the same target.
    """
    k = list(keys)
    day = lambda df, by, p: df.groupBy(*k, *by, "exposure_date").agg(F.sum(n).cast("double").alias(p + "n"), F.sum(s).cast("double").alias(p + "s"), F.sum(q).cast("double").alias(p + "q"))
    t, c = day(rows, ["arm"], "t"), day(rows.where("allocation_slice = 'holdout'"), [], "c")
    both = t.join(c, [*k, "exposure_date"]).where("tn > 0 and cn > 0")

    def within(p):
        ss = F.sum(F.when(F.col(p + "n") > 1, F.greatest(F.col(p + "q") - F.col(p + "s") * F.col(p + "s") / F.col(p + "n"), F.lit(0.0))))
        df = F.sum(F.when(F.col(p + "n") > 1, F.col(p + "n") - 1))
        mean = F.sum(p + "s") / F.sum(p + "n")
        return F.coalesce(ss / df, F.greatest(F.sum(p + "q") / F.sum(p + "n") - mean * mean, F.lit(0.0)))

    var = both.groupBy(*k, "arm").agg(within("t").alias("s2t"), within("c").alias("s2c"))
    x = both.join(var, [*k, "arm"]).withColumn("v", F.greatest(F.col("s2t") / F.col("tn") + F.col("s2c") / F.col("cn"), F.lit(1e-12)))
    x = x.withColumn("d", F.col("ts") / F.col("tn") - F.col("cs") / F.col("cn"))
    return x.groupBy(*k, "arm").agg(
        F.sum(F.col("d") / F.col("v")).alias("z"), F.sum(1 / F.col("v")).alias("information"), F.count(F.lit(1)).alias("days"), F.sum("tn").alias("treatment_n"), F.sum("cn").alias("control_n"),
        (F.sum("ts") / F.sum("tn")).alias("treatment_mean"), (F.sum("cs") / F.sum("cn")).alias("control_mean")).withColumn("estimate", F.col("z") / F.col("information"))


def confidence_sequence(x: DataFrame, tau: float, alpha: float, min_treatment: float = 0, min_control: float = 0) -> DataFrame:
    """Always-valid interval (normal mixture) of a contrast; valid under any stopping rule."""
    t, i = tau * tau, F.col("information")
    half = F.sqrt((1 + t * i) / (t * i * i) * (2 * math.log(1 / alpha) + F.log1p(t * i)))
    llr = -0.5 * F.log1p(t * i) + t * F.col("z") * F.col("z") / (2 * (1 + t * i))
    y = x.where((F.col("treatment_n") >= min_treatment) & (F.col("control_n") >= min_control))
    return y.withColumn("lower", F.col("estimate") - half).withColumn("upper", F.col("estimate") + half).withColumn("log_lambda", llr)


GUARDRAILS = {
    "activation": ("scored_users", "activated_users"), "refunds": ("matured_converted_users", "matured_refunded_users"), "failed_generations": ("generations_24h", "failed_generations_24h"),
}


def guardrails(rows: DataFrame, margins: dict[str, float], alpha: float, min_treatment: float, min_control: float) -> DataFrame:
    """Activation, refund and failure contrasts against the holdout, with the breach verdict."""
    out = None
    for metric, (n, x) in GUARDRAILS.items():
        cs = confidence_sequence(contrast(rows, F.col(n), F.col(x), F.col(x)), max(margins[metric], 1e-6), alpha, min_treatment, min_control)
        bad = F.col("upper") < -margins[metric] if metric == "activation" else F.col("lower") > margins[metric]
        sign = "below -" if metric == "activation" else "above +"
        text = F.when(bad, F.concat(F.lit(f"{metric}: always-valid interval is {sign}"), F.format_string("%.1f%%", F.lit(100 * margins[metric]))))
        part = cs.select("flag_key", "target", "arm", F.lit(metric).alias("metric"), "estimate", "lower", "upper", text.alias("breach"))
        out = part if out is None else out.unionByName(part)
    return out


@F.pandas_udf(DoubleType())
def chi_square_tail(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """P(X >= x) of a chi-square with k degrees of freedom (a few aggregated rows)."""

    def tail(x, k):
        if x is None or k is None or np.isnan(x) or k < 1:
            return None
        if math.isinf(x):
            return 0.0
        h, k = x / 2.0, int(k)
        # upper incomplete gamma by its recurrence from 1/2 or 1
        q, a = (math.erfc(math.sqrt(h)), 0.5) if k % 2 else (math.exp(-h), 1.0)
        while a < k / 2.0:
            q += math.exp(a * math.log(h) - h - math.lgamma(a + 1)) if h > 0 else 0.0
            a += 1.0
        return min(1.0, q)

    for x, k in batches:
        yield pd.Series([tail(a, b) for a, b in zip(x, k)], dtype="float64")


def srm(rows: DataFrame, log: DataFrame) -> DataFrame:
    """Sample-ratio check: exposures per target and arm against the logged weights of each day."""
    x = rows.withColumn("served", F.when(F.col("allocation_slice") == "holdout", "holdout").otherwise(F.col("target")))
    seen = x.groupBy("flag_key", "served", "arm").agg(F.sum("exposed_users").alias("observed"))
    days = x.groupBy("flag_key", "served", "allocation_slice", "exposure_date").agg(F.sum("exposed_users").alias("n"))
    g = log.select("flag_key", "allocation_slice", F.col("day").alias("exposure_date"), "arm", "weight")
    want = days.join(g, ["flag_key", "allocation_slice", "exposure_date"]).groupBy("flag_key", "served", "arm").agg(F.sum(F.col("n") * F.col("weight")).alias("expected"))
    y = want.join(seen, ["flag_key", "served", "arm"], "full_outer").na.fill({"observed": 0, "expected": 0.0})
    term = F.when(F.col("expected") > 0, (F.col("observed") - F.col("expected")) * (F.col("observed") - F.col("expected")) / F.col("expected")).when(F.col("observed") > 0, F.lit(float("inf"))).otherwise(0.0)
    chi = y.groupBy("flag_key", "served").agg(F.sum("observed").alias("exposures"), F.sum(term).alias("chi_square"), (C.tally(F.col("expected") > 0) - 1).alias("df"))
    return chi.withColumn("p_value", chi_square_tail("chi_square", "df"))


def holdout_share(rows: DataFrame, expected: float) -> DataFrame:
    h = rows.groupBy("flag_key").agg(C.sum_if(F.col("allocation_slice") == "holdout", F.col("exposed_users")).alias("holdout"), F.sum("exposed_users").alias("total"))
    e, t = F.lit(expected), F.col("total")
    chi = (F.col("holdout") - t * e) * (F.col("holdout") - t * e) / (t * e) + (t - F.col("holdout") - t * (1 - e)) * (t - F.col("holdout") - t * (1 - e)) / (t * (1 - e))
    return h.withColumn("chi_square", chi).withColumn("p_value", chi_square_tail("chi_square", F.lit(1)))


def coverage_spread(rows: DataFrame) -> DataFrame:
    """Largest minus smallest share of scored users over the arms of a flag."""
    a = rows.groupBy("flag_key", "arm").agg(C.safe_divide(F.sum("scored_users"), F.sum("exposed_users")).alias("coverage"))
    return a.groupBy("flag_key").agg(F.min("coverage").alias("lowest"), F.max("coverage").alias("highest"), (F.max("coverage") - F.min("coverage")).alias("spread"))


def _nig(mu0: Column, kappa0: Column, alpha0: Column, beta0: Column, n: Column, mean: Column, var: Column, name: str) -> Column:
    m, some = F.coalesce(mean, F.lit(0.0)), n > 0
    kappa = kappa0 + n
    return F.when(some, F.struct(
        ((kappa0 * mu0 + n * m) / kappa).alias("mu"), kappa.alias("kappa"), (alpha0 + n / 2).alias("alpha"),
        (beta0 + n * var / 2 + kappa0 * n * (m - mu0) * (m - mu0) / (2 * kappa)).alias("beta"),
    )).otherwise(F.struct(mu0.alias("mu"), kappa0.alias("kappa"), alpha0.alias("alpha"), beta0.alias("beta"))).alias(name)


def posteriors(moments: DataFrame, global_moments: DataFrame, pooled: DataFrame, mean_count: float, var_count: float, strength: float) -> DataFrame:
    """Conjugate normal posterior per target and arm, shrunk to the arm's posterior over all targets.

    ``moments`` / ``global_moments``: n_eff, mean, variance; ``pooled``: flag_key, n, s, q of all arms.
    """
    pm = C.safe_divide("s", "n")
    weak = pooled.select("flag_key", F.coalesce(pm, F.lit(0.0)).alias("m0"), F.greatest(F.coalesce(C.safe_divide("q", "n") - pm * pm, F.lit(0.0)), 1e-9 * (1 + F.coalesce(pm * pm, F.lit(0.0)))).alias("v0"))
    a0 = F.lit(1 + var_count / 2)
    g = global_moments.join(weak, "flag_key").select("flag_key", "arm", "v0", _nig(F.col("m0"), F.lit(mean_count), a0, (a0 - 1) * F.col("v0"), F.col("n_eff"), F.col("mean"), F.col("variance"), "g"))
    s2 = F.when(F.col("g.alpha") > 1, F.col("g.beta") / (F.col("g.alpha") - 1)).otherwise(F.col("v0"))
    x = moments.join(g, ["flag_key", "arm"]).withColumn("_s2", s2)
    post = _nig(F.col("g.mu"), F.lit(float(strength)), a0, (a0 - 1) * F.col("_s2"), F.col("n_eff"), F.col("mean"), F.col("variance"), "p")
    return x.select("flag_key", "target", "arm", "n_eff", post).select("flag_key", "target", "arm", "n_eff", "p.*")


def beta_posterior(moments: DataFrame, pooled_rate: Column, mean_count: float) -> DataFrame:
    """Beta posterior of a rate from effective trials and the weighted mean."""
    p = F.least(F.greatest(pooled_rate, F.lit(1e-6)), F.lit(1 - 1e-6))
    t = F.greatest(F.col("n_eff"), F.lit(0.0))
    ok = F.least(t, F.greatest(t * F.coalesce("mean", F.lit(0.0)), F.lit(0.0)))
    return moments.withColumn("a", p * mean_count + ok).withColumn("b", (1 - p) * mean_count + t - ok)


def _uniform(seed: int, draw: Column, purpose: Column, candidate: Column) -> Column:
    """A number in (0, 1) that depends on the seed, the arm, the draw and its purpose alone."""
    key = F.concat_ws("|", F.lit(str(seed)), "flag_key", "target", "arm", draw.cast("string"), purpose.cast("string"), candidate.cast("string"))
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / 2.0**48


def _normal(seed: int, draw: Column, purpose: int, candidate: Column) -> Column:
    """A standard normal draw from two uniforms."""
    u, v = _uniform(seed, draw, F.lit(purpose), candidate), _uniform(seed, draw, F.lit(purpose + 1), candidate)
    return F.sqrt(-2 * F.ln(u)) * F.cos(F.lit(2 * math.pi) * v)


#: Candidates of a gamma draw; each is accepted with a probability of 0.95 or more, so all fail once in 10^15 draws.
CANDIDATES = 12


def p_best(post: DataFrame, draws: int, seed: int) -> DataFrame:
    """P(best) and expected loss per target from seeded draws of each arm's mean reward.

    Every draw is an expression of hashes of (seed, arm, draw), so it depends on neither partitioning nor order and any engine can
    repeat it. The variance is beta over a gamma draw by rejection (d = alpha - 1/3): the first of ``CANDIDATES`` candidates that is
    accepted (the last where none is). An alpha below 1 is drawn at alpha + 1 and brought down by a power of a uniform.
    """
    x = post.select("flag_key", "target", "arm", "mu", "kappa", "alpha", "beta", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    d = F.when(F.col("alpha") < 1, F.col("alpha") + 1).otherwise(F.col("alpha")) - F.lit(1.0) / 3
    c = 1 / F.sqrt(9 * d)

    def candidate(t: Column) -> Column:
        z, u = t["z"], t["u"]
        root = 1 + c * z
        v = root * root * root
        fits = (root > 0) & (F.ln(u) < 0.5 * z * z + d - d * v + d * F.ln(F.when(root > 0, v).otherwise(1.0)))
        return F.struct(fits.alias("fits"), (d * v).alias("gamma"))

    # the uniforms of a candidate are hashed once, before they are used several times
    seeds = F.transform(F.sequence(F.lit(0), F.lit(CANDIDATES - 1)), lambda j: F.struct(_normal(seed, F.col("draw"), 0, j).alias("z"), _uniform(seed, F.col("draw"), F.lit(2), j).alias("u")))
    x = x.withColumn("_seeds", seeds)
    tried = F.transform("_seeds", candidate)
    x = x.withColumn("_tried", tried).withColumn("_gamma", F.coalesce(F.get(F.filter("_tried", lambda t: t["fits"]), F.lit(0))["gamma"], F.element_at("_tried", -1)["gamma"]))
    lower = F.when(F.col("alpha") < 1, F.pow(_uniform(seed, F.col("draw"), F.lit(5), F.lit(0)), 1 / F.col("alpha"))).otherwise(1.0)
    sigma2 = F.col("beta") / F.greatest(F.col("_gamma") * lower, F.lit(1e-300))
    value = F.col("mu") + F.sqrt(sigma2 / F.col("kappa")) * _normal(seed, F.col("draw"), 3, F.lit(0))
    x = x.select("flag_key", "target", "arm", "draw", value.alias("x"))
    best = x.groupBy("flag_key", "target", "draw").agg(F.max("x").alias("top"))
    j = x.join(best, ["flag_key", "target", "draw"])
    return j.groupBy("flag_key", "target", "arm").agg(F.avg((F.col("x") == F.col("top")).cast("double")).alias("p_best"), F.avg(F.col("top") - F.col("x")).alias("expected_loss"))


def required_n(variance: Column, mde: float, floor: int, z: float = Z_975 + Z_80) -> Column:
    """Users per arm to see a gap of ``mde`` (two-sided 5%, power 80% by default)."""
    return F.greatest(F.lit(floor), F.ceil(2 * z * z * variance / (mde * mde)))


def apply_resets(rows: DataFrame, resets: DataFrame) -> DataFrame:
    """Drop exposure days before the flag's latest reset and rows of older score models."""
    last = resets.groupBy("flag_key").agg(F.max("reset_date").alias("_r"))
    x = rows.join(last, "flag_key", "left").where(F.col("_r").isNull() | (F.col("exposure_date") >= F.col("_r"))).drop("_r")
    newest = x.groupBy("flag_key").agg(F.max(F.struct("exposure_date", "model_version"))["model_version"].alias("_m"))
    return x.join(newest, "flag_key").where(F.col("model_version") == F.col("_m")).drop("_m")


def stats_from_ci(x: DataFrame, n: str, mean: str, low: str, high: str, z: float) -> DataFrame:
    """Sum and sum of squares recovered from a published mean, interval and n."""
    sd = (F.col(high) - F.col(low)) / (2 * z) * F.sqrt(F.col(n))
    return x.withColumn("s", F.col(n) * F.col(mean)).withColumn("q", (F.col(n) - 1) * sd * sd + F.col(n) * F.col(mean) * F.col(mean))

"""Experiment exposures, user readout, arm readout and the daily sufficient statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators.rows import bounded, keep_first, valid_on
from tidemark.operators.running import Agg, lookup
from tidemark.params import Params
from tidemark.plans.scores_24h import fees

SEGMENT = ("country_bucket", "device", "acquisition_channel")


def exposures(rows: DataFrame) -> DataFrame:
    """First exposure per user and flag; exposure events outrank first-seen properties. Users of two arms are kept."""
    first = keep_first(rows, ["user_id", "flag_key"], [F.col("source_priority"), F.col("event_time"), F.col("event_id")])
    arms = rows.groupBy("user_id", "flag_key").agg(F.countDistinct("arm").alias("n_distinct_arms"))
    return first.join(arms, ["user_id", "flag_key"]).select("user_id", "flag_key", "arm", F.col("event_time").alias("first_exposed_at"), "source_priority", "n_distinct_arms")


def allocation_log(spark, rows: DataFrame | None) -> DataFrame:
    """Logged assignment probabilities as dated intervals; an empty typed table when nothing was logged."""
    ddl = "flag_key string, arm string, allocation_slice string, valid_from date, valid_to date, assignment_probability double, data_origin string"
    return spark.createDataFrame([], ddl) if rows is None else rows.select(*[c.split()[0] for c in ddl.split(", ")])


def propensity(x: DataFrame, log: DataFrame) -> DataFrame:
    """Attach the assignment probability in force on the exposure date (NULL when not logged)."""
    g = log.select(F.col("flag_key").alias("_f"), F.col("arm").alias("_a"), F.col("allocation_slice").alias("_s"), "valid_from", "valid_to", F.col("assignment_probability").alias("propensity"), "data_origin")
    on = (F.col("flag_key") == F.col("_f")) & (F.col("arm") == F.col("_a")) & (F.col("allocation_slice") == F.col("_s")) & valid_on(F.col("exposure_date"), F.col("valid_from"), F.col("valid_to"))
    y = x.join(bounded(g), on, "left").drop("_f", "_a", "_s", "valid_from", "valid_to")
    return y.withColumn("propensity_source", F.when(F.col("propensity").isNotNull(), F.coalesce("data_origin", F.lit("allocation_log"))).otherwise("unavailable")).drop("data_origin")


def cuped_covariate(outcomes: DataFrame, segments: DataFrame, p: Params) -> DataFrame:
    """Cross-fitted mean profit of a segment, shrunk to the fold mean: (fold, segment) -> covariate.

    A held-out fold learns from all other folds: totals minus the own fold's cell.
    """
    x = outcomes.where("is_horizon_complete").join(segments, "user_id")
    cells = x.groupBy("cf_fold", *SEGMENT).agg(F.count(F.lit(1)).alias("n"), F.sum("realized_profit").alias("v"))
    folds = cells.groupBy("cf_fold").agg(F.sum("n").alias("fn"), F.sum("v").alias("fv"))
    every = Window.partitionBy()
    # one row per fold
    fold_mean = folds.select("cf_fold", C.safe_divide(F.sum("fv").over(every) - F.col("fv"), F.nullif(F.sum("fn").over(every) - F.col("fn"), F.lit(0))).alias("fold_mean"))
    total = cells.groupBy(*SEGMENT).agg(F.sum("n").alias("tn"), F.sum("v").alias("tv"))
    grid = total.select("*", F.explode(F.sequence(F.lit(0), F.lit(p.folds - 1))).alias("cf_fold"))
    y = grid.join(cells, ["cf_fold", *SEGMENT], "left").join(fold_mean, "cf_fold", "left")
    n, v = F.col("tn") - F.coalesce("n", F.lit(0)), F.col("tv") - F.coalesce("v", F.lit(0.0))
    out = y.select("cf_fold", *SEGMENT, F.round(C.shrink(v, n, F.col("fold_mean"), p.cuped_prior_users), 6).alias("cuped_covariate"))
    return out.unionByName(fold_mean.select("cf_fold", F.round("fold_mean", 6).alias("cuped_covariate")), allowMissingColumns=True)


def user_readout(expo: DataFrame, scores: DataFrame, purch: DataFrame, adj: DataFrame, usage: DataFrame, events: DataFrame, segments: DataFrame, channels: DataFrame, log: DataFrame, covariates: DataFrame, p: Params) -> DataFrame:
    """One row per exposed user and flag: intention-to-treat arm, matured outcome, score, residual, covariate."""
    e = expo.withColumn("horizon_end", C.add_seconds("first_exposed_at", p.horizon_days * 86_400))
    span = e.select("user_id", "flag_key", "first_exposed_at", "horizon_end")
    inside = lambda t: (F.col(t) >= F.col("first_exposed_at")) & (F.col(t) < F.col("horizon_end"))
    key = ["user_id", "flag_key"]
    w = purch.join(span, "user_id").where(inside("occurred_at"))
    money = w.groupBy(*key).agg(F.min(F.when(F.col("event_name") == "purchase_first", F.col("occurred_at"))).alias("first_sub"), F.sum("revenue_minor").alias("rev"), F.sum("cash_minor").alias("cash"), F.count(F.lit(1)).alias("charges"))
    a = adj.select("adjusts_event_id", F.col("occurred_at").alias("out_at"), F.col("cash_minor").alias("out"), (F.col("event_name") == "chargeback").alias("cb"))
    back = w.select(*key, F.col("event_id").alias("adjusts_event_id"), "horizon_end").join(a, "adjusts_event_id").where(F.col("out_at") < F.col("horizon_end"))
    back = back.groupBy(*key).agg(F.sum("out").alias("adj"), C.tally(F.col("cb")).alias("cbs"), F.count(F.lit(1)).alias("adjs"))
    cost = usage.join(span, "user_id").where(inside("created_at")).groupBy(*key).agg(F.sum("cost_micros").alias("cost"))
    e = lookup(e, events, ["user_id"], "first_exposed_at", "event_time", [Agg("pre_exposure_events", "count")], inclusive=False, block_seconds=None)
    x = e
    for side in (money, back, cost):
        x = x.join(side, key, "left")
    x = x.join(segments, "user_id", "left").join(channels.select("user_id", (F.col("acquisition_channel") == "affiliate").alias("aff")), "user_id", "left")
    for c in ("rev", "cash", "charges", "adj", "cbs", "adjs", "cost", "pre_exposure_events"):
        x = x.withColumn(c, F.coalesce(c, F.lit(0)))
    x = x.withColumn("fee", F.round(fees(F.col("cash"), F.col("charges"), F.col("rev"), F.col("cbs"), F.coalesce("aff", F.lit(False)), p), 6))
    x = x.withColumn("exposure_date", F.to_date("first_exposed_at")).withColumn("allocation_slice", C.holdout_slice("user_id", p.holdout_key_pattern)).withColumn("cf_fold", C.fold("user_id", p.folds))
    x = propensity(x, log)
    s = scores.select("user_id", F.lit(True).alias("is_scored"), "paid_within_24h", "activated_24h", "generations_24h", "failed_generations_24h", "predicted_profit", "predicted_revenue", "predicted_generation_cost", "predicted_fees",
                      "predicted_refund_risk", "p_convert", "unconditional_cost", (F.col("p_convert") * F.col("value_if_converted")).alias("expected_value_if_converted"), "model_version")
    x = x.join(s, "user_id", "left")
    by_segment = covariates.where("country_bucket is not null")
    by_fold = covariates.where("country_bucket is null").select("cf_fold", F.col("cuped_covariate").alias("_fc"))
    x = x.join(by_segment, ["cf_fold", *SEGMENT], "left").join(F.broadcast(by_fold), "cf_fold", "left")
    matured = F.col("horizon_end") <= F.lit(p.as_of)
    m = lambda c: F.when(matured, c)
    net = F.col("rev") / 100 + F.col("adj") / 100
    conv = F.col("first_sub").isNotNull()
    profit = F.round(net - F.col("cost") / 1_000_000 - F.col("fee"), 6)
    return x.select(
        "user_id", "flag_key", "arm", "first_exposed_at", "exposure_date", (F.col("n_distinct_arms") > 1).alias("is_contaminated"), *SEGMENT, "allocation_slice", "cf_fold", "propensity", "propensity_source",
        F.coalesce("is_scored", F.lit(False)).alias("is_scored"), F.coalesce("paid_within_24h", F.lit(False)).alias("paid_within_24h"), F.coalesce("activated_24h", F.lit(False)).alias("activated_24h"),
        F.coalesce(F.col("generations_24h") + F.col("failed_generations_24h"), F.lit(0)).alias("generations_started_24h"), F.coalesce("failed_generations_24h", F.lit(0)).alias("failed_generations_24h"),
        "predicted_profit", "predicted_revenue", "predicted_generation_cost", "predicted_fees", "predicted_refund_risk", "p_convert", "unconditional_cost", "expected_value_if_converted", "model_version", "pre_exposure_events",
        F.coalesce(F.col("first_sub") < C.add_seconds("first_exposed_at", p.maturity_days * 86_400), F.lit(False)).alias("converted_in_conversion_window"), conv.alias("converted_in_horizon"), matured.alias("is_matured"),
        m(conv).alias("realised_converted"), m(net).alias("realised_net_revenue"), m(F.col("cost") / 1_000_000).alias("realised_generation_cost"), m(F.col("fee")).alias("realised_fees"),
        m(conv & (F.col("adjs") > 0)).alias("realised_refunded"), m(F.when(conv, F.least(net - F.col("fee"), F.lit(p.value_cap))).otherwise(0.0)).alias("matured_value_capped"), m(profit).alias("realised_profit"),
        m(F.round(profit - F.col("predicted_profit"), 6)).alias("residual"), F.coalesce("cuped_covariate", "_fc").alias("cuped_covariate"))


def bootstrap(users: DataFrame, p: Params) -> DataFrame:
    """Deterministic Poisson bootstrap of the prediction-powered mean per arm.

    Each scored user is repeated per replicate and folded away again in the same task
    (the grouped state has arms x replicates entries), so nothing wide is shuffled.
    """
    reps = F.explode(F.sequence(F.lit(0), F.lit(p.bootstrap_replicates - 1))).alias("replicate")
    x = users.where("is_scored").select("user_id", "flag_key", "arm", "predicted_profit", "residual", reps)
    w = C.poisson_weight(C.uniform(F.concat_ws(":", F.col("user_id").cast("string"), "flag_key", F.col("replicate").cast("string"))))
    x = x.withColumn("w", w)
    known = F.col("residual").isNotNull()
    r = x.groupBy("flag_key", "arm", "replicate").agg(
        F.sum("w").alias("n"), F.sum(F.col("w") * F.col("predicted_profit")).alias("s"), F.sum(F.when(known, F.col("w"))).alias("rn"), F.sum(F.when(known, F.col("w") * F.col("residual"))).alias("rs"))
    r = r.withColumn("est", C.safe_divide("s", "n") + F.coalesce(C.safe_divide("rs", "rn"), F.lit(0.0)))
    return r.groupBy("flag_key", "arm").agg(C.quantile("est", 0.025).alias("ppi_bootstrap_low"), C.quantile("est", 0.975).alias("ppi_bootstrap_high"))


def arm_readout(users: DataFrame, p: Params) -> DataFrame:
    """Arm means, intervals, post-stratified, prediction-powered and covariate-adjusted estimates, and ranks."""
    z = p.ci_z
    scored, paid, matured = F.col("is_scored"), F.col("paid_within_24h"), F.col("is_matured")
    pred, cov = F.col("predicted_profit"), F.col("cuped_covariate")
    early, later = F.when(scored & paid, pred), F.when(scored & ~paid, pred)
    flag = users.groupBy("flag_key").agg(
        F.avg(F.when(scored, paid.cast("double"))).alias("w"), F.var_samp("residual").alias("rv_pool"), F.count("residual").alias("rn_pool"), F.avg(F.when(matured, cov)).alias("cov_mean"),
        C.safe_divide(F.avg(F.when(matured, cov * F.col("realised_profit"))) - F.avg(F.when(matured, cov)) * F.avg(F.when(matured, F.col("realised_profit"))),
                      F.nullif(F.avg(F.when(matured, cov * cov)) - F.avg(F.when(matured, cov)) * F.avg(F.when(matured, cov)), F.lit(0.0))).alias("theta"))
    a = users.groupBy("flag_key", "arm").agg(
        F.count(F.lit(1)).alias("exposed_users"), C.tally(F.col("is_contaminated")).alias("contaminated_users"), C.tally(F.col("converted_in_horizon")).alias("converters"), C.tally(matured).alias("matured_users"),
        F.avg("realised_net_revenue").alias("revenue"), F.stddev_samp("realised_net_revenue").alias("revenue_sd"), F.avg("realised_generation_cost").alias("cost"), F.avg("realised_profit").alias("profit"),
        F.stddev_samp("realised_profit").alias("profit_sd"), F.avg(F.when(matured, cov)).alias("cov_arm"), C.tally(scored).alias("scored_users"), F.avg(pred).alias("pred"), F.stddev_samp(pred).alias("pred_sd"),
        F.count("residual").alias("residual_users"), F.avg("residual").alias("bias"), F.var_samp("residual").alias("rv_arm"), F.count(early).alias("n1"), F.count(later).alias("n0"), F.avg(early).alias("m1"), F.avg(later).alias("m0"),
        F.var_samp(early).alias("v1"), F.var_samp(later).alias("v0"), C.safe_divide(F.sum("expected_value_if_converted"), F.sum("p_convert")).alias("value_if_converted"), F.min("propensity").alias("min_propensity"))
    a = a.join(flag, "flag_key")
    model_var = F.when(F.col("residual_users") >= p.min_matured_for_arm_error, F.col("rv_arm") / F.col("residual_users")).when(F.col("rn_pool") > 1, F.col("rv_pool") / F.col("rn_pool"))
    rate = F.col("converters") / F.col("exposed_users")
    both = (F.col("n1") > 0) & (F.col("n0") > 0)
    w = F.col("w")
    sampling = F.col("pred_sd") * F.col("pred_sd") / F.nullif("scored_users", F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    strat_var = F.when(both, w * w * zero(F.col("v1")) / F.col("n1") + (1 - w) * (1 - w) * zero(F.col("v0")) / F.col("n0")).otherwise(sampling)
    a = a.withColumn("conversion_rate", rate).withColumn("model_var", model_var).withColumn("stratified", F.when(both, w * F.col("m1") + (1 - w) * F.col("m0")).otherwise(F.col("pred")))
    a = a.withColumn("half", F.lit(z) * F.sqrt(zero(sampling) + zero(F.col("model_var")))).withColumn("strat_half", F.lit(z) * F.sqrt(zero(strat_var) + zero(F.col("model_var"))))
    rate_half = F.lit(z) * F.sqrt(rate * (1 - rate) / F.col("exposed_users"))
    profit_half = F.lit(z) * F.col("profit_sd") / F.sqrt(F.nullif("matured_users", F.lit(0)))
    ranked = lambda c: F.rank().over(Window.partitionBy("flag_key").orderBy(F.col(c).desc_nulls_last()))
    a = a.withColumn("conversion_rank", ranked("conversion_rate")).withColumn("predicted_rank", ranked("pred")).withColumn("realised_rank", ranked("profit"))
    by_flag = Window.partitionBy("flag_key")
    a = a.withColumn("_cw", F.max(F.when(F.col("conversion_rank") == 1, F.col("pred"))).over(by_flag)).withColumn("_pw", F.max(F.when(F.col("predicted_rank") == 1, F.col("pred"))).over(by_flag))
    r6 = lambda c, n: F.round(c, 6).alias(n)
    return a.select(
        "flag_key", "arm", "exposed_users", "contaminated_users", "converters", "matured_users", "scored_users", "residual_users", r6(rate, "conversion_rate"), r6(rate - rate_half, "conversion_low"), r6(rate + rate_half, "conversion_high"),
        r6(F.col("revenue"), "revenue_per_exposed"), r6(F.col("cost"), "cost_per_exposed"), r6(F.col("profit"), "realised_profit_per_exposed"), r6(F.col("profit") - profit_half, "realised_low"), r6(F.col("profit") + profit_half, "realised_high"),
        r6(F.col("pred"), "predicted_profit_per_exposed"), r6(F.col("pred") - F.col("half"), "predicted_low"), r6(F.col("pred") + F.col("half"), "predicted_high"),
        r6(F.col("stratified"), "stratified_per_exposed"), r6(F.col("stratified") - F.col("strat_half"), "stratified_low"), r6(F.col("stratified") + F.col("strat_half"), "stratified_high"),
        r6(F.col("bias"), "model_bias"), r6(F.sqrt("model_var"), "model_error_se"), r6(F.col("pred") + zero(F.col("bias")), "ppi_per_exposed"),
        r6(F.col("profit") - F.col("theta") * (F.col("cov_arm") - F.col("cov_mean")), "cuped_per_exposed"), r6(F.col("theta"), "cuped_theta"), r6(F.col("value_if_converted"), "value_if_converted"), "min_propensity",
        "conversion_rank", "predicted_rank", "realised_rank", r6(F.col("pred") - F.col("_cw"), "predicted_vs_conversion_winner"), r6(F.col("_pw") - F.col("_cw"), "profit_left_by_conversion_ranking"))


GRAIN = ("exposure_date", "flag_key", "arm", *SEGMENT, "allocation_slice")


def daily_readout(users: DataFrame, p: Params) -> DataFrame:
    """Sufficient statistics per day, flag, arm, segment and slice."""
    s, x, m = F.col("is_scored"), F.col("cuped_covariate"), F.col("is_matured")
    y, v, cost = F.col("predicted_profit"), F.col("matured_value_capped"), F.col("realised_generation_cost")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return users.groupBy(*GRAIN).agg(
        F.count(F.lit(1)).alias("exposed_users"), C.tally(s).alias("scored_users"), C.tally(s & F.col("converted_in_conversion_window")).alias("converted_users"), total(y).alias("sum_predicted_profit"),
        total(y * y).alias("sum_sq_predicted_profit"), *[total(F.col(c)).alias("sum_" + c) for c in ("predicted_revenue", "predicted_generation_cost", "predicted_fees", "predicted_refund_risk")],
        F.coalesce(F.max("model_version"), F.lit(p.pp_model_version)).alias("model_version"), C.tally(F.col("is_contaminated")).alias("contaminated_users"), C.tally(m).alias("matured_users"),
        C.tally(F.col("realised_converted")).alias("matured_converted_users"), total(v).alias("sum_matured_value"), total(v * v).alias("sum_sq_matured_value"), total(cost).alias("sum_matured_cost"),
        total(cost * cost).alias("sum_sq_matured_cost"), C.tally(F.col("realised_refunded")).alias("matured_refunded_users"), C.tally(s & F.col("activated_24h")).alias("activated_users"),
        F.coalesce(F.sum(F.when(s, F.col("generations_started_24h"))), F.lit(0)).alias("generations_24h"), F.coalesce(F.sum(F.when(s, F.col("failed_generations_24h"))), F.lit(0)).alias("failed_generations_24h"),
        total(F.when(s, x)).alias("sum_covariate"), total(F.when(s, x * x)).alias("sum_sq_covariate"), total(x * y).alias("sum_predicted_profit_x_covariate"), F.sum("propensity").alias("sum_propensity"),
        F.sum(1 / F.nullif("propensity", F.lit(0.0))).alias("sum_inverse_propensity"), F.count("residual").alias("residual_users"), total(F.col("residual")).alias("sum_residual"))


OPTIONAL_GROUPS = {
    "matured": ("matured_users", "matured_converted_users", "sum_matured_value", "sum_sq_matured_value", "sum_matured_cost", "sum_sq_matured_cost", "matured_refunded_users"),
    "guardrail": ("activated_users", "generations_24h", "failed_generations_24h"),
    "covariate": ("sum_covariate", "sum_sq_covariate", "sum_predicted_profit_x_covariate"),
}


def validate_daily(rows: DataFrame) -> DataFrame:
    """Violations of the daily-row contract: counts, all-or-none groups, Cauchy-Schwarz, identity, unique grain."""
    c = F.col

    def spread(n, s, q):
        floor = F.when(c(n) > 0, c(s) * c(s) / c(n)).otherwise(0.0)
        return (c(q) + 1e-6 * (1 + F.abs(floor)) < floor) | ((c(n) == 0) & ((c(s) != 0) | (c(q) != 0)))

    parts = c("sum_predicted_revenue") - c("sum_predicted_generation_cost") - c("sum_predicted_fees") - c("sum_predicted_refund_risk")
    rules: dict[str, Column] = {
        "scored_users > exposed_users": c("scored_users") > c("exposed_users"), "converted_users > scored_users": c("converted_users") > c("scored_users"),
        "sum_sq_predicted_profit inconsistent": spread("scored_users", "sum_predicted_profit", "sum_sq_predicted_profit"),
        "profit identity": F.abs(parts - c("sum_predicted_profit")) > 0.01 * F.greatest(F.lit(1), c("scored_users")) + 1e-6,
        "matured_users > exposed_users": c("matured_users") > c("exposed_users"), "matured_converted_users > matured_users": c("matured_converted_users") > c("matured_users"),
        "matured_refunded_users > matured_converted_users": c("matured_refunded_users") > c("matured_converted_users"), "sum_sq_matured_value inconsistent": spread("matured_converted_users", "sum_matured_value", "sum_sq_matured_value"),
        "sum_sq_matured_cost inconsistent": spread("matured_users", "sum_matured_cost", "sum_sq_matured_cost"), "activated_users > scored_users": c("activated_users") > c("scored_users"),
        "failed_generations_24h > generations_24h": c("failed_generations_24h") > c("generations_24h"), "sum_sq_covariate inconsistent": spread("scored_users", "sum_covariate", "sum_sq_covariate"),
    }
    for name, cols in OPTIONAL_GROUPS.items():
        present = sum((c(x).isNotNull().cast("int") for x in cols), F.lit(0))
        rules[f"{name} columns are all-or-none"] = (present != 0) & (present != len(cols))
    found = F.filter(F.array(*[F.when(test, F.lit(n)) for n, test in rules.items()]), lambda v: v.isNotNull())
    broken = rows.select(*GRAIN, F.explode(found).alias("violation"))
    twice = rows.groupBy(*GRAIN).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*GRAIN, F.lit("duplicate grain").alias("violation"))
    return broken.unionByName(twice)

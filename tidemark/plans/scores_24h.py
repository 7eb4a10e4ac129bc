"""24-hour features, outcomes, fits and scores."""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators.rows import beside
from tidemark.params import Params


def content_ref(params: DataFrame) -> DataFrame:
    """Content hash of name=value rows. The parameter table is a short list by construction."""
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("name", "value"))), lambda p: F.concat_ws("=", p["name"], p["value"]))
    return params.agg(F.sha2(F.array_join(pairs, "|"), 256).alias("content_ref"))


# Money inside these jobs is whole minor units and usage cost whole micro-units, so
# every sum is exact, merges over partitions and does not depend on row order.

SEGMENTS = ("not_activated", "activated", "activated_depleted")


def segment() -> Column:
    return (
        F.when(F.col("paid_within_24h"), "paid_24h").when(~F.col("activated_24h"), "not_activated")
        .when(F.col("trial_depleted_24h"), "activated_depleted").otherwise("activated")
    )


def features_24h(users: DataFrame, usage: DataFrame, purch: DataFrame, balances: DataFrame, exposures: DataFrame, acquisition: DataFrame, flags: Sequence[str], p: Params) -> DataFrame:
    """Everything knowable before signup + 24 hours, one row per user (user_id, signup_at)."""
    u = users.select("user_id", "signup_at", C.add_seconds("signup_at", 86_400).alias("window_end"))
    end = F.col("window_end")
    g = usage.join(u, "user_id").where((F.col("created_at") >= F.col("signup_at")) & (F.col("created_at") < end))
    ok, video = ~F.col("is_failed"), F.col("media_type") == "video"
    # a user's models first: their counts give the mix, and everything else adds up over them
    sums = ("generations_24h", "failed_generations_24h", "video_generations_24h", "credits_consumed_24h", "video_credits_24h", "cost_24h_micros")
    models = g.groupBy("user_id", "model_id").agg(
        C.tally(ok).alias("generations_24h"), C.tally(~ok).alias("failed_generations_24h"), C.tally(ok & video).alias("video_generations_24h"),
        C.sum_if(ok, F.col("credits")).alias("credits_consumed_24h"), C.sum_if(ok & video, F.col("credits")).alias("video_credits_24h"),
        F.sum("cost_micros").alias("cost_24h_micros"), F.min("created_at").alias("first_generation_at"), F.max("created_at").alias("last_generation_at"),
    )
    used, n = F.col("generations_24h") > 0, F.col("generations_24h")
    mix = C.kv_json(F.when(used, F.col("model_id")), n)
    stats = models.groupBy("user_id").agg(
        *[F.sum(c).alias(c) for c in sums], F.count(F.when(used, F.col("model_id"))).alias("distinct_models_24h"),
        F.min("first_generation_at").alias("first_generation_at"), F.max("last_generation_at").alias("last_generation_at"),
        F.when(F.sum(n) > 0, mix).alias("model_mix_24h"), F.min(F.when(used, F.struct((-n).alias("n"), "model_id")))["model_id"].alias("top_model_24h"),
    )
    arms = exposures.join(u, "user_id").where(F.col("first_exposed_at") < end).groupBy("user_id").agg(
        *[F.max(F.when(F.col("flag_key") == f, F.col("arm"))).alias(f"arm_{i}") for i, f in enumerate(flags)])
    trial = balances.join(u, "user_id").where(F.col("created_at") < end).groupBy("user_id").agg(
        F.max(F.struct("created_at", "entry_id", "balance_after"))["balance_after"].alias("trial_credits_remaining_24h"))
    first = purch.join(u, "user_id").where(F.col("occurred_at") < end).groupBy("user_id").agg(
        F.min(F.struct("occurred_at", "event_id", "event_name", "plan_tier", "billing_interval", "revenue_minor")).alias("fp"))
    x = beside(u, [stats, arms, trial, first, acquisition.select("user_id", "acquisition_channel")], "user_id")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return x.select(
        "user_id", "signup_at", F.col("window_end").alias("feature_window_end"), (end <= F.lit(p.as_of)).alias("is_window_complete"), C.fold("user_id", p.folds).alias("cf_fold"),
        C.week_start("signup_at").alias("signup_week"), F.col("fp.event_name").alias("first_purchase_event_name"), F.col("fp.occurred_at").alias("first_purchase_at"),
        F.col("fp.plan_tier").alias("plan_tier"), F.col("fp.billing_interval").alias("billing_interval"), F.col("fp.revenue_minor").alias("first_purchase_minor"),
        F.col("fp").isNotNull().alias("paid_within_24h"), zero("generations_24h"), zero("failed_generations_24h"), (F.coalesce("generations_24h", F.lit(0)) > 0).alias("activated_24h"),
        "first_generation_at", "last_generation_at", zero("video_generations_24h"), C.safe_divide("video_generations_24h", "generations_24h").alias("video_share_24h"),
        zero("credits_consumed_24h"), C.safe_divide("video_credits_24h", "credits_consumed_24h").alias("video_credit_share_24h"), zero("cost_24h_micros"), zero("distinct_models_24h"),
        "top_model_24h", "model_mix_24h", "trial_credits_remaining_24h", F.coalesce(F.col("trial_credits_remaining_24h") < p.trial_min_credits, F.lit(False)).alias("trial_depleted_24h"),
        *[f"arm_{i}" for i in range(len(flags))], F.coalesce("acquisition_channel", F.lit("organic")).alias("acquisition_channel"),
    )


def fees(cash_minor, charges, revenue_minor, chargebacks, affiliate, p: Params) -> Column:
    """Payment, affiliate and dispute fees of a window, in major units."""
    return (
        cash_minor / 100 * F.lit(p.fee_pct) + charges * F.lit(p.fee_fixed) + F.when(affiliate, revenue_minor / 100 * F.lit(p.affiliate_pct)).otherwise(0.0)
        + chargebacks * F.lit(p.dispute_fee)
    )


def user_outcomes(features: DataFrame, purch: DataFrame, adj: DataFrame, usage: DataFrame, p: Params) -> DataFrame:
    """Realised outcome over the horizon from signup; maturity flags say what may be used yet."""
    f = features.where("is_window_complete").withColumn("segment", segment())
    f = f.withColumn("maturity_end", C.add_seconds("signup_at", p.maturity_days * 86_400)).withColumn("horizon_end", C.add_seconds("signup_at", p.horizon_days * 86_400))
    span = f.select("user_id", "signup_at", "horizon_end")
    inside = lambda t: (F.col(t) >= F.col("signup_at")) & (F.col(t) < F.col("horizon_end"))
    hp = purch.join(span, "user_id").where(inside("occurred_at"))
    money = hp.groupBy("user_id").agg(F.sum("revenue_minor").alias("revenue_minor"), F.sum("cash_minor").alias("cash_minor"), F.count(F.lit(1)).alias("charges"))
    ha = adj.where(F.col("occurred_at") <= F.lit(p.as_of)).select("adjusts_event_id", F.col("cash_minor").alias("a"), (F.col("event_name") == "chargeback").alias("cb"))
    back = hp.select("user_id", F.col("event_id").alias("adjusts_event_id")).join(ha, "adjusts_event_id").groupBy("user_id").agg(F.sum("a").alias("adjusted_minor"), C.tally(F.col("cb")).alias("chargebacks"))
    paid = (F.col("credit_field") != "trial_credit_balance") & ~F.col("is_failed")
    used = usage.join(span, "user_id").where(inside("created_at")).groupBy("user_id").agg(C.sum_if(paid, F.col("credits")).alias("paid_credits"), F.sum("cost_micros").alias("cost_micros"))
    sub = purch.where("event_name = 'purchase_first'").groupBy("user_id").agg(F.min(F.struct("occurred_at", "event_id", "revenue_minor")).alias("s"))
    x = beside(f, [money, back, used, sub], "user_id")
    for c in ("revenue_minor", "cash_minor", "charges", "adjusted_minor", "chargebacks", "paid_credits", "cost_micros"):
        x = x.withColumn(c, F.coalesce(c, F.lit(0)))
    at = F.col("s.occurred_at")
    late = (at >= F.col("feature_window_end")) & (at < F.col("maturity_end"))
    fee = fees(F.col("cash_minor"), F.col("charges"), F.col("revenue_minor"), F.col("chargebacks"), F.col("acquisition_channel") == "affiliate", p)
    x = x.withColumn("fees", F.round(fee, 6))
    profit = F.round(F.col("revenue_minor") / 100 + F.col("adjusted_minor") / 100 - F.col("cost_micros") / 1_000_000 - fee, 6)
    return x.select(
        "user_id", "segment", "signup_at", "signup_week", "cf_fold", *[c for c in x.columns if c.startswith("arm_")], (F.col("maturity_end") <= F.lit(p.as_of)).alias("is_conversion_mature"),
        (F.col("horizon_end") <= F.lit(p.as_of)).alias("is_horizon_complete"), F.coalesce(late, F.lit(False)).alias("converted_after_24h"),
        F.coalesce((at >= F.col("signup_at")) & (at < F.col("horizon_end")), F.lit(False)).alias("converted_in_horizon"), F.when(late, F.col("s.revenue_minor")).alias("first_subscription_minor"),
        "revenue_minor", "cash_minor", "charges", "adjusted_minor", "chargebacks", "paid_credits", "cost_micros", F.col("fees").alias("fees_horizon"), profit.alias("realized_profit"),
    )


def oot_weeks(outcomes: DataFrame, p: Params) -> DataFrame:
    """Most recent complete signup weeks that can be tested out of time (a handful of rows)."""
    weeks = outcomes.groupBy("signup_week").agg(F.count(F.lit(1)).alias("test_week_users"))
    ripe = F.date_add("signup_week", 7 + p.horizon_days) <= F.lit(p.as_of).cast("date")
    x = weeks.where(ripe & (F.col("signup_week") > weeks.agg(F.min("signup_week")).scalar())).orderBy(F.desc("signup_week")).limit(p.backtest_weeks)
    return x.select(F.concat(F.lit("oot_"), C.date_compact("signup_week")).alias("fit_id"), F.col("signup_week").alias("test_week_start"), F.date_add("signup_week", 7).alias("test_week_end"), "test_week_users")


def week_starts(weeks: DataFrame) -> list[date]:
    """The test weeks as a driver-side list; ``oot_weeks`` limits it to a handful."""
    return sorted(r[0] for r in weeks.select("test_week_start").collect())


def _week_array(weeks: Sequence[date]) -> Column:
    return F.array(*[F.lit(w) for w in weeks]).cast("array<date>")


def into_fits(df: DataFrame, weeks: Sequence[date], p: Params) -> DataFrame:
    """Repeat each row under every fit that may learn from it.

    Needs cf_fold and signup_week. The test weeks (at most ``backtest_weeks``) are a literal array, so no
    join multiplies rows. Statistics are first aggregated per (fold, week) cell and only the cells are repeated.
    """
    null_fold, null_week = F.lit(None).cast("int"), F.lit(None).cast("date")
    fit = lambda i, kind, k, w: F.struct(i.alias("fit_id"), F.lit(kind).alias("fit_kind"), k.alias("held_out_fold"), w.alias("test_week_start"))
    folds = F.filter(F.array(*[F.lit(k) for k in range(p.folds)]), lambda k: k != F.col("cf_fold"))
    name = lambda w: F.concat(F.lit("oot_"), F.date_format(w, "yyyyMMdd"))
    x = df.withColumn("_w", F.filter(_week_array(weeks), lambda w: w > F.col("signup_week")))
    fits = F.concat(
        F.array(fit(F.lit("all"), "all", null_fold, null_week)),
        F.transform(folds, lambda k: fit(F.concat(F.lit("xf"), k.cast("string")), "crossfit", k, null_week)),
        F.transform("_w", lambda w: fit(name(w), "out_of_time", null_fold, w)),
        F.flatten(F.transform("_w", lambda w: F.transform(folds, lambda k: fit(F.concat(name(w), F.lit("_xf"), k.cast("string")), "out_of_time_crossfit", k, w)))),
    )
    return x.select(*df.columns, F.explode(fits).alias("_f")).select(*df.columns, "_f.*")


def fit_ids(outcomes: DataFrame, weeks: Sequence[date], p: Params) -> DataFrame:
    cells = outcomes.select("cf_fold", "signup_week").distinct()
    return into_fits(cells, weeks, p).select("fit_id").distinct()


def _grid(fits: DataFrame, rows: Sequence[dict]) -> DataFrame:
    return fits.select("fit_id", F.explode(C.small_rows(rows)).alias("g")).select("fit_id", "g.*")


def segment_rates(outcomes: DataFrame, weeks: Sequence[date], p: Params) -> DataFrame:
    """Shrunk conversion rate per fit and segment, on the full grid."""
    cells = outcomes.where("is_conversion_mature and segment <> 'paid_24h'").groupBy("cf_fold", "signup_week", "segment").agg(
        F.count(F.lit(1)).alias("n"), C.tally(F.col("converted_after_24h")).alias("x"))
    seen = into_fits(cells, weeks, p).groupBy("fit_id", "segment").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    priors = [{"segment": s, "prior_rate": r} for s, r in zip(SEGMENTS, (p.prior_not_activated, p.prior_activated, p.prior_depleted))]
    grid = _grid(fit_ids(outcomes, weeks, p), priors).join(seen, ["fit_id", "segment"], "left")
    return grid.select(
        "fit_id", "segment", "prior_rate", F.coalesce("n", F.lit(0)).alias("matured_users"), F.coalesce("x", F.lit(0)).alias("conversions"),
        F.round(C.shrink(F.col("x"), F.col("n"), F.col("prior_rate"), p.prior_users), 9).alias("p_convert"))


def converter_value(outcomes: DataFrame, usage: DataFrame, weeks: Sequence[date], p: Params) -> DataFrame:
    """Value, charges and credits of a converter and the usage mix, shrunk, per fit."""
    keep = outcomes.where("is_horizon_complete and converted_in_horizon and segment <> 'paid_24h'")
    cells = keep.groupBy("cf_fold", "signup_week").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("revenue_minor", "charges", "paid_credits")])
    seen = into_fits(cells, weeks, p).groupBy("fit_id").agg(*[F.sum(c).alias(c) for c in ("n", "revenue_minor", "charges", "paid_credits")])
    u = usage.where(~F.col("is_failed")).join(outcomes.select("user_id", "cf_fold", "signup_week"), "user_id")
    trial = F.col("credit_field") == "trial_credit_balance"
    parts = {"pc": C.sum_if(~trial, F.col("credits")), "pv": C.sum_if(~trial & (F.col("media_type") == "video"), F.col("credits")), "tc": C.sum_if(trial, F.col("credits")), "tm": C.sum_if(trial, F.col("cost_micros"))}
    ucell = u.groupBy("cf_fold", "signup_week").agg(*[e.alias(k) for k, e in parts.items()])
    mix = into_fits(ucell, weeks, p).groupBy("fit_id").agg(*[F.sum(k).alias(k) for k in parts])
    x = fit_ids(outcomes, weeks, p).join(seen, "fit_id", "left").join(mix, "fit_id", "left")
    k = p.prior_converters
    return x.select(
        "fit_id", F.coalesce("n", F.lit(0)).alias("matured_converters"), F.round(C.shrink(F.col("revenue_minor") / 100, F.col("n"), p.prior_revenue, k), 9).alias("revenue_per_converter"),
        F.round(C.shrink(F.col("charges"), F.col("n"), p.prior_charges, k), 9).alias("charges_per_converter"),
        F.round(C.shrink(F.col("paid_credits"), F.col("n"), p.prior_paid_credits, k), 9).alias("paid_credits_per_converter"),
        F.round(C.shrink(F.col("pv"), F.col("pc"), p.video_credit_share, p.cpc_prior_credits), 9).alias("paid_video_credit_share"),
        F.round(C.shrink(F.col("tm") / 1_000_000, F.col("tc"), p.default_cost_per_credit, p.cpc_prior_credits), 9).alias("trial_cost_per_credit"))


MEDIA = ("image", "video")


def cost_per_credit(outcomes: DataFrame, usage: DataFrame, weeks: Sequence[date], arms: Sequence[tuple[int, str]], p: Params) -> DataFrame:
    """Cost per paid credit of each arm, shrunk to the pooled rate of its medium, per fit.

    Arm i belongs to flag i, whose medium is MEDIA[i]; ``arms`` lists (flag index, arm).
    """
    who = outcomes.select("user_id", "cf_fold", "signup_week", "arm_0", "arm_1")
    paid = usage.where(~F.col("is_failed") & (F.col("credit_field") != "trial_credit_balance") & (F.col("credits") > 0)).join(who, "user_id")
    arm = F.when(F.col("media_type") == "image", F.col("arm_0")).otherwise(F.col("arm_1"))
    cells = paid.groupBy("cf_fold", "signup_week", "media_type", arm.alias("arm")).agg(F.sum("credits").alias("c"), F.sum("cost_micros").alias("m"))
    fitted = into_fits(cells, weeks, p).groupBy("fit_id", "media_type", "arm").agg(F.sum("c").alias("c"), F.sum("m").alias("m"))
    pooled = fitted.groupBy("fit_id", "media_type").agg(F.sum("c").alias("pc"), F.sum("m").alias("pm"))
    grid = _grid(fit_ids(outcomes, weeks, p), [{"flag_index": i, "arm": a, "media_type": MEDIA[i]} for i, a in arms])
    x = grid.join(fitted, ["fit_id", "media_type", "arm"], "left").join(pooled, ["fit_id", "media_type"], "left")
    base = F.coalesce(C.safe_divide(F.col("pm") / 1_000_000, F.col("pc")), F.lit(p.default_cost_per_credit))
    return x.select(
        "fit_id", "flag_index", "arm", "media_type", F.coalesce("c", F.lit(0)).alias("measured_credits"), F.round(base, 9).alias("pooled_cost_per_credit"),
        F.round(C.shrink(F.col("m") / 1_000_000, F.col("c"), base, p.cpc_prior_credits), 9).alias("cost_per_credit"))


def arm_multipliers(outcomes: DataFrame, rates: DataFrame, weeks: Sequence[date], p: Params) -> DataFrame:
    """Shrunk ratio of observed to expected conversions of each arm, per fit and flag.

    Segment and arm cells carry counts and moments; expected conversions are cell counts times the fit's rate.
    """
    o = outcomes.where("is_conversion_mature and segment <> 'paid_24h'").withColumn("fl", F.explode(F.array(
        F.struct(F.lit(0).alias("i"), F.col("arm_0").alias("a")), F.struct(F.lit(1).alias("i"), F.col("arm_1").alias("a")))))
    v = F.when(F.col("converted_after_24h"), F.col("first_subscription_minor"))
    cells = o.groupBy("cf_fold", "signup_week", "segment", F.col("fl.i").alias("flag_index"), F.col("fl.a").alias("arm")).agg(
        F.count(F.lit(1)).alias("n"), C.tally(F.col("converted_after_24h")).alias("x"), F.count(v).alias("vn"), F.sum(v).alias("vs"), F.sum(v.cast("double") * v).alias("vq"))
    f = into_fits(cells, weeks, p).groupBy("fit_id", "segment", "flag_index", "arm").agg(*[F.sum(c).alias(c) for c in ("n", "x", "vn", "vs", "vq")])
    f = f.join(rates.select("fit_id", "segment", "p_convert"), ["fit_id", "segment"]).withColumn("e", F.col("n") * F.col("p_convert"))
    # every user sits in both flags' cells, so one flag's cells pool the whole fit
    pool = f.where("flag_index = 0").groupBy("fit_id").agg(F.sum("vn").alias("pn"), F.sum("vs").alias("ps"), F.sum("vq").alias("pq"))
    pool = pool.select("fit_id", (C.safe_divide("ps", "pn") / 100).alias("pmean"), (F.sqrt(C.sample_variance(F.col("pn"), F.col("ps"), F.col("pq"))) / 100).alias("psd"))
    a = f.where("arm is not null").groupBy("fit_id", "flag_index", "arm").agg(
        F.sum("n").alias("matured_users"), F.sum("x").alias("observed"), F.sum("e").alias("expected"), F.sum("vn").alias("vn"), F.sum("vs").alias("vs")).join(pool, "fit_id", "left")
    a = a.withColumn("log_ratio", F.log((F.col("observed") + 0.5) / (F.col("expected") + 0.5))).withColumn("sampling_var", 1.0 / (F.col("observed") + 0.5))
    mean = C.safe_divide("vs", "vn") / 100
    usable = (F.col("observed") > 0) & (F.col("pmean") > 0)
    a = a.withColumn("v_log", F.when(usable & (mean > 0), F.log(mean / F.col("pmean")))).withColumn(
        "v_var", F.when(usable, F.pow(F.coalesce("psd", F.lit(0.0)) / F.col("pmean"), F.lit(2.0)) / F.col("observed")))
    tau = a.groupBy("fit_id", "flag_index").agg(
        C.greatest_of(F.var_samp("log_ratio") - F.avg("sampling_var"), F.lit(0.0), 0.0).alias("tau2"), C.greatest_of(F.var_samp("v_log") - F.avg("v_var"), F.lit(0.0), 0.0).alias("tau2_v"))
    a = a.join(tau, ["fit_id", "flag_index"])
    weight = F.col("tau2") / (F.col("tau2") + F.col("sampling_var"))
    v_weight = C.safe_divide(F.col("tau2_v"), F.col("tau2_v") + F.col("v_var"))
    return a.select(
        "fit_id", "flag_index", "arm", "matured_users", F.col("observed").alias("observed_conversions"), F.round("expected", 9).alias("expected_conversions"),
        F.round("tau2", 9).alias("tau2"), F.round(weight, 9).alias("shrinkage_weight"), F.round(F.exp(weight * F.col("log_ratio")), 9).alias("conversion_multiplier"),
        F.round(F.coalesce(F.exp(v_weight * F.col("v_log")), F.lit(1.0)), 9).alias("value_multiplier"))


def scoring_rows(features: DataFrame, weeks: Sequence[date]) -> DataFrame:
    """Rows to score: served (cross-fitted), out-of-time test, and cross-fitted residuals of earlier users."""
    x = features.where("is_window_complete").withColumn("_w", _week_array(weeks))
    job = lambda purpose, fit: F.struct(F.lit(purpose).alias("purpose"), fit.alias("fit_id"))
    name = lambda w: F.concat(F.lit("oot_"), F.date_format(w, "yyyyMMdd"))
    fold = F.col("cf_fold").cast("string")
    jobs = F.concat(
        F.array(job("serve", F.concat(F.lit("xf"), fold))),
        F.transform(F.filter("_w", lambda w: w == F.col("signup_week")), lambda w: job("oot_test", name(w))),
        F.transform(F.filter("_w", lambda w: w > F.col("signup_week")), lambda w: job("oot_train_crossfit", F.concat(name(w), F.lit("_xf"), fold))),
    )
    return x.select(*features.columns, F.explode(jobs).alias("_j")).select("_j.*", *features.columns)


def score_24h(rows: DataFrame, rates: DataFrame, multipliers: DataFrame, values: DataFrame, cpc: DataFrame, plan_credits: DataFrame, pack_credits: float, p: Params) -> DataFrame:
    """Both variants of the score (with and without arm terms) and its p x V - C decomposition.

    The fit tables have one row per fit and cell: fits x arms rows, independent of the number of users.
    """
    x = rows.withColumn("segment", segment())
    x = x.join(F.broadcast(rates.select("fit_id", "segment", F.col("p_convert").alias("seg_p"))), ["fit_id", "segment"], "left")
    x = x.join(F.broadcast(values.drop("matured_converters")), "fit_id", "left").join(F.broadcast(plan_credits), "plan_tier", "left")
    pooled = cpc.groupBy("fit_id").agg(*[F.max(F.when(F.col("media_type") == m, F.col("pooled_cost_per_credit"))).alias(f"pool_{i}") for i, m in enumerate(MEDIA)])
    x = x.join(F.broadcast(pooled), "fit_id", "left")
    for i in range(2):
        m = multipliers.where(F.col("flag_index") == i).select("fit_id", F.col("arm").alias(f"arm_{i}"), F.col("conversion_multiplier").alias(f"cm_{i}"), F.col("value_multiplier").alias(f"vm_{i}"))
        c = cpc.where(F.col("flag_index") == i).select("fit_id", F.col("arm").alias(f"arm_{i}"), F.col("cost_per_credit").alias(f"cpc_{i}"))
        x = x.join(F.broadcast(m), ["fit_id", f"arm_{i}"], "left").join(F.broadcast(c), ["fit_id", f"arm_{i}"], "left")
    one = lambda c: F.coalesce(c, F.lit(1.0))
    rate = lambda i: F.coalesce(f"cpc_{i}", f"pool_{i}", F.lit(p.default_cost_per_credit))
    share = F.col("paid_video_credit_share")
    mix_rate = share * rate(1) + (1 - share) * rate(0)
    r = p.monthly_retention
    months = 1.0 + r + r * r
    pack, monthly = F.col("first_purchase_event_name") == "purchase_one_time_pack", F.col("billing_interval") == "month"
    first = F.col("first_purchase_minor") / 100
    paid_charges = F.when(pack, 1.0).when(monthly, months).otherwise(1.0)
    paid_revenue = F.when(pack, first).when(monthly, first * months).otherwise(first)
    plan = F.col("plan_monthly_credits") * F.lit(p.plan_utilization)
    paid_credits = F.when(pack, F.lit(pack_credits * p.plan_utilization)).when(monthly, plan * months).otherwise(plan * 3.0)
    q = p.refund_prob + p.chargeback_prob
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    base_cost = F.col("cost_24h_micros") / 1_000_000 + F.coalesce("trial_credits_remaining_24h", F.lit(0)) * F.lit(p.trial_leftover_share) * F.col("trial_cost_per_credit")
    x = x.withColumn("unconditional_cost", F.round(base_cost, 6))
    for v, conv, val in (("cal", one("cm_0") * one("cm_1"), one("vm_0") * one("vm_1")), ("sig", F.lit(1.0), F.lit(1.0))):
        lift = F.least(F.coalesce(F.col("seg_p") * conv, F.lit(1.0)), F.lit(1.0))
        paid = F.col("paid_within_24h")
        x = x.withColumn(f"{v}_p", F.when(paid, 1.0).otherwise(lift))
        x = x.withColumn(f"{v}_rev", zero(F.when(paid, paid_revenue).otherwise(lift * F.col("revenue_per_converter") * val)))
        x = x.withColumn(f"{v}_chg", zero(F.when(paid, paid_charges).otherwise(lift * F.col("charges_per_converter"))))
        x = x.withColumn(f"{v}_cred", zero(F.when(paid, paid_credits).otherwise(lift * F.col("paid_credits_per_converter") * val)))
        rev, chg = F.col(f"{v}_rev"), F.col(f"{v}_chg")
        x = x.withColumn(f"{v}_revenue", F.round(rev, 6)).withColumn(f"{v}_cost", F.round(base_cost + F.col(f"{v}_cred") * mix_rate, 6))
        affiliate = F.when(F.col("acquisition_channel") == "affiliate", rev * p.affiliate_pct).otherwise(0.0)
        x = x.withColumn(f"{v}_fees", F.round(rev * p.fee_pct + chg * p.fee_fixed + affiliate, 6))
        x = x.withColumn(f"{v}_risk", F.round(rev * q + chg * p.chargeback_prob * p.dispute_fee, 6))
        x = x.withColumn(f"{v}_refund_probability", F.round(1 - F.pow(F.lit(1 - q), chg), 6))
        x = x.withColumn(f"{v}_profit", F.round(F.col(f"{v}_revenue") - F.col(f"{v}_cost") - F.col(f"{v}_fees") - F.col(f"{v}_risk"), 6))
    m = "cal" if p.use_arm_calibration else "sig"
    return x.select(
        "purpose", "fit_id", "user_id", "segment", "signup_week", "cf_fold", "arm_0", "arm_1", "paid_within_24h", "activated_24h", "generations_24h", "failed_generations_24h", F.lit(m).alias("main_variant"),
        F.round(f"{m}_p", 6).alias("p_convert"), F.col(f"{m}_revenue").alias("predicted_revenue"), F.col(f"{m}_cost").alias("predicted_generation_cost"),
        F.col(f"{m}_fees").alias("predicted_fees"), F.col(f"{m}_risk").alias("predicted_refund_risk"), F.col(f"{m}_profit").alias("predicted_profit"),
        F.col("sig_profit").alias("predicted_profit_signals_only"), F.col("cal_profit").alias("predicted_profit_with_arm_terms"), F.col(f"{m}_refund_probability").alias("refund_probability"),
        "unconditional_cost", F.when(F.col(f"{m}_p") > 0, F.round((F.col(f"{m}_profit") + F.col("unconditional_cost")) / F.col(f"{m}_p"), 6)).alias("value_if_converted"))


SNAPSHOT = ("segment", "paid_within_24h", "activated_24h", "generations_24h", "arm_0", "arm_1", "fit_id")


def served_scores(scores: DataFrame, p: Params, external: DataFrame | None = None) -> DataFrame:
    """The served score table in contract shape; a trained model's table may replace the heuristic."""
    x = scores.where("purpose = 'serve'")
    money = ["predicted_revenue", "predicted_generation_cost", "predicted_fees", "predicted_refund_risk", "predicted_profit"]
    version = F.lit(p.pp_model_version)
    if external is not None:
        x = x.drop(*money).join(external.select("user_id", *money, F.col("model_version").alias("_v")), "user_id")
        version = F.col("_v")
    return x.select("user_id", F.lit(p.horizon_days).alias("horizon_days"), *money, version.alias("model_version"), "p_convert", "value_if_converted", "unconditional_cost",
                    F.to_json(F.struct(*SNAPSHOT), {"ignoreNullFields": "false"}).alias("features_snapshot"), *[c for c in SNAPSHOT if c != "fit_id"], "cf_fold", "signup_week", "failed_generations_24h")


def current_parameters(spark, p: Params, rates: DataFrame, values: DataFrame) -> DataFrame:
    """All constants and fitted values of a run with one content reference."""
    named = [(f.name, str(getattr(p, f.name))) for f in dataclasses.fields(p)]
    rows = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).alias("value")) for n, v in named])).alias("r")).select("r.*")
    fitted = rates.select(F.concat_ws(".", F.lit("p_convert"), "fit_id", "segment").alias("name"), F.format_string("%.9f", "p_convert").alias("value"))
    more = values.select("fit_id", F.explode(F.array(*[F.struct(F.lit(c).alias("n"), F.format_string("%.9f", c).alias("v")) for c in values.columns if c not in ("fit_id", "matured_converters")])).alias("r"))
    every = rows.unionByName(fitted).unionByName(more.select(F.concat_ws(".", "r.n", "fit_id").alias("name"), F.col("r.v").alias("value")))
    return every.withColumn("fitted_params_ref", content_ref(every).scalar())

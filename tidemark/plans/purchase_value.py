"""Value of a purchase: point-in-time features, 90-day outcome, fits and score."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators.rows import lookup, quantiles
from tidemark.operators.running import Agg, Facts, lookup_many, running
from tidemark.params import Params, Z_BY_COVERAGE
from tidemark.plans.identity import arm_facts, click_facts, utm_facts
from tidemark.plans.scores_24h import fees, into_fits
from tidemark.functions.segments import utm_channel

BUCKETS = ("us", "tier1", "rest", "unknown")


def _shift(df: DataFrame, ts: str, seconds: int, name: str) -> DataFrame:
    return df.withColumn(name, C.add_seconds(ts, -seconds))


def purchase_features(purch: DataFrame, usage: DataFrame, exposures: DataFrame, clicks: DataFrame, utms: DataFrame, countries: DataFrame, catalog: DataFrame,
                      flags: Sequence[str], platforms: Sequence[tuple], utm_keys: Sequence[str], p: Params) -> DataFrame:
    """Features known at each purchase; usage and earlier purchases strictly before it, exposures and clicks up to it.

    ``countries``: user_id, country_bucket, country_known_at; ``catalog``: plan_tier, billing_interval, list_price, plan_monthly_credits.
    """
    video = F.col("media_type") == "video"
    paid = F.col("credit_field") != "trial_credit_balance"
    used = Facts(usage.where(~F.col("is_failed")), "created_at", [
        Agg("generations_before", "count"), Agg("credits_before", "sum", F.col("credits")), Agg("video_credits_before", "sum", F.when(video, F.col("credits")).otherwise(0)),
        Agg("cost_before_micros", "sum", F.col("cost_micros")), Agg("paid_credits_before", "sum", F.when(paid, F.col("credits")).otherwise(0)), Agg("last_generation_before_at", "max", F.col("created_at")),
    ], inclusive=False)
    keys = [q[0] for q in platforms]
    month = F.col("event_name").isin("purchase_first", "purchase_renewal") & (F.col("billing_interval") == "month")
    of_user = F.col("user_id").isNotNull()
    earlier = [Agg("previous_purchases", "count", of_user), Agg("paid_months_before", "sum", F.when(of_user & month, 1).otherwise(0))]
    x = running(purch, ["user_id"], "occurred_at", ["event_id"], earlier, block_seconds=None)
    x = lookup_many(x, [used, arm_facts(exposures, flags), click_facts(clicks, "known_at", keys), utm_facts(utms, "known_at", utm_keys, order="known_at")], ["user_id"], "occurred_at", None)
    best = F.array_min(F.filter(F.array(*[
        F.when(F.col(f"click_{k}").isNotNull(), F.struct(F.col(f"click_{k}.newest").alias("n"), F.lit(prec).alias("prec"), F.lit(ch).alias("ch"))) for k, _pl, ch, prec in platforms]), lambda c: c.isNotNull()))
    x = x.withColumn("acquisition_channel", F.coalesce(best["ch"], utm_channel(F.col("_u_utm_source.v"), F.col("_u_utm_medium.v"))))
    keep = [*purch.columns, "generations_before", "credits_before", "video_credits_before", "cost_before_micros", "paid_credits_before", "last_generation_before_at", "acquisition_channel",
            *[F.col(f"_a{i}.arm").alias(f"arm_{i}") for i in range(len(flags))], *[a.name for a in earlier]]
    x = lookup(x.select(*keep).join(countries, "user_id", "left"), catalog, ["plan_tier", "billing_interval"])
    known = F.col("country_known_at") <= F.col("occurred_at")
    kind = F.when((F.col("event_name") == "purchase_one_time_pack") | F.col("billing_interval").isNull(), "pack").when(F.col("billing_interval") == "year", "annual").otherwise("monthly")
    for c in ("generations_before", "credits_before", "video_credits_before", "cost_before_micros", "paid_credits_before", "previous_purchases", "paid_months_before"):
        x = x.withColumn(c, F.coalesce(c, F.lit(0)))
    return x.withColumn("purchase_kind", kind).withColumn("country_bucket", F.when(known, F.coalesce("country_bucket", F.lit("unknown"))).otherwise("unknown")).withColumn(
        "is_affiliate", F.col("acquisition_channel") == "affiliate").withColumn("cf_fold", C.fold("user_id", p.folds)).withColumn(
        "cost_per_credit_before", C.safe_divide(F.col("cost_before_micros") / 1_000_000, F.nullif("credits_before", F.lit(0))))


def purchase_outcomes(features: DataFrame, purch: DataFrame, adj: DataFrame, usage: DataFrame, p: Params, renewal_days: int = 45) -> DataFrame:
    """Realised outcome of each purchase over its horizon.

    A fact at time f lies in the window [t, t + H) of exactly the purchases with f - H < t <= f, so a window
    sum is "facts shifted back by H" minus "facts", both before t: one ordered frame, no pairs of overlapping windows.
    """
    h = p.horizon_days * 86_400

    def window(df, ts, aggs, from_ts=None):
        back = _shift(df, ts, h, "_from")
        low = [Agg("lo_" + a.name, a.kind, a.value) for a in aggs]
        high = [Agg("hi_" + a.name, a.kind, a.value) for a in aggs]
        return [Facts(back, "_from", high, False), Facts(df, from_ts or ts, low, False)]

    # an adjustment counts while both its purchase is in the window and it happened before the window's end
    when = purch.select(F.col("event_id").alias("adjusts_event_id"), F.col("occurred_at").alias("bought_at"))
    a = adj.join(when, "adjusts_event_id").where(F.unix_micros("occurred_at") < F.unix_micros("bought_at") + h * 1_000_000)
    sides = window(purch, "occurred_at", [Agg("revenue", "sum", F.col("revenue_minor")), Agg("cash", "sum", F.col("cash_minor")), Agg("charges", "count")])
    sides += window(a, "occurred_at", [Agg("adjusted", "sum", F.col("cash_minor")), Agg("chargebacks", "count", F.col("event_name") == "chargeback")], "bought_at")
    sides += window(usage, "created_at", [Agg("cost", "sum", F.col("cost_micros"))])
    base = features.select("event_id", "user_id", "occurred_at", "subscription_id", "event_name", "purchase_kind", "is_affiliate")
    x = lookup_many(base, sides, ["user_id"], "occurred_at", None)
    d = lambda n: (F.coalesce("hi_" + n, F.lit(0)) - F.coalesce("lo_" + n, F.lit(0)))
    x = x.select(*base.columns, *[d(n).alias(n) for n in ("revenue", "cash", "charges", "adjusted", "chargebacks", "cost")])
    r = purch.where("event_name = 'purchase_renewal'").select("subscription_id", "occurred_at").withColumn("_from", C.add_seconds("occurred_at", -renewal_days * 86_400))
    x = lookup_many(x, [Facts(r, "_from", [Agg("_hi", "count")]), Facts(r, "occurred_at", [Agg("_lo", "count")])], ["subscription_id"], "occurred_at", None)
    fee = fees(F.col("cash"), F.col("charges"), F.col("revenue"), F.col("chargebacks"), F.coalesce("is_affiliate", F.lit(False)), p)
    at = F.lit(p.as_of)
    return x.select(
        "event_id", "user_id", "occurred_at", (C.add_seconds("occurred_at", h) <= at).alias("is_horizon_complete"), F.col("revenue").alias("revenue_minor"), F.col("cash").alias("cash_minor"), "charges",
        F.col("adjusted").alias("adjusted_minor"), "chargebacks", F.col("cost").alias("cost_micros"), F.round(fee, 6).alias("fees"),
        F.round(F.col("revenue") / 100 + F.col("adjusted") / 100 - F.col("cost") / 1_000_000 - fee, 6).alias("realized_profit"),
        ((F.col("purchase_kind") == "monthly") & F.col("event_name").isin("purchase_first", "purchase_renewal", "purchase_upgrade")).alias("is_renewal_opportunity"),
        (C.add_seconds("occurred_at", renewal_days * 86_400) <= at).alias("is_renewal_observable"),
        ((F.coalesce("_hi", F.lit(0)) - F.coalesce("_lo", F.lit(0))) > 0).alias("renewed_in_time"))


def with_outcomes(features: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The features of each purchase beside what the fits and scores need of its outcome; joined once for all of them."""
    return features.join(outcomes.select("event_id", "is_horizon_complete", F.col("revenue_minor").alias("out_minor"), "is_renewal_opportunity", "is_renewal_observable", "renewed_in_time"), "event_id")


def renewal_rates(known: DataFrame, fits: DataFrame, weeks: Sequence[date], tiers: Sequence[str], p: Params) -> DataFrame:
    """Renewal probability per fit, tier and country bucket: shrunk to the tier, the tier to the prior (``known``: see ``with_outcomes``)."""
    cells = known.where("is_renewal_opportunity and is_renewal_observable").groupBy("cf_fold", "signup_week", "plan_tier", "country_bucket").agg(F.count(F.lit(1)).alias("n"), C.tally(F.col("renewed_in_time")).alias("x"))
    seen = into_fits(cells, weeks, p).groupBy("fit_id", "plan_tier", "country_bucket").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    tier = seen.groupBy("fit_id", "plan_tier").agg(F.sum("n").alias("tn"), F.sum("x").alias("tx"))
    grid = fits.select("fit_id", F.explode(C.small_rows([{"plan_tier": t, "country_bucket": b} for t in tiers for b in BUCKETS])).alias("g")).select("fit_id", "g.*")
    x = grid.join(tier, ["fit_id", "plan_tier"], "left").join(seen, ["fit_id", "plan_tier", "country_bucket"], "left")
    x = x.withColumn("tier_prob", C.shrink(F.col("tx"), F.col("tn"), p.monthly_retention, p.renewal_prior))
    return x.select("fit_id", "plan_tier", "country_bucket", F.coalesce("n", F.lit(0)).alias("opportunities"), F.coalesce("x", F.lit(0)).alias("renewals"), F.round("tier_prob", 9).alias("tier_renewal_prob"),
                    F.round(C.shrink(F.col("x"), F.col("n"), F.col("tier_prob"), p.renewal_country_prior), 9).alias("renewal_prob"))


def value_params(known: DataFrame, usage: DataFrame, adj: DataFrame, fits: DataFrame, weeks: Sequence[date], pack_credits: float, p: Params) -> DataFrame:
    """Eight structural parameters per fit. Everything but the pack quantile is a sum of cell moments (``known``: see ``with_outcomes``)."""
    month_s = 30.4375 * 86_400
    cell = ["cf_fold", "signup_week"]
    is_paid = F.col("event_name").isin("purchase_first", "purchase_renewal") & F.col("purchase_kind").isin("monthly", "annual")
    seen = F.least(F.when(F.col("purchase_kind") == "annual", 12.0).otherwise(1.0), C.diff_seconds(F.lit(p.as_of), "occurred_at") / F.lit(month_s))
    is_pack = F.col("purchase_kind") == "pack"
    future = F.when(is_pack & F.col("is_horizon_complete"), (F.col("out_minor") - F.col("revenue_minor")) / 100)
    is_old = C.add_seconds("occurred_at", 30 * 86_400) <= F.lit(p.as_of)
    t = known.withColumn("m", F.when(is_paid, seen)).withColumn("_future", future).withColumn("_old", is_old)
    addon = F.when(F.col("event_name").isin("purchase_add_on", "purchase_upgrade"), F.col("revenue_minor"))
    sums = t.groupBy(*cell).agg(
        F.sum("m").alias("months"), F.sum(F.col("m") * F.col("plan_monthly_credits")).alias("capacity"), (F.sum(addon) / 100).alias("addon"),
        C.tally(is_pack).alias("packs"), F.count("_future").alias("ripe"), F.sum("_future").alias("future"), C.tally(F.col("_old")).alias("chg"))
    subs = F.col("credit_field") == "subscription_monthly_credit"
    burn = usage.where(~F.col("is_failed")).groupBy("user_id").agg(C.sum_if(subs, F.col("credits")).alias("sub_c"), C.sum_if(F.col("credit_field") == "one_time_pack_credit", F.col("credits")).alias("pack_c"))
    # months of paying users and users of packs, each beside the user's credits
    per_user = t.where(is_paid | is_pack).groupBy("user_id", *cell).agg(F.sum("m").alias("m"), F.bool_or(is_paid).alias("pays"), F.bool_or(is_pack).alias("packed")).join(burn, "user_id", "left")
    b = F.when(F.col("pays") & (F.col("m") >= 1) & F.col("sub_c").isNotNull(), F.col("sub_c") / F.col("m"))
    users = per_user.groupBy(*cell).agg(
        F.sum(F.when(F.col("pays"), F.coalesce("sub_c", F.lit(0)))).alias("sub_credits"), F.count(b).alias("bn"), F.sum(b).alias("bs"), F.sum(b * b).alias("bq"),
        F.sum(F.when(F.col("packed"), F.col("pack_c"))).alias("pack_used"))
    kinds = ("refund", "chargeback")
    back = adj.where(F.col("event_name").isin(*kinds)).select(F.col("adjusts_event_id").alias("event_id"), F.col("event_name").alias("back"))
    charges = t.where("_old").select("event_id", *cell).join(back, "event_id").groupBy(*cell).agg(C.tally(F.col("back") == "refund").alias("rf"), C.tally(F.col("back") == "chargeback").alias("cb"))
    # everything is a sum over cells, so the parts need not meet before the fits
    x = sums.unionByName(users, allowMissingColumns=True).unionByName(charges, allowMissingColumns=True)
    names = [c for c in x.columns if c not in cell]
    f = into_fits(x, weeks, p).groupBy("fit_id").agg(*[F.sum(c).alias(c) for c in names])
    # values are counted per cell first: only the counts are repeated per fit
    counted = t.select(*cell, F.col("_future").alias("v")).where("v is not null").groupBy(*cell, "v").agg(F.count(F.lit(1)).alias("n"))
    q90 = quantiles(into_fits(counted, weeks, p), ["fit_id"], "v", {"q90": 0.9}, "n")
    f = fits.join(f, "fit_id", "left").join(q90, "fit_id", "left")
    mean = C.safe_divide("bs", "bn")
    cv = F.when((F.coalesce("bn", F.lit(0)) >= 5) & (mean > 0), F.sqrt(C.sample_variance(F.col("bn"), F.col("bs"), F.col("bq"))) / mean).otherwise(p.prior_burn_cv)
    sh = lambda s, n, prior, k: F.round(C.shrink(s, n, prior, k), 9)
    return f.select(
        "fit_id", F.coalesce("months", F.lit(0.0)).alias("observed_months"), sh(F.col("addon"), F.col("months"), p.prior_addon_per_month, p.addon_prior_months).alias("addon_per_month"),
        sh(F.col("sub_credits"), F.col("capacity"), p.plan_utilization, p.util_prior_credits).alias("plan_utilization"), F.round(cv, 9).alias("burn_cv"), F.coalesce("packs", F.lit(0)).alias("packs"),
        sh(F.col("pack_used"), F.col("packs") * pack_credits, p.plan_utilization, p.util_prior_credits).alias("pack_utilization"), sh(F.col("future"), F.col("ripe"), p.prior_pack_revenue, p.pack_prior).alias("pack_future_revenue"),
        F.round(F.when(F.coalesce("ripe", F.lit(0)) >= 10, F.col("q90")).otherwise(p.prior_pack_q90), 9).alias("pack_future_q90"), F.coalesce("chg", F.lit(0)).alias("observed_charges"),
        sh(F.col("rf"), F.col("chg"), p.refund_prob, p.rate_prior_charges).alias("refund_rate"), sh(F.col("cb"), F.col("chg"), p.chargeback_prob, p.rate_prior_charges).alias("chargeback_rate"))


def scoring_rows(known: DataFrame, weeks: Sequence[date]) -> DataFrame:
    """Served rows under the fit without the user's fold; test-week rows of complete horizons under the out-of-time fit."""
    x = known.drop("out_minor", "is_renewal_opportunity", "is_renewal_observable", "renewed_in_time")
    job = lambda purpose, fit: F.struct(F.lit(purpose).alias("purpose"), fit.alias("fit_id"))
    listed = F.array(*[F.lit(w) for w in weeks]).cast("array<date>")
    tests = F.filter(listed, lambda w: (w == F.col("signup_week")) & F.col("is_horizon_complete"))
    jobs = F.concat(F.array(job("serve", F.concat(F.lit("xf"), F.col("cf_fold").cast("string")))), F.transform(tests, lambda w: job("oot_test", F.concat(F.lit("oot_"), F.date_format(w, "yyyyMMdd")))))
    return x.withColumn("_j", F.explode(jobs)).select("_j.*", *x.columns)


def score_purchase(rows: DataFrame, rates: DataFrame, params: DataFrame, values: DataFrame, cpc: DataFrame, pack_credits: float, p: Params) -> DataFrame:
    """Expected horizon profit of each purchase with an interval from renewal quantiles and burn spread.

    The joined fit tables hold one row per fit (and tier, bucket or arm), independent of the data size. The rows travel as one
    column beside what the score reads, and the inputs of the score are left behind.
    """
    media = {0: "image", 1: "video"}
    read = ("fit_id", "plan_tier", "country_bucket", "arm_0", "arm_1", "purchase_kind", "event_name", "revenue_minor", "list_price", "plan_monthly_credits", "is_affiliate",
            "credits_before", "cost_per_credit_before", "paid_credits_before", "paid_months_before")
    pooled = cpc.groupBy("fit_id").agg(*[F.max(F.when(F.col("media_type") == m, F.col("pooled_cost_per_credit"))).alias(f"pool_{i}") for i, m in media.items()])
    x = rows.select(F.struct(*rows.columns).alias("_row"), *read)
    x = x.join(F.broadcast(rates.select("fit_id", "plan_tier", "country_bucket", "renewal_prob")), ["fit_id", "plan_tier", "country_bucket"], "left")
    by_fit = params.drop("observed_months", "packs", "observed_charges").join(values.select("fit_id", "paid_video_credit_share"), "fit_id", "full_outer").join(pooled, "fit_id", "full_outer")
    x = x.join(F.broadcast(by_fit), "fit_id", "left")
    for i in media:
        x = x.join(F.broadcast(cpc.where(F.col("flag_index") == i).select("fit_id", F.col("arm").alias(f"arm_{i}"), F.col("cost_per_credit").alias(f"cpc_{i}"))), ["fit_id", f"arm_{i}"], "left")
    rate = lambda i: F.coalesce(f"cpc_{i}", f"pool_{i}", F.lit(p.default_cost_per_credit))
    share = F.col("paid_video_credit_share")
    x = x.withColumn("arm_cpc", share * rate(1) + (1 - share) * rate(0)).drop("fit_id", "country_bucket", "arm_0", "arm_1", "paid_video_credit_share", *[f"{n}_{i}" for i in media for n in ("pool", "cpc")])
    return score_expression(x, pack_credits, p).select("_row.*", *AMOUNTS)


AMOUNTS = ("predicted_revenue", "predicted_generation_cost", "predicted_fees", "predicted_refund_risk", "predicted_profit", "interval_low", "interval_high")


def score_expression(x: DataFrame, pack_credits: float, p: Params) -> DataFrame:
    """The scoring arithmetic over one row's inputs."""
    z, alpha, window = Z_BY_COVERAGE.get(p.interval_coverage, 1.2816), (1 - p.interval_coverage) / 2, p.horizon_days / 30.4375
    monthly, annual, pack = (F.col("purchase_kind") == k for k in ("monthly", "annual", "pack"))
    revenue = F.col("revenue_minor") / 100
    plan = F.coalesce("plan_monthly_credits", F.lit(0))
    x = x.withColumn("s", F.when(monthly, F.coalesce("renewal_prob", F.lit(p.monthly_retention))).otherwise(0.0))
    x = x.withColumn("renewal_value", F.when(F.col("event_name").isin("purchase_first", "purchase_renewal"), revenue).otherwise(F.coalesce("list_price", revenue)))
    x = x.withColumn("cpc", (F.col("credits_before") * F.coalesce("cost_per_credit_before", "arm_cpc") + p.user_cpc_prior_credits * F.col("arm_cpc")) / (F.col("credits_before") + p.user_cpc_prior_credits))
    own = (F.col("paid_credits_before") + p.burn_prior_months * F.col("plan_utilization") * plan) / (F.col("paid_months_before") + p.burn_prior_months)
    x = x.withColumn("burn", F.when(F.col("paid_months_before") > 0, own).otherwise(F.col("plan_utilization") * plan))
    s = F.col("s")
    x = x.withColumn("renewals", F.when(monthly, s + s * s).otherwise(0.0)).withColumn("paid_months", F.when(monthly, 1.0 + s + s * s).when(annual, window).otherwise(0.0))
    quantile = lambda a: F.when(~monthly, 0).when(1 - s >= a, 0).when(1 - s * s >= a, 1).otherwise(2)
    affiliate = F.coalesce("is_affiliate", F.lit(False))
    aff = F.when(affiliate, p.affiliate_pct).otherwise(0.0)
    keep = 1 - p.fee_pct - aff - F.col("refund_rate") - F.col("chargeback_rate")
    per_charge = p.fee_fixed + p.dispute_fee * F.col("chargeback_rate")
    sub = monthly | annual
    rev = revenue + F.col("renewal_value") * F.col("renewals") + F.when(sub, F.col("addon_per_month") * F.col("paid_months")).otherwise(0.0) + F.when(pack, F.col("pack_future_revenue")).otherwise(0.0)
    credits = F.when(pack, pack_credits * F.col("pack_utilization")).otherwise(F.col("burn") * F.col("paid_months"))
    x = x.withColumn("rev", rev).withColumn("cred", credits).withColumn("chg", 1.0 + F.col("renewals"))
    fee = F.col("rev") * p.fee_pct + F.col("chg") * p.fee_fixed + F.when(affiliate, F.col("rev") * p.affiliate_pct).otherwise(0.0) + F.col("chg") * F.col("chargeback_rate") * p.dispute_fee
    x = x.withColumn("predicted_revenue", F.round("rev", 6)).withColumn("predicted_generation_cost", F.round(F.col("cred") * F.col("cpc"), 6)).withColumn("predicted_fees", F.round(fee, 6))
    x = x.withColumn("predicted_refund_risk", F.round(F.col("rev") * (F.col("refund_rate") + F.col("chargeback_rate")), 6))
    x = x.withColumn("predicted_profit", F.round(F.col("predicted_revenue") - F.col("predicted_generation_cost") - F.col("predicted_fees") - F.col("predicted_refund_risk"), 6))

    def structural(k, pack_revenue, factor):
        income = revenue + F.col("renewal_value") * k + F.when(sub, F.col("addon_per_month") * F.when(annual, window).otherwise(1 + k)).otherwise(0.0) + F.when(pack, pack_revenue).otherwise(0.0)
        burned = F.when(pack, pack_credits * F.col("pack_utilization")).when(annual, F.col("burn") * window).otherwise(F.col("burn") * (1 + k))
        return income * keep - (1 + k) * per_charge - burned * F.col("cpc") * factor

    low = structural(quantile(alpha), F.lit(0.0), 1 + z * F.col("burn_cv"))
    high = structural(quantile(1 - alpha), F.coalesce("pack_future_q90", F.lit(0.0)), F.greatest(F.lit(0.0), 1 - z * F.col("burn_cv")))
    profit = F.col("predicted_profit")
    return x.withColumn("interval_low", F.round(F.least(low, profit), 6)).withColumn("interval_high", F.round(F.greatest(high, profit), 6))


def served_values(scores: DataFrame, p: Params) -> DataFrame:
    """The served purchase value; what a platform receives is never negative."""
    x = scores.where("purpose = 'serve' and predicted_profit is not null")
    return x.select("event_id", "user_id", "occurred_at", F.lit(p.horizon_days).alias("horizon_days"), "predicted_revenue", "predicted_generation_cost", "predicted_fees", "predicted_refund_risk", "predicted_profit",
                    "interval_low", "interval_high", F.greatest("predicted_profit", F.lit(0.0)).alias("platform_value"), F.lit(p.pvs_model_version).alias("model_version"), "event_name", "purchase_kind", "acquisition_channel",
                    "country_bucket", "fit_id", "cf_fold", "signup_week")

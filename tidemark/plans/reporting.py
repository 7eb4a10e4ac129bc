"""Aggregate-only reports over the marts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C

COVERAGE = ("has_any_click_id", "has_google_click_id", "has_meta_fbclid", "meta_fbc_buildable", "has_tiktok_ttclid", "has_utm_source", "has_experiment_arm", "consent_region_known")


def signal_coverage_daily(ledger: DataFrame) -> DataFrame:
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return ledger.where(~F.col("is_qa_account")).groupBy(F.to_date("occurred_at").alias("event_date"), "event_name").agg(
        F.count(F.lit(1)).alias("events"), *[share(F.col(c)).alias("share_" + c.removeprefix("has_")) for c in COVERAGE], share(F.col("device_id").isNotNull()).alias("share_device_id"),
        F.max(F.when(F.col("requires_web_fix"), F.col("web_fix_platforms"))).alias("web_fix_platforms"))


def coverage_question(daily: DataFrame) -> DataFrame:
    """Coverage over all days: day shares weighted by their events."""
    shares = [c for c in daily.columns if c.startswith("share_")]
    return daily.groupBy("event_name").agg(F.sum("events").alias("events"), *[C.safe_divide(F.sum(F.col("events") * F.col(c)), F.sum("events")).alias(c) for c in shares])


def experiment_daily(daily: DataFrame) -> DataFrame:
    g = daily.groupBy("exposure_date", "flag_key", "arm", "allocation_slice").agg(*[F.sum(c).alias(c) for c in ("exposed_users", "scored_users", "contaminated_users", "matured_users", "converted_users", "sum_predicted_profit")])
    return g.withColumn("predicted_profit_per_scored", C.safe_divide("sum_predicted_profit", F.nullif("scored_users", F.lit(0))))


def purchase_value(values: DataFrame) -> DataFrame:
    return values.groupBy(C.month_start(F.to_date("occurred_at")).alias("purchase_month"), "acquisition_channel", "purchase_kind", "model_version").agg(
        F.count(F.lit(1)).alias("purchases"), F.sum("predicted_profit").alias("predicted_profit"), F.sum("platform_value").alias("platform_value"), F.avg(F.col("interval_high") - F.col("interval_low")).alias("mean_interval_width"),
        C.tally(F.col("predicted_profit") < 0).alias("negative_value_purchases"))


def data_quality(issues: DataFrame, day: str) -> DataFrame:
    return issues.groupBy(F.col(day).alias("day"), "issue", "severity").agg(F.count(F.lit(1)).alias("records"), F.sum("ledger_difference_minor").alias("ledger_difference_minor"))


def reconciliation_summary(steps: DataFrame, layer: str) -> DataFrame:
    pick = lambda names, c: F.sum(F.when(F.col("step_name").isin(*names), F.col(c)).otherwise(0.0))
    truth, reported = pick(["stripe_truth"], "value_delta"), pick(["platform_reported"], "value_delta")
    return steps.where(F.col("report_layer") == layer).groupBy("platform").agg(
        pick(["stripe_truth"], "conversions_delta").alias("purchases"), truth.alias("truth_value"), pick(["stripe_truth", "warehouse_vs_stripe"], "value_delta").alias("warehouse_value"), pick(["platform_reported"], "conversions_delta").alias("platform_conversions"),
        reported.alias("platform_value"), C.safe_divide(100 * (reported - truth), F.nullif(truth, F.lit(0.0))).alias("gap_pct"), pick(["residual"], "value_delta").alias("unexplained"))


def waterfall_question(steps: DataFrame, month, platform: str, layer: str) -> DataFrame:
    return steps.where((F.col("period_month") == F.lit(month)) & (F.col("platform") == platform) & (F.col("report_layer") == layer)).select("step_order", "step_name", "step_group", "conversions_delta", "value_delta", "value_running").orderBy("step_order")


def arm_question(arms: DataFrame, flag: str) -> DataFrame:
    return arms.where(F.col("flag_key") == flag).select("arm", "exposed_users", "conversion_rate", "predicted_profit_per_exposed", "predicted_low", "predicted_high", "conversion_rank", "predicted_rank").orderBy("predicted_rank", "arm")

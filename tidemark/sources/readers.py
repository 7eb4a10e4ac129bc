"""Readers: one DataFrameReader / DataStreamReader call per source, always with a schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import schemas as S


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_billing_events(spark, path):
    return _json(spark, path, S.BILLING_EVENTS)


def stream_billing_events(spark, path, files_per_trigger: int = 100):
    return spark.readStream.schema(S.BILLING_EVENTS).option("maxFilesPerTrigger", files_per_trigger).json(path)


def read_product_events(spark, path, fmt: str = "json"):
    """Export partitioned by ``event_date``; filter on it so only the needed days are read."""
    return spark.read.schema(S.PRODUCT_EVENTS + ", event_date date").format(fmt).load(path)


def read_usage_ledger(spark, path):
    return _json(spark, path, S.USAGE_LEDGER)


def read_click_posts(spark, path):
    return _json(spark, path, S.CLICK_POSTS)


def read_accounts(spark, path):
    """The e-mail address never leaves the reader."""
    return _json(spark, path, S.ACCOUNTS).drop("email")


def read_lookup_attempts(spark, path):
    return _json(spark, path, S.LOOKUP_ATTEMPTS)


def read_form_submissions(spark, path):
    return _json(spark, path, S.FORM_SUBMISSIONS)


def read_property_changes(spark, path):
    return _json(spark, path, S.PROPERTY_CHANGES)


def read_platform_reports(spark, path):
    return spark.read.schema(S.PLATFORM_REPORTS).option("header", True).csv(path)


def read_seed(spark, folder, name):
    return spark.read.schema(S.SEEDS[name]).option("header", True).csv(f"{folder}/{name}.csv")


def read_external_scores(spark, table):
    return spark.table(table)


def assert_counts(frames: dict[str, DataFrame], manifest: dict[str, int]) -> DataFrame:
    """Rows of each load that differ from the manifest (empty = pass); one job over all tables."""
    rows = None
    for name, df in frames.items():
        part = df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table"), "rows", F.lit(manifest.get(name)).cast("bigint").alias("expected")
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows.where(~F.col("rows").eqNullSafe(F.col("expected")))


def require_counts(frames: dict[str, DataFrame], manifest: dict[str, int]) -> None:
    """Fail the load if any table's row count differs from the manifest."""
    wrong = assert_counts(frames, manifest).collect()  # at most one row per table
    if wrong:
        raise ValueError("row counts differ from the manifest: " + ", ".join(f"{r.table} {r.rows} instead of {r.expected}" for r in wrong))


def freshness(df: DataFrame, loaded_at: str, now, warn_hours: int, error_hours: int) -> DataFrame:
    """Status of a source by the age of its newest row."""
    newest = df.agg(F.max(loaded_at).alias("newest"))
    age = newest.withColumn("age_hours", F.floor((F.unix_micros(F.lit(now)) - F.unix_micros("newest")) / 3_600_000_000))
    status = F.when(F.col("age_hours").isNull() | (F.col("age_hours") > error_hours), "error").when(
        F.col("age_hours") > warn_hours, "warn"
    ).otherwise("pass")
    return age.withColumn("status", status)

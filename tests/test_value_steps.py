"""Purchase features, outcomes and fits: rows without a user, and how often rows go over the network."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401
from tidemark.params import Params
from tidemark.plans import purchase_value as V
from tidemark.sources import driver_tables as D

SMOKE = "/root/testdata/sf0.001"
P = Params(as_of=datetime(2024, 1, 31), horizon_days=7, maturity_days=3)


def tables(spark, purchases=None):
    e = D.ev(spark, SMOKE)
    usage = D.usage(spark, e).withColumn("cost_micros", F.col("cost_cents") * 10_000)
    expo = D.exposure_rows(spark, e).groupBy("user_id", "flag_key").agg(F.min("arm").alias("arm"), F.min("event_time").alias("first_exposed_at"))
    countries = e.groupBy("user_id").agg(F.min("ts").alias("country_known_at")).withColumn("country_bucket", F.lit("us"))
    cat = spark.createDataFrame([("essential", "month", 10.0, 4000)], "plan_tier string, billing_interval string, list_price double, plan_monthly_credits bigint")
    purch = D.purchase(spark, e) if purchases is None else purchases
    f = V.purchase_features(purch, usage, expo, D.click(spark, e), D.utm(spark, e), countries, cat, D.FLAGS, D.CLICK_PLATFORMS, D.UTM_KEYS, P)
    return e, usage, f


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_purchases_without_a_user_follow_nothing(spark):
    e = D.ev(spark, SMOKE)
    one = D.purchase(spark, e).where("event_name = 'purchase_first' and billing_interval = 'month'").limit(1)
    at = one.first().occurred_at
    rows = one.withColumn("user_id", F.lit(None).cast("bigint")).crossJoin(spark.createDataFrame([("p1", at), ("p2", at + timedelta(seconds=1))], "i string, at timestamp"))
    rows = rows.withColumn("event_id", F.col("i")).withColumn("occurred_at", F.col("at")).drop("i", "at")
    got = tables(spark, rows)[2].select("event_id", "previous_purchases", "paid_months_before").collect()
    assert sorted(tuple(r) for r in got) == [("p1", 0, 0), ("p2", 0, 0)]


def test_histories_go_over_the_network_once(spark):
    e, usage, f = tables(spark)
    # purchases, their facts, exposures and countries by user; blocks by day took most of them three times (9 and 8 shuffles)
    assert exchanges(f) <= 5
    o = V.purchase_outcomes(f.localCheckpoint(), D.purchase(spark, e), D.adjustment(spark, e), usage, P, 5)
    assert exchanges(o) <= 3


def test_events_are_parsed_once(spark, monkeypatch):
    read, table = [], D.table
    monkeypatch.setattr(D, "table", lambda s, d, name: read.append(name) or table(s, d, name))
    from tidemark.catalog import scores

    scores.features(spark, SMOKE)
    scores.features(spark, SMOKE)
    assert read.count("events") <= 1


def test_readout_reads_the_parsed_events(spark, monkeypatch):
    from tidemark.catalog import experiment, scores

    scores.events(spark, SMOKE)
    read, table = [], D.table
    monkeypatch.setattr(D, "table", lambda s, d, name: read.append(name) or table(s, d, name))
    assert experiment.segments(spark, SMOKE).count() > 0
    assert "events" not in read

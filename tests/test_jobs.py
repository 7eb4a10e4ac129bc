"""Usage cost, attribution, scores, experiment and streaming jobs on inline rows."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.params import Params
from tidemark.plans import allocation as A
from tidemark.plans import audiences as AU
from tidemark.plans import experiment as E
from tidemark.plans import identity as I
from tidemark.plans import purchase_value as V
from tidemark.plans import scores_24h as S
from tidemark.plans import usage_cost as U
from tidemark.sinks import tables as K
from tidemark.streaming import jobs as J

T0 = datetime(2026, 9, 1)


def hours(n):
    return T0 + timedelta(hours=n)


# ---- usage ------------------------------------------------------------------

LEDGER = "id string, type string, amount long, creditField string, balanceBefore long, balanceAfter long, reference struct<businessType: string, businessId: string>, createdAt string, userId string, businessDetails array<struct<quantity: long, unitCredits: long, subBusinessType: string, metadata: struct<projectId: string, mediaType: string, source: string, discountPct: double, originalUnitCredits: long>>>"


def entry(i, user, cap, credits, original=0, kind="CONSUME", day=1, hid="h"):
    return (i, kind, -credits, "subscription_monthly_credit", 0, 0, (cap, hid), f"2026-09-{day:02d}T00:00:00Z", user, [(2, credits, None, ("p", "image", "web", None, original))])


def test_ledger_dedup_and_quarantine(spark):
    df = spark.createDataFrame([entry("a", "u1", "m:text-to-image", 5), entry("a", "u1", "m:text-to-image", 5, day=2), entry("b", None, "m:text-to-image", 5), entry("c", "u1", "m:lipSync", 5)], LEDGER)
    kept, orphans = U.usage_entries(df, Params())
    assert sorted((r.ledger_entry_id, r.media_type) for r in kept.collect()) == [("a", "image"), ("c", "video")]
    assert [r.id for r in orphans.collect()] == ["b"]


def test_cost_precedence_and_discounts(spark):
    caps = [("x", "m:img", 10), ("y", "m:img", 7), ("z", "m:img", 0), ("w", "other:img", 4), ("v", "o:img", 10), ("f", "m:img", 10)]
    rows = [entry(i, "u", c, n, hid=i) for i, c, n in caps] + [entry("o2", "u", "m:img", 0, original=10, hid="o2"), entry("rf", "u", "m:img", 0, kind="REFUND", hid="f")]
    p = Params(vendor_discounts={"fal": 0.25}, failed_cost_share=0.5)
    entries, _ = U.usage_entries(spark.createDataFrame(rows, LEDGER), p)
    prices = U.price_settings(spark.createDataFrame([("m:img", "hi", 10, 0.4, "https://fal.ai/a"), ("m:img", "hi2", 10, 0.3, "https://fal.ai/a"), ("m:img", "lo", 2, 0.1, "https://fal.ai/a")], "business_type string, setting string, credits long, list_cost_usd double, source_url string"), p)
    over = spark.createDataFrame([("o1", "o:img", None, None, None, 0.01, None, None, None, None), ("o9", "o:img", None, None, None, 9.0, None, None, datetime(2027, 1, 1).date(), None)],
                                 "override_id string, business_type string, setting string, route string, vendor string, unit_cost_usd double, cost_per_credit_usd double, discount_pct double, valid_from date, valid_to date")
    refunds = entries.where("entry_type = 'REFUND'").select("user_id", "business_type", "business_id", "created_at")
    got = {r.ledger_entry_id: r for r in U.generation_cost(U.usage_details(entries), refunds, prices, over, p).collect()}
    assert (got["x"].cost_basis, got["x"].setting, got["x"].matching_settings, got["x"].cost_usd) == ("exact_setting", "hi", 2, pytest.approx(0.6))
    assert (got["y"].cost_basis, got["y"].cost_usd) == ("capability_mean_per_credit", pytest.approx((0.04 + 0.03 + 0.05) / 3 * 7 * 2 * 0.75, abs=1e-6))
    assert (got["z"].cost_basis, got["z"].cost_usd) == ("unlimited_cheapest_setting", pytest.approx(0.15))
    assert got["o2"].cost_basis == "unlimited_original_credits" and got["w"].cost_basis == "default_per_credit" and got["w"].cost_usd == pytest.approx(0.016)
    assert (got["v"].cost_basis, got["v"].override_id, got["v"].cost_usd) == ("override_capability", "o1", pytest.approx(0.02))
    assert got["f"].is_failed_generation and got["f"].cost_usd == pytest.approx(0.3)


# ---- attribution --------------------------------------------------------------

PLATFORMS = [("gclid", "google_ads", "paid_google", 1), ("fbclid", "meta", "paid_meta", 2)]


def test_acquisition_is_point_in_time(spark):
    anchors = spark.createDataFrame([("early", "u", hours(5)), ("late", "u", hours(10)), ("none", "w", hours(10))], "anchor_key string, user_id string, anchor_at timestamp")
    clicks = spark.createDataFrame([("u", "gclid", "g1", hours(1), hours(1), 2), ("u", "fbclid", "f1", hours(2), hours(8), 1), ("u", "gclid", "late", hours(9), hours(20), 1)], "user_id string, click_id_key string, click_id_value string, click_id_created_at timestamp, known_at timestamp, source_priority int")
    utms = spark.createDataFrame([("w", "utm_source", "tolt", hours(3), hours(3), 1)], "user_id string, utm_key string, utm_value string, captured_at timestamp, known_at timestamp, source_priority int")
    got = {r.anchor_key: (r.acquisition_channel, r.has_fbclid) for r in I.acquisition_as_of(anchors, clicks, utms, PLATFORMS, True, ["utm_source", "utm_medium"]).collect()}
    assert got == {"early": ("paid_google", False), "late": ("paid_meta", True), "none": ("affiliate", False)}
    strict = {r.anchor_key: r.acquisition_channel for r in I.acquisition_as_of(spark.createDataFrame([("at", "u", hours(1))], "anchor_key string, user_id string, anchor_at timestamp"), clicks, utms, PLATFORMS, False, ["utm_source", "utm_medium"]).collect()}
    assert strict == {"at": "organic"}


def test_click_replay_keeps_first_time_of_a_repeated_value(spark):
    obs = spark.createDataFrame([("u", "k", "a", hours(1)), ("u", "k", "a", hours(3)), ("u", "k", "b", hours(4)), ("u", "k", "a", hours(5)), ("u", "k", "a", hours(50)), ("u", "old", "z", hours(-999))], "user_id string, click_id_key string, click_id_value string, observed_at timestamp")
    got = {r.click_id_key: (r.click_id_value, r.click_id_at) for r in I.resolve_clicks_replay(obs, hours(6), 48 * 3600).collect()}
    assert got == {"k": ("a", hours(5))}


# ---- scores ---------------------------------------------------------------------

def test_shrunk_rates_and_fit_sets(spark):
    weeks = [T0.date()]
    o = spark.createDataFrame([(1, 0, datetime(2026, 8, 3).date(), "activated", True, True, True), (2, 1, datetime(2026, 8, 3).date(), "activated", True, False, True), (3, 1, datetime(2026, 9, 7).date(), "activated", True, True, True)],
                              "user_id long, cf_fold int, signup_week date, segment string, is_conversion_mature boolean, converted_after_24h boolean, is_horizon_complete boolean")
    p = Params(folds=2, prior_users=10.0)
    fits = {(r.fit_id, r.user_id) for r in S.into_fits(o.select("user_id", "cf_fold", "signup_week"), weeks, p).collect()}
    assert fits == {("all", 1), ("all", 2), ("all", 3), ("xf1", 1), ("xf0", 2), ("xf0", 3), ("oot_20260901", 1), ("oot_20260901", 2), ("oot_20260901_xf1", 1), ("oot_20260901_xf0", 2)}
    rate = {(r.fit_id, r.segment): r.p_convert for r in S.segment_rates(o, weeks, p).collect()}
    assert rate[("all", "activated")] == pytest.approx((2 + 10 * 0.05) / 13) and rate[("xf1", "activated")] == pytest.approx((1 + 0.5) / 11) and rate[("all", "activated_depleted")] == pytest.approx(0.08)


def test_purchase_score_by_hand(spark):
    row = dict(purchase_kind="monthly", event_name="purchase_first", revenue_minor=2000, renewal_prob=0.5, list_price=30.0, plan_monthly_credits=1000, credits_before=0, cost_per_credit_before=None, arm_cpc=0.002, paid_credits_before=0, paid_months_before=0,
               plan_utilization=0.4, is_affiliate=False, refund_rate=0.02, chargeback_rate=0.005, addon_per_month=1.0, pack_utilization=0.4, pack_future_revenue=5.0, pack_future_q90=30.0, burn_cv=0.6)
    ddl = "purchase_kind string, event_name string, revenue_minor long, renewal_prob double, list_price double, plan_monthly_credits long, credits_before long, cost_per_credit_before double, arm_cpc double, paid_credits_before long, paid_months_before long, plan_utilization double, is_affiliate boolean, refund_rate double, chargeback_rate double, addon_per_month double, pack_utilization double, pack_future_revenue double, pack_future_q90 double, burn_cv double"
    got = V.score_expression(spark.createDataFrame([tuple(row.values())], ddl), 5000.0, Params()).collect()[0]
    revenue = 20 + 20 * 0.75 + 1.75
    cost = 400 * 1.75 * 0.002
    fees = revenue * 0.036 + 1.75 * 0.3 + 1.75 * 0.005 * 15
    assert got.predicted_revenue == pytest.approx(revenue) and got.predicted_generation_cost == pytest.approx(cost) and got.predicted_fees == pytest.approx(fees, abs=1e-6)
    assert got.predicted_profit == pytest.approx(revenue - cost - fees - revenue * 0.025, abs=1e-5)
    keep, per = 1 - 0.036 - 0.025, 0.3 + 15 * 0.005
    low = (20 + 1) * keep - per - 400 * 0.002 * (1 + 1.2816 * 0.6)
    high = (20 + 40 + 3) * keep - 3 * per - 1200 * 0.002 * max(0, 1 - 1.2816 * 0.6)
    # 1 - s = 0.5 and 1 - s^2 = 0.75: the low side sees no renewal, the high side two
    assert got.interval_low == pytest.approx(low, abs=1e-5) and got.interval_high == pytest.approx(high, abs=1e-5)


# ---- experiment -------------------------------------------------------------------

def test_exposure_event_outranks_property_and_two_arm_users_stay(spark):
    rows = spark.createDataFrame([(1, "u", "f", "a", hours(1), 2), (2, "u", "f", "b", hours(2), 1), (3, "v", "f", "a", hours(3), 2)], "event_id long, user_id string, flag_key string, arm string, event_time timestamp, source_priority int")
    got = {r.user_id: (r.arm, r.n_distinct_arms) for r in E.exposures(rows).collect()}
    assert got == {"u": ("b", 2), "v": ("a", 1)}


def test_confidence_sequence_and_chi_square(spark):
    x = spark.createDataFrame([("f", "t", "a", 8.0, 4.0, 100.0, 100.0)], "flag_key string, target string, arm string, z double, information double, treatment_n double, control_n double").withColumn("estimate", F.col("z") / F.col("information"))
    r = A.confidence_sequence(x, 1.0, 0.05).collect()[0]
    half = math.sqrt((1 + 4) / 16 * (2 * math.log(20) + math.log1p(4)))
    assert r.upper - r.estimate == pytest.approx(half) and r.lower == pytest.approx(2 - half)
    tail = {r.k: r.p for r in spark.createDataFrame([(3.841458820694124, 1), (5.991464547107979, 2), (7.814727903251179, 3), (18.307038053275146, 10)], "x double, k int").select("k", A.chi_square_tail("x", "k").alias("p")).collect()}
    assert all(v == pytest.approx(0.05, abs=1e-9) for v in tail.values())


def test_p_best_is_seeded_and_ordered(spark):
    post = spark.createDataFrame([("f", "t", "good", 10.0, 50.0, 20.0, 100.0), ("f", "t", "bad", 0.0, 50.0, 20.0, 100.0)], "flag_key string, target string, arm string, mu double, kappa double, alpha double, beta double")
    a = {r.arm: (r.p_best, r.expected_loss) for r in A.p_best(post, 500, 3).collect()}
    b = {r.arm: (r.p_best, r.expected_loss) for r in A.p_best(post.repartition(3), 500, 3).collect()}
    assert a == b and a["good"][0] > 0.99 and a["bad"][1] == pytest.approx(10, abs=1.5)


@pytest.mark.parametrize("alpha,beta", [(3.0, 4.0), (20.0, 50.0), (0.7, 1.0)])
def test_posterior_draws_have_their_distribution(spark, alpha, beta):
    """P(one arm beats a fixed one) is a Student t tail: compared with draws of the same posterior by another generator."""
    post = spark.createDataFrame([("f", "t", "a", 1.0, 4.0, alpha, beta), ("f", "t", "b", 0.0, 1e12, 50.0, 1.0)], "flag_key string, target string, arm string, mu double, kappa double, alpha double, beta double")
    got = {r.arm: r.p_best for r in A.p_best(post, 20_000, 11).collect()}
    rng = np.random.default_rng(0)
    other = 1.0 + np.sqrt(beta / rng.gamma(alpha, 1.0, 400_000) / 4.0) * rng.standard_normal(400_000)
    assert got["a"] == pytest.approx((other > 0).mean(), abs=0.015) and got["a"] + got["b"] == pytest.approx(1)


def test_value_bucket_edges(spark):
    x = spark.createDataFrame([(None,), (-1.0,), (0.0,), (0.5,), (1.0,), (1.2,), (1.19,), (1.44,)], "v double").select(AU.value_bucket(F.col("v")).alias("b"))
    assert [r.b for r in x.collect()] == ["none", "0", "0", "<1", "0", "1", "0", "2"]


# ---- sinks and streams ---------------------------------------------------------------

def test_append_new_adds_nothing_twice(spark, tmp_path):
    p = str(tmp_path / "log")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, v string")
    assert [K.append_new(p, df, ["id"]), K.append_new(p, df, ["id"])] == [2, 0]
    assert spark.read.parquet(p).count() == 2


def test_ledger_sink_is_idempotent_per_batch(spark, tmp_path):
    p = str(tmp_path / "ledger")
    sink = J.first_write_wins(p, "id")
    first, second = (spark.createDataFrame(r, "id long, v string") for r in ([(1, "a"), (2, "a")], [(2, "b"), (3, "b")]))
    for batch, i in ((first, 0), (second, 1), (second, 1), (first, 0)):
        sink(batch, i)
    assert sorted((r.id, r.v) for r in spark.read.parquet(p).collect()) == [(1, "a"), (2, "a"), (3, "b")]


def test_stream_park_and_join_equals_batch(spark, tmp_path):
    ev = [(1, "k1", hours(1)), (2, "k2", hours(2)), (3, "k3", hours(3)), (-1, "end", hours(9999))]
    dep = [("k1", hours(5)), ("k2", hours(60)), ("zz", hours(9999))]
    for name, rows, ddl in (("e", ev, "event_id long, dep_key string, received_at timestamp"), ("d", dep, "dep_key string, partner_at timestamp")):
        for r in rows:
            spark.createDataFrame([r], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    read = lambda n, ddl: spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n))
    x = J.park_and_join(read("e", "event_id long, dep_key string, received_at timestamp"), read("d", "dep_key string, partner_at timestamp"), "dep_key", "received_at", "partner_at", "24 hours", "10 days", salts=3)
    J.run_once(x, J.versions(str(tmp_path / "out")), str(tmp_path / "cp"))
    got = {r.event_id: r.status for r in spark.read.parquet(str(tmp_path / "out")).where("event_id > 0").collect()}
    assert got == {1: "resolved", 2: "degraded", 3: "degraded"}

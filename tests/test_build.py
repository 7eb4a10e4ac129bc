"""The whole revenue run on a folder of deliveries: readers, layers, marts, views."""

from datetime import date

import pytest
from test_billing import DELIVERY, at, delivery, refund

from tidemark.params import Params
from tidemark.plans import build as W
from tidemark.sources import schemas as S

INVOICE = {"id": "in_1", "customer": "u1", "status": "paid", "billing_reason": "subscription_create", "currency": "usd", "amount_paid": 2000, "total": 2000, "created": 1_788_300_000, "subscription": "sub_1", "charge": "ch_1",
           "lines": {"data": [{"id": "il_1", "amount": 2000, "quantity": 1, "price": {"id": "pm"}}]}}
SEEDS = {"plan_catalog": [("pm", "x", "plan", "essential", "month", *[None] * 6)], "fx_rates": [("USD", date(2020, 1, 1), 1.0, "x")], "currency_minor_units": [("USD", 2, "x")]}


@pytest.fixture
def folder(spark, tmp_path):
    for name, rows in SEEDS.items():
        spark.createDataFrame(rows, S.SEEDS[name]).write.option("header", True).csv(f"{tmp_path}/seeds/{name}.csv")
    return str(tmp_path)


def put(spark, folder, rows):
    spark.createDataFrame(rows, DELIVERY).write.mode("append").json(f"{folder}/inbox")


def go(spark, folder, day=20, manifest=None):
    names = W.run(spark, f"{folder}/inbox", f"{folder}/seeds", f"{folder}/warehouse", Params(as_of=at(day)), manifest)
    m = W.read_marts(spark, f"{folder}/warehouse")
    rows = {n: sorted(str(sorted(r.asDict().items(), key=str)) for r in df.collect()) for n, df in m.items()}
    return rows, {n: spark.table(n).collect() for n in names}


def test_run_is_idempotent_and_pinned(spark, folder):
    paid = delivery("e1", "invoice.paid", INVOICE, at(2))
    put(spark, folder, [paid, refund("r1", 500, 3), refund("r2", 1400, 4)])
    first, views = go(spark, folder)
    day = views["rpt_revenue_daily"][0]
    assert (day.purchases, day.gross_minor, day.taken_minor, day.restated_minor) == (1, 2000, 1400, 600)
    assert sorted((r.adjustments, r.ledger_cash_minor) for r in views["rpt_money_out_daily"]) == [(1, -900), (1, -500)]
    assert all("user_id" not in r.asDict() for rows in views.values() for r in rows) and len(views["rpt_subscriptions"]) == 1
    # a second run, redeliveries, and a new refund that arrives after the pinned instant, change nothing; a later instant sees it
    put(spark, folder, [paid, (*paid[:6], at(6)), refund("r3", 2000, 25)])
    assert go(spark, folder)[0] == first
    later, views = go(spark, folder, 28)
    assert later != first and views["rpt_revenue_daily"][0].restated_minor == 0


def test_empty_inbox_leaves_empty_tables(spark, folder):
    put(spark, folder, [delivery("t", "invoice.paid", INVOICE, at(2), live=False)])
    rows, views = go(spark, folder)
    assert not any(rows.values()) and not any(views.values())


def test_wrong_counts_and_open_runs_stop_before_writing(spark, folder, tmp_path):
    put(spark, folder, [delivery("e1", "invoice.paid", INVOICE, at(2))])
    with pytest.raises(ValueError, match="deliveries 1 instead of 2"):
        go(spark, folder, manifest={"deliveries": 2})
    with pytest.raises(ValueError, match="as_of"):
        W.run(spark, f"{folder}/inbox", f"{folder}/seeds", f"{folder}/warehouse", Params())
    assert not (tmp_path / "warehouse").exists()


def test_purchases_that_name_their_plan_stay_out_of_the_history(spark, folder, monkeypatch):
    """All purchases were sent to the frame of their subscription."""
    from tidemark.plans import money as M

    anchors, original = [], M.lookup_many
    monkeypatch.setattr(M, "lookup_many", lambda x, *a, **k: anchors.append(sorted(r.invoice_id for r in x.collect())) or original(x, *a, **k))
    event = lambda i, user, day, price, reason="subscription_cycle": delivery(
        f"e{i}", "invoice.paid", {**INVOICE, "id": f"in_{i}", "customer": user, "created": 1_788_300_000 + 86_400 * i, "charge": f"ch_{i}", "billing_reason": reason,
                                  "lines": {"data": [{"id": f"il_{i}", "amount": 2000, "quantity": 1, "price": {"id": price}}]}}, at(day))
    put(spark, folder, [event(1, "u1", 2, "full"), event(2, "u1", 3, "unknown"), event(3, "u2", 4, "full", "subscription_update"), event(4, "u2", 5, "full"), event(5, None, 6, "full")])
    spark.createDataFrame([("full", "x", "plan", "essential", "month", None, 1, *[None] * 4)], S.SEEDS["plan_catalog"]).write.mode("overwrite").option("header", True).csv(f"{folder}/seeds/plan_catalog.csv")
    go(spark, folder)
    assert anchors == [["in_2", "in_3"]]
    rows = {r.invoice_id: r for r in W.read_marts(spark, f"{folder}/warehouse")["purchases"].collect()}
    assert all(r.plan_tier == "essential" and r.billing_interval == "month" and r.plan_tier_code == 1 for r in rows.values())
    assert {i: r.is_first_purchase for i, r in rows.items()} == {"in_1": True, "in_2": False, "in_3": True, "in_4": False, "in_5": False}


def test_layers_and_marts_are_written_small(spark, tmp_path):
    from tidemark.sinks import tables as K

    df = spark.range(10).selectExpr("id as user_id", "timestamp'2024-01-01' as at")
    K.write_layer(df, str(tmp_path), "staging", "x")
    K.write_mart(df, f"{tmp_path}/mart", "at", ["user_id"])
    files = list(tmp_path.rglob("*.parquet"))
    assert files and all(f.name.endswith(".zstd.parquet") for f in files)

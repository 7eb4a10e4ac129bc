"""Billing staging and money jobs on inline rows."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.params import Params
from tidemark.plans import billing as B
from tidemark.plans import money as M

DELIVERY = "id string, type string, created long, api_version string, livemode boolean, data string, received_at timestamp"


def at(day, hour=0):
    return datetime(2026, 9, day, hour)


def delivery(i, kind, obj, received, live=True, prev=None, created=1_788_300_000):
    return (i, kind, created, "v", live, json.dumps({"object": obj, "previous_attributes": prev or {}}), received)


def frame(spark, rows):
    return spark.createDataFrame(rows, DELIVERY)


def test_first_delivery_kept_and_test_mode_dropped(spark):
    rows = [delivery("e1", "invoice.paid", {"id": "in_1", "customer_email": "a@b.c"}, at(2, 1)), delivery("e1", "invoice.paid", {"id": "in_1"}, at(2, 0)),
            delivery("e2", "invoice.paid", {"id": "in_2"}, at(2), live=False), delivery("e3", "radar.warning", {"id": "x"}, at(2)), delivery("e4", "invoice.paid", {"id": "in_4"}, at(9))]
    got = {r.stripe_event_id: r for r in B.billing_events(frame(spark, rows), Params(as_of=at(5))).collect()}
    assert set(got) == {"e1", "e3"}
    assert got["e1"].received_at == at(2, 0) and got["e1"].is_handled_type and not got["e3"].is_handled_type
    assert "customer_email" not in got["e1"].obj.asDict()


def test_late_rows_do_not_change_an_as_of_result(spark):
    rows = [delivery("e1", "invoice.paid", {"id": "in_1"}, at(2))]
    later = rows + [delivery("e9", "invoice.paid", {"id": "in_9"}, at(20)), delivery("e1", "invoice.paid", {"id": "in_1"}, at(21))]
    pick = lambda r: [x.stripe_event_id for x in B.billing_events(frame(spark, r), Params(as_of=at(5))).collect()]
    assert pick(rows) == pick(later)


def refund(i, cum, day, charge="ch_1"):
    return delivery(i, "charge.refunded", {"id": charge, "customer": "u1", "amount": 2000, "amount_refunded": cum, "currency": "usd", "payment_intent": "pi_1"}, at(day), created=1_788_300_000 + day * 86_400)


def test_cumulative_refunds_become_steps(spark):
    rows = [refund("r2", 1400, 4), refund("r1", 500, 3), refund("r1b", 500, 5), refund("r0", 0, 2)]
    got = sorted((r.amount_refunded_cumulative_minor, r.refund_step_minor, r.stripe_event_id) for r in B.refunds(B.billing_events(frame(spark, rows), Params())).collect())
    assert got == [(500, 500, "r1"), (1400, 900, "r2")]


def test_one_row_per_invoice_and_line_fields(spark):
    line = {"id": "il_1", "amount": 1000, "currency": "eur", "pricing": {"price_details": {"price": "p_new"}}, "price": {"id": "p_old"}, "quantity": 2, "period": {"start": 1, "end": 2}}
    old = {"id": "il_2", "amount": 5, "price": {"id": "p_old"}, "proration": True}
    inv = {"id": "in_1", "customer": "u1", "status": "paid", "currency": "eur", "amount_paid": 1005, "created": 100, "subscription": "sub_1", "lines": {"data": [line, old]}}
    rows = [delivery("a", "invoice.paid", inv, at(1), created=10), delivery("b", "invoice.paid", {**inv, "amount_paid": 7}, at(2), created=20)]
    i = B.invoices(B.billing_events(frame(spark, rows), Params()))
    r = i.collect()
    assert len(r) == 1 and r[0].amount_paid_minor == 1005 and r[0].currency == "EUR" and r[0].subscription_id == "sub_1" and r[0].paid_at == datetime(1970, 1, 1, 0, 1, 40)
    got = {x.line_id: x for x in B.invoice_lines(i).collect()}
    assert (got["il_1"].price_id, got["il_2"].price_id) == ("p_new", "p_old") and got["il_2"].is_proration and got["il_1"].line_position == 0


def test_dispute_lifecycle(spark):
    def d(i, kind, dispute, status, day):
        return delivery(i, f"charge.dispute.{kind}", {"id": dispute, "charge": "ch", "amount": 100, "currency": "usd", "status": status, "created": 5}, at(day), created=1_788_300_000 + day)

    rows = [d("1", "created", "won", "needs_response", 1), d("2", "closed", "won", "won", 2), d("3", "created", "lost", "needs_response", 1), d("4", "closed", "lost", "lost", 3),
            d("5", "created", "ask", "warning_needs_response", 1), d("6", "created", "back", "lost", 1), d("7", "funds_reinstated", "back", "lost", 2)]
    got = {r.dispute_id: (r.dispute_status, r.is_inquiry, r.is_funds_reinstated, r.is_money_lost, r.closed_at is not None) for r in B.disputes(B.billing_events(frame(spark, rows), Params())).collect()}
    assert got == {"won": ("won", False, True, False, True), "lost": ("lost", False, False, True, True), "ask": ("warning_needs_response", True, False, False, False), "back": ("lost", False, True, False, False)}


@pytest.fixture(scope="module")
def fx(spark):
    rates = spark.sql("SELECT * FROM VALUES ('USD', date'2020-01-01', 1.0D), ('EUR', date'2020-01-01', 1.2D), ('EUR', date'2026-09-10', 1.5D), ('JPY', date'2020-01-01', 0.01D) AS t(currency, rate_date, usd_per_unit)")
    return M.fx_ranges(rates, spark.sql("SELECT * FROM VALUES ('USD', 2L), ('JPY', 0L) AS t(currency, minor_unit_digits)"), "USD")


def test_fx_ranges_and_cross_rates(spark, fx):
    got = {(r.currency, str(r.valid_from)): (str(r.valid_to), round(r.reporting_per_unit, 6), r.minor_unit_digits, r.minor_unit_digits_known) for r in fx.collect()}
    assert got[("EUR", "2020-01-01")] == ("2026-09-10", 1.2, 2, False) and got[("EUR", "2026-09-10")] == ("None", 1.5, 2, False) and got[("JPY", "2020-01-01")][2] == 0


INV = "invoice_id string, paid_event_id string, paid_at timestamp, user_id string, invoice_status string, billing_reason string, currency string, amount_paid_minor long, total_minor long, total_excluding_tax_minor long, subscription_id string, legacy_charge_id string, legacy_payment_intent_id string"


def run_purchases(spark, fx, invoices, lines, sessions=(), payments=(), states=()):
    cat = spark.sql("SELECT * FROM VALUES ('pm', 'plan', 'essential', 'month', 1L), ('py', 'plan', 'wonder', 'year', 4L), ('pk', 'credit_pack', NULL, NULL, NULL) AS t(price_id, item_type, plan_tier, billing_interval, plan_tier_code)")
    s = spark.createDataFrame(list(sessions), "checkout_session_id string, completed_event_id string, completed_at timestamp, checkout_mode string, session_status string, payment_status string, user_id string, invoice_id string, payment_intent_id string, amount_total_minor long, amount_tax_minor long, currency string, ga_client_id string, ga_session_id string, tolt_referral string")
    p = spark.createDataFrame(list(payments), "invoice_payment_id string, invoice_id string, payment_intent_id string, charge_id string, payment_created_at timestamp")
    st = spark.createDataFrame(list(states), "stripe_event_id string, subscription_id string, changed_at timestamp, pack_quantity long, plan_tier string, billing_interval string, plan_tier_code long")
    li = spark.createDataFrame(list(lines), "invoice_id string, line_id string, amount_minor long, quantity long, price_id string")
    return M.purchases(spark.createDataFrame(list(invoices), INV), li, s, p, st, cat, fx)


def inv(i, reason, day, amount=1000, total=1000, ex=None, currency="USD", sub="s1", user="u1"):
    return (i, "e" + i, at(day), user, "paid", reason, currency, amount, total, ex, sub, None, None)


def test_purchase_classification_and_plan(spark, fx):
    invoices = [inv("in_1", "subscription_create", 1), inv("in_2", "subscription_cycle", 2), inv("in_3", "subscription_update", 3), inv("in_4", "subscription_update", 4), inv("in_5", "manual", 5), inv("in_6", "subscription_create", 6, user="u2", sub="s2")]
    lines = [("in_1", "a", 1000, 1, "pm"), ("in_2", "b", 1000, 1, "unknown"), ("in_3", "c", 900, 1, "py"), ("in_3", "d", -300, 1, "pm"), ("in_4", "e", 500, 3, "pk"), ("in_6", "f", 10, 1, "pm")]
    pack = ("cs_1", "ev", at(7), "payment", "complete", "paid", "u1", "in_6", "pi", 500, 50, "USD", None, None, None)
    got = {r.event_id: r for r in run_purchases(spark, fx, invoices, lines, [pack]).collect()}
    assert set(got) == {f"purchase_in_{i}" for i in range(1, 7)}
    kind = {k[-4:]: (r.event_name, r.classification_rule) for k, r in got.items()}
    assert kind["in_1"] == ("purchase_first", "billing_reason_subscription_create") and kind["in_2"] == ("purchase_renewal", "billing_reason_recurring")
    assert kind["in_3"] == ("purchase_upgrade", "plan_change_lines") and kind["in_4"] == ("purchase_add_on", "credit_pack_line") and kind["in_5"] == (None, "unclassified_billing_reason")
    # the pack checkout owns invoice in_6
    assert kind["in_6"] == ("purchase_one_time_pack", "payment_mode_checkout") and got["purchase_in_6"].revenue_minor == 450
    assert got["purchase_in_2"].plan_tier == "essential" and got["purchase_in_2"].has_unknown_price_lines and got["purchase_in_3"].previous_plan_tier == "essential" and got["purchase_in_3"].plan_tier == "wonder"
    assert got["purchase_in_1"].is_first_purchase and not got["purchase_in_2"].is_first_purchase and not got["purchase_in_6"].is_first_purchase


def test_same_instant_invoice_is_not_a_predecessor(spark, fx):
    invoices = [inv("in_1", "subscription_create", 1), inv("in_2", "subscription_cycle", 1)]
    got = {r.invoice_id: r.plan_tier for r in run_purchases(spark, fx, invoices, [("in_1", "a", 1000, 1, "pm")]).collect()}
    assert got == {"in_1": "essential", "in_2": None}


def test_fx_and_tax(spark, fx):
    invoices = [inv("in_1", "subscription_create", 1, 1190, 1190, 1000, "EUR"), inv("in_2", "subscription_cycle", 11, 1190, 1190, 1000, "EUR"), inv("in_3", "subscription_cycle", 12, 500, 500, None, "JPY"), inv("in_4", "subscription_cycle", 13, 500, 500, None, "XYZ")]
    got = {r.invoice_id: (r.revenue_minor, r.cash_value_reporting, r.revenue_reporting) for r in run_purchases(spark, fx, invoices, []).collect()}
    assert got["in_1"] == (1000, pytest.approx(14.28), pytest.approx(12.0)) and got["in_2"] == (1000, pytest.approx(17.85), pytest.approx(15.0))
    assert got["in_3"] == (500, pytest.approx(5.0), pytest.approx(5.0)) and got["in_4"] == (500, None, None)


def test_linkage_and_dispute_netting(spark, fx):
    p = run_purchases(spark, fx, [inv("in_1", "subscription_create", 1, 1000), inv("in_2", "subscription_cycle", 2, 800)], [], payments=[("ip", "in_1", "pi_1", "ch_1", at(1))])
    pay = spark.createDataFrame([("ip", "in_1", "pi_1", "ch_1", at(1))], "invoice_payment_id string, invoice_id string, payment_intent_id string, charge_id string, payment_created_at timestamp")
    refunds = spark.createDataFrame([("e1", at(3), "ch_1", "u1", "pi_1", None, 600, 600, "USD"), ("e2", at(4), "ch_x", "u1", None, "in_2", 800, 800, "USD"), ("e3", at(4), "ch_q", "u9", None, None, 5, 5, "USD")],
                                    "stripe_event_id string, refunded_at timestamp, charge_id string, user_id string, payment_intent_id string, legacy_invoice_id string, amount_refunded_cumulative_minor long, refund_step_minor long, currency string")
    disputes = spark.createDataFrame([("dp_1", "e5", at(5), "ch_1", None, 1000, "USD", "fraudulent", "lost", True), ("dp_2", "e6", at(6), "ch_1", None, 1000, "USD", "general", "won", False), ("dp_3", "e7", at(7), "ch_1", None, 50, "USD", "general", "lost", True)],
                                     "dispute_id string, stripe_event_id string, disputed_at timestamp, charge_id string, payment_intent_id string, amount_minor long, currency string, dispute_reason string, dispute_status string, is_money_lost boolean")
    got = {r.event_id: r for r in M.adjustments(refunds, disputes, pay, p, fx).collect()}
    assert (got["refund_ch_1_600"].link_path, got["refund_ch_x_800"].link_path, got["refund_ch_q_5"].link_path) == ("payment_intent", "legacy_invoice", None)
    assert (got["chargeback_dp_1"].ledger_cash_value_minor, got["chargeback_dp_1"].disposition, got["chargeback_dp_1"].restated_order_value_minor) == (-400, "chargeback", 0)
    assert (got["chargeback_dp_2"].ledger_cash_value_minor, got["chargeback_dp_2"].disposition, got["chargeback_dp_2"].is_ledger_event) == (0, "dispute_won_or_inquiry", False)
    assert (got["chargeback_dp_3"].ledger_cash_value_minor, got["chargeback_dp_3"].disposition) == (0, "dispute_after_full_refund")
    assert got["refund_ch_1_600"].restated_order_value_minor == 400 and got["refund_ch_q_5"].adjusts_event_id is None and got["chargeback_dp_1"].user_id == "u1"


def test_subscription_status(spark):
    invs = spark.createDataFrame([("i1", "sA", "u1", at(1), at(8), "paid"), ("i2", "sB", "u1", at(1), at(8), "paid"), ("i3", "sC", "u2", at(1), at(28), "paid")], "invoice_id string, subscription_id string, user_id string, paid_at timestamp, period_end timestamp, invoice_status string")
    lines = spark.createDataFrame([("i1", False, at(30)), ("i2", True, at(30)), ("i2", False, at(9))], "invoice_id string, is_proration boolean, line_period_end timestamp")
    changes = spark.createDataFrame([("sC", "customer.subscription.deleted", at(10))], "subscription_id string, event_type string, changed_at timestamp")
    purch = spark.createDataFrame([("sA", "essential", "month", at(1), "e")], "subscription_id string, plan_tier string, billing_interval string, occurred_at timestamp, event_id string")
    got = {r.subscription_id: r.status_as_of for r in M.subscription_status(invs, lines, changes, purch, Params(as_of=at(20))).collect()}
    assert got == {"sA": "active", "sB": "lapsed", "sC": "canceled"}

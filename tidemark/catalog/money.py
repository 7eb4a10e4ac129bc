"""Billing staging, exchange rates, purchases, adjustments, status and the ledger."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.catalog.cte import sql
from tidemark.catalog.registry import query, shared
from tidemark.params import Params
from tidemark.plans import billing as B
from tidemark.plans import money as M
from tidemark.sinks.tables import stage
from tidemark.sources import driver_tables as D

AS_OF = datetime(2000, 1, 1)
P = Params(as_of=AS_OF)


def fx(s):
    return M.fx_ranges(D.fx_seed(s), D.minor_units_seed(s), "USD")


@shared
def purchases(s, d):
    states = M.subscription_states(D.sub_change(s, d), D.sub_item(s, d), D.plan_catalog(s, d))
    return stage(M.purchases(D.invoice_full(s, d), D.invoice_line(s, d), D.session(s, d), D.payment(s, d), states, D.plan_catalog(s, d), fx(s)))


@shared
def adjustments(s, d):
    r = B.refund_steps(D.refund_event(s, d))
    x = B.dispute_lifecycle(D.dispute_event(s, d))
    return stage(M.adjustments(r, x, D.payment(s, d), purchases(s, d), fx(s)))


def json_deliveries(s, d):
    """Orders as webhook deliveries with a JSON payload, every third one delivered twice, some in test mode."""
    i = D.invoice_full(s, d)
    line = F.struct(
        F.concat(F.lit("il_"), F.col("orderkey").cast("string")).alias("id"), F.col("amount_paid_minor").alias("amount"), F.lower("currency").alias("currency"),
        F.when(F.col("orderkey") % 2 == 0, F.struct(F.struct(F.concat(F.lit("price_"), (F.col("orderkey") % 200).cast("string")).alias("price")).alias("price_details"))).alias("pricing"),
        F.when(F.col("orderkey") % 2 == 1, F.struct(F.concat(F.lit("price_"), (F.col("orderkey") % 200).cast("string")).alias("id"))).alias("price"),
        (F.col("orderkey") % 5).alias("quantity"), F.lit(True).alias("proration"))
    obj = F.struct(
        F.col("invoice_id").alias("id"), F.lit("invoice").alias("object"), F.col("user_id").alias("customer"), F.lit("paid").alias("status"), "billing_reason", F.lower("currency").alias("currency"),
        F.col("amount_paid_minor").alias("amount_paid"), F.col("total_minor").alias("total"), F.col("total_excluding_tax_minor").alias("total_excluding_tax"),
        F.unix_timestamp("paid_at").alias("created"), F.when(F.col("orderkey") % 2 == 0, F.struct(F.struct(F.col("subscription_id").alias("subscription")).alias("subscription_details"))).alias("parent"),
        F.when(F.col("orderkey") % 2 == 1, F.col("subscription_id")).alias("subscription"), F.struct(F.array(line).alias("data")).alias("lines"), F.lit("x@example.com").alias("customer_email"))
    one = i.select(
        F.col("paid_event_id").alias("id"), F.lit("invoice.paid").alias("type"), F.unix_timestamp("paid_at").alias("created"), F.lit("2025-01-01").alias("api_version"),
        (F.col("orderkey") % 10 != 4).alias("livemode"), F.to_json(F.struct(obj.alias("object"))).alias("data"), F.col("paid_at").alias("received_at"), "orderkey")
    again = one.where("orderkey % 3 = 0").withColumn("received_at", F.timestamp_micros(F.unix_micros("received_at") + 60_000_000))
    return again.unionByName(one).drop("orderkey")


LIVE = "orderkey % 10 <> 4 AND paid_at <= TIMESTAMP '2000-01-01'"


@query("job_3_billing_staging", sql(f"""SELECT invoice_id, paid_event_id, user_id, subscription_id, billing_reason, currency, amount_paid_minor, total_excluding_tax_minor, paid_at FROM invoice_full WHERE {LIVE}"""))
def _(s, d):
    inv = B.invoices(B.billing_events(json_deliveries(s, d), P))
    return inv.select("invoice_id", "paid_event_id", "user_id", "subscription_id", "billing_reason", "currency", "amount_paid_minor", "total_excluding_tax_minor", "paid_at")


@query("exp_2_invoice_lines", sql(f"""SELECT invoice_id, 'il_' || orderkey AS line_id, 0 AS line_position, amount_paid_minor AS amount_minor, currency, 'price_' || (orderkey % 200) AS price_id, orderkey % 5 AS quantity, true AS is_proration FROM invoice_full WHERE {LIVE}"""))
def _(s, d):
    lines = B.invoice_lines(B.invoices(B.billing_events(json_deliveries(s, d), P)))
    return lines.select("invoice_id", "line_id", "line_position", "amount_minor", "currency", "price_id", "quantity", "is_proration")


@query("exp_4_subscription_items", sql("SELECT stripe_event_id, subscription_id, price_id, quantity FROM sub_change JOIN sub_item USING (stripe_event_id)"))
def _(s, d):
    x = D.sub_change(s, d).join(D.sub_item(s, d), "stripe_event_id")
    obj = F.struct(F.col("subscription_id").alias("id"), F.lit("subscription").alias("object"),
                   F.struct(F.array(F.struct(F.lit("si").alias("id"), F.struct(F.col("price_id").alias("id")).alias("price"), "quantity")).alias("data")).alias("items"))
    rows = x.select(F.col("stripe_event_id").alias("id"), F.col("event_type").alias("type"), F.unix_timestamp("changed_at").alias("created"), F.lit("v").alias("api_version"),
                    F.lit(True).alias("livemode"), F.to_json(F.struct(obj.alias("object"))).alias("data"), F.col("changed_at").alias("received_at"))
    return B.subscription_items(B.subscription_events(B.billing_events(rows, Params()))).select("stripe_event_id", "subscription_id", "price_id", "quantity")


@query("job_1_refund_steps", sql("SELECT charge_id, cum AS cumulative, step, refunded_at, stripe_event_id FROM refund_step"))
def _(s, d):
    r = B.refund_steps(D.refund_event(s, d))
    return r.select("charge_id", F.col("amount_refunded_cumulative_minor").alias("cumulative"), F.col("refund_step_minor").alias("step"), "refunded_at", "stripe_event_id")


@query("job_2_disputes", sql("""SELECT dispute_id, stripe_event_id, disputed_at, charge_id, payment_intent_id, amount_minor, currency, dispute_reason, dispute_status, closed_at, is_inquiry, is_funds_reinstated, is_money_lost FROM dispute"""))
def _(s, d):
    return B.dispute_lifecycle(D.dispute_event(s, d))


@query("job_4_fx_ranges", sql("""SELECT c.c_custkey, f.currency, f.valid_from, f.valid_to, f.per_unit, f.digits FROM customer c JOIN fx f ON f.currency = ([""" + ", ".join(f"'{c}'" for c in D.CURRENCIES) + """])[c.c_custkey % 6 + 1]"""))
def _(s, d):
    # every customer with the rate periods of the currency it pays in
    c = D.table(s, d, "customer").select("c_custkey", D.pick(F.col("c_custkey") % 6, D.CURRENCIES).alias("currency"))
    return c.join(fx(s), "currency").select("c_custkey", "currency", "valid_from", "valid_to", F.col("reporting_per_unit").alias("per_unit"), F.col("minor_unit_digits").alias("digits"))


@query("prj_16_classification", sql("SELECT invoice_id, event_name FROM pur WHERE NOT is_pack"))
def _(s, d):
    x = D.invoice_full(s, d).where("amount_paid_minor > 0").join(M.line_evidence(D.invoice_line(s, d), D.plan_catalog(s, d)), "invoice_id", "left")
    packs = D.session(s, d).where("checkout_mode = 'payment' and invoice_id is not null").select("invoice_id")
    name, _rule = M.classify_purchase("billing_reason", F.col("old_plan").isNotNull(), F.coalesce("has_pack_line", F.lit(False)))
    return x.join(packs, "invoice_id", "left_anti").select("invoice_id", name.alias("event_name"))


@query("job_5_purchases", sql("""SELECT p.event_id, p.event_name, p.occurred_at, p.user_id, p.cash AS cash_value_minor, p.revenue AS revenue_minor, p.currency,
    round(p.cash / power(10, f.digits) * f.per_unit, 6) AS cash_value_reporting, row_number() OVER (PARTITION BY p.user_id, p.is_pack ORDER BY p.occurred_at, p.event_id) = 1
      AND (NOT p.is_pack OR NOT EXISTS (SELECT 1 FROM pur q WHERE q.user_id = p.user_id AND NOT q.is_pack AND (q.occurred_at < p.occurred_at OR (q.occurred_at = p.occurred_at AND q.event_id < p.event_id)))) AS is_first_purchase
    FROM pur p LEFT JOIN fx f ON f.currency = p.currency AND f.valid_from <= CAST(p.occurred_at AS DATE) AND (f.valid_to IS NULL OR CAST(p.occurred_at AS DATE) < f.valid_to)"""))
def _(s, d):
    return purchases(s, d).select("event_id", "event_name", "occurred_at", "user_id", "cash_value_minor", "revenue_minor", "currency", "cash_value_reporting", "is_first_purchase")


@query("job_5_plan_resolution", sql("""SELECT i.invoice_id, coalesce(np.plan_tier, st.plan_tier, pp.plan_tier) AS plan_tier, coalesce(np.billing_interval, st.billing_interval, pp.billing_interval) AS billing_interval, coalesce(st.pack_quantity, 0) AS state_packs
    FROM pur i LEFT JOIN np ON np.invoice_id = i.invoice_id
    LEFT JOIN (SELECT * FROM (SELECT i2.invoice_id, c.*, row_number() OVER (PARTITION BY i2.invoice_id ORDER BY c.changed_at DESC, c.stripe_event_id DESC) AS n FROM pur i2 JOIN st c ON c.subscription_id = i2.subscription_id AND c.changed_at <= i2.occurred_at) WHERE n = 1) st ON st.invoice_id = i.invoice_id
    LEFT JOIN (SELECT * FROM (SELECT i2.invoice_id, q.plan_tier, q.billing_interval, row_number() OVER (PARTITION BY i2.invoice_id ORDER BY j.occurred_at DESC, j.invoice_id DESC) AS n FROM pur i2 JOIN pur j ON j.subscription_id = i2.subscription_id AND j.occurred_at < i2.occurred_at JOIN np q ON q.invoice_id = j.invoice_id) WHERE n = 1) pp ON pp.invoice_id = i.invoice_id
    WHERE NOT i.is_pack""",
    np="""SELECT * FROM (SELECT l.invoice_id, c.plan_tier, c.billing_interval, row_number() OVER (PARTITION BY l.invoice_id ORDER BY l.amount_minor DESC, l.line_id) AS n
        FROM invoice_line l JOIN plan_catalog c ON c.price_id = l.price_id WHERE c.item_type = 'plan' AND l.amount_minor > 0) WHERE n = 1""",
    st="""SELECT e.stripe_event_id, e.subscription_id, e.changed_at, CASE WHEN c.item_type = 'credit_pack' THEN i.quantity ELSE 0 END AS pack_quantity, CASE WHEN c.item_type = 'plan' THEN c.plan_tier END AS plan_tier,
        CASE WHEN c.item_type = 'plan' THEN c.billing_interval END AS billing_interval FROM sub_change e JOIN sub_item i USING (stripe_event_id) LEFT JOIN plan_catalog c ON c.price_id = i.price_id"""))
def _(s, d):
    states = M.subscription_states(D.sub_change(s, d), D.sub_item(s, d), D.plan_catalog(s, d))
    p = purchases(s, d).where("event_name is null or event_name <> 'purchase_one_time_pack'")
    from tidemark.operators.running import latest
    at = latest(p.select("invoice_id", "subscription_id", "occurred_at", "plan_tier", "billing_interval"), states.select("subscription_id", "changed_at", "stripe_event_id", "pack_quantity"),
                ["subscription_id"], "occurred_at", "changed_at", [F.col("changed_at"), F.col("stripe_event_id")], ["pack_quantity"])
    return at.select("invoice_id", "plan_tier", "billing_interval", F.coalesce("pack_quantity", F.lit(0)).alias("state_packs"))


@query("job_6_adjustments", sql("""SELECT event_id, event_name, occurred_at, adjusts_event_id, cash AS cash_value_minor, ledger_cash AS ledger_cash_value_minor,
    CASE WHEN event_name = 'refund' THEN 'refund' WHEN NOT lost THEN 'dispute_won_or_inquiry' WHEN ledger_cash = 0 THEN 'dispute_after_full_refund' ELSE 'chargeback' END AS disposition,
    CASE WHEN p_cash IS NOT NULL THEN greatest(p_cash + sum(ledger_cash) OVER (PARTITION BY adjusts_event_id ORDER BY occurred_at, event_id ROWS UNBOUNDED PRECEDING), 0) END AS restated FROM netted"""))
def _(s, d):
    return adjustments(s, d).select("event_id", "event_name", "occurred_at", "adjusts_event_id", "cash_value_minor", "ledger_cash_value_minor", "disposition", F.col("restated_order_value_minor").alias("restated"))


@query("job_7_subscription_status", sql("""SELECT p.subscription_id, p.first_paid_at, p.period_end AS current_period_end, x.deleted_at, CASE WHEN x.deleted_at IS NOT NULL THEN 'canceled' WHEN p.period_end > TIMESTAMP '2000-01-01' THEN 'active' ELSE 'lapsed' END AS status_as_of
    FROM (SELECT subscription_id, min(paid_at) AS first_paid_at, max(coalesce(e, period_end)) AS period_end FROM invoice_full LEFT JOIN (SELECT invoice_id AS iid, max(line_period_end) AS e FROM invoice_line WHERE NOT is_proration GROUP BY 1) ON iid = invoice_id
      WHERE paid_at <= TIMESTAMP '2000-01-01' GROUP BY 1) p
    LEFT JOIN (SELECT subscription_id, min(changed_at) AS deleted_at FROM sub_change WHERE event_type = 'customer.subscription.deleted' AND changed_at <= TIMESTAMP '2000-01-01' GROUP BY 1) x USING (subscription_id)"""))
def _(s, d):
    out = M.subscription_status(D.invoice_full(s, d), D.invoice_line(s, d), D.sub_change(s, d), purchases(s, d), P)
    return out.select("subscription_id", "first_paid_at", "current_period_end", "deleted_at", "status_as_of")


@query("job_0_net_cash_ledger", sql("""SELECT p.event_id, p.user_id, p.occurred_at, p.currency, p.cash AS gross_minor, coalesce(t.taken, 0) AS taken_minor, greatest(p.cash - coalesce(t.taken, 0), 0) AS restated_minor,
    round(greatest(p.cash - coalesce(t.taken, 0), 0) / power(10, f.digits) * f.per_unit, 6) AS restated_reporting FROM pur p
    LEFT JOIN (SELECT adjusts_event_id, sum(-ledger_cash) AS taken FROM netted GROUP BY 1) t ON t.adjusts_event_id = p.event_id
    LEFT JOIN fx f ON f.currency = p.currency AND f.valid_from <= CAST(p.occurred_at AS DATE) AND (f.valid_to IS NULL OR CAST(p.occurred_at AS DATE) < f.valid_to) WHERE p.event_name IS NOT NULL"""))
def _(s, d):
    n = M.net_cash(purchases(s, d).where("event_name is not null"), adjustments(s, d), fx(s))
    return n.select("event_id", "user_id", "occurred_at", "currency", F.col("cash_value_minor").alias("gross_minor"), "taken_minor", "restated_minor", "restated_reporting")

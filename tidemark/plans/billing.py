"""Billing deliveries to typed billing tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions.segments import url_param
from tidemark.operators.rows import keep_first
from tidemark.operators.running import Agg, running_by_number
from tidemark.params import Params
from tidemark.sinks.tables import stage
from tidemark.sources.schemas import BILLING_OBJECT, BILLING_PREVIOUS

# Event types the staging jobs read (fixed values); others are only flagged.
HANDLED_TYPES = (
    "checkout.session.completed", "invoice.paid", "invoice_payment.paid",
    "customer.subscription.created", "customer.subscription.updated", "customer.subscription.deleted",
    "charge.refunded", "charge.dispute.created", "charge.dispute.updated", "charge.dispute.closed",
    "charge.dispute.funds_withdrawn", "charge.dispute.funds_reinstated",
)
SUBSCRIPTION_TYPES = HANDLED_TYPES[3:6]
DISPUTE_TYPES = HANDLED_TYPES[7:]


def billing_events(deliveries: DataFrame, p: Params) -> DataFrame:
    """First known delivery per event; the payload is cut to the listed fields while parsing."""
    known = deliveries if p.as_of is None else deliveries.where(F.col("received_at") <= F.lit(p.as_of))
    if p.livemode_only:
        known = known.where("livemode")
    first = keep_first(known, ["id"], [F.col("received_at")])
    parsed = first.withColumn(
        "d", F.from_json("data", f"object struct<{_nested(BILLING_OBJECT)}>, previous_attributes struct<{_nested(BILLING_PREVIOUS)}>")
    )
    return parsed.select(
        F.col("id").alias("stripe_event_id"), F.col("type").alias("event_type"), F.col("created").alias("created_unix"),
        C.from_unix_seconds("created").alias("created_at"), "api_version", "livemode",
        F.col("d.object").alias("obj"), F.col("d.previous_attributes").alias("prev"),
        F.col("d.object.id").alias("object_id"), F.col("d.object.object").alias("object_type"),
        F.col("type").isin(*HANDLED_TYPES).alias("is_handled_type"), "received_at",
    )


def _nested(ddl: str) -> str:
    """Top-level DDL fields ``a type`` as struct fields ``a: type``."""
    out, depth, start = [], 0, True
    for word in ddl.replace("\n", " ").split(" "):
        if not word:
            continue
        if depth == 0 and start and ":" not in word:
            word, start = word + ":", False
        depth += word.count("<") - word.count(">")
        start = start or (depth == 0 and word.endswith(","))
        out.append(word)
    return " ".join(out)


def _objects(events: DataFrame, types: Sequence[str]) -> DataFrame:
    """One row per business object: a second event for it changes nothing."""
    return keep_first(events.where(F.col("event_type").isin(*types)), ["object_id"], [F.col("created_at"), F.col("stripe_event_id")])


def _unix(path: str):
    return C.from_unix_seconds(F.col(path))


def invoices(events: DataFrame) -> DataFrame:
    return _objects(events, ["invoice.paid"]).select(
        F.col("object_id").alias("invoice_id"), F.col("stripe_event_id").alias("paid_event_id"), F.col("created_at").alias("paid_event_created_at"),
        F.col("obj.customer").alias("user_id"), F.col("obj.status").alias("invoice_status"), "obj.billing_reason",
        F.upper("obj.currency").alias("currency"), F.col("obj.amount_paid").alias("amount_paid_minor"), F.col("obj.total").alias("total_minor"),
        F.col("obj.subtotal").alias("subtotal_minor"), F.col("obj.total_excluding_tax").alias("total_excluding_tax_minor"),
        _unix("obj.created").alias("invoice_created_at"),
        F.coalesce(_unix("obj.status_transitions.paid_at"), _unix("obj.created")).alias("paid_at"),
        _unix("obj.period_start").alias("period_start"), _unix("obj.period_end").alias("period_end"),
        F.coalesce("obj.parent.subscription_details.subscription", "obj.subscription").alias("subscription_id"),
        F.col("obj.charge").alias("legacy_charge_id"), F.col("obj.payment_intent").alias("legacy_payment_intent_id"),
        F.coalesce("obj.lines.has_more", F.lit(False)).alias("lines_has_more"), F.col("obj.lines.data").alias("lines"),
    )


def invoice_lines(inv: DataFrame) -> DataFrame:
    x = inv.select("invoice_id", "user_id", F.posexplode("lines").alias("line_position", "l"))
    return x.select(
        "invoice_id", "user_id", F.col("l.id").alias("line_id"), "line_position", F.col("l.amount").alias("amount_minor"),
        F.upper("l.currency").alias("currency"), F.coalesce("l.pricing.price_details.price", "l.price.id").alias("price_id"),
        F.coalesce("l.pricing.price_details.product", "l.price.product").alias("product_id"), F.col("l.quantity").alias("quantity"),
        F.coalesce("l.parent.subscription_item_details.proration", "l.proration", F.lit(False)).alias("is_proration"),
        F.coalesce("l.parent.subscription_item_details.subscription_item", "l.subscription_item").alias("subscription_item_id"),
        _unix("l.period.start").alias("line_period_start"), _unix("l.period.end").alias("line_period_end"),
        F.col("l.description").alias("line_description"),
    )


def invoice_payments(events: DataFrame) -> DataFrame:
    return _objects(events, ["invoice_payment.paid"]).select(
        F.col("object_id").alias("invoice_payment_id"), "stripe_event_id", F.col("obj.invoice").alias("invoice_id"),
        F.col("obj.payment.type").alias("payment_type"), F.col("obj.payment.payment_intent").alias("payment_intent_id"),
        F.col("obj.payment.charge").alias("charge_id"), F.col("obj.amount_paid").alias("amount_paid_minor"),
        F.upper("obj.currency").alias("currency"), F.col("obj.status").alias("payment_status"),
        _unix("obj.created").alias("payment_created_at"), F.col("created_at").alias("event_created_at"),
    )


def checkout_sessions(events: DataFrame) -> DataFrame:
    s = _objects(events, ["checkout.session.completed"]).withColumn("success_url", F.col("obj.success_url"))
    return s.select(
        F.col("object_id").alias("checkout_session_id"), F.col("stripe_event_id").alias("completed_event_id"), F.col("created_at").alias("completed_at"),
        _unix("obj.created").alias("session_created_at"), F.col("obj.mode").alias("checkout_mode"), F.col("obj.status").alias("session_status"),
        "obj.payment_status", F.col("obj.customer").alias("user_id"), F.col("obj.subscription").alias("subscription_id"),
        F.col("obj.invoice").alias("invoice_id"), F.col("obj.payment_intent").alias("payment_intent_id"),
        F.col("obj.amount_total").alias("amount_total_minor"), F.col("obj.amount_subtotal").alias("amount_subtotal_minor"),
        F.col("obj.total_details.amount_tax").alias("amount_tax_minor"), F.upper("obj.currency").alias("currency"), "obj.client_reference_id",
        url_param("success_url", "tier", "[0-9]+").try_cast("int").alias("success_url_tier_code"),
        url_param("success_url", "interval", "[a-z]+").alias("success_url_interval"),
        "obj.metadata.ga_client_id", "obj.metadata.ga_session_id", "obj.metadata.tolt_referral",
    )


def subscription_events(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type").isin(*SUBSCRIPTION_TYPES)).select(
        "stripe_event_id", "event_type", F.col("created_at").alias("changed_at"), F.col("object_id").alias("subscription_id"),
        F.col("obj.customer").alias("user_id"), F.col("obj.status").alias("subscription_status"),
        F.coalesce("obj.cancel_at_period_end", F.lit(False)).alias("cancel_at_period_end"), _unix("obj.cancel_at").alias("cancel_at"),
        _unix("obj.canceled_at").alias("canceled_at"), _unix("obj.ended_at").alias("ended_at"),
        F.col("obj.latest_invoice").alias("latest_invoice_id"), F.col("obj.items.data").alias("items"), F.col("prev").alias("previous_attributes"),
    )


def subscription_items(changes: DataFrame) -> DataFrame:
    x = changes.select("stripe_event_id", "changed_at", "subscription_id", "user_id", F.explode("items").alias("i"))
    return x.select(
        "stripe_event_id", "changed_at", "subscription_id", "user_id", F.col("i.id").alias("subscription_item_id"),
        F.col("i.price.id").alias("price_id"), F.col("i.quantity").alias("quantity"),
    )


def cumulative_steps(df: DataFrame, keys: Sequence[str], cumulative: str, step: str) -> DataFrame:
    """Cumulative amounts to steps: each minus the largest smaller amount of the key."""
    # counted and then ordered: computed once
    out = running_by_number(stage(df), keys, cumulative, [Agg("_prev", "max", F.col(cumulative))], block_width=None)
    return out.withColumn(step, F.col(cumulative) - F.coalesce("_prev", F.lit(0))).drop("_prev")


def refunds(events: DataFrame) -> DataFrame:
    r = events.where("event_type = 'charge.refunded'").select(
        "stripe_event_id", F.col("created_at").alias("refunded_at"), F.col("obj.id").alias("charge_id"), F.col("obj.customer").alias("user_id"),
        F.col("obj.payment_intent").alias("payment_intent_id"), F.col("obj.invoice").alias("legacy_invoice_id"),
        F.col("obj.amount").alias("charge_amount_minor"), F.col("obj.amount_refunded").alias("amount_refunded_cumulative_minor"),
        F.col("prev.amount_refunded").alias("previous_amount_refunded_minor"), F.upper("obj.currency").alias("currency"),
    )
    return refund_steps(r)


def refund_steps(r: DataFrame) -> DataFrame:
    """One row per refund step of a charge from (redelivered) cumulative refund events."""
    once = keep_first(
        r.where("amount_refunded_cumulative_minor > 0"), ["charge_id", "amount_refunded_cumulative_minor"],
        [F.col("refunded_at"), F.col("stripe_event_id")],
    )
    return cumulative_steps(once, ["charge_id"], "amount_refunded_cumulative_minor", "refund_step_minor")


def disputes(events: DataFrame) -> DataFrame:
    """Dispute lifecycle in one aggregation: opening row, latest status, close and reinstatement."""
    e = events.where(F.col("event_type").isin(*DISPUTE_TYPES)).select(
        F.col("object_id").alias("dispute_id"), "stripe_event_id", "event_type", "created_at",
        F.col("obj.created").alias("created"), F.col("obj.charge").alias("charge"), F.col("obj.payment_intent").alias("payment_intent"),
        F.col("obj.amount").alias("amount"), F.col("obj.currency").alias("currency"), F.col("obj.reason").alias("reason"), F.col("obj.status").alias("status"),
    )
    return dispute_lifecycle(e)


def dispute_lifecycle(e: DataFrame) -> DataFrame:
    opening = F.struct(
        F.when(F.col("event_type") == "charge.dispute.created", 0).otherwise(1).alias("p"), "created_at", "stripe_event_id",
        "created", "charge", "payment_intent", "amount", "currency", "reason", "status",
    )
    life = e.groupBy("dispute_id").agg(
        F.min(opening).alias("o"), F.max(F.struct("created_at", "stripe_event_id", "status"))["status"].alias("latest"),
        F.min(F.when(F.col("event_type") == "charge.dispute.closed", F.col("created_at"))).alias("closed_at"),
        F.bool_or(F.col("event_type") == "charge.dispute.funds_reinstated").alias("back"),
    )
    status = F.coalesce("latest", "o.status")
    inquiry = F.coalesce(F.col("latest").startswith("warning"), F.lit(False))
    won = (F.coalesce("latest", F.lit("")) == "won") | F.col("back")
    return life.select(
        "dispute_id", "o.stripe_event_id", C.from_unix_seconds("o.created").alias("disputed_at"), F.col("o.charge").alias("charge_id"),
        F.col("o.payment_intent").alias("payment_intent_id"), F.col("o.amount").alias("amount_minor"), F.upper("o.currency").alias("currency"),
        F.col("o.reason").alias("dispute_reason"), status.alias("dispute_status"), "closed_at", inquiry.alias("is_inquiry"),
        won.alias("is_funds_reinstated"), (~(inquiry | won)).alias("is_money_lost"),
    )

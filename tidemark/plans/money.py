"""Exchange rates, canonical purchases, adjustments, subscription status and net cash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators.rows import anti, bounded, keep_first, key_map, known_equal, link_wide, lookup, overlaps, to_ranges, valid_on
from tidemark.operators.running import Agg, Facts, latest_of, lookup_many, running
from tidemark.params import Params
from tidemark.sinks.tables import stage

OPEN_END = "9999-12-31"
RECURRING = ("subscription_cycle", "subscription", "subscription_threshold")
BUSINESS_TIERS = ("team", "business")


def fx_ranges(rates: DataFrame, units: DataFrame, reporting: str) -> DataFrame:
    """Validity ranges of each currency in the reporting currency, with its minor-unit digits."""
    dated = rates.select(F.upper("currency").alias("currency"), F.col("rate_date").alias("valid_from"), F.col("usd_per_unit").cast("double").alias("usd"))
    ranges = to_ranges(dated, ["currency"], "valid_from", "valid_to").withColumn("end", F.coalesce("valid_to", F.lit(OPEN_END).cast("date")))
    base = ranges.where(F.col("currency") == reporting).select(F.col("valid_from").alias("bf"), F.col("end").alias("be"), F.col("usd").alias("bu"))
    cut = overlaps(ranges, base, ("valid_from", "end"), ("bf", "be"))
    digits = units.select(F.upper("currency").alias("currency"), "minor_unit_digits")
    out = cut.join(digits, "currency", "left").select(
        "currency", F.lit(reporting).alias("reporting_currency"), F.greatest("valid_from", "bf").alias("valid_from"),
        F.nullif(F.least("end", "be"), F.lit(OPEN_END).cast("date")).alias("valid_to"), (F.col("usd") / F.col("bu")).alias("reporting_per_unit"),
        F.coalesce("minor_unit_digits", F.lit(2)).cast("int").alias("minor_unit_digits"), F.col("minor_unit_digits").isNotNull().alias("minor_unit_digits_known"),
    )
    # the hint travels with the table: every later lookup joins it without a shuffle
    return bounded(out)


def value_at(df: DataFrame, fx: DataFrame, ts: str) -> DataFrame:
    """Attach the rate valid on the row's date; no rate leaves NULL (never 1.0).

    ``fx_ranges`` marks the rate list for broadcast once its row count is checked.
    """
    r = fx.select(F.col("currency").alias("_cur"), "valid_from", "valid_to", "reporting_per_unit", "minor_unit_digits")
    on = (F.col("currency") == F.col("_cur")) & valid_on(F.to_date(F.col(ts)), F.col("valid_from"), F.col("valid_to"))
    return df.join(r, on, "left").drop("_cur", "valid_from", "valid_to")


def to_reporting(minor: str):
    return F.round(F.col(minor) / F.pow(F.lit(10.0), F.col("minor_unit_digits")) * F.col("reporting_per_unit"), 6)


def mark_first(df: DataFrame, key: str, order: Sequence[str], name: str) -> DataFrame:
    """First-ever flag: the smallest order per key (pre-aggregated), joined back."""
    return mark_firsts(df, key, {name: (F.lit(True), order)})


def mark_firsts(df: DataFrame, key: str, flags: dict[str, tuple[Column, Sequence[str]]]) -> DataFrame:
    """Several first-ever flags (which rows compete, by what order) with one aggregation and one join; rows without a key are first in nothing."""
    low = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_low")).agg(*[F.min(F.when(rows, F.struct(*order))).alias(f"_f{i}") for i, (rows, order) in enumerate(flags.values())])
    x = df.join(low, known_equal(df, key, "_low"), "left")
    x = x.withColumns({name: rows & F.col(f"_f{i}").eqNullSafe(F.struct(*order)) for i, (name, (rows, order)) in enumerate(flags.items())})
    return x.drop("_low", *[f"_f{i}" for i in range(len(flags))])


def line_evidence(lines: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per invoice: new and old plan line, pack quantity and unknown prices, in one aggregation."""
    cat = catalog.select("price_id", "item_type", F.col("plan_tier").alias("t"), F.col("billing_interval").alias("bi"), F.col("plan_tier_code").alias("tc"))
    x = lookup(lines, cat, ["price_id"])
    plan = F.col("item_type") == "plan"
    up = F.struct((-F.col("amount_minor")).alias("a"), F.col("line_id").alias("l"), "t", "bi", "tc")
    down = F.struct(F.col("amount_minor").alias("a"), F.col("line_id").alias("l"), "t")
    pack = (F.col("item_type") == "credit_pack") & (F.col("amount_minor") > 0)
    return x.groupBy("invoice_id").agg(
        F.min(F.when(plan & (F.col("amount_minor") > 0), up)).alias("new_plan"), F.min(F.when(plan & (F.col("amount_minor") < 0), down)).alias("old_plan"),
        F.sum(F.when(pack, F.col("quantity"))).alias("pack_line_quantity"), F.bool_or(pack).alias("has_pack_line"),
        F.bool_or(F.col("item_type").isNull()).alias("has_unknown_price_lines"),
    )


def subscription_states(changes: DataFrame, items: DataFrame, catalog: DataFrame) -> DataFrame:
    """Plan and pack quantity after each subscription change."""
    cat = catalog.select("price_id", "item_type", "plan_tier", "billing_interval", "plan_tier_code")
    x = lookup(items.select("stripe_event_id", "price_id", "quantity"), cat, ["price_id"])
    plan = F.col("item_type") == "plan"
    agg = x.groupBy("stripe_event_id").agg(
        F.sum(F.when(F.col("item_type") == "credit_pack", F.col("quantity"))).alias("q"),
        *[F.max(F.when(plan, F.col(c))).alias(c) for c in ("plan_tier", "billing_interval", "plan_tier_code")],
    )
    return changes.select("stripe_event_id", "subscription_id", "changed_at").join(agg, "stripe_event_id", "left").withColumn(
        "pack_quantity", F.coalesce("q", F.lit(0))).drop("q")


def classify_purchase(reason: str, has_old_plan, has_pack):
    """(event name, rule) from the billing reason and the line evidence."""
    r = F.col(reason)
    update = r == "subscription_update"
    rules = [
        (r == "subscription_create", "purchase_first", "billing_reason_subscription_create"),
        (r.isin(*RECURRING), "purchase_renewal", "billing_reason_recurring"),
        (update & has_old_plan, "purchase_upgrade", "plan_change_lines"),
        (update & has_pack, "purchase_add_on", "credit_pack_line"),
        (update, "purchase_upgrade", "subscription_update_other"),
    ]
    name, rule = F.lit(None).cast("string"), F.lit("unclassified_billing_reason")
    for test, n, why in reversed(rules):
        name, rule = F.when(test, n).otherwise(name), F.when(test, why).otherwise(rule)
    return name, rule


#: Columns of a subscription's state that fill a purchase without a plan of its own.
STATE = ("pack_quantity", "plan_tier", "billing_interval", "plan_tier_code")


def pack_events(packs: DataFrame) -> DataFrame:
    return packs.withColumn("event_id", F.concat(F.lit("purchase_"), F.coalesce("invoice_id", "checkout_session_id")))


def first_purchases(paid: DataFrame, packs: DataFrame) -> DataFrame:
    """Per user: the first invoice (``_ft``, ``_fi``: its instant and id) and the first purchase of any kind, by time and id.

    A pack is a first purchase when nothing of the user precedes it; invoices compare among invoices, by their own ids. Rows
    without a user are first in nothing.
    """
    invoiced = paid.select("user_id", F.struct(F.col("paid_at").alias("_ft"), F.col("invoice_id").alias("_fi")).alias("i"), F.struct(F.col("paid_at").alias("at"), F.concat(F.lit("purchase_"), "invoice_id").alias("id")).alias("a"))
    packed = pack_events(packs).select("user_id", F.struct(F.col("completed_at").alias("at"), F.col("event_id").alias("id")).alias("a"))
    rows = invoiced.unionByName(packed, allowMissingColumns=True).where("user_id is not null")
    return rows.groupBy("user_id").agg(F.min("i").alias("first_invoice"), F.min("a").alias("first_any"))


def purchases(inv: DataFrame, lines: DataFrame, sessions: DataFrame, payments: DataFrame, states: DataFrame, catalog: DataFrame, fx: DataFrame) -> DataFrame:
    """Canonical purchases: five kinds, plan by three fallbacks, tax-free revenue, reporting value, first flag."""
    done = sessions.where("session_status = 'complete' and payment_status = 'paid'")
    packs = done.where("checkout_mode = 'payment' and amount_total_minor > 0")
    paid = anti(
        inv.where("invoice_status = 'paid' and amount_paid_minor > 0"), packs.where("invoice_id is not null"), ["invoice_id"]
    )
    first = stage(first_purchases(paid, packs))
    # all that is known of an invoice by its id, in the partitions of the evidence
    x = paid.join(line_evidence(lines, catalog), "invoice_id", "left")
    # at most one row an invoice and user: only the users' firsts go over the network, not all purchases
    won = first.where("first_invoice is not null").select(F.col("user_id").alias("_fu"), "first_invoice.*")
    x = x.join(won, (F.col("invoice_id") == F.col("_fi")) & (F.col("user_id") == F.col("_fu")) & F.col("paid_at").eqNullSafe(F.col("_ft")), "left")
    name, rule = classify_purchase("billing_reason", F.col("old_plan").isNotNull(), F.coalesce("has_pack_line", F.lit(False)))
    x = x.withColumn("event_name", name).withColumn("classification_rule", rule)
    pay = keep_first(payments, ["invoice_id"], [F.col("payment_created_at"), F.col("invoice_payment_id")]).select("invoice_id", "payment_intent_id", "charge_id")
    x = x.join(pay, "invoice_id", "left")
    sub = done.where("checkout_mode = 'subscription' and invoice_id is not null").select(F.col("invoice_id").alias("_k"), "checkout_session_id", "ga_client_id", "ga_session_id", "tolt_referral")
    # only a first purchase has a checkout; the rule is part of the condition, so the others stay where they are
    x = x.join(sub, (F.col("invoice_id") == F.col("_k")) & (F.col("event_name") == "purchase_first"), "left").drop("_k")
    x = x.select(
        "invoice_id", "paid_event_id", "user_id", "subscription_id", "paid_at", "billing_reason", "amount_paid_minor", "total_minor", "total_excluding_tax_minor", "currency", "event_name", "classification_rule",
        F.col("new_plan.t").alias("np_t"), F.col("new_plan.tc").alias("np_tc"), F.col("new_plan.bi").alias("np_bi"), F.col("new_plan").isNotNull().alias("has_new_plan"), F.col("old_plan.t").alias("op_t"),
        "pack_line_quantity", "has_unknown_price_lines", F.coalesce("payment_intent_id", "legacy_payment_intent_id").alias("payment_intent_id"), F.coalesce("charge_id", "legacy_charge_id").alias("charge_id"),
        "checkout_session_id", "ga_client_id", "ga_session_id", "tolt_referral", F.col("_fu").isNotNull().alias("is_first_purchase"))
    # counted and then ordered: computed once
    x = stage(x)
    plan = F.struct(F.col("np_t").alias("t"), F.col("np_tc").alias("tc"), F.col("np_bi").alias("bi"))
    previous = Agg("_prev", "max", F.struct(F.unix_micros("paid_at").alias("t"), F.col("invoice_id").alias("i"), plan.alias("p")))
    # an invoice without a subscription has no history: a key of its own, so that they do not all meet in one
    x = x.withColumn("_sub", F.coalesce("subscription_id", F.concat(F.lit("none:"), "invoice_id")))
    state = states.where("subscription_id is not null").select(F.col("subscription_id").alias("_sub"), "changed_at", "stripe_event_id", *STATE)
    invoiced = x.where("has_new_plan and subscription_id is not null").select("_sub", "paid_at", "invoice_id", "np_t", "np_tc", "np_bi")
    # a purchase that names all of its plan, and is no add-on or upgrade, needs nothing of the history: it stays where it is
    add_on = F.col("event_name").isin("purchase_add_on", "purchase_upgrade")
    open_ = F.coalesce(add_on, F.lit(False)) | F.col("np_t").isNull() | F.col("np_tc").isNull() | F.col("np_bi").isNull()
    settled = x.where(~open_).drop("_sub")
    # the last plan invoiced before and the newest state so far, in one ordered frame of the subscription's history
    x = lookup_many(x.where(open_), [
        Facts(invoiced, "paid_at", [previous], inclusive=False), Facts(state, "changed_at", [latest_of([F.col("changed_at"), F.col("stripe_event_id")], STATE, "_state")]),
    ], ["_sub"], "paid_at", None).drop("_sub")
    x = x.withColumn("pp", F.when(F.col("subscription_id").isNotNull(), F.col("_prev.p")))
    x = x.withColumns({f"st_{c}": F.col(f"_state.p{i}") for i, c in enumerate(STATE)}).drop("_prev", "_state").unionByName(settled, allowMissingColumns=True)
    taxed = (F.col("total_minor") > 0) & F.col("total_excluding_tax_minor").isNotNull()
    net = F.round(F.col("amount_paid_minor") * F.col("total_excluding_tax_minor").cast("double") / F.col("total_minor"), 0).cast("bigint")
    invoiced = x.select(
        F.concat(F.lit("purchase_"), "invoice_id").alias("event_id"), F.concat(F.lit("sub_"), "invoice_id").alias("order_id"), "event_name",
        F.col("paid_at").alias("occurred_at"), F.col("paid_event_id").alias("source_event_id"), "user_id", "invoice_id", "subscription_id", "checkout_session_id",
        "payment_intent_id", "charge_id",
        F.col("amount_paid_minor").alias("cash_value_minor"), F.when(taxed, net).otherwise(F.col("amount_paid_minor")).alias("revenue_minor"), "currency",
        F.coalesce("np_t", "st_plan_tier", "pp.t").alias("plan_tier"), F.coalesce("np_tc", "st_plan_tier_code", "pp.tc").alias("plan_tier_code"),
        F.coalesce("np_bi", "st_billing_interval", "pp.bi").alias("billing_interval"),
        F.when(F.col("event_name") == "purchase_upgrade", F.col("op_t")).alias("previous_plan_tier"),
        F.when(add_on, F.coalesce(F.nullif("st_pack_quantity", F.lit(0)), "pack_line_quantity")).otherwise(F.col("pack_line_quantity")).alias("credit_pack_quantity"),
        F.coalesce(F.coalesce("np_t", "st_plan_tier", "pp.t").isin(*BUSINESS_TIERS), F.lit(False)).alias("is_business"),
        "billing_reason", "classification_rule", F.coalesce("has_unknown_price_lines", F.lit(False)).alias("has_unknown_price_lines"),
        "ga_client_id", "ga_session_id", "tolt_referral", "is_first_purchase",
    )
    ref = F.coalesce("invoice_id", "checkout_session_id")
    any_first = first.select(F.col("user_id").alias("_fu"), "first_any")
    packed = pack_events(packs).join(any_first, known_equal(packs, "user_id", "_fu"), "left").select(
        "event_id", F.concat(F.lit("sub_"), ref).alias("order_id"), F.lit("purchase_one_time_pack").alias("event_name"),
        F.col("completed_at").alias("occurred_at"), F.col("completed_event_id").alias("source_event_id"), "user_id", "invoice_id", "checkout_session_id", "payment_intent_id",
        F.col("amount_total_minor").alias("cash_value_minor"), (F.col("amount_total_minor") - F.coalesce("amount_tax_minor", F.lit(0))).alias("revenue_minor"),
        "currency", F.lit(False).alias("is_business"), F.lit("payment_mode_checkout").alias("classification_rule"), F.lit(False).alias("has_unknown_price_lines"),
        "ga_client_id", "ga_session_id", "tolt_referral", (F.col("first_any").isNotNull() & F.col("first_any.at").eqNullSafe(F.col("completed_at")) & F.col("first_any.id").eqNullSafe(F.col("event_id"))).alias("is_first_purchase"),
    )
    every = invoiced.unionByName(packed, allowMissingColumns=True)
    out = value_at(every, fx, "occurred_at")
    return out.withColumn("cash_value_reporting", to_reporting("cash_value_minor")).withColumn("revenue_reporting", to_reporting("revenue_minor")).withColumn(
        "fx_rate_to_reporting", F.col("reporting_per_unit")).drop("reporting_per_unit", "minor_unit_digits")


def adjustments(refunds: DataFrame, disputes: DataFrame, payments: DataFrame, purch: DataFrame, fx: DataFrame) -> DataFrame:
    """Refunds and disputes linked to purchases; disputes are netted to what is left of the purchase."""
    p = purch.where("event_name is not null")
    via = payments.join(p.select("invoice_id", "event_id"), "invoice_id")
    by_intent = key_map([via, p], "payment_intent_id", "event_id").withColumnRenamed("event_id", "adjusts_event_id")
    by_charge = key_map([via, p], "charge_id", "event_id").withColumnRenamed("event_id", "adjusts_event_id")
    by_invoice = p.where("invoice_id is not null").select(F.col("invoice_id").alias("legacy_invoice_id"), F.col("event_id").alias("adjusts_event_id"))
    # event ids are made of other columns: not carried along
    r = refunds.select(
        F.lit("refund").alias("event_name"), F.col("refunded_at").alias("occurred_at"), F.col("stripe_event_id").alias("source_event_id"), F.col("user_id").alias("charge_user_id"), "charge_id",
        "payment_intent_id", "legacy_invoice_id", "amount_refunded_cumulative_minor", (-F.col("refund_step_minor")).alias("cash_value_minor"), "currency", F.lit(True).alias("is_money_lost"),
    )
    c = disputes.select(
        "dispute_id", F.lit("chargeback").alias("event_name"), F.col("disputed_at").alias("occurred_at"), F.col("stripe_event_id").alias("source_event_id"), "charge_id", "payment_intent_id",
        (-F.col("amount_minor")).alias("cash_value_minor"), "currency", "dispute_reason", "dispute_status", "is_money_lost",
    )
    event_id = F.when(F.col("event_name") == "refund", F.concat_ws("_", F.lit("refund"), "charge_id", F.col("amount_refunded_cumulative_minor").cast("string"))).otherwise(F.concat(F.lit("chargeback_"), "dispute_id"))
    maps = [("payment_intent", "payment_intent_id", by_intent), ("charge", "charge_id", by_charge), ("legacy_invoice", "legacy_invoice_id", by_invoice)]
    linked = link_wide(r.unionByName(c, allowMissingColumns=True), maps, "adjusts_event_id")
    base = p.select(
        F.col("event_id").alias("adjusts_event_id"), F.col("user_id").alias("p_user"), F.col("order_id").alias("adjusts_order_id"), "invoice_id", "subscription_id",
        "plan_tier", "plan_tier_code", "billing_interval", F.col("cash_value_minor").alias("adjusted_purchase_cash_minor"), F.col("revenue_minor").alias("p_revenue"),
    )
    # what the lookups needed alone is left out
    x = stage(linked.drop("payment_intent_id", "legacy_invoice_id"))
    x = net_disputes(x.withColumn("event_id", event_id).drop("dispute_id", "amount_refunded_cumulative_minor"), base)
    x = value_at(x, fx, "occurred_at")
    share = F.coalesce(F.col("p_revenue").cast("double") / F.nullif("adjusted_purchase_cash_minor", F.lit(0)), F.lit(1.0))
    major = F.col("ledger_cash_value_minor") / F.pow(F.lit(10.0), F.col("minor_unit_digits")) * F.col("reporting_per_unit")
    disposition = (
        F.when(F.col("event_name") == "refund", "refund").when(~F.col("is_money_lost"), "dispute_won_or_inquiry")
        .when(F.col("ledger_cash_value_minor") == 0, "dispute_after_full_refund").otherwise("chargeback")
    )
    return x.select(
        "event_id", "event_name", "occurred_at", "source_event_id", F.coalesce("charge_user_id", "p_user").alias("user_id"), "charge_id", "cash_value_minor",
        "ledger_cash_value_minor", (F.col("ledger_cash_value_minor") < 0).alias("is_ledger_event"), disposition.alias("disposition"), "currency",
        F.round(major, 6).alias("cash_value_reporting"), F.round(major * share, 6).alias("revenue_reporting"), "adjusts_event_id", "link_path", "adjusts_order_id",
        "invoice_id", "subscription_id", "plan_tier", "plan_tier_code", "billing_interval", "adjusted_purchase_cash_minor", "restated_order_value_minor",
        "dispute_reason", "dispute_status",
    )


def net_disputes(x: DataFrame, purch: DataFrame | None = None) -> DataFrame:
    """Cut each lost dispute to what earlier money-out left of its purchase; restate the order value.

    Needs adjusts_event_id, adjusted_purchase_cash_minor, cash_value_minor (negative), is_money_lost, event_name. Columns of
    the purchases may come in ``purch`` (one row an adjusts_event_id): they are joined where the frame has put the rows.

    One ordered frame is enough: with T taken before, a dispute of a counts min(a, max(P - T, 0)) and a refund all of a. Until
    the sum of all that was taken reaches the price P nothing is cut, and from then on nothing is left, so the restated value
    is max(P - T - a, 0) whatever was cut. Money not known to be lost is not.
    """
    x = x.withColumn("is_money_lost", F.coalesce("is_money_lost", F.lit(False)))
    lost = F.when(F.col("is_money_lost"), -F.col("cash_value_minor")).otherwise(F.lit(0))
    loose = x.where("adjusts_event_id is null")
    tied = running(x.where("adjusts_event_id is not null"), ["adjusts_event_id"], "occurred_at", ["event_id"], [Agg("taken_before_minor", "sum", lost)], block_seconds=None)
    if purch is not None:
        tied = tied.join(purch, "adjusts_event_id", "left")
    left = F.greatest(F.coalesce(F.col("adjusted_purchase_cash_minor") - F.col("taken_before_minor"), F.lit(0)), F.lit(0))
    ledger = (
        F.when(~F.col("is_money_lost"), F.lit(0)).when(F.col("event_name") == "refund", F.col("cash_value_minor"))
        .otherwise(-F.least(-F.col("cash_value_minor"), left))
    )
    paid = F.col("adjusted_purchase_cash_minor")
    restated = F.when(paid.isNotNull(), F.greatest(paid - F.coalesce("taken_before_minor", F.lit(0)) - lost, F.lit(0)))
    tied = tied.withColumn("ledger_cash_value_minor", ledger).withColumn("restated_order_value_minor", restated)
    loose = loose.withColumn("taken_before_minor", F.lit(0).cast("bigint")).withColumn(
        "ledger_cash_value_minor", F.when(~F.col("is_money_lost"), F.lit(0)).otherwise(F.col("cash_value_minor"))
    )
    return tied.unionByName(loose, allowMissingColumns=True)


def net_cash(purch: DataFrame, adj: DataFrame, fx: DataFrame) -> DataFrame:
    """One row per purchase: gross, taken, restated and reporting-currency value."""
    taken = adj.where("adjusts_event_id is not null").groupBy(F.col("adjusts_event_id").alias("event_id")).agg(F.sum(-F.col("ledger_cash_value_minor")).alias("taken"))
    x = purch.join(taken, "event_id", "left").withColumn("taken_minor", F.coalesce("taken", F.lit(0))).drop("taken")
    x = x.withColumn("restated_minor", F.greatest(F.col("cash_value_minor") - F.col("taken_minor"), F.lit(0)))
    x = value_at(x, fx, "occurred_at")
    return x.withColumn("restated_reporting", to_reporting("restated_minor"))


def subscription_status(inv: DataFrame, lines: DataFrame, changes: DataFrame, purch: DataFrame, p: Params) -> DataFrame:
    """Status of each paid subscription at the as-of instant from the service periods it paid for."""
    at = F.lit(p.as_of)
    paid = inv.where((F.col("invoice_status") == "paid") & F.col("subscription_id").isNotNull() & (F.col("paid_at") <= at))
    ends = lines.where("not is_proration and line_period_end is not null").groupBy("invoice_id").agg(F.max("line_period_end").alias("line_end"))
    span = paid.join(ends, "invoice_id", "left").groupBy("subscription_id", "user_id").agg(
        F.min("paid_at").alias("first_paid_at"), F.max(F.coalesce("line_end", "period_end")).alias("current_period_end"))
    deleted = changes.where((F.col("event_type") == "customer.subscription.deleted") & (F.col("changed_at") <= at)).groupBy("subscription_id").agg(F.min("changed_at").alias("deleted_at"))
    plan = purch.where("subscription_id is not null and plan_tier is not null").groupBy("subscription_id").agg(
        F.max(F.struct("occurred_at", "event_id", "plan_tier", "billing_interval")).alias("m")).select("subscription_id", "m.plan_tier", "m.billing_interval")
    status = F.when(F.col("deleted_at").isNotNull(), "canceled").when(F.col("current_period_end") > at, "active").otherwise("lapsed")
    return span.join(deleted, "subscription_id", "left").join(plan, "subscription_id", "left").withColumn("status_as_of", status)

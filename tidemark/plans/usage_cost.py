"""Usage ledger staging and cost of each generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions.segments import CAPABILITY_PATTERN, parse_business_type
from tidemark.operators.rows import keep_first, keep_first_counted, lookup
from tidemark.params import Params

# Vendor by price-source pattern, first match wins (fixed values).
VENDOR_PATTERNS = (
    ("ESTIMATE%", "self_hosted"), ("%fal.ai%", "fal"), ("%byteplus%", "byteplus"), ("%ai.google.dev%", "google"),
    ("%cloud.google.com%", "google"), ("%alibabacloud%", "alibaba"), ("%openai%", "openai"), ("%ltx.io%", "lightricks"),
)


def usage_entries(ledger: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """(typed entries, quarantined rows without a user)."""
    at = C.from_iso("createdAt")
    kept = ledger.where("userId is not null")
    if p.as_of is not None:
        kept = kept.where(at <= F.lit(p.as_of))
    once = keep_first(kept, ["id"], [F.col("createdAt")])
    typed = once.select(
        F.col("id").alias("ledger_entry_id"), F.col("userId").alias("user_id"), F.col("type").alias("entry_type"), "amount",
        F.col("creditField").alias("credit_field"), F.col("balanceBefore").alias("balance_before"), F.col("balanceAfter").alias("balance_after"),
        F.col("reference.businessType").alias("business_type"), F.col("reference.businessId").alias("business_id"), at.alias("created_at"),
        F.col("businessDetails").alias("business_details"),
    )
    is_generation = (F.col("entry_type") == "CONSUME") & F.coalesce(F.col("business_type").rlike(CAPABILITY_PATTERN), F.lit(False))
    return parse_business_type(typed.withColumn("is_generation", is_generation)), ledger.where("userId is null")


def usage_details(entries: DataFrame) -> DataFrame:
    x = entries.where("is_generation").select("*", F.posexplode("business_details").alias("detail_position", "x")).drop("business_details")
    return x.select(
        "*", F.col("x.quantity").alias("quantity"), F.col("x.unitCredits").alias("unit_credits"), F.col("x.subBusinessType").alias("sub_business_type"),
        F.col("x.metadata.source").alias("generation_source"), F.col("x.metadata.discountPct").alias("credit_discount_pct"),
        F.col("x.metadata.originalUnitCredits").alias("original_unit_credits"),
    ).drop("x")


def price_settings(costs: DataFrame, p: Params) -> DataFrame:
    """Vendor, discount and per-credit list price of each priced setting."""
    vendor = F.lit("unknown")
    for pattern, name in reversed(VENDOR_PATTERNS):
        vendor = F.when(F.col("source_url").like(pattern), name).otherwise(vendor)
    discount = F.lit(p.vendor_discount_pct)
    if p.vendor_discounts:
        table = F.create_map(*[F.lit(v) for kv in p.vendor_discounts.items() for v in kv])
        discount = F.coalesce(F.try_element_at(table, F.col("vendor")), discount)
    x = costs.where("list_cost_usd is not null and credits > 0").withColumn("vendor", vendor)
    return x.withColumn("list_cost_per_credit_usd", F.col("list_cost_usd") / F.col("credits")).withColumn("vendor_discount_pct", discount.cast("double"))


def wildcard_match(df: DataFrame, rules: DataFrame, dims: Sequence[str], rule_id: str) -> DataFrame:
    """Best rule per row where a NULL dimension matches anything; more named dimensions win, then the id.

    Rules are indexed by the set of dimensions they name: each set is one equality join of the rows' distinct dimension values with the
    best rule per value, so rules and rows never meet all with all, whatever the number of rules.
    """
    combos = df.select(*dims).distinct()
    named = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(i)) for i, c in enumerate(dims)]))
    sets = [tuple(r[0]) for r in rules.select(named.alias("s")).distinct().collect()]  # at most 2^dimensions
    found = combos
    candidates = []
    for number, places in enumerate(sorted(sets)):
        some = [dims[i] for i in places]
        best = rules.where(named == F.array(*[F.lit(i) for i in places]) if places else F.size(named) == 0).groupBy(*[F.col(c).alias(f"_{number}_{c}") for c in some]).agg(F.min(rule_id).alias(f"_rule{number}"))
        if some:
            on = F.lit(True)
            for c in some:
                on = on & (F.col(c) == F.col(f"_{number}_{c}"))
            found = found.join(best, on, "left").drop(*[f"_{number}_{c}" for c in some])
        else:
            found = found.withColumn(f"_rule{number}", F.lit(best.first()[0]))
        candidates.append(F.when(F.col(f"_rule{number}").isNotNull(), F.struct(F.lit(-len(places)).alias("n"), F.col(f"_rule{number}").alias("id"))))
    choice = F.array_min(F.array_compact(F.array(*candidates)))["id"] if candidates else F.lit(None).cast(dict(rules.dtypes)[rule_id])
    best = found.select(*[F.col(c).alias("_" + c) for c in dims], choice.alias(rule_id))
    match = F.lit(True)
    for c in dims:
        match = match & F.col(c).eqNullSafe(F.col("_" + c))
    return df.join(best, match, "left").drop(*["_" + c for c in dims])


def override_for(keys: DataFrame, overrides: DataFrame) -> DataFrame:
    """Best override per (capability, setting, day): a named setting first, then the newest, then the id.

    Works on the distinct keys, not on usage rows.
    """
    o = overrides.select(
        F.col("business_type").alias("cost_business_type"), F.col("setting").alias("o_setting"), "valid_from", "valid_to", "override_id", "route",
        F.col("vendor").alias("override_vendor"), "unit_cost_usd", "cost_per_credit_usd", "discount_pct",
    )
    hit = keys.join(o, "cost_business_type").where(
        (F.col("o_setting").isNull() | F.col("o_setting").eqNullSafe(F.col("em_setting")))
        & (F.col("valid_from").isNull() | (F.col("valid_from") <= F.col("day"))) & (F.col("valid_to").isNull() | (F.col("valid_to") >= F.col("day")))
    )
    order = [F.when(F.col("o_setting").isNotNull(), 0).otherwise(1), F.col("valid_from").desc_nulls_first(), F.col("override_id")]
    return keep_first(hit, ["cost_business_type", "em_setting", "day"], order)


def generation_cost(details: DataFrame, refunds: DataFrame, prices: DataFrame, overrides: DataFrame, p: Params) -> DataFrame:
    """Cost of each sub-generation: override, exact setting, original credits, cheapest, mean, default.

    Prices are resolved per capability and credit amount (the price table), then joined,
    so no usage row meets more than one price row.
    """
    g = details.withColumn(
        "cost_business_type", F.when(F.coalesce(F.col("sub_business_type").rlike(CAPABILITY_PATTERN), F.lit(False)), F.col("sub_business_type")).otherwise(F.col("business_type"))
    ).withColumn(
        "costed_unit_credits", F.when(F.col("unit_credits") > 0, F.col("unit_credits")).when(F.col("original_unit_credits") > 0, F.col("original_unit_credits"))
    ).withColumn("day", F.to_date("created_at"))
    failed = refunds.groupBy("user_id", "business_type", "business_id").agg(F.min("created_at").alias("refunded_at"))
    exact = keep_first_counted(prices, ["business_type", "credits"], [F.col("list_cost_usd").desc(), F.col("setting")], "matching_settings").select(
        F.col("business_type").alias("cost_business_type"), F.col("credits").alias("costed_unit_credits"), F.col("setting").alias("em_setting"),
        F.col("list_cost_usd").alias("em_cost"), F.col("vendor").alias("em_vendor"), F.col("vendor_discount_pct").alias("em_discount"), "matching_settings")
    cheapest = keep_first(prices, ["business_type"], [F.col("credits"), F.col("list_cost_usd"), F.col("setting")]).select(
        F.col("business_type").alias("cost_business_type"), F.col("setting").alias("cs_setting"), F.col("list_cost_usd").alias("cs_cost"),
        F.col("vendor").alias("cs_vendor"), F.col("vendor_discount_pct").alias("cs_discount"))
    mean = prices.groupBy(F.col("business_type").alias("cost_business_type")).agg(
        F.avg("list_cost_per_credit_usd").alias("mean_cpc"), F.max("vendor").alias("mean_vendor"), F.max("vendor_discount_pct").alias("mean_discount"))
    # a few capabilities hold most of the usage: prices are broadcast, or their hot keys spread
    x = lookup(g.join(failed, ["user_id", "business_type", "business_id"], "left"), exact, ["cost_business_type", "costed_unit_credits"])
    x = lookup(x, mean.join(cheapest, "cost_business_type", "left"), ["cost_business_type"])
    best = override_for(x.select("cost_business_type", "em_setting", "day").distinct(), overrides).select(
        F.col("cost_business_type").alias("_b"), F.col("em_setting").alias("_s"), F.col("day").alias("_d"), "override_id", "o_setting", "route",
        "override_vendor", "unit_cost_usd", "cost_per_credit_usd", "discount_pct")
    x = x.join(best, (F.col("_b") == F.col("cost_business_type")) & F.col("_s").eqNullSafe(F.col("em_setting")) & (F.col("_d") == F.col("day")), "left")
    free = F.col("unit_credits") == 0
    has = lambda c: F.col(c).isNotNull()
    basis = (
        F.when(has("override_id") & has("o_setting"), "override_setting").when(has("override_id"), "override_capability")
        .when(has("em_setting") & (F.col("unit_credits") > 0), "exact_setting").when(has("em_setting"), "unlimited_original_credits")
        .when(free & has("cs_setting"), "unlimited_cheapest_setting").when(has("mean_cpc"), "capability_mean_per_credit").otherwise("default_per_credit")
    )
    list_unit = (
        F.when(has("em_setting"), F.col("em_cost")).when(free & has("cs_setting"), F.col("cs_cost"))
        .when(has("mean_cpc"), F.col("mean_cpc") * F.col("costed_unit_credits")).otherwise(F.lit(p.default_cost_per_credit) * F.col("costed_unit_credits"))
    )
    discount = (
        F.when(has("unit_cost_usd") | has("cost_per_credit_usd"), 0.0).when(has("discount_pct"), F.col("discount_pct"))
        .otherwise(F.coalesce("em_discount", "cs_discount", "mean_discount", F.lit(p.vendor_discount_pct)))
    )
    x = x.withColumn("cost_basis", basis).withColumn("list_unit", list_unit).withColumn("discount_pct_applied", discount.cast("double"))
    x = x.withColumn("is_failed_generation", has("refunded_at")).withColumn("billable_share", F.when(has("refunded_at"), F.lit(p.failed_cost_share)).otherwise(1.0))
    raw: Column = (
        F.when(has("unit_cost_usd"), F.col("unit_cost_usd") * F.col("quantity"))
        .when(has("cost_per_credit_usd"), F.col("cost_per_credit_usd") * F.col("quantity") * F.coalesce("costed_unit_credits", F.lit(0)))
        .otherwise(F.coalesce("list_unit", F.lit(0.0)) * F.col("quantity") * (1 - F.col("discount_pct_applied")))
    )
    return x.select(
        F.concat_ws(":", "ledger_entry_id", F.col("detail_position").cast("string")).alias("generation_id"), "ledger_entry_id", "detail_position", "user_id", "created_at",
        "business_type", "cost_business_type", "model_id", "media_type", "credit_field", "quantity", "unit_credits",
        (F.col("quantity") * F.col("unit_credits")).alias("credits_charged"), (F.col("quantity") * F.coalesce("costed_unit_credits", F.lit(0))).alias("credits_costed"),
        F.coalesce("em_setting", F.when(free, F.col("cs_setting"))).alias("setting"), F.coalesce("matching_settings", F.lit(0)).alias("matching_settings"), "cost_basis",
        F.coalesce("override_vendor", "em_vendor", "cs_vendor", "mean_vendor", F.lit("unknown")).alias("vendor"), "route", "override_id",
        F.round("list_unit", 6).alias("list_unit_cost_usd"), F.round(F.coalesce("list_unit", F.lit(0.0)) * F.col("quantity"), 6).alias("list_cost_usd"),
        "discount_pct_applied", "is_failed_generation", "refunded_at", "billable_share", F.round(raw * F.col("billable_share"), 6).alias("cost_usd"),
    )

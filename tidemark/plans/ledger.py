"""Lifecycle events, the canonical event union and the conversion ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions.segments import event_id
from tidemark.operators.rows import anti, bounded, keep_first
from tidemark.operators.running import Agg, Facts, latest_of, lookup_many, running
from tidemark.plans.identity import arm_facts, click_facts, open_utms, utm_facts
from tidemark.params import Params

PLAN_TIERS = ("essential", "advanced", "infinite", "wonder", "team", "business")
MONEY_OUT = ("refund", "chargeback")


def signups(grants: DataFrame, accounts: DataFrame) -> DataFrame:
    """The first trial grant is the signup; an account without a grant signed up when it was created."""
    first = keep_first(grants, ["user_id"], [F.col("created_at"), F.col("ledger_entry_id")])
    a = first.select("user_id", F.col("created_at").alias("occurred_at"), F.lit("credit_ledger").alias("source_system"), F.col("ledger_entry_id").cast("string").alias("source_event_id"))
    rest = anti(accounts.where("account_created_at is not null"), grants, ["user_id"])
    b = rest.select("user_id", F.col("account_created_at").alias("occurred_at"), F.lit("app_backend").alias("source_system"), F.col("user_id").cast("string").alias("source_event_id"))
    return a.unionByName(b)


def activations(entries: DataFrame) -> DataFrame:
    first = keep_first(entries.where("is_generation"), ["user_id"], [F.col("created_at"), F.col("ledger_entry_id")])
    return first.select("user_id", F.col("created_at").alias("occurred_at"), F.col("ledger_entry_id").cast("string").alias("source_event_id"), "model_id", F.col("credits"))


def checkouts(events: DataFrame) -> DataFrame:
    tier = F.lower("tier")
    return events.where("event_type = 'subscription_started'").select(
        "event_uuid", F.col("event_time").alias("occurred_at"), "user_id", F.when(tier.isin(*PLAN_TIERS), tier).alias("plan_tier"),
        F.when(F.col("interval").isin("month", "year"), F.col("interval")).alias("billing_interval"))


def stage_changes(changes: DataFrame, tie: str) -> DataFrame:
    """Previous stage of the contact and whether the stage is reached for the first time."""
    prev = Agg("_p", "max", F.struct(F.unix_micros("occurred_at").alias("t"), F.col(tie).alias("i"), F.col("lifecycle_stage").alias("s")))
    x = running(changes, ["contact_id"], "occurred_at", [tie], [prev])
    low = changes.groupBy("contact_id", "lifecycle_stage").agg(F.min(F.struct("occurred_at", tie))[tie].alias("_first"))
    return x.join(low, ["contact_id", "lifecycle_stage"], "left").select(
        *changes.columns, F.col("_p.s").alias("previous_lifecycle_stage"), (F.col("_first") == F.col(tie)).alias("first_reach"))


def canonical_events(sign: DataFrame, act: DataFrame, check: DataFrame, purch: DataFrame, adj: DataFrame, leads: DataFrame | None = None, stages: DataFrame | None = None) -> DataFrame:
    """All event kinds in one table; columns a kind does not have are NULL."""
    parts = [
        sign.select(event_id("signup", "user_id").alias("event_id"), F.lit("signup").alias("event_name"), "occurred_at", "source_system", "source_event_id", "user_id"),
        act.select(event_id("activation", "user_id").alias("event_id"), F.lit("activation_first_generation").alias("event_name"), "occurred_at",
                   F.lit("credit_ledger").alias("source_system"), "source_event_id", "user_id", F.to_json(F.struct("model_id", "credits")).alias("generation")),
        check.select(event_id("checkout", "event_uuid").alias("event_id"), F.lit("checkout_started").alias("event_name"), "occurred_at",
                     F.lit("amplitude").alias("source_system"), F.col("event_uuid").cast("string").alias("source_event_id"), "user_id", "plan_tier", "billing_interval"),
        purch.where("event_name is not null").withColumn("source_system", F.lit("stripe")),
        adj.where("is_ledger_event").withColumn("source_system", F.lit("stripe")),
    ]
    if leads is not None:
        parts.append(leads.select(event_id("lead", "conversion_id").alias("event_id"), F.lit("enterprise_lead").alias("event_name"), F.col("submitted_at").alias("occurred_at"),
                                  F.lit("hubspot").alias("source_system"), F.col("conversion_id").cast("string").alias("source_event_id"), "lead"))
    if stages is not None:
        parts.append(stages.where("first_reach").select(
            event_id("lead_stage", "contact_id", "lifecycle_stage").alias("event_id"), F.lit("lead_stage_change").alias("event_name"), "occurred_at",
            F.lit("hubspot").alias("source_system"), "source_event_id", F.to_json(F.struct("lifecycle_stage", "previous_lifecycle_stage")).alias("lead")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def conversion_ledger(
    events: DataFrame, profile: DataFrame, devices: DataFrame, clicks: DataFrame, utms: DataFrame, exposures: DataFrame, web_fix: DataFrame,
    p: Params, click_keys: Sequence[str], utm_keys: Sequence[str], flags: Sequence[str],
) -> DataFrame:
    """Events with device, click ids, UTMs and arms as known when they happened (within the clock skew)."""
    x = events.withColumn("_until", C.add_seconds("occurred_at", p.clock_skew_seconds))
    sides = [
        Facts(devices, "device_since", [latest_of([F.col("device_since"), F.col("device_id")], ["device_id"], "_dev")]),
        click_facts(clicks, "click_id_created_at", click_keys), utm_facts(utms, "captured_at", utm_keys), arm_facts(exposures, flags),
    ]
    x = lookup_many(x, sides, ["user_id"], "_until").withColumn("device_id", F.col("_dev.p0")).drop("_dev")
    kept = [c for c in x.columns if not c.startswith(("_u_", "_a"))]
    x = open_utms(x, [*kept, *[F.col(f"_a{i}.arm").alias(f"arm_{i}") for i in range(len(flags))]], utm_keys)
    money_out = F.col("event_name").isin(*MONEY_OUT)
    entry = lambda v, at: F.struct(v.alias("value"), C.iso_millis(at).alias("created_at"))
    click_map = F.map_filter(
        F.map_from_arrays(F.array(*[F.lit(k) for k in click_keys]), F.array(*[F.when(F.col(f"click_{k}").isNotNull(), entry(F.col(f"click_{k}.value"), F.col(f"click_{k}.created_at"))) for k in click_keys])),
        lambda k, v: v.isNotNull())
    text_map = lambda names, cols: F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*cols)), lambda k, v: v.isNotNull())
    none = F.map_filter(click_map, lambda k, v: F.lit(False))
    x = x.withColumn("click_ids", F.when(money_out, none).otherwise(click_map))
    utm_map = text_map(utm_keys, [F.col(k) for k in utm_keys])
    x = x.withColumn("utm", F.when(money_out, F.map_filter(utm_map, lambda k, v: F.lit(False))).otherwise(utm_map))
    x = x.withColumn("experiment_arms", text_map(flags, [F.col(f"arm_{i}") for i in range(len(flags))]))
    prof = profile.select("user_id", "first_device_id", "country_code", "is_qa_account")
    fixes = bounded(web_fix).where("send and requires_web_fix").groupBy(F.col("canonical_event").alias("event_name")).agg(F.array_join(F.array_sort(F.collect_set("platform")), ",").alias("web_fix_platforms"))
    x = x.join(prof, "user_id", "left").join(fixes, "event_name", "left")
    drop = ["_until", "first_device_id", "utm_known_at"] + [f"click_{k}" for k in click_keys] + list(utm_keys) + [f"arm_{i}" for i in range(len(flags))]
    x = x.withColumn("device_id", F.coalesce("device_id", "first_device_id")).withColumn("requires_web_fix", F.col("web_fix_platforms").isNotNull())
    if "order_id" in x.columns:
        x = x.withColumn("order_id_sha256", F.when(F.col("order_id").isNotNull(), C.sha256_hex("order_id")))
    consent = F.to_json(F.struct(*[F.lit("unknown").alias(c) for c in ("ad_storage", "ad_user_data", "ad_personalization", "analytics_storage")],
                                 F.col("country_code").alias("region"), F.lit("none").alias("source")))
    x = x.withColumn("consent", consent).withColumn("is_qa_account", F.coalesce("is_qa_account", F.lit(False)))
    return coverage_flags(x.drop(*drop))


def coverage_flags(ledger: DataFrame) -> DataFrame:
    """Which identifiers each event carries."""
    has = lambda k: F.coalesce(F.map_contains_key("click_ids", k), F.lit(False))
    return ledger.select(
        "*", (F.size("click_ids") > 0).alias("has_any_click_id"), (has("gclid") | has("gbraid") | has("wbraid")).alias("has_google_click_id"),
        has("fbclid").alias("has_meta_fbclid"), (has("fbclid") & F.try_element_at("click_ids", F.lit("fbclid"))["created_at"].isNotNull()).alias("meta_fbc_buildable"),
        has("ttclid").alias("has_tiktok_ttclid"), F.map_contains_key("utm", "utm_source").alias("has_utm_source"),
        (F.size("experiment_arms") > 0).alias("has_experiment_arm"), F.col("country_code").isNotNull().alias("consent_region_known"),
    )

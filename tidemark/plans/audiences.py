"""Audience lists: candidates, membership, consent gate, hashing, snapshot diff."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators.rows import bounded, global_rank, keep_first, keep_first_counted, known_equal, top_fraction
from tidemark.params import Params
from tidemark.plans.consent import consent_country, denied, opted_out

# List names and reasons (fixed values).
MART_LISTS = {
    "seed": ("oa_high_predicted_profit_90d", "high_predicted_profit"), "paying": ("oa_paying_customers_suppress", "paying_customer_suppression"),
    "money_out": ("oa_refund_or_chargeback_suppress", "refund_or_chargeback_suppression"), "low": ("oa_low_predicted_profit_suppress", "low_predicted_profit_suppression"),
}
SYNC_LISTS = (
    ("oa_seed_top_decile_predicted_profit", "top_decile_predicted_profit", "seed"), ("oa_seed_positive_predicted_profit", "positive_predicted_profit", "seed"),
    ("oa_excl_active_subscribers", "active_subscriber_suppression", "exclusion"), ("oa_excl_fraud_or_chargeback", "fraud_or_chargeback_suppression", "exclusion"),
    ("oa_excl_refunded", "refund_suppression", "exclusion"), ("oa_excl_low_predicted_profit", "low_predicted_profit_suppression", "exclusion"),
)
CONSUMER_DOMAINS = ("gmail.com", "googlemail.com")


def candidates(scores: DataFrame, money_out: DataFrame, active: DataFrame, users: DataFrame, regions: DataFrame, p: Params) -> DataFrame:
    """List memberships of scored users with the upload gate.

    ``scores``: user_id, event_id, occurred_at, predicted_profit; ``money_out``: user_id, event_name, dispute_reason;
    ``active``: user_id; ``users``: user_id, country_code; ``regions``: iso2 of consent-required countries.
    """
    first = keep_first(scores, ["user_id"], [F.col("occurred_at"), F.col("event_id")]).select("user_id", "predicted_profit")
    r = global_rank(first, "predicted_profit")
    r = r.withColumn("percentile", F.coalesce(C.safe_divide(F.col("rank_min") - 1, F.nullif(F.col("total") - 1, F.lit(0))), F.lit(0.0))).drop("rank_min", "ties", "total")
    out = money_out.groupBy("user_id").agg(F.bool_or(F.col("event_name") == "refund").alias("has_refund"), F.bool_or(F.col("event_name") == "chargeback").alias("has_chargeback"),
                                           F.bool_or(F.coalesce(F.col("dispute_reason") == "fraudulent", F.lit(False))).alias("has_fraud_dispute"))
    x = r.join(out, "user_id", "left").join(active.select("user_id").distinct().withColumn("is_active_subscriber", F.lit(True)), "user_id", "left").join(users.select("user_id", "country_code"), "user_id", "left")
    x = x.join(bounded(regions.select(F.col("iso2").alias("country_code"), F.lit(True).alias("requires_consent"))), "country_code", "left")
    for c in ("has_refund", "has_chargeback", "has_fraud_dispute", "is_active_subscriber", "requires_consent"):
        x = x.withColumn(c, F.coalesce(c, F.lit(False)))
    profit = F.col("predicted_profit")
    tainted = F.col("has_refund") | F.col("has_chargeback") | F.col("has_fraud_dispute")
    member = lambda kind, role, reason=None, value=None: F.struct(F.lit(MART_LISTS[kind][0]).alias("list_name"), F.lit(role).alias("candidate_role"), (F.lit(MART_LISTS[kind][1]) if reason is None else reason).alias("reason"), (F.lit(None) if value is None else value).cast("double").alias("seed_value"))
    low_reason = F.when(profit < 0, "negative_predicted_profit_suppression").otherwise(MART_LISTS["low"][1])
    lists = F.array(
        F.when((F.col("percentile") >= 1 - p.seed_top_share) & (profit >= p.seed_min_profit) & ~tainted, member("seed", "seed", value=F.greatest(profit, F.lit(0.0)))),
        F.when(F.col("is_active_subscriber"), member("paying", "exclusion")), F.when(tainted, member("money_out", "exclusion")), F.when(profit < p.low_profit_threshold, member("low", "exclusion", low_reason)))
    x = x.withColumn("_m", F.explode(F.filter(lists, lambda m: m.isNotNull())))
    blocked = F.when(F.col("country_code").isNull(), "region_unknown").when(F.col("requires_consent"), "consent_required_region_without_consent")
    return x.select("user_id", "_m.*", F.round(profit, 6).alias("predicted_profit"), F.round("percentile", 6).alias("percentile"), "is_active_subscriber", "has_refund", "has_chargeback", "has_fraud_dispute", "country_code",
                    blocked.isNull().alias("upload_allowed"), blocked.alias("upload_block_reason"))


def consent_gate(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Eligibility and its reason: opt-out, then denial, then region rule; an unknown region fails closed."""
    region, account = consent_country(F.col("region")), consent_country(F.col("country"))
    unknown = region.isNull() & account.isNull()
    needs = unknown | F.coalesce(region.isin(*required), F.lit(False)) | F.coalesce(account.isin(*required), F.lit(False))
    granted = (F.col("consent_source") == "cmp") & (F.col("ad_user_data") == "granted") & (F.col("ad_personalization") == "granted")
    reason = (
        F.when(opted_out(), "opted_out_gpc_or_sale_sharing").when(denied("ad_storage", "ad_user_data", "ad_personalization", "analytics_storage"), "explicit_denial").when(~needs, "default_eligible").when(granted, "granted")
        .when(unknown, "unknown_region_needs_cmp_grant").otherwise("consent_required_needs_cmp_grant"))
    return df.withColumn("consent_reason", reason).withColumn("eligible", F.col("consent_reason").isin("default_eligible", "granted"))


def select_audiences(cands: DataFrame, required: Sequence[str], numerator: int = 1, denominator: int = 10, low_below: float = 0.0) -> DataFrame:
    """Membership of six lists; the top-share threshold is taken before the consent filter."""
    top = top_fraction(cands.where("predicted_profit is not null"), "predicted_profit", numerator, denominator)
    # one row: the lowest score inside the top share
    threshold = top.agg(F.min("predicted_profit")).scalar()
    x = consent_gate(cands, required).where("eligible").withColumn("_t", threshold)
    p = F.col("predicted_profit")
    positive = F.coalesce((p > 0) & ~(F.col("is_fraud") | F.col("has_chargeback") | F.col("has_refund")), F.lit(False))
    tests = (positive & (p >= F.col("_t")), positive, F.col("is_active_subscriber"), F.col("is_fraud") | F.col("has_chargeback"), F.col("has_refund"), F.coalesce(p < low_below, F.lit(False)))
    lists = F.array(*[F.when(t, F.struct(F.lit(n).alias("list_name"), F.lit(r).alias("reason"), F.lit(role).alias("role"))) for t, (n, r, role) in zip(tests, SYNC_LISTS)])
    x = x.withColumn("_m", F.explode(F.filter(lists, lambda m: m.isNotNull())))
    return x.select("user_id", "email", "phone", "predicted_profit", "_m.*")


def normalized_email(platform: Column, email: Column) -> Column:
    """E-mail in the form each destination hashes; NULL when it is no address."""
    lowered = F.lower(F.trim(email))
    text = F.when(platform.isin("google_ads", "linkedin"), F.regexp_replace(lowered, "\\s+", "")).otherwise(lowered)
    local, domain = (F.regexp_extract(text, "^([^@\\s]+)@([^@\\s]+[.][^@\\s]+)$", g) for g in (1, 2))
    short = F.regexp_replace(F.substring_index(local, "+", 1), "[.]", "")
    strip = ((platform == "google_ads") & domain.isin(*CONSUMER_DOMAINS)) | platform.isin("reddit", "microsoft")
    name = F.when(strip, short).otherwise(local)
    return F.when((domain != "") & (name != ""), F.concat(name, F.lit("@"), domain))


def normalized_phone(platform: Column, phone: Column) -> Column:
    cleaned = F.regexp_replace(F.trim(phone), "[\\s().-]", "")
    return F.when(cleaned.rlike("^[+][1-9][0-9]{6,14}$"), F.when(platform == "meta", F.substring(cleaned, 2, 20)).otherwise(cleaned))


def hash_identifiers(df: DataFrame, platforms: Sequence[str]) -> DataFrame:
    """Hashed identifiers of each row for each destination; values a destination cannot use are NULL."""
    x = df.select("*", F.explode(F.array(*[F.lit(q) for q in platforms])).alias("platform"))
    p = F.col("platform")
    return x.select(
        "*", F.sha2(normalized_email(p, F.col("email")), 256).alias("email_sha256"), F.sha2(normalized_phone(p, F.col("phone")), 256).alias("phone_sha256"),
        F.when(p == "meta", F.sha2(F.lower(F.col("user_id").cast("string")), 256)).alias("external_id_sha256"))


def members(selection: DataFrame, platforms: Sequence[str]) -> DataFrame:
    """Member rows per platform and list, one per identifier key; ``outcome`` counts skips and duplicates."""
    x = hash_identifiers(selection, platforms).drop("email", "phone")
    key = F.concat_ws("|", F.coalesce("email_sha256", F.lit("-")), F.coalesce("phone_sha256", F.lit("-")), F.coalesce("external_id_sha256", F.lit("-")))
    usable = F.coalesce("email_sha256", "phone_sha256", "external_id_sha256").isNotNull()
    x = x.withColumn("member_key", F.when(usable, key))
    value = F.when((F.col("role") == "seed") & F.col("predicted_profit").isNotNull(), F.floor(F.greatest(F.col("predicted_profit"), F.lit(0.0)) * 100 + 0.5) / 100)
    known = keep_first_counted(x.where("member_key is not null"), ["platform", "list_name", "member_key"], [F.col("user_id")], "copies")
    return known.withColumn("value", value).select("platform", "list_name", "member_key", "user_id", "reason", "role", "value", "copies")


def member_counts(selection: DataFrame, platforms: Sequence[str]) -> DataFrame:
    m = members(selection, platforms).groupBy("platform", "list_name").agg(F.count(F.lit(1)).alias("members"), F.sum(F.col("copies") - 1).alias("duplicates"))
    total = selection.select("list_name", F.explode(F.array(*[F.lit(q) for q in platforms])).alias("platform")).groupBy("platform", "list_name").agg(F.count(F.lit(1)).alias("selected"))
    y = total.join(m, ["platform", "list_name"], "left").na.fill(0, ["members", "duplicates"])
    return y.withColumn("skipped_no_identifier", F.col("selected") - F.col("members") - F.col("duplicates"))


def value_bucket(v: Column, step: float = 0.2) -> Column:
    """Relative value bucket: small changes of a value do not cause a re-upload."""
    k = F.floor(F.log(v) / math.log1p(step) + 1e-9).cast("string")
    return F.when(v.isNull(), "none").when(~(v > 0), "0").when(v < 1, "<1").otherwise(k)


def audience_diff(prev: DataFrame, curr: DataFrame, dropped: DataFrame, candidate_ids: DataFrame, value_lists: Sequence[str]) -> DataFrame:
    """Changes per platform, list and member: adds, removes with their reason, value updates, unchanged."""
    keys = ["platform", "list_name", "member_key"]
    a = prev.select(*keys, F.col("user_id").alias("prev_user"), F.col("value").alias("prev_value"), F.lit(True).alias("_p"))
    b = curr.select(*keys, F.col("user_id").alias("curr_user"), F.col("value").alias("curr_value"), F.lit(True).alias("_c"))
    x = a.join(b, keys, "full_outer")
    # the three sides grow with the users: joined in partitions, whatever size they are guessed at; added members have no previous user
    still = curr.select(F.col("platform").alias("_sp"), F.col("list_name").alias("_sl"), F.col("user_id").alias("_su")).distinct().withColumn("_still", F.lit(True)).hint("merge")
    x = x.join(still, (F.col("platform") == F.col("_sp")) & (F.col("list_name") == F.col("_sl")) & known_equal(x, "prev_user", "_su"), "left").drop("_sp", "_sl", "_su")
    for side, flag in ((dropped, "_drop"), (candidate_ids, "_cand")):
        ids = side.select(F.col("user_id").alias("_u"), F.lit(True).alias(flag)).distinct().hint("merge")
        x = x.join(ids, known_equal(x, "prev_user", "_u"), "left").drop("_u")
    moved = F.col("list_name").isin(*value_lists) & ~value_bucket(F.col("prev_value")).eqNullSafe(value_bucket(F.col("curr_value")))
    action = F.when(F.col("_p").isNull(), "add").when(F.col("_c").isNull(), "remove").when(moved, "update").otherwise("unchanged")
    reason = F.when(F.col("_drop"), "consent_withdrawn").when(F.col("_still"), "identifier_changed").when(F.col("_cand").isNull(), "no_longer_a_candidate").otherwise("no_longer_qualifies")
    return x.select(*keys, F.coalesce("curr_user", "prev_user").alias("user_id"), "prev_value", "curr_value", action.alias("action"), F.when(F.col("_c").isNull(), reason).when(F.col("_p").isNotNull() & moved, "value_changed").alias("change_reason"))


def next_snapshot(diff: DataFrame, min_size: int) -> DataFrame:
    """Members each list holds after the run: a list below the minimum size takes no adds or updates."""
    size = diff.groupBy("platform", "list_name").agg(C.tally(F.col("action") != "remove").alias("_size"))
    x = diff.join(size, ["platform", "list_name"]).withColumn("held", F.col("_size") < min_size).where(F.col("action") != "remove")
    x = x.where(~(F.col("held") & (F.col("action") == "add")))
    return x.select("platform", "list_name", "member_key", "user_id", F.when(F.col("held"), F.col("prev_value")).otherwise(F.coalesce("curr_value", "prev_value")).alias("value"))


def plan_summary(diff: DataFrame, min_size: int) -> DataFrame:
    count = lambda a: C.tally(F.col("action") == a)
    x = diff.groupBy("platform", "list_name").agg(count("add").alias("adds"), count("remove").alias("removes"), count("update").alias("updates"), count("unchanged").alias("unchanged"), C.tally(F.col("change_reason") == "consent_withdrawn").alias("withdrawn"))
    held = F.col("adds") + F.col("updates") + F.col("unchanged") < min_size
    return x.withColumn("held", held).withColumn("sent_adds", F.when(held, 0).otherwise(F.col("adds"))).withColumn("sent_updates", F.when(held, 0).otherwise(F.col("updates")))


def candidates_from_lists(rows: DataFrame, contacts: DataFrame, attributes: Sequence[str], respect_gate: bool = True) -> tuple[DataFrame, DataFrame]:
    """Collapse list rows to users; users whose attributes disagree are reported, contacts joined, the gate applied."""
    shown = lambda a: F.coalesce(F.col(a).cast("string"), F.lit("~"))
    g = rows.groupBy("user_id").agg(*[F.min(a).alias(a) for a in attributes], F.bool_and("upload_allowed").alias("upload_allowed"), F.count(F.lit(1)).alias("lists"), *[F.countDistinct(shown(a)).alias(f"_n_{a}") for a in attributes])
    clash = F.filter(F.array(*[F.when(F.col(f"_n_{a}") > 1, F.lit(a)) for a in attributes]), lambda v: v.isNotNull())
    g = g.withColumn("_clash", clash)
    ok = g.where(F.size("_clash") == 0)
    if respect_gate:
        ok = ok.where("upload_allowed")
    users = ok.join(contacts, "user_id", "left").drop("_clash", *[f"_n_{a}" for a in attributes])
    return users, g.where(F.size("_clash") > 0).select("user_id", F.explode("_clash").alias("attribute"))

"""Per-platform decisions over all events: mapping, consent, windows and gates, values, restatements."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators.rows import bounded
from tidemark.operators.running import Agg, Facts, latest, lookup_many
from tidemark.plans.consent import SIGNALS, consent_country, denied, merge_signal, opted_out

DAY = 86_400


def expand_mapping(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """Event x platform with send flag, dedup key from its template and web-fix need.

    The mapping is a fixed table (12 event kinds x platforms). A template placeholder that
    has no value leaves the key NULL.
    """
    m = bounded(mapping.withColumnRenamed("canonical_event", "event_name"))
    x = events.join(m, "event_name")
    key = F.col("dedup_template")
    for name in ("event_id", "order_id", "user_id"):
        if name in events.columns:
            token = F.lit("{" + name + "}")
            key = F.when(F.contains(key, token), F.replace(key, token, F.col(name).cast("string"))).otherwise(key)
    return x.withColumn("dedup_key", key)


def consent_as_of(events: DataFrame, states: DataFrame, now: datetime) -> DataFrame:
    """Recorded consent merged with the user's latest state up to ``now`` (a denial from either side wins)."""
    s = states.where(F.col("updated_at") <= F.lit(now)).groupBy("user_id").agg(F.max(F.struct("updated_at", "state_id", *SIGNALS, "source", "gpc")).alias("c"))
    x = events.join(s, "user_id", "left")
    cmp = F.coalesce(F.col("c.source") == "cmp", F.lit(False))
    keep = [c for c in events.columns if c not in (*SIGNALS, "consent_source", "gpc")]
    merged = [F.when(F.col("c").isNull(), F.col(n)).otherwise(merge_signal(F.col(n), F.col(f"c.{n}"), cmp)).alias(n) for n in SIGNALS]
    gpc = F.when(F.col("gpc").isNotNull() | F.col("c.gpc").isNotNull(), F.coalesce("gpc", F.lit(False)) | F.coalesce("c.gpc", F.lit(False)))
    return x.select(*keep, *merged, F.when(cmp, "cmp").otherwise(F.col("consent_source")).alias("consent_source"), gpc.alias("gpc"))


def platform_consent(x: DataFrame, regulated: Sequence[str], unknown_region: str = "block", opt_out: str = "drop") -> DataFrame:
    """Consent mode or block reason of each event x platform."""
    # parts that the rules name often are columns of their own: inlined, they are worked out wherever they are named
    x = x.withColumns({"_country": consent_country(F.col("region")), "_no": denied("ad_storage", "ad_user_data")})
    country, no, yes = F.col("_country"), F.col("_no"), F.col("_yes")
    x = x.withColumn("_yes", (F.col("consent_source") == "cmp") & ~no & F.coalesce(F.col("ad_user_data") == "granted", F.lit(False)) & F.coalesce(F.col("ad_storage") == "granted", F.lit(False)))
    in_law = F.coalesce(country.isin(*regulated), F.lit(False))
    p = F.col("platform")
    limited = (
        F.when((p == "meta") & ~F.coalesce(country == "US", F.lit(False)), "meta_ldu_us_only").when((p == "tiktok") & F.col("client_ip").isNull(), "tiktok_ldu_requires_ip")
        .when(p.isin("linkedin", "x"), "consent_denied_no_limited_mode"))
    drop = F.lit(opt_out == "drop")
    reason = (
        F.when(opted_out(), "gpc_or_sale_opt_out").when(~yes & no & (in_law | country.isNull() | drop), "consent_denied")
        .when(country.isNull() & F.lit(unknown_region == "block") & ~yes, "consent_region_unknown").when(yes, F.lit(None)).when(in_law, "consent_required_regulated_region").when(no, limited))
    mode = F.when(F.col("block_reason").isNotNull(), F.lit(None)).when(yes, "granted").when(no, "restricted").otherwise("unspecified")
    return x.withColumn("block_reason", reason).withColumn("consent_mode", mode).drop("_country", "_no", "_yes")


def dispatch_plan(x: DataFrame, now: datetime | Column, enabled: Sequence[str], fixes_live: DataFrame, multi_source: bool, dedup_verified: bool, skew_seconds: int = 300) -> DataFrame:
    """Status and reason per event x platform, in the order the rules apply.

    Needs the columns of ``expand_mapping`` (send, max_age_days, twin_window_seconds, browser_twin, twin_observed, requires_web_fix)
    and of ``platform_consent``; ``fixes_live``: event_name, platform, live_at. ``now``: a time, or a column with each row's own.
    """
    us = lambda c: F.unix_micros(c)
    at, t = us(F.lit(now)), us(F.col("occurred_at"))
    twin = F.when(F.col("browser_twin"), F.col("twin_window_seconds"))
    age = F.col("max_age_days") * DAY
    window = F.when(twin.isNull(), age).otherwise(F.least(age, twin))
    # the deadline and the reasons are columns of their own, worked out once (see platform_consent)
    y = x.join(bounded(fixes_live), ["event_name", "platform"], "left").withColumn("_deadline", t + window * 1_000_000)
    deadline = F.col("_deadline")
    p = F.col("platform")
    skipped = (
        F.when(~p.isin(*enabled), "platform_disabled").when(~F.col("send"), "not_sent_by_mapping")
        .when((F.col("event_name") == "purchase_first") & p.isin("meta", "tiktok") & ~F.coalesce("is_first_purchase", F.lit(False)), "not_first_purchase").when(F.col("block_reason").isNotNull(), F.col("block_reason"))
        .when(t > at + skew_seconds * 1_000_000, "event_time_in_future").when((at > deadline) & twin.isNotNull() & (at - t <= age * 1_000_000), "twin_window_expired").when(at > deadline, "window_expired")
        .when(F.col("dedup_key").isNull(), "dedup_key_unavailable").when(F.col("requires_web_fix") & F.col("live_at").isNotNull() & (F.col("occurred_at") < F.col("live_at")), "predates_web_fix"))
    held = (
        F.when(F.col("requires_web_fix") & F.col("live_at").isNull(), "awaiting_web_fix").when((p == "google_ads") & F.col("twin_observed") & F.lit(not multi_source), "awaiting_google_multi_source")
        .when((p == "reddit") & F.col("browser_twin") & F.lit(not dedup_verified), "awaiting_reddit_dedup").when(F.coalesce("value_pending", F.lit(False)), "awaiting_value_score"))
    y = y.withColumns({"_skipped": skipped, "_held": held})
    status = F.when(F.col("_skipped").isNotNull(), "skipped").when(F.col("_held").isNotNull(), "held").otherwise("pending")
    return y.withColumn("status", status).withColumn("reason", F.coalesce("_skipped", "_held")).withColumn("deadline_at", F.timestamp_micros(deadline)).drop("live_at", "_deadline", "_skipped", "_held")


def restate(adjustments: DataFrame, originals: DataFrame, sends: DataFrame) -> DataFrame:
    """Value each platform should now hold for an order after refunds, in the currency first sent.

    ``adjustments``: event_id, event_name, adjusts_event_id, charge_id, cumulative_minor, cash_minor (negative);
    a lower refund of a charge than one already known is superseded.
    """
    top = adjustments.where("event_name = 'refund'").groupBy("charge_id").agg(F.max("cumulative_minor").alias("_max"))
    x = adjustments.join(top, "charge_id", "left").join(originals.select(F.col("event_id").alias("adjusts_event_id"), F.col("cash_minor").alias("original_minor"), F.col("currency").alias("original_currency"), "digits"), "adjusts_event_id", "left")
    x = x.join(sends.select(F.col("event_id").alias("adjusts_event_id"), "platform", "sent_value", "sent_currency"), "adjusts_event_id", "left")
    refund = F.col("event_name") == "refund"
    cut = F.when(refund, F.col("cumulative_minor")).otherwise(-F.col("cash_minor"))
    left = F.greatest(F.col("original_minor") - cut, F.lit(0))
    base = F.coalesce("sent_value", C.minor_to_major("original_minor", "digits"))
    value = F.when(F.col("original_minor") > 0, F.floor(base * left / F.col("original_minor") * 100 + 0.5) / 100).otherwise(0.0)
    status = F.when(F.col("original_minor").isNull(), "adjusted_purchase_unknown").when(refund & (F.col("cumulative_minor") < F.col("_max")), "superseded_by_later_refund").otherwise("pending")
    return x.select("event_id", "adjusts_event_id", "platform", status.alias("status"), F.when(status == "pending", value).alias("restated_value"), F.coalesce("sent_currency", "original_currency").alias("currency"), (left == 0).alias("full_refund"))


def resolve_clicks(events: DataFrame, store: DataFrame, keys: Sequence[str], max_age_seconds: int) -> DataFrame:
    """Click ids at conversion: the newest stored value per key not after the event and not too old; the event's own values win.

    ``events``: event_id, user_id, occurred_at and a map column own_click_ids; ``store``: user_id, click_id_key, click_id_value, created_at.
    """
    packed = F.struct(F.col("created_at").alias("t"), F.col("click_id_value").alias("v"))
    x = lookup_many(events, [Facts(store, "created_at", [Agg(f"_k_{k}", "max", F.when(F.col("click_id_key") == k, packed)) for k in keys])], ["user_id"], "occurred_at")
    fresh = lambda k: F.when(F.unix_micros("occurred_at") - F.unix_micros(f"_k_{k}.t") <= max_age_seconds * 1_000_000, F.col(f"_k_{k}.v"))
    stored = F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*[fresh(k) for k in keys])), lambda _k, v: v.isNotNull())
    own = F.coalesce("own_click_ids", F.map_filter(stored, lambda _k, v: F.lit(False)))
    rest = F.map_filter(stored, lambda k, v: ~F.map_contains_key(own, k))
    return x.withColumn("click_ids", F.map_concat(rest, own)).select(*[c for c in events.columns if c != "own_click_ids"], "click_ids")


def decide_value(purchases: DataFrame, scores: DataFrame, decided: DataFrame, now: datetime, sla_seconds: int, floor: float) -> DataFrame:
    """Value to send per purchase: the earliest score within the SLA, cash once it has passed; earlier decisions stay.

    ``purchases``: event_id, user_id, occurred_at, cash_value, acquisition; ``scores``: event_id, user_id, scored_at, predicted_profit.
    """
    open_ = purchases.join(decided.select("event_id"), "event_id", "left_anti")
    s = scores.select("event_id", F.col("user_id").alias("_u"), "scored_at", "predicted_profit").join(open_.select("event_id", "user_id", "occurred_at"), "event_id")
    late = F.unix_micros("scored_at") - F.unix_micros("occurred_at")
    s = s.where((F.col("_u") == F.col("user_id")) & (late >= 0) & (late <= sla_seconds * 1_000_000) & (F.col("scored_at") <= F.lit(now)))
    first = s.groupBy("event_id").agg(F.min(F.struct("scored_at", "predicted_profit"))["predicted_profit"].alias("score"))
    x = open_.join(first, "event_id", "left")
    due = F.unix_micros(F.lit(now)) >= F.unix_micros("occurred_at") + sla_seconds * 1_000_000
    cents = lambda c: F.floor(c * 100 + 0.5) / 100
    basis = F.when(~F.col("acquisition"), "cash").when(F.col("score").isNotNull(), "predicted_profit_90d").when(due, "cash_fallback").otherwise("pending")
    raw = cents(F.col("score"))
    value = F.when(basis == "predicted_profit_90d", F.greatest(raw, F.lit(floor))).otherwise(cents(F.col("cash_value")))
    return x.select("event_id", basis.alias("basis"), value.alias("value"), ((basis == "predicted_profit_90d") & (raw < floor)).alias("floored"))


def value_health(sends: DataFrame, platforms: Sequence[str], now: datetime, days: int = 14, min_conversions: int = 30, min_distinct: int = 5, min_ratio: float = 3.0) -> DataFrame:
    """Shares, distinct values and spread of the values sent in the trailing window, on the full platform grid."""
    t = F.unix_micros("occurred_at")
    at = F.unix_micros(F.lit(now))
    x = sends.where((t >= at - days * DAY * 1_000_000) & (t <= at) & F.col("value").isNotNull())
    ours = F.when(F.col("in_reporting_currency"), F.col("value"))
    is_ = lambda b: C.tally(F.col("basis") == b)
    a = x.groupBy("platform").agg(F.count(F.lit(1)).alias("conversions"), is_("predicted_profit_90d").alias("predicted"), is_("cash_fallback").alias("cash_fallback"), is_("cash").alias("cash"), C.tally(F.col("floored")).alias("floored"),
                                  C.tally(~F.col("in_reporting_currency")).alias("not_in_reporting_currency"), F.countDistinct(ours).alias("distinct_values"), F.min(ours).alias("min_value"), F.max(ours).alias("max_value"))
    grid = sends.sparkSession.range(1).select(F.explode(F.array(*[F.lit(p) for p in platforms])).alias("platform"))
    y = grid.join(a, "platform", "left").na.fill(0, ["conversions", "predicted", "cash_fallback", "cash", "floored", "not_in_reporting_currency", "distinct_values"])
    share = lambda n, d: F.floor(C.safe_divide(n, F.nullif(d, F.lit(0))) * 10_000 + 0.5) / 10_000
    ratio = F.when(F.col("min_value") > 0, F.floor(F.col("max_value") / F.col("min_value") * 100 + 0.5) / 100)
    ok = (F.col("conversions") >= min_conversions) & (F.col("distinct_values") >= min_distinct) & F.coalesce(ratio >= min_ratio, F.lit(False))
    return y.select("*", share(F.col("floored"), F.col("conversions")).alias("floor_share"), share(F.col("cash_fallback"), F.col("predicted") + F.col("cash_fallback")).alias("cash_fallback_share"), ratio.alias("max_min_ratio"), ok.alias("thresholds_ok"))


def latest_consent(events: DataFrame, states: DataFrame) -> DataFrame:
    """State of the user at the event (as-of form of the merge, for back-fills)."""
    return latest(events, states, ["user_id"], "occurred_at", "updated_at", [F.col("updated_at"), F.col("state_id")], [*SIGNALS, "source"], prefix="state_")

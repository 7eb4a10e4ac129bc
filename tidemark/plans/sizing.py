"""Sizing questions over the raw inputs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators.rows import keep_first
from tidemark.operators.running import Agg, running

DAY_US = 86_400_000_000
IN_APP_PATTERN = "instagram|facebook|fban|fbav|tiktok|musical_ly|bytedance"
SOCIAL_DOMAIN_PATTERN = "(^|[.])(instagram|facebook|tiktok)[.]com$"


def event_inventory(events: DataFrame, flags: dict[str, Column]) -> DataFrame:
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("user_id").alias("users"), *[C.tally(c).alias(n) for n, c in flags.items()])


def new_devices(events: DataFrame, start: datetime, end: datetime, now: datetime, follow_days: int = 7) -> DataFrame:
    """Devices first seen in the cohort and followed long enough."""
    f = events.where((F.col("event_time") < F.lit(end)) & F.col("device_id").isNotNull()).groupBy("device_id").agg(F.min("event_time").alias("first_seen_at"))
    return f.where((F.col("first_seen_at") >= F.lit(start)) & (F.unix_micros("first_seen_at") + follow_days * DAY_US <= F.unix_micros(F.lit(now))))


def journey_types(events: DataFrame, devices: DataFrame, follow_days: int = 7) -> DataFrame:
    """How paid-social devices reach the app: directly, over several pages, on a later visit, or never.

    ``events``: uuid, device_id, event_time, session_id, has_fbclid, is_page_view, is_app_page, url_has_fbclid.
    """
    e = events.join(devices, "device_id").where(F.unix_micros("event_time") < F.unix_micros("first_seen_at") + follow_days * DAY_US)
    meta = e.where("has_fbclid").select("device_id").distinct()
    v = e.where("is_page_view").join(meta, "device_id", "left_semi")
    v = running(v, ["device_id"], "event_time", ["uuid"], [Agg("view_number", "count")], include_current=True)
    first = v.groupBy("device_id").agg(F.min(F.struct("view_number", "session_id")).alias("l"), F.min(F.when(F.col("is_app_page"), F.struct("view_number", "session_id", "url_has_fbclid"))).alias("a"))
    x = meta.join(first, "device_id", "left")
    same = F.col("a.session_id") == F.col("l.session_id")
    kind = (
        F.when(F.col("a").isNull(), "never_reached_app").when(F.col("a.url_has_fbclid"), "direct_hop").when(same & (F.col("a.view_number") - F.col("l.view_number") <= 1), "direct_hop")
        .when(same, "multi_hop_same_session").otherwise("return_visit"))
    return with_share(x.groupBy(kind.alias("journey_type")).agg(F.count(F.lit(1)).alias("devices")), "devices", "pct")


def with_share(groups: DataFrame, count: str, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Share of the total; the frame runs over a handful of groups."""
    return groups.withColumn(name, 100 * F.col(count) / F.sum(count).over(Window.partitionBy(*by)))


def blocker_proxy(signups: DataFrame, events: DataFrame, payers: DataFrame) -> DataFrame:
    """Signups (and payers among them) without any product event around the signup, per week."""
    near = events.join(signups, "user_id").where((F.unix_micros("event_time") >= F.unix_micros("signup_at") - DAY_US) & (F.unix_micros("event_time") < F.unix_micros("signup_at") + 7 * DAY_US))
    x = signups.join(near.select("user_id").distinct().withColumn("_e", F.lit(True)), "user_id", "left").join(payers.select("user_id").distinct().withColumn("_p", F.lit(True)), "user_id", "left")
    silent, payer = F.col("_e").isNull(), F.col("_p").isNotNull()
    g = x.groupBy(C.week_start("signup_at").alias("signup_week")).agg(F.count(F.lit(1)).alias("signups"), C.tally(silent).alias("without_events"), C.tally(payer).alias("payers"), C.tally(payer & silent).alias("payers_without_events"))
    return g.withColumn("pct_without_events", 100 * F.col("without_events") / F.col("signups"))


def landing_context(events: DataFrame, devices: DataFrame, follow_days: int = 7) -> DataFrame:
    """Where devices landed and whether they signed in on the same device.

    ``events``: uuid, device_id, event_time, ua_hint, referring_domain, paid_click, signed_in.
    """
    e = events.join(devices, "device_id").where(F.unix_micros("event_time") < F.unix_micros("first_seen_at") + follow_days * DAY_US)
    g = e.groupBy("device_id").agg(F.min(F.struct("event_time", "uuid", "ua_hint", "referring_domain", "paid_click")).alias("f"), F.bool_or("signed_in").alias("signed_in"))
    context = F.when(F.lower("f.ua_hint").rlike(IN_APP_PATTERN), "in_app_browser (user agent)").when(F.lower("f.referring_domain").rlike(SOCIAL_DOMAIN_PATTERN), "social_referrer (proxy)").otherwise("other")
    x = g.groupBy(context.alias("landing_context")).agg(F.count(F.lit(1)).alias("devices"), C.tally(F.col("f.paid_click")).alias("with_paid_click"), C.tally(F.col("signed_in")).alias("signed_in"), C.tally(F.col("f.paid_click") & ~F.col("signed_in")).alias("paid_never_signed_in"))
    return x.withColumn("pct_signed_in", 100 * F.col("signed_in") / F.col("devices"))


def cost_per_arm(exposures: DataFrame, usage: DataFrame) -> DataFrame:
    """Serving cost per exposed user in the first day and the first 30 days after the exposure."""
    late = F.unix_micros("created_at") - F.unix_micros("first_exposed_at")
    x = usage.join(exposures.select("user_id", "flag_key", "first_exposed_at"), "user_id").where((late >= 0) & (late < 30 * DAY_US))
    c = x.groupBy("user_id", "flag_key").agg(C.sum_if(late < DAY_US, F.col("cost_micros")).alias("c1"), F.sum("cost_micros").alias("c30"), F.count(F.lit(1)).alias("n"))
    y = exposures.join(c, ["user_id", "flag_key"], "left").na.fill(0, ["c1", "c30", "n"])
    g = y.groupBy("flag_key", "arm").agg(F.countDistinct("user_id").alias("users"), C.tally(F.col("n") > 0).alias("active_users"), F.sum("c1").alias("cost_24h_micros"), F.sum("c30").alias("cost_30d_micros"))
    return g.withColumn("cost_30d_per_user", F.col("cost_30d_micros") / 1_000_000 / F.col("users"))


def revenue_after_first(inv: DataFrame) -> DataFrame:
    """Paid amount by how many months after the customer's first paid invoice it came."""
    first = inv.groupBy("user_id").agg(F.min(F.struct("paid_at", "invoice_id")).alias("f"))
    x = inv.join(first, "user_id")
    kind = F.when(F.col("invoice_id") == F.col("f.invoice_id"), "first").otherwise("later")
    return x.groupBy(kind.alias("kind"), C.month_diff(F.to_date("paid_at"), F.to_date("f.paid_at")).alias("months_after")).agg(F.count(F.lit(1)).alias("invoices"), F.sum("amount_paid_minor").alias("paid_minor"))


TIMING = ((0, "before signup (check the join)"), (24, "0-24h"), (72, "1-3d"), (168, "3-7d"), (336, "7-14d"), (720, "14-30d"))


def time_to_first(signups: DataFrame, subs: DataFrame, max_days: int = 60) -> DataFrame:
    """First subscriptions by time since signup."""
    first = keep_first(subs, ["user_id"], [F.col("purchased_at"), F.col("id")])
    x = first.join(signups, "user_id").withColumn("h", (F.unix_micros("purchased_at") - F.unix_micros("signup_at")) / 3_600_000_000).where(F.col("h") < max_days * 24)
    label = F.lit("30-60d")
    for limit, name in reversed(TIMING):
        label = F.when(F.col("h") < limit, name).otherwise(label)
    return with_share(x.groupBy(label.alias("purchase_timing")).agg(F.count(F.lit(1)).alias("first_subscriptions"), F.sum("amount_minor").alias("amount_minor")), "first_subscriptions", "pct")


def currency_mix(inv: DataFrame) -> DataFrame:
    g = inv.groupBy("currency").agg(F.count(F.lit(1)).alias("invoices"), F.sum("amount_paid_minor").alias("paid_minor"), C.tally(F.coalesce(F.col("total_excluding_tax_minor") < F.col("total_minor"), F.lit(False))).alias("taxed"), C.tally(F.col("total_excluding_tax_minor").isNull()).alias("tax_unknown"))
    return with_share(g, "invoices", "pct_invoices")


def exposure_hygiene(rows: DataFrame, pattern: str = "[0-5]$") -> DataFrame:
    """Arm share of its slice, slice share of the flag, and users who saw more than one arm."""
    u = rows.groupBy("user_id", "flag_key").agg(F.min(F.struct("event_time", "event_id", "arm"))["arm"].alias("first_arm"), F.countDistinct("arm").alias("arms"))
    g = u.groupBy("flag_key", C.holdout_slice("user_id", pattern).alias("allocation_slice"), "first_arm").agg(F.count(F.lit(1)).alias("users"), C.tally(F.col("arms") > 1).alias("contaminated"))
    g = with_share(g, "users", "pct_of_slice", ("flag_key", "allocation_slice"))
    in_slice = F.sum("users").over(Window.partitionBy("flag_key", "allocation_slice"))
    return g.withColumn("slice_pct_of_flag", 100 * in_slice / F.sum("users").over(Window.partitionBy("flag_key")))

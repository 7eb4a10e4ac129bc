"""Segment bucketing, id rules and business-type parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import first_group, part_or_null

# Patterns and value lists (fixed values).
TABLET_PATTERN = "ipad|tablet|kindle|galaxy tab"
MOBILE_OS_PATTERN = "mobile|iphone|android|ios"
MOBILE_TYPE_PATTERN = "iphone|android|pixel|galaxy|mobile"
PAID_MEDIUM_PATTERN = "cpc|ppc|paid|display|cpm"
UTM_PAID_MEDIA = ("cpc", "ppc", "paid", "paid_social", "paidsocial", "display", "influencer")
CAPABILITY_PATTERN = "^[A-Za-z0-9.-]+:[A-Za-z0-9-]+$"
VARIANT_PATTERN = "^gpt-image-2-5-(flare|sunburst)$"
VARIANT_MODEL = "gpt-image-2-5"
VIDEO_MODES = ("lipSync", "motion-sync")


def _text(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def country_key(country: Column) -> Column:
    """ISO codes upper-cased, names lower-cased: the key of the bucket table."""
    trimmed = F.trim(country)
    return F.when(trimmed.rlike("^[A-Za-z]{2}$"), F.upper(trimmed)).otherwise(F.lower(trimmed))


def country_bucket(country: Column, seed_bucket: Column) -> Column:
    blank = F.trim(F.coalesce(country, F.lit(""))) == ""
    return F.when(blank, F.lit("unknown")).otherwise(F.coalesce(seed_bucket, F.lit("rest")))


def device_class(platform: Column, os_name: Column, device_type: Column) -> Column:
    p, o, t = _text(platform), _text(os_name), _text(device_type)
    return (
        F.when((p == "") & (o == "") & (t == ""), "unknown")
        .when(t.rlike(TABLET_PATTERN), "tablet")
        .when(p.isin("ios", "android") | o.rlike(MOBILE_OS_PATTERN) | t.rlike(MOBILE_TYPE_PATTERN), "mobile")
        .otherwise("desktop")
    )


def first_touch_channel(p: dict[str, Column]) -> Column:
    """Channel from first-touch properties, keyed by property name."""

    def has(*names):
        out = F.lit(False)
        for n in names:
            out = out | (F.coalesce(p[n], F.lit("")) != "")
        return out

    affiliate = (_text(p["utm_medium"]) == "affiliate") | (_text(p["utm_source"]) == "tolt") | has("ref", "tolt_referral")
    return (
        F.when(has("gclid", "gbraid", "wbraid"), "google_cpc")
        .when(has("fbclid"), "meta_paid_social")
        .when(has("ttclid"), "tiktok_paid_social")
        .when(affiliate, "affiliate")
        .when(_text(p["utm_medium"]).rlike(PAID_MEDIUM_PATTERN), "other_paid")
        .otherwise("organic")
    )


def utm_channel(source: Column, medium: Column) -> Column:
    s, m = F.lower(source), F.lower(medium)
    return (
        F.when((s == "tolt") | (m == "affiliate"), "affiliate")
        .when(m.isin(*UTM_PAID_MEDIA), "paid_other")
        .when(source.isNotNull(), "referral_other")
        .otherwise("organic")
    )


def parse_business_type(df: DataFrame, column: str = "business_type") -> DataFrame:
    """Capability id -> model, mode and media type."""
    mode = part_or_null(column, ":", 2)
    media = (
        F.when(mode.contains("video") | mode.isin(*VIDEO_MODES), "video")
        .when(mode.contains("image"), "image")
        .when(mode.contains("speech") | mode.contains("music") | mode.contains("sfx"), "audio")
        .when(mode.isNotNull(), "other")
    )
    return df.select(
        "*",
        F.regexp_replace(part_or_null(column, ":", 1), VARIANT_PATTERN, VARIANT_MODEL).alias("model_id"),
        mode.alias("generation_mode"), media.alias("media_type"),
    )


def clean_url(url: str) -> Column:
    return F.regexp_replace(F.col(url), "[?#].*$", "")


def url_param(url: str, name: str, value_pattern: str) -> Column:
    return first_group(url, f"[?&]{name}=({value_pattern})")


# Id formats (fixed values).
INVOICE_ID_PATTERN = "^in_[A-Za-z0-9]+$"
SESSION_ID_PATTERN = "^cs_(live|test)_[A-Za-z0-9]+$"
FALLBACK_ID_PATTERN = "^[A-Za-z]+_[0-9]+_.+_[0-9]{13}$"


def parse_dedup_id(c: str) -> tuple[Column, Column]:
    """(kind, reference) of a browser-side dedup id; unstable fallback ids carry no reference."""
    s = F.col(c)
    event, order = F.expr(f"substring({c}, 10)"), F.expr(f"substring({c}, 5)")
    is_ref = lambda x: x.rlike(INVOICE_ID_PATTERN) | x.rlike(SESSION_ID_PATTERN)
    kind = (
        F.when(s.startswith("reg_") & (F.length(s) > 4), "signup")
        .when(s.startswith("purchase_") & is_ref(event), "purchase_event")
        .when(s.startswith("sub_") & is_ref(order), "purchase_order")
        .when(s.startswith("sub_") & order.rlike(FALLBACK_ID_PATTERN), "unstable_fallback")
        .otherwise("unknown")
    )
    ref = F.when(kind.isin("signup", "purchase_order"), order).when(kind == "purchase_event", event)
    return kind, ref


def event_id(kind: str, *parts: str) -> Column:
    """Deterministic canonical event ids; NULL when a part is missing."""
    prefix = {
        "signup": "reg", "activation": "activation", "checkout": "checkout", "purchase": "purchase", "order": "sub",
        "refund": "refund", "chargeback": "chargeback", "lead": "lead", "lead_stage": "leadstage",
    }[kind]
    out = F.lit(prefix)
    for p in parts:
        out = F.concat(out, F.lit("_"), F.col(p).cast("string"))
    return out

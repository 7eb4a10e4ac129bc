"""Consent rules as column expressions. Signals are 'granted', 'denied' or 'unknown'."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Placeholders that mean an unknown country, and states with a limited-data mode (fixed values).
UNKNOWN_COUNTRIES = ("XX", "T1", "ZZ")
SIGNALS = ("ad_storage", "ad_user_data", "ad_personalization", "analytics_storage")


def consent_country(region: Column) -> Column:
    """Upper-case ISO country of a consent region, NULL when missing or unusable."""
    c = F.trim(F.split_part(F.upper(F.trim(region)), F.lit("-"), F.lit(1)))
    return F.when(c.rlike("^[A-Z]{2}$") & ~c.isin(*UNKNOWN_COUNTRIES), F.when(c == "UK", "GB").otherwise(c))


def opted_out() -> Column:
    return F.coalesce("gpc", F.lit(False)) | F.coalesce("opt_out_sale_sharing", F.lit(False))


def denied(*signals: str) -> Column:
    out = F.lit(False)
    for s in signals:
        out = out | F.coalesce(F.col(s) == "denied", F.lit(False))
    return out


def merge_signal(recorded: Column, current: Column, current_is_cmp: Column) -> Column:
    """A denial from either side wins; a current CMP answer fills what the row did not know."""
    some_denial = F.coalesce(recorded == "denied", F.lit(False)) | F.coalesce(current == "denied", F.lit(False))
    fills = current_is_cmp & F.coalesce(current != "unknown", F.lit(False))
    return F.when(some_denial, "denied").when(fills, current).otherwise(recorded)

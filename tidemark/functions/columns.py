"""Column helpers. Each one pins a semantic that differs between SQL engines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.params import POISSON_BOUNDS


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- numbers -------------------------------------------------------------

def safe_divide(a: str | Column, b: str | Column) -> Column:
    """Double division, NULL on a zero or NULL denominator."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def greatest_of(a: Column, b: Column, default) -> Column:
    return F.greatest(F.coalesce(a, F.lit(default)), F.coalesce(b, F.lit(default)))


def least_of(a: Column, b: Column, default) -> Column:
    return F.least(F.coalesce(a, F.lit(default)), F.coalesce(b, F.lit(default)))


def minor_to_major(minor: str | Column, digits: str | Column) -> Column:
    return col(minor).cast("double") / F.pow(F.lit(10.0), col(digits))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def shrink(observed: Column, n: Column, prior: Column | float, strength: float) -> Column:
    """Pseudo-count shrinkage of a mean: (sum + k * prior) / (n + k), empty cells give the prior."""
    prior = prior if isinstance(prior, Column) else F.lit(prior)
    return (F.coalesce(observed, F.lit(0)) + F.lit(strength) * prior) / (F.coalesce(n, F.lit(0)) + F.lit(strength))


def tally(condition: Column) -> Column:
    """Number of rows where the condition holds (never NULL)."""
    return F.count_if(F.coalesce(condition, F.lit(False)))


def sum_if(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value).otherwise(F.lit(0)))


def sample_variance(n: Column, s: Column, q: Column) -> Column:
    """Sample variance from count, sum and sum of squares (additive, so it merges over partitions)."""
    return F.when(n > 1, F.greatest((q - s * s / n) / (n - 1), F.lit(0.0)))


# ---- strings and hashes --------------------------------------------------

def sha256_hex(s: str | Column) -> Column:
    return F.sha2(col(s).cast("string"), 256)


def hex_prefix_to_int(h: Column, n: int) -> Column:
    return F.conv(F.substring(h, 1, n), 16, 10).cast("bigint")


def fold(key: str | Column, k: int) -> Column:
    """Cross-fitting fold of a key, the same on every engine."""
    return (hex_prefix_to_int(sha256_hex(key), 4) % k).cast("int")


def uniform(key: Column) -> Column:
    """Deterministic uniform in [0, 1)."""
    return hex_prefix_to_int(sha256_hex(key), 8).cast("double") / F.lit(4294967296.0)


def poisson_weight(u: Column) -> Column:
    """Poisson(1) draw by inverse CDF."""
    out = F.lit(len(POISSON_BOUNDS))
    for i in reversed(range(len(POISSON_BOUNDS))):
        out = F.when(u < POISSON_BOUNDS[i], F.lit(i)).otherwise(out)
    return out


def first_group(s: str | Column, pattern: str) -> Column:
    """First capture group or NULL."""
    return F.nullif(F.regexp_extract(col(s), pattern, 1), F.lit(""))


def part_or_null(s: str | Column, delimiter: str, n: int) -> Column:
    return F.nullif(F.split_part(col(s), F.lit(delimiter), F.lit(n)), F.lit(""))


def holdout_slice(key: str | Column, pattern: str) -> Column:
    return F.when(col(key).cast("string").rlike(pattern), F.lit("holdout")).otherwise(F.lit("bandit"))


def pattern_share(pattern_digits: int, alphabet: int = 10) -> float:
    """Share of uniformly spread keys a last-character class matches."""
    return pattern_digits / alphabet


# ---- JSON ----------------------------------------------------------------

def json_path(*keys: str) -> str:
    """Bracket path, safe for keys with dots or hyphens."""
    return "$" + "".join(f"['{k}']" for k in keys)


def json_str(j: str | Column, *keys: str) -> Column:
    return F.get_json_object(col(j), json_path(*keys))


def json_int(j: str | Column, *keys: str) -> Column:
    return json_str(j, *keys).try_cast("bigint")


def json_float(j: str | Column, *keys: str) -> Column:
    return json_str(j, *keys).try_cast("double")


def json_bool(j: str | Column, *keys: str) -> Column:
    text = json_str(j, *keys)
    return F.when(text == "true", F.lit(True)).when(text == "false", F.lit(False))


# ---- time ----------------------------------------------------------------

def from_unix_seconds(x: str | Column) -> Column:
    return F.timestamp_seconds(col(x))


def from_unix_millis(x: str | Column) -> Column:
    return F.timestamp_millis(col(x))


def from_iso(x: str | Column) -> Column:
    return F.try_to_timestamp(col(x))


def add_seconds(ts: str | Column, seconds: int | float | Column) -> Column:
    if isinstance(seconds, Column):
        return F.timestamp_micros(F.unix_micros(col(ts)) + (seconds * 1_000_000).cast("bigint"))
    return col(ts) + F.make_dt_interval(secs=F.lit(float(seconds)))


def diff_seconds(a: str | Column, b: str | Column) -> Column:
    return (F.unix_micros(col(a)) - F.unix_micros(col(b))) / F.lit(1e6)


def date_in_zone(ts: str | Column, zone: str | Column) -> Column:
    return F.to_date(F.from_utc_timestamp(col(ts), zone))


def month_start(d: str | Column) -> Column:
    return F.trunc(col(d), "month")


def week_start(ts: str | Column) -> Column:
    return F.to_date(F.date_trunc("week", col(ts)))


def date_compact(d: str | Column) -> Column:
    return F.date_format(col(d), "yyyyMMdd")


def iso_millis(ts: str | Column) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def month_diff(later: str | Column, earlier: str | Column) -> Column:
    return F.months_between(month_start(later), month_start(earlier)).cast("int")


# ---- aggregates ----------------------------------------------------------

def first_by(value: Column, order: Sequence[Column], where: Column | None = None) -> Column:
    """First non-NULL value under an order, optionally only among rows that match."""
    keep = value.isNotNull() if where is None else value.isNotNull() & where
    packed = F.when(keep, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], value.alias("v")))
    return F.min(packed)["v"]


def quantile(x: str | Column, q: float, exact: bool = True) -> Column:
    """Continuous quantile; the approximate form keeps a bounded sketch per group."""
    return F.percentile(col(x), q) if exact else F.percentile_approx(col(x), q, 200)


def kv_json(keys: str | Column, values: Column) -> Column:
    """Aggregate key/value rows to one JSON object with sorted keys, NULL keys skipped.

    Only for groups with a bounded key set (click keys, flags, models).
    """
    pairs = F.collect_list(F.when(col(keys).isNotNull(), F.struct(col(keys).alias("k"), values.alias("v"))))
    return F.to_json(F.map_from_entries(F.array_sort(pairs)))


def small_rows(rows: Sequence[dict]) -> Column:
    """A fixed list of rules as an array of structs, to explode next to each row."""
    names = list(rows[0])
    return F.array(*[F.struct(*[F.lit(r[n]).alias(n) for n in names]) for r in rows])

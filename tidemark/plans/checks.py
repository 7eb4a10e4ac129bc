"""Data-quality checks. Each returns the violating rows; an empty result is a pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.segments import INVOICE_ID_PATTERN, SESSION_ID_PATTERN


def in_range(df: DataFrame, c: str, low=None, high=None) -> DataFrame:
    bad = F.lit(False)
    if low is not None:
        bad = bad | (F.col(c) < low)
    if high is not None:
        bad = bad | (F.col(c) > high)
    return df.where(bad)


def matches(df: DataFrame, c: str, pattern: str) -> DataFrame:
    return df.where(F.col(c).isNotNull() & ~F.col(c).rlike(pattern))


def not_negative(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Negative values over several columns in one scan: (key, column, value)."""
    pairs = F.array(*[F.when(F.col(c) < 0, F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))) for c in columns])
    return df.select(key, F.explode(F.filter(pairs, lambda v: v.isNotNull())).alias("v")).select(key, "v.*")


def is_true(df: DataFrame, expression: Column) -> DataFrame:
    """Rows where an expression is false or unknown."""
    return df.where(~F.coalesce(expression, F.lit(False)))


def equal_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    n = a.agg(F.count(F.lit(1)).alias("left_rows")).withColumn("right_rows", b.agg(F.count(F.lit(1))).scalar())
    return n.where("left_rows <> right_rows")


def unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def known_before(df: DataFrame, key: str, anchor: str, columns: Sequence[str], strict: bool) -> DataFrame:
    """Facts dated after (or at, when strict) the anchor they feed."""
    late = lambda c: (F.col(c) >= F.col(anchor)) if strict else (F.col(c) > F.col(anchor))
    pairs = F.array(*[F.when(late(c), F.struct(F.lit(c).alias("column"), F.col(c).alias("fact_at"))) for c in columns])
    return df.select(key, anchor, F.explode(F.filter(pairs, lambda v: v.isNotNull())).alias("v")).select(key, anchor, "v.*")


def fit_hygiene(fits: DataFrame, users: DataFrame, scores: DataFrame) -> DataFrame:
    """Fits that learn from their own test week, and scores whose fit contains the scored user."""
    week = fits.where("test_week_start is not null").join(users.select("user_id", "signup_week"), "user_id").where("signup_week >= test_week_start")
    own = scores.where("purpose <> 'oot_train_crossfit' or fit_id like '%xf%'").join(fits.select("fit_id", "user_id"), ["fit_id", "user_id"], "left_semi")
    return week.select("fit_id", "user_id", F.lit("trains_on_test_week").alias("problem")).unionByName(own.select("fit_id", "user_id", F.lit("scores_own_user").alias("problem")))


def net_cash(ledger_cash: DataFrame, billing_cash: DataFrame, explained: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ledger cash = billing cash + explained differences, per key."""
    a = ledger_cash.select(*keys, F.col("minor").alias("v"))
    b = billing_cash.select(*keys, (-F.col("minor")).alias("v"))
    c = explained.select(*keys, (-F.col("minor")).alias("v"))
    return a.unionByName(b).unionByName(c).groupBy(*keys).agg(F.sum("v").alias("gap_minor")).where("gap_minor <> 0")


def completeness(source: DataFrame, ledger: DataFrame, key: str, amount: str) -> DataFrame:
    """Each paid record is exactly one ledger purchase with the same amount."""
    s = source.groupBy(key).agg(F.count(F.lit(1)).alias("source_rows"), F.sum(amount).alias("source_minor"))
    t = ledger.groupBy(key).agg(F.count(F.lit(1)).alias("ledger_rows"), F.sum(amount).alias("ledger_minor"))
    x = s.join(t, key, "full_outer")
    ok = (F.col("source_rows") == 1) & (F.col("ledger_rows") == 1) & (F.col("source_minor") == F.col("ledger_minor"))
    return is_true(x, ok)


PURCHASE_ID_PATTERN = "^purchase_(" + INVOICE_ID_PATTERN.strip("^$") + "|" + SESSION_ID_PATTERN.strip("^$") + ")$"


def contract(ledger: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """(key, rule) per broken contract rule, all rules in one scan."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()]), lambda v: v.isNotNull())
    return ledger.select(key, F.explode(broken).alias("rule"))


def ledger_rules() -> dict[str, Column]:
    c = F.col
    purchase = c("event_name").startswith("purchase")
    out = c("event_name").isin("refund", "chargeback")
    return {
        "event id format": F.when(purchase, c("event_id").startswith("purchase_")).when(c("event_name") == "refund", c("event_id").startswith("refund_")).when(c("event_name") == "chargeback", c("event_id").startswith("chargeback_")).otherwise(F.lit(True)),
        "purchase has positive cash": ~purchase | (c("cash_minor") > 0), "money out is negative": ~out | (c("cash_minor") < 0), "money out names its purchase": ~out | c("adjusts_event_id").isNotNull(), "has user": c("user_id").isNotNull(),
    }


def waterfall_closes(steps: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Month, platform and layer whose steps do not add up to the reported number."""
    moves = F.when(~F.col("is_total") | (F.col("step_name") == "stripe_truth"), F.col("value_delta")).otherwise(0.0)
    g = steps.groupBy("period_month", "platform", "report_layer").agg(F.sum(moves).alias("summed"), F.sum(F.when(F.col("step_name") == "platform_reported", F.col("value_delta")).otherwise(0.0)).alias("reported"))
    return g.where(F.abs(F.col("summed") - F.col("reported")) > tolerance * (1 + F.abs("reported")))


def links(adj: DataFrame, purch: DataFrame) -> DataFrame:
    """Adjustments without a purchase, or with a purchase of another user."""
    p = purch.select(F.col("event_id").alias("adjusts_event_id"), F.col("user_id").alias("_u"), F.lit(True).alias("_p"))
    x = adj.join(p, "adjusts_event_id", "left")
    problem = F.when(F.col("_p").isNull(), "no_purchase").when(~F.col("_u").eqNullSafe(F.col("user_id")), "other_user")
    return x.withColumn("problem", problem).where("problem is not null").select("event_id", "problem")


def log_reproducible(log: DataFrame, registry: DataFrame, current: DataFrame, key: str, ref: str, value: str) -> DataFrame:
    """Logged scores whose parameter set is unknown, or that differ from the current value under the same set."""
    missing = log.join(registry.select(ref).distinct(), ref, "left_anti").select(key, F.lit("unknown_reference").alias("problem"))
    now = current.select(key, ref, F.col(value).alias("_now"))
    changed = log.join(now, [key, ref]).where(~F.col(value).eqNullSafe(F.col("_now"))).select(key, F.lit("value_changed").alias("problem"))
    return missing.unionByName(changed)


def score_rules() -> dict[str, Column]:
    c = F.col
    gap = F.abs(c("predicted_revenue") - c("predicted_generation_cost") - c("predicted_fees") - c("predicted_refund_risk") - c("predicted_profit"))
    return {"profit identity": gap <= 0.01, "interval contains the score": (c("interval_low") <= c("predicted_profit")) & (c("predicted_profit") <= c("interval_high")),
            "no feature after the purchase": c("last_fact_at").isNull() | (c("last_fact_at") <= c("occurred_at")), "scored after the purchase": c("scored_at") >= c("occurred_at")}


def against_truth(df: DataFrame, truth: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, column, got, expected) where a result differs from the ground truth."""
    t = truth.select(key, *[F.col(c).alias(f"_t_{c}") for c in columns])
    x = t.join(df, key, "left")
    text = lambda c: F.col(c).cast("string")
    pairs = F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_t_{c}")), F.struct(F.lit(c).alias("column"), text(c).alias("got"), text(f"_t_{c}").alias("expected"))) for c in columns])
    return x.select(key, F.explode(F.filter(pairs, lambda v: v.isNotNull())).alias("v")).select(key, "v.*")


def mapping_flag(ledger: DataFrame, mapping: DataFrame) -> DataFrame:
    """Events whose web-fix flag differs from what the mapping says for their kind."""
    want = mapping.groupBy(F.col("canonical_event").alias("event_name")).agg(F.bool_or(F.col("send") & F.col("requires_web_fix")).alias("_want"))
    x = ledger.join(want, "event_name", "left").withColumn("expected", F.coalesce("_want", F.lit(False)))
    return x.where(F.col("requires_web_fix") != F.col("expected")).select("event_id", "event_name", "requires_web_fix", "expected")


def vectors(cases: DataFrame) -> DataFrame:
    """Cases (name, actual, expected) that disagree."""
    return cases.where(~F.col("actual").eqNullSafe(F.col("expected")))


def quarantine_counts(issues: DataFrame) -> DataFrame:
    """Warn for every quarantined record: counts per issue and severity."""
    return issues.groupBy("issue", "severity").agg(F.count(F.lit(1)).alias("records"))

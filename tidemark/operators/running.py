"""Running aggregates over ordered histories, safe for hot keys.

An as-of lookup, a previous-record lookup, a running sum and "how many before" are
all an associative aggregate over the facts of a key up to an instant. A window per
key would put a hot key into one task, and a range join would emit all pairs of it.
Both are avoided: histories are cut into time blocks, the frame runs inside
(key, block), and the totals of earlier blocks (one small row per key and block)
are carried in.

A block is a fixed stretch of time (a day). With ``block_rows`` the rows of every (key, stretch) are
counted first and a stretch with more rows is cut at quantiles of its times, so that a key with all its
rows in one day is spread over many tasks. Rows of one key at one instant stay together. Results do not
depend on the blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400
#: Rows of a key that a task orders at a time where blocks are cut by density.
BLOCK_ROWS = 1_000_000
#: Most stretches that are cut (each of the others holds at most one in so many of all rows) and most pieces of one.
DENSE, PIECES = 16_384, 1024
#: Hash buckets of the first count: only keys of a bucket with too many rows are counted one by one.
BUCKETS = 4096

_MERGE = {
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "count": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "min": lambda a, b: F.least(a, b),
    "max": lambda a, b: F.greatest(a, b),
}
_FOLD = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def _merge(kind: str, a: Column, b: Column) -> Column:
    """Combine two partial results; least/greatest skip NULL and order structs field by field."""
    if kind in ("min", "max"):
        first = F.when(a.isNull(), b).when(b.isNull(), a)
        return first.otherwise(F.when(a <= b, a).otherwise(b) if kind == "min" else F.when(a >= b, a).otherwise(b))
    return _MERGE[kind](a, b)


@dataclass(frozen=True)
class Agg:
    name: str
    kind: str  # sum | count | min | max
    value: Column | None = None

    def input(self) -> Column:
        if self.kind == "count":
            return F.lit(1).cast("bigint") if self.value is None else F.when(self.value, F.lit(1).cast("bigint"))
        return self.value


def _block(micros: Column, seconds: int | None) -> Column:
    if seconds is None:
        return F.lit(0).cast("bigint")
    return F.floor(micros / F.lit(seconds * 1_000_000)).cast("bigint")


def _cuts(rows: DataFrame, keys: Sequence[str], block_rows: int) -> DataFrame | None:
    """The times that cut crowded (key, stretch) groups into pieces of about ``block_rows`` rows; None if there are none.

    The list has at most DENSE groups and 2 * DENSE times. It is made once, here, since the frame and the carried totals
    must use the same cuts and approximate quantiles may differ between two runs.
    """
    spark = rows.sparkSession
    rows = rows.where(F.col("_t").isNotNull())
    bucket = F.pmod(F.xxhash64(*keys, "_b"), F.lit(BUCKETS))
    full = [r["_h"] for r in rows.groupBy(bucket.alias("_h")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block_rows).collect()]  # at most BUCKETS rows
    if not full:
        return None
    rows = rows.where(bucket.isin(full))
    crowded = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block_rows).orderBy(F.desc("_n")).limit(DENSE)
    listed = crowded.collect()  # at most DENSE rows
    if not listed:
        return None
    share = max(block_rows, sum(r["_n"] for r in listed) / DENSE)
    small = _listed(spark.createDataFrame(listed, crowded.schema), keys)
    quantiles = F.percentile_approx("_t", [i / PIECES for i in range(1, PIECES)], 10 * PIECES)
    found = _meet(rows.select(*keys, "_t", "_b"), small, keys).groupBy(*keys, "_b").agg(quantiles.alias("_q"), F.max("_n").alias("_n"))
    pieces = F.least(F.lit(PIECES), F.ceil(F.col("_n") / F.lit(share))).cast("int")
    picked = F.transform(F.sequence(F.lit(1), F.col("_p") - 1), lambda i: F.get(F.col("_q"), F.floor(i * PIECES / F.col("_p")).cast("int") - 1))
    cuts = found.withColumn("_p", pieces).where("_p > 1").select(*keys, "_b", F.array_distinct(picked).alias("_at"))
    return _listed(spark.createDataFrame(cuts.collect(), cuts.schema), keys)


def _listed(small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The columns of a list of (key, stretch) groups under names of their own."""
    return small.select(*[F.col(k).alias(f"_dk{i}") for i, k in enumerate(keys)], F.col("_b").alias("_db"), *[c for c in small.columns if c not in (*keys, "_b")])


def _meet(rows: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Rows with their entry of a short list of (key, stretch) groups; NULL keys are equal."""
    match = F.col("_b") == F.col("_db")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_dk{i}"))
    return rows.join(F.broadcast(small), match, how).drop("_db", *[f"_dk{i}" for i in range(len(keys))])


def _in_pieces(rows: DataFrame, cuts: DataFrame | None, keys: Sequence[str], whole: bool = False) -> DataFrame:
    """Number the blocks of a key in the order of time: PIECES numbers a stretch, by the cuts at or before the row's time.

    Of whole histories only the pieces of those that are cut have numbers, all below zero.
    """
    if cuts is None:
        return rows
    steps = F.array(*[F.lit(PIECES >> i) for i in range(1, PIECES.bit_length())])
    at_or_before = F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(F.col("_at"), n + step - 1) <= F.col("_t"), n + step).otherwise(n))
    if whole:
        return _meet(rows, cuts, keys, "left").withColumn("_b", F.when(F.col("_at").isNotNull(), at_or_before - PIECES).otherwise(F.lit(0)).cast("bigint")).drop("_at")
    piece = F.when(F.col("_at").isNotNull(), at_or_before).otherwise(F.lit(0))
    return _meet(rows, cuts, keys, "left").withColumn("_b", F.col("_b") * F.lit(PIECES) + piece).drop("_at")


def _carry(rows: DataFrame, keys: Sequence[str], aggs: Sequence[Agg]) -> DataFrame:
    """Per (key, block): the aggregate over all earlier blocks of the key."""
    totals = rows.groupBy(*keys, "_b").agg(*[_FOLD[a.kind](F.col(f"_i{i}")).alias(f"_p{i}") for i, a in enumerate(aggs)])
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *[F.col(k).alias(f"_ck{i}") for i, k in enumerate(keys)],
        F.col("_b").alias("_cb"),
        *[_FOLD[a.kind](F.col(f"_p{i}")).over(before).alias(f"_c{i}") for i, a in enumerate(aggs)],
    )


def _attach(rows: DataFrame, carry: DataFrame, keys: Sequence[str], null_safe: bool = False) -> DataFrame:
    match = F.col("_b") == F.col("_cb")
    for i, k in enumerate(keys):
        match = match & (F.col(k).eqNullSafe(F.col(f"_ck{i}")) if null_safe else F.col(k) == F.col(f"_ck{i}"))
    return rows.join(carry, match, "left")


def _results(inside: DataFrame, rows: DataFrame, keys: Sequence[str], aggs: Sequence[Agg], columns: Sequence[str], whole: bool, cut: bool) -> DataFrame:
    """The frames' results with the totals of earlier blocks; whole histories have such totals only where they are cut."""
    if whole and cut:
        # at most one row a piece of the listed keys
        joined = _attach(inside, F.broadcast(_carry(rows.where("_b < 0"), keys, aggs)), keys, True)
    elif whole:
        return inside.select(*columns, *[(F.coalesce(F.col(f"_w{i}"), F.lit(0)) if a.kind in ("sum", "count") else F.col(f"_w{i}")).alias(a.name) for i, a in enumerate(aggs)])
    else:
        joined = _attach(inside, _carry(rows, keys, aggs), keys)
    return joined.select(*columns, *[_merge(a.kind, F.col(f"_c{i}"), F.col(f"_w{i}")).alias(a.name) for i, a in enumerate(aggs)])


def running(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: Sequence[str],
    aggs: Sequence[Agg],
    include_current: bool = False,
    block_seconds: int | None = DAY,
    strict_time: bool = False,
    block_rows: int | None = None,
) -> DataFrame:
    """Aggregate over the rows of a key before (or through) the current one in (ts, tie) order.

    ``strict_time`` counts only rows with an earlier time, whatever their tie-break. ``block_rows`` cuts crowded blocks
    (those of a key that is not NULL) after a count of the rows. Without ``block_seconds`` a key is one block unless it has
    more than ``block_rows`` rows; ``df`` is counted first, so stage it where it is dear.
    """
    return _running(df, F.unix_micros(F.col(ts)), keys, tie, aggs, include_current, block_seconds, strict_time, block_rows)


def _running(
    df: DataFrame, place: Column, keys: Sequence[str], tie: Sequence[str], aggs: Sequence[Agg], include_current: bool,
    block_seconds: int | None, strict_time: bool, block_rows: int | None,
) -> DataFrame:
    whole, cuts = block_seconds is None, None
    base = df.withColumn("_t", place).withColumn("_b", _block(F.col("_t"), block_seconds))
    if block_rows or whole:
        known = base if whole else base.dropna(subset=list(keys))
        cuts = _cuts(known.select(*keys, "_t", "_b"), keys, block_rows or BLOCK_ROWS)
        base = _in_pieces(base, cuts, keys, whole)
    base = base.select("*", *[a.input().alias(f"_i{i}") for i, a in enumerate(aggs)])
    end = Window.currentRow if include_current else -1
    within = Window.partitionBy(*keys) if whole and cuts is None else Window.partitionBy(*keys, "_b")
    if strict_time:
        frame = within.orderBy("_t").rangeBetween(Window.unboundedPreceding, -1)
    else:
        frame = within.orderBy("_t", *tie).rowsBetween(Window.unboundedPreceding, end)
    inside = base.select("*", *[_FOLD[a.kind](F.col(f"_i{i}")).over(frame).alias(f"_w{i}") for i, a in enumerate(aggs)])
    return _results(inside, base, keys, aggs, df.columns, whole, cuts is not None)


def running_by_number(
    df: DataFrame, keys: Sequence[str], order: str, aggs: Sequence[Agg], include_current: bool = False,
    block_width: int | None = 100_000, block_rows: int | None = None,
) -> DataFrame:
    """As ``running``, ordered by an integer column instead of a time."""
    if block_width is None:
        return _running(df, F.col(order).cast("bigint"), keys, [], aggs, include_current, None, False, block_rows)
    base = df.withColumn("_b", F.floor(F.col(order) / F.lit(block_width)).cast("bigint"))
    base = base.select("*", *[a.input().alias(f"_i{i}") for i, a in enumerate(aggs)])
    end = Window.currentRow if include_current else -1
    frame = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, end)
    inside = base.select("*", *[_FOLD[a.kind](F.col(f"_i{i}")).over(frame).alias(f"_w{i}") for i, a in enumerate(aggs)])
    return _results(inside, base, keys, aggs, df.columns, False, False)


@dataclass(frozen=True)
class Facts:
    """One fact table of a lookup: inclusive facts count at the anchor instant, strict ones only before it."""

    df: DataFrame
    ts: str
    aggs: Sequence[Agg]
    inclusive: bool = True


def lookup_many(
    anchors: DataFrame, sides: Sequence[Facts], keys: Sequence[str], anchor_ts: str, block_seconds: int | None = DAY,
    block_rows: int | None = None,
) -> DataFrame:
    """For each anchor, aggregate several fact tables of its keys up to its instant.

    All sides and the anchors meet in one ordered frame: one shuffle and one sort,
    linear in anchors + facts, however many lookups are asked for. ``block_rows`` cuts
    crowded blocks, anchors without a key among them, after a count of anchors and facts. Without ``block_seconds`` a
    key is one block unless it is crowded.
    """
    whole = block_seconds is None
    left = anchors.select(
        *keys, F.unix_micros(F.col(anchor_ts)).alias("_t"), F.lit(1).alias("_k"), F.struct(*anchors.columns).alias("_row"),
    )
    blocks = left.select(*keys, "_t")
    names: list[tuple[str, str, int]] = []
    facts = None
    for side in sides:
        known = side.df.where(F.col(side.ts).isNotNull())
        for k in keys:
            known = known.where(F.col(k).isNotNull())
        cols = []
        for a in side.aggs:
            cols.append(a.input().alias(f"_i{len(names)}"))
            names.append((a.name, a.kind, len(names)))
        part = known.select(*keys, F.unix_micros(F.col(side.ts)).alias("_t"), F.lit(0 if side.inclusive else 2).alias("_k"), *cols)
        facts = part if facts is None else facts.unionByName(part, allowMissingColumns=True)
    aggs = [Agg(n, kind) for n, kind, _ in names]

    times = blocks.unionByName(facts.select(*keys, "_t")).withColumn("_b", _block(F.col("_t"), block_seconds))
    cuts = _cuts(times, keys, block_rows or BLOCK_ROWS) if block_rows or whole else None

    def with_block(df):
        return _in_pieces(df.withColumn("_b", _block(F.col("_t"), block_seconds)), cuts, keys, whole)

    both = with_block(left.unionByName(facts, allowMissingColumns=True))
    within = Window.partitionBy(*keys) if whole and cuts is None else Window.partitionBy(*keys, "_b")
    frame = within.orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = both.select(
        *keys, "_b", "_row", *[_FOLD[a.kind](F.col(f"_i{i}")).over(frame).alias(f"_w{i}") for i, a in enumerate(aggs)]
    ).where(F.col("_row").isNotNull())
    rows = with_block(blocks.unionByName(facts.drop("_k"), allowMissingColumns=True))
    return _results(inside, rows, keys, aggs, ["_row.*"], whole, cuts is not None)


def lookup(
    anchors: DataFrame, facts: DataFrame, keys: Sequence[str], anchor_ts: str, fact_ts: str, aggs: Sequence[Agg],
    inclusive: bool = True, block_seconds: int | None = DAY, block_rows: int | None = None,
) -> DataFrame:
    """For each anchor, aggregate the facts of its keys at or before (or strictly before) its instant."""
    return lookup_many(anchors, [Facts(facts, fact_ts, aggs, inclusive)], keys, anchor_ts, block_seconds, block_rows)


def latest_of(order: Sequence[Column], payload: Sequence[str], name: str = "_best") -> Agg:
    """Aggregate holding the payload of the greatest order so far; fields are p0, p1, ..."""
    return Agg(name, "max", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *[F.col(p).alias(f"p{i}") for i, p in enumerate(payload)]))


def latest(
    anchors: DataFrame, facts: DataFrame, keys: Sequence[str], anchor_ts: str, fact_ts: str,
    order: Sequence[Column], payload: Sequence[str], inclusive: bool = True, prefix: str = "",
    block_seconds: int | None = DAY, block_rows: int | None = None,
) -> DataFrame:
    """As-of join: the state with the greatest order among facts at or before the anchor."""
    out = lookup(anchors, facts, keys, anchor_ts, fact_ts, [latest_of(order, payload)], inclusive, block_seconds, block_rows)
    return out.select(*anchors.columns, *[F.col("_best")[f"p{i}"].alias(prefix + p) for i, p in enumerate(payload)])


def in_window(
    anchors: DataFrame, facts: DataFrame, keys: Sequence[str], start: str, end: str, fact_ts: str,
    aggs: Sequence[Agg], block_seconds: int = DAY, block_rows: int | None = None,
) -> DataFrame:
    """Sums and counts over facts in [start, end) for anchors whose windows may overlap.

    Two prefix lookups and a subtraction instead of a range join, so overlapping
    windows of a hot key emit no pairs. Only for sum and count over exact (integer) values.
    """
    assert all(a.kind in ("sum", "count") for a in aggs)
    low = [Agg(f"_lo{i}", a.kind, a.value) for i, a in enumerate(aggs)]
    high = [Agg(f"_hi{i}", a.kind, a.value) for i, a in enumerate(aggs)]
    out = lookup(anchors, facts, keys, start, fact_ts, low, False, block_seconds, block_rows)
    out = lookup(out, facts, keys, end, fact_ts, high, False, block_seconds, block_rows)
    return out.select(
        *anchors.columns,
        *[(F.coalesce(F.col(f"_hi{i}"), F.lit(0)) - F.coalesce(F.col(f"_lo{i}"), F.lit(0))).alias(a.name) for i, a in enumerate(aggs)],
    )

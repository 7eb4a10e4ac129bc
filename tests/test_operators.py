"""Ordered-frame operators against brute force, with ties, hot keys and small blocks."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import rows as R
from tidemark.operators.running import Agg, Facts, in_window, latest, lookup_many, running

T0 = datetime(2024, 1, 1)


def history(seed, n, hot=0.4, keys=4, span=40):
    rnd = random.Random(seed)
    return [(i, 0 if rnd.random() < hot else rnd.randrange(keys), T0 + timedelta(minutes=rnd.randrange(span)), rnd.randrange(100)) for i in range(n)]


@pytest.fixture(scope="module")
def data(spark):
    a, f = history(1, 60), history(2, 90)
    return a, f, spark.createDataFrame(a, "id long, k long, t timestamp, v long"), spark.createDataFrame(f, "fid long, k long, ft timestamp, w long")


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("block", [120, 600, 86_400])
def test_lookup_matches_brute_force(data, inclusive, block):
    a, f, da, df = data
    side = Facts(df, "ft", [Agg("n", "count"), Agg("s", "sum", F.col("w")), Agg("lo", "min", F.col("w")), Agg("hi", "max", F.struct("ft", "fid"))], inclusive)
    got = {r.id: r for r in lookup_many(da, [side], ["k"], "t", block).collect()}
    assert len(got) == len(a)
    for i, k, t, _ in a:
        seen = [x for x in f if x[1] == k and (x[2] <= t if inclusive else x[2] < t)]
        assert (got[i].n or 0) == len(seen)
        assert (got[i].s or 0) == sum(x[3] for x in seen)
        assert got[i].lo == (min(x[3] for x in seen) if seen else None)
        assert (got[i].hi and got[i].hi.fid) == (max((x[2], x[0]) for x in seen)[1] if seen else None)


def test_mixed_bounds_in_one_frame(data):
    a, f, da, df = data
    x = lookup_many(da, [Facts(df, "ft", [Agg("le", "count")], True), Facts(df, "ft", [Agg("lt", "count")], False)], ["k"], "t", 300)
    for r in x.collect():
        assert (r.le or 0) == sum(1 for q in f if q[1] == r.k and q[2] <= r.t)
        assert (r.lt or 0) == sum(1 for q in f if q[1] == r.k and q[2] < r.t)


def test_null_keys_match_nothing(spark):
    a = spark.createDataFrame([(1, None, T0)], "id long, k long, t timestamp")
    f = spark.createDataFrame([(None, T0, 5)], "k long, ft timestamp, w long")
    row = lookup_many(a, [Facts(f, "ft", [Agg("s", "sum", F.col("w"))])], ["k"], "t").collect()[0]
    assert not row.s


@pytest.mark.parametrize("block", [120, 86_400])
def test_running_sum_and_previous(data, block):
    _, f, _, df = data
    x = running(df, ["k"], "ft", ["fid"], [Agg("before", "sum", F.col("w")), Agg("prev", "max", F.struct("ft", "fid", "w"))], block_seconds=block)
    for r in x.collect():
        earlier = sorted((q[2], q[0], q[3]) for q in f if q[1] == r.k and (q[2], q[0]) < (r.ft, r.fid))
        assert (r.before or 0) == sum(e[2] for e in earlier)
        assert (r.prev.w if r.prev else None) == (earlier[-1][2] if earlier else None)


@pytest.fixture(scope="module")
def crowded(spark):
    """One key with 3,000 rows in eight minutes of one day, half of them at few instants; a key over days; rows without a key."""
    rnd = random.Random(7)
    rows = [(i, 0, T0 + timedelta(seconds=rnd.choice([rnd.randrange(480), 60, 61])), rnd.randrange(100)) for i in range(3000)]
    rows += [(3000 + i, 1, T0 + timedelta(hours=7 * i), rnd.randrange(100)) for i in range(40)] + [(4000 + i, None, T0 + timedelta(seconds=i), 1) for i in range(300)]
    return rows, spark.createDataFrame(rows, "fid long, k long, ft timestamp, w long")


def test_crowded_days_are_cut_by_density(spark, crowded):
    from tidemark.operators import running as N

    rows, df = crowded
    base = df.withColumn("_t", F.unix_micros("ft")).withColumn("_b", N._block(F.col("_t"), N.DAY))
    sizes = {}
    cut = N._in_pieces(base, N._cuts(base, ["k"], 100), ["k"])
    assert cut.count() == len(rows)
    cut = cut.withColumn("alike", F.count(F.lit(1)).over(Window.partitionBy("k", "ft")))
    for r in cut.groupBy("k", "_b").agg(F.count(F.lit(1)).alias("n"), F.min("ft").alias("lo"), F.max("ft").alias("hi"), F.max("alike").alias("alike")).collect():
        sizes.setdefault(r.k, []).append((r["_b"], r.n, r.lo, r.hi, r.alike))
    hot = sorted(sizes[0])
    # an instant is never cut; beside its fullest instant no block holds more than about its share
    assert len(hot) > 8 and max(alike for *_, alike in hot) > 900 and all(n - alike <= 150 for _b, n, _lo, _hi, alike in hot)
    assert all(a[3] < b[2] for a, b in zip(hot, hot[1:]))  # block numbers follow time and no instant is in two blocks
    assert len(sizes[None]) > 1 and sum(n for _b, n, *_ in sizes[1]) == 40
    assert N._cuts(base, ["k"], 10_000) is None


def test_results_do_not_depend_on_the_cuts(spark, crowded):
    rows, df = crowded
    aggs = [Agg("before", "sum", F.col("w")), Agg("prev", "max", F.struct("ft", "fid", "w"))]
    pick = lambda x: sorted(tuple(r) for r in x.select("fid", "before", "prev.fid").collect())
    got = {r.fid: r for r in running(df, ["k"], "ft", ["fid"], aggs, block_rows=100).collect()}
    for key in (0, 1):
        total, last = 0, None
        for fid, _k, _ft, w in sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0])):
            assert (got[fid].before or 0) == total and (got[fid].prev and got[fid].prev.fid) == last
            total, last = total + w, fid
    for strict in (False, True):
        frames = [running(df, ["k"], "ft", [] if strict else ["fid"], aggs[:1], strict_time=strict, block_rows=n).select("fid", "before") for n in (None, 100)]
        assert frames[0].exceptAll(frames[1]).isEmpty()
    assert pick(running(df, ["k"], "ft", ["fid"], aggs, block_rows=100)) == pick(running(df, ["k"], "ft", ["fid"], aggs))
    anchors = df.where("fid % 3 = 0").select("fid", "k", "ft")
    for inclusive in (True, False):
        a, b = (latest(anchors, df, ["k"], "ft", "ft", [F.col("ft"), F.col("fid")], ["w"], inclusive, prefix="at_", block_rows=n) for n in (None, 100))
        assert sorted(a.collect(), key=str) == sorted(b.collect(), key=str) and a.count() == anchors.count()
    ends = anchors.withColumn("e", C.add_seconds("ft", 90))
    a, b = (in_window(ends, df, ["k"], "ft", "e", "ft", [Agg("n", "count")], block_rows=n) for n in (None, 100))
    assert sorted(a.collect(), key=str) == sorted(b.collect(), key=str)


def test_running_strict_time_skips_equal_times(data):
    _, f, _, df = data
    x = running(df, ["k"], "ft", [], [Agg("before", "count")], block_seconds=300, strict_time=True)
    for r in x.collect():
        assert (r.before or 0) == sum(1 for q in f if q[1] == r.k and q[2] < r.ft)


def test_in_window_is_half_open(data):
    a, f, da, df = data
    x = in_window(da.withColumn("e", C.add_seconds("t", 600)), df, ["k"], "t", "e", "ft", [Agg("n", "count")], 300)
    for r in x.collect():
        assert r.n == sum(1 for q in f if q[1] == r.k and r.t <= q[2] < r.t + timedelta(minutes=10))


def test_lookup_ignores_input_order(spark, data):
    _, f, da, _ = data
    shuffled = spark.createDataFrame(random.Random(9).sample(f, len(f)), "fid long, k long, ft timestamp, w long")
    base = spark.createDataFrame(f, "fid long, k long, ft timestamp, w long")
    pick = lambda d: sorted(tuple(r) for r in latest(da, d, ["k"], "t", "ft", [F.col("ft"), F.col("fid")], ["w"]).collect())
    assert pick(shuffled) == pick(base)


def test_global_rank_and_top_fraction(spark):
    values = [5, 5, 5, 5, 1, 2, 9, 9, 3, 7]
    d = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i long, v double")
    for rows in (1, 2, 200_000):
        for r in R.global_rank(d, "v", block_rows=rows).collect():
            assert r.rank_min == 1 + sum(1 for q in values if q < r.v) and r.total == len(values)
    assert sorted(r.v for r in R.top_fraction(d, "v", 1, 10).collect()) == [9.0, 9.0]
    assert sorted(r.v for r in R.top_fraction(d, "v", 4, 10).collect()) == [5.0, 5.0, 5.0, 5.0, 7.0, 9.0, 9.0]


def test_link_prefers_first_map(spark):
    child = spark.createDataFrame([(1, "p1", "c1"), (2, None, "c1"), (3, "zz", "zz")], "id long, pi string, ch string")
    pi = spark.createDataFrame([("p1", "A")], "pi string, parent string")
    ch = spark.createDataFrame([("c1", "B")], "ch string, parent string")
    got = {r.id: (r.parent, r.link_path) for r in R.link(child, [("intent", "pi", pi), ("charge", "ch", ch)], "parent").collect()}
    assert got == {1: ("A", "intent"), 2: ("B", "charge"), 3: (None, None)}


def test_plans(spark):
    """Group limits run before the shuffle, filters reach the scan, bounded tables are broadcast."""
    path = "/root/testdata/sf0.001/orders.parquet"
    o = spark.read.parquet(path)
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan(R.keep_first(o, ["o_custkey"], [F.col("o_orderkey")]))
    p = plan(o.where("o_orderkey > 10").select("o_custkey"))
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThan(o_orderkey,10)]" in p and "o_totalprice" not in p
    small = spark.sql("SELECT * FROM VALUES (1L) AS t(o_custkey)")
    assert "BroadcastHashJoin" in plan(o.join(R.bounded(small), "o_custkey"))
    assert "WindowGroupLimit" not in plan(o.groupBy("o_custkey").count())


def test_known_vectors(spark):
    row = spark.range(1).select(
        C.sha256_hex(F.lit("abc")).alias("sha"), C.from_unix_seconds(F.lit(1_700_000_000)).cast("string").alias("epoch"), C.iso_millis(C.from_iso(F.lit("2024-02-29T23:59:59.123Z"))).alias("iso"),
        C.date_in_zone(F.lit("2024-01-01 03:00:00").cast("timestamp"), "America/Los_Angeles").cast("string").alias("la"), C.json_str(F.lit('{"a-b": {"c": 1}}'), "a-b", "c").alias("j"),
        C.json_bool(F.lit('{"x": 1}'), "x").alias("not_bool"), C.safe_divide(F.lit(1), F.lit(0)).alias("div"), C.part_or_null(F.lit("a:"), ":", 2).alias("part"),
    ).collect()[0]
    assert row.sha == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert (row.epoch, row.iso, row.la, row.j) == ("2023-11-14 22:13:20", "2024-02-29T23:59:59.123Z", "2023-12-31", "1")
    assert (row.not_bool, row.div, row.part) == (None, None, None)


def test_quantiles_from_counts_equal_percentile(spark):
    import random

    rng = random.Random(4)
    rows = [("hot", round(rng.gauss(0, 50))) for _ in range(3000)] + [("one", 5), ("two", 1), ("two", 2), ("none", None)] + [("tie", 7)] * 9
    df = spark.createDataFrame(rows, "k string, v int")
    got = {r.k: (r.lo, r.mid, r.hi) for r in R.quantiles(df, ["k"], "v", {"lo": 0.025, "mid": 0.5, "hi": 0.9}, cuts=8).collect()}
    plain = {r.k: (r.lo, r.mid, r.hi) for r in df.where("v is not null").groupBy("k").agg(F.percentile("v", 0.025).alias("lo"), F.percentile("v", 0.5).alias("mid"), F.percentile("v", 0.9).alias("hi")).collect()}
    assert {k: [round(x, 9) for x in v] for k, v in got.items()} == {k: [round(x, 9) for x in v] for k, v in plain.items()}
    weighed = df.groupBy("k", "v").count()
    assert {r.k: r.mid for r in R.quantiles(weighed, ["k"], "v", {"mid": 0.5}, "count").collect()} == {k: v[1] for k, v in plain.items()}


@pytest.fixture
def shuffled(spark):
    """Every join and window goes over the network, without changes at run time."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    for k, v in keep.items():
        spark.conf.set(k, v)


def test_whole_histories_are_cut_only_where_crowded(crowded):
    rows, df = crowded
    aggs = [Agg("before", "sum", F.col("w")), Agg("prev", "max", F.struct("ft", "fid", "w"))]
    for n in (100, 100_000):
        got = {r.fid: r for r in running(df, ["k"], "ft", ["fid"], aggs, block_seconds=None, block_rows=n).collect()}
        assert len(got) == len(rows)
        for key in (0, 1, None):
            total, last = 0, None
            for fid, _k, _ft, w in sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0])):
                assert got[fid].before == total and (got[fid].prev and got[fid].prev.fid) == last
                total, last = total + w, fid
    anchors = df.where("fid % 3 = 0").select("fid", "k", "ft")
    for inclusive in (True, False):
        a, b, c = (sorted(latest(anchors, df, ["k"], "ft", "ft", [F.col("ft"), F.col("fid")], ["w"], inclusive, prefix="at_", block_seconds=s, block_rows=n).collect(), key=str) for s, n in ((86_400, None), (None, 100), (None, None)))
        assert a == b == c and len(a) == anchors.count()
        assert all(r.at_w is None for r in b if r.k is None)


def test_numbers_of_a_whole_history(spark):
    from tidemark.operators.running import running_by_number

    df = spark.createDataFrame([(k, 7 * i * i) for k in (1, None) for i in range(500)], "k long, v long")
    for n in (50, None):
        got = running_by_number(df, ["k"], "v", [Agg("prev", "max", F.col("v"))], block_width=None, block_rows=n).collect()
        assert len(got) == 1000 and all(r.prev == (7 * i * i if (i := round((r.v / 7) ** 0.5) - 1) >= 0 else None) for r in got)


def test_a_sparse_history_goes_over_the_network_once(shuffled, data):
    _, _, da, df = data
    plan = lookup_many(da, [Facts(df, "ft", [Agg("n", "count")])], ["k"], "t", None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_rows_without_a_key_do_not_meet_in_one_task(shuffled):
    child = shuffled.range(2000).select("id", F.when(F.col("id") < 100, F.concat(F.lit("k"), "id")).alias("key"), F.lit(None).cast("long").alias("other"))
    # a real key that looks like a made-up one takes no row without a key
    side = shuffled.range(70_000).select(F.col("id").cast("string").alias("key"), F.lit("wrong").alias("parent")).unionByName(child.where("id < 50").select("key", F.lit("right").alias("parent")))
    empty = shuffled.createDataFrame([(1, "wrong")], "other long, parent string")
    for how in (R.link, R.link_wide):
        out = how(child, [("a", "key", side), ("b", "other", empty)], "parent").withColumn("task", F.spark_partition_id()).collect()
        assert len(out) == 2000 and all((r.parent, r.link_path) == (("right", "a") if r.id < 50 else (None, None)) for r in out)
        held = [r.task for r in out if r.key is None]
        assert max(held.count(t) for t in set(held)) < 1000, how.__name__


def test_sides_that_grow_are_not_sent_to_every_task(spark):
    from tidemark.plans.audiences import audience_diff

    df = spark.createDataFrame([("meta", "seed", f"m{i % 60}", i, float(i)) for i in range(90)], "platform string, list_name string, member_key string, user_id long, value double")
    known = R.keep_first_counted(df, ["platform", "list_name", "member_key"], [F.col("user_id")], "copies")
    assert sorted((r.user_id, r.copies) for r in known.collect()) == [(i, 2 if i < 30 else 1) for i in range(60)]
    ids = df.select("user_id")
    diff = audience_diff(known.where("user_id % 5 <> 0"), known.where("user_id % 7 <> 0"), ids.where("user_id % 14 = 0"), ids.where("user_id % 21 <> 0"), ["seed"])
    for r in diff.collect():
        assert r.action == ("add" if r.user_id % 5 == 0 else "remove" if r.user_id % 7 == 0 else "unchanged")
        assert r.change_reason == (None if r.action != "remove" else "consent_withdrawn" if r.user_id % 14 == 0 else "no_longer_a_candidate" if r.user_id % 21 == 0 else "no_longer_qualifies")
    plan = diff._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") >= 6


def test_sides_of_one_row_a_key_meet_in_one_aggregation(shuffled):
    """A chain of joins sorted every side in one task."""
    df = shuffled.createDataFrame([(i, f"r{i}") for i in range(50)] + [(None, "none")], "k long, a string")
    sides = [
        shuffled.createDataFrame([(i, i * 2, None if i % 4 else "x") for i in range(0, 80, 3)] + [(None, 7, "y")], "k long, b long, c string"),
        shuffled.createDataFrame([(i, {"m": i}) for i in range(0, 50, 7)], "k long, d map<string,int>"),
    ]
    out = R.beside(df, sides, "k")
    assert out.columns == ["k", "a", "b", "c", "d"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    want = [(i, f"r{i}", i * 2 if i % 3 == 0 else None, "x" if i % 12 == 0 else None, {"m": i} if i % 7 == 0 else None) for i in range(50)] + [(None, "none", None, None, None)]
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, want))

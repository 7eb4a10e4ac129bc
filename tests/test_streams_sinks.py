"""Streams that lose nothing, and sinks that delete and replace."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import rows as R
from tidemark.plans import identity as I
from tidemark.sinks import tables as K
from tidemark.streaming import jobs as J

T0 = datetime(2024, 1, 1)
SCHEMA = "side string, key string, event_id long, at timestamp, cash_value double, predicted_profit double"


def at(hours):
    return T0 + timedelta(hours=hours)


def feed(spark, folder, *batches, park_h=3, back_h=2):
    sink = J.park(folder, ["key"], "event_id", park_h * 3600, back_h * 3600)
    for i, rows in enumerate(batches):
        sink(spark.createDataFrame(rows, SCHEMA), i)
    return {r.event_id: r for r in settled(spark, folder).collect()}


def settled(spark, folder):
    return J.settle(spark, folder, spark.createDataFrame([], SCHEMA).schema)


def event(i, h, key="a"):
    return ("event", key, i, at(h), 10.0 * i, None)


def partner(h, value=0.0, key="a"):
    return ("partner", key, None, at(h), None, value)


def test_late_events_still_get_an_answer(spark, tmp_path):
    got = feed(spark, str(tmp_path), [event(1, 0), event(2, 24)], [event(3, 25), event(4, 20), partner(21, 7.0)], [event(5, 19)])
    assert {i: r.status for i, r in got.items()} == {1: "degraded", 2: "degraded", 3: "degraded", 4: "resolved", 5: "resolved"}


def test_a_partner_outside_the_look_back_hides_none(spark, tmp_path):
    got = feed(spark, str(tmp_path), [partner(0, 1.0), event(1, 10)], [partner(12, 2.0), partner(11, 3.0)])
    assert got[1].status == "resolved" and got[1].partner.predicted_profit == 3.0


def test_earliest_score_inside_the_sla(spark, tmp_path):
    rows = [event(1, 10), partner(9.5, 9.0), partner(11, 5.0), partner(10.5, 42.0), event(2, 10, "b"), partner(9.5, 9.0, "b")]
    feed(spark, str(tmp_path), rows, park_h=2, back_h=0)
    got = {r.event_id: (r.basis, r.value) for r in J.sla_value(settled(spark, str(tmp_path)), 1.0).collect()}
    assert got == {1: ("predicted_profit_90d", 42.0), 2: ("cash_fallback", 20.0)}


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    batches = [[event(1, 0), event(2, 5)], [partner(6), event(3, 30)]]
    before = feed(spark, str(tmp_path), *batches)
    sink = J.park(str(tmp_path), ["key"], "event_id", 3 * 3600, 2 * 3600)
    sink(spark.createDataFrame(batches[1], SCHEMA), 1)
    after = {r.event_id: r for r in settled(spark, str(tmp_path)).collect()}
    assert {i: r.status for i, r in before.items()} == {i: r.status for i, r in after.items()} == {1: "degraded", 2: "resolved", 3: "degraded"}


def table(spark, path, rows):
    K.overwrite_days(spark.createDataFrame(rows, "user_id long, n long, day date"), path, "day")


def test_erasure_in_place_empties_days(spark, tmp_path):
    path = f"{tmp_path}/t"
    table(spark, path, [(1, 1, date(2024, 1, 1)), (1, 2, date(2024, 1, 2)), (2, 3, date(2024, 1, 2)), (2, 4, date(2024, 1, 3)), (3, 5, date(2024, 1, 3))])
    requests = spark.createDataFrame([(1, at(0)), (3, at(1000))], "user_id long, requested_at timestamp")
    for _ in range(2):
        K.erase_table(spark, path, "day", requests, at(48), 24)
        assert sorted((r.user_id, r.n) for r in spark.read.parquet(path).collect()) == [(2, 3), (2, 4), (3, 5)]
    assert not (tmp_path / "t" / "day=2024-01-01").exists()


def test_expiry_drops_partitions(spark, tmp_path):
    path = f"{tmp_path}/t"
    table(spark, path, [(1, i, date(2024, 1, 1 + i)) for i in range(10)])
    K.expire_table(spark, path, "day", datetime(2024, 1, 10), 3)
    assert sorted(x.name for x in (tmp_path / "t").iterdir() if x.name.startswith("day=")) == [f"day=2024-01-{d:02d}" for d in (7, 8, 9, 10)]


def test_refresh_replaces_old_days(spark, tmp_path):
    path = f"{tmp_path}/m"
    old = spark.createDataFrame([(1, at(0)), (2, at(48))], "user_id long, ts timestamp")
    K.write_mart(old, path, "ts", ["user_id"])
    K.write_mart(old.where("user_id = 2"), path, "ts", ["user_id"])
    assert [r.user_id for r in spark.read.parquet(path).collect()] == [2]


def test_append_takes_the_first_row_of_a_key(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5), (1, 3), (2, 4)], "id long, seen long").repartition(3)
    K.append_new(f"{tmp_path}/log", rows, ["id"], ["seen"])
    assert sorted(tuple(r) for r in K.read_log(spark, f"{tmp_path}/log").collect()) == [(1, 3), (2, 4)]


def dates(spark, rows, names):
    day = lambda n: None if n is None else date(1969, 12, 1) + timedelta(days=n)
    return spark.createDataFrame([(i, g, day(x), day(y)) for i, (g, x, y) in enumerate(rows)], names)


@pytest.mark.parametrize("on", [(), ("g",)])
def test_overlaps_equal_all_pairs(spark, on):
    rng = random.Random(5)
    ranges = lambda n: [(rng.choice("uv"), x, rng.choice((None, x, x + rng.randint(-2, 9), x + rng.randint(1, 4000)))) for x in (rng.randint(0, 300) for _ in range(n))]
    left, right = ranges(40) + [("u", 0, 5), ("u", 5, 40), ("v", 40, None)], ranges(40) + [("u", 5, 6), ("v", 40, None)]
    x, y = dates(spark, left, "i int, g string, a date, b date"), dates(spark, right, "j int, g string, c date, d date")
    y = y if on else y.withColumnRenamed("g", "h")
    joined = R.overlaps(x, y, ("a", "b"), ("c", "d"), on)
    far = 10**9
    end = lambda t: far if t is None else t
    expected = [(i, j) for i, (g, a, b) in enumerate(left) for j, (h, c, d) in enumerate(right) if a < end(b) and c < end(d) and a < end(d) and c < end(b) and (not on or g == h)]
    assert sorted((r.i, r.j) for r in joined.collect()) == sorted(expected)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_a_range_is_cut_into_few_pieces(spark):
    x = dates(spark, [("u", 3, 3653), ("u", 0, None)], "i int, g string, a date, b date")
    p = dates(spark, [("u", n, None) for n in range(0, 4000, 7)], "j int, h string, c date, d date")
    got = R.points_in_ranges(p, "c", x, ("a", "b")).collect()
    assert sorted((r.i, r.j) for r in got) == sorted([(0, j) for j, n in enumerate(range(0, 4000, 7)) if 3 <= n < 3653] + [(1, j) for j in range(len(range(0, 4000, 7)))])
    pieces = x.select(F.size(R._pieces(F.unix_date("a").cast("bigint"), F.unix_date("b").cast("bigint") - 1)).alias("n")).first().n
    assert pieces <= 2 * 12


def test_rules_meet_rows_by_equality_only(spark):
    from tidemark.plans.usage_cost import wildcard_match

    rng = random.Random(8)
    value = lambda: rng.choice((None, "a", "b", "c"))
    rules = [(f"r{i:03d}", value(), value(), value()) for i in range(60)]
    rows = [(i, value(), value(), value()) for i in range(200)]
    got = wildcard_match(spark.createDataFrame(rows, "i int, x string, y string, z string"), spark.createDataFrame(rules, "rule string, x string, y string, z string"), ["x", "y", "z"], "rule")
    for r in got.collect():
        fits = [(-sum(v is not None for v in rule[1:]), rule[0]) for rule in rules if all(v is None or v == w for v, w in zip(rule[1:], (r.x, r.y, r.z)))]
        assert r.rule == (min(fits)[1] if fits else None)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert wildcard_match(spark.createDataFrame(rows, "i int, x string, y string, z string"), spark.createDataFrame([], "rule string, x string, y string, z string"), ["x", "y", "z"], "rule").where("rule is not null").isEmpty()


def test_a_decided_event_is_decided_once(spark, tmp_path):
    sink = J.park(str(tmp_path), ["key"], "event_id", 3 * 3600, 2 * 3600)
    for i, rows in enumerate([[event(1, 0), partner(1, 4.0)], [event(1, 0), event(2, 5)], [event(2, 9), partner(8, 1.0)], [event(2, 5), event(1, 0), partner(40)]]):
        sink(spark.createDataFrame(rows, SCHEMA), i)
    got = settled(spark, str(tmp_path)).collect()
    # the parked event 2 keeps its first time (hour 5), so the partner of hour 8 is in time for it
    assert sorted((r.event_id, r.status, r.at) for r in got) == [(1, "resolved", at(0)), (2, "resolved", at(5))]


def test_settling_where_nothing_was_parked_or_decided(spark, tmp_path):
    assert {i: r.status for i, r in feed(spark, f"{tmp_path}/a", [event(1, 0), partner(1)]).items()} == {1: "resolved"}
    assert {i: r.status for i, r in feed(spark, f"{tmp_path}/b", [event(1, 0)]).items()} == {1: "degraded"}


def test_partners_are_read_by_day(spark, tmp_path):
    sink = J.park(str(tmp_path), ["key"], "event_id", 3600, 3600)
    sink(spark.createDataFrame([partner(24 * d) for d in range(20)] + [event(1, 24 * 19)], SCHEMA), 0)
    assert len([x for x in (tmp_path / "partners").iterdir() if x.name.startswith("day=")]) == 20
    assert [r.status for r in settled(spark, str(tmp_path)).collect()] == ["resolved"]


def test_dead_letters_after_so_many_failures(spark, tmp_path):
    failing = lambda x: x.withColumn("failed", F.when(F.col("id") == 9, None).otherwise(F.col("attempts") < F.col("fails")))
    sink = J.retry(str(tmp_path), failing, 3)
    batches = [[(1, 0), (2, 2), (3, 3), (9, 0)], [(4, 1)], [], [(5, 99)], [], [], []]
    for i, rows in enumerate(batches):
        sink(spark.createDataFrame(rows, "id int, fails int"), i)
        sink(spark.createDataFrame(rows, "id int, fails int"), i)  # a replay
    got = {n: sorted((r.id, r.attempts) for r in spark.read.parquet(f"{tmp_path}/{n}").collect()) for n in ("accepted", "dead_letter")}
    assert got == {"accepted": [(1, 0), (2, 2), (4, 1)], "dead_letter": [(3, 3), (5, 3), (9, 3)]}


def test_a_first_decision_stays(spark, tmp_path):
    sink = J.decide_once(str(tmp_path), "id", "at", 10)
    batches = [[(1, at(5), "a"), (1, at(4), "b")], [(1, at(0), "c"), (2, at(6), "d")], [(1, at(24 * 9), "e"), (2, at(24 * 40), "f")], []]
    for i, rows in enumerate(batches):
        sink(spark.createDataFrame(rows, "id int, at timestamp, v string"), i)
        sink(spark.createDataFrame(rows, "id int, at timestamp, v string"), i)
    got = sorted((r.id, r.v) for r in spark.read.parquet(str(tmp_path)).collect())
    assert got == [(1, "b"), (2, "d"), (2, "f")]
    K.expire_table(spark, str(tmp_path), "day", T0 + timedelta(days=41), 10)
    assert [r.v for r in spark.read.parquet(str(tmp_path)).collect()] == ["f"]


def test_a_load_reads_its_own_buckets(spark, tmp_path):
    path = f"{tmp_path}/log"
    assert K.append_new(path, spark.range(2000).withColumn("v", F.lit(1)), ["id"], buckets=16) == 2000
    few = K.with_bucket(spark.range(3, 4), ["id"], 16)
    read = K.logged(spark, path, few, "id bigint")
    assert read.select(F.input_file_name()).distinct().count() == 1 and read.count() < 400
    assert K.append_new(path, spark.range(1990, 2010).withColumn("v", F.lit(2)), ["id"], buckets=16) == 10
    assert K.read_log(spark, path).groupBy("v").count().orderBy("v").collect() == [(1, 2000), (2, 10)]


def test_rows_without_a_day_are_erased(spark, tmp_path):
    path = f"{tmp_path}/t"
    table(spark, path, [(1, 1, date(2024, 1, 1)), (1, 2, None), (2, 3, None), (3, 4, date(2024, 1, 2))])
    requests = spark.createDataFrame([(1, at(0))], "user_id long, requested_at timestamp")
    assert set(K.erase_table(spark, path, "day", requests, at(48), 24)) == {None, date(2024, 1, 1)}
    assert sorted((r.user_id, r.n, r.day) for r in spark.read.parquet(path).collect()) == [(2, 3, None), (3, 4, date(2024, 1, 2))]
    K.erase_table(spark, path, "day", spark.createDataFrame([(2, at(0))], "user_id long, requested_at timestamp"), at(48), 24)
    assert [r.user_id for r in spark.read.parquet(path).collect()] == [3]


def test_a_hot_key_is_spread(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 700).cast("string"))).alias("k"), F.col("id").alias("i"))
    side = spark.range(700).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"), F.col("id").alias("v")).unionByName(spark.createDataFrame([("hot", -1)], "k string, v long"))
    small, large = R.lookup(rows, side, ["k"]), R.lookup(rows, side, ["k"], max_rows=10)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect())) and large.columns == small.columns and large.count() == 20_000
    # the join's input as it is shuffled: no piece of the hot key holds much of it
    keyed = rows.withColumn("p", F.when(F.col("k") == "hot", F.pmod(F.xxhash64("k", "i"), F.lit(64)))).groupBy("k", "p").count()
    assert keyed.agg(F.max("count")).first()[0] < 2 * 18_000 / 64
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()


def test_speculative_loads_by_header(spark):
    names = ("sec_purpose", "purpose", "x_purpose", "x_moz")
    cases = [("sec_purpose", "prefetch;anonymous-client-ip", False), ("purpose", "prefetch", False), ("purpose", "prefetch;x", True), ("x_purpose", "Preview ", False), ("x_moz", "prefetch", False), ("x_moz", "preview", True)]
    rows = [(i, *[v if n == h else None for n in names], keep) for i, (h, v, keep) in enumerate(cases)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{n} string" for n in names) + ", keep boolean").select("*", F.lit("GET").alias("method"), F.lit("/").alias("path"), F.lit("document").alias("fetch_dest"), F.lit(None).cast("string").alias("fetch_mode"), F.lit(None).cast("string").alias("accept"), F.lit("Mozilla/5.0").alias("user_agent"))
    assert {r.id for r in I.page_visits(df).collect()} == {i for i, (_, _, keep) in enumerate(cases) if keep}


def test_no_local_folder_on_a_cluster(spark):
    from tidemark.session import checkpoint_folder

    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:  # noqa: N801
            master = "yarn"

    with pytest.raises(RuntimeError):
        checkpoint_folder(Cluster)


def test_a_load_with_wrong_counts_fails(spark):
    from tidemark.sources import readers

    frames = {"a": spark.range(3), "b": spark.range(2)}
    readers.require_counts(frames, {"a": 3, "b": 2})
    with pytest.raises(ValueError, match="b 2 instead of 5"):
        readers.require_counts(frames, {"a": 3, "b": 5})

"""Sends that wait for a gate: due rows leave the state, others stay for a later run."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import held as H

T0 = datetime(2024, 1, 1)
SHAPE = "id long, platform string, open_h int, deadline_at timestamp, next_at timestamp, received_at timestamp, checks int"


def at(hours):
    return T0 + timedelta(hours=hours)


def decide(rows, now):
    """The gate of a row opens ``open_h`` hours after the start (None: never); past its deadline it is skipped."""
    opens = F.unix_micros(F.lit(T0)) + F.col("open_h") * 3_600_000_000
    return rows.withColumn("status", F.when(F.unix_micros(now) > F.unix_micros("deadline_at"), "skipped").when(opens <= F.unix_micros(now), "pending").otherwise("held"))


def test_due_rows_leave_and_others_wait(spark, tmp_path):
    source, folder, checkpoint = f"{tmp_path}/in", f"{tmp_path}/q", f"{tmp_path}/c"

    def deliver(*rows):
        spark.createDataFrame([(*r, 0) for r in rows], SHAPE).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(source)
        H.run_held(H.due_sends(stream, ["id", "platform"], "next_at", "received_at", "0 seconds"), H.decide_due(folder, decide, "next_at", "received_at", 3600), checkpoint, 2)

    def read(name):
        return sorted((r.id, r.platform, r.status, r.checks, r.due_at) for r in spark.read.parquet(f"{folder}/{name}").collect())

    clock = lambda h: (999, "clock", None, at(999), at(990), at(h))
    deliver((1, "a", 1, at(50), at(2), at(0)), (1, "b", 9, at(50), at(30), at(0)), (2, "a", None, at(3), at(2), at(0)), (3, "a", 4, at(50), at(2), at(0)))
    deliver((1, "a", 1, at(50), at(20), at(1)), clock(5))  # a redelivery, and time goes on
    deliver(clock(6))
    run()
    # 1a was due at hour 2 and its gate is open; 2a and 3a are still held; 1b is not due
    assert [r[:4] for r in read("checked")] == [(1, "a", "pending", 1), (2, "a", "held", 1), (3, "a", "held", 1)]
    assert [r[:3] for r in read("out")] == [(1, "a", "pending")]
    again = sorted((r.id, r.next_at, r.checks) for r in spark.read.parquet(f"{folder}/again").collect())
    assert again == [(2, at(3), 1), (3, at(3), 1)]
    # what is held again comes back with the next files; the state of 1b is still there
    spark.read.parquet(f"{folder}/again").select(*[F.col(c) for c in spark.createDataFrame([], SHAPE).columns]).withColumn("received_at", F.lit(at(7))).coalesce(1).write.mode("append").parquet(source)
    deliver(clock(40))
    deliver(clock(41))
    run()
    assert (1, "b", "pending", 1, at(30)) in read("out")
    assert [r for r in read("checked") if r[3] == 2] == [(2, "a", "held", 2, at(3)), (3, "a", "held", 2, at(3))]


ROWS = "id long, platform string, next_at timestamp, received_at timestamp"


def queue(spark, folder):
    """The sink of one batch of rows, and what it has handed on as due: (id, platform, due_at, checks) by batch."""
    handed = {}
    sink = lambda rows, batch_id: handed.update({batch_id: sorted(((r.id, r.platform, r.due_at, r.checks) for r in rows.collect()), key=str)})
    write = H.held_table(folder, H.due_sends(spark.createDataFrame([], ROWS), ["id", "platform"], "next_at", "received_at", "0 seconds"), sink)
    return lambda batch_id, *rows: write(spark.createDataFrame(list(rows), ROWS), batch_id), handed


def test_waiting_rows_need_no_state_of_their_own_and_late_ones_are_taken(spark, tmp_path):
    source, folder, checkpoint = f"{tmp_path}/in", f"{tmp_path}/q", f"{tmp_path}/c"
    shape = ROWS.replace("next_at", "open_h int, deadline_at timestamp, next_at")
    for rows in ([(1, "a", 1, at(50), at(2), at(0)), (2, "a", 1, at(50), at(30), at(0))], [(9, "clock", None, at(999), at(990), at(20))], [(3, "a", 1, at(50), at(4), at(3))], [(9, "clock", None, at(999), at(990), at(21))]):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(source)
    H.run_held(H.due_sends(stream, ["id", "platform"], "next_at", "received_at", "0 seconds"), H.decide_due(folder, decide, "next_at", "received_at", 3600), checkpoint, 2)
    # row 3 arrives 17 hours behind the clock: due at once
    assert sorted((r.id, r.status, r.due_at) for r in spark.read.parquet(f"{folder}/checked").collect()) == [(1, "pending", at(2)), (3, "pending", at(4))]
    # the rows wait in a table: no call to a state store for each
    assert not (tmp_path / "c" / "state").exists()
    assert sorted(r.id for r in spark.read.parquet(f"{checkpoint}/held/waiting").where("due_us > 0").collect() if r.next_at > at(20)) == [2, 9]


def test_a_key_that_waits_is_not_replaced_and_can_come_again(spark, tmp_path):
    batch, handed = queue(spark, f"{tmp_path}/q")
    batch(0, (1, "a", at(10), at(1)), (1, "a", at(3), at(2)), (1, "b", at(3), at(2)), (None, "a", at(10), at(1)))
    assert handed[0] == []
    batch(1, (1, "a", at(4), at(5)), (None, "a", at(4), at(5)))  # redeliveries, one without an id
    assert handed[1] == [(1, "b", at(3), 1)]
    batch(2, (5, "c", at(10), at(10)))  # due when the clock has come to it, not after
    assert handed[2] == [(1, "a", at(10), 1), (5, "c", at(10), 1), (None, "a", at(10), 1)]
    batch(3, (1, "a", at(12), at(11)), (6, "c", None, at(11)))  # a key that has left waits anew; no next check: due at once
    assert handed[3] == [(6, "c", at(11), 1)]
    batch(4, (7, "c", at(99), at(13)))
    assert handed[4] == [(1, "a", at(12), 1)]


def test_a_replayed_batch_hands_on_the_same_rows(spark, tmp_path):
    batch, handed = queue(spark, f"{tmp_path}/q")
    batches = [[(i, "a", at(5 * i), at(0)) for i in range(20)], [(30, "a", at(31), at(30)), (8, "a", at(99), at(30)), (31, "a", at(1), at(30))], [(40, "a", at(1), at(60)), (19, "a", at(1), at(60))]]
    for n, rows in enumerate(batches):
        batch(n, *rows)
        first = dict(handed)
        batch(n, *rows)  # the run failed before the batch was committed
        assert handed == first
    assert [sorted(x[0] for x in handed[n]) for n in range(3)] == [[0], [1, 2, 3, 4, 5, 6, 31], [7, 8, 9, 10, 11, 12, 30, 40]]
    # days behind the clock of the batch before are gone, waiting rows are not
    left = spark.read.parquet(f"{tmp_path}/q/waiting").select("id", "due_day", "batch_id").collect()
    assert {r.id for r in left if r.due_day > at(60).date()} == {15, 16, 17, 18, 19}
    assert [r.id for r in left if r.due_day < at(30).date()] == [40]


def test_a_held_table_that_is_missing_is_not_taken_as_empty(spark, tmp_path):
    batch, handed = queue(spark, f"{tmp_path}/q")
    with pytest.raises(RuntimeError, match="batch 6"):
        batch(7, (1, "a", at(1), at(2)))
    batch(0)  # a batch without rows
    batch(1, (1, "a", at(1), at(2)))
    assert handed == {0: [], 1: [(1, "a", at(1), 1)]}

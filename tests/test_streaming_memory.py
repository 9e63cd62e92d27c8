"""Streams into a memory table, event-time state and maintenance that catches up."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from graphloom.streaming import memory as Y
from graphloom.streaming.decay import event_time_strength

NEW = "seq long, id long, fact string, embedding array<double>, importance int, ephemeral boolean"


@pytest.fixture
def target(spark, tmp_path):
    rows = [(1, "Old", [0.0, 1.0], "active", False, 5, 0.5, 0.3, 0.07, 0, 0, None, None, None)]
    schema = "id long, fact string, embedding array<double>, status string, ephemeral boolean, importance int, strength double, min_strength double, decay_rate double, recall_count int, reinforcement_count int, created_at timestamp, last_used_at timestamp, last_reinforced_at timestamp"
    Y.create_table(spark.createDataFrame(rows, schema), str(tmp_path / "table"))
    return str(tmp_path / "table")


def run(writer):
    q = writer.trigger(availableNow=True).start()
    assert q.awaitTermination(120)


def state(spark, target):
    return {r["id"]: (r["strength"], r["reinforcement_count"], r["recall_count"], r["decay_rate"]) for r in Y.memories(spark, target).collect()}


def test_ingest_and_replay(spark, tmp_path, target):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 11, "new one", [1.0, 0.0], 5, False), (2, 12, "near copy", [1.0, 0.01], 5, False), (3, 13, "OLD", [5.0, 5.0], 1, False)], NEW).coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema(NEW).parquet(src)
    run(Y.ingest_memories(stream(), target, str(tmp_path / "c")))
    once = state(spark, target)
    assert sorted(once) == [1, 11] and once[11][1] == 1 and math.isclose(once[11][0], 0.6) and once[11][3] == 0.01
    assert once[1][1] == 1 and math.isclose(once[1][0], 0.7)
    # The same batch again, as after a lost checkpoint write: the commit is found and nothing changes.
    version = Y.current_version(spark, target)
    assert not Y.commit_batch(spark, target, Y._run_of(str(tmp_path / "c")), 0, lambda a, b: pytest.fail("ran again"))
    run(Y.ingest_memories(stream(), target, str(tmp_path / "c")))
    assert state(spark, target) == once and Y.current_version(spark, target) == version
    # Another stream brings the same rows: all repeat, none is added.
    run(Y.ingest_memories(stream(), target, str(tmp_path / "other")))
    again = state(spark, target)
    assert sorted(again) == [1, 11] and again[11][1] == 3 and again[1][1] == 2


def test_uncommitted_rows_are_not_seen(spark, tmp_path, target):
    def broken(last, version):
        Y._append(Y.memories(spark, target, last).withColumn("id", F.lit(99).cast("long")), target, "memories", version)
        raise RuntimeError("lost")

    before = state(spark, target)
    with pytest.raises(RuntimeError):
        Y.commit_batch(spark, target, "r", 0, broken)
    assert state(spark, target) == before
    # The next attempt overwrites what the first one left.
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 11, "new one", [1.0, 0.0], 5, False)], NEW).write.parquet(src)
    run(Y.ingest_memories(spark.readStream.schema(NEW).parquet(src), target, str(tmp_path / "c")))
    assert sorted(state(spark, target)) == [1, 11]


def test_recall_after_the_response(spark, tmp_path, target):
    src = str(tmp_path / "answers")
    spark.createDataFrame([(1,), (1,), (77,)], "id long").coalesce(1).write.parquet(src)
    for _ in range(2):
        run(Y.recall_after(spark.readStream.schema("id long").parquet(src), target, str(tmp_path / "c")))
    got = state(spark, target)
    assert sorted(got) == [1] and math.isclose(got[1][0], 0.6) and got[1][1:] == (0, 2, 0.07)


def test_catch_up_runs_a_missed_window_once(spark, tmp_path):
    log, calls = str(tmp_path / "log"), []
    at = lambda d, h: dt.datetime(2024, 3, d, h)
    fails = [True]

    def long_rest(now):
        if fails.pop() if fails else False:
            raise ValueError("no luck")
        calls.append(("long", now))

    work = {"short_rest": lambda now: calls.append(("short", now)), "long_rest": long_rest}
    # Neither ever ran: both are due; the long one fails and stays due.
    assert Y.catch_up(spark, log, at(1, 12), work) == [("short_rest", True), ("long_rest", False)]
    assert Y.catch_up(spark, log, at(1, 12), work) == [("long_rest", True)]
    assert Y.catch_up(spark, log, at(1, 13), work) == []
    # Days of missed windows: each job once, and then no more.
    assert Y.catch_up(spark, log, at(9, 12), work) == [("short_rest", True), ("long_rest", True)]
    assert Y.catch_up(spark, log, at(9, 12), work) == []
    # The long rest waits for its hour unless it is overdue.
    assert Y.catch_up(spark, log, at(10, 9), work) == [("short_rest", True)]
    assert Y.catch_up(spark, log, at(11, 3), work) == [("short_rest", True), ("long_rest", True)]
    assert len(calls) == 7 and Y.run_log(spark, log).where("NOT ok").count() == 1


def by_hand(times, rate=0.07, step=0.2, start=0.4):
    strength, last = start, None
    for t in sorted(times):
        strength = min(1.0, (strength if last is None else strength * math.exp(-rate * (t - last).total_seconds() / 86400)) + step)
        last = t
    return round(strength, 6)


def test_event_time_strength(spark, tmp_path):
    """Out of order within the lateness: as if sorted; behind the watermark: dropped; idle: expired."""
    src = tmp_path / "in"
    t = lambda d, h: dt.datetime(2024, 1, d, h)
    files = [
        [(7, t(1, 5)), (7, t(1, 1)), (8, t(1, 2))],  # out of order inside a batch
        [(7, t(1, 4)), (7, t(1, 9)), (None, t(1, 9))],  # and across batches, still within the hours allowed
        [(9, t(3, 0))],  # moves the watermark past them
        [(7, t(1, 6)), (7, t(3, 1))],  # the first is late now
        [(9, t(20, 0))],  # key 8 is idle by then, and 7 as well
        [(9, t(20, 1))],
    ]
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = []
    try:
        for i, rows in enumerate(files):
            spark.createDataFrame(rows, "user_id long, ts timestamp").coalesce(1).write.mode("append").parquet(str(src))
            stream = spark.readStream.schema("user_id long, ts timestamp").parquet(str(src))
            q = event_time_strength(stream, late="6 hours", idle_days=5).writeStream.outputMode("update").foreachBatch(lambda b, n: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c"))
            run(q)
    finally:
        spark.conf.unset(provider)
    last = {r["user_id"]: r for r in got if not r["expired"]}
    assert (last[7]["n"], last[7]["strength"]) == (5, by_hand([t(1, 1), t(1, 4), t(1, 5), t(1, 9), t(3, 1)]))
    assert (last[8]["n"], last[8]["strength"]) == (1, 0.6)
    gone = {r["user_id"]: r for r in got if r["expired"]}
    assert sorted(gone) == [7, 8] and gone[8]["strength"] == round(0.6 * math.exp(-0.07 * 5), 6)

from __future__ import annotations

from datetime import timedelta

import pytest

from herdwatch.streaming import telemetry as streams
from herdwatch.streaming.state import ChangeLog, StateTable
from tests.replay import replay
from tests.test_telemetry import OPS, SCHEMA, START, random_rows

NOW = {"availableNow": True}


def feed(spark, root, rows, start):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")
    start(spark.readStream.schema(SCHEMA).parquet(f"{root}/in"), root).awaitTermination()


def latencies(stream, root):
    return streams.stream_latencies(stream, f"{root}/out", f"{root}/cp", OPS, ["op"], **NOW)


def test_stream_equals_the_replay_and_sets_late_rows_apart(spark, tmp_path):
    root, rows = str(tmp_path), sorted(random_rows(11, 300), key=lambda r: (r[1], r[2]))
    for i in range(3):
        feed(spark, root, rows[i * 100 : (i + 1) * 100], latencies)
    late = [("c", START - timedelta(days=1), 10_000, 5, 5), ("new", START, 10_001, 2, 8)]
    feed(spark, root, late, latencies)
    out = spark.read.parquet(f"{root}/out")
    got = {(r.node, r.seq): (r.op_delta, r.op_time_delta, r.op_latency_us, r.op_p95, r.op_p99) for r in out.collect()}
    assert got == replay([*rows, late[1]])
    assert [r.seq for r in spark.read.parquet(f"{root}/out-late").collect()] == [10_000]


def test_late_process_signals_are_set_apart(spark, tmp_path):
    root = str(tmp_path)
    schema = "node string, ts timestamp, seq long, up boolean"

    def step(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        streams.stream_process_signals(spark.readStream.schema(schema).parquet(f"{root}/in"), f"{root}/out", f"{root}/cp", **NOW).awaitTermination()

    step([("a", START, 1, True), ("b", START, 2, True)])
    step([("a", START + timedelta(minutes=1), 3, False), ("a", START - timedelta(minutes=1), 4, True)])
    assert [r.seq for r in spark.read.parquet(f"{root}/out-late").collect()] == [4]
    assert sorted((r.seq, r.transition) for r in spark.read.parquet(f"{root}/out-transitions").collect() if r.seq == 3) == [(3, "STOPPED")]


def test_a_repeated_micro_batch_changes_nothing(spark, tmp_path):
    table = StateTable(str(tmp_path / "state"))
    first = spark.createDataFrame([("a", 1)], "node string, v long")
    here = table.touched(first)
    table.write(first, 0, here)
    for v in (2, 3):  # the second write is the retry
        assert [tuple(r) for r in table.read(spark, 1, here).collect()] == [("a", 1)]
        table.write(spark.createDataFrame([("a", v)], "node string, v long"), 1, here)
    assert [tuple(r) for r in table.read(spark, 2, here).collect()] == [("a", 3)]
    with pytest.raises(RuntimeError, match="do not belong together"):
        table.read(spark, 4, here)


def test_a_micro_batch_replaces_only_its_buckets(spark, tmp_path):
    table = StateTable(str(tmp_path / "state"), buckets=16)
    every = spark.createDataFrame([(f"n{i}", i) for i in range(200)], "node string, v long")
    table.write(every, 0, table.touched(every))
    for epoch in range(1, 5):
        one = spark.createDataFrame([("n7", 1000 + epoch)], "node string, v long")
        touched = table.touched(one)
        assert len(touched) == 1
        before = table.read(spark, epoch, touched)
        assert len({f.rpartition("/")[0] for f in before.inputFiles()}) == 1
        table.write(before.filter("node <> 'n7'").unionByName(one), epoch, touched)
    kept = {r.node: r.v for r in table.read(spark, 5, range(16)).collect()}
    assert kept == {f"n{i}": i for i in range(200)} | {"n7": 1004}
    # Of the bucket's versions only the last two are left.
    assert len(list((tmp_path / "state").glob(f"v=*/_bucket={touched[0]}"))) == 2


def test_keys_that_stay_away_expire(spark, tmp_path):
    table = StateTable(str(tmp_path / "state"), buckets=1, expire_after="1 hour")
    rows = spark.createDataFrame([("old", START), ("new", START + timedelta(hours=2))], "node string, ts timestamp")
    table.write(rows, 0, [0])
    assert [r.node for r in table.read(spark, 1, [0]).collect()] == ["new"]


def test_changes_are_folded(spark, tmp_path):
    log = ChangeLog(str(tmp_path / "log"), streams._last(["k"]), every=3)
    for epoch in range(20):
        for _ in range(2):  # each micro-batch twice
            log.write(spark.createDataFrame([(f"k{epoch % 4}", epoch), ("all", epoch)], "k string, v long"), epoch)
        assert len(log.folders(spark)) <= 6
    assert {r.k: r.v for r in log.read(spark).collect()} == {"k0": 16, "k1": 17, "k2": 18, "k3": 19, "all": 19}
    assert len(list((tmp_path / "log").glob("level=*"))) <= 14


def test_rows_of_windows_that_are_over_are_kept_apart(spark, tmp_path):
    root = str(tmp_path)

    def start(stream, root):
        return streams.stream_windows(stream, f"{root}/out", f"{root}/cp", ["node"], "time", "1 hour", **NOW)

    feed(spark, root, [("a", START, 1, 0, 5), ("a", START + timedelta(minutes=1), 2, 0, 5)], start)
    feed(spark, root, [("a", START + timedelta(minutes=2), 3, 0, 5), ("a", START + timedelta(hours=2), 4, 0, 9)], start)
    feed(spark, root, [("a", START + timedelta(minutes=3), 5, 0, 5), ("a", START + timedelta(hours=2), 6, 0, 9), ("a", None, 7, 0, 5)], start)
    rows = streams.read_windows(spark, f"{root}/out", ["node"]).orderBy("window_start").collect()
    assert [(r.bound, r.n) for r in rows] == [(5, 3), (10, 2)]
    assert sorted(r.seq for r in spark.read.parquet(f"{root}/out-late").collect()) == [5, 7]


def test_counts_older_than_the_watermark_do_not_come_back(spark, tmp_path):
    root = str(tmp_path)

    def start(stream, root):
        hist = streams.window_histogram(stream, ["node"], "time", "1 hour")
        return streams.stream_updates(hist, f"{root}/out", f"{root}/cp", ["node", "window_start", "bound"], **NOW)

    feed(spark, root, [("a", START, 1, 0, 5), ("a", START + timedelta(minutes=1), 2, 0, 5)], start)
    feed(spark, root, [("a", START + timedelta(minutes=2), 3, 0, 5), ("a", START + timedelta(hours=2), 4, 0, 9)], start)
    rows = streams.read_updates(spark, f"{root}/out", ["node", "window_start", "bound"]).orderBy("window_start").collect()
    assert [(r.bound, r.n) for r in rows] == [(5, 3), (10, 1)]


def test_micro_batches_run_adaptively(spark, tmp_path):
    plans = []

    def handle(batch, epoch):
        counted = batch.groupBy((batch.seq % 7).alias("k")).count()
        plans.append(counted._jdf.queryExecution().executedPlan().toString())

    feed(spark, str(tmp_path), random_rows(1, 20), lambda s, r: streams._start(s, streams._per_batch(handle), f"{r}/cp", **NOW))
    assert plans[0].startswith("AdaptiveSparkPlan")

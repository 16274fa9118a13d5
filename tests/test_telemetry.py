from __future__ import annotations

import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from herdwatch.catalog import telemetry as telemetry_catalog
from herdwatch.functions import buckets
from herdwatch.operators import counters, health, histogram, telemetry
from herdwatch.plans import slices
from tests.replay import BOUNDS, Histogram, replay

OPS = {"op": ("total", "time")}
START = datetime(2024, 1, 1)
SCHEMA = "node string, ts timestamp, seq long, total long, time long"


def random_rows(seed: int, n: int = 600):
    """Two quiet nodes and one that holds most rows, many of them in one burst and at one instant."""
    rng = random.Random(seed)
    rows, total, time = [], dict.fromkeys("abc", 0), dict.fromkeys("abc", 0)
    moments = sorted(rng.choice([rng.uniform(0, 40 * 86400), 1_000_000 + rng.uniform(0, 3), 2_000_000]) for _ in range(n))
    for seq, second in enumerate(moments):
        node = rng.choices("abc", [1, 1, 8])[0]
        if rng.random() < 0.03:
            total[node] = 0
        if rng.random() < 0.03:
            time[node] = 0
        total[node] += rng.choice([0, 0, 1, 3, 50])
        time[node] += rng.choice([0, 7, 900, 30_000])
        rows.append((node, START + timedelta(seconds=int(second)), seq, total[node], time[node]))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("cut", [{}, {"width": 3600, "max_rows": 25}, {"max_rows": 7}, {"max_rows": None}])
def test_deltas_and_running_percentiles_equal_the_replay(spark, seed, cut):
    rows = random_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    deltas = counters.operation_deltas(df, OPS, keep_slices=True, **cut)
    out = histogram.running_percentile(deltas, "op_latency_us")
    got = {(r.node, r.seq): (r.op_delta, r.op_time_delta, r.op_latency_us, r.p95, r.p99) for r in out.collect()}
    assert got == replay(rows)


def test_hot_slices_are_cut_and_stay_in_order(spark):
    rows = random_rows(5)
    df = spark.createDataFrame(rows, SCHEMA)
    cut = slices.with_slices(df, ["node"], max_rows=20)
    assert cut.groupBy("node", slices.SLICE, slices.PART).count().agg(F.max("count")).first()[0] <= 20
    ordered = cut.orderBy("node", "ts", "seq").select("node", slices.SLICE, slices.PART).collect()
    assert [tuple(r) for r in ordered] == sorted(tuple(r) for r in ordered)


def test_one_instant_is_cut_by_the_tie_breaker(spark):
    rows = [("hot", START, i, i, i) for i in range(500)] + [("cold", START, 1000, 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    cut = slices.with_slices(df, ["node"], max_rows=50)
    assert cut.groupBy("node", slices.SLICE, slices.PART).count().agg(F.max("count")).first()[0] <= 50
    out = counters.counter_delta(df, "total", max_rows=50)
    assert {r.total_delta for r in out.filter("node = 'hot' AND seq > 0").collect()} == {1}


def test_many_hot_slices_are_joined_instead_of_broadcast(spark, monkeypatch):
    monkeypatch.setattr(slices, "BROADCAST_ROWS", 0)
    rows = random_rows(6)
    df = spark.createDataFrame(rows, SCHEMA)
    out = counters.operation_deltas(df, OPS, width=86400, max_rows=15)
    got = {(r.node, r.seq): (r.op_delta, r.op_time_delta) for r in out.collect()}
    assert got == {k: v[:2] for k, v in replay(rows).items()}


def test_null_timer_values_do_not_look_like_a_first_row(spark):
    rows = [("a", START + timedelta(days=i), i, 1, v) for i, v in enumerate([5, None, 9])]
    out = slices.running_before(spark.createDataFrame(rows, SCHEMA), ["node"], {"b": ("last", "time")}, width=3600)
    assert [r.b for r in out.orderBy("seq").collect()] == [None, 5, None]


def test_reset_rules(spark):
    rows = [("a", START + timedelta(minutes=i), i, v, 0) for i, v in enumerate([5, 8, 2, 7, 9])]
    df = spark.createDataFrame(rows, SCHEMA)
    peak = counters.counter_delta(df, "total").orderBy("seq")
    restart = counters.counter_delta(df, "total", reset="restart").orderBy("seq")
    assert [r.total_delta for r in peak.collect()] == [5, 3, 0, 0, 1]
    assert [r.total_delta for r in restart.collect()] == [5, 3, 2, 5, 2]


def test_bounds_follow_the_rule():
    assert buckets.BOUNDS == BOUNDS
    assert buckets.BOUNDS[:13] == [1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 17, 20]
    assert buckets.TOP == 25_109_160


def test_buckets_at_every_edge(spark):
    values = sorted({v + d for v in BOUNDS for d in (-1, 0, 1)} | {-5, 0, 2**62})
    df = spark.createDataFrame([(v,) for v in values], "v long").withColumn("b", buckets.to_bucket("v"))
    rows = df.withColumn("below", buckets.bound_before("b")).withColumn("label", buckets.hist_label("b")).collect()
    for r in rows:
        expected = next((b for b in BOUNDS if b >= r.v), buckets.OVERFLOW)
        assert r.b == expected
        assert r.below == max((b for b in BOUNDS if b < expected), default=0)
        assert r.label == f"[{r.below + 1}..{'Inf' if expected == buckets.OVERFLOW else expected}]"


@pytest.mark.parametrize("values", [[1], [0, -3], [7, 9, 9, 25_109_160], [5, 25_109_161], list(range(1, 400, 3))])
def test_histogram_summary_equals_the_replay(spark, values):
    expected = Histogram()
    for v in values:
        expected.add(v)
    df = spark.createDataFrame([("k", v) for v in values] + [("k", None)], "k string, v long")
    hist = histogram.histogram(df, ["k"], "v")
    s = histogram.hist_summary(hist, ["k"]).first()
    assert (s.min, s.max, s.n, s.mean, s.overflowed) == (
        expected.min(), expected.max(), len(values), expected.mean(), expected.overflowed,
    )
    p = histogram.hist_percentile(hist, ["k"], {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}).first()
    assert (p.p0, p.p50, p.p95, p.p100) == tuple(expected.percentile(x) for x in (0.0, 0.5, 0.95, 1.0))


def test_histograms_merge_and_compare(spark):
    df = spark.createDataFrame([("k", 1, v) for v in (3, 9)] + [("k", 2, 9)], "k string, part int, v long")
    whole = histogram.histogram(df, ["k"], "v")
    merged = histogram.merge_histograms(histogram.histogram(df, ["k", "part"], "v"), ["k"])
    assert histogram.hist_equal(whole, merged, ["k"]).first().equal
    one = histogram.histogram(df.filter("part = 1"), ["k"], "v")
    assert not histogram.hist_equal(whole, one, ["k"]).first().equal


def test_running_percentile_goes_on_from_an_initial_histogram(spark):
    rows = random_rows(9)
    df = counters.operation_deltas(spark.createDataFrame(rows, SCHEMA), OPS, keep_slices=True)
    split = START + timedelta(days=15)
    first, second = df.filter(F.col("ts") < split), df.filter(F.col("ts") >= split)
    seen = histogram.counts_array(histogram.histogram(first, ["node"], "op_latency_us"), ["node"])
    out = histogram.running_percentile(second, "op_latency_us", initial=seen)
    expected = replay(rows)
    for r in out.collect():
        assert (r.p95, r.p99) == expected[(r.node, r.seq)][3:]


def test_one_sample_per_tick_keeps_the_first(spark):
    rows = [("a", START + timedelta(seconds=s), i, 0, 0) for i, s in enumerate([5, 1, 59, 60, 61])]
    kept = telemetry.one_sample_per_tick(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r.seq for r in kept.collect()) == [1, 3]


def test_top_n_and_latest(spark):
    df = spark.createDataFrame([("a", START + timedelta(days=i), i, v, 0) for i, v in enumerate([4, 9, 9, 1, 7])], SCHEMA)
    assert [r.total for r in telemetry.top_n_distinct(df, ["node"], "total", 3).orderBy("rank").collect()] == [9, 7, 4]
    assert telemetry.latest_per_node(df).first().total == 7


@pytest.mark.parametrize(
    ("status", "nodes", "expected"),
    [
        ("green", 3, (0, 0, 0, 1)),
        ("YELLOW", 2, (0, 1, 1, 0)),
        ("RED", 3, (1, 0, 0, 1)),
        (None, 3, (-1, -1, -1, -1)),
    ],
)
def test_health_codes(spark, status, nodes, expected):
    df = spark.createDataFrame([(status, nodes)], "status string, nodes int")
    r = health.health_codes(df, desired_nodes=F.lit(3), discovery_nodes=F.lit(2)).first()
    assert (r.green_or_red, r.green_or_yellow, r.node_match, r.discovery_node_match) == expected


def test_registry_count_decides_the_node_match(spark):
    df = spark.createDataFrame([("c1", "GREEN", 2), ("c2", "GREEN", 2)], "app string, status string, nodes int")
    registry = spark.createDataFrame([("c1", "a"), ("c1", "b")], "app string, id string")
    out = health.health_codes(health.with_registry_count(df, registry), registry_nodes="registry_nodes")
    assert {r.app: r.node_match for r in out.collect()} == {"c1": 0, "c2": 1}


@pytest.mark.parametrize("cut", [{}, {"width": 60, "max_rows": None}, {"max_rows": 3}])
def test_members_are_counted_at_the_time_of_the_sample(spark, cut):
    at = lambda m: None if m is None else START + timedelta(minutes=m)
    members = [("a", 0, 9), ("a", 3, None), ("a", None, 5), ("a", 3, 3), ("b", 7, None), (None, 1, None)]
    asked = [(c, m, i) for i, (c, m) in enumerate((c, m) for c in ("a", "b", "c", None) for m in [*range(12), 3, None])]
    registry = spark.createDataFrame([(c, at(x), at(y)) for c, x, y in members], "app string, registered_at timestamp, removed_at timestamp")
    df = spark.createDataFrame([(c, at(m), i) for c, m, i in asked], "app string, ts timestamp, seq long")
    got = health.with_registry_count_at(df, registry, **cut)
    assert got.columns == [*df.columns, "registry_nodes"]
    known = lambda c, m: sum(c == a and (x is None or x <= m) and (y is None or y > m) for a, x, y in members) if c and m is not None else 0
    assert {r.seq: r.registry_nodes for r in got.collect()} == {i: known(c, m) for c, m, i in asked}


@pytest.mark.parametrize("cut", [{}, {"width": 60, "max_rows": None}])
def test_process_latch_and_edges(spark, cut):
    ups = [False, False, True, False, False, True, True]
    rows = [("n", START + timedelta(minutes=i), i, up) for i, up in enumerate(ups)]
    df = spark.createDataFrame(rows, "node string, ts timestamp, seq long, up boolean")
    down = health.process_down(df, **cut).orderBy("seq").collect()
    assert [(r.seq, r.down) for r in down] == [(2, 0), (3, 1), (4, 1), (5, 0), (6, 0)]
    turned = health.transitions(df, **cut).orderBy("seq").collect()
    assert [(r.seq, r.transition) for r in turned] == [(2, "STARTED"), (3, "STOPPED"), (5, "STARTED")]


def test_long_metrics_kinds(spark):
    rows = [("n", START, 1, 7, 3)]
    df = spark.createDataFrame(rows, "node string, ts timestamp, seq long, search_query_total long, open_files long")
    kinds = {r.metric: r.kind for r in telemetry.to_long_metrics(df).collect()}
    assert kinds == {"search_query_total": "COUNTER", "open_files": "GAUGE"}


def test_long_metrics_keep_whole_numbers(spark):
    df = spark.createDataFrame([("n", START, 1, 2**53 + 1, 0.5)], "node string, ts timestamp, seq long, open_files long, load double")
    rows = {r.metric: (r.value, r.long_value) for r in telemetry.to_long_metrics(df).collect()}
    assert rows == {"open_files": (float(2**53), 2**53 + 1), "load": (0.5, None)}


def test_top_n_of_any_size(spark):
    df = spark.createDataFrame([("a", i % 3000) for i in range(6000)], "node string, v long")
    rows = telemetry.top_n_distinct(df, ["node"], "v", 1500).orderBy("rank").collect()
    assert [r.v for r in rows] == list(range(2999, 1499, -1))


@pytest.mark.parametrize("tie", [lambda i: 2**60 + i, lambda i: f"run-{i:05d}"])
def test_one_instant_is_cut_by_any_tie_breaker(spark, tie):
    kind = "long" if isinstance(tie(0), int) else "string"
    df = spark.createDataFrame([("a", START, tie(i), i) for i in range(200)], f"node string, ts timestamp, seq {kind}, v long")
    sizes = slices.with_slices(df, ["node"], max_rows=20).groupBy(*slices.slice_group(["node"])).count()
    assert sizes.agg({"count": "max"}).first()[0] <= 20
    rows = slices.running_before(df, ["node"], {"s": ("sum", "v"), "l": ("last", "v")}, max_rows=20).collect()
    assert all((r.l, r.s) == ((r.v - 1, r.v * (r.v - 1) // 2) if r.v else (None, None)) for r in rows)


def test_running_percentiles_of_many_columns_take_no_more_scans(spark, tmp_path):
    rows = random_rows(4)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "rows"))
    df = counters.operation_deltas(spark.read.parquet(str(tmp_path / "rows")), OPS, keep_slices=True, max_rows=None)
    df = df.withColumns({f"c{i}": F.col("op_latency_us") * (i + 1) for i in range(7)})

    def scans(n: int) -> int:
        out = histogram.running_percentiles(df, {f"p{i}": f"c{i}" for i in range(n)})
        return out._jdf.queryExecution().optimizedPlan().toString().count("Relation [")

    assert scans(7) == scans(1)
    out = histogram.running_percentiles(df, {"a": "op_latency_us", "b": "c0"})
    expected = replay(rows)
    for r in out.collect():
        assert (r.a_p95, r.a_p99) == (r.b_p95, r.b_p99) == expected[(r.node, r.seq)][3:]


def test_overflow_query_has_all_samples_with_their_percentiles(spark, tmp_path):
    """Also those that did not overflow, and those without a node; the totals come with each of them."""
    rows = [(i * 700, START + timedelta(hours=i), i % 3 if i % 10 else None, "view", float(i % 90), "{}") for i in range(1, 150)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    entry = next(e for e in telemetry_catalog.entries() if e.name == "running_percentile_overflow")
    found = entry.run(spark, str(tmp_path)).collect()
    assert len(found) == len(rows) * len(counters.OPERATIONS)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    result = duck.execute(entry.oracle)
    names = [d[0] for d in result.description]
    key = lambda r: (r["node"], r["op"], r["seq"])
    named = [r.asDict() for r in found if r.node is not None]
    expected = [r for r in (dict(zip(names, r, strict=True)) for r in result.fetchall()) if r["node"] is not None]
    assert sorted(named, key=key) == sorted(expected, key=key)
    assert {r.ticks > 0 for r in found} == {True, False}


def test_flags_without_percentiles_are_those_with_them(spark):
    values = [None, 5, 30_000_000, 7, None, 100]
    df = spark.createDataFrame([("n", i * 86_400, i, v) for i, v in enumerate(values)], "node string, ts long, seq long, us long")
    df = df.withColumn("ts", F.timestamp_seconds("ts"))
    flags = histogram.running_percentiles(df, {"a": "us"}, percentiles={}, width=2 * 86_400)
    assert [c for c in flags.columns if c.startswith("a_")] == ["a_overflowed"]
    assert [r.a_overflowed for r in flags.orderBy("seq").collect()] == [False, False, True, True, True, True]

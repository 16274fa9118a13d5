from __future__ import annotations

from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from herdwatch.functions import text
from herdwatch.operators import settings, snapshots
from herdwatch.sources import node_stats, properties, snapshot_store


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def test_property_files(spark, tmp_path):
    (tmp_path / "a.properties").write_text('depot.zone=north\ndepot.noSeparator77\ndepot.label="two words"\ndepot.size = 12\ndepot.none=')
    (tmp_path / "b.properties").write_text("# c\n! c\nx : 1\nx=2\nlong=a,\\\n   b\nspaced value here\n")
    rows = properties.read_properties(spark, str(tmp_path)).collect()
    files = {}
    for r in rows:
        files.setdefault(r.file[-12:], {})[r.k] = r.v
    assert files["a.properties"] == {"depot.zone": "north", "depot.label": '"two words"', "depot.size": "12"}
    assert files["b.properties"] == {"x": "2", "long": "a,b", "spaced": "value here"}


def test_lists(spark):
    assert one(spark, text.split_list(F.col("v")), v="bar,baz, qux ") == ["bar", "baz", "qux"]
    assert one(spark, text.split_list(F.col("v")), v="\tbar ") == ["bar"]
    assert one(spark, text.split_list(F.col("v")), v=None) is None


@pytest.mark.parametrize(
    ("value", "to", "default", "expected"),
    [
        ("12", "int", 5, 12), ("12x", "int", 5, 5), (" 12", "int", 5, 5), ("99999999999", "int", 5, 5),
        ("99999999999", "bigint", 5, 99999999999), ("1.5", "double", 0.0, 1.5), ("x", "float", 2.0, 2.0),
        ("TRUE", "boolean", False, True), ("yes", "boolean", True, False), (None, "boolean", True, True),
        (None, "int", None, None),
    ],
)
def test_typed(spark, value, to, default, expected):
    assert one(spark, text.typed(F.col("v"), to, default), v=value) == expected


def test_layers(spark):
    rows = [(0, "n", "a", None), (1, "n", "a", "one"), (2, "n", "a", "two"), (2, "n", "b", "x"), (0, "m", "b", "y")]
    layers = spark.createDataFrame(rows, "layer int, scope string, k string, v string")
    resolved = settings.resolve_settings(layers)
    assert {tuple(r) for r in resolved.collect()} == {("n", "a", "one"), ("n", "b", "x"), ("m", "b", "y")}
    props = settings.get_props(resolved, ["a", "zz"])
    assert {tuple(r) for r in props.collect()} == {("n", "a", "one"), ("n", "zz", None), ("m", "a", None), ("m", "zz", None)}


def test_overrides_replace_and_skip(spark):
    kv = "scope string, k string, v string"
    base = spark.createDataFrame([("n", "port", "1"), ("n", "name", "x")], kv)
    resolved = spark.createDataFrame([("n", "app.port", "9")], kv)
    extra = spark.createDataFrame([("n", "app.port=port, app.none=name,bad")], "scope string, mapping string")
    out = settings.apply_overrides(base, extra, resolved)
    assert {tuple(r) for r in out.collect()} == {("n", "port", "9"), ("n", "name", "x")}


def test_tribe_ids(spark):
    assert one(spark, settings.tribe_id(F.col("v")), v="zone.i-1/t3") == "t3"
    assert one(spark, settings.tribe_id(F.col("v")), v="zone.i-1") is None


def test_one_cluster_of_many_tribe_nodes_is_spread(spark, monkeypatch):
    """Blocks of nodes meet blocks of instances, each pair of rows once; repeated rows stay, null clusters meet nothing."""
    monkeypatch.setattr(settings, "NODES", 10)
    monkeypatch.setattr(settings, "INSTANCES", 20)
    apps = ["big"] * 34 + ["small", "none", None]
    config = [(f"i{n}", "tribe.t1.cluster.name", app) for n, app in enumerate(apps)]
    nodes = [(f"i{n}", f"i{n}/t1") for n in range(len(apps))] + [("i0", "i0/t1"), ("i1", "i1"), ("i2", "i2/t7")]
    members = [("big", f"m{n}") for n in range(90)] + [("big", "m0"), ("big", None), ("small", "s"), (None, "x")]
    frame = lambda rows, names: spark.createDataFrame(rows, names).coalesce(1)
    out = settings.tribe_nodes(
        frame(config, "scope string, k string, v string"),
        frame(members, "app string, instance_id string"),
        frame(nodes, "scope string, node_name string"),
    )
    found = Counter((r.node_name, r.tribe_id, r.app, r.instance_id) for r in out.collect())
    by_scope = {scope: app for scope, _, app in config}
    asked = [(scope, name) for scope, name in nodes if name.endswith("/t1")]
    expected = Counter((name, "t1", app, m) for scope, name in asked for app, m in members if app and app == by_scope[scope])
    assert found == expected
    assert out.select(F.spark_partition_id()).distinct().count() > 4


@pytest.mark.parametrize(
    ("spec", "expected"),
    [
        (None, "abc"), (" ", "abc"), ("_ALL", "abc"), ("a", "a"), ("a,b", "ab"), ("*,-b", "ac"), ("-b", "ac"),
        ("a.b", ""), ("?", ""),
    ],
)
def test_selection(spark, spec, expected):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    assert "".join(sorted(r.name for r in snapshots.select_datasets(df, spec).collect())) == expected


def test_snapshot_names(spark):
    at = datetime(2024, 2, 3, 4, 5)
    name = lambda i, v: one(spark, snapshots.snapshot_name(F.col("v"), F.lit(i), at), v=v)
    assert name(True, "ALL") == "all_202402030405"
    assert name(True, "_all") == "_all_202402030405"
    assert name(True, "a,b") == "a_b_202402030405"
    assert name(False, "a,b") == "202402030405"


def test_write_change_restore(spark, tmp_path):
    rows = [(name, i) for name in ("x", "y") for i in range(100)]
    df = spark.createDataFrame(rows, "name string, v long")
    entry = snapshot_store.write_snapshot(df, str(tmp_path), "repo", "s1", "x,y", "2024-01-01 00:00:00")
    assert {(r.dataset, r.row_count) for r in entry.collect()} == {("x", 100), ("y", 100)}
    left = df.filter("v % 2 = 0")
    assert left.groupBy("name").count().agg(F.max("count")).first()[0] == 50
    back = snapshot_store.restore_snapshot(spark, str(tmp_path), "repo", "s1")
    assert {tuple(r) for r in back.groupBy("name").count().collect()} == {("x", 100), ("y", 100)}
    renamed = snapshot_store.restore_snapshot(spark, str(tmp_path), "repo", "s1", "x", "^(.*)$", "old-$1")
    assert {tuple(r) for r in renamed.groupBy("name").count().collect()} == {("old-x", 100)}
    snapshot_store.write_snapshot(df, str(tmp_path), "repo", "s2", "x")
    catalog = snapshot_store.read_catalog(spark, str(tmp_path))
    assert {r.snapshot for r in snapshots.list_snapshots(catalog, "repo").collect()} == {"s1", "s2"}
    assert snapshots.latest_snapshot(catalog.select("repo", "snapshot")).first().snapshot == "s2"


def test_a_broken_restore_leaves_nothing_and_a_repeat_changes_nothing(spark, tmp_path, monkeypatch):
    root, target = str(tmp_path / "root"), str(tmp_path / "target")
    df = spark.createDataFrame([("x", i) for i in range(50)] + [("y", i) for i in range(30)], "name string, v long")
    snapshot_store.write_snapshot(df, root, "r", "s")
    with pytest.raises(ValueError, match="nothing"):
        snapshot_store.read_restored(spark, target)
    snapshot_store.restore_into(spark, root, "r", "s", target, "x")

    def broken(self, name):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:  # rows are staged, the manifest is not written
        m.setattr("pyspark.sql.classic.dataframe.DataFrame.coalesce", broken)
        with pytest.raises(RuntimeError, match="lost"):
            snapshot_store.restore_into(spark, root, "r", "s", target, "y")
    assert {tuple(r) for r in snapshot_store.read_restored(spark, target).groupBy("name").count().collect()} == {("x", 50)}
    for _ in range(2):
        done = snapshot_store.restore_into(spark, root, "r", "s", target, "y")
        assert [(r.repo, r.snapshot, r.name, r.row_count) for r in done.collect()] == [("r", "s", "y", 30)]
    assert {tuple(r) for r in snapshot_store.read_restored(spark, target).groupBy("name").count().collect()} == {("x", 50), ("y", 30)}
    with pytest.raises(ValueError, match="x"):
        snapshot_store.restore_into(spark, root, "r", "s", target)
    assert snapshot_store.read_manifest(spark, target).count() == 2


ESCAPES = {
    "a=b\\\\\nc=d": {"a": "b\\", "c": "d"}, "a=b\\\\\\\n  c": {"a": "b\\c"}, "# x\\\na=1": {"a": "1"}, "a=b\\\n# c": {"a": "b# c"},
    "a\\ b\\:c = d\\te": {"a b:c": "d\te"}, "\\u0061=\\u00e9\\u00E9x": {"a": "\u00e9\u00e9x"}, "a=\\ud83d\\ude00\\ud83d": {"a": "\U0001f600\ufffd"},
    "a=\\\\u0041": {"a": "\\u0041"}, "a=\\u00g": {"a": "u00g"}, "a=x\\": {"a": "x"}, "a=1\rb=2\r\nc=3\n\r\n": {"a": "1", "b": "2", "c": "3"},
    "a=b\\\n\nc=1": {"a": "b", "c": "1"}, "  \t\n ! z\n a  b c ": {"a": "b c "}, "a==b": {"a": "=b"}, "": {}, "=x": {"": "x"}, "a:": {},
    "long=" + "x\\\n" * 3000 + "y": {"long": "x" * 3000 + "y"},
}


def test_logical_lines_and_escapes(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ESCAPES)] + [(99, None)], "i int, t string")
    got = {i: {} for i in range(len(ESCAPES))}
    for r in properties.parse_properties(df, "t").collect():
        got[r.i][r.k] = r.v
    assert [got[i] for i in range(len(ESCAPES))] == list(ESCAPES.values())


def test_many_chosen_datasets_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshot_store, "PUSHED_NAMES", 3)
    df = spark.createDataFrame([(f"d{i}", i) for i in range(20)], "name string, v long")
    snapshot_store.write_snapshot(df, str(tmp_path), "r", "s")
    assert snapshot_store.restore_snapshot(spark, str(tmp_path), "r", "s", "d1*").count() == 11


def test_missing_datasets(spark, tmp_path):
    df = spark.createDataFrame([("x", 1)], "name string, v long")
    with pytest.raises(ValueError, match="missing"):
        snapshot_store.write_snapshot(df, str(tmp_path), "r", "s", "x,zz")
    assert snapshot_store.write_snapshot(df, str(tmp_path), "r", "s", "x,zz", partial=True).count() == 1


def test_node_stats_files_and_sink(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(
        '{"node":"n","ts":"2024-01-01T00:00:00Z","seq":1,"up":true,"fs":{"total":10,"free":4,"available":3},"other":1}\n'
    )
    df = node_stats.read_node_stats(spark, str(tmp_path / "in"), "json")
    assert (df.first().fs.available, df.first().jvm) == (3, None)
    node_stats.write_metrics(df.select("node", "ts", "seq"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).first().day.isoformat() == "2024-01-01"


def test_bad_json_samples_are_told_apart(spark):
    df = spark.createDataFrame([('{"node":"n","seq":1}',), ("{oops",), ("{}",)], "j string")
    got = {(r.node, r.error, r.raw) for r in node_stats.parse_node_stats(df, "j").collect()}
    assert got == {("n", None, None), (None, "bad json", "{oops"), (None, "no node", "{}")}

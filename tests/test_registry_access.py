from __future__ import annotations

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from herdwatch.functions import text
from herdwatch.operators import access, registry

ROW = "app string, id string, instance_id string, availability_zone string, public_ip string, host_name string, dc string, asg string, update_time long"


def instance(n: int, app="c", asg="g", zone="z", dc="d", time=1):
    return (app, f"{dc}.i{n}", f"i{n}", zone, f"10.0.0.{n}", f"h{n}", dc, asg, time)


@pytest.mark.parametrize(
    ("flags", "unknown"),
    [
        ({}, "dead: unknown group"),
        ({"multi_dc": True}, "skipped: several locations"),
        ({"tribe_source": True}, "skipped: tribe source"),
    ],
)
def test_every_branch_of_the_dead_instance_rule(spark, flags, unknown):
    known = spark.createDataFrame(
        [
            instance(1),
            instance(2),
            instance(3, asg="other"),
            instance(4, zone="y"),
            instance(5, asg="gone"),
            instance(6, asg=None),
            instance(7, asg="empty"),
        ],
        ROW,
    )
    members = spark.createDataFrame(
        [("g", "i1", "InService"), ("g", "i2", "Terminating"), ("other", "i9", "InService"), ("empty", "i7", "TERMINATED")],
        "asg string, instance_id string, state string",
    )
    out = registry.classify_instances(known, members, "g", "z", **flags)
    assert {r.instance_id: r.reason for r in out.collect()} == {
        "i1": "skipped: live",
        "i2": "dead: not in its group",
        "i3": "skipped: other group",
        "i4": "skipped: other zone",
        "i5": unknown,
        "i6": unknown,
        "i7": "skipped: other group",
    }


def test_listing_equals_the_expected_document(spark):
    df = spark.createDataFrame([instance(1, zone="b"), instance(0, zone="a")], ROW)
    rows = registry.instances_to_json(df).collect()
    assert len(rows) == 1
    listing = json.loads(rows[0].listing)["instances"]
    assert list(listing) == ["instance-0", "instance-1"]
    assert listing["instance-0"] == {
        "host_name": "h0", "id": "d.i0", "app_name": "c", "instance_id": "i0", "availability_zone": "a",
        "public_ip": "10.0.0.0", "dc": "d", "update_time": 1,
    }


def test_large_listings_are_split_and_come_back_whole(spark):
    df = spark.createDataFrame([instance(n) for n in range(500)] + [instance(n, app="small") for n in range(3)], ROW)
    pages = registry.instances_to_json(df, pages=13)
    assert pages.filter("app = 'small'").count() <= 3
    assert pages.filter("app = 'c'").count() == 13
    back = registry.instances_from_json(pages.select("listing"), "listing")
    assert back.count() == 503
    assert back.select("app", "id").exceptAll(df.select("app", "id")).count() == 0


def test_upsert_is_idempotent(spark):
    current = spark.createDataFrame([instance(1, time=5), instance(2, time=5)], ROW)
    incoming = spark.createDataFrame([instance(1, zone="new", time=5), instance(2, zone="old", time=4), instance(3)], ROW)
    once = registry.upsert_instances(current, incoming)
    twice = registry.upsert_instances(once, incoming)
    zones = lambda df: {r.instance_id: r.availability_zone for r in df.collect()}
    assert zones(once) == zones(twice) == {"i1": "new", "i2": "z", "i3": "z"}
    assert registry.delete_instances(once, incoming).count() == 0


def test_newest_cell_counts(spark):
    cells = [("k", "cluster", "c", 7), ("k", "cluster", "old", 3), ("k", "location", "d", 9), ("k", "instanceId", "i1", 9)]
    r = registry.cells_to_instances(spark.createDataFrame(cells, "row_key string, col string, value string, write_ts long")).first()
    assert (r.app, r.id, r.update_time) == ("c", "d.i1", 7)


def test_cells_are_dealt_to_even_parts_before_they_are_sorted(spark):
    """Also many writes of one key, and one write that is stored many times."""
    names = ["cluster", "location", "instanceId"]
    often = [("hot", c, f"{c}{t}", t) for t in range(500) for c in names]
    same = [("same", c, c, 5) for c in names] * 300
    cells = spark.createDataFrame(often + same, "row_key string, col string, value string, write_ts long").coalesce(1)
    out = registry.cells_to_instances(cells)
    plan = out._jdf.queryExecution().executedPlan().toString()
    first_aggregate = plan[plan.rindex("SortAggregate") :]
    assert "REBALANCE_PARTITIONS_BY_COL" in first_aggregate and first_aggregate.index("Sort [") < first_aggregate.index("Exchange")
    found = {r.row_key: (r.app, r.id, r.host_name, r.update_time) for r in out.collect()}
    assert found == {"hot": ("cluster499", "location499.instanceId499", None, 499), "same": ("cluster", "location.instanceId", None, 5)}


@pytest.mark.parametrize(
    ("answer", "leads"),
    [("10.0.0.1", True), ("  10.0.0.1 ", True), ("HOST", True), ("10.0.0.2", False), (None, False), ("", False)],
)
def test_leader(spark, answer, leads):
    df = spark.createDataFrame([(answer, "host", "10.0.0.1")], "answer string, host string, ip string")
    assert df.select(registry.leader_flag(F.col("answer"), F.col("host"), F.col("ip"))).first()[0] is leads


def test_master_info(spark):
    doc = '[{"id":"a","host":"h","ip":"1.2.3.4","node":"n"}]'
    r = registry.parse_master_info(spark.createDataFrame([(doc,)], "doc string"), "doc").first()
    assert tuple(r) == ("a", "h", "1.2.3.4", "n")


def test_repeated_clusters(spark):
    df = spark.createDataFrame([instance(1, app="a"), instance(1, app="b")], ROW)
    assert registry.federated_instances(df, "a", "b=1, b=2").count() == 2
    assert registry.federated_instances(df, "a", "b=1, b=2", repeats=True).count() == 3


RULES = "from_port int, to_port int, cidr string, rule_order long"


def test_rule_diff(spark):
    nodes = spark.createDataFrame([instance(1), instance(2)], ROW)
    rules = spark.createDataFrame(
        [(1, 1, "10.0.0.1/32", 1), (1, 1, "9.9.9.9/32", 2), (1, 2, "10.0.0.2/32", 3), (2, 2, "8.8.8.8/32", 4)], RULES
    )
    rows = lambda df: sorted((r.cidr, r.from_port, r.to_port) for r in df.collect())
    assert rows(access.acl_to_add(nodes, rules, 1, 2)) == [("10.0.0.2/32", 1, 1), ("10.0.0.2/32", 2, 2)]
    assert rows(access.acl_to_remove(nodes, rules, 1, 2)) == [("9.9.9.9/32", 1, 1), ("9.9.9.9/32", 2, 2)]
    assert rows(access.acl_to_add(nodes, rules, 1, 2, per_port=True)) == [
        ("10.0.0.1/32", 2, 2), ("10.0.0.2/32", 1, 1), ("10.0.0.2/32", 2, 2),
    ]
    assert rows(access.acl_to_remove(nodes, rules, 1, 2, per_port=True)) == [("8.8.8.8/32", 2, 2), ("9.9.9.9/32", 1, 1)]


def test_tribe_plan(spark):
    nodes = [instance(1, app="a"), instance(2, app="es_tribe_x"), instance(3, app="a"), instance(3, app="es_tribe_x", time=2)]
    nodes += [instance(4, app="unmapped"), instance(5, app="a")]
    rules = [(1, 1, "10.0.0.5/32", 1), (2, 2, "9.9.9.9/32", 2), (7, 9, "9.9.9.9/32", 3)]
    plan = access.tribe_acl_plan(
        spark.createDataFrame(nodes, ROW), spark.createDataFrame(rules, RULES), {"a": 1, "es_tribe_x": 2}
    )
    got = {(r.action, r.app, r.cidr, r.from_port, r.to_port) for r in plan.collect()}
    assert got == {
        ("add", "a", "10.0.0.1/32", 1, 1),
        ("add", "es_tribe_x", "10.0.0.2/32", 1, 1),
        ("add", "es_tribe_x", "10.0.0.2/32", 2, 2),
        ("add", "es_tribe_x", "10.0.0.3/32", 1, 1),
        ("add", "es_tribe_x", "10.0.0.3/32", 2, 2),
        ("remove", None, "9.9.9.9/32", 7, 9),
    }


@pytest.mark.parametrize(
    ("ip", "mask", "action", "cidr"),
    [
        ("10.0.0.1", None, "add", "10.0.0.1/32"),
        ("10.0.0.1", 7, "add", "10.0.0.1/32"),
        ("10.0.0.1", 7, "remove", "10.0.0.1/7"),
        ("10.0.0.1", 24, "add", "10.0.0.1/24"),
        ("10.0.0.256", 24, "add", None),
        ("10.0.0", 24, "add", None),
        (None, 24, "add", None),
        ("2001:db8::1", None, "add", "2001:db8::1/128"),
        ("fe80:0:0:0:1:2:3:4", 64, "add", "fe80:0:0:0:1:2:3:4/64"),
        ("::", 16, "remove", "::/16"),
        ("::ffff:10.0.0.1", None, "add", "::ffff:10.0.0.1/128"),
        ("1:2:3:4:5:6:7", None, "add", None),
        ("1::2::3", None, "add", None),
        ("1:2:3:4:5:6:7::8", None, "add", None),
        ("12345::", None, "add", None),
        ("::g", None, "add", None),
    ],
)
def test_requests(spark, ip, mask, action, cidr):
    r = access.normalize_cidr(spark.createDataFrame([(ip, mask, action)], "ip string, mask int, action string")).first()
    assert (r.cidr, r.error) == (cidr, None if cidr else "invalid address")


def test_missing_group_is_an_error(spark):
    groups = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y")], "group_name string, position int, group_id string")
    assert access.pick_group(groups, "a").first().group_id == "y"
    with pytest.raises(PySparkException, match="no group named b"):
        access.pick_group(groups, "b").collect()


def test_host_names(spark):
    df = spark.createDataFrame([("ec2-1-2-3-4-x.y",), ("plain",)], "h string")
    assert [r[0] for r in df.select(text.host_ip(F.col("h"))).collect()] == ["1.2.3.4", None]

"""Catalog entries for access rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from herdwatch.catalog import views
from herdwatch.catalog.base import Entry, on_spark, table, with_views
from herdwatch.operators import access

TRANSPORT, REST = 7102, 7104
PORTS = {"es_asia": 7102, "es_tribe_europe": 7104, "es_africa": 7200}


def rules(spark, sf_dir):
    return on_spark(spark, sf_dir, views.ACL_RULES)


def instances(spark, sf_dir):
    return on_spark(spark, sf_dir, views.REGISTRY)


def _tribe_instances(spark, sf_dir):
    """The European cluster plays the tribe cluster."""
    return instances(spark, sf_dir).withColumn("app", F.replace("app", F.lit("es_europe"), F.lit("es_tribe_europe")))


def _oracle(body: str, **more: str) -> str:
    return with_views(body, registry=views.REGISTRY, rules=views.ACL_RULES, **more)


DESIRED = "select distinct public_ip || '/32' as cidr from registry"
PRESENT = f"select distinct cidr from rules where from_port = {TRANSPORT} and to_port = {TRANSPORT}"
ON_BOTH = f"(values ({TRANSPORT}, {TRANSPORT}), ({REST}, {REST})) as p(from_port, to_port)"
LAST_PORTS = "select cidr, from_port, to_port from rules qualify row_number() over (partition by cidr order by rule_order desc, from_port desc) = 1"
OWNED = (
    "select replace(app, 'es_europe', 'es_tribe_europe') as app, public_ip || '/32' as cidr from registry where app in ('es_asia', 'es_europe', 'es_africa') "
    "qualify row_number() over (partition by public_ip order by update_time desc, id desc) = 1"
)
TRIBE_PRESENT = "select distinct cidr from rules where from_port = to_port and from_port in (7102, 7104, 7200)"


def _nested(spark, sf_dir):
    """Rules as a cloud lists them: several ranges each."""
    second = F.concat(F.lit("10.99."), (F.col("rule_order") % 250).cast("string"), F.lit(".1/32"))
    return rules(spark, sf_dir).select("from_port", "to_port", "rule_order", F.array("cidr", second).alias("ranges"))


def _requests(spark, sf_dir):
    k = F.col("c_custkey")
    ip = (
        F.when(k % 5 == 0, F.concat(F.lit("10.1.2."), (k % 300).cast("string")))
        .when(k % 5 == 1, F.lit("10.01.2.3"))
        .when(k % 5 == 2, F.concat(F.lit("host"), k.cast("string")))
        .when(k % 5 == 3, F.concat(F.lit("2001:db8::"), (k % 1000).cast("string")))
        .otherwise(F.concat(F.lit("192.168.7."), (k % 256).cast("string")))
    )
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        ip.alias("ip"),
        F.when(k % 4 != 0, (k % 33).cast("int")).alias("mask"),
        F.when(k % 2 == 0, "add").otherwise("remove").alias("action"),
    )


def _groups(spark, sf_dir):
    return rules(spark, sf_dir).groupBy("group_name").agg(
        F.count(F.lit(1)).alias("n"), F.min("rule_order").alias("position")
    )


def _diff(op, **more):
    return lambda s, d: op(instances(s, d), rules(s, d), TRANSPORT, REST, **more)


def entries() -> list[Entry]:
    missing = "cidr not in (select cidr from present)"
    stale = "cidr not in (select cidr from desired)"
    exact = f"select distinct cidr, from_port, to_port from rules where from_port = to_port and from_port in ({TRANSPORT}, {REST})"
    return [
        Entry(
            "acl_ranges",
            lambda s, d: access.acl_ranges(access.flatten_rules(_nested(s, d)), TRANSPORT),
            _oracle(
                "select cidr from rules where from_port = 7102 and to_port = 7102 union all "
                "select '10.99.' || rule_order % 250 || '.1/32' from rules where from_port = 7102 and to_port = 7102"
            ),
        ),
        Entry("desired_ranges", lambda s, d: access.desired_ranges(instances(s, d)), _oracle(DESIRED)),
        Entry(
            "acl_to_add",
            _diff(access.acl_to_add),
            _oracle(f"select * from desired, {ON_BOTH} where {missing}", desired=DESIRED, present=PRESENT),
        ),
        Entry(
            "acl_to_remove",
            _diff(access.acl_to_remove),
            _oracle(f"select * from present, {ON_BOTH} where {stale}", desired=DESIRED, present=PRESENT),
        ),
        Entry(
            "acl_to_add_per_port",
            _diff(access.acl_to_add, per_port=True),
            _oracle(f"select * from desired, {ON_BOTH} except select * from exact", desired=DESIRED, exact=exact),
        ),
        Entry(
            "acl_to_remove_per_port",
            _diff(access.acl_to_remove, per_port=True),
            _oracle(f"select * from exact where {stale}", desired=DESIRED, exact=exact),
        ),
        Entry(
            "tribe_acl_plan",
            lambda s, d: access.tribe_acl_plan(_tribe_instances(s, d), rules(s, d), PORTS),
            _oracle(
                "select 'add' as action, app, cidr, port as from_port, port as to_port from owned, "
                "(values ('es_asia', 7102), ('es_tribe_europe', 7102), ('es_tribe_europe', 7104), ('es_tribe_europe', 7200), ('es_africa', 7200)) as p(owner, port) "
                f"where owner = app and {missing} union all "
                "select 'remove', null, cidr, from_port, to_port from last where cidr in (select cidr from present) and cidr not in (select cidr from owned)",
                owned=OWNED,
                present=TRIBE_PRESENT,
                last=LAST_PORTS,
            ),
        ),
        Entry(
            "normalize_cidr",
            lambda s, d: access.normalize_cidr(_requests(s, d)),
            "select * exclude (ok), case when ok then ip || '/' || case when mask is null or (action = 'add' and mask < 8) then case when c_custkey % 5 = 3 then 128 else 32 end else mask end end as cidr, "
            "case when not ok then 'invalid address' end as error from ("
            "select *, case when c_custkey % 5 = 0 then c_custkey % 300 < 256 when c_custkey % 5 in (1, 2) then false else true end as ok from ("
            "select c_custkey, case when c_custkey % 5 = 0 then '10.1.2.' || c_custkey % 300 when c_custkey % 5 = 1 then '10.01.2.3' "
            "when c_custkey % 5 = 2 then 'host' || c_custkey when c_custkey % 5 = 3 then '2001:db8::' || c_custkey % 1000 else '192.168.7.' || c_custkey % 256 end as ip, "
            "cast(case when c_custkey % 4 <> 0 then c_custkey % 33 end as int) as mask, case when c_custkey % 2 = 0 then 'add' else 'remove' end as action from customer) as a) as b",
        ),
        Entry(
            "acl_ports",
            lambda s, d: access.acl_ports(rules(s, d), rules(s, d).select(F.upper("cidr").alias("cidr"))),
            _oracle("select * from last", last=LAST_PORTS),
        ),
        Entry(
            "pick_group",
            lambda s, d: access.pick_group(_groups(s, d), "sg_1"),
            _oracle("select group_name, count(*) as n, min(rule_order) as position from rules where group_name = 'sg_1' group by group_name"),
        ),
    ]

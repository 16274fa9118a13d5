"""Catalog entries for the node registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from herdwatch.catalog import views
from herdwatch.catalog.base import Entry, on_spark, table, with_views
from herdwatch.operators import registry

COLUMNS = "app, id, instance_id, availability_zone, public_ip, host_name, dc, asg, update_time"
ASG, ZONE = "nation_3-data", "NATION_3"


def instances(spark, sf_dir):
    return on_spark(spark, sf_dir, views.REGISTRY)


def membership(spark, sf_dir):
    return on_spark(spark, sf_dir, views.MEMBERSHIP)


def _oracle(body: str, **more: str) -> str:
    return with_views(body, registry=views.REGISTRY, membership=views.MEMBERSHIP, **more)


def _columns(df):
    return df.select(*(c.strip() for c in COLUMNS.split(",")))


# Re-registrations: every third instance comes back, some with an older, some with a newer write.
def _incoming(spark, sf_dir):
    key = F.col("update_time") / 1000
    again = instances(spark, sf_dir).filter(F.col("update_time") % 3000 == 0)
    shift = F.when(key % 2 == 0, 500).otherwise(-500)
    return again.withColumns({"update_time": F.col("update_time") + shift, "public_ip": F.concat(F.lit("n"), "public_ip")})


INCOMING = (
    "select * replace (update_time + case when (update_time // 1000) % 2 = 0 then 500 else -500 end as update_time, "
    "'n' || public_ip as public_ip) from registry where update_time % 3000 = 0"
)
LIVE = "select distinct asg, instance_id from membership where lower(state) not in ('terminating', 'shutting-down', 'terminated')"
REASON = f"""case when asg not in (select asg from membership) then '{{unknown}}' when asg <> '{ASG}' then 'skipped: other group'
  when availability_zone <> '{ZONE}' then 'skipped: other zone'
  when (asg, instance_id) in (select (asg, instance_id) from live) then 'skipped: live' else 'dead: not in its group' end"""


def _classified(**flags):
    return lambda s, d: registry.classify_instances(instances(s, d), membership(s, d), ASG, ZONE, **flags).select(
        "instance_id", "asg", "reason"
    )


def _dead_oracle(unknown: str) -> str:
    return _oracle(f"select instance_id, asg, {REASON.format(unknown=unknown)} as reason from registry", live=LIVE)


def _after_delete(spark, sf_dir):
    all_rows = instances(spark, sf_dir)
    classified = registry.classify_instances(all_rows, membership(spark, sf_dir), ASG, ZONE)
    return _columns(registry.delete_instances(all_rows, classified.filter("reason LIKE 'dead%'")))


def _json_round_trip(spark, sf_dir):
    listings = registry.instances_to_json(instances(spark, sf_dir), pages=16)
    back = registry.instances_from_json(listings.select("listing"), "listing")
    return back.select("app", "id", "instance_id", "availability_zone", "public_ip", "host_name", "dc", "update_time")


def _json_gap(spark, sf_dir):
    """Per customer a listing with entries 0, 1 and 3: the gap-sensitive reader sees two of them."""
    text = "'{\"instances\":{' || array_join(transform(array(3, 0, 1), i -> '\"instance-' || i || '\":{\"id\":\"' || c_custkey || '-' || i || '\",\"update_time\":' || c_custkey || '}'), ',') || '}}'"
    listings = table(spark, sf_dir, "customer").select("c_custkey", F.expr(text).alias("listing"))
    strict = registry.instances_from_json(listings, "listing").withColumn("reader", F.lit("strict"))
    full = registry.instances_from_json(listings, "listing", stop_at_gap=False).withColumn("reader", F.lit("all"))
    return strict.unionByName(full).select("c_custkey", "reader", "id", "update_time")


GROUPS = "select asg, availability_zone as zone, cast(1 + update_time // 1000 % 4 as bigint) as max_size from registry"
MASTERS = "select c_custkey, '[{{\"id\":\"m' || c_custkey || '\",\"host\":\"h' || c_nationkey || '\",\"ip\":\"10.0.0.' || c_custkey % 250 || '\",\"node\":\"n1\",\"x\":1}},{{\"id\":\"s' || c_custkey || '\"}}]' as info from {customer}"


def _groups(spark, sf_dir):
    df = instances(spark, sf_dir)
    size = (1 + F.floor(F.col("update_time") / 1000) % 4).cast("bigint")
    return df.select("asg", F.col("availability_zone").alias("zone"), size.alias("max_size"))


def _hosts(spark, sf_dir):
    return instances(spark, sf_dir).withColumn("status", F.when(F.col("update_time") % 4000 == 0, "DOWN").otherwise("UP"))


def _leaders(spark, sf_dir):
    n = F.col("update_time") / 1000 % 5
    answer = (
        F.when(n == 0, F.concat(F.lit("  "), F.upper("host_name"), F.lit(" ")))
        .when(n == 1, F.col("public_ip"))
        .when(n == 2, F.lit("elsewhere"))
        .when(n == 3, F.lit("  "))
    )
    df = instances(spark, sf_dir).withColumn("answer", answer).withColumn("dedicated", F.col("update_time") % 2000 == 0)
    return df.select(
        "instance_id",
        registry.leader_flag(F.col("answer"), F.col("host_name"), F.col("public_ip")).alias("leads"),
        registry.can_lead(F.col("dedicated"), F.col("asg")).alias("can_lead"),
    )


def _identity(spark, sf_dir):
    n = F.col("update_time") / 1000 % 3
    df = instances(spark, sf_dir).withColumns(
        {"region": F.when(n == 0, F.col("dc")).otherwise(F.lit(" ")), "env_region": F.when(n == 1, F.lower("dc"))}
    )
    return registry.with_identity(df).select("id", "region", "node_name")


def entries() -> list[Entry]:
    zone_rows = lambda s, d: table(s, d, "nation").select(
        F.col("n_name").alias("zone"), F.col("n_nationkey").alias("position"),
        F.when(F.col("n_nationkey") % 3 == 0, "impaired").otherwise("available").alias("state"),
    )
    return [
        Entry(
            "cluster_instances",
            lambda s, d: _columns(registry.instances(instances(s, d), "es_asia", "ASIA")),
            _oracle(f"select {COLUMNS} from registry where app = 'es_asia' and dc = 'ASIA'"),
        ),
        Entry(
            "cells_to_instances",
            lambda s, d: _columns(registry.cells_to_instances(registry.to_cells(instances(s, d)))),
            _oracle(f"select {COLUMNS} from registry"),
        ),
        Entry(
            "find_instance",
            lambda s, d: _columns(registry.find_instance(instances(s, d), "es_asia", "i-00000007", "ASIA").unionByName(
                registry.find_instance(instances(s, d), "es_europe", "i-00000007", "EUROPE")
            ).unionByName(registry.find_instance(instances(s, d), "es_america", "i-00000007", "AMERICA")).unionByName(
                registry.find_instance(instances(s, d), "es_africa", "i-00000007", "AFRICA")
            ).unionByName(registry.find_instance(instances(s, d), "es_middle east", "i-00000007", "MIDDLE EAST"))),
            _oracle(f"select {COLUMNS} from registry where instance_id = 'i-00000007'"),
        ),
        Entry(
            "upsert_instances",
            lambda s, d: _columns(registry.upsert_instances(instances(s, d), _incoming(s, d))),
            _oracle(
                f"select {COLUMNS} from (select * from registry union all select * from incoming) as b "
                "qualify row_number() over (partition by app, dc, instance_id order by update_time desc) = 1",
                incoming=INCOMING,
            ),
        ),
        Entry(
            "instances_json_round_trip",
            _json_round_trip,
            _oracle("select app, id, instance_id, availability_zone, public_ip, host_name, dc, update_time from registry"),
        ),
        Entry(
            "instances_json_gap",
            _json_gap,
            "select c_custkey, r.reader, c_custkey || '-' || r.i as id, c_custkey as update_time from customer, "
            "(values ('strict', 0), ('strict', 1), ('all', 0), ('all', 1), ('all', 3)) as r(reader, i)",
        ),
        Entry(
            "sort_instances",
            lambda s, d: registry.sort_instances(instances(s, d)).select("availability_zone", "id"),
            _oracle("select availability_zone, id from registry order by availability_zone, id"),
        ),
        Entry("live_members", lambda s, d: registry.live_members(membership(s, d)), _oracle("select * from live", live=LIVE)),
        Entry(
            "group_sizes",
            lambda s, d: registry.group_sizes(membership(s, d)),
            _oracle(
                "select m.asg, (select count(*) from live as l where l.asg = m.asg) as live from (select distinct asg from membership) as m",
                live=LIVE,
            ),
        ),
        Entry("known_groups", lambda s, d: registry.known_groups(instances(s, d)), _oracle("select distinct asg from registry")),
        Entry("classify_instances", _classified(), _dead_oracle("dead: unknown group")),
        Entry("classify_instances_multi_dc", _classified(multi_dc=True), _dead_oracle("skipped: several locations")),
        Entry("classify_instances_tribe", _classified(tribe_source=True), _dead_oracle("skipped: tribe source")),
        Entry(
            "delete_instances",
            _after_delete,
            _oracle(
                f"select {COLUMNS} from (select *, {REASON.format(unknown='dead: unknown group')} as reason from registry) as r where reason not like 'dead%'",
                live=LIVE,
            ),
        ),
        Entry(
            "capacity",
            lambda s, d: registry.capacity(_groups(s, d)),
            _oracle("select asg, cast(sum(max_size) as bigint) as max_size, count(distinct zone) as zones from g group by asg", g=GROUPS),
        ),
        Entry(
            "federated_instances",
            lambda s, d: registry.federated_instances(
                instances(s, d), "es_asia", "es_europe=9200, es_africa=9300,es_europe=9400", repeats=True
            ).select("app", "id"),
            _oracle(
                "select app, id from registry where app in ('es_asia', 'es_europe', 'es_africa') union all "
                "select app, id from registry where app = 'es_europe'"
            ),
        ),
        Entry(
            "cluster_instances_by_name",
            lambda s, d: registry.cluster_instances(instances(s, d), " ES_Asia ").select("id"),
            _oracle("select id from registry where app = 'es_asia'"),
        ),
        Entry(
            "up_hosts",
            lambda s, d: registry.up_hosts(_hosts(s, d)).select("id", "host_name", "alternate_ip"),
            _oracle(
                "select id, host_name, array_to_string(string_split(string_split(host_name, '.')[1], '-')[2:5], '.') as alternate_ip "
                "from registry where update_time % 4000 <> 0"
            ),
        ),
        Entry(
            "default_zones",
            lambda s, d: registry.default_zones(zone_rows(s, d)).select("zone"),
            "select n_name as zone from nation where n_nationkey % 3 <> 0 order by n_nationkey limit 3",
        ),
        Entry(
            "leader_and_role",
            _leaders,
            _oracle(
                "select instance_id, (update_time // 1000) % 5 in (0, 1) as leads, update_time % 2000 <> 0 or asg like '%master%' as can_lead from registry"
            ),
        ),
        Entry(
            "parse_master_info",
            lambda s, d: registry.parse_master_info(on_spark(s, d, MASTERS), "info"),
            "select c_custkey, 'm' || c_custkey as id, 'h' || c_nationkey as host, '10.0.0.' || c_custkey % 250 as ip, 'n1' as node from customer "
            "union all select c_custkey, 's' || c_custkey, null, null, null from customer",
        ),
        Entry(
            "identity_defaults",
            _identity,
            _oracle(
                "select id, case (update_time // 1000) % 3 when 0 then dc when 1 then lower(dc) else substr(availability_zone, 1, length(availability_zone) - 1) end as region, "
                "availability_zone || '.' || instance_id as node_name from registry"
            ),
        ),
    ]

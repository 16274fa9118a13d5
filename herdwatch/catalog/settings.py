"""Catalog entries for settings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from herdwatch.catalog import views
from herdwatch.catalog.base import Entry, on_spark, table, with_views
from herdwatch.functions import text
from herdwatch.operators import settings
from herdwatch.session import shared_dir
from herdwatch.sources.properties import read_properties

PREFIX = "app."
RESOLVED = "select scope, k, arg_min(v, layer) as v from layers where v is not null group by scope, k"


def layers(spark, sf_dir):
    return on_spark(spark, sf_dir, views.SETTINGS_LAYERS)


def resolved(spark, sf_dir):
    return settings.resolve_settings(layers(spark, sf_dir))


def _oracle(body: str, **more: str) -> str:
    return with_views(body, layers=views.SETTINGS_LAYERS, resolved=RESOLVED, **more)


def _customers(spark, sf_dir):
    scope = F.concat(F.lit("i-"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))
    return table(spark, sf_dir, "customer").withColumn("scope", scope)


def _property_files(spark, sf_dir):
    """Files of the settings of 500 customers each, read back: comments, bare keys, continued lines (one after
    an escaped backslash is none), repeated keys, escapes in keys and values."""
    key = F.concat(F.lit("\n"), F.col("scope"), F.lit("."))
    body = F.concat(
        F.lit("# settings \\\n! more\n"), key, F.lit("app.name = es_"), F.col("c_custkey").cast("string"),
        key, F.lit("app.bare"), key, F.lit("app.zone:z"), F.col("c_nationkey").cast("string"),
        F.lit("\n  "), F.col("scope"), F.lit(".app.path=/data,\\\n     /logs\r"), key, F.lit("app.port=1"),
        key, F.lit("app.port="), (F.col("c_custkey") % 100).cast("string"), key, F.lit("app.empty="),
        key, F.lit("app.share=a\\:b\\tc\\\\\n"), key, F.lit("app.\\u00e9t\\u00E9\\=x \\u4e2d\\ud83d\\ude00\\!"),
    )
    path = f"{shared_dir(spark)}/catalog-properties-{uuid.uuid4().hex}"
    dealt = _customers(spark, sf_dir).select(body.alias("value"), F.floor(F.col("c_custkey") / 500).alias("part"))
    dealt.repartition("part").write.partitionBy("part").text(path)
    return read_properties(spark, path)


def _properties(spark, sf_dir):
    cut = F.instr("k", ".")
    return _property_files(spark, sf_dir).select(F.substring("k", F.lit(1), cut - 1).alias("scope"), F.substring("k", cut + 1, F.length("k")).alias("k"), "v")


def _typed(spark, sf_dir):
    wide = resolved(spark, sf_dir).filter("k IN ('app.http.port', 'app.multi.dc', 'app.stack')")
    v = F.col("v")
    return wide.select(
        "scope",
        "k",
        text.typed(v, "int", 9200).alias("as_int"),
        text.typed(v, "bigint", -1).alias("as_long"),
        text.typed(v, "double", 0.5).alias("as_double"),
        text.typed(v, "boolean", True).alias("as_boolean"),
        text.typed(v, "enum", "other", ("master", "search")).alias("as_enum"),
    )


def _lists(spark, sf_dir):
    spec = F.concat(F.lit("\tbar,baz, "), F.col("c_mktsegment"), F.lit(" ,,"))
    pairs = F.concat(F.lit(" a=1, b = "), F.col("c_custkey").cast("string"), F.lit(",a=3,,bad,c=,d=4=5"))
    good = text.first_per_key(text.pairs(F.col("p")))
    shown = F.transform(good, lambda e: F.concat_ws("=", e["k"], e["v"]))
    return (
        _customers(spark, sf_dir)
        .select("scope", spec.alias("s"), pairs.alias("p"))
        .select(
            "scope",
            F.array_join(text.split_list(F.col("s")), "|").alias("items"),
            F.array_join(shown, "|").alias("pairs"),
            F.array_join(text.bad_pairs(F.col("p")), "|").alias("bad"),
        )
    )


def _role_input(spark, sf_dir):
    k = F.col("c_custkey")
    stack = F.expr("case c_mktsegment when 'BUILDING' then 'master' when 'MACHINERY' then 'Data' when 'FURNITURE' then 'SEARCH' else 'other' end")
    return _customers(spark, sf_dir).select(
        "scope",
        stack.alias("stack"),
        (k % 4 != 0).alias("dedicated"),
        (k % 3 == 0).alias("multi_dc"),
        F.concat(F.lit("r"), (k % 5).cast("string")).alias("region"),
        F.concat(F.lit("z"), F.col("c_nationkey").cast("string")).alias("availability_zone"),
    )


def _tribe_input(spark, sf_dir):
    k = F.col("c_custkey")
    clusters = F.concat(
        F.lit("es_asia=9"), F.lpad((k % 100).cast("string"), 3, "0"), F.lit(",broken,es_europe="),
        (8000 + k % 3000).cast("string"), F.lit(",es_africa=x1"),
    )
    return _customers(spark, sf_dir).select(
        "scope",
        (9000 + k % 50).cast("int").alias("own_port"),
        clusters.alias("clusters"),
        (k % 2 == 0).alias("write_enabled"),
        (k % 3 == 0).alias("metadata_enabled"),
        F.lit("t0").alias("prefer"),
    )


TRIBE = """
select scope, unnest([
  {{'k': 'tribe.t0.cluster.name', 'v': 'es_asia'}}, {{'k': 'tribe.t0.transport.tcp.port', 'v': cast(p0 as string)}},
  {{'k': 'tribe.t0.discovery.zen.hosts_provider', 'v': 'ec2'}}, {{'k': 'tribe.t0.network.host', 'v': '_global_'}},
  {{'k': 'tribe.t2.cluster.name', 'v': 'es_europe'}}, {{'k': 'tribe.t2.transport.tcp.port', 'v': cast(p2 as string)}},
  {{'k': 'tribe.t2.discovery.zen.hosts_provider', 'v': 'ec2'}}, {{'k': 'tribe.t2.network.host', 'v': '_global_'}},
  {{'k': 'transport.tcp.port', 'v': least(p0, p2, own) || '-' || greatest(p0, p2, own)}},
  {{'k': 'node.master', 'v': 'false'}}, {{'k': 'node.data', 'v': 'false'}},
  {{'k': 'tribe.blocks.write', 'v': case when c_custkey % 2 = 0 then 'false' else 'true' end}},
  {{'k': 'tribe.blocks.metadata', 'v': case when c_custkey % 3 = 0 then 'false' else 'true' end}},
  {{'k': 'tribe.on_conflict', 'v': 'prefer_t0'}}]) as s
from (select c_custkey, 'i-' || lpad(cast(c_custkey as string), 8, '0') as scope, 9000 + c_custkey % 100 as p0, 8000 + c_custkey % 3000 as p2,
  9000 + c_custkey % 50 as own from customer) as c
""".replace("{{", "{").replace("}}", "}")


def _tribe_settings(spark, sf_dir):
    return settings.tribe_settings(_tribe_input(spark, sf_dir))


def _overrides(spark, sf_dir):
    base = _customers(spark, sf_dir).select(
        "scope", F.inline(F.expr("array(struct('http.port' as k, '1' as v), struct('node.name' as k, scope as v))"))
    )
    mapping = F.lit("app.http.port=http.port,app.stack=node.attr.stack, app.missing=x,app.stack=extra,app.http.port=extra")
    extra = _customers(spark, sf_dir).filter("c_custkey % 2 = 0").select("scope", mapping.alias("mapping"))
    return settings.apply_overrides(base, extra, resolved(spark, sf_dir))


OVERRIDES = """
select scope, k, v from (
  select scope, 'http.port' as k, '1' as v, -1 as prio from c union all select scope, 'node.name', scope, -1 from c
  union all select r.scope, m.target, r.v, m.i from resolved as r, c,
    (values ('app.http.port', 'http.port', 0), ('app.stack', 'node.attr.stack', 1), ('app.missing', 'x', 2), ('app.stack', 'extra', 3), ('app.http.port', 'extra', 4)) as m(source, target, i)
  where r.scope = c.scope and r.k = m.source and c.c_custkey % 2 = 0
) as b qualify row_number() over (partition by scope, k order by prio desc) = 1
"""
SCOPES = "select c_custkey, 'i-' || lpad(cast(c_custkey as string), 8, '0') as scope from customer"


def _tribe_nodes(spark, sf_dir):
    """Every 100th node is a tribe node; its second source cluster is asked for."""
    tribe = _customers(spark, sf_dir).filter("c_custkey % 100 = 6")
    number = F.when(F.col("c_custkey") % 200 == 6, "/t2").otherwise("/t9")
    nodes = tribe.select("scope", F.concat("scope", number).alias("node_name")).unionByName(
        tribe.select("scope", F.col("scope").alias("node_name"))
    )
    instances = on_spark(spark, sf_dir, views.REGISTRY).select("app", "instance_id")
    return settings.tribe_nodes(_tribe_settings(spark, sf_dir), instances, nodes)


def _ports(spark, sf_dir):
    spec = F.concat(F.lit("es_a=9001, es_own=1 ,es_b="), (F.col("c_custkey") % 10000).cast("string"), F.lit(",es_a=9002"))
    rows = _customers(spark, sf_dir).select(
        "scope", F.lit("es_own").alias("own"), F.lit(7102).alias("own_port"), spec.alias("clusters")
    )
    return settings.cluster_ports(rows).select("scope", F.inline("ports")).select("scope", "k", "v")


def entries() -> list[Entry]:
    names = ["app.http.port", "app.stack", "app.nowhere"]
    return [
        Entry(
            "read_properties",
            _properties,
            "select scope, unnest(['app.name', 'app.zone', 'app.path', 'app.port', 'app.share', 'app.\u00e9t\u00e9=x']) as k, "
            "unnest(['es_' || c_custkey, 'z' || c_nationkey, '/data,/logs', cast(c_custkey % 100 as string), "
            "'a:b' || chr(9) || 'c' || chr(92), '\u4e2d\U0001f600!']) as v from "
            "(select *, 'i-' || lpad(cast(c_custkey as string), 8, '0') as scope from customer) as c",
        ),
        Entry(
            "filter_prefix",
            lambda s, d: settings.filter_prefix(layers(s, d), PREFIX),
            _oracle(f"select layer, scope, k, v from layers where starts_with(k, '{PREFIX}') and v <> ''"),
        ),
        Entry("resolve_settings", resolved, _oracle("select * from resolved")),
        Entry(
            "typed_settings",
            _typed,
            _oracle(
                "select scope, k, coalesce(try_cast(v as int), 9200) as as_int, coalesce(try_cast(v as bigint), -1) as as_long, "
                "coalesce(try_cast(v as double), 0.5) as as_double, lower(v) = 'true' as as_boolean, case when v in ('master', 'search') then v else 'other' end as as_enum "
                "from resolved where k in ('app.http.port', 'app.multi.dc', 'app.stack')"
            ),
        ),
        Entry(
            "lists_and_pairs",
            _lists,
            "select 'i-' || lpad(cast(c_custkey as string), 8, '0') as scope, 'bar|baz|' || c_mktsegment as items, "
            "'a=1|b=' || c_custkey as pairs, 'bad|c=|d=4=5' as bad from customer",
        ),
        Entry(
            "cluster_ports",
            _ports,
            "select 'i-' || lpad(cast(c_custkey as string), 8, '0') as scope, unnest(['es_own', 'es_a', 'es_b']) as k, "
            "unnest(['7102', '9001', cast(c_custkey % 10000 as string)]) as v from customer",
        ),
        Entry(
            "settings_stats",
            lambda s, d: settings.settings_stats(layers(s, d)),
            _oracle("select scope, count(v) as size, count(distinct k) as keys from layers group by scope"),
        ),
        Entry(
            "get_props",
            lambda s, d: settings.get_props(resolved(s, d), names),
            _oracle(
                "select s.scope, n.k, r.v from (select distinct scope from resolved) as s cross join (values ('app.http.port'), ('app.stack'), ('app.nowhere')) as n(k) "
                "left join resolved as r on r.scope = s.scope and r.k = n.k"
            ),
        ),
        Entry(
            "node_roles",
            lambda s, d: settings.node_roles(_role_input(s, d)).select("scope", "node_master", "node_data", "node_ingest", "rack_id"),
            "select 'i-' || lpad(cast(c_custkey as string), 8, '0') as scope, case when c_custkey % 4 <> 0 then c_mktsegment = 'BUILDING' end as node_master, "
            "case when c_custkey % 4 <> 0 then c_mktsegment = 'MACHINERY' end as node_data, case when c_custkey % 4 <> 0 then c_mktsegment = 'FURNITURE' end as node_ingest, "
            "case when c_custkey % 3 = 0 then 'r' || c_custkey % 5 else 'z' || c_nationkey end as rack_id from customer",
        ),
        Entry("tribe_settings", _tribe_settings, f"select scope, s.k as k, s.v as v from ({TRIBE}) as t"),
        Entry("apply_overrides", _overrides, _oracle(OVERRIDES, c=SCOPES)),
        Entry(
            "tribe_nodes",
            _tribe_nodes,
            with_views(
                "select scope, scope || '/t2' as node_name, 't2' as tribe_id, app, instance_id from "
                "(select 'i-' || lpad(cast(c_custkey as string), 8, '0') as scope from customer where c_custkey % 200 = 6) as c, registry where app = 'es_europe'",
                registry=views.REGISTRY,
            ),
        ),
    ]

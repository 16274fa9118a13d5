"""Desired against actual access rules: what to add and what to remove.

Rules are flat rows ``(from_port, to_port, cidr, rule_order)``; see ``flatten_rules``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from herdwatch.functions.text import is_ipv4, is_ipv6, single_address

TRIBE_PREFIX = "es_tribe_"


def flatten_rules(rules: DataFrame, ranges: str = "ranges") -> DataFrame:
    """One row per range of a rule."""
    others = [c for c in rules.columns if c != ranges]
    return rules.select(*others, F.explode(ranges).alias("cidr"))


def acl_ranges(rules: DataFrame, from_port: int, to_port: int | None = None) -> DataFrame:
    """Ranges of the rules with exactly these ports."""
    to_port = from_port if to_port is None else to_port
    return rules.filter((F.col("from_port") == from_port) & (F.col("to_port") == to_port)).select("cidr")


def desired_ranges(instances: DataFrame) -> DataFrame:
    return instances.select(single_address(F.col("public_ip")).alias("cidr")).filter("cidr IS NOT NULL").distinct()


def _on_ports(ranges: DataFrame, ports: list[int]) -> DataFrame:
    port = F.explode(F.array(*map(F.lit, ports)))
    return ranges.select("cidr", port.alias("from_port")).withColumn("to_port", F.col("from_port"))


def acl_to_add(
    instances: DataFrame, rules: DataFrame, transport_port: int, rest_port: int, per_port: bool = False
) -> DataFrame:
    """Ranges of instances that no rule lets in yet, on both ports.

    Whether a range is let in is judged on the transport port; ``per_port`` judges each port by
    its own rules.
    """
    desired = desired_ranges(instances)
    if per_port:
        present = _exact(rules, [transport_port, rest_port])
        return _on_ports(desired, [transport_port, rest_port]).join(present, ["cidr", "from_port"], "left_anti")
    missing = desired.join(acl_ranges(rules, transport_port), "cidr", "left_anti")
    return _on_ports(missing, [transport_port, rest_port])


def acl_to_remove(
    instances: DataFrame, rules: DataFrame, transport_port: int, rest_port: int, per_port: bool = False
) -> DataFrame:
    """Ranges that are let in but belong to no instance any more, on both ports."""
    desired = desired_ranges(instances)
    if per_port:
        stale = _exact(rules, [transport_port, rest_port]).join(desired, "cidr", "left_anti")
        return stale.select("cidr", "from_port", F.col("from_port").alias("to_port"))
    stale = acl_ranges(rules, transport_port).distinct().join(desired, "cidr", "left_anti")
    return _on_ports(stale, [transport_port, rest_port])


def _exact(rules: DataFrame, ports: list[int]) -> DataFrame:
    """Distinct ranges of rules for exactly one of the ports."""
    single = rules.filter((F.col("from_port") == F.col("to_port")) & F.col("from_port").isin(*ports))
    return single.select("cidr", "from_port").distinct()


def tribe_acl_plan(instances: DataFrame, rules: DataFrame, cluster_ports: Mapping[str, int]) -> DataFrame:
    """Changes for a tribe node: ``(action, app, cidr, from_port, to_port)``.

    A range belongs to one cluster, the last one registered with it.  Ranges of clusters named
    ``es_tribe_*`` are opened on every mapped port, others on their cluster's own port.  Stale
    ranges are closed on the ports of the last rule that names them.
    """
    ports = list(dict.fromkeys(cluster_ports.values()))
    mapped = instances.filter(F.col("app").isin(*cluster_ports) & F.col("public_ip").isNotNull())
    ranges = mapped.select("app", "update_time", "id", single_address(F.col("public_ip")).alias("cidr"))
    last = Window.partitionBy("cidr").orderBy(F.col("update_time").desc(), F.col("id").desc())
    owned = ranges.withColumn("_rank", F.row_number().over(last)).filter("_rank = 1").select("app", "cidr")
    present = _exact(rules, ports).select("cidr").distinct()

    own_port = F.lit(None).cast("int")
    for app, port in cluster_ports.items():
        own_port = F.when(F.col("app") == app, port).otherwise(own_port)
    opened = F.when(F.startswith("app", F.lit(TRIBE_PREFIX)), F.array(*map(F.lit, ports))).otherwise(F.array(own_port))
    add = (
        owned.join(present, "cidr", "left_anti")
        .withColumn("from_port", F.explode(opened))
        .select(F.lit("add").alias("action"), "app", "cidr", "from_port", F.col("from_port").alias("to_port"))
    )
    stale = present.join(owned, "cidr", "left_anti")
    remove = acl_ports(rules, stale).select(
        F.lit("remove").alias("action"), F.lit(None).cast("string").alias("app"), "cidr", "from_port", "to_port"
    )
    return add.unionByName(remove)


def normalize_cidr(df: DataFrame, ip: str = "ip", mask: str = "mask", action: str = "action") -> DataFrame:
    """Requests with a ``cidr``; a bad address gives none, but an ``error``.

    Addresses of both families are good.  A missing mask means a single address; so does, when
    adding, one wider than /8.
    """
    wide = F.col(mask).isNull() | ((F.col(action) == "add") & (F.col(mask) < 8))
    used = F.when(wide, F.when(is_ipv6(F.col(ip)), 128).otherwise(32)).otherwise(F.col(mask))
    good = is_ipv4(F.col(ip)) | is_ipv6(F.col(ip))
    return df.withColumns(
        {
            "cidr": F.when(good, F.concat_ws("/", F.col(ip), used.cast("string"))),
            "error": F.when(~good, "invalid address"),
        }
    )


def acl_ports(rules: DataFrame, cidrs: DataFrame) -> DataFrame:
    """Port range of each given range, in any case; of several rules the last one counts."""
    wanted = cidrs.select("cidr", F.lower("cidr").alias("_cidr")).distinct()
    last = Window.partitionBy("_cidr").orderBy(F.col("rule_order").desc(), F.col("from_port").desc())
    ruled = rules.select(F.lower("cidr").alias("_cidr"), "from_port", "to_port", "rule_order")
    newest = ruled.withColumn("_rank", F.row_number().over(last)).filter("_rank = 1")
    return wanted.join(newest, "_cidr").select("cidr", "from_port", "to_port")


def pick_group(groups: DataFrame, name: str, order: Column | str = "position") -> DataFrame:
    """The first group with the name; an error when the action runs if there is none."""
    found = groups.filter(F.col("group_name") == name).agg(F.min_by(F.struct("*"), order).alias("g"))
    missing = F.raise_error(F.lit(f"no group named {name}")).cast(found.schema["g"].dataType.simpleString())
    return found.select(F.coalesce("g", missing).alias("g")).select("g.*")

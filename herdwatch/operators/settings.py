"""Layered settings per node and what is derived from them.

Settings are rows ``(scope, k, v)``, scope being a node; layered ones also have ``layer``, a
lower layer winning over a higher one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from herdwatch.functions.text import first_per_key, pairs
from herdwatch.session import ensure_checkpoint_dir

# Cells of a dedicated node by stack name: (master, data, ingest).  Fixed values.
ROLES = {"master": (True, False, False), "data": (False, True, False), "search": (False, False, True)}

# Tribe nodes and instances of one cluster that meet in one piece: some four million rows come from it.
NODES, INSTANCES = 1_024, 4_096
# At most this many partitions hold the pieces.
PARTS = 4_096


def filter_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """Settings whose key has the prefix and whose value is not empty."""
    return df.filter(F.startswith("k", F.lit(prefix)) & (F.col("v") != ""))


def resolve_settings(layers: DataFrame, scope: str = "scope") -> DataFrame:
    """The value of the first layer that has one, per scope and key."""
    first = F.min_by("v", "layer")
    return layers.filter(F.col("v").isNotNull()).groupBy(scope, "k").agg(first.alias("v"))


def settings_stats(layers: DataFrame, scope: str = "scope") -> DataFrame:
    """Entries over all layers, repeated keys counted each time, and distinct keys."""
    return layers.groupBy(scope).agg(F.count("v").alias("size"), F.count_distinct("k").alias("keys"))


def get_props(resolved: DataFrame, names: Sequence[str], scope: str = "scope") -> DataFrame:
    """One row per scope and name, the value NULL where the scope does not have it."""
    wanted = F.array(*map(F.lit, names))
    values = [F.max(F.when(F.col("k") == n, F.col("v"))) for n in names]
    found = resolved.groupBy(scope).agg(F.array(*values).alias("_v"))
    rows = found.select(scope, F.inline(F.arrays_zip(wanted.alias("k"), F.col("_v").alias("v"))))
    return rows.toDF(scope, "k", "v")


def node_roles(df: DataFrame) -> DataFrame:
    """Role flags by ``stack`` for ``dedicated`` nodes (NULL for others) and the rack.

    The rack is the region when nodes span several (``multi_dc``), else the zone.
    """
    stack = F.lower("stack")

    def flag(place: int) -> Column:
        is_set = F.lit(False)
        for name, cells in ROLES.items():
            is_set = F.when(stack == name, F.lit(cells[place])).otherwise(is_set)
        return F.when(F.col("dedicated"), is_set)

    return df.withColumns(
        {
            "node_master": flag(0),
            "node_data": flag(1),
            "node_ingest": flag(2),
            "rack_id": F.when(F.col("multi_dc"), F.col("region")).otherwise(F.col("availability_zone")),
        }
    )


def tribe_settings(df: DataFrame, hosts_provider: str = "ec2") -> DataFrame:
    """Settings of tribe nodes: ``(scope, k, v)``, several per listed source cluster.

    Input columns: ``scope, own_port, clusters`` (``name=port,...``), ``write_enabled``,
    ``metadata_enabled``, ``prefer``.  Entries without a whole-number port are left out but keep
    their number.  The port range spans the own port and all listed ones.
    """
    listed = F.filter(pairs(F.col("clusters")), lambda e: e["v"].try_cast("int").isNotNull())
    ports = F.transform(F.col("_listed"), lambda e: e["v"].cast("int"))

    def setting(key: Column | str, value: Column | str) -> Column:
        key = F.lit(key) if isinstance(key, str) else key
        value = F.lit(value) if isinstance(value, str) else value
        return F.struct(key.alias("k"), value.alias("v"))

    def of_cluster(e: Column) -> Column:
        at = F.concat(F.lit("tribe.t"), e["i"].cast("string"))
        return F.array(
            setting(F.concat(at, F.lit(".cluster.name")), e["k"]),
            setting(F.concat(at, F.lit(".transport.tcp.port")), e["v"]),
            setting(F.concat(at, F.lit(".discovery.zen.hosts_provider")), hosts_provider),
            setting(F.concat(at, F.lit(".network.host")), "_global_"),
        )

    every = F.array_append(F.col("_ports"), F.col("own_port").cast("int"))
    shared = F.array(
        setting("transport.tcp.port", F.concat_ws("-", F.array_min(every).cast("string"), F.array_max(every).cast("string"))),
        setting("node.master", "false"),
        setting("node.data", "false"),
        setting("tribe.blocks.write", (~F.col("write_enabled")).cast("string")),
        setting("tribe.blocks.metadata", (~F.col("metadata_enabled")).cast("string")),
        setting("tribe.on_conflict", F.concat(F.lit("prefer_"), F.col("prefer"))),
    )
    prepared = df.withColumn("_listed", listed).withColumn("_ports", ports)
    settings = F.concat(F.flatten(F.transform(F.col("_listed"), of_cluster)), shared)
    return prepared.select("scope", F.inline(settings))


def cluster_ports(df: DataFrame, own: str = "own", own_port: str = "own_port", clusters: str = "clusters") -> DataFrame:
    """Add ``ports``: (cluster, port) pairs, the own one first; of equal names the first counts."""
    seeded = F.concat(
        F.array(F.struct(F.lit(-1).alias("i"), F.col(own).alias("k"), F.col(own_port).cast("string").alias("v"))),
        pairs(F.col(clusters)),
    )
    return df.withColumn("ports", first_per_key(seeded))


def apply_overrides(base: DataFrame, extra: DataFrame, resolved: DataFrame, scope: str = "scope") -> DataFrame:
    """Base settings plus extra ones: ``extra`` holds ``(scope, mapping)`` with ``source=target,...``.

    Each target key gets the value of its source key, replacing what was there; sources without
    a value are skipped, of several for one target the last counts.
    """
    mapped = extra.select(scope, F.inline(pairs(F.col("mapping")))).select(
        scope, F.col("k"), F.col("v").alias("_target"), F.col("i")
    )
    added = mapped.join(resolved.select(scope, "k", F.col("v")), [scope, "k"]).select(
        scope, F.col("_target").alias("k"), "v", F.col("i").alias("_prio")
    )
    both = base.select(scope, "k", "v", F.lit(-1).alias("_prio")).unionByName(added)
    last = Window.partitionBy(scope, "k").orderBy(F.col("_prio").desc())
    return both.withColumn("_rank", F.row_number().over(last)).filter("_rank = 1").select(scope, "k", "v")


def tribe_id(node_name: Column) -> Column:
    """``name/t3`` gives ``t3``; NULL for nodes that are not tribe nodes."""
    return F.when(F.contains(node_name, F.lit("/t")), F.regexp_extract(node_name, r"/(t\w*)", 1))


def tribe_nodes(settings: DataFrame, instances: DataFrame, nodes: DataFrame, scope: str = "scope") -> DataFrame:
    """Instances behind each tribe node: node name -> id -> cluster setting -> that cluster's nodes.

    ``nodes`` holds ``(scope, node_name)``; an unknown id gives no rows.

    The rows are as many as a cluster has tribe nodes times instances.  Both are dealt to blocks by a hash,
    as many as their counts ask for, and each block of nodes meets each block of instances in a piece of
    its own, so a large cluster is spread over all tasks.
    """
    wanted = nodes.withColumn("tribe_id", tribe_id(F.col("node_name"))).filter("tribe_id IS NOT NULL")
    named = wanted.withColumn("k", F.concat(F.lit("tribe."), "tribe_id", F.lit(".cluster.name")))
    # Settings are many more than the files that Spark would judge a broadcast by.
    clusters = named.join(settings.select(scope, "k", F.col("v").alias("app")).hint("merge"), [scope, "k"])
    # One row per tribe node, and one per cluster: both are needed twice.
    ensure_checkpoint_dir(nodes.sparkSession)
    clusters = clusters.select(scope, "node_name", "tribe_id", "app").checkpoint()
    members = instances.select("app", "instance_id")

    def blocks(df: DataFrame, rows: int, name: str) -> DataFrame:
        return df.groupBy("app").agg(F.ceil(F.count(F.lit(1)) / rows).alias(name))

    def block(n: str, *columns: str) -> Column:
        return F.pmod(F.xxhash64(*columns), F.col(n))

    def each(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    sizes = blocks(clusters, NODES, "_n").join(blocks(members, INSTANCES, "_m"), "app").checkpoint()
    pieces = sizes.agg(F.sum(F.col("_n") * F.col("_m"))).first()[0] or 1
    # A stated number of partitions: by their few bytes Spark would merge them again.
    place = (min(pieces, PARTS), "app", "_i", "_j")
    left = clusters.join(sizes, "app").withColumn("_i", block("_n", scope, "node_name")).withColumn("_j", each("_m"))
    right = members.join(sizes, "app").withColumn("_j", block("_m", "instance_id")).withColumn("_i", each("_n"))
    met = left.drop("_n", "_m").repartition(*place).join(right.drop("_n", "_m").repartition(*place), ["app", "_i", "_j"])
    return met.select(scope, "node_name", "tribe_id", "app", "instance_id")

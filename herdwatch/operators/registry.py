"""Node registry and group membership."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from herdwatch.functions.text import host_ip, non_blank
from herdwatch.schemas import MASTER_INFO

KEY = ("app", "dc", "instance_id")
# States in which a group member no longer counts.  Fixed values.
GONE = ("terminating", "shutting-down", "terminated")
# Stored cell name -> instance field.  Fixed values.
CELLS = {
    "cluster": "app", "availabilityZone": "availability_zone", "hostname": "host_name", "ip": "public_ip",
    "instanceId": "instance_id", "asgname": "asg", "location": "dc",
}
# Parts that cells are dealt to, which AQE splits and merges by size.  Up to 200 are written straight to
# files; for more, a task keeps what it writes in memory.
PARTS = 200
# Instance field -> name in the JSON listing.  Fixed values.
JSON_NAMES = {
    "host_name": "host_name", "id": "id", "app": "app_name", "instance_id": "instance_id",
    "availability_zone": "availability_zone", "public_ip": "public_ip", "dc": "dc", "update_time": "update_time",
}


def instances(df: DataFrame, app: str, dc: str | None = None, multi_dc: bool = False) -> DataFrame:
    """Instances of a cluster, of one location unless the cluster spans several."""
    of_app = df.filter(F.col("app") == app)
    return of_app if dc is None or multi_dc else of_app.filter(F.col("dc") == dc)


def instance_key() -> Column:
    return F.concat_ws("_", *KEY)


def to_cells(df: DataFrame) -> DataFrame:
    """Stored form of instances: one row per instance and cell."""
    cells = F.array(*(F.struct(F.lit(c).alias("col"), F.col(f).alias("value")) for c, f in CELLS.items()))
    rows = df.select(instance_key().alias("row_key"), F.explode(cells).alias("c"), F.col("update_time").alias("write_ts"))
    return rows.select("row_key", "c.col", "c.value", "write_ts")


def cells_to_instances(cells: DataFrame) -> DataFrame:
    """Instances from stored cells; the newest write of a cell counts.

    The id is ``location.instanceId``, the update time is when the cluster cell was written.

    Rows of text are aggregated in sorted order, so a task would sort all cells of its part of the input
    at once.  The cells are dealt to even parts first, those of one write together: in each part they become
    one row before these meet by key, however often a key was written.
    """
    cells = cells.hint("rebalance", PARTS, F.col("row_key"), F.col("write_ts"))
    newest = {
        field: F.max_by(F.when(F.col("col") == cell, F.col("value")), F.when(F.col("col") == cell, F.col("write_ts")))
        for cell, field in CELLS.items()
    }
    written = F.max(F.when(F.col("col") == "cluster", F.col("write_ts")))
    wide = cells.groupBy("row_key").agg(*(c.alias(f) for f, c in newest.items()), written.alias("update_time"))
    return wide.withColumn("id", F.concat("dc", F.lit("."), "instance_id"))


def find_instance(df: DataFrame, app: str, instance_id: str, dc: str) -> DataFrame:
    return df.filter((F.col("app") == app) & (F.col("instance_id") == instance_id) & (F.col("dc") == dc)).limit(1)


def upsert_instances(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """The registry after registering ``incoming``: per key the row with the newest update time.

    On a tie the incoming row wins, so running it again changes nothing.
    """
    both = current.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    newest = Window.partitionBy(*KEY).orderBy(F.col("update_time").desc(), F.col("_new").desc())
    return both.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank", "_new")


def delete_instances(current: DataFrame, dead: DataFrame) -> DataFrame:
    return current.join(dead.select(*KEY).distinct(), list(KEY), "left_anti")


def instances_to_json(df: DataFrame, pages: int = 1, group: str = "app") -> DataFrame:
    """Listings ``{"instances": {"instance-0": {...}, ...}}`` per cluster: ``(app, page, listing)``.

    A cluster's instances are dealt to ``pages`` documents by a hash of their key, whatever the
    cluster's size; each is numbered from 0 and complete in itself.  State as many pages as keep a
    document of the largest cluster in one task; pages without instances are left out.
    """
    page = F.pmod(F.xxhash64(*KEY), F.lit(pages))
    body = F.struct(*(F.col(f).alias(n) for f, n in JSON_NAMES.items()))
    paged = df.select(group, page.alias("page"), body.alias("_body"))
    in_page = F.sort_array(F.collect_list(F.struct("_body.availability_zone", "_body.id", "_body")))
    numbered = F.transform(
        F.col("_all"),
        lambda e, i: F.struct(F.concat(F.lit("instance-"), i.cast("string")).alias("key"), e["_body"].alias("value")),
    )
    listing = F.to_json(F.struct(F.map_from_entries(numbered).alias("instances")))
    return paged.groupBy(group, "page").agg(in_page.alias("_all")).select(group, "page", listing.alias("listing"))


def instances_from_json(df: DataFrame, column: str, stop_at_gap: bool = True) -> DataFrame:
    """Instances from listings.  ``stop_at_gap`` reads up to the first missing number only."""
    fields = [T.StructField(n, T.LongType() if f == "update_time" else T.StringType()) for f, n in JSON_NAMES.items()]
    schema = T.StructType([T.StructField("instances", T.MapType(T.StringType(), T.StructType(fields)))])
    entries = F.map_entries(F.from_json(F.col(column), schema)["instances"])
    numbered = F.transform(
        entries,
        lambda e: F.struct(
            F.regexp_extract(e["key"], r"^instance-(\d+)$", 1).try_cast("int").alias("i"), e["value"].alias("value")
        ),
    )
    ordered = F.array_sort(F.filter(numbered, lambda e: e["i"].isNotNull()))
    taken = F.filter(ordered, lambda e, place: e["i"] == place) if stop_at_gap else ordered
    others = [c for c in df.columns if c != column]
    rows = df.select(*others, F.explode(taken).alias("_e"))
    return rows.select(*others, *(F.col(f"_e.value.{n}").alias(f) for f, n in JSON_NAMES.items() if f not in others))


def sort_instances(df: DataFrame) -> DataFrame:
    return df.orderBy("availability_zone", "id")


def live_members(membership: DataFrame) -> DataFrame:
    """``(asg, instance_id)`` of members that are not on their way out."""
    live = ~F.coalesce(F.lower("state"), F.lit("")).isin(*GONE)
    return membership.filter(live).select("asg", "instance_id").distinct()


def group_sizes(membership: DataFrame) -> DataFrame:
    """Every group with its number of live members, 0 included."""
    live = ~F.coalesce(F.lower("state"), F.lit("")).isin(*GONE)
    return membership.groupBy("asg").agg(F.count_if(live).alias("live"))


def known_groups(registry: DataFrame) -> DataFrame:
    return registry.select("asg").filter("asg IS NOT NULL").distinct()


def classify_instances(
    registry: DataFrame,
    membership: DataFrame,
    asg: str,
    zone: str,
    multi_dc: bool = False,
    tribe_source: bool = False,
) -> DataFrame:
    """Registry rows with a ``reason``, as seen by a node of group ``asg`` in ``zone``.

    Rows whose reason starts with ``dead`` are the ones to delete.
    """
    groups = membership.select("asg").distinct().withColumn("_known", F.lit(True))
    live = live_members(membership).withColumn("_live", F.lit(True))
    joined = registry.join(groups, "asg", "left").join(live, ["asg", "instance_id"], "left")
    unknown = "skipped: several locations" if multi_dc else "skipped: tribe source" if tribe_source else "dead: unknown group"
    reason = (
        F.when(F.col("_known").isNull(), unknown)
        .when(F.col("asg") != asg, "skipped: other group")
        .when(F.col("availability_zone") != zone, "skipped: other zone")
        .when(F.col("_live"), "skipped: live")
        .otherwise("dead: not in its group")
    )
    return joined.withColumn("reason", reason).drop("_known", "_live")


def capacity(groups: DataFrame, by: Sequence[str] = ("asg",)) -> DataFrame:
    """Sum of the largest allowed sizes and number of zones."""
    return groups.groupBy(*by).agg(F.sum("max_size").alias("max_size"), F.count_distinct("zone").alias("zones"))


def federated_instances(df: DataFrame, own: str, source_clusters: str | None = None, repeats: bool = False) -> DataFrame:
    """Instances of the own cluster and of each listed one (``name=port,name=port`` or names).

    With ``repeats`` a cluster listed twice counts twice.
    """
    listed = [p.split("=")[0].strip() for p in (source_clusters or "").split(",") if p.strip()]
    names = [own, *listed]
    of_clusters = df.filter(F.col("app").isin(*dict.fromkeys(names)))
    if not repeats or len(set(names)) == len(names):
        return of_clusters
    times = F.array_repeat(F.lit(1), F.size(F.filter(F.array(*map(F.lit, names)), lambda n: n == F.col("app"))))
    return of_clusters.withColumn("_copy", F.explode(times)).drop("_copy")


def cluster_instances(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col("app") == name.strip().lower())


def up_hosts(df: DataFrame) -> DataFrame:
    """Hosts with status UP, with the address that their name spells out."""
    return df.filter(F.col("status") == "UP").withColumn("alternate_ip", host_ip(F.col("host_name")))


def default_zones(zones: DataFrame, n: int = 3) -> DataFrame:
    """The first n available zones in listing order (``position``)."""
    return zones.filter(F.col("state") == "available").orderBy("position").limit(n)


def leader_flag(answer: Column, host: Column, ip: Column) -> Column:
    """Does the leader named in the answer mean this host?"""
    named = F.lower(F.trim(answer))
    return F.coalesce((named != "") & ((named == F.lower(host)) | (named == F.lower(ip))), F.lit(False))


def can_lead(dedicated: Column, asg: Column) -> Column:
    return ~dedicated | F.coalesce(F.contains(F.lower(asg), F.lit("master")), F.lit(False))


def parse_master_info(df: DataFrame, column: str) -> DataFrame:
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.inline(F.from_json(F.col(column), MASTER_INFO)))


def with_identity(df: DataFrame) -> DataFrame:
    """Add ``region`` (own, environment's, or the zone without its last letter) and ``node_name``."""
    zone = F.col("availability_zone")
    of_zone = F.substring(zone, F.lit(1), F.length(zone) - 1)
    region = F.coalesce(non_blank(F.col("region")), non_blank(F.col("env_region")), of_zone)
    return df.withColumns({"region": region, "node_name": F.concat_ws(".", zone, "instance_id")})

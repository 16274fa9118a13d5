"""Cluster health codes and process up/down signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdwatch.plans.slices import running_before, without_slices

UNKNOWN = -1


def _mismatch(actual: Column, expected: Column) -> Column:
    """0 when both counts agree, 1 when they differ, -1 when either is unknown."""
    return F.coalesce((actual != expected).cast("int"), F.lit(UNKNOWN))


def health_codes(
    df: DataFrame,
    registry_nodes: str | Column | None = None,
    desired_nodes: str | Column | None = None,
    discovery_nodes: str | Column | None = None,
) -> DataFrame:
    """Add health codes from ``status`` and ``nodes``.

    ``green_or_red`` and ``green_or_yellow`` are 0/1, or -1 while the status is unknown.
    ``node_match`` compares with the registry count if given, else with the desired count;
    ``discovery_node_match`` with the discovery count.  Expected counts are columns of the
    frame (join them first) or literals.  A sample without a status has -1 everywhere.
    """
    status = F.upper(F.trim("status"))
    known = F.col("status").isNotNull()

    def code(bad: str) -> Column:
        return F.when(status == bad, 1).when(status.isin("GREEN", "YELLOW", "RED"), 0).otherwise(UNKNOWN)

    def expected(count: str | Column | None) -> Column:
        if count is None:
            return F.lit(None).cast("int")
        return F.col(count) if isinstance(count, str) else count

    target = expected(registry_nodes if registry_nodes is not None else desired_nodes)
    return df.withColumns(
        {
            "green_or_red": code("RED").cast("int"),
            "green_or_yellow": code("YELLOW").cast("int"),
            "node_match": F.when(known, _mismatch(F.col("nodes"), target)).otherwise(UNKNOWN).cast("int"),
            "discovery_node_match": F.when(known, _mismatch(F.col("nodes"), expected(discovery_nodes)))
            .otherwise(UNKNOWN)
            .cast("int"),
        }
    )


def with_registry_count(df: DataFrame, registry: DataFrame, key: str = "app") -> DataFrame:
    """Add ``registry_nodes``: how many instances the registry knows for the sample's cluster."""
    known = registry.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("registry_nodes"))
    joined = df.join(known, key, "left")
    return joined.withColumn("registry_nodes", F.coalesce("registry_nodes", F.lit(0)))


def with_registry_count_at(
    df: DataFrame,
    registry: DataFrame,
    key: str = "app",
    order: Sequence[str] = ("ts", "seq"),
    registered: str = "registered_at",
    removed: str = "removed_at",
    **slicing,
) -> DataFrame:
    """Add ``registry_nodes``: how many instances the registry knew for the sample's cluster at its time.

    An instance counts from its registration on, and no longer at the instant of its removal; a null
    removal means that it is still there, a null registration that it always was.  Arrivals and leavings
    are summed by cluster and instant, and a running sum over time slices carries them to the samples, so
    that a cluster's history is not one task.  Samples without a cluster or a time count 0; ``order`` is
    the samples' time and tie-breaker, a whole number.
    """
    ts, tie = order
    came = registry.select(F.col(key).alias("_key"), F.coalesce(F.col(registered).cast("timestamp"), F.lit("0001-01-01").cast("timestamp")).alias("_ts"), F.lit(1).alias("_d"))
    left = registry.filter(F.col(removed).isNotNull()).select(F.col(key), F.col(removed).cast("timestamp"), F.lit(-1))
    # Changes come before samples of the same instant.
    changes = came.unionAll(left).filter("_key is not null").groupBy("_key", "_ts").agg(F.sum("_d").alias("_d"))
    changes = changes.select("_key", "_ts", F.lit(False).alias("_asks"), F.lit(0).cast("bigint").alias("_tie"), "_d")
    whole = F.struct(*(F.col(c) for c in df.columns))
    rows = df.select(F.col(key).alias("_key"), F.col(ts).cast("timestamp").alias("_ts"), F.lit(True).alias("_asks"), F.col(tie).cast("bigint").alias("_tie"), whole.alias("_row"))
    placeable = F.col("_key").isNotNull() & F.col("_ts").isNotNull()
    both = changes.unionByName(rows.filter(placeable), allowMissingColumns=True)
    both = both.withColumn("_tie", F.struct("_asks", "_tie")).drop("_asks")
    counted = without_slices(running_before(both, ["_key"], {"_known": ("sum", "_d")}, order=("_ts", "_tie"), **slicing))
    found = counted.filter("_row is not null").select("_row", F.coalesce("_known", F.lit(0)).alias("_known"))
    found = found.unionAll(rows.filter(~placeable).select("_row", F.lit(0).cast("bigint")))
    return found.select("_row.*", F.col("_known").cast("int").alias("registry_nodes"))


def process_down(df: DataFrame, keys: Sequence[str] = ("node",), **slicing) -> DataFrame:
    """``down`` = 0 or 1 per sample, silent (no row) until the process was first seen up."""
    seen = running_before(df, keys, {"_seen": ("max", F.col("up").cast("int"))}, **slicing)
    latched = seen.filter(F.greatest(F.coalesce("_seen", F.lit(0)), F.col("up").cast("int")) == 1)
    return without_slices(latched.withColumn("down", F.when(F.col("up"), 0).otherwise(1)).drop("_seen"))


def transitions(df: DataFrame, keys: Sequence[str] = ("node",), **slicing) -> DataFrame:
    """Samples at which the process changed between up and down; it counts as down at first."""
    before = running_before(df, keys, {"_before": ("last", "up")}, **slicing)
    changed = before.filter(F.col("up") != F.coalesce("_before", F.lit(False)))
    turned = F.when(F.col("up"), "STARTED").otherwise("STOPPED")
    return without_slices(changed.withColumn("transition", turned).drop("_before"))

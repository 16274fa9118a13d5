"""Snapshot selection, naming, catalog, restore plans and reports."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from herdwatch.functions.text import non_blank, wildcard_rule
from herdwatch.plans.slices import running_before, without_slices

ALL = "_all"


def chosen(name: Column, spec: str | None) -> Column:
    """Does a comma list choose the name?  ``*`` is a wildcard, ``-`` in front leaves names out.

    A blank list and ``_all`` in any case choose everything.
    """
    words = [w.strip() for w in (spec or "").split(",") if w.strip()]
    if not words or [w.lower() for w in words] == [ALL]:
        return F.lit(True)
    wanted = [wildcard_rule(w) for w in words if not w.startswith("-")]
    unwanted = [wildcard_rule(w[1:]) for w in words if w.startswith("-")]
    choice = name.rlike("|".join(wanted)) if wanted else F.lit(True)
    return choice & ~name.rlike("|".join(unwanted)) if unwanted else choice


def select_datasets(df: DataFrame, spec: str | None, column: str = "name") -> DataFrame:
    return df.filter(chosen(F.col(column), spec))


def _ts(at: Column | datetime | str) -> Column:
    return at if isinstance(at, Column) else F.lit(at).cast("timestamp")


def snapshot_name(indices: Column, include_indices: Column, at: Column | datetime | str) -> Column:
    """``[indices_]yyyyMMddHHmm``; commas become ``_``, ``all`` is written in lower case."""
    listed = F.when(F.lower(indices) == "all", F.lit("all")).otherwise(F.replace(indices, F.lit(","), F.lit("_")))
    return F.concat_ws("_", F.when(include_indices, listed), F.date_format(_ts(at), "yyyyMMddHHmm"))


def repository_name(at: Column | datetime | str) -> Column:
    return F.date_format(_ts(at), "yyyyMMdd")


def snapshot_path(cluster: Column, at: Column | datetime | str) -> Column:
    return F.concat_ws("/", cluster, repository_name(at))


def restore_path(source_cluster: Column, suffix: Column) -> Column:
    """``source/suffix``; NULL when no source cluster is named."""
    return F.when(non_blank(source_cluster).isNotNull(), F.concat(source_cluster, F.lit("/"), suffix))


def restore_plan(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Restore requests with every parameter settled, or with an ``error``.

    Request columns: ``repository, repo_type, snapshot, indices`` as asked for, and the settings
    ``restore_repository, restore_repo_type, restore_snapshot, restore_indices,
    restore_location, backup_location, restore_region, dc, source_cluster``.  What is blank
    falls back to the restore setting, then to the backup setting or default; a snapshot that
    is named nowhere is the newest of ``catalog`` (repo, snapshot).  ``indices`` NULL means all.
    """

    def first(*columns: str) -> Column:
        return F.coalesce(*(non_blank(F.col(c)) for c in columns))

    indices = first("indices", "restore_indices")
    repo = first("repository", "restore_repository")
    settled = requests.withColumns(
        {
            "_repo": F.concat(repo, F.lit("-"), F.col("source_cluster")),
            "_type": F.coalesce(first("repo_type"), F.lower(first("restore_repo_type")), F.lit("s3")),
            "_bucket": first("restore_location", "backup_location"),
            "_region": first("restore_region", "dc"),
            "_path": restore_path(F.col("source_cluster"), repo),
            "_snapshot": first("snapshot", "restore_snapshot"),
            "_indices": F.when(F.lower(indices) != ALL, indices),
        }
    )
    newest = latest_snapshot(catalog).select(F.col("repo").alias("_repo"), F.col("snapshot").alias("_newest"))
    joined = settled.join(newest, "_repo", "left")
    snapshot = F.coalesce("_snapshot", "_newest")
    error = (
        F.when(repo.isNull(), "no repository")
        .when(F.col("_path").isNull(), "no source cluster")
        .when(~F.lower("_type").isin("s3", "fs"), "unknown repository type")
        .when(snapshot.isNull(), "no snapshot")
    )
    settings = {c for c in requests.columns if c in _REQUEST}
    return joined.select(
        *(c for c in requests.columns if c not in settings),
        F.col("_repo").alias("repository"),
        F.lower("_type").alias("repo_type"),
        F.col("_bucket").alias("bucket"),
        F.col("_region").alias("region"),
        F.col("_path").alias("base_path"),
        snapshot.alias("snapshot"),
        F.col("_indices").alias("indices"),
        error.alias("error"),
    )


_REQUEST = (
    "repository", "repo_type", "snapshot", "indices", "restore_repository", "restore_repo_type", "restore_snapshot",
    "restore_indices", "restore_location", "backup_location", "restore_region", "dc", "source_cluster",
)


def repo_exists(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Requests ``(name, type)`` whose repository exists, names and types in any case."""
    keyed = requests.withColumns({"_n": F.lower("name"), "_t": F.lower("type")})
    known = catalog.select(F.lower("name").alias("_n"), F.lower("type").alias("_t")).distinct()
    return keyed.join(known, ["_n", "_t"], "left_semi").drop("_n", "_t")


def list_snapshots(catalog: DataFrame, repo: str) -> DataFrame:
    return catalog.filter(F.col("repo") == repo).select("snapshot").distinct()


def latest_snapshot(catalog: DataFrame, by: str = "snapshot") -> DataFrame:
    """The newest snapshot per repository: the greatest name, or ``by="created_at"``.

    Greatest by name is not newest in time when names start with the datasets' names.
    """
    newest = Window.partitionBy("repo").orderBy(F.col(by).desc(), F.col("snapshot").desc())
    return catalog.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")


def _outcome() -> tuple[Column, Column]:
    status = F.col("status")
    return status == "OK", status.isin("INTERNAL_SERVER_ERROR", "EXCEPTION")


def snapshot_outcomes(runs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Number of succeeded and failed runs; other statuses count as neither."""
    success, failure = _outcome()
    return runs.groupBy(*keys).agg(
        F.count_if(success).alias("snapshot_success"), F.count_if(failure).alias("snapshot_failure")
    )


def running_outcomes(
    runs: DataFrame, keys: Sequence[str] = ("node",), order: Sequence[str] = ("ts", "run_id"), **slicing
) -> DataFrame:
    """Add the totals of a node's runs so far, the row included."""
    success, failure = _outcome()
    counted = runs.withColumns({"_ok": success.cast("bigint"), "_bad": failure.cast("bigint")})
    before = running_before(counted, keys, {"_s": ("sum", "_ok"), "_f": ("sum", "_bad")}, order, **slicing)
    totals = before.withColumns(
        {
            "snapshot_success": F.coalesce("_s", F.lit(0)) + F.col("_ok"),
            "snapshot_failure": F.coalesce("_f", F.lit(0)) + F.col("_bad"),
        }
    )
    return without_slices(totals.drop("_s", "_f", "_ok", "_bad"))


def snapshot_report(runs: DataFrame) -> DataFrame:
    """Add whole ``minutes`` and ``successful_shards``."""
    minutes = F.call_function("div", F.col("end_ms") - F.col("start_ms"), F.lit(60_000))
    return runs.withColumns({"minutes": minutes, "successful_shards": F.col("total_shards") - F.col("failed_shards")})


def shard_failures(runs: DataFrame, keys: Sequence[str], column: str = "shard_failures") -> DataFrame:
    """One row per failed shard."""
    return runs.select(*keys, F.inline(column))


def restore_report(restores: DataFrame, keys: Sequence[str] = ("name",)) -> DataFrame:
    """One row per restored dataset with the restore's shard counts."""
    shards = [c for c in ("total_shards", "successful_shards", "failed_shards") if c in restores.columns]
    return restores.select(*keys, F.explode("indices").alias("dataset"), *shards)


def rename(name: Column, pattern: str | None, replacement: str | None) -> Column:
    """Rename by regular expression if both parts are given and at least one is not empty."""
    if pattern is None or replacement is None or not (pattern or replacement):
        return name
    return F.regexp_replace(name, pattern, replacement)

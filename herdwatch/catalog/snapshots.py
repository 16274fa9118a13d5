"""Catalog entries for snapshots and restore."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from herdwatch.catalog import views
from herdwatch.catalog.base import Entry, on_duckdb, on_spark, table, with_views
from herdwatch.catalog.lifecycle import DATASETS, datasets, parts
from herdwatch.operators import snapshots
from herdwatch.session import shared_dir
from herdwatch.sources import snapshot_store

NOW = "1999-06-15 12:34:56"
SPEC = "orders_1999*, audit-*,-orders_199903*, -*.02.*"
CHOSEN = "(name like 'orders\\_1999%' escape '\\' or name like 'audit-%') and name not like 'orders\\_199903%' escape '\\' and name not like '%.02.%'"


def catalog(spark, sf_dir):
    return on_spark(spark, sf_dir, views.SNAPSHOT_CATALOG)


def runs(spark, sf_dir):
    return on_spark(spark, sf_dir, views.SNAPSHOT_RUNS)


def _oracle(body: str, **more: str) -> str:
    return with_views(body, parts=views.DATASET_PARTS, datasets=DATASETS, catalog=views.SNAPSHOT_CATALOG, runs=views.SNAPSHOT_RUNS, **more)


def _names(spark, sf_dir):
    indices = F.expr("case o_orderkey % 4 when 0 then 'ALL' when 1 then '_all' when 2 then 'a,b,c' else o_orderpriority end")
    at = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        snapshots.snapshot_name(indices, F.col("o_orderkey") % 3 != 0, at).alias("snapshot"),
        snapshots.snapshot_path(F.concat(F.lit("es_"), F.col("o_orderstatus")), at).alias("path"),
        snapshots.restore_path(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).otherwise(F.lit(" ")), snapshots.repository_name(at)).alias("restore_path"),
    )


_REQUESTS = (
    "select o_orderkey, case when o_orderkey % 3 = 0 then '' when o_orderkey % 3 = 1 then 'es' end as repository, "
    "case when o_orderkey % 5 = 0 then 'S3' when o_orderkey % 5 = 1 then 'fs' when o_orderkey % 5 = 2 then 'tape' else ' ' end as repo_type, "
    "case when o_orderkey % 7 = 0 then 'mine' end as snapshot, case when o_orderkey % 4 = 0 then 'a,b' when o_orderkey % 4 = 1 then '_ALL' end as indices, "
    "case when o_orderkey % 11 <> 0 then 'es' end as restore_repository, case when o_orderkey % 2 = 0 then 'FS' else '' end as restore_repo_type, "
    "case when o_orderkey % 13 = 0 then 'set' end as restore_snapshot, case when o_orderkey % 6 = 2 then 'x*' end as restore_indices, "
    "case when o_orderkey % 2 = 0 then 'restore-b' else '  ' end as restore_location, 'backup-b' as backup_location, "
    "case when o_orderkey % 3 = 2 then 'eu' end as restore_region, 'us' as dc, "
    "case when o_orderkey % 9 = 0 then ' ' when o_orderkey % 10 = 0 then 'zz' else lower(o_orderstatus) end as source_cluster from {orders}"
)
# Snapshot repositories for restoring are named ``<repository>-<source cluster>``.
_RESTORE_CATALOG = "select replace(repo, 'es_', 'es-') as repo, snapshot from ({}) as c".format(views.SNAPSHOT_CATALOG)


def _restore_plan(spark, sf_dir):
    return snapshots.restore_plan(on_spark(spark, sf_dir, _REQUESTS), on_spark(spark, sf_dir, _RESTORE_CATALOG))


def _blank(*columns: str) -> str:
    return "coalesce(" + ", ".join(f"case when trim({c}) <> '' then {c} end" for c in columns) + ", null)"


_PLAN_SQL = f"""
select o_orderkey, repo as repository, type as repo_type, bucket, region, path as base_path, coalesce(named, newest) as snapshot,
  case when lower(idx) <> '_all' then idx end as indices,
  case when base is null then 'no repository' when path is null then 'no source cluster' when type not in ('s3', 'fs') then 'unknown repository type'
    when coalesce(named, newest) is null then 'no snapshot' end as error
from (
  select o_orderkey, base, base || '-' || source_cluster as repo,
    lower(coalesce({_blank('repo_type')}, {_blank('restore_repo_type')}, 's3')) as type,
    {_blank('restore_location', 'backup_location')} as bucket, {_blank('restore_region', 'dc')} as region,
    case when trim(source_cluster) <> '' then source_cluster || '/' || base end as path,
    {_blank('snapshot', 'restore_snapshot')} as named, {_blank('indices', 'restore_indices')} as idx
  from (select *, {_blank('repository', 'restore_repository')} as base from requests) as a
) as b left join (select repo as r, max(snapshot) as newest from catalog2 group by repo) as n on b.repo = n.r
"""


def _repos(spark, sf_dir):
    known = catalog(spark, sf_dir).select(F.col("repo").alias("name"), F.lit("s3").alias("type")).distinct()
    asked = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(F.lit("ES_"), F.when(F.col("o_orderkey") % 4 == 0, "none").otherwise(F.col("o_orderstatus"))).alias("name"),
        F.when(F.col("o_orderkey") % 3 == 0, "FS").otherwise("S3").alias("type"),
    )
    return snapshots.repo_exists(asked, known)


def _failures(spark, sf_dir):
    shards = F.transform(
        F.sequence(F.lit(1), F.lit(2)),
        lambda i: F.struct(
            F.concat(F.lit("ds"), (F.col("run_id") % 7).cast("string")).alias("dataset"), i.alias("shard"), F.col("node").alias("node"),
            F.when(i == 1, "node left").otherwise("disk full").alias("reason"),
        ),
    )
    listed = runs(spark, sf_dir).withColumn("shard_failures", F.when(F.col("failed_shards") > 0, shards)).drop("node")
    return snapshots.shard_failures(listed, ["run_id"])


def _restores(spark, sf_dir):
    indices = F.transform(F.sequence(F.lit(0), (F.col("run_id") % 3).cast("int")), lambda i: F.concat(F.lit("ds"), i.cast("string")))
    return snapshots.restore_report(runs(spark, sf_dir).withColumn("indices", indices), ["run_id"])


def _stored(spark, sf_dir):
    """Write the chosen datasets as a snapshot, read the catalog rows back."""
    root = f"{shared_dir(spark)}/catalog-write-{uuid.uuid4().hex}"
    written = snapshot_store.write_snapshot(parts(spark, sf_dir), root, "es", "199906151234", SPEC, NOW)
    return written.select("repo", "snapshot", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), "dataset", "row_count")


def _restored(spark, sf_dir):
    """Write everything as a snapshot, restore a part of it under other names into a store, twice, and read that."""
    root = f"{shared_dir(spark)}/catalog-restore-{uuid.uuid4().hex}"
    snapshot_store.write_snapshot(parts(spark, sf_dir), root, "es", "199906151234")
    for _ in range(2):
        snapshot_store.restore_into(spark, root, "es", "199906151234", f"{root}-store", "orders_1998*", "^orders_(.*)$", "restored-$1")
    back = snapshot_store.read_restored(spark, f"{root}-store")
    return back.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round("price").cast("bigint")).alias("price"))


def entries() -> list[Entry]:
    both = ("snapshot_success", "snapshot_failure")
    counts = "count(*) filter (where status = 'OK') {over} as snapshot_success, count(*) filter (where status in ('INTERNAL_SERVER_ERROR', 'EXCEPTION')) {over} as snapshot_failure"
    return [
        Entry(
            "select_datasets",
            lambda s, d: snapshots.select_datasets(datasets(s, d), SPEC),
            _oracle(f"select name from datasets where {CHOSEN}"),
        ),
        Entry(
            "snapshot_names",
            _names,
            "select o_orderkey, case when o_orderkey % 3 <> 0 then (case o_orderkey % 4 when 0 then 'all' when 1 then '_all' when 2 then 'a_b_c' else o_orderpriority end) || '_' else '' end "
            "|| strftime(t, '%Y%m%d%H%M') as snapshot, 'es_' || o_orderstatus || '/' || strftime(t, '%Y%m%d') as path, "
            "case when o_orderkey % 5 <> 0 then o_orderpriority || '/' || strftime(t, '%Y%m%d') end as restore_path from "
            "(select *, o_orderdate + to_minutes(o_orderkey % 1440) as t from orders) as o",
        ),
        Entry(
            "restore_plan",
            _restore_plan,
            with_views(_PLAN_SQL, requests=_REQUESTS, catalog2=_RESTORE_CATALOG),
        ),
        Entry(
            "repo_exists",
            _repos,
            "select o_orderkey, 'ES_' || o_orderstatus as name, 'S3' as type from orders where o_orderkey % 4 <> 0 and o_orderkey % 3 <> 0",
        ),
        Entry(
            "latest_snapshot",
            lambda s, d: snapshots.latest_snapshot(catalog(s, d)).select("repo", "snapshot"),
            _oracle("select repo, max(snapshot) as snapshot from catalog group by repo"),
        ),
        Entry(
            "latest_snapshot_by_time",
            lambda s, d: snapshots.latest_snapshot(catalog(s, d), by="created_at").select("repo", "snapshot"),
            _oracle("select repo, snapshot from catalog qualify row_number() over (partition by repo order by created_at desc, snapshot desc) = 1"),
        ),
        Entry(
            "list_snapshots",
            lambda s, d: snapshots.list_snapshots(catalog(s, d), "es_p"),
            _oracle("select distinct snapshot from catalog where repo = 'es_p'"),
        ),
        Entry(
            "snapshot_outcomes",
            lambda s, d: snapshots.snapshot_outcomes(runs(s, d), ["node"]),
            _oracle("select node, " + counts.format(over="") + " from runs group by node"),
        ),
        Entry(
            "running_outcomes",
            lambda s, d: snapshots.running_outcomes(runs(s, d)).select("run_id", "node", *both),
            _oracle(
                "select run_id, node, "
                + counts.format(over="over (partition by node order by ts, run_id rows between unbounded preceding and current row)")
                + " from runs"
            ),
        ),
        Entry(
            "snapshot_report",
            lambda s, d: snapshots.snapshot_report(runs(s, d)).select("run_id", "minutes", "total_shards", "successful_shards", "failed_shards"),
            _oracle("select run_id, (end_ms - start_ms) // 60000 as minutes, total_shards, total_shards - failed_shards as successful_shards, failed_shards from runs"),
        ),
        Entry(
            "shard_failures",
            _failures,
            _oracle(
                "select run_id, 'ds' || run_id % 7 as dataset, f.shard, node, f.reason from runs, (values (1, 'node left'), (2, 'disk full')) as f(shard, reason) where failed_shards > 0"
            ),
        ),
        Entry(
            "restore_report",
            _restores,
            _oracle(
                "select run_id, 'ds' || i as dataset, total_shards, failed_shards from (select *, unnest(range(0, run_id % 3 + 1)) as i from runs) as r"
            ),
        ),
        Entry(
            "write_snapshot",
            _stored,
            _oracle(
                f"select 'es' as repo, '199906151234' as snapshot, '{NOW}' as created_at, name as dataset, count(*) as row_count from parts where {CHOSEN} group by name"
            ),
        ),
        Entry(
            "restore_snapshot",
            _restored,
            _oracle(
                "select 'restored-' || substr(name, 8) as name, count(*) as n, cast(sum(cast(round(price) as bigint)) as bigint) as price from parts where name like 'orders\\_1998%' escape '\\' group by name"
            ),
        ),
    ]

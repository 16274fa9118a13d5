"""Snapshots as parquet sorted by dataset, with a catalog table next to them.

Files are cut by dataset name, not one folder per dataset: many small datasets share a file, a
large one spans several, and a restore skips files and row groups by their name range.
"""

from __future__ import annotations

import hashlib
import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from herdwatch.operators.snapshots import rename, select_datasets
from herdwatch.schemas import SNAPSHOT_CATALOG

MANIFEST = "restore string, repo string, snapshot string, name string, row_count bigint"
# More chosen datasets than this are found by a join instead of a pushed filter.
PUSHED_NAMES = 2_000


def _data(root: str, repo: str, snapshot: str) -> str:
    return f"{root}/data/{repo}/{snapshot}"


def read_catalog(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(SNAPSHOT_CATALOG).option("recursiveFileLookup", True).parquet(f"{root}/catalog")


def write_snapshot(
    df: DataFrame,
    root: str,
    repo: str,
    snapshot: str,
    spec: str | None = None,
    at: datetime | str = "1970-01-01 00:00:00",
    partial: bool = False,
) -> DataFrame:
    """Write the chosen datasets of ``df`` (rows with a ``name``) and add them to the catalog.

    Names in ``spec`` without a wildcard must exist unless ``partial``.  Rows are ranged by name
    and then by a hash of the whole row, which splits a large dataset over tasks.  Writing the
    same snapshot again replaces it.  Returns its catalog rows.
    """
    spark, path = df.sparkSession, _data(root, repo, snapshot)
    picked = select_datasets(df, spec)
    if not partial:
        words = [w.strip() for w in (spec or "").split(",")]
        exact = [w for w in words if w and w.lower() != "_all" and "*" not in w and not w.startswith("-")]
        if exact:
            found = {r[0] for r in picked.filter(F.col("name").isin(*exact)).select("name").distinct().collect()}
            if set(exact) - found:
                raise ValueError(f"missing datasets: {sorted(set(exact) - found)}")
    ranged = picked.repartitionByRange("name", F.xxhash64(*picked.columns)).sortWithinPartitions("name")
    ranged.write.mode("overwrite").parquet(path)
    rows = (
        spark.read.schema(picked.select("name").schema)
        .parquet(path)
        .groupBy(F.col("name").alias("dataset"))
        .agg(F.count(F.lit(1)).alias("row_count"))
        .select(
            F.lit(repo).alias("repo"),
            F.lit(snapshot).alias("snapshot"),
            F.lit(at).cast("timestamp").alias("created_at"),
            "dataset",
            "row_count",
        )
    )
    entry = f"{root}/catalog/{repo}--{snapshot}"
    rows.write.mode("overwrite").parquet(entry)
    return spark.read.schema(SNAPSHOT_CATALOG).parquet(entry)


def restore_snapshot(
    spark: SparkSession,
    root: str,
    repo: str,
    snapshot: str,
    spec: str | None = None,
    rename_pattern: str | None = None,
    rename_replacement: str | None = None,
) -> DataFrame:
    """Rows of the chosen datasets of a snapshot, their ``name`` renamed.

    Which datasets are chosen is looked up in the catalog, so the scan can be narrowed to their
    names; up to ``PUSHED_NAMES`` become a pushed filter, more are joined.
    """
    rows = spark.read.parquet(_data(root, repo, snapshot))
    if spec is not None:
        held = read_catalog(spark, root).filter((F.col("repo") == repo) & (F.col("snapshot") == snapshot))
        names = select_datasets(held, spec, "dataset").select(F.col("dataset").alias("name"))
        first = [r[0] for r in names.limit(PUSHED_NAMES + 1).collect()]
        if len(first) <= PUSHED_NAMES:
            rows = rows.filter(F.col("name").isin(first))
        else:
            rows = rows.join(names, "name", "left_semi")
    return rows.withColumn("name", rename(F.col("name"), rename_pattern, rename_replacement))


def restore_into(
    spark: SparkSession,
    root: str,
    repo: str,
    snapshot: str,
    target: str,
    spec: str | None = None,
    rename_pattern: str | None = None,
    rename_replacement: str | None = None,
) -> DataFrame:
    """Restore a snapshot's chosen datasets into the store ``target``; returns their manifest rows.

    Rows are staged in a folder named by what is restored, and its manifest is written last: what a run
    that broke has left is seen by no reader and replaced by the next run.  Repeating a restore that is
    in the manifest changes nothing.  Datasets that another restore has brought in are an error.
    """
    what = json.dumps([root, repo, snapshot, spec, rename_pattern, rename_replacement])
    restore = hashlib.sha256(what.encode()).hexdigest()[:32]
    held = read_manifest(spark, target)
    mine = held.filter(F.col("restore") == restore)
    if mine.head(1):
        return mine
    rows = restore_snapshot(spark, root, repo, snapshot, spec, rename_pattern, rename_replacement)
    staged = f"{target}/data/{restore}"
    ranged = rows.repartitionByRange("name", F.xxhash64(*rows.columns)).sortWithinPartitions("name")
    ranged.write.mode("overwrite").parquet(staged)
    names = spark.read.schema(rows.select("name").schema).parquet(staged).groupBy("name").agg(F.count(F.lit(1)).alias("row_count"))
    there = [r.name for r in names.join(held.select("name"), "name", "left_semi").limit(5).collect()]
    if there:
        raise ValueError(f"datasets are in the store already: {sorted(there)}")
    entry = f"{target}/manifest/{restore}"
    manifest = names.select(F.lit(restore).alias("restore"), F.lit(repo).alias("repo"), F.lit(snapshot).alias("snapshot"), "name", "row_count")
    # A file becomes visible whole, so one file is the switch.
    manifest.coalesce(1).write.mode("overwrite").parquet(entry)
    return spark.read.schema(MANIFEST).parquet(entry)


def read_manifest(spark: SparkSession, target: str) -> DataFrame:
    """(restore, repo, snapshot, name, row_count) of all restores that were finished."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/manifest")
    if not folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).option("recursiveFileLookup", True).parquet(f"{target}/manifest")


def read_restored(spark: SparkSession, target: str) -> DataFrame:
    """Rows of all finished restores of a store; at least one is needed."""
    done = [r.restore for r in read_manifest(spark, target).select("restore").distinct().collect()]
    if not done:
        raise ValueError(f"nothing was restored into {target}")
    return spark.read.option("mergeSchema", True).parquet(*(f"{target}/data/{r}" for r in sorted(done)))

"""What streaming operators keep between micro-batches: keyed state in buckets, and a folded log of changes.

Both are folders next to a manifest for each micro-batch, written last, that says which folders make up
the whole.  Micro-batch N starts from the manifest of N-1 and writes folders and a manifest of its own,
so running N again after a failure gives the same state and the same output.  Folders that neither N nor
N-1 names are removed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def _remove(spark: SparkSession, path: str) -> None:
    files, at = _folder(spark, path)
    files.delete(at, True)


@dataclass(frozen=True)
class Manifests:
    """Per micro-batch, the (group, version) pairs that make up a table; as many as buckets or levels."""

    path: str

    def _at(self, epoch: int) -> str:
        return f"{self.path}/epoch={epoch}"

    def newest(self, spark: SparkSession) -> int | None:
        files, at = _folder(spark, self.path)
        if not files.exists(at):
            return None
        names = [f.getPath().getName() for f in files.listStatus(at)]
        return max((int(n[6:]) for n in names if n.startswith("epoch=") and self._done(spark, int(n[6:]))), default=None)

    def _done(self, spark: SparkSession, epoch: int) -> bool:
        files, at = _folder(spark, f"{self._at(epoch)}/_SUCCESS")
        return files.exists(at)

    def read(self, spark: SparkSession, epoch: int) -> set[tuple[int, int]]:
        """What made up the table after a micro-batch; nothing before the first one."""
        if epoch < 0:
            return set()
        if not self._done(spark, epoch):
            raise RuntimeError(f"there is no state of micro-batch {epoch}: the checkpoint and it do not belong together")
        return {(r.group, r.version) for r in spark.read.schema("group int, version bigint").parquet(self._at(epoch)).collect()}

    def write(self, spark: SparkSession, epoch: int, entries: set[tuple[int, int]], folder: Callable[[int, int], str]) -> None:
        """Make ``entries`` the table, and remove what was needed for micro-batch ``epoch - 1`` alone."""
        listed = spark.createDataFrame(sorted(entries), "group int, version bigint").coalesce(1)
        listed.write.mode("overwrite").parquet(self._at(epoch))
        if epoch >= 2 and self._done(spark, epoch - 2):
            for entry in self.read(spark, epoch - 2) - self.read(spark, epoch - 1) - entries:
                _remove(spark, folder(*entry))
            _remove(spark, self._at(epoch - 2))


@dataclass(frozen=True)
class StateTable:
    """One row per key, in buckets by a hash of the key: a micro-batch reads and replaces only those of its keys.

    With ``expire_after`` (an interval) keys whose ``ts`` is that much older than the newest of their
    bucket go when the bucket is replaced.
    """

    path: str
    keys: Sequence[str] = ("node",)
    buckets: int = 16
    expire_after: str | None = None

    @property
    def _manifests(self) -> Manifests:
        return Manifests(f"{self.path}/manifest")

    def _files(self, bucket: int, version: int) -> str:
        return f"{self.path}/v={version}/_bucket={bucket}"

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def touched(self, batch: DataFrame) -> list[int]:
        """The buckets of the batch's keys, of which there are at most ``buckets``."""
        return sorted(r[0] for r in batch.select(self.bucket()).distinct().collect())

    def read(self, spark: SparkSession, epoch: int, touched: Sequence[int]) -> DataFrame | None:
        """What the micro-batch before ``epoch`` left in the given buckets; None if nothing."""
        known = dict(self._manifests.read(spark, epoch - 1))
        paths = [self._files(b, known[b]) for b in touched if b in known]
        return spark.read.parquet(*paths) if paths else None

    def write(self, state: DataFrame, epoch: int, touched: Sequence[int]) -> None:
        """Replace the given buckets by ``state``, which has all their keys."""
        spark, whole = state.sparkSession, f"{self.path}/v={epoch}"
        state = state.withColumn("_bucket", self.bucket())
        if self.expire_after:
            newest = state.groupBy("_bucket").agg((F.max("ts") - F.expr(f"INTERVAL {self.expire_after}")).alias("_from"))
            state = state.join(newest, "_bucket").filter(F.col("ts") >= F.col("_from")).drop("_from")
        state.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(whole)
        written = {r[0] for r in spark.read.parquet(whole).select("_bucket").distinct().collect()} if touched else set()
        kept = {(b, v) for b, v in self._manifests.read(spark, epoch - 1) if b not in set(touched)}
        self._manifests.write(spark, epoch, kept | {(b, epoch) for b in written}, self._files)


@dataclass(frozen=True)
class ChangeLog:
    """Changes by micro-batch, folded: of ``every`` folders of a level one of the next level is made.

    ``fold`` brings rows of several micro-batches together; rows have their micro-batch as ``epoch``.
    A reader sees the folders of one manifest, at most ``every`` for each level.
    """

    path: str
    fold: Callable[[DataFrame], DataFrame]
    every: int = 8

    @property
    def _manifests(self) -> Manifests:
        return Manifests(f"{self.path}/manifest")

    def _files(self, level: int, version: int) -> str:
        return f"{self.path}/level={level}-{version}"

    def write(self, changes: DataFrame, epoch: int) -> None:
        spark = changes.sparkSession
        changes.withColumn("epoch", F.lit(epoch).cast("bigint")).write.mode("overwrite").parquet(self._files(0, epoch))
        entries, level = self._manifests.read(spark, epoch - 1) | {(0, epoch)}, 0
        while len(full := {e for e in entries if e[0] == level}) >= self.every:
            folded = self.fold(spark.read.parquet(*(self._files(*e) for e in sorted(full))))
            folded.write.mode("overwrite").parquet(self._files(level + 1, epoch))
            entries, level = entries - full | {(level + 1, epoch)}, level + 1
        self._manifests.write(spark, epoch, entries, self._files)

    def folders(self, spark: SparkSession) -> list[str]:
        """The folders that make up the newest consistent set."""
        newest = self._manifests.newest(spark)
        return [] if newest is None else [self._files(*e) for e in sorted(self._manifests.read(spark, newest))]

    def read(self, spark: SparkSession) -> DataFrame:
        return self.fold(spark.read.parquet(*self.folders(spark)))


def mark_late(batch: DataFrame, state: DataFrame | None, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``late``: not after the newest row of the key that was already handled.

    A delta against a baseline that has moved on means nothing, so late rows are set apart.
    """
    if state is None:
        return batch.withColumn("late", F.lit(False))
    newest = state.select(*keys, F.struct(*order).alias("_newest"))
    joined = batch.join(newest, list(keys), "left")
    return joined.withColumn("late", F.coalesce(F.struct(*order) <= F.col("_newest"), F.lit(False))).drop("_newest")

"""Tables that cut lineage: written once into the shared folder, then read by every later step."""

from __future__ import annotations

import pickle
import uuid
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from herdwatch.session import shared_dir


class _Call:
    """Is unpickled as the result of a call."""

    def __init__(self, *call):
        self.call = call

    def __reduce__(self) -> tuple:
        return self.call[0], self.call[1:]


def _revive(kind: type, state: dict):
    out = kind.__new__(kind)
    out.__dict__.update(state)
    return out


class Sendable:
    """Objects that take their class along when they are broadcast: executors need not have the package."""

    def __reduce__(self) -> tuple:
        return pickle.loads, (cloudpickle.dumps(_Call(_revive, type(self), self.__dict__)),)


#: Ids (8 bytes each) that are sent to all tasks rather than joined.
FEW = 1_000_000
#: Folders that steps have written and the next step removes, by session; and the running step's own.
_done: dict[int, list[str]] = {}
_running: list[list[str]] = []


def _path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    if _running:
        _running[-1].append(path)
    return path


@contextmanager
def step(docs: DataFrame):
    """A step of a chain in which each step's result is written before the next step begins.

    The tables that earlier steps have written along the way go, unless ``docs`` is still to be read
    from them; those of this step are kept until then.
    """
    spark, read, left = docs.sparkSession, docs.inputFiles(), []
    for path in _done.pop(id(spark), []):
        if any(path.rpartition("/")[2] in f for f in read):
            left.append(path)
            continue
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
    _running.append(left)
    try:
        yield
    finally:
        _done[id(spark)] = _running.pop()


def without(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not among ``ids``: few of these are sent to all tasks, many are joined."""
    ids = keep(ids.select(key).distinct(), "ids")
    return rows.join(F.broadcast(ids) if ids.count() <= FEW else ids, key, "left_anti")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into a fresh folder of the shared checkpoint folder and read it back.

    A lost executor then costs one task of a later step, not the steps before it.
    """
    path = _path(df.sparkSession, f"llm-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """``keep`` in buckets of ``key``: joins on it do not shuffle the table again.

    The table is registered while it is read and then dropped; its files stay in the shared folder.
    """
    spark, table = df.sparkSession, f"llm_{name}_{uuid.uuid4().hex}"
    path = _path(spark, table)
    df.write.bucketBy(buckets, key).option("path", path).saveAsTable(table)
    found = spark.table(table)
    found.schema  # resolved before the name goes
    spark.sql(f"DROP TABLE {table}")
    return found


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """(_rid, _doc): every row as a struct with a number of its own, written out so that the numbers stay.

    Ids may be null or repeated; what is decided about a row is joined back by its number.
    """
    whole = F.struct(*(docs[c] for c in docs.columns)).alias("_doc")
    return keep(docs.select(F.monotonically_increasing_id().alias("_rid"), whole), name)


def bounded_batches(spark: SparkSession, megabytes: int = 4, rows: int = 2_000, scanned: int = 512) -> None:
    """Bound what one Arrow batch between the JVM and Python, and one batch of a scan, can hold: texts may be very long."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(scanned))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{megabytes}m")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))

"""Node-stats samples as batch or stream, and the long metric table as a sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from herdwatch.schemas import NODE_STATS

TICK_SECONDS = 60


def read_node_stats(spark: SparkSession, path: str | list[str], fmt: str = "parquet") -> DataFrame:
    """Samples of all sections; ``fmt`` is any Spark file format that takes a schema."""
    return spark.read.schema(NODE_STATS).format(fmt).load(path)


def parse_node_stats(df: DataFrame, column: str) -> DataFrame:
    """Samples from a column of JSON text, with ``error`` and, where it is set, the ``raw`` text.

    Unknown fields are ignored.  Text that is no sample (``bad json``) or has no node (``no node``)
    gives a row as well, so that nothing vanishes; filter on ``error`` before using the samples.
    """
    parsed = F.from_json(F.col(column), NODE_STATS)
    rows = df.select(F.col(column).alias("_raw"), parsed.alias("_s"), F.try_parse_json(column).isNull().alias("_broken"))
    error = F.when(F.col("_broken"), "bad json").when(F.col("_s.node").isNull(), "no node")
    return rows.select("_s.*", error.alias("error"), F.when(error.isNotNull(), F.col("_raw")).alias("raw"))


def stream_node_stats(
    spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int | None = None
) -> DataFrame:
    """Samples as they arrive as files; start the query with a trigger of ``TICK_SECONDS``."""
    reader = spark.readStream.schema(NODE_STATS).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def write_metrics(long_metrics: DataFrame, path: str, mode: str = "append") -> None:
    """Write the long metric table partitioned by day.

    Hash-free writing would leave every task with a file per day; ``rebalance`` lets AQE size
    the files and split a day that is larger than others.
    """
    (
        long_metrics.withColumn("day", F.to_date("ts"))
        .hint("rebalance", "day")
        .write.mode(mode)
        .partitionBy("day")
        .parquet(path)
    )


def metrics_sink(path: str):
    """For ``foreachBatch``: each micro-batch goes to its own folder, so a retry replaces it."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write

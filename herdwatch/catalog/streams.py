"""Catalog entries for the streaming forms.

The samples arrive in four steps, cut by time: each step's files are written, then the query
is started again from its checkpoint and takes them as one micro-batch.  So every entry also
goes through restarts with state.  The oracles are those of the batch forms.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from herdwatch.catalog import telemetry as batch
from herdwatch.catalog import views
from herdwatch.catalog.base import Entry, with_views
from herdwatch.operators import counters
from herdwatch.session import shared_dir
from herdwatch.streaming import telemetry as streams

STEPS = 4
NOW = {"availableNow": True}


def _arrive(
    spark: SparkSession, sf_dir: str, start: Callable[[DataFrame, str], StreamingQuery], columns: tuple[str, ...] = (), held: str = "false"
) -> str:
    """Feed the samples step by step to the query that ``start`` starts; returns its folder.

    Those that ``held`` holds for arrive after all others.
    """
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = batch.samples(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.select(*columns) if columns else rows
    micros = F.unix_micros("ts")
    low, high = rows.agg(F.min(micros), F.max(micros)).first()
    step = F.floor((micros - low) * STEPS / (high - low + 1))
    for i in range(STEPS + (held != "false")):
        here = F.expr(held) if i == STEPS else ~F.expr(held) & (step == i)
        rows.filter(here).write.mode("append").parquet(f"{root}/in")
        start(spark.readStream.schema(rows.schema).parquet(f"{root}/in"), root).awaitTermination()
    return root


def _latencies(spark, sf_dir):
    def start(stream, root):
        return streams.stream_latencies(stream, f"{root}/out", f"{root}/cp", **NOW)

    counted = (c for op in counters.OPERATIONS.values() for c in op)
    root = _arrive(spark, sf_dir, start, ("node", "ts", "seq", *counted))
    columns = [f"{op}_{x}" for op in counters.OPERATIONS for x in ("delta", "time_delta", "latency_us")]
    return spark.read.parquet(f"{root}/out").select("node", "seq", *columns)


def _percentiles(spark, sf_dir):
    def start(stream, root):
        return streams.stream_latencies(stream, f"{root}/out", f"{root}/cp", percentile_of=list(counters.OPERATIONS), **NOW)

    counted = (c for op in counters.OPERATIONS.values() for c in op)
    root = _arrive(spark, sf_dir, start, ("node", "ts", "seq", *counted))
    return batch.by_operation(spark.read.parquet(f"{root}/out"))


def _signals(name: str, *columns: str):
    def start(stream, root):
        return streams.stream_process_signals(stream, f"{root}/out", f"{root}/cp", **NOW)

    def run(spark, sf_dir):
        root = _arrive(spark, sf_dir, start, ("node", "ts", "seq", "up"))
        return spark.read.parquet(f"{root}/out-{name}").select("node", "seq", *columns)

    return run


# One sample in fifty arrives last: late, but for those whose day is not over by the watermark.
HELD = "seq % 50 = 7"
LATE = f"{HELD} and date_trunc('day', ts) + interval 1 day <= (select max(ts) from samples where not ({HELD})) - interval 10 minute"


def _windows_root(spark, sf_dir):
    def start(stream, root):
        values = stream.withColumn("us", F.col("v") * 1000)
        return streams.stream_windows(values, f"{root}/out", f"{root}/cp", ["node"], "us", "1 day", **NOW)

    return _arrive(spark, sf_dir, start, ("node", "ts", "seq", "v"), HELD)


def _windows(spark, sf_dir):
    rows = streams.read_windows(spark, f"{_windows_root(spark, sf_dir)}/out", ["node"])
    return rows.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


def _late(spark, sf_dir):
    return spark.read.parquet(f"{_windows_root(spark, sf_dir)}/out-late").select("node", "seq", "v")


def _latest(spark, sf_dir):
    def start(stream, root):
        return streams.stream_updates(streams.latest_sample(stream), f"{root}/out", f"{root}/cp", ["node"], **NOW)

    columns = ("node", "seq", "v", "status", "store_size")
    root = _arrive(spark, sf_dir, start, ("ts", *columns))
    return streams.read_updates(spark, f"{root}/out", ["node"]).select(*columns)


def entries() -> list[Entry]:
    same = {e.name: e.oracle for e in batch.entries()}
    return [
        Entry("stream_interval_latency", _latencies, same["interval_latency"]),
        Entry(
            "stream_running_percentile",
            _percentiles,
            same["running_percentile"],
        ),
        Entry("stream_process_down", _signals("down", "down"), same["process_down"]),
        Entry("stream_transitions", _signals("transitions", "transition"), same["transitions"]),
        Entry(
            "stream_window_histogram",
            _windows,
            with_views(
                f"select node, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') as window_start, {batch._bound_sql('v * 1000')} as bound, count(*) as n "
                f"from samples where not ({LATE}) group by all",
                samples=views.SAMPLES,
            ),
        ),
        Entry("stream_window_late", _late, with_views(f"select node, seq, v from samples where {LATE}", samples=views.SAMPLES)),
        Entry("stream_latest_sample", _latest, same["latest_per_node"]),
    ]

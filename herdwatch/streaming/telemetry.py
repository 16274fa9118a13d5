"""Streaming forms of the telemetry operators.

Stateful ones run per micro-batch (``foreachBatch``) and write ``<out>/epoch=N``; a repeated
micro-batch replaces its own output.  Start them with ``trigger(processingTime="60 seconds")``
for the polling rhythm, or ``availableNow`` to catch up and stop.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from herdwatch.functions.buckets import to_bucket
from herdwatch.operators.counters import OPERATIONS, operation_deltas
from herdwatch.operators.health import process_down, transitions
from herdwatch.operators.histogram import PERCENTILES, counts_of_all, histogram, running_percentiles
from herdwatch.streaming.state import ChangeLog, StateTable, mark_late

WATERMARK = "10 minutes"
ORDER = ("ts", "seq")


def _start(stream: DataFrame, handle: Callable, checkpoint: str, mode: str = "append", **trigger) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", f"{checkpoint}/query")
    return writer.trigger(**(trigger or {"processingTime": "60 seconds"})).start()


def _per_batch(handle: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """The batch is read several times; keep it while it is handled.

    Streams switch adaptive execution off; these queries hold no state of their own and need it
    for joins on a hot key.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        batch.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")
        batch = batch.persist()
        try:
            handle(batch, epoch)
        finally:
            batch.unpersist()

    return run


def stream_latencies(
    samples: DataFrame,
    out: str,
    checkpoint: str,
    operations: Mapping[str, tuple[str, str]] = OPERATIONS,
    percentile_of: Sequence[str] = (),
    percentiles: Mapping[str, float] = PERCENTILES,
    keys: Sequence[str] = ("node",),
    expire_after: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Deltas and interval latency as samples arrive (G2), with running percentiles.

    Writes the samples with the columns of ``operation_deltas``; for each operation in
    ``percentile_of`` also ``<op>_<percentile>`` and ``<op>_overflowed``.  Late samples go to ``<out>-late``.
    """
    table = StateTable(f"{checkpoint}/state", keys, expire_after=expire_after)
    counters = [c for c, _ in operations.values()]
    timers = [t for _, t in operations.values()]

    def handle(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        touched = table.touched(batch)
        state = table.read(spark, epoch, touched)
        marked = mark_late(batch, state, keys, ORDER)
        marked.filter("late").drop("late").write.mode("overwrite").parquet(f"{out}-late/epoch={epoch}")
        fresh = marked.filter("NOT late").drop("late").withColumn("_seed", F.lit(False))
        if state is not None:
            # A key's state is written as one more sample, older than all new ones.
            # Keys that did not report need none.
            seeds = state.select(*keys, *ORDER, *counters, *timers).withColumn("_seed", F.lit(True))
            seeds = seeds.join(fresh.select(*keys).distinct(), list(keys), "left_semi")
            fresh = fresh.unionByName(seeds, allowMissingColumns=True)
        result = operation_deltas(fresh, operations, keys, keep_slices=bool(percentile_of))
        if percentile_of:
            # The seed rows are no intervals and must not count.
            named = {op: f"{op}_latency_us" for op in percentile_of}
            result = result.withColumns({c: F.when(~F.col("_seed"), F.col(c)) for c in named.values()})
            result = running_percentiles(result, named, keys, percentiles, ORDER, initial=state)
        result = result.filter("NOT _seed").drop("_seed", "_slice", "_part")
        result.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        table.write(_next_state(spark.read.parquet(f"{out}/epoch={epoch}"), state), epoch, touched)

    def _next_state(done: DataFrame, state: DataFrame | None) -> DataFrame:
        counted = done.groupBy(*keys).agg(
            F.max(F.struct(*ORDER)).alias("_at"),
            *(F.max(c).alias(c) for c in counters),
            *(F.max_by(t, F.struct(*ORDER)).alias(t) for t in timers),
        )
        new = counted.select(*keys, "_at.*", *counters, *timers)
        if percentile_of:
            latencies = [f"{op}_latency_us" for op in percentile_of]
            new = new.join(counts_of_all(done, keys, latencies, seen=state), list(keys), "full")
        if state is None:
            return new
        # At most two rows per key meet here.
        old = state.select(*keys, *(F.col(c).alias(f"_{c}") for c in new.columns if c not in keys))
        both = new.join(old, list(keys), "full")
        later = F.col("seq").isNotNull()
        merged = {
            **{c: F.when(later, F.col(c)).otherwise(F.col(f"_{c}")) for c in (*ORDER, *timers)},
            **{c: F.greatest(F.col(c), F.col(f"_{c}")) for c in counters},
        }
        if percentile_of:
            merged["seen"] = F.col("seen")  # earlier counts are in it
        return both.select(*keys, *(c.alias(n) for n, c in merged.items()))

    return _start(samples, _per_batch(handle), checkpoint, **trigger)


def stream_process_signals(
    samples: DataFrame, out: str, checkpoint: str, keys: Sequence[str] = ("node",), expire_after: str | None = None, **trigger
) -> StreamingQuery:
    """Down codes and up/down changes (G4): ``<out>-down``, ``<out>-transitions`` and ``<out>-late``."""
    table = StateTable(f"{checkpoint}/state", keys, expire_after=expire_after)

    def handle(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        touched = table.touched(batch)
        state = table.read(spark, epoch, touched)
        columns = [*keys, *ORDER, "up"]
        marked = mark_late(batch.select(*columns), state, keys, ORDER)
        marked.filter("late").drop("late").write.mode("overwrite").parquet(f"{out}-late/epoch={epoch}")
        fresh = marked.filter("NOT late").drop("late")
        here = fresh.select(*keys).distinct()
        fresh = fresh.withColumn("_seed", F.lit(False))

        def seeded(flag: str) -> DataFrame:
            if state is None:
                return fresh
            seeds = state.select(*keys, *ORDER, F.col(flag).alias("up"), F.lit(True).alias("_seed"))
            return fresh.unionByName(seeds.join(here, list(keys), "left_semi"))

        down = process_down(seeded("seen"), keys).filter("NOT _seed").drop("_seed")
        turned = transitions(seeded("last_up"), keys).filter("NOT _seed").drop("_seed")
        down.write.mode("overwrite").parquet(f"{out}-down/epoch={epoch}")
        turned.write.mode("overwrite").parquet(f"{out}-transitions/epoch={epoch}")

        rows = fresh.select(*keys, *ORDER, F.col("up").alias("seen"), F.col("up").alias("last_up"))
        rows = rows if state is None else rows.unionByName(state)
        newest = F.max_by(F.struct(*ORDER, "last_up"), F.struct(*ORDER))
        merged = rows.groupBy(*keys).agg(newest.alias("_n"), F.bool_or("seen").alias("seen"))
        table.write(merged.select(*keys, "_n.ts", "_n.seq", "seen", "_n.last_up"), epoch, touched)

    return _start(samples, _per_batch(handle), checkpoint, **trigger)


def window_histogram(samples: DataFrame, keys: Sequence[str], column: str, window: str, watermark: str = WATERMARK) -> DataFrame:
    """Streaming histogram per tumbling window (G5): a new window starts empty.

    Counts are aggregated before the shuffle and merged in the state store, which forgets
    windows once the watermark has passed them.
    """
    bucketed = samples.filter(F.col(column).isNotNull()).withColumn("bound", to_bucket(column))
    return (
        bucketed.withWatermark("ts", watermark)
        .groupBy(F.window("ts", window), *keys, "bound")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*keys, F.col("window.start").alias("window_start"), "bound", "n")
    )


def _added(keys: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.max("epoch").alias("epoch"))


def stream_windows(
    samples: DataFrame, out: str, checkpoint: str, keys: Sequence[str], column: str, window: str, watermark: str = WATERMARK, **trigger
) -> StreamingQuery:
    """Histograms per tumbling window (G5) that keep late rows: whole rows of windows which the watermark of
    the last finished micro-batch has passed go to ``<out>-late``, rows without a time as well.

    Counts of a micro-batch are added to a folded log, which ``read_windows`` reads.
    """
    counted = [*keys, "window_start", "bound"]
    log = ChangeLog(out, _added(counted))

    def handle(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{checkpoint}/mark/epoch={epoch - 1}").first()[0] if epoch else None
        # A window of a NULL time would drop the row.
        timed, timeless = batch.filter("ts IS NOT NULL").withColumn("_w", F.window("ts", window)), batch.filter("ts IS NULL")
        over = F.lit(False) if before is None else F.col("_w.end") <= F.lit(before) - F.expr(f"INTERVAL {watermark}")
        late = timed.filter(over).select(*batch.columns).unionByName(timeless)
        late.write.mode("overwrite").parquet(f"{out}-late/epoch={epoch}")
        fresh = timed.filter(~over & F.col(column).isNotNull()).withColumn("window_start", F.col("_w.start"))
        log.write(histogram(fresh, [*keys, "window_start"], column), epoch)
        mark = batch.agg(F.greatest(F.max("ts").cast("timestamp"), F.lit(before).cast("timestamp")).alias("mark"))
        mark.coalesce(1).write.mode("overwrite").parquet(f"{checkpoint}/mark/epoch={epoch}")

    return _start(samples, _per_batch(handle), checkpoint, **trigger)


def read_windows(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    """What ``stream_windows`` has counted: ``(*keys, window_start, bound, n)``."""
    return ChangeLog(out, _added([*keys, "window_start", "bound"])).read(spark).drop("epoch")


def latest_sample(samples: DataFrame, keys: Sequence[str] = ("node",)) -> DataFrame:
    """Streaming newest sample per key (G6), for update mode."""
    newest = F.max_by(F.struct("*"), F.struct(*ORDER)).alias("_newest")
    return samples.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(newest).select("_newest.*")


def _last(keys: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """The last change of each key."""

    def fold(rows: DataFrame) -> DataFrame:
        values = [c for c in rows.columns if c not in keys]
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "epoch").alias("_v"))
        return last.select(*keys, "_v.*")

    return fold


def stream_updates(updates: DataFrame, out: str, checkpoint: str, keys: Sequence[str], every: int = 8, **trigger) -> StreamingQuery:
    """Write the changed rows of an update-mode aggregate (a row per key), micro-batch by micro-batch, and fold them."""
    log = ChangeLog(out, _last(keys), every)

    def handle(batch: DataFrame, epoch: int) -> None:
        log.write(batch, epoch)

    return _start(updates, handle, checkpoint, "update", **trigger)


def read_updates(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    """The current state of what ``stream_updates`` wrote: the last change of each key."""
    return ChangeLog(out, _last(keys)).read(spark).drop("epoch")

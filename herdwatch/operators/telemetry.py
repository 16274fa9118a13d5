"""Flat metrics from nested node-stats samples.

All section operators return the keys ``node, ts, seq`` and the section's metrics, and leave
out samples without that section.  Values the reference data model names but never fills are
left out; constant zeros are kept where they are published as such.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from herdwatch.operators.counters import lifetime_avg
from herdwatch.sources.node_stats import TICK_SECONDS

IDS = ("node", "ts", "seq")


def one_sample_per_tick(
    df: DataFrame, keys: Sequence[str] = ("node",), tick_seconds: int = TICK_SECONDS, order: Sequence[str] = ("ts", "seq")
) -> DataFrame:
    """Keep the first sample of each key in each tick.

    The rank filter is applied before the shuffle as well, so copies of one tick are dropped
    where they are read and never meet in one task.
    """
    tick = F.floor(F.unix_seconds(F.col(order[0]).cast("timestamp")) / tick_seconds)
    first = Window.partitionBy(*keys, "_tick").orderBy(*order)
    return (
        df.withColumn("_tick", tick)
        .withColumn("_rank", F.row_number().over(first))
        .filter(F.col("_rank") == 1)
        .drop("_tick", "_rank")
    )


def usable(df: DataFrame, section: str) -> DataFrame:
    """Samples taken while the process was up and that carry the section."""
    return df.filter(F.col("up") & F.col(section).isNotNull())


def _section(df: DataFrame, section: str, **metrics: Column) -> DataFrame:
    present = df.filter(F.col(section).isNotNull())
    return present.select(*IDS, *(c.alias(n) for n, c in metrics.items()))


def indices_metrics(df: DataFrame) -> DataFrame:
    """Store, docs, refresh, flush, merge, field cache and the plain search/get/indexing values."""
    i = "indices"

    def col(path: str) -> Column:
        return F.col(f"{i}.{path}")

    return _section(
        df,
        i,
        store_size=col("store.size"),
        store_throttle_time=col("store.throttle_time"),
        docs_count=col("docs.count"),
        docs_deleted=col("docs.deleted"),
        refresh_total=col("refresh.total"),
        refresh_total_time=col("refresh.total_time"),
        refresh_avg_time_in_millis_per_request=lifetime_avg(col("refresh.total_time"), col("refresh.total")),
        flush_total=col("flush.total"),
        flush_total_time=col("flush.total_time"),
        flush_avg_time_in_millis_per_request=lifetime_avg(col("flush.total_time"), col("flush.total")),
        merges_current=col("merge.current"),
        merges_current_docs=col("merge.current_docs"),
        merges_current_size=col("merge.current_size"),
        merges_total=col("merge.total"),
        merges_total_time=col("merge.total_time"),
        merges_total_size=col("merge.total_size"),
        cache_field_evictions=col("fielddata.evictions"),
        cache_field_size=col("fielddata.size"),
        search_query_total=col("search.query_total"),
        search_query_time=col("search.query_time"),
        search_query_current=col("search.query_current"),
        search_query_avg_time_in_millis_per_request=lifetime_avg(col("search.query_time"), col("search.query_total")),
        search_fetch_total=col("search.fetch_total"),
        search_fetch_time=col("search.fetch_time"),
        search_fetch_current=col("search.fetch_current"),
        search_fetch_avg_time_in_millis_per_request=lifetime_avg(col("search.fetch_time"), col("search.fetch_total")),
        get_total=col("get.total"),
        get_time=col("get.time"),
        get_current=col("get.current"),
        total_avg_time_in_millis_per_request=lifetime_avg(col("get.time"), col("get.total")),
        get_exists_total=col("get.exists_total"),
        get_exists_time=col("get.exists_time"),
        exists_avg_time_in_millis_per_request=lifetime_avg(col("get.exists_time"), col("get.exists_total")),
        get_missing_total=col("get.missing_total"),
        get_missing_time=col("get.missing_time"),
        missing_avg_time_in_millis_per_request=lifetime_avg(col("get.missing_time"), col("get.missing_total")),
        indexing_index_total=col("indexing.index_total"),
        indexing_index_time=col("indexing.index_time"),
        indexing_index_current=col("indexing.index_current"),
        indexing_avg_time_in_millis_per_request=lifetime_avg(col("indexing.index_time"), col("indexing.index_total")),
        indexing_delete_total=col("indexing.delete_total"),
        indexing_delete_time=col("indexing.delete_time"),
        indexing_delete_current=col("indexing.delete_current"),
        indexing_delete_avg_time_in_millis_per_request=lifetime_avg(
            col("indexing.delete_time"), col("indexing.delete_total")
        ),
    )


def fs_metrics(df: DataFrame) -> DataFrame:
    """File-system sizes and the whole percentage available; NULL for a disk of size 0."""
    total, available = F.col("fs.total"), F.col("fs.available")
    return _section(
        df,
        "fs",
        total_bytes=total,
        free_bytes=F.col("fs.free"),
        available_bytes=available,
        available_disk_percent=F.when(total != 0, F.call_function("div", available * 100, total)),
    )


def os_metrics(df: DataFrame) -> DataFrame:
    """Memory, CPU and swap.  ``cpu_sys`` is the total CPU percentage; the zeros are constants."""
    zero = F.lit(0).cast("short")
    return _section(
        df,
        "os",
        free_in_bytes=F.col("os.mem_free"),
        used_in_bytes=F.col("os.mem_used"),
        actual_free_in_bytes=F.col("os.mem_free"),
        actual_used_in_bytes=F.col("os.mem_used"),
        free_percent=F.col("os.free_percent").cast("short"),
        used_percent=F.col("os.used_percent").cast("short"),
        cpu_sys=F.col("os.cpu_percent").cast("short"),
        cpu_user=zero,
        cpu_idle=zero,
        cpu_stolen=zero,
        swap_free_in_bytes=F.col("os.swap_free"),
        swap_used_in_bytes=F.col("os.swap_used"),
        uptime_in_millis=F.lit(0).cast("bigint"),
        os_timestamp=F.col("os.timestamp"),
    )


def process_metrics(df: DataFrame) -> DataFrame:
    return _section(
        df,
        "process",
        total_virtual_in_bytes=F.col("process.virtual"),
        cpu_percent=F.col("process.cpu_percent").cast("short"),
        total_in_millis=F.col("process.cpu_total_ms"),
        open_file_descriptors=F.col("process.open_files"),
        cpu_timestamp=F.col("process.timestamp"),
    )


def http_metrics(df: DataFrame) -> DataFrame:
    return _section(df, "http", server_open=F.col("http.server_open"), total_open=F.col("http.total_open"))


def jvm_metrics(df: DataFrame) -> DataFrame:
    """Heap in whole MB, threads, uptime in whole hours."""

    def mb(path: str) -> Column:
        return F.call_function("div", F.col(path), F.lit(1 << 20))

    return _section(
        df,
        "jvm",
        heap_committed_mb=mb("jvm.mem.heap_committed"),
        heap_max_mb=mb("jvm.mem.heap_max"),
        heap_used_mb=mb("jvm.mem.heap_used"),
        heap_used_percent=F.col("jvm.mem.heap_used_percent"),
        non_heap_committed_mb=mb("jvm.mem.non_heap_committed"),
        non_heap_used_mb=mb("jvm.mem.non_heap_used"),
        threads_count=F.col("jvm.threads.count"),
        threads_peak_count=F.col("jvm.threads.peak"),
        uptime_hours=F.call_function("div", F.col("jvm.uptime_ms"), F.lit(3_600_000)),
    )


def _pick(
    df: DataFrame,
    array: str,
    section: str,
    names: Sequence[str],
    fields: Mapping[str, str],
    label: str,
    ignore_case: bool = False,
) -> DataFrame:
    """Metrics from an array of named structs: the last element of each name, field by field.

    Works inside the row, so pivoting needs neither an explode nor a shuffle.  A name that
    does not occur gives NULL metrics.
    """

    def named(name: str) -> Column:
        return F.filter(F.col(array), lambda e: (F.lower(e["name"]) if ignore_case else e["name"]) == name)

    metrics = {}
    for name in names:
        last = F.try_element_at(named(name), F.lit(-1))
        for field, suffix in fields.items():
            metrics[label.format(name=name, field=suffix)] = last[field]
    return _section(df, section, **metrics)


def jvm_pools(df: DataFrame) -> DataFrame:
    """Young, survivor and old memory pools; names match in any case."""
    fields = {"used": "used", "max": "max", "peak_used": "peak_used", "peak_max": "peak_max"}
    return _pick(df, "jvm.pools", "jvm", ("young", "survivor", "old"), fields, "{name}_{field}_in_bytes", True)


def jvm_gc(df: DataFrame) -> DataFrame:
    fields = {"count": "count", "time_ms": "time_in_millis"}
    return _pick(df, "jvm.gc", "jvm", ("young", "old"), fields, "{name}_collection_{field}", True)


def thread_pool_metrics(df: DataFrame) -> DataFrame:
    """Index, get, search and bulk pools; names match exactly, other pools are left out."""
    fields = {f: f for f in ("threads", "queue", "active", "rejected", "largest", "completed")}
    return _pick(df, "thread_pools", "thread_pools", ("index", "get", "search", "bulk"), fields, "{name}_{field}")


def breaker_metrics(df: DataFrame) -> DataFrame:
    """Field-data and request circuit breakers."""
    fields = {
        "estimated": "estimated_size_in_bytes",
        "limit": "limit_maximum_size_in_bytes",
        "overhead": "overhead",
        "tripped": "tripped_count",
    }
    has_any = df.filter(F.size("breakers") > 0)
    return _pick(has_any, "breakers", "breakers", ("fielddata", "request"), fields, "{name}_{field}")


# Metrics published as counters; every other metric is a gauge.  Fixed values.
COUNTER_METRICS = (
    "bulk_completed", "bulk_rejected", "flush_total", "flush_total_time", "get_completed", "get_exists_time",
    "get_exists_total", "get_missing_time", "get_missing_total", "get_rejected", "get_time", "get_total",
    "index_completed", "index_rejected", "indexing_delete_time", "indexing_delete_total", "indexing_index_time",
    "indexing_index_total", "merges_total", "merges_total_time", "refresh_total", "refresh_total_time",
    "search_completed", "search_fetch_time", "search_fetch_total", "search_query_time", "search_query_total",
    "search_rejected",
)


#: From this n on Spark no longer limits groups before the shuffle; PARTS of a key are ranked apart then.
GROUP_LIMIT, PARTS = 1_000, 64


def to_long_metrics(df: DataFrame, ids: Sequence[str] = IDS) -> DataFrame:
    """One row per sample and metric: ``(*ids, metric, kind, value, long_value)``.

    ``value`` is a DOUBLE; ``long_value`` holds whole numbers exactly, which a DOUBLE does not beyond
    2**53, and is NULL for metrics that are no whole numbers.
    """
    whole = {f.name for f in df.schema if f.dataType.typeName() in ("byte", "short", "integer", "long")}

    def entry(m: str) -> Column:
        exact = F.col(m).cast("bigint") if m in whole else F.lit(None).cast("bigint")
        return F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), exact.alias("long_value"))

    entries = F.explode(F.array(*(entry(c) for c in df.columns if c not in ids)))
    kind = F.when(F.col("_m.metric").isin(*COUNTER_METRICS), "COUNTER").otherwise("GAUGE")
    return df.select(*ids, entries.alias("_m")).select(*ids, "_m.metric", kind.alias("kind"), "_m.value", "_m.long_value")


def latest_per_node(df: DataFrame, keys: Sequence[str] = ("node",), order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """The newest sample of each key.  Every task first keeps its own newest row per key."""
    newest = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") == 1).drop("_rank")


def top_n_distinct(df: DataFrame, keys: Sequence[str], column: str, n: int) -> DataFrame:
    """The n largest distinct values per key, with their rank.

    Distinct values are counted before ranking; tasks keep n candidates per key each, so only
    these meet.  Spark does that by itself for small n; for larger ones a key's values are first
    ranked in parts, of which each keeps n.
    """
    distinct = df.filter(F.col(column).isNotNull()).select(*keys, column).distinct()
    largest = Window.partitionBy(*keys).orderBy(F.col(column).desc())
    if n >= GROUP_LIMIT:
        parts = Window.partitionBy(*keys, "_part").orderBy(F.col(column).desc())
        split = distinct.withColumn("_part", F.pmod(F.xxhash64(column), F.lit(PARTS)))
        distinct = split.withColumn("_rank", F.row_number().over(parts)).filter(F.col("_rank") <= n).select(*keys, column)
    return distinct.withColumn("rank", F.row_number().over(largest)).filter(F.col("rank") <= n)

"""Catalog entries for telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from herdwatch.catalog import views
from herdwatch.catalog.base import Entry, on_spark, with_views
from herdwatch.functions.buckets import OVERFLOW, hist_label, to_bucket
from herdwatch.operators import counters, health, histogram, telemetry
from herdwatch.plans.slices import DAY
from herdwatch.sources.node_stats import parse_node_stats

W = "(partition by node order by ts, seq)"
BEFORE = "(partition by node order by ts, seq rows between unbounded preceding and 1 preceding)"
RUN = "(partition by node order by ts, seq rows between unbounded preceding and current row)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_spark(spark, sf_dir, views.SAMPLES)


def _struct(**fields: str):
    return F.struct(*(F.col(c).alias(n) for n, c in fields.items()))


def nested_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples as ``NODE_STATS``; samples without a status have no indices and fs section."""
    flat = samples(spark, sf_dir)
    v = F.col("v")

    def entry(name: str, **fields):
        return F.struct(F.lit(name).alias("name"), *(c.cast(t).alias(n) for n, (c, t) in fields.items()))

    def pool(name: str, factor: int):
        return entry(
            name,
            used=(v * factor, "bigint"),
            max=(v * factor + 100, "bigint"),
            peak_used=(v * factor + 10, "bigint"),
            peak_max=(v * factor + 200, "bigint"),
        )

    def collector(name: str, factor: int):
        return entry(name, count=(v % factor, "bigint"), time_ms=(v * factor, "bigint"))

    def threads(name: str, factor: int):
        return entry(
            name,
            threads=(F.lit(factor), "bigint"),
            queue=(v % factor, "bigint"),
            active=(v % (factor + 1), "bigint"),
            rejected=(v * factor, "bigint"),
            largest=(v + factor, "bigint"),
            completed=(F.col("seq") * factor, "bigint"),
        )

    def breaker(name: str, factor: int):
        return entry(
            name,
            estimated=(v * factor, "bigint"),
            limit=(v * factor * 2, "bigint"),
            overhead=(F.lit(1.0) + F.lit(factor) / 4, "double"),
            tripped=(v % factor, "bigint"),
        )

    indices = F.struct(
        _struct(size="store_size", throttle_time="store_throttle_time").alias("store"),
        _struct(count="docs_count", deleted="docs_deleted").alias("docs"),
        _struct(total="refresh_total", total_time="refresh_total_time").alias("refresh"),
        _struct(total="flush_total", total_time="flush_total_time").alias("flush"),
        _struct(
            current="merges_current", current_docs="merges_current_docs", current_size="merges_current_size",
            total="merges_total", total_time="merges_total_time", total_size="merges_total_size",
        ).alias("merge"),
        _struct(evictions="cache_field_evictions", size="cache_field_size").alias("fielddata"),
        _struct(
            query_total="search_query_total", query_time="search_query_time", query_current="search_query_current",
            fetch_total="search_fetch_total", fetch_time="search_fetch_time", fetch_current="search_fetch_current",
        ).alias("search"),
        _struct(
            total="get_total", time="get_time", current="get_current", exists_total="get_exists_total",
            exists_time="get_exists_time", missing_total="get_missing_total", missing_time="get_missing_time",
        ).alias("get"),
        _struct(
            index_total="indexing_index_total", index_time="indexing_index_time",
            index_current="indexing_index_current", delete_total="indexing_delete_total",
            delete_time="indexing_delete_time", delete_current="indexing_delete_current",
        ).alias("indexing"),
    )
    jvm = F.struct(
        _struct(
            heap_committed="heap_committed", heap_max="heap_max", heap_used="heap_used",
            heap_used_percent="heap_used_percent", non_heap_committed="non_heap_committed",
            non_heap_used="non_heap_used",
        ).alias("mem"),
        _struct(count="threads_count", peak="threads_peak").alias("threads"),
        F.col("uptime_ms"),
        # The survivor pool is missing from every third sample.
        F.filter(
            F.array(pool("Young", 3), pool("metaspace", 5), pool("SURVIVOR", 7), pool("old", 11)),
            lambda p: (p["name"] != "SURVIVOR") | (v % 3 != 0),
        ).alias("pools"),
        F.array(collector("young", 13), collector("Old", 17), collector("mixed", 19)).alias("gc"),
    )
    has_status = F.col("status").isNotNull()
    return flat.select(
        "node",
        F.col("ts").cast("timestamp").alias("ts"),
        "seq",
        "up",
        "status",
        "nodes",
        F.when(has_status, indices).alias("indices"),
        F.when(has_status, _struct(total="fs_total", free="fs_free", available="fs_available")).alias("fs"),
        _struct(
            mem_free="os_mem_free", mem_used="os_mem_used", free_percent="os_free_percent",
            used_percent="os_used_percent", cpu_percent="os_cpu_percent", swap_free="os_swap_free",
            swap_used="os_swap_used", timestamp="os_timestamp",
        ).alias("os"),
        _struct(
            virtual="process_virtual", cpu_percent="process_cpu_percent", cpu_total_ms="process_cpu_total",
            open_files="process_files", timestamp="process_timestamp",
        ).alias("process"),
        _struct(server_open="http_server_open", total_open="http_total_open").alias("http"),
        _struct(
            server_open="transport_server_open", rx_count="rx_count", rx_size="rx_size", tx_count="tx_count",
            tx_size="tx_size",
        ).alias("transport"),
        jvm.alias("jvm"),
        F.array(
            threads("index", 2), threads("get", 3), threads("search", 5), threads("bulk", 7), threads("INDEX", 9)
        ).alias("thread_pools"),
        F.when(v % 5 == 0, F.array().cast("array<struct<name:string,estimated:bigint,limit:bigint,overhead:double,tripped:bigint>>"))
        .otherwise(F.array(breaker("fielddata", 2), breaker("parent", 3), breaker("request", 5)))
        .alias("breakers"),
    )


def _delta_sql(total: str) -> str:
    return f"greatest({total} - greatest(coalesce(max({total}) over {BEFORE}, 0), 0), 0)"


def _timer_sql(time: str) -> str:
    return f"{time} - coalesce(lag({time}) over {W}, 0)"


def _deltas_sql(ops: dict[str, tuple[str, str]]) -> str:
    """Subquery text: samples with delta, time delta and latency per operation."""
    deltas = ", ".join(
        f"cast({_delta_sql(t)} as bigint) as {op}_delta, cast({_timer_sql(m)} as bigint) as {op}_time_delta"
        for op, (t, m) in ops.items()
    )
    latency = ", ".join(
        f"case when {op}_delta <> 0 then {op}_time_delta // {op}_delta * 1000 end as {op}_latency_us" for op in ops
    )
    return f"select *, {latency} from (select *, {deltas} from samples) as d"


# Made in SQL, so that a wrong bound in the library shows.
BOUND_LIST = (
    "(with recursive steps(i, b) as (select 1, cast(1 as bigint) union all "
    "select i + 1, greatest(b + 1, cast(floor(b * cast(1.2 as double) + 0.5) as bigint)) from steps where i < 90) select list(b order by i) from steps)"
)


def _bound_sql(value: str) -> str:
    return (
        f"case when {value} is not null then coalesce(list_min(list_filter({BOUND_LIST}, lambda b: b >= {value})), "
        f"{OVERFLOW}) end"
    )


def _oracle(body: str, **more: str) -> str:
    return with_views(body, samples=views.SAMPLES, **more)


ONE_OP = {"search_query": counters.OPERATIONS["search_query"]}
TWO_OPS = {op: counters.OPERATIONS[op] for op in ("search_query", "index_delete")}


def latencies(spark: SparkSession, sf_dir: str, ops=ONE_OP, keep_slices: bool = False) -> DataFrame:
    return counters.operation_deltas(samples(spark, sf_dir), ops, keep_slices=keep_slices)


def long_latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(node, op, us)`` for all operation types."""
    wide = latencies(spark, sf_dir, counters.OPERATIONS)
    named = wide.select("node", *(F.col(f"{op}_latency_us").alias(op) for op in counters.OPERATIONS))
    return named.unpivot(["node"], list(counters.OPERATIONS), "op", "us")


def by_operation(wide: DataFrame, *more: str) -> DataFrame:
    """Samples with running percentiles of all operations, as one row per sample and operation."""
    fields = {"us": "latency_us", "p95": "p95", "p99": "p99", "overflowed": "overflowed", **{m: m for m in more}}
    each = [F.struct(F.lit(op).alias("op"), *(F.col(f"{op}_{c}").alias(n) for n, c in fields.items())) for op in counters.OPERATIONS]
    return wide.select("node", "seq", F.explode(F.array(*each)).alias("_o")).select("node", "seq", "_o.*")


LATENCIES = {op: f"{op}_latency_us" for op in counters.OPERATIONS}


def running_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running percentiles of all seven operations, in one pass over the deltas."""
    deltas = latencies(spark, sf_dir, counters.OPERATIONS, keep_slices=True)
    return by_operation(histogram.running_percentiles(deltas, LATENCIES))


def running_overflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running percentiles, and the overflowed samples of each node and operation: how many, their smallest number."""
    deltas = latencies(spark, sf_dir, counters.OPERATIONS, keep_slices=True)
    # Flags alone are cheap, and their input is the same shuffle.
    flags, totals = histogram.running_percentiles(deltas, LATENCIES, percentiles={}), {}
    for op in counters.OPERATIONS:
        over = F.col(f"{op}_overflowed")
        totals |= {f"{op}_ticks": F.count_if(over), f"{op}_first_seq": F.min(F.when(over, F.col("seq")))}
    per_node = flags.groupBy(F.col("node").alias("_node")).agg(*(c.alias(n) for n, c in totals.items()))
    # Every node has its row, and so have samples without a node.
    wide = histogram.running_percentiles(deltas, LATENCIES).join(per_node, F.col("node").eqNullSafe(F.col("_node")))
    return by_operation(wide, "ticks", "first_seq")


LONG_LATENCIES = " union all ".join(
    f"select node, '{op}' as op, {op}_latency_us as us from d" for op in counters.OPERATIONS
)
HIST = f"select node, op, bound, count(*) as n from (select node, op, {_bound_sql('us')} as bound from l where us is not null) as x group by all"


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: p95 and p99 interval latency per node and operation from raw counters."""
    hist = histogram.histogram(long_latencies(spark, sf_dir), ["node", "op"], "us")
    return histogram.hist_percentile(hist, ["node", "op"])


def _sections() -> list[Entry]:
    def entry(name: str, op, body: str) -> Entry:
        def run(spark, sf_dir):
            return op(nested_samples(spark, sf_dir)).drop("ts")

        return Entry(name, run, _oracle(body))

    def avg(time: str, total: str, name: str) -> str:
        return f"case when {total} <> 0 then cast({time} // {total} as double) else 0.0 end as {name}"

    indices = ", ".join(
        [
            "store_size, store_throttle_time, docs_count, docs_deleted, refresh_total, refresh_total_time",
            avg("refresh_total_time", "refresh_total", "refresh_avg_time_in_millis_per_request"),
            "flush_total, flush_total_time",
            avg("flush_total_time", "flush_total", "flush_avg_time_in_millis_per_request"),
            "merges_current, merges_current_docs, merges_current_size, merges_total, merges_total_time",
            "merges_total_size, cache_field_evictions, cache_field_size, search_query_total, search_query_time",
            "search_query_current, search_fetch_total, search_fetch_time, search_fetch_current",
            avg("search_query_time", "search_query_total", "search_query_avg_time_in_millis_per_request"),
            avg("search_fetch_time", "search_fetch_total", "search_fetch_avg_time_in_millis_per_request"),
            "get_total, get_time, get_current, get_exists_total, get_exists_time, get_missing_total, get_missing_time",
            avg("get_time", "get_total", "total_avg_time_in_millis_per_request"),
            avg("get_exists_time", "get_exists_total", "exists_avg_time_in_millis_per_request"),
            avg("get_missing_time", "get_missing_total", "missing_avg_time_in_millis_per_request"),
            "indexing_index_total, indexing_index_time, indexing_index_current, indexing_delete_total",
            "indexing_delete_time, indexing_delete_current",
            avg("indexing_index_time", "indexing_index_total", "indexing_avg_time_in_millis_per_request"),
            avg("indexing_delete_time", "indexing_delete_total", "indexing_delete_avg_time_in_millis_per_request"),
        ]
    )

    def pool(name: str, factor: int, when: str = "true") -> str:
        return ", ".join(
            f"case when {when} then v * {factor} + {add} end as {name}_{f}_in_bytes"
            for f, add in (("used", 0), ("max", 100), ("peak_used", 10), ("peak_max", 200))
        )

    def threads(name: str, factor: int) -> str:
        return (
            f"cast({factor} as bigint) as {name}_threads, v % {factor} as {name}_queue, v % {factor + 1} as {name}_active, "
            f"v * {factor} as {name}_rejected, v + {factor} as {name}_largest, seq * {factor} as {name}_completed"
        )

    def breaker(name: str, factor: int) -> str:
        return (
            f"v * {factor} as {name}_estimated_size_in_bytes, v * {factor * 2} as {name}_limit_maximum_size_in_bytes, "
            f"cast({1 + factor / 4} as double) as {name}_overhead, v % {factor} as {name}_tripped_count"
        )

    short = "cast({} as smallint) as {}".format
    return [
        entry("indices_metrics", telemetry.indices_metrics, f"select node, seq, {indices} from samples where status is not null"),
        entry(
            "fs_metrics",
            telemetry.fs_metrics,
            "select node, seq, fs_total as total_bytes, fs_free as free_bytes, fs_available as available_bytes, "
            "case when fs_total <> 0 then fs_available * 100 // fs_total end as available_disk_percent from samples where status is not null",
        ),
        entry(
            "os_metrics",
            telemetry.os_metrics,
            "select node, seq, os_mem_free as free_in_bytes, os_mem_used as used_in_bytes, os_mem_free as actual_free_in_bytes, "
            "os_mem_used as actual_used_in_bytes, "
            + ", ".join([short("os_free_percent", "free_percent"), short("os_used_percent", "used_percent"), short("os_cpu_percent", "cpu_sys"), short(0, "cpu_user"), short(0, "cpu_idle"), short(0, "cpu_stolen")])
            + ", os_swap_free as swap_free_in_bytes, os_swap_used as swap_used_in_bytes, cast(0 as bigint) as uptime_in_millis, os_timestamp from samples",
        ),
        entry(
            "process_metrics",
            telemetry.process_metrics,
            f"select node, seq, process_virtual as total_virtual_in_bytes, {short('process_cpu_percent', 'cpu_percent')}, "
            "process_cpu_total as total_in_millis, process_files as open_file_descriptors, process_timestamp as cpu_timestamp from samples",
        ),
        entry("http_metrics", telemetry.http_metrics, "select node, seq, http_server_open as server_open, http_total_open as total_open from samples"),
        entry(
            "jvm_metrics",
            telemetry.jvm_metrics,
            "select node, seq, heap_committed // 1048576 as heap_committed_mb, heap_max // 1048576 as heap_max_mb, "
            "heap_used // 1048576 as heap_used_mb, heap_used_percent, non_heap_committed // 1048576 as non_heap_committed_mb, "
            "non_heap_used // 1048576 as non_heap_used_mb, threads_count, threads_peak as threads_peak_count, "
            "uptime_ms // 3600000 as uptime_hours from samples",
        ),
        entry("jvm_pools", telemetry.jvm_pools, f"select node, seq, {pool('young', 3)}, {pool('survivor', 7, 'v % 3 <> 0')}, {pool('old', 11)} from samples"),
        entry(
            "jvm_gc",
            telemetry.jvm_gc,
            "select node, seq, v % 13 as young_collection_count, v * 13 as young_collection_time_in_millis, "
            "v % 17 as old_collection_count, v * 17 as old_collection_time_in_millis from samples",
        ),
        entry(
            "thread_pool_metrics",
            telemetry.thread_pool_metrics,
            f"select node, seq, {threads('index', 2)}, {threads('get', 3)}, {threads('search', 5)}, {threads('bulk', 7)} from samples",
        ),
        entry("breaker_metrics", telemetry.breaker_metrics, f"select node, seq, {breaker('fielddata', 2)}, {breaker('request', 5)} from samples where v % 5 <> 0"),
        entry(
            "transport_metrics",
            counters.transport_metrics,
            "select node, seq, transport_server_open as server_open, rx_count, rx_size, tx_count, tx_size, "
            f"{_timer_sql('rx_size')} as rx_size_delta, {_timer_sql('tx_size')} as tx_size_delta from samples",
        ),
    ]


def _read(spark, sf_dir):
    """Every third sample has its text cut short: it comes back as a row with an error."""
    text = F.to_json(F.struct("*"))
    as_json = nested_samples(spark, sf_dir).select(F.when(F.col("seq") % 3 == 0, F.left(text, F.lit(10))).otherwise(text).alias("j"))
    return parse_node_stats(as_json, "j").select(
        "error",
        "node",
        "seq",
        "up",
        "status",
        "nodes",
        F.col("indices.search.query_time").alias("query_time"),
        F.col("jvm.uptime_ms").alias("uptime_ms"),
        F.size("thread_pools").cast("bigint").alias("pools"),
        F.try_element_at("breakers", F.lit(1))["overhead"].alias("overhead"),
    )


def _long_metrics(spark, sf_dir):
    nested = nested_samples(spark, sf_dir)
    fs = telemetry.to_long_metrics(telemetry.fs_metrics(nested))
    pools = telemetry.to_long_metrics(telemetry.thread_pool_metrics(nested))
    return fs.unionByName(pools).drop("ts")


def _long_metrics_sql() -> str:
    fs = {
        "total_bytes": "fs_total",
        "free_bytes": "fs_free",
        "available_bytes": "fs_available",
        "available_disk_percent": "case when fs_total <> 0 then fs_available * 100 // fs_total end",
    }
    rows = [
        f"select node, seq, '{m}' as metric, 'GAUGE' as kind, cast({e} as double) as value, cast({e} as bigint) as long_value from samples where status is not null"
        for m, e in fs.items()
    ]
    for name, factor in (("index", 2), ("get", 3), ("search", 5), ("bulk", 7)):
        values = {
            "threads": f"{factor}",
            "queue": f"v % {factor}",
            "active": f"v % {factor + 1}",
            "rejected": f"v * {factor}",
            "largest": f"v + {factor}",
            "completed": f"seq * {factor}",
        }
        rows += [
            f"select node, seq, '{name}_{f}', '{'COUNTER' if f in ('rejected', 'completed') else 'GAUGE'}', cast({e} as double), cast({e} as bigint) from samples"
            for f, e in values.items()
        ]
    return " union all ".join(rows)


def _health(spark, sf_dir):
    # A user's samples are those of a cluster; 4 is the count by discovery.
    df = samples(spark, sf_dir).select("node", "seq", "ts", "status", "nodes", F.concat(F.lit("es_"), "node").alias("app"))
    df = health.with_registry_count_at(df, on_spark(spark, sf_dir, views.REGISTRATIONS))
    out = health.health_codes(df, registry_nodes="registry_nodes", discovery_nodes=F.lit(4))
    return out.select("node", "seq", "green_or_red", "green_or_yellow", "node_match", "discovery_node_match")


def _equal_histograms(spark, sf_dir):
    """Is a node's query histogram the same for the first and second half of its operations?"""
    base = latencies(spark, sf_dir, TWO_OPS)
    left = histogram.histogram(base.filter(F.col("up")), ["node"], "search_query_latency_us")
    right = histogram.histogram(base, ["node"], "search_query_latency_us")
    return histogram.hist_equal(left, right, ["node"])


_D_ONE, _D_TWO, _D_ALL = (_deltas_sql(o) for o in (ONE_OP, TWO_OPS, counters.OPERATIONS))


def entries() -> list[Entry]:
    search = ("search_query_total", "search_query_time")
    hist_keys = ["node", "op"]
    return [
        Entry(
            "latency_percentiles",
            latency_percentiles,
            _oracle(
                "select node, op, cast(sum(n) as bigint) as n, max(bound) = {top} as overflowed, {p95} as p95, {p99} as p99 "
                "from (select *, sum(n) over (partition by node, op order by bound) as cum, sum(n) over (partition by node, op) as total from h) as c "
                "group by node, op".format(
                    top=OVERFLOW,
                    **{
                        name: f"case when max(bound) = {OVERFLOW} then null when floor(max(total) * cast({p} as double)) = 0 then 0 "
                        f"else min(case when cum >= floor(total * cast({p} as double)) then bound end) end"
                        for name, p in histogram.PERCENTILES.items()
                    },
                ),
                d=_D_ALL,
                l=LONG_LATENCIES,
                h=HIST,
            ),
        ),
        Entry(
            "read_node_stats",
            _read,
            _oracle(
                "select null as error, node, seq, up, status, nodes, case when status is not null then search_query_time end as query_time, "
                "uptime_ms, cast(5 as bigint) as pools, case when v % 5 <> 0 then cast(1.5 as double) end as overhead from samples where seq % 3 <> 0 "
                "union all select 'bad json', null, null, null, null, null, null, null, null, null from samples where seq % 3 = 0"
            ),
        ),
        Entry(
            "one_sample_per_tick",
            lambda s, d: telemetry.one_sample_per_tick(samples(s, d), tick_seconds=86_400).select("node", "seq", "v"),
            _oracle(
                "select node, seq, v from samples qualify row_number() over (partition by node, floor(epoch(ts) / 86400) order by ts, seq) = 1"
            ),
        ),
        Entry(
            "usable_samples",
            lambda s, d: telemetry.usable(nested_samples(s, d), "fs").select("node", "seq", F.col("fs.total").alias("total")),
            _oracle("select node, seq, fs_total as total from samples where up and status is not null"),
        ),
        *_sections(),
        Entry(
            "counter_delta",
            lambda s, d: counters.counter_delta(samples(s, d), search[0], width=DAY).select("node", "seq", search[0], f"{search[0]}_delta"),
            _oracle(f"select node, seq, {search[0]}, {_delta_sql(search[0])} as {search[0]}_delta from samples"),
        ),
        Entry(
            "counter_delta_restart",
            lambda s, d: counters.counter_delta(samples(s, d), search[0], reset="restart", width=DAY).select("node", "seq", f"{search[0]}_delta"),
            _oracle(
                f"select node, seq, case when {search[0]} < prev then {search[0]} else {search[0]} - prev end as {search[0]}_delta "
                f"from (select *, coalesce(lag({search[0]}) over {W}, 0) as prev from samples) as p"
            ),
        ),
        Entry(
            "timer_delta",
            lambda s, d: counters.timer_delta(samples(s, d), search[1], width=DAY).select("node", "seq", search[1], f"{search[1]}_delta"),
            _oracle(f"select node, seq, {search[1]}, {_timer_sql(search[1])} as {search[1]}_delta from samples"),
        ),
        Entry(
            "interval_latency",
            lambda s, d: latencies(s, d, counters.OPERATIONS).select(
                "node", "seq", *(f"{op}_{x}" for op in counters.OPERATIONS for x in ("delta", "time_delta", "latency_us"))
            ),
            _oracle(
                "select node, seq, "
                + ", ".join(f"{op}_{x}" for op in counters.OPERATIONS for x in ("delta", "time_delta", "latency_us"))
                + " from d",
                d=_D_ALL,
            ),
        ),
        Entry(
            "lifetime_averages",
            lambda s, d: counters.lifetime_averages(
                samples(s, d), {f"{op}_avg": (m, t) for op, (t, m) in counters.OPERATIONS.items()}
            ).select("node", "seq", *(f"{op}_avg" for op in counters.OPERATIONS)),
            _oracle(
                "select node, seq, "
                + ", ".join(
                    f"case when {t} <> 0 then cast({m} // {t} as double) else 0.0 end as {op}_avg"
                    for op, (t, m) in counters.OPERATIONS.items()
                )
                + " from samples"
            ),
        ),
        Entry(
            "bucket_bounds",
            lambda s, d: samples(s, d)
            .select("node", "seq", (F.col("v") * F.col("v") * 100 - 500).alias("us"))
            .withColumn("bound", to_bucket("us"))
            .withColumn("label", hist_label("bound")),
            _oracle(
                "select node, seq, us, bound, '[' || (coalesce(list_max(list_filter("
                + BOUND_LIST
                + f", lambda b: b < bound)), 0) + 1) || '..' || case when bound = {OVERFLOW} then 'Inf' else cast(bound as string) end || ']' as label "
                f"from (select *, {_bound_sql('us')} as bound from (select node, seq, v * v * 100 - 500 as us from samples) as x) as y"
            ),
        ),
        Entry(
            "histogram",
            lambda s, d: histogram.histogram(long_latencies(s, d), hist_keys, "us"),
            _oracle("select * from h", d=_D_ALL, l=LONG_LATENCIES, h=HIST),
        ),
        Entry(
            "hist_summary",
            lambda s, d: histogram.hist_summary(histogram.histogram(long_latencies(s, d), hist_keys, "us"), hist_keys),
            _oracle(
                "select node, op, min(case when bound = 1 then 0 else coalesce(list_max(list_filter("
                + BOUND_LIST
                + ", lambda b: b < bound)), 0) + 1 end) as min, max(bound) as max, cast(sum(n) as bigint) as n, "
                f"case when max(bound) < {OVERFLOW} then cast(ceil(cast(sum(case when bound < {OVERFLOW} then n * bound end) as double) / sum(n)) as bigint) end as mean, "
                f"max(bound) = {OVERFLOW} as overflowed from h group by node, op",
                d=_D_ALL,
                l=LONG_LATENCIES,
                h=HIST,
            ),
        ),
        Entry(
            "hist_windows",
            lambda s, d: histogram.hist_rows(latencies(s, d), ["node"], "search_query_latency_us", "1 day").select(
                "node", F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "bound", "n", "label"
            ),
            _oracle(
                "select *, '[' || (coalesce(list_max(list_filter("
                + BOUND_LIST
                + f", lambda b: b < bound)), 0) + 1) || '..' || case when bound = {OVERFLOW} then 'Inf' else cast(bound as string) end || ']' as label "
                "from (select node, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') as window_start, "
                f"{_bound_sql('search_query_latency_us')} as bound, count(*) as n from d where search_query_latency_us is not null group by all) as x",
                d=_D_ONE,
            ),
        ),
        Entry(
            "hist_equal",
            _equal_histograms,
            _oracle(
                "select node, bool_and(d = 0) as equal from (select node, bound, sum(case when up then 0 else 1 end) as d from "
                f"(select node, up, {_bound_sql('search_query_latency_us')} as bound from d where search_query_latency_us is not null) as x "
                "group by all) as y group by node",
                d=_D_TWO,
            ),
        ),
        Entry("running_percentile", running_percentiles, _running_oracle()),
        Entry(
            "running_percentile_overflow",
            running_overflows,
            _running_oracle(
                "select *, count(*) filter (where overflowed) over (partition by node, op) as ticks, "
                "min(seq) filter (where overflowed) over (partition by node, op) as first_seq from p"
            ),
        ),
        Entry(
            "health_codes",
            _health,
            _oracle(
                "select node, seq, cast(case upper(status) when 'RED' then 1 when 'GREEN' then 0 when 'YELLOW' then 0 else -1 end as int) as green_or_red, "
                "cast(case upper(status) when 'YELLOW' then 1 when 'GREEN' then 0 when 'RED' then 0 else -1 end as int) as green_or_yellow, "
                "cast(case when status is null then -1 when nodes <> known then 1 else 0 end as int) as node_match, "
                "cast(case when status is null then -1 when nodes <> 4 then 1 else 0 end as int) as discovery_node_match from "
                "(select node, seq, any_value(status) as status, any_value(nodes) as nodes, count(id) as known from samples left join registrations "
                "on app = 'es_' || node and registered_at <= ts and (removed_at is null or removed_at > ts) group by node, seq) as k",
                registrations=views.REGISTRATIONS,
            ),
        ),
        Entry("long_metrics", _long_metrics, _oracle(_long_metrics_sql())),
        Entry(
            "latest_per_node",
            lambda s, d: telemetry.latest_per_node(samples(s, d)).select("node", "seq", "v", "status", "store_size"),
            _oracle("select node, seq, v, status, store_size from samples qualify row_number() over (partition by node order by ts desc, seq desc) = 1"),
        ),
        Entry(
            "top_n_distinct",
            lambda s, d: telemetry.top_n_distinct(samples(s, d), ["node"], "v", 5),
            _oracle(
                "select node, v, cast(row_number() over (partition by node order by v desc) as int) as rank from (select distinct node, v from samples) as x "
                "qualify row_number() over (partition by node order by v desc) <= 5"
            ),
        ),
        Entry(
            "process_down",
            lambda s, d: health.process_down(samples(s, d), width=DAY).select("node", "seq", "down"),
            _oracle(f"select node, seq, case when up then 0 else 1 end as down from samples qualify max(cast(up as int)) over {RUN} = 1"),
        ),
        Entry(
            "transitions",
            lambda s, d: health.transitions(samples(s, d), width=DAY).select("node", "seq", "transition"),
            _oracle(
                "select node, seq, case when up then 'STARTED' else 'STOPPED' end as transition from "
                f"(select *, coalesce(lag(up) over {W}, false) as before from samples) as x where up <> before"
            ),
        ),
    ]


def _running_oracle(body: str = "select * from p") -> str:
    """``p``: the running percentiles of all operations, one row per sample and operation."""

    def at(p: float) -> str:
        k = f"cast(floor(len(past) * cast({p} as double)) as bigint)"
        return (
            f"case when us is null then 0 when list_max(past) = {OVERFLOW} then null when {k} = 0 then 0 "
            f"else list_sort(past)[{k}] end"
        )

    us = " union all ".join(f"select node, ts, seq, '{op}' as op, {op}_latency_us as us from d" for op in counters.OPERATIONS)
    return _oracle(
        body,
        d=_D_ALL,
        p=f"select node, seq, op, us, {at(0.95)} as p95, {at(0.99)} as p99, coalesce(list_max(past) = {OVERFLOW}, false) as overflowed from "
        f"(select node, seq, op, us, list(bound) filter (where bound is not null) over (partition by node, op order by ts, seq rows between unbounded preceding and current row) as past from "
        f"(select node, ts, seq, op, us, {_bound_sql('us')} as bound from ({us}) as u) as b) as w",
    )

"""Explicit schemas; nothing in the library infers one."""

from __future__ import annotations

from pyspark.sql import types as T


def _longs(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType()) for n in names])


def _named(*fields: str, **other: T.DataType) -> T.ArrayType:
    """Array of structs with a name, LONG fields and fields of other types."""
    struct = T.StructType([T.StructField("name", T.StringType())])
    for f in fields:
        struct.add(f, other.get(f, T.LongType()))
    return T.ArrayType(struct)


INDICES = T.StructType(
    [
        T.StructField("store", _longs("size", "throttle_time")),
        T.StructField("docs", _longs("count", "deleted")),
        T.StructField("refresh", _longs("total", "total_time")),
        T.StructField("flush", _longs("total", "total_time")),
        T.StructField("merge", _longs("current", "current_docs", "current_size", "total", "total_time", "total_size")),
        T.StructField("fielddata", _longs("evictions", "size")),
        T.StructField(
            "search", _longs("query_total", "query_time", "query_current", "fetch_total", "fetch_time", "fetch_current")
        ),
        T.StructField(
            "get", _longs("total", "time", "current", "exists_total", "exists_time", "missing_total", "missing_time")
        ),
        T.StructField(
            "indexing",
            _longs("index_total", "index_time", "index_current", "delete_total", "delete_time", "delete_current"),
        ),
    ]
)

NODE_STATS = T.StructType(
    [
        T.StructField("node", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("seq", T.LongType()),
        T.StructField("up", T.BooleanType()),
        T.StructField("status", T.StringType()),
        T.StructField("nodes", T.IntegerType()),
        T.StructField("indices", INDICES),
        T.StructField("fs", _longs("total", "free", "available")),
        T.StructField(
            "os",
            _longs(
                "mem_free", "mem_used", "free_percent", "used_percent", "cpu_percent", "swap_free", "swap_used",
                "timestamp",
            ),
        ),
        T.StructField("process", _longs("virtual", "cpu_percent", "cpu_total_ms", "open_files", "timestamp")),
        T.StructField("http", _longs("server_open", "total_open")),
        T.StructField("transport", _longs("server_open", "rx_count", "rx_size", "tx_count", "tx_size")),
        T.StructField(
            "jvm",
            T.StructType(
                [
                    T.StructField(
                        "mem",
                        _longs(
                            "heap_committed", "heap_max", "heap_used", "heap_used_percent", "non_heap_committed",
                            "non_heap_used",
                        ),
                    ),
                    T.StructField("threads", _longs("count", "peak")),
                    T.StructField("uptime_ms", T.LongType()),
                    T.StructField("pools", _named("used", "max", "peak_used", "peak_max")),
                    T.StructField("gc", _named("count", "time_ms")),
                ]
            ),
        ),
        T.StructField("thread_pools", _named("threads", "queue", "active", "rejected", "largest", "completed")),
        T.StructField("breakers", _named("estimated", "limit", "overhead", "tripped", overhead=T.DoubleType())),
    ]
)

# Retention policies as written by operators: period and preCreate come as text, number or boolean.
POLICIES = T.ArrayType(
    T.StructType(
        [
            T.StructField(n, T.StringType())
            for n in ("indexName", "indexNamePattern", "retentionType", "retentionPeriod", "preCreate")
        ]
    )
)

INSTANCE = T.StructType(
    [
        T.StructField("app", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("instance_id", T.StringType()),
        T.StructField("availability_zone", T.StringType()),
        T.StructField("public_ip", T.StringType()),
        T.StructField("host_name", T.StringType()),
        T.StructField("dc", T.StringType()),
        T.StructField("asg", T.StringType()),
        T.StructField("update_time", T.LongType()),
        T.StructField("out_of_service", T.BooleanType()),
    ]
)

MASTER_INFO = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("id", "host", "ip", "node")]))

SNAPSHOT_CATALOG = T.StructType(
    [
        T.StructField("repo", T.StringType()),
        T.StructField("snapshot", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("row_count", T.LongType()),
    ]
)

"""Input views over the given tables (see FIXTURES.md section 2)."""

from __future__ import annotations

# --- telemetry ---------------------------------------------------------------------------
# One sample per event.  ``event_id`` grows with time, so counters made from it behave like
# a node's counters: they grow by different amounts per tick, some intervals have no traffic,
# and the modulus makes them restart, at different times for counts and timers.  Every column
# depends on its own row only, so the view is a plain scan at any size.

COUNTERS = {
    "search_query_total": "cast((event_id - event_id % 40) / 40 as bigint) % 1500",
    "search_query_time": "(event_id * 3 + v) % 40000",
    "search_fetch_total": "cast((event_id - event_id % 100) / 100 as bigint)",
    "search_fetch_time": "event_id * 2 + v",
    "get_total": "cast((event_id - event_id % 25) / 25 as bigint) % 700",
    "get_time": "(event_id * 5) % 100000",
    "get_exists_total": "cast((event_id - event_id % 200) / 200 as bigint)",
    "get_exists_time": "event_id + v * 4",
    "get_missing_total": "cast((event_id - event_id % 500) / 500 as bigint) % 90",
    "get_missing_time": "event_id * 7",
    "indexing_index_total": "cast((event_id - event_id % 10) / 10 as bigint)",
    "indexing_index_time": "event_id * 11",
    "indexing_delete_total": "cast((event_id - event_id % 1000) / 1000 as bigint)",
    "indexing_delete_time": "event_id * 30",
}

GAUGES = {
    "store_size": "v * 1000003", "store_throttle_time": "v % 17", "docs_count": "event_id * 10",
    "docs_deleted": "event_id % 97", "refresh_total": "event_id % 50", "refresh_total_time": "v * 9",
    "flush_total": "event_id % 7", "flush_total_time": "v * 3", "merges_current": "v % 4",
    "merges_current_docs": "v * 5", "merges_current_size": "v * 4096", "merges_total": "event_id % 1000",
    "merges_total_time": "event_id * 2", "merges_total_size": "event_id * 512",
    "cache_field_evictions": "v % 3", "cache_field_size": "v * 128",
    "search_query_current": "v % 6", "search_fetch_current": "v % 5", "get_current": "v % 7",
    "indexing_index_current": "v % 8", "indexing_delete_current": "v % 2",
    "fs_total": "case when v % 50 = 0 then 0 else 1000000 + v end", "fs_free": "500000 + v * 3",
    "fs_available": "v * 1000",
    "os_mem_free": "v * 11", "os_mem_used": "v * 13", "os_free_percent": "v % 101",
    "os_used_percent": "100 - v % 101", "os_cpu_percent": "v % 100", "os_swap_free": "v * 17",
    "os_swap_used": "v * 19", "os_timestamp": "event_id * 60000",
    "process_virtual": "v * 23", "process_cpu_percent": "v % 90", "process_cpu_total": "event_id * 4",
    "process_files": "v % 1024", "process_timestamp": "event_id * 60000 + 5",
    "http_server_open": "v % 31", "http_total_open": "event_id * 2",
    "transport_server_open": "v % 13", "rx_count": "event_id * 3", "rx_size": "event_id * 1500 + v",
    "tx_count": "event_id * 4", "tx_size": "event_id * 900 - v",
    "heap_committed": "v * 2097152 + 5", "heap_max": "v * 4194304 + 1048575", "heap_used": "v * 1572864",
    "heap_used_percent": "v % 100", "non_heap_committed": "v * 1048576 + 7", "non_heap_used": "v * 524288",
    "threads_count": "v % 200", "threads_peak": "v % 200 + 20", "uptime_ms": "event_id * 3600001",
}

SAMPLES = (
    "select cast(user_id as string) as node, ts, event_id as seq, event_type <> 'error' as up, "
    "case when event_type = 'signup' then null when v % 3 = 0 then 'GREEN' when v % 3 = 1 then 'yellow' else 'RED' end as status, "
    "cast(3 + v % 4 as int) as nodes, event_type as kind, v, "
    + ", ".join(f"cast({e} as bigint) as {n}" for n, e in {**COUNTERS, **GAUGES}.items())
    + " from (select user_id, ts, event_id, event_type, cast(round(value) as bigint) as v from {events}) as e"
)

# --- lifecycle and snapshots -------------------------------------------------------------
_YEAR = "lpad(cast(year(o_orderdate) as string), 4, '0')"
_MONTH = "lpad(cast(month(o_orderdate) as string), 2, '0')"
_DAY = "lpad(cast(day(o_orderdate) as string), 2, '0')"

# Every order counts for its yearly, monthly and daily dataset, so sizes can be summed up.
DATASET_PARTS = (
    f"select 'orders_' || {_YEAR} as name, o_totalprice as price from {{orders}} "
    f"union all select 'orders_' || {_YEAR} || {_MONTH}, o_totalprice from {{orders}} "
    f"union all select 'orders_' || {_YEAR} || {_MONTH} || {_DAY}, o_totalprice from {{orders}} "
    f"union all select 'audit-' || {_YEAR} || '.' || {_MONTH} || '.' || {_DAY}, o_totalprice from {{orders}} where o_orderstatus = 'P' "
    # Names that look close to a pattern but are not of its form.
    "union all select case cast(o_orderkey % 5 as int) when 0 then 'orders_19991' when 1 then 'orders_199913' when 2 then 'orders_abc' "
    "when 3 then '_orders199901' else 'orders_19990230' end, o_totalprice from {orders} where o_orderpriority = '5-LOW'"
)

# One policy document per customer: well-formed, partial, and broken ones.
POLICY_JSON = (
    "select c_custkey, case cast(c_custkey % 12 as int) "
    "when 0 then '[{{\"indexName\":\"c' || k || '_\",\"retentionType\":\"yearly\",\"retentionPeriod\":' || p || '}}]' "
    "when 1 then '[{{\"indexName\":\"c' || k || '_\",\"retentionType\":\"Monthly\",\"retentionPeriod\":\"' || p || '\",\"preCreate\":true,\"extra\":{{\"a\":1}}}}]' "
    "when 2 then '[{{\"indexName\":\"c' || k || '_\",\"retentionPeriod\":' || p || ',\"preCreate\":\"false\"}}]' "
    "when 3 then '[{{\"indexName\":\"c' || k || '_\",\"retentionType\":\"HOURLY\",\"retentionPeriod\":' || p || '}},{{\"retentionType\":\"monthly\",\"retentionPeriod\":20}}]' "
    "when 4 then '[{{\"indexNamePattern\":\"''c' || k || '-''YYYY-MM-dd\",\"retentionPeriod\":\"P' || p || 'M\",\"preCreate\":true}}]' "
    "when 5 then '[{{\"indexNamePattern\":\"''c' || k || '''YYYYMMdd\",\"indexName\":\"x\",\"retentionType\":\"yearly\",\"retentionPeriod\":\"PT' || p || 'H\"}}]' "
    "when 6 then '[{{\"retentionType\":\"monthly\",\"indexName\":\"c' || k || '_\"}}]' "
    "when 7 then '[{{\"retentionType\":\"monthly\",\"indexName\":\"c' || k || '_\",\"retentionPeriod\":\"A\"}}]' "
    "when 8 then '[{{\"indexNamePattern\":\"c' || k || '_logYYYY\",\"retentionPeriod\":\"P1M\"}}]' "
    "when 9 then '[{{\"retentionType\":\"monthly\", \"indexName\":\"c' || k || '\",' "
    "when 10 then '[{{\"retentionType\":\"weekly\",\"indexName\":\"c' || k || '_\",\"retentionPeriod\":3}}]' "
    "else '[{{\"indexName\":\"c' || k || '_\",\"retentionType\":\"daily\",\"retentionPeriod\":\"P1Y' || p || 'M2W3DT4H5M6S\"}}]' end as policy_json "
    "from (select c_custkey, cast(c_custkey as string) as k, cast(1 + c_custkey % 30 as string) as p from {customer}) as c"
)

SNAPSHOT_CATALOG = (
    "select distinct 'es_' || lower(o_orderstatus) as repo, "
    f"{_YEAR} || {_MONTH} || {_DAY} || '0100' as snapshot, o_orderdate as created_at from {{orders}} "
    f"union select distinct 'es_' || lower(o_orderstatus), 'idx_' || {_YEAR} || {_MONTH} || '010100', o_orderdate from {{orders}} where year(o_orderdate) < 1997"
)

SNAPSHOT_RUNS = (
    "select event_id as run_id, cast(user_id as string) as node, ts, "
    "case event_type when 'view' then 'OK' when 'click' then 'OK' when 'error' then 'INTERNAL_SERVER_ERROR' "
    "when 'signup' then 'EXCEPTION' else 'ACCEPTED' end as status, "
    "event_id * 60000 as start_ms, event_id * 60000 + cast(round(value) as bigint) * 60000 + 59999 as end_ms, "
    "cast(5 + event_id % 5 as bigint) as total_shards, "
    "cast(case when event_type = 'error' then 2 else 0 end as bigint) as failed_shards from {events}"
)

# --- registry and access -----------------------------------------------------------------
_ASG = "lower(n_name) || case when c_mktsegment = 'BUILDING' then '-master' else '-data' end"
_INSTANCE = "'i-' || lpad(cast(c_custkey as string), 8, '0')"
_IP = "'10.' || cast(c_nationkey as string) || '.' || cast(c_custkey % 250 as string) || '.' || cast(c_custkey % 200 as string)"

REGISTRY = (
    f"select 'es_' || lower(r_name) as app, r_name || '.' || {_INSTANCE} as id, {_INSTANCE} as instance_id, "
    f"n_name as availability_zone, {_IP} as public_ip, "
    "'ec2-' || cast(c_nationkey as string) || '-' || cast(c_custkey % 250 as string) || '-' || cast(c_custkey % 200 as string) || '-7.compute.example' as host_name, "
    f"r_name as dc, {_ASG} as asg, cast(c_custkey * 1000 as bigint) as update_time, c_custkey % 17 = 0 as out_of_service "
    "from {customer} join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey"
)

# Clusters of six instances that come and go while samples are taken.
REGISTRATIONS = (
    f"select 'es_' || cast(cast(floor(c_custkey / 6) as bigint) as string) as app, {_INSTANCE} as id, "
    "cast('2024-01-01 00:00:00' as timestamp) + interval '7' hour * (c_custkey % 97) as registered_at, "
    "case when c_custkey % 3 = 0 then cast('2024-01-01 00:00:00' as timestamp) + interval '7' hour * (c_custkey % 97 + c_custkey % 31) end as removed_at "
    "from {customer}"
)

MEMBERSHIP = (
    f"select {_ASG} as asg, {_INSTANCE} as instance_id, "
    "case when c_acctbal < 0 then 'Terminating' when c_custkey % 11 = 0 then 'terminated' when c_custkey % 19 = 0 then 'SHUTTING-DOWN' else 'InService' end as state "
    "from {customer} join {nation} on c_nationkey = n_nationkey where c_custkey % 13 <> 0 and n_nationkey % 7 <> 6"
)

ACL_RULES = (
    "select 'sg_' || cast(c_nationkey % 3 as string) as group_name, 7102 as from_port, 7102 as to_port, "
    f"{_IP} || '/32' as cidr, c_custkey as rule_order from {{customer}} where c_custkey % 7 <> 0 "
    "union all select 'sg_0', 7102, 7102, '192.168.0.' || cast(s_suppkey % 250 as string) || '/32', s_suppkey from {supplier} "
    "union all select 'sg_1', 7104, 7104, '172.16.0.' || cast(s_suppkey % 250 as string) || '/32', s_suppkey from {supplier} "
    "union all select 'sg_1', 7200, 7300, '192.168.0.' || cast(s_suppkey % 90 as string) || '/32', s_suppkey + 1000000 from {supplier}"
)

# --- settings ----------------------------------------------------------------------------
SETTINGS_LAYERS = (
    f"select 0 as layer, {_INSTANCE} as scope, 'app.http.port' as k, cast(7000 + c_custkey % 100 as string) as v from {{customer}} where c_custkey % 3 = 0 "
    f"union all select 1, {_INSTANCE}, 'app.http.port', case when c_nationkey % 5 = 0 then 'bad' else cast(8000 + c_nationkey as string) end from {{customer}} where c_custkey % 2 = 0 "
    f"union all select 2, {_INSTANCE}, 'app.stack', case c_mktsegment when 'BUILDING' then 'master' when 'MACHINERY' then 'Data' when 'FURNITURE' then 'search' else 'other' end from {{customer}} "
    f"union all select 1, {_INSTANCE}, 'app.multi.dc', case when c_custkey % 4 = 0 then 'TRUE' when c_custkey % 4 = 1 then 'yes' else '' end from {{customer}} "
    f"union all select 1, {_INSTANCE}, 'os.name', 'linux' from {{customer}} where c_custkey % 5 = 0 "
    f"union all select 0, {_INSTANCE}, 'app.tribe.clusters', ' es_asia=9' || lpad(cast(c_custkey % 100 as string), 3, '0') || ',es_europe=9200 ,bad' from {{customer}} where c_custkey % 6 = 0"
)

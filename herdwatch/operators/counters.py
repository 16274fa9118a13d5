"""Counter and timer deltas, interval and lifetime latency.

A counter's baseline is the highest value seen so far, so after a reset its delta stays 0
until the old peak is passed.  A timer's baseline is simply its previous value, so its delta
may be negative.  Both baselines start at 0: the first delta of a node is its lifetime total.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdwatch.plans.slices import running_before, without_slices

# Operation types of an indices sample: name -> (counter column, timer column).
OPERATIONS = {
    "search_query": ("search_query_total", "search_query_time"),
    "search_fetch": ("search_fetch_total", "search_fetch_time"),
    "get": ("get_total", "get_time"),
    "get_exists": ("get_exists_total", "get_exists_time"),
    "get_missing": ("get_missing_total", "get_missing_time"),
    "indexing": ("indexing_index_total", "indexing_index_time"),
    "index_delete": ("indexing_delete_total", "indexing_delete_time"),
}


def clamped_delta(total: Column, highest_before: Column) -> Column:
    """Growth of a counter over the highest value before; never negative."""
    baseline = F.greatest(F.coalesce(highest_before, F.lit(0)), F.lit(0))
    return F.greatest(total - baseline, F.lit(0)).cast("bigint")


def restart_delta(total: Column, value_before: Column) -> Column:
    """Growth of a counter that restarts from 0 at a reset: after one, the delta is the total."""
    previous = F.coalesce(value_before, F.lit(0))
    return F.when(total < previous, total).otherwise(total - previous).cast("bigint")


def interval_latency_us(time_delta: Column, count_delta: Column) -> Column:
    """Whole milliseconds per operation in the interval, as microseconds; NULL without traffic."""
    return F.when(count_delta != 0, _div(time_delta, count_delta) * 1000)


def lifetime_avg(time: Column, total: Column) -> Column:
    """Whole milliseconds per operation since the start, as DOUBLE; 0 before the first one."""
    return F.when(total != 0, _div(time, total).cast("double")).otherwise(F.lit(0.0))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)  # truncates toward zero


def counter_delta(
    df: DataFrame, column: str, keys: Sequence[str] = ("node",), reset: str = "peak", **slicing
) -> DataFrame:
    """Add ``<column>_delta``.  ``reset`` is ``peak`` (see above) or ``restart``."""
    kind = {"peak": "max", "restart": "last"}[reset]
    with_before = running_before(df, keys, {"_before": (kind, column)}, **slicing)
    rule = clamped_delta if reset == "peak" else restart_delta
    delta = rule(F.col(column), F.col("_before")).alias(f"{column}_delta")
    return without_slices(with_before.select(*df.columns, delta))


def timer_delta(df: DataFrame, columns: str | Sequence[str], keys: Sequence[str] = ("node",), **slicing) -> DataFrame:
    """Add ``<column>_delta``: the value minus the previous one, unclamped."""
    columns = [columns] if isinstance(columns, str) else list(columns)
    with_before = running_before(df, keys, {f"_before_{c}": ("last", c) for c in columns}, **slicing)
    deltas = [(F.col(c) - F.coalesce(F.col(f"_before_{c}"), F.lit(0))).alias(f"{c}_delta") for c in columns]
    return without_slices(with_before.select(*df.columns, *deltas))


def operation_deltas(
    df: DataFrame,
    operations: Mapping[str, tuple[str, str]] = OPERATIONS,
    keys: Sequence[str] = ("node",),
    keep_slices: bool = False,
    **slicing,
) -> DataFrame:
    """Deltas and interval latency of all operation types, with one shuffle for all of them.

    Adds ``<op>_delta``, ``<op>_time_delta`` and ``<op>_latency_us`` per operation.
    """
    specs = {}
    for op, (total, time) in operations.items():
        specs[f"_peak_{op}"] = ("max", total)
        specs[f"_time_{op}"] = ("last", time)
    before = running_before(df, keys, specs, **slicing)
    deltas = {}
    for op, (total, time) in operations.items():
        deltas[f"{op}_delta"] = clamped_delta(F.col(total), F.col(f"_peak_{op}"))
        deltas[f"{op}_time_delta"] = F.col(time) - F.coalesce(F.col(f"_time_{op}"), F.lit(0))
    out = before.withColumns(deltas).withColumns(
        {
            f"{op}_latency_us": interval_latency_us(F.col(f"{op}_time_delta"), F.col(f"{op}_delta"))
            for op in operations
        }
    )
    out = out.drop(*specs)
    return out if keep_slices else without_slices(out)


def lifetime_averages(df: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Add one lifetime mean per entry ``name -> (time column, total column)``."""
    return df.withColumns({name: lifetime_avg(F.col(t), F.col(n)) for name, (t, n) in pairs.items()})


def transport_metrics(df: DataFrame, keys: Sequence[str] = ("node",), **slicing) -> DataFrame:
    """Transport section with real received/sent size deltas between samples."""
    flat = df.filter(F.col("transport").isNotNull()).select(*keys, "ts", "seq", "transport.*")
    return timer_delta(flat, ["rx_size", "tx_size"], keys, **slicing)

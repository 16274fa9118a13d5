"""Histograms over log-scale buckets and their percentiles.

A histogram is a frame with one row per key and used bucket: ``(*keys, bound, n)``.  A key
has at most 91 such rows, so everything after the counting is small, whatever the input was.
An overflowed histogram (values above the last bound) has no percentile and no mean: both are
NULL and ``overflowed`` says why.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from herdwatch.functions.buckets import BOUNDS, OVERFLOW, bound_before, bucket_index, hist_label, to_bucket
from herdwatch.plans.slices import PART, SLICE, slice_group, with_slices, without_slices

PERCENTILES = {"p95": 0.95, "p99": 0.99}
EDGES = [*BOUNDS, OVERFLOW]
_PLACES = [f"_b{i}" for i in range(len(EDGES))]


def histogram(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Count the values of a BIGINT column per key and bucket; NULLs are not values."""
    return (
        df.filter(F.col(column).isNotNull())
        .select(*keys, to_bucket(column).alias("bound"))
        .groupBy(*keys, "bound")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def merge_histograms(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add histograms up, for example hourly ones to daily ones."""
    return hist.groupBy(*keys, "bound").agg(F.sum("n").alias("n"))


def hist_percentile(
    hist: DataFrame, keys: Sequence[str], percentiles: Mapping[str, float] = PERCENTILES
) -> DataFrame:
    """One row per key: ``n``, ``overflowed`` and the first bound holding each percentile.

    With ``k = floor(n * p)``: 0 if k is 0, else the first bound whose cumulative count is >= k.
    """
    by_bound = Window.partitionBy(*keys).orderBy("bound")
    cumulated = hist.withColumns(
        {
            "_cum": F.sum("n").over(by_bound.rowsBetween(Window.unboundedPreceding, 0)),
            "_all": F.sum("n").over(Window.partitionBy(*keys)),
        }
    )
    overflowed = F.max("bound") == OVERFLOW

    def at(p: float) -> Column:
        k = F.floor(F.col("_all") * F.lit(float(p)))
        value = F.coalesce(F.min(F.when(F.col("_cum") >= k, F.col("bound"))), F.lit(0))
        return F.when(~overflowed, F.when(F.max(k) == 0, F.lit(0)).otherwise(value)).cast("bigint")

    return cumulated.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        overflowed.alias("overflowed"),
        *(at(p).alias(name) for name, p in percentiles.items()),
    )


def hist_summary(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smallest and largest value a key may have seen, its count, mean and overflow flag."""
    overflowed = F.max("bound") == OVERFLOW
    weighted = hist.withColumns(
        {
            "_floor": F.when(F.col("bound") == BOUNDS[0], F.lit(0)).otherwise(bound_before("bound") + 1),
            "_sum": F.when(F.col("bound") != OVERFLOW, F.col("n") * F.col("bound")),
        }
    )
    mean = F.ceil(F.sum("_sum").cast("double") / F.sum("n").cast("double"))
    return weighted.groupBy(*keys).agg(
        F.min("_floor").cast("bigint").alias("min"),
        F.max("bound").alias("max"),
        F.sum("n").alias("n"),
        F.when(~overflowed, mean).cast("bigint").alias("mean"),
        overflowed.alias("overflowed"),
    )


def hist_mean(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    return hist_summary(hist, keys).select(*keys, "mean")


def hist_rows(df: DataFrame, keys: Sequence[str], column: str, window: str, ts: str = "ts") -> DataFrame:
    """Labelled buckets per tumbling window: reading a window and starting the next one empty."""
    windowed = df.withColumn("window_start", F.window(F.col(ts).cast("timestamp"), window)["start"])
    hist = histogram(windowed, [*keys, "window_start"], column)
    return hist.withColumn("label", hist_label("bound"))


def hist_equal(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key, whether both histograms hold the same counts; a missing histogram is empty."""
    sided = left.withColumn("_d", F.col("n")).unionByName(right.withColumn("_d", -F.col("n")))
    per_bound = sided.groupBy(*keys, "bound").agg(F.sum("_d").alias("_d"))
    return per_bound.groupBy(*keys).agg((F.max(F.abs("_d")) == 0).alias("equal"))


def counts_array(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Histograms as one array per key: ``(*keys, counts)``, entry i counting bucket i."""
    per_bucket = [F.expr(f"sum(CASE WHEN bound = {b}L THEN n ELSE 0L END)").alias(f"_b{i}") for i, b in enumerate(EDGES)]
    return hist.groupBy(*keys).agg(*per_bucket).select(*keys, F.array(*_PLACES).alias("counts"))


#: What the running counts of several columns start from: (column's number, bucket, count), used buckets only.
SEEN = "array<struct<column:int,bucket:int,n:bigint>>"


def counts_of_all(df: DataFrame, keys: Sequence[str], columns: Sequence[str], seen: DataFrame | None = None) -> DataFrame:
    """Counts of several columns per key, from one pass: ``(*keys, seen)``, with a row for every key.

    ``seen`` may hold earlier counts, which are added.
    """
    buckets = [F.struct(F.lit(i).alias("column"), bucket_index(c).alias("bucket"), F.lit(1).cast("bigint").alias("n")) for i, c in enumerate(columns)]
    # A key without any value is kept by an entry of no column.
    none = F.struct(F.lit(-1).alias("column"), F.lit(0).alias("bucket"), F.lit(0).cast("bigint").alias("n"))
    entries = df.select(*keys, F.explode(F.array(none, *buckets)).alias("_e")).filter("_e.bucket IS NOT NULL")
    entries = entries.select(*keys, "_e.*")
    if seen is not None:
        entries = entries.unionByName(seen.select(*keys, F.explode_outer("seen").alias("_e")).select(*keys, "_e.*"))
    counted = entries.groupBy(*keys, "column", "bucket").agg(F.sum("n").alias("n"))
    used = F.when(F.col("column") >= 0, F.struct("column", "bucket", "n"))
    return counted.groupBy(*keys).agg(F.sort_array(F.collect_list(used)).alias("seen"))


def running_percentile(
    df: DataFrame,
    column: str,
    keys: Sequence[str] = ("node",),
    percentiles: Mapping[str, float] = PERCENTILES,
    order: Sequence[str] = ("ts", "seq"),
    initial: DataFrame | None = None,
    **slicing,
) -> DataFrame:
    """``running_percentiles`` of one column: adds the percentiles and ``overflowed`` by their own names.

    ``initial`` may hold what was seen before the frame starts, as ``counts_array``.
    """
    if initial is not None:
        entries = F.transform("counts", lambda n, i: F.struct(F.lit(0).alias("column"), i.alias("bucket"), n.cast("bigint").alias("n")))
        initial = initial.select(*keys, F.filter(entries, lambda e: e["n"] > 0).alias("seen"))
    return running_percentiles(df, {"": column}, keys, percentiles, order, initial, **slicing)


def running_percentiles(
    df: DataFrame,
    columns: Mapping[str, str],
    keys: Sequence[str] = ("node",),
    percentiles: Mapping[str, float] = PERCENTILES,
    order: Sequence[str] = ("ts", "seq"),
    initial: DataFrame | None = None,
    **slicing,
) -> DataFrame:
    """Per row, percentiles of several columns over the key's whole past including the row itself.

    For each entry ``name -> column`` adds ``<name>_<percentile>`` and ``<name>_overflowed`` (without the
    underscore if the name is empty).  The histograms behind them are never cleared.  A row whose value
    is NULL (a tick without traffic) adds nothing and reports 0.  After an overflow the percentiles are
    NULL.  Without any percentiles only the flags are added.  ``initial`` may hold what was seen before
    the frame starts: ``(*keys, seen)`` as made by ``counts_of_all``, with columns numbered as here.

    Any number of columns takes one pass to count them per slice and one to go through the rows.  What
    a slice inherits, for all columns, is joined to its first row; the rows stay where the window over
    their slice has them.  The counting itself runs over Arrow batches: 91 running counts per row and
    column are too many for a window, which updates them one by one.
    """
    tie = order[1] if len(order) > 1 else None
    had_slices = SLICE in df.columns
    sliced = with_slices(df, keys, order[0], tie, **slicing)
    group, values = slice_group(keys), list(columns.values())

    per_slice = counts_of_all(sliced, group, values)
    if initial is not None:
        # Older than all slices: no slice has a NULL number.
        old = {c: F.lit(None).cast(sliced.schema[c].dataType) for c in (SLICE, PART)}
        per_slice = per_slice.unionByName(initial.select(*keys, "seen").withColumns(old))
    in_order = per_slice.repartition(*keys).sortWithinPartitions(*group)
    schema = T.StructType([sliced.schema[c] for c in group]).add("_counts", T.BinaryType())
    fronts = in_order.mapInArrow(_inherited(list(keys), group, len(values)), schema)

    first = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) == 1
    marked = sliced.withColumns({"_first": first, **{f"_bucket{i}": bucket_index(c) for i, c in enumerate(values)}})
    together = marked.join(fronts, group, "left").withColumn("_counts", F.when(F.col("_first"), F.col("_counts")))
    together = together.drop("_first").sortWithinPartitions(*group, *order)
    names, shares = list(percentiles), list(percentiles.values())
    added = [[f"{column}_{n}" if column else n for n in (*names, "overflowed")] for column in columns]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in sliced.schema])
    for one in added:
        for name in one[:-1]:
            schema = schema.add(name, T.LongType())
        schema = schema.add(one[-1], T.BooleanType())
    out = together.mapInArrow(_running(sliced.columns, added, shares), schema)
    return out if had_slices else without_slices(out)


def _inherited(keys: list[str], group: list[str], n_columns: int):
    """Per slice, in order, the counts of all earlier slices of its key, a row of buckets for each column."""

    def run(batches):
        key, counts = None, None
        for batch in batches:
            out = []
            here = list(zip(*(batch.column(c).to_pylist() for c in keys), strict=True))
            numbered = batch.column(group[-2]).is_valid().to_pylist()
            for at, entries in enumerate(batch.column("seen")):
                if counts is None or here[at] != key:
                    key, counts = here[at], np.zeros((n_columns, len(EDGES)), dtype=np.int64)
                # Counts from before the frame have no slice.
                out.append(counts.tobytes() if numbered[at] else None)
                if entries.is_valid and len(entries.values):
                    column, bucket, n = (f.to_numpy() for f in entries.values.flatten())
                    np.add.at(counts, (column, bucket), n)
            whole = pa.RecordBatch.from_arrays([*(batch.column(c) for c in group), pa.array(out, pa.binary())], [*group, "_counts"])
            yield whole.filter(pa.array(numbered))

    return run


# Rows counted at a time: small enough for 91 counts per row to stay in the processor's cache.
_BLOCK = 1024


def _running(columns: list[str], added: list[list[str]], shares: list[float]):
    """The counting of ``running_percentiles`` over the ordered batches of one task."""
    bounds, last = np.array([*BOUNDS, 0]), len(EDGES) - 1

    def ranks(base, seg, upto, share):
        """First bucket whose count reaches the rank, by bisection in all rows at once."""
        row = np.arange(len(seg))
        count = lambda i: base[seg, i] + upto[row, i]
        k = np.floor(count(last) * share).astype(np.int64)
        low, high = np.zeros(len(seg), dtype=np.int64), np.full(len(seg), last)
        for _ in range(last.bit_length()):
            middle = (low + high) // 2
            enough = count(middle) >= k
            low, high = np.where(enough, low, np.minimum(middle + 1, high)), np.where(enough, middle, high)
        return np.where(k == 0, 0, bounds[low])

    def one_column(bucket, start, part, given, seen, above):
        """Percentiles and overflow of one column; ``given`` has what each slice starts with, and ``seen``
        and ``above`` what the slice of the first row has so far: values up to each bound, values above the last."""
        given = np.vstack([seen, given.cumsum(axis=1)])
        is_over = bucket == last
        over = is_over.cumsum()
        front = np.concatenate([[above], given[1:, last] - given[1:, last - 1] - (over - is_over)[start]])
        over = over + front[part]
        # Flags alone need no counts per bucket.
        held = np.flatnonzero(bucket >= 0) if shares else []
        found = [np.zeros(len(bucket), dtype=np.int64) for _ in shares]
        for at in range(0, len(held), _BLOCK):
            rows = held[at : at + _BLOCK]
            upto = (bucket[rows, None] <= np.arange(last + 1)).cumsum(axis=0, dtype=np.int32)
            change = np.flatnonzero(np.diff(part[rows])) + 1
            seg = np.zeros(len(rows), dtype=np.int64)
            seg[change] = 1
            seg = seg.cumsum()
            base = given[part[rows[np.concatenate([[0], change])]]]
            base[1:] -= upto[change - 1]
            for values, share in zip(found, shares, strict=True):
                values[rows] = ranks(base, seg, upto, share)
            given[part[rows[-1]]] = base[seg[-1]] + upto[-1]
        arrays = [pa.array(values, mask=(over > 0) & (bucket >= 0)) for values in found]
        return [*arrays, pa.array(over > 0)], (given[part[-1]], over[-1])

    def run(batches):
        state = [(np.zeros(last + 1, dtype=np.int64), 0)] * len(added)
        for batch in batches:
            if not batch.num_rows:
                continue
            counts = batch.column("_counts")
            start = np.flatnonzero(counts.is_valid().to_numpy(zero_copy_only=False))
            given = np.frombuffer(b"".join(counts.drop_null().to_pylist()), dtype=np.int64).reshape(-1, len(added), last + 1)
            part = np.searchsorted(start, np.arange(batch.num_rows), side="right")
            results = []
            for i, (seen, above) in enumerate(state):
                bucket = batch.column(f"_bucket{i}").fill_null(-1).to_numpy(zero_copy_only=False)
                arrays, state[i] = one_column(bucket, start, part, given[:, i], seen, above)
                results += arrays
            names = [n for one in added for n in one]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *results], [*columns, *names])

    return run

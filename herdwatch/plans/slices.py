"""Running values per key that never put one key's whole history into one task.

A plain ``Window.partitionBy(node)`` sends all rows of a node to one task, so one chatty
node decides how long the job takes.  Here the history of a key is cut into time slices:

1. inside a slice an ordinary window runs over the slice only;
2. every slice is reduced to one row (map-side combined), and a window over those few rows
   gives what each slice inherits from the slices before it;
3. both meet in a join on (key, slice), which is the partitioning the window already has.

A slice is ``width`` seconds long.  Counting shows which slices hold more than ``max_rows``
rows; these are cut at quantiles of their time, an instant that is itself that large at
evenly spaced values of the tie-breaker, which may be of any type, and counted again until all
are small.  The result is exact for any cut, because cuts follow the row order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from herdwatch.session import ensure_checkpoint_dir

DAY = 86_400
# At one sample a minute a key has 43,200 rows per slice, and one carried row for them.
WIDTH = 30 * DAY
SLICE = "_slice"
PART = "_part"
# Cuts per hot slice and round; a part's number grows by a factor of BASE per round, and fits into
# 64 bits for ROUNDS rounds.  Each divides by about CUTS: more rounds are an error, not an end.
CUTS = 63
BASE = 2 * (CUTS + 1)
ROUNDS = 8
# Distinct tie-breakers of a hot slice that its cuts are chosen from.
TIES = 50 * CUTS
# More hot slices than this are joined by shuffle instead of being broadcast.
BROADCAST_ROWS = 2_000


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def with_slices(
    df: DataFrame,
    keys: Sequence[str],
    ts: str = "ts",
    tie: str | None = "seq",
    width: int = WIDTH,
    max_rows: int | None = 1_000_000,
) -> DataFrame:
    """Add ``_slice`` and ``_part``, both non-decreasing in (ts, tie) within a key.

    With ``max_rows`` a counting job looks for slices to cut; it reads only the keys, the time
    and the tie-breaker, and usually finds none.  Pass None where rows per slice are bounded
    already, for example after ``one_sample_per_tick``.  Frames that carry slices are returned
    as they are.  Only rows that share key, time and tie-breaker cannot be cut apart.
    """
    if SLICE in df.columns:
        return df
    cut = df.withColumn(SLICE, F.floor(_micros(ts) / F.lit(width * 1_000_000))).withColumn(
        PART, F.lit(0).cast("bigint")
    )
    if max_rows is None:
        return cut
    was_cut = 0
    while (finer := _cut_hot(cut, keys, _micros(ts), F.col(tie) if tie else F.lit(0), max_rows)) is not None:
        if was_cut == ROUNDS:
            raise RuntimeError(f"slices of more than {max_rows} rows are left after {ROUNDS} rounds of cutting")
        cut, was_cut = finer, was_cut + 1
    # Without this, a shuffle join with the cuts would leave a hot slice in one partition: its
    # partitioning by (key, slice) would also do for a window by (key, slice, part).
    return cut.repartition(*slice_group(keys)) if was_cut else cut


def _cut_hot(df: DataFrame, keys: Sequence[str], at: Column, tie: Column, max_rows: int) -> DataFrame | None:
    """Cut the parts that hold more than ``max_rows`` rows; None if there are none."""
    group, spark = slice_group(keys), df.sparkSession
    position = df.select(*group, at.alias("_at"), tie.alias("_tie"))
    counted = position.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_a"), F.max("_at").alias("_b"),
        F.min("_tie").alias("_c"), F.max("_tie").alias("_d"),
    )
    divisible = (F.col("_a") < F.col("_b")) | (F.col("_c") < F.col("_d"))
    hot = counted.filter((F.col("_n") > max_rows) & divisible).select(*group, (F.col("_a") < F.col("_b")).alias("_timed"))
    hot, few = _small(hot, spark)
    if hot is None:
        return None
    at_quantiles = [i / (CUTS + 1) for i in range(1, CUTS + 1)]
    rows = position.join(hot, group)
    share = F.lit(float(TIES)) / F.approx_count_distinct("_tie")
    rows = rows.join(rows.groupBy(*group).agg(share.alias("_share")), group)
    # A hash chooses among the distinct tie-breakers; the first one is there in any case.
    chosen = F.when(F.abs(F.xxhash64("_tie") % 1_000_000) < F.col("_share") * 1_000_000, F.col("_tie"))
    cuts = rows.groupBy(*group, "_timed").agg(
        F.percentile_approx("_at", at_quantiles, 50 * CUTS).alias("_times"),
        F.array_sort(F.array_union(F.collect_set(chosen), F.array(F.min("_tie")))).alias("_all"),
    )
    place = lambda i: F.floor(F.lit(i) * F.size("_all") / (CUTS + 1)).cast("int")
    spaced = F.array_distinct(F.array(*(F.element_at("_all", place(i) + 1) for i in range(1, CUTS + 1))))
    cuts = cuts.withColumn("_ties", F.when(F.size("_all") <= CUTS, F.col("_all")).otherwise(spaced)).drop("_all")
    # The quantiles are estimates: they are fixed here, so that all uses see the same cuts.
    if few:
        cuts = F.broadcast(spark.createDataFrame(cuts.collect(), cuts.schema))
    else:
        ensure_checkpoint_dir(spark)
        cuts = cuts.checkpoint()

    def place(value: Column, among: Column) -> Column:
        """Twice the number of cuts below, plus one on a cut: a crowded instant gets its own part."""
        below = F.size(F.filter(among, lambda c: c < value))
        return 2 * below + F.array_contains(among, value).cast("int")

    sub = F.when(F.col("_timed"), place(at, F.col("_times"))).otherwise(place(tie, F.col("_ties")))
    part = F.col(PART) * BASE + F.coalesce(sub, F.lit(0))
    # Parts that are not cut are renumbered as well, so that numbers stay in order.
    return df.join(cuts, group, "left").withColumn(PART, part).drop("_timed", "_times", "_ties")


def _small(df: DataFrame, spark) -> tuple[DataFrame | None, bool]:
    """A frame that is usually empty or small: None if empty, broadcast if small, else as it is.

    At most ``BROADCAST_ROWS`` + 1 rows reach the driver.
    """
    rows = df.limit(BROADCAST_ROWS + 1).collect()
    if not rows:
        return None, True
    if len(rows) > BROADCAST_ROWS:
        return df, False
    return F.broadcast(spark.createDataFrame(rows, df.schema)), True


def slice_group(keys: Sequence[str]) -> list[str]:
    return [*keys, SLICE, PART]


def carried(totals: DataFrame, keys: Sequence[str], combine: Mapping[str, Column]) -> DataFrame:
    """From one row per slice, what each slice inherits from all earlier slices of its key."""
    before = Window.partitionBy(*keys).orderBy(SLICE, PART).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*slice_group(keys), *(c.over(before).alias(n) for n, c in combine.items()))


def running_before(
    df: DataFrame,
    keys: Sequence[str],
    specs: Mapping[str, tuple[str, Column | str]],
    order: Sequence[str] = ("ts", "seq"),
    **slicing,
) -> DataFrame:
    """Add, per spec ``name -> (kind, column)``, the value over all earlier rows of the key.

    Kinds: ``max``, ``sum`` and ``last`` (the value of the row just before).  The first row of
    a key gets NULL.  Rows with a NULL key belong to no key and are not supported.
    """
    ts, tie = order[0], (order[1] if len(order) > 1 else None)
    sliced = with_slices(df, keys, ts, tie, **slicing)
    group = slice_group(keys)
    position = F.struct(*order)
    ordered = Window.partitionBy(*group).orderBy(*order)
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)

    local, totals, inherit = {}, [], {}
    for name, (kind, column) in specs.items():
        column = F.col(column) if isinstance(column, str) else column
        if kind == "max":
            local[f"_l_{name}"] = F.max(column).over(earlier)
            totals.append(F.max(column).alias(f"_c_{name}"))
            inherit[f"_c_{name}"] = F.max(f"_c_{name}")
        elif kind == "sum":
            local[f"_l_{name}"] = F.sum(column).over(earlier)
            totals.append(F.sum(column).alias(f"_c_{name}"))
            inherit[f"_c_{name}"] = F.sum(f"_c_{name}")
        elif kind == "last":
            # Wrapped in a struct so that a NULL value is told apart from "no earlier row".
            local[f"_l_{name}"] = F.lag(F.struct(column.alias("v"))).over(ordered)
            totals.append(F.max_by(F.struct(column.alias("v")), position).alias(f"_c_{name}"))
            inherit[f"_c_{name}"] = F.last(f"_c_{name}")
        else:
            raise ValueError(f"unknown kind {kind!r}")

    carry = carried(sliced.groupBy(*group).agg(*totals), keys, inherit)
    joined = sliced.withColumns(local).join(carry, group, "left")

    def combined(name: str, kind: str) -> Column:
        here, above = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if kind == "max":
            return F.greatest(here, above)
        if kind == "sum":
            return F.when(here.isNull(), above).when(above.isNull(), here).otherwise(here + above)
        return F.coalesce(here, above)["v"]

    return joined.select(
        *(F.col(c) for c in sliced.columns),
        *(combined(name, kind).alias(name) for name, (kind, _) in specs.items()),
    )


def without_slices(df: DataFrame) -> DataFrame:
    return df.drop(SLICE, PART)

"""Log-scale latency buckets: bounds, bucket lookup and labels.

Bounds start at 1; each next bound is the previous one times 1.2, rounded, and at least one
more than it.  A value belongs to the smallest bound that is not below it.  Values above the
last bound belong to the overflow bucket, written with the bound ``OVERFLOW``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OVERFLOW = 9223372036854775807  # Long.MAX_VALUE


def bucket_bounds(n: int = 90) -> list[int]:
    """The first ``n`` bucket bounds, ascending."""
    bounds = [1]
    while len(bounds) < n:
        last = bounds[-1]
        bounds.append(max(int(last * 1.2 + 0.5), last + 1))
    return bounds


BOUNDS = bucket_bounds()
TOP = BOUNDS[-1]


def decision_tree(leaves: list[str], test) -> str:
    """SQL text that finds the first leaf whose ``test(i)`` holds, by bisection.

    ``test`` must be false up to some index and true from there on; the last leaf is taken
    when it never holds.  Ninety buckets need seven comparisons per row, and a CASE keeps
    them inside generated code, where a lambda over an array would not be.
    """

    def grow(lo: int, hi: int) -> str:
        if lo == hi:
            return leaves[lo]
        mid = (lo + hi) // 2
        return f"CASE WHEN {test(mid)} THEN {grow(lo, mid)} ELSE {grow(mid + 1, hi)} END"

    return grow(0, len(leaves) - 1)


def to_bucket(column: str, bounds: list[int] = BOUNDS) -> Column:
    """Bound of the bucket that the BIGINT column falls in; NULL stays NULL."""
    tree = decision_tree([f"{b}L" for b in [*bounds, OVERFLOW]], lambda i: f"`{column}` <= {bounds[i]}L")
    return F.expr(f"CASE WHEN `{column}` IS NOT NULL THEN {tree} END")


def bucket_index(column: str, bounds: list[int] = BOUNDS) -> Column:
    """Place of the bucket that the BIGINT column falls in, the overflow bucket being the last."""
    tree = decision_tree([str(i) for i in range(len(bounds) + 1)], lambda i: f"`{column}` <= {bounds[i]}L")
    return F.expr(f"CASE WHEN `{column}` IS NOT NULL THEN {tree} END")


def bound_before(column: str, bounds: list[int] = BOUNDS) -> Column:
    """The bound one below the given bound; 0 below the first."""
    tree = decision_tree([f"{b}L" for b in [0, *bounds]], lambda i: f"`{column}` <= {bounds[i]}L")
    return F.expr(f"CASE WHEN `{column}` IS NOT NULL THEN {tree} END")


def hist_label(column: str, bounds: list[int] = BOUNDS) -> Column:
    """``[lo..hi]`` of a bucket; the overflow bucket ends in ``Inf``."""
    upper = F.when(F.col(column) == OVERFLOW, "Inf").otherwise(F.col(column).cast("string"))
    return F.concat(F.lit("["), (bound_before(column, bounds) + 1).cast("string"), F.lit(".."), upper, F.lit("]"))

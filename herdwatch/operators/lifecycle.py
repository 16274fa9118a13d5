"""Retention policies against date-named datasets: what to drop and what to create.

Planning never changes data.  A policy that cannot be used becomes a row with an ``error``
instead of stopping the others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from herdwatch.functions import patterns, periods
from herdwatch.schemas import POLICIES

STEPS = ("1 minute", "1 hour", "1 day", "7 days", "1 month", "1 year")


def parse_policies(df: DataFrame, column: str) -> DataFrame:
    """One row per policy of a JSON document: the other columns, ``pos`` and the policy's fields.

    Unknown fields are ignored.  A document that is not a JSON array gives one row with an
    ``error``; an empty array gives none.
    """
    parsed = F.from_json(F.col(column), POLICIES, {"mode": "PERMISSIVE"})
    others = [c for c in df.columns if c != column]
    exploded = (
        df.select(*others, parsed.alias("_docs"))
        .filter(F.col("_docs").isNull() | (F.size("_docs") > 0))
        .select(*others, F.posexplode_outer("_docs").alias("pos", "_p"))
    )
    p = F.col("_p")
    return exploded.select(
        *others,
        "pos",
        p["indexName"].alias("index_name"),
        p["indexNamePattern"].alias("index_name_pattern"),
        p["retentionType"].alias("retention_type"),
        p["retentionPeriod"].alias("retention_period"),
        p["preCreate"].alias("pre_create"),
        F.when(p.isNull(), "bad json").alias("error"),
    )


def resolve_policies(policies: DataFrame) -> DataFrame:
    """Fill in defaults: ``pattern``, ``form`` (the pattern compiled), ``period``, ``pre_create``,
    ``actionable`` and ``error``.

    The type defaults to DAILY, in any case.  An explicit pattern wins over a name; a name is
    literal text in front of the type's pattern.
    """
    by_name = F.concat(
        F.lit("'"), F.replace(F.col("index_name"), F.lit("'"), F.lit("''")), F.lit("'"), F.col("_type_pattern")
    )
    flag = F.lower("pre_create")
    raw_period = F.col("retention_period")
    named = (
        policies.withColumn("_kind", F.upper(F.coalesce("retention_type", F.lit("DAILY"))))
        .withColumn("_type_pattern", periods.type_pattern(F.col("_kind")))
        .withColumn("pattern", F.coalesce("index_name_pattern", by_name))
        .withColumn("period", periods.parse_period(raw_period, F.col("_kind")))
    )
    return (
        patterns.with_form(named, "pattern")
        .withColumns(
            {
                "error": F.coalesce(
                    "error",
                    F.when(F.col("_type_pattern").isNull(), "unknown retention type"),
                    F.col("form.error"),
                    F.when(raw_period.isNotNull() & F.col("period").isNull(), "bad retention period"),
                    F.when(~flag.isin("true", "false"), "bad preCreate"),
                ),
                "pre_create": F.coalesce(flag == "true", F.lit(False)),
            }
        )
        .withColumn(
            "actionable", F.col("error").isNull() & F.col("pattern").isNotNull() & F.col("period").isNotNull()
        )
        .drop("_kind", "_type_pattern")
    )


def list_datasets(df: DataFrame, column: str = "name") -> DataFrame:
    """The distinct dataset names of a listing."""
    return df.select(F.col(column).alias("name")).filter(F.col("name").isNotNull()).distinct()


def list_tables(spark: SparkSession, database: str) -> DataFrame:
    """Tables of a catalog database as datasets; reads no data."""
    return spark.sql(f"SHOW TABLES IN {database}").select(F.col("tableName").alias("name"))


@dataclass(frozen=True)
class NameFilter:
    """A caller's own rule for which names belong to a pattern.

    ``matches`` takes the name and the pattern.  ``name_key`` and ``pattern_key`` are equal wherever it
    holds: only such pairs are tested, so the more they tell apart, the fewer.
    """

    matches: Callable[[Column, Column], Column]
    name_key: Callable[[Column], Column]
    pattern_key: Callable[[Column], Column]


def candidates(policies: DataFrame, datasets: DataFrame) -> DataFrame:
    """Datasets with the actionable policies whose literal text they have in its places.

    Not a cross join.  Patterns have few layouts: a length, and the places of literal text.  A name is
    cut by the layouts of its length, and what is cut out is joined to the patterns' text by equality,
    digits included, so that numbered clusters of one layout do not meet.
    """
    laid_out = policies.filter("actionable").withColumn("_l", F.explode(F.arrays_zip("form.layouts", "form.texts")))
    laid_out = laid_out.withColumns({"_layout": F.col("_l.layouts"), "_text": F.col("_l.texts")}).drop("_l")
    layouts = laid_out.select("_layout").distinct().withColumn("_size", patterns.layout_size(F.col("_layout")))
    sized = datasets.withColumn("_size", F.length("name")).join(layouts, "_size").drop("_size")
    cut = sized.withColumn("_text", patterns.cut_by_layout(F.col("name"), F.col("_layout")))
    return cut.join(laid_out, ["_layout", "_text"]).drop("_layout", "_text")


def match_policies(policies: DataFrame, datasets: DataFrame, name_filter: NameFilter | None = None) -> DataFrame:
    """Every dataset with every actionable policy that its name matches; policies may overlap.

    A name matches if it has the pattern's form, or by ``name_filter`` if one is given.
    """
    if name_filter is None:
        return candidates(policies, datasets).filter(patterns.matches_form(F.col("name"), F.col("form")))
    named = datasets.withColumn("_key", name_filter.name_key(F.col("name")))
    pairs = named.join(policies.filter("actionable").withColumn("_key", name_filter.pattern_key(F.col("pattern"))), "_key").drop("_key")
    return pairs.filter(name_filter.matches(F.col("name"), F.col("pattern")))


def _now(now: datetime | str | Column) -> Column:
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp")


def cutoff(policies: DataFrame, now: datetime | str | Column) -> DataFrame:
    """Add ``cutoff``: now minus the period, floored to what the pattern can say."""
    past = periods.minus_period(_now(now), F.col("period"))
    return policies.withColumn(
        "cutoff", F.when(F.col("actionable"), patterns.floor_to_pattern(past, F.col("form")))
    )


def expired(
    datasets: DataFrame, policies: DataFrame, now: datetime | str | Column, name_filter: NameFilter | None = None
) -> DataFrame:
    """The drop plan: matches dated strictly before the policy's cutoff."""
    dated = match_policies(cutoff(policies, now), datasets, name_filter).withColumn(
        "name_date", patterns.name_date(F.col("name"), F.col("form"))
    )
    return dated.filter(F.col("name_date") < F.col("cutoff"))


def next_name(policies: DataFrame, now: datetime | str | Column) -> DataFrame:
    """Add ``next_name``: the first name, a minute to a year ahead, that differs from today's."""
    at, form = _now(now), F.col("form")
    ahead = F.array(*(patterns.print_date(at + F.expr(f"INTERVAL {s}"), form) for s in STEPS))
    named = policies.withColumns({"_now_name": patterns.print_date(at, form), "_ahead": ahead})
    first = F.get(F.filter("_ahead", lambda n: n != F.col("_now_name")), F.lit(0))
    return named.withColumn("next_name", first).drop("_now_name", "_ahead")


def to_create(
    datasets: DataFrame, policies: DataFrame, now: datetime | str | Column, name_filter: NameFilter | None = None
) -> DataFrame:
    """Datasets to create: next names of ``pre_create`` policies that match something already.

    Names that exist are left out.  A pattern whose name never changes gives an ``error`` row.
    """
    wanted = next_name(policies.filter("actionable AND pre_create"), now)
    in_use = match_policies(policies.filter("pre_create"), datasets, name_filter).select("pattern").distinct()
    named = wanted.join(in_use, "pattern", "left_semi").withColumn(
        "error", F.when(F.col("next_name").isNull(), "pattern never changes")
    )
    existing = datasets.select(F.col("name").alias("next_name"))
    return named.join(existing, "next_name", "left_anti").select("pattern", "next_name", "error").distinct()


def reclaim_report(plan: DataFrame, stats: DataFrame) -> DataFrame:
    """What the drop plan frees: ``stats`` (name, rows, bytes) per dataset, each counted once."""
    per_dataset = stats.groupBy("name").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
    return per_dataset.join(plan.select("name").distinct(), "name", "left_semi")


def kept(df: DataFrame, plan: DataFrame, column: str = "name") -> DataFrame:
    """Apply a drop plan to rows that carry their dataset name: what remains."""
    doomed = plan.select(F.col("name").alias(column)).distinct()
    return df.join(doomed, column, "left_anti")

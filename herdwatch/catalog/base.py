"""How catalog entries are written: a Spark callable and, where SQL can say it, an oracle.

Input views are plain SQL over the given tables that runs on Spark and on DuckDB alike, so a
query and its oracle start from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


@dataclass(frozen=True)
class Entry:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_spark(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a portable view text; ``{orders}`` and the like stand for the given tables."""
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def on_duckdb(sql: str) -> str:
    """The same text with plain table names, to be used as a subquery."""
    return sql.format(**{t: t for t in TABLES})


def with_views(body: str, **views: str) -> str:
    """An oracle: ``WITH view AS (...) ... body``."""
    heads = ", ".join(f"{name} AS ({on_duckdb(sql)})" for name, sql in views.items())
    return f"WITH {heads} {body}"

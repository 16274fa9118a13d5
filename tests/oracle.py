"""Run catalog entries next to their oracles: ``python -m tests.oracle [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 9)
    return value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> str | None:
    """None if both give the same columns and the same bag of rows, else what differs."""
    got = rows_of(df.columns, df.collect())
    start = time.time()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = rows_of(names, result.fetchall())
    compare.oracle_seconds = time.time() - start
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if got != expected:
        return f"{sum(got.values())} rows vs {sum(expected.values())}; only here {list((got - expected))[:3]}; only there {list((expected - got))[:3]}"
    return None


def main() -> None:
    import __spark_entry__ as e
    from herdwatch.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session(
        master="local[8]",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="8g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("OFF")
    con, oracle = connect(sf_dir), e.oracle_sql()
    for name, run in e.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in oracle:
                problem = compare(df, con, oracle[name])
            else:
                problem = f"no oracle, {len(df.collect())} rows"
        except Exception as x:  # noqa: BLE001 - a report over all entries
            problem = f"{type(x).__name__}: {str(x)[:700]}"
        spent = getattr(compare, "oracle_seconds", 0)
        print(f"{'ok ' if problem is None else 'BAD' if name in oracle else '-- '} {name} {time.time() - start - spent:.2f}s (oracle {spent:.2f}s) {problem or ''}", flush=True)


if __name__ == "__main__":
    main()

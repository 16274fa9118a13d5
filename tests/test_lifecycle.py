from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from herdwatch.functions import patterns
from herdwatch.operators import lifecycle

# Own examples of each rule: whole match, digits, quoted text, real dates, leap days, half days.
NAMES = {
    "'ledger-'yyyy": (["ledger-1999", "ledger-2031"], ["ledger-99", "ledger-19991", "Ledger-1999", "ledger-", "xledger-1999"]),
    "'m'yyyy'q'MM": (["m2024q01", "m2024q12"], ["m2024q00", "m2024q13", "m2024q1", "m2024-01", "m2024q011"]),
    "yyyy_MM_dd'.part'": (["2024_02_29.part"], ["2023_02_29.part", "2024_02_30.part", "2024_2_29.part", "2024_02_29"]),
    "'tick/'yyyyMMddHH": (["tick/2024022900", "tick/2024022923"], ["tick/2024022924", "tick/20240229", "tick/2023022900"]),
    "yyyy.MM.dd'/'aa": (["2024.12.31/AM", "2024.12.31/PM"], ["2024.12.31/XM", "2024.12.31/"]),
    "'wk'YYYY'.'ww": (["wk2024.01", "wk2024.52"], ["wk2024.54", "wk2024.1", "wk2024.00"]),
    "'o''clock'yyyy-M": (["o'clock2024-7", "o'clock2024-11"], ["o'clock2024-07", "oclock2024-7"]),
    "yyyy-D": (["2024-366", "2023-365", "2024-60"], ["2023-366", "2024-060"]),
}


def test_names_match_their_patterns_and_keep_their_shape(spark):
    rows = [(p, n, want) for p, (good, bad) in NAMES.items() for want, ns in ((True, good), (False, bad)) for n in ns]
    df = patterns.with_form(spark.createDataFrame(rows, "pattern string, name string, want boolean"), "pattern")
    got = df.select(
        "*",
        patterns.matches_form(F.col("name"), F.col("form")).alias("got"),
        F.array_contains("form.shapes", patterns.name_shape(F.col("name"))).alias("shaped"),
    ).collect()
    assert [(r.pattern, r.name) for r in got if r.got != r.want] == []
    assert [(r.pattern, r.name) for r in got if r.want and not r.shaped] == []


def test_known_patterns_need_no_table(spark):
    df = spark.createDataFrame([("a201802",), ("a20182",)], "name string")
    assert [r[0] for r in df.select(patterns.matches_pattern(F.col("name"), "'a'yyyyMM")).collect()] == [True, False]


@pytest.mark.parametrize(
    ("pattern", "error"),
    [
        ("eventsyyyy", "unsupported field e"),
        ("'open", "unterminated quote"),
        ("'a'yyyy[MM]", "reserved character outside quotes"),
        ("'a'YYYY-ww-dd", "unsupported week pattern"),
        ("'a'MM", "no year"),
        ("'a'yyyyMM", None),
        ("'a'", None),
    ],
)
def test_pattern_errors(pattern, error):
    assert patterns.compile_pattern(pattern)["error"] == error


def resolved(spark, *documents):
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(documents)], "i int, doc string")
    return lifecycle.resolve_policies(lifecycle.parse_policies(rows, "doc"))


def test_policies_are_read(spark):
    rows = resolved(
        spark,
        '[{"retentionType":"yearly","retentionPeriod":4}]',
        '[{"retentionType":"daily","indexName":"orders"}]',
        '[{"retentionType":"daily","indexName":"orders","retentionPeriod":"soon"}]',
        '[{"indexNamePattern":"eyyyy","retentionPeriod":"P3D"}]',
        '[{"retentionType":"daily"',
        '[{"indexNamePattern":"\'q\'yyyy","retentionPeriod":"PT90M","color":{"a":1}}]',
        '[{"indexNamePattern":"\'q\'yyyy","indexName":"z","retentionType":"daily","retentionPeriod":"P2Y","preCreate":true}]',
        "[]",
        '[{"indexName":"q","retentionType":"fortnightly","retentionPeriod":1}]',
        '[{"indexName":"q","retentionPeriod":"P"},{"indexName":"r","retentionPeriod":11,"preCreate":"false"}]',
    ).collect()
    seen = {(r.i, r.pos): r for r in rows}
    assert 7 not in {i for i, _ in seen}
    assert (seen[0, 0].pattern, seen[0, 0].actionable) == (None, False)
    assert (seen[1, 0].period, seen[1, 0].actionable, seen[1, 0].error) == (None, False, None)
    assert seen[2, 0].error == "bad retention period"
    assert seen[3, 0].error == "unsupported field e"
    assert seen[4, None].error == "bad json"
    assert (seen[5, 0].period.minutes, seen[5, 0].actionable) == (90, True)
    assert (seen[6, 0].pattern, seen[6, 0].pre_create) == ("'q'yyyy", True)
    assert seen[8, 0].error == "unknown retention type"
    assert seen[9, 0].error == "bad retention period"
    assert (seen[9, 1].period.days, seen[9, 1].pre_create, seen[9, 1].actionable) == (11, False, True)


def test_cutoffs_and_next_names(spark):
    """The clock stands on a leap day, in its last hour, so that all next names roll over."""
    policies = resolved(
        spark,
        '[{"indexName":"y","retentionType":"yearly","retentionPeriod":4}]',
        '[{"indexName":"m","retentionType":"monthly","retentionPeriod":3}]',
        '[{"indexName":"d","retentionPeriod":59}]',
        '[{"indexName":"h","retentionType":"hourly","retentionPeriod":24},{"indexName":"h","retentionType":"hourly","retentionPeriod":1}]',
    )
    now = "2024-02-29 23:05:00"
    out = lifecycle.next_name(lifecycle.cutoff(policies, now), now).orderBy("i", "pos").collect()
    assert [(r.cutoff, r.next_name) for r in out] == [
        (datetime(2020, 1, 1), "y2025"),
        (datetime(2023, 11, 1), "m202403"),
        (datetime(2024, 1, 1), "d20240301"),
        (datetime(2024, 2, 28, 23), "h2024030100"),
        (datetime(2024, 2, 29, 22), "h2024030100"),
    ]


def test_years_come_off_before_months(spark):
    policies = resolved(spark, '[{"indexNamePattern":"\'a\'yyyyMMdd","retentionPeriod":"P1Y1M"}]')
    assert lifecycle.cutoff(policies, "2020-02-29 10:00:00").first().cutoff == datetime(2019, 1, 28)


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "name string")


def test_retention_keeps_the_cutoff_itself(spark):
    """What lies before the cutoff goes; the cutoff and what follows stay."""
    daily = resolved(spark, '[{"indexName":"trace","retentionPeriod":2}]')
    listed = names(spark, "trace20240227", "trace20240228", "trace20240226", "trace20240301", "trace20240230", "other20200101")
    plan = lifecycle.expired(listed, daily, "2024-02-29 00:00:00")
    assert [r.name for r in plan.collect()] == ["trace20240226"]

    monthly = resolved(spark, '[{"indexName":"bill","retentionType":"monthly","retentionPeriod":1}]')
    listed = names(spark, "bill202311", "bill202312", "bill202401", "bill202402")
    plan = lifecycle.expired(listed, monthly, "2024-01-15 08:00:00")
    assert sorted(r.name for r in plan.collect()) == ["bill202311"]


def test_overlapping_policies_count_each(spark):
    both = resolved(
        spark,
        '[{"indexName":"s","retentionType":"monthly","retentionPeriod":2},'
        '{"indexName":"s20","retentionType":"yearly","retentionPeriod":1}]',
    )
    listed = names(spark, "s202401", "s202412", "s209913")
    matched = lifecycle.match_policies(both, listed).groupBy("pattern").count().collect()
    # After the second policy's literal 2401, 2412 and 9913 read as years; 209913 is no month.
    counts = {r.pattern: r["count"] for r in matched}
    assert sorted(counts.values()) == [2, 3]


def test_to_create(spark):
    policies = resolved(
        spark,
        '[{"indexName":"d","retentionPeriod":9,"preCreate":true},{"indexName":"m","retentionType":"monthly","retentionPeriod":9,"preCreate":true},'
        '{"indexName":"none","retentionPeriod":9,"preCreate":true},{"indexName":"off","retentionPeriod":9},'
        '{"indexNamePattern":"\'fixed\'","retentionPeriod":"P1D","preCreate":true}]',
    )
    listed = names(spark, "d20240101", "m202401", "m202402", "off20240101", "fixed")
    rows = lifecycle.to_create(listed, policies, "2024-01-31 12:00:00").collect()
    assert {(r.next_name, r.error) for r in rows} == {("d20240201", None), (None, "pattern never changes")}


def test_drop_plan_applies(spark):
    rows = spark.createDataFrame([("a2012", 1), ("a2012", 2), ("a2017", 3)], "name string, v long")
    policies = resolved(spark, '[{"indexName":"a","retentionType":"yearly","retentionPeriod":3}]')
    plan = lifecycle.expired(lifecycle.list_datasets(rows), policies, "2017-06-01 00:00:00")
    assert [r.v for r in lifecycle.kept(rows, plan).collect()] == [3]
    stats = rows.select("name", F.lit(1).alias("rows"), F.col("v").alias("bytes"))
    assert tuple(lifecycle.reclaim_report(plan, stats).first()) == ("a2012", 2, 3)


def test_numbered_clusters_only_meet_their_own_policies(spark):
    texts = ["'c%d_'yyyyMMdd", "'c%d_'yyyy", "yyyy-MM'/c%d'", "'c%d-'yyyy-D", "'c%d.'YYYYww"]
    usable = [(texts[i % 5] % i,) for i in range(100, 300)]
    policies = patterns.with_form(spark.createDataFrame(usable, "pattern string"), "pattern").withColumn("actionable", F.lit(True))
    names = ["c%d_20240229", "c%d_2024", "2024-02/c%d", "c%d-2024-60", "c%d.202409"]
    datasets = spark.createDataFrame([(names[i % 5] % i,) for i in range(100, 300)] + [("c100_20240230",), ("other",)], "name string")
    assert lifecycle.candidates(policies, datasets).count() <= 2 * 200 + 1
    got = {(r.pattern, r.name) for r in lifecycle.match_policies(policies, datasets).select("pattern", "name").collect()}
    assert got == {(texts[i % 5] % i, names[i % 5] % i) for i in range(100, 300)}


def test_layouts_hold_every_name_that_matches(spark):
    rows = [(p, n) for p, (good, _) in NAMES.items() for n in good]
    df = spark.createDataFrame(rows, "pattern string, name string")
    policies = patterns.with_form(df.select("pattern").distinct(), "pattern").withColumn("actionable", F.lit(True))
    found = {(r.pattern, r.name) for r in lifecycle.candidates(policies, df.select("name").distinct()).select("pattern", "name").collect()}
    assert found >= set(rows)


def test_a_callers_filter(spark):
    policies = patterns.with_form(spark.createDataFrame([("'a'yyyy",), ("'b'yyyyMM",)], "pattern string"), "pattern").withColumn("actionable", F.lit(True))
    datasets = spark.createDataFrame([("axx",), ("bxx",), ("cxx",), ("a1999",)], "name string")
    own = lifecycle.NameFilter(
        matches=lambda name, pattern: ~name.contains("1") & pattern.contains("yyyy"),
        name_key=lambda name: F.substring(name, 1, 1),
        pattern_key=lambda pattern: F.substring(pattern, 2, 1),
    )
    got = lifecycle.match_policies(policies, datasets, own).select("name", "pattern").collect()
    assert sorted(map(tuple, got)) == [("axx", "'a'yyyy"), ("bxx", "'b'yyyyMM")]

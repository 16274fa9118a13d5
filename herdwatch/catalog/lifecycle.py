"""Catalog entries for the dataset lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from herdwatch.catalog import views
from herdwatch.catalog.base import Entry, on_spark, with_views
from herdwatch.functions import patterns
from herdwatch.operators import lifecycle

NOW = "1999-06-15 12:34:56"

# Policies over the datasets below: (JSON, pattern, strftime form, period for SQL, pre-create).
POLICIES = [
    ('{"indexName":"orders_","retentionType":"yearly","retentionPeriod":2}', "'orders_'YYYY", "orders_%Y", "INTERVAL 2 YEAR", False),
    ('{"indexName":"orders_","retentionType":"Monthly","retentionPeriod":"20","preCreate":true}', "'orders_'YYYYMM", "orders_%Y%m", "INTERVAL 20 MONTH", True),
    ('{"indexName":"orders_","retentionPeriod":400,"preCreate":"true"}', "'orders_'YYYYMMdd", "orders_%Y%m%d", "INTERVAL 400 DAY", True),
    ('{"indexNamePattern":"\'audit-\'YYYY.MM.dd","retentionPeriod":"P14M","preCreate":true}', "'audit-'YYYY.MM.dd", "audit-%Y.%m.%d", "INTERVAL 14 MONTH", True),
    ('{"indexName":"orders_","retentionType":"hourly","retentionPeriod":40,"preCreate":true}', "'orders_'YYYYMMddHH", "orders_%Y%m%d%H", "INTERVAL 40 HOUR", True),
    ('{"indexNamePattern":"\'orders_\'yyyyMM","retentionPeriod":"P1Y"}', "'orders_'yyyyMM", "orders_%Y%m", "INTERVAL 1 YEAR", False),
]
NOT_ACTIONABLE = ['{"indexName":"orders_"}', '{"retentionPeriod":3}', '{"indexName":"orders_","retentionPeriod":"A"}']


def policies(spark: SparkSession) -> DataFrame:
    document = "[" + ",".join([p[0] for p in POLICIES] + NOT_ACTIONABLE) + "]"
    parsed = lifecycle.parse_policies(spark.createDataFrame([(document,)], "policy_json string"), "policy_json")
    return lifecycle.resolve_policies(parsed)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_spark(spark, sf_dir, views.DATASET_PARTS)


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.list_datasets(parts(spark, sf_dir))


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole_price = F.round("price").cast("bigint")
    return parts(spark, sf_dir).select("name", F.lit(1).cast("bigint").alias("rows"), whole_price.alias("bytes"))


def _text(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


DATASETS = "select distinct name from parts"
_quote = lambda text: "'" + text.replace("'", "''") + "'"
STEPS = ("INTERVAL 1 MINUTE", "INTERVAL 1 HOUR", "INTERVAL 1 DAY", "INTERVAL 7 DAY", "INTERVAL 1 MONTH", "INTERVAL 1 YEAR")


def _policy_row(pattern: str, form: str, period: str, pre: bool) -> str:
    now, form = f"timestamp '{NOW}'", _quote(form)
    ahead = ", ".join(f"nullif(strftime({now} + {s}, {form}), strftime({now}, {form}))" for s in STEPS)
    return (
        f"select {_quote(pattern)} as pattern, strptime(strftime({now} - {period}, {form}), {form}) as cutoff, "
        f"{str(pre).lower()} as pre_create, coalesce({ahead}) as next_name"
    )


POLICY_ROWS = " union all ".join(_policy_row(*p[1:]) for p in POLICIES)
# strptime takes constant formats only, hence one branch per policy.
MATCHES = " union all ".join(
    f"select name, pattern, try_strptime(name, {_quote(form)}) as name_date, cutoff, pre_create, next_name from datasets, policies "
    f"where pattern = {_quote(pattern)} and strftime(try_strptime(name, {_quote(form)}), {_quote(form)}) = name"
    for _, pattern, form, _, _ in POLICIES
)
def _oracle(body: str) -> str:
    return with_views(body, parts=views.DATASET_PARTS, datasets=DATASETS, policies=POLICY_ROWS, matches=MATCHES)


# What each kind of customer policy document means (see views.POLICY_JSON).
_EXPECTED = """
select c_custkey, cast(pos as int) as pos, pattern, years, months, weeks, days, hours, minutes, seconds, pre_create,
       error is null and pattern is not null and years is not null as actionable, error
from (
  select *,
    case m when 0 then q || 'YYYY' when 1 then q || 'YYYYMM' when 2 then q || 'YYYYMMdd' when 3 then q || 'YYYYMMddHH'
      when 4 then '''c' || k || '-''YYYY-MM-dd' when 5 then '''c' || k || '''YYYYMMdd' when 6 then q || 'YYYYMM'
      when 7 then q || 'YYYYMM' when 8 then 'c' || k || '_logYYYY' when 11 then q || 'YYYYMMdd' end as pattern,
    case when m in (6, 7, 9, 10) then null when m = 0 then p when m = 11 then 1 else 0 end as years,
    case when m in (6, 7, 9, 10) then null when m in (1, 4, 11) then p when m = 8 then 1 when m = 13 then 20 else 0 end as months,
    case when m in (6, 7, 9, 10) then null when m = 11 then 2 else 0 end as weeks,
    case when m in (6, 7, 9, 10) then null when m = 2 then p when m = 11 then 3 else 0 end as days,
    case when m in (6, 7, 9, 10) then null when m in (3, 5) then p when m = 11 then 4 else 0 end as hours,
    case when m in (6, 7, 9, 10) then null when m = 11 then 5 else 0 end as minutes,
    case when m in (6, 7, 9, 10) then null when m = 11 then 6 else 0 end as seconds,
    m in (1, 4) as pre_create,
    case m when 7 then 'bad retention period' when 8 then 'unsupported field c' when 9 then 'bad json' when 10 then 'unknown retention type' end as error
  from (
    select *, '''c' || k || '_''' as q from (
      select c_custkey, cast(case when c_custkey % 12 = 9 then null else 0 end as int) as pos, cast(c_custkey % 12 as int) as m,
             cast(c_custkey as string) as k, cast(1 + c_custkey % 30 as int) as p from customer
      union all
      select c_custkey, 1, 13, cast(c_custkey as string), 0 from customer where c_custkey % 12 = 3
    ) as a
  ) as b
) as c
"""


def _customer_policies(spark, sf_dir):
    documents = on_spark(spark, sf_dir, views.POLICY_JSON)
    return lifecycle.resolve_policies(lifecycle.parse_policies(documents, "policy_json"))


def _parse(spark, sf_dir):
    period = (F.col(f"period.{u}").cast("int").alias(u) for u in ("years", "months", "weeks", "days", "hours", "minutes", "seconds"))
    return _customer_policies(spark, sf_dir).select("c_custkey", "pos", "pattern", *period, "pre_create", "actionable", "error")


def _customer_plans(spark, sf_dir):
    usable = _customer_policies(spark, sf_dir).filter("actionable")
    planned = lifecycle.next_name(lifecycle.cutoff(usable, NOW), NOW)
    return planned.select("c_custkey", "pattern", _text("cutoff"), "next_name")


_PLANS_SQL = f"""
select c_custkey, pattern, strftime(case when m = 0 then date_trunc('year', past) when m = 1 then date_trunc('month', past)
    when m = 3 then date_trunc('hour', past) else date_trunc('day', past) end, '%Y-%m-%d %H:%M:%S') as cutoff,
  case m when 0 then 'c' || k || '_2000' when 1 then 'c' || k || '_199907' when 3 then 'c' || k || '_1999061513'
    when 4 then 'c' || k || '-1999-06-16' when 5 then 'c' || k || '19990616' else 'c' || k || '_19990616' end as next_name
from (
  select *, cast(c_custkey % 12 as int) as m, cast(c_custkey as string) as k,
    timestamp '{NOW}' - to_years(cast(years as int)) - to_months(cast(months as int)) - to_days(cast(weeks * 7 + days as int))
      - to_hours(hours) - to_minutes(minutes) - to_seconds(seconds) as past
  from ({_EXPECTED}) as e where actionable
) as f
"""

# Names of the form year-week and day-halfday, good and bad.
WEEK_NAMES = (
    "select distinct 'wk-' || cast(year(o_orderdate) as string) || '-' || lpad(cast(o_orderkey % 60 as string), 2, '0') as name, "
    "cast(year(o_orderdate) as int) as y, cast(o_orderkey % 60 as int) as w from {orders}"
)
HALF_DAYS = (
    "select distinct 'log-' || cast(year(o_orderdate) as string) || '-' || lpad(cast(1 + o_orderkey % 13 as string), 2, '0') || '-' || "
    "lpad(cast(1 + o_custkey % 31 as string), 2, '0') || '-' || case when o_orderkey % 3 = 0 then 'AM' when o_orderkey % 3 = 1 then 'PM' else 'BC' end as name from {orders}"
)


# Numbered clusters: each customer's datasets, named as the customer's policy has it.
_K = "'c' || cast(o_custkey as string)"
CUSTOMER_NAMES = (
    "select distinct c_custkey, case m when 0 then k || '_' || y when 1 then k || '_' || y || mo when 3 then k || '_' || y || mo || d || '07' "
    "when 4 then k || '-' || y || '-' || mo || '-' || d when 5 then k || y || mo || d else k || '_' || y || mo || d end as name from "
    f"(select o_custkey as c_custkey, cast(o_custkey % 12 as int) as m, {_K} as k, cast(year(o_orderdate) as string) as y, "
    "lpad(cast(month(o_orderdate) as string), 2, '0') as mo, lpad(cast(day(o_orderdate) as string), 2, '0') as d from {orders}) as x"
)


def _customer_matches(spark, sf_dir):
    listing = on_spark(spark, sf_dir, CUSTOMER_NAMES).select("name").distinct()
    return lifecycle.match_policies(_customer_policies(spark, sf_dir), listing).select("c_custkey", "pattern", "name")


# A caller's filter: names of a pattern's first word, of any form, as long as the pattern without its quotes.
BY_WORD = lifecycle.NameFilter(
    matches=lambda name, pattern: F.length(name) == F.length(F.replace(pattern, F.lit("'"), F.lit(""))),
    name_key=lambda name: F.regexp_extract(name, "^[a-z]*", 0),
    pattern_key=lambda pattern: F.regexp_extract(pattern, "^'([a-z]*)", 1),
)


def _named(view: str, pattern: str):
    def run(spark, sf_dir):
        names = on_spark(spark, sf_dir, view).select("name").distinct()
        form = patterns.pattern_form(pattern)
        dated = names.withColumns(
            {"matches": patterns.matches_form(F.col("name"), form), "name_date": patterns.name_date(F.col("name"), form)}
        )
        return dated.select("name", "matches", F.when(F.col("matches"), F.date_format("name_date", "yyyy-MM-dd HH:mm")).alias("name_date"))

    return run


def entries() -> list[Entry]:
    return [
        Entry("parse_policies", _parse, _EXPECTED),
        Entry("policy_cutoff_and_next_name", _customer_plans, _PLANS_SQL),
        Entry("list_datasets", datasets, _oracle("select name from datasets")),
        Entry(
            "match_policies",
            lambda s, d: lifecycle.match_policies(policies(s), datasets(s, d)).select("name", "pattern"),
            _oracle("select name, pattern from matches"),
        ),
        Entry(
            "match_customer_policies",
            _customer_matches,
            with_views("select e.c_custkey, e.pattern, n.name from e join n using (c_custkey) where e.actionable", e=_EXPECTED, n=CUSTOMER_NAMES),
        ),
        Entry(
            "match_policies_by_filter",
            lambda s, d: lifecycle.match_policies(policies(s), datasets(s, d), BY_WORD).select("name", "pattern"),
            _oracle(
                "select name, pattern from datasets, policies where length(name) = length(replace(pattern, chr(39), '')) "
                "and regexp_extract(name, '^[a-z]*') = regexp_extract(pattern, '^' || chr(39) || '([a-z]*)', 1)"
            ),
        ),
        Entry(
            "week_names",
            _named(WEEK_NAMES, "'wk'-YYYY-ww"),
            with_views(
                "select name, ok as matches, case when ok then strftime(monday, '%Y-%m-%d 00:00') end as name_date from "
                "(select *, w >= 1 and weekofyear(monday) = w as ok from (select *, cast(date_trunc('week', make_date(y, 1, 4)) as date) + (w - 1) * 7 as monday from w) as a) as b",
                w=WEEK_NAMES,
            ),
        ),
        Entry(
            "half_day_names",
            _named(HALF_DAYS, "'log'-YYYY-MM-dd-aa"),
            with_views(
                "select name, ok as matches, case when ok then strftime(day, '%Y-%m-%d ') || case when name like '%AM' then '00:00' else '12:00' end end as name_date from "
                "(select *, day is not null and strftime(day, '%Y-%m-%d') = substr(name, 5, 10) and name not like '%BC' as ok from "
                "(select name, try_strptime(substr(name, 5, 10), '%Y-%m-%d') as day from n) as a) as b",
                n=HALF_DAYS,
            ),
        ),
        Entry(
            "expired_datasets",
            lambda s, d: lifecycle.expired(datasets(s, d), policies(s), NOW).select(
                "name", "pattern", _text("name_date"), _text("cutoff")
            ),
            _oracle(
                "select name, pattern, strftime(name_date, '%Y-%m-%d %H:%M:%S') as name_date, strftime(cutoff, '%Y-%m-%d %H:%M:%S') as cutoff "
                "from matches where name_date < cutoff"
            ),
        ),
        Entry(
            "datasets_to_create",
            lambda s, d: lifecycle.to_create(datasets(s, d), policies(s), NOW),
            _oracle(
                "select distinct pattern, next_name, cast(null as string) as error from matches where pre_create "
                "and next_name not in (select name from datasets)"
            ),
        ),
        Entry(
            "reclaim_report",
            lambda s, d: lifecycle.reclaim_report(lifecycle.expired(datasets(s, d), policies(s), NOW), _stats(s, d)),
            _oracle(
                "select name, count(*) as rows, cast(sum(cast(round(price) as bigint)) as bigint) as bytes from parts "
                "where name in (select name from matches where name_date < cutoff) group by name"
            ),
        ),
        Entry(
            "kept_after_drop",
            lambda s, d: lifecycle.kept(
                parts(s, d), lifecycle.expired(datasets(s, d), policies(s), NOW)
            ).groupBy("name").agg(F.count(F.lit(1)).alias("n")),
            _oracle("select name, count(*) as n from parts where name not in (select name from matches where name_date < cutoff) group by name"),
        ),
    ]

"""Queries of the two general data-processing operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import malformed, rolling
from ..session import table

P2_LIMITS = {7: -0.2, 30: -0.35}


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return rolling.below(rolling.rolling_totals(table(spark, folder, "wrds_pull")), P2_LIMITS)


def p2_rolling_totals(spark: SparkSession, folder: str) -> DataFrame:
    return rolling.rolling_totals(table(spark, folder, "wrds_pull")).withColumnRenamed("day", "date")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return malformed.rejects(malformed.load_records(table(spark, folder, "fnspid_raw")))


def p4_loaded(spark: SparkSession, folder: str) -> DataFrame:
    return malformed.good_rows(malformed.load_records(table(spark, folder, "fnspid_raw"))).select("raw_id", "Date", "Article")


QUERIES = {f.__name__: f for f in (p2_found, p2_rolling_totals, p4_found, p4_loaded)}

_DAILY = """
with newest as (
  select permno, date, ret from (
    select permno, date, ret, row_number() over (partition by permno, date order by loaded_at desc nulls last, case when isnan(ret) then null else ret end desc nulls last) as place
    from wrds_pull where permno is not null and date is not null)
  where place = 1),
days as (select permno, cast(unnest(generate_series(min(date), max(date), interval 1 day)) as date) as day from newest group by permno),
filled as (select d.permno, d.day, case when n.ret >= -1 and not isnan(n.ret) then n.ret end as r from days d left join newest n on n.permno = d.permno and n.date = d.day),
totals as (
  select permno, day,
    round(sum(coalesce(r, 0e0)) over w7, 6) + 0e0 as total_7, count(r) over w7 as n_7, round(sum(coalesce(r, 0e0)) over w7 / count(*) over w7, 8) + 0e0 as avg_7,
    round(sum(coalesce(r, 0e0)) over w30, 6) + 0e0 as total_30, count(r) over w30 as n_30, round(sum(coalesce(r, 0e0)) over w30 / count(*) over w30, 8) + 0e0 as avg_30
  from filled
  window w7 as (partition by permno order by day rows between 6 preceding and current row), w30 as (partition by permno order by day rows between 29 preceding and current row))
"""
_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
_WHITE = "\\x{0009}-\\x{000D}\\x{001C}-\\x{0020}\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
_RECORDS = f"""
with shaped as (
  select raw_id, coalesce(raw, '') as raw, regexp_full_match(coalesce(raw, ''), '{_FIELD}(?:,{_FIELD})*', 's') as quoted,
    1 + length(regexp_replace(regexp_replace(coalesce(raw, ''), '"(?:[^"]|"")*"', '', 'g'), '[^,]', '', 'g')) as n
  from fnspid_raw),
cells as (
  select *, case when quoted and n = 12 then regexp_extract(raw, '^(?:{_FIELD},){{1}}({_FIELD})', 1) end as d, case when quoted and n = 12 then regexp_extract(raw, '^(?:{_FIELD},){{7}}({_FIELD})', 1) end as a
  from shaped),
bare as (
  select raw_id, quoted, n, case when d[1] = '"' then replace(d[2:-2], '""', '"') else d end as d, case when a[1] = '"' then replace(a[2:-2], '""', '"') else a end as a
  from cells),
labelled as (
  select raw_id, d, a, case
    when not quoted then 'quoting'
    when n <> 12 then 'columns'
    when not regexp_full_match(d, '\\d{{4}}-\\d{{2}}-\\d{{2}} \\d{{2}}:\\d{{2}}:\\d{{2}} UTC') or d[1:4] = '0000' or d[18:19] > '59' or d[12:13] > '23' or try_cast(d[1:19] as timestamp) is null then 'date'
    when regexp_replace(a, '^[{_WHITE}]+|[{_WHITE}]+$', '', 'g') in ('', '#N/A', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null', '<NA>') or regexp_matches(a, '[\\x{{FFFD}}\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]') then 'article'
    end as reason
  from bare)
"""

ORACLE = {
    "p2_found": _DAILY + "select permno, strftime(day, '%Y-%m-%d') as day, cast(7 as int) as span from totals where total_7 < -0.2e0 union all select permno, strftime(day, '%Y-%m-%d'), cast(30 as int) from totals where total_30 < -0.35e0",
    "p2_rolling_totals": _DAILY + "select permno, day as date, total_7, n_7, avg_7, total_30, n_30, avg_30 from totals",
    "p4_found": _RECORDS + "select raw_id, reason from labelled where reason is not null",
    "p4_loaded": _RECORDS + "select raw_id, cast(d[1:19] as timestamp) as Date, a as Article from labelled where reason is null",
}

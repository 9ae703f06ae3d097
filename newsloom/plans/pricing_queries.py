"""Queries over return panels: joins in time, shocks, covariances, the factor model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ipca, reports, returns
from ..session import cut, table

HALFLIVES = (20, 60, 120)
#: Stocks of a year's universe, as in the reference.
UNIVERSE = 1_000


def orders_attention(spark: SparkSession, folder: str) -> DataFrame:
    """date, topic, theta: each order priority's share of the day's value, 0 where absent."""
    orders = table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("topic"), "o_totalprice")
    priorities = [r.topic for r in orders.select("topic").distinct().orderBy("topic").collect()]
    wide = orders.groupBy("date").pivot("topic", priorities).agg(F.sum("o_totalprice"))
    whole = sum((F.coalesce(F.col(f"`{t}`"), F.lit(0.0)) for t in priorities[1:]), F.coalesce(F.col(f"`{priorities[0]}`"), F.lit(0.0)))
    return wide.select("date", F.inline(F.array(*(F.struct(F.lit(t).alias("topic"), (F.coalesce(F.col(f"`{t}`"), F.lit(0.0)) / whole).alias("theta")) for t in priorities))))


def line_returns(spark: SparkSession, folder: str) -> DataFrame:
    """date, id, ret: mean discount of the lines of ten suppliers' groups, less 5 %."""
    lines = table(spark, folder, "lineitem")
    return lines.groupBy(F.to_date("l_shipdate").alias("date"), (F.col("l_suppkey") % 10).alias("id")).agg((F.avg("l_discount") - 0.05).alias("ret"))


def stock_returns(spark: SparkSession, folder: str) -> DataFrame:
    """date, id, ret of the stock file; codes below -1 are null."""
    return table(spark, folder, "wrds_pull").select("date", F.col("permno").alias("id"), F.when(F.col("ret") >= -1, F.col("ret")).alias("ret"))


def rate(spark: SparkSession, folder: str) -> DataFrame:
    days = table(spark, folder, "wrds_pull").select("date").distinct()
    return days.select("date", (0.0001 * (1 + F.month("date") % 3)).alias("rf"))


def _trading(spark: SparkSession, folder: str) -> DataFrame:
    return returns.to_trading_days(orders_attention(spark, folder), line_returns(spark, folder).select("date").distinct())


def _shocks(spark: SparkSession, folder: str) -> DataFrame:
    return returns.shocks(_trading(spark, folder))


def _instruments(spark: SparkSession, folder: str, halflives: tuple[int, ...] = (60,)) -> DataFrame:
    return returns.covariances(line_returns(spark, folder), _shocks(spark, folder), halflives)


def _monthly(spark: SparkSession, folder: str) -> DataFrame:
    return returns.monthly(line_returns(spark, folder), 10)


def _moments(spark: SparkSession, folder: str, halflives: tuple[int, ...] = (60,)) -> ipca.Moments:
    instruments = cut(_instruments(spark, folder, halflives))
    return ipca.moments(returns.wide_panel(instruments, _monthly(spark, folder), [f"cov_{h}" for h in halflives]))


def shocks(spark: SparkSession, folder: str) -> DataFrame:
    return _shocks(spark, folder).select("date", "topic", (F.round("z", 9) + 0.0).alias("z"))


def asof_trading_day(spark: SparkSession, folder: str) -> DataFrame:
    return _trading(spark, folder).select("date", "topic", F.round("theta", 9).alias("theta"))


def month_starts(spark: SparkSession, folder: str) -> DataFrame:
    return returns.month_starts(line_returns(spark, folder).select("date").distinct())


def validity_join(spark: SparkSession, folder: str) -> DataFrame:
    daily = table(spark, folder, "wrds_pull").select("date", "permno", "ret")
    return returns.valid_join(daily, table(spark, folder, "dsenames"))


def universe_topn(spark: SparkSession, folder: str) -> DataFrame:
    return returns.largest_by_year(table(spark, folder, "wrds_pull"), UNIVERSE).select("year", "permno", F.round("me", 2).alias("me"), "place")


def universe_days(spark: SparkSession, folder: str) -> DataFrame:
    daily = table(spark, folder, "wrds_pull")
    return returns.of_universe(daily, returns.largest_by_year(daily, UNIVERSE)).select("year", "permno", "date", "ret")


def excess_returns(spark: SparkSession, folder: str) -> DataFrame:
    return returns.excess(stock_returns(spark, folder), rate(spark, folder)).select("date", "id", F.round("ret", 9).alias("ret"))


def returns_pivot_mean(spark: SparkSession, folder: str) -> DataFrame:
    return returns.daily_mean(stock_returns(spark, folder)).select("date", "id", F.round("ret", 9).alias("ret"))


def monthly_returns(spark: SparkSession, folder: str) -> DataFrame:
    return returns.monthly(stock_returns(spark, folder)).select("month", "id", F.round("ret", 9).alias("ret"))


def monthly_excess(spark: SparkSession, folder: str) -> DataFrame:
    return returns.monthly_excess(stock_returns(spark, folder), rate(spark, folder)).select("month", "id", F.round("ret", 9).alias("ret"))


def ew_market(spark: SparkSession, folder: str) -> DataFrame:
    return returns.equal_weight(returns.monthly(stock_returns(spark, folder))).select("month", F.round("market", 9).alias("market"))


def sharpe(spark: SparkSession, folder: str) -> DataFrame:
    return returns.sharpe(returns.equal_weight(returns.monthly(stock_returns(spark, folder))), "market").select(F.round("sharpe", 6).alias("sharpe"))


def ewma_cov(spark: SparkSession, folder: str) -> DataFrame:
    return _instruments(spark, folder).select("month", "id", "topic", (F.round(F.col("cov_60") * 1e6, 6) + 0.0).alias("cov_ppm"))


def ewma_cov_multi(spark: SparkSession, folder: str) -> DataFrame:
    return _instruments(spark, folder, HALFLIVES).select("month", "id", "topic", *((F.round(F.col(f"cov_{h}") * 1e6, 6) + 0.0).alias(f"cov_{h}_ppm") for h in HALFLIVES))


def ewma_cov_nulls(spark: SparkSession, folder: str) -> DataFrame:
    """As `ewma_cov`, on returns of which some are null or NaN, with whole days without any."""
    day = F.dayofyear("date")
    holed = line_returns(spark, folder).withColumn("ret", F.when((day % 11 == 0) | ((day + F.col("id")) % 7 == 0), F.lit(None)).when((day + F.col("id")) % 13 == 0, float("nan")).otherwise(F.col("ret")))
    return returns.covariances(holed, _shocks(spark, folder), (60,), 252, 100).select("month", "id", "topic", (F.round(F.col("cov_60") * 1e6, 6) + 0.0).alias("cov_ppm"))


def panel(spark: SparkSession, folder: str) -> DataFrame:
    rows = returns.panel(_instruments(spark, folder), _monthly(spark, folder))
    return rows.select("m_id", "month", "id", "topic", (F.round("x", 6) + 0.0).alias("x"), F.round("y", 9).alias("y"))


def panel_gram(spark: SparkSession, folder: str) -> DataFrame:
    rows = returns.wide_panel(_instruments(spark, folder), _monthly(spark, folder), ["cov_60"])
    return ipca.moments_table(rows).select("m_id", "month", "i", "j", (F.round("g", 5) + 0.0).alias("g"))


def _fit_frame(spark: SparkSession, model: ipca.Fit) -> DataFrame:
    rows = [(i, k, float(x)) for i, row in enumerate(model.gamma) for k, x in enumerate(row)]
    return spark.createDataFrame(rows, "feature int, factor int, loading double")


def ipca_fit(spark: SparkSession, folder: str) -> DataFrame:
    return _fit_frame(spark, ipca.fit(_moments(spark, folder), k=3, lam=1e-6))


def ipca_grouped(spark: SparkSession, folder: str) -> DataFrame:
    m = _moments(spark, folder, HALFLIVES)
    return _fit_frame(spark, ipca.fit(m, k=3, lam=1e-6, groups=ipca.row_groups(m.G.shape[1] - 1, len(HALFLIVES))))


def lambda_path(spark: SparkSession, folder: str) -> DataFrame:
    _, tried = ipca.tune(_moments(spark, folder))
    return spark.createDataFrame([(a, float(b), c) for a, b, c in tried], "lam double, sharpe double, active int")


def oos_portfolio(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame(ipca.out_of_sample(_moments(spark, folder)), "month string, mve_oos double")


def _grouped(spark: SparkSession, folder: str) -> tuple[ipca.Moments, list]:
    m = _moments(spark, folder, HALFLIVES)
    return m, ipca.row_groups(m.G.shape[1] - 1, len(HALFLIVES))


def oos_grouped(spark: SparkSession, folder: str) -> DataFrame:
    """Out-of-sample returns of the model over all horizons; a topic's rows enter and leave together. Eight penalties, as in the reference."""
    m, groups = _grouped(spark, folder)
    return spark.createDataFrame(ipca.out_of_sample(m, groups=groups, n_lams=8), "month string, mve_oos double")


def oos_refits(spark: SparkSession, folder: str) -> DataFrame:
    """Diagnostics of the refits of `oos_grouped` with a fixed penalty."""
    m, groups = _grouped(spark, folder)
    refits: list[dict] = []
    ipca.out_of_sample(m, groups=groups, lam=1e-6, refits=refits)
    return spark.createDataFrame([(r["month"], r["lam"], r["active"], r["is_sharpe"]) for r in refits], "month string, lam double, active int, is_sharpe double")


def selection_grouped(spark: SparkSession, folder: str) -> DataFrame:
    m, groups = _grouped(spark, folder)
    names = sorted(r.topic for r in table(spark, folder, "orders").select(F.col("o_orderpriority").alias("topic")).distinct().collect())
    return spark.createDataFrame([(i, names[i], x) for i, x in ipca.selection(ipca.fit(m, k=3, lam=1e-6, groups=groups))], "topic int, label string, group_norm double")


def market_oos(spark: SparkSession, folder: str) -> DataFrame:
    """The equal-weight market on the out-of-sample months of the panel; null where it has none."""
    months = _instruments(spark, folder).select("month").distinct()
    return returns.on_months(returns.equal_weight(_monthly(spark, folder)), months, 0.6).select("month", F.round("market", 9).alias("market"))


def pricing_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Yearly Sharpe ratio of the out-of-sample returns of both models with a fixed penalty, and their months."""

    def one(m: ipca.Moments, groups: list | None) -> DataFrame:
        series = spark.createDataFrame(ipca.out_of_sample(m, groups=groups, lam=1e-6), "month string, value double")
        return returns.sharpe(series, "value").crossJoin(series.agg(F.count("*").alias("months")))  # one row each

    return reports.pricing_summary({"single": one(_moments(spark, folder), None), "grouped": one(*_grouped(spark, folder))})


def selection_report(spark: SparkSession, folder: str) -> DataFrame:
    names = sorted(r.topic for r in table(spark, folder, "orders").select(F.col("o_orderpriority").alias("topic")).distinct().collect())
    return spark.createDataFrame([(i, names[i], x) for i, x in ipca.selection(ipca.fit(_moments(spark, folder), k=3, lam=1e-6))], "topic int, label string, row_norm double")


QUERIES = {
    f.__name__: f
    for f in (
        shocks, asof_trading_day, month_starts, validity_join, universe_topn, universe_days, excess_returns, returns_pivot_mean, monthly_returns, monthly_excess, ew_market, sharpe,
        ewma_cov, ewma_cov_multi, ewma_cov_nulls, panel, panel_gram, ipca_fit, ipca_grouped, lambda_path, oos_portfolio, oos_grouped, oos_refits, selection_report, selection_grouped, market_oos, pricing_summary,
    )
}

_ATTENTION = """
daily as (select cast(o_orderdate as date) as date, o_orderpriority as topic, sum(o_totalprice) as s from orders group by 1, 2),
attention as (
  select d.date, t.topic, coalesce(x.s, 0e0) / sum(x.s) over (partition by d.date) as theta
  from (select distinct date from daily) d cross join (select distinct topic from daily) t left join daily x on x.date = d.date and x.topic = t.topic),
lines as (select cast(l_shipdate as date) as date, l_suppkey % 10 as id, avg(l_discount) - 5e-2 as ret from lineitem group by 1, 2),
days as (select distinct date as td from lines),
trading as (select c.td as date, a.topic, avg(a.theta) as theta from attention a asof join days c on a.date <= c.td group by 1, 2),
lagged as (select date, topic, theta, avg(theta) over w as mean, count(theta) over w as n from trading window w as (partition by topic order by date rows between 5 preceding and 1 preceding)),
z as (select date, topic, z from (select date, topic, theta - mean as z, count(case when n = 5 then 1 end) over (partition by date) as have from lagged) where have = (select count(distinct topic) from trading))
"""
_COV = f"""{_ATTENTION},
cal as (select date, row_number() over (order by date) as pos from (select distinct date from lines join z using (date))),
starts as (select cast(date_trunc('month', date) as date) as month, min(pos) as start from cal group by 1 having min(pos) > 120),
win as (select month, date, start - 1 - pos as back from starts join cal on pos >= start - 252 and pos < start),
rows_ as (select month, id, topic, ret, z, back from win join lines using (date) join z using (date)),
cov as (
  select month, id, topic, {", ".join(f"sum(pow(0.5e0, back / {h}e0) * ret * z) / sum(pow(0.5e0, back / {h}e0)) - sum(pow(0.5e0, back / {h}e0) * ret) / sum(pow(0.5e0, back / {h}e0)) * sum(pow(0.5e0, back / {h}e0) * z) / sum(pow(0.5e0, back / {h}e0)) as cov_{h}" for h in HALFLIVES)}
  from rows_ group by month, id, topic having count(*) >= 120)
"""
_STOCKS = """
stocks as (select date, permno as id, case when ret >= -1 and not isnan(ret) then ret end as ret from wrds_pull),
rate as (select date, 1e-4 * (1 + month(date) % 3) as rf from (select distinct date from wrds_pull)),
compounded as (select cast(date_trunc('month', date) as date) as month, id, product(1 + ret) - 1 as ret from stocks where ret is not null group by 1, 2 having count(ret) >= 15),
market as (select month, avg(ret) as market from compounded group by month)
"""
_UNIVERSE = f"""
june as (select year(date) as year, permno, date, abs(prc) * shrout as me from wrds_pull where month(date) = 6),
last as (select year, permno, me from june where me is not null and not isnan(me) qualify row_number() over (partition by year, permno order by date desc, me desc) = 1),
top as (select year, permno, me, row_number() over (partition by year order by me desc, permno) as place from last qualify row_number() over (partition by year order by me desc, permno) <= {UNIVERSE})
"""
_PANEL = f"""{_COV},
months as (select month, row_number() over (order by month) - 1 as m_id from (select distinct month from cov)),
monthly as (select cast(date_trunc('month', date) as date) as month, id, product(1 + ret) - 1 as y from lines group by 1, 2 having count(ret) >= 10),
joined as (select month, id, topic, cov_60 as x, y from cov join monthly using (month, id)),
scaled as (select m_id, month, id, topic, x / greatest(stddev_pop(x) over (partition by topic), 1e-12) as x, y from joined join months using (month))
"""

ORACLE = {
    "shocks": f"with {_ATTENTION} select date, topic, round(z, 9) + 0e0 as z from z",
    "asof_trading_day": f"with {_ATTENTION} select date, topic, round(theta, 9) as theta from trading",
    "month_starts": f"with {_ATTENTION} select cast(date_trunc('month', td) as date) as month, min(td) as first from days group by 1",
    "validity_join": "select d.permno, d.date, d.ret, n.ticker as name_ticker, n.shrcd, n.exchcd from wrds_pull d join dsenames n on d.permno = n.permno and d.date between n.namedt and n.nameendt",
    "universe_topn": f"with {_UNIVERSE} select cast(year as int) as year, permno, round(me, 2) as me, cast(place as int) as place from top",
    "universe_days": f"with {_UNIVERSE} select cast(year(date) as int) as year, permno, date, ret from wrds_pull w where exists (select 1 from top t where t.permno = w.permno and t.year = year(w.date))",
    "excess_returns": f"with {_STOCKS} select date, id, round(ret - rf, 9) as ret from stocks join rate using (date)",
    "returns_pivot_mean": f"with {_STOCKS} select date, id, round(avg(ret), 9) as ret from stocks where ret is not null group by date, id",
    "monthly_returns": f"with {_STOCKS} select month, id, round(ret, 9) as ret from compounded",
    "monthly_excess": f"with {_STOCKS}, rates as (select cast(date_trunc('month', date) as date) as month, product(1 + rf) - 1 as rf from rate group by 1) select month, id, round(ret - rf, 9) as ret from compounded left join rates using (month)",
    "ew_market": f"with {_STOCKS} select month, round(market, 9) as market from market",
    "sharpe": f"with {_STOCKS} select round(avg(market) / stddev_samp(market) * sqrt(12e0), 6) as sharpe from market",
    "ewma_cov": f"with {_COV} select month, id, topic, round(cov_60 * 1e6, 6) + 0e0 as cov_ppm from cov",
    "ewma_cov_multi": f"with {_COV} select month, id, topic, {', '.join(f'round(cov_{h} * 1e6, 6) + 0e0 as cov_{h}_ppm' for h in HALFLIVES)} from cov",
    "ewma_cov_nulls": f"""with {_ATTENTION},
holed as (select date, id, case when dayofyear(date) % 11 = 0 or (dayofyear(date) + id) % 7 = 0 or (dayofyear(date) + id) % 13 = 0 then null else ret end as ret from lines),
cal as (select date, row_number() over (order by date) as pos from (select distinct date from lines join z using (date))),
starts as (select cast(date_trunc('month', date) as date) as month, min(pos) as start from cal group by 1 having min(pos) > 100),
win as (select month, date, start - 1 - pos as back from starts join cal on pos >= start - 252 and pos < start),
rows_ as (select month, id, topic, ret, z, pow(0.5e0, back / 60e0) as w from win join holed using (date) join z using (date) where ret is not null)
select month, id, topic, round((sum(w * ret * z) / sum(w) - sum(w * ret) / sum(w) * sum(w * z) / sum(w)) * 1e6, 6) + 0e0 as cov_ppm from rows_ group by month, id, topic having count(*) >= 100""",
    "panel": f"with {_PANEL} select cast(m_id as int) as m_id, month, id, topic, round(x, 6) + 0e0 as x, round(y, 9) as y from scaled",
    "market_oos": f"""with {_PANEL}, later as (select month from months where m_id >= floor(0.6e0 * (select count(*) from months)))
select month, round(avg(y), 9) as market from later left join monthly using (month) group by month""",
    "panel_gram": f"""with {_PANEL},
cells as (
  select m_id, month, id, cast(dense_rank() over (order by topic) as int) as i, x as v from scaled
  union all select distinct m_id, month, id, 0, 1e0 from scaled
  union all select distinct m_id, month, id, 1 + (select count(distinct topic) from scaled)::int, y from scaled)
select cast(a.m_id as int) as m_id, a.month, a.i as i, b.i as j, round(sum(a.v * b.v), 5) + 0e0 as g from cells a join cells b on a.m_id = b.m_id and a.id = b.id and a.i <= b.i group by 1, 2, 3, 4""",
}

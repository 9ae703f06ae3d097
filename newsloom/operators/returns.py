"""Joins in time, returns, attention shocks and covariance instruments."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..session import cut


def month(day: str) -> Column:
    """First day of the month, as a date."""
    return F.trunc(day, "MM")


def valid_join(daily: DataFrame, names: DataFrame) -> DataFrame:
    """Daily rows with the attributes that were valid on their day: equal permno, date within [namedt, nameendt]. Equi-join with a residual range."""
    n = names.select("permno", F.col("ticker").alias("name_ticker"), "namedt", "nameendt", "shrcd", "exchcd")
    return daily.join(n, "permno").where(F.col("date").between(F.col("namedt"), F.col("nameendt"))).drop("namedt", "nameendt")


def largest_by_year(daily: DataFrame, n: int = 1000, at_month: int = 6) -> DataFrame:
    """year, permno, me: the n largest by |prc| * shrout on their last known day of June. The rank limit applies before the shuffle."""
    size = F.abs("prc") * F.col("shrout")
    known = daily.where(F.month("date") == at_month).select(F.year("date").alias("year"), "permno", "date", size.alias("me")).where("me is not null and not isnan(me)")
    last = known.groupBy("year", "permno").agg(F.max(F.struct("date", "me")).alias("m")).select("year", "permno", F.col("m.me").alias("me"))
    by = Window.partitionBy("year").orderBy(F.desc("me"), "permno")
    return last.withColumn("place", F.row_number().over(by)).where(F.col("place") <= n)


def of_universe(daily: DataFrame, universe: DataFrame) -> DataFrame:
    """Daily rows of the stocks in the universe of their own calendar year."""
    return daily.withColumn("year", F.year("date")).join(universe.select("year", "permno"), ["year", "permno"], "left_semi")


def daily_mean(returns: DataFrame) -> DataFrame:
    """date, id, ret: the mean of repeated rows; days without any return are absent."""
    return returns.where("ret is not null and not isnan(ret)").groupBy("date", "id").agg(F.avg("ret").alias("ret"))


def monthly(returns: DataFrame, least: int = 15) -> DataFrame:
    """month, id, ret: compounded over all rows (repeated ones too) of months with at least `least` returns."""
    rows = returns.where("ret is not null and not isnan(ret)")
    return rows.groupBy(month("date").alias("month"), "id").agg((F.product(1 + F.col("ret")) - 1).alias("ret"), F.count("*").alias("n")).where(F.col("n") >= least).select("month", "id", "ret")


def monthly_excess(returns: DataFrame, rate: DataFrame, least: int = 15) -> DataFrame:
    """Compounded returns less the compounded rate of the month; null where the month has no rate. rate: date, rf (one row for each day, broadcast if small)."""
    by_month = rate.groupBy(month("date").alias("month")).agg((F.product(1 + F.col("rf")) - 1).alias("rf"))
    return monthly(returns, least).join(by_month, "month", "left").select("month", "id", (F.col("ret") - F.col("rf")).alias("ret"))


def excess(returns: DataFrame, rate: DataFrame) -> DataFrame:
    """Daily returns less the day's rate; fails where a day has no rate."""
    joined = returns.join(rate, "date", "left")
    have = F.assert_true(F.col("rf").isNotNull(), F.lit("a day has no risk-free rate"))
    return joined.withColumn("checked", have).where("checked is null").select("date", "id", (F.col("ret") - F.col("rf")).alias("ret"))


def equal_weight(monthly_returns: DataFrame) -> DataFrame:
    return monthly_returns.groupBy("month").agg(F.avg("ret").alias("market"))


def on_months(market: DataFrame, months: DataFrame, first_share: float = 0.6) -> DataFrame:
    """The market on the months after the first share of them (months: one row each); null where it has no value."""
    numbered = months.select("month", (F.row_number().over(Window.orderBy("month")) - 1).alias("at"), F.count("*").over(Window.partitionBy()).alias("n"))
    return numbered.where(F.col("at") >= F.floor(F.lit(first_share) * F.col("n"))).select("month").join(market, "month", "left")


def sharpe(series: DataFrame, value: str, periods: int = 12) -> DataFrame:
    """Mean over sample deviation, by the square root of the periods of a year."""
    return series.agg((F.avg(value) / F.stddev_samp(value) * F.sqrt(F.lit(float(periods)))).alias("sharpe"))


def to_trading_days(theta: DataFrame, days: DataFrame) -> DataFrame:
    """Attention on the first trading day at or after its date, averaged; later dates drop.

    A forward as-of join: dates and trading days, both one row a day, are merged in one
    sorted pass over the calendar; the result is joined back by date.
    """
    marks = theta.select("date").distinct().select("date", F.lit(None).cast("date").alias("trade")).unionByName(days.select("date", F.col("date").alias("trade")))
    ahead = Window.orderBy("date").rowsBetween(0, Window.unboundedFollowing)
    # A calendar has a row for each day, whatever the size of the facts: one task is enough for it.
    calendar = marks.groupBy("date").agg(F.max("trade").alias("trade")).select("date", F.first("trade", ignorenulls=True).over(ahead).alias("trade"))
    return theta.join(calendar.where("trade is not null"), "date").groupBy(F.col("trade").alias("date"), "topic").agg(F.avg("theta").alias("theta"))


def shocks(theta: DataFrame, window: int = 5) -> DataFrame:
    """date, topic, z: attention less its mean over the `window` rows before; only full windows, and only days on which every topic has one."""
    before = Window.partitionBy("topic").orderBy("date").rowsBetween(-window, -1)
    z = theta.select("date", "topic", F.when(F.count("theta").over(before) == window, F.col("theta") - F.avg("theta").over(before)).alias("z"))
    day = Window.partitionBy("date")
    topics = theta.select("topic").distinct().agg(F.count("*").alias("topics"))
    full = z.withColumn("have", F.count("z").over(day)).crossJoin(F.broadcast(topics))
    return full.where("have = topics").select("date", "topic", "z")


def month_starts(days: DataFrame) -> DataFrame:
    return days.groupBy(month("date").alias("month")).agg(F.min("date").alias("first"))


def windows(days: DataFrame, lookback: int = 252, least: int = 120) -> DataFrame:
    """month, date, back: the `lookback` rows of the calendar before each month but the first, the newest with back 0; months with fewer than `least` are left out.

    A range join on row numbers, made an equi-join by listing each window's rows.
    """
    numbered = days.select("date", F.row_number().over(Window.orderBy("date")).alias("at"))  # a calendar: one row a day
    first = numbered.groupBy(month("date").alias("month")).agg(F.min("at").alias("start")).where(F.col("start") > least)
    listed = first.select("month", "start", F.explode(F.sequence(F.greatest(F.lit(1), F.col("start") - lookback), F.col("start") - 1)).alias("at"))
    return listed.join(numbered, "at").select("month", "date", (F.col("start") - 1 - F.col("at")).alias("back"))


#: Numbers of the shocks' matrix (days x topics) sent to the tasks at once; more topics are taken in blocks.
_SHOCKS = 8_000_000
#: Stocks whose returns make one matrix.
_TOGETHER = 64


def covariances(returns: DataFrame, z: DataFrame, halflives: Sequence[int] = (60,), lookback: int = 252, least: int = 120) -> DataFrame:
    """month, id, topic and `cov_h` for each half-life: exponentially weighted covariance of a stock's returns with each topic's shocks.

    Weights are 0.5 ** (back / halflife) over the days a stock has a return; null and NaN
    returns are none, repeated ones of a day are averaged. The calendar is every date of
    `returns` (those without any return too) that has shocks; a stock needs `least`
    returns in a window. An empty table gives no rows.

    Stocks are dealt by id and come in order, so a task holds _TOGETHER of them at a time;
    each window of theirs is one matrix product with the shocks. The calendar and the
    shocks (a row a day, a column a topic) are the only broadcast, in blocks of topics.
    """
    z = cut(z.select("date", "topic", "z"))  # a row for each day and topic, asked for several times
    days = np.array(sorted(r.date for r in returns.select("date").distinct().join(z.select("date").distinct(), "date").where("date is not null").collect()), "datetime64[D]")
    topics = [r.topic for r in z.select("topic").distinct().orderBy("topic").collect()]
    kinds = dict(returns.dtypes)["id"], dict(z.dtypes)["topic"]
    schema = f"month date, id {kinds[0]}, topic {kinds[1]}, " + ", ".join(f"cov_{h} double" for h in halflives)
    usable = F.col("ret").isNotNull() & ~F.isnan("ret")
    once = returns.where(usable & F.col("id").isNotNull()).select("id", "date", F.col("ret").cast("double").alias("ret")).repartition("id").groupBy("id", "date").agg(F.avg("ret").alias("ret"))
    sorted_ = once.sortWithinPartitions("id", "date")
    if not len(days):
        return returns.sparkSession.createDataFrame([], schema)
    wide = max(1, _SHOCKS // max(1, len(days)))
    parts = [_block_covariances(sorted_, z, days, topics[i : i + wide], halflives, lookback, least, schema) for i in range(0, len(topics), wide)]
    return reduce(DataFrame.unionByName, parts)


def _block_covariances(returns: DataFrame, z: DataFrame, days: np.ndarray, topics: list, halflives: Sequence[int], lookback: int, least: int, schema: str) -> DataFrame:
    shock = np.zeros((len(days), len(topics)))
    column = {t: i for i, t in enumerate(topics)}
    for r in z.where(F.col("topic").isin(topics)).select("date", "topic", "z").collect():
        at = int(np.searchsorted(days, np.datetime64(r.date, "D")))
        if at < len(days) and days[at] == np.datetime64(r.date, "D"):
            shock[at, column[r.topic]] = r.z
    month_of = days.astype("datetime64[M]")
    begins = np.flatnonzero(np.concatenate([[False], month_of[1:] != month_of[:-1]]))
    ends = [int(e) for e in begins if min(e, lookback) >= least]
    sent = returns.sparkSession.sparkContext.broadcast(shock)
    arrow_schema = to_arrow_schema(_parse_datatype_string(schema))
    names = arrow_schema.names

    def of(ids: list, r: np.ndarray) -> pa.RecordBatch:
        """Covariances of the stocks in the columns of r (days x stocks, NaN for no return)."""
        shocks_ = sent.value
        have = ~np.isnan(r)
        filled = np.where(have, r, 0.0)
        out: dict[str, list] = {n: [] for n in names}
        for end in ends:
            begin = max(0, end - lookback)
            seen = have[begin:end]
            take = np.flatnonzero(seen.sum(0) >= least)
            if not len(take):
                continue
            seen, held, x = seen[:, take].astype(float), filled[begin:end][:, take], shocks_[begin:end]
            back = np.arange(end - begin)[::-1]
            for h in halflives:
                w = 0.5 ** (back / h)
                total = w @ seen
                mean = (w @ held) / total
                # Deviations from a stock's own mean add up to zero, so the shocks need no centring of their own.
                out[f"cov_{h}"].append(((w[:, None] * (held - seen * mean)).T @ x / total[:, None]).ravel())
            out["month"].append(np.full(len(take) * len(topics), month_of[end]))
            out["id"].append(np.repeat(take, len(topics)))
        if not out["month"]:
            return pa.RecordBatch.from_pylist([], schema=arrow_schema)
        flat = {n: np.concatenate(v) for n, v in out.items() if v}
        many = len(flat["id"]) // len(topics)
        columns = [pa.array(flat["month"].astype("datetime64[D]")), pa.array(ids, arrow_schema.field("id").type).take(pa.array(flat["id"])), pa.array(topics * many, arrow_schema.field("topic").type)]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(flat[f"cov_{h}"]) for h in halflives)], schema=arrow_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        r = np.full((len(days), _TOGETHER), np.nan)
        for batch in batches:
            who = batch.column("id").to_pylist()
            date = batch.column("date").to_numpy(zero_copy_only=False).astype("datetime64[D]")
            at = np.searchsorted(days, date)
            known = (at < len(days)) & (days[np.minimum(at, len(days) - 1)] == date)
            value = batch.column("ret").to_numpy(zero_copy_only=False)
            edges = [0, *(i for i in range(1, len(who)) if who[i] != who[i - 1]), len(who)]
            for a, b in zip(edges, edges[1:], strict=False):
                if b == a:
                    continue
                if not ids or ids[-1] != who[a]:
                    if len(ids) == _TOGETHER:
                        yield of(ids, r)
                        ids = []
                        r[:] = np.nan
                    ids.append(who[a])
                mine = np.arange(a, b)[known[a:b]]
                r[at[mine], len(ids) - 1] = value[mine]
        if ids:
            yield of(ids, r[:, : len(ids)])

    return returns.mapInArrow(run, schema)


def panel(instruments: DataFrame, monthly_returns: DataFrame, value: str = "cov_60", standardize: bool = True) -> DataFrame:
    """m_id, month, id, topic, x, y: instruments with the month's return, scaled by their population deviation over the whole panel. m_id numbers the months with instruments, gaps kept."""
    months = instruments.select("month").distinct().select("month", (F.row_number().over(Window.orderBy("month")) - 1).alias("m_id"))  # one row a month
    rows = instruments.select("month", "id", "topic", F.col(value).alias("x")).join(monthly_returns.where("ret is not null").select("month", "id", F.col("ret").alias("y")), ["month", "id"])
    if standardize:
        scale = rows.groupBy("topic").agg(F.greatest(F.stddev_pop("x"), F.lit(1e-12)).alias("scale"))
        rows = rows.join(F.broadcast(scale), "topic").withColumn("x", F.col("x") / F.col("scale"))
    return rows.join(F.broadcast(months), "month").select("m_id", "month", "id", "topic", "x", "y")


def wide_panel(instruments: DataFrame, monthly_returns: DataFrame, values: Sequence[str]) -> DataFrame:
    """m_id, month, id, y, x (array): one row for each stock and month. Features are ordered by horizon, then topic; the constant is not among them."""
    parts = None
    for k, v in enumerate(values):
        one = panel(instruments, monthly_returns, v).select("m_id", "month", "id", "y", F.struct(F.lit(k).alias("k"), "topic", "x").alias("cell"))
        parts = one if parts is None else parts.unionByName(one)
    packed = parts.groupBy("m_id", "month", "id").agg(F.first("y").alias("y"), F.sort_array(F.collect_list("cell")).alias("cells"))
    return packed.select("m_id", "month", "id", "y", F.transform("cells", lambda c: c["x"]).alias("x"))

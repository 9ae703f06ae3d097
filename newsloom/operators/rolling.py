"""Totals and averages over trailing calendar periods, by block decomposition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_per_day(df: DataFrame, key: str, day: str, value: str, version: str | None) -> DataFrame:
    """One row (key, day, value) for each key and day: the value of the latest version.

    The newest version counts even if its value is null. Of equal versions the largest
    non-null value counts, so repeated rows count once. Rows without key or day are left
    out; NaN is null. Rows are combined before the shuffle, so a key that holds a third
    of all rows arrives as one row for each day.
    """
    number = F.col(value).cast("double")
    rows = df.select(
        F.col(key).alias("key"),
        F.to_date(F.col(day)).alias("day"),
        F.struct(F.col(version).alias("v") if version else F.lit(0).alias("v"), F.when(~F.isnan(number), number).alias("x")).alias("newest"),
    ).where("key is not null and day is not null")
    return rows.groupBy("key", "day").agg(F.max("newest").alias("newest")).select("key", "day", F.col("newest.x").alias("x"))


def rolling_totals(
    df: DataFrame,
    key: str = "permno",
    day: str = "date",
    value: str = "ret",
    version: str | None = "loaded_at",
    spans: Sequence[int] = (7, 30),
    least: float | None = -1.0,
    digits: int = 6,
) -> DataFrame:
    """For each key and each calendar day from its first to its last: total, number and average of `value` over trailing periods.

    Columns: key, day (date), and for each span w `total_w`, `n_w` (values in the period)
    and `avg_w` (total over the calendar days of the period, those without activity
    included). Periods that reach back before a key's first day hold what there is.

    Null, NaN and values below `least` add nothing. An empty table gives no rows. Columns
    of `df` beyond the four named ones play no part, whatever their names.

    Method: the days of a key, made dense, are cut into blocks of w days from its first
    day on. Running sums from each block's start (prefix) and to each block's end
    (suffix) make every trailing total the sum of one suffix and one prefix. All windows
    need the one shuffle by key; a key has at most one row for each calendar day by then.
    """
    by_key = Window.partitionBy("key").orderBy("day")
    x = F.when(F.col("x") >= least, F.col("x")) if least is not None else F.col("x")
    known = latest_per_day(df, key, day, value, version).select("key", "day", x.alias("x"))
    gaps = known.select(
        "key",
        "day",
        "x",
        F.first("day").over(by_key.rowsBetween(Window.unboundedPreceding, 0)).alias("begin"),
        F.coalesce(F.lead("day").over(by_key), F.date_add("day", 1)).alias("next"),
    )
    dense = gaps.select("key", "begin", "x", "day", F.posexplode(F.sequence(F.lit(0), F.datediff("next", "day") - 1)).alias("skip", "_"))
    dense = dense.select(
        "key",
        F.date_add("day", F.col("skip")).alias("day"),
        (F.datediff("day", "begin") + F.col("skip")).alias("age"),
        F.when(F.col("skip") == 0, F.coalesce("x", F.lit(0.0))).otherwise(0.0).alias("x"),
        F.when((F.col("skip") == 0) & F.col("x").isNotNull(), 1).otherwise(0).alias("one"),
    )
    for w in spans:
        block = Window.partitionBy("key", f"block_{w}").orderBy("day")
        dense = dense.withColumn(f"block_{w}", F.floor(F.col("age") / w))
        head, tail = block.rowsBetween(Window.unboundedPreceding, 0), block.rowsBetween(0, Window.unboundedFollowing)
        dense = dense.select(
            "*",
            *(F.sum(c).over(f).alias(f"{n}_{c}_{w}") for n, f in (("head", head), ("tail", tail)) for c in ("x", "one")),
        )
    out = [F.col("key").alias(key), F.col("day")]
    for w in spans:
        # The suffix that starts w-1 days back lies in the block before, unless this day ends its own block.
        crosses = (F.col("age") % w != w - 1) & (F.col("age") >= w)

        def whole(c: str, w: int = w, crosses: F.Column = crosses) -> F.Column:
            return F.col(f"head_{c}_{w}") + F.when(crosses, F.lag(f"tail_{c}_{w}", w - 1).over(by_key)).otherwise(0)

        total = F.round(whole("x"), digits) + F.lit(0.0)
        out += [total.alias(f"total_{w}"), whole("one").cast("bigint").alias(f"n_{w}"), F.round(whole("x") / F.least(F.col("age") + 1, F.lit(w)), digits + 2).alias(f"avg_{w}")]
    return dense.select(*out)


def below(totals: DataFrame, limits: dict[int, float], key: str = "permno") -> DataFrame:
    """Rows (key, day as text, span) where the total over `span` days is below its limit."""
    cases = F.filter(F.array(*(F.when(F.col(f"total_{w}") < limit, F.lit(w)) for w, limit in limits.items())), lambda s: s.isNotNull())
    return totals.select(key, F.date_format("day", "yyyy-MM-dd").alias("day"), F.explode(cases).alias("span"))

"""Filtering, deduplication and sampling of raw news rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: What the CSV reader of the raw files takes for null.
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
SYMBOL = r"^[A-Z][A-Z0-9.\-]{0,7}\z"
DAY = r"^\d{4}-\d{2}-\d{2}\z"


def known(column: str) -> Column:
    """The column, null where it holds a null token."""
    return F.when(~F.col(column).isin(*NULL_TOKENS), F.col(column))


def raw_filter(df: DataFrame, first: str = "2015-01-01", last: str = "2023-12-31", most_chars: int | None = None) -> DataFrame:
    """Rows with a date, a symbol and a body, the date (as text) within [first, last]: row_id, date, title, symbol, url, body.

    `most_chars` cuts the body; by default it stays whole.
    """
    body = known("Article") if most_chars is None else F.substring(known("Article"), 1, most_chars)
    rows = df.select("row_id", F.substring(known("Date"), 1, 10).alias("date"), known("Article_title").alias("title"), known("Stock_symbol").alias("symbol"), known("Url").alias("url"), body.alias("body"))
    return rows.where(F.col("date").rlike(DAY) & F.col("date").between(first, last) & F.col("symbol").rlike(SYMBOL) & F.col("body").isNotNull())


def long_bodies(df: DataFrame, least: int = 400) -> DataFrame:
    """Rows whose body has at least `least` characters."""
    return df.where(F.length("body") >= least)


def greedy_dedupe(df: DataFrame, order: str = "row_id", null_url_is_key: bool = True) -> DataFrame:
    """Rows kept when going through them in `order`, keeping a row if neither its URL nor its date and title was seen in a row kept before.

    Works in rounds over keys only: a row that comes first among the undecided rows of
    both its groups is kept, and all rows that share a group with it are decided. Each
    round is two aggregations with map-side combine and is cut to a checkpoint, so a group
    that holds a third of all rows meets no single task. The bodies join once, at the end.
    """
    url = F.coalesce(F.md5(F.coalesce("url", F.lit(""))))
    keys = df.select(F.col(order).alias("o"), (url if null_url_is_key else F.when(F.col("url").isNotNull(), url).otherwise(F.md5(F.concat(F.lit("\x00"), F.col(order).cast("string"))))).alias("u"), F.md5(F.concat(F.col("date"), F.lit("|"), F.coalesce("title", F.lit("")))).alias("t"))
    left, kept = cut(keys), None
    while left.limit(1).count():
        by_u = left.groupBy("u").agg(F.min("o").alias("first_u"))
        by_t = left.groupBy("t").agg(F.min("o").alias("first_t"))
        now = cut(left.join(by_u, "u").join(by_t, "t").where("o = first_u and o = first_t").select("o", "u", "t"))
        kept = now if kept is None else kept.unionByName(now)
        left = cut(left.join(now.select("u"), "u", "left_anti").join(now.select("t"), "t", "left_anti").select("o", "u", "t"))
    return df.limit(0) if kept is None else df.join(kept.select(F.col("o").alias(order)), order, "left_semi")


def day_sample(df: DataFrame, most: int = 120, seed: str = "corpus-v1", day: str = "date", key: str = "row_id") -> DataFrame:
    """At most `most` rows of each day, those with the smallest seeded hash; ties by id. The rank limit applies before the shuffle."""
    hashed = df.withColumn("sample_key", F.md5(F.concat(F.lit(seed), F.coalesce("url", F.lit("")), F.lit("#"), F.col(key).cast("string"))))
    ranked = hashed.withColumn("place", F.row_number().over(Window.partitionBy(day).orderBy("sample_key", key)))
    return ranked.where(F.col("place") <= most).drop("place")


def seeded_sample(df: DataFrame, n: int, seed: str = "vocab-v1", key: str = "row_id") -> DataFrame:
    """n rows with the smallest seeded hash of their id."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def whole_text(df: DataFrame) -> DataFrame:
    """row_id, date and text: title, a full stop, body."""
    return df.select("row_id", "date", F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("body", F.lit(""))).alias("text"))

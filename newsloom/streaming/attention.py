"""Daily attention over a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily(events: DataFrame, time: str, topic: str, weight: str, late: str = "1 day") -> DataFrame:
    """date, topic, weight, n: totals by event day; rows later than `late` after the newest are dropped. Works on a stream or a table."""
    days = events.withWatermark(time, late) if events.isStreaming else events
    sums = days.groupBy(F.window(time, "1 day").alias("day"), F.col(topic).alias("topic")).agg(F.sum(weight).alias("weight"), F.count("*").alias("n"))
    return sums.select(F.to_date("day.start").alias("date"), "topic", "weight", "n")

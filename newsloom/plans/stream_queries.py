"""Daily event totals, from a stream run to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, table
from ..streaming import attention


def _events(df: DataFrame) -> DataFrame:
    return df.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")


def daily_events(spark: SparkSession, folder: str) -> DataFrame:
    """The totals as a finished stream gives them: files are read as they come, the result table is the stream's sink."""
    schema = table(spark, folder, "events").schema
    # A file source reads folders: the pattern names the one file or all its parts.
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/events.parquet*")
    name = f"daily_{uuid.uuid4().hex}"
    # The sink in memory holds one row for each day and type.
    run = attention.daily(_events(stream), "ts", "event_type", "value").writeStream.outputMode("complete").format("memory").queryName(name)
    query = run.option("checkpointLocation", f"{shared_folder(spark)}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).select("date", "topic", F.round("weight", 6).alias("weight"), "n")


def daily_events_batch(spark: SparkSession, folder: str) -> DataFrame:
    return attention.daily(_events(table(spark, folder, "events")), "ts", "event_type", "value").select("date", "topic", F.round("weight", 6).alias("weight"), "n")


QUERIES = {f.__name__: f for f in (daily_events, daily_events_batch)}
_SQL = "select cast(ts as date) as date, event_type as topic, round(sum(value), 6) as weight, count(*) as n from events group by 1, 2"
ORACLE = {"daily_events": _SQL, "daily_events_batch": _SQL}

"""Readers: byte ranges of quoted CSV, return files, zipped factor files, wide attention tables."""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..operators.malformed import FIELDS, load_records

#: How a record of the raw news file begins: its number, then its date.
RECORD = re.compile(rb"\n(?:\d+(?:\.0)?|\"\")?,\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2} UTC,")


class _Range(InputPartition):
    def __init__(self, start: int, end: int) -> None:
        self.start, self.end = start, end


class _RangeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.parts = int(options.get("parts", "8"))
        self.size = os.path.getsize(self.path)

    def partitions(self) -> list[InputPartition]:
        step = max(1, -(-self.size // self.parts))
        return [_Range(a, min(self.size, a + step)) for a in range(0, self.size, step)] or [_Range(0, 0)]

    def read(self, part: _Range) -> Iterator[tuple]:
        """Records that begin within the range, each whole, as one string. A record that runs past the range's end is read on."""
        with open(self.path, "rb") as f:
            f.seek(max(0, part.start - 1))
            # The first range skips the header; the others begin at the first record mark.
            held, at, done = b"", max(0, part.start - 1), False
            if part.start == 0:
                at = len(f.readline()) - 1
                f.seek(at)
            begin = None
            while not done:
                block = f.read(1 << 20)
                held += block
                while True:
                    m = RECORD.search(held, 0 if begin is None else 1)
                    # A mark may go on in the next block; the last bytes wait for it.
                    if not m or (block and m.end() > len(held) - 1):
                        break
                    if begin is not None:
                        yield begin, held[1 : m.start()].rstrip(b"\r").decode("utf-8", "replace")
                    place = at + m.start() + 1
                    held, at = held[m.start() :], at + m.start()
                    begin = place
                    if place >= part.end and part.end < self.size or (begin >= part.end):
                        begin, done = None, True
                        break
                if not block:
                    if begin is not None and held[1:].strip():
                        yield begin, held[1:].rstrip(b"\r\n").decode("utf-8", "replace")
                    done = True
                elif begin is None and not done:
                    keep = min(len(held), 64)
                    at += len(held) - keep
                    held = held[len(held) - keep :]


class RangeCsv(DataSource):
    """`spark.read.format("range_csv").option("path", file).option("parts", n)`: (start bigint, raw string) of a quoted CSV file whose records may hold line breaks. Ranges realign at the mark a record begins with, so no record is lost or read twice."""

    @classmethod
    def name(cls) -> str:
        return "range_csv"

    def schema(self) -> str:
        return "start bigint, raw string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _RangeReader(self.options)


def news_csv(spark: SparkSession, path: str, parts: int = 8) -> DataFrame:
    """Every record of a raw news file with its fields and the reason if it doesn't load."""
    spark.dataSource.register(RangeCsv)
    raw = spark.read.format("range_csv").option("path", path).option("parts", str(parts)).load()
    return load_records(raw, "start", "raw", FIELDS)


def complete(spark: SparkSession, path: str, records: DataFrame, slack: int = 1 << 20) -> bool:
    """Whether the records read reach the end of the file but for `slack` bytes."""
    last = records.agg(F.max("start")).first()[0]
    return last is not None and last >= os.path.getsize(path) - slack


def news_shards(spark: SparkSession, path: str, columns: tuple[str, ...] = ("row_id", "Date", "Article_title", "Stock_symbol", "Url", "Article")) -> DataFrame:
    """Named columns of Parquet shards; only those are read."""
    return spark.read.parquet(path).select(*columns)


def daily_returns(spark: SparkSession, path: str) -> DataFrame:
    """date, id, ret from CSV or Parquet: the id is the first of id, permno, ticker, tick, in any case; what is no number is null."""
    raw = spark.read.parquet(path) if Path(path).suffix == ".parquet" else spark.read.csv(path, header=True)
    by = {c.lower(): c for c in raw.columns}
    key = next((by[k] for k in ("id", "permno", "ticker", "tick") if k in by), None)
    if key is None or not {"date", "ret"} <= set(by):
        raise ValueError(f"no id, date or ret among {raw.columns}")
    number = F.expr(f"try_cast(`{by['ret']}` as double)")
    return raw.select(F.expr(f"try_cast(`{by['date']}` as date)").alias("date"), F.col(key).alias("id"), F.when(~F.isnan(number), number).alias("ret"))


def factor_rates(spark: SparkSession, path: str, skip: int = 4) -> DataFrame:
    """date, rf from a zipped factor file: the first CSV in it, `skip` lines before its header, dates as yyyymmdd, rates in percent; other lines are left out. The file has a line for each day and is read by the driver."""
    with zipfile.ZipFile(path) as z:
        text = z.read(next(n for n in z.namelist() if n.lower().endswith(".csv"))).decode("latin-1")
    lines = io.StringIO(text).read().splitlines()[skip - 1 :]
    header = [h.strip() for h in lines[0].split(",")]
    at = header.index("RF")
    rows = []
    for line in lines[1:]:
        cells = [c.strip() for c in line.split(",")]
        if len(cells) > at and re.fullmatch(r"\d{8}", cells[0]):
            rows.append((cells[0], cells[at]))
    df = spark.createDataFrame(rows, "d string, r string")
    return df.select(F.expr("to_date(try_to_timestamp(d, 'yyyyMMdd'))").alias("date"), (F.expr("try_cast(r as double)") / 100).alias("rf")).where("date is not null and rf is not null")


def attention(spark: SparkSession, path: str) -> DataFrame:
    """date, topic, theta from a wide table: topics are numbered by column position."""
    wide = spark.read.parquet(path)
    names = [c for c in wide.columns if c != "date"]
    numbered = wide.select("date", *(F.col(f"`{c}`").cast("double").alias(str(i)) for i, c in enumerate(names)))
    long = numbered.unpivot("date", [str(i) for i in range(len(names))], "topic", "theta")
    return long.select("date", F.col("topic").cast("int").alias("topic"), "theta")


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query run by a database; give partitionColumn, lowerBound, upperBound and numPartitions to read it in parallel."""
    return spark.read.format("jdbc").options(url=url, **({"query": query} if "partitionColumn" not in options else {"dbtable": f"({query}) q"}), **options).load()

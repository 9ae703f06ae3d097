"""Writers: Parquet tables, wide attention, small reports, atomic JSON, manifests."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shards(df: DataFrame, path: str, *partition_by: str) -> None:
    """A zstd Parquet table, replaced as a whole."""
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def corpus(df: DataFrame, path: str) -> None:
    """The sampled corpus in order of date, then of sample key."""
    shards(df.repartitionByRange("date").sortWithinPartitions("date", "sample_key"), path)


def attention(df: DataFrame, path: str, topics: int) -> None:
    """Wide attention: date and a column for each topic."""
    shards(df.groupBy("date").pivot("topic", list(range(topics))).agg(F.first("theta")).orderBy("date"), path)


def report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A small table as one CSV, JSON or Markdown file. Only for reports: it is collected."""
    rows = df.toPandas()
    if kind == "md":
        lines = ["| " + " | ".join(map(str, r)) + " |" for r in [rows.columns, ["---"] * len(rows.columns), *rows.itertuples(index=False)]]
        text = "\n".join(lines) + "\n"
    else:
        text = rows.to_csv(index=False) if kind == "csv" else rows.to_json(orient="records")
    _replace(path, text)


def _replace(path: str, text: str) -> None:
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=target.parent, delete=False) as f:
        f.write(text)
    os.replace(f.name, target)


def atomic_json(path: str, payload: Any) -> None:
    """JSON with sorted keys, put in place at once."""
    _replace(path, json.dumps(payload, sort_keys=True, indent=2, default=str))


def fingerprint(params: dict[str, Any], *inputs: str) -> str:
    """What a stored result depends on: parameters, and path, size and time of its input files."""
    files = sorted(str(p) for i in inputs for p in ([Path(i)] if Path(i).is_file() else Path(i).rglob("*")) if p.is_file())
    stamps = [(f, os.path.getsize(f), os.stat(f).st_mtime_ns) for f in files]
    return hashlib.sha256(json.dumps([params, stamps], sort_keys=True, default=str).encode()).hexdigest()


def cached(spark: SparkSession, path: str, key: str, make: Callable[[], DataFrame], on_change: str = "remake") -> DataFrame:
    """The table at `path` if its manifest has the key; else it is made and written. `on_change='raise'` refuses to replace a result of another key."""
    manifest = Path(f"{path}.manifest.json")
    if manifest.exists():
        if json.loads(manifest.read_text())["key"] == key:
            return spark.read.parquet(path)
        if on_change == "raise":
            raise ValueError(f"{path} was made from other inputs or parameters")
        manifest.unlink()  # else a run that dies while writing would leave the old key with new data
    shards(make(), path)
    atomic_json(str(manifest), {"key": key})
    return spark.read.parquet(path)

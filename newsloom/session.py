"""Session building and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Runtime settings every entry point relies on.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build(master: str = "local[*]", name: str = "newsloom", **conf: str) -> SparkSession:
    """A session with the settings of DEFAULTS; conf overrides them (dots written as `__`)."""
    builder = SparkSession.builder.master(master).appName(name)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Makes this package importable on the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="newsloom-")) / "newsloom.zip"
        with zipfile.ZipFile(path, "w") as archive:
            for f in sorted(root.rglob("*.py")):
                archive.write(f, os.path.relpath(f, root.parent))
        context.addPyFile(str(path))
        _shipped.add(context.applicationId)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`. Only a local session without that setting (tests, a laptop) gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="newsloom-")


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """`df` with its lineage cut by a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager)


def table(spark: SparkSession, folder: str, name: str, spread: bool = False) -> DataFrame:
    """A table of a data folder. `spread` deals the rows of a table that is scanned by fewer tasks than half the cores (one small file, say) over all of them; larger tables are left as they lie."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df.rdd.getNumPartitions() * 2 <= cores else df


def stamp(df: DataFrame) -> tuple:
    """Path, length and time of every file a table is read from, by the file system it lies on."""
    spark = df.sparkSession
    conf, path_of = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    out = []
    for name in sorted(df.inputFiles()):
        path = path_of(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        out.append((name, status.getLen(), status.getModificationTime()))
    return tuple(out)

"""Connected components of edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def union(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of the component of each of n nodes, given edges between them: hooking and pointer jumping over whole arrays."""
    root = np.arange(n)
    a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
    while len(a):
        x, y = root[a], root[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        if not len(a):
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges to the smallest node of each component within a batch."""
    for batch in batches:
        a, b = (np.asarray(c) for c in batch.columns)
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = union(len(nodes), at[: len(a)], at[len(a) :])
        child = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[child]), pa.array(nodes[root[child]])], names=["a", "b"])


#: Edges (16 bytes each) up to which one task joins them.
ONE_TASK = 1_000_000


def _whole_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    return _forest(iter(pa.Table.from_batches(held).combine_chunks().to_batches()) if held else iter(()))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b: bigint): root is the smallest node of its component.

    Up to ONE_TASK edges, once joined within each task, are joined by one task. Beyond, it
    alternates large-star and small-star rounds, each one join and cut to a checkpoint,
    until every edge is a star's; the number of rounds grows with the logarithm of the
    number of nodes. Nothing is collected. An empty table gives no rows.
    """
    now = cut(edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).where("a <> b").mapInArrow(_forest, "a bigint, b bigint").distinct())
    after = None
    if now.count() <= ONE_TASK:
        after = cut(now.coalesce(1).mapInArrow(_whole_forest, "a bigint, b bigint"))
    while after is None:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        fresh = cut(small.where("a <> b").distinct())
        # Stars only: no node is both a leaf and a centre, and no leaf has two centres.
        leaves = fresh.groupBy("a").agg(F.count("*").alias("n"))
        if not fresh.join(fresh.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count() and not leaves.where("n > 1").limit(1).count():
            after = fresh
        now = fresh
    roots = after.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(after.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

"""Coherence, diversity and agreement of topic models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def npmi(tops: DataFrame, counts: DataFrame, n_docs: int) -> DataFrame:
    """topic, npmi: mean over all pairs of a topic's terms, pairs that never meet included.

    Only documents' rows of the terms in question are joined; the term list is small (topics x terms).
    """
    words = tops.select("topic", "term_id")
    pairs = words.alias("a").join(words.alias("b"), (F.col("a.topic") == F.col("b.topic")) & (F.col("a.term_id") < F.col("b.term_id"))).select(F.col("a.topic").alias("topic"), F.col("a.term_id").alias("i"), F.col("b.term_id").alias("j"))
    present = counts.where("tf > 0").join(F.broadcast(words.select("term_id").distinct()), "term_id", "left_semi").select("row_id", "term_id")
    df = present.groupBy("term_id").agg(F.count("*").alias("df"))
    # Terms of a document are paired within their topics only: at most the pairs asked for.
    held = present.join(F.broadcast(words), "term_id").groupBy("row_id", "topic").agg(F.collect_set("term_id").alias("terms"))
    within = held.select(F.explode("terms").alias("i"), "terms", "topic").select("topic", "i", F.explode("terms").alias("j")).where("i < j")
    met = within.groupBy("topic", "i", "j").agg(F.count("*").alias("co"))
    full = pairs.join(met, ["topic", "i", "j"], "left").join(df.select(F.col("term_id").alias("i"), F.col("df").alias("di")), "i", "left").join(df.select(F.col("term_id").alias("j"), F.col("df").alias("dj")), "j", "left")
    p = F.coalesce("co", F.lit(0)) / F.lit(float(n_docs)) + 1e-12
    pi, pj = (F.coalesce(c, F.lit(0)) / F.lit(float(n_docs)) + 1e-12 for c in ("di", "dj"))
    return full.select("topic", (F.ln(p / (pi * pj)) / -F.ln(p)).alias("v")).groupBy("topic").agg(F.avg("v").alias("npmi"))


def diversity(tops: DataFrame) -> DataFrame:
    """diversity: distinct terms over all top terms."""
    return tops.agg((F.count_distinct("term_id") / F.count("*")).alias("diversity"))


def cosines(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b, cosine of the term distributions of every pair of topics of two models, from one pass over the terms."""
    x, y = a.select(F.col("topic").alias("a"), "term_id", F.col("p").alias("x")), b.select(F.col("topic").alias("b"), "term_id", F.col("p").alias("y"))
    norms = [d.groupBy(k).agg(F.greatest(F.sqrt(F.sum(F.col(v) * F.col(v))), F.lit(1e-12)).alias(f"n{k}")) for d, k, v in ((x, "a", "x"), (y, "b", "y"))]
    inner = x.join(y, "term_id").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    return inner.join(norms[0], "a").join(norms[1], "b").select("a", "b", (F.col("s") / (F.col("na") * F.col("nb"))).alias("cosine"))


def assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row in the assignment of least total cost, by shortest augmenting paths (rows <= columns)."""
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for row in range(1, n + 1):
        owner[0], at = row, 0
        least, way, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[at]:
            done[at] = True
            i = owner[at]
            free = ~done[1:]
            slack = cost[i - 1] - u[i] - v[1:]
            better = free & (slack < least[1:])
            least[1:][better] = slack[better]
            way[1:][better] = at
            to = int(np.where(free, least[1:], np.inf).argmin()) + 1
            step = least[to]
            u[owner[done]] += step
            v[done] -= step
            least[~done] -= step
            at = to
        while at:
            owner[at], at = owner[way[at]], way[at]
    out = np.empty(n, int)
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def matching(pairs: DataFrame) -> DataFrame:
    """a, b, cosine of the one-to-one matching with the highest total cosine. The topics x topics matrix is solved on the driver."""
    rows = pairs.toPandas()
    grid = rows.pivot(index="a", columns="b", values="cosine").fillna(0.0)
    to = assignment(-grid.to_numpy())
    out = [(int(grid.index[i]), int(grid.columns[j]), float(grid.iat[i, j])) for i, j in enumerate(to)]
    return pairs.sparkSession.createDataFrame(out, "a int, b int, cosine double")


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """topic, n, largest and mean absolute difference and correlation of two attention tables (date, topic, theta)."""
    both = a.select("date", "topic", F.col("theta").alias("x")).join(b.select("date", "topic", F.col("theta").alias("y")), ["date", "topic"])
    gap = F.abs(F.col("x") - F.col("y"))
    return both.groupBy("topic").agg(F.count("*").alias("n"), F.max(gap).alias("max_gap"), F.avg(gap).alias("mean_gap"), F.corr("x", "y").alias("r"))


def summary(scores: DataFrame, arm: str, value: str) -> DataFrame:
    """n, mean, median and sample deviation of a score for each arm."""
    return scores.groupBy(arm).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.stddev_samp(value).alias("sd"))

"""Topic weights of documents, term weights of topics, and their daily means."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector over its length; the one-element array makes the length once, not for each place."""
    return F.element_at(F.transform(F.array(F.sqrt(dot(v, v))), lambda n: F.transform(v, lambda x: x.cast("double") / n)), 1)


def sound(v: Column, dims: int = 64) -> Column:
    """Whether a vector has `dims` finite values, not all zero."""
    return v.isNotNull() & (F.size(v) == dims) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)


def mean_centroids(df: DataFrame, vector: str, label: str, dims: int = 64) -> DataFrame:
    """topic, centroid (array of double): unit mean vector of each label; tasks add up whole vectors."""
    schema = "topic int, n bigint, total array<double>"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            if b.num_rows:
                topic, x = np.asarray(b.column(0)), b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                for t in np.unique(topic).tolist():
                    held = sums.setdefault(t, [0, np.zeros(dims)])
                    held[0] += int((topic == t).sum())
                    held[1] += x[topic == t].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([v.tolist() for _, v in sums.values()], pa.list_(pa.float64()))], names=["topic", "n", "total"])

    def mean(rows: pa.Table) -> pa.Table:
        total = np.sum(rows.column("total").to_pylist(), axis=0)
        norm = np.linalg.norm(total)
        return pa.table({"topic": rows.column("topic")[:1], "centroid": pa.array([(total / norm if norm else total).tolist()], pa.list_(pa.float64()))})

    rows = df.where(sound(F.col(vector), dims)).select(F.col(label).cast("int"), F.col(vector).cast("array<double>")).where(F.col(label).isNotNull())
    return rows.mapInArrow(partial, schema).groupBy("topic").applyInArrow(mean, "topic int, centroid array<double>")


def checked_centroids(topics: Sequence[int], rows: Sequence[Sequence[float]], dims: int | None = None) -> np.ndarray:
    """Unit centroids, also ones made before: of equal length, finite and not zero."""
    sizes = {len(r) for r in rows}
    if not rows or len(sizes) != 1 or dims not in (None, *sizes):
        raise ValueError(f"centroids must have one length ({dims or 'any'}), got {sorted(sizes)}")
    if len(set(topics)) != len(topics):
        raise ValueError("a topic has two centroids")
    x = np.array(rows, float)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    if not np.isfinite(norm).all() or (norm == 0).any():
        raise ValueError("centroids must be finite and not zero")
    return x / norm


def _matrix(centroids: DataFrame) -> tuple[list[int], np.ndarray]:
    """Topics and their centroids, in order; topics x dims numbers, whatever the data."""
    rows = centroids.orderBy("topic").collect()
    topics = [r.topic for r in rows]
    return topics, checked_centroids(topics, [r.centroid for r in rows])


def _cosines(batch: pa.RecordBatch, centres: np.ndarray) -> np.ndarray:
    v = batch.column("v").cast(pa.list_(pa.float64()))
    x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
    return (x @ centres.T) / np.linalg.norm(x, axis=1, keepdims=True)


def soft_assign(passages: DataFrame, centroids: DataFrame, temperature: float = 0.07) -> DataFrame:
    """id, doc, w and `p`, each passage's share of every topic: softmax of cosine / temperature, one matrix product for each batch."""
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    _, centres = _matrix(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = _cosines(b, centres) / temperature
                e = np.exp(s - s.max(1, keepdims=True))
                p = pa.FixedSizeListArray.from_arrays(pa.array((e / e.sum(1, keepdims=True)).ravel()), len(centres)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("doc"), b.column("w"), p], names=["id", "doc", "w", "p"])

    return passages.select("id", "doc", "w", "v").mapInArrow(run, "id bigint, doc bigint, w double, p array<double>")


def document_weights(docs: DataFrame, assigned: DataFrame, topics: Sequence[int]) -> DataFrame:
    """doc, topic, theta: weighted sum of passage shares, normalised; documents without passages get equal shares."""
    n = len(topics)
    sums = assigned.groupBy("doc").agg(*(F.sum(F.col("w") * F.col("p")[i]).alias(f"t{i}") for i in range(n)))
    whole = sum((F.col(f"t{i}") for i in range(1, n)), F.col("t0"))
    shares = F.array(*(F.struct(F.lit(t).alias("topic"), F.coalesce(F.col(f"t{i}") / whole, F.lit(1.0 / n)).alias("theta")) for i, t in enumerate(topics)))
    return docs.select("doc").join(sums, "doc", "left").select("doc", F.inline(shares))


def hard_topic(theta: DataFrame) -> DataFrame:
    """doc, topic: the largest share, the smallest topic of equals."""
    return theta.groupBy("doc").agg(F.max_by("topic", F.struct("theta", -F.col("topic"))).alias("topic"))


def sparsify(theta: DataFrame, keep: int = 2, power: float = 2.0, confidence_power: float = 1.0, quantile: float = 0.5) -> DataFrame:
    """doc, topic, weight: the `keep` largest shares to `power`, normalised, times the margin between the first two to `confidence_power`; documents whose margin is below the quantile get 0."""
    if keep < 1 or power <= 0 or confidence_power < 0 or not 0 <= quantile <= 1:
        raise ValueError("keep and power must be positive, confidence_power not negative, quantile within [0, 1]")
    by = Window.partitionBy("doc")
    ranked = theta.withColumn("place", F.row_number().over(by.orderBy(F.desc("theta"), "topic")))
    top = F.when(F.col("place") <= keep, F.pow("theta", F.lit(power))).otherwise(0.0)
    first, second = (F.max(F.when(F.col("place") == k, F.col("theta"))).over(by) for k in (1, 2))
    marked = ranked.select("doc", "topic", "place", (top / F.sum(top).over(by)).alias("share"), F.round(first - F.coalesce(second, F.lit(0.0)), 12).alias("margin"))
    cutoff = marked.where("place = 1").agg(F.round(F.percentile("margin", F.lit(quantile)), 12).alias("cutoff"))
    joined = marked.crossJoin(F.broadcast(cutoff))
    return joined.select("doc", "topic", F.when(F.col("margin") >= F.col("cutoff"), F.col("share") * F.pow("margin", F.lit(confidence_power))).otherwise(0.0).alias("weight"))


def _none_negative(df: DataFrame, value: str) -> DataFrame:
    """The same rows; a negative or NaN value fails the query when it is met."""
    good = F.assert_true((F.col(value) >= 0) & ~F.isnan(value), F.lit(f"{value} must not be negative"))
    return df.withColumn(value, F.when(good.isNull(), F.col(value)))


def ctfidf(counts: DataFrame, members: DataFrame, terms: DataFrame, topics: Sequence[int], smooth: float = 1.0, sublinear: bool = False) -> DataFrame:
    """topic, term_id, p: class-based tf-idf, every topic a distribution over the whole vocabulary.

    counts: row_id, term_id, tf; members: doc, topic, weight. The weights of a document lie
    in one row, so the join with the counts does not grow by the number of topics.
    """
    if smooth <= 0:
        raise ValueError("smooth must be positive")
    members = _none_negative(members, "weight")
    wide = members.groupBy("doc").pivot("topic", list(topics)).agg(F.sum("weight"))
    weights = wide.select(F.col("doc").alias("row_id"), *(F.coalesce(F.col(f"`{t}`"), F.lit(0.0)).alias(f"w{i}") for i, t in enumerate(topics)))
    g = 1.0 + F.ln("tf") if sublinear else F.col("tf").cast("double")
    sums = counts.join(weights, "row_id").groupBy("term_id").agg(*(F.sum(g * F.col(f"w{i}")).alias(f"s{i}") for i in range(len(topics))))
    cells = F.array(*(F.struct(F.lit(t).alias("topic"), (F.coalesce(f"s{i}", F.lit(0.0)) + smooth).alias("tf")) for i, t in enumerate(topics)))
    dense = terms.select("term_id").join(sums, "term_id", "left").select("term_id", F.inline(cells))
    by_topic = Window.partitionBy("topic")
    average = dense.agg((F.sum("tf") / len(topics)).alias("average"))
    column = dense.groupBy("term_id").agg(F.sum("tf").alias("column"))
    raw = dense.join(column, "term_id").crossJoin(F.broadcast(average)).select("topic", "term_id", (F.col("tf") * F.log1p(F.col("average") / F.col("column"))).alias("w"))
    return raw.select("topic", "term_id", (F.col("w") / F.sum("w").over(by_topic)).alias("p"))


def daily_attention(theta: DataFrame, docs: DataFrame) -> DataFrame:
    """date, topic, theta: mean of the documents' shares weighted by max(n_tokens, 1). docs: doc, date, n_tokens."""
    w = F.greatest(F.col("n_tokens").cast("double"), F.lit(1.0))
    return theta.join(docs, "doc").groupBy("date", "topic").agg((F.sum(w * F.col("theta")) / F.sum(w)).alias("theta"))


def top_terms(phi: DataFrame, vocab: DataFrame, n: int = 10) -> DataFrame:
    """topic, place, term_id, term, p: the n most likely terms of each topic, the smaller id of equals first."""
    by = Window.partitionBy("topic").orderBy(F.desc(F.round("p", 12)), "term_id")
    return phi.withColumn("place", F.row_number().over(by)).where(F.col("place") <= n).join(F.broadcast(vocab.select("term_id", "term")), "term_id").select("topic", "place", "term_id", "term", "p")


def labels(tops: DataFrame, n: int = 3) -> DataFrame:
    """topic, label: the n most likely terms, joined by slashes."""
    few = tops.where(F.col("place") <= n).groupBy("topic").agg(F.sort_array(F.collect_list(F.struct("place", "term"))).alias("t"))
    return few.select("topic", F.array_join(F.transform("t", lambda x: x["term"]), " / ").alias("label"))


def representatives(passages: DataFrame, centroids: DataFrame, n: int = 50) -> DataFrame:
    """topic, place, id, cosine: the n passages nearest to each centroid. Only n rows of each topic leave a batch."""
    topics, centres = _matrix(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near, ids = np.round(_cosines(b, centres), 9), np.asarray(b.column("id"))
                order = [np.lexsort((ids, -near[:, j]))[:n] for j in range(len(topics))]
                pick = np.concatenate(order)
                which = np.repeat(np.arange(len(topics)), [len(o) for o in order])
                yield pa.RecordBatch.from_arrays([pa.array(np.array(topics)[which], pa.int32()), pa.array(ids[pick]), pa.array(near[pick, which])], names=["topic", "id", "cosine"])

    scored = passages.select("id", "v").mapInArrow(run, "topic int, id bigint, cosine double")
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("cosine"), "id"))).where(F.col("place") <= n).select("topic", "place", "id", "cosine")


def contract(theta: DataFrame, phi: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """check, broken: number of rows that break each rule of the attention model (shares not negative, rows on the simplex)."""
    negative = theta.where(F.col("theta") < -1e-6).agg(F.count("*").alias("broken")).select(F.lit("theta_negative").alias("check"), "broken")

    def sums(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
        off = df.groupBy(key).agg(F.sum(value).alias("s")).where(F.abs(F.col("s") - 1) > tolerance)
        return off.agg(F.count("*").alias("broken")).select(F.lit(name).alias("check"), "broken")

    return negative.unionByName(sums(theta, "date", "theta", "theta_simplex")).unionByName(sums(phi, "topic", "p", "phi_simplex"))


WEIGHTINGS = ("soft", "hard", "sparse")


def fit_topics(passages: DataFrame, docs: DataFrame, counts: DataFrame, vocab: DataFrame, centroids: DataFrame, weighting: str = "soft", temperature: float = 0.07, sublinear: bool = False, meta: dict | None = None) -> dict:
    """Everything the topic layer makes of passage vectors and term counts, in one call.

    passages: id, doc, w, v; docs: doc, date, n_tokens; counts: row_id, term_id, tf; vocab:
    term_id, term; centroids: topic, centroid (new or made before). Gives the tables
    `theta` (documents), `attention` (days), `phi`, `tops`, `labels`, the rows of broken
    rules `contract`, and `meta`: what it was made with, and for sparse weights the share
    of documents that keep any.
    """
    if weighting not in WEIGHTINGS:
        raise ValueError(f"weighting must be one of {WEIGHTINGS}")
    names = [r.topic for r in centroids.select("topic").distinct().orderBy("topic").collect()]
    theta = cut(document_weights(docs, soft_assign(passages.where("doc is not null and w is not null"), centroids, temperature), names))
    rounded = theta.withColumn("theta", F.round("theta", 9))
    said = {"topics": len(names), "temperature": temperature, "weighting": weighting, "sublinear": sublinear, **(meta or {})}
    if weighting == "soft":
        members = theta.withColumnRenamed("theta", "weight")
    elif weighting == "hard":
        members = hard_topic(rounded).withColumn("weight", F.lit(1.0))
    else:
        members = cut(sparsify(rounded))
        kept = members.groupBy("doc").agg(F.max("weight").alias("w")).agg(F.avg((F.col("w") > 0).cast("double")).alias("share")).first()
        said["documents_kept"] = kept.share
    phi = cut(ctfidf(counts, members, vocab, names, sublinear=sublinear))
    attention = daily_attention(theta, docs)
    tops = top_terms(phi, vocab)
    return {"theta": theta, "attention": attention, "phi": phi, "tops": tops, "labels": labels(tops), "contract": contract(attention, phi), "meta": said}

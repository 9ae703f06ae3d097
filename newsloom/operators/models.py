"""Topic and cluster models from Spark ML, and the model-free passage encoder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hashed_features
from ..session import cut
from . import em_lda
from .topics import unit


def kmeans(vectors: DataFrame, k: int, measure: str = "cosine", seed: int = 7, passes: int = 25) -> DataFrame:
    """topic, size, weight, objective, centroid of k-means over (id, w, v): 'cosine' on unit vectors, or 'euclidean'; weighted; parallel oversampled seeding.

    `size` counts members, `weight` adds up their weights, `objective` is their weighted
    mean cosine with the centroid. Fewer vectors than clusters are an error.
    """
    if k < 1:
        raise ValueError("k must be positive")
    rows = vectors.where("w is not null and w > 0").select("id", "w", array_to_vector(unit(F.col("v"))).alias("features"))
    if rows.limit(k).count() < k:
        raise ValueError("fewer vectors than clusters")
    model = KMeans(k=k, distanceMeasure=measure, seed=seed, maxIter=passes, weightCol="w", initMode="k-means||").fit(rows)
    centres = vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "topic int, centroid array<double>")
    given = model.transform(rows).select(F.col("prediction").alias("topic"), "w", vector_to_array("features").alias("v"))
    cosine = F.aggregate(F.zip_with("v", "centroid", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) / F.sqrt(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x * x))
    sizes = given.join(F.broadcast(centres), "topic").groupBy("topic").agg(F.count("*").alias("size"), F.sum("w").alias("weight"), (F.sum(F.col("w") * cosine) / F.sum("w")).alias("objective"))
    return centres.join(sizes, "topic", "left").select("topic", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("weight", F.lit(0.0)).alias("weight"), "objective", "centroid")


def lda(counts: DataFrame, terms: int, k: int, optimizer: str = "online", seed: int = 7, passes: int = 20) -> tuple[DataFrame, DataFrame]:
    """Topic-term table (topic, term_id, p) and document table (row_id, topic, theta), both distributions. 'em' is `em_lda.fit`, 'online' Spark ML's."""
    if optimizer == "em":
        cells = counts.where("tf > 0").groupBy("row_id").agg(F.collect_list(F.struct(F.col("term_id").cast("int").alias("id"), F.col("tf").cast("int").alias("tf"))).alias("cells"))
        return em_lda.fit(cells.select("row_id", F.col("cells.id").alias("ids"), F.col("cells.tf").alias("tfs")), terms, k, seed, passes)

    def vector(cells: list) -> SparseVector:
        return SparseVector(terms, sorted((c.term_id, float(c.tf)) for c in cells))

    packed = counts.groupBy("row_id").agg(F.collect_list(F.struct("term_id", "tf")).alias("cells"))
    rows = cut(packed.select("row_id", F.udf(vector, VectorUDT())("cells").alias("features")))
    model = LDA(k=k, optimizer=optimizer, seed=seed, maxIter=passes, featuresCol="features").fit(rows)
    weights = model.topicsMatrix().toArray()
    weights = weights / weights.sum(0)
    phi = counts.sparkSession.createDataFrame([(j, i, float(weights[i, j])) for j in range(k) for i in range(terms)], "topic int, term_id int, p double")
    shares = cut(model.transform(rows).select("row_id", vector_to_array("topicDistribution").alias("t")))
    total = F.aggregate("t", F.lit(0.0), lambda s, x: s + x)
    even = F.transform("t", lambda x: F.when(total > 0, x / total).otherwise(1.0 / k))
    return phi, shares.select("row_id", F.posexplode(even).alias("topic", "theta"))


def encode(passages: DataFrame, dims: int = 64) -> DataFrame:
    """row_id, piece, weight, v: passages as unit vectors of hashed weighted words (no model is at hand; any encoder with the same columns fits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = pa.array(hashed_features(b.column(3), dims).ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.FixedSizeListArray.from_arrays(flat, dims).cast(pa.list_(pa.float64()))], names=["row_id", "piece", "weight", "v"])

    return passages.select("row_id", "piece", "weight", "chunk").mapInArrow(run, "row_id bigint, piece int, weight double, v array<double>")

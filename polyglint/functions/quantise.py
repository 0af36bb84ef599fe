"""Quantisation of weights: six-bit integers and product quantisation."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: the largest magnitude of a six-bit weight.
TOP = 31


def scales(weights: np.ndarray, per_row: bool) -> np.ndarray:
    """TOP over the largest magnitude, of each row or of all; 1 where all is zero."""
    most = np.abs(weights).max(axis=-1, initial=0) if per_row else np.abs(weights).max(initial=0)
    return np.where(most > 0, TOP / np.where(most > 0, most, 1), 1.0)


def quantise(weights: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(weights * (scale[:, None] if np.ndim(scale) else scale)), -TOP, TOP).astype(np.int8)


def pack6(values: np.ndarray) -> bytes:
    """Four values in three bytes, high bits first; what is missing in the last four is dropped bytewise."""
    bits = np.unpackbits((np.asarray(values, np.int16) + TOP).astype(np.uint8)[:, None], axis=1)[:, 2:]
    return np.packbits(bits.ravel()).tobytes()


def unpack6(data: bytes, count: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8))[: 6 * count].reshape(count, 6)
    return (bits @ (1 << np.arange(5, -1, -1))).astype(np.int16) - TOP


def int6_rows(weights: DataFrame) -> DataFrame:
    """weights (grp, lang_idx, idx, w) with the row's scale and q, as columns."""
    most = F.max(F.abs("w")).over(Window.partitionBy("grp", "lang_idx"))
    scale = F.when(most > 0, F.lit(float(TOP)) / most).otherwise(F.lit(1.0))
    return weights.withColumn("scale", scale).withColumn("q", F.greatest(F.lit(-TOP), F.least(F.lit(TOP), F.rint(F.col("w") * F.col("scale")))).cast("int"))


def subvectors(weights: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled by their largest magnitude and cut into pieces of d, padded with zeros; and 1 / magnitude by row."""
    inverse = scales(weights, True) / TOP
    wide = np.zeros((len(weights), -(-weights.shape[1] // d) * d))
    wide[:, : weights.shape[1]] = weights * inverse[:, None]
    return wide.reshape(-1, d), inverse


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] + (centroids * centroids).sum(axis=1) - 2 * x @ centroids.T


def pq_fit(spark: SparkSession, weights: np.ndarray, k: int = 256, d: int = 4, seed: int = 0, restarts: int = 4, rounds: int = 100) -> np.ndarray:
    """The codebook (k, d) of least cost over some restarts of k-means; where pieces or clusters are fewer than k, they repeat."""
    x, _ = subvectors(weights, d)
    if len(x) <= k:
        return np.resize(x, (k, d))
    rows = spark.createDataFrame([(v,) for v in x.tolist()], "v array<double>").select(array_to_vector("v").alias("features")).persist()
    fits = [KMeans(k=k, seed=seed + r, maxIter=rounds, initMode="k-means||").fit(rows) for r in range(restarts)]
    rows.unpersist()
    best = min(fits, key=lambda f: f.summary.trainingCost)
    return np.resize(np.array(best.clusterCenters()), (k, d))


def pq_assign(weights: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each piece (rows, pieces), and the rows' scales."""
    x, inverse = subvectors(weights, codebook.shape[1])
    return distances(x, codebook).argmin(axis=1).reshape(len(weights), -1), inverse


def pq_decode(codebook: np.ndarray, indices: np.ndarray, inverse: np.ndarray, columns: int) -> np.ndarray:
    return codebook[indices].reshape(len(indices), -1)[:, :columns] / inverse[:, None]


def pq_snap(weights: np.ndarray, codebook: np.ndarray) -> np.ndarray:
    return pq_decode(codebook, *pq_assign(weights, codebook), weights.shape[1])


def assign(points: DataFrame, centroids: DataFrame, key: str, vector: str = "v") -> DataFrame:
    """points with centroid_id and dist: the nearest of a bounded codebook (centroid_id, c); ties go to the lower id."""
    book = F.broadcast(centroids.agg(F.sort_array(F.collect_list(F.struct("centroid_id", "c"))).alias("book")))
    gap = lambda c: F.aggregate(F.zip_with(vector, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    all_ = F.transform("book", lambda b: F.struct(gap(b["c"]).alias("dist"), b["centroid_id"].alias("centroid_id")))
    return points.crossJoin(book).select(key, vector, F.array_min(all_).alias("best")).select(key, vector, "best.centroid_id", F.col("best.dist").alias("dist"))


def lloyd(points: DataFrame, centroids: DataFrame, key: str, vector: str = "v") -> DataFrame:
    """(centroid_id, c, n, mse): one round of k-means. A centroid moves to the mean of its n points; the empty ones, in order,
    move to the points that are served worst (ties: the lower key). mse: the points' mean squared distance before the move."""
    found = assign(points, centroids, key, vector)
    means = found.select("centroid_id", F.posexplode(vector).alias("i", "x")).groupBy("centroid_id", "i").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    means = means.groupBy("centroid_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"), F.max("n").alias("n"))
    # both sides are bounded by the size of the codebook
    empty = centroids.select("centroid_id").join(means, "centroid_id", "left_anti").withColumn("turn", F.row_number().over(Window.orderBy("centroid_id")))
    many = centroids.count()
    worst = found.orderBy(F.desc("dist"), key).limit(many).withColumn("turn", F.row_number().over(Window.orderBy(F.desc("dist"), key)))
    moved = empty.join(worst.select("turn", F.col(vector).alias("c")), "turn").select("centroid_id", "c", F.lit(0).cast("long").alias("n"))
    return means.unionByName(moved).crossJoin(F.broadcast(found.agg(F.avg("dist").alias("mse"))))

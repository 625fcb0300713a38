"""Centroid clustering over integer vectors; nearest centroids by partial-distance search."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder

DIMENSIONS, CENTROIDS, ROUNDS, SCALE = 64, 8, 10, 1024
#: Integers beyond this size are set to it, so that a squared distance always fits into 64 bits. Components below 131,072 are exact.
MOST = 2**27
#: Dimensions that are added up between two looks at which centroids are still in the running.
STEP = 8
LONGEST = 2**63 - 1


def whole_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """Rows (vec_id, vec) of the vectors with exactly `dimensions` components, none null or non-finite; each component x becomes floor(scale * x), x as double."""
    x = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    good = (F.size("embedding") == dimensions) & F.forall(x, lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False)))
    whole = F.transform(x, lambda v: F.greatest(F.least(F.floor(F.greatest(F.least(v * scale, F.lit(4.0 * MOST)), F.lit(-4.0 * MOST))), F.lit(MOST)), F.lit(-MOST)).cast("int"))
    return vectors.where(F.coalesce(good, F.lit(False))).select("vec_id", whole.alias("vec"))


def nearest(vectors: np.ndarray, centroids: np.ndarray, order: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each row; of equally near ones the smallest number.

    Squared differences are added up dimension by dimension in the order given. A vector leaves a centroid as soon as its sum is strictly
    above its best distance so far; those that stay to the end have their whole distance.
    """
    ordered, points = np.ascontiguousarray(vectors[:, order].T), centroids[:, order]
    best = np.full(len(vectors), LONGEST, np.int64)
    cluster = np.zeros(len(vectors), np.int32)
    for c, point in enumerate(points):
        rows, total = np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
        for at in range(0, len(order), step):
            for d in range(at, min(at + step, len(order))):
                gap = (ordered[d] if len(rows) == len(vectors) else ordered[d][rows]) - point[d]
                total += gap * gap
            stay = total <= best[rows]
            if not stay.all():
                rows, total = rows[stay], total[stay]
        closer = total < best[rows]
        best[rows[closer]], cluster[rows[closer]] = total[closer], c
    return cluster, best


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(batch.num_rows, -1)


def _sums(centroids: np.ndarray, order: np.ndarray):
    """Rows (cluster, dim, total) of what a task has seen; dim -1 counts its vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], int] = {}
        for batch in batches:
            if batch.num_rows:
                vectors = _matrix(batch)
                cluster, _ = nearest(vectors, centroids, order)
                for c in np.unique(cluster).tolist():
                    own = vectors[cluster == c]
                    for dim, total in [(-1, len(own)), *enumerate(own.sum(0).tolist())]:
                        totals[c, dim] = totals.get((c, dim), 0) + total
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in totals], pa.int32()), pa.array([d for _, d in totals], pa.int32()), pa.array(list(totals.values()), pa.int64())], ["cluster", "dim", "total"])

    return run


def _assigned(centroids: np.ndarray, order: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, distance = nearest(_matrix(batch), centroids, order)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def by_variance(vectors: DataFrame, dimensions: int) -> np.ndarray:
    """Dimensions by falling variance, over all vectors. It decides how soon centroids are abandoned, never the result."""
    each = vectors.select(F.posexplode("vec").alias("dim", "x")).groupBy("dim").agg(F.var_pop(F.col("x").cast("double")).alias("v"))
    spread = {r["dim"]: r["v"] for r in each.collect()}
    return np.array(sorted(range(dimensions), key=lambda d: (-spread.get(d, 0.0), d)))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of seed:vec_id; equal ids (a null one counts as an empty text) go by their components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return np.array([r["vec"] for r in vectors.orderBy(key, "vec").select("vec").limit(k).collect()], np.int64)


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 3, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """Rows (vec_id, cluster, distance, cluster_inertia, inertia, centroid) of all vectors that whole_vectors keeps, repeated ones too.

    Each round assigns every vector to its nearest centroid and moves each non-empty centroid to the floored mean of its vectors, in whole numbers.
    A round reads the integer vectors, which are written once, and shuffles one row a task, cluster and dimension; the driver holds the
    k * dimensions components of the centroids and nothing else. Rounds end early when no centroid moved, as all further ones would be the same.
    Null, short, long or non-finite vectors give no row; with fewer than k vectors there are as many centroids as vectors; an empty table gives no rows.
    Inertias beyond 64 bits come out as the largest long.
    """
    spark = vectors.sparkSession
    folder = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    whole_vectors(vectors, dimensions, scale).write.parquet(folder)
    kept = spark.read.parquet(folder)
    centroids, order = first_centroids(kept, k, seed), by_variance(kept, dimensions)
    for _ in range(rounds if len(centroids) else 0):
        sums = kept.select("vec").mapInArrow(_sums(centroids, order), "cluster int, dim int, total long")
        totals = {(r["cluster"], r["dim"]): int(r["total"]) for r in sums.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
        moved = np.array([[totals[c, d] // totals[c, -1] for d in range(dimensions)] if (c, -1) in totals else old.tolist() for c, old in enumerate(centroids)], np.int64)
        if (moved == centroids).all():
            break
        centroids = moved
    kind = kept.schema["vec_id"].dataType.simpleString()
    found = kept.mapInArrow(_assigned(centroids.reshape(-1, dimensions), order), f"vec_id {kind}, cluster int, distance long")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    per = {r["cluster"]: int(r["own"]) for r in sums.collect()}
    rows = [(c, min(per.get(c, 0), LONGEST), min(sum(per.values()), LONGEST), point) for c, point in enumerate(centroids.tolist())]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def digest(centroid) -> F.Column:
    """SHA-256 of a centroid's components in decimal, joined by commas."""
    return F.sha2(F.array_join(F.transform(centroid, lambda x: x.cast("string")), ",").cast("binary"), 256)

"""Centroid clustering against plain Python whole numbers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriloom.llm import clustering


def plain(rows, k, rounds, seed, scale=1024):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(centroids)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = sum(d for *_, d in found)
    return sorted(((i, n, d, sum(x for _, m, x in found if m == n), inertia, centroids[n]) for i, n, d in found), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string, distance int, vec array<int>, inertia double")


def found(spark, rows, **kw):
    df = clustering.cluster(frame(spark, [(i, v, "x", 1, [1], 0.5) for i, v in rows]), **kw)
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid) for r in df.collect()), key=str)


def vectors(n, dims, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (5, dims))
    return [(i, [float(np.float32(x)) for x in centres[i % 5] + rng.normal(0, 0.4, dims)]) for i in range(n)]


def test_equals_whole_numbers_in_plain_python(spark):
    rows = vectors(240, 6)
    rows += [(7, rows[7][1])] * 60 + [(None, rows[3][1]), (500, [-0.0001] * 6), (501, [0.0] * 6)]  # a hot vector, repeated rows, a null id, floors below zero
    assert found(spark, rows, k=4, rounds=5, dimensions=6) == plain(rows, 4, 5, 3)


def test_bad_vectors_are_left_out_and_few_vectors_do(spark):
    good = vectors(3, 6)
    bad = [(10, None), (11, []), (12, [1.0] * 5), (13, [1.0] * 7), (14, [1.0] * 5 + [None]), (15, [1.0] * 5 + [float("nan")]), (16, [float("-inf")] + [1.0] * 5)]
    assert found(spark, good + bad, k=8, rounds=3, dimensions=6) == plain(good, 8, 3, 3)
    assert found(spark, bad, dimensions=6) == []
    assert found(spark, [], dimensions=6) == []


def test_an_empty_cluster_stays(spark):
    rows = [(i, [1.0] * 6) for i in range(9)] + [(20, [5.0] * 6)]
    assert found(spark, rows, k=8, rounds=4, dimensions=6) == plain(rows, 8, 4, 3)


def test_components_beyond_the_bound_are_set_to_it(spark):
    rows = clustering.whole_vectors(frame(spark, [(1, [3e38, -3e38, 131071.0, -131072.5, 0.0, 1.5], "", 0, [], 0.0)]), 6).collect()
    assert rows[0].vec == [2**27, -(2**27), 131071 * 1024, -(2**27), 0, 1536]
    assert len(found(spark, [(1, [3e38] * 64), (2, [-3e38] * 64)], k=1)) == 2


@pytest.mark.parametrize("step", [1, 3, 8, 64])
def test_partial_distances_lose_no_nearest_centroid(step):
    rng = np.random.default_rng(step)
    rows, points = rng.integers(-40, 40, (500, 20)), rng.integers(-40, 40, (9, 20))
    points[4] = points[2]
    rows[:50] = points[rng.integers(0, 9, 50)]
    whole = ((rows[:, None, :] - points[None]) ** 2).sum(2)
    cluster, distance = clustering.nearest(rows, points, rng.permutation(20), step)
    assert (distance == whole.min(1)).all() and (cluster == whole.argmin(1)).all()


def test_dimensions_by_variance_and_digest(spark):
    rows = spark.createDataFrame([([0, 5, 1],), ([0, -5, 2],)], "vec array<int>")
    assert clustering.by_variance(rows, 3).tolist() == [1, 2, 0]
    one = spark.createDataFrame([([1, -2],)], "c array<long>").select(clustering.digest(F.col("c")).alias("h")).first()
    assert one.h == hashlib.sha256(b"1,-2").hexdigest()

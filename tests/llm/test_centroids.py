"""Centroid clustering against plain integer k-means."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ranksmith.llm import centroids as C


def brute(rows, k, rounds, seed):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((r for r in kept if r[0] is not None), key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    own = [v for _, v in first]

    def assign():
        out = []
        for i, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in own]
            out.append((i, d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        at = assign()
        for c in range(len(own)):
            mine = [v for (_, v), (_, a, _) in zip(kept, at) if a == c]
            if mine:
                own[c] = [sum(col) // len(mine) for col in zip(*mine)]
    at = assign()
    sums = {}
    for _, c, d in at:
        sums[c] = sums.get(c, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in own]
    return sorted((str(i), c, d, sums[c], sum(sums.values()), sha[c]) for i, c, d in at)


def rows_of(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_transform_is_exact_and_ordered():
    rng = np.random.default_rng(1)
    x = rng.integers(-1000, 1000, (50, 64))
    y = C.transform(x)
    assert ((y * y).sum(axis=1) == 64 * (x * x).sum(axis=1)).all()
    assert (y[:, 0] == x.sum(axis=1)).all()
    basis = C.transform(np.eye(64, dtype=np.int64))
    assert (basis @ basis.T == 64 * np.eye(64)).all()
    changes = (np.diff(basis.T, axis=1) != 0).sum(axis=1)
    assert (changes == np.arange(64)).all()  # coarse to fine


@pytest.mark.parametrize("scale", [3, 300, 1 << 22, 1 << 50])
def test_nearest_with_ties(scale):
    rng = np.random.default_rng(2)
    own = rng.integers(-scale, scale + 1, (40, 64))
    own[7], own[30] = own[3], own[12]  # equal centroids: the smaller number
    x = np.concatenate([rng.integers(-scale, scale + 1, (60, 64)), own])
    k, d = C.nearest(x, own)
    full = ((x[:, None].astype(object) - own[None].astype(object)) ** 2).sum(axis=2)
    assert k.tolist() == [list(r).index(min(r)) for r in full]
    assert d.tolist() == [min(min(r), C.LARGEST) for r in full]


def test_clusters_by_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(9, 64))
    rows = [(i, [float(np.float32(v)) for v in base[i % 9] + 0.3 * rng.normal(size=64)]) for i in range(160)]
    one = rows[3]
    rows += [one, one, (None, rows[5][1]), (900, None), (901, [1.0] * 63), (902, [1.0] * 63 + [float("nan")]), (903, [1.0] * 63 + [float("inf")]),
             (904, [1.0] * 63 + [None]), (3, rows[8][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"cluster": F.lit("x"), "v": F.lit(1), "distance": F.lit(2)})
    got = C.cluster(df.repartition(5))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert rows_of(got) == brute(rows, C.CENTROIDS, C.ROUNDS, C.SEED)
    assert rows_of(C.cluster(df, k=3, rounds=2, seed=8)) == brute(rows, 3, 2, 8)


def test_few_equal_and_no_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    same = [(i, [0.5] * 64) for i in range(5)]
    assert rows_of(C.cluster(spark.createDataFrame(same, schema))) == brute(same, 40, 5, 2)
    assert C.cluster(spark.createDataFrame([], schema)).count() == 0
    assert C.cluster(spark.createDataFrame([(1, None), (2, [1.0])], schema)).count() == 0
    huge = [(i, [(-1.0) ** i * 1e38] * 64) for i in range(4)]
    got = C.cluster(spark.createDataFrame(huge, schema)).collect()
    assert len(got) == 4 and all(0 <= r.distance <= C.LARGEST for r in got)

"""Centroid clustering: Walsh-Hadamard progressive search.

Vectors become integers, ``floor(256 * x)`` a component.  The Walsh-Hadamard
transform of integers is exact and keeps squared distances up to the factor
64, and sorted by sign changes (coarse to fine) its first coefficients hold
most of a difference.  So a vector is held against all centroids on the first
few coefficients only; the likeliest centroid's full distance is then a bound,
and centroids whose sum of squared differences is already above it are
strictly worse and go, step by step, until the rest have all 64 coefficients.
The nearest one's distance is exact, ties go to the smaller number.

Each round is one pass over the vectors in Spark tasks, which add up their
clusters' components; at most centroids x components sums reach the driver.

Defined results: vectors that are null, hold a null or a number that is not
finite, or have another length than 64 take no part and get no row; repeated
rows each get one; vectors without id get one but never start a cluster, and
of equal ids that start one the lesser vector comes first; fewer vectors than
centroids make fewer clusters, an empty table an empty result.  Components are
held within +-2**62, and distances and sums above the range of a long are its
largest number.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranksmith.session import ship_package

from .common import staged

DIM = 64
CENTROIDS, ROUNDS, SEED = 40, 5, 2
#: Coefficients known after each step of the search.
STEPS = (4, 8, 16, 32, DIM)
#: Up to this size of a component every sum of the search fits a long.
EXACT_LONG = 1 << 21
LARGEST = (1 << 63) - 1
_ROWS = 4096


def _sequency_order() -> np.ndarray:
    """Rows of the Hadamard matrix in the order of their sign changes."""
    i = np.arange(DIM)
    bits = i[:, None] & i[None, :]
    odd = sum((bits >> b) & 1 for b in range(DIM.bit_length())) & 1
    return np.argsort((odd[:, 1:] != odd[:, :-1]).sum(axis=1), kind="stable")


_ORDER = _sequency_order()


def integers(x: np.ndarray) -> np.ndarray:
    """``floor(256 * x)`` of finite doubles."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(256 * x), -2.0 ** 62, 2.0 ** 62).astype(np.int64)


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of the rows of ``x``, coarse to fine."""
    step = 1
    while step < DIM:
        pairs = x.reshape(len(x), DIM // (2 * step), 2, step)
        a, b = pairs[:, :, 0], pairs[:, :, 1]
        x = np.stack([a + b, a - b], axis=2).reshape(len(x), DIM)
        step *= 2
    return x[:, _ORDER]


def _squares(d: np.ndarray) -> np.ndarray:
    return (d * d).sum(axis=-1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid; rows and
    centroids are integers."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) > EXACT_LONG:
        x, centroids = x.astype(object), centroids.astype(object)
    X, C = transform(x), transform(centroids)
    first = STEPS[0]
    sums = _squares(X[:, None, :first] - C[None, :, :first])
    bound = _squares(X - C[sums.argmin(axis=1)])
    row, k = np.nonzero(sums <= bound[:, None])
    sums = sums[row, k]
    for lo, hi in zip(STEPS, STEPS[1:]):
        sums = sums + _squares(X[row, lo:hi] - C[k, lo:hi])
        left = sums <= bound[row]
        row, k, sums = row[left], k[left], sums[left]
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    least = np.minimum.reduceat(sums, starts)
    hit = np.flatnonzero(sums == least[row])
    _, at = np.unique(row[hit], return_index=True)
    return k[hit[at]], np.minimum(least // DIM, LARGEST).astype(np.int64)


def _matrix(col: pa.Array) -> np.ndarray:
    return integers(col.flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM))


def whole_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v = F.col(f"`{embedding}`").cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (df.where(v.isNotNull() & (F.size(v) == DIM)).where(sound)
            .select(F.col(f"`{vec_id}`").alias("vec_id"), v.alias("v")))


def starts(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The integers of the ``k`` vectors with the smallest hash of their id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where("vec_id is not null").orderBy(digest, "v").limit(k).collect()  # k rows
    return integers(np.array([r.v for r in rows], np.float64).reshape(-1, DIM))


def _sums(vectors: DataFrame, centroids: np.ndarray) -> list:
    """(cluster, place, total, n) over all vectors: a row for each component
    of each centroid that is nearest to some vector."""
    def run(batches):
        n = np.zeros(len(centroids), np.int64)
        total = np.zeros(centroids.shape, object)
        for batch in batches:
            for lo in range(0, len(batch), _ROWS):
                x = _matrix(batch.column(0).slice(lo, _ROWS))
                k, _ = nearest(x, centroids)
                n += np.bincount(k, minlength=len(n))
                wide = np.abs(x).max() > EXACT_LONG
                for c in np.unique(k):
                    own = x[k == c]
                    total[c] += own.astype(object).sum(axis=0) if wide else own.sum(axis=0).astype(object)
        at = np.repeat(np.flatnonzero(n), DIM)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), pa.array(np.tile(np.arange(DIM), len(at) // DIM), pa.int32()),
             pa.array([Decimal(int(t)) for t in total[n > 0].ravel()], pa.decimal128(38, 0)), pa.array(n[at])],
            names=["cluster", "place", "total", "n"])

    return (vectors.select("v").mapInArrow(run, "cluster int, place int, total decimal(38,0), n long")
            .groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect())


def fit(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Final centroids: ``rounds`` times, every vector goes to its nearest one
    and every centroid that has vectors becomes the floor of their mean."""
    ship_package(vectors.sparkSession)
    centroids = starts(vectors, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        moved = centroids.copy()
        for r in _sums(vectors, centroids):
            moved[r.cluster, r.place] = int(r.total) // r.n
        centroids = moved
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    ship_package(vectors.sparkSession)
    if not len(centroids):
        return vectors.where("false").select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), _ROWS):
                part = batch.slice(lo, _ROWS)
                k, distance = nearest(_matrix(part.column(1)), centroids)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(k, pa.int32()), pa.array(distance)],
                                                 names=["vec_id", "cluster", "distance"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def cluster(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = CENTROIDS,
            rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """One row per vector: vec_id, cluster, distance, cluster_inertia, inertia
    and centroid_sha256.  The vectors' clusters are written once; the sums, a
    row a cluster, and the centroids come back as constants."""
    vectors = whole_vectors(df, vec_id, embedding)
    centroids = fit(vectors, k, rounds, seed)
    found = staged(assign(vectors, centroids), "clusters")
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    own = [min(sums.get(c, 0), LARGEST) for c in range(len(centroids))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def of(values: list, kind: str) -> Column:
        return F.get(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("cluster"))

    return found.select("vec_id", "cluster", "distance", of(own, "bigint").alias("cluster_inertia"),
                        F.lit(min(sum(sums.values()), LARGEST)).cast("long").alias("inertia"), of(digests, "string").alias("centroid_sha256"))

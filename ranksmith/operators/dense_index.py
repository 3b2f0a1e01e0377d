"""Exact dense search that skips blocks by an angle bound.

Centroids come from a bounded sample of each scope's vectors; every vector goes
to its nearest centroid's cluster, and a cluster is cut into rings by the angle
to the centroid.  A ring knows its widest angle and its least and largest norm,
so that for a query at angle ``a`` to the centroid no vector of the ring is
nearer than ``a - widest`` nor farther than ``a + widest``: both bound the inner
products of the whole ring.

Top-k: a query first visits its most promising rings until they hold ``k``
vectors; the k-th best score is its threshold, and of the other rings it visits
those whose bound reaches it.  Full ranks: a ring whose upper bound stays below
the gold's score holds nothing better, one whose lower bound is above it is
counted as it stands, and only the rings between are scored.  Either result
equals the scan of all vectors.

Rings larger than a block are dealt to several by id.  Thresholds come from a
visit of each query's best blocks, a row each; after that the blocks pass by the
queries (``dense._scan``), which skip those whose bounds tell, so that a query
is not repeated for the blocks it looks at.  Centroids and rings (``MAX_CLUSTERS`` x ``RINGS`` a scope) are broadcast;
with more than ``MAX_SCOPES`` scopes the plain scan is the better plan and is
what ``dense`` takes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package, staged

#: Vectors of a scope that its centroids are learnt from, at most.
SAMPLE_ROWS = 4096
MAX_CLUSTERS, MAX_SCOPES = 256, 1024
RINGS = 4
LLOYD_ROUNDS = 4
#: Vectors of a block, and visiting queries that one task takes.
BLOCK_ROWS = 16_384
PART_QUERIES = 16_384
#: Clusters of a scope from which blocks grow, up to BLOCK_ROWS, rather than
#: their number: every query may have to visit every block.
MANY_CLUSTERS = 32
#: (query, block) bounds that routing holds at a time, and rows that it gives at a time.
ROUTE_BOUNDS, ROUTE_ROWS = 1 << 20, 8192
#: Far above the error of an arc cosine and of sums in another order.
ANGLE_SLACK, SCORE_SLACK = 1e-6, 1e-8


@dataclass
class ClusterIndex:
    vectors: DataFrame  # scope..., _block, _id, _vec
    rings: dict         # scope values -> Rings, as Spark broadcast
    scope: tuple[str, ...]
    n_rows: dict        # scope values -> number of vectors


class Rings:
    """One scope's centroids (unit length), and of each block its centroid,
    number of vectors, widest angle, least and largest norm."""

    def __init__(self, centroids: np.ndarray):
        norm = np.linalg.norm(centroids, axis=1, keepdims=True)
        self.centroids = np.divide(centroids, norm, out=np.zeros_like(centroids), where=norm > 0)
        self.blocks: list[int] = []
        self.stats: list[tuple] = []

    def ready(self) -> None:
        self.block = np.array(self.blocks, np.int64)
        cluster, n, wide, low, high = zip(*self.stats)
        self.cluster, self.n = np.array(cluster, np.int64), np.array(n, np.int64)
        self.wide, self.low, self.high = (np.array(x, np.float64) for x in (wide, low, high))

    def angles(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Norms, and [vector, centroid]: angles."""
        norm = np.linalg.norm(vectors, axis=1)
        unit = np.divide(vectors, norm[:, None], out=np.zeros_like(vectors), where=norm[:, None] > 0)
        return norm, np.arccos(np.clip(unit @ self.centroids.T, -1.0, 1.0))

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[query, block]: most and least that an inner product can be."""
        norm, angle = self.angles(queries)
        angle = angle[:, self.cluster]
        near = np.cos(np.maximum(angle - self.wide - ANGLE_SLACK, 0.0))
        far = np.cos(np.minimum(angle + self.wide + ANGLE_SLACK, np.pi))
        most = norm[:, None] * np.where(near >= 0, near * self.high, near * self.low)
        least = norm[:, None] * np.where(far >= 0, far * self.low, far * self.high)
        return most, least


def _matrix(col) -> np.ndarray:
    rows = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _centroids(sample: pa.Table, k: int) -> np.ndarray:
    order = np.argsort(sample["_h"].to_numpy(), kind="stable")
    x = _matrix(sample["_vec"])[order]
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    c = x[:k].copy()
    for _ in range(LLOYD_ROUNDS):
        own = (x @ c.T).argmax(axis=1)
        for i in range(len(c)):
            if (own == i).any():
                c[i] = x[own == i].mean(axis=0)
    return c


def _by_scope(batch: pa.RecordBatch, scope: Sequence[str]):
    """(scope values, row numbers) of a batch."""
    if not scope:
        yield (), np.arange(len(batch))
        return
    rows: dict[tuple, list[int]] = {}
    for i, values in enumerate(zip(*(batch.column(c).to_pylist() for c in scope))):
        rows.setdefault(values, []).append(i)
    yield from ((s, np.array(at)) for s, at in rows.items())


def cluster_index(corpus: DataFrame, pid: str = "pid", pvec: str = "pvec", scope: Sequence[str] = (),
                  block_rows: int = BLOCK_ROWS) -> ClusterIndex | None:
    """Index of all vectors of ``corpus`` (rows without id, vector or scope
    take no part), or None if there are none or too many scopes.  Blocks have
    about ``block_rows`` vectors, more in a scope of many."""
    spark, sc = corpus.sparkSession, list(scope)
    ship_package(spark)
    p = staged(corpus.select(*sc, F.col(pid).alias("_id"), F.col(pvec).alias("_vec")).na.drop(), "vectors")
    counts = p.groupBy(*sc).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_vec")).alias("_dim"))
    sizes = counts.limit(MAX_SCOPES + 1).collect()
    if not sizes or len(sizes) > MAX_SCOPES or not sum(r.n for r in sizes):
        return None
    rows_of = lambda n: max(block_rows, min(BLOCK_ROWS, n // MANY_CLUSTERS))
    wanted = {tuple(r[c] for c in sc): int(min(max(r.n // rows_of(r.n), 1), MAX_CLUSTERS)) for r in sizes}
    # The smallest hashes: a sample of at most SAMPLE_ROWS a scope, which a
    # window group limit takes without gathering the scope.
    order = Window.partitionBy(*sc).orderBy("_h", "_id") if sc else Window.orderBy("_h", "_id")
    upto = lambda n: F.lit(2.0 * SAMPLE_ROWS) / n * 2.0 ** 63
    near = p.withColumn("_h", F.shiftright(F.xxhash64("_id"), 1) + F.lit(1 << 62))
    near = (near.join(F.broadcast(counts.select(*sc, "n")), sc).filter(F.col("_h") <= upto(F.col("n"))).drop("n") if sc
            else near.filter(F.col("_h") <= upto(F.lit(sizes[0].n))))
    sample = near.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= SAMPLE_ROWS)

    def learn(table: pa.Table) -> pa.Table:
        s = tuple(table[c][0].as_py() for c in sc)
        c = _centroids(table, wanted.get(s, 1))
        return pa.table({**{name: [v] for name, v in zip(sc, s)}, "c": pa.array([c.ravel()], pa.list_(pa.float64())), "k": pa.array([len(c)], pa.int64())})

    kinds = T.StructType([*(corpus.schema[c] for c in sc), T.StructField("c", T.ArrayType(T.DoubleType())), T.StructField("k", T.LongType())])
    learnt = sample.groupBy(*sc).applyInArrow(lambda t: learn(t), kinds).collect()  # a row a scope
    rings = {tuple(r[c] for c in sc): Rings(np.array(r.c).reshape(r.k, -1)) for r in learnt}
    sent = spark.sparkContext.broadcast(rings)

    def assign(batches):
        for batch in batches:
            x = batch.column("_vec")
            cluster, angle, length = np.zeros(len(batch), np.int32), np.zeros(len(batch)), np.zeros(len(batch))
            for s, at in _by_scope(batch, sc):
                norm, a = sent.value[s].angles(_matrix(x.take(pa.array(at))))
                cluster[at], angle[at], length[at] = a.argmin(axis=1), a.min(axis=1), norm
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster), pa.array(angle), pa.array(length)],
                                             names=[*batch.schema.names, "_cluster", "_angle", "_norm"])

    held = T.StructType([*p.schema.fields, T.StructField("_cluster", T.IntegerType()), T.StructField("_angle", T.DoubleType()),
                         T.StructField("_norm", T.DoubleType())])
    assigned = staged(p.mapInArrow(assign, held), "assigned")
    # Cuts and parts are written, a row a ring at most: the blocks are the
    # assigned vectors, not another copy of them.
    cuts = staged(assigned.groupBy(*sc, "_cluster").agg(
        F.percentile_approx("_angle", [i / RINGS for i in range(1, RINGS)], 1000).alias("_cuts")), "cuts")
    ringed = assigned.join(F.broadcast(cuts), [*sc, "_cluster"]).withColumn(
        "_ring", F.size(F.filter("_cuts", lambda c: c < F.col("_angle"))))
    held_rows = F.greatest(F.lit(block_rows), F.least(F.lit(BLOCK_ROWS), F.floor(F.col("n") / MANY_CLUSTERS)))
    in_ring = ringed.groupBy(*sc, "_cluster", "_ring").agg(F.count(F.lit(1)).alias("_in_ring"))
    in_ring = in_ring.join(F.broadcast(counts.select(*sc, "n")), sc) if sc else in_ring.withColumn("n", F.lit(sizes[0].n))
    parts = staged(in_ring.select(*sc, "_cluster", "_ring", F.ceil(F.col("_in_ring") / held_rows).alias("_parts")), "parts")
    block = F.xxhash64("_cluster", "_ring", F.pmod(F.xxhash64("_id"), F.col("_parts")))
    vectors = ringed.join(F.broadcast(parts), [*sc, "_cluster", "_ring"]).withColumn("_block", block)
    stats = vectors.groupBy(*sc, "_block", "_cluster").agg(
        F.count(F.lit(1)).alias("n"), F.max("_angle").alias("wide"), F.min("_norm").alias("low"), F.max("_norm").alias("high"))
    for r in stats.collect():  # a row a block
        own = rings[tuple(r[c] for c in sc)]
        own.blocks.append(r["_block"])
        own.stats.append((r["_cluster"], r.n, r.wide, r.low, r.high))
    for own in rings.values():
        own.ready()
    return ClusterIndex(vectors.select(*sc, "_block", "_id", "_vec"), spark.sparkContext.broadcast(rings), tuple(sc),
                        {tuple(r[c] for c in sc): r.n for r in sizes})


def _routed(queries: DataFrame, index: ClusterIndex, choose, extra: list[T.StructField] = ()) -> DataFrame:
    """(scope..., _id, _vec, extra..., _block, _n): the blocks that ``choose``
    names for each query; without a block, ``_n`` vectors counted unseen.
    ``choose`` maps rings, query vectors and the batch's extra columns to
    (query, block) flags and counts."""
    sc, rings = list(index.scope), index.rings
    names = [*sc, "_id", "_vec", *(f.name for f in extra)]
    schema = T.StructType([*(queries.schema[c] for c in names), T.StructField("_block", T.LongType()), T.StructField("_n", T.LongType())])

    def given(part, row, block, n):
        out = part.select(names).take(pa.array(row))
        return out.append_column("_block", block).append_column("_n", pa.array(n, pa.int64())).combine_chunks().to_batches()

    def run(batches):
        for batch in batches:
            for s, at in _by_scope(batch, sc):
                own = rings.value.get(s)
                if own is None:
                    continue
                step = max(ROUTE_BOUNDS // len(own.block), 1)
                for a in range(0, len(at), step):
                    part = pa.Table.from_batches([batch]).take(pa.array(at[a:a + step]))
                    visited, counted = choose(own, _matrix(part["_vec"]), part)
                    row, block = np.nonzero(visited)
                    for i in range(0, len(row), ROUTE_ROWS):
                        rows = slice(i, i + ROUTE_ROWS)
                        yield from given(part, row[rows], pa.array(own.block[block[rows]]), np.zeros(len(row[rows]), np.int64))
                    if counted is not None:
                        some = np.flatnonzero(counted)
                        yield from given(part, some, pa.nulls(len(some), pa.int64()), counted[some])

    return queries.select(*names).mapInArrow(run, schema)


def _first(rings: Rings, Q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds, and flags of the best blocks that hold ``k`` vectors."""
    most, _ = rings.bounds(Q)
    order = np.argsort(-most, axis=1, kind="stable")
    before = np.cumsum(rings.n[order], axis=1) - rings.n[order]
    first = np.zeros(most.shape, bool)
    np.put_along_axis(first, order, before < k, axis=1)
    return most, first


def scan_blocks(visits: DataFrame, index: ClusterIndex, kernel, fields: list[T.StructField], extra: Sequence[str] = ()) -> DataFrame:
    """``kernel`` (see ``dense._scan``) over every visited (query, block).
    ``visits`` is a written table: it is read for the blocks' loads too."""
    from .dense import _runner
    sc = list(index.scope)
    schema = T.StructType([index.vectors.schema[s] for s in sc] + fields)
    loads = visits.groupBy(*sc, "_block").agg(F.ceil(F.count(F.lit(1)) / PART_QUERIES).alias("_parts"))
    loads = F.broadcast(loads)  # a row a block, as the rings are
    q = visits.join(loads, [*sc, "_block"]).withColumn("_part", F.pmod(F.xxhash64("_id"), F.col("_parts")))
    p = index.vectors.join(loads, [*sc, "_block"]).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    by = [*sc, "_block", "_part"]
    own = lambda side: [F.col(c).alias(f"_{side}{i}") for i, c in enumerate(by)]
    left = q.select(*own("q"), *sc, "_id", "_vec", *extra).groupBy(*[f"_q{i}" for i in range(len(by))])
    right = p.select(*own("p"), "_id", "_vec").groupBy(*[f"_p{i}" for i in range(len(by))])
    return left.cogroup(right).applyInArrow(_runner(sc, kernel, extra, schema), schema)


def topk(queries: DataFrame, index: ClusterIndex, k: int, fields: list[T.StructField], other_than_self: bool,
         block_bytes: int) -> DataFrame:
    """Candidates ``(scope..., qid, pid, score)`` that hold each query's best
    ``k``.  ``queries``: scope..., _id, _vec."""
    from .dense import SCORE_ROUND, _scan, _topk_kernel
    sc, taken = list(index.scope), k + other_than_self
    kernel = _topk_kernel(taken)
    visits = staged(_routed(queries, index, lambda r, Q, _: (_first(r, Q, taken)[1], None)), "first-visits")
    found = staged(scan_blocks(visits, index, kernel, fields), "first-scores")
    others = found.filter(F.col("pid") != F.col("qid")) if other_than_self else found
    best = Window.partitionBy(*sc, "qid").orderBy(F.desc("score"))
    least = (others.withColumn("_i", F.row_number().over(best)).filter(F.col("_i") == k)
             .select(*sc, F.col("qid").alias("_id"), (F.round("score", SCORE_ROUND) - SCORE_SLACK).alias("_least")))
    known = staged(queries.join(least, [*sc, "_id"], "left").withColumn("_least", F.coalesce("_least", F.lit(float("-inf")))), "thresholds")
    # The second scan gives only scores that reach the threshold; which blocks
    # a query looks at is told where they pass by, not a row each.

    def rest(rings, Q, extras):
        most, first = _first(rings, Q, taken)
        return ~first & (most >= extras["_least"][:, None]), None

    return found.unionByName(_scan(known, index.vectors, sc, "_id", "_vec", "_id", "_vec", block_bytes, kernel, fields, ["_least"],
                                   index, rest))


def visit_report(queries: DataFrame, index: ClusterIndex, k: int, other_than_self: bool = False) -> DataFrame:
    """(scope..., n_pairs, n_first): pairs of query and block, and those that
    give the thresholds; what ``topk`` visits beyond them depends on the scores."""
    def count(rings, Q, part):
        return np.zeros((len(Q), len(rings.n)), bool), np.full(len(Q), len(rings.n))

    sc = list(index.scope)
    none = F.lit(0).cast("long")
    pairs = _routed(queries, index, count).select(*sc, F.col("_n").alias("n_pairs"), none.alias("n_first"))
    first = _routed(queries, index, lambda r, Q, _: (_first(r, Q, k + other_than_self)[1], None)).select(
        *sc, none.alias("n_pairs"), F.lit(1).cast("long").alias("n_first"))
    return pairs.unionByName(first).groupBy(*sc).agg(F.sum("n_pairs").alias("n_pairs"), F.sum("n_first").alias("n_first"))


def better_counts(queries: DataFrame, index: ClusterIndex, kernel, fields: list[T.StructField], extra: Sequence[str],
                  other_than_self: bool, block_bytes: int) -> DataFrame:
    """(scope..., qid, n_better): vectors that beat the gold's score, from
    scored blocks and from blocks counted as they stand."""
    from .dense import _scan
    sc = list(index.scope)

    def choose(rings, Q, extras):
        most, least = rings.bounds(Q)
        gold = extras["_gscore"].astype(np.float64)[:, None]
        whole = least > gold + SCORE_SLACK
        if other_than_self:  # the query's own vector is not in a block that its score cannot reach
            whole &= most < (Q * Q).sum(axis=1)[:, None] - SCORE_SLACK
        return (most >= gold - SCORE_SLACK) & ~whole, whole

    counts = _scan(queries, index.vectors, sc, "_id", "_vec", "_id", "_vec", block_bytes, kernel, fields, extra, index, choose)
    return counts.select(*sc, "qid", "n_better")

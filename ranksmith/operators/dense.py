"""Dense retrieval: pluggable batch encoders and exact inner-product top-k.

Exact search scores every (query, passage) pair, but never materialises the
pairs.  Queries are dealt to blocks of about ``block_bytes`` of vectors per
scope (e.g. model and language), and the passages of the scope pass by every
query block, multiplied as numpy matrices in bounded chunks.  Products in
single precision, with a bound on their error, leave out the pairs that cannot
count; the others are scored in double precision.  Only each block's partial
top-k (ties at the cut kept) -- or, for gold ranks, one count per query --
leaves the task; a ``row_number() <= k`` window (planned as a WindowGroupLimit)
merges the partial lists.

Ties: rank order is (score rounded to 9 places desc, passage id asc).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package, staged
from . import dense_index
from .dense_index import ClusterIndex
from .model_pass import ModelPass, split_pass

Encoder = Callable[[pd.Series], np.ndarray]

SCORE_ROUND = 9
_TIE_SLACK = 1e-9  # partial top-k keeps a superset; the window decides exactly


def unique_passages(df: DataFrame, col: str = "passage", keys: Sequence[str] = ()) -> DataFrame:
    """Non-null distinct passages (the retrieval corpus), per ``keys``."""
    return df.select(*keys, col).na.drop(subset=[col]).distinct()


# --- encoders ------------------------------------------------------------------

def hashed_bow_encoder(dim: int = 64) -> Callable[[], Encoder]:
    """Offline stand-in for a neural encoder: bag of words hashed into
    ``dim`` buckets (first 32 bits of md5 of each ``lower().split()`` token),
    L2-normalised.  Returns a factory so a real model would load once per
    task, not once per batch."""
    def factory() -> Encoder:
        bucket: dict[str, int] = {}  # per task: tokens repeat, hash each once

        def place(tok: str) -> int:
            if tok not in bucket:
                if len(bucket) > 1_000_000:
                    bucket.clear()
                bucket[tok] = int(hashlib.md5(tok.encode()).hexdigest()[:8], 16) % dim
            return bucket[tok]

        def encode(texts: pd.Series) -> np.ndarray:
            split = [t.lower().split() if t is not None else [] for t in texts]
            rows = np.repeat(np.arange(len(split)), [len(ts) for ts in split])
            at = np.fromiter((place(t) for ts in split for t in ts), np.int64, len(rows))
            out = np.bincount(rows * dim + at, minlength=len(split) * dim).reshape(-1, dim).astype(np.float64)
            norms = np.linalg.norm(out, axis=1, keepdims=True)
            return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)
        return encode
    return factory


def embed_batches(df: DataFrame, text: str, encoder: Callable[[], Encoder], out: str = "embedding",
                  batch_size: int = 32, on_error: str = "skip", dim: int | None = None,
                  error: str | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """Append ``out`` (array<double>) by running the encoder over batches of
    ``batch_size`` texts.  With ``on_error="skip"`` (index build) the rows of
    a failing batch are dropped; with ``"zero"`` (evaluator) they get zero
    vectors, and every row stays; these have ``dim`` numbers, or as many as
    the encoder gives for an empty text.  ``error`` names a column
    for the failure's message (null where there was none); with it no row is
    dropped in ``skip`` mode either: the vector is null, so failures can be
    counted and set apart.  ``keep`` names the columns that stay beside the
    vector (default: all)."""
    ship_package(df.sparkSession)
    kept = list(df.columns if keep is None else keep)
    fields = [T.StructField(out, T.ArrayType(T.DoubleType()))] + ([T.StructField(error, T.StringType())] if error else [])
    schema = T.StructType([df.schema[c] for c in kept] + fields)

    def run(it):
        model, width = encoder(), dim
        for pdf in it:
            for s in range(0, len(pdf), batch_size):
                chunk = pdf.iloc[s:s + batch_size]
                said = None
                try:
                    vecs = list(np.asarray(model(chunk[text]), dtype=np.float64))
                except Exception as e:  # noqa: BLE001 - model failures are data here
                    if on_error == "skip" and not error:
                        continue
                    said = f"{type(e).__name__}: {e}"
                    if on_error == "zero" and width is None:
                        width = np.asarray(model(pd.Series([""]))).shape[1]
                    vecs = [np.zeros(width) if on_error == "zero" else None for _ in range(len(chunk))]
                yield chunk[kept].assign(**{out: vecs}, **({error: said} if error else {}))
    return df.mapInPandas(run, schema)


def embed_pass(df: DataFrame, text: str, encoder: Callable[[], Encoder], out: str = "embedding", batch_size: int = 32,
               path: str | None = None, keep: Sequence[str] | None = None) -> ModelPass:
    """``embed_batches`` once, written: ``replies`` have vectors, and the rows
    of failing batches are ``dead_letters`` with their ``error``."""
    made = embed_batches(df, text, encoder, out, batch_size, error="error", keep=keep)
    return split_pass(made.withColumn("success", F.col("error").isNull()), path)


# --- blocked exact scoring ---------------------------------------------------------

# A task holds about BLOCK_BYTES of float64 query vectors; passages pass by in
# batches.  The product is taken in chunks of CHUNK_ROWS passages x CHUNK_QUERIES
# queries.  A task of more than TASK_PAIRS pairs is split by passages, where that
# takes MOST_PARTS parts at most: each part gets the queries again.
BLOCK_BYTES = 64 << 20
TASK_PAIRS = 1 << 31
MOST_PARTS = 4
CHUNK_ROWS = 1024
CHUNK_QUERIES = 2048


def _scan(queries: DataFrame, corpus: DataFrame, scope: Sequence[str], qid: str, qvec: str,
          pid: str, pvec: str, block_bytes: int, kernel, out_fields: list[T.StructField],
          extra_q: Sequence[str] = (), index: ClusterIndex | None = None, choose=None) -> DataFrame:
    """Run a kernel over every pair of a query and a passage of the same scope.
    ``kernel(Q, ids, extras)`` makes the state of a query chunk, whose
    ``add(piece, some)`` takes a chunk of passages (for the queries ``some``, or
    all) and whose ``result()`` is a dict of columns; these are returned with
    the scope columns in front.

    Queries are dealt by id hash to blocks of about ``block_bytes`` and wait in
    memory; passages go to every query block of their scope and pass by in the
    order of their ids, so that a task holds no more than its queries and a
    batch.  Passages of over four times ``block_bytes`` are dealt to several
    tasks.  What moves is the queries once a passage part, and the passages
    once a query block.  The block counts come from one aggregate per side (a
    row per scope value) that is joined in, so nothing passes through the
    driver and the plan stays lazy.  Rows without id or vector take no part.

    With an ``index`` of the corpus, its vectors pass by block after block, and
    ``choose(rings, Q, extras)`` tells by (query, block) flags which are scored,
    and which are counted as they stand (or None)."""
    ship_package(corpus.sparkSession)
    scope = list(scope)
    schema = T.StructType([corpus.schema[s] for s in scope] + out_fields)
    q = queries.select(*scope, F.col(qid).alias("_id"), F.col(qvec).alias("_vec"), *extra_q).na.drop(subset=["_id", "_vec"])
    block = ["_block"] if index is not None else []
    p = corpus.select(*scope, *block, F.col(pid).alias("_id"), F.col(pvec).alias("_vec")).na.drop(subset=["_id", "_vec"])
    on = scope or ["_all"]
    if not scope:
        q, p = (x.withColumn("_all", F.lit(0)) for x in (q, p))

    def sizes(df: DataFrame, side: str) -> DataFrame:
        n = F.count(F.lit(1))
        return df.groupBy(*on).agg(n.alias(f"_{side}rows"), (n * F.max(F.size("_vec")) * 8).alias(f"_{side}bytes"))

    least = lambda x: F.greatest(F.ceil(x), F.lit(1))
    pairs = F.col("_qrows") / F.col("_nq") * F.col("_prows")
    counts = (sizes(q, "q").join(sizes(p, "p"), on)
              .withColumn("_nq", least(F.col("_qbytes") / F.lit(block_bytes)))
              .withColumn("_np", F.greatest(least(F.col("_pbytes") / F.lit(4 * block_bytes)),
                                            F.least(least(pairs / F.lit(TASK_PAIRS)), F.lit(MOST_PARTS))))
              .select(*on, "_nq", "_np"))
    deal = lambda n, c="_id": F.pmod(F.xxhash64(c), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = q.join(counts, on).withColumn("_qb", deal("_nq")).withColumn("_pb", every("_np")).drop("_nq", "_np")
    p = p.join(counts, on).withColumn("_pb", deal("_np", *block)).withColumn("_qb", every("_nq")).drop("_nq", "_np")
    keys = [*on, "_qb", "_pb"]
    names = [f"_g{i}" for i in range(len(keys))]
    group = [F.col(c).alias(n) for c, n in zip(keys, names)]
    q = q.select(*group, F.lit(0).alias("_side"), *scope, F.col("_id").alias("_qid"), "_vec", *extra_q)
    p = p.select(*group, F.lit(1).alias("_side"), *block, F.col("_id").alias("_pid"), "_vec")
    both = q.unionByName(p, allowMissingColumns=True).repartition(*names).sortWithinPartitions(*names, "_side", *block, "_pid")
    rings = index.rings if index is not None else None
    return both.groupBy(*names).applyInArrow(_passing(scope, kernel, extra_q, schema, rings, choose), schema)


def _matrix(col) -> np.ndarray:
    rows = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


class _Vectors:
    """Vectors in both precisions, their norms and the largest."""

    def __init__(self, v: np.ndarray, single: np.ndarray | None = None, norm: np.ndarray | None = None):
        self.v = v
        with np.errstate(over="ignore", invalid="ignore"):
            self.norm = np.linalg.norm(v, axis=1) if norm is None else norm
            self.single = v.astype(np.float32) if single is None else single
        self.most = float(self.norm.max(initial=0.0))

    def some(self, at: np.ndarray) -> _Vectors:
        return _Vectors(self.v[at], self.single[at], self.norm[at])


class _Piece(_Vectors):
    """A chunk of passages by ascending id; ``at`` numbers them, unless ids of
    later chunks can be smaller."""

    def __init__(self, v: np.ndarray, pids: np.ndarray, first: int | None = None):
        super().__init__(v)
        self.pids, self.first = pids, first

    def among(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place in ``ids``) of passages that have one of the ids."""
        low, high = (np.searchsorted(self.pids, ids, side) for side in ("left", "right"))
        n = high - low
        c = np.repeat(np.arange(len(ids)), n)
        return np.arange(len(c)) - np.repeat(np.cumsum(n) - n, n) + low[c], c


def _products(piece: _Vectors, own: _Vectors) -> tuple[np.ndarray, np.ndarray]:
    """[passage, query] products and what each query's can be off by: single
    precision, which tells most pairs apart in half the time, where it holds."""
    if piece.most * own.most < 1e30 and max(piece.most, own.most) < 1e30:
        return piece.single @ own.single.T, own.norm * (piece.most * (piece.v.shape[1] + 8) * 1.2e-7) + 1e-37
    return piece.v @ own.v.T, np.zeros(len(own.v))


def _exact(piece: _Vectors, own: _Vectors, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", piece.v[r], own.v[c])


def _flagged(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.nonzero`` of a matrix with few flags, eight at a look."""
    flat = mask.ravel()
    whole = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:whole].view(np.uint64))
    if len(words) * 4 > whole // 8:
        return np.nonzero(mask)
    at = (words[:, None] * 8 + np.arange(8)).ravel()
    at = np.concatenate([at[flat[at]], whole + np.flatnonzero(flat[whole:])])
    return np.divmod(at, mask.shape[1])


def _counted(mask: np.ndarray) -> np.ndarray:
    """Flags of each column."""
    whole = len(mask) // 64 * 64
    bits = mask.view(np.int8)
    return (bits[:whole].reshape(-1, 64, mask.shape[1]).sum(axis=1, dtype=np.int8).sum(axis=0, dtype=np.int64)
            + bits[whole:].sum(axis=0, dtype=np.int64))


class _Chunk:
    """A query chunk's state, and by block which of its queries look at it."""

    def __init__(self, state, visited: np.ndarray | None, whole: np.ndarray | None):
        self.state, self.visited, self.whole = state, visited, whole

    def add(self, piece: _Piece, block: int | None) -> None:
        some = None
        if block is not None:
            if self.whole is not None and self.whole[:, block].any():
                self.state.count(self.whole[:, block], len(piece.v))
            flags = self.visited[:, block]
            n = np.count_nonzero(flags)
            if not n:
                return
            some = np.flatnonzero(flags) if n < len(flags) else None
        self.state.add(piece, some)


def _passing(scope, kernel, extra_q, schema, rings, choose):
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)

    def chunks(left: pa.Table, own) -> list[_Chunk]:
        Q = _matrix(left["_vec"])
        order = np.argsort(own.angles(Q)[1].argmin(axis=1), kind="stable") if own is not None else np.arange(len(Q))
        ids, extras = left["_qid"].to_numpy()[order], {c: left[c].to_numpy()[order] for c in extra_q}
        out = []
        for a in range(0, len(Q), CHUNK_QUERIES):
            c = slice(a, a + CHUNK_QUERIES)
            q, more = Q[order[c]], {k: v[c] for k, v in extras.items()}
            out.append(_Chunk(kernel(q, ids[c], more), *(choose(own, q, more) if own is not None else (None, None))))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, held, own, seen, place = [], None, None, 0, {}
        for batch in batches:
            n = int(np.count_nonzero(batch.column("_side").to_numpy() == 0))
            if n:
                if held is not None or batch.column("_side")[n - 1].as_py():
                    raise RuntimeError("passages came before queries")
                left.append(batch.slice(0, n))
            if n == len(batch) or not left:
                continue
            if held is None:
                table = pa.Table.from_batches(left)
                if rings is not None:
                    own = rings.value[tuple(table[c][0].as_py() for c in scope)]
                    place = {b: i for i, b in enumerate(own.block.tolist())}
                held = chunks(table, own)
                first = {c: table[c].slice(0, 1) for c in scope}
                left = [batch.slice(0, 0)]
            right = batch.slice(n)
            P, pids = _matrix(right.column("_vec")), right.column("_pid").to_numpy(zero_copy_only=False)
            if own is None:
                cuts = range(0, len(P), CHUNK_ROWS)
                blocks = [None] * len(cuts)
            else:  # no chunk has passages of two blocks
                of = right.column("_block").to_numpy()
                starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                ends = np.r_[starts[1:], len(of)]
                cuts = [a for s, e in zip(starts, ends) for a in range(s, e, CHUNK_ROWS)]
                blocks = [place[of[a]] for a in cuts]
            for a, e, b in zip(cuts, [*cuts[1:], len(P)], blocks):
                piece = _Piece(P[a:e], pids[a:e], seen + a if own is None else None)
                for chunk in held:
                    chunk.add(piece, b)
            seen += len(P)
        for chunk in held or ():
            cols = chunk.state.result()
            n = len(next(iter(cols.values())))
            if n:
                yield from pa.table([pa.repeat(first[f.name][0], n) if f.name in first else pa.array(cols[f.name], f.type)
                                     for f in arrow], schema=arrow).combine_chunks().to_batches()
    return run


def _runner(scope, kernel, extra_q, schema):
    """Both sides of a cogroup, as tables."""
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if len(left) and len(right):
            right = right.take(pc.sort_indices(right["_id"]))  # kernels get ascending ids
            ids, Q = left["_id"].to_numpy(), _matrix(left["_vec"])
            extras = {c: left[c].to_numpy() for c in extra_q}
            pids, P = right["_id"].to_numpy(), _matrix(right["_vec"])
            pieces = [_Piece(P[a:a + CHUNK_ROWS], pids[a:a + CHUNK_ROWS], a) for a in range(0, len(pids), CHUNK_ROWS)]
            for q0 in range(0, len(ids), CHUNK_QUERIES):
                c = slice(q0, q0 + CHUNK_QUERIES)
                state = kernel(Q[c], ids[c], {k: v[c] for k, v in extras.items()})
                for piece in pieces:
                    state.add(piece)
                cols = state.result()
                n = len(next(iter(cols.values())))
                parts.append(pa.table([pa.repeat(left[f.name][0], n) if f.name in scope else pa.array(cols[f.name], f.type)
                                       for f in arrow], schema=arrow))
        return pa.concat_tables(parts) if parts else arrow.empty_table()
    return run


def _cut(who: np.ndarray, at: np.ndarray, score: np.ndarray, k: int):
    """Places of the rows that can be among the best ``k`` of their query:
    those above the k-th score and near ties, of equal scores the first ``k``.
    Also the queries with ``k`` rows, and their k-th scores."""
    order = np.lexsort((at, -score, who))
    who, score = who[order], score[order]
    i = np.arange(len(who))
    first = np.r_[True, who[1:] != who[:-1]][:len(who)]
    run = first | np.r_[True, score[1:] != score[:-1]][:len(who)]
    place = i - np.maximum.accumulate(np.where(first, i, 0))
    nth = np.flatnonzero(place == k - 1)
    kth = np.full(int(who[-1]) + 1 if len(who) else 0, -np.inf)
    kth[who[nth]] = score[nth]
    keep = (score >= kth[who] - _TIE_SLACK) & (i - np.maximum.accumulate(np.where(run, i, 0)) < k)
    return order[keep], who[nth], score[nth]


#: Rows that a query chunk holds before they are cut to the best.
HELD_ROWS = 1 << 15


class _TopK:
    def __init__(self, k: int, Q: np.ndarray, ids: np.ndarray, extras: dict):
        self.k, self.own, self.ids = k, _Vectors(Q), ids
        self.least = extras["_least"].astype(np.float64) if "_least" in extras else np.full(len(ids), -np.inf)
        self.rows, self.held, self.most = [], 0, HELD_ROWS

    def add(self, piece: _Piece, some: np.ndarray | None = None) -> None:
        own = self.own if some is None else self.own.some(some)
        least = self.least if some is None else self.least[some]
        S, off = _products(piece, own)
        if len(S) > self.k and np.isneginf(least).any():
            least = np.fmax(least, np.partition(S, len(S) - self.k, axis=0)[len(S) - self.k] - off - _TIE_SLACK)
        r, c = _flagged(S >= (least - off).astype(S.dtype)[None, :])
        if not len(r):
            return
        score = _exact(piece, own, r, c)
        r, c, score = (x[score >= least[c]] for x in (r, c, score))
        at = r + piece.first if piece.first is not None else r
        self.rows.append((c if some is None else some[c], at, score, piece.pids[r]))
        self.held += len(r)
        if self.held > self.most or np.isneginf(self.least).any():
            self.cut(piece.first is not None)

    def cut(self, numbered: bool) -> None:
        if not self.rows:
            return
        who, at, score, pids = (np.concatenate(x) for x in zip(*self.rows))
        keep, full, kth = _cut(who, at if numbered else np.unique(pids, return_inverse=True)[1], score, self.k)
        self.least[full] = np.maximum(self.least[full], kth - _TIE_SLACK)
        self.rows, self.held = [(who[keep], at[keep], score[keep], pids[keep])], len(keep)
        self.most, self.numbered = max(HELD_ROWS, 2 * len(keep)), numbered

    def result(self) -> dict:
        if not self.rows:
            return {"qid": self.ids[:0], "pid": [], "score": np.empty(0)}
        self.cut(False)
        who, _, score, pids = self.rows[0]
        return {"qid": self.ids[who], "pid": pids, "score": score}


def _topk_kernel(k: int):
    """Best ``k`` of all chunks for each query: what a query holds stays near
    ``k`` rows however many chunks and ties there are.  Scores below an extra
    column ``_least`` are left out."""
    return lambda Q, ids, extras: _TopK(k, Q, ids, extras)


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int = 10, qid: str = "qid", qvec: str = "qvec",
               pid: str = "pid", pvec: str = "pvec", scope: Sequence[str] = (),
               block_bytes: int = BLOCK_BYTES, index: ClusterIndex | None = None, other_than_self: bool = False) -> DataFrame:
    """Exact top-``k`` passages per query by inner product:
    ``(scope..., qid, pid, score, rank)``.  Vectors are used as given
    (normalise first for cosine).  With an ``index`` of the corpus
    (``dense_index.cluster_index``) only blocks that can hold a result are
    scored; without one every block is.  ``other_than_self`` leaves out the
    passage with the query's own id."""
    fields = [T.StructField("qid", queries.schema[qid].dataType), T.StructField("pid", corpus.schema[pid].dataType),
              T.StructField("score", T.DoubleType())]
    if index is not None:
        q = queries.select(*scope, F.col(qid).alias("_id"), F.col(qvec).alias("_vec")).na.drop()
        cands = dense_index.topk(staged(q, "queries"), index, k, fields, other_than_self, block_bytes)
    else:
        cands = _scan(queries, corpus, scope, qid, qvec, pid, pvec, block_bytes, _topk_kernel(k + other_than_self), fields)
    if other_than_self:
        cands = cands.filter(F.col("pid") != F.col("qid"))
    w = Window.partitionBy(*scope, "qid").orderBy(F.round("score", SCORE_ROUND).desc(), F.col("pid").asc())
    ranked = cands.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.withColumnsRenamed({"qid": qid, "pid": pid}) if qid != pid else ranked


class _Better:
    """How many passages beat each query's gold: a higher rounded score, or the
    same and a smaller id.  The gold, copies of its text, and with an extra
    column ``_self`` the query's own passage, never do."""

    def __init__(self, Q: np.ndarray, ids: np.ndarray, extras: dict):
        self.own, self.ids = _Vectors(Q), ids
        self.gold = np.round(extras["_gscore"].astype(np.float64), SCORE_ROUND)
        self.out = [extras[c] for c in ("_gpid", "_self") if c in extras]
        self.n_better, self.n_seen = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)

    def add(self, piece: _Piece, some: np.ndarray | None = None) -> None:
        at = slice(None) if some is None else some
        own, g, gp = self.own if some is None else self.own.some(some), self.gold[at], self.out[0][at]
        S, off = _products(piece, own)
        for ids in self.out:
            S[piece.among(ids[at])] = -np.inf
        near = off + 4 * _TIE_SLACK
        over = S > (g + near).astype(S.dtype)[None, :]
        n = _counted(over)
        r, c = _flagged((S >= (g - near).astype(S.dtype)[None, :]) & ~over)
        s = np.round(_exact(piece, own, r, c), SCORE_ROUND)
        better = s > g[c]
        tie = np.flatnonzero(s == g[c])
        better[tie] = piece.pids[r[tie]] < gp[c[tie]]
        self.n_better[at] += n + np.bincount(c[better], minlength=len(n))
        self.n_seen[at] += len(S)

    def count(self, flags: np.ndarray, n: int) -> None:
        """``n`` passages that beat the golds of the queries, unseen."""
        self.n_better[flags] += n

    def result(self) -> dict:
        return {"qid": self.ids, "n_better": self.n_better, "n_seen": self.n_seen}


_better_kernel = _Better


def gold_rank_full(queries: DataFrame, corpus: DataFrame, qid: str = "qid", qvec: str = "qvec",
                   gold: str = "gold_pid", pid: str = "pid", pvec: str = "pvec",
                   scope: Sequence[str] = (), block_bytes: int = BLOCK_BYTES,
                   index: ClusterIndex | None = None, other_than_self: bool = False) -> DataFrame:
    """Rank of the gold passage when every passage is scored:
    ``1 + #{better}`` where better = higher rounded score, or equal score and
    smaller id; a gold missing from the corpus ranks ``N + 1``.  With the
    text (or its hash) as id, a gold that the corpus holds several times has
    the rank of its first copy.
    With an ``index`` of the corpus, blocks whose bounds tell are not scored.
    ``other_than_self`` leaves out the passage with the query's own id.
    Output ``(scope..., qid, rank, n_scored)``; ``n_scored`` counts the
    passages ranked, scored or not."""
    sc = list(scope)
    # Only passages that are some query's gold are looked up and told apart.
    g = corpus.select(*sc, F.col(pid).alias(gold), F.col(pvec).alias("_gvec")).na.drop(subset=["_gvec"]) \
        .join(queries.select(*sc, gold).distinct(), [*sc, gold], "left_semi").dropDuplicates([*sc, gold])
    q = queries.join(g, [*sc, gold], "left").withColumn(
        "_gscore", F.aggregate(F.zip_with(qvec, "_gvec", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    q = q.select(*sc, F.col(qid).alias("_id"), F.col(qvec).alias("_vec"), F.col(gold).alias("_gpid"), "_gscore")
    if index is not None:  # read for the routes, the ranks and the golds that are missing
        q = staged(q, "queries")
    found = q.filter(F.col("_gscore").isNotNull())
    fields = [T.StructField("qid", queries.schema[qid].dataType),
              T.StructField("n_better", T.LongType()), T.StructField("n_seen", T.LongType())]
    extra = ["_gpid", "_gscore"]
    if other_than_self:
        found, extra = found.withColumn("_self", F.col("_id")), [*extra, "_self"]
    if index is not None:
        given = found.na.drop()
        counts = dense_index.better_counts(given, index, _better_kernel, fields, extra, other_than_self, block_bytes)
        better = given.select(*sc, F.col("_id").alias("qid")).join(counts.groupBy(*sc, "qid").agg(F.sum("n_better").alias("b")), [*sc, "qid"], "left")
        if sc:  # a row a scope
            kinds = T.StructType([*(corpus.schema[c] for c in sc), T.StructField("n", T.LongType())])
            better = better.join(F.broadcast(queries.sparkSession.createDataFrame([(*s, n) for s, n in index.n_rows.items()], kinds)), sc)
        else:
            better = better.withColumn("n", F.lit(index.n_rows[()]).cast("long"))
        agg = better.select(*sc, "qid", (F.coalesce("b", F.lit(0)) + 1).alias("rank"), F.col("n").alias("n_scored"))
    else:
        counts = _scan(found, corpus, sc, "_id", "_vec", pid, pvec, block_bytes, _better_kernel, fields, extra_q=tuple(extra))
        agg = counts.groupBy(*sc, "qid").agg((F.sum("n_better") + 1).alias("rank"), F.sum("n_seen").alias("n_scored"))
    valid = corpus.select(*sc, pid, pvec).na.drop()
    missing = q.filter(F.col("_gscore").isNull()).select(*sc, F.col("_id").alias("qid"))
    if sc:  # corpus size per scope: one row per scope value
        n = valid.groupBy(*sc).agg(F.count(F.lit(1)).alias("_n"))
        missing = missing.join(F.broadcast(n), sc, "left")
    else:
        missing = missing.withColumn("_n", F.lit(valid.count()))
    missing = missing.select(*sc, "qid", (F.coalesce(F.col("_n"), F.lit(0)) + 1).alias("rank"),
                             F.coalesce(F.col("_n"), F.lit(0)).cast("long").alias("n_scored"))
    return agg.unionByName(missing).withColumnRenamed("qid", qid)


def nearest_texts(queries: DataFrame, passages: DataFrame, encoder: Callable[[], Encoder], k: int = 3,
                  query: str = "query_text", passage: str = "passage", path: str | None = None) -> DataFrame:
    """The ``k`` passages whose vectors are nearest to each distinct query's:
    ``(query, rank, passage)``.  Vectors travel with md5 ids; the texts are
    joined in for the chosen pairs only.  Ties: passage id ascending.  Texts
    that the encoder failed on take no part; with ``path`` their dead letters
    stay there, in ``queries`` and ``passages`` (``model_pass.read_pass``)."""
    q = queries.select(query).na.drop().distinct().withColumn("qid", F.md5(query))
    p = passages.select(passage).na.drop().distinct().withColumn("pid", F.md5(passage))
    q_vecs, p_vecs = (embed_pass(df, text, encoder, out, path=path and f"{path}/{side}").replies
                      for df, text, out, side in ((q, query, "qvec", "queries"), (p, passage, "pvec", "passages")))
    top = dense_topk(q_vecs.select("qid", "qvec"), p_vecs.select("pid", "pvec"), k=k)
    return top.join(q_vecs.select("qid", query), "qid").join(p_vecs.select("pid", passage), "pid").select(query, "rank", passage)


def index_metadata(corpus: DataFrame, vec: str = "embedding", model: str = "") -> DataFrame:
    """Corpus size, vector dimension and model name in one row."""
    return corpus.agg(F.count(F.lit(1)).alias("corpus_size"),
                      F.max(F.size(vec)).alias("dim")).withColumn("model", F.lit(model))


class _Stats:
    def __init__(self, other_than_self: bool, eps: float | None, Q: np.ndarray, ids: np.ndarray):
        self.own, self.ids, self.other_than_self, self.eps = _Vectors(Q), ids, other_than_self, eps
        self.n, self.total, self.most = np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.full(len(ids), -np.inf)

    def add(self, piece: _Piece, some: np.ndarray | None = None) -> None:
        S = piece.v @ self.own.v.T
        if self.eps is not None:
            S /= piece.norm[:, None] * self.own.norm[None, :] + self.eps
        self.n += len(S)
        if self.other_than_self:
            r, c = piece.among(self.ids)
            self.n -= np.bincount(c, minlength=len(self.n))
            S[r, c] = 0.0
        self.total += S.sum(axis=0)
        if self.other_than_self:
            S[r, c] = -np.inf
        self.most = np.maximum(self.most, S.max(axis=0))

    def result(self) -> dict:
        return {"qid": self.ids, "n": self.n, "sum": self.total, "max": self.most}


def _stats_kernel(other_than_self: bool, eps: float | None):
    return lambda Q, ids, extras: _Stats(other_than_self, eps, Q, ids)


def score_all_pairs(queries: DataFrame, corpus: DataFrame, qid: str = "qid", qvec: str = "qvec",
                    pid: str = "pid", pvec: str = "pvec", scope: Sequence[str] = (),
                    block_bytes: int = BLOCK_BYTES, other_than_self: bool = False, eps: float | None = None) -> DataFrame:
    """Score every query against every passage (the nested-loop evaluator)
    and keep per-query aggregates ``(scope..., qid, n_scored, score_sum,
    score_max)`` -- the pairs themselves are never written out.  Scores are
    inner products, or with ``eps`` cosines ``dot / (|q| |p| + eps)``."""
    fields = [T.StructField("qid", queries.schema[qid].dataType), T.StructField("n", T.LongType()),
              T.StructField("sum", T.DoubleType()), T.StructField("max", T.DoubleType())]
    s = _scan(queries, corpus, scope, qid, qvec, pid, pvec, block_bytes, _stats_kernel(other_than_self, eps), fields)
    return s.groupBy(*scope, "qid").agg(F.sum("n").alias("n_scored"), F.sum("sum").alias("score_sum"),
                                        F.max("max").alias("score_max")).withColumnRenamed("qid", qid)

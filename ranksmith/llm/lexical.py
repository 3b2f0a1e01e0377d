"""Ranked lexical search by hashed max-sketches.

A document's sketch folds its terms into hashed coordinates and keeps each
coordinate's largest impact.  Impacts grow with the number of occurrences, so
the sketch holds the largest number of occurrences a coordinate, which needs
no statistics of the corpus, and impacts are taken when it is read.  For a
query, the sum over its terms of weight times the sketch's impact at the
term's coordinate is no less than the document's score.

A search goes by descending bounds: every document's bounds for a block of
queries are one matrix product; the documents with the highest bounds are
scored exactly, the k-th best score is the threshold, and exactly those
documents whose bound reaches it are scored from their whole texts.  What
stays below cannot be among the best k, ties included.

Scores are whole numbers.  A term weighs w = floor(1000 * ln((2N + 2) / (2df + 1)));
a document's length counts as m = 75 + 25 * n * N div L; each occurrence of a
query term adds w * (10**9 * tf div (1000 * tf + 12 * m)).  N documents have a
term, L terms are in them, n in this one, tf of them this term, which df
documents hold.

Defined results: null texts have no terms, and queries without a known term no
rows; texts are read whole, long ones in slices cut between terms; repeated
documents are documents of their own; repeated queries (equal id and text)
count once, those with equal id and other text are ranked each; equal scores
rank by ascending id, nulls last; an empty table gives an empty result.  Other
columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranksmith.session import ship_package

from .common import map_texts, staged

#: The sketch has ``2 ** BITS`` coordinates, of which a document stores those it uses.
BITS = 16
#: Occurrences are stored up to this number, which stands for any as large.
MANY = (1 << 16) - 1
BEST = 20
#: Queries are looked up in blocks of about this many bytes of text.
BLOCK_BYTES = 1 << 17
#: Documents of each query whose scores give the first threshold.
FIRST = 2 * BEST
#: Documents to score up to which their keys (24 bytes each) are broadcast.
BROADCAST_KEYS = 1 << 20
_SLICE = 4 << 20
_DOCS = 256
_TABLE = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()
_BETWEEN = regex.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def count_terms(text: bytes | None) -> Counter:
    """term -> occurrences.  The bytes of a term are those of letters and
    digits, in lower case, and all beyond ASCII."""
    found: Counter = Counter()
    text, lo = text or b"", 0
    while lo < len(text):
        hi = len(text)
        if hi - lo > _SLICE and (cut := _BETWEEN.search(text, lo + _SLICE)):
            hi = cut.end()
        found.update(text[lo:hi].translate(_TABLE).split())
        lo = hi
    return found


def coordinates(terms) -> np.ndarray:
    return np.fromiter(map(crc32, terms), np.int64) & ((1 << BITS) - 1)


def sketch(found: Counter) -> tuple[bytes, bytes]:
    """Coordinates used, ascending, and the largest count at each."""
    at = coordinates(found)
    tf = np.minimum(np.fromiter(found.values(), np.int64, len(found)), MANY)
    order = np.argsort(at, kind="stable")
    at, tf = at[order], tf[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else at
    return at[first].astype("<u2").tobytes(), (np.maximum.reduceat(tf, first) if len(at) else tf).astype("<u2").tobytes()


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, t, k1, k2): a document's key is two hashes of id and text."""
    given = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("t"))
    parts = [F.col("doc_id").isNull(), "doc_id", F.col("t").isNull(), "t"]
    return given.select("*", F.xxhash64(F.lit(1), *parts).alias("k1"), F.xxhash64(F.lit(2), *parts).alias("k2"))


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(k1, k2, n, at, tf): key, number of terms and sketch of each document
    that has a term."""
    def make_kernel():
        def one(t):
            found = count_terms(t)
            return found.total(), *sketch(found)
        return lambda texts: [list(c) for c in zip(*map(one, texts))]

    return map_texts(_keyed(docs, doc_id, text), "t", make_kernel,
                     [T.StructField("n", T.LongType()), T.StructField("at", T.BinaryType()), T.StructField("tf", T.BinaryType())],
                     keep=["k1", "k2"]).where("n > 0")


def _document_counts(docs: DataFrame, text: str, wanted: list[bytes]) -> dict[bytes, int]:
    """How many documents hold each wanted term; tasks add up their own."""
    given = docs.sparkSession.sparkContext.broadcast(frozenset(wanted))  # the terms of one block of queries

    def run(batches):
        df: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                df.update(given.value.intersection(count_terms(t.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.binary()), pa.array(list(df.values()), pa.int64())], names=["term", "df"])

    rows = (docs.select(F.col(f"`{text}`").cast("binary").alias("t")).mapInArrow(run, "term binary, df long")
            .groupBy("term").agg(F.sum("df").alias("df")).collect())  # at most the wanted terms
    given.unpersist()
    return {bytes(r.term): r.df for r in rows}


class Queries:
    """A block of queries with weights: ``terms`` by query and, for bounds,
    ``weights[coordinate, query]`` of the coordinates that occur (``place``)."""

    def __init__(self, found: list[Counter], df: dict[bytes, int], n_docs: int, n_terms: int):
        weigh = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
        self.terms = [[(t, weigh[t] * times) for t, times in c.items() if weigh.get(t)] for c in found]
        self.n_docs, self.n_terms = n_docs, n_terms
        used = np.unique(np.concatenate([coordinates(t for t, _ in own) for own in self.terms] or [np.empty(0, np.int64)]))
        self.place = np.full(1 << BITS, -1, np.int32)
        self.place[used] = np.arange(len(used))
        self.weights = np.zeros((len(used), len(found)))
        for q, own in enumerate(self.terms):
            if own:
                np.add.at(self.weights[:, q], self.place[coordinates(t for t, _ in own)], [w for _, w in own])

    def length(self, n):
        return 75 + 25 * n * self.n_docs // self.n_terms

    def bounds(self, batch: pa.RecordBatch) -> np.ndarray:
        """[document, query]: bounds of a batch of the index.  All numbers are
        whole and, for queries of under 2**18 terms, exact as doubles; the
        slack covers longer ones."""
        at, tf = (_flat(batch.column(i)) for i in (3, 4))
        n = batch.column(2).to_numpy()
        row = np.repeat(np.arange(len(n)), _lengths(batch.column(3)) // 2)
        place = self.place[at]
        seen = place >= 0
        row, place, tf = row[seen], place[seen], tf[seen].astype(np.int64)
        impact = 10 ** 9 * tf // (1000 * tf + 12 * self.length(n)[row])
        impact[tf >= MANY] = 10 ** 6
        dense = np.zeros((len(n), len(self.weights)))
        dense[row, place] = impact
        return (dense @ self.weights) * (1 + 1e-12)

    def score(self, found: Counter, q: int) -> int:
        n = self.length(found.total())
        return sum(w * (10 ** 9 * tf // (1000 * tf + 12 * n)) for t, w in self.terms[q] if (tf := found.get(t)))


def _lengths(col: pa.Array) -> np.ndarray:
    return np.diff(np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1])


def _flat(col: pa.Array) -> np.ndarray:
    ends = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    return np.frombuffer(data, "<u2", (ends[-1] - ends[0]) // 2, int(ends[0])) if data is not None and ends[-1] > ends[0] else np.empty(0, "<u2")


def _small(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch), _DOCS):
            yield batch.slice(lo, _DOCS)


_FOUND = "q int, k1 long, k2 long, bound double"


def _rows(q, keys: np.ndarray, bound) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(keys[:, 0], pa.int64()), pa.array(keys[:, 1], pa.int64()),
                                       pa.array(bound, pa.float64())], names=["q", "k1", "k2", "bound"])


def highest_bounds(index: DataFrame, queries, count: int) -> DataFrame:
    """Each query's ``count`` documents with the highest bounds; every task
    passes on no more than its own so many."""
    def run(batches):
        block = queries.value
        n = block.weights.shape[1]
        top, keys = np.zeros((n, 0)), np.zeros((n, 0, 2), np.int64)
        for batch in _small(batches):
            bound = block.bounds(batch).T
            own = np.stack([batch.column(i).to_numpy() for i in (0, 1)], axis=1)
            if top.shape[1] >= count and not (bound > top.min(axis=1)[:, None]).any():
                continue
            top = np.concatenate([top, bound], axis=1)
            keys = np.concatenate([keys, np.broadcast_to(own, (n, *own.shape))], axis=1)
            if top.shape[1] > count:
                at = np.argpartition(-top, count - 1, axis=1)[:, :count]
                top, keys = np.take_along_axis(top, at, 1), np.take_along_axis(keys, at[:, :, None], 1)
        q, at = np.nonzero(top > 0)
        yield _rows(q, keys[q, at], top[q, at])

    best = Window.partitionBy("q").orderBy(F.desc("bound"), "k1", "k2")
    return index.mapInArrow(run, _FOUND).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= count).drop("_r")


def reaching(index: DataFrame, queries, thresholds: np.ndarray) -> DataFrame:
    """All documents whose bound reaches the query's threshold."""
    def run(batches):
        for batch in _small(batches):
            bound = queries.value.bounds(batch)
            row, q = np.nonzero((bound >= thresholds) & (bound > 0))
            if len(row):
                own = np.stack([batch.column(i).to_numpy() for i in (0, 1)], axis=1)
                yield _rows(q, own[row], bound[row, q])

    return index.mapInArrow(run, _FOUND)


def exact_scores(docs: DataFrame, queries, chosen: DataFrame) -> DataFrame:
    """(q, doc_id, score) of the chosen pairs, from the whole texts."""
    lists = staged(chosen.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("q")).alias("qs")), "chosen")
    if lists.count() <= BROADCAST_KEYS:
        lists = F.broadcast(lists)
    given = docs.join(lists, ["k1", "k2"]).select("doc_id", "t", "qs")

    def run(batches):
        block = queries.value
        for batch in batches:
            ids, at, qs, scores = batch.column(0), [], [], []
            for i, (t, own) in enumerate(zip(batch.column(1), batch.column(2))):
                found = count_terms(t.as_py())
                for q in own.as_py():
                    at.append(i)
                    qs.append(q)
                    scores.append(block.score(found, q))
            yield pa.RecordBatch.from_arrays([pa.array(qs, pa.int32()), ids.take(pa.array(at, pa.int64())), pa.array(scores, pa.int64())],
                                             names=["q", "doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(run, f"q int, doc_id {kind}, score long").where("score > 0")


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list]:
    """The queries in blocks, each brought to the driver by itself."""
    given = staged(items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").cast("binary").alias("t")).distinct(), "queries")
    held = given.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = held // BLOCK_BYTES + 1
    for b in range(blocks):
        yield given.where(F.pmod(F.xxhash64(F.col("item_id"), F.col("t")), F.lit(blocks)) == b).orderBy("item_id", "t").collect()


def search(docs: DataFrame, items: DataFrame, k: int = BEST, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text", index: DataFrame | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item.
    ``index``: a table of ``build_index`` over the same documents."""
    spark = docs.sparkSession
    ship_package(spark)
    index = staged(build_index(docs, doc_id, text), "sketches") if index is None else index
    keyed = _keyed(docs, doc_id, text)
    corpus = index.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_terms")).first()
    kinds = items.schema[item_id].dataType.simpleString(), docs.schema[doc_id].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kinds[0]}, rank int, doc_id {kinds[1]}, score long")
    for rows in _blocks(items, item_id, item_text) if corpus.n_docs else ():
        found = [count_terms(None if r.t is None else bytes(r.t)) for r in rows]
        df = _document_counts(docs, text, list(set().union(*found)))
        queries = spark.sparkContext.broadcast(Queries(found, df, corpus.n_docs, corpus.n_terms))
        first = _ranked(exact_scores(keyed, queries, highest_bounds(index, queries, max(k, FIRST))), k)
        thresholds = np.zeros(len(rows))
        for r in first.where(F.col("rank") == k).select("q", "score").collect():  # a row a query
            thresholds[r.q] = r.score
        best = _ranked(exact_scores(keyed, queries, reaching(index, queries, thresholds)), k)
        names = spark.createDataFrame([(q, r.item_id) for q, r in enumerate(rows)], f"q int, item_id {kinds[0]}")
        out = out.unionByName(staged(best.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score"), "ranked"))
    return out

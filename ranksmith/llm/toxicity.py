"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's probability is the logistic of
a bias and the weights of its words and word beginnings; a document's is the noisy-or of its sentences,
``1 - prod(1 - p)``.  Weights are learnt from document labels alone, by
gradient descent on the documents' log loss, and then say which sentences
offend.

The fit reads a bounded sample of labelled rows (``SAMPLE_ROWS``); scoring
reads every text whole.

Defined results: a null or empty text, or one without words, is one sentence
without words and scores the bias's probability; rows whose id or label is
null are not learnt from; an id labelled more than once is toxic if any label
is 1; repeated rows each get a result; without labelled rows of both kinds
nothing is learnt and every score is 0.  An empty table gives an empty result.
Other columns are only carried along where whole rows are returned.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranksmith.session import ship_package

from .common import WordCache, filter_texts, map_texts, per_worker, staged

#: Labelled rows of each kind that the fit reads at most.
SAMPLE_ROWS = 5000
#: Features that a task of the fit counts before it hands the counts on.
COUNTED = 200_000
#: Features that carry a weight: words and word beginnings, at most so many,
#: whose document frequency differs most between the kinds, by z-score of the
#: log odds.
VOCABULARY = 3000
MIN_DOCS, MIN_Z = 3, 2.5
#: Lengths of word beginnings, so that inflected words share a weight.
BEGINNINGS = range(4, 9)
STEPS, RATE, RIDGE = 400, 0.2, 0.3
_LETTERS = regex.compile(r"\p{L}+")
_END = b"\x00"


def words_of(token: bytes) -> list[str]:
    return _LETTERS.findall(token.decode("utf-8", "replace").lower())


def features_of(token: bytes) -> list[str]:
    """The token's words and their beginnings, those marked with an asterisk."""
    words = words_of(token)
    return words + [w[:k] + "*" for w in words for k in BEGINNINGS if len(w) >= k]


def tokens(text: bytes) -> list[bytes]:
    """Words and, for each line break, an end mark."""
    return text.replace(b"\n", b" \x00 ").split()


def ends(token: bytes) -> bool:
    return token[-1:] in (b".", b"!", b"?", _END)


def sentences(text: bytes) -> list[tuple[int, int]]:
    """Byte ranges of the sentences that have a word."""
    out, start, stop, words = [], None, 0, False
    for m in re.finditer(rb"[^\x20\x09-\x0D]+|\n", text):
        token = m[0] if m[0] != b"\n" else _END
        start = m.start() if start is None else start
        stop, words = (m.end() if token != _END else stop), words or bool(words_of(token))
        if ends(token):
            if words:
                out.append((start, stop))
            start, words = None, False
    return [*out, (start, stop)] if words else out


def _noisy_or(logits: np.ndarray) -> float:
    return float(-np.expm1(-np.logaddexp(0, logits).sum()))


class Model:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.key, self.cache = uuid.uuid4().hex, None

    def ready(self) -> Model:
        """A copy with a word cache."""
        out = Model(self.weights, self.bias)
        out.cache = WordCache(out._entry)
        return out

    def _entry(self, token: bytes) -> bytes:
        """Weight, whether a sentence ends, whether there is a word."""
        used = features_of(token)
        return np.array([sum(self.weights.get(w, 0.0) for w in used), ends(token), bool(used)], "<f4").tobytes()

    def logits(self, text: bytes) -> np.ndarray:
        """A logit for each sentence that has a word, or for one without words."""
        entry = self.cache.__getitem__ if self.cache is not None else self._entry
        rows = np.frombuffer(b"".join(map(entry, tokens(text))), "<f4").reshape(-1, 3)
        stop = rows[:, 1].cumsum().astype(np.int64)
        nth = stop - rows[:, 1].astype(np.int64)
        sums, real = np.bincount(nth, rows[:, 0]), np.bincount(nth, rows[:, 2]) > 0
        return self.bias + (sums[real] if real.any() else np.zeros(1))

    def score(self, text: bytes) -> float:
        return _noisy_or(self.logits(text))

    def located(self, text: bytes, least: float) -> tuple:
        """Score, number of sentences of ``least`` or more, and the byte range
        of the worst of them (null without one)."""
        logits = self.logits(text)
        ps = 1 / (1 + np.exp(-logits))
        n = int((ps >= least).sum())
        spans = sentences(text) if n else []
        return (_noisy_or(logits), n, *(spans[int(ps.argmax())] if len(spans) == len(ps) else (None, None)))

    def offending(self, text: bytes, least: float) -> list[tuple[int, int, float]]:
        spans = sentences(text)
        ps = 1 / (1 + np.exp(-self.logits(text)))
        return [(a, b, float(p)) for (a, b), p in zip(spans, ps) if p >= least]


NOTHING = Model({}, float("-inf"))


def held_out(doc_id: str = "doc_id"):
    """Ids that the fit never learns from."""
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def known_labels(labels: DataFrame, doc_id: str = "doc_id", label: str = "toxic") -> DataFrame:
    """(doc_id, y) of the ids that may be learnt from."""
    return (labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~held_out(doc_id))
            .groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y")))


def labelled_sample(known: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` ids of each kind, those with the smallest hashes."""
    kinds = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for y in (0, 1)]
    return kinds[0].unionByName(kinds[1])


def fit(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
        rows: int = SAMPLE_ROWS) -> Model:
    """Learn from the labelled sample's texts.  At most ``2 * rows`` ids are
    broadcast, ``VOCABULARY`` words and weights come to the driver."""
    ship_package(df.sparkSession)
    known = known_labels(labels, doc_id, label)
    sample = F.broadcast(labelled_sample(known, rows))  # 2 * rows ids at most
    texts = (df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("t"))
             .join(sample, "doc_id"))
    totals = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows

    def count(batches):
        found, cache = Counter(), WordCache(features_of)

        def counts():
            return pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in found], pa.string()), pa.array([y for _, y in found], pa.int32()),
                 pa.array(list(found.values()), pa.int64())], names=["word", "y", "n"])

        for batch in batches:
            for t, y in zip(batch.column(0), batch.column(1)):
                y, used = y.as_py(), {""}  # the empty feature counts documents
                used.update(*map(cache.__getitem__, set(tokens(t.as_py() or b""))))
                found.update((w, y) for w in used)
                if len(found) > COUNTED:
                    yield counts()
                    found.clear()
        yield counts()

    per_word = (texts.select("t", "y").mapInArrow(count, "word string, y int, n long").groupBy("word")
                .agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("bad"),
                     F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("good"))
                .where(F.col("bad") + F.col("good") >= MIN_DOCS))
    per_word = staged(per_word, "features")
    docs = per_word.where("word = ''").first()  # one row
    if not docs or not docs.bad or not docs.good:
        return NOTHING
    bad, good = F.col("bad") + 0.5, F.col("good") + 0.5
    odds = F.log(bad / (docs.bad + 1.0)) - F.log(good / (docs.good + 1.0))
    z = F.abs(odds) / F.sqrt(1 / bad + 1 / good)
    words = [r.word for r in per_word.where((F.col("word") != "") & (z >= MIN_Z))
             .orderBy(z.desc(), "word").limit(VOCABULARY).select("word").collect()]
    index = {w: i for i, w in enumerate(words)}
    # What a sampled document stands for, as the kinds are not sampled alike.
    share = {1: totals[1] / docs.bad, 0: totals[0] / docs.good}

    def features(batches):
        cache = WordCache(lambda token: [index[w] for w in features_of(token) if w in index])
        for batch in batches:
            made = [[], [], [], [], []]
            for i, t, y in zip(*(batch.column(c) for c in range(3))):
                data, plain, word, sent, k = t.as_py() or b"", 0, [], [], 0
                for a, b in sentences(data):
                    at = [w for token in data[a:b].split() for w in cache[token]]
                    plain += not at
                    if at:
                        word += at
                        sent += [k] * len(at)
                        k += 1
                packed = [np.array(x, "<i4").tobytes() for x in (word, sent)]
                for column, value in zip(made, (i.as_py(), y.as_py(), plain or int(not k), *packed)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                                             names=["doc_id", "y", "plain", "word", "sent"])

    def learn(batches):
        rows = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: r["doc_id"])
        unpack = lambda c: [np.frombuffer(r[c], "<i4") for r in rows]
        y = np.array([r["y"] for r in rows])
        weights, bias = noisy_or_fit(y, np.array([r["plain"] for r in rows]), unpack("word"), unpack("sent"), len(words),
                                     np.where(y == 1, share[1], share[0]))
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(words)), -1], pa.int32()), pa.array([*weights, bias], pa.float64())],
                                         names=["i", "weight"])

    # The sample is bounded: one task holds its feature numbers and learns.
    got = (texts.select(F.col("doc_id").cast("string"), "t", "y")
           .mapInArrow(features, "doc_id string, y int, plain long, word binary, sent binary")
           .dropDuplicates(["doc_id"]).repartition(1).mapInArrow(learn, "i int, weight double").collect())
    learnt = {r.i: r.weight for r in got}
    return Model({w: learnt[i] for i, w in enumerate(words)}, learnt[-1])


def noisy_or_fit(y, plain, words, sents, n_words: int, weight=None) -> tuple[np.ndarray, float]:
    """Word weights and bias by Adam on the documents' weighted mean log loss.

    By document: ``plain``, its sentences without a weighted word; ``words``,
    the numbers of the weighted words in the others, and ``sents``, the number
    of the sentence that each stands in."""
    y, plain = np.array(y, float), np.array(plain, float)
    weight = np.ones(len(y)) if weight is None else np.array(weight, float)
    n_sents = np.array([s[-1] + 1 if len(s) else 0 for s in sents], int)
    start = np.concatenate([[0], n_sents.cumsum()])
    doc = np.repeat(np.arange(len(y)), n_sents)
    word = np.concatenate([*map(np.asarray, words), np.zeros(0, int)]).astype(int)
    sent = np.concatenate([*(np.asarray(s) + a for s, a in zip(sents, start)), np.zeros(0, int)]).astype(int)
    w, mean, var = np.append(np.zeros(n_words), -4.0), np.zeros(n_words + 1), np.zeros(n_words + 1)
    for step in range(1, STEPS + 1):
        z = w[-1] + np.bincount(sent, w[word], len(doc))
        clean = -np.logaddexp(0, z)  # log of the chance of no offence
        none = np.bincount(doc, clean, len(y)) - plain * np.logaddexp(0, w[-1])
        p = -np.expm1(none)
        # d loss / d log(1 - p): 1 for clean documents' negative log, -(1 - p) / p for toxic ones
        pull = weight * np.where(y == 1, -np.exp(none) / np.maximum(p, 1e-9), 1.0)
        by_sentence = pull[doc] / (1 + np.exp(-z))
        grad = np.append(np.bincount(word, by_sentence[sent], n_words),
                         by_sentence.sum() + (pull * plain).sum() / (1 + np.exp(-w[-1])))
        grad[:-1] += RIDGE * w[:-1]
        grad /= weight.sum()
        mean, var = 0.9 * mean + 0.1 * grad, 0.99 * var + 0.01 * grad ** 2
        w -= RATE * (1 - step / (STEPS + 1)) * (mean / (1 - 0.9 ** step)) / (np.sqrt(var / (1 - 0.99 ** step)) + 1e-8)
    return w[:-1], float(w[-1])


def score(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id and score."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # VOCABULARY words

    def make_kernel():
        m = per_worker("words", sent.value.key, sent.value.ready)
        return lambda texts: [[m.score(t or b"") for t in texts]]

    return map_texts(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("_rs_text")), "_rs_text",
                     make_kernel, [T.StructField("score", T.DoubleType())])


def located(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """One row per row of ``df``: doc_id, score, n_offending (sentences that
    score ``least`` or more), worst_start and worst_stop (byte range in the
    text's UTF-8 of the one that scores most; null without one)."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # VOCABULARY words

    def make_kernel():
        m = per_worker("words", sent.value.key, sent.value.ready)
        return lambda texts: [list(c) for c in zip(*(m.located(t or b"", least) for t in texts))]

    return map_texts(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("_rs_text")), "_rs_text", make_kernel,
                     [T.StructField("score", T.DoubleType()),
                      *(T.StructField(c, T.LongType()) for c in ("n_offending", "worst_start", "worst_stop"))])


def offending_sentences(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text",
                        least: float = 0.5) -> DataFrame:
    """(doc_id, start, stop, score, sentence) for sentences that score
    ``least`` or more; start and stop are byte offsets in the text's UTF-8."""
    ship_package(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)
    given = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("t"))
    schema = T.StructType([given.schema["doc_id"], *(T.StructField(n, t) for n, t in (
        ("start", T.LongType()), ("stop", T.LongType()), ("score", T.DoubleType()), ("sentence", T.StringType())))])

    def run(batches):
        m = per_worker("words", sent.value.key, sent.value.ready)
        for batch in batches:
            rows = [(i, a, b, p, t.as_py()[a:b].decode("utf-8", "replace"))
                    for i, t in enumerate(batch.column(1)) for a, b, p in m.offending(t.as_py() or b"", least)]
            ids, *rest = map(list, zip(*rows)) if rows else [[]] * 5
            types = (pa.int64(), pa.int64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())),
                                              *(pa.array(x, t) for x, t in zip(rest, types))], names=schema.names)

    return given.mapInArrow(run, schema)


def not_toxic(df: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``df``, whole, that score below ``least``."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make_kernel():
        m = per_worker("words", sent.value.key, sent.value.ready)
        return lambda texts: [m.score(t or b"") < least for t in texts]

    return filter_texts(df, text, make_kernel)

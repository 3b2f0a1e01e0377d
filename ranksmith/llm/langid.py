"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
A word's probability is the sum, over all its segmentations into pieces, of
the product of the pieces' probabilities (forward algorithm); a text's is the
product over its words.  Piece probabilities are fitted by expectation
maximisation: a word adds each piece's expected number of uses.

The fit reads a bounded sample of labelled rows (about ``SAMPLE_ROWS`` a
language, chosen by hash); prediction reads every text whole.

Words are the letter runs of a text, in lower case; a piece's word mark stands
before a word.  A character without a piece counts as an unknown piece.

Defined results: a null text, an empty one or one without a letter is ``und``
with score 0, as is every text if no language was learnt; of languages as
likely the first by code point wins; null languages are not learnt from;
repeated rows each get a result; an empty table gives an empty result.  Other
columns are not read.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranksmith.session import ship_package

from .common import map_texts, per_worker, staged, text_or_empty

#: Labelled rows of each language that the fit reads, about.
SAMPLE_ROWS = 1000
ROUNDS = 2
UNKNOWN = 1e-7
SMOOTHING = 0.01
MARK = "▁"
NO_LANGUAGE = "und"
_LETTERS = regex.compile(r"\p{L}+")
#: Letter runs longer than this are summed up piecemeal, and learnt from in pieces.
LONG = 1 << 13
#: Sums below this are scaled up.
SMALL = 1e-100


def letters(token: bytes) -> list[str]:
    word = token.decode("utf-8", "replace").lower()
    return [word] if word.isalpha() else _LETTERS.findall(word)


def pieces_of(path: str) -> frozenset[str]:
    """The vocabulary's pieces that consist of letters, with or without word mark."""
    def load():
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
        return frozenset(p for p in pieces if p == MARK or regex.fullmatch(MARK + r"?\p{L}+", p))
    return per_worker("pieces", path, load)


class Trie:
    """The vocabulary's pieces, numbered, as flat arrays: ``keys`` holds each
    step's node and character, ascending, ``child`` the node that it leads to,
    ``ends`` the number of the piece that ends at a node, or -1."""

    def __init__(self, pieces: list[str]):
        self.size, self.longest = len(pieces), max(map(len, pieces), default=1)
        steps: dict[int, int] = {}
        ends = {}
        for i, piece in enumerate(pieces):
            node = 0
            for c in piece:
                node = steps.setdefault(node << 21 | ord(c), len(steps) + 1)
            ends[node] = i
        keys = np.fromiter(steps, np.int64, len(steps))
        order = keys.argsort()
        self.keys, self.child = keys[order], np.fromiter(steps.values(), np.int64, len(steps))[order]
        self.ends = np.full(len(steps) + 1, -1, np.int32)
        self.ends[list(ends)] = list(ends.values())

    def lattice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths, and at [word, stop, length] the piece there: ``size`` for
        an unknown character, ``size + 1`` where there is none.  All starts
        walk down together until no piece goes on."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        width, deep = int(lengths.max()) + 1, self.longest + 1
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        word = np.repeat(np.arange(len(words)), lengths)
        begin = np.cumsum(lengths) - lengths
        at = np.arange(len(codes))
        left = (begin + lengths)[word] - at
        cell = (word * width + at - begin[word]) * deep
        grid = np.full((len(words), width, deep), self.size + 1, np.int32)
        flat, node = grid.ravel(), np.zeros(len(codes), np.int64)
        for k in range(1, self.longest + 1):
            keys = node << 21 | codes[at + k - 1]
            step = np.minimum(self.keys.searchsorted(keys), max(len(self.keys) - 1, 0))
            on = self.keys[step] == keys if len(self.keys) else np.zeros(len(keys), bool)
            at, left, cell, node = at[on], left[on], cell[on] + deep + 1, self.child[step[on]]
            piece = self.ends[node]
            flat[cell[piece >= 0]] = piece[piece >= 0]
            on = left > k
            at, left, cell, node = at[on], left[on], cell[on], node[on]
        ones = grid[:, 1:, 1]
        real = np.arange(1, width) <= lengths[:, None]
        ones[real & (ones > self.size)] = self.size
        return lengths, grid


def batches_of(words: list[str], cells: int = 1 << 15) -> Iterator[list[str]]:
    """Words of like length, so many that they fill a grid of ``cells`` rows."""
    words, lo = sorted(words, key=len), 0
    while lo < len(words):
        hi = lo + 1
        while hi < len(words) and (hi - lo + 1) * (len(words[hi]) + 1) <= cells:
            hi += 1
        yield words[lo:hi]
        lo = hi


def forward_logs(lengths: np.ndarray, grid: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """[word, language]: log of the sum over the word's segmentations.
    ``probs`` is [piece, language]; sums are rescaled wherever they get small.
    A character is a piece or an unknown one, so no step divides a sum by more
    than the inverse of the least probability."""
    n, width, deep = grid.shape
    sums, scale = np.zeros((n, width, probs.shape[1])), np.zeros((n, probs.shape[1]))
    sums[:, 0] = 1.0
    out = np.empty((n, probs.shape[1]))
    for stop in range(1, width):
        for k in range(1, min(stop, deep - 1) + 1):
            if (piece := grid[:, stop, k]).min() < len(probs) - 1:
                sums[:, stop] += sums[:, stop - k] * probs[piece]
        if (done := lengths == stop).any():
            out[done] = np.log(sums[done, stop]) + scale[done]
        low = (sums[:, stop] < SMALL) & (lengths > stop)[:, None]
        if low.any():
            factor = np.where(low, 1 / SMALL, 1.0)
            sums[:, max(0, stop - deep):stop + 1] *= factor[:, None]
            scale -= np.log(factor)
    return out


def long_logs(trie: Trie, word: str, probs: np.ndarray, chunk: int = 1 << 12) -> np.ndarray:
    """``forward_logs`` of one word of any length: only the sums that a piece
    can still start from, and the lattice of ``chunk`` letters, are held."""
    deep = trie.longest
    sums, scale = np.ones((1, probs.shape[1])), np.zeros(probs.shape[1])
    for lo in range(0, len(word), chunk):
        known = len(sums) - 1  # letters before ``lo`` whose sums are held
        _, grid = trie.lattice([word[lo - known:lo + chunk]])
        width = grid.shape[1]
        sums = np.concatenate([sums, np.zeros((width - known - 1, probs.shape[1]))])
        for stop in range(known + 1, width):
            reach = min(stop, deep)
            pieces = grid[0, stop, 1:reach + 1]
            sums[stop] = (probs[pieces] * sums[stop - reach:stop][::-1]).sum(axis=0)
            if (sums[stop] < SMALL).any():
                factor = np.where(sums[stop] < SMALL, 1 / SMALL, 1.0)
                sums[max(0, stop - deep):stop + 1] *= factor
                scale -= np.log(factor)
        sums = sums[-deep:]
    return np.log(sums[-1]) + scale


def expected_uses(lengths: np.ndarray, grid: np.ndarray, probs: np.ndarray, times: np.ndarray) -> np.ndarray:
    """[piece]: expected number of uses in the words' segmentations under one
    language's ``probs``, each word counted ``times``.  Forward sums are kept
    as logs; backwards, the expected number of segmentations through each
    position is dealt to the pieces that end there by their shares of its sum."""
    n, width, deep = grid.shape
    ahead, through = np.zeros((n, width)), np.zeros((n, width))
    through[np.arange(n), lengths] = times

    def steps(stop):
        """Words that reach ``stop``; positions that pieces start at, and pieces."""
        starts = np.arange(stop - 1, max(0, stop - deep + 1) - 1, -1)
        rows = np.flatnonzero(lengths >= stop)[:, None]
        return rows, starts, grid[rows, stop, stop - starts]

    for stop in range(1, width):
        rows, starts, pieces = steps(stop)
        last = ahead[rows, stop - 1]
        terms = probs[pieces] * np.exp(ahead[rows, starts] - last)
        ahead[rows, stop] = last + np.log(terms.sum(axis=1, keepdims=True))
    uses = np.zeros(len(probs))
    for stop in range(width - 1, 0, -1):
        rows, starts, pieces = steps(stop)
        flow = probs[pieces] * np.exp(ahead[rows, starts] - ahead[rows, stop]) * through[rows, stop]
        through[rows, starts] += flow
        np.add.at(uses, pieces, flow)
    return uses


class Model:
    """Piece probabilities by language: ``probs[piece, language]`` for the
    vocabulary's pieces, the unknown piece and, with 0, no piece."""

    def __init__(self, languages: list[str], pieces: list[str], probs: np.ndarray):
        self.languages, self.pieces, self.probs = languages, pieces, probs
        self.key = uuid.uuid4().hex

    def ready(self) -> Model:
        """A copy with what prediction looks up."""
        out = Model(self.languages, self.pieces, self.probs)
        out.trie = Trie(self.pieces)
        return out

    def word_logs(self, words: list[str]) -> np.ndarray:
        """[word, language]: log probabilities."""
        out, place = np.empty((len(words), len(self.languages))), {w: i for i, w in enumerate(words)}
        for w in words:
            if len(w) > LONG:
                out[place[w]] = long_logs(self.trie, MARK + w, self.probs)
        for some in batches_of([w for w in words if len(w) <= LONG]):
            out[[place[w] for w in some]] = forward_logs(*self.trie.lattice([MARK + w for w in some]), self.probs)
        return out

    def predict(self, texts: list[bytes]) -> list[tuple[str, float]]:
        """Every distinct word of the texts is summed up once: most are rare,
        so that nothing is kept for later texts."""
        split = [t.split() for t in texts]
        tokens = list({t for ts in split for t in ts})
        words = [letters(t) for t in tokens]
        n_words = np.fromiter(map(len, words), np.int64, len(words))
        distinct = list({w for ws in words for w in ws})
        place = dict(zip(distinct, range(len(distinct))))
        logs = self.word_logs(distinct)[np.fromiter((place[w] for ws in words for w in ws), np.int64, n_words.sum())]
        entries, first = np.zeros((len(tokens), len(self.languages))), (np.cumsum(n_words) - n_words)[n_words > 0]
        entries[n_words > 0] = np.add.reduceat(logs, first) if len(first) else 0.0
        index = dict(zip(tokens, range(len(tokens)))).__getitem__
        return [self._best(np.fromiter(map(index, ts), np.int64, len(ts)), entries, n_words) for ts in split]

    def _best(self, at: np.ndarray, entries: np.ndarray, n_words: np.ndarray) -> tuple[str, float]:
        if not n_words[at].any():
            return NO_LANGUAGE, 0.0
        logs = entries[at].sum(axis=0)
        best = int(logs.argmax())
        return self.languages[best], float(1 / np.exp(logs - logs[best]).sum())


def held_out(doc_id: str = "doc_id"):
    """Ids that the fit never learns from."""
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(df: DataFrame, doc_id: str, text: str, lang: str, rows: int) -> tuple[DataFrame, list[str]]:
    """(lang, t) of about ``rows`` rows a language, and the languages."""
    known = df.where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull() & ~held_out(doc_id)).select(
        F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("t"),
        F.shiftright(F.xxhash64(text_or_empty(doc_id), F.octet_length(F.col(f"`{text}`"))), 1).alias("h"))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # Hashes now lie within +- 2 ** 62.
    upto = counts.withColumn("upto", F.least(F.lit(1.0), F.lit(float(rows)) / F.col("n")) * 2.0 ** 63 - 2.0 ** 62)
    upto = staged(upto, "languages")
    picked = known.join(upto, "lang").where(F.col("h") <= F.col("upto"))
    return (picked.select("lang", F.col("t").cast("binary").alias("t")),
            sorted(r.lang for r in upto.select("lang").collect()))  # a row a language


def fit(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
        rows: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> Model:
    """Learn each language's piece probabilities.  Words are counted by
    language and the counts kept; each round sends expected uses to the
    driver, at most one row for each language and piece of the vocabulary."""
    ship_package(df.sparkSession)
    texts, languages = sample(df, doc_id, text, lang, rows)
    if not languages:
        return Model([], [], np.zeros((2, 0)))

    def count(batches):
        for batch in batches:
            found = defaultdict(Counter)
            for g, t in zip(batch.column(0), batch.column(1)):
                found[g.as_py()].update(t.as_py().split())
            words = Counter()
            for g, n_tokens in found.items():
                for token, n in n_tokens.items():
                    for w in letters(token):
                        for lo in range(0, len(w), LONG):
                            words[g, w[lo:lo + LONG]] += n
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in words], pa.string()), pa.array([w for _, w in words], pa.string()),
                                              pa.array(list(words.values()), pa.int64())], names=["lang", "word", "n"])

    words = staged(texts.mapInArrow(count, "lang string, word string, n long")
                   .groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    spark, pieces = df.sparkSession, sorted(pieces_of(path))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    probs = np.full((len(pieces) + 2, len(languages)), 1.0 / len(pieces))
    for _ in range(rounds):
        probs[-2], probs[-1] = UNKNOWN, 0.0
        given = spark.sparkContext.broadcast(probs)  # languages x vocabulary

        def expect(batches):
            trie = per_worker("words", ("trie", path), lambda: Trie(sorted(pieces_of(path))))
            sums = np.zeros(given.value.shape)
            for batch in batches:
                counts = defaultdict(dict)
                for g, w, n in zip(*(c.to_pylist() for c in batch.columns)):
                    counts[g][w] = n
                for g, own in counts.items():
                    k = languages.index(g)
                    for some in batches_of(list(own)):
                        grid = trie.lattice([MARK + w for w in some])
                        sums[:, k] += expected_uses(*grid, given.value[:, k], np.array([own[w] for w in some], float))
            piece, k = np.nonzero(sums[:-2])
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(piece, pa.int64()), pa.array(sums[piece, k])],
                                             names=["k", "piece", "uses"])

        got = (words.repartition(tasks, "word").mapInArrow(expect, "k long, piece long, uses double")
               .groupBy("k", "piece").agg(F.sum("uses").alias("uses")).collect())
        probs = np.full(probs.shape, SMOOTHING)
        for r in got:
            probs[r.piece, r.k] += r.uses
        probs /= probs[:-2].sum(axis=0)
        given.unpersist()
    probs[-2], probs[-1] = UNKNOWN, 0.0
    return Model(languages, pieces, probs)


def predict(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, lang_pred and score (the language's
    posterior probability, all languages being as likely before)."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # languages x vocabulary

    def make_kernel():
        m = per_worker("words", sent.value.key, sent.value.ready)

        def kernel(texts: list) -> list:
            if not m.languages:
                return [[NO_LANGUAGE] * len(texts), [0.0] * len(texts)]
            return [list(c) for c in zip(*m.predict([t or b"" for t in texts]))]
        return kernel

    return map_texts(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("_rs_text")), "_rs_text", make_kernel,
                     [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

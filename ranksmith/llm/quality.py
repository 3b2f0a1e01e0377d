"""Quality rules: hashed n-gram log-likelihood ratio.

Two multinomials over hashed n-grams, one of the trusted target and one of the
raw corpus, give each document the mean log ratio of its n-grams; a fixed
threshold decides, for every document alike.  N-grams are single tokens and
pairs of neighbouring tokens; tokens are the runs of word characters and the
runs of other characters of each word, case kept.  The target is the documents
whose labels are all of good quality; the counts of both cover all documents.

Base rules come first: too few words, or too many words in repeated windows.

Defined results: a null or empty text has no words and fails the base rules
(its score is 0); texts are read whole; documents labelled more than once are
trusted if every label is 1, null labels and ids being no trust; repeated rows
each count and each get a result; with an empty table or no trusted document
the target falls back to the raw corpus, so every ratio is 0.  Other columns
are not read.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranksmith.session import ship_package

from .common import WordCache, map_texts, per_worker, slices, staged

#: Bits of the fewest and of the most buckets.  In between, their number follows
#: the corpus: one for ``PER_BUCKET`` to twice as many n-grams, repeats counted.
BUCKET_BITS, MOST_BITS = 12, 22
PER_BUCKET = 16
#: Buckets in a packed block.
BLOCK = 1 << 12
#: Trusted ids up to which they are broadcast.
BROADCAST_IDS = 1 << 21
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Documents whose n-grams are, by the mean, less likely than this log ratio
#: under the target are rejected.
THRESHOLD = -0.15
#: Added to each bucket's count.
PRIOR = 1.0
SYMBOLS = b"#*$%&|<>"
#: White space and continuation bytes: what is left of a text is a byte for each character in words.
_NO_WORD_CHAR = b" \t\n\x0b\x0c\r" + bytes(range(0x80, 0xC0))
_TOKEN = regex.compile(r"\w+|[^\w\s]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _word_hashes(word: bytes) -> bytes:
    """Packed hashes of a word's tokens; a word of letters is one token."""
    return xxhash.xxh64_digest(word) if word.isalpha() or word.decode("utf-8", "replace").isalpha() else _token_hashes(word)


def _token_hashes(word: bytes) -> bytes:
    tokens = _TOKEN.findall(word.decode("utf-8", "replace"))
    return b"".join(xxhash.xxh64_digest(t.encode()) for t in tokens)


def buckets(words: list[bytes], cache, bits: int = BUCKET_BITS) -> np.ndarray:
    """Hash buckets of one text's n-grams, word by word: single tokens in the
    lower half, pairs in the upper one.  Fewer bits join neighbouring buckets."""
    h = np.frombuffer(b"".join(map(cache.__getitem__, words)), "<u8")
    pairs = (h[:-1] * _MIX + h[1:]) * _MIX
    shift, half = np.uint64(65 - bits), np.uint64(1 << bits - 1)
    return np.concatenate([h >> shift, (pairs >> shift) + half]).astype(np.int64)


class Slice:
    """The words of some texts: ``ids`` numbers each word among the distinct
    ``words``, ``ends`` is where each text's words end."""

    def __init__(self, texts: list[bytes]):
        split = [t.split() for t in texts]
        self.ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
        self.words = list({w for ws in split for w in ws})
        index = dict(zip(self.words, range(len(self.words)))).__getitem__
        self.ids = np.fromiter(map(index, chain.from_iterable(split)), np.int64, self.ends[-1] if len(split) else 0)

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Token hashes in order, and where each text's end."""
        packed = [_word_hashes(w) for w in self.words]
        n = np.fromiter(map(len, packed), np.int64, len(packed)) >> 3
        flat = np.frombuffer(b"".join(packed), "<u8")
        first = np.cumsum(n) - n
        times = n[self.ids]
        before = np.cumsum(times) - times
        at = np.repeat(first[self.ids] - before, times) + np.arange(times.sum())
        return flat[at], np.r_[0, np.cumsum(times)][self.ends]

    def buckets(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the texts' n-grams (see ``buckets``), the single tokens
        first, and the number of the text that each belongs to."""
        h, ends = self.hashes()
        text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        within = text[1:] == text[:-1]
        pairs = (h[:-1] * _MIX + h[1:])[within] * _MIX
        shift, half = np.uint64(65 - bits), np.uint64(1 << bits - 1)
        return np.concatenate([h >> shift, (pairs >> shift) + half]).astype(np.int64), np.concatenate([text, text[1:][within]])

    def repeated(self) -> list[int]:
        """Each text's words inside three-word windows that it has twice."""
        ids, out, lo = self.ids, [], 0
        if len(self.words) < 1 << 21:
            windows = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
        else:  # three numbers do not fit together: pairs are numbered first
            _, pair = np.unique(ids[:-1] * len(self.words) + ids[1:], return_inverse=True)
            _, windows = np.unique(np.stack([pair[:-1], ids[2:]]), axis=1, return_inverse=True)
        for hi in self.ends.tolist():
            n, own = 0, windows[lo:hi - 2] if hi - lo > 3 else windows[:0]
            order = np.sort(own)
            if (twice := order[1:] == order[:-1]).any():
                often, inside = np.isin(own, order[1:][twice]), np.zeros(hi - lo, bool)
                for k in range(3):
                    inside[k:k + len(own)] |= often
                n = int(inside.sum())
            out.append(n)
            lo = hi
        return out


def bits_for(grams: int) -> int:
    """Bits of the number of buckets for so many n-grams."""
    return min(max((grams // PER_BUCKET).bit_length() - 1, BUCKET_BITS), MOST_BITS)


def _cache():
    return per_worker("words", "quality", lambda: WordCache(_token_hashes, 32 << 20))


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    some = Slice([text])
    return len(some.ids), *_char_counts(text), some.repeated()[0]


def _char_counts(text: bytes) -> tuple[int, int, int]:
    """word_chars, n_symbols, n_dup_lines."""
    chars = len(text.translate(None, _NO_WORD_CHAR))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return chars, symbols, len(lines) - len(set(lines))


def trusted_ids(labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality") -> DataFrame:
    """Ids whose labels all say good quality."""
    return (labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id"))
            .agg(F.min(F.coalesce(F.col(quality).cast("int"), F.lit(0))).alias("good")).where("good = 1").select("doc_id"))


def _packed(counts: np.ndarray) -> bytes:
    """Counts, not negative, in the narrowest type that holds them."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0)))).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // BLOCK}").astype(np.int64)


def fit(df: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text") -> np.ndarray:
    """The log ratio of each bucket, from all of ``df`` and the trusted ids
    (one column ``doc_id``).  Tasks add up their n-grams in ``2 ** MOST_BITS``
    buckets and hand them on in packed blocks, one row for ``BLOCK`` buckets;
    the blocks' sums are a table, and at most so many ratios of 4 bytes come to
    the driver.  Texts stay where they are: the trusted ids are broadcast up to
    ``BROADCAST_IDS``, and only beyond that joined by a shuffle."""
    spark = df.sparkSession
    ship_package(spark)
    ids = staged(trusted.select(F.col("doc_id").alias("_rs_t")), "trusted")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    given = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("t"))
    marked = (given.join(ids, F.col("doc_id") == F.col("_rs_t"), "left")
              .select("t", F.col("_rs_t").isNotNull().alias("good")))
    blocks = (1 << MOST_BITS) // BLOCK

    def run(batches):
        sums = np.zeros((2, 1 << MOST_BITS), np.uint32)
        held, most = 0, 1 << 31

        def packed():
            rows = sums.reshape(2, blocks, BLOCK)
            used = np.flatnonzero(rows[0].any(axis=1))
            yield from (pa.RecordBatch.from_arrays(
                [pa.array([b], pa.int32()), pa.array([_packed(rows[0, b])], pa.binary()), pa.array([_packed(rows[1, b])], pa.binary())],
                names=["block", "raw", "good"]) for b in used.tolist())

        for batch in batches:
            for lo, hi in slices(batch.column(0)):
                part = batch.slice(lo, hi - lo)
                at, text = Slice([t or b"" for t in part.column(0).to_pylist()]).buckets(MOST_BITS)
                if held + len(at) >= most:  # no count gets beyond its type
                    yield from packed()
                    sums[:], held = 0, 0
                held += len(at)
                good = at[part.column(1).to_numpy(zero_copy_only=False).astype(bool)[text]]
                for own, some in zip(sums, (at, good)):
                    np.add.at(own, some, np.uint32(1))
        yield from packed()

    def add(batches):
        """Sums of the blocks of a partition: at most all blocks, 64 MB."""
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw, good in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if block not in sums:
                    sums[block] = np.zeros((2, BLOCK), np.int64)
                sums[block][0] += _unpacked(raw.as_py())
                sums[block][1] += _unpacked(good.as_py())
        for block, both in sums.items():
            totals = both.sum(axis=1).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in both),
                                              *(pa.array([n], pa.int64()) for n in totals)], names=["block", "raw", "good", "n_raw", "n_good"])

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = staged(marked.mapInArrow(run, "block int, raw binary, good binary").repartition(tasks, "block")
                    .mapInArrow(add, "block int, raw binary, good binary, n_raw long, n_good long"), "quality")
    total = counts.agg(F.sum("n_raw").alias("raw"), F.sum("n_good").alias("good")).first()
    bits = bits_for(total.raw or 0)
    if not total.good:
        return np.zeros(1 << bits, np.float32)
    n_raw, n_good, fold = total.raw, total.good, 1 << MOST_BITS - bits

    def ratio(batches):
        for batch in batches:
            made = []
            for raw, good in zip(batch.column(1), batch.column(2)):
                raw, good = (np.frombuffer(c.as_py(), "<i8").reshape(-1, fold).sum(axis=1) for c in (raw, good))
                made.append(_log_ratio(raw, good, n_raw, n_good, bits).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["block", "ratio"])

    ratios = np.full((blocks, BLOCK // fold), _log_ratio(0, 0, n_raw, n_good, bits), np.float32)
    for r in counts.select("block", "raw", "good").mapInArrow(ratio, "block int, ratio binary").toLocalIterator():
        ratios[r.block] = np.frombuffer(bytes(r.ratio), np.float32)
    return ratios.ravel()


def _log_ratio(raw, good, n_raw: int, n_good: int, bits: int) -> np.ndarray:
    share = lambda n, of: np.log((n + PRIOR) / (of + PRIOR * (1 << bits)))
    return np.float32(share(good, n_good) - share(raw, n_raw))


def score(df: DataFrame, ratios: np.ndarray, doc_id: str = "doc_id", text: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``df``: doc_id, the base counts, base_failed, score
    (mean log ratio of the text's n-grams) and kept."""
    model = df.sparkSession.sparkContext.broadcast(ratios)  # at most 2 ** MOST_BITS floats
    bits = len(ratios).bit_length() - 1
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def make_kernel():
        ratio = model.value

        def kernel(texts: list) -> list:
            texts = [t or b"" for t in texts]
            some = Slice(texts)
            at, text = some.buckets(bits)
            n = np.bincount(text, minlength=len(texts))
            means = np.bincount(text, ratio[at], len(texts)) / np.maximum(n, 1)
            return [np.diff(some.ends, prepend=0).tolist(), *(list(c) for c in zip(*map(_char_counts, texts))), some.repeated(), means.tolist()]
        return kernel

    scored = map_texts(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("_rs_text")), "_rs_text",
                       make_kernel, [*(T.StructField(c, T.LongType()) for c in counts), T.StructField("score", T.DoubleType())])
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))

"""Token counts through a digest cache.

The cache is a Parquet table (content digest, tokenizer digest, count) in a
folder that all executors see.  Documents are joined to it by the digest of
their normalised content and the digest of the tokenizer version; only
distinct contents without an entry are encoded, and their counts appended.

Digests are grouped and held against the cache first, without texts, and name
one row for each distinct miss.  Without a miss no text is read again.  Up to
``BROADCAST_MISSES`` misses their names are broadcast and the texts encoded
where they lie; only beyond that are texts moved to be matched.

Defined results: a null text counts as empty (0 tokens); equal texts are
encoded once and share a count; repeated rows each get a result row; an empty
table gives an empty result and leaves the cache as it is; no other input
column is read, so names cannot clash.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, per_worker, staged, text_or_empty

#: Misses (a digest and an id) whose names are broadcast at most.
BROADCAST_MISSES = 1 << 19
CACHE_SCHEMA = T.StructType([T.StructField("content", T.BinaryType()),
                             T.StructField("tokenizer", T.BinaryType()),
                             T.StructField("n_tokens", T.LongType())])


def tokenizer_digest(path: str) -> bytes:
    """SHA-256 of the vocabulary file and of the library version that reads it."""
    import sentencepiece
    import tokenizers
    version = sentencepiece.__version__ if path.endswith(".model") else tokenizers.__version__
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"\0" + version.encode()).digest()


def _load(path: str):
    """A function from texts to their token counts, by the file's library."""
    if path.endswith(".model"):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


def content_digest(text: str, normalise=None) -> Column:
    """SHA-256 of the normalised content.  ``normalise`` (a function from
    column to column) must not change a count: the default leaves texts as
    they are, null being empty, since byte-level vocabularies tell all
    strings apart."""
    c = text_or_empty(text)
    return F.unhex(F.sha2((normalise(c) if normalise else c).cast("binary"), 256))


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The cache's entries; none where nothing was stored yet."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(cache)
    if not folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache)


def fill_cache(df: DataFrame, path: str, cache: str, doc_id: str = "doc_id", text: str = "text",
               normalise=None) -> None:
    """Encode each distinct content without an entry and append its count."""
    keyed = staged(df.select(F.col(f"`{doc_id}`").alias("doc_id"), content_digest(text, normalise).alias("content")), "digests")
    _fill(df, keyed, path, cache, doc_id, text, normalise)


def _fill(df: DataFrame, digests: DataFrame, path: str, cache: str, doc_id: str, text: str, normalise) -> None:
    spark, version = df.sparkSession, tokenizer_digest(path)
    known = read_cache(spark, cache).where(F.col("tokenizer") == F.lit(version)).select("content").distinct()
    missing = staged(digests.groupBy("content").agg(F.min("doc_id").alias("_rs_first"))
                     .join(known, "content", "left_anti"), "misses")
    misses = missing.count()
    if not misses:
        return
    keyed = df.select(F.col(f"`{doc_id}`").alias("_rs_id"), F.col(f"`{text}`").alias("_rs_text"),
                      content_digest(text, normalise).alias("content"))
    missing = F.broadcast(missing) if misses <= BROADCAST_MISSES else missing
    named = (keyed.alias("k").join(
        missing.alias("m"),
        (F.col("k.content") == F.col("m.content")) & F.col("k._rs_id").eqNullSafe(F.col("m._rs_first")), "left_semi")
        .select("content", "_rs_text"))

    def make_kernel():
        count = per_worker("counts", path, lambda: _load(path))

        def kernel(texts: list) -> list:
            seen: dict[bytes, int] = {}
            fresh = list(dict.fromkeys(t or b"" for t in texts))
            seen.update(zip(fresh, count([t.decode("utf-8", "replace") for t in fresh])))
            return [[seen[t or b""] for t in texts]]
        return kernel

    counted = map_texts(named, "_rs_text", make_kernel, [T.StructField("n_tokens", T.LongType())], ["content"])
    # Rows that share the first id and the content meet here, as digests only.
    (counted.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
     .select("content", F.lit(version).alias("tokenizer"), "n_tokens")
     .write.mode("append").parquet(cache))


def count_tokens(df: DataFrame, path: str, cache: str, doc_id: str = "doc_id", text: str = "text",
                 normalise=None) -> DataFrame:
    """One row per row of ``df``: ``doc_id``, ``n_bytes`` (UTF-8) and
    ``n_tokens``, the counts taken from the cache after filling it."""
    spark = df.sparkSession
    # The digests are kept: the texts are read for them once.
    keyed = staged(df.select(F.col(f"`{doc_id}`").alias("doc_id"),
                             F.octet_length(text_or_empty(text)).cast("long").alias("n_bytes"),
                             content_digest(text, normalise).alias("content")), "digests")
    _fill(df, keyed, path, cache, doc_id, text, normalise)
    # Kept, so that the join reads it plainly and can split a hot content's rows.
    stored = staged(read_cache(spark, cache).where(F.col("tokenizer") == F.lit(tokenizer_digest(path)))
                    .groupBy("content").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    return keyed.join(stored, "content", "left").select("doc_id", "n_bytes", "n_tokens")

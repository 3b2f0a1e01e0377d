"""Readers and writers for the retrieval file layouts.

Layouts are Spark-native: a "file" of the source layout is a folder of part
files, and per-language files are ``partitionBy('lang')`` folders, so a
language filter prunes partitions instead of opening one file per language.
Schemas are always explicit (no inference), ids are strings.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordering import head_n
from .quoted import read_records

S = T.StringType()

TRIPLET_FILE_COLUMNS = {"query": "query_text", "positive_passage": "gold_passage",
                        "negative_passage": "hard_negative"}
# Whitespace inside values is data: the CSV writer trims it by default.
_CSV = {"sep": "\t", "escape": '"', "quote": '"', "multiLine": "true",
        "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _schema(names: Sequence[str], types: dict | None = None) -> T.StructType:
    types = types or {}
    return T.StructType([T.StructField(n, types.get(n, S)) for n in names])


# --- triplets --------------------------------------------------------------------------

def write_triplets(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Triplets as parquet (canonical) or as a quoted TSV with the source
    header ``query, positive_passage, negative_passage``."""
    if fmt == "parquet":
        df.write.mode(mode).parquet(path)
        return
    back = {v: k for k, v in TRIPLET_FILE_COLUMNS.items()}
    out = df.select(*[F.col(c).alias(back.get(c, c)) for c in df.columns])
    out.write.mode(mode).options(**_CSV, header="true", quoteAll="true").csv(path)


def read_triplets(spark: SparkSession, path: str, n: int | None = None, order: Sequence | None = None,
                  fmt: str = "tsv") -> DataFrame:
    """Triplet TSV (header) -> ``query_text, gold_passage, hard_negative``;
    ``n`` keeps the first ``n`` rows by ``order`` (default: the triplet)."""
    if fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        df = read_records(spark, path, list(TRIPLET_FILE_COLUMNS), header=True).withColumnsRenamed(TRIPLET_FILE_COLUMNS)
    if n is not None:
        df = head_n(df, n, list(order) if order else ["query_text", "gold_passage", "hard_negative"])
    return df


# --- BEIR layout (queries / corpus / qrels per language) ---------------------------------

QUERY_SCHEMA = _schema(["_id", "text"])
CORPUS_SCHEMA = _schema(["_id", "title", "text"])
QREL_SCHEMA = _schema(["query-id", "corpus-id", "score"], {"score": T.IntegerType()})


def write_beir(queries: DataFrame, corpus: DataFrame, qrels: DataFrame, root: str, split: str = "test",
               mode: str = "overwrite") -> None:
    """``root/queries.jsonl``, ``root/corpus.jsonl`` (JSON lines) and
    ``root/qrels/{split}.tsv`` (TSV with header), each partitioned by
    ``lang``.  Inputs use ``query_id / corpus_id`` names; files use the
    source names ``_id``, ``query-id``, ``corpus-id``."""
    queries.select(F.col("query_id").alias("_id"), "text", "lang") \
        .write.mode(mode).partitionBy("lang").json(f"{root}/queries.jsonl")
    corpus.select(F.col("corpus_id").alias("_id"), "title", "text", "lang") \
        .write.mode(mode).partitionBy("lang").json(f"{root}/corpus.jsonl")
    qrels.select(F.col("query_id").alias("query-id"), F.col("corpus_id").alias("corpus-id"), "score", "lang") \
        .write.mode(mode).partitionBy("lang").options(sep="\t", header="true").csv(f"{root}/qrels/{split}.tsv")


def _with_lang(schema: T.StructType) -> T.StructType:
    return T.StructType(schema.fields + [T.StructField("lang", S)])


def read_beir(spark: SparkSession, root: str, lang: str | None = None,
              split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, corpus, qrels) with ``query_id / corpus_id`` names and a
    ``lang`` column; ``lang`` prunes to one language partition."""
    q = spark.read.schema(_with_lang(QUERY_SCHEMA)).json(f"{root}/queries.jsonl") \
        .select(F.col("_id").alias("query_id"), "text", "lang")
    c = spark.read.schema(_with_lang(CORPUS_SCHEMA)).json(f"{root}/corpus.jsonl") \
        .select(F.col("_id").alias("corpus_id"), "title", "text", "lang")
    r = spark.read.schema(_with_lang(QREL_SCHEMA)).options(sep="\t", header="true") \
        .csv(f"{root}/qrels/{split}.tsv") \
        .select(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("corpus_id"), "score", "lang")
    if lang is not None:
        q, c, r = (x.filter(F.col("lang") == lang) for x in (q, c, r))
    return q, c, r


def read_beir_multilang(spark: SparkSession, root: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """All languages in one read; a language missing any of the three files
    is dropped from all three.  The languages are those of the file listing,
    so unused partitions are pruned and nothing is scanned to find them."""
    parts = [{n.removeprefix("lang=") for n in list_names(spark, p) if n.startswith("lang=")}
             for p in (f"{root}/queries.jsonl", f"{root}/corpus.jsonl", f"{root}/qrels/{split}.tsv")]
    langs = sorted(set.intersection(*parts) - {"__HIVE_DEFAULT_PARTITION__"})
    return tuple(x.filter(F.col("lang").isin(langs)) for x in read_beir(spark, root, None, split))


# --- headerless / qrels TSV ---------------------------------------------------------------

def read_headerless_tsv(spark: SparkSession, path: str, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Headerless TSV with given column names.  Lines with more fields than
    names are malformed: returned separately, as ``(line, fields)`` (the reader
    warns and skips them); lines with fewer fields get nulls.  Fields are
    counted on the line itself, since an empty value too many is null when read."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("line")).filter(F.col("line") != "")
    # Tabs outside quotes: every second piece between quotes lies outside.
    outside = F.filter(F.split("line", '"', -1), lambda x, i: i % 2 == 0)
    told = lines.withColumn("fields", F.length(F.regexp_replace(F.array_join(outside, ""), "[^\t]", "")) + 1)
    schema = ", ".join(f"`{c}` string" for c in names)
    ok = told.filter(F.col("fields") <= len(names)).select(
        F.from_csv("line", schema, {"sep": "\t", "quote": '"', "escape": '"'}).alias("r")).select("r.*")
    return ok, told.filter(F.col("fields") > len(names))


def headerless_rejects(bad: DataFrame) -> DataFrame:
    """``(fields, n, line)``: how many lines had so many fields, and one of them."""
    return bad.groupBy("fields").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("line"))


def split_qrels(lines: DataFrame) -> DataFrame:
    """``value`` lines -> ``(query_id, corpus_id, score, line, reason)``, each
    line by its own shape: ``q c`` (score 1), ``q c s``, or TREC ``q 0 c s``
    (dummy dropped).  ``reason`` is null for a good line."""
    parts = F.split(F.rtrim(F.col("value"), F.lit("\r\n")), "\t")
    n, at = F.size("_p"), lambda i: F.try_element_at(F.col("_p"), F.lit(i))
    given = F.when(n == 2, F.lit("1")).when(n == 3, at(3)).when(n == 4, at(4))
    d = lines.select("value", parts.alias("_p")).select(
        "value", n.alias("_n"), at(1).alias("query_id"), F.when(n == 4, at(3)).otherwise(at(2)).alias("corpus_id"),
        F.when(F.trim(given) == "", F.lit("1")).otherwise(given).alias("_s"))
    score = F.expr("try_cast(_s AS INT)")
    why = F.when(~F.col("_n").between(2, 4), F.concat(F.col("_n"), F.lit(" fields"))) \
        .when((F.col("query_id") == "") | (F.col("corpus_id") == ""), F.lit("empty id")) \
        .when(score.isNull(), F.lit("score is no integer"))
    return d.select("query_id", "corpus_id", score.alias("score"), F.col("value").alias("line"), why.alias("reason"))


def normalize_qrels(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """2-, 3- or 4-column qrels TSV -> ``(query_id, corpus_id, score)``; lines
    of different shapes may be mixed.  With ``header`` the first line of each
    file is skipped.  Bad and blank lines are left out: see ``rejected_qrels``."""
    return _qrels(spark, path, header).filter(F.col("reason").isNull()).select("query_id", "corpus_id", "score")


def rejected_qrels(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """Lines that ``normalize_qrels`` leaves out: ``(reason, n, line)``, with
    their count and one of them."""
    bad = _qrels(spark, path, header).filter(F.col("reason").isNotNull())
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("line"))


def _qrels(spark: SparkSession, path: str, header: bool) -> DataFrame:
    lines = spark.read.options(header=str(header).lower(), sep="\u0001", quote="", escape="").schema("value string").csv(path) \
        if header else spark.read.text(path)
    return split_qrels(lines.filter(F.trim("value") != ""))


def read_tsv_eval_sources(spark: SparkSession, queries_path: str, corpus_path: str,
                          qrels_path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Headerless 3-column TSVs with string ids: queries (query_id, title,
    query_text), corpus (corpus_id, title, passage), qrels (query_id,
    corpus_id, score)."""
    return (read_records(spark, queries_path, ["query_id", "title", "query_text"]),
            read_records(spark, corpus_path, ["corpus_id", "title", "passage"]),
            read_records(spark, qrels_path, ["query_id", "corpus_id", "score"]))


# --- other sinks ---------------------------------------------------------------------------

def write_scored_and_selected(scored: DataFrame, root: str, choose: Callable[[DataFrame], DataFrame]) -> tuple[str, str]:
    """All scored rows and the rows that ``choose`` selects of them as two
    parquet tables.  The scored rows are evaluated once: the selection, with
    its threshold, reads what was written."""
    everything, selected = f"{root}/all_ranked_with_scores", f"{root}/selected_high_quality"
    scored.write.mode("overwrite").parquet(everything)
    choose(scored.sparkSession.read.schema(scored.schema).parquet(everything)).write.mode("overwrite").parquet(selected)
    return everything, selected


def metrics_to_json(long: DataFrame, keys: Sequence[str] = ("setting", "model")) -> DataFrame:
    """Long ``(keys..., metric, value)`` -> one JSON document per key tuple
    (``{metric: value}``); nesting is only built at the sink."""
    return long.groupBy(*keys).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("metric", "value")))).alias("metrics"))


def write_metrics_json(long: DataFrame, path: str, keys: Sequence[str] = ("setting", "model")) -> None:
    metrics_to_json(long, keys).coalesce(1).write.mode("overwrite").json(path)


def _at(spark: SparkSession, path: str):
    """The path and its file system, of the session's Hadoop settings."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def list_names(spark: SparkSession, path: str, hidden: bool = False) -> list[str]:
    """Names in a folder, none if it is absent; hidden and marker files are
    left out unless asked for."""
    return [n for n, _ in list_sizes(spark, path, hidden)]


def list_sizes(spark: SparkSession, path: str, hidden: bool = False) -> list[tuple[str, int]]:
    """Names in a folder with their bytes, by name."""
    p, fs = _at(spark, path)
    if not fs.exists(p):
        return []
    found = sorted((f.getPath().getName(), f.getLen()) for f in fs.listStatus(p))
    return [(n, size) for n, size in found if hidden or not n.startswith(("_", "."))]


def path_exists(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all: written aside, then renamed."""
    p, fs = _at(spark, path)
    aside, _ = _at(spark, f"{path}._writing")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(p, False)
    if not fs.rename(aside, p):
        raise OSError(f"{path} could not be written")


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    """A folder that this library wrote, with what is in it."""
    p, fs = _at(spark, path)
    fs.delete(p, True)


def table_digest(df: DataFrame) -> tuple[int, str]:
    """Number of rows and a digest of their values that no order changes."""
    parts = [x for c in df.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    half = lambda s: F.sum(F.xxhash64(F.lit(s), *parts).bitwiseAND(0x7FFFFFFF))
    r = df.agg(F.count(F.lit(1)).alias("n"), half(1).alias("a"), half(2).alias("b")).first()
    return r.n, f"{r.a or 0:x}-{r.b or 0:x}"


def eval_cache(spark: SparkSession, path: str, build, partition_by: Sequence[str] = ("setting", "lang"),
               setting: str = "", source: DataFrame | None = None) -> DataFrame:
    """The evaluation table of ``setting`` built from ``source``: read if the
    cache at ``path`` has it for as many input rows with the same digest, else
    built, written (partitioned) and read back.  The manifest is written after
    the table, so a half-written one is never read; what the same setting had
    for another input is stale and goes."""
    rows, digest = table_digest(source) if source is not None else (None, None)
    key = {"setting": setting, "rows": rows, "digest": digest}
    name = hashlib.md5(json.dumps(key).encode()).hexdigest()
    entry, manifest = f"{path}/entry={name}", f"{path}/_entry-{name}.json"
    if not path_exists(spark, manifest):
        build().write.mode("overwrite").partitionBy(*partition_by).parquet(entry)
        stale = [n for n in list_names(spark, path, hidden=True) if n.startswith("_entry-")]
        write_text(spark, manifest, json.dumps(key))
        for other in stale:
            if json.loads(read_text(spark, f"{path}/{other}"))["setting"] == setting:
                remove(spark, f"{path}/{other}")
                remove(spark, f"{path}/entry={other.removeprefix('_entry-').removesuffix('.json')}")
    return spark.read.parquet(entry)


def write_eval_csv_by_lang(df: DataFrame, path: str, partition_by: Sequence[str] = ("setting", "lang")) -> DataFrame:
    """One CSV folder per (setting, language) and the row counts (the
    metadata record) computed from the same data."""
    how = {**_CSV, "sep": ",", "header": "true"}
    df.write.mode("overwrite").partitionBy(*partition_by).options(**how).csv(path)
    # Counted from what was written, so the input is evaluated once.
    names = [c for c in df.columns if c not in partition_by]
    back = read_records(df.sparkSession, path, names, sep=",", header=True, partitions=partition_by)
    return back.groupBy(*partition_by).agg(F.count(F.lit(1)).alias("rows"))


def write_vectors(df: DataFrame, path: str, vec: str = "embedding") -> None:
    """Passages with float32 vectors as parquet ``array<float>``, plus a
    one-row metadata table (size, dimension)."""
    df.withColumn(vec, F.col(vec).cast("array<float>")).write.mode("overwrite").parquet(f"{path}/vectors")
    # From what was written, so the encoder runs once.
    df.sparkSession.read.parquet(f"{path}/vectors").agg(
        F.count(F.lit(1)).alias("corpus_size"), F.max(F.size(vec)).alias("dim")) \
        .write.mode("overwrite").parquet(f"{path}/metadata")

"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranksmith.session import shared_dir, ship_package

#: Words are runs of characters other than these (space, tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"
WHITE_SPACE = " \t\n\x0b\x0c\r"
#: Texts are handed to a kernel in slices of about this many bytes.
SLICE_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the cluster's shared folder and read back: the
    lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def without_white_space(text: Column) -> Column:
    """``text`` after deleting every character of ``WHITE_SPACE``."""
    for c in WHITE_SPACE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def row_digest(df: DataFrame, names: tuple[str, str] = ("rd1", "rd2")) -> list[Column]:
    """Two 64-bit digests of all columns of a row, nulls told from values."""
    parts: list[Column] = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            c = F.to_json(F.struct(c))
        parts += [c.isNull(), c]
    return [F.xxhash64(F.lit(i), *parts).alias(n) for i, n in enumerate(names)]


def keep_rows(df: DataFrame, winners: DataFrame) -> DataFrame:
    """Rows of ``df`` whose digest is in ``winners`` (rd1, rd2), each distinct
    row once.  The rows move once: the semi-join and the removal of repeated
    rows share one partitioning."""
    keyed = df.select("*", *row_digest(df, ("_rs_rd1", "_rs_rd2")))
    won = winners.select(F.col("rd1").alias("_rs_rd1"), F.col("rd2").alias("_rs_rd2")).distinct()
    return (keyed.join(won, ["_rs_rd1", "_rs_rd2"], "left_semi")
            .dropDuplicates(["_rs_rd1", "_rs_rd2"])
            .select(*[f"`{c}`" for c in df.columns]))


def slices(col: pa.Array) -> Iterator[tuple[int, int]]:
    lo, held = 0, 0
    for i in range(len(col)):
        v = col[i]
        held += len(v.as_buffer()) if v.is_valid else 0
        if held >= SLICE_BYTES:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(col):
        yield lo, len(col)


Kernel = Callable[[list], list]


def map_texts(df: DataFrame, text: str, make_kernel: Callable[[], Kernel],
              fields: list[T.StructField], keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``df`` (default: all but ``text``) plus ``fields``,
    which a kernel computes from the texts.

    ``make_kernel`` runs once a task; the kernel gets lists of UTF-8 bytes
    (null texts: ``None``) of about ``SLICE_BYTES`` and returns one Arrow array
    or list for each field.  A kernel that returns ``None`` in place of its
    first result drops the rows (see ``filter_texts``)."""
    ship_package(df.sparkSession)
    keep = [c for c in df.columns if c != text] if keep is None else keep
    given = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("binary").alias("_rs_text"))
    schema = T.StructType([*given.schema.fields[:-1], *fields])
    names, n = [f.name for f in schema.fields], len(keep)
    types = [_ARROW[type(f.dataType)] for f in fields]

    def run(batches):
        kernel = make_kernel()
        for batch in batches:
            texts = batch.column(n)
            for lo, hi in slices(texts):
                part = batch.slice(lo, hi - lo)
                made = kernel(part.column(n).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(n)),
                     *(m if isinstance(m, pa.Array) else pa.array(m, t) for m, t in zip(made, types, strict=True))],
                    names=names)

    return given.mapInArrow(run, schema)


def filter_texts(df: DataFrame, text: str, make_kernel: Callable[[], Callable[[list], list]]) -> DataFrame:
    """Rows of ``df``, whole, whose text the kernel maps to true; the rows
    never leave their partition."""
    ship_package(df.sparkSession)
    at = df.columns.index(text)

    def run(batches):
        kernel = make_kernel()
        for batch in batches:
            for lo, hi in slices(batch.column(at).cast(pa.binary())):
                part = batch.slice(lo, hi - lo)
                yield part.filter(pa.array(kernel(part.column(at).cast(pa.binary()).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


_ARROW = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(),
          T.StringType: pa.string(), T.BooleanType: pa.bool_(), T.BinaryType: pa.binary()}


class WordCache(dict):
    """word -> packed value, filled by ``make`` on a miss.

    Holds about ``2 * held`` bytes: when words of ``held`` bytes have come in,
    the older half is let go, except for words asked for again meanwhile."""

    #: Bytes that an entry takes beside the content of its word and value.
    ENTRY = 180

    def __init__(self, make: Callable[[bytes], bytes], held: int = 20 << 20):
        super().__init__()
        self.make, self.held, self.now, self.old = make, held, 0, {}

    def __missing__(self, word):
        got = self.old.get(word)
        if got is None:
            got = self.make(word)
        self._take(word, got)
        return got

    def _take(self, word, got) -> None:
        if len(word) <= 64:
            if self.now >= self.held:
                self.old, self.now = dict(self), 0
                self.clear()
            self.now += self.ENTRY + len(word) + len(got)
            self[word] = got


_KEPT: dict = {}


def per_worker(kind: str, key, make: Callable[[], object]):
    """``make()``, kept for later tasks of this Python worker until another
    ``key`` of the ``kind`` takes its place.  All objects with word caches are
    of one kind, so a worker holds one operator's at a time."""
    if kind not in _KEPT or _KEPT[kind][0] != key:
        _KEPT.pop(kind, None)
        _KEPT[kind] = key, make()
    return _KEPT[kind][1]

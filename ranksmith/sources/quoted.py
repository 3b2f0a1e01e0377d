"""Quoted delimited text, read in parallel.

A quoted value may hold line breaks, so a line may start inside a value, and
whether it does depends on everything before it in the file.  Spark's
``multiLine`` reader therefore takes a file in one task.  Here a file is read
by byte ranges, as plain lines: each line maps the state it starts in (outside
or inside a quoted value) to the state it ends in; within a range these maps
are composed along the lines, across ranges by one row a range, and every
line then knows its own state.  Lines that are whole records stay as they are,
only the lines of records with line breaks are brought together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import staged


def _ends_inside(line: Column, start: int, sep: str, quote: str) -> Column:
    """1 if a line that starts outside (``start`` 0) or inside (1) a quoted
    value ends inside one.  A value is quoted if it begins with the quote, and
    is closed by an odd number of further quotes (a doubled one is a quote)."""
    quotes = lambda x: F.length(x) - F.length(F.replace(x, F.lit(quote), F.lit("")))
    even = lambda n: (n % 2 == 0).cast("int")
    fields = F.split(line, f"[{sep}]", -1)
    return F.aggregate(fields, F.lit(start), lambda inside, x: F.when(inside == 1, even(quotes(x)))
                       .when(x.startswith(quote), even(quotes(x) - 1)).otherwise(F.lit(0)))


def _composed(after0: Column, after1: Column, along) -> tuple[Column, Column]:
    """Composition of state maps along a window: the number of flips so far,
    and, from the last map that forgets its start, its end plus the flips up
    to there.  ``_state`` reads them."""
    flips = F.sum(F.when((after0 == 1) & (after1 == 0), 1).otherwise(0)).over(along)
    kept = F.when(after0 == after1, (after0 + flips) % 2)
    return flips, F.last(kept, ignorenulls=True).over(along)


def _state(start: Column, flips: Column, kept: Column) -> Column:
    return F.when(kept.isNotNull(), (kept + flips) % 2).otherwise((start + flips) % 2)


def read_records(spark: SparkSession, path: str, names: Sequence[str], sep: str = "\t", header: bool = False,
                 quote: str = '"', partitions: Sequence[str] = ()) -> DataFrame:
    """String columns ``names`` (and the folders' ``partitions``) of a quoted
    delimited text, as the ``multiLine`` reader gives them: values keep their
    white space, unquoted empty values and missing ones are null, further
    values and blank lines are passed over; with ``header`` each file's first
    record is."""
    parts = list(partitions)
    plain = T.StructType([T.StructField(c, T.StringType()) for c in ["value", *parts]])
    lines = (spark.read.schema(plain).option("lineSep", "\n").text(path)
             .select("value", *parts, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("_line"))
             .withColumns({"_after0": _ends_inside(F.col("value"), 0, sep, quote), "_after1": _ends_inside(F.col("value"), 1, sep, quote)}))
    along = Window.partitionBy("_file", "_block").orderBy("_line")
    flips, kept = _composed(F.col("_after0"), F.col("_after1"), along.rowsBetween(Window.unboundedPreceding, 0))
    known = staged(lines.withColumns({"_flips": flips, "_kept": kept})
                   .withColumns({"_flips_before": F.coalesce(F.lag("_flips").over(along), F.lit(0)), "_kept_before": F.lag("_kept").over(along)}),
                   "lines")
    # One row a range: its map, composed along the file.
    ranges = known.groupBy("_file", "_block").agg(F.max_by(F.struct("_flips", "_kept"), "_line").alias("m"))
    end0, end1 = (_state(F.lit(s), F.col("m._flips"), F.col("m._kept")).cast("int") for s in (0, 1))
    file = Window.partitionBy("_file").orderBy("_block")
    r_flips, r_kept = _composed(F.col("_end0"), F.col("_end1"), file.rowsBetween(Window.unboundedPreceding, 0))
    starts = (ranges.select("_file", "_block", end0.alias("_end0"), end1.alias("_end1")).withColumns({"_f": r_flips, "_k": r_kept})
              .select("_file", "_block", F.coalesce(F.lag(_state(F.lit(0), F.col("_f"), F.col("_k"))).over(file), F.lit(0)).alias("_start")))
    told = (known.join(starts, ["_file", "_block"])
            .withColumns({"_inside": _state(F.col("_start"), F.col("_flips_before"), F.col("_kept_before")),
                          "_open": _state(F.col("_start"), F.col("_flips"), F.col("_kept"))}))
    first = told.withColumn("_nth", F.sum((F.col("_inside") == 0).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    counts = told.groupBy("_file", "_block").agg(F.count_if(F.col("_inside") == 0).alias("_records"))
    before = counts.select("_file", "_block", (F.sum("_records").over(file.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_records")).alias("_before"))
    numbered = first.join(before, ["_file", "_block"]).withColumn("_record", F.col("_before") + F.col("_nth"))
    whole = (F.col("_inside") == 0) & (F.col("_open") == 0)
    broken = (numbered.filter(~whole).groupBy("_file", "_record", *parts)
              .agg(F.sort_array(F.collect_list(F.struct("_block", "_line", "value"))).alias("ls"))
              .select("_record", F.array_join(F.transform("ls", lambda x: x["value"]), "\n").alias("value"), *parts))
    records = numbered.filter(whole).select("_record", "value", *parts).unionByName(broken)
    if header:
        records = records.filter(F.col("_record") > 1)
    records = records.withColumn("value", F.regexp_replace("value", "\r$", "")).filter(F.col("value") != "")
    schema = ", ".join(f"`{c}` string" for c in names)
    how = {"sep": sep, "quote": quote, "escape": quote, "multiLine": "true", "ignoreLeadingWhiteSpace": "false",
           "ignoreTrailingWhiteSpace": "false"}
    return records.select(F.from_csv("value", schema, how).alias("r"), *parts).select("r.*", *parts)

"""JSON array files of any size, each read by many tasks.

A file is read in pieces between commas, so Spark cuts it at any comma. Whether a comma parts two elements
depends on all text before it: whether a string is open, and how deep the nesting is. Each piece changes that
state in a known way for either start (outside or inside a string), and such changes compose: first within a
file split, then over one row per split. What is left is to put the pieces of an element together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from millrace.functions import jsonrow
from millrace.functions.text import plain_text

BLANK = "[ \\t\\n\\r]*"
ESCAPE = r"(?s)\\."
STRING = r'"[^"]*+(?:"|\z)'


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _depth(text: Column) -> Column:
    """Brackets opened less brackets closed outside strings, for a text that starts outside one."""
    outside = F.regexp_replace(text, STRING, "")
    return _count(outside, "[{") - _count(outside, "]}")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Pieces with the state after them, for a split that starts outside (``_d0``) or inside (``_d1``) a string."""
    rows = spark.read.option("lineSep", ",").text(path).select(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_mark"), F.col("value").alias("_piece"),
    )
    clean = F.regexp_replace("_piece", ESCAPE, "")
    rows = rows.withColumns({"_quotes": _count(clean, '"'), "_from0": _depth(clean), "_from1": _depth(F.concat(F.lit('"'), clean))})
    split = Window.partitionBy("source", "_start").orderBy("_mark").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_odd", F.sum("_quotes").over(split) % 2 == 1)
    odd_before = F.col("_odd") != (F.col("_quotes") % 2 == 1)
    return rows.select(
        "source", "_start", "_mark", "_piece", "_odd",
        F.sum(F.when(odd_before, F.col("_from1")).otherwise(F.col("_from0"))).over(split).alias("_d0"),
        F.sum(F.when(odd_before, F.col("_from0")).otherwise(F.col("_from1"))).over(split).alias("_d1"),
    )


def _carried(splits: DataFrame) -> DataFrame:
    """The state before each split; one row per split."""
    file = Window.partitionBy("source").orderBy("_start")
    earlier = file.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(F.col("_odd").cast("int")).over(earlier), F.lit(0)) % 2 == 1
    splits = splits.withColumns({"_inside": inside, "_array": F.first("_head").over(file) == "["})
    step = F.when(F.col("_inside"), F.col("_d1")).otherwise(F.col("_d0"))
    return splits.withColumn("_base", F.coalesce(F.sum(step).over(earlier), F.lit(0))).select("source", "_start", "_inside", "_array", "_base")


def array_units(spark: SparkSession, path: str, settle) -> DataFrame:
    """``(source, unit_idx, unit)``: the elements of each file's array as they stand, else the file's one value.

    ``settle`` writes a table and reads it back (``millrace.session.settle``). A file that is no valid JSON
    fails the job, an empty array gives no rows. Only an element must fit into a cell, not the file.
    """
    pieces = settle(_pieces(spark, path), "pieces")
    carried = _carried(pieces.groupBy("source", "_start").agg(
        *[F.max_by(c, "_mark").alias(c) for c in ("_odd", "_d0", "_d1")],
        F.min_by(F.substring(F.ltrim(F.translate("_piece", "\t\n\r", "   ")), 1, 1), "_mark").alias("_head"),
    ))
    placed = pieces.join(carried, ["source", "_start"])
    depth = F.col("_base") + F.when(F.col("_inside"), F.col("_d1")).otherwise(F.col("_d0"))
    ends = F.col("_array") & (F.col("_odd") == F.col("_inside")) & (depth == 1)  # the comma after the piece parts elements
    placed = settle(placed.select("source", "_start", "_mark", "_piece", "_array", ends.cast("long").alias("_ends")), "placed")
    file = Window.partitionBy("source").orderBy("_start")
    counts = placed.groupBy("source", "_start").agg(F.sum("_ends").alias("_n"), F.max_by("_ends", "_mark").alias("_open"))
    counts = counts.select(
        "source", "_start", F.coalesce(F.sum("_n").over(file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy("source")).alias("_last"),
        (F.max_by("_open", "_start").over(Window.partitionBy("source")) == 1).alias("_open"),  # the file ends within its array
    )
    split = Window.partitionBy("source", "_start").orderBy("_mark").rowsBetween(Window.unboundedPreceding, 0)
    numbered = placed.withColumn("_own", F.sum("_ends").over(split) - F.col("_ends")).join(counts, ["source", "_start"])
    units = numbered.withColumn("unit_idx", F.col("_before") + F.col("_own")).groupBy("source", "unit_idx").agg(
        F.array_sort(F.collect_list(F.struct("_start", "_mark", "_piece"))).alias("_parts"), F.first("_array").alias("_array"), F.first("_last").alias("_last"), F.first("_open").alias("_open"),
    )
    text = F.array_join(F.transform("_parts", lambda p: p["_piece"]), ",")
    first, last = F.col("_array") & (F.col("unit_idx") == 0), F.col("_array") & (F.col("unit_idx") == F.col("_last"))
    units = units.withColumn("_text", plain_text(text))
    open_end = F.col("_open") | (last & ~F.col("_text").rlike(rf"\]{BLANK}\z"))
    body = F.when(first, F.regexp_replace("_text", rf"\A{BLANK}\[", "")).otherwise(F.col("_text"))
    units = units.withColumn("_bad", open_end).withColumn("_text", body)
    body = F.when(last, F.regexp_replace("_text", rf"\]{BLANK}\z", "")).otherwise(F.col("_text"))
    units = units.withColumn("unit", F.btrim(body, F.lit(" \t\n\r"))).filter(~(first & last & ~F.col("_bad") & (F.col("unit") == "")))
    checked = jsonrow.with_value(units, "unit", "_value")
    bad = F.raise_error(F.lit("a source file is not valid JSON")).cast("string")
    unit = F.when(F.col("_bad") | F.col("_value").isNull(), bad).otherwise(F.col("unit"))
    return checked.select("source", "unit_idx", unit.alias("unit"), "_value")

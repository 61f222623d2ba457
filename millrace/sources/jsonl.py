"""JSON-lines files as numbered lines; validation and counts straight from files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from millrace.functions.text import is_blank, split_lines
from millrace.operators.datasets import classify_lines, verdicts
from millrace.sources.files import list_files, listing_bounds

# One small row per file split; beyond this many Spark picks the join itself.
BROADCAST_SPLITS = 100_000


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the file split they come from and their mark within the task.

    A split lies in one task and its marks grow by one per line, so the mark minus
    the split's first mark is the line's index in the split.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_mark"),
        F.col("value").alias("raw"),
    )


def _offsets(splits: DataFrame) -> DataFrame:
    """Lines before each split; one row per split."""
    earlier = Window.partitionBy("source").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    return splits.withColumn("_before", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)))


def check_suffix(path: str) -> None:
    if os.path.splitext(path.rstrip("/"))[1].lower() != ".jsonl":
        raise ValueError(f"a dataset is a .jsonl file or a folder with that suffix, not {path}")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(source, line_no, raw)``: every physical line of the files, numbered from 1."""
    lines = scan_lines(spark, path)
    splits = lines.groupBy("source", "_start").agg(
        F.min("_mark").alias("_first"), F.count(F.lit(1)).alias("_lines")
    )
    offsets = _offsets(splits).select("source", "_start", "_first", "_before")
    if listing_bounds(list_files(spark, path)) <= BROADCAST_SPLITS:
        offsets = F.broadcast(offsets)
    numbered = lines.join(offsets, ["source", "_start"])
    return numbered.select(
        "source", (F.col("_before") + F.col("_mark") - F.col("_first") + 1).alias("line_no"), "raw"
    )


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a dataset, blank ones left out; they keep their physical line number."""
    check_suffix(path)
    return read_lines(spark, path).filter(~is_blank(F.col("raw")))


def validate_files(spark: SparkSession, path: str) -> DataFrame:
    """One verdict per file, with physical error lines, in one scan.

    Lines are not numbered for it: only the first line of each status in each split
    is, from the few rows that the aggregation leaves.
    """
    check_suffix(path)
    marked = classify_lines(scan_lines(spark, path))
    found = marked.groupBy("source", "_start", "status").agg(
        F.count(F.lit(1)).alias("n"), F.min("_mark").alias("_mark")
    )
    split = Window.partitionBy("source", "_start")
    found = found.withColumns({"_first": F.min("_mark").over(split), "_lines": F.sum("n").over(split)})
    # lines before a split: what the earlier splits of the file hold, each status row one share
    earlier = Window.partitionBy("source").orderBy("_start").rangeBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    line = F.col("_before") + F.col("_mark") - F.col("_first") + 1
    positions = found.withColumn("_before", before).withColumn("line", line).groupBy("source", "status").agg(
        F.sum("n").alias("n"), F.min("line").alias("first_line")
    )
    return verdicts(positions)


def count_existing(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines of an output, whatever they hold: ``(existing)``."""
    lines = spark.read.text(path).select(F.explode(split_lines(F.col("value"))).alias("line"))
    return lines.agg(F.count_if(~is_blank(F.col("line"))).alias("existing"))

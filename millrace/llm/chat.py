"""Chat logs in which every request repeats the turns before it: keep the longest, render those.

Each turn is hashed with its place in the conversation; the hash of a prefix is the running
exclusive-or of its turns, so a prefix and a whole conversation compare by one equality. A
conversation that is a proper prefix of another one goes by an anti-join; of equal ones the
smallest id stays. The kept turns are rendered.

Places and running hashes are summed in two levels, by key range and then over the ranges of
a conversation, so a conversation with a third of all rows is no single task; shared
first turns meet only after they were made distinct on the map side. DataFrame functions
only. Rendered turns stay rows, as a conversation of any length then needs no cell of its size.

Defined results. Turns are ordered by turn number (nulls first), then by hash of role and
text; a repeated row is a turn of its own. A null role or text counts as empty. Rows with a
null id form one conversation. Empty table: empty result. Only the named columns are carried,
so others cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from millrace.session import settle


def number_turns(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """Every turn with ``position`` (from 1), its conversation's key ``_conv``, and the hashes
    ``_x1``, ``_x2`` of the prefix that it ends."""
    ranges = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns = conversations.select(
        F.coalesce(F.concat(F.lit("c"), F.col(key).cast("string")), F.lit("n")).alias("_conv"), F.col(key).alias(key), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).withColumns({"_h1": F.xxhash64("role", "text"), "_h2": F.xxhash64(F.lit("2"), "text", "role")})
    order = ["_conv", "turn", "_h1", "_h2"]
    turns = turns.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumns(
        {"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()}
    )
    turns = settle(turns, "turns")
    slim = turns.select("_conv", "_part", "_id", "_h1", "_h2")
    before = Window.partitionBy("_conv").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    here = Window.partitionBy("_conv", "_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = slim.groupBy("_conv", "_part").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("_conv", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    slim = slim.join(counts, ["_conv", "_part"]).withColumn("position", F.col("_before") + F.count(F.lit(1)).over(here))
    slim = slim.withColumns({"_h1": F.xxhash64("position", "_h1"), "_h2": F.xxhash64("position", "_h2")}).drop("_before")
    slim = settle(slim, "places")
    totals = slim.groupBy("_conv", "_part").agg(F.bit_xor("_h1").alias("a"), F.bit_xor("_h2").alias("b"))
    zero = F.lit(0).cast("long")
    totals = totals.select(
        "_conv", "_part", F.coalesce(F.bit_xor("a").over(before), zero).alias("a"), F.coalesce(F.bit_xor("b").over(before), zero).alias("b")
    )
    slim = slim.join(totals, ["_conv", "_part"]).select(
        "_id", "position", "_conv",
        F.col("a").bitwiseXOR(F.bit_xor("_h1").over(here)).alias("_x1"), F.col("b").bitwiseXOR(F.bit_xor("_h2").over(here)).alias("_x2"),
    )
    return turns.select("_id", key, "turn", "role", "text").join(slim, "_id")


def maximal(numbered: DataFrame, key: str = "conv_id") -> DataFrame:
    """(``_conv``, ``n_turns``, ``n_copies``) of conversations that prefix no longer one."""
    slim = numbered.select("_conv", key, "position", "_x1", "_x2")
    last = F.struct("position", "_x1", "_x2")
    whole = slim.groupBy("_conv").agg(F.max(last).alias("l"), F.min(key).alias(key))
    whole = whole.groupBy(F.col("l.position").alias("n"), F.col("l._x1").alias("a"), F.col("l._x2").alias("b")).agg(
        F.min(F.struct(key, "_conv")).alias("first"), F.count(F.lit(1)).alias("n_copies")
    )
    # A prefix is proper where a longer prefix of the same conversation exists: all but the last turn.
    ends = slim.groupBy("_conv").agg(F.max("position").alias("n_turns"))
    proper = slim.join(ends, "_conv").filter("position < n_turns").select(
        F.col("position").alias("n"), F.col("_x1").alias("a"), F.col("_x2").alias("b")
    ).distinct()
    return whole.join(proper, ["n", "a", "b"], "left_anti").select(F.col("first._conv").alias("_conv"), F.col("n").alias("n_turns"), "n_copies")


def render(role, text, open_mark: str = "<|", close_mark: str = "|>", end: str = "<|end|>"):
    return F.concat(F.lit(open_mark), role, F.lit(close_mark + "\n"), text, F.lit(end + "\n"))


def collapse_snapshots(conversations: DataFrame, key: str = "conv_id", **marks: str) -> DataFrame:
    """One row per turn of the kept conversations: key, ``position``, ``n_turns``, ``n_copies``
    and the rendered ``segment``; a conversation is its segments in order."""
    numbered = settle(number_turns(conversations, key), "numbered")
    return numbered.join(maximal(numbered, key), "_conv").select(
        key, "position", "n_turns", "n_copies", render(F.col("role"), F.col("text"), **marks).alias("segment")
    )

"""How five filters overlap: what each removes in every order, alone, and on average.

1. The text filters A to D are decided row by row; the rows go on without their texts.
2. Filter E is an existential self-join: a row fails it when a row with the same hash, the same text
   and a smaller key exists. Only texts whose hash occurs more than once take part, and the right side
   holds one row per different text with its smallest key, so a group of copies of any size costs
   one comparison a row and never meets itself.
3. The ids that fail E are united with the ids and bits of the other filters, and one aggregation
   gives each row its combination of bits.
4. Rows are counted by part and combination (32 at most a part); orders are worked out on those counts.

Only DataFrame operations. Data that are broadcast on purpose: the table of orders, 600 rows.

Defined results. Null text: as an empty one (fails A only, and E where another null or empty text has a
smaller key). Null part: the empty string. Null key: fails E never, has no label and is no
one's smaller key. Repeated rows: each counts; rows with the same key are no copies of each other. Labels
of a key given more than once: one with the value 1 suffices. Empty table: no rows. Only the named columns
are carried, so others cannot clash.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.session import settle

LETTERS = "ABCDE"
WORD_GAP = "[\\x20\\x09-\\x0D]+"
MARKS = "[#$%&*|]"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_UPPER_PERCENT = 2


def text_bits(text: Column) -> Column:
    """The bits of A to D that ``text`` (not null) fails, A as the lowest."""
    words = F.array_remove(F.split(text, WORD_GAP), "")
    n = F.size(words)
    fails = [
        n < MIN_WORDS,
        F.size(F.array_distinct(words)) * 100 < n * MIN_DISTINCT_PERCENT,
        F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * MAX_UPPER_PERCENT,
        text.rlike(MARKS),
    ]
    bits = F.lit(0)
    for i, fail in enumerate(fails):
        bits = bits + F.when(fail, 1 << i).otherwise(0)
    return bits


def later_copies(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(id, part, h) of the rows of ``rows`` (id, part, h, text) with an equal text under a smaller id.

    ``known`` has (id, h) of all rows. Texts move only if their hash occurs again.
    """
    again = known.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    copies = settle(rows.join(again, "h", "left_semi"), "copies")
    first = copies.groupBy(F.col("h").alias("first_h"), F.col("text").alias("first_text")).agg(F.min("id").alias("first_id"))
    earlier = (F.col("h") == F.col("first_h")) & (F.col("text") == F.col("first_text")) & (F.col("first_id") < F.col("id"))
    return copies.join(first, earlier, "left_semi").select("id", "part", "h")


def failing_bits(documents: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(id, part, bits, n): the filters that ``n`` equal rows fail, as bits, A to E from the lowest."""
    rows = documents.select(
        F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).withColumn("h", F.unhex(F.md5("text")))
    judged = settle(rows.select("id", "part", "h", text_bits(F.col("text")).alias("bits")), "judged")
    copies = settle(later_copies(rows, judged), "later")
    marks = judged.withColumn("n", F.lit(1)).unionByName(
        copies.withColumns({"bits": F.lit(1 << LETTERS.index("E")), "n": F.lit(0)})
    )
    return marks.groupBy("id", "part", "h").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n")).drop("h")


def combinations(bits: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(part, bits, n, n_good, n_toxic): rows by part and combination of failed filters."""
    marks = labels.groupBy(F.col(key).alias("id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    ).filter("good = 1 or toxic = 1")
    rows = bits.join(marks, "id", "left")
    return rows.groupBy("part", "bits").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("good") == 1, F.col("n")).otherwise(0)).alias("n_good"),
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("n_toxic"),
    )


def orders(spark) -> DataFrame:
    """(filter_order, step, bit, before) of all orders; ``before`` has the bits of the earlier filters."""
    rows = []
    for order in permutations(LETTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << LETTERS.index(letter)
            rows.append(f"('{''.join(order)}', {step}, {bit}, {before})")
            before |= bit
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(filter_order, step, bit, before)")


def positions() -> list[tuple[int, int, int]]:
    """(bit, bits before it, number of orders in which exactly these stand before it)."""
    n = len(LETTERS)
    return [
        (1 << i, before, factorial(before.bit_count()) * factorial(n - 1 - before.bit_count()))
        for i in range(n) for before in range(1 << n) if not before >> i & 1
    ]


def interactions(counts: DataFrame) -> DataFrame:
    """The report of all orders and steps from the counts that ``combinations`` gives."""
    place = F.explode(F.array(*(F.struct(F.lit(b).alias("bit"), F.lit(s).alias("before"), F.lit(w).alias("weight")) for b, s, w in positions())))
    cells = counts.withColumn("place", place).select("part", "bits", "n", "n_good", "n_toxic", "place.*")
    fails, earlier = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits").bitwiseAND(F.col("before")) != 0

    def total(column: str, where: Column) -> Column:
        return F.sum(F.when(where, F.col(column)).otherwise(0)).cast("long")

    sums = cells.groupBy("part", "bit", "before", "weight").agg(
        total("n", ~fails & ~earlier).alias("kept"),
        total("n", fails & ~earlier).alias("removed"),
        total("n", fails & earlier).alias("redundant"),
        total("n", F.col("bits") == F.col("bit")).alias("unique_fails"),
        total("n_good", fails & ~earlier).alias("good_lost"),
        total("n_toxic", fails & ~earlier).alias("toxic_lost"),
    )
    shapley = F.sum(F.col("removed") * F.col("weight")).over(Window.partitionBy("part", "bit"))
    sums = sums.withColumn("shapley", shapley)
    return sums.join(F.broadcast(orders(counts.sparkSession)), ["bit", "before"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def audit_filters(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row per part, order of the five filters and step: what stays, what the step's filter removes,
    what it would have removed, what only it removes, labelled rows it removes, and its removals over all orders."""
    counts = combinations(failing_bits(documents, key, text, part), labels, key)
    return interactions(settle(counts, "combinations"))

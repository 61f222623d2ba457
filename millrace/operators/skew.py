"""Joins in which one key may hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

ROWS_PER_TASK = 2_000_000


def spread_join(
    big: DataFrame, small: DataFrame, keys: list[str], by: list[str],
    rows_per_task: int = ROWS_PER_TASK, sizes: DataFrame | None = None, keep_big: bool = False,
) -> DataFrame:
    """Inner join whose large keys are spread over several tasks; ``keep_big`` keeps rows without a partner.

    Keys with more than ``rows_per_task`` rows in ``big`` are found first, by
    counting or from ``sizes`` (the keys and ``n``). There are at most
    ``rows(big) / rows_per_task`` of them, which bounds what is broadcast. Their
    rows are salted by the columns ``by``, their partners copied once per salt; all
    other keys join as they are.
    """
    if sizes is None:
        sizes = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    large = F.broadcast(
        sizes.filter(F.col("n") > rows_per_task)
        .select(*keys, F.ceil(F.col("n") / rows_per_task).cast("int").alias("_salts"))
    )
    salts = F.coalesce("_salts", F.lit(1))
    salted = big.join(large, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*by), salts).cast("int"))
    copies = small.join(large, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return copies.drop("_salts").join(salted.drop("_salts"), [*keys, "_salt"], "right" if keep_big else "inner").drop("_salt")

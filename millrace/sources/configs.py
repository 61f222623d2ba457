"""Config files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions import jsonrow
from millrace.functions.text import strip
from millrace.operators.configs import CONFIG_SCHEMA, STANDARD


def parse_configs(texts: DataFrame, ignore_field: str = "ignore") -> DataFrame:
    """Config rows from ``(name, text)``; ``readable`` is false where the text is no JSON object.

    ``ignore_field`` is the JSON field that lists the rules a config leaves out.
    """
    schema = CONFIG_SCHEMA.replace("ignore array", f"`{ignore_field}` array")
    rows = jsonrow.with_value(texts.withColumn("text", strip(F.col("text"))), "text", "_value")
    readable = F.coalesce(jsonrow.is_object(F.col("text"), F.col("_value")), F.lit(False))
    fields = rows.withColumns({"readable": readable, "_c": F.from_json("text", schema)})
    named = [c.split()[0] for c in CONFIG_SCHEMA.split(", ")]
    cells = {c: F.col(f"_c.`{ignore_field}`" if c == "ignore" else f"_c.{c}") for c in named if c != "name"}
    return fields.select("name", "readable", *[F.when(F.col("readable"), cell).alias(c) for c, cell in cells.items()])


def read_configs(spark: SparkSession, path: str, ignore_field: str = "ignore") -> DataFrame:
    """All ``*.json`` configs of a folder, named by file; a broken one is a row, not a failure."""
    whole = spark.read.text(path, wholetext=True, pathGlobFilter="*.json")
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    return parse_configs(whole.select(name.alias("name"), F.col("value").alias("text")), ignore_field)


def listing_of(configs: DataFrame) -> DataFrame:
    """``(name, mode, task, model, count)`` by name, ``?`` for unreadable configs and missing fields."""
    def shown(name: str, default: str):
        return F.when(F.col("readable"), F.coalesce(F.col(name).cast("string"), F.lit(default))).otherwise("?").alias(name)

    return configs.select(
        "name", shown("mode", STANDARD), shown("task", "?"), shown("model", "?"), shown("count", "?")
    ).orderBy("name")

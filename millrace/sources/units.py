"""Source units out of JSON files, JSON lines and tables."""

from __future__ import annotations

import json
import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StringType

from millrace.functions import jsonrow
from millrace.functions.text import plain_text, split_lines, strip, truncate
from millrace.operators.configs import MAX_SOURCE_CHARS
from millrace.session import settle
from millrace.sources.arrays import array_units
from millrace.sources.files import has_scheme, is_folder, read_paths, units_from_dir, units_from_file
from millrace.sources.jsonl import read_lines


def _dump(value) -> str:
    return json.dumps(value, ensure_ascii=False)


@F.pandas_udf(ArrayType(StringType()))
def _json_units(texts: pd.Series) -> pd.Series:
    def units(text):
        data = json.loads(text)
        return [_dump(item) for item in data] if isinstance(data, list) else [_dump(data)]

    return texts.map(units)


@F.pandas_udf(StringType())
def spaced_json(lines: pd.Series) -> pd.Series:
    """JSON texts in Python's default form; others as they stand, and so are those that its parser
    gives up on (numbers of more than 4,300 digits, very deep nesting)."""
    def unit(line):
        try:
            return _dump(json.loads(line))
        except (ValueError, RecursionError):
            return line

    return lines.map(unit)


def units_from_json(texts: DataFrame, text: str = "text", compact: bool = False) -> DataFrame:
    """The elements of a top-level array, else the one value: ``(..., unit_idx, unit)``.

    Units keep key order and have a space after commas and colons; ``compact``
    gives Spark's own JSON form (sorted keys, no spaces) without leaving the JVM.
    """
    rest = [c for c in texts.columns if c != text]
    if not compact:
        return texts.select(*rest, F.posexplode(_json_units(text)).alias("unit_idx", "unit"))
    parsed = jsonrow.with_value(texts, text, "_value")
    items = F.try_variant_get("_value", "$", "array<variant>")
    listed = F.schema_of_variant("_value").startswith("ARRAY")
    bad = F.raise_error(F.lit("a source file is not valid JSON")).cast("array<variant>")
    units = F.when(F.col("_value").isNull(), bad).when(listed, items).otherwise(F.array("_value"))
    return parsed.select(*rest, F.posexplode(units).alias("unit_idx", "_item")).select(
        *rest, "unit_idx", F.to_json("_item").alias("unit")
    )


def units_from_json_files(spark: SparkSession, path: str, compact: bool = False) -> DataFrame:
    """The same from files, ``(source, unit_idx, unit)``: an array may be larger than a cell or a task's memory."""
    units = array_units(spark, path, settle)
    # the unit is read in either form: it carries the check
    unit = F.when(F.col("unit").isNotNull(), F.to_json("_value")) if compact else spaced_json("unit")
    return units.select("source", "unit_idx", unit.alias("unit"))


def units_from_jsonl(lines: DataFrame, raw: str = "raw", compact: bool = False) -> DataFrame:
    """Each non-blank line as a unit, invalid JSON as it stands: ``(..., part, unit)``.

    A physical line may hold several units: Unicode line breaks separate them too.
    """
    rest = [c for c in lines.columns if c != raw]
    text = F.make_valid_utf8(F.col(raw))
    pieces = lines.select(*rest, F.posexplode(split_lines(text)).alias("part", "_line"))
    pieces = pieces.withColumn("_line", strip(F.col("_line"))).filter(F.col("_line") != "")
    if compact:
        unit: Column = F.coalesce(F.to_json(jsonrow.parse_strict("_line")), F.col("_line"))
    else:
        unit = spaced_json("_line")
    return pieces.select(*rest, "part", unit.alias("unit"))


def load_units(spark: SparkSession, source: str, glob: str = "", hidden: bool = True, compact: bool = False) -> DataFrame:
    """A config's source as ``(source, unit_idx, unit)``, by what the path is.

    A ``.json`` file gives its array elements, a ``.jsonl`` file its lines, any other
    file its text, a folder each file that matches ``glob``. ``unit_idx`` is a text
    that sorts in unit order. A path without a scheme is looked for on mounted storage;
    one with a scheme (``hdfs://``, ``s3a://``, ``file:/``) is read by Spark alone, which
    leaves out names that start with ``.`` or ``_``.
    """
    remote = has_scheme(source)
    path = source if remote else os.path.expanduser(source)
    if not (remote or os.path.exists(path)):
        raise FileNotFoundError(f"no source at {source}")
    kind = os.path.splitext(path)[1].lower()
    # Spark's own file sources see no names that start like this
    unseen = not remote and os.path.basename(path)[:1] in (".", "_")
    text = read_paths(spark, [path]).select(plain_text(F.col("content")).alias("text")) if unseen else None
    if is_folder(spark, path) if remote else os.path.isdir(path):
        units = units_from_dir(spark, path, glob, hidden and not remote)
        # components sort before longer names that start like them
        units = units.withColumn("unit_idx", F.replace("path", F.lit("/"), F.lit("\x01")))
    elif kind == ".json":
        units = units_from_json(text, compact=compact) if unseen else units_from_json_files(spark, path, compact)
        units = units.withColumn("unit_idx", _padded("unit_idx", 12))
    elif kind == ".jsonl":
        lines = text.select(F.posexplode(F.split("text", "\n")).alias("line_no", "raw")) if unseen else read_lines(spark, path)
        units = units_from_jsonl(lines, compact=compact)
        units = units.withColumn("unit_idx", F.concat(_padded("line_no", 15), F.lit("."), _padded("part", 9)))
    else:
        units = text.withColumnRenamed("text", "unit") if unseen else units_from_file(spark, path)
        units = units.withColumn("unit_idx", F.lit(""))
    return units.select(F.lit(source).alias("source"), "unit_idx", "unit")


def _padded(name: str, width: int) -> Column:
    return F.lpad(F.col(name).cast("string"), width, "0")


def truncate_units(units: DataFrame, limit: int | Column = MAX_SOURCE_CHARS, **mark) -> DataFrame:
    return units.withColumn("unit", truncate(F.col("unit"), limit, **mark))


def units_from_table(df: DataFrame, unit_id: str, text: str, *keep: str) -> DataFrame:
    """A table's rows as source units."""
    return df.select(*keep, F.col(unit_id).alias("unit_idx"), F.col(text).alias("unit"))

"""Inventories over file listings ``(path, length, mtime)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.text import human_size, minute_text


def model_inventory(files: DataFrame) -> DataFrame:
    """The kind of model in each ``dir`` by the names of its ``file`` entries."""
    file = F.col("file")
    kinds = files.groupBy("dir").agg(
        F.bool_or(file.endswith(".gguf")).alias("_gguf"),
        F.bool_or((file == "config.json") | file.endswith(".safetensors") | file.endswith(".bin")).alias("_weights"),
    )
    kind = F.when(F.col("_gguf"), "gguf").when(F.col("_weights"), "transformers").otherwise("unknown")
    return kinds.select("dir", kind.alias("type"))


def latest_checkpoint(files: DataFrame, run: str = "run", path: str = "path") -> DataFrame:
    """Per run: the checkpoint directory with the highest number, NULL without any."""
    name = F.element_at(F.split(F.rtrim(F.col(path), F.lit("/")), "/"), -1)
    step = F.when(name.startswith("checkpoint-"), F.element_at(F.split(name, "-"), -1).try_cast("long"))
    found = files.withColumn("_step", step)
    return found.groupBy(run).agg(F.max_by(path, F.col("_step")).alias("checkpoint"), F.max("_step").alias("step"))


def path_parts(path: Column) -> Column:
    return F.split(path, "/")


def order_by_path(df: DataFrame, path: str = "path") -> DataFrame:
    """Order by path components: ``a/b`` comes before ``a-b``."""
    return df.orderBy(path_parts(F.col(path)))


def log_listing(files: DataFrame) -> DataFrame:
    """Logs, newest first, with a size text and a time to the minute (session time zone)."""
    return files.orderBy(F.desc("mtime"), "path").select(
        F.element_at(path_parts(F.col("path")), -1).alias("name"),
        human_size(F.col("length")).alias("size"), minute_text(F.col("mtime")).alias("created"),
    )

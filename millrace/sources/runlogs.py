"""Run-log documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_RAM = "struct<total:double,used:double,available:double,percent:double>"
RUN_LOG_SCHEMA = (
    "model string, device string, prompt string, response string, "
    "args struct<max_tokens:bigint,temperature:double>, "
    "stats struct<time_s:double,prompt_tokens:bigint,response_tokens:bigint,tps_overall:double,tps_peak:double,"
    "tps_lowest:double,temp_avg_c:double,temp_peak_c:double,temp_lowest_c:double,ram_before_load_mb:double,"
    "ram_after_load_mb:double,ram_load_delta_mb:double,ram_after_inference_mb:double,ram_inference_delta_mb:double,"
    f"system_ram_before:{_RAM},system_ram_after_load:{_RAM},system_ram_after_inference:{_RAM}>, "
    "chunk_trace array<struct<chunk:string,tokens:bigint,tps:double,elapsed_s:double,ram_mb:double,"
    "device_util_pct:double>>, timestamp string"
)


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    """One row per log file, with the file it came from."""
    logs = spark.read.schema(RUN_LOG_SCHEMA).json(path, multiLine=True)
    return logs.select(F.col("_metadata.file_path").alias("source"), "*")


def parse_run_logs(documents: DataFrame, document: str = "document") -> DataFrame:
    """The same from a column of documents."""
    rest = [c for c in documents.columns if c != document]
    return documents.select(*rest, F.from_json(F.col(document), RUN_LOG_SCHEMA).alias("_log")).select(*rest, "_log.*")


def explode_trace(logs: DataFrame, *keys: str) -> DataFrame:
    """Trace entries of run logs in order: ``(keys, entry_idx, chunk, tokens, tps, elapsed_s, ...)``."""
    return logs.select(*keys, F.posexplode("chunk_trace").alias("entry_idx", "_entry")).select(*keys, "entry_idx", "_entry.*")


def stat(name: str) -> Column:
    return F.col(f"stats.{name}")

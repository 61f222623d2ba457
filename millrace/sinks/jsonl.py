"""JSON-lines outputs, training tables, run ids and run logs."""

from __future__ import annotations

from datetime import datetime, timezone
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.functions import jsonrow
from millrace.operators.telemetry import in_parts, round_stats
from millrace.sources.units import spaced_json

# Fields of a run log besides its stats, response and trace.
RUN_FIELDS = ("model", "device", "prompt", "args", "timestamp")


def as_json_lines(df: DataFrame, keep_nulls: bool = True) -> DataFrame:
    """Typed rows as one JSON object per row, NULL fields written as null."""
    options = {"ignoreNullFields": str(not keep_nulls).lower()}
    return df.select(F.to_json(F.struct(*df.columns), options).alias("raw"))


def spaced_lines(df: DataFrame, raw: str = "raw") -> DataFrame:
    """JSON lines with a space after commas and colons and each key once.

    Lines can be written as they came; this form is for readers that compare bytes.
    """
    return df.withColumn(raw, spaced_json(raw))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", raw: str = "raw", by: list[str] | None = None) -> None:
    """One line per row, UTF-8, as the text stands; ``mode='append'`` resumes an output.

    ``mode='replace'`` overwrites the partitions (``by``) that get rows and leaves the others as they are.
    """
    writer = df.select(*(by or []), raw).write.mode("overwrite" if mode == "replace" else mode)
    if mode == "replace":
        if not by:
            raise ValueError("only an output with partitions can be replaced in part")
        writer = writer.option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*by) if by else writer).text(path)


def partition_path(path: str, **values: Column) -> Column:
    """The folder that Spark writes a partition's rows to; names are escaped as there."""
    out = F.lit(path.rstrip("/"))
    for name, value in values.items():
        for mark in ("%", *"\"#'*/:=?\\{[]^\x7f", *map(chr, range(1, 32))):
            value = F.replace(value, F.lit(mark), F.lit(f"%{ord(mark):02X}"))
        out = F.concat(out, F.lit(f"/{name}="), F.when(value == "", "__HIVE_DEFAULT_PARTITION__").otherwise(value))
    return out


def output_exists(spark: SparkSession, path: str) -> bool:
    """Whether anything lies at ``path``, in whichever store it names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def run_id() -> str:
    """A new output's name: UTC time and six random characters."""
    return f"{datetime.now(timezone.utc):%Y%m%d_%H%M%S}_{uuid4().hex[:6]}"


def with_run_id(df: DataFrame, name: str | None = None) -> DataFrame:
    return df.withColumn("run_id", F.lit(name or run_id()))


def to_training_table(classified: DataFrame, task: str, path: str | None = None) -> DataFrame:
    """The columns of one task, written as Parquet when a path is given."""
    table = classified.filter(F.col("status") == task).select(*jsonrow.columns_of(F.col("value"), task))
    if path is None:
        return table
    table.write.mode("overwrite").parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def build_run_logs(stats: DataFrame, steps: DataFrame, part_rows: int | None = None) -> DataFrame:
    """Run-log documents ``(run_id, part, document)``: rounded stats, response and chunk trace.

    A run of more than ``part_rows`` chunks is cut into parts, each a document with
    its piece of the response and the trace; the stats stand in part 0. ``stats``
    has one row per run, and what of ``RUN_FIELDS`` it holds (model, prompt, ...)
    goes beside the stats. ``steps`` is ``trace_steps``; chunks without a speed are
    no entries.
    """
    shown = ["chunk", "tokens", *[c for c in ("tps", "elapsed_s", "ram_mb", "device_util_pct") if c in steps.columns]]
    entry = F.struct("seq", *shown)
    parts = in_parts(round_stats(steps), part_rows).groupBy("run_id", "part").agg(
        F.array_sort(F.collect_list(F.when(F.col("tps").isNotNull(), entry))).alias("_entries"),
        F.expr("listagg(chunk) WITHIN GROUP (ORDER BY seq)").alias("response"),
    )
    # both sides have one row per run and part: a run of many parts does not meet in one task
    heads = stats.withColumns({"part": F.lit(0).cast("long"), "_has": F.lit(True)})
    joined = heads.join(parts, ["run_id", "part"], "full")
    trace = F.transform("_entries", lambda e: F.struct(*[e[c].alias(c) for c in shown]))
    beside = {c: F.col(c) for c in RUN_FIELDS if c in stats.columns}
    numbers = [c for c in stats.columns if c not in ("run_id", *RUN_FIELDS)]
    cells = {
        **beside, "response": F.coalesce("response", F.lit("")),
        "stats": F.when(F.col("_has"), F.struct(*numbers)),
        "chunk_trace": F.coalesce(trace, F.from_json(F.lit("[]"), parts.select(trace.alias("t")).schema["t"].dataType)),
    }
    document = F.struct(*[cells[c].alias(c) for c in (*RUN_FIELDS[:3], "response", "args", "stats", "chunk_trace", "timestamp") if c in cells])
    return joined.select("run_id", "part", F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))

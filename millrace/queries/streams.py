"""Registered queries: streams over the given tables, run until all input is read."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from millrace.operators import telemetry as tm
from millrace.queries import fixtures as fx
from millrace.queries.fixtures import Query, table
from millrace.session import scratch_path
from millrace.streaming import streams as st

CAP = 2


def table_stream(spark, folder, name):
    """A given table, one file or a folder of them, as a stream of its Parquet files."""
    schema = table(spark, folder, name).schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parquet")
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def arriving(spark, folder):
    t = fx.SPARK_JSON_TEXT.format("text")
    rows = table_stream(spark, folder, "documents").selectExpr("source", "doc_id AS unit_idx", f"{t} AS t")
    return rows.selectExpr("source", "unit_idx", f"{fx.spark_response(fx.shapes('t'), 'unit_idx', 'unit_idx')} AS response")


def parsed_stream(spark, folder):
    return st.stream_rows(arriving(spark, folder), "sft")


def finish(query):
    query.awaitTermination()
    return query


def through_files(spark, df, name, file_format="parquet"):
    """What a stream writes until its input is read."""
    path = scratch_path(spark, name)
    with st.keyed_state(spark):
        finish(st.run_stream(df, f"{path}/out", f"{path}/checkpoint", file_format))
    return spark.read.schema(df.schema).format(file_format).load(f"{path}/out")


def ingested(spark, folder):
    rows = parsed_stream(spark, folder).select("source", "unit_idx", "line_idx", "status")
    return through_files(spark, rows, "ingest")


def counted(spark, folder):
    path = scratch_path(spark, "counts")
    counts = st.stream_counts(parsed_stream(spark, folder), "source")

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/out")

    finish(
        counts.writeStream.outputMode("complete").foreachBatch(write)
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    )
    return spark.read.parquet(f"{path}/out")


def capped(spark, folder):
    """Whole rows: the first ones of each source, in the order of its documents."""
    valid = parsed_stream(spark, folder).filter("status = 'valid'").select("source", "unit_idx", "line_idx", "raw")
    rows = through_files(spark, st.stream_cap(valid, ["source", "unit_idx"], CAP), "cap")
    return rows


def sensed(spark, folder):
    samples = table_stream(spark, folder, "events").selectExpr("user_id AS run_id", "CAST(ts AS TIMESTAMP) AS ts", "value AS celsius")
    found = through_files(spark, tm.sensor_windows(samples, "1 hour", "2 hours"), "sensors")
    return found.withColumns({"window_start": F.col("window_start").cast("timestamp_ntz"), "avg": F.round("avg", 6)})


def traced(spark, folder):
    chunks = table_stream(spark, folder, "events").selectExpr(*fx.TRACE_COLUMNS)
    rows = through_files(spark, st.stream_trace(chunks, "1 hour", 3600), "trace")
    return rows.select("run_id", "seq", "tokens", "cumulative_tokens", "elapsed_s", "tps")


def metered(spark, folder):
    """The totals that all progress reports of a stream add up to, however many there are."""
    path = scratch_path(spark, "metrics")
    name = f"lines-{os.path.basename(path)}"  # a listener hears every stream of the session
    rows = st.with_metrics(parsed_stream(spark, folder), name)
    with st.listening(spark, name) as listener:
        finish(st.run_stream(rows.select("status"), f"{path}/out", f"{path}/checkpoint", "parquet"))
    return spark.createDataFrame([(listener.generated, listener.skipped)], "generated long, skipped long")


def durable(spark, folder):
    path = scratch_path(spark, "durable")
    finish(st.stream_to_jsonl(parsed_stream(spark, folder), f"{path}/out", f"{path}/checkpoint"))
    return spark.read.text(f"{path}/out").withColumnRenamed("value", "raw")


def resumed(spark, folder):
    """A second start from the same checkpoint adds nothing."""
    path = scratch_path(spark, "resume")
    for _ in range(2):
        finish(st.stream_to_jsonl(parsed_stream(spark, folder), f"{path}/out", f"{path}/checkpoint"))
    return spark.read.text(f"{path}/out").agg(F.count(F.lit(1)).alias("n_rows"))


VALID = f"WITH {fx.PARSED} "

QUERIES = {
    "stream_ingest": Query(ingested, f"{VALID} SELECT source, unit_idx, line_idx, status FROM parsed"),
    "stream_counts": Query(
        counted,
        f"{VALID} SELECT source, count(*) FILTER (status = 'valid') AS generated, count(*) FILTER (status <> 'valid') AS skipped FROM parsed GROUP BY source",
    ),
    "stream_cap": Query(
        capped,
        f"{VALID}, ranked AS (SELECT *, row_number() OVER (PARTITION BY source, unit_idx ORDER BY line_idx) AS n FROM parsed WHERE status = 'valid') "
        f"SELECT source, unit_idx, line_idx, raw FROM ranked WHERE n <= {CAP}",
    ),
    "stream_sensor_windows": Query(
        sensed,
        "WITH w AS (SELECT user_id AS run_id, date_trunc('hour', ts) AS window_start, round(avg(value), 6) AS avg, max(value) AS peak, min(value) AS lowest, "
        "count(*) AS samples FROM events GROUP BY user_id, date_trunc('hour', ts)) SELECT * FROM w "
        "WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR",
    ),
    "stream_chunk_trace": Query(
        traced,
        f"WITH {fx.TRACE.replace(f'min(us) - {fx.LEAD_US}', 'min(us)')} SELECT run_id, seq, tokens, cumulative_tokens, elapsed_s, tps FROM steps",
    ),
    "progress_metrics": Query(
        metered, f"{VALID} SELECT count(*) FILTER (status = 'valid') AS generated, count(*) FILTER (status <> 'valid') AS skipped FROM parsed"
    ),
    "durable_stream_sink": Query(durable, f"{VALID} SELECT raw FROM parsed WHERE status = 'valid'"),
    "stream_resume": Query(resumed, f"{VALID} SELECT count(*) AS n_rows FROM parsed WHERE status = 'valid'"),
}

"""Registered queries: run telemetry and inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.text import human_size
from millrace.functions.units import celsius, mebibytes
from millrace.operators import inventory as iv
from millrace.operators import telemetry as tm
from millrace.queries import fixtures as fx
from millrace.queries.fixtures import Query, table
from millrace.operators.runlog import full_run_logs
from millrace.sources.runlogs import explode_trace, parse_run_logs, stat



def runs(spark, folder):
    return tm.run_bounds(fx.trace(spark, folder), fx.LEAD_US)


def steps(spark, folder):
    return tm.trace_steps(fx.trace(spark, folder), lead_us=fx.LEAD_US)


def speeds(spark, folder):
    return tm.throughput(steps(spark, folder))


WORD = "[^\\x09-\\x0d\\x1c-\\x20]+"
SPEEDS = (
    "words AS (SELECT run_id, len(regexp_extract_all(string_agg(chunk, '' ORDER BY seq), '" + WORD + "')) AS response_tokens FROM trace GROUP BY run_id), "
    "tops AS (SELECT run_id, max(tps) AS p, min(tps) AS l FROM steps GROUP BY run_id), "
    "overall AS (SELECT run_id, (ended_us - started_us) / 1e6 AS time_s, response_tokens, "
    "CASE WHEN ended_us > started_us THEN response_tokens / ((ended_us - started_us) / 1e6) ELSE 0 END AS tps_overall, p, l "
    "FROM runs JOIN words USING (run_id) JOIN tops USING (run_id)), "
    "speeds AS (SELECT run_id, time_s, response_tokens, tps_overall, coalesce(p, tps_overall) AS tps_peak, coalesce(l, tps_overall) AS tps_lowest FROM overall)"
)


def two(expression: str, places: int) -> str:
    """Rounding of a double's exact value."""
    return f"CAST(printf('%.{places}f', {expression}) AS DOUBLE)"


SAMPLED = [
    "user_id AS run_id", "event_id AS seq", "ts + INTERVAL '7' SECOND AS ts", "CASE WHEN event_id % 4 <> 0 THEN value * 10 END AS ram_mb",
    "CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 1000 AS DOUBLE) / 10 END AS device_util_pct", "CASE WHEN event_id % 5 <> 2 THEN value END AS celsius",
]
SNAPPED = [
    "user_id AS run_id", "CASE event_type WHEN 'view' THEN 'before' WHEN 'click' THEN 'after_load' ELSE 'after_inference' END AS phase", "max(value) AS mb",
    "max(event_id) AS used",
]
SNAPPED_BY = "1, 2"


def full_logs(spark, folder):
    """Runs of the events, each with the document of its number as its prompt."""
    events = table(spark, folder, "events")
    prompts = table(spark, folder, "documents").selectExpr(
        "doc_id AS run_id", "lang AS model", "source AS device", "text AS prompt", "n_chars AS max_tokens", "CAST(doc_id % 10 AS DOUBLE) / 10 AS temperature"
    )
    runs = events.select(F.col("user_id").alias("run_id")).distinct().join(prompts, "run_id", "left")
    snapshots = events.groupBy(F.expr(SNAPPED[0]), F.expr(SNAPPED[1])).agg(F.expr(SNAPPED[2]), F.expr(SNAPPED[3]))
    system = F.struct(F.lit(100000.0).alias("total"), F.col("used").cast("double"), (100000.0 - F.col("used")).alias("available"), (F.col("used") / 1000.0).alias("percent"))
    return full_run_logs(
        fx.trace(spark, folder), runs, events.selectExpr(*SAMPLED), snapshots.withColumn("system", system), fx.LEAD_US
    )


FULL_STATS = (
    "prompt_tokens", "time_s", "response_tokens", "tps_overall", "tps_peak", "tps_lowest", "temp_avg_c", "temp_peak_c", "temp_lowest_c", "ram_before_load_mb",
    "ram_after_load_mb", "ram_load_delta_mb", "ram_after_inference_mb", "ram_inference_delta_mb",
)


def logged(spark, folder):
    logs = parse_run_logs(full_logs(spark, folder))
    return logs.select(
        "run_id", "part", "model", "device", "prompt", "response", F.col("args.max_tokens").alias("max_tokens"), F.col("args.temperature").alias("temperature"),
        "timestamp", *[stat(s).alias(s) for s in FULL_STATS], F.col("stats.system_ram_after_load.available").alias("available"), F.size("chunk_trace").alias("entries"),
    )


def scanned(spark, folder):
    logs = parse_run_logs(full_logs(spark, folder))
    return explode_trace(logs, "run_id", "part").select("run_id", "part", "entry_idx", "chunk", "tokens", "tps", "elapsed_s", "ram_mb", "device_util_pct")


FULL = (
    f"samples AS (SELECT {', '.join(SAMPLED)} FROM events), snaps AS (SELECT {', '.join(SNAPPED)} FROM events GROUP BY {SNAPPED_BY}), "
    "temps AS (SELECT run_id, avg(celsius) AS temp_avg_c, max(celsius) AS temp_peak_c, min(celsius) AS temp_lowest_c FROM samples GROUP BY run_id), "
    "mems AS (SELECT run_id, max(mb) FILTER (phase = 'before') AS b, max(mb) FILTER (phase = 'after_load') AS l, max(mb) FILTER (phase = 'after_inference') AS i, "
    "100000 - max(used) FILTER (phase = 'after_load') AS available FROM snaps GROUP BY run_id), "
    "ended AS (SELECT run_id, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS timestamp, string_agg(chunk, '' ORDER BY seq) AS response FROM raw_trace GROUP BY run_id)"
)
READ = (
    "timed AS (SELECT s.*, r.ts FROM numbered s JOIN raw_trace r USING (run_id, seq)), "
    "ram AS (SELECT run_id, ts, ram_mb FROM samples WHERE ram_mb IS NOT NULL), util AS (SELECT run_id, ts, device_util_pct FROM samples WHERE device_util_pct IS NOT NULL), "
    "read AS (SELECT t.*, ram_mb, device_util_pct FROM timed t ASOF LEFT JOIN ram ON t.run_id = ram.run_id AND t.ts >= ram.ts "
    "ASOF LEFT JOIN util ON t.run_id = util.run_id AND t.ts >= util.ts)"
)


ENTRIES = (
    f"placed AS (SELECT *, 0 AS part FROM steps), "
    "entries AS (SELECT * FROM placed WHERE tps IS NOT NULL), "
    "numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY run_id, part ORDER BY seq) - 1 AS INTEGER) AS entry_idx FROM entries)"
)


def rounded(spark, folder):
    return tm.round_stats(speeds(spark, folder))


def samples(spark, folder):
    return table(spark, folder, "events").selectExpr(*fx.SAMPLE_COLUMNS)


def windows(spark, folder):
    return tm.sensor_windows(samples(spark, folder), "1 hour").withColumn("avg", F.round("avg", 6))


def stats(spark, folder):
    return tm.sensor_stats(samples(spark, folder), "run_id").withColumn("temp_avg_c", F.round("temp_avg_c", 6))


SNAPSHOTS = ["user_id AS run_id", "CAST(ts AS DATE) AS day", "CASE event_type WHEN 'view' THEN 'before' WHEN 'click' THEN 'after_load' WHEN 'error' THEN 'after_inference' ELSE 'other' END AS phase", "value AS mb"]


def deltas(spark, folder):
    return tm.memory_deltas(table(spark, folder, "events").selectExpr(*SNAPSHOTS), "run_id", "day")


RAW_READINGS = [
    "event_id", "CASE WHEN event_id % 3 = 0 THEN value * 1000 END AS milli", "CASE WHEN event_id % 3 <> 2 THEN value * 10 END AS tenths",
    "CASE WHEN event_id % 5 <> 0 THEN value + 273.15 END AS kelvin", "event_id * 4096 AS bytes",
]


def readings(spark, folder):
    return table(spark, folder, "events").selectExpr(*RAW_READINGS).select(
        "event_id", F.round(celsius(F.col("milli"), F.col("tenths"), F.col("kelvin")), 6).alias("celsius"),
        mebibytes(F.col("bytes")).alias("mib"),
    )


def losses(spark, folder):
    logs = table(spark, folder, "orders").selectExpr("o_custkey AS run_id", "o_orderkey AS seq", "o_totalprice AS loss")
    planned = logs.groupBy("run_id").agg(F.count(F.lit(1)).alias("total_steps"))
    return tm.step_progress(logs, planned)


def files(spark, folder):
    return table(spark, folder, "documents").selectExpr(*[c.format("STRING") for c in fx.FILE_COLUMNS])


FILES = f"files AS (SELECT {', '.join(c.format('VARCHAR') for c in fx.FILE_COLUMNS)} FROM documents)"


def checkpoints(spark, folder):
    found = table(spark, folder, "documents").selectExpr(
        "source AS run", "CASE WHEN doc_id % 7 = 3 THEN 'logs/run-' ELSE 'out/checkpoint-' END || CAST(doc_id AS STRING) AS path"
    )
    return iv.latest_checkpoint(found)


def sizes(spark, folder):
    return table(spark, folder, "documents").select("doc_id", human_size(F.col("n_chars")).alias("size"))


def by_path(spark, folder):
    rows = table(spark, folder, "documents").selectExpr(
        "CASE doc_id % 3 WHEN 0 THEN source || '/' || lang ELSE source || '-' || lang END || CAST(doc_id AS STRING) AS path"
    )
    return iv.order_by_path(rows)


QUERIES = {
    "chunk_tps": Query(
        lambda spark, folder: tm.chunk_tps(fx.trace(spark, folder), lead_us=fx.LEAD_US),
        f"WITH {fx.TRACE} SELECT run_id, seq, chunk, tokens, elapsed_s, tps FROM steps WHERE tps IS NOT NULL",
    ),
    "cumulative_tokens": Query(
        lambda spark, folder: tm.cumulative_tokens(fx.trace(spark, folder)),
        f"WITH {fx.TRACE} SELECT run_id, seq, tokens, cumulative_tokens FROM steps",
    ),
    "elapsed": Query(
        lambda spark, folder: tm.elapsed(fx.trace(spark, folder), runs(spark, folder)),
        f"WITH {fx.TRACE} SELECT run_id, seq, elapsed_s FROM steps",
    ),
    "throughput_stats": Query(speeds, f"WITH {fx.TRACE}, {SPEEDS} SELECT * FROM speeds"),
    "assemble_response": Query(
        lambda spark, folder: tm.assemble_response(fx.trace(spark, folder)),
        f"WITH {fx.TRACE}, placed AS (SELECT *, 0 AS part FROM trace) "
        "SELECT run_id, part, string_agg(chunk, '' ORDER BY seq) AS response FROM placed GROUP BY run_id, part",
    ),
    "run_log_sink": Query(
        logged,
        f"WITH {fx.TRACE}, {SPEEDS}, {ENTRIES}, {FULL}, parts AS (SELECT run_id, part, count(tps) AS n FROM placed GROUP BY run_id, part) "
        "SELECT parts.run_id, part, lang AS model, source AS device, text AS prompt, response, n_chars AS max_tokens, (doc_id % 10) / 10 AS temperature, timestamp, "
        f"len(regexp_extract_all(text, '{WORD}')) AS prompt_tokens, {two('time_s', 4)} AS time_s, response_tokens, {two('tps_overall', 4)} AS tps_overall, "
        f"{two('tps_peak', 4)} AS tps_peak, {two('tps_lowest', 4)} AS tps_lowest, {two('temp_avg_c', 2)} AS temp_avg_c, {two('temp_peak_c', 2)} AS temp_peak_c, "
        f"{two('temp_lowest_c', 2)} AS temp_lowest_c, {two('b', 2)} AS ram_before_load_mb, {two('l', 2)} AS ram_after_load_mb, {two('l - b', 2)} AS ram_load_delta_mb, "
        f"{two('i', 2)} AS ram_after_inference_mb, {two('i - l', 2)} AS ram_inference_delta_mb, CAST(available AS DOUBLE) AS available, CAST(n AS INTEGER) AS entries "
        "FROM parts JOIN speeds USING (run_id) JOIN ended USING (run_id) LEFT JOIN temps USING (run_id) LEFT JOIN mems USING (run_id) LEFT JOIN documents ON doc_id = parts.run_id",
    ),
    "run_log_scan": Query(
        scanned,
        f"WITH {fx.TRACE}, {ENTRIES}, {FULL}, {READ} SELECT run_id, part, entry_idx, chunk, tokens, {two('tps', 2)} AS tps, {two('elapsed_s', 3)} AS elapsed_s, "
        f"{two('ram_mb', 2)} AS ram_mb, {two('device_util_pct', 1)} AS device_util_pct FROM read",
    ),
    "round_stats": Query(
        rounded,
        f"WITH {fx.TRACE}, {SPEEDS} SELECT run_id, {two('time_s', 4)} AS time_s, response_tokens, {two('tps_overall', 4)} AS tps_overall, "
        f"{two('tps_peak', 4)} AS tps_peak, {two('tps_lowest', 4)} AS tps_lowest FROM speeds",
    ),
    "sensor_stats": Query(
        stats,
        "SELECT user_id AS run_id, round(avg(value), 6) AS temp_avg_c, max(value) AS temp_peak_c, min(value) AS temp_lowest_c FROM events GROUP BY user_id",
    ),
    "sensor_windows": Query(
        windows,
        "SELECT user_id AS run_id, date_trunc('hour', ts) AS window_start, round(avg(value), 6) AS avg, max(value) AS peak, min(value) AS lowest, "
        "count(*) AS samples FROM events GROUP BY user_id, date_trunc('hour', ts)",
    ),
    "memory_deltas": Query(
        deltas,
        f"WITH s AS (SELECT {', '.join(SNAPSHOTS)} FROM events), p AS (SELECT run_id, day, max(mb) FILTER (phase = 'before') AS before_mb, "
        "max(mb) FILTER (phase = 'after_load') AS after_load_mb, max(mb) FILTER (phase = 'after_inference') AS after_inference_mb FROM s GROUP BY run_id, day) "
        "SELECT *, after_load_mb - before_mb AS load_delta_mb, after_inference_mb - after_load_mb AS inference_delta_mb FROM p",
    ),
    "sensor_normalise": Query(
        readings,
        f"WITH r AS (SELECT {', '.join(RAW_READINGS)} FROM events) SELECT event_id, round(coalesce(milli / 1000, tenths / 10 - 273.15, kelvin - 273.15), 6) AS celsius, "
        "bytes / (1024 * 1024) AS mib FROM r",
    ),
    "step_progress": Query(
        losses,
        "SELECT o_custkey AS run_id, o_orderkey AS seq, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS step, "
        "count(*) OVER (PARTITION BY o_custkey) AS total_steps, o_totalprice AS loss FROM orders",
    ),
    "model_inventory": Query(
        lambda spark, folder: iv.model_inventory(files(spark, folder)),
        f"WITH {FILES} SELECT dir, CASE WHEN bool_or(ends_with(file, '.gguf')) THEN 'gguf' WHEN bool_or(file = 'config.json' OR ends_with(file, '.safetensors') "
        "OR ends_with(file, '.bin')) THEN 'transformers' ELSE 'unknown' END AS type FROM files GROUP BY dir",
    ),
    "latest_checkpoint": Query(
        checkpoints,
        "SELECT source AS run, 'out/checkpoint-' || CAST(max(doc_id) FILTER (doc_id % 7 <> 3) AS VARCHAR) AS checkpoint, "
        "max(doc_id) FILTER (doc_id % 7 <> 3) AS step FROM documents GROUP BY source",
    ),
    "human_size": Query(
        sizes,
        "SELECT doc_id, CASE WHEN n_chars < 1024 THEN CAST(n_chars AS VARCHAR) || ' B' ELSE printf('%.1f KB', n_chars / 1024) END AS size FROM documents",
    ),
    "path_order": Query(
        by_path,
        "SELECT CASE doc_id % 3 WHEN 0 THEN source || '/' || lang ELSE source || '-' || lang END || CAST(doc_id AS VARCHAR) AS path FROM documents "
        "ORDER BY string_split(path, '/')",
    ),
}

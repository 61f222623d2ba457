"""Run telemetry: chunk traces, throughput, sensors, memory, run-log documents.

A chunk row is ``(run_id, seq, ts, chunk, tokens)``; ``seq`` is a whole number that
is unique within a run and grows with arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.text import chunk_tokens, is_blank, token_count
from millrace.functions.units import round_exact
from millrace.operators.ordered import ordered_scan
from millrace.operators.skew import ROWS_PER_TASK, spread_join

# Decimal places of a run log's numbers.
PLACES = {
    "time_s": 4, "tps_overall": 4, "tps_peak": 4, "tps_lowest": 4, "tps": 2, "elapsed_s": 3,
    "temp_avg_c": 2, "temp_peak_c": 2, "temp_lowest_c": 2, "ram_mb": 2, "device_util_pct": 1,
    "before_mb": 2, "after_load_mb": 2, "after_inference_mb": 2, "load_delta_mb": 2, "inference_delta_mb": 2,
    "ram_before_load_mb": 2, "ram_after_load_mb": 2, "ram_load_delta_mb": 2, "ram_after_inference_mb": 2, "ram_inference_delta_mb": 2,
}


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def run_bounds(trace: DataFrame, lead_us: int = 0) -> DataFrame:
    """Start and end of each run from its chunks; ``lead_us`` is the wait before the first one."""
    return trace.groupBy("run_id").agg(
        (F.min(micros(F.col("ts"))) - lead_us).alias("started_us"), F.max(micros(F.col("ts"))).alias("ended_us")
    )


def trace_steps(
    trace: DataFrame, runs: DataFrame | None = None, lead_us: int = 0, keep: tuple[str, ...] = (),
    parts: int | None = None,
) -> DataFrame:
    """Every chunk with its place, tokens, cumulative tokens, seconds since the run start and speed.

    The first chunk is measured from the run start: that of ``runs`` (``run_id,
    started_us``), else ``lead_us`` before the run's first chunk. ``tps`` is NULL
    where no token or no time passed: such chunks are no trace entries. ``words``
    adds up to the words of the whole response: a chunk's own, less one where it
    goes on with the word that the text before it ended in. ``keep`` names further
    columns of the trace, such as memory and utilisation readings.
    """
    text = F.col("chunk") != ""
    rows = trace.withColumns({
        "tokens": chunk_tokens(F.col("tokens"), F.col("chunk")),
        "_us": micros(F.col("ts")),
    })
    scanned = ordered_scan(
        rows, ["run_id"], ["seq"], parts=parts,
        totals={"place": F.lit(1), "cumulative_tokens": F.col("tokens")},
        previous={"_before": F.col("_us"), "_open": F.when(text, ~is_blank(F.right("chunk", F.lit(1))))},
        least={"_first": F.col("_us")} if runs is None else None,
        attach=None if runs is None else runs.select("run_id", "started_us"),
    )
    if runs is None:
        scanned = scanned.withColumn("started_us", F.col("_first") - lead_us)
    passed = F.col("_us") - F.coalesce("_before", "started_us")
    goes_on = text & F.coalesce("_open", F.lit(False)) & ~is_blank(F.left("chunk", F.lit(1)))
    return scanned.select(
        "run_id", "seq", F.col("place").cast("long").alias("place"), "chunk", "tokens", "cumulative_tokens",
        ((F.col("_us") - F.col("started_us")) / 1e6).alias("elapsed_s"),
        F.when((F.col("tokens") > 0) & (passed > 0), F.col("tokens") / (passed / 1e6)).alias("tps"),
        (token_count(F.col("chunk")) - goes_on.cast("int")).alias("words"), *keep,
    )


def chunk_tps(trace: DataFrame, runs: DataFrame | None = None, **options) -> DataFrame:
    """Trace entries: chunks that hold tokens and took time."""
    steps = trace_steps(trace, runs, **options).filter(F.col("tps").isNotNull())
    return steps.select("run_id", "seq", "chunk", "tokens", "elapsed_s", "tps")


def cumulative_tokens(trace: DataFrame, parts: int | None = None) -> DataFrame:
    rows = trace.withColumn("tokens", chunk_tokens(F.col("tokens"), F.col("chunk")))
    return ordered_scan(
        rows, ["run_id"], ["seq"], totals={"cumulative_tokens": F.col("tokens")}, parts=parts
    ).select("run_id", "seq", "tokens", "cumulative_tokens")


def elapsed(trace: DataFrame, runs: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Seconds from run start to each chunk; NULL for a run that ``runs`` does not hold."""
    rows = trace.select("run_id", "seq", micros(F.col("ts")).alias("_us"))
    return spread_join(rows, runs.select("run_id", "started_us"), ["run_id"], ["seq"], rows_per_task, keep_big=True).select("run_id", "seq", ((F.col("_us") - F.col("started_us")) / 1e6).alias("elapsed_s"))


def throughput(steps: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Overall, peak and lowest speed per run, from ``trace_steps``.

    The response's tokens are its words, or what ``counts`` (``run_id,
    response_tokens``) says. Peak and lowest fall back to overall where a run has
    no trace entry; a run without duration has overall speed 0.
    """
    runs = steps.groupBy("run_id").agg(
        F.max("elapsed_s").alias("time_s"), F.sum("words").alias("response_tokens"),
        F.max("tps").alias("_peak"), F.min("tps").alias("_lowest"),
    )
    if counts is not None:
        runs = runs.drop("response_tokens").join(counts.select("run_id", "response_tokens"), "run_id", "left")
    overall = F.when(F.col("time_s") > 0, F.col("response_tokens") / F.col("time_s")).otherwise(F.lit(0.0))
    return runs.withColumn("tps_overall", overall).select(
        "run_id", "time_s", "response_tokens", "tps_overall",
        F.coalesce("_peak", "tps_overall").alias("tps_peak"),
        F.coalesce("_lowest", "tps_overall").alias("tps_lowest"),
    )


def in_parts(trace: DataFrame, part_rows: int | None = None) -> DataFrame:
    """Add ``part``: 0 for all of a run, or with ``part_rows`` 0 for its first chunks, 1 for the next, and so on."""
    if part_rows is None:
        return trace.withColumn("part", F.lit(0).cast("long"))
    rows = ordered_scan(trace, ["run_id"], ["seq"], totals={"_place": F.lit(1)})
    return rows.withColumn("part", F.floor((F.col("_place") - 1) / part_rows).cast("long")).drop("_place")


def assemble_response(trace: DataFrame, part_rows: int | None = None) -> DataFrame:
    """The response text of each run, its chunks joined in arrival order.

    With ``part_rows`` a longer response comes in parts whose texts follow one another.
    """
    rows = in_parts(trace.select("run_id", "seq", "chunk"), part_rows)
    return rows.groupBy("run_id", "part").agg(
        F.expr("listagg(chunk) WITHIN GROUP (ORDER BY seq)").alias("response")
    )


def sensor_stats(samples: DataFrame, *keys: str, value: str = "celsius") -> DataFrame:
    """Average, highest and lowest reading; NULL without readings."""
    return samples.groupBy(*keys).agg(
        F.avg(value).alias("temp_avg_c"), F.max(value).alias("temp_peak_c"), F.min(value).alias("temp_lowest_c")
    )


def memory_deltas(snapshots: DataFrame, *keys: str) -> DataFrame:
    """Growth by loading and by inference from ``(phase, mb)`` snapshots.

    Phases are ``before``, ``after_load`` and ``after_inference``; a missing one
    leaves its difference NULL.
    """
    def at(phase: str) -> Column:
        return F.max(F.when(F.col("phase") == phase, F.col("mb")))

    return snapshots.groupBy(*keys).agg(
        at("before").alias("before_mb"), at("after_load").alias("after_load_mb"),
        at("after_inference").alias("after_inference_mb"),
    ).withColumns({
        "load_delta_mb": F.col("after_load_mb") - F.col("before_mb"),
        "inference_delta_mb": F.col("after_inference_mb") - F.col("after_load_mb"),
    })


def round_stats(stats: DataFrame) -> DataFrame:
    """The rounding that run logs use, for the columns that are there."""
    return stats.withColumns({c: round_exact(F.col(c), PLACES[c]) for c in stats.columns if c in PLACES})


def sensor_windows(samples: DataFrame, width: str, delay: str | None = None, value: str = "celsius") -> DataFrame:
    """Readings per run and time window; on a stream, ``delay`` bounds late data."""
    if samples.isStreaming and delay:
        samples = samples.withWatermark("ts", delay)
    stats = samples.groupBy("run_id", F.window("ts", width)).agg(
        F.avg(value).alias("avg"), F.max(value).alias("peak"), F.min(value).alias("lowest"),
        F.count(value).alias("samples"),
    )
    return stats.select("run_id", F.col("window.start").alias("window_start"), "avg", "peak", "lowest", "samples")


def step_progress(losses: DataFrame, runs: DataFrame, parts: int | None = None) -> DataFrame:
    """Each logged loss as step k of N, in log order; ``runs`` holds ``(run_id, total_steps)``."""
    return ordered_scan(
        losses.filter(F.col("loss").isNotNull()), ["run_id"], ["seq"],
        totals={"step": F.lit(1)}, attach=runs.select("run_id", "total_steps"), parts=parts,
    ).select("run_id", "seq", "step", "total_steps", "loss")

"""Full run logs: chunk entries with readings, memory phases, temperatures, arguments and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.text import token_count
from millrace.operators.ordered import ordered_scan
from millrace.operators.telemetry import memory_deltas, micros, round_stats, sensor_stats, throughput, trace_steps
from millrace.session import settle
from millrace.sinks.jsonl import build_run_logs

# Names of the memory figures in a run log.
MEMORY = {
    "before_mb": "ram_before_load_mb", "after_load_mb": "ram_after_load_mb", "load_delta_mb": "ram_load_delta_mb",
    "after_inference_mb": "ram_after_inference_mb", "inference_delta_mb": "ram_inference_delta_mb",
}
PHASES = {"before": "system_ram_before", "after_load": "system_ram_after_load", "after_inference": "system_ram_after_inference"}
READINGS = ("ram_mb", "device_util_pct")


def last_readings(rows: DataFrame, samples: DataFrame, keys: list[str], values: list[str], tie: str = "seq", parts: int | None = None) -> DataFrame:
    """Add to each row the last known ``values`` of its key's samples at or before its ``ts``; NULL before the first.

    Rows and samples are merged by time in one scan of ordered ranges, so a key with very many of either
    spreads over tasks. Each value has its own last sample: one without it does not count. Samples at one
    time count in order of ``tie``, and before rows of that time.
    """
    absent = {v: F.lit(None).cast(samples.schema[v].dataType) for v in values}
    own = [c for c in rows.columns if c not in keys]
    marked = rows.select(
        *keys, micros(F.col("ts")).alias("_us"), F.lit(1).alias("_kind"), F.col(tie).alias("_tie"), F.struct(*own).alias("_row"),
        *[absent[v].alias(f"_{v}") for v in values],
    )
    taken = samples.select(*keys, micros(F.col("ts")).alias("_us"), F.lit(0).alias("_kind"), F.col(tie).alias("_tie"), *[F.col(v).alias(f"_{v}") for v in values])
    merged = ordered_scan(
        marked.unionByName(taken, allowMissingColumns=True), keys, ["_us", "_kind", "_tie"],
        previous={v: F.col(f"_{v}") for v in values}, parts=parts,
    )
    return merged.filter("_kind = 1").select(*keys, "_row.*", *values)


def phase_figures(snapshots: DataFrame) -> DataFrame:
    """Per run: process memory by phase with its growth, and the system's memory by phase.

    ``snapshots`` holds ``(run_id, phase, mb)`` and, where known, ``system`` (total, used, available, percent).
    """
    figures = memory_deltas(snapshots, "run_id").withColumnsRenamed(MEMORY)
    if "system" not in snapshots.columns:
        return figures
    system = snapshots.groupBy("run_id").agg(*[
        F.first(F.when(F.col("phase") == phase, F.col("system")), ignorenulls=True).alias(name) for phase, name in PHASES.items()
    ])
    return figures.join(system, "run_id")


def run_stats(steps: DataFrame, runs: DataFrame, samples: DataFrame | None = None, snapshots: DataFrame | None = None) -> DataFrame:
    """One row per run: what its log says beside response and trace, rounded.

    ``runs`` holds ``run_id`` and any of ``model, device, prompt, max_tokens, temperature, timestamp``.
    """
    stats = throughput(steps)
    if "prompt" in runs.columns:
        runs = runs.withColumn("prompt_tokens", token_count(F.col("prompt")).cast("long"))
    given: list[Column | str] = [c for c in ("model", "device", "prompt", "prompt_tokens", "timestamp") if c in runs.columns]
    args = [c for c in ("max_tokens", "temperature") if c in runs.columns]
    stats = stats.join(runs.select("run_id", *given, *([F.struct(*args).alias("args")] if args else [])), "run_id", "left")
    if samples is not None:
        stats = stats.join(sensor_stats(samples.filter("celsius IS NOT NULL"), "run_id"), "run_id", "left")
    if snapshots is not None:
        stats = stats.join(phase_figures(snapshots), "run_id", "left")
    return round_stats(stats)


def full_run_logs(
    trace: DataFrame, runs: DataFrame, samples: DataFrame | None = None, snapshots: DataFrame | None = None,
    lead_us: int = 0, part_rows: int | None = None,
) -> DataFrame:
    """Run-log documents ``(run_id, part, document)`` of whole runs.

    ``samples`` holds ``(run_id, seq, ts, ram_mb, device_util_pct, celsius)``: each entry of the trace has the last
    readings before it, and the stats the temperatures. Without samples and snapshots the documents are
    those of a bare run. ``runs`` may hold ``started_us``; else a run starts ``lead_us`` before its first
    chunk, and a log without a ``timestamp`` has that of the last chunk (UTC). The trace is
    scanned once: its steps are written, and stats, response and entries are read from there.
    """
    keep = READINGS if samples is not None else ()
    rows = trace if samples is None else last_readings(trace, samples, ["run_id"], list(keep))
    begun = runs.select("run_id", "started_us") if "started_us" in runs.columns else None
    steps = settle(trace_steps(rows, begun, lead_us, keep), "steps")
    if "timestamp" not in runs.columns:
        ended = trace.groupBy("run_id").agg(F.max(micros(F.col("ts"))).alias("_us"))
        shown = F.date_format(F.timestamp_micros("_us").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss")
        runs = runs.join(ended, "run_id", "left").withColumn("timestamp", shown).drop("_us")
    return build_run_logs(run_stats(steps, runs, samples, snapshots), steps, part_rows)

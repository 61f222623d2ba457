"""Whole runs: from configs and a model to JSON lines, from dataset lines to a training table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions import jsonrow
from millrace.functions.text import format_chat, format_sft, truncate
from millrace.operators import configs as cf
from millrace.operators import datasets as ds
from millrace.operators import responses as rs
from millrace.plans import requests as rq
from millrace.plans.generate import fill_rounds
from millrace.plans.ledger import Factory, answered, failures, good_keys, record
from millrace.session import settle
from millrace.sinks.jsonl import output_exists, partition_path, write_jsonl


def _routed(configs: DataFrame, mode: str, system: Column | None, prefixes: dict[str, str] | None) -> DataFrame:
    """The configs of a run, with defaults, ``provider`` and the model's name there.

    Stops the run when one of them breaks a rule or is of the other mode.
    """
    cf.stop_on_problems(cf.run_problems(configs, mode))
    wanted = configs if system is None else configs.withColumn("system", system)
    return cf.provider_route(cf.with_defaults(wanted), prefixes).withColumn("model", F.col("slug")).drop("slug")


def _with_existing(wanted: DataFrame, existing: int | DataFrame) -> DataFrame:
    """Add the rows that each config's output holds already."""
    if isinstance(existing, DataFrame):
        rows = wanted.join(existing.select("name", "existing"), "name", "left")
        return rows.withColumn("existing", F.coalesce("existing", F.lit(0)))
    if existing and len(wanted.select("name").take(2)) > 1:
        raise ValueError("one number of existing rows for several configs: give a table (name, existing)")
    return wanted.withColumn("existing", F.lit(existing))


def synthesize(
    configs: DataFrame, factory: Factory, path: str, existing: int | DataFrame = 0, workers: int | None = None,
    template: str = rq.STANDARD_TEMPLATE, hints: dict[str, str] | None = None, separate: bool = True,
    system: Column | None = None, prefixes: dict[str, str] | None = None, ledger: str | None = None, run: str | None = None,
) -> DataFrame:
    """Run all standard configs as one job; the rows of each go to ``path`` under ``name=...``.

    With a ``run`` they go under ``run_id=...`` and ``name=...``, and only what this run writes there is replaced: repeating
    one config leaves the others' rows. A ``ledger`` (a folder) records answers as tasks end: a run that died and
    starts again with it asks its open requests only.

    With very many configs, ``separate=False`` writes one output instead. A config that
    breaks a rule, or a grounded one, stops the run before any request.

    The factory's function gets ``name``, ``batch_idx``, ``provider``, ``model``,
    ``temperature``, ``message`` and ``system`` (``configs.system_text``, or a column of
    the configs). ``existing`` resumes an output: its number of rows, or for several
    configs a table ``(name, existing)``. Returns ``(name, generated, skipped)``; a
    config whose batches gave too few rows ends short, as the row shows.
    """
    wanted = _with_existing(_routed(configs, cf.STANDARD, system, prefixes), existing)
    asked = ["name", "batch_idx", "task", "count", "existing"]
    before = answered(configs.sparkSession, ledger) if ledger else None
    done = None if before is None else good_keys(before, ["name", "batch_idx"])
    plan = rq.request_plan(wanted, F.col("count"), F.col("batch_size"), F.col("existing"), spread=True, done=done, keys=["name"])
    messages = rq.render_request(plan, template, hints)
    sent = messages.select(*asked, "provider", "model", "temperature", "message", *[c for c in ("system",) if c in wanted.columns])
    answers = record(sent, ["name", "batch_idx"], factory, ledger, workers, keep=asked, before=before)
    parsed = settle(rs.parse_responses(answers.select(*asked, "response"), F.col("task")).drop("value"), "lines")
    valid = parsed.filter(F.col("status") == rs.VALID)
    rows = rs.cap_to_target(valid, ["name"], F.col("count") - F.col("existing"))
    resumed = isinstance(existing, DataFrame) or existing > 0
    _write_rows(rows, path, "append" if resumed else "overwrite", separate, run)
    target = wanted.select("name", F.col("count").cast("long").alias("_target"), F.col("existing").cast("long").alias("_had"))
    counts = rs.parse_counts(parsed, "name")
    return target.join(counts, "name", "left").join(failures(answers, "name"), "name", "left").select(
        "name",
        F.greatest("_had", F.least(F.col("_target"), F.coalesce("valid", F.lit(0)) + F.col("_had"))).alias("generated"),
        F.coalesce("skipped", F.lit(0)).alias("skipped"), F.coalesce("elapsed_s", F.lit(0.0)).alias("elapsed_s"),
        _output(path, separate, run).alias("output"), "error",
    )


def _write_rows(rows: DataFrame, path: str, mode: str, separate: bool, run: str | None) -> None:
    if run is not None:
        rows, mode = rows.withColumn("run_id", F.lit(run)), "replace" if mode == "overwrite" else mode
    by = [*(["run_id"] if run is not None else []), *(["name"] if separate else [])]
    write_jsonl(rows, path, mode, by=by or None)


def _output(path: str, separate: bool, run: str | None) -> Column:
    """The folder that a config's rows went to."""
    parts = {"run_id": F.lit(run)} if run is not None else {}
    return partition_path(path, **parts, **({"name": F.col("name")} if separate else {}))


def one_after_another(configs: DataFrame, run: Callable[[DataFrame], DataFrame], order: str = "name") -> DataFrame:
    """Run each config by itself (``run`` is given a table of one) and stop after the first that fails.

    Returns the rows of the configs that ran, with their ``position``; ``sequential_status`` sums them up. For the few configs
    that a caller lists; many are one job (``synthesize``).
    """
    done = None
    for position, row in enumerate(configs.select("name").orderBy(order).toLocalIterator()):
        result = settle(run(configs.filter(F.col("name").eqNullSafe(F.lit(row["name"])))), "result")
        result = result.withColumn("position", F.lit(position))
        done = result if done is None else done.unionByName(result)
        if not result.filter("error IS NOT NULL").isEmpty():
            break
    if done is None:
        raise ValueError("no configs")
    return done


def synthesize_grounded(
    configs: DataFrame, units: DataFrame, factory: Factory, path: str, max_rounds: int, workers: int | None = None,
    template: str = rq.GROUNDED_TEMPLATE, hints: dict[str, str] | None = None, separate: bool = True,
    system: Column | None = None, prefixes: dict[str, str] | None = None, mode: str = "error",
    ledger: str | None = None, run: str | None = None,
) -> DataFrame:
    """Run all grounded configs as one job over their units ``(source, unit_idx, unit)``.

    Each (unit, prompt) is asked until it has its config's count of rows or
    ``max_rounds`` are over. Rows go to ``path`` under ``name=...``; an output that is there
    already stops the run, unless ``mode`` says ``append`` or ``overwrite``, or a ``run`` names it (``synthesize``; so does
    ``ledger``). Returns ``(name, generated, skipped, sources, elapsed_s, output, error)``, with zeros for a config
    whose source has no units. A call that fails ends its config after the round; others go on.
    """
    if run is not None and mode == "error":
        mode = "overwrite"
    if mode == "error" and output_exists(configs.sparkSession, path):
        raise FileExistsError(path)
    wanted = _routed(configs, cf.GROUNDED, system, prefixes)
    given = ["name", "prompts", "max_source_chars", "provider", "model", "task", "count", "temperature", "batch_size"]
    given += [c for c in ("system",) if c in wanted.columns]
    # the units' texts stay where they are until a request needs them
    own = rq.attach_units(wanted.select("source", *given), units.select("source", "unit_idx"))
    pairs = rq.unit_prompts(own, F.col("prompts")).drop("prompts")

    def render(plan: DataFrame) -> DataFrame:
        # cut here: what is written is a unit, not its cuts for each config and prompt
        cut = plan.withColumn("unit", truncate(F.col("unit"), F.col("max_source_chars")))
        return rq.render_grounded(cut, template, hints).drop("unit", "prompt", "max_source_chars")

    keys = ["name", "unit_idx", "prompt_idx"]
    rows, state = fill_rounds(
        pairs, keys, factory, F.col("task"), F.col("count"), F.col("batch_size"), max_rounds, workers,
        render=render, ledger=ledger, config="name", units=units.select("source", "unit_idx", "unit"), unit_keys=["source", "unit_idx"],
    )
    _write_rows(rows, path, mode, separate, run)
    spans = [F.min("_from").alias("_from"), F.max("_to").alias("_to"), F.min("error").alias("error")]
    per_unit = state.groupBy("name", "unit_idx").agg(F.sum("written").alias("written"), F.sum("skipped").alias("skipped"), *spans)
    counts = per_unit.groupBy("name").agg(
        F.sum("written").alias("generated"), F.sum("skipped").alias("skipped"), F.count(F.lit(1)).alias("sources"), *spans
    ).withColumn("elapsed_s", (F.col("_to") - F.col("_from")) / 1e6).drop("_from", "_to")
    results = wanted.select("name").join(counts, "name", "left").fillna(0, ["generated", "skipped", "sources", "elapsed_s"])
    return results.select("name", "generated", "skipped", "sources", "elapsed_s", _output(path, separate, run).alias("output"), "error")


def training_text(lines: DataFrame, task: str, dataset: str = "source", strict: bool = True) -> DataFrame:
    """Dataset lines of an sft or chat dataset as training ``text``, after validation."""
    rows, _ = ds.load_lines(lines, dataset, strict=strict)
    table = ds.project_task(rows, task)
    if task == jsonrow.SFT:
        return table.select(format_sft(F.col("prompt"), F.col("completion")).alias("text"))
    if task == jsonrow.CHAT:
        return table.select(format_chat(F.col("messages")).alias("text"))
    raise ValueError(f"rows of task {task} are not joined into one text")

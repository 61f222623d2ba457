"""Request plans: units and prompts, batches, rendered messages, what remains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions import jsonrow
from millrace.functions.text import fill_template
from millrace.operators.skew import ROWS_PER_TASK, spread_join

def row_shape(task: str) -> str:
    """The names and types of a task's training columns, as a schema text."""
    if task == jsonrow.CHAT:
        turn = ", ".join(f"{name}: string" for name in jsonrow.TURN_COLUMNS)
        return f"messages: array<struct<{turn}>>"
    return ", ".join(f"{name}: string" for name in jsonrow.TEXT_COLUMNS[task])


# Row shapes that the tasks stand for, shown to a model; callers may pass their own.
SCHEMA_HINTS = {task: row_shape(task) for task in jsonrow.TASKS}
STANDARD_TEMPLATE = (
    "{instruction}\n\nTask: {task}\nRow shape: {schema}\n\n"
    "Write {ask} rows. Rows so far: {generated}. Answer with JSON lines only."
)
GROUNDED_TEMPLATE = (
    "{instruction}\n\nSource:\n{unit}\n\nTask: {task}\nRow shape: {schema}\n\n"
    "Write {ask} rows from the source alone. Answer with JSON lines only."
)
# Batches that one plan row is first cut into; keeps every array small.
PLAN_BLOCK = 10_000


def schema_hint(task: Column, hints: dict[str, str] | None = None) -> Column:
    hints = SCHEMA_HINTS if hints is None else hints
    pairs = [F.lit(part) for pair in hints.items() for part in pair]
    return F.try_element_at(F.create_map(*pairs), task)


def unit_prompts(units: DataFrame, prompts: list[str] | Column) -> DataFrame:
    """Every unit with every prompt of its list, by exploding the list: no join, no shuffle."""
    listed = F.array(*[F.lit(p) for p in prompts]) if isinstance(prompts, list) else prompts
    return units.select(*units.columns, F.posexplode(listed).alias("prompt_idx", "prompt"))


def attach_units(configs: DataFrame, units: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Each grounded config with the units of its own source, however large that source is.

    ``units`` is ``(source, unit_idx, unit)``; the index is unique within a source.
    """
    return spread_join(units, configs, ["source"], ["unit_idx"], rows_per_task)


def batch_total(count: Column, existing: Column, batch: Column) -> Column:
    left = F.greatest(count - existing, F.lit(0)).cast("long")
    return F.ceil(left / batch).cast("long")


def request_plan(
    df: DataFrame, target: Column, batch: Column, existing: Column | None = None, spread: bool = False,
    done: DataFrame | None = None, keys: list[str] | None = None,
) -> DataFrame:
    """One row per request: ``batch_idx``, its ``ask`` and the ``planned_before`` offset.

    Full batches and a rest; nothing for a target already reached. A huge target is
    exploded in two steps, and with ``spread`` the steps are redistributed between,
    so that one config with most of the requests fills many tasks. Requests that ``done`` holds (``keys`` of
    ``df``, and ``batch_idx``) are left out between the steps, where a text is moved once and not once a request.
    """
    existing = F.lit(0) if existing is None else existing
    left = F.greatest(target - existing, F.lit(0)).cast("long")
    rows = df.withColumns({"_left": left, "_batch": batch.cast("long"), "_existing": existing.cast("long")})
    rows = rows.withColumn("_batches", F.ceil(F.col("_left") / F.col("_batch")).cast("long")).filter("_batches > 0")
    last_block = F.floor((F.col("_batches") - 1) / PLAN_BLOCK).cast("long")
    blocks = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last_block)).alias("_plan_block"))
    # a fixed number: the few rows here would be put together, but not what they grow into
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = F.col("_plan_block") * PLAN_BLOCK
    end = F.least(first + PLAN_BLOCK, F.col("_batches")) - 1
    numbers = F.sequence(first, end)
    if done is not None:
        # a struct is never NULL, so NULL keys match; the deal is the join's own
        blocks = blocks.withColumn("_slot", F.struct(*keys, "_plan_block"))
        slot = F.struct(*keys, F.floor(F.col("batch_idx") / PLAN_BLOCK).cast("long").alias("_plan_block")).alias("_slot")
        held = done.groupBy(slot).agg(F.collect_set("batch_idx").alias("_done"))
        blocks = (blocks.repartition(tasks, "_slot") if spread else blocks).join(held, "_slot", "left")
        numbers = F.array_except(numbers, F.coalesce("_done", F.array().cast("array<bigint>")))
    elif spread:
        blocks = blocks.repartition(tasks, F.xxhash64(*df.columns), F.col("_plan_block"))
    plan = blocks.select("*", F.explode(numbers).alias("batch_idx"))
    before = F.col("batch_idx") * F.col("_batch")
    return plan.select(
        *df.columns, "batch_idx",
        F.least(F.col("_batch"), F.col("_left") - before).alias("ask"),
        (F.col("_existing") + before).alias("planned_before"),
    )


def request_id(*keys: str) -> Column:
    """A request's name: its keys, joined."""
    return F.concat_ws("/", *[F.col(key).cast("string") for key in keys])


def render_request(plan: DataFrame, template: str = STANDARD_TEMPLATE, hints: dict[str, str] | None = None) -> DataFrame:
    """Add the ``message`` of a standard request."""
    return plan.withColumn("message", fill_template(
        template, instruction=F.col("user_prompt"), task=F.upper("task"), schema=schema_hint(F.col("task"), hints),
        ask=F.col("ask"), generated=F.col("planned_before"),
    ))


def render_grounded(plan: DataFrame, template: str = GROUNDED_TEMPLATE, hints: dict[str, str] | None = None) -> DataFrame:
    """Add the ``message`` of a grounded request: the same with its source unit."""
    return plan.withColumn("message", fill_template(
        template, instruction=F.col("prompt"), unit=F.col("unit"), task=F.upper("task"),
        schema=schema_hint(F.col("task"), hints), ask=F.col("ask"),
    ))


def attribute_responses(responses: DataFrame, plan: DataFrame) -> DataFrame:
    """Each response with its request; ids are unique on both sides."""
    return plan.join(responses, "request_id")


def remaining_requests(plan: DataFrame, done: DataFrame) -> DataFrame:
    return plan.join(done.select("request_id"), "request_id", "left_anti")


def resume_union(existing: DataFrame, new: DataFrame) -> DataFrame:
    return existing.unionByName(new)


def expected_rows(units: DataFrame, prompts: Column, count: Column, *keys: str) -> DataFrame:
    """Rows that a grounded run is to give: count x prompts, over all units."""
    return units.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sources"), F.sum(F.size(prompts) * count).cast("long").alias("expected")
    )

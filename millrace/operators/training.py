"""Before training: method and task compatibility, step arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions import jsonrow

# Which tasks each training method takes.
METHOD_TASKS = {
    "lora": (jsonrow.SFT, jsonrow.CHAT),
    "qlora": (jsonrow.SFT, jsonrow.CHAT),
    "full": (jsonrow.SFT, jsonrow.CHAT),
    "dpo": (jsonrow.DPO,),
    "grpo": (jsonrow.RL,),
    "ppo": (jsonrow.RL,),
}


def compat_matrix(spark) -> DataFrame:
    """``(method, task)`` pairs that fit, as a table of fixed size."""
    pairs = ", ".join(f"('{method}', '{task}')" for method, tasks in METHOD_TASKS.items() for task in tasks)
    return spark.sql(f"SELECT * FROM VALUES {pairs} AS matrix(method, task)")


def effective_task() -> Column:
    return F.when(F.coalesce(F.col("task_override"), F.lit("")) != "", F.col("task_override")).otherwise(F.col("task"))


def _given(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def check_compat(runs: DataFrame) -> DataFrame:
    """``(run, method, task, code)``: the first rule a run breaks, NULL when it may start.

    A task override wins over the detected task.
    """
    method, task = F.col("method"), F.col("task")
    rl_method = method.isin("grpo", "ppo")
    code = (
        F.when((method == "dpo") & (task != jsonrow.DPO), "dpo_needs_dpo")
        .when((task == jsonrow.DPO) & (method != "dpo"), "dpo_rows_need_dpo")
        .when(rl_method & (task != jsonrow.RL), "method_needs_rl")
        .when((task == jsonrow.RL) & ~rl_method, "rl_rows_need_rl")
        .when((method == "ppo") & ~_given("reward_model") & ~_given("reward_fn"), "ppo_needs_reward")
        .when(~method.isin(*METHOD_TASKS), "unsupported")
        .when(~task.isin(*jsonrow.TASKS), "unsupported")
    )
    return runs.withColumn("task", effective_task()).select("run", "method", "task", code.alias("code"))


def incompatible(runs: DataFrame) -> DataFrame:
    """Runs whose method and task are no pair of the matrix."""
    wanted = runs.withColumn("task", effective_task()).select("run", "method", "task")
    return wanted.join(compat_matrix(runs.sparkSession), ["method", "task"], "left_anti").select("run", "method", "task")


def training_steps(count: Column, batch: Column, accum: Column, epochs: Column) -> Column:
    """Optimiser steps: at least one per epoch."""
    per_step = (batch * accum).cast("long")
    whole = (count.cast("long") - F.pmod(count.cast("long"), per_step)) / per_step
    return (F.greatest(whole.cast("long"), F.lit(1)) * epochs).cast("long")


def gen_params(prompts: DataFrame, max_tokens: int = 256, temperature: float = 0.7) -> DataFrame:
    """Generation defaults: an empty prompt is one space, a temperature above zero samples."""
    df = prompts
    for name, default in (("max_tokens", max_tokens), ("temperature", temperature)):
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default))
    return df.withColumns({
        "prompt": F.when(F.coalesce(F.col("prompt"), F.lit("")) == "", " ").otherwise(F.col("prompt")),
        "do_sample": F.col("temperature") > 0,
    })

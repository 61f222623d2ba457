"""Registered queries: dataset lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import jsonrow
from millrace.functions.text import format_chat, format_sft, strip
from millrace.operators import datasets as ds
from millrace.queries import fixtures as fx
from millrace.queries.fixtures import Query


def classified(spark, folder):
    return ds.classify_lines(fx.lines(spark, folder))


def chat_rows(turns):
    """Conversations as chat rows, one each."""
    turn = F.struct("turn", F.col("role"), F.col("text").alias("content"))
    rows = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(turn)).alias("turns")
    )
    messages = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    return rows.select("conv_id", messages.alias("messages"))


def formatted_chats(spark, folder):
    rows = chat_rows(fx.table(spark, folder, "conversations"))
    return rows.select("conv_id", format_chat(F.col("messages")).alias("text"))


def strict_json(spark, folder):
    rows = fx.lines(spark, folder).withColumn("raw", strip(F.col("raw"))).filter("raw <> ''")
    return jsonrow.with_value(rows).select("line_no", F.col("value").isNotNull().alias("valid"))


def sft_rows(spark, folder):
    return ds.project_task(classified(spark, folder), jsonrow.SFT, "line_no")


# One verdict per dataset, from the classified lines' order alone.
VERDICTS = """
ranked AS (SELECT *, status IN ('sft', 'chat', 'dpo', 'rl') AS is_task FROM classified),
leads AS (SELECT dataset, min(line_no) FILTER (is_task) AS lead_line, arg_min(status, line_no) FILTER (is_task) AS lead,
  count(*) FILTER (is_task) AS n_rows, count(*) FILTER (status = 'unrecognised') AS n_skipped FROM ranked GROUP BY dataset),
faults AS (SELECT dataset, min(line_no) AS fault_line, arg_min(status, line_no) AS what FROM ranked JOIN leads USING (dataset)
  WHERE status IN ('bad_json', 'non_object') OR (is_task AND status <> lead) GROUP BY dataset),
verdicts AS (SELECT dataset, what IS NULL AND lead IS NOT NULL AS ok, lead, n_rows, n_skipped, fault_line,
  CASE WHEN what IN ('bad_json', 'non_object') THEN what WHEN what IS NOT NULL THEN 'mixed_tasks' WHEN lead IS NULL THEN 'no_rows' END AS error,
  what FROM leads LEFT JOIN faults USING (dataset)),
dataset_verdicts AS (SELECT dataset, ok, CASE WHEN ok THEN lead END AS task, CASE WHEN ok THEN n_rows END AS count,
  CASE WHEN ok THEN n_skipped END AS skipped, error, fault_line AS error_line,
  CASE WHEN error = 'mixed_tasks' THEN lead END AS expected, CASE WHEN error = 'mixed_tasks' THEN what END AS found FROM verdicts)
"""
# A lenient load skips values that are no object.
LENIENT = VERDICTS.replace("status IN ('bad_json', 'non_object') OR", "status = 'bad_json' OR")

QUERIES = {
    "task_detect": Query(
        lambda spark, folder: classified(spark, folder).select("source", "line_no", "status"),
        f"WITH {fx.CLASSIFIED} SELECT source, line_no, status FROM classified",
    ),
    "json_strict": Query(
        strict_json, f"WITH {fx.CLASSIFIED} SELECT line_no, json_valid(raw) AS valid FROM stripped WHERE raw <> ''"
    ),
    "non_object_filter": Query(
        lambda spark, folder: classified(spark, folder).filter("status = 'non_object'").select("source", "line_no", "raw"),
        f"WITH {fx.CLASSIFIED} SELECT source, line_no, raw FROM classified WHERE status = 'non_object'",
    ),
    "dataset_validate": Query(
        lambda spark, folder: ds.validate_datasets(classified(spark, folder), "dataset"),
        f"WITH {fx.CLASSIFIED}, {VERDICTS} SELECT * FROM dataset_verdicts",
    ),
    "dataset_load": Query(
        lambda spark, folder: ds.load_lines(fx.lines(spark, folder), "dataset", strict=False)[0]
        .select("dataset", "line_no", "status", "raw"),
        f"WITH {fx.CLASSIFIED}, {LENIENT} SELECT dataset, line_no, status, raw FROM classified "
        "JOIN dataset_verdicts USING (dataset) WHERE ok AND status IN ('sft', 'chat', 'dpo', 'rl')",
    ),
    "project_task": Query(
        lambda spark, folder: ds.project_task(classified(spark, folder), jsonrow.DPO, "line_no"),
        f"WITH {fx.CLASSIFIED} SELECT line_no, raw->>'$.prompt' AS prompt, raw->>'$.chosen' AS chosen, "
        "raw->>'$.rejected' AS rejected FROM classified WHERE status = 'dpo'",
    ),
    "project_chat": Query(
        lambda spark, folder: ds.project_task(classified(spark, folder), jsonrow.CHAT, "line_no").select(
            "line_no", F.size("messages").cast("long").alias("turns"), format_chat(F.col("messages")).alias("text")),
        f"WITH {fx.CLASSIFIED} SELECT line_no, json_array_length(raw, '$.messages')::BIGINT AS turns, "
        "CASE WHEN json_array_length(raw, '$.messages') = 0 THEN '' ELSE '<|' || (raw->>'$.messages[0].role') || '|>' || chr(10) "
        "|| (raw->>'$.messages[0].content') END AS text FROM classified WHERE status = 'chat'",
    ),
    "format_sft": Query(
        lambda spark, folder: sft_rows(spark, folder).select("line_no", format_sft(F.col("prompt"), F.col("completion")).alias("text")),
        f"WITH {fx.CLASSIFIED} SELECT line_no, coalesce(raw->>'$.prompt', '') || coalesce(raw->>'$.completion', '') AS text FROM classified WHERE status = 'sft'",
    ),
    "format_chat": Query(
        formatted_chats,
        "SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || text, chr(10) ORDER BY turn) AS text "
        "FROM conversations GROUP BY conv_id",
    ),
    "dataset_summary": Query(
        lambda spark, folder: ds.dataset_summary(classified(spark, folder), "source"),
        f"WITH {fx.CLASSIFIED} SELECT source, count(*) FILTER (status IN ('sft', 'chat', 'dpo', 'rl')) AS count, "
        "count(*) FILTER (status = 'unrecognised') AS skipped, count(*) FILTER (status IN ('bad_json', 'non_object')) AS invalid, "
        + ", ".join(f"count(*) FILTER (status = '{t}') AS n_{t}" for t in jsonrow.TASKS) + " FROM classified GROUP BY source",
    ),
    "mixed_task_check": Query(
        lambda spark, folder: ds.mixed_tasks(classified(spark, folder), "dataset"),
        f"WITH {fx.CLASSIFIED} SELECT dataset, arg_min(status, line_no) AS first_task, count(DISTINCT status) AS n_tasks FROM classified "
        "WHERE status IN ('sft', 'chat', 'dpo', 'rl') GROUP BY dataset HAVING count(DISTINCT status) > 1",
    ),
    "skip_reasons": Query(
        lambda spark, folder: ds.skip_reasons(classified(spark, folder), "source"),
        f"WITH {fx.CLASSIFIED} SELECT source, status, count(*) AS n_lines FROM classified "
        "WHERE status IN ('bad_json', 'non_object', 'unrecognised') GROUP BY source, status",
    ),
}

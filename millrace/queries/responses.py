"""Registered queries: plans, requests, responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.text import token_count
from millrace.operators import responses as rs
from millrace.operators.udtfs import register_parse_rows
from millrace.plans import requests as rq
from millrace.queries import fixtures as fx
from millrace.queries.fixtures import Query, table
from millrace.sources.units import truncate_units, units_from_table

KEYS = ["source", "unit_idx", "prompt_idx"]
FILL_TARGET = 3


def units(spark, folder):
    return units_from_table(table(spark, folder, "documents"), "doc_id", "text", "source")


def pairs(spark, folder):
    named = fx.spread(units(spark, folder).select("source", "unit_idx"))
    return rq.unit_prompts(named, fx.PROMPTS).drop("prompt")


def plan(spark, folder):
    return rq.request_plan(pairs(spark, folder), F.lit(fx.TARGET), F.lit(fx.BATCH))


def answers(spark, folder):
    """An answer to each request of the plan, with the unit's whole text in its rows."""
    asked = requests_with_texts(spark, folder, t=F.expr(fx.SPARK_JSON_TEXT.format("unit")))
    return asked.select(*KEYS, "batch_idx", F.expr(fx.answer_columns()).alias("response"))


def parsed_answers(spark, folder):
    return rs.parse_responses(answers(spark, folder), "sft").drop("value")


def requests_with_texts(spark, folder, **of_unit):
    """The plan with each unit's whole text and the request's id; columns ``of_unit`` are worked out once a unit."""
    asked = rq.unit_prompts(fx.spread(units(spark, folder)).withColumns(of_unit), fx.PROMPTS).drop("prompt")
    planned = rq.request_plan(asked, F.lit(fx.TARGET), F.lit(fx.BATCH))
    return planned.withColumn("request_id", rq.request_id("unit_idx", "prompt_idx", "batch_idx"))


ID_SQL = "CAST(unit_idx AS VARCHAR) || '/' || CAST(prompt_idx AS VARCHAR) || '/' || CAST(batch_idx AS VARCHAR)"
# An answer: one line, with the unit's whole text as prompt and completion.
WHOLE_ANSWER = fx.shapes("t")[0]
PLANNED_TEXTS = f"{fx.PLAN}, texts AS (SELECT plan.*, text AS unit, {fx.DUCK_JSON_TEXT.format('text')} AS t FROM plan JOIN documents ON unit_idx = doc_id)"


def attributed(spark, folder):
    """Answers with whole texts, told apart by the request's id alone."""
    asked = requests_with_texts(spark, folder)
    came = asked.selectExpr("request_id", f"{fx.SPARK_JSON_TEXT.format('unit')} AS t").selectExpr("request_id", f"{WHOLE_ANSWER} AS response")
    found = rq.attribute_responses(came, asked.drop("unit"))
    return found.select("request_id", "ask", "planned_before", F.md5("response").alias("digest"))


def remaining(spark, folder):
    done = table(spark, folder, "labels").select(
        F.concat(F.col("doc_id").cast("string"), F.lit("/0/0")).alias("request_id")
    )
    found = rq.remaining_requests(requests_with_texts(spark, folder), done)
    return found.select("request_id", "ask", F.md5("unit").alias("digest"))


def messages(spark, folder):
    configs = fx.configs(spark, folder).filter("user_prompt IS NOT NULL AND batch_size > 0")
    planned = rq.request_plan(
        configs.select("name", "user_prompt", "task", "count", "batch_size"), F.col("count"), F.col("batch_size"), spread=True
    )
    return rq.render_request(planned).select("name", "batch_idx", "message")


def grounded_messages(spark, folder):
    rows = rq.unit_prompts(truncate_units(units(spark, folder)), fx.PROMPTS)
    rows = rows.withColumns({"task": F.lit("sft"), "ask": F.lit(fx.BATCH)})
    return rq.render_grounded(rows).select("unit_idx", "prompt_idx", "message")


def hints(spark, folder):
    return fx.configs(spark, folder).select("name", "task", rq.schema_hint(F.col("task")).alias("hint"))


HINT_SQL = "CASE task " + " ".join(f"WHEN '{t}' THEN '{h}'" for t, h in rq.SCHEMA_HINTS.items()) + " END"


def template_sql(template: str, **values: str) -> str:
    """The SQL concatenation that a template stands for."""
    sql = "'" + template.replace("'", "''") + "'"
    for name, value in values.items():
        sql = sql.replace("{" + name + "}", f"' || {value} || '")
    return sql


def attached(spark, folder):
    return rq.attach_units(fx.grounded_configs(spark, folder).select("source", "name"), units(spark, folder)).select(
        "name", "unit_idx", F.length("unit").cast("long").alias("n_chars")
    )


def sparse_answers(spark, folder):
    """Lines of answers of which some are blank."""
    came = answers(spark, folder)
    blank = F.when(F.expr(fx.BLANK), F.lit(" \n")).otherwise(F.col("response"))
    return rs.parse_responses(came.withColumn("response", blank), "sft").drop("value")


def summaries(spark, folder):
    return rs.synth_summary(
        sparse_answers(spark, folder), "source", KEYS, FILL_TARGET, unit="unit_idx", plan=plan(spark, folder)
    )


def running(spark, folder):
    return rs.progress(sparse_answers(spark, folder), KEYS, FILL_TARGET, plan=plan(spark, folder))


def capped(spark, folder):
    valid = parsed_answers(spark, folder).filter("status = 'valid'")
    return rs.cap_to_target(valid, KEYS, FILL_TARGET).select(*KEYS, "batch_idx", "line_idx", "raw")


def limited(spark, folder):
    """One target per source: a few very large groups."""
    valid = parsed_answers(spark, folder).filter("status = 'valid'")
    # a source's rows in unit order, so a unit's place is the batch
    rows = valid.withColumn("place", (F.col("unit_idx") * 8 + F.col("prompt_idx") * 4 + F.col("batch_idx")))
    return rs.cap_to_target(rows, ["source"], F.lit(100), batch="place").select(
        "source", "unit_idx", "prompt_idx", "batch_idx", "line_idx", "raw"
    )


def udtf_rows(spark, folder):
    register_parse_rows(spark)
    fx.responses(spark, folder).createOrReplaceTempView("millrace_responses")
    return spark.sql(
        "SELECT unit_idx, p.line_idx, p.status FROM millrace_responses, LATERAL parse_rows(response, 'sft') p"
    )


def expected(spark, folder):
    counted = units(spark, folder).select("source")
    return rq.expected_rows(counted, F.array(*[F.lit(p) for p in fx.PROMPTS]), F.lit(fx.TARGET), "source")


def totals(spark, folder):
    configs = fx.configs(spark, folder).filter("batch_size > 0")
    return configs.select("name", rq.batch_total(F.col("count"), F.lit(7), F.col("batch_size")).alias("batches"))


QUERIES = {
    "units_from_table": Query(units, "SELECT source, doc_id AS unit_idx, text AS unit FROM documents"),
    "truncate_units": Query(
        lambda spark, folder: truncate_units(units(spark, folder)).select("unit_idx", "unit"),
        "SELECT doc_id AS unit_idx, CASE WHEN length(text) > 8000 THEN substring(text, 1, 8000) || chr(10) || "
        "'... [truncated at 8000 chars]' ELSE text END AS unit FROM documents",
    ),
    "line_filter": Query(
        lambda spark, folder: rs.candidate_lines(fx.responses(spark, folder)),
        f"WITH {fx.CANDIDATES} SELECT * FROM candidates",
    ),
    "schema_match_filter": Query(
        lambda spark, folder: rs.match_task(
            rs.classify_candidates(rs.candidate_lines(fx.responses(spark, folder))), "dpo"
        ).select("unit_idx", "line_idx", "raw"),
        f"WITH {fx.CANDIDATES}, {fx.parsed_sql('dpo', 'source, unit_idx')} "
        "SELECT unit_idx, line_idx, raw FROM parsed WHERE status = 'valid'",
    ),
    "parse_response": Query(
        lambda spark, folder: rs.parse_responses(fx.responses(spark, folder), "sft").select(
            "source", "unit_idx", "line_idx", "status", F.length("raw").cast("long").alias("n_chars")),
        f"WITH {fx.PARSED} SELECT source, unit_idx, line_idx, status, length(raw) AS n_chars FROM parsed",
    ),
    "parse_counts": Query(
        lambda spark, folder: rs.parse_counts(rs.parse_responses(fx.responses(spark, folder), "sft"), "source"),
        f"WITH {fx.PARSED} SELECT source, count(*) FILTER (status = 'valid') AS valid, "
        "count(*) FILTER (status <> 'valid') AS skipped FROM parsed GROUP BY source",
    ),
    "parse_udtf": Query(udtf_rows, f"WITH {fx.PARSED} SELECT unit_idx, line_idx, status FROM parsed"),
    "unit_prompt_cross": Query(
        lambda spark, folder: rq.unit_prompts(units(spark, folder), fx.PROMPTS),
        "SELECT source, doc_id AS unit_idx, text AS unit, CAST(i AS INTEGER) AS prompt_idx, p AS prompt FROM documents, "
        f"(SELECT unnest([0, 1]) AS i, unnest({fx.PROMPTS}) AS p)",
    ),
    "request_plan": Query(plan, f"WITH {fx.PLAN} SELECT * FROM plan"),
    "attribute_response": Query(
        attributed,
        f"WITH {PLANNED_TEXTS} SELECT {ID_SQL} AS request_id, ask, planned_before, md5({WHOLE_ANSWER}) AS digest FROM texts",
    ),
    "remaining_requests": Query(
        remaining,
        f"WITH {PLANNED_TEXTS}, named AS (SELECT {ID_SQL} AS request_id, ask, md5(unit) AS digest FROM texts) SELECT request_id, ask, digest FROM named "
        "WHERE request_id NOT IN (SELECT CAST(doc_id AS VARCHAR) || '/0/0' FROM labels)",
    ),
    "config_unit_join": Query(
        attached,
        f"WITH {fx.GROUNDED_CONFIGS} SELECT name, doc_id AS unit_idx, length(text) AS n_chars FROM grounded JOIN documents USING (source)",
    ),
    "render_request": Query(
        messages,
        f"WITH {fx.CONFIGS}, planned AS (SELECT *, unnest(range(0, CAST(ceil(count / batch_size) AS BIGINT))) AS batch_idx FROM configs "
        "WHERE user_prompt IS NOT NULL AND batch_size > 0 AND count > 0) SELECT name, batch_idx, "
        + template_sql(
            rq.STANDARD_TEMPLATE, instruction="user_prompt", task="upper(task)", schema=f"({HINT_SQL})",
            ask="CAST(least(batch_size, count - batch_idx * batch_size) AS VARCHAR)",
            generated="CAST(batch_idx * batch_size AS VARCHAR)",
        ) + " AS message FROM planned",
    ),
    "render_gfs_request": Query(
        grounded_messages,
        "WITH units AS (SELECT doc_id AS unit_idx, CASE WHEN length(text) > 8000 THEN substring(text, 1, 8000) || chr(10) || "
        "'... [truncated at 8000 chars]' ELSE text END AS unit FROM documents), asked AS (SELECT *, 'sft' AS task FROM units, "
        f"(SELECT unnest([0, 1]) AS prompt_idx, unnest({fx.PROMPTS}) AS prompt)) SELECT unit_idx, prompt_idx, "
        + template_sql(
            rq.GROUNDED_TEMPLATE, instruction="prompt", unit="unit", task="upper(task)", schema=f"({HINT_SQL})", ask=f"'{fx.BATCH}'"
        ) + " AS message FROM asked",
    ),
    "schema_hint": Query(hints, f"WITH {fx.CONFIGS} SELECT name, task, {HINT_SQL} AS hint FROM configs"),
    "expected_rows": Query(
        expected, f"SELECT source, count(*) AS sources, count(*) * 2 * {fx.TARGET} AS expected FROM documents GROUP BY source"
    ),
    "batch_total": Query(
        totals,
        f"WITH {fx.CONFIGS} SELECT name, CAST(ceil(greatest(count - 7, 0) / batch_size) AS BIGINT) AS batches FROM configs WHERE batch_size > 0",
    ),
    "cap_to_target": Query(
        capped,
        f"WITH {fx.PARSED_ANSWERS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY source, unit_idx, prompt_idx "
        f"ORDER BY batch_idx, line_idx) AS n FROM parsed WHERE status = 'valid') SELECT {fx.ANSWER_KEYS}, line_idx, raw FROM ranked "
        f"WHERE n <= {FILL_TARGET}",
    ),
    "limit_target": Query(
        limited,
        f"WITH {fx.PARSED_ANSWERS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY unit_idx, prompt_idx, "
        f"batch_idx, line_idx) AS n FROM parsed WHERE status = 'valid') SELECT {fx.ANSWER_KEYS}, line_idx, raw FROM ranked WHERE n <= 100",
    ),
    "progress_running": Query(
        running,
        f"WITH {fx.PARSED_ANSWERS}, per_batch AS (SELECT {fx.ANSWER_KEYS}, count(*) FILTER (status = 'valid' AND NOT {fx.BLANK}) AS valid, "
        f"count(*) FILTER (status <> 'valid' AND NOT {fx.BLANK}) AS skipped FROM plan LEFT JOIN parsed USING ({fx.ANSWER_KEYS}) GROUP BY {fx.ANSWER_KEYS}) SELECT {fx.ANSWER_KEYS}, "
        f"CAST(least(sum(valid) OVER w, {FILL_TARGET}) AS BIGINT) AS generated, CAST(sum(skipped) OVER w AS BIGINT) AS total_skipped "
        "FROM per_batch WINDOW w AS (PARTITION BY source, unit_idx, prompt_idx ORDER BY batch_idx)",
    ),
    "synth_summary": Query(
        summaries,
        f"WITH {fx.PARSED_ANSWERS}, fills AS (SELECT source, unit_idx, prompt_idx, least(count(*) FILTER (status = 'valid' AND NOT {fx.BLANK}), {FILL_TARGET}) AS g, "
        f"count(*) FILTER (status <> 'valid' AND NOT {fx.BLANK}) AS s FROM plan LEFT JOIN parsed USING ({fx.ANSWER_KEYS}) GROUP BY source, unit_idx, prompt_idx) SELECT source, "
        "CAST(sum(g) AS BIGINT) AS generated, CAST(sum(s) AS BIGINT) AS skipped, count(DISTINCT unit_idx) AS sources FROM fills GROUP BY source",
    ),
    "token_count": Query(
        lambda spark, folder: fx.spread(table(spark, folder, "documents").select("doc_id", "text")).select(
            "doc_id", token_count(F.col("text")).cast("long").alias("tokens")),
        "SELECT doc_id, len(regexp_extract_all(text, '[^\\x09-\\x0d\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}"
        "\\x{202f}\\x{205f}\\x{3000}]+')) AS tokens FROM documents",
    ),
    "resume_union": Query(
        lambda spark, folder: rq.resume_union(
            table(spark, folder, "conversations").filter("role = 'user'"), table(spark, folder, "conversations").filter("role <> 'user'")
        ).select("conv_id", "turn", "text"),
        "SELECT conv_id, turn, text FROM conversations",
    ),
}

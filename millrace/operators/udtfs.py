"""Response parsing as a table function for SQL callers, written in SQL itself."""

from __future__ import annotations

from pyspark.sql import SparkSession

from millrace.functions import jsonrow
from millrace.functions.text import CODE_FENCE, LINE_BREAK, SPACES
from millrace.operators.responses import VALID, WRONG_TASK

_TASKS = ", ".join(f"'{task}'" for task in jsonrow.TASKS)


def _bound(value: str, name: str, then: str) -> str:
    """``then`` with ``name`` standing for ``value``, which is worked out once."""
    return f"get(transform(array({value}), {name} -> {then}), 0)"


def _status_sql() -> str:
    """The status of the line ``raw`` for the task ``task``, as ``parse_responses`` gives it."""
    has = {key: f"try_variant_get(value, '$.{key}', 'variant') IS NOT NULL" for key in jsonrow.TASK_KEYS}
    flags = ", ".join(f"'{key}', {test}" for key, test in has.items())
    found = (
        f"CASE WHEN value IS NULL AND octet_length(raw) > {jsonrow.LARGE_LINE} THEN '{jsonrow.TOO_LARGE}' "
        f"WHEN value IS NULL THEN '{jsonrow.BAD_JSON}' WHEN NOT startswith(raw, '{{') THEN '{jsonrow.NON_OBJECT}' "
        f"WHEN held.prompt AND held.chosen AND held.rejected THEN '{jsonrow.DPO}' "
        f"WHEN held.messages AND startswith(schema_of_variant(try_variant_get(value, '$.messages', 'variant')), 'ARRAY') THEN '{jsonrow.CHAT}' "
        f"WHEN held.prompt AND held.completion THEN '{jsonrow.SFT}' "
        f"WHEN held.prompt AND NOT (held.completion OR held.chosen OR held.messages) THEN '{jsonrow.RL}' "
        f"ELSE '{jsonrow.UNRECOGNISED}' END"
    )
    verdict = f"CASE WHEN found = task THEN '{VALID}' WHEN found IN ({_TASKS}) THEN '{WRONG_TASK}' ELSE found END"
    of_value = _bound(f"named_struct({flags})", "held", _bound(found, "found", verdict))
    return _bound(jsonrow.guarded_sql("raw"), "pair", _bound(jsonrow.sole_value_sql("raw", "pair"), "value", of_value))


def _parse_rows_sql() -> str:
    """One generator over the response's own row: with a filter or a projection above the split Spark would join the
    distinct responses to their lines, which shuffles each whole response."""
    numbered = (
        f"transform(split(response, '{jsonrow.sql_text(LINE_BREAK)}'), "
        f"(piece, i) -> named_struct('line_idx', i, 'raw', btrim(piece, '{jsonrow.sql_text(SPACES)}')))"
    )
    wanted = f"filter({numbered}, line -> line.raw <> '' AND NOT startswith(line.raw, '{CODE_FENCE}'))"
    status = _bound("line.raw", "raw", _status_sql())
    rows = f"transform({wanted}, line -> named_struct('line_idx', line.line_idx, 'raw', line.raw, 'status', {status}))"
    return f"SELECT line_idx, raw, status FROM inline({rows}) AS parsed(line_idx, raw, status)"


def register_parse_rows(spark: SparkSession) -> None:
    """``parse_rows(response, task)``: candidate lines with their status, as ``parse_responses`` gives them."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION parse_rows(response STRING, task STRING) "
        f"RETURNS TABLE (line_idx INT, raw STRING, status STRING) RETURN {_parse_rows_sql()}"
    )

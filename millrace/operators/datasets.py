"""Dataset lines: classification, whole-dataset validation, typed projection, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.functions import jsonrow
from millrace.functions.text import strip
from millrace.operators.skew import ROWS_PER_TASK, spread_join
from millrace.session import settle

BLANK = "blank"


def classify_lines(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Add the parsed ``value`` and the ``status`` of each line.

    ``raw`` becomes the stripped line. The status is a task, ``blank``, or the
    reason why the line has no task.
    """
    rows = jsonrow.with_value(lines.withColumn(raw, strip(F.col(raw))), raw)
    status = F.when(F.col(raw) == "", BLANK).otherwise(jsonrow.line_status(F.col(raw), F.col("value")))
    return rows.withColumn("status", status)


def recognised(status: str = "status"):
    return F.col(status).isin(*jsonrow.TASKS)


def skip_reasons(classified: DataFrame, *keys: str) -> DataFrame:
    """How many lines were left out, by reason."""
    left_out = classified.filter(~recognised() & (F.col("status") != BLANK))
    return left_out.groupBy(*keys, "status").agg(F.count(F.lit(1)).alias("n_lines"))


def status_positions(classified: DataFrame, dataset: str = "source", line: str = "line_no") -> DataFrame:
    """Per dataset and status: line count and first line."""
    return classified.groupBy(dataset, "status").agg(
        F.count(F.lit(1)).alias("n"), F.min(line).alias("first_line")
    )


def verdicts(positions: DataFrame, dataset: str = "source") -> DataFrame:
    """One row per dataset from its few (status, count, first line) rows.

    The first recognised line sets the task. The first line that is not JSON, is
    no object, or has another task makes the whole dataset invalid.
    """
    status, first_line, n = F.col("status"), F.col("first_line"), F.col("n")
    is_task = status.isin(*jsonrow.TASKS)
    at = F.struct(first_line.alias("line"), status.alias("status"))
    per_status = positions.groupBy(dataset).agg(
        F.min(F.when(is_task, at)).alias("lead"),
        F.min(F.when(status.isin(*jsonrow.INVALID), at)).alias("broken"),
        F.array_sort(F.collect_list(F.when(is_task, at))).alias("tasks"),
        F.coalesce(F.sum(F.when(is_task, n)), F.lit(0)).alias("count"),
        F.coalesce(F.sum(F.when(status == jsonrow.UNRECOGNISED, n)), F.lit(0)).alias("skipped"),
    )
    # at most one entry per task, so the second entry is the first line of another task
    other = F.get("tasks", F.lit(1))
    broken = F.col("broken")
    broken_first = broken.isNotNull() & (other.isNull() | (broken["line"] < other["line"]))
    code = (
        F.when(broken_first, broken["status"])
        .when(other.isNotNull(), F.lit("mixed_tasks"))
        .when(F.col("lead").isNull(), F.lit("no_rows"))
    )
    error_line = F.when(broken_first, broken["line"]).otherwise(other["line"])
    ok = F.col("error").isNull()
    return per_status.select(
        dataset, "lead", "count", "skipped", other["status"].alias("found"), code.alias("error"),
        error_line.alias("error_line"),
    ).select(
        dataset,
        ok.alias("ok"),
        F.when(ok, F.col("lead")["status"]).alias("task"),
        F.when(ok, F.col("count")).alias("count"),
        F.when(ok, F.col("skipped")).alias("skipped"),
        "error",
        "error_line",
        F.when(F.col("error") == "mixed_tasks", F.col("lead")["status"]).alias("expected"),
        F.when(F.col("error") == "mixed_tasks", F.col("found")).alias("found"),
    )


def validate_datasets(classified: DataFrame, dataset: str = "source", line: str = "line_no") -> DataFrame:
    """Validate every dataset in one pass: one aggregation, partial before the shuffle."""
    return verdicts(status_positions(classified, dataset, line), dataset)


def _judged(classified: DataFrame, dataset: str, line: str, strict: bool) -> DataFrame:
    """The written verdicts; an error for an invalid dataset if ``strict``."""
    if not strict:
        skipped = F.when(F.col("status") == jsonrow.NON_OBJECT, jsonrow.UNRECOGNISED).otherwise(F.col("status"))
        classified = classified.withColumn("status", skipped)
    found = settle(validate_datasets(classified, dataset, line), "verdicts")
    if strict:
        worst = found.filter("NOT ok").orderBy(dataset).first()
        if worst:
            at = f" at line {worst.error_line}" if worst.error_line is not None else ""
            raise ValueError(f"dataset {worst[dataset]} is invalid: {worst.error}{at}")
    return found


def _of_valid(rows: DataFrame, found: DataFrame, dataset: str, line: str, rows_per_task: int) -> DataFrame:
    sizes = found.filter("ok").select(dataset, (F.col("count") + F.col("skipped")).alias("n"))
    return spread_join(rows, sizes.select(dataset), [dataset], [line], rows_per_task, sizes).select(*rows.columns)


def load_dataset(classified: DataFrame, dataset: str = "source", line: str = "line_no", strict: bool = True, rows_per_task: int = ROWS_PER_TASK):
    """``(rows, verdicts)``: the recognised lines of valid datasets, and a verdict per dataset.

    With ``strict`` an invalid dataset is an error. Otherwise its rows are left out, and a line that
    holds a value but no object is skipped and counted, like one without a known task.
    The lines are read twice, for the verdicts, which are written, and for the rows:
    write them first (``settle``) when they are costly to compute, or start from the
    unparsed ones (``load_lines``).
    """
    found = _judged(classified, dataset, line, strict)
    return _of_valid(classified.filter(recognised()), found, dataset, line, rows_per_task), found


def load_lines(lines: DataFrame, dataset: str = "source", line: str = "line_no", strict: bool = True, rows_per_task: int = ROWS_PER_TASK):
    """``(rows, verdicts)`` as from ``load_dataset``, out of lines that are not parsed yet.

    The verdicts take one parse that keeps nothing but a status. Then the lines
    of valid datasets are chosen, as text, and only they are parsed for their values: no VARIANT is
    joined or shuffled, and no line of an invalid dataset is parsed again.
    """
    found = _judged(classify_lines(lines), dataset, line, strict)
    kept = _of_valid(lines, found, dataset, line, rows_per_task)
    return classify_lines(kept).filter(recognised()), found


def dataset_summary(classified: DataFrame, *keys: str) -> DataFrame:
    """Recognised and skipped lines per dataset, with the lines of each task."""
    status = F.col("status")
    return classified.groupBy(*keys).agg(
        F.count_if(recognised()).alias("count"),
        F.count_if(status == jsonrow.UNRECOGNISED).alias("skipped"),
        F.count_if(status.isin(*jsonrow.INVALID)).alias("invalid"),
        *[F.count_if(status == task).alias(f"n_{task}") for task in jsonrow.TASKS],
    )


def mixed_tasks(classified: DataFrame, dataset: str = "source", line: str = "line_no") -> DataFrame:
    """Datasets whose lines hold more than one task."""
    per_task = status_positions(classified.filter(recognised()), dataset, line)
    return per_task.groupBy(dataset).agg(
        F.min_by("status", "first_line").alias("first_task"),
        F.count(F.lit(1)).alias("n_tasks"),
    ).filter("n_tasks > 1")


def project_task(classified: DataFrame, task: str, *keep: str) -> DataFrame:
    """The rows of one task as typed columns."""
    return classified.filter(F.col("status") == task).select(*keep, *jsonrow.columns_of(F.col("value"), task))

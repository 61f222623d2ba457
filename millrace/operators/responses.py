"""Model responses: lines, parsing, matching, capping, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.functions import jsonrow
from millrace.functions.text import CODE_FENCE, split_lines, strip
from millrace.operators.ordered import first_rows, ordered_scan

VALID, WRONG_TASK = "valid", "wrong_task"
# Up to this many rows per key Spark limits a ranking before the shuffle
# (spark.sql.optimizer.windowGroupLimitThreshold, default 1000).
EARLY_LIMIT = 1000


def candidate_lines(responses: DataFrame, response: str = "response") -> DataFrame:
    """One stripped line per row; blanks and code fences are dropped, uncounted."""
    rest = [c for c in responses.columns if c != response]
    # stripped before the explode: after it, every mention in a filter would strip again
    lines = F.transform(split_lines(F.col(response)), strip)
    return responses.select(*rest, F.posexplode(lines).alias("line_idx", "raw")).filter(
        (F.col("raw") != "") & ~F.col("raw").startswith(CODE_FENCE)
    )


def classify_candidates(lines: DataFrame, decoded: bool = False) -> DataFrame:
    rows = jsonrow.with_value(lines, decoded=decoded)
    return rows.withColumn("status", jsonrow.line_status(F.col("raw"), F.col("value")))


def _verdict(status: Column, expected: Column) -> Column:
    return F.when(status == expected, F.lit(VALID)).when(status.isin(*jsonrow.TASKS), F.lit(WRONG_TASK)).otherwise(status)


def parse_responses(responses: DataFrame, expected: str | Column, response: str = "response") -> DataFrame:
    """Candidate lines with ``status`` ``valid`` or the reason they are skipped."""
    expected = F.lit(expected) if isinstance(expected, str) else expected
    rows = classify_candidates(candidate_lines(responses, response), decoded=True)
    return rows.withColumn("status", _verdict(F.col("status"), expected))


def first_valid(responses: DataFrame, expected: str | Column, room: Column, response: str = "response") -> DataFrame:
    """Per response its first ``room`` valid lines and the counts of all: ``added``, ``missed``, ``kept`` (``line_idx``, ``raw``).

    The same rules as ``parse_responses``, but a response stays one row: nothing is shuffled, and only
    what is kept goes on. ``response`` is dropped, a NULL one has no lines.
    """
    expected = F.lit(expected) if isinstance(expected, str) else expected
    rest = [c for c in responses.columns if c != response]
    numbered = F.transform(split_lines(F.coalesce(F.col(response), F.lit(""))), lambda line, i: F.struct(i.alias("line_idx"), strip(line).alias("raw")))
    wanted = F.filter(numbered, lambda line: (line["raw"] != "") & ~line["raw"].startswith(CODE_FENCE))
    rows = responses.withColumn("_lines", wanted).withColumn("_raws", F.col("_lines")["raw"])
    rows = rows.withColumn("_pairs", F.expr(f"transform(_raws, raw -> {jsonrow.guarded_sql('raw')})"))
    rows = rows.withColumn("_values", F.expr(f"zip_with(_raws, _pairs, (raw, pair) -> {jsonrow.sole_value_sql('raw', 'pair', decoded=True)})"))
    found = F.zip_with("_raws", "_values", lambda raw, value: jsonrow.line_status(raw, value))
    rows = rows.withColumn("_found", F.transform(found, lambda status: _verdict(status, expected) == VALID))
    valid = F.filter(F.zip_with("_lines", "_found", lambda line, good: F.when(good, line)), lambda line: line.isNotNull())
    rows = rows.withColumn("_valid", valid)
    return rows.select(
        *rest, F.size("_valid").cast("long").alias("added"), (F.size("_lines") - F.size("_valid")).cast("long").alias("missed"),
        F.slice("_valid", F.lit(1), F.greatest(room, F.lit(0)).cast("int")).alias("kept"),
    )


def judged_valid(answers: DataFrame, expected: str | Column, room: Column) -> DataFrame:
    """What ``first_valid`` gives, of answers that were judged where they were made (``functions.answers``): only the
    ``response`` of one that could not be judged there is here and is looked at now."""
    names = ["_added", "_missed", "_places", "_kept"]
    rest = [c for c in answers.columns if c not in ("response", *names)]
    kept = F.zip_with("_places", "_kept", lambda place, raw: F.struct(place.alias("line_idx"), raw.alias("raw")))
    return first_valid(answers, expected, room).select(
        *rest, F.coalesce("_added", "added").alias("added"), F.coalesce("_missed", "missed").alias("missed"),
        F.when(F.col("_added").isNull(), F.col("kept")).otherwise(kept).alias("kept"),
    )


def match_task(classified: DataFrame, expected: str | Column) -> DataFrame:
    return classified.filter(F.col("status") == expected)


def parse_counts(parsed: DataFrame, *keys: str) -> DataFrame:
    valid = F.col("status") == VALID
    return parsed.groupBy(*keys).agg(F.count_if(valid).alias("valid"), F.count_if(~valid).alias("skipped"))


def cap_to_target(
    rows: DataFrame, keys: list[str], target: int | Column, batch: str = "batch_idx", line: str = "line_idx",
    parts: int | None = None,
) -> DataFrame:
    """Keep each key's first ``target`` rows in batch and line order.

    A late batch fills what an earlier one left open. A small target is cut before
    the shuffle; otherwise counts per range of batches tell which ranges hold a key's first rows, and only
    those are ranked, so that a key with very many rows stays spread over tasks.
    """
    if isinstance(target, int) and target <= EARLY_LIMIT:
        # Spark keeps at most the target per key and task before it shuffles
        first = F.row_number().over(Window.partitionBy(*keys).orderBy(batch, line))
        return rows.withColumn("_rank", first).filter(F.col("_rank") <= target).drop("_rank")
    target = F.lit(target) if isinstance(target, int) else target
    return first_rows(rows, keys, [batch, line], target, parts)


def _with_plan(parsed: DataFrame, plan: DataFrame | None, keys: list[str], *more: str) -> DataFrame:
    """The lines and one row without ``status`` per planned request: counted with them, it adds nothing but its keys."""
    lines = parsed.select(*keys, "status", *more)
    return lines if plan is None else lines.unionByName(plan.select(*keys), allowMissingColumns=True)


def progress(
    parsed: DataFrame, keys: list[str], target: int | Column, batch: str = "batch_idx",
    existing: int = 0, parts: int | None = None, plan: DataFrame | None = None,
) -> DataFrame:
    """After each batch: rows generated so far, at most ``target``, and lines skipped so far.

    ``existing`` rows of a resumed output count as generated. With the ``plan`` of requests
    (the keys and the batch) a batch whose answer held no line has its row too.
    """
    target = F.lit(target) if isinstance(target, int) else target
    per_batch = parse_counts(_with_plan(parsed, plan, [*keys, batch]), *keys, batch)
    running = ordered_scan(
        per_batch, keys, [batch], totals={"_valid": F.col("valid"), "total_skipped": F.col("skipped")}, parts=parts
    )
    return running.select(
        *keys, batch, F.least(F.col("_valid") + existing, target).alias("generated"), "total_skipped"
    )


def synth_summary(
    parsed: DataFrame, config: str, fill_keys: list[str], target: int | Column, unit: str | None = None,
    started: str = "started", ended: str = "ended", plan: DataFrame | None = None,
) -> DataFrame:
    """Per config: rows generated, lines skipped, source units, seconds from first to last response.

    The target holds for each of ``fill_keys``; counting stops there, so capping the
    counts equals counting the capped rows. With the ``plan`` (config, unit and fill keys)
    units and configs whose answers held no line count too; a plan row without a unit
    stands for a config that has none.
    """
    target = F.lit(target) if isinstance(target, int) else target
    keys = list(dict.fromkeys([config, *([unit] if unit else []), *fill_keys]))
    timed = started in parsed.columns
    spans = [F.min(started).alias("_from"), F.max(ended).alias("_to")] if timed else []
    valid = F.col("status") == VALID
    fills = _with_plan(parsed, plan, keys, *([started, ended] if timed else [])).groupBy(*keys).agg(
        F.count_if(valid).alias("_valid"), F.count_if(~valid).alias("_skipped"), *spans
    )
    capped = F.least(F.col("_valid"), target)
    if unit is None:
        counted = fills.groupBy(config).agg(
            F.sum(capped).alias("generated"), F.sum("_skipped").alias("skipped"), *_span(timed)
        )
        return _with_elapsed(counted, timed)
    per_unit = fills.groupBy(config, unit).agg(
        F.sum(capped).alias("generated"), F.sum("_skipped").alias("skipped"),
        *([F.min("_from").alias("_from"), F.max("_to").alias("_to")] if timed else []),
    )
    counted = per_unit.groupBy(config).agg(
        F.sum("generated").alias("generated"), F.sum("skipped").alias("skipped"),
        F.count(unit).alias("sources"), *_span(timed),
    )
    return _with_elapsed(counted, timed)


def _span(timed: bool) -> list[Column]:
    return [F.timestamp_diff("MICROSECOND", F.min("_from"), F.max("_to")).alias("_us")] if timed else []


def _with_elapsed(df: DataFrame, timed: bool) -> DataFrame:
    return df.withColumn("elapsed_s", F.col("_us") / 1e6).drop("_us") if timed else df

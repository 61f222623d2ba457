import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import datasets as ds
from millrace.operators import responses as rs
from millrace.operators.udtfs import register_parse_rows
from millrace.plans import jobs
from millrace.sources import jsonl as src

SFT, RL, DPO = '{"prompt":"p","completion":"c"}', '{"prompt":"p"}', '{"prompt":1,"chosen":2,"rejected":3}'
NONE, BAD, LIST = '{"x":1}', '{"prompt":', "[1]"

SETS = {
    "clean": ([SFT, "", NONE, SFT], (True, "sft", 2, 1, None, None)),
    "mixed": ([NONE, SFT, " ", RL, BAD], (False, None, None, None, "mixed_tasks", 4)),
    "broken": ([SFT, BAD, RL], (False, None, None, None, "bad_json", 2)),
    "list": ([LIST, SFT], (False, None, None, None, "non_object", 1)),
    "empty": ([NONE, ""], (False, None, None, None, "no_rows", None)),
    "dpo": ([DPO], (True, "dpo", 1, 0, None, None)),
}


def as_lines(spark):
    rows = [(name, i, line) for name, (lines, _) in SETS.items() for i, line in enumerate(lines, 1)]
    return spark.createDataFrame(rows, "source string, line_no long, raw string")


def verdict(row):
    return (row.ok, row.task, row["count"], row.skipped, row.error, row.error_line)


def test_validation_rules(spark):
    rows = ds.validate_datasets(ds.classify_lines(as_lines(spark))).collect()
    assert {row.source: verdict(row) for row in rows} == {name: want for name, (_, want) in SETS.items()}


def test_validation_of_files_reports_physical_lines(spark, tmp_path):
    folder = tmp_path / "all.jsonl"
    folder.mkdir()
    for name, (lines, _) in SETS.items():
        # different line ends, all of which count as one line each
        (folder / f"{name}.jsonl").write_bytes("\r\n".join(lines).encode())
    rows = src.validate_files(spark, str(folder)).collect()
    got = {row.source.rsplit("/", 1)[1].removesuffix(".jsonl"): verdict(row) for row in rows}
    assert got == {name: want for name, (_, want) in SETS.items()}


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    for key, value in old.items():
        spark.conf.set(key, value)


def test_line_numbers_hold_across_file_splits(spark, tmp_path, small_splits):
    lines = [json.dumps({"prompt": "x" * (i % 40), "n": i}) if i % 5 else "  " for i in range(1, 2001)]
    lines[1499] = '{"prompt":"a","completion":"b"}'
    path = tmp_path / "big.jsonl"
    path.write_text("\n".join(lines), encoding="utf-8")
    read = src.read_jsonl(spark, str(path))
    assert src.scan_lines(spark, str(path)).select("_start").distinct().count() > 10
    assert {row.line_no: row.raw for row in read.collect()} == {i: line for i, line in enumerate(lines, 1) if line.strip()}
    (row,) = src.validate_files(spark, str(path)).collect()
    assert (row.error, row.error_line, row.expected, row.found) == ("mixed_tasks", 1500, "rl", "sft")


def test_datasets_need_the_suffix(spark, tmp_path):
    with pytest.raises(ValueError):
        src.read_jsonl(spark, str(tmp_path / "a.json"))
    (tmp_path / "A.JSONL").write_text(SFT)
    assert src.read_jsonl(spark, str(tmp_path / "A.JSONL")).count() == 1


def test_load_keeps_rows_of_valid_datasets(spark):
    classified = ds.classify_lines(as_lines(spark))
    rows, _ = ds.load_dataset(classified, strict=False, rows_per_task=1)
    assert sorted((r.source, r.line_no) for r in rows.collect()) == [("clean", 1), ("clean", 4), ("dpo", 1), ("list", 2)]
    with pytest.raises(ValueError, match="dataset broken is invalid: bad_json at line 2"):
        ds.load_dataset(classified)


def test_response_lines(spark):
    fence = "```"
    response = f"{fence}json\r\n{SFT}\n\n  {RL}\x0b{SFT} trailing {LIST}\n{NONE}\n{fence}"
    df = spark.createDataFrame([(1, response)], "request_id int, response string")
    parsed = rs.parse_responses(df, "sft")
    got = [(r.raw, r.status) for r in parsed.orderBy("line_idx").collect()]
    assert got == [
        (SFT, "valid"), (RL, "wrong_task"), (f"{SFT} trailing", "bad_json"), (LIST, "non_object"), (NONE, "unrecognised"),
    ]
    counts = rs.parse_counts(parsed, "request_id").first()
    assert (counts.valid, counts.skipped) == (1, 4)


def test_invalid_utf8_is_bad_json(spark):
    df = spark.createDataFrame([(b'{"prompt":"\xff"}',)], "b binary").select(F.col("b").cast("string").alias("raw"))
    assert ds.classify_lines(df).first().status == "bad_json"


def test_synth_summary_times_runs(spark):
    rows = spark.sql(
        "SELECT * FROM VALUES ('c', 1, 'valid', TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-01 00:00:02'), "
        "('c', 1, 'valid', TIMESTAMP '2024-01-01 00:00:01', TIMESTAMP '2024-01-01 00:00:04.5'), "
        "('c', 2, 'bad_json', TIMESTAMP '2024-01-01 00:00:01', TIMESTAMP '2024-01-01 00:00:03') AS t(config, unit_idx, status, started, ended)"
    )
    row = rs.synth_summary(rows, "config", ["config", "unit_idx"], 1, unit="unit_idx").first()
    assert (row.generated, row.skipped, row.sources, row.elapsed_s) == (1, 1, 2, 4.5)


def test_training_text(spark):
    lines = spark.createDataFrame([("d", 1, SFT), ("d", 2, '{"prompt":"a","completion":null}')], "source string, line_no long, raw string")
    assert sorted(str(r.text) for r in jobs.training_text(lines, "sft").collect()) == ["a", "pc"]
    with pytest.raises(ValueError):
        jobs.training_text(lines, "rl")


def test_large_lines_are_parsed_whole_or_reported(spark):
    sizes = spark.createDataFrame([(1, 40), (2, 140)], "line_no int, mb int").withColumn("source", F.lit("s"))
    text = F.concat(F.lit('{"prompt":"'), F.repeat(F.lit("x"), F.col("mb") * (1 << 20)), F.lit('"}'))
    rows = ds.classify_lines(sizes.withColumn("raw", text)).select("line_no", "status", "source")
    assert {r.line_no: r.status for r in rows.collect()} == {1: "rl", 2: "too_large"}
    assert ds.validate_datasets(rows).first().error == "too_large"


def test_every_line_is_valid_skipped_or_ignored(spark):
    kinds = [SFT, RL, DPO, NONE, BAD, LIST, "", "   ", "```", "```json", "5", '{"messages":[]}']
    chooser = random.Random(7)
    lines = [[chooser.choice(kinds) for _ in range(chooser.randrange(1, 30))] for _ in range(60)]
    df = spark.createDataFrame([(i, "\n".join(batch)) for i, batch in enumerate(lines)], "i int, response string")
    for task, good in (("sft", SFT), ("rl", RL), ("dpo", DPO), ("chat", '{"messages":[]}')):
        counts = {r.i: (r.valid, r.skipped) for r in rs.parse_counts(rs.parse_responses(df, task), "i").collect()}
        for i, batch in enumerate(lines):
            ignored = sum(not line.strip() or line.startswith("```") for line in batch)
            valid, skipped = counts.get(i, (0, 0))
            assert valid == batch.count(good) and valid + skipped + ignored == len(batch)


def test_lenient_load_skips_values_that_are_no_object(spark):
    df = ds.classify_lines(spark.createDataFrame([("d", 1, SFT), ("d", 2, "[1]"), ("d", 3, SFT)], "source string, line_no long, raw string"))
    rows, found = ds.load_dataset(df, strict=False)
    row = found.first()
    assert rows.count() == 2 and (row.ok, row["count"], row.skipped) == (True, 2, 1)
    with pytest.raises(ValueError):
        ds.load_dataset(df)


def test_lines_are_loaded_as_classified_ones_are(spark):
    lines = as_lines(spark).unionByName(spark.createDataFrame([("spaced", 1, f"  {SFT}\t"), ("spaced", 2, " ")], "source string, line_no long, raw string"))
    old, old_verdicts = ds.load_dataset(ds.classify_lines(lines), strict=False)
    for size in (1, 2_000_000):
        new, verdicts = ds.load_lines(lines, strict=False, rows_per_task=size)
        columns = ["source", "line_no", "status", "raw"]
        assert new.columns == old.columns
        assert sorted(map(tuple, new.select(columns).collect())) == sorted(map(tuple, old.select(columns).collect())) != []
        assert sorted(map(tuple, verdicts.collect()), key=str) == sorted(map(tuple, old_verdicts.collect()), key=str)
    rows = ds.project_task(ds.load_lines(lines, strict=False)[0].filter("source = 'spaced'"), "sft")
    assert rows.columns == ["prompt", "completion"] and rows.count() == 1
    with pytest.raises(ValueError, match="is invalid"):
        ds.load_lines(lines)
    assert ds.load_lines(lines.limit(0))[0].count() == 0


def test_lines_are_chosen_before_they_are_parsed(spark):
    rows, _ = ds.load_lines(as_lines(spark), strict=False)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("from_json") < plan.index("Join")  # parents are printed first: the parse stands above the join


def test_planned_requests_without_lines_count(spark):
    rows = spark.createDataFrame([("c", 1, 0, "valid"), ("c", 1, 0, "bad_json")], "config string, unit_idx int, batch_idx int, status string")
    plan = spark.createDataFrame(
        [("c", 1, 0), ("c", 1, 1), ("c", 2, 0), ("d", 7, 0), ("e", None, None)], "config string, unit_idx int, batch_idx int"
    )
    found = rs.synth_summary(rows, "config", ["config", "unit_idx"], 5, unit="unit_idx", plan=plan).collect()
    assert {r.config: (r.generated, r.skipped, r.sources) for r in found} == {"c": (1, 1, 2), "d": (0, 0, 1), "e": (0, 0, 0)}
    steps = rs.progress(rows, ["config", "unit_idx"], 5, plan=plan.filter("unit_idx IS NOT NULL")).collect()
    assert sorted(tuple(r) for r in steps) == [("c", 1, 0, 1, 1), ("c", 1, 1, 1, 1), ("c", 2, 0, 0, 0), ("d", 7, 0, 0, 0)]


def test_table_function_parses_as_the_operator(spark):
    lines = [
        '{"prompt":1,"completion":2}', " ```json", "", '{"prompt":null}', "[1]", "NaN", '{"messages":[]}', '{"messages":1,"prompt":2}',
        '{"prompt":1} x', '{"prompt":"+Infinity u0001~end","completion":""}', "'a'", '{"prompt":1,"chosen":2,"rejected":3}',
    ]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, "\r\n".join(lines)), (4, "")], "id int, response string")
    register_parse_rows(spark)
    df.createOrReplaceTempView("parse_rows_input")
    found = spark.sql("SELECT id, p.* FROM parse_rows_input, LATERAL parse_rows(response, 'sft') p")
    want = rs.parse_responses(df, "sft").select("id", "line_idx", "raw", "status")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and want.count() == 20


def test_table_function_moves_no_response(spark):
    register_parse_rows(spark)
    spark.range(3).selectExpr("id", "repeat('[1]\n', 5) AS response").createOrReplaceTempView("parse_rows_input")
    found = spark.sql("SELECT id, p.line_idx, p.status FROM parse_rows_input, LATERAL parse_rows(response, 'sft') p")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and found.count() == 15

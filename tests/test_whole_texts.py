"""Long texts in requests, answers and array files: what is written, held and cut."""

import json
import os
import random

import pandas as pd
from pyspark.sql import functions as F

from millrace.operators.responses import VALID, first_valid, judged_valid, parse_responses
from millrace.plans import generate as gen
from millrace.plans.ledger import CALL_CHARS, call, portions
from millrace.queries import files, generation
from millrace.session import PYTHON_BATCH, settle, shared_folder


def test_one_array_file_for_each_source_of_a_table_of_many_files(spark, tmp_path):
    rows = [(i, f'text {i}, "[{i % 7}', f"s{i % 20}") for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8).write.parquet(str(tmp_path / "documents.parquet"))
    # the join is planned by hash and turns out small as it runs, as on larger tables
    joins = {"spark.sql.autoBroadcastJoinThreshold": "1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m"}
    try:
        for name, value in joins.items():
            spark.conf.set(name, value)
        got = {(r.source, r.unit_idx): json.loads(r.unit) for r in files.array_files(spark, str(tmp_path)).collect()}
    finally:
        for name in joins:
            spark.conf.unset(name)
    for source in {s for _, _, s in rows}:
        own = [(i, text) for i, text, s in rows if s == source]
        assert [(got[source, k]["id"], got[source, k]["text"]) for k in range(len(own))] == own
    assert len(got) == len(rows)


def test_a_call_gets_no_more_text_than_it_may(spark):
    plan = spark.range(40, numPartitions=1).withColumn("unit", F.repeat(F.lit("é"), F.lit(CALL_CHARS // 8)))

    def sizes():
        return lambda requests: [f"{len(requests)}"] * len(requests)

    got = gen.generate(plan, sizes, keep=["id"]).collect()
    assert sorted(r.id for r in got) == list(range(40)) and max(int(r.response) for r in got) == 8
    batch = pd.DataFrame({"n": range(5), "t": ["x" * 4, None, "x" * 9, "x", ""]})
    assert [list(p.n) for p in portions(batch, 5)] == [[0, 1], [2], [3, 4]]
    assert [list(p.n) for p in portions(batch.iloc[:0], 5)] == []


def test_refill_rounds_write_what_they_keep(spark):
    r = random.Random(5)
    junk = "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(200_000))

    def wordy():
        return lambda requests: [f'{{"prompt":"{u}","completion":"{b}"}}\n{junk}' for u, b in zip(requests.unit_idx, requests.batch_idx)]

    def used():
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(shared_folder(spark).removeprefix("file:")) for f in names)

    before = used()
    pairs = spark.range(4).withColumnRenamed("id", "unit_idx").withColumn("prompt_idx", F.lit(0))
    rows, state = gen.fill_rounds(pairs, ["unit_idx", "prompt_idx"], wordy, "sft", F.lit(2), F.lit(1), 3)
    assert rows.count() == 8 and [(s.written, s.skipped) for s in state.collect()] == [(2, 2)] * 4
    assert used() - before < len(junk)


def test_first_valid_is_what_parsed_lines_give(spark):
    good, other = '{"prompt":"a","completion":"b"}', '{"prompt":"a"}'
    kinds = [good, other, "", "  ", "```json", "no json", "[1]", f" {good} ", f"{good}{good}", '{"messages":[]}', "'x'"]
    r = random.Random(6)
    texts = [r.choice(["\n", "\r\n", " "]).join(r.choice(kinds) for _ in range(r.randrange(9))) for _ in range(60)] + [None, ""]
    df = spark.createDataFrame([(i, t, r.choice(["sft", "rl"]), r.randrange(-1, 4)) for i, t in enumerate(texts)], "i int, response string, task string, room int")
    lines = {}
    for row in parse_responses(df, F.col("task")).orderBy("i", "line_idx").collect():
        lines.setdefault(row.i, []).append(row)
    for row in first_valid(df, F.col("task"), F.col("room")).collect():
        mine = lines.get(row.i, [])
        valid = [(x.line_idx, x.raw) for x in mine if x.status == VALID]
        assert (row.added, row.missed) == (len(valid), len(mine) - len(valid))
        assert [tuple(k) for k in row.kept] == valid[: max(row.room, 0)]


def test_python_workers_get_bounded_batches(spark):
    @F.pandas_udf("long")
    def received(texts: pd.Series) -> pd.Series:
        return pd.Series([int(texts.str.len().sum())] * len(texts))

    rows = spark.range(40, numPartitions=1).select(received(F.repeat(F.lit("x"), F.lit(1 << 20) + F.col("id").cast("int"))).alias("n"))
    assert max(r.n for r in rows.collect()) <= 2 * PYTHON_BATCH


LINES = [
    '{"prompt":"a","completion":"b"}', '{"prompt":"a"}', "", "  ", "```json", "no json", "[1]", ' {"prompt":"é","completion":null}\u3000',
    '{"prompt":1}{"completion":2}', '{"messages":[]}', '{"messages":[],"messages":"x","prompt":1,"completion":2}', "'x'", '{"prompt":1,"completion":2,}',
    '{"pro\\u006dpt":1,"completion":2}', '{"prompt":NaN,"completion":-Infinity}', '{"prompt":-INF,"completion":INF}', '{"prompt":+Infinity,"completion":1}',
    '{"prompt":"+Infinity","completion":1}', '{"prompt":"\\ud800","completion":"\t"}', '{"prompt":"\\ud800","completion":"\\u0001~end"}',
    '{"prompt":01,"completion":1.}', '{"prompt":1e999,"completion":' + "9" * 5000 + "}", '{"prompt":"p","completion":' + "[" * 900 + "]" * 900 + "}",
    '{"prompt":"p","completion":' + "[" * 2_000 + "}", '{"prompt":"p","completion":1,"' + "k" * 49_999 + '":1}', '{"prompt":"p","completion":1,"' + "k" * 50_001 + '":1}',
    '{"prompt":"p","completion":{"x":{"' + "\U0001f600" * 25_001 + '":1}}}', '{"prompt":"p","chosen":1,"rejected":{"prompt":[]}}', '{"a":{"prompt":1,"completion":2}}',
    '{"prompt":"' + "x" * 60_000 + '","completion":2}', '{"completion":2,"prompt":3}\x1f', "\ufeff" + '{"prompt":"a","completion":"b"}', "{}", "{", '"prompt" "completion"',
    '{"prompt":tru,"completion":2}', '{"prompt":"\\x","completion":2}', '{prompt:1,"prompt":1,"completion":2}', '{"prompt":1,"completion":2} // c', "null", "NaN", "INF", "-INF",
]


def test_answers_judged_in_the_worker_are_what_the_parser_gives(spark):
    r = random.Random(7)
    breaks = ["\n", "\r\n", "\r", "\x0b", "\x1c", "\x85", "\u2028"]
    texts = [line for line in LINES] + [r.choice(breaks).join(r.choice(LINES) for _ in range(r.randrange(9))) for _ in range(150)] + [None, ""]
    tasks = ["sft", "rl", "chat", "dpo", "bad_json", "non_object", "unrecognised", None, "other"]
    rows = [(i, t, task, r.randrange(-1, 4)) for i, (t, task) in enumerate([(t, "sft") for t in texts] + [(t, r.choice(tasks)) for t in texts])]
    df = spark.createDataFrame(rows, "i long, response string, _task string, _target long").withColumn("_written", F.lit(0).cast("long"))

    def said():
        return lambda requests: list(requests.response)

    made = call(df, said, keep=["i", "_task", "_target", "_written"], judge=gen._judge_refill)
    verdict = F.col("_task"), F.col("_target") - F.col("_written")
    columns = ["i", "added", "missed", "kept"]
    got = {x.i: x for x in judged_valid(made, *verdict).select(*columns).collect()}
    want = {x.i: x for x in first_valid(df, *verdict).select(*columns).collect()}
    for i, text, task, room in rows:
        assert got[i] == want[i], (text and text[:200], task, room)
    left = {rows[x.i][1] for x in made.filter("response IS NOT NULL").select("i").collect()}
    assert left and all("k" * 9000 in t or "\U0001f600" * 99 in t or "-INF" in t for t in left)


def test_judged_answers_stay_in_the_worker(spark):
    """Of an answer's text only what is kept comes out of Python; a failed call has no line."""
    df = spark.range(3, numPartitions=1).selectExpr("id", "'sft' AS _task", "1L AS _target", "0L AS _written")

    def wordy():
        def respond(requests):
            if 2 in list(requests.id):
                raise ConnectionError("refused")
            return ["x" * 100_000 + '\n{"prompt":1,"completion":2}\n{"prompt":3,"completion":4}'] * len(requests)

        return respond

    found = sorted(call(df, wordy, keep=["id"], judge=gen._judge_refill).drop("started_us", "ended_us").collect())
    assert [(x.response, x._added, x._missed, x._places, x._kept, x.error) for x in found] == [
        (None, 2, 1, [1], ['{"prompt":1,"completion":2}'], None),
    ] * 2 + [(None, 0, 0, [], [], "ConnectionError: refused")]


def test_written_answers_take_less_disk_than_four_times_the_documents(spark):
    """An answer says its unit's text again and again, and so do the unit's other answers in the rows next to it."""
    def size(rows):
        return sum(os.path.getsize(file.removeprefix("file://")) for file in rows.inputFiles())

    folder = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    answers = generation.generated(spark, folder)
    assert answers.count() == 6 * documents.count() and size(answers) < 4 * size(documents)
    assert size(answers) < size(settle(answers, "answers")) / 3

import json

import pytest
from pyspark.sql import functions as F

from millrace.plans import generate as gen
from millrace.plans import jobs
from millrace.plans import requests as rq
from millrace.operators import configs as cf
from millrace.sources.units import load_units


def test_plan_asks_add_up_to_the_target(spark):
    rows = [(i, target, batch, existing) for i, (target, batch, existing) in enumerate(
        [(12, 5, 0), (12, 5, 7), (5, 5, 0), (1, 9, 0), (0, 3, 0), (4, 2, 9), (25_003, 1, 0)])]
    df = spark.createDataFrame(rows, "i int, target int, batch int, existing int")
    for spread in (False, True):
        plan = rq.request_plan(df, F.col("target"), F.col("batch"), F.col("existing"), spread=spread)
        got = {r.i: r for r in plan.groupBy("i").agg(
            F.sum("ask").alias("asked"), F.max("ask").alias("most"), F.min("ask").alias("least"), F.count("*").alias("n"),
            F.max(F.col("planned_before") + F.col("ask")).alias("end"), F.countDistinct("batch_idx").alias("batches"),
        ).collect()}
        for i, target, batch, existing in rows:
            left = max(0, target - existing)
            if not left:
                assert i not in got
                continue
            r = got[i]
            assert (r.asked, r.n, r.batches, r.end) == (left, -(-left // batch), r.n, target)
            assert r.least >= 1 and r.most <= batch


def test_documented_volumes(spark):
    for units, prompts, count, want in ((50, 3, 1, 150), (30, 2, 2, 120)):
        pairs = rq.unit_prompts(spark.range(units).withColumnRenamed("id", "unit_idx"), [f"p{i}" for i in range(prompts)])
        assert rq.request_plan(pairs, F.lit(count), F.lit(10)).agg(F.sum("ask")).first()[0] == want
        expected = rq.expected_rows(spark.range(units), F.array(*[F.lit(str(i)) for i in range(prompts)]), F.lit(count))
        assert expected.first().expected == want


def test_batch_total(spark):
    df = spark.createDataFrame([(12, 0, 5), (12, 7, 5), (3, 9, 5)], "c int, e int, b int")
    got = [r[0] for r in df.select(rq.batch_total(F.col("c"), F.col("e"), F.col("b"))).collect()]
    assert got == [3, 1, 0]


def scripted():
    """Unit 0 gives nothing, unit 1 one row a time, unit 2 more than asked, unit 3 one row every second time."""
    def respond(requests):
        for unit, batch, ask in zip(requests.unit_idx, requests.batch_idx, requests.ask):
            good = [0, 1, ask + 2, batch % 2][unit]
            lines = [f'{{"prompt":"{unit}-{batch}-{i}","completion":"x"}}' for i in range(good)]
            yield "\n".join([*lines, "no json"])

    return lambda requests: list(respond(requests))


def simulate(unit, target, batch, rounds):
    """One pair asked again and again until it has its rows."""
    written, skipped, rows = 0, 0, []
    for number in range(rounds):
        if written >= target:
            break
        ask = min(batch, target - written)
        good = [0, 1, ask + 2, number % 2][unit]
        kept = [f"{unit}-{number}-{i}" for i in range(good)][: target - written]
        rows += kept
        written += len(kept)
        skipped += 1
    return rows, written, skipped


@pytest.mark.parametrize("rounds", [2, 5])
def test_refill_rounds_follow_the_loop(spark, rounds):
    pairs = spark.range(4).withColumnRenamed("id", "unit_idx").withColumn("prompt_idx", F.lit(0))
    rows, state = gen.fill_rounds(pairs, ["unit_idx", "prompt_idx"], scripted, "sft", F.lit(5), F.lit(3), rounds)
    got = sorted(F_value for (F_value,) in rows.selectExpr("get_json_object(raw, '$.prompt')").collect())
    want = [simulate(unit, 5, 3, rounds) for unit in range(4)]
    assert got == sorted(row for kept, _, _ in want for row in kept)
    assert {r.unit_idx: (r.written, r.skipped) for r in state.collect()} == {
        unit: (written, skipped) for unit, (_, written, skipped) in enumerate(want)
    }


def test_generate_builds_the_model_once_per_task(spark, tmp_path):
    log = str(tmp_path / "loads")

    def factory():
        with open(log, "a") as out:
            out.write("x")
        return lambda requests: [f"r{i}" for i in requests.request_id]

    plan = spark.range(100).withColumnRenamed("id", "request_id")
    rows = gen.generate(plan, factory, workers=3)
    assert sorted(rows.collect()) == [(i, f"r{i}") for i in range(100)]
    with open(log) as loads:
        assert len(loads.read()) <= 3


def test_message_templates(spark):
    df = spark.createDataFrame([("do it", "sft", 5, 10, "text {ask}")], "user_prompt string, task string, ask int, planned_before int, unit string")
    message = rq.render_request(df).first().message
    assert message.startswith("do it\n\nTask: SFT\n") and "Write 5 rows. Rows so far: 10." in message
    grounded = rq.render_grounded(df.withColumnRenamed("user_prompt", "prompt"), "{unit}|{ask}|{schema}", {"sft": "hint"}).first().message
    assert grounded == "text {ask}|5|hint"


def test_remaining_and_resume(spark):
    plan = spark.range(10).select(F.col("id").cast("string").alias("request_id"))
    done = spark.createDataFrame([("3",), ("4",), ("99",)], "request_id string")
    assert rq.remaining_requests(plan, done).count() == 8
    assert rq.resume_union(plan, done).count() == 13


def test_one_huge_config_fills_many_tasks(spark):
    df = spark.sql("SELECT 'c' AS name, 300000L AS target")
    plan = rq.request_plan(df, F.col("target"), F.lit(1), spread=True)
    sizes = [r["count"] for r in plan.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 300_000 and len(sizes) >= 6 and max(sizes) < 150_000


def echo():
    """Two good rows and a bad line for each request; the row tells what was asked."""
    def respond(requests):
        for message, model in zip(requests.message, requests.model):
            row = json.dumps({"prompt": f"{model}: {message}", "completion": "x"})
            yield "\n".join([row, "bad", row])

    return lambda requests: list(respond(requests))


CONFIG = dict(
    name="n", description="", mode="gfs", user_prompt=None, prompts=["P", "Q"], source=None, glob="", max_source_chars=100, model="m",
    task="sft", count=3, temperature=0.5, batch_size=2, ignore=None,
)


@pytest.mark.parametrize("spread", [False, True])
def test_plan_without_what_is_done(spark, monkeypatch, spread):
    """Blocks of three, a name that is NULL, done requests that no plan holds."""
    monkeypatch.setattr(rq, "PLAN_BLOCK", 3)
    df = spark.createDataFrame([("a", 10), ("b", 4), (None, 7), ("c", 2)], "name string, target int")
    done = [("a", 0), ("a", 1), ("a", 2), ("a", 7), ("b", 3), (None, 6), (None, 0), ("c", 0), ("c", 1), ("z", 1), ("a", 99)]
    whole = rq.request_plan(df, F.col("target"), F.lit(1), spread=spread)
    left = rq.request_plan(df, F.col("target"), F.lit(1), spread=spread, done=spark.createDataFrame(done, "name string, batch_idx long"), keys=["name"])
    assert left.columns == whole.columns
    assert sorted(map(str, left.collect())) == sorted(str(r) for r in whole.collect() if (r.name, r.batch_idx) not in done)


def test_grounded_run_over_files(spark, tmp_path):
    (tmp_path / "list.json").write_text('[{"b": 1, "a": "é"}, 2]', encoding="utf-8")
    (tmp_path / "lines.JSONL").write_text('{"a":1}\n\nno json\n', encoding="utf-8")
    (tmp_path / "plain.md").write_text("y" * 101)
    folder = tmp_path / "dir"
    (folder / "a").mkdir(parents=True)
    (folder / "a" / "b.txt").write_text("ab")
    (folder / "a-b.txt").write_text("a-b")
    (folder / "skip.py").write_text("skip")
    sources = {
        str(tmp_path / "list.json"): ['{"b": 1, "a": "é"}', "2"], str(tmp_path / "lines.JSONL"): ['{"a": 1}', "no json"],
        str(tmp_path / "plain.md"): ["y" * 100 + "\n... [truncated at 100 chars]"], str(folder): ["ab", "a-b"],
    }
    rows = [{**CONFIG, "name": f"c{i}", "source": source} for i, source in enumerate(sources)]
    configs = spark.createDataFrame(rows, cf.CONFIG_SCHEMA)
    units = None
    for source, want in sources.items():
        found = load_units(spark, source, "**/*.txt" if source == str(folder) else "")
        got = [r.unit for r in found.orderBy("unit_idx").collect()]
        assert got == [u.replace("\n... [truncated at 100 chars]", "y") for u in want]
        units = found if units is None else units.unionByName(found)
    out = str(tmp_path / "out")
    summary = jobs.synthesize_grounded(configs, units, echo, out, max_rounds=5, template="{instruction}|{unit}|{ask}")
    got = {r.name: (r.generated, r.skipped, r.sources) for r in summary.collect()}
    # three rows a pair in two requests: two rows, then one; each answer has one bad line
    assert got == {f"c{i}": (3 * 2 * len(u), 2 * 2 * len(u), len(u)) for i, u in enumerate(sources.values())}
    written = spark.read.text(out).selectExpr("name", "get_json_object(value, '$.prompt') AS p").collect()
    want = [
        (f"c{i}", f"m: {prompt}|{unit}|{ask}")
        for i, units_of in enumerate(sources.values()) for unit in units_of for prompt in "PQ" for ask in (2, 2, 1)
    ]
    assert sorted((r.name, r.p) for r in written) == sorted(want)
    with pytest.raises(FileNotFoundError):
        load_units(spark, str(tmp_path / "none.json"))


def test_standard_run_and_resume(spark, tmp_path):
    rows = [{**CONFIG, "mode": None, "prompts": None, "user_prompt": "U", "name": "a", "count": 5}]
    rows.append({**rows[0], "name": "b", "task": "rl", "count": 4})
    configs = spark.createDataFrame(rows, cf.CONFIG_SCHEMA)
    out = str(tmp_path / "out")
    first = {r.name: (r.generated, r.skipped) for r in jobs.synthesize(configs, echo, out, workers=2).collect()}
    # rows of another task than the config's are skipped
    assert first == {"a": (5, 3), "b": (0, 6)}
    assert spark.read.text(out).count() == 5
    more = configs.filter("name = 'a'").withColumn("count", F.lit(8))
    (again,) = jobs.synthesize(more, echo, out, existing=5).collect()
    assert (again.generated, again.skipped) == (8, 2)
    assert spark.read.text(out).count() == 8


def test_bad_configs_stop_a_run(spark, tmp_path):
    good = {**CONFIG, "mode": None, "prompts": None, "user_prompt": "U", "name": "a"}
    for change, problem in (
        ({"task": "odd"}, "invalid_task"), ({"batch_size": 0}, "invalid_batch_size"),
        ({"mode": "gfs", "prompts": ["P"], "source": "s"}, "other_mode"),
    ):
        configs = spark.createDataFrame([good, {**good, **change, "name": "b"}], cf.CONFIG_SCHEMA)
        with pytest.raises(ValueError, match=f"config b: {problem}"):
            jobs.synthesize(configs, echo, str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_each_config_resumes_at_its_own_rows(spark, tmp_path):
    row = {**CONFIG, "mode": None, "prompts": None, "user_prompt": "U", "count": 5, "model": "agentrouter/m"}
    configs = spark.createDataFrame([{**row, "name": "a"}, {**row, "name": "b"}], cf.CONFIG_SCHEMA)
    out = str(tmp_path / "out")
    with pytest.raises(ValueError, match="several configs"):
        jobs.synthesize(configs, echo, out, existing=3)
    done = spark.createDataFrame([("a", 3)], "name string, existing int")
    system = cf.system_text("Base", "in", {"r": "R"}, "out", "end")
    found = jobs.synthesize(configs, echo, out, existing=done, template="{ask}|{generated}", system=system)
    assert {r.name: r.generated for r in found.collect()} == {"a": 5, "b": 5}
    lines = spark.read.text(out).selectExpr("name", "get_json_object(value, '$.prompt') AS p").collect()
    assert sorted((r.name, r.p) for r in lines) == [
        ("a", "m: 2|3"), ("a", "m: 2|3"), ("b", "m: 1|4"), ("b", "m: 2|0"), ("b", "m: 2|0"), ("b", "m: 2|2"), ("b", "m: 2|2"),
    ]


def test_grounded_runs_report_empty_sources_and_refuse_written_outputs(spark, tmp_path):
    rows = [{**CONFIG, "name": name, "source": name} for name in ("full", "empty")]
    configs = spark.createDataFrame(rows, cf.CONFIG_SCHEMA)
    units = spark.createDataFrame([("full", 0, "text")], "source string, unit_idx int, unit string")
    out = str(tmp_path / "out")
    found = {r.name: (r.generated, r.sources) for r in jobs.synthesize_grounded(configs, units, echo, out, max_rounds=5).collect()}
    assert found == {"full": (6, 1), "empty": (0, 0)}
    with pytest.raises(FileExistsError):
        jobs.synthesize_grounded(configs, units, echo, out, max_rounds=5)

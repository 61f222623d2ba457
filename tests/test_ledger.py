"""Runs with failing calls, runs that die, and outputs that are replaced in part."""

import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from millrace.operators import configs as cf
from millrace.operators.configs import sequential_status
from millrace.plans import generate as gen
from millrace.plans import jobs
from millrace.plans.ledger import answered, call, record
from millrace.queries import generation
from tests.test_plans import CONFIG

ROW = '{"prompt":"p","completion":"c"}'


def configs(spark, *names, count=4):
    plain = {**CONFIG, "mode": None, "prompts": None, "user_prompt": "Write."}
    return spark.createDataFrame([{**plain, "name": n, "count": count} for n in names], cf.CONFIG_SCHEMA)


def model(bad=(), log=None):
    def load():
        def respond(requests):
            if log:
                with open(os.path.join(log, f"{os.getpid()}-{os.urandom(4).hex()}"), "w") as file:
                    file.write("\n".join(f"{n}/{b}" for n, b in zip(requests.name, requests.batch_idx)))
            if any(n in bad for n in requests.name):
                raise ConnectionError("refused")
            return ["\n".join([ROW] * 2)] * len(requests)

        return respond

    return load


def logged(folder):
    return sorted(line for f in folder.iterdir() for line in f.read_text().splitlines())


def test_one_failing_config_leaves_the_others(spark, tmp_path):
    out = str(tmp_path / "out")
    found = {r.name: r for r in jobs.synthesize(configs(spark, "a", "b", "c/d"), model(bad=("b",)), out).collect()}
    assert {n: (r.generated, r.skipped, r.error) for n, r in found.items()} == {"a": (4, 0, None), "b": (0, 0, "ConnectionError: refused"), "c/d": (4, 0, None)}
    assert all(r.elapsed_s >= 0 for r in found.values())
    assert os.path.isdir(found["c/d"].output) and found["c/d"].output.endswith("name=c%2Fd")


def test_sequential_runs_stop_at_the_first_failure(spark, tmp_path):
    results = jobs.one_after_another(configs(spark, "a", "b", "c"), lambda one: jobs.synthesize(one, model(bad=("b",)), str(tmp_path / "out"), run="r"))
    assert [(r.name, r.error) for r in results.orderBy("position").collect()] == [("a", None), ("b", "ConnectionError: refused")]
    (status,) = sequential_status(results.withColumn("run_id", F.lit("r"))).collect()
    assert (status.configs, status.stopped_at, status.run_failed) == (2, 1, True)


def test_failures_are_rows_of_their_requests(spark):
    plan = spark.createDataFrame([(n, 0) for n in "abcd"], "name string, batch_idx long").coalesce(1)
    found = {r.name: (r.response is None, r.error) for r in call(plan, model(bad=("b", "d"))).collect()}
    assert found == {n: (n in "bd", "ConnectionError: refused" if n in "bd" else None) for n in "abcd"}

    def unloadable():
        raise MemoryError("too large")

    assert {r.error for r in call(plan, unloadable).collect()} == {"MemoryError: too large"}
    assert {r.error for r in call(plan, lambda: lambda rows: ["x", "y"]).collect()} == {"ValueError: 2 answers to 1 requests"}


def test_a_killed_run_asks_only_its_open_requests(spark, tmp_path):
    """The worker dies in one task after the others have ended: what they answered is not asked again."""
    ledger, first, second = str(tmp_path / "ledger"), tmp_path / "first", tmp_path / "second"
    first.mkdir()
    second.mkdir()
    plan = spark.createDataFrame([(f"c{i}", 0) for i in range(12)], "name string, batch_idx long").repartition(6, "name")
    poison = "c7"

    def dying():
        ask = model(log=str(first))()

        def respond(requests):
            if poison in list(requests.name):
                import glob
                import time

                for _ in range(600):  # until the others' files are there
                    time.sleep(0.1)
                    if len(glob.glob(f"{ledger}/part-*")) >= others:
                        break
                os._exit(1)
            return ask(requests)

        return respond

    groups = plan.select("name", F.spark_partition_id().alias("p")).groupBy("p").agg(F.collect_list("name").alias("names")).collect()
    others = sum(poison not in g.names for g in groups)
    with pytest.raises(Exception, match="crash|exited|EOF|Python worker"):
        record(plan, ["name", "batch_idx"], dying, ledger)
    kept = {r.name for r in answered(spark, ledger).collect()}
    assert kept and poison not in kept
    rows = record(plan, ["name", "batch_idx"], model(log=str(second)), ledger)
    assert sorted(r.name for r in rows.collect()) == sorted(f"c{i}" for i in range(12))
    assert logged(second) == sorted(f"{n}/0" for n in {f"c{i}" for i in range(12)} - kept)


def test_failed_requests_are_asked_again(spark, tmp_path):
    ledger, log = str(tmp_path / "ledger"), tmp_path / "log"
    log.mkdir()
    jobs.synthesize(configs(spark, "a", "b"), model(bad=("b",)), str(tmp_path / "1"), ledger=ledger)
    found = {r.name: (r.generated, r.error) for r in jobs.synthesize(configs(spark, "a", "b"), model(log=str(log)), str(tmp_path / "2"), ledger=ledger).collect()}
    assert found == {"a": (4, None), "b": (4, None)}
    assert logged(log) == ["b/0", "b/1"]
    again = jobs.synthesize(configs(spark, "a", "b"), model(bad=("a", "b")), str(tmp_path / "3"), ledger=ledger)
    assert {r.name: (r.generated, r.error) for r in again.collect()} == found


def test_a_restart_moves_texts_once_a_config(spark, tmp_path, monkeypatch):
    """The open requests are found before the plan is exploded: no message, with its text, is shuffled."""
    ledger, plans = str(tmp_path / "ledger"), []
    jobs.synthesize(configs(spark, "a", "b"), model(bad=("b",)), str(tmp_path / "1"), ledger=ledger)
    monkeypatch.setattr("millrace.plans.ledger.call", lambda plan, *rest: plans.append(plan) or call(plan, *rest))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        jobs.synthesize(configs(spark, "a", "b"), model(), str(tmp_path / "2"), ledger=ledger)
        plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above = plan[:plan.index("Generate explode(array_except")]
    assert "Join" not in above and "Exchange" not in above and "Join" in plan


def test_standard_configs_are_read_once(spark, monkeypatch):
    """The steps of a run read the chosen configs, not all documents and rules again."""
    given = []
    monkeypatch.setattr(generation.jobs, "synthesize", lambda configs, *rest, **more: given.append(configs) or configs)
    with pytest.raises(AnalysisException, match="generated"):
        generation.standard_job(spark, "/root/testdata/sf0.001")
    assert given[0].count() > 0 and not any("documents" in file for file in given[0].inputFiles())


def test_a_rerun_of_one_config_leaves_the_others(spark, tmp_path):
    out = str(tmp_path / "out")

    def rows():
        found = spark.read.option("basePath", out).text(out)
        return {(r.run_id, r.name): r["count"] for r in found.groupBy("run_id", "name").count().collect()}

    jobs.synthesize(configs(spark, "a", "b"), model(), out, run="r1")
    jobs.synthesize(configs(spark, "b", count=6), model(), out, run="r1")
    jobs.synthesize(configs(spark, "b", count=2), model(), out, run="r2")
    assert rows() == {("r1", "a"): 4, ("r1", "b"): 6, ("r2", "b"): 2}


def test_grounded_runs_keep_failures_apart_and_restart(spark, tmp_path):
    rows = [{**CONFIG, "name": n, "prompts": ["P"], "source": "s", "batch_size": 1} for n in ("a", "b")]
    grounded = spark.createDataFrame(rows, cf.CONFIG_SCHEMA)
    units = spark.createDataFrame([("s", i, f"text {i}") for i in range(3)], "source string, unit_idx long, unit string")

    def one_row(bad=()):
        return lambda: lambda requests: model(bad)()(requests) and [ROW] * len(requests)

    def go(factory, name):
        found = jobs.synthesize_grounded(grounded, units, factory, str(tmp_path / name), 5, run="r", ledger=str(tmp_path / "ledger"))
        return {r.name: (r.generated, r.sources, r.error) for r in found.collect()}

    assert go(one_row(bad=("b",)), "1") == {"a": (9, 3, None), "b": (0, 3, "ConnectionError: refused")}
    assert go(one_row(bad=("a",)), "2") == {"a": (9, 3, None), "b": (9, 3, None)}


def test_refill_rounds_do_not_move_texts(spark):
    pairs = spark.range(50).selectExpr("id AS unit_idx", "id % 2 AS prompt_idx", "repeat('x', 100) AS unit")
    stored = gen.stored_by(pairs, ["unit_idx", "prompt_idx"], "test-pairs")
    waiting = spark.range(20).selectExpr("id AS unit_idx", "id % 2 AS prompt_idx", "1L AS n")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = stored.join(waiting, ["unit_idx", "prompt_idx"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(moved) == 1 and "unit_idx" in moved[0] and plan.index("Exchange") > plan.index("FileScan")


@pytest.mark.parametrize("ledgered", [False, True])
def test_refill_rounds_write_a_shared_text_once(spark, tmp_path, monkeypatch, ledgered):
    """Two prompts to each unit, of which unit 3 is full after the first round: its text is not written, the others' once."""
    units = spark.range(4).selectExpr("'s' AS source", "id AS unit_idx", "concat('text ', id) AS unit")
    pairs = units.crossJoin(spark.range(2).selectExpr("id AS prompt_idx", "concat('p', id) AS prompt"))
    keys, written = ["source", "unit_idx", "prompt_idx"], {}

    def telling():
        def respond(requests):
            seen = zip(requests.unit_idx, requests.batch_idx, requests.unit, requests.prompt)
            return ["\n".join([f'{{"prompt":"{p} {t} {b}","completion":"c"}}'] * (9 if u == 3 else 1)) for u, b, t, p in seen]

        return respond

    def stored(rows, by, name, wanted=None):
        written[name] = storing(rows, by, name, wanted)
        return written[name]

    storing = gen.stored_by
    monkeypatch.setattr(gen, "stored_by", stored)
    ledger = (lambda name: str(tmp_path / name)) if ledgered else lambda name: None
    plain, state = gen.fill_rounds(pairs, keys, telling, "sft", F.lit(3), F.lit(1), 4, ledger=ledger("a"))
    want = sorted(map(str, plain.select(*keys, "batch_idx", "line_idx", "raw").collect())), sorted((*r[:3], r.written, r.skipped) for r in state.collect())
    assert len(want[0]) == 24 and written["open-pairs"].count() == 6
    shared, state = gen.fill_rounds(pairs, keys, telling, "sft", F.lit(3), F.lit(1), 4, ledger=ledger("b"), units=units, unit_keys=["source", "unit_idx"])
    assert (sorted(map(str, shared.select(*keys, "batch_idx", "line_idx", "raw").collect())), sorted((*r[:3], r.written, r.skipped) for r in state.collect())) == want
    assert "unit" not in written["open-pairs"].columns and written["open-pairs"].count() == 6
    assert sorted(r.unit for r in written["open-units"].collect()) == ["text 0", "text 1", "text 2"]


def test_open_texts_are_moved_once(spark, monkeypatch):
    """What is open is looked for in the buckets: one shuffle of the texts, also where the open keys are too many to broadcast."""
    plans = []
    monkeypatch.setattr("pyspark.sql.readwriter.DataFrameWriter.saveAsTable", lambda self, name: plans.append(self._df))
    monkeypatch.setattr(type(spark), "table", lambda self, name: None)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        units = spark.range(50).selectExpr("id AS unit_idx", "repeat('x', 100) AS unit")
        gen.stored_by(units, ["unit_idx"], "test-units", spark.range(20).selectExpr("id AS unit_idx"))
        plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 2


def test_grounded_runs_write_a_unit_once(spark, tmp_path, monkeypatch):
    """However many configs and prompts ask about it, a unit is written once and joined in its bucket; each config has its own cut."""
    rows = [{**CONFIG, "name": n, "prompts": ["P", "Q"], "source": "s", "batch_size": 1, "count": 2, "max_source_chars": k} for n, k in (("a", 100), ("b", 900))]
    grounded = spark.createDataFrame(rows, cf.CONFIG_SCHEMA)
    units = spark.createDataFrame([(s, i, "x" * 100 + f"{s} text {i}") for s in "su" for i in range(3)], "source string, unit_idx long, unit string")
    written, plans, storing, calling = {}, [], gen.stored_by, gen.call

    def stored(rows, by, name, wanted=None):
        written[name] = storing(rows, by, name, wanted)
        return written[name]

    def called(plan, *rest):
        plans.append(plan._jdf.queryExecution().executedPlan().toString())
        return calling(plan, *rest)

    def one_row():
        return lambda requests: ['{"prompt":"%s","completion":"c"}' % m.replace("\n", " ") for m in requests.message]

    monkeypatch.setattr(gen, "stored_by", stored)
    monkeypatch.setattr(gen, "call", called)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = str(tmp_path / "out")
        found = jobs.synthesize_grounded(grounded, units, one_row, out, 5, template="{instruction}|{unit}")
        assert {r.name: (r.generated, r.sources) for r in found.collect()} == {"a": (12, 3), "b": (12, 3)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    texts = [name for name, rows in written.items() if "unit" in rows.columns]
    assert texts == ["units"] and sorted(r.unit[100:] for r in written["units"].collect()) == ["s text 0", "s text 1", "s text 2"]
    assert len(plans) == 2 and all("Bucketed: true" in p for p in plans)
    got = {(r.name, r.value.split('"')[3]) for r in spark.read.option("basePath", out).text(out).collect()}
    want = {("a", f"{p}|{'x' * 100} ... [truncated at 100 chars]") for p in "PQ"} | {("b", f"{p}|{'x' * 100}s text {i}") for p in "PQ" for i in range(3)}
    assert got == want

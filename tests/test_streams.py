import __spark_entry__ as entry
import pandas as pd
import pytest
from pyspark.sql import Row, functions as F

from millrace.operators import responses as rs
from millrace.operators import telemetry as tm
from millrace.streaming import streams as st


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


GOOD = '{{"prompt":"{k}{i}","completion":"c"}}'


def put(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines), encoding="utf-8")


def run(query):
    query.awaitTermination()
    assert query.exception() is None


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    put(tmp_path / "in", "1.jsonl", [GOOD.format(k="a", i=i) for i in range(5)] + ["bad", "[1]"])

    def go():
        arrivals = st.stream_lines(spark, str(tmp_path / "in"), files_per_trigger=1)
        rows = st.stream_rows(arrivals, "sft")
        run(st.stream_to_jsonl(rows, str(tmp_path / "out"), str(tmp_path / "check")))
        return sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect())

    def batch():
        lines = spark.read.text(str(tmp_path / "in")).withColumnRenamed("value", "response")
        return sorted(r.raw for r in rs.parse_responses(lines, "sft").filter("status = 'valid'").collect())

    assert go() == batch()
    assert go() == batch()
    put(tmp_path / "in", "2.jsonl", [GOOD.format(k="b", i=i) for i in range(3)])
    assert go() == batch()
    assert len(batch()) == 8


@pytest.mark.parametrize("target", [1, 4])
def test_cap_holds_across_micro_batches(spark, tmp_path, target):
    for number in range(4):
        put(tmp_path / "in", f"{number}.jsonl", [f"k{i % 3},{number}-{i}" for i in range(6)] + [f"hot,{number}-{i}" for i in range(50)])
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))
    rows = lines.select(F.split("value", ",")[0].alias("k"), F.split("value", ",")[1].alias("v"))
    with st.keyed_state(spark):
        run(st.run_stream(st.stream_cap(rows, ["k"], target), str(tmp_path / "out"), str(tmp_path / "check"), "parquet"))
    counts = {r.k: r["count"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("k").count().collect()}
    assert counts == {"k0": min(target, 8), "k1": min(target, 8), "k2": min(target, 8), "hot": target}


CHUNKS = "run_id long, seq long, ts timestamp, chunk string, tokens long"
STEPS = ["run_id", "seq", "tokens", "cumulative_tokens", "elapsed_s", "tps"]


def chunk_rows(spark, rows):
    """``rows``: (run_id, seq, second, tokens)."""
    rows = [(run, seq, f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}", "w " if seq % 5 else "", tokens) for run, seq, s, tokens in rows]
    return spark.createDataFrame(rows, CHUNKS.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp"))


def live_trace(spark, folder, name, delay="1 hour", idle_s=3600):
    chunks = spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    with st.keyed_state(spark), st.listening(spark, name) as listener:
        run(st.run_stream(st.stream_trace(chunks, delay, idle_s), str(folder / "out"), str(folder / "check"), "parquet", name))
    return spark.read.parquet(str(folder / "out")), listener


def test_live_trace_equals_the_batch_over_many_micro_batches(spark, tmp_path):
    whole = chunk_rows(spark, [(i % 3, i, i, i % 4) for i in range(200)])
    for at in range(0, 200, 5):  # forty files, each a micro-batch
        whole.filter(f"seq >= {at} AND seq < {at + 5}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got, listener = live_trace(spark, tmp_path, "many")
    want = tm.trace_steps(whole).select(STEPS)
    assert got.count() == 200 and listener.batches >= 40
    assert got.select(STEPS).exceptAll(want).count() == got.filter("late").count() == listener.dropped == 0


def test_live_trace_goes_on_after_a_restart(spark, tmp_path):
    whole = chunk_rows(spark, [(i % 2, i, i, 2) for i in range(40)])
    for low, high in ((0, 20), (20, 40)):
        whole.filter(f"seq >= {low} AND seq < {high}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got, _ = live_trace(spark, tmp_path, f"restart{low}")
    assert got.select(STEPS).exceptAll(tm.trace_steps(whole).select(STEPS)).count() == 0 and got.count() == 40


def test_finished_runs_leave_the_state_and_late_chunks_follow_the_rule(spark, tmp_path):
    files = [
        [(1, 1, 0, 2), (1, 2, 1, 2), (2, 6, 1, 1)],
        [(1, 4, 3, 2)],
        [(1, 3, 2, 5)],  # behind chunk 4
        [(1, 5, 5, 2), (3, 1, 400, 1)],  # the watermark goes to 390 s: runs 1 and 2 are over
        [(3, 2, 401, 1)],
        [(2, 7, 5, 9), (3, 3, 402, 1)],  # older than the watermark: dropped
        [(1, 9, 403, 3)],  # run 1 anew
    ]
    for rows in files:
        chunk_rows(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got, listener = live_trace(spark, tmp_path, "leave", "10 seconds", 60)
    found = {(r.run_id, r.seq): (r.tokens, r.cumulative_tokens, r.elapsed_s, r.tps, r.late) for r in got.collect()}
    assert found[1, 4] == (2, 6, 3.0, 1.0, False)
    assert found[1, 3] == (5, 11, 2.0, None, True)
    assert found[1, 5][1:] == (13, 5.0, 1.0, False)
    assert found[1, 9] == (3, 3, 0.0, None, False)
    assert (2, 7) not in found and listener.dropped == 1
    # state of runs 3 and 1 (the new one) with their timers, not of run 2
    everything = spark.read.format("statestore").option("stateVarName", "run").load(str(tmp_path / "check"))
    assert sorted(r.key.run_id for r in everything.select("key").collect()) == [1, 3]


def test_late_samples_are_counted(spark, tmp_path):
    for rows in ([(1, 0, 1.0), (2, 3700, 2.0)], [(1, 20000, 3.0)], [(1, 20001, 3.0)], [(1, 10, 4.0), (2, 20, 5.0), (1, 20002, 6.0)]):
        frame = spark.createDataFrame(rows, "run_id long, s long, celsius double")
        frame.select("run_id", F.timestamp_seconds("s").alias("ts"), "celsius").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    samples = spark.readStream.schema("run_id long, ts timestamp, celsius double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with st.listening(spark, "late") as listener:
        run(st.run_stream(tm.sensor_windows(samples, "1 hour", "10 minutes"), str(tmp_path / "out"), str(tmp_path / "check"), "parquet", "late"))
    assert listener.dropped == 2
    assert sorted((r.run_id, r.samples) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 1), (2, 1)]


def test_the_state_store_setting_is_put_back(spark):
    before = spark.conf.get(st.STATE_STORE, None)
    with st.keyed_state(spark):
        assert "RocksDB" in spark.conf.get(st.STATE_STORE)
    assert spark.conf.get(st.STATE_STORE, None) == before


def test_progress_reports(spark, tmp_path):
    put(tmp_path / "in", "1.jsonl", [GOOD.format(k="a", i=i) for i in range(5)] + ["bad"])
    put(tmp_path / "in", "2.jsonl", ["bad"] * 3)
    seen = []
    listener = st.ProgressListener("lines", lambda generated, skipped: seen.append((generated, skipped)))
    spark.streams.addListener(listener)
    try:
        rows = st.with_metrics(st.stream_rows(st.stream_lines(spark, str(tmp_path / "in"), 1), "sft"), "lines")
        run(st.run_stream(rows.select("raw"), str(tmp_path / "out"), str(tmp_path / "check")))
        for _ in range(50):
            if seen and seen[-1] == (5, 4):
                break
            spark.range(1000).count()
    finally:
        spark.streams.removeListener(listener)
    assert seen[-1] == (5, 4)


def test_counts_in_complete_mode(spark, tmp_path):
    put(tmp_path / "in", "1.jsonl", [GOOD.format(k="a", i=1), "x"])
    put(tmp_path / "in", "2.jsonl", ["y"])
    last = []
    counts = st.stream_counts(st.stream_rows(st.stream_lines(spark, str(tmp_path / "in"), 1), "sft"))
    run(counts.writeStream.outputMode("complete").foreachBatch(lambda df, n: last.append(df.first()))
        .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start())
    assert (last[-1].generated, last[-1].skipped) == (1, 2)


def test_a_table_in_a_folder_streams_like_one_file(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    spark.read.parquet(f"{folder}/documents.parquet").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    queries = entry.queries()
    assert queries["stream_ingest"](spark, str(tmp_path)).count() == queries["stream_ingest"](spark, folder).count() > 0


class Held:
    """A value state, or the handle that gives it out."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def getValueState(self, name, schema):
        return self

    def registerTimer(self, at):
        pass

    def getCurrentWatermarkInMs(self):
        return 0


def test_a_chunk_without_a_count_adds_nothing_to_a_live_trace():
    held, trace = Held(), st._LiveTrace(60_000)
    trace.init(held)
    first = pd.DataFrame({"seq": [2, 1], "us": [2_000_000, 0], "chunk": ["b", "a"], "tokens": [None, 3.0]})
    then = pd.DataFrame({"seq": [3], "us": [4_000_000], "chunk": ["c"], "tokens": [4]})
    found = [step for frame in (first, then) for step in trace.handleInputRows((7,), iter([frame]), held)]
    assert [x for step in found for x in step["cumulative_tokens"]] == [3, 3, 7]
    assert found[1]["tps"].tolist() == [2.0] and found[0]["tps"].isna().all() and held.value == (0, 4_000_000, 3, 7)


def test_the_cap_takes_rows_one_by_one_up_to_its_target():
    held, cap, row = Held(), st._FirstRows(3), Row("k", "v")
    cap.init(held)
    found = [r.v for part in (range(2), range(2, 6)) for r in cap.handleInputRows(("a",), (row("a", i) for i in part), held)]
    assert found == [0, 1, 2] and held.value == (3,)

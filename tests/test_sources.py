import json
import os

import pytest
from pyspark.sql import functions as F

from millrace.operators import inventory as iv
from millrace.operators import telemetry as tm
from millrace.sinks import jsonl as out
from millrace.sources import configs as cs
from millrace.sources import files as fs
from millrace.sources import jsonl as src
from millrace.sources import runlogs
from millrace.sources import units as un


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "src"
    (root / "sub" / "deep").mkdir(parents=True)
    (root / ".cache").mkdir()
    (root / "a.txt").write_bytes(b"one\r\ntwo\xff\xfe\r")
    (root / ".hidden.txt").write_text("hidden")
    (root / "_under.txt").write_text("under")
    (root / ".cache" / "c.txt").write_text("cached")
    (root / "sub" / "z.py").write_text("print()")
    (root / "sub" / "deep" / "y.py").write_text("pass")
    (root / "data.json").write_text('[1, {"b": 2}]')
    return root


def relative(root, rows):
    return {r.path.split(f"{root}/", 1)[1]: r.unit for r in rows}


@pytest.mark.parametrize("glob", ["", "**/*", "*.txt", "**/*.py", "sub/*", "**/z.*", "sub/**", "?.txt", "**/[yz].py"])
def test_folder_units_match_a_path_glob(spark, tree, glob):
    want = {
        p.relative_to(tree).as_posix(): p.read_text(encoding="utf-8", errors="replace")
        for p in tree.glob(glob or "**/*") if p.is_file()
    }
    if not want:
        with pytest.raises(ValueError):
            fs.units_from_dir(spark, str(tree), glob)
        return
    assert relative(tree, fs.units_from_dir(spark, str(tree), glob).collect()) == want
    visible = {k: v for k, v in want.items() if not any(part[0] in "._" for part in k.split("/"))}
    assert relative(tree, fs.units_from_dir(spark, str(tree), glob, hidden=False).collect()) == visible


def test_folder_without_a_match_is_an_error(spark, tree):
    for hidden in (True, False):
        with pytest.raises(ValueError):
            fs.units_from_dir(spark, str(tree), "*.md", hidden=hidden)


def test_walk_lists_every_file(spark, tree, tmp_path):
    """Hidden, empty and linked files and deep folders; links to folders and broken links are no files."""
    deep = tree.joinpath(*[f"level{i}" for i in range(6)])
    deep.mkdir(parents=True)
    (deep / "bottom.txt").write_bytes(b"")
    (tree / "empty").mkdir()
    os.symlink(tree / "a.txt", tree / "link.txt")
    os.symlink(tree / "sub", tree / "loop")
    os.symlink(tree / "nowhere", tree / "broken")
    want = {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(tree) for f in files if f != "broken"}
    assert dict(fs.walk_files(spark, str(tree)).collect()) == want
    assert "link.txt" in str(want) and "/loop/" not in str(want)
    (tmp_path / "bare").mkdir()
    assert fs.walk_files(spark, str(tmp_path / "bare")).collect() == []
    with pytest.raises(Exception):
        fs.walk_files(spark, str(tmp_path / "missing")).collect()


def test_wide_folders_come_in_batches(spark, tmp_path, monkeypatch):
    for i in range(90):
        (tmp_path / f"f{i % 9}" / "g").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"f{i % 9}" / f"{i}.txt").write_text("x" * i)
    monkeypatch.setattr(fs, "FOLDERS_PER_TASK", 2)
    found = dict(fs.walk_files(spark, str(tmp_path)).collect())
    assert {p.rsplit("/", 1)[1]: n for p, n in found.items()} == {f"{i}.txt": i for i in range(90)}


def test_listed_paths_are_read_as_told(spark, tree):
    a, hidden = str(tree / "a.txt"), str(tree / ".hidden.txt")
    read = lambda files, **bytes_of: sorted((r.path, bytes(r.content)) for r in fs.read_paths(spark, files, **bytes_of).collect())
    want = sorted([(a, (tree / "a.txt").read_bytes()), (hidden, b"hidden"), (hidden, b"hidden")])
    assert read([a, hidden, hidden]) == want
    table = spark.createDataFrame([(1, a), (2, hidden), (3, hidden)], "extra int, path string")
    assert read(table) == read(table, task_bytes=1) == want
    assert fs.read_paths(spark, table, task_bytes=1).rdd.getNumPartitions() == 3
    assert read([]) == []
    with pytest.raises(Exception):
        read([a, str(tree / "missing.txt")])


def test_units_by_uri_are_those_of_mounted_storage(spark, tree):
    (tree / "lines.jsonl").write_text('{"a":1}\n\n[2]\n')
    for name in ("a.txt", "data.json", "lines.jsonl", "sub", "sub/deep"):
        for uri in (f"file:{tree}/{name}", f"file://{tree}/{name}"):
            here, there = [sorted((r.unit_idx.split("src")[-1], r.unit) for r in un.load_units(spark, p).collect()) for p in (f"{tree}/{name}", uri)]
            assert here and here == there
    with pytest.raises(Exception):
        un.load_units(spark, f"file:{tree}/missing.txt").collect()


def test_path_order_is_by_component(spark):
    df = spark.createDataFrame([("a-b",), ("a/b",), ("a",), ("a/c/d",)], "path string")
    assert [r.path for r in iv.order_by_path(df).collect()] == ["a", "a/b", "a/c/d", "a-b"]


def test_json_file_units(spark, tmp_path):
    values = {
        "list.json": [{"z": 1, "a": [1.5, None]}, "é", 2, [], True], "object.json": {"b": {"c": "x"}}, "scalar.json": 5,
    }
    for name, value in values.items():
        (tmp_path / name).write_text(json.dumps(value, indent=2), encoding="utf-8")
    rows = un.units_from_json_files(spark, str(tmp_path)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.unit_idx):
        got.setdefault(r.source.rsplit("/", 1)[1], []).append(r.unit)
    want = {n: [json.dumps(x, ensure_ascii=False) for x in (v if isinstance(v, list) else [v])] for n, v in values.items()}
    assert got == want
    compact = un.units_from_json_files(spark, str(tmp_path), compact=True).filter("source LIKE '%list.json'")
    assert [r.unit for r in compact.orderBy("unit_idx").collect()] == ['{"a":[1.5,null],"z":1}', '"é"', "2", "[]", "true"]
    (tmp_path / "bad.json").write_text("{")
    for form in (False, True):
        with pytest.raises(Exception):
            un.units_from_json_files(spark, str(tmp_path), compact=form).collect()


def test_jsonl_units_keep_broken_lines(spark, tmp_path):
    text = '{"b":1,"a":[1,2]}\n\n  not json  \r\n"x\u0085y"\n{"é":NaN}\n'
    path = tmp_path / "s.jsonl"
    path.write_text(text, encoding="utf-8")
    want = []
    for line in text.splitlines():
        if line.strip():
            try:
                want.append(json.dumps(json.loads(line.strip()), ensure_ascii=False))
            except json.JSONDecodeError:
                want.append(line.strip())
    rows = un.units_from_jsonl(src.read_lines(spark, str(path))).orderBy("line_no", "part").collect()
    assert [r.unit for r in rows] == want


def test_whole_file_units(spark, tree):
    (row,) = fs.units_from_file(spark, str(tree / "a.txt")).collect()
    assert row.unit == "one\ntwo��\n"


def test_listing_and_log_listing(spark, tree):
    files = fs.list_files(spark, str(tree), "*.py")
    assert {r.path.rsplit("/", 1)[1]: r.length for r in files.collect()} == {"z.py": 7, "y.py": 4}
    assert "content" not in files._jdf.queryExecution().executedPlan().toString()
    df = spark.sql("SELECT * FROM VALUES ('l/old.json', 10L, TIMESTAMP '2024-01-01 00:00:59'), ('l/new.json', 2048L, TIMESTAMP '2024-01-02 10:30:00') AS t(path, length, mtime)")
    assert [tuple(r) for r in iv.log_listing(df).collect()] == [
        ("new.json", "2.0 KB", "2024-01-02 10:30"), ("old.json", "10 B", "2024-01-01 00:00"),
    ]


def test_config_folder(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"name": "other", "task": "sft", "model": "m", "count": 3, "skip_rules": ["x"]}))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text(json.dumps({"mode": "gfs", "prompts": ["p"], "max_source_chars": 200}))
    (tmp_path / "d.json").write_text("[]")
    (tmp_path / "note.txt").write_text("{}")
    configs = cs.read_configs(spark, str(tmp_path), ignore_field="skip_rules")
    assert [tuple(r) for r in cs.listing_of(configs).collect()] == [
        ("a", "standard", "sft", "m", "3"), ("b", "?", "?", "?", "?"), ("c", "gfs", "?", "?", "?"), ("d", "?", "?", "?", "?"),
    ]
    assert configs.filter("name = 'a'").first().ignore == ["x"]


def test_resume_count_takes_any_line(spark, tmp_path):
    (tmp_path / "o.jsonl").write_text('{"a":1}\n \nnot json\n\n{"b":2}', encoding="utf-8")
    assert src.count_existing(spark, str(tmp_path / "o.jsonl")).first().existing == 3


def test_sinks_keep_text_nulls_and_append(spark, tmp_path):
    df = spark.createDataFrame([("é\n", None), ("b", 2)], "prompt string, n int")
    path = str(tmp_path / "out.jsonl")
    lines = out.as_json_lines(df)
    out.write_jsonl(lines, path)
    out.write_jsonl(lines, path)
    assert sorted(r.value for r in spark.read.text(path).collect()) == ['{"prompt":"b","n":2}', '{"prompt":"é\\n","n":null}']
    out.write_jsonl(lines, path, mode="append")
    assert spark.read.text(path).count() == 4
    names = {out.run_id() for _ in range(20)}
    assert len(names) == 20 and all(len(n) == 22 for n in names)


def test_run_logs_round_trip(spark, tmp_path):
    rows = [(1, i, f"2024-01-01 00:00:{i:02d}", w, t) for i, (w, t) in enumerate([("Hel", 1), ("lo ", 0), ("", 0), ("you", 3)], 1)]
    trace = spark.createDataFrame(rows, "run_id long, seq long, ts string, chunk string, tokens long").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    steps = tm.trace_steps(trace, lead_us=500_000)
    stats = tm.throughput(steps).first()
    assert (stats.response_tokens, stats.time_s) == (2, 3.5)
    assert (stats.tps_peak, stats.tps_lowest) == (3.0, 1.0)
    logs = out.build_run_logs(tm.round_stats(tm.throughput(steps)), steps, part_rows=3)
    (tmp_path / "logs").mkdir()
    for r in logs.collect():
        # indented, as log files are
        (tmp_path / "logs" / f"{r.part}.json").write_text(json.dumps(json.loads(r.document), indent=2))
    read = runlogs.read_run_logs(spark, str(tmp_path / "logs"))
    entries = runlogs.explode_trace(read, "source")
    assert sorted((r.chunk, r.tokens, r.tps, r.elapsed_s) for r in entries.collect()) == [
        ("Hel", 1, 2.0, 0.5), ("lo ", 1, 1.0, 1.5), ("you", 3, 3.0, 3.5),
    ]
    assert read.select(runlogs.stat("tps_overall")).filter("tps_overall IS NOT NULL").first()[0] == round(2 / 3.5, 4)
    parts = tm.assemble_response(trace, part_rows=3).orderBy("part").collect()
    assert [r.response for r in parts] == ["Hello ", "you"]


def test_runs_without_entries_fall_back_to_overall(spark):
    trace = spark.sql("SELECT 7L AS run_id, 1L AS seq, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS ts, 'a b' AS chunk, 0L AS tokens")
    row = tm.throughput(tm.trace_steps(trace)).first()
    assert (row.tps_overall, row.tps_peak, row.tps_lowest, row.response_tokens) == (0.0, 0.0, 0.0, 2)


def test_model_inventory_and_checkpoints(spark):
    files = spark.createDataFrame(
        [("g", "w.gguf"), ("g", "config.json"), ("c", "config.json"), ("b", "w.bin"), ("u", "README.md")], "dir string, file string")
    assert dict(iv.model_inventory(files).collect()) == {"g": "gguf", "c": "transformers", "b": "transformers", "u": "unknown"}
    found = spark.createDataFrame(
        [("r", "x/checkpoint-9"), ("r", "x/checkpoint-10/"), ("r", "x/other-99"), ("e", "x/logs")], "run string, path string")
    assert {r.run: (r.checkpoint, r.step) for r in iv.latest_checkpoint(found).collect()} == {"r": ("x/checkpoint-10/", 10), "e": (None, None)}


@pytest.mark.parametrize("name", ["{}s.json", "{}s.jsonl", "{}s.txt"])
def test_unseen_names_load_like_others(spark, tmp_path, name):
    text = '[{"b": 1},\r\n 2]\n'
    found = []
    for start in ("", "_", "."):
        (tmp_path / name.format(start)).write_bytes(text.encode())
        rows = un.load_units(spark, str(tmp_path / name.format(start))).orderBy("unit_idx").collect()
        found.append([r.unit for r in rows])
    assert found[0] and found[0] == found[1] == found[2]

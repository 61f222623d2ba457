"""Array files in pieces, and readings as of a row, beside plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators.runlog import last_readings
from millrace.sources.units import load_units, units_from_json_files

VALUES = [
    {"a": 'x,y "[{', "b": [1, 2, {"c": []}]}, "a,b\\,\"]", [], {}, None, 1.5, -3, True, ",,,", '\\', '"', "[", "é 中, 😀", {"k": {"k": {"k": [[["]"]]]}}}, "line\nbreak,\ttab",
]


@pytest.fixture(params=[40, 1 << 20])
def small_splits(spark, request):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, str(request.param))
    yield
    for n, value in zip(names, before, strict=True):
        spark.conf.set(n, value)


def dumped(values):
    return [json.dumps(v, ensure_ascii=False) for v in values]


def test_array_files_of_any_split(spark, tmp_path, small_splits):
    r = random.Random(3)
    many = [r.choice(VALUES) for _ in range(60)]
    texts = {
        "a.json": (json.dumps(many, indent=2), many), "b.json": (json.dumps(many, ensure_ascii=False, separators=(",", ":")) + "\n", many),
        "c.json": (" [ ]\n", []), "d.json": (json.dumps({"x": many}), [{"x": many}]), "e.json": ('"one, [value"', ["one, [value"]),
        "f.json": ("\r\n[1 ,\r\n2]", [1, 2]), "g.json": ("[[1,2],[3,4]]", [[1, 2], [3, 4]]),
    }
    for name, (text, _) in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    got = {}
    for row in units_from_json_files(spark, str(tmp_path)).orderBy("unit_idx").collect():
        got.setdefault(row.source.rsplit("/", 1)[1], []).append((row.unit_idx, row.unit))
    assert got == {name: list(enumerate(dumped(values))) for name, (_, values) in texts.items() if values}
    assert [r.unit for r in load_units(spark, str(tmp_path / "a.json")).orderBy("unit_idx").collect()] == dumped(many)


@pytest.mark.parametrize("text", ["[1", "[1,]", "[1],[2]", "[1]]", '["a]', "[,]", "", "[1 2]", "{", "[{]}", "nothing"])
def test_broken_arrays_fail(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text or " ")
    with pytest.raises(Exception, match="not valid JSON"):
        units_from_json_files(spark, str(tmp_path / "x.json")).collect()


def test_last_readings(spark):
    r = random.Random(4)
    rows = [(r.choice((1, 2, None)), i, r.randrange(100), f"c{i}") for i in range(200)]
    samples = [(r.choice((1, 2, None)), i, r.randrange(100), r.choice((None, float(i))), r.choice((None, -float(i)))) for i in range(150)]

    def frame(data, schema):
        return spark.createDataFrame(data, schema).withColumn("ts", F.timestamp_seconds("s"))

    got = last_readings(
        frame(rows, "run_id long, seq long, s long, chunk string"), frame(samples, "run_id long, seq long, s long, ram_mb double, util double"), ["run_id"], ["ram_mb", "util"], parts=5)
    for row in got.collect():
        before = sorted((s, seq, a, b) for run, seq, s, a, b in samples if run == row.run_id and s <= row.s)
        assert (row.ram_mb, row.util) == tuple(next((x[k] for x in reversed(before) if x[k] is not None), None) for k in (2, 3))
    assert got.count() == len(rows) and got.columns == ["run_id", "seq", "s", "chunk", "ts", "ram_mb", "util"]

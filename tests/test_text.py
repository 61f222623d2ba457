import sys

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.functions.units import celsius, mebibytes, round_exact

SPACED = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()]
BREAKS = [chr(c) for c in range(sys.maxunicode + 1) if len(f"a{chr(c)}b".splitlines()) == 2]


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [row.y for row in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_fixed_character_sets_are_complete():
    assert sorted(tx.SPACES) == SPACED
    assert sorted({*tx.RARE_BREAKS, "\n"}) == BREAKS


texts = st.lists(
    st.text(st.sampled_from([*SPACED, *BREAKS, "a", "é", "`", "​", "𝄞"]), max_size=12), min_size=40, max_size=80
)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(values=texts)
def test_strip_split_and_count_match_python(spark, values):
    assert column(spark, values, tx.strip) == [v.strip() for v in values]
    assert column(spark, values, tx.token_count) == [len(v.split()) for v in values]
    pieces = column(spark, values, lambda x: F.filter(tx.split_lines(x), lambda line: line != ""))
    assert pieces == [[line for line in v.splitlines() if line] for v in values]


def test_lines_that_end_in_crlf_need_no_regex(spark, monkeypatch):
    values = ["a\r\nb\r\n", "\r\n\r\n", "a\nb\r\n\nc", "é\r\n𝄞"]
    want = [[line for line in v.splitlines() if line] for v in values]
    monkeypatch.setattr(tx, "LINE_BREAK", "no such mark")
    assert column(spark, values, lambda x: F.filter(tx.split_lines(x), lambda line: line != "")) == want
    monkeypatch.undo()
    mixed = ["a\r\nb\rc", "a\r\r\nb", "\r", "a\r\n\x85b\u2028c"]
    assert column(spark, mixed, lambda x: F.filter(tx.split_lines(x), lambda line: line != "")) == [[x for x in v.splitlines() if x] for v in mixed]


def test_truncate_counts_code_points_and_adds_the_mark(spark):
    values = ["é𝄞abc", "é𝄞a", ""]
    assert column(spark, values, lambda x: tx.truncate(x, 3)) == ["é𝄞a\n... [truncated at 3 chars]", "é𝄞a", ""]
    assert column(spark, values, lambda x: tx.truncate(x, F.length(x) - 1, "~")) == ["é𝄞ab~", "é𝄞~", "~"]


def test_plain_text_replaces_bad_bytes_and_line_ends(spark):
    raw = [b"a\r\nb\rc\n", b"\xff\xfea\xe2\x82", "é".encode()]
    want = [data.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n") for data in raw]
    assert column(spark, raw, tx.plain_text, "binary") == want


def test_small_formats(spark):
    sizes = [0, 1023, 1024, 1075, 1076, 1536, 10**6, 12595]
    want = [f"{n} B" if n < 1024 else "%.1f KB" % (n / 1024) for n in sizes]
    assert column(spark, sizes, tx.human_size, "long") == want
    many = list(range(1024, 60_000, 1))
    assert column(spark, many, tx.human_size, "long") == ["%.1f KB" % (n / 1024) for n in many]
    secrets = ["", "x" * 12, "sk-abcdefghijk"]
    assert column(spark, secrets, tx.mask_secret) == ["****", "****", "sk-abcde...hijk"]
    assert column(spark, ["o/r/s"], tx.safe_name) == ["o--r--s"]
    assert column(spark, [" a, ,b,,c "], tx.split_names) == [["a", "b", "c"]]


def test_chat_and_template_rendering(spark):
    df = spark.sql("SELECT array(named_struct('role','system','content','s'), named_struct('role','user','content',CAST(NULL AS STRING))) AS m, 'v{x}' AS v")
    assert df.select(tx.format_chat(F.col("m")).alias("t")).first().t == "<|system|>\ns\n<|user|>\n"
    shown = tx.fill_template('{"k": {v}} {other} {', v=F.col("v"))
    assert df.select(shown.alias("t")).first().t == '{"k": v{x}} {other} {'


def test_sensor_units(spark):
    rows = spark.sql("SELECT * FROM VALUES (45000D, NULL, NULL), (NULL, 3181.5D, 1D), (NULL, NULL, 318.15D) AS t(m, t, k)")
    got = [round(r.c, 9) for r in rows.select(celsius(F.col("m"), F.col("t"), F.col("k")).alias("c")).collect()]
    assert got == [45.0, 45.0, 45.0]
    assert column(spark, [1 << 20], mebibytes, "long") == [1.0]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(values=st.lists(st.floats(-1e9, 1e9) | st.integers(-10**7, 10**7).map(lambda n: n / 2000) | st.sampled_from(
    [2.675, 0.125, 0.375, -2.5, 1e-7, 2572857.27325, 0.0]), min_size=50, max_size=100), places=st.integers(1, 4))
def test_rounding_is_python_rounding(spark, values, places):
    got = column(spark, values, lambda x: round_exact(x, places), "double")
    assert got == [round(v, places) for v in values]

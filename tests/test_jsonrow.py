import json

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from millrace.functions import jsonrow

EDGES = [
    '{"a":1}', '{"a":1}{"b":2}', '{"a":1}] {}', '{"a":1},{"b":2}', "null", "5", '"x"', "[1,2]", "{'a':1}",
    '{"a":NaN}', '{"a":-Infinity}', "NaN", '{"a":INF}', '{"a":+Infinity}', '{"a":1,}', "[1,]", '{"a":"x\ty"}',
    '﻿{"a":1}', '{"a":01}', '{"a":1,"a":2}', "1],[2", '{"a":null}', "", "1,", '{"a":1} // c', "tru", "true",
    "{a:1}", '{"a":+1}', '{"a":.5}', '{"a":5.}', "[1]]", '{"a":"\\x"}', '{"\\u0061":3}', "[", "]", "{}", "[]",
    '{"a":"\\u0001~end"}', '"\\u0001~end"', '1,"\\u0001~end"] x', '{"a":"+Infinity"}', '{"a":"u0001~end"} {}',
    '{"a":"NaN"', '{"prompt":" é"}', "-0", "1e5", "1e400", '{"a":"\\ud800"}',
]


def accepted(text):
    try:
        json.loads(text)
        return True
    except json.JSONDecodeError:
        return False


def validity(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, raw string")
    rows = jsonrow.with_value(df).select("i", F.col("value").isNotNull().alias("ok")).orderBy("i").collect()
    return [row.ok for row in rows]


def test_strict_gate_accepts_what_python_accepts(spark):
    assert list(zip(EDGES, validity(spark, EDGES))) == [(text, accepted(text)) for text in EDGES]


def test_a_guard_with_escaped_letters_closes_no_line(spark):
    texts = [
        '{"prompt":1},"\\u0001\\u007eend"] junk', '{"a":1},"\\u0001\\u007Een\\u0064"]}', '{"a":"\\u0001\\u007eend"}', '{"a":"\\\\u0001"}',
        '{"a":["\\u0001",NaN,' + "[" * 1200 + "9" * 2000 + "]" * 1200 + "]}",
    ]
    assert validity(spark, texts) == [False, False, True, True, True]


def test_column_and_table_forms_agree(spark):
    df = spark.createDataFrame(list(enumerate(EDGES)), "i int, raw string")
    both = jsonrow.with_value(df).withColumn("again", jsonrow.parse_strict("raw"))
    assert both.filter(F.col("value").isNull() != F.col("again").isNull()).count() == 0


values = st.recursive(
    st.none() | st.booleans() | st.integers(-(2**53), 2**53) | st.text(max_size=8),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.sampled_from(
        ["prompt", "chosen", "rejected", "completion", "messages", "other"]), inner, max_size=6),
    max_leaves=8,
)


def expected_status(text):
    """The documented detection table, read off a parsed row."""
    try:
        row = json.loads(text)
    except json.JSONDecodeError:
        return "bad_json"
    if not isinstance(row, dict):
        return "non_object"
    has = row.__contains__
    if all(map(has, ("prompt", "chosen", "rejected"))):
        return "dpo"
    if isinstance(row.get("messages"), list):
        return "chat"
    if has("prompt") and has("completion"):
        return "sft"
    if has("prompt") and not any(map(has, ("completion", "chosen", "messages"))):
        return "rl"
    return "unrecognised"


def statuses(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, raw string")
    rows = jsonrow.with_value(df).withColumn("status", jsonrow.line_status(F.col("raw"), F.col("value")))
    return [row.status for row in rows.orderBy("i").collect()]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(values, min_size=60, max_size=120), cut=st.integers(0, 5))
def test_detection_matches_the_documented_rule(spark, rows, cut):
    texts = [json.dumps(row, ensure_ascii=False) for row in rows]
    texts = [text[: len(text) - cut] if i % 7 == 0 and len(text) > cut else text for i, text in enumerate(texts)]
    texts = [text.strip() for text in texts if text.strip()]
    assert statuses(spark, texts) == [expected_status(text) for text in texts]


CASES = {
    '{"prompt":null,"completion":null}': "sft",
    '{"prompt":1,"rejected":2}': "rl",
    '{"prompt":1,"chosen":2}': "unrecognised",
    '{"prompt":1,"messages":"[1]"}': "unrecognised",
    '{"prompt":1,"completion":2,"messages":{}}': "sft",
    '{"prompt":1,"completion":2,"chosen":3}': "sft",
    '{"prompt":1,"other":2}': "rl",
    '{"prompt":1,"chosen":2,"rejected":3,"messages":[]}': "dpo",
    '{"messages":[]}': "chat",
    '{"messages":null}': "unrecognised",
    "{}": "unrecognised",
    "null": "non_object",
    "5": "non_object",
}


def test_detection_golden_cases(spark):
    assert dict(zip(CASES, statuses(spark, list(CASES)))) == CASES


def test_projection_keeps_text_and_nulls(spark):
    lines = [
        '{"prompt":5,"completion":null}',
        '{"prompt":{"b":1},"completion":"x\\n\\u00e9"}',
        '{"prompt":"a","prompt":"last","completion":""}',
    ]
    df = jsonrow.with_value(spark.createDataFrame([(line,) for line in lines], "raw string"))
    rows = df.select(*jsonrow.columns_of(F.col("value"), "sft")).collect()
    assert [tuple(row) for row in rows] == [("5", None), ('{"b":1}', "x\né"), ("last", "")]


def test_messages_projection(spark):
    line = '{"messages":[{"role":"system","content":"s","extra":1},{"role":"user","content":null},{"content":["a"]}]}'
    df = jsonrow.with_value(spark.createDataFrame([(line,)], "raw string"))
    (row,) = df.select(*jsonrow.columns_of(F.col("value"), "chat")).collect()
    assert [tuple(turn) for turn in row.messages] == [("system", "s"), ("user", None), (None, '["a"]')]


def test_unknown_task_is_refused():
    with pytest.raises(ValueError):
        jsonrow.columns_of(None, "other")


def test_long_numbers_and_deep_nesting_are_json(spark):
    texts = ['{"a":' + "1" * 1200 + "}", '{"a":' + "[" * 1200 + "]" * 1200 + "}", '{"a":' + "[" * 1200 + "]" * 1199 + "}"]
    assert validity(spark, texts) == [True, True, False]

"""Inputs that the registered queries derive from the given tables.

An input is a list of SQL expressions that Spark and the checking engine both read,
so that both sides start from equal rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions.text import SPACES


@dataclass(frozen=True)
class Query:
    """A registered query and the SQL that must give the same rows."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a table of a few small files; larger tables stay as they are split."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def select_sql(columns: list[str], source: str) -> str:
    return f"SELECT {', '.join(c.replace('ARRAY(', 'list_value(') for c in columns)} FROM {source}"


# JSON string literal of a text column, in either engine.
SPARK_JSON_TEXT = "substring(to_json(named_struct('t', {0})), 6, length(to_json(named_struct('t', {0}))) - 6)"
DUCK_JSON_TEXT = "CAST(to_json({0}) AS VARCHAR)"
TEXT = "text"


def _object(t: str, *keys: str) -> str:
    """SQL of a JSON object that holds the text ``t`` under each of the keys."""
    cells = " || ',' || ".join(f"""'"{key}":' || {t}""" for key in keys)
    return f"'{{' || {cells} || '}}'"


def shapes(t: str) -> list[str]:
    """SQL of sixteen kinds of lines around the JSON text ``t``."""
    return [
        _object(t, "prompt", "completion"),
        _object(t, "prompt"),
        _object(t, "prompt", "chosen", "rejected"),
        f"""'{{"messages":[{{"role":"user","content":' || {t} || '}}]}}'""",
        """'{"messages":"[1]"}'""",
        _object(t, "prompt", "rejected"),
        _object(t, "prompt", "chosen"),
        "'[1,2]'",
        f"""'{{"prompt":' || {t}""",
        """'{''prompt'':''x''}'""",
        "'  '",
        f"""'{{"prompt":null,"completion":' || {t} || '}}'""",
        "'```json'",
        f"""{_object(t, "prompt")} || {_object(t, "prompt")}""",
        f"""'{{"completion":' || {t} || ',"messages":[],"prompt":' || {t} || ',"chosen":' || {t} || ',"rejected":' || {t} || '}}'""",
        f"""'{{"messages":[],"prompt":' || {t} || ',"completion":' || {t} || '}}'""",
    ]


def shape_case(kinds: list[str], number: str) -> str:
    cases = " ".join(f"WHEN {k} THEN {shape}" for k, shape in enumerate(kinds))
    return f"CASE {number} {cases} END"


def quoted(sql: str) -> str:
    """SQL text for Spark, which reads a doubled quote as two joined literals."""
    return sql.replace("'{''prompt'':''x''}'", "\"{'prompt':'x'}\"")


# Dataset lines: one per document, its whole text inside, sixteen kinds in turn.
def line_columns() -> list[str]:
    dataset = (
        "source || ':' || CASE WHEN doc_id % 5 = 0 THEN 'mixed' WHEN doc_id % 16 IN (0, 4, 11) THEN 'a' "
        "WHEN doc_id % 16 IN (1, 5, 6) THEN 'b' WHEN doc_id % 16 IN (2, 10, 14) THEN 'c' "
        "WHEN doc_id % 16 IN (3, 15) THEN 'd' WHEN doc_id % 16 IN (6, 7) THEN 'e' ELSE 'f' END AS dataset"
    )
    return ["source", dataset, "doc_id + 1 AS line_no", f"{shape_case(shapes('t'), 'doc_id % 16')} AS raw"]


def lines(spark: SparkSession, folder: str) -> DataFrame:
    documents = spread(table(spark, folder, "documents").select("doc_id", "source", "text"))
    texts = documents.selectExpr("doc_id", "source", f"{SPARK_JSON_TEXT.format('text')} AS t")
    return texts.selectExpr(*[quoted(c) for c in line_columns()])


LINES = f"lines AS ({select_sql(line_columns(), f'(SELECT *, {DUCK_JSON_TEXT.format(TEXT)} AS t FROM documents)')})"

_SPACES_SQL = "'" + SPACES + "'"


def status_sql(raw: str, blank: bool = True) -> str:
    """The status of a stripped line, by the checking engine's own JSON functions."""
    has = {k: f"list_contains(json_keys({raw}), '{k}')" for k in ("prompt", "chosen", "rejected", "completion", "messages")}
    return (
        "CASE " + (f"WHEN {raw} = '' THEN 'blank' " if blank else "")
        + f"WHEN NOT json_valid({raw}) THEN 'bad_json' WHEN json_type({raw}) <> 'OBJECT' THEN 'non_object' "
        f"WHEN {has['prompt']} AND {has['chosen']} AND {has['rejected']} THEN 'dpo' "
        f"WHEN coalesce(json_type({raw}, '$.messages') = 'ARRAY', false) THEN 'chat' "
        f"WHEN {has['prompt']} AND {has['completion']} THEN 'sft' "
        f"WHEN {has['prompt']} AND NOT {has['completion']} AND NOT {has['chosen']} AND NOT {has['messages']} THEN 'rl' "
        "ELSE 'unrecognised' END"
    )


CLASSIFIED = (
    f"{LINES}, stripped AS (SELECT source, dataset, line_no, trim(raw, {_SPACES_SQL}) AS raw FROM lines), "
    f"classified AS (SELECT *, {status_sql('raw')} AS status FROM stripped)"
)


# Responses: eight lines of those kinds, the first kind moving with unit and batch.
def spark_response(kinds: list[str], start: str, breaks: str) -> str:
    eight = "ARRAY(" + ", ".join(quoted(shape_case(kinds, f"(({start}) + {i}) % 16")) for i in range(8)) + ")"
    return f"array_join({eight}, CASE WHEN ({breaks}) % 7 = 0 THEN '\\r\\n' ELSE '\\n' END)"


def duck_response(kinds: list[str], start: str, breaks: str) -> str:
    eight = f"list_transform(range(0, 8), lambda i: (list_value({', '.join(kinds)}))[(({start}) + i) % 16 + 1])"
    joined = f"array_to_string({eight}, chr(10))"
    return f"CASE WHEN ({breaks}) % 7 = 0 THEN replace({joined}, chr(10), chr(13) || chr(10)) ELSE {joined} END"


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """One response per document, the whole text in its lines."""
    t = SPARK_JSON_TEXT.format("text")
    documents = spread(table(spark, folder, "documents").select("doc_id", "source", "text"))
    return documents.selectExpr("source", "doc_id AS unit_idx", f"{t} AS t").selectExpr(
        "source", "unit_idx", f"{spark_response(shapes('t'), 'unit_idx', 'unit_idx')} AS response"
    )


def candidate_sql(responses_sql: str, keys: str) -> str:
    return (
        f"responses AS ({responses_sql}), "
        "pieces AS (SELECT * EXCLUDE (response), regexp_split_to_array(response, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]') AS parts FROM responses), "
        f"split_up AS (SELECT * EXCLUDE (parts), unnest(parts) AS piece, unnest(range(0, len(parts))) AS line_idx FROM pieces), "
        f"candidates AS (SELECT {keys}, CAST(line_idx AS INTEGER) AS line_idx, trim(piece, {_SPACES_SQL}) AS raw FROM split_up "
        f"WHERE trim(piece, {_SPACES_SQL}) <> '' AND NOT starts_with(trim(piece, {_SPACES_SQL}), '```'))"
    )


def parsed_sql(expected: str, keys: str) -> str:
    return (
        f"statuses AS (SELECT *, {status_sql('raw', blank=False)} AS found FROM candidates), "
        f"parsed AS (SELECT {keys}, line_idx, raw, CASE WHEN found = '{expected}' THEN 'valid' "
        "WHEN found IN ('sft', 'chat', 'dpo', 'rl') THEN 'wrong_task' ELSE found END AS status FROM statuses)"
    )


RESPONSES = (
    "SELECT source, unit_idx, " + duck_response(shapes("t"), "unit_idx", "unit_idx") + " AS response FROM "
    f"(SELECT source, doc_id AS unit_idx, {DUCK_JSON_TEXT.format('text')} AS t FROM documents)"
)
CANDIDATES = candidate_sql(RESPONSES, "source, unit_idx")
PARSED = f"{CANDIDATES}, {parsed_sql('sft', 'source, unit_idx')}"

# Plan: every document with two prompts, twelve rows asked five at a time.
PROMPTS = ["Ask one question about the text.", "State one fact from the text."]
TARGET, BATCH = 12, 5
PAIRS = (
    "pairs AS (SELECT source, doc_id AS unit_idx, CAST(p AS INTEGER) AS prompt_idx FROM documents, (SELECT unnest([0, 1]) AS p))"
)
PLAN = (
    f"{PAIRS}, plan AS (SELECT source, unit_idx, prompt_idx, b AS batch_idx, least({BATCH}, {TARGET} - b * {BATCH}) AS ask, "
    f"b * {BATCH} AS planned_before FROM pairs, (SELECT unnest(range(0, CAST(ceil({TARGET} / {BATCH}) AS BIGINT))) AS b))"
)
# Answers to the plan: the lines that are rows hold the unit's whole text, the others its name.
ROW_KINDS = (0, 11, 14, 15)
UNIT_NAME = """'"u' || CAST(unit_idx AS {0}) || '"'"""


def answer_shapes(string: str) -> list[str]:
    """The sixteen kinds of lines, with the JSON text ``t`` in those that are rows."""
    named = shapes(UNIT_NAME.format(string))
    return [whole if k in ROW_KINDS else named[k] for k, whole in enumerate(shapes("t"))]


def answer_columns() -> str:
    return spark_response(answer_shapes("STRING"), "unit_idx + prompt_idx + batch_idx", "unit_idx + batch_idx")


ANSWERS = (
    "SELECT source, unit_idx, prompt_idx, batch_idx, "
    + duck_response(answer_shapes("VARCHAR"), "unit_idx + prompt_idx + batch_idx", "unit_idx + batch_idx")
    + f" AS response FROM (SELECT plan.*, {DUCK_JSON_TEXT.format(TEXT)} AS t FROM plan JOIN documents ON unit_idx = doc_id)"
)
ANSWER_KEYS = "source, unit_idx, prompt_idx, batch_idx"
# Answers without any line: all of some units, one batch of others.
BLANK = "(unit_idx % 13 = 5 OR (unit_idx + batch_idx) % 6 = 0)"
PARSED_ANSWERS = f"{PLAN}, {candidate_sql(ANSWERS, ANSWER_KEYS)}, {parsed_sql('sft', ANSWER_KEYS)}"

# Configs: one per document, good and bad fields in turn.
RULES = {"rule_a": "Be brief.", "rule_b": "Be exact.", "rule_c": "Say what is unknown.", "rule_d": "Stay on the topic."}


def config_columns() -> list[str]:
    return [
        "'c' || CAST(doc_id AS {string}) AS name",
        "lang AS description",
        "CASE doc_id % 3 WHEN 0 THEN 'gfs' WHEN 1 THEN 'standard' END AS mode",
        "CASE WHEN doc_id % 17 = 1 THEN '  ' WHEN doc_id % 3 <> 0 THEN text END AS user_prompt",
        "CASE WHEN doc_id % 3 <> 0 THEN NULL WHEN doc_id % 7 = 0 THEN CAST(ARRAY() AS {strings}) "
        "WHEN doc_id % 11 = 0 THEN ARRAY(text, ' ') ELSE ARRAY(text, lang) END AS prompts",
        "CASE WHEN doc_id % 3 <> 0 THEN NULL WHEN doc_id % 13 = 0 THEN '' ELSE source END AS source",
        "CASE WHEN doc_id % 8 = 0 THEN '**/*.md' END AS {glob}",
        "CAST(CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 19 = 0 THEN 50 ELSE n_chars + 100 END AS INT) AS max_source_chars",
        "CASE doc_id % 6 WHEN 0 THEN 'agentrouter/m1' WHEN 1 THEN 'vendor/m2' WHEN 2 THEN '' ELSE 'm3' END AS model",
        "CASE doc_id % 9 WHEN 0 THEN 'sft' WHEN 1 THEN 'sft' WHEN 2 THEN 'chat' WHEN 3 THEN 'chat' WHEN 4 THEN 'dpo' "
        "WHEN 5 THEN 'dpo' WHEN 6 THEN 'rl' WHEN 7 THEN 'rl' ELSE 'other' END AS task",
        "CAST(doc_id % 23 AS INT) AS count",
        "CAST(doc_id % 10 AS DOUBLE) / 5 AS temperature",
        "CAST(doc_id % 6 AS INT) AS batch_size",
        "CASE doc_id % 4 WHEN 0 THEN ARRAY(' Rule_A ', 'rule_c') WHEN 1 THEN CAST(ARRAY() AS {strings}) "
        "WHEN 2 THEN ARRAY('rule_a', 'rule_b', 'RULE_C', 'rule_d') END AS ignore",
    ]


def configs(spark: SparkSession, folder: str) -> DataFrame:
    columns = [c.format(string="STRING", strings="ARRAY<STRING>", glob="glob") for c in config_columns()]
    return table(spark, folder, "documents").selectExpr(*columns)


CONFIGS = "configs AS (" + select_sql(
    [c.format(string="VARCHAR", strings="VARCHAR[]", glob='"glob"') for c in config_columns()], "documents"
) + ")"

# Grounded configs: one per (source, language), and one per language for a source without units.
GROUNDED_COLUMNS = [
    "source || '-' || lang AS name", "lang AS description", "'gfs' AS mode", "CAST(NULL AS {string}) AS user_prompt",
    "CASE WHEN n % 4 = 0 THEN ARRAY(lang) ELSE ARRAY(lang, source) END AS prompts", "source", "'' AS {glob}",
    "CAST(100 + n AS INT) AS max_source_chars", "CASE n % 2 WHEN 0 THEN 'agentrouter/m1' ELSE 'm3' END AS model",
    "CASE n % 3 WHEN 0 THEN 'sft' WHEN 1 THEN 'rl' ELSE 'dpo' END AS task", "CAST(n % 7 AS INT) AS count",
    "CAST(0.5 AS DOUBLE) AS temperature", "CAST(1 + n % 3 AS INT) AS batch_size", "CAST(ARRAY() AS {strings}) AS ignore",
]


def grounded_configs(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    counts = documents.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    others = documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("source", F.lit("no units"))
    columns = [c.format(string="STRING", strings="ARRAY<STRING>", glob="glob") for c in GROUNDED_COLUMNS]
    return counts.unionByName(others).selectExpr(*columns)


GROUNDED_CONFIGS = "grounded AS (" + select_sql(
    [c.format(string="VARCHAR", strings="VARCHAR[]", glob='"glob"') for c in GROUNDED_COLUMNS],
    "(SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang "
    "UNION ALL SELECT 'no units', lang, count(*) FROM documents GROUP BY lang)",
) + ")"

# Chunk trace: events as chunks of a user's run; some hold no token, some end a word.
TRACE_COLUMNS = [
    "user_id AS run_id", "event_id AS seq", "ts", "CASE WHEN event_id % 3 = 0 THEN event_type || ' ' "
    "WHEN event_id % 29 = 0 THEN '' ELSE event_type END AS chunk",
    "CAST(CASE WHEN event_id % 7 = 0 THEN 0 ELSE ceil(value) END AS BIGINT) AS tokens",
]
LEAD_US = 1_000_000


def trace(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(*TRACE_COLUMNS)


TRACE = (
    f"raw_trace AS (SELECT {', '.join(TRACE_COLUMNS)} FROM events), "
    "trace AS (SELECT run_id, seq, epoch_us(ts) AS us, chunk, CASE WHEN tokens = 0 AND chunk <> '' THEN 1 ELSE tokens END AS tokens FROM raw_trace), "
    f"runs AS (SELECT run_id, min(us) - {LEAD_US} AS started_us, max(us) AS ended_us FROM trace GROUP BY run_id), "
    "lagged AS (SELECT trace.*, started_us, sum(tokens) OVER w AS cumulative_tokens, "
    "us - coalesce(lag(us) OVER w, started_us) AS passed FROM trace JOIN runs USING (run_id) "
    "WINDOW w AS (PARTITION BY run_id ORDER BY seq)), "
    "steps AS (SELECT run_id, seq, chunk, tokens, CAST(cumulative_tokens AS BIGINT) AS cumulative_tokens, "
    "(us - started_us) / 1e6 AS elapsed_s, CASE WHEN tokens > 0 AND passed > 0 THEN tokens / (passed / 1e6) END AS tps FROM lagged)"
)

SAMPLE_COLUMNS = ["user_id AS run_id", "ts", "value AS celsius"]

# Training runs: one per order.
RUN_COLUMNS = [
    "o_orderkey AS run",
    "CASE WHEN o_orderkey % 37 = 0 THEN 'other' ELSE CASE o_orderkey % 6 WHEN 0 THEN 'lora' WHEN 1 THEN 'qlora' "
    "WHEN 2 THEN 'full' WHEN 3 THEN 'dpo' WHEN 4 THEN 'grpo' ELSE 'ppo' END END AS method",
    "CASE o_custkey % 4 WHEN 0 THEN 'sft' WHEN 1 THEN 'chat' WHEN 2 THEN 'dpo' ELSE 'rl' END AS task",
    "CASE WHEN o_orderkey % 11 = 0 THEN 'rl' WHEN o_orderkey % 13 = 0 THEN '' END AS task_override",
    "CASE WHEN o_orderkey % 4 = 0 THEN 'words' END AS reward_fn",
    "CASE WHEN o_orderkey % 5 = 0 THEN 'scorer' END AS reward_model",
    "o_custkey AS count", "CAST(1 + o_orderkey % 8 AS INT) AS batch",
    "CAST(1 + o_orderkey % 4 AS INT) AS accum", "CAST(1 + o_orderkey % 3 AS INT) AS epochs",
]

# Files: one per document, three to a folder.
FILE_COLUMNS = [
    "source || '/' || lang || CAST(CAST(floor(doc_id / 3) AS BIGINT) AS {0}) AS dir",
    "CASE doc_id % 5 WHEN 0 THEN 'w.gguf' WHEN 1 THEN 'config.json' WHEN 2 THEN 'w.safetensors' WHEN 3 THEN 'w.bin' ELSE 'README.md' END AS file",
    "n_chars AS length",
]

# Links: one per page, URLs as they are and other forms in turn.
LINK_COLUMNS = [
    "page_id",
    "CASE page_id % 11 WHEN 0 THEN 'o/r' || CAST(page_id AS {0}) WHEN 1 THEN 'o/r/f' || CAST(page_id AS {0}) || '.gguf' "
    "WHEN 2 THEN ' m' || CAST(page_id AS {0}) || '/ ' WHEN 3 THEN 'o/r/x/y' "
    "WHEN 4 THEN 'https://h/o/r/resolve/main/d/f' || CAST(page_id AS {0}) || '.gguf' "
    "WHEN 5 THEN 'https://h/o/r/blob/v2/f.txt//' WHEN 6 THEN 'https://h/o/r/raw' WHEN 7 THEN 'https://h' "
    "ELSE url END AS link",
]

"""JSON lines as VARIANT columns: the strict gate, task detection, field access.

Every rule works on one VARIANT column, so a line is parsed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SFT, CHAT, DPO, RL = "sft", "chat", "dpo", "rl"
TASKS = (SFT, CHAT, DPO, RL)
# The text columns of a task's training rows; chat has turns instead.
TEXT_COLUMNS = {SFT: ("prompt", "completion"), DPO: ("prompt", "chosen", "rejected"), RL: ("prompt",)}
TURN_COLUMNS = ("role", "content")
# The keys that tell the tasks apart.
TASK_KEYS = ("prompt", "chosen", "rejected", "completion", "messages")
BAD_JSON, NON_OBJECT, UNRECOGNISED, TOO_LARGE = "bad_json", "non_object", "unrecognised", "too_large"
# What makes a whole dataset invalid.
INVALID = (BAD_JSON, NON_OBJECT, TOO_LARGE)
# A VARIANT holds 128 MiB; many small values need several times their text. Longer lines
# without a value may be valid, so they are told apart from broken ones.
LARGE_LINE = 32 << 20

_GUARD = '"\\u0001~end"'
_OPTIONS = (
    "map('allowSingleQuotes', 'false', 'maxStringLen', '2147483647', 'maxNumLen', '2147483647', 'maxNestingDepth', '2147483647')"
)


def guarded_sql(raw: str) -> str:
    """The line as the first element of an array whose second one is the guard string."""
    wrapped = f"'[' || `{raw}` || ',{sql_text(_GUARD)}]'"
    return f"from_json({wrapped}, 'array<variant>', {_OPTIONS})"


def sole_value_sql(raw: str, pair: str, decoded: bool = False) -> str:
    """The first element of ``pair`` (SQL of the guarded line), or NULL unless the line is one whole value.

    ``decoded``: the line is a piece of a split text. Splitting decodes, so its bytes are known to be valid.
    """
    # a control character has one spelling in JSON, the rest of the guard may be escaped as well
    member = f"'{{\"v\":' || `{raw}` || '}}'"
    second = (
        f"CASE WHEN contains(`{raw}`, '+Infinity') THEN try_parse_json({member}) IS NOT NULL "
        f"WHEN contains(`{raw}`, '{sql_text(_GUARD[1:7])}') THEN from_json({member}, 'variant', {_OPTIONS}) IS NOT NULL ELSE true END"
    )
    guard = f"try_variant_get(get({pair}, 1), '$', 'string') = '\\u0001~end'"
    valid = "" if decoded else f"AND is_valid_utf8(`{raw}`) "
    return (
        f"CASE WHEN size({pair}) = 2 AND {guard} {valid}"
        f"AND {second} THEN get({pair}, 0) END"
    )


def parse_strict(raw: str) -> Column:
    """``raw`` (a column name) as VARIANT, or NULL unless all of it is one JSON value.

    Spark's parsers ignore whatever follows the first value. The line is put into
    an array ahead of a guard string: only a single whole value leaves exactly the
    two elements. Lines that hold the guard or ``+Infinity`` themselves take an
    exact second look.
    """
    return F.expr(sole_value_sql(raw, guarded_sql(raw)))


def with_value(df: DataFrame, raw: str = "raw", name: str = "value", decoded: bool = False) -> DataFrame:
    """Add the parsed line as column ``name``, in a form that is evaluated once; ``decoded`` as for ``sole_value_sql``.

    A filter on what is derived from the value would otherwise be pushed below the
    projection and repeat the parse for every mention; it stops at an explode.
    """
    pairs = df.withColumn("_pair", F.expr(guarded_sql(raw)))
    return pairs.select(*df.columns, F.explode(F.array(F.expr(sole_value_sql(raw, "_pair", decoded)))).alias(name))


def sql_text(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def is_object(raw: Column, value: Column) -> Column:
    """Whether a valid line is an object; ``raw`` is stripped text."""
    return value.isNotNull() & raw.startswith("{")


def has_key(value: Column, key: str) -> Column:
    """Key presence: a JSON null counts as present."""
    return F.try_variant_get(value, f"$.{key}", "variant").isNotNull()


def is_list(value: Column, key: str) -> Column:
    member = F.try_variant_get(value, f"$.{key}", "variant")
    return member.isNotNull() & F.schema_of_variant(member).startswith("ARRAY")


def task_of(value: Column) -> Column:
    """The task of an object by the keys it holds, first rule that fits; else NULL."""
    prompt, chosen, rejected, completion, messages = (
        has_key(value, key) for key in TASK_KEYS
    )
    return (
        F.when(prompt & chosen & rejected, DPO)
        .when(is_list(value, "messages"), CHAT)
        .when(prompt & completion, SFT)
        .when(prompt & ~completion & ~chosen & ~messages, RL)
    )


def line_status(raw: Column, value: Column) -> Column:
    """The task of a stripped line, or why it has none."""
    return (
        F.when(value.isNull() & (F.octet_length(raw) > LARGE_LINE), TOO_LARGE)
        .when(value.isNull(), BAD_JSON)
        .when(~is_object(raw, value), NON_OBJECT)
        .otherwise(F.coalesce(task_of(value), F.lit(UNRECOGNISED)))
    )


def text_at(value: Column, path: str) -> Column:
    """A member as text, a JSON null as NULL; lists and objects keep their JSON form."""
    return F.try_variant_get(value, path, "string")


def messages_of(value: Column) -> Column:
    """``array<struct<role:string,content:string>>`` of a chat object."""
    turns = F.try_variant_get(value, "$.messages", "array<variant>")
    return F.transform(
        turns,
        lambda turn: F.struct(*[text_at(turn, f"$.{name}").alias(name) for name in TURN_COLUMNS]),
    )


def columns_of(value: Column, task: str) -> list[Column]:
    """The columns that a task's training rows consist of."""
    if task == CHAT:
        return [messages_of(value).alias("messages")]
    if task not in TEXT_COLUMNS:
        raise ValueError(f"unknown task: {task}")
    return [text_at(value, f"$.{name}").alias(name) for name in TEXT_COLUMNS[task]]

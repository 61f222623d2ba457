"""String columns: trimming, line splitting, truncation, rendering, small formats."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

# What Python's str.strip() removes.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
# What Python's str.splitlines() breaks on.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
RARE_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
# The start of lines that are left out of responses, and the mark of a cut text.
CODE_FENCE = "```"
TRUNCATION_MARK = "\n... [truncated at {limit} chars]"


def strip(text: Column) -> Column:
    """Trimming looks at every character of a text, so texts without a space at either end are left alone."""
    edges = reduce(or_, [text.startswith(space) | text.endswith(space) for space in SPACES])
    return F.when(edges, F.btrim(text, F.lit(SPACES))).otherwise(text)


def split_lines(text: Column) -> Column:
    """Lines as Python's str.splitlines() finds them.

    Most texts break at newlines alone, or at CRLF and newlines; splitting those at the one character is
    several times as fast as the regex. The marks are looked for in the bytes, which is again faster.
    """
    def holds(value: Column, mark: str) -> Column:
        return F.contains(value.cast("binary"), F.lit(mark.encode()))

    rare = reduce(or_, [holds(text, mark) for mark in RARE_BREAKS if mark != "\r"])
    by_newline = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    return (
        F.when(rare, F.split(text, LINE_BREAK))
        .when(~holds(text, "\r"), F.split(text, "\n"))
        .when(holds(by_newline, "\r"), F.split(text, LINE_BREAK))
        .otherwise(F.split(by_newline, "\n"))
    )


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def token_count(text: Column) -> Column:
    """Whitespace-separated words; an empty string has none.

    Splitting at one literal character is several times as fast as a regex here.
    """
    words = F.split(F.translate(text, SPACES, " " * len(SPACES)), " ")
    return F.size(F.array_remove(words, ""))


def chunk_tokens(tokens: Column, chunk: Column) -> Column:
    """A chunk that holds any text counts as one token at least."""
    return F.when((tokens == 0) & (chunk != ""), F.lit(1)).otherwise(tokens)


def truncate(text: Column, limit: int | Column, mark: str = TRUNCATION_MARK) -> Column:
    """Keep ``limit`` characters and append the mark, which is not counted in the limit."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    before, _, after = mark.partition("{limit}")
    tail = F.concat(F.lit(before), limit.cast("string"), F.lit(after)) if "{limit}" in mark else F.lit(mark)
    return F.when(F.length(text) > limit, F.concat(F.substr(text, F.lit(1), limit), tail)).otherwise(text)


def plain_text(raw: Column) -> Column:
    """File content as text: bad UTF-8 bytes replaced, CRLF and CR turned into LF."""
    return F.regexp_replace(F.make_valid_utf8(raw.cast("string")), "\r\n?", "\n")


def format_sft(prompt: Column, completion: Column) -> Column:
    """Prompt and completion as one text; a NULL one is empty."""
    return F.concat(F.coalesce(prompt, F.lit("")), F.coalesce(completion, F.lit("")))


def format_chat(messages: Column) -> Column:
    """Each turn as a role tag line and its content, turns joined by newlines."""
    def turn(message: Column) -> Column:
        return F.concat(
            F.lit("<|"), F.coalesce(message["role"], F.lit("")), F.lit("|>\n"),
            F.coalesce(message["content"], F.lit("")),
        )

    return F.array_join(F.transform(messages, turn), "\n")


def safe_name(repo: Column) -> Column:
    return F.replace(repo, F.lit("/"), F.lit("--"))


def mask_secret(secret: Column) -> Column:
    shown = F.concat(F.substring(secret, 1, 8), F.lit("..."), F.substring(secret, -4, 4))
    return F.when(F.length(secret) > 12, shown).otherwise(F.lit("****"))


def human_size(size: Column) -> Column:
    """Bytes below one KiB as they are, else KB with one decimal, ties to even."""
    # A tenth of a KB is 102.4 bytes; ties are decided on whole numbers.
    tenfold = size * 10
    whole = F.floor(tenfold / 1024).cast("long")
    rest = tenfold - whole * 1024
    tenths = whole + F.when((rest > 512) | ((rest == 512) & (whole % 2 == 1)), 1).otherwise(0)
    kb = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" KB"))
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).otherwise(kb)


def minute_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def split_names(names: Column) -> Column:
    """Comma-separated names, trimmed, empties dropped."""
    return F.filter(F.transform(F.split(names, ","), strip), lambda name: name != "")


def fill_template(template: str, **values: Column) -> Column:
    """``{name}`` places in a user's template become columns; the rest stays literal."""
    parts: list[Column] = []
    rest = template
    while rest:
        head, brace, tail = rest.partition("{")
        if not brace:
            parts.append(F.lit(head))
            break
        name, close, after = tail.partition("}")
        if close and name in values:
            parts += [F.lit(head), values[name].cast("string")]
            rest = after
        else:
            parts.append(F.lit(head + "{"))
            rest = tail
    return F.concat(*parts) if parts else F.lit("")

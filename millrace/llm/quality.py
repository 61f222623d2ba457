"""Line-first document cleaning, as column expressions only.

Every line is judged by itself (punctuation, navigation, symbols, capitals, boilerplate
phrases); failing lines go, and a document that loses too much of its text goes with them.
A line without a final mark fails only if it is short or holds no mark at all; with ``prose``
the lines of a hard-wrapped passage are judged together.
No shuffle and no Python: each row is decided alone, so hot sources, copies and keys do not
matter, and a lost executor costs only its own rows.

Defined results. Null text: as an empty one (no words, rejected for its word count). Lines
without a word are neither kept nor counted. Repeated rows: one result each. Empty table:
empty result. Columns with clashing names stay as they are; the result columns replace
columns of the same name.
"""

from __future__ import annotations

from functools import reduce
from itertools import groupby
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|>»·•"
#: The end marks of many scripts, perhaps followed by closing quotes and brackets, or a closing quote.
END_MARKS = ".!?…。！？｡．؟۔।॥։።፧។။‼⁇⁈⁉‽"
CLOSERS = r"""\)\]\}"'”’“»«›‹」』）】》〉］｝*_"""
#: Sought from the end, where most lines have one.
PROSE_END = rf"""(?s)\A.*(?:[{END_MARKS}][{CLOSERS}]*|["”»])[\x20\x09-\x0D]*\z"""
#: An end mark within a passage: before white space, or one that is written without a blank after it.
SENTENCE_MARK = rf"""[{END_MARKS}][{CLOSERS}]*[\x20\x09-\x0D]|[。！？｡।॥።។။]"""
#: Characters of the shortest line that may be wrapped, and of the shortest line or passage that may lack its final mark.
PROSE_CHARS = 40
#: Characters of the longest line that counts as wrapped though it ends with a mark.
WRAPPED_CHARS = 120
#: A line feed that ends a passage: after a short line, before a blank one, or after a finished one that is not amid wrapped lines.
PASSAGE_BREAK = (
    rf"\n(?:(?<![^\n]{{{PROSE_CHARS}}}\n)|(?<=[{END_MARKS}\"”»][{CLOSERS}]{{0,8}}[\x20\x09\x0B-\x0D]{{0,8}}\n)"
    rf"(?:(?![^\n]{{{PROSE_CHARS}}})|(?<=[^\n]{{{WRAPPED_CHARS + 1}}}\n))|(?=[\x20\x09\x0B-\x0D]*+(?:\n|\z)))"
)
#: Phrases of page furniture, compared in lower case.
BOILERPLATE = (
    "all rights reserved", "accept all cookies", "click here", "cookie policy", "enable javascript",
    "follow us on", "forgot your password", "lorem ipsum", "privacy policy", "share this",
    "sign in to", "sign up for", "skip to content", "subscribe to our", "terms of service",
    "terms of use", "use cookies",
)
#: The same by first letter, in any ASCII case.
FURNITURE = "(?i)(?:" + "|".join(
    f"{letter}(?:{'|'.join(phrase[1:] for phrase in phrases)})" for letter, phrases in groupby(sorted(BOILERPLATE), key=lambda phrase: phrase[0])
) + ")"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
MAX_LOST_PERCENT = 50
WINDOW = 3
RESULTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_lost_lines", "clean_text", "base_failed", "kept",
)


def count_of(text: Column, characters: str) -> Column:
    return F.regexp_count(text, F.lit("[" + "".join(f"\\{c}" if c in "|$*&" else c for c in characters) + "]"))


def line_fails(line: Column) -> Column:
    """True for a line that any rule rejects."""
    return prose_fails(line) | furniture(line)


def furniture(line: Column) -> Column:
    """True for a line that a rule other than the one on its end rejects."""
    words = F.regexp_count(line, F.lit(f"{WORD}+"))
    separators = count_of(line, SEPARATORS)
    return (
        ((separators >= 2) & (separators * 4 >= words))
        | (count_of(line, SYMBOLS) * 10 > F.length(line))
        | ((F.length(line) >= 20) & (count_of(line, UPPER) * 10 > F.length(line) * 6))
        | line.rlike(FURNITURE)
    )


def prose_fails(passage: Column) -> Column:
    """True for a line or passage without a final mark that is short or holds no mark at all."""
    return ~passage.rlike(PROSE_END) & ((F.length(F.btrim(passage, F.lit(SPACES))) < PROSE_CHARS) | ~passage.rlike(SENTENCE_MARK))


def good_lines(text: Column) -> Column:
    """The lines with a word that pass when the ends are judged by passages of wrapped lines."""
    def lines(passage: Column) -> Column:
        kept = F.filter(F.split(passage, "\n"), lambda line: line.rlike(WORD) & ~furniture(line))
        return F.when(prose_fails(passage), F.array().cast("array<string>")).otherwise(kept)

    return F.flatten(F.transform(F.split(text, PASSAGE_BREAK), lines))


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """The windows of ``size`` words by hash and first position, in that order; null if there is only one.

    ``words`` must be a plain column, as it is read once per window.
    """
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - size),
        lambda i: F.struct(F.xxhash64(*[F.get(words, i + k) for k in range(size)]).alias("h"), i.alias("i")),
    )
    return F.when(F.size(words) > size, F.sort_array(windows))


def same(items: Column, item: Column, j: Column, *fields: str) -> Column:
    """Whether the item at ``j``, if there is one, has these fields in common with ``item``."""
    return F.coalesce(reduce(and_, [F.get(items, j)[f] == item[f] for f in fields]), F.lit(False))


def same_hashes(words: Column, windows: Column, size: int = WINDOW) -> Column:
    """The windows whose hash occurs again, by hash, words and position: equal windows are neighbours, whatever hashes coincide."""
    again = F.filter(windows, lambda x, i: same(windows, x, i - 1, "h") | same(windows, x, i + 1, "h"))
    return F.sort_array(F.transform(again, lambda x: F.struct(x["h"].alias("h"), F.slice(words, x["i"] + 1, size).alias("w"), x["i"].alias("i"))))


def positions_of_repeats(windows: Column) -> Column:
    """Sorted first positions of the windows that an equal neighbour has."""
    equal = F.filter(windows, lambda x, i: same(windows, x, i - 1, "h", "w") | same(windows, x, i + 1, "h", "w"))
    return F.sort_array(F.transform(equal, lambda x: x["i"]))


def covered_by(positions: Column, size: int = WINDOW) -> Column:
    """How many words the windows at these sorted positions cover."""
    return F.coalesce(F.aggregate(
        F.transform(positions, lambda p, i: F.least(F.lit(size), F.coalesce(F.get(positions, i + 1) - p, F.lit(size)))),
        F.lit(0).cast("long"), lambda total, n: total + n,
    ), F.lit(0).cast("long"))


def judge_quality(
    documents: DataFrame, min_words: int = MIN_WORDS, max_repeated_percent: int = MAX_REPEATED_PERCENT,
    max_lost_percent: int = MAX_LOST_PERCENT, text: str = "text", prose: bool = False,
) -> DataFrame:
    """Add the word and line counts, ``clean_text``, ``base_failed`` and ``kept``.

    ``clean_text`` holds the lines that pass, joined by line feeds. ``kept`` is false for a
    document that fails the base limits or loses more than ``max_lost_percent`` of the
    characters of its lines. ``prose``: hard-wrapped lines share the marks of their passage.
    """
    step = documents.select(F.struct("*").alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    whole = F.col("_text")
    step = step.withColumns({
        "_trimmed": F.btrim(whole, F.lit(SPACES)),
        "_lines": F.filter(F.split(whole, "\n"), lambda line: line.rlike(WORD)),
        "n_symbols": count_of(whole, SYMBOLS).cast("long"),
    })
    step = step.withColumns({
        "_words": F.when(F.col("_trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("_trimmed", f"{SPACE}+")),
        "_good": good_lines(whole) if prose else F.filter("_lines", lambda line: ~line_fails(line)),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    }).drop("_trimmed")
    step = step.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "_windows": repeated_words(F.col("_words")),
        "n_lines": F.size("_lines").cast("long"),
        "n_lost_lines": (F.size("_lines") - F.size("_good")).cast("long"),
        "_chars": F.length(F.array_join("_lines", "")),
        "_good_chars": F.length(F.array_join("_good", "")),
        "clean_text": F.array_join("_good", "\n"),
    }).drop("_lines", "_good")
    step = step.withColumn("_again", same_hashes(F.col("_words"), F.col("_windows"))).drop("_words", "_windows")
    step = step.withColumn("_repeats", positions_of_repeats(F.col("_again"))).drop("_again")
    step = step.withColumn("n_repeat_words", covered_by(F.col("_repeats"))).drop("_repeats")
    step = step.withColumn(
        "base_failed",
        (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeated_percent),
    )
    lost = (F.col("_chars") - F.col("_good_chars")) * 100
    step = step.withColumn("kept", ~F.col("base_failed") & (lost <= F.col("_chars") * max_lost_percent))
    # An explode of one row: a filter on the results must not be pushed below and repeat the work.
    others = [c for c in documents.columns if c not in RESULTS]
    return step.select("_row", F.explode(F.array(F.struct(*RESULTS))).alias("_r")).select(
        *[F.col("_row").getField(c).alias(c) for c in others], "_r.*"
    )

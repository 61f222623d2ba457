"""User callables over columns: reward scores and model tokenizers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

from millrace.functions.text import token_count


def reward_score(score: Callable[[pd.Series, pd.Series], pd.Series]):
    """A user's ``score(prompts, responses)`` as a column function; it gets and gives whole batches."""

    @F.pandas_udf("double")
    def apply(prompt: pd.Series, response: pd.Series) -> pd.Series:
        return pd.Series(score(prompt, response), dtype="float64")

    return apply


def word_reward(response: Column, words: int = 100) -> Column:
    """Longer responses score higher: words over ``words``, at most 1."""
    return F.least(token_count(response) / F.lit(float(words)), F.lit(1.0))


def _encoded_length(encode: Callable[[str], list], text: str) -> int | None:
    """NULL where the user's tokenizer gives up, for whatever reason."""
    try:
        return len(encode(text))
    except Exception:
        return None


def tokenizer_udf(factory: Callable[[], Callable[[str], list]]) -> Callable[[Column | str], Column]:
    """Token counts by a user's tokenizer, which each Python worker builds once.

    Texts that the tokenizer fails on come back as NULL from Python and are counted by
    their words in the JVM.
    """

    @F.pandas_udf("int")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = factory()
        for texts in batches:
            yield pd.Series([None if t is None else _encoded_length(encode, t) for t in texts], dtype="Int32")

    def tokens(text: Column | str) -> Column:
        column = F.col(text) if isinstance(text, str) else text
        return F.coalesce(encoded(column), token_count(column))

    return tokens

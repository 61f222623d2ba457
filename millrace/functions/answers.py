"""The rules of ``operators.responses.first_valid`` for an answer that is still in the Python worker that asked for it.

A line is parsed only if it spells the keys of the task that is asked for. What Spark's parser may see in another way than
Python's (very deep values, very long keys or lines, the number ``-INF``) is left to it: such an answer is not judged here.
"""

from __future__ import annotations

import json
import re

import pandas as pd

from millrace.functions import jsonrow
from millrace.functions.text import CODE_FENCE, RARE_BREAKS

#: From here on a key may be too long for Spark's parser (50,000 UTF-16 units), and a line for a VARIANT (in bytes).
LONG_KEY, LONG_LINE = 25_000, jsonrow.LARGE_LINE // 4
_ODD_NUMBER = re.compile(r"(?:^|[\[:,\s])[-+]INF(?:[\]},\s]|$)")
_NEEDED = {**jsonrow.TEXT_COLUMNS, jsonrow.CHAT: ("messages",)}
_SPELLED = {task: tuple(f'"{key}"' for key in keys) for task, keys in _NEEDED.items()}
JUDGED = "response string, _added bigint, _missed bigint, _places array<int>, _kept array<string>"


class _Unsure(Exception):
    """Spark's parser has to look at this answer."""


def _members(pairs: list[tuple]) -> dict:
    if any(len(key) > LONG_KEY for key, _ in pairs):
        raise _Unsure
    return dict(pairs)


# numbers of any length are numbers, and nobody looks at their values
_decode = json.JSONDecoder(parse_int=len, parse_float=len).decode
_decode_long = json.JSONDecoder(parse_int=len, parse_float=len, object_pairs_hook=_members).decode


def _task_of(row: dict) -> str:
    has = row.__contains__
    prompt, chosen, rejected, completion, messages = map(has, jsonrow.TASK_KEYS)
    if prompt and chosen and rejected:
        return jsonrow.DPO
    if messages and isinstance(row["messages"], list):
        return jsonrow.CHAT
    if prompt and completion:
        return jsonrow.SFT
    return jsonrow.RL if prompt and not (chosen or messages) else jsonrow.UNRECOGNISED


def line_status(raw: str) -> str:
    """The task of a stripped line, or why it has none; as ``jsonrow.line_status``."""
    if len(raw) > LONG_LINE:
        raise _Unsure
    try:
        value = (_decode_long if len(raw) > LONG_KEY else _decode)(raw)
    except RecursionError:
        raise _Unsure from None
    except ValueError:
        if "INF" in raw and _ODD_NUMBER.search(raw):
            raise _Unsure from None
        return jsonrow.BAD_JSON
    return _task_of(value) if isinstance(value, dict) else jsonrow.NON_OBJECT


def _is_valid(raw: str, expected: str) -> bool:
    spelled = _SPELLED.get(expected)
    if spelled is not None:
        if raw[0] != "{" or raw[-1] != "}":
            return False
        # a key can be spelled with escapes as well
        if not all(key in raw for key in spelled) and "\\u" not in raw:
            return False
    return line_status(raw) == expected


def _lines(text: str) -> list[str]:
    """Lines as ``splitlines`` finds them; looking for each of its rare marks and splitting at newlines is faster."""
    return text.splitlines() if any(mark in text for mark in RARE_BREAKS) else text.split("\n")


def judge(response: str, expected: str, room: int) -> tuple[int, int, list[int], list[str]] | None:
    """How many lines are valid, how many are not, and the places and texts of the first ``room`` valid ones."""
    added, missed, places, raws = 0, 0, [], []
    try:
        for place, line in enumerate(_lines(response)):
            raw = line.strip()
            if not raw or raw.startswith(CODE_FENCE):
                continue
            if not _is_valid(raw, expected):
                missed += 1
                continue
            added += 1
            if added <= room:
                places.append(place)
                raws.append(raw)
    except _Unsure:
        return None
    return added, missed, places, raws


def judged(responses: list, expected: pd.Series, rooms: pd.Series) -> dict[str, list]:
    """The columns ``JUDGED``: only a response that could not be judged is handed on."""
    columns = {name.split()[0]: [] for name in JUDGED.split(", ")}
    for response, task, room in zip(responses, expected, rooms):
        if isinstance(response, str):
            found = judge(response, task, room)
            row = (response, None, None, None, None) if found is None else (None, *found)
        elif response is None or response is pd.NA or response != response:
            row = (None, 0, 0, [], [])
        else:
            row = (response, None, None, None, None)  # no text: refused where it leaves Python
        for column, value in zip(columns.values(), row):
            column.append(value)
    return columns

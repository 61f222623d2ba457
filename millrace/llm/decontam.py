"""Benchmark passages in documents, by Wu-Manber search over words.

Every window of ten item words is a test string. Windows of one length share a table of
shifts by block (two neighbouring words): a scan position whose block stands in no window
jumps by the whole window, others as far as the nearest place of the block allows. Where
the shift is nought, the windows whose last block hashes alike are looked up and compared
word by word. Many scan positions move at once, in numpy.

The windows are dealt into blocks of a bounded count; one block at a time is broadcast.
More than one block means that many passes over the documents, each written to the shared
folder. Documents are never shuffled.

Defined results. Null or wordless text: no words, no hit. Null or wordless item: no window.
An item with a null id counts as the item ``null``. Items with the same id count once. Repeated
documents: one result each. Empty tables: empty result, or no hit. The result columns
replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from millrace.session import settle

WINDOW = 10
#: Windows in one block, which bounds what is collected and broadcast (about 20 MB).
BLOCK_WINDOWS = 100_000
#: Words that one scan position has to pass over.
LANE = 128
#: Texts are turned into words in groups of about this many bytes.
GROUP_BYTES = 4_000_000
#: Bytes to word characters in lower case; all others become blanks.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def item_windows(items: DataFrame, window: int = WINDOW, key: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (``words``, ``item``): the windows that items hold, as one string of words."""
    folded = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = items.select(
        F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("item"),
        F.regexp_extract_all(folded, F.lit(ITEM_WORD), F.lit(0)).alias("w"),
    ).filter(F.size("w") > 0)
    # windows are made inside the row, so that no copy of the words goes with each of them
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    windows = F.transform(starts, lambda i: F.array_join(F.slice("w", i + 1, window), " "))
    return words.select(F.explode(windows).alias("words"), "item").distinct()


class Table:
    """Shift and suffix tables of the windows of one length; words are numbers from 1 on."""

    def __init__(self, windows: np.ndarray, ids: np.ndarray) -> None:
        self.length = m = windows.shape[1]
        self.block = min(2, m)
        self.bits = max(16, int(np.ceil(np.log2(len(windows) * 8 + 1))))
        shift = np.full(1 << self.bits, m - self.block + 1, np.int32)
        for end in range(self.block - 1, m):
            np.minimum.at(shift, self.hashed(windows, end), m - 1 - end)
        whole = self.whole(windows)
        order = np.lexsort((whole, self.hashed(windows, m - 1)))
        self.shift, self.windows, self.ids = shift, windows[order], ids[order]
        suffix = self.hashed(self.windows, m - 1)
        self.first = np.searchsorted(suffix, np.arange((1 << self.bits) + 1))
        self.whole_of = whole[order]

    def hashed(self, windows: np.ndarray, end: int) -> np.ndarray:
        before = windows[:, end - 1] if self.block == 2 else np.zeros(len(windows), np.int64)
        return self.pair(before, windows[:, end])

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        mixed = (a.astype(np.uint64) * np.uint64(1_000_003) + b.astype(np.uint64)) * MULTIPLIER
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def whole(self, windows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(windows), np.uint64)
        for k in range(windows.shape[1]):
            out = (out ^ windows[:, k].astype(np.uint64)) * MULTIPLIER
            out ^= out >> np.uint64(29)
        return out

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last word's place, window id) of every occurrence in a row of numbers."""
        m = self.length
        if len(words) < m:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.arange(m - 1, len(words), LANE)
        stop = np.minimum(at + LANE, len(words))
        hits = []
        while len(at):
            block = self.pair(words[at - 1] if self.block == 2 else np.zeros(len(at), np.int64), words[at])
            jump = self.shift[block]
            if len(zero := np.flatnonzero(jump == 0)):
                hits.append(at[zero])
            at = at + np.maximum(jump, 1)
            go = at < stop
            at, stop = at[go], stop[go]
        if not hits:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        ends = np.sort(np.concatenate(hits))
        found = words[ends[:, None] + np.arange(1 - m, 1)]
        suffix, whole = self.hashed(found, m - 1), self.whole(found)
        low, high = self.first[suffix], self.first[suffix + 1]
        for _ in range(int(np.ceil(np.log2(len(self.windows) + 1))) + 1):  # the whole hash, within the bucket
            mid = np.minimum((low + high) // 2, len(self.windows) - 1)
            right = (low < high) & (self.whole_of[mid] < whole)
            low, high = np.where(right, mid + 1, low), np.where((low < high) & ~right, mid, high)
        at = np.minimum(low, len(self.windows) - 1)
        same = (self.windows[at] == found).all(axis=1)
        for k in np.flatnonzero(~same & (self.whole_of[at] == whole)):  # windows that only hash alike
            for j in range(at[k] + 1, self.first[suffix[k] + 1]):
                if (self.windows[j] == found[k]).all():
                    at[k], same[k] = j, True
                    break
        return ends[same], self.ids[at[same]]


class Search:
    """The tables of one block of windows, a table for each length."""

    def __init__(self, windows: dict[str, list[str]]) -> None:
        split = [key.encode("utf-8", "surrogatepass").split(b" ") for key in windows]
        self.items = list(windows.values())
        self.numbers = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for words in split for w in words))}
        by_length: dict[int, list[int]] = {}
        for i, words in enumerate(split):
            by_length.setdefault(len(words), []).append(i)
        self.tables = [
            Table(np.array([[self.numbers[w] for w in split[i]] for i in ids], np.int64), np.array(ids, np.int64))
            for ids in by_length.values()
        ]

    def numbered(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.numbers.get, words, repeat(0)), np.int64, len(words))

    def scan(self, texts: list[str | None]) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
        """Per text: its word count, the word spans that windows cover, and their items."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text or "")
            if size >= GROUP_BYTES:
                yield from self.scan_group(group)
                group, size = [], 0
        yield from self.scan_group(group)

    def scan_group(self, texts: list[str | None]) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
        if not texts:
            return
        numbers = [self.numbered(words_of(t)) for t in texts]
        gap = np.zeros(1, np.int64)  # no word has the number 0, so nothing matches across texts
        row = np.concatenate([part for n in numbers for part in (n, gap)])
        starts = np.concatenate([[0], np.cumsum([len(n) + 1 for n in numbers])])
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[str]] = {}
        for table in self.tables:
            for end, window in zip(*(x.tolist() for x in table.find(row)), strict=True):
                doc = int(np.searchsorted(starts, end, "right")) - 1
                last = end - int(starts[doc]) + 1
                spans.setdefault(doc, []).append((last - table.length, last))
                items.setdefault(doc, set()).update(self.items[window])
        for doc, n in enumerate(numbers):
            yield len(n), merged(spans.get(doc, [])), items.get(doc, set())


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


SPANS = "array<struct<start:bigint,end:bigint>>"
FOUND = {"n_words": "bigint", "_spans": SPANS, "_items": "array<string>"}


def find_passages(
    documents: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """Add ``n_words``, ``hit_spans`` (word numbers, end exclusive) and ``items`` (sorted ids)."""
    windows = settle(item_windows(items, window), "windows")
    blocks = max(1, -(-windows.count() // block_windows))
    dealt = windows.withColumn("block", F.pmod(F.xxhash64("words", "item"), F.lit(blocks)))
    df = documents.drop(*FOUND, "hit_spans", "items")
    empty = {n: F.lit(None).cast(t) for n, t in FOUND.items()}
    df = df.withColumns(empty)
    context = documents.sparkSession.sparkContext
    for number in range(blocks):
        by_window: dict[str, list[str]] = {}
        for row in dealt.filter(F.col("block") == number).select("words", "item").toLocalIterator():
            by_window.setdefault(row.words, []).append(row.item)
        tables = context.broadcast(by_window)
        df = df.mapInArrow(scanner(tables, text), df.schema)
        if number + 1 < blocks:
            df = settle(df, "decontam")
    return df.withColumnsRenamed({"_spans": "hit_spans", "_items": "items"})


def scanner(tables, text: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = None
        for batch in batches:
            search = search or Search(tables.value)
            found = list(search.scan(batch.column(text).to_pylist()))
            old = zip(batch.column("_spans").to_pylist(), batch.column("_items").to_pylist(), strict=True)
            spans, ids = [], []
            for (_, new_spans, new_items), (old_spans, old_items) in zip(found, old, strict=True):
                both = merged([*((s["start"], s["end"]) for s in old_spans or []), *new_spans])
                spans.append([{"start": a, "end": b} for a, b in both])
                ids.append(sorted({*(old_items or []), *new_items}))
            for name, values in (("n_words", [n for n, _, _ in found]), ("_spans", spans), ("_items", ids)):
                at = batch.schema.get_field_index(name)
                batch = batch.set_column(at, batch.schema.field(at), pa.array(values, batch.schema.field(at).type))
            yield batch

    return scan


def contamination(documents: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Add ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated``."""
    found = find_passages(documents, items, **options)
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.withColumns({
        "n_hit": hit,
        "n_items": F.size("items").cast("long"),
        "items_sha256": F.sha2(F.array_join("items", ","), 256),
        "contaminated": hit > 0,
    })

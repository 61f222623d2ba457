"""Ranked lexical search: every item against all documents, by masks of the terms that documents hold.

1. Items are taken in blocks of a bounded number of terms. One pass over the documents keeps, for each, its
   length and the counts of the block's terms, in the shared folder.
2. Those rows give N, L and the document frequencies, summed in the tasks before they are shuffled; a
   block's frequencies go to the driver, as many as the block has terms.
3. A task turns chunks of documents into postings. For an item, the postings set one bit a term in each document's
   mask, and documents with equal masks form a group. A mask's greatest possible score is the sum over its
   terms of weight and largest term value in the chunk. Masks are scored in descending order of it, until
   the next one cannot reach the item's tenth score so far.
4. Each task leaves its ten best documents of each item; these are ranked in two steps, so that an item's rows
   from many tasks do not meet at once.

Scores are 64-bit integers, as stated with ``term_weight`` and ``length_factor``.

Defined results. Null text and texts without terms: neither count nor match. Items without terms: no rows.
Repeated document rows: each is ranked, in any order among themselves; a null id comes after all others with
the same score. Equal item rows (id and text) count once; different texts under one id are items of their own.
Equal scores: ascending id. Empty documents or items: no rows. Only the named columns are carried, so
others cannot clash. Ids are integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window, functions as F

from millrace.session import settle

TOP = 10
#: Terms of all items in one block, repeats included.
BLOCK_TERMS = 500_000
#: Documents and their terms in one chunk.
CHUNK, CHUNK_TERMS = 8192, 2_000_000
#: Masks that are scored at once hold at least so many documents.
BATCH = 64
#: The ranking's first step parts an item's rows by this number.
SPREAD = 64
#: A to Z become small, all ASCII characters but letters and digits part terms.
FOLD = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def term_weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def length_factor(n: np.ndarray, documents: int, tokens: int) -> np.ndarray:
    return 100 - 75 + (75 * n * documents) // max(tokens, 1)


def term_value(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def blocks(items: DataFrame, key: str, text: str, size: int) -> Iterator[list[tuple[int | None, Counter]]]:
    """Items with terms, as counters, in blocks of about ``size`` terms."""
    held, n = [], 0
    for row in items.select(F.col(key).alias("item"), F.col(text).alias("text")).distinct().toLocalIterator():
        if words := terms(row.text):
            held.append((row.item, Counter(words)))
            n += len(words)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def counted(documents: DataFrame, numbers: dict[bytes, int], key: str, text: str) -> DataFrame:
    """(id, n, terms, tfs) of the documents with terms; only the terms in ``numbers`` are listed, as int32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lengths, own, tfs = [], [], [], []
            for row, value in enumerate(batch.column("text")):
                if words := terms(value.as_py()):
                    counts = Counter(words)
                    known = [(numbers[w], c) for w, c in counts.items() if w in numbers]
                    pair = np.array(known, np.int32).reshape(-1, 2)
                    rows.append(row)
                    lengths.append(len(words))
                    own.append(pair[:, 0].tobytes())
                    tfs.append(pair[:, 1].tobytes())
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(pa.array(rows, pa.int64())), pa.array(lengths, pa.int64()), pa.array(own, pa.binary()), pa.array(tfs, pa.binary()),
            ], ["id", "n", "terms", "tfs"])

    rows = documents.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id bigint, n bigint, terms binary, tfs binary")


def frequencies(index: DataFrame, n_terms: int) -> np.ndarray:
    """Documents with each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), np.int32), minlength=n_terms)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["term", "df"])

    out = np.zeros(n_terms, np.int64)
    for row in index.select("terms").mapInArrow(run, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[row.term] = row.df
    return out


class Best:
    """The best (score, id) of one item so far."""

    def __init__(self, top: int) -> None:
        self.top = top
        self.scores, self.ids, self.nulls = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def least(self) -> int:
        """A document must reach this score, or any above 0, to matter."""
        return int(self.scores[-1]) if len(self.scores) == self.top else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        scores, ids, nulls = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.nulls, nulls)))
        order = np.lexsort((ids, nulls, -scores))[:self.top]
        order = order[scores[order] > 0]
        self.scores, self.ids, self.nulls = scores[order], ids[order], nulls[order]


class Chunk:
    """Postings of some documents: for each term, places and values in ascending place."""

    def __init__(self, rows: list[dict], n_terms: int, documents: int, tokens: int) -> None:
        own = [np.frombuffer(r["terms"], np.int32) for r in rows]
        term = np.concatenate(own)
        place = np.repeat(np.arange(len(rows)), [len(x) for x in own])
        tf = np.frombuffer(b"".join(r["tfs"] for r in rows), np.int32).astype(np.int64)
        m = length_factor(np.array([r["n"] for r in rows], np.int64), documents, tokens)
        order = np.argsort(term, kind="stable")
        self.place = place[order]
        self.value = term_value(tf, m[place])[order]
        self.first = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.ids = np.array([r["id"] or 0 for r in rows], np.int64)
        self.nulls = np.array([r["id"] is None for r in rows])

    def search(self, item: list[tuple[int, int]], best: Best) -> None:
        """Put the documents that belong among the item's best there; ``item`` has (term, weight)."""
        postings = [(w, self.place[a:b], self.value[a:b]) for t, w in item if w and (a := self.first[t]) < (b := self.first[t + 1])]
        if not postings:
            return
        weight = np.array([w for w, _, _ in postings])
        bound = np.array([w * v.max() for w, _, v in postings])
        masks = np.zeros(((len(postings) + 63) // 64, len(self.ids)), np.uint64)
        for j, (_, place, _) in enumerate(postings):
            masks[j // 64, place] |= np.uint64(1 << j % 64)
        touched = np.flatnonzero(masks.any(axis=0))
        order = touched[np.lexsort(masks[:, touched])]  # documents by mask
        sorted_masks = masks[:, order]
        starts = np.flatnonzero(np.concatenate([[True], (sorted_masks[:, 1:] != sorted_masks[:, :-1]).any(axis=0)]))
        different = sorted_masks[:, starts]
        most = np.zeros(len(starts), np.int64)
        for j in range(len(postings)):
            most += np.where(different[j // 64] >> np.uint64(j % 64) & np.uint64(1), bound[j], 0)
        ends = np.append(starts[1:], len(order))
        by_most = np.argsort(-most, kind="stable")
        at, size = 0, BATCH
        while at < len(by_most) and most[by_most[at]] >= best.least():
            stop = at + max(1, int(np.searchsorted(np.cumsum((ends - starts)[by_most[at:]]), size)))
            chosen = by_most[at:stop]
            chosen = chosen[most[chosen] >= best.least()]
            documents = np.sort(np.concatenate([order[starts[g]:ends[g]] for g in chosen]))
            best.add(self.scores(documents, postings, weight), self.ids[documents], self.nulls[documents])
            at, size = stop, size * 2

    @staticmethod
    def scores(documents: np.ndarray, postings: list, weight: np.ndarray) -> np.ndarray:
        out = np.zeros(len(documents), np.int64)
        for w, (_, place, value) in zip(weight, postings, strict=True):
            at = np.minimum(np.searchsorted(place, documents), len(place) - 1)
            out += np.where(place[at] == documents, w * value[at], 0)
        return out


def best_of_tasks(index: DataFrame, items: list[list[tuple[int, int]]], names: list[int | None], n_terms: int, documents: int, tokens: int, top: int) -> DataFrame:
    """(item, name, id, score): the best documents of each task for each item; ``item`` is its place in ``items``."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
        rows, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                rows.append(row)
                size += len(row["terms"]) // 4
                if len(rows) >= CHUNK or size >= CHUNK_TERMS:
                    yield Chunk(rows, n_terms, documents, tokens)
                    rows, size = [], 0
        if rows:
            yield Chunk(rows, n_terms, documents, tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in items]
        for chunk in chunks(batches):
            for item, found in zip(items, best, strict=True):
                chunk.search(item, found)
        for at in range(0, len(best), 1000):
            part = [(i, f) for i, f in enumerate(best[at:at + 1000], at) if len(f.scores)]
            yield pa.RecordBatch.from_arrays([
                pa.array([i for i, f in part for _ in f.scores], pa.int32()), pa.array([names[i] for i, f in part for _ in f.scores], pa.int64()),
                pa.array([None if z else int(x) for _, f in part for x, z in zip(f.ids, f.nulls, strict=True)], pa.int64()),
                pa.array([int(s) for _, f in part for s in f.scores], pa.int64()),
            ], ["item", "name", "id", "score"])

    return index.mapInArrow(run, "item int, name bigint, id bigint, score bigint")


def ranked(found: DataFrame, top: int) -> DataFrame:
    best_first = (F.col("score").desc(), F.col("id").asc_nulls_last())
    parted = Window.partitionBy("item", F.pmod(F.xxhash64("id"), F.lit(SPREAD))).orderBy(*best_first)
    whole = Window.partitionBy("item").orderBy(*best_first)
    first = found.withColumn("rank", F.row_number().over(parted)).filter(F.col("rank") <= top)
    return first.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= top)


def search(
    documents: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row per item and rank: ``item_id``, ``rank`` (from 1), ``doc_id`` and ``score`` of its best documents."""
    spark = documents.sparkSession
    out = spark.createDataFrame([], f"{item_key} bigint, rank int, {key} bigint, score bigint")
    for block in blocks(items, item_key, item_text, block_terms):
        numbers = {w: i for i, w in enumerate(sorted({w for _, counts in block for w in counts}))}
        index = settle(counted(documents, numbers, key, text), "index")
        size: Row = index.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("tokens")).first()
        if not size.documents:
            return out
        weights = [term_weight(size.documents, int(df)) for df in frequencies(index, len(numbers))]
        wanted = [[(numbers[w], weights[numbers[w]] * c) for w, c in counts.items()] for _, counts in block]
        found = best_of_tasks(index, wanted, [item for item, _ in block], len(numbers), size.documents, size.tokens, top)
        rows = ranked(settle(found, "found"), top)
        out = out.unionByName(rows.select(F.col("name").alias(item_key), "rank", F.col("id").alias(key), "score"))
    return out

"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A window is a string of ``length`` bytes. Its anchor is the leftmost smallest hash of its
32-byte parts, so equal windows have equal anchors at equal places; the windows with one anchor at
one place are a suffix bucket, and equal windows always fall into the same bucket.

1. Every text gives its runs: consecutive windows with one anchor. Runs whose anchor occurs
   once in all texts end here.
2. A run that occurs twice as a whole (copies, middles of passages) is repeated as a whole. Only
   anchors with different runs have anything left to sort.
3. One representative of each such run is read with its bytes. A task sorts the buckets of
   its anchors: ties of the first block are resolved by precomputed ranks of the sample
   suffixes, whose places form a difference cover, so no comparison reads a whole window.
4. An anchor with more than ``HOT`` different runs (a passage in very many documents) is no
   task's burden: its runs are cut into cells of neighbouring windows, and cells and then
   windows are counted by hash with partial aggregation.

Only runs, and the texts that take part, are shuffled; no suffix leaves its task.

Defined results. Null text: as an empty one. Texts shorter than a window: nothing removed.
Repeated rows: each is a copy of the other. Empty table: empty result. Only the named columns
are carried, so others cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from millrace.llm.arrays import Parts, mix
from millrace.session import settle

LENGTH = 400
ANCHOR = 32
HOT = 256
CELL = 12
#: Bytes of texts, or of runs, that are handled at once.
GROUP_BYTES = 1_000_000
RUN = "cid binary, f bigint, s bigint, n bigint, m bigint, h bigint"


def difference_cover(modulus: int) -> np.ndarray:
    """Places such that every distance modulo ``modulus`` lies between two of them (greedy)."""
    cover, missing = [0], set(range(1, modulus))
    while missing:
        new = lambda d: {x % modulus for c in cover for x in (d - c, c - d)} & missing
        best = max(range(modulus), key=lambda d: (len(new(d)), -d))
        missing -= new(best)
        cover.append(best)
    return np.array(sorted(cover))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` neighbours, by prefix and suffix minima of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def runs_of(row: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs in texts laid end to end: text number, first window, count, anchor's place, anchor.

    Places are those in ``row``.
    """
    n = len(row)
    empty = np.empty(0, np.int64)
    if n < length:
        return empty, empty, empty, empty, empty
    anchor = min(ANCHOR, length)
    at = np.arange(n - anchor + 1)
    hashes = Parts(row).hashed(at, at + anchor)
    # 36 bits of the hash, then the place: of equal hashes the leftmost wins.
    low = sliding_min((hashes & ~np.uint64(2**28 - 1)) | at.astype(np.uint64), length - anchor + 1)
    place = (low & np.uint64(2**28 - 1)).astype(np.int64)
    start = np.arange(len(place))
    text = np.searchsorted(bounds, start, "right") - 1
    inside = start + length <= bounds[text + 1]
    start, place, text = start[inside], place[inside], text[inside]
    if not len(start):
        return empty, empty, empty, empty, empty
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])]))
    count = np.diff(np.append(first, len(start)))
    return text[first], start[first], count, place[first], hashes[place[first]].view(np.int64)


def pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (text number, offset, bytes); a very long text goes in pieces that overlap."""
    group: list[tuple[int, int, bytes]] = []
    size = 0
    for number, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), GROUP_BYTES):
            piece = text[at:at + GROUP_BYTES + length - 1]
            if group and size + len(piece) > GROUP_BYTES:
                yield group
                group, size = [], 0
            group.append((number, at, piece))
            size += len(piece)
    if group:
        yield group


def run_rows(batches: Iterator[pa.RecordBatch], length: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """The runs of all texts: anchors alone, or with places and the hash of the run's bytes."""
    for batch in batches:
        ids = batch.column("cid")
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
        for group in pieces(texts, length):
            joined = b"".join(g[2] for g in group)
            bounds = np.concatenate([[0], np.cumsum([len(g[2]) for g in group])])
            text, start, count, place, anchor = runs_of(np.frombuffer(joined, np.uint8), bounds, length)
            if not whole:
                yield pa.RecordBatch.from_arrays([pa.array(anchor)], ["f"])
                continue
            view = memoryview(joined)
            digests = [xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(start.tolist(), (start + count + length - 1).tolist(), strict=True)]
            number, offset = np.array([g[0] for g in group])[text], np.array([g[1] for g in group])[text]
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(number)), pa.array(anchor), pa.array(start - bounds[text] + offset), pa.array(count), pa.array(place - start),
                pa.array(np.array(digests, np.uint64).view(np.int64)),
            ], ["cid", "f", "s", "n", "m", "h"])


def sample_ranks(row: np.ndarray, last: int, cover: np.ndarray, modulus: int, width: int) -> np.ndarray:
    """Ranks of the sample suffixes up to ``last`` by their first ``width`` bytes, by doubling.

    ``width`` is a multiple of ``modulus``, so that every step stays within the sample. Ranks of
    other places are nought; ``row`` is padded.
    """
    sample = np.flatnonzero(np.isin(np.arange(modulus), cover)[np.arange(last) % modulus])
    blocks = np.lib.stride_tricks.sliding_window_view(row, modulus)[sample]
    ranks = np.zeros(len(row), np.int64)
    ranks[sample] = np.unique(np.ascontiguousarray(blocks).view(f"S{modulus}").ravel(), return_inverse=True)[1] + 1
    done = modulus
    while done < width:
        step = min(done, width - done)
        pair = ranks[sample].astype(np.uint64) * np.uint64(len(sample) + 2) + ranks[sample + step].astype(np.uint64)
        ranks[sample] = np.unique(pair, return_inverse=True)[1] + 1
        done += step
    return ranks


Run = tuple[int, bytes, int, int]  # anchor, bytes, number of windows, place of the anchor


def equal_windows(runs: list[Run], length: int) -> Iterator[tuple[int, int, int]]:
    """(run number, from, to) of the windows that a window of another run equals.

    Runs are laid so that their anchors have like places modulo the cover's: all suffixes of a
    bucket then share one shift into the sample.
    """
    modulus = min(64, 1 << max(0, (length // 4).bit_length() - 1))
    cover = difference_cover(modulus)
    shift_of = np.array([min(d for d in range(modulus) if (r + d) % modulus in cover) for r in range(modulus)])
    width = (length - modulus) // modulus * modulus  # what ranks compare, after at most one block and before the tail
    laid, offsets, at = [], [], 0
    for _, content, _, place in runs:
        pad = -(at + place) % modulus
        laid += [bytes(pad), content]
        offsets.append(at + pad)
        at += pad + len(content)
    row = np.frombuffer(b"".join([*laid, bytes(2 * length + 2 * modulus)]), np.uint8)
    counts = np.array([r[2] for r in runs])
    run = np.repeat(np.arange(len(runs)), counts)
    shift = np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = np.array(offsets)[run] + shift
    ranks = sample_ranks(row, at + modulus, cover, modulus, max(modulus, width))
    middle = ranks[start + shift_of[start % modulus]]
    parts = Parts(row)
    bucket = np.array([r[0] for r in runs], np.int64).view(np.uint64)[run] ^ mix((np.array([r[3] for r in runs])[run] - shift).astype(np.uint64))
    edge = parts.hashed(start, start + modulus) * np.uint64(3) + parts.hashed(start + max(0, min(width, length - modulus)), start + length)
    key = mix(mix(bucket) ^ edge)
    order = np.lexsort((middle, key))
    same = (key[order][1:] == key[order][:-1]) & (middle[order][1:] == middle[order][:-1])
    twin = np.zeros(len(order), bool)
    twin[order[1:]] |= same
    twin[order[:-1]] |= same
    first = np.flatnonzero(twin & np.concatenate([[True], ~twin[:-1] | (run[1:] != run[:-1])]))
    last = np.flatnonzero(twin & np.concatenate([~twin[1:] | (run[1:] != run[:-1]), [True]]))
    yield from zip(run[first].tolist(), shift[first].tolist(), (shift[last] + 1).tolist(), strict=True)


RANGE = "f bigint, n bigint, m bigint, h bigint, a bigint, b bigint"
NAMES = ["f", "n", "m", "h", "a", "b"]


def sort_buckets(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Ranges of repeated windows in runs sorted by anchor; some whole anchors at a time."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("f", "n", "m", "h", "c", "content")), strict=True):
            if size >= GROUP_BYTES and row[0] != held[-1][0]:
                yield ranges_of(held, length)
                held, size = [], 0
            held.append(row)
            size += len(row[5])
    if held:
        yield ranges_of(held, length)


def ranges_of(rows: list[tuple], length: int) -> pa.RecordBatch:
    found = [(*rows[i][:4], a, b) for i, a, b in equal_windows([(r[0], r[5], r[1], r[2]) for r in rows], length) if rows[i][4] == 1]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else [[]] * 6)], NAMES)


def cell_rows(batches: Iterator[pa.RecordBatch], length: int, cell: int) -> Iterator[pa.RecordBatch]:
    """Runs of hot anchors in cells of windows: the hash of the bytes that all windows of a cell
    share (``core``), of all its bytes here (``own``), and of every window."""
    names = ["f", "n", "m", "h", "c", "t", "a", "b", "core", "own", "windows"]
    for batch in batches:
        out = []
        for f, n, m, h, c, content in zip(*(batch.column(k).to_pylist() for k in names[:5] + ["content"]), strict=True):
            parts = Parts(np.frombuffer(content, np.uint8))
            at = np.arange(n)
            windows = parts.hashed(at, at + length).view(np.int64)
            a = 0
            while a < n:
                t = (m - a) // cell  # windows with their anchor's place in one cell
                b = min(n, m - t * cell + 1)
                low, high = m - (t + 1) * cell + 1, m - t * cell  # first and last window that a whole cell would have
                core = int(parts.hashed(np.array([high]), np.array([low + length])).view(np.int64)[0])
                out.append((f, n, m, h, c, t, a, b, core, xxhash.xxh3_64_intdigest(content[a:b - 1 + length]) - 2**63, windows[a:b].tolist()))
                a = b
        kinds = [pa.int64()] * 10 + [pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [[]] * 11, kinds, strict=True)], names)


def hot_ranges(runs: DataFrame, length: int, cell: int) -> DataFrame:
    """Ranges of repeated windows of hot anchors, by counting cells and then windows."""
    cells = settle(runs.mapInArrow(
        lambda batches: cell_rows(batches, length, cell),
        "f bigint, n bigint, m bigint, h bigint, c bigint, t bigint, a bigint, b bigint, core bigint, own bigint, windows array<bigint>",
    ), "cells")
    kinds = cells.groupBy("f", "t", "core").agg(F.count(F.lit(1)).alias("k"), F.min("own").alias("low"), F.max("own").alias("high")).filter("k > 1")
    shared = cells.join(kinds, ["f", "t", "core"])
    whole = shared.filter("low = high and c = 1").select(*NAMES)
    split = settle(shared.filter("low <> high").select("f", "n", "m", "h", "c", "a", F.posexplode("windows").alias("i", "w")).select(
        "f", "n", "m", "h", "c", (F.col("a") + F.col("i")).alias("a"), (F.col("m") - F.col("a") - F.col("i")).alias("t"), "w"
    ), "windows")
    twice = split.groupBy("f", "t", "w").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    single = split.filter("c = 1").join(twice, ["f", "t", "w"]).select("f", "n", "m", "h", "a", (F.col("a") + 1).alias("b"))
    return whole.unionByName(single)


def cut_spans(text: str | None, spans: list[dict]) -> tuple[int, int, int, str]:
    """Bytes, removed bytes, removed runs, and the hash of what stays."""
    content = (text or "").encode("utf-8", "surrogatepass")
    kept, at, removed, count, end = hashlib.sha256(), 0, 0, 0, -1
    for span in sorted(spans, key=lambda x: (x["s"], x["e"])):
        if span["s"] > end:  # spans that touch are one
            kept.update(content[at:span["s"]])
            at, count = span["s"], count + 1
        end = max(end, span["e"])
        removed += end - at
        at = end
    kept.update(content[at:])
    return len(content), removed, count, kept.hexdigest()


def repeated_spans(documents: DataFrame, length: int = LENGTH, hot: int = HOT, cell: int = CELL, text: str = "text") -> DataFrame:
    """(``cid``, ``spans``): byte ranges (s, e) of repeated windows of every different text that has any."""
    texts = documents.select(F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("cid"), F.col(text).alias("text"))
    anchors = texts.mapInArrow(lambda batches: run_rows(batches, length, False), "f bigint")
    anchors = anchors.groupBy("f").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("f")
    anchors = settle(anchors, "anchors")  # with an exchange of its own on either side the join can split a hot anchor
    runs = settle(texts.mapInArrow(lambda batches: run_rows(batches, length, True), RUN).join(anchors, "f"), "runs")
    kinds = settle(runs.groupBy("f", "n", "m", "h").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("cid", "s")).alias("first")), "kinds")
    several = kinds.groupBy("f").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    wanted = kinds.join(several, "f").groupBy("first.cid").agg(F.collect_list(F.struct("f", "n", "m", "h", "c", "k", "first.s")).alias("runs"))
    distinct = texts.groupBy("cid").agg(F.first("text").alias("text"))
    content = F.expr(f"substring(cast(coalesce(text, '') as binary), cast(r.s + 1 as int), cast(r.n + {length - 1} as int))").alias("content")
    read = distinct.join(wanted, "cid").select("text", F.explode("runs").alias("r")).select("r.*", content)
    read = settle(read.drop("s"), "contents")
    cold = read.filter(F.col("k") <= hot).select("f", "n", "m", "h", "c", "content").repartition("f").sortWithinPartitions("f")
    found = kinds.filter("c > 1").select("f", "n", "m", "h", F.lit(0).cast("long").alias("a"), F.col("n").alias("b"))
    found = found.unionByName(cold.mapInArrow(lambda batches: sort_buckets(batches, length), RANGE))
    found = found.unionByName(hot_ranges(read.filter(F.col("k") > hot).drop("k"), length, cell))
    spans = runs.join(found, ["f", "n", "m", "h"]).select(
        "cid", (F.col("s") + F.col("a")).alias("s"), (F.col("s") + F.col("b") - 1 + length).alias("e")
    )
    return spans.groupBy("cid").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def remove_repeats(documents: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """Per document: key, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``."""
    spans = settle(repeated_spans(documents, length, text=text, **options), "spans")
    rows = documents.select(F.col(key), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("cid"), F.col(text).alias("text"))
    distinct = rows.groupBy("cid").agg(F.first("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [cut_spans(*x) for x in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True) if found else [[]] * 4, [pa.int64()] * 3 + [pa.string()], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("cid"), *columns], ["cid", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    results = distinct.join(spans, "cid").mapInArrow(cut, "cid binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    whole = F.coalesce(F.col(text), F.lit(""))
    plain = documents.select(
        F.col(key), F.unhex(F.md5(whole)).alias("cid"), F.octet_length(whole).cast("long").alias("_bytes"), F.sha2(whole, 256).alias("_sha")
    )
    return plain.join(results, "cid", "left").select(
        key, F.col("_bytes").alias("n_bytes"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "_sha").alias("kept_sha256"),
    )

"""Documents packed into training windows by Karmarkar-Karp multiway differencing.

A document's ids are cut into full windows and a rest; the rest of one document in sixteen is cut
into grains, which level the windows. The rests and grains are dealt into batches of about
``batch_pieces`` (a hash of their row number, so no key can make a batch hot), and each
batch is split into near-equal windows:
partial partitions are merged, the two with the widest imbalance first, the fullest windows of
one on the emptiest of the other. A batch begins with as many windows as its ids need;
whenever one exceeds the capacity, the count rises.

The texts are read once and never shuffled; what moves is a few numbers per piece.

Defined results. Null text: an empty one, whose only id is the end mark. Repeated rows: packed
each for itself. Empty table: empty result. A text of any length: cut. Only the key
and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import heapq
import itertools
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.arrays import Parts
from millrace.session import settle

CAPACITY = 1024
BATCH_PIECES = 1000
#: The rest of one text in so many is cut this small: grains let the windows come out equal.
EVERY, GRAIN = 16, 32
MAX_TASKS = 10_000
#: Parts of texts whose ids a task keeps (about 32 MB), and characters it handles at once.
CACHE = 1_000_000
GROUP_CHARS = 1_000_000
LETTER, NUMBER, MARK, BLANK = range(4)
#: The characters that are white space.
WHITE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Tokens:
    """Ids of whole texts under a byte-level tokenizer.

    Texts are cut into parts (letters, numbers, marks or white space, with at most one blank
    before) in numpy; the tokenizer's model then sees each part once, as merges never cross
    parts. A text that holds an added token goes through the tokenizer as it is.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        # Byte-level names: printable Latin-1 bytes stand for themselves, the others follow from 256 on.
        plain = [b for b in range(256) if chr(b).isprintable() and b != 32]
        others = [b for b in range(256) if b not in plain]
        self.names = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
        categories = [*map(unicodedata.category, map(chr, range(0x110000)))]
        kinds = {c: LETTER if c[0] == "L" else NUMBER if c[0] == "N" else MARK for c in set(categories)}
        self.kind = np.array([*map(kinds.get, categories)], np.uint8)
        self.kind[list(WHITE)] = BLANK
        # characters that this Python does not know may be letters to the tokenizer
        self.unknown = np.array([c == "Cn" for c in categories])
        self.forget()

    def forget(self) -> None:
        self.keys, self.first, self.count = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat = np.empty(0, np.uint32)
        self.chars, self.char_at, self.size = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        group: list[str] = []
        for text in texts:
            special = bool(self.added and self.added.search(text))
            if special or sum(map(len, group)) + len(text) > GROUP_CHARS:
                yield from self.of_group(group)
                group = []
            if special:
                yield self.encoded(text)
            else:
                group.append(text)
        yield from self.of_group(group)

    def encoded(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def starts(self, chars: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where parts begin, in texts laid end to end that begin at ``bounds``."""
        n = len(chars)
        kind = self.kind[chars]
        fresh = np.zeros(n + 1, bool)
        fresh[bounds] = True
        change = fresh[:n].copy()
        change[1:] |= kind[1:] != kind[:-1]
        run = np.flatnonzero(change)
        end = np.append(run[1:], n)
        blank = kind[run] == BLANK
        follows = ~fresh[end]  # the run is not the last of its text
        joins = blank & follows & (chars[end - 1] == 32)  # its last character belongs to the next run
        size = end - run
        out = np.zeros(n + 1, bool)
        out[run[blank & ~(joins & (size == 1))]] = True
        out[end[blank & follows & (size > 1)] - 1] = True  # white space leaves its last character out
        before = np.concatenate([[False], joins[:-1]])
        out[run[~blank] - before[~blank]] = True
        quote = np.flatnonzero((chars[run] == 39) & (size == 1) & ~before & follows)
        for k in quote.tolist():  # 's 't 'm 'd 're 've 'll are parts of their own
            a, b = int(end[k]), int(end[k + 1])
            if kind[a] == LETTER:
                word = "".join(map(chr, chars[a:min(b, a + 2)].tolist()))
                n_letters = 1 if word[0] in "stmd" else 2 if word in ("re", "ve", "ll") else 0
                if n_letters:
                    out[a] = False
                    out[a + n_letters] = out[a + n_letters] or a + n_letters < b
        return np.flatnonzero(out[:n])

    def of_group(self, texts: list[str]) -> Iterator[np.ndarray]:
        if not texts:
            return
        whole = "".join(texts)
        chars = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        if not len(chars):
            yield from (np.empty(0, np.uint32) for _ in texts)
            return
        starts = self.starts(chars, bounds)
        ends = np.append(starts[1:], len(chars))
        hashes = Parts(chars).hashed(starts, ends) ^ (ends - starts).astype(np.uint64)
        unique, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        place = self.places(unique, whole, chars, starts[at], ends[at])[back]
        # a hash only proposes: every part is compared with the one whose ids it takes
        length = ends - starts
        known = self.chars[np.minimum(np.repeat(self.char_at[place] - starts, length) + np.arange(len(chars)), len(self.chars) - 1)]
        differs = np.logical_or.reduceat((known != chars) | self.unknown[chars], starts) | (self.size[place] != length)
        whole_texts = set((np.searchsorted(bounds, starts[differs], "right") - 1).tolist())
        count = self.count[place]
        last = np.cumsum(count)
        pick = np.repeat(self.first[place] - (last - count), count) + np.arange(last[-1])
        ids = self.flat[pick]
        cut = np.concatenate([[0], last])[np.searchsorted(starts, bounds)]
        for row, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            yield self.encoded(texts[row]) if row in whole_texts else ids[a:b]

    def places(self, unique: np.ndarray, whole: str, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where the ids of these parts are kept, sorted by hash; unknown ones are looked up."""
        if len(self.keys) + len(unique) > CACHE:
            self.forget()
        at = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == unique[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            names, tokenize = self.names, self.model.tokenize
            got = [
                [t.id for t in tokenize("".join([names[b] for b in whole[a:b].encode("utf-8")]))]
                for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)
            ]
            count = np.array([len(g) for g in got], np.int64)
            first = len(self.flat) + np.cumsum(count) - count
            self.flat = np.concatenate([self.flat, np.array([i for g in got for i in g], np.uint32)])
            size = ends[new] - starts[new]
            char_at = len(self.chars) + np.cumsum(size) - size
            self.chars = np.concatenate([self.chars, *(chars[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True))])
            self.char_at, self.size = np.insert(self.char_at, at[new], char_at), np.insert(self.size, at[new], size)
            self.keys = np.insert(self.keys, at[new], unique[new])
            self.first, self.count = np.insert(self.first, at[new], first), np.insert(self.count, at[new], count)
            at = np.searchsorted(self.keys, unique)
        return at


@cache
def tokens_of(path: str) -> Tokens:
    """One for each Python worker, which runs many tasks."""
    return Tokens(path)


def cuts(n: int, capacity: int, grain: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full windows, then the rest; cut into near-equal
    parts of at most ``grain`` ids if ``grain`` is not nought."""
    full = n - n % capacity
    out = [(at, capacity) for at in range(0, full, capacity)]
    parts = min(n - full, 1 if not grain else -(-(n - full) // grain))
    edges = [full + (n - full) * k // parts for k in range(parts + 1)] if parts else []
    return out + [(a, b - a) for a, b in itertools.pairwise(edges)]


def cutter(path: str, capacity: int, grain: int, every: int, key: str, text: str):
    names = [key, "start", "length", "ids_crc32", "doc_tokens"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(path)
        for batch in batches:
            rows, numbers = [], []
            names_of = batch.column(key).to_pylist()
            texts = [t or "" for t in batch.column(text).to_pylist()]
            for row, found in enumerate(tokens.ids(texts)):
                ids = np.append(found, np.uint32(0)).astype("<u4")
                # by the document alone, however the rows are dealt
                fine = zlib.crc32(f"{names_of[row]}".encode(), zlib.crc32(ids.tobytes())) % every == 0
                for start, length in cuts(len(ids), capacity, grain if fine else 0):
                    rows.append(row)
                    numbers.append((start, length, zlib.crc32(ids[start:start + length].tobytes()), len(ids)))
            columns = np.array(numbers, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows, pa.int64())), *map(pa.array, columns)], names)

    return cut


def difference(sizes: list[int], windows: int) -> tuple[np.ndarray, list[list[int]]]:
    """Sums (ascending) and members of near-equal groups, at most ``windows`` of them.

    A partial partition holds the sums of its non-empty groups, ascending, and a number for each;
    the two with the widest spread merge, the fullest group of one with the emptiest of the
    other. Numbers from ``len(sizes)`` on stand for two groups that met.
    """
    n = len(sizes)
    left: list[int] = []
    right: list[int] = []
    heap = [(-size, i, np.array([size]), np.array([i])) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, tie, a, of_a = heapq.heappop(heap)
        _, _, b, of_b = heapq.heappop(heap)
        meet = max(0, len(a) + len(b) - windows)  # the other groups meet an empty one
        new = np.arange(n + len(left), n + len(left) + meet)
        left += of_a[:meet][::-1].tolist()
        right += of_b[:meet].tolist()
        sums = np.concatenate([a[:meet][::-1] + b[:meet], a[meet:], b[meet:]])
        numbers = np.concatenate([new, of_a[meet:], of_b[meet:]])
        order = sums.argsort(kind="stable")
        sums, numbers = sums[order], numbers[order]
        low = int(sums[0]) if len(sums) == windows else 0
        heapq.heappush(heap, (low - int(sums[-1]), tie, sums, numbers))
    _, _, sums, numbers = heap[0]
    members: dict[int, list[int]] = {number: [number] for number in range(n)}
    for k, (x, y) in enumerate(zip(left, right, strict=True)):
        members[n + k] = members.pop(x) + members.pop(y)
    return sums, [members[number] for number in numbers.tolist()]


def near_equal(sizes: list[int], capacity: int) -> list[list[int]]:
    """Groups of at most ``capacity``; their count rises whenever one exceeds it."""
    if not sizes:
        return []
    total = sum(sizes)
    windows = max(1, -(-total // capacity))
    while True:
        sums, groups = difference(sizes, windows)
        if sums[-1] <= capacity:
            return groups
        spread = int(sums[-1] - sums[0])  # the rise leaves half of it as room
        windows = max(windows + 1, -(-total // max(1, capacity - spread // 2)))


def packer(capacity: int):
    def pack(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("_row", ignore_index=True)
        sizes = batch.length.tolist()
        rows = batch._row.to_numpy()
        sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
        for members in near_equal(sizes, capacity):
            at = 0
            members = sorted(members)
            for i in members:
                sequence[i], offset[i] = rows[members[0]], at
                at += sizes[i]
        return batch.assign(sequence_id=sequence, offset=offset).drop(columns=["_batch"])

    return pack


def pack_documents(
    documents: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, grain: int = GRAIN, every: int = EVERY,
    batch_pieces: int = BATCH_PIECES, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per piece: key, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id`` (the row number of its first piece) and ``offset``."""
    kind = documents.schema[key].dataType.simpleString()
    cut = cutter(tokenizer or tokenizer_path(), capacity, grain, every, key, text)
    pieces = documents.select(key, text).mapInArrow(
        cut, f"`{key}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    )
    pieces = settle(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    full = pieces.filter(F.col("length") == capacity).withColumns({"sequence_id": F.col("_row"), "offset": F.lit(0).cast("long")})
    rest = pieces.filter(F.col("length") < capacity)
    batches = max(1, round(rest.count() / batch_pieces))
    schema = rest.schema.simpleString()[7:-1].replace(":", " ") + ", sequence_id bigint, offset bigint"
    dealt = rest.withColumn("_batch", F.pmod(F.xxhash64("_row"), F.lit(batches)))
    # The rows are few and the work on them is not: as many tasks as there are batches for.
    dealt = dealt.repartition(min(batches, MAX_TASKS), "_batch")
    packed = dealt.groupBy("_batch").applyInPandas(packer(capacity), schema)
    return full.unionByName(packed).drop("_row")

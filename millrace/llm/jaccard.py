"""Near-duplicate documents: Jaccard similarity of five-word shingles, pruned by Bayes.

1. Equal texts are one content; only contents are compared.
2. MinHash bands propose: contents that share a band meet in a bucket. Buckets with the same
   members as another one are dropped, large ones are cut into pairs of blocks.
3. Within a bucket signatures are compared 32 hashes at a time; a pair is dropped as soon as
   the posterior probability that its similarity reaches the threshold falls below the tolerance. Only
   a spanning forest of the surviving pairs is emitted, never all pairs.
4. Each component of that forest is read once more with its texts, in pairs of blocks of
   bounded size, and every surviving pair is verified by the exact overlap of its shingle sets. What
   leaves a task is a count of links and one root per content.

A pair at the threshold is missed by all bands with a probability of about 5e-8, and pruned
wrongly with one of at most the tolerance. Links within a component are counted exactly, which takes
time quadratic in a group of different near copies, spread over its pairs of blocks.

Defined results. Null text: as an empty one. Texts of fewer than five words have one shingle of
all their words; texts without words link to nothing but equal texts. Repeated rows: one
result each. Empty table: empty result. Only the named columns are carried, so others
cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.arrays import Parts, mix
from millrace.llm.graphs import components
from millrace.session import settle

SHINGLE = 5
THRESHOLD = 0.8
TOLERANCE = 1e-6
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
STEP = 32
#: Contents and characters in one block; a task holds two blocks at most.
BLOCK = 512
BLOCK_CHARS = 8_000_000


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; words are parted by ASCII white space, ASCII in lower case."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    row = np.frombuffer(b" ".join(words), np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - size + 1)
    return np.unique(Parts(row).hashed(starts[:n], ends[min(size, len(words)) - 1:]))


def seeds(count: int = HASHES) -> np.ndarray:
    return (mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def min_hashes(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 4096):
        np.minimum(out, np.multiply.outer(factors, low[at:at + 4096]).min(axis=1), out=out)
    return out


def band_keys(mins: np.ndarray) -> np.ndarray:
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in mins.reshape(BANDS, ROWS).T:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) ^ row.astype(np.uint64))
    return out.view(np.int64)


def signature(mins: np.ndarray) -> bytes:
    """Eight bits of every MinHash value."""
    return ((mins * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """Of so many compared values, how many must match for the pair to stay.

    Uniform prior; eight-bit values that differ match by chance once in 256.
    """
    grid = np.linspace(0, 1, 20001)[1:-1]
    needed = threshold + (1 - threshold) / 256
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            weight = m * np.log(grid) + (n - m) * np.log1p(-grid)
            weight = np.exp(weight - weight.max())
            if weight[grid >= needed].sum() >= tolerance * weight.sum():
                out[n] = m
                break
    return out


def survivors(own: np.ndarray, others: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Indexes of the signatures that stay candidates next to ``own``."""
    left = np.arange(len(others))
    matches = np.zeros(len(others), np.int64)
    for n, m in least.items():
        matches = matches + (others[left, n - STEP:n] == own[n - STEP:n]).sum(axis=1)
        stay = matches >= m
        left, matches = left[stay], matches[stay]
        if not len(left):
            break
    return left


def like_sizes(size: int, sizes: np.ndarray, threshold: float) -> np.ndarray:
    return (sizes >= size * threshold) & (sizes * threshold <= size)


def forest(signatures: np.ndarray, sizes: np.ndarray, least: dict[int, int], threshold: float) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the candidate pairs: who is found is not looked for again."""
    waiting = np.arange(len(signatures))
    while len(waiting) > 1:
        queue, waiting = [int(waiting[0])], waiting[1:]
        while queue and len(waiting):
            own = queue.pop()
            near = waiting[like_sizes(sizes[own], sizes[waiting], threshold)]
            found = near[survivors(signatures[own], signatures[near], least)]
            if len(found):
                yield from ((own, int(i)) for i in found)
                queue += found.tolist()
                waiting = np.setdiff1d(waiting, found, assume_unique=True)


def groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Rows with equal ``key`` from sorted batches, one group at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch.column(k).to_pylist() for k in key), strict=True))
        starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1])]
        for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HASHES)


class Sets:
    """Disjoint sets of row numbers; the root is the smallest."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = sorted((self.root(i), self.root(j)))
        self.up[b] = a


def verify(table: pa.Table, least: dict[int, int], threshold: float, size: int) -> tuple[list[int], list[int]]:
    """Links of every row within a pair of blocks, and the smallest row that links lead to."""
    n = table.num_rows
    side = np.array(table.column("side").to_pylist())
    across = table.column("lo")[0].as_py() != table.column("hi")[0].as_py()
    signatures = matrix(table.column("sig"))
    sets = [shingles(t, size) for t in table.column("text").to_pylist()]
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    values, number = np.unique(np.concatenate(sets), return_inverse=True) if n else (np.empty(0), np.empty(0, np.int64))
    order = np.argsort(number, kind="stable")
    posting, first = owner[order], np.searchsorted(number[order], np.arange(len(values) + 1))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    links, roots = np.zeros(n, np.int64), Sets(n)
    for i in range(n - 1):
        later = np.arange(i + 1, n)
        later = later[like_sizes(sizes[i], sizes[later], threshold)]
        if across:
            later = later[side[later] != side[i]]
        later = later[survivors(signatures[i], signatures[later], least)]
        if not len(later):
            continue
        own = number[bounds[i]:bounds[i + 1]]
        count = first[own + 1] - first[own]
        last = np.cumsum(count)
        overlap = np.bincount(posting[np.repeat(first[own] - (last - count), count) + np.arange(last[-1])], minlength=n)[later]
        # overlap / union >= threshold, in whole numbers
        found = later[overlap * 1_000_000 >= (sizes[i] + sizes[later] - overlap) * round(threshold * 1_000_000)]
        links[i] += len(found)
        links[found] += 1
        for j in found.tolist():
            roots.join(i, j)
    return links.tolist(), [roots.root(i) for i in range(n)]


def in_blocks(df: DataFrame, key: list[str], parts) -> DataFrame:
    """Rows dealt to every pair of blocks (``lo``, ``hi``) that their block ``side`` is part of, sorted by it."""
    pair = F.explode(F.transform(
        F.sequence(F.lit(0), F.col("_parts") - 1),
        lambda x: F.struct(F.least(x, F.col("side")).alias("lo"), F.greatest(x, F.col("side")).alias("hi")),
    ))
    df = df.withColumn("_parts", parts).withColumn("side", F.pmod(F.xxhash64("cid"), F.col("_parts")).cast("int"))
    df = df.withColumn("_pair", pair).select(*[c for c in df.columns if c not in ("_parts", "side")], "side", "_pair.*")
    # A pair of different blocks compares across only; each block meets itself once.
    return df.repartition(*key, "lo", "hi").sortWithinPartitions(*key, "lo", "hi", "cid")


def near_duplicates(
    documents: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, shingle: int = SHINGLE, block: int = BLOCK,
    block_chars: int = BLOCK_CHARS, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per document: key, ``class_id`` (smallest key of its class), ``n_links`` (other texts
    at or above the threshold), ``n_copies`` (documents with the same text), ``cid`` (the text's
    hash) and ``class_cid`` (of the class)."""
    content = F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("cid")
    least, factors = least_matches(threshold, tolerance), seeds()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, signatures, bands, rows = [], [], [], []
            for row, value in enumerate(batch.column("text").to_pylist()):
                if len(hashes := shingles(value, shingle)):
                    mins = min_hashes(hashes, factors)
                    rows.append(row)
                    sizes.append(len(hashes))
                    signatures.append(signature(mins))
                    bands.append(band_keys(mins))
            lists = pa.ListArray.from_arrays(np.arange(len(bands) + 1, dtype=np.int32) * BANDS, np.concatenate([np.empty(0, np.int64), *bands]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("cid").take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), pa.array(signatures, pa.binary()), lists],
                ["cid", "size", "sig", "bands"],
            )

    def bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for table in groups(batches, ["bucket", "lo", "hi"]):
            ids = table.column("cid").to_pylist()
            for i, j in forest(matrix(table.column("sig")), np.array(table.column("size").to_pylist()), least, threshold):
                a.append(ids[i])
                b.append(ids[j])
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    def block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["root", "lo", "hi"]):
            ids = table.column("cid").to_pylist()
            links, roots = verify(table, least, threshold, shingle)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.binary()), pa.array([ids[r] for r in roots], pa.binary()), pa.array(links, pa.int64())], ["cid", "other", "links"]
            )

    texts = documents.select(content, F.col(text).alias("text"))
    signed = texts.mapInArrow(sign, "cid binary, size bigint, sig binary, bands array<bigint>")
    contents = settle(signed.groupBy("cid").agg(F.first(F.struct("size", "sig", "bands")).alias("s")).select("cid", "s.*"), "contents")

    banded = contents.select("cid", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("cid")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "cid")).alias("y")
    ).filter("n > 1")
    buckets = buckets.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    members = banded.join(buckets, "bucket").join(contents.select("cid", "size", "sig"), "cid")
    members = in_blocks(members, ["bucket"], F.ceil(F.col("n") / block).cast("int"))
    edges = members.mapInArrow(bucket_edges, "a binary, b binary").distinct()
    found = settle(components(edges), "candidates")

    wanted = found.join(contents.select(F.col("cid").alias("node"), "sig"), "node")
    wanted = wanted.select(F.col("node").alias("cid"), "root", "sig")
    with_text = texts.join(wanted, "cid").groupBy("cid", "root").agg(F.first(F.struct("sig", "text")).alias("s")).select("cid", "root", "s.*")
    with_text = settle(with_text, "near")
    sizes = with_text.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    parts = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("chars") / block_chars)).cast("int")
    blocks = in_blocks(with_text.join(sizes.select("root", parts.alias("p")), "root"), ["root"], F.col("p"))
    linked = settle(blocks.mapInArrow(block_links, "cid binary, other binary, links bigint"), "links")

    classes = components(linked.select(F.col("cid").alias("a"), F.col("other").alias("b"))).withColumnsRenamed({"node": "cid"})
    counts = linked.groupBy("cid").agg(F.sum("links").alias("n_links"))
    copies = documents.select(F.col(key).alias(key), content)
    known = copies.groupBy("cid").agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("n_copies"))
    known = known.join(counts, "cid", "left").join(classes, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    roots = known.groupBy("root").agg(F.min("_first").alias("class_id"))
    known = known.join(roots, "root").select("cid", F.col("root").alias("class_cid"), "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_copies")
    return copies.join(known, "cid").select(key, "class_id", "n_links", "n_copies", "cid", "class_cid")


def one_per_class(documents: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The row with the smallest key of every class, whole; of repeated rows one."""
    classes = near_duplicates(documents, key=key, text=text, **options)
    first = classes.groupBy("class_cid").agg(F.min(F.struct(key, "cid")).alias("s")).select(F.col(f"s.{key}").alias("_key"), F.col("s.cid").alias("_cid"))
    marked = documents.withColumn("_content", F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))))
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_content") == F.col("_cid"))
    return marked.join(first, same, "left_semi").dropDuplicates([key, "_content"]).drop("_content")

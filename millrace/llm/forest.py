"""Near-duplicate documents by an LSH forest over five-word shingles.

1. Every text becomes its set of distinct shingles and 128 MinHash values of 16 bits. Equal texts are one
   content, known by its MD5; only contents are compared.
2. A tree sorts the contents by one order of their values; there are 32 orders. Contents whose keys share a
   prefix of MIN_DEPTH values are a region. A region with more than ``block`` members is cut by longer
   prefixes, up to MAX_DEPTH values, until it is small enough: sparse regions stay shallow, dense ones go deep.
   Regions with the same members as another one are dropped.
3. In a region the keys stand in order and neighbours with the longest common prefixes are compared first, by
   their values: an edge means that the pair may reach the threshold. A region that is still large at
   MAX_DEPTH is taken as candidates whole, by one edge from each member to the smallest.
4. Connected candidates are confirmed on their full sets. Groups of up to ``block`` contents are compared
   in one piece. Larger ones first in pieces dealt at random, twice; then only members that are not yet
   connected meet: those outside the largest component against all, piece by piece. A group of near copies,
   however large, is thus moved three times, and no link between two components is left out.
5. Components of the confirmed links give every document its smallest reachable id.

A pair at the threshold misses all trees with a probability of about 6e-11 in sparse regions
(``miss_probability``) and below 2e-6 where all of its regions are dense; a candidate is dropped in step 3 with one
of at most 1e-6 (the posterior bound of jaccard.py). Links are confirmed by whole numbers on sets of 64-bit hashes
of the shingles, built from hashes of their words.

Defined results. Null text, text without words: no shingles, linked with nothing, not even with equal
texts. Fewer than five words: one shingle. Repeated rows: one result each. A null id is never the smallest
while another one is in reach; ids given to several rows stay so. Empty table: empty result. Only the named
columns are carried, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from millrace.llm.arrays import mix
from millrace.llm.graphs import components
from millrace.llm.jaccard import Sets, groups, least_matches, like_sizes, min_hashes, seeds, survivors
from millrace.session import settle

SHINGLE = 5
#: A link needs PERCENT * union <= 100 * intersection.
PERCENT = 85
TREES, OWN = 32, 4
HASHES = TREES * OWN
MIN_DEPTH, MAX_DEPTH = OWN, 6
#: A tree's key: its own four values, then those of the tree this far away.
NEXT_TREE = 11
TOLERANCE = 1e-6
#: Contents and shingles in one piece.
BLOCK = 512
BLOCK_SHINGLES = 1_000_000
#: A content with more than this share of all rows is hot; there are at most so many of them.
HOT_CONTENTS = 1000


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; ASCII white space parts words, A to Z are lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(size, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) ^ hashes[i:i + n])
    return np.unique(out)


def signature(shingles: np.ndarray, factors: np.ndarray) -> bytes:
    """Sixteen bits of every MinHash value, big-endian, so that byte order is value order."""
    return ((min_hashes(shingles, factors) * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(">u2").tobytes()


def miss_probability(similarity: float, depth: int = MIN_DEPTH, trees: int = TREES) -> float:
    """Chance that no tree puts a pair of this similarity under a common prefix of ``depth`` values, trees taken as independent."""
    return (1 - similarity**depth) ** trees


def tree_keys(contents: DataFrame) -> DataFrame:
    """(cid, tree, key): one row per content and order of its values."""
    width = 2 * OWN
    other = F.pmod(F.col("tree") + NEXT_TREE, F.lit(TREES))
    key = F.concat(F.substring("sig", F.col("tree") * width + 1, F.lit(width)), F.substring("sig", other * width + 1, F.lit(width)))
    return contents.select("cid", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select("cid", "tree", key.alias("key"))


def regions(keys: DataFrame, block: int) -> DataFrame:
    """(cid, tree, prefix, key, n): members of the regions with at least two, at the depth that fits them."""
    found, open_rows = None, keys
    for depth in range(MIN_DEPTH, MAX_DEPTH + 1):
        rows = open_rows.withColumn("prefix", F.substring("key", 1, 2 * depth))
        sizes = rows.groupBy("tree", "prefix").agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("cid")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "cid")).alias("y")
        ).filter("n > 1")
        fits = sizes.filter(F.col("n") <= block) if depth < MAX_DEPTH else sizes
        once = fits.groupBy("n", "x", "y").agg(F.min(F.struct("tree", "prefix")).alias("s")).select("s.*", "n")
        members = rows.join(once, ["tree", "prefix"]).select("cid", "tree", "prefix", "key", "n")
        found = members if found is None else found.unionByName(members)
        if depth < MAX_DEPTH:
            open_rows = settle(rows.join(sizes.filter(F.col("n") > block), ["tree", "prefix"], "left_semi").drop("prefix"), "dense")
    return found


def near_first(order: np.ndarray, at: int) -> np.ndarray:
    """Places by their distance from ``at`` in key order: neighbours share the longest prefixes."""
    return order[np.argsort(np.abs(order - at), kind="stable")]


def candidate_edges(values: np.ndarray, sizes: np.ndarray, least: dict[int, int], share: float) -> Iterator[tuple[int, int]]:
    """Spanning edges of the pairs of a region, in key order, that may reach the threshold."""
    waiting = np.arange(len(values))
    while len(waiting) > 1:
        queue, waiting = [int(waiting[0])], waiting[1:]
        while queue and len(waiting):
            own = queue.pop()
            near = near_first(waiting[like_sizes(sizes[own], sizes[waiting], share)], own)
            found = near[survivors(values[own], values[near], least)]
            yield from ((own, int(i)) for i in found)
            queue += found[::-1].tolist()
            waiting = np.setdiff1d(waiting, found, assume_unique=True)


def linked(sets: list[np.ndarray], labels: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Links that connect rows of different ``labels``; rows with the same label count as connected.

    Exact overlaps from an inverted index. A row whose later rows all share its label needs no look.
    """
    n = len(sets)
    labels = labels.copy()
    sizes = np.array([len(s) for s in sets])
    values, number = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(number, kind="stable")
    posting = np.repeat(np.arange(n), sizes)[order]
    first = np.searchsorted(number[order], np.arange(len(values) + 1))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    for i in range(n - 1):
        later = np.arange(i + 1, n)
        later = later[(labels[later] != labels[i]) & (sizes[later] * 100 >= sizes[i] * percent) & (sizes[i] * 100 >= sizes[later] * percent)]
        if not len(later):
            continue
        own = number[bounds[i]:bounds[i + 1]]
        count = first[own + 1] - first[own]
        last = np.cumsum(count)
        overlap = np.bincount(posting[np.repeat(first[own] - (last - count), count) + np.arange(last[-1])], minlength=n)[later]
        for j in later[overlap * 100 >= (sizes[i] + sizes[later] - overlap) * percent].tolist():
            if labels[j] != labels[i]:
                yield i, j
                labels[labels == labels[j]] = labels[i]


def stars(ids: list[bytes], edges: Iterator[tuple[int, int]]) -> list[tuple[bytes, bytes]]:
    """What ``edges`` of places connect, as edges from every member to the smallest id: paths over several groups stay short."""
    order = sorted(range(len(ids)), key=ids.__getitem__)
    rank = {place: r for r, place in enumerate(order)}
    sets = Sets(len(ids))
    for i, j in edges:
        sets.join(rank[i], rank[j])
    return [(ids[order[r]], ids[order[root]]) for r in range(len(ids)) if (root := sets.root(r)) != r]


def edge_batch(edges: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.binary()) for i in (0, 1)], ["a", "b"])


def confirm(rows: DataFrame, key: list[str], percent: int) -> DataFrame:
    """Edges (a, b) between the components ``v`` (null: the row is one of its own) that links within a group of ``key`` connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, key):
            ids = table.column("cid").to_pylist()
            names, labels = np.unique(np.array([(v or c).hex() for v, c in zip(table.column("v").to_pylist(), ids, strict=True)]), return_inverse=True)
            # the largest component last: once the others are through, nothing is left to compare
            order = np.argsort(labels == np.bincount(labels).argmax(), kind="stable") if len(names) < len(ids) else np.arange(len(ids))
            sets = table.column("shingles").to_pylist()
            sets = [np.frombuffer(sets[i], np.uint64) for i in order]
            labels = labels[order]
            found = ((int(labels[i]), int(labels[j])) for i, j in linked(sets, labels, percent))
            yield edge_batch(stars([bytes.fromhex(name) for name in names.tolist()], found))

    rows = rows.select("cid", "v", "shingles", *key)
    return rows.repartition(*key).sortWithinPartitions(*key, "cid").mapInArrow(run, "a binary, b binary")


def confirmed_classes(near: DataFrame, block: int, block_shingles: int, percent: int) -> DataFrame:
    """(node, root) of what links connect among the candidates ``near`` (root, cid, size, shingles); contents without a link may be missing."""

    def pieces(rows, total):
        return F.greatest(F.ceil(rows / block), F.ceil(total / block_shingles)).cast("int")

    def piece(seed: int, parts: str):
        return F.pmod(F.xxhash64(F.lit(seed), "cid"), F.col(parts)).cast("int")

    sizes = near.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))
    rows = near.join(sizes.select("root", pieces(F.col("n"), F.col("total")).alias("parts")), "root").withColumn("v", F.lit(None).cast("binary"))
    rounds = F.when(F.col("parts") > 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    dealt = rows.withColumn("round", F.explode(rounds)).withColumn("piece", F.pmod(F.xxhash64("round", "cid"), F.col("parts")).cast("int"))
    links = settle(confirm(dealt, ["root", "round", "piece"], percent), "links")

    classes = components(links)
    large = rows.filter("parts > 1").drop("v")
    if large.isEmpty():
        return classes
    parts = classes.select(F.col("node").alias("cid"), F.col("root").alias("v"))
    large = settle(large.select("cid", "root").join(parts, "cid", "left").withColumn("v", F.coalesce("v", "cid")), "parts")
    counted = large.join(near.select("cid", "size"), "cid").groupBy("root", "v").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))
    largest = counted.groupBy("root").agg(
        F.max(F.struct("n", "total", "v")).alias("m"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.count(F.lit(1)).alias("components")
    ).filter("components > 1").select(
        "root", F.col("m.v").alias("main"), pieces(F.col("m.n"), F.col("m.total")).alias("main_parts"),
        pieces(F.col("n") - F.col("m.n"), F.col("total") - F.col("m.total")).alias("rest_parts"),
    )
    left = large.join(largest, "root").join(near.select("cid", "size", "shingles"), "cid").withColumn("is_main", F.col("v") == F.col("main"))
    # main rows meet each piece of the rest; rows of the rest meet each piece of the main component and of the rest
    mine = piece(3, "rest_parts")
    to_rest = F.transform(F.sequence(F.lit(0), F.col("rest_parts") - 1), lambda r: F.struct(
        F.least(r, mine).alias("rest"), (F.col("main_parts") + F.greatest(r, mine)).alias("other")))
    to_main = F.transform(F.sequence(F.lit(0), F.col("main_parts") - 1), lambda m: F.struct(mine.alias("rest"), m.alias("other")))
    from_main = F.transform(F.sequence(F.lit(0), F.col("rest_parts") - 1), lambda r: F.struct(r.alias("rest"), piece(4, "main_parts").alias("other")))
    pairs = left.withColumn("pair", F.explode(F.when(F.col("is_main"), from_main).otherwise(F.concat(to_main, to_rest))))
    rest = confirm(pairs.select("root", "cid", "v", "shingles", "pair.*"), ["root", "rest", "other"], percent)
    # edges between components: few, and no link within one is gone through again
    merged = components(settle(rest, "rest_links"))
    moved = classes.join(merged.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
    alone = merged.join(classes.select("node"), "node", "left_anti")
    return moved.select("node", F.coalesce("to", "root").alias("root")).unionByName(alone)


def sign(documents: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(id, cid, size, sig) of every row; texts without words have no signature."""
    factors = seeds(HASHES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("cid"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([signature(s, factors) if len(s) else None for s in sets], pa.binary()),
            ], ["id", "cid", "size", "sig"])

    rows = with_content(documents, key, text)
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, cid binary, size bigint, sig binary")


def with_content(documents: DataFrame, key: str, text: str) -> DataFrame:
    rows = documents.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.withColumn("cid", F.unhex(F.md5("text")))


def with_shingles(rows: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("cid"), batch.column("root"), batch.column("size"), pa.array(sets, pa.binary())], ["cid", "root", "size", "shingles"]
            )

    return rows.select("cid", "root", "size", "text").mapInArrow(run, "cid binary, root binary, size bigint, shingles binary")


def forest_duplicates(
    documents: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES,
    tolerance: float = TOLERANCE, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per document: key, ``n_shingles``, ``component_id`` (smallest key that links lead to) and ``kept``
    (whether that is its own key)."""
    share = percent / 100
    least = least_matches((share * 256 - 1) / 255, tolerance)  # made for 8-bit values, which match by chance; these do not

    def region_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = []
        for table in groups(batches, ["tree", "prefix"]):
            ids = table.column("cid").to_pylist()
            values = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
            sizes = np.array(table.column("size").to_pylist())
            edges += stars(ids, candidate_edges(values, sizes, least, share))
            if len(edges) > 10_000:
                yield edge_batch(edges)
                edges = []
        yield edge_batch(edges)

    signed = settle(sign(documents, key, text, shingle), "signed")
    contents = signed.filter("size > 0").groupBy("cid").agg(
        F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first(F.struct("size", "sig")).alias("s"))
    contents = settle(contents.select("cid", "first_id", "copies", "s.*"), "contents")

    members = settle(regions(tree_keys(contents), block), "regions")
    small = members.filter(F.col("n") <= block).join(contents.select("cid", "size", "sig"), "cid")
    small = small.repartition("tree", "prefix").sortWithinPartitions("tree", "prefix", "key", "cid")
    large = members.filter(F.col("n") > block)
    heads = large.groupBy("tree", "prefix").agg(F.min("cid").alias("a"))
    whole = large.join(heads, ["tree", "prefix"]).select("a", F.col("cid").alias("b"))
    found = settle(components(small.mapInArrow(region_edges, "a binary, b binary").unionByName(whole)), "candidates")

    wanted = found.withColumnRenamed("node", "cid").join(contents.select("cid", "first_id", "size"), "cid")
    # one row holds each content's text: the one with the smallest id, so a group of copies does not meet
    rows = with_content(documents, key, text).join(
        wanted.withColumnRenamed("cid", "want"), F.col("id").eqNullSafe(F.col("first_id")) & (F.col("cid") == F.col("want")))
    near = settle(with_shingles(rows.dropDuplicates(["cid"]), shingle), "near")
    classes = confirmed_classes(near, block, block_shingles, percent).select(F.col("node").alias("cid"), "root")
    known = contents.select("cid", "first_id", "copies").join(classes, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    ids = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = settle(known.join(ids, "root").select("cid", "copies", "component_id"), "classes")
    total = signed.count()
    hot = F.broadcast(known.filter(F.col("copies") * HOT_CONTENTS >= total).select("cid", F.col("component_id").alias("hot_id")))
    rows = signed.select("id", "cid", "size").join(hot, "cid", "left")
    out = rows.filter("size > 0 and hot_id is null").join(known.select("cid", "component_id"), "cid")
    out = out.select("id", "size", "component_id").unionByName(
        rows.filter("size = 0 or hot_id is not null").select("id", "size", F.when(F.col("size") > 0, F.col("hot_id")).otherwise(F.col("id")).alias("component_id"))
    )
    return out.select(
        F.col("id").alias(key), F.col("size").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )

"""URL rules by a sort-merge range join.

A host's labels in reverse, each followed by a full stop, make a key in which a host and all
its subdomains are one interval: everything that starts with the host's own key. URLs are
spread by key ranges (a hot host over several), every rule goes to the ranges that its
interval meets, and one sorted sweep per range keeps the stack of rules whose interval is
open. Paths are looked up within the stack.

Defined results. Null url, or one without ``://``: empty host and path, no rule. A rule's
path must start the url's path, which is empty if the url ends after the host. Of several
fitting rules the longest text (host and path) wins, then the longest host; two rules with the
same host and path: ``block`` wins. A rule with a null part or an empty host is ignored. Repeated rows: one
result each. Empty urls or rules: empty result, or no rule for any url. Only the columns
named are carried, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.session import settle

#: The rules of the registered query (host, path, verdict).
RULES = (
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(after, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """``www.a.net`` as ``net.a.www.``; an empty host as an empty key."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


class Stack:
    """The open intervals at one place of the sweep, outermost first."""

    def __init__(self) -> None:
        self.entries: list[tuple[str, dict[str, str], list[int]]] = []

    def close_before(self, key: str) -> None:
        while self.entries and not key.startswith(self.entries[-1][0]):
            self.entries.pop()

    def add(self, key: str, path: str, verdict: str) -> None:
        self.close_before(key)
        if not self.entries or self.entries[-1][0] != key:
            self.entries.append((key, {}, []))
        _, paths, lengths = self.entries[-1]
        if paths.get(path) != "block":
            paths[path] = verdict
        if len(path) not in lengths:
            lengths.append(len(path))
            lengths.sort(reverse=True)

    def longest(self, key: str, path: str) -> tuple[str | None, str | None]:
        self.close_before(key)
        best = (-1, "", None, None)
        for prefix, paths, lengths in reversed(self.entries):
            for n in lengths:
                if n <= len(path) and path[:n] in paths:
                    if len(prefix) + n > best[0]:
                        best = (len(prefix) + n, prefix, path[:n], paths[path[:n]])
                    break
        if best[2] is None:
            return None, None
        return ".".join(reversed(best[1][:-1].split("."))) + best[2], best[3]


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (part, key, is_url, path): rules open intervals, urls read the stack."""
    stack, part, last, found = Stack(), None, None, (None, None)
    for batch in batches:
        parts, keys, is_url, paths, verdicts = (batch.column(n).to_pylist() for n in ("part", "key", "is_url", "path", "verdict"))
        rules, results, rows = [], [], []
        for row, (p, key, url, path, verdict) in enumerate(zip(parts, keys, is_url, paths, verdicts, strict=True)):
            if p != part:
                stack, part, last = Stack(), p, None
            if not url:
                stack.add(key, path, verdict)
                last = None
                continue
            if (key, path) != last:
                found, last = stack.longest(key, path), (key, path)
            rows.append(row)
            rules.append(found[0])
            results.append(found[1])
        out = batch.select(["row"]).take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([out.column(0), pa.array(rules, pa.string()), pa.array(results, pa.string())], ["row", "rule", "verdict"])


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """``key``, ``host``, ``path``, ``rule`` and ``verdict`` of every row of ``pages``.

    ``rules`` holds (host, path, verdict) and may be of any size: each rule is sent only to
    the key ranges that its interval meets, of which there are as many as shuffle partitions.
    """
    spark = pages.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    urls = pages.select(F.struct(F.col(key).alias(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).alias("row"))
    urls = urls.select("row", host_key(F.col("row.host")).alias("key"), F.col("row.path").alias("path"))
    dealt = urls.repartitionByRange(ranges, "key", "path", F.xxhash64(F.col(f"row.{key}"), F.rand(7)))
    urls = settle(dealt.withColumn("part", F.spark_partition_id()), "urls")
    bounds = urls.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    # One row per key range, so its size is the number of shuffle partitions.
    bounds = F.broadcast(bounds.agg(F.collect_list(F.struct("part", "first", "last")).alias("bounds")))
    rules = rules.select("host", "path", "verdict").dropna().filter("host != ''").select(
        F.lit(1).alias("_one"), host_key(F.translate("host", UPPER, LOWER)).alias("key"), "path", "verdict"
    )
    # '/' follows '.' and stands in no host: the first key after an interval.
    meets = lambda b: (F.col("key") <= b["last"]) & (F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/")) > b["first"])
    rules = rules.join(bounds.withColumn("_one", F.lit(1)), "_one").select(
        F.explode(F.filter("bounds", meets)).alias("b"), "key", "path", "verdict"
    ).select(F.col("b.part").alias("part"), "key", F.lit(False).alias("is_url"), "path", "verdict", F.lit(None).alias("row"))
    events = rules.unionByName(urls.select("part", "key", F.lit(True).alias("is_url"), "path", F.lit(None).alias("verdict"), "row"))
    events = events.repartitionByRange(ranges, "part").sortWithinPartitions("part", "key", "is_url", "path")
    judged = events.mapInArrow(sweep, f"row {urls.schema['row'].dataType.simpleString()}, rule string, verdict string")
    return judged.select("row.*", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))

"""File listings, whole files, and reads of exactly the files that a table names.

No list of files passes through the driver: folders are listed by tasks, level by level, and
files are opened by the tasks that give their rows.
"""

from __future__ import annotations

import glob as globs
import os
import re
from collections.abc import Iterator
from itertools import batched

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions.text import plain_text
from millrace.session import settle

EVERY_FILE = "**/*"
#: Bytes of the files that one task reads, on average.
TASK_BYTES = 64 << 20
#: Bytes of small files that go in one batch of rows.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 10_000
FOLDERS_PER_TASK = 64
AUTHORITY = "^[^:/]*:(//[^/]*)?"


def list_files(spark: SparkSession, path: str, name_glob: str | None = None) -> DataFrame:
    """``(path, length, mtime)`` of all files below ``path``; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    return reader.load(path).select("path", "length", F.col("modificationTime").alias("mtime"))


def has_scheme(path: str) -> bool:
    return re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path) is not None


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path on any storage is a folder, which lists other paths than its own."""
    below = list_files(spark, path).select("path").limit(2).collect()
    own = re.sub(AUTHORITY, "", path.rstrip("/"))
    return [re.sub(AUTHORITY, "", row.path) for row in below] != [own]


def listing_bounds(files: DataFrame, split_bytes: int = 4 << 20) -> int:
    """At most how many splits Spark cuts these files into (its open cost is the least split size)."""
    row = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("size")).first()
    return row["n"] + row["size"] // split_bytes


def units_from_file(spark: SparkSession, path: str) -> DataFrame:
    """Each file's whole text as one source unit."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.col("_metadata.file_path").alias("source"), plain_text(F.col("value")).alias("unit"))


def glob_regex(pattern: str) -> str:
    """A path glob over ``/``-separated relative paths as a regex that Python and Java share."""
    pattern = pattern.strip() or EVERY_FILE
    regex = globs.translate(pattern, recursive=True, include_hidden=True, seps="/")
    return "^" + regex.removesuffix(r"\Z") + "$"


def units_from_dir(spark: SparkSession, path: str, glob: str = "", hidden: bool = True) -> DataFrame:
    """Each matching file below ``path`` as one unit of plain text: ``(source, path, unit)``.

    Spark's file sources leave out names that start with ``.`` or ``_``; with ``hidden`` the
    folders are listed by ``walk_files``, which leaves out none and needs storage that all
    executors mount. Without, ``path`` may be on any storage that Spark reads. Order rows by
    path components (``order_by_path``).
    """
    if hidden:
        root = os.path.join(path, "")
        found = walk_files(spark, path).filter(F.substr("path", F.lit(len(root) + 1)).rlike(glob_regex(glob)))
        rows = read_paths(spark, found)
    else:
        root = path.rstrip("/") + "/"
        below = F.substr("path", F.instr("path", root) + len(root))
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        found = rows = files.filter(below.rlike(glob_regex(glob)))
    if found.select("path").isEmpty():
        raise ValueError(f"no file below {path} matches {glob or EVERY_FILE}")
    return rows.select(F.lit(path).alias("source"), "path", plain_text(F.col("content")).alias("unit"))


def _list_folders(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The entries of each folder, a bounded number at a time; links to folders are not followed."""
    for frame in frames:
        for folder in frame.path:
            with os.scandir(folder) as entries:
                for some in batched(entries, BATCH_ROWS):
                    rows = [(e.path, e.stat().st_size if e.is_file() else None) for e in some if e.is_file() or e.is_dir(follow_symlinks=False)]
                    yield pd.DataFrame(rows, columns=["path", "length"]).astype({"length": "Int64"})


def walk_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length)`` of all files below a mounted folder, hidden ones too.

    One job for each level of folders; a level is written before the next one, and the driver
    learns only how many folders it has. An empty folder gives no row; one that a task cannot
    read is an error, so that no file is left out in silence.
    """
    level, n, found = spark.createDataFrame([(path,)], "path string"), 1, None
    while n:
        spread = level.repartition(-(-n // FOLDERS_PER_TASK))
        listed = settle(spread.mapInPandas(_list_folders, "path string, length long"), "listing")
        level = listed.filter("length IS NULL").select("path")
        files = listed.filter("length IS NOT NULL")
        found = files if found is None else found.unionByName(files)
        n = level.count()
    return found


def _add_lengths(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"path": frame.path, "length": frame.path.map(os.path.getsize).astype("int64")})


def _open_files(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole files, a few small ones or a single large one to a batch."""
    rows, size = [], 0
    for frame in frames:
        for path in frame.path:
            with open(path, "rb") as file:
                rows.append((path, file.read()))
            size += len(rows[-1][1])
            if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield pd.DataFrame(rows, columns=["path", "content"])
                rows, size = [], 0
    yield pd.DataFrame(rows, columns=["path", "content"])


def read_paths(spark: SparkSession, files: DataFrame | list[str], task_bytes: int = TASK_BYTES) -> DataFrame:
    """``(path, content)`` of exactly these files, hidden ones too, on storage that all executors mount.

    ``files`` has a column ``path``, and ``length`` if it is known. A path that occurs twice is read
    twice; one that names no file is an error; no path gives no row.
    """
    if isinstance(files, list):
        files = spark.createDataFrame([(p,) for p in files], "path string")
    if "length" not in files.columns:
        files = files.select("path").mapInPandas(_add_lengths, "path string, length long")
    row = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("size")).first()
    tasks = max(1, min(row["n"], row["size"] // task_bytes + 1))
    return files.select("path").repartition(tasks).mapInPandas(_open_files, "path string, content binary")

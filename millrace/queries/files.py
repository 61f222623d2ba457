"""Registered queries: sources and sinks, by way of files written from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import jsonrow
from millrace.operators import datasets as ds
from millrace.operators.inventory import log_listing
from millrace.queries import fixtures as fx
from millrace.queries.fixtures import Query, table
from millrace.session import scratch_path
from millrace.sinks import jsonl as out
from millrace.sources import files as fs
from millrace.sources import jsonl as src
from millrace.sources import units as un

# Lines of one file: small enough to be read as one text.
FILE_ROWS = 400
BUCKET = f"CAST(floor((line_no - 1) / {FILE_ROWS}) AS BIGINT)"


def written_lines(spark, folder):
    """The dataset lines as files of ``FILE_ROWS`` lines in document order, each in a folder of its bucket."""
    path = f"{scratch_path(spark, 'lines')}.jsonl"
    rows = fx.lines(spark, folder).selectExpr(f"{BUCKET} AS bucket", "line_no", "raw")
    rows.repartition("bucket").sortWithinPartitions("bucket", "line_no").select("bucket", "raw").write.partitionBy("bucket").text(path)
    return path


def bucket_of(path):
    return F.regexp_extract(path, "/bucket=([0-9]+)/", 1).cast("long").alias("bucket")


def scanned(spark, folder):
    """Every line under its number in its file; blank lines count but are left out."""
    rows = src.read_jsonl(spark, written_lines(spark, folder))
    return rows.select(bucket_of("source"), "line_no", "raw")


def json_documents(spark, folder):
    """One JSON text per document: an array, an object or a single string."""
    t = fx.SPARK_JSON_TEXT.format("text")
    rows = table(spark, folder, "documents").selectExpr("doc_id", f"{t} AS t")
    return rows.selectExpr("doc_id", f"{JSON_TEXT} AS text")


JSON_TEXT = """CASE doc_id % 3 WHEN 0 THEN '[{"prompt":' || t || ',"n":1},' || t || ',[1,2],null]' WHEN 1 THEN '{"b":' || t || ',"a":[]}' ELSE t END"""
JSON_UNITS = f"""WITH d AS (SELECT doc_id, {fx.DUCK_JSON_TEXT.format('text')} AS t FROM documents),
u AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ['{{"prompt": ' || t || ', "n": 1}}', t, '[1, 2]', 'null']
  WHEN 1 THEN ['{{"b": ' || t || ', "a": []}}'] ELSE [t] END AS us FROM d)
SELECT doc_id, unnest(range(0, len(us)))::INTEGER AS unit_idx, unnest(us) AS unit FROM u"""
COMPACT_UNITS = f"""WITH d AS (SELECT doc_id, {fx.DUCK_JSON_TEXT.format('text')} AS t FROM documents),
u AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ['{{"n":1,"prompt":' || t || '}}', t, '[1,2]', 'null']
  WHEN 1 THEN ['{{"a":[],"b":' || t || '}}'] ELSE [t] END AS us FROM d)
SELECT doc_id, unnest(range(0, len(us)))::INTEGER AS unit_idx, unnest(us) AS unit FROM u"""


ARRAY_ITEM = """'{"id": ' || CAST(doc_id AS STRING) || ', "text": ' || t || ', "of": [{"n": null}, "a,b]"]}'"""


def array_files(spark, folder):
    """One array file for each source, its documents' whole texts inside; elements start on lines of their own."""
    path = scratch_path(spark, "arrays")
    rows = table(spark, folder, "documents").selectExpr("source", "doc_id", f"{fx.SPARK_JSON_TEXT.format('text')} AS t").selectExpr("source", "doc_id", f"{ARRAY_ITEM} AS item")
    ends = rows.groupBy("source").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    line = F.concat(
        F.when(F.col("doc_id") == F.col("first"), "[").otherwise(", "), F.col("item"), F.when(F.col("doc_id") == F.col("last"), " ]\n").otherwise(""))
    # one row for each file; a join by hash would stand in for the repartition, and its parts may be read apart
    lines = rows.join(F.broadcast(ends), "source").select("source", "doc_id", line.alias("value"))
    lines.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "value").write.partitionBy("source").text(path)
    units = un.units_from_json_files(spark, path)
    return units.withColumn("source", F.regexp_extract("source", "source=([^/]*)/", 1))


ARRAY_FILES = (
    f"WITH d AS (SELECT source, doc_id, {fx.DUCK_JSON_TEXT.format('text')} AS t FROM documents) SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS unit_idx, "
    f"{ARRAY_ITEM.replace('STRING', 'VARCHAR')} AS unit FROM d"
)


def line_units(spark, folder):
    rows = fx.lines(spark, folder).select("line_no", "raw")
    return un.units_from_jsonl(rows)


# Valid lines come back with a space after commas and colons outside strings.
SPACED = " ".join(
    f"WHEN {k} THEN {sql}"
    for k, sql in enumerate(
        s.replace('":\'', '": \'').replace("',\"", "', \"").replace("|| ',' ||", "|| ', ' ||").replace('":[]', '": []').replace('[],"', '[], "')
        .replace('":[{"role":"user","content": ', '": [{"role": "user", "content": ').replace('":"[1]"', '": "[1]"')
        .replace("[1,2]", "[1, 2]").replace('":null,"', '": null, "')
        if k not in (8, 9, 12, 13) else s
        for k, s in enumerate(fx.shapes("t"))
    )
)
LINE_UNITS = (
    f"WITH d AS (SELECT doc_id, {fx.DUCK_JSON_TEXT.format('text')} AS t FROM documents) SELECT doc_id + 1 AS line_no, 0 AS part, "
    f"CASE doc_id % 16 {SPACED} END AS unit FROM d WHERE doc_id % 16 <> 10"
)


def unit_digest(path, unit):
    return [bucket_of(path), F.length(unit).cast("long").alias("n_chars"), F.md5(F.encode(unit, "UTF-8")).alias("digest")]


def whole_files(spark, folder):
    units = fs.units_from_file(spark, written_lines(spark, folder))
    return units.select(*unit_digest("source", "unit"))


def folder_files(spark, folder):
    path = written_lines(spark, folder).removeprefix("file:")
    units = fs.units_from_dir(spark, path, "**/part-*.txt")
    return units.select(*unit_digest("path", "unit"))


def listed_paths(spark, folder):
    """The files of every second bucket, read by the table of their paths."""
    path = written_lines(spark, folder).removeprefix("file:")
    files = fs.walk_files(spark, path).filter(F.col("path").rlike("/bucket=[0-9]*[02468]/part-[^/]*[.]txt$"))
    found = fs.read_paths(spark, files)
    return found.select(bucket_of("path"), F.length("content").cast("long").alias("n_bytes"), F.md5("content").alias("digest"))


def listing(spark, folder):
    found = fs.list_files(spark, written_lines(spark, folder), "*.txt")
    return found.select(bucket_of("path"), F.col("length").alias("n_bytes"), F.col("mtime").isNotNull().alias("timed"))


# A listing of logs: one per document, seven hours apart, two of them at the same time.
LOG_COLUMNS = [
    "'runs/' || source || '/' || lang || CAST(doc_id AS {0}) || '.json' AS path", "n_chars * 7 AS length",
    "{1} '2024-01-01 00:00:30' + INTERVAL '7' HOUR * CAST(floor(doc_id / 2) AS INT) AS mtime",
]


def logs(spark, folder):
    columns = [c.format("STRING", "TIMESTAMP_NTZ") for c in LOG_COLUMNS]
    return log_listing(table(spark, folder, "documents").selectExpr(*columns))


LOGS = (
    f"WITH logs AS (SELECT {', '.join(c.format('VARCHAR', 'TIMESTAMP') for c in LOG_COLUMNS)} FROM documents) "
    "SELECT string_split(path, '/')[-1] AS name, CASE WHEN length < 1024 THEN CAST(length AS VARCHAR) || ' B' "
    "ELSE printf('%.1f KB', length / 1024) END AS size, strftime(mtime, '%Y-%m-%d %H:%M') AS created FROM logs ORDER BY mtime DESC, path"
)
FILES = (
    f"WITH {fx.LINES}, files AS (SELECT {BUCKET} AS bucket, string_agg(raw || chr(10), '' ORDER BY line_no) AS text FROM lines GROUP BY ALL) "
)
FILE_UNITS = f"{FILES} SELECT bucket, length(text) AS n_chars, md5(text) AS digest FROM files"


def conversations(spark, folder):
    return table(spark, folder, "conversations")


def reread(spark, path):
    lines = jsonrow.with_value(spark.read.text(path).withColumnRenamed("value", "raw"))
    return lines.select(
        F.try_variant_get("value", "$.conv_id", "bigint").alias("conv_id"),
        F.try_variant_get("value", "$.turn", "bigint").alias("turn"),
        jsonrow.text_at(F.col("value"), "$.text").alias("text"),
        jsonrow.has_key(F.col("value"), "note").alias("null_kept"),
    )


def typed(spark, folder):
    return out.as_json_lines(conversations(spark, folder).withColumn("note", F.lit(None).cast("string")))


def sunk(spark, folder):
    path = scratch_path(spark, "sink")
    out.write_jsonl(typed(spark, folder), path)
    return reread(spark, path)


def appended(spark, folder):
    """A first run writes the users' turns, a resumed one appends the others."""
    path = scratch_path(spark, "resumed")
    rows = conversations(spark, folder).withColumn("note", F.lit(None).cast("string"))
    out.write_jsonl(out.as_json_lines(rows.filter("role = 'user'")), path)
    out.write_jsonl(out.as_json_lines(rows.filter("role <> 'user'")), path, mode="append")
    return reread(spark, path)


TURNS = "SELECT conv_id, turn, text, true AS null_kept FROM conversations"


def partitioned(spark, folder):
    path = scratch_path(spark, "runs")
    rows = out.with_run_id(fx.lines(spark, folder).filter("trim(raw) <> ''"), "run-1")
    out.write_jsonl(rows, path, by=["run_id", "source"])
    found = spark.read.option("basePath", path).schema("value string, run_id string, source string").text(path)
    return found.groupBy("run_id", "source").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("value")).alias("n_chars")
    )


def training_table(spark, folder):
    path = scratch_path(spark, "training")
    return out.to_training_table(ds.classify_lines(fx.lines(spark, folder)), jsonrow.SFT, path)


QUERIES = {
    "jsonl_scan": Query(
        scanned,
        f"WITH {fx.LINES} SELECT {BUCKET} AS bucket, (line_no - 1) % {FILE_ROWS} + 1 AS line_no, raw FROM lines WHERE trim(raw) <> ''",
    ),
    "json_array_units": Query(lambda spark, folder: un.units_from_json(json_documents(spark, folder)), JSON_UNITS),
    "json_array_units_compact": Query(
        lambda spark, folder: un.units_from_json(json_documents(spark, folder), compact=True), COMPACT_UNITS
    ),
    "json_array_files": Query(array_files, ARRAY_FILES),
    "jsonl_units": Query(line_units, LINE_UNITS),
    "file_units": Query(whole_files, FILE_UNITS),
    "dir_units": Query(folder_files, FILE_UNITS),
    "path_list_source": Query(
        listed_paths, f"{FILES} SELECT bucket, strlen(text) AS n_bytes, md5(text) AS digest FROM files WHERE bucket % 2 = 0"
    ),
    "file_listing": Query(listing, f"{FILES} SELECT bucket, strlen(text) AS n_bytes, true AS timed FROM files"),
    "log_listing": Query(logs, LOGS),
    "resume_scan": Query(
        lambda spark, folder: src.count_existing(spark, written_lines(spark, folder)),
        f"WITH {fx.CLASSIFIED} SELECT count(*) AS existing FROM stripped WHERE raw <> ''",
    ),
    "jsonl_sink": Query(sunk, TURNS),
    "jsonl_append": Query(appended, TURNS),
    "run_partition": Query(
        partitioned,
        f"WITH {fx.CLASSIFIED} SELECT 'run-1' AS run_id, source, count(*) AS n_lines, sum(length(raw))::BIGINT AS n_chars FROM stripped "
        "WHERE raw <> '' GROUP BY source",
    ),
    "typed_dataset_sink": Query(
        training_table,
        f"WITH {fx.CLASSIFIED} SELECT raw->>'$.prompt' AS prompt, raw->>'$.completion' AS completion FROM classified WHERE status = 'sft'",
    ),
}

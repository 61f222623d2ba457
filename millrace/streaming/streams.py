"""The same rules over streams: arriving JSON lines, caps, traces, metrics, resume."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener
from pyspark.sql.types import LongType, StructField, StructType

from millrace.functions.text import chunk_tokens
from millrace.operators.responses import VALID, parse_responses
from millrace.operators.telemetry import micros


def stream_lines(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Text lines of the files that arrive in a folder."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return lines.withColumnRenamed("value", "response")


def stream_rows(arrivals: DataFrame, task: str) -> DataFrame:
    """Arriving responses as parsed, classified lines: the batch rules unchanged."""
    return parse_responses(arrivals, task).drop("value")


def stream_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """Valid and skipped lines so far."""
    valid = F.col("status") == VALID
    return rows.groupBy(*keys).agg(F.count_if(valid).alias("generated"), F.count_if(~valid).alias("skipped"))


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside use the state store that ``stream_cap`` and ``stream_trace`` need.

    A stream takes the setting when it starts; the session has its own again afterwards.
    """
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


class _FirstRows(StatefulProcessor):
    """Passes a key's rows on until it has given its target."""

    def __init__(self, target: int):
        self.target = target

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.given = handle.getValueState("given", StructType([StructField("n", LongType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.given.get()
        given = known[0] if known else 0
        for row in rows:
            if given < self.target:
                given += 1
                yield row
        self.given.update((given,))

    def close(self) -> None:
        pass


#: Keys that a task remembers before the shuffle; it then starts anew, and a key sends at most its target again.
KNOWN_KEYS = 1_000_000


def stream_cap(rows: DataFrame, keys: list[str], target: int) -> DataFrame:
    """Give each key's first ``target`` rows over the whole life of the stream.

    Rows beyond the target within one task of one micro-batch can never be among
    the first, so they go before the shuffle: a key with very many rows sends at
    most ``target`` per task, or per ``KNOWN_KEYS`` other keys. Start it within ``keyed_state``.
    """
    def before_shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}
        for batch in batches:
            room = []
            for name in zip(*(batch.column(key).to_pylist() for key in keys)):
                n = seen.get(name, 0)
                room.append(n < target)
                if n < target:
                    seen[name] = n + 1
            yield batch.filter(pa.array(room, pa.bool_()))
            if len(seen) > KNOWN_KEYS:
                seen.clear()

    few = rows.mapInArrow(before_shuffle, rows.schema)
    return few.groupBy(*keys).transformWithState(
        statefulProcessor=_FirstRows(target), outputStructType=rows.schema, outputMode="Append", timeMode="None"
    )


class _LiveTrace(StatefulProcessor):
    """Trace steps of a run's arriving chunks; what it hands on is four numbers, for as long as it is live."""

    STATE = StructType([StructField(name, LongType()) for name in ("started_us", "last_us", "last_seq", "tokens")])

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", self.STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # plain arrays: most runs have few chunks, and each step on a frame costs more than all of them here
        frames = list(rows)
        chunks = frames[0] if len(frames) == 1 else pd.concat(frames)
        order = np.argsort(chunks["seq"].to_numpy(), kind="stable")
        seq, us, tokens, chunk = (chunks[name].to_numpy()[order] for name in ("seq", "us", "tokens", "chunk"))
        known = self.run.get()
        started, last, last_seq, given = known or (int(us.min()), None, None, 0)
        # behind what was given out: the tokens count from here on, but there is no speed to tell
        late = np.arange(len(seq)) < (np.searchsorted(seq, last_seq, "right") if known else 0)
        running = given + np.nan_to_num(tokens).astype("int64").cumsum()
        in_time, counted = us[~late], tokens[~late]
        passed = np.diff(in_time, prepend=last if known else started)
        speed = np.full(len(seq), np.nan)
        speed[~late] = np.divide(counted, passed / 1e6, out=np.full(len(passed), np.nan), where=(counted > 0) & (passed > 0))
        if len(in_time):
            last, last_seq = int(in_time[-1]), int(seq[-1])
        self.run.update((started, last, last_seq, int(running[-1])))
        if not known:
            self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs(), last // 1000) + self.idle_ms)
        yield pd.DataFrame({
            "run_id": key[0], "seq": seq, "chunk": chunk, "tokens": tokens, "cumulative_tokens": running,
            "elapsed_s": (us - started) / 1e6, "tps": speed, "late": late,
        })

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A run has one timer: it looks again if chunks came meanwhile, else the run is over and forgotten."""
        known = self.run.get()
        if known:
            ends = known[1] // 1000 + self.idle_ms
            if ends > timerValues.getCurrentWatermarkInMs():
                self.handle.registerTimer(ends)
            else:
                self.run.clear()
        yield from ()

    def close(self) -> None:
        pass


TRACE_COLUMNS = {
    "run_id": "bigint", "seq": "bigint", "chunk": "string", "tokens": "bigint", "cumulative_tokens": "bigint",
    "elapsed_s": "double", "tps": "double", "late": "boolean",
}


def stream_trace(chunks: DataFrame, delay: str, idle_s: int) -> DataFrame:
    """Trace steps of arriving chunks, run by run, across micro-batches; start it within ``keyed_state``.

    A run is forgotten ``idle_s`` seconds of event time after its last chunk, so the state holds the
    live runs only and each micro-batch touches the runs that it has chunks of. Chunks older than the
    watermark (``delay`` behind the newest) are dropped by Spark and counted by ``ProgressListener``. A chunk
    that comes after a later one of its run was given out is ``late``: its tokens count from where it
    arrives, and it has no speed. A chunk of a run that was forgotten starts that run anew.
    """
    rows = chunks.select(
        "run_id", F.col("seq").cast("long").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), "chunk",
        chunk_tokens(F.col("tokens"), F.col("chunk")).cast("long").alias("tokens"), micros(F.col("ts")).alias("us"),
    )
    return rows.withWatermark("ts", delay).groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=_LiveTrace(idle_s * 1000), outputStructType=", ".join(f"{n} {t}" for n, t in TRACE_COLUMNS.items()),
        outputMode="Append", timeMode="EventTime",
    )


def with_metrics(parsed: DataFrame, name: str) -> DataFrame:
    """Report valid and skipped lines of each micro-batch (or batch job) under ``name``."""
    valid = F.col("status") == VALID
    return parsed.observe(name, F.count_if(valid).alias("generated"), F.count_if(~valid).alias("skipped"))


class ProgressListener(StreamingQueryListener):
    """Calls ``report(generated, skipped)`` with running totals after every micro-batch of the stream ``name``.

    The name is that of ``with_metrics``, or of the query itself. ``dropped`` counts what its stateful operators
    left out as older than the watermark: rows, or for aggregations what is left of them after the partial one. ``state_rows``
    is the size of its state after the last micro-batch.
    """

    def __init__(self, name: str, report=lambda generated, skipped: None):
        self.name, self.report, self.generated, self.skipped = name, report, 0, 0
        self.dropped = self.state_rows = self.batches = 0
        self.ended = threading.Event()

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        metrics = event.progress.observedMetrics.get(self.name)
        if metrics or event.progress.name == self.name:
            self.batches += 1
            self.dropped += sum(o.numRowsDroppedByWatermark for o in event.progress.stateOperators)
            self.state_rows = sum(o.numRowsTotal for o in event.progress.stateOperators)
        if metrics:
            self.generated += metrics["generated"]
            self.skipped += metrics["skipped"]
            self.report(self.generated, self.skipped)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.ended.set()


@contextmanager
def listening(spark: SparkSession, name: str) -> Iterator[ProgressListener]:
    """A listener for the stream ``name``, to be started and awaited inside; its totals are final on leaving."""
    listener = ProgressListener(name)
    spark.streams.addListener(listener)
    try:
        yield listener
        listener.ended.wait()
    finally:
        spark.streams.removeListener(listener)


def run_stream(df: DataFrame, path: str, checkpoint: str, file_format: str = "text", name: str | None = None, **trigger) -> StreamingQuery:
    """Write a stream's rows durably, each once; a restart goes on after the last finished micro-batch."""
    writer = df.writeStream.format(file_format).option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.queryName(name) if name else writer
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def stream_to_jsonl(rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write the valid lines of a stream as JSON lines."""
    return run_stream(rows.filter(F.col("status") == VALID).select("raw"), path, checkpoint, "text", **trigger)

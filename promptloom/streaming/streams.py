"""Streaming twins of the ordered operators.

Each keeps a small state per key: the last status, the last time, or the last N word sets. Rows of a
micro-batch are put in order inside their key; across micro-batches the order of arrival counts. The
rows of one key handled at once are bounded by what a micro-batch admits
(``maxFilesPerTrigger`` or ``maxBytesPerTrigger`` on the source).

With ``forget_seconds`` a timer removes the state of a key once the newest event times have left its last row that far behind, so the state levels off at the keys
of that time; a key that comes back later starts anew, and rows older than the newest one of earlier micro-batches are late and dropped. Without it keys are kept for ever.
"""
from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from promptloom.functions.similarity import word_hashes
from promptloom.operators.circuit import MAX_FAILURES, RESET_SECONDS, step
from promptloom.operators.status import TERMINAL, is_terminal
from promptloom.sources import scan, sinks
from promptloom.sources.documents import elements as documents_of
from promptloom.streaming import runner


def stream_table(spark: SparkSession, path: str, schema: T.StructType | str, max_files: int | None = None) -> DataFrame:
    """New parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def _text_stream(spark: SparkSession, path: str, glob: str, line_end: str, max_files: int | None, max_bytes: int | None) -> DataFrame:
    reader = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("lineSep", line_end)
    bound = {"maxFilesPerTrigger": max_files, "maxBytesPerTrigger": max_bytes}
    return reader.options(**{name: value for name, value in bound.items() if value}).text(path)


def stream_inputs(spark: SparkSession, path: str, out: str, checkpoint: str, documents: str = "*.json", lines: str = "*.jsonl",
                  max_files: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Work off the prompt files that came since the last call and return all records so far: file_path, file_name, idx and line.

    JSON arrays and objects (``documents``) and JSON Lines (``lines``) are told apart by name, as ``scan.scan_inputs`` does. A file is part of one micro-batch, in which it is cut
    and numbered as the batch reader does; a micro-batch that is repeated after a failure replaces its own output, so every record is there once.
    A micro-batch has a cost of its own: bound it by ``max_bytes`` where files are many and small, else their number decides how many micro-batches there are. Spark takes one of the two bounds.
    """
    def of_documents(batch: DataFrame) -> DataFrame:
        return documents_of(batch).select("file_path", "file_name", "block_start", "row_id", "line")

    def of_lines(batch: DataFrame) -> DataFrame:
        return batch.where(F.col("value").rlike(r"\S")).select(
            "file_path", "file_name", "block_start", F.monotonically_increasing_id().alias("row_id"), F.col("value").alias("line"))

    for kind, glob, line_end, cut in (("documents", documents, ",", of_documents), ("lines", lines, "\n", of_lines)):
        text = _text_stream(spark, path, glob, line_end, max_files, max_bytes).select("value", *scan.source_columns())
        runner.drain_batches(text, f"{out}/{kind}", f"{checkpoint}/{kind}", lambda batch, cut=cut: scan.with_position(cut(batch)).select(
            "file_path", "file_name", "idx", "line"))
    kinds = "file_path string, file_name string, idx bigint, line string"
    return runner.read_batches(spark, f"{out}/documents", kinds).unionByName(runner.read_batches(spark, f"{out}/lines", kinds))


def _in_order(frames: Iterator[pd.DataFrame], columns: list[str]) -> list[tuple]:
    """Rows of one key as tuples sorted by their first fields; cheaper than frames for the usual few rows."""
    return sorted(row for frame in frames for row in zip(*(frame[c].tolist() for c in columns)))


def _stateful(df: DataFrame, keys: list[str], run: Callable, output: str, state: str, forget_seconds: int | None, micros: str = "us") -> DataFrame:
    """``run`` per key and micro-batch; with ``forget_seconds`` the state ends that long after the key's last row."""
    if forget_seconds is None:
        return df.groupBy(*keys).applyInPandasWithState(run, output, state, "append", GroupStateTimeout.NoTimeout)

    def timed(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        if kept.hasTimedOut:
            kept.remove()
            return
        newest = 0

        def seen() -> Iterator[pd.DataFrame]:
            nonlocal newest
            for frame in frames:
                newest = max(newest, int(frame[micros].max()))
                yield frame
        yield from run(key, seen(), kept)
        kept.setTimeoutTimestamp(max(newest // 1000 + forget_seconds * 1000, kept.getCurrentWatermarkMs() + 1))

    marked = df.withColumn("event_time", F.timestamp_micros(micros)).withWatermark("event_time", "0 seconds")
    return marked.groupBy(*keys).applyInPandasWithState(timed, output, state, "append", GroupStateTimeout.EventTimeTimeout)


def stream_status_changes(df: DataFrame, forget_seconds: int | None = None) -> DataFrame:
    """From ``job_id, event_id, us, status`` the rows whose status is new for their job."""
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, last, changed = state.exists, state.get[0] if state.exists else None, []
        for us, event_id, status in _in_order(frames, ["us", "event_id", "status"]):
            if not seen or status != last:
                changed.append((event_id, key[0], us, status, last))
            seen, last = True, status
        state.update((last,))
        if changed:
            yield pd.DataFrame(changed, columns=["event_id", "job_id", "us", "status", "previous_status"])

    return _stateful(df.select("job_id", "event_id", "us", "status"), ["job_id"], run,
                     "event_id bigint, job_id bigint, us bigint, status string, previous_status string",
                     "status string", forget_seconds)


def stream_latest_status(df: DataFrame, span: str | None = None, late: str = "0 seconds") -> DataFrame:
    """The newest status of each job, for an update sink: a micro-batch reports the jobs whose status it changed.

    With ``span`` jobs are kept by stretches of event time of that length, and stretches that the newest event times have left behind by ``late`` are forgotten.
    """
    newest = F.max_by(F.struct("us", "event_id", "status"), F.struct("us", "event_id")).alias("newest")
    if span is None:
        return df.groupBy("job_id").agg(newest).select("job_id", "newest.*")
    timed = df.withColumn("event_time", F.timestamp_micros("us")).withWatermark("event_time", late)
    return timed.groupBy("job_id", F.window("event_time", span)).agg(newest).select("job_id", "newest.*")


def current_status(snapshots: DataFrame) -> DataFrame:
    """Latest snapshot of each job."""
    return snapshots.groupBy("job_id").agg(F.max_by("status", F.struct("us", "event_id")).alias("status"))


def stream_terminal_jobs(df: DataFrame, terminal: tuple[str, ...] = TERMINAL, forget: str | None = None) -> DataFrame:
    """Jobs that ended, once each; with ``forget`` a job is remembered that long after it ended."""
    ended = df.where(is_terminal(F.col("status"), terminal))
    if forget is None:
        return ended.select("job_id").dropDuplicates(["job_id"])
    timed = ended.select("job_id", F.timestamp_micros("us").alias("event_time")).withWatermark("event_time", forget)
    return timed.dropDuplicatesWithinWatermark(["job_id"]).select("job_id")


def stream_similarity(df: DataFrame, n: int, threshold: float, forget_seconds: int | None = None) -> DataFrame:
    """From ``task, seq, text`` the best word-set score among the previous ``n`` of the task; ``forget_seconds`` needs a time ``us`` as well."""
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = [set(words) for words in state.get[0]] if state.exists else []
        scored = []
        for seq, words in _in_order(frames, ["seq", "words"]):
            own = set(words)
            scores = [len(own & old) / len(own | old) if own or old else 1.0 for old in recent]
            best = max(scores, default=0.0)
            scored.append((key[0], seq, best, best >= threshold))
            recent = [*recent, own][-n:]
        state.update(([[int(w) for w in words] for words in recent],))
        yield pd.DataFrame(scored, columns=["task", "seq", "max_score", "is_similar"])

    words = df.select("task", "seq", word_hashes(F.col("text")).alias("words"), *([] if forget_seconds is None else ["us"]))
    return _stateful(words, ["task"], run, "task string, seq bigint, max_score double, is_similar boolean",
                     "recent array<array<bigint>>", forget_seconds)


def stream_cooldown(df: DataFrame, cooldown: int, forget_seconds: int | None = None) -> DataFrame:
    """From ``job_id, event_id, us`` the whole seconds to wait before each row."""
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waits = state.get[0] if state.exists else None, []
        for us, event_id in _in_order(frames, ["us", "event_id"]):
            left = 0 if last is None else max(0, cooldown * 1_000_000 - (us - last))
            waits.append((event_id, key[0], us, left // 1_000_000, left > 0))
            last = us
        state.update((last,))
        yield pd.DataFrame(waits, columns=["event_id", "job_id", "us", "remaining", "should_wait"])

    return _stateful(df.select("job_id", "event_id", "us"), ["job_id"], run,
                     "event_id bigint, job_id bigint, us bigint, remaining bigint, should_wait boolean", "us bigint", forget_seconds)


def stream_circuit(df: DataFrame, max_failures: int = MAX_FAILURES, reset_seconds: int = RESET_SECONDS) -> DataFrame:
    """From ``provider, call_id, us, ok`` what happened to each call and whether the circuit is open after it."""
    reset_us = reset_seconds * 1_000_000

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, opened = state.get if state.exists else (0, None)
        labelled = []
        for us, call_id, ok in _in_order(frames, ["us", "call_id", "ok"]):
            failures, opened, outcome = step(failures, opened, us, ok, max_failures, reset_us)
            labelled.append((key[0], call_id, outcome, opened is not None))
        state.update((failures, opened))
        yield pd.DataFrame(labelled, columns=["provider", "call_id", "outcome", "is_open"])

    return _stateful(df.select("provider", "call_id", "us", "ok"), ["provider"], run,
                     "provider string, call_id bigint, outcome string, is_open boolean", "failures bigint, opened bigint", None)


def stream_cache_dedup(df: DataFrame, ttl_seconds: int, slices: int = 256) -> DataFrame:
    """From ``cache_key, event_id, us`` the rows that are not repeats within the time to live.

    Keys are many and have few rows each, so the state is kept per hash slice of keys: last use of
    every key that can still be repeated. Choose ``slices`` so that one holds some hundreds of live keys. A
    row further behind the newest one than the time to live may find its key forgotten.
    """
    ttl_us = ttl_seconds * 1_000_000

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, fresh = json.loads(state.get[0]) if state.exists else {}, []
        for us, event_id, name in _in_order(frames, ["us", "event_id", "cache_key"]):
            if name not in last or us - last[name] > ttl_us:
                fresh.append((name, event_id, us))
            last[name] = max(us, last.get(name, us))
        oldest = state.getCurrentWatermarkMs() * 1000 - ttl_us
        state.update((json.dumps({name: us for name, us in last.items() if us >= oldest}),))
        if fresh:
            yield pd.DataFrame(fresh, columns=["cache_key", "event_id", "us"])

    timed = df.select("cache_key", "event_id", "us", F.timestamp_micros("us").alias("event_time"),
                      F.pmod(F.xxhash64("cache_key"), F.lit(slices)).alias("slice"))
    return _stateful(timed.withWatermark("event_time", "0 seconds"), ["slice"], run,
                     "cache_key string, event_id bigint, us bigint", "last string", None)


def stream_run_log(df: DataFrame, **fields: Column) -> DataFrame:
    """Log rows of a stream of status records with all fields of ``sinks.log_rows``, ready for an append sink."""
    return sinks.log_rows(df, **fields)

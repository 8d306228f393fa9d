"""Streams over the given tables: two slices arrive one after the other, the result is read as a table."""
from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.functions import times as T
from promptloom.functions import variants as V
from promptloom.plans import fixtures as X
from promptloom.plans import order_queries
from promptloom.plans.registry import CHECKS, query
from promptloom.sources import sinks, workspace
from promptloom.streaming import runner
from promptloom.streaming import streams as S


#: No event of the given month is older: state is kept as long as results need it.
MONTH_SECONDS = 31 * 86_400
#: Bytes of text that arrive at once, where a key may hold most of them.
ARRIVAL_BYTES = 256 << 20
#: JSON arrays of the input folder, and what a micro-batch takes of the folder.
ARRAY_BYTES, BATCH_BYTES = 4 << 20, 256 << 20


def _arrivals(rows: DataFrame, order: str, text: str) -> Iterator[DataFrame]:
    """``rows`` in stretches of about ``ARRIVAL_BYTES`` of ``text``, one after the other by ``order``."""
    size = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    if size <= ARRIVAL_BYTES:
        yield rows
        return
    count = -(-size // ARRIVAL_BYTES)
    path = workspace.new_path(rows.sparkSession, "arrivals")
    rows.repartitionByRange(count, order).withColumn("stretch", F.spark_partition_id()).write.partitionBy("stretch").parquet(path)
    for k in range(count):
        if workspace.exists(rows.sparkSession, f"{path}/stretch={k}"):
            yield rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/stretch={k}")


def in_slices(rows: DataFrame, late: Column, make: Callable[[DataFrame], DataFrame], mode: str = "append",
              bounded: tuple[str, str] | None = None) -> DataFrame:
    """Run ``make`` on a stream of ``rows``: those not ``late`` arrive first, then the others.

    ``bounded`` names a column to arrive by and a text column whose bytes bound what arrives at once: a micro-batch hands all rows of a key to one task.
    """
    spark = rows.sparkSession
    base = workspace.new_path(spark, "stream")
    stream = None
    late = F.coalesce(late, F.lit(False))  # a row without a time comes with the first
    slices = (rows.where(part) for part in (~late, late))
    for arriving in (slices if bounded is None else (some for part in slices for some in _arrivals(part, *bounded))):
        arriving.write.mode("append").parquet(f"{base}/in")
        stream = stream if stream is not None else make(S.stream_table(spark, f"{base}/in", rows.schema))
        if mode == "append":
            runner.drain(stream, f"{base}/out", f"{base}/checkpoint")
        else:
            runner.drain_batches(stream, f"{base}/out", f"{base}/checkpoint", mode=mode)
    return runner.read_output(spark, stream, f"{base}/out") if mode == "append" else runner.read_batches(spark, f"{base}/out", stream.schema)


def _events(spark, sf):
    return X.events(spark, sf).select("event_id", "job_id", "status", "us")


def _late():
    """Second half of January 2024, the month the events are from."""
    return F.col("us") >= 1_705_363_200_000_000


@query("stream_status_changes", CHECKS["status_changes"])
def stream_status_changes(spark, sf):
    return in_slices(_events(spark, sf), _late(), lambda s: S.stream_status_changes(s, MONTH_SECONDS))


@query("stream_latest_status", f"WITH {X.EVENTS} SELECT job_id, arg_max(status, (us, event_id)) AS status FROM ev GROUP BY job_id")
def stream_latest_status(spark, sf):
    return S.current_status(in_slices(_events(spark, sf), _late(), lambda s: S.stream_latest_status(s, "7 days"), "update"))


@query("stream_terminal_jobs", "SELECT DISTINCT user_id AS job_id FROM events WHERE event_type IN ('purchase', 'error')")
def stream_terminal_jobs(spark, sf):
    return in_slices(_events(spark, sf), _late(), lambda s: S.stream_terminal_jobs(s, ("purchase", "error"), "31 days"))


@query("stream_similarity", CHECKS["similarity_flag"].replace("SELECT * FROM", "SELECT task, seq, max_score, is_similar FROM"))
def stream_similarity(spark, sf):
    rows = order_queries.gappy(spark, sf).select("task", "seq", "text")
    flagged = in_slices(rows, F.col("seq") >= 3_000, lambda s: S.stream_similarity(s, 10, 0.8), bounded=("seq", "text"))
    return flagged.withColumn("max_score", F.round("max_score", 6))


@query("stream_cooldown", CHECKS["cooldown_remaining"])
def stream_cooldown(spark, sf):
    return in_slices(_events(spark, sf), _late(), lambda s: S.stream_cooldown(s, 20_000, MONTH_SECONDS)).select(
        "event_id", "job_id", "us", "remaining", "should_wait")


@query("stream_circuit", CHECKS["circuit_state"])
def stream_circuit(spark, sf):
    calls = _events(spark, sf).select(F.col("job_id").cast("string").alias("provider"), F.col("event_id").alias("call_id"),
                                      "us", (F.col("status") != "error").alias("ok"))
    return in_slices(calls, _late(), lambda s: S.stream_circuit(s, 2, 86_400))


@query("stream_cache_dedup", f"""WITH {X.EVENTS}, a AS (SELECT job_id || '_' || status AS cache_key, event_id, us,
    us - lag(us) OVER (PARTITION BY job_id, status ORDER BY us, event_id) AS age FROM ev)
  SELECT cache_key, event_id, us FROM a WHERE age IS NULL OR age > 86400000000""")
def stream_cache_dedup(spark, sf):
    rows = _events(spark, sf).select(F.concat_ws("_", F.col("job_id").cast("string"), "status").alias("cache_key"), "event_id", "us")
    return in_slices(rows, _late(), lambda s: S.stream_cache_dedup(s, 86_400))


@query("stream_run_log", """SELECT epoch_us(ts) AS us, 'run' AS logger_name, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, 'job ' || event_type AS message,
    event_type AS module, 'poll' AS function, (event_id % 500)::INT AS line_number, props AS extra_data FROM events""")
def stream_run_log(spark, sf):
    level = F.when(F.col("status") == "error", "ERROR").otherwise("INFO")
    log = in_slices(X.events(spark, sf), _late(), lambda s: S.stream_run_log(
        s, ts=F.col("ts"), logger=F.lit("run"), level=level, message=F.concat(F.lit("job "), F.col("status")), module=F.col("status"), function=F.lit("poll"),
        line=F.col("event_id") % 500, extra=F.col("props")))
    return log.select(T.epoch_micros(F.col("timestamp")).alias("us"), *[c for c in log.columns if c != "timestamp"])


@query("stream_inputs", f"""WITH {X.PROMPTS} SELECT doc_id, input_text, CASE WHEN doc_id % 2 = 0 THEN 'array' ELSE 'line' END AS kind FROM prompts""")
def stream_inputs(spark, sf):
    """JSON arrays and JSON Lines that arrive in two steps, worked off by two runs with one checkpoint."""
    base = workspace.new_path(spark, "inputs")
    rows = workspace.materialize(X.prompts(spark, sf).select("file", "idx", "doc_id", "input_text"), "prompts")
    rows = rows.withColumn("line", F.to_json(F.struct("doc_id", "input_text")))
    found = None
    for step in (0, 1):
        some = rows.where(F.floor(F.col("doc_id") / 2) % 2 == step)
        sinks.write_raw_responses(some.where("doc_id % 2 = 0").withColumn("file", F.concat("file", F.lit(f"-{step}"))), f"{base}/in/arrays", "file", "idx", "line", ARRAY_BYTES)
        some.where("doc_id % 2 = 1").select("doc_id", "input_text").write.mode("append").json(f"{base}/in/lines")
        found = S.stream_inputs(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", "*_raw_response.json", "part-*.json", max_bytes=BATCH_BYTES)
    item = V.parse(F.col("line"))
    return found.select(V.get(item, "$.doc_id", "bigint").alias("doc_id"), V.get(item, "$.input_text").alias("input_text"),
                        F.when(F.col("file_name").endswith(sinks.RAW_SUFFIX), "array").otherwise("line").alias("kind"))

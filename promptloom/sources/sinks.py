"""Writing rows as JSON Lines, JSON arrays, raw, formatted and parsed outputs, snapshots and logs."""
from __future__ import annotations

import os
import re
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptloom.functions import names as N
from promptloom.operators import ordered
from promptloom.operators.responses import NO_CONTENT
from promptloom.sources import workspace

BYTES_PER_DOCUMENT = 128 << 20
RAW_SUFFIX = "_raw_response.json"
# Fixed by Spark: what ``partitionBy`` escapes in the name of a folder, and the name of a folder without a value.
_ESCAPED = re.compile("[\x01-\x1f\x7f\"#%'*/:=?\\\\{\\[\\]^]")
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def write_jsonl(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """One JSON object per line, optionally a folder per value of ``by``."""
    writer = df.write.option("ignoreNullFields", "false")
    writer.partitionBy(*by).json(path) if by else writer.json(path)


def write_tree(df: DataFrame, path: str, by: Sequence[str], line: str, tasks: int) -> None:
    """A text file a folder, below folders ``name=value`` as ``partitionBy`` names them, written by ``tasks`` tasks.

    Folders cost far more than their bytes. In a mounted store (``file:``) Hadoop starts a process for the mode of each folder and file, six a line of this tree, so the tasks write there
    themselves; a task that runs again replaces its own files. Other stores are written by Spark.
    """
    spread = df.select(*by, line).repartition(tasks, *by)
    root = workspace.mounted(df.sparkSession, path)
    if root is None:
        spread.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(*by).text(path)
        return
    run_id = uuid.uuid4().hex

    def write(batches):
        name, held, out, files = f"part-{TaskContext.get().partitionId():05d}-{run_id}.txt", None, None, 0
        try:
            for batch in batches:
                for *values, text in zip(*(column.to_pylist() for column in batch.columns)):
                    if out is None or values != held:
                        if out is not None:
                            out.close()
                        folder = os.path.join(root, *(f"{k}={_ESCAPED.sub(lambda c: f'%{ord(c[0]):02X}', v) if v else _NO_VALUE}" for k, v in zip(by, values)))
                        os.makedirs(folder, exist_ok=True)
                        held, out, files = values, open(os.path.join(folder, name), "wb"), files + 1
                    out.write(f"{text or ''}\n".encode())
        finally:
            if out is not None:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    rows = spread.select(*(F.col(c).cast("string").alias(c) for c in by), line).sortWithinPartitions(*by)
    rows.mapInArrow(write, "files long").agg(F.sum("files")).collect()


def json_array_lines(df: DataFrame, file: str, idx: str, line: str, rows_per_document: int | None = None,
                     bytes_per_document: int = BYTES_PER_DOCUMENT) -> DataFrame:
    """Rows of each file as consecutive JSON array documents of bounded size, one element per line.

    ``document`` numbers the arrays of a file; a row carries the opening or closing bracket
    when it is the first or last of its array. A document holds the elements that begin in the same stretch of ``bytes_per_document`` bytes of its file, or
    ``rows_per_document`` rows each.
    """
    slim = df.select(file, idx, line)
    if rows_per_document:
        numbered = slim.withColumn("document", F.floor(F.col(idx) / rows_per_document).cast("bigint"))
    else:
        size = F.octet_length(line) + 2
        placed = ordered.running_sums(slim.withColumn("__size", size.cast("bigint")), [file], [idx], {"__upto": "__size"})
        numbered = placed.withColumn("document", F.floor((F.col("__upto") - F.col("__size")) / bytes_per_document).cast("bigint")).drop("__upto", "__size")
    inside = Window.partitionBy(file, "document").orderBy(idx)
    first, last = F.lag(idx).over(inside).isNull(), F.lead(idx).over(inside).isNull()
    text = F.concat(F.when(first, F.lit("[")).otherwise(F.lit("")), F.col(line),
                    F.when(last, F.lit("]")).otherwise(F.lit(",")))
    return numbered.withColumn("value", text).drop(line)


def write_json_array(df: DataFrame, path: str, file: str, idx: str, line: str, rows_per_document: int | None = None,
                     bytes_per_document: int = BYTES_PER_DOCUMENT) -> None:
    """Folder per file and document; every document is a valid JSON array of bounded size, in a file of its own."""
    lines = json_array_lines(df, file, idx, line, rows_per_document, bytes_per_document)
    # The window has already put each document into one task.
    (lines.sortWithinPartitions(file, "document", idx)
     .select(file, "document", "value").write.partitionBy(file, "document").text(path))


def write_raw_responses(df: DataFrame, path: str, name: str, idx: str, line: str, bytes_per_document: int = BYTES_PER_DOCUMENT) -> int:
    """JSON array files ``<name>_raw_response.json`` that ``scan.scan_raw_responses`` reads; returns their number.

    A name with more than ``bytes_per_document`` bytes gets further files, ``<name>_part1_raw_response.json`` and so on. Files are written below a hidden folder by Spark and
    named when all of them are complete; naming moves no data.
    """
    spark = df.sparkSession
    staging = f"{path.rstrip('/')}/_staging-{uuid.uuid4().hex}"
    write_json_array(df.select(F.col(name).alias("name"), idx, line), staging, "name", idx, line, bytes_per_document=bytes_per_document)
    written = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(staging).select("path")

    def give_name(found: str) -> None:
        where = found.split("/")
        folder, number = unquote(where[-3].removeprefix("name=")), where[-2].removeprefix("document=")
        workspace.rename(spark, found, f"{path.rstrip('/')}/{folder}{'' if number == '0' else '_part' + number}{RAW_SUFFIX}")

    total = 0
    with ThreadPoolExecutor(16) as pool:
        # One name a file of up to 128 MB, taken from the driver's listing a partition at a time.
        for _ in pool.map(give_name, (row.path for row in written.toLocalIterator())):
            total += 1
    workspace.remove(spark, staging)
    return total


def content_rows(df: DataFrame, content: Column, keep: Sequence[str] = ()) -> DataFrame:
    """Parsed output: the answer text alone."""
    return df.select(*keep, content.alias("content"))


def write_outputs(answers: DataFrame, path: str, raw: str, triple: Sequence[str], keep: Sequence[str]) -> None:
    """Raw, formatted and parsed outputs of one answer table, which is evaluated only once.

    A row without an answer is written as well: its triple says ``error`` and carries the reason as its answer.
    """
    answers.write.parquet(f"{path}/raw")
    stored = answers.sparkSession.read.parquet(f"{path}/raw")
    *asked, answer = triple
    failed = F.col(raw).isNull() | F.col(answer).isNull()
    told = stored.withColumns({
        **{name: F.when(failed, F.lit("error")).otherwise(F.col(name)) for name in asked},
        answer: F.when(failed, F.lit(NO_CONTENT)).otherwise(F.col(answer))})
    told.select(*keep, *triple).write.json(f"{path}/formatted")
    content_rows(told, F.col(answer), keep).write.json(f"{path}/parsed")


def per_item_names(df: DataFrame, file: str, task: Column) -> DataFrame:
    """Name of the single-answer output of each row, as a column of one table."""
    return df.withColumn("result_name", N.result_filename(F.col(file), task, F.lit(1)))


def write_combined(df: DataFrame, path: str, file: str, position: str, content: str) -> None:
    """Contents of all batches of a file, in order, below one folder per file."""
    (df.repartitionByRange(file, position).sortWithinPartitions(file, position)
     .select(file, F.col(content).alias("content")).write.partitionBy(file).json(path))


def snapshot_inputs(df: DataFrame, path: str, stamp: str) -> None:
    """Copy of the inputs as they were, below their time stamp."""
    df.withColumn("snapshot_ts", F.lit(stamp)).write.mode("append").partitionBy("snapshot_ts").parquet(path)


def log_rows(df: DataFrame, ts: Column, logger: Column, level: Column, message: Column, module: Column,
             function: Column, line: Column, extra: Column) -> DataFrame:
    return df.select(
        ts.alias("timestamp"), logger.alias("logger_name"), level.alias("level"), message.alias("message"),
        module.alias("module"), function.alias("function"), line.cast("int").alias("line_number"),
        extra.alias("extra_data"))


def append_run_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)

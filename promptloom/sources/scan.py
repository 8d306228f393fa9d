"""Reading prompt, response, config and task files as tables."""
from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptloom.functions import names as N
from promptloom.functions import variants as V
from promptloom.operators import joins
from promptloom.operators.config import CONFIG_SCHEMA
from promptloom.sources import documents, workspace

RAW_RESPONSES = "*_raw_response.json"
# Tasks a core, where a folder or file costs far more than its bytes.
LISTERS = 2
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def _with_source(df: DataFrame) -> DataFrame:
    return df.select("*", F.col("_metadata.file_path").alias("file_path"),
                     F.col("_metadata.file_name").alias("file_name"),
                     F.col("_metadata.file_block_start").alias("block_start"))


def _reader(spark: SparkSession, glob: str | None):
    reader = spark.read.option("recursiveFileLookup", "true")
    return reader.option("pathGlobFilter", glob) if glob else reader


def scan_jsonl(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One row per line that is not blank: the text, its place, and the VARIANT (null when broken).

    Files are split, so a large file is read by many tasks.
    """
    lines = _with_source(_reader(spark, glob).text(path)).where(F.col("value").rlike(r"\S"))
    return lines.select("file_path", "file_name", "block_start",
                        F.monotonically_increasing_id().alias("row_id"),
                        F.col("value").alias("line"), V.parse(F.col("value")).alias("item"))


def source_columns() -> list[Column]:
    """Where a row of text comes from, as ``documents.elements`` wants it."""
    about = {"file_path": "file_path", "file_name": "file_name", "block_start": "file_block_start", "file_size": "file_size"}
    return [*[F.col(f"_metadata.{old}").alias(new) for new, old in about.items()], (F.col("_metadata.file_block_length") < F.col("_metadata.file_size")).alias("several")]


def _may_split(spark: SparkSession, path: str, glob: str | None) -> bool:
    """Whether Spark may cut a file into several splits, from the files' sizes alone; it never cuts one of at most its cost to open a file."""
    largest = _reader(spark, glob).format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0
    settings = spark._jsparkSession.sessionState().conf()
    return largest > min(settings.filesOpenCostInBytes(), settings.filesMaxPartitionBytes())


def scan_json(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One row per element of a JSON array file, one row for an object file, none for a blank file.

    A file is read by as many tasks as it has splits (see ``documents``); only a single element has to fit into a row and a VARIANT. A document that is not JSON stops the job.
    """
    text = _reader(spark, glob).option("lineSep", ",").text(path).select("value", *source_columns())
    broken = F.raise_error(F.concat("file_path", F.lit(" is not one JSON document: an element cannot be read")))
    item = V.let(V.parse(F.col("line")), lambda value: F.when(value.isNull() & (F.col("line") != "null"), broken).otherwise(value))
    return documents.elements(text, _may_split(spark, path, glob)).select("file_path", "file_name", "block_start", "row_id", item.alias("item"), "line")


def scan_inputs(spark: SparkSession, path: str, documents: str = "*.json", lines: str = "*.jsonl") -> DataFrame:
    """Every JSON document and JSON Lines file below a folder as one table, told apart by their names."""
    return scan_json(spark, path, documents).unionByName(scan_jsonl(spark, path, lines))


def with_position(df: DataFrame, file: str = "file_path", parts: Sequence[str] = ()) -> DataFrame:
    """Add ``idx``, the 0-based place of each row in its file.

    ``file`` may be a column that names a logical file written as several documents; ``parts`` are then the columns that
    order its documents, such as the ``document`` folder of ``sinks.write_json_array``.

    Row ids grow by one inside a split, so only the row count and first id of each split are
    needed: the rows are not shuffled or sorted, even when one file holds most of them. The split table is
    stored, so the files are read once for it and once for the rows.
    """
    of = list(dict.fromkeys([file, *parts, "file_path", "block_start"]))
    splits = workspace.materialize(df.groupBy(*of).agg(
        F.count("*").alias("__n"), F.min("row_id").alias("__first")), "splits")
    earlier = Window.partitionBy(file).orderBy(*of[1:]).rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("file_path", "block_start", "__first",
                           F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    placed = df.join(F.broadcast(starts) if joins.is_small(splits, documents.STATE_ROWS, documents.STATE_BYTES) else starts, ["file_path", "block_start"], "left")
    idx = F.col("row_id") - F.col("__first") + F.col("__start")
    return placed.withColumn("idx", F.when(idx.isNull(), F.raise_error(F.lit(documents.CHANGED)).cast("bigint"))
                             .otherwise(idx)).drop("__first", "__start")


def scan_raw_responses(spark: SparkSession, path: str, glob: str = RAW_RESPONSES) -> DataFrame:
    """Elements of all ``*_raw_response.json`` files."""
    return scan_json(spark, path, glob)


@contextmanager
def _listing(spark: SparkSession):
    """Spark lists folders by a task each, which costs far more than the listing; here by ``LISTERS`` tasks a core. Files are listed when a reader is loaded."""
    before = spark.conf.get(_LISTING, None)
    spark.conf.set(_LISTING, str(LISTERS * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.unset(_LISTING) if before is None else spark.conf.set(_LISTING, before)


def scan_config(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Config files as the typed tree; keys the schema does not know are ignored."""
    reader = _reader(spark, glob).schema(CONFIG_SCHEMA).option("multiLine", "true")
    with _listing(spark):
        files = reader.json(path)
    return files.select("*", F.col("_metadata.file_path").alias("file_path"))


def scan_tasks(spark: SparkSession, path: str, glob: str | None = "config.json") -> DataFrame:
    """Task catalogue of a folder tree ``<user>/<task folder>/config/<config file>``.

    ``name=`` in front of a folder, as partitioned tables have it, is ignored. Spark reads a few small files a task; its partitions are put together, so that tasks and the files of the result grow
    with the cluster and not with the tree.
    """
    folder = F.regexp_replace(F.regexp_replace("file_path", "/[^/]*config/[^/]*$", ""), "/[^/=]+=", "/")
    tasks = scan_config(spark, path, glob).select(folder.alias("path"), F.col("task_name").alias("config_task_name"))
    parsed = N.parse_task_path(F.col("path"))
    return tasks.coalesce(LISTERS * spark.sparkContext.defaultParallelism).select(
        "path", parsed["user_id"].alias("user_id"), parsed["api_name"].alias("api_name"),
        F.coalesce(F.nullif(parsed["task_name"], F.lit("unknown")), "config_task_name",
                   F.lit("unknown")).alias("task_name"),
        parsed["created_at"].alias("created_at"))

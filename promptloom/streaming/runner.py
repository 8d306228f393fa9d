"""Starting streams that work off what is there and stop, with file output and a checkpoint."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from promptloom.sources import workspace


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available and append the result to ``path`` exactly once.

    Started again with the same checkpoint it goes on where it stopped.
    """
    query = (stream.writeStream.format("parquet").option("path", path)
             .option("checkpointLocation", checkpoint).outputMode("append")
             .trigger(availableNow=True).start())
    query.awaitTermination()


def read_output(spark: SparkSession, stream: DataFrame, path: str) -> DataFrame:
    """What the stream has written so far, as a table."""
    return spark.read.schema(stream.schema).parquet(path)


def drain_batches(stream: DataFrame, path: str, checkpoint: str, make: Callable[[DataFrame], DataFrame] | None = None, mode: str = "append") -> None:
    """Process everything available; what ``make`` gives for a micro-batch is one folder below ``path``, which a repeated micro-batch replaces."""
    def write(batch: DataFrame, number: int) -> None:
        (make(batch) if make else batch).write.mode("overwrite").parquet(f"{path}/batch-{number}")

    query = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def read_batches(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """What ``drain_batches`` has written so far; no rows before the first micro-batch."""
    if not workspace.exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)

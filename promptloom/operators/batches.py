"""Splitting numbered inputs into batches and putting batch results together again.

``idx`` is the dense position of a row in its file, so batch number and place in the batch are
arithmetic: no window and no shuffle, however large one file is.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.operators import ordered
from promptloom.operators.prompts import CHAT_ENDPOINT, COMPLETION_WINDOW


def split_batches(df: DataFrame, size: int, idx: str = "idx") -> DataFrame:
    batch = F.floor(F.col(idx) / size).cast("bigint")
    return df.withColumns({
        "batch_no": batch,
        "batch_id": F.format_string("batch_%04d", batch),
    })


def number_in_batch(df: DataFrame, size: int, idx: str = "idx") -> DataFrame:
    place = (F.col(idx) % size).cast("bigint")
    return df.withColumns({
        "idx_in_batch": place,
        "custom_id": F.concat(F.lit("request_"), place.cast("string")),
    })


def build_batch_line(custom_id: Column, body: Column, url: str = CHAT_ENDPOINT) -> Column:
    return F.struct(custom_id.alias("custom_id"), F.lit("POST").alias("method"),
                    F.lit(url).alias("url"), body.alias("body"))


def count_items(df: DataFrame, file: str = "file") -> DataFrame:
    return df.groupBy(file).agg(F.count("*").alias("items"))


def batch_manifest(df: DataFrame, size: int, file: str = "file") -> DataFrame:
    """Per file: items, number of batches, and size of the last batch."""
    items = F.col("items")
    batches = F.ceil(items / size).cast("bigint")
    return count_items(df, file).withColumns({
        "batches": batches, "last_size": items - (batches - 1) * size})


def build_batch_job(batched: DataFrame, file: str = "file") -> DataFrame:
    """One job record per batch of every file, from rows that know their batch."""
    return batched.groupBy(file, "batch_id").agg(F.count("*").alias("requests")).withColumns({
        "endpoint": F.lit(CHAT_ENDPOINT),
        "completion_window": F.lit(COMPLETION_WINDOW),
        "description": F.concat(F.lit("Batch processing for "), F.col(file), F.lit(" "), F.col("batch_id")),
    })


def combine_batches(df: DataFrame, file: str = "file") -> DataFrame:
    """Answers of all batches of a file in one order: adds ``position`` inside the file.

    The rows stay a table in file order; they are never gathered into one list per file.
    """
    return ordered.number_rows(df, [file], ["batch_no", "idx_in_batch"], "position")


def union_results(*parts: DataFrame) -> DataFrame:
    """All batches' results in one table."""
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result


def merge_by_name(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """One result per name; the latest by ``order`` wins."""
    rest = [c for c in df.columns if c != name]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("__newest")
    return df.groupBy(name).agg(newest).select(name, "__newest.*")


def result_summary(df: DataFrame, file: str = "file", error: str = "error") -> DataFrame:
    return df.groupBy(file).agg(
        F.count_if(F.col(error).isNull()).alias("success"),
        F.count_if(F.col(error).isNotNull()).alias("failed"))

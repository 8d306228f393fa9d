"""Job status: changes, progress, remaining time, and roll-ups."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.functions import times as T
from promptloom.operators import ordered

# A job with one of these does not change any more.
TERMINAL = ("completed", "failed", "expired", "cancelled")


def is_terminal(status: Column, terminal: Sequence[str] = TERMINAL) -> Column:
    return F.coalesce(status.isin(*terminal), F.lit(False))


def status_changes(df: DataFrame, job: str, order: Sequence[str], status: str) -> DataFrame:
    """Rows whose status differs from the one before in the same job; the first row always stays."""
    prev = ordered.previous_values(df.withColumn("__seen", F.lit(True)), [job], order,
                                   {"previous_status": status, "__before": "__seen"})
    changed = F.col("__before").isNull() | ~F.col(status).eqNullSafe(F.col("previous_status"))
    return prev.where(changed).drop("__seen", "__before")


def distinct_statuses(df: DataFrame, status: str) -> DataFrame:
    return df.select(status).distinct()


def batch_progress(df: DataFrame, job: str, done: Column) -> DataFrame:
    """Per job: rows done, rows in all, and whole percent."""
    sums = df.groupBy(job).agg(F.count_if(done).alias("done"), F.count("*").alias("total"))
    return sums.withColumn("progress", T.percent_text(F.col("done"), F.col("total")))


def batch_eta(snapshots: DataFrame, created_at: str, now: Column) -> DataFrame:
    """Add ``eta`` to snapshots that hold ``done`` and ``total``."""
    return snapshots.withColumn("eta", T.eta_text(F.col(created_at), now, F.col("done"), F.col("total")))


def job_duration(df: DataFrame, job: str, micros: str) -> DataFrame:
    return df.groupBy(job).agg(
        ((F.max(micros) - F.min(micros)) / F.lit(1e6)).alias("seconds"))


def rollup_status(df: DataFrame, task: str, ok: Column) -> DataFrame:
    """A task succeeds only when all of its parts did."""
    return df.groupBy(task).agg(
        F.when(F.bool_and(ok), F.lit("success")).otherwise("failed").alias("status"),
        F.count("*").alias("parts"))


def latest_status(df: DataFrame, job: str, order: Sequence[str], status: str) -> DataFrame:
    return df.groupBy(job).agg(F.max_by(status, F.struct(*order)).alias(status))

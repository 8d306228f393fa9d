"""Task catalogue: one row per task folder."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.functions import names as N
from promptloom.operators import joins, ordered

PENDING = "pending"
UNKNOWN = "unknown"
# The states of a task.
STATES = ("pending", "running", "success", "failed")


def catalogue(df: DataFrame, path: str) -> DataFrame:
    """Add user, api, task and creation time read from the folder path."""
    return df.withColumn("__task", N.parse_task_path(F.col(path))).select("*", "__task.*").drop("__task")


def number_tasks(df: DataFrame, user: str, name: Sequence[str]) -> DataFrame:
    """1-based number of each task of a user, by name."""
    return ordered.number_rows(df, [user], name, "number", start=1)


def latest_task(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row of each user and task name."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("__newest")
    return df.groupBy(*keys).agg(newest).select(*keys, "__newest.*")


def sort_tasks(df: DataFrame, name: Sequence[str], newest_first: bool = False) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() if newest_first else F.col(c).asc() for c in name])


def pick_task(numbered: DataFrame, k: Column) -> DataFrame:
    """The ``k``-th task of each user; users with fewer tasks give no row."""
    return numbered.where(F.col("number") == k)


def tasks_by_user(df: DataFrame, user: str, created: str) -> DataFrame:
    """Tasks per user with counts and first and last creation time; for the members see ``number_tasks``."""
    return df.groupBy(user).agg(F.count("*").alias("tasks"), F.min(created).alias("first_created"),
                                F.max(created).alias("last_created"))


def task_status_join(tasks: DataFrame, statuses: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Tasks with the optional status record and the optional name from their config."""
    with_status = tasks.join(statuses, key, "left")
    with_name = with_status.join(names, key, "left")
    status = F.when(F.col("status").isin(*STATES), F.col("status")).otherwise(PENDING)
    return with_name.withColumns({
        "status": status, "task_name": F.coalesce("task_name", "config_task_name", F.lit(UNKNOWN)),
    }).drop("config_task_name")


def task_by_path(wanted: DataFrame, tasks: DataFrame, path: str = "path") -> DataFrame:
    """Catalogue row of each wanted path; unknown paths give no row."""
    return tasks.join(wanted.select(path).distinct(), path, "left_semi")


def task_status(wanted: DataFrame, tasks: DataFrame, spread: Sequence[str], path: str = "path") -> DataFrame:
    """Status of each wanted path, ``unknown`` when there is no such task. ``tasks`` has one row per path."""
    known = tasks.select(path, "status")
    return joins.salted_join(wanted, known, [path], "left", spread).withColumn("status", F.coalesce("status", F.lit(UNKNOWN)))


def resolve_provider(df: DataFrame, registry: DataFrame, name: str, value: str, default: Column,
                     spread: Sequence[str]) -> DataFrame:
    """Provider registered under the row's name, the default for names nobody registered."""
    found = joins.lookup_join(df, registry.select(name, value), [name], "left", spread)
    return found.withColumn(value, F.coalesce(F.col(value), default))

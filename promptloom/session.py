"""Session settings the library is written for."""
from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A provider call is a side effect: never run the same task twice on purpose.
    "spark.speculation": "false",
}


def build_session(name: str = "promptloom", **extra: str) -> SparkSession:
    """A session with the library's settings; ``extra`` wins, dots written as ``__``."""
    builder = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cpus: int | None = None, **extra: str) -> SparkSession:
    """Single-machine session for tests and the benchmark."""
    cpus = cpus or os.cpu_count() or 4
    extra.setdefault("spark__sql__shuffle__partitions", str(cpus))
    extra.setdefault("spark__ui__enabled", "false")
    extra.setdefault("spark__ui__showConsoleProgress", "false")
    extra.setdefault("spark__driver__memory", "12g")
    return build_session(spark__master=f"local[{cpus}]", **extra)

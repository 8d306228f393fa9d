"""Where intermediate tables go: the shared folder the cluster names, nothing machine-local."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_WAREHOUSE = "spark.sql.warehouse.dir"


_made: set[str] = set()


def _own_folder(spark: SparkSession) -> str:
    """The folder of this application below the shared one, removed when the application ends."""
    folder = f"{shared_folder(spark)}/promptloom-{spark.sparkContext.applicationId}"
    if folder not in _made:
        store, path = _store(spark, folder)
        store.mkdirs(path)
        store.deleteOnExit(path)
        _made.add(folder)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """Folder from ``spark.checkpoint.dir``; the warehouse, which executors share too, where it is not set."""
    return (spark.conf.get(_SETTING, None) or spark.conf.get(_WAREHOUSE)).rstrip("/")


def _store(spark: SparkSession, folder: str):
    """Hadoop's view of a path: its file system and the path itself."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def mounted(spark: SparkSession, folder: str) -> str | None:
    """The folder as the operating systems of the cluster know it; none if it is in another store than theirs."""
    store, path = _store(spark, folder)
    return path.toUri().getPath() if store.getUri().getScheme() == "file" else None


def exists(spark: SparkSession, folder: str) -> bool:
    store, path = _store(spark, folder)
    return store.exists(path)


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Give a file its name; one that is there already is never replaced."""
    store, path = _store(spark, old)
    target = _store(spark, new)[1]
    if store.exists(target) or not store.rename(path, target):
        raise FileExistsError(f"cannot name {old} {new}")


def remove(spark: SparkSession, folder: str) -> None:
    store, path = _store(spark, folder)
    store.delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path below the shared folder, in a folder that goes when the application ends."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once and read back, so that side effects upstream happen once and lineage is cut."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

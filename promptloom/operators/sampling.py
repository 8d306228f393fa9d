"""Sampling records and files; every choice is a function of seed and key, so it can be repeated."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.operators import joins, ordered


def sample_head(df: DataFrame, n: int, idx: str = "idx") -> DataFrame:
    """First ``n`` records of every file."""
    return df.where(F.col(idx) < n)


def sample_records(df: DataFrame, n: int | Column, seed: str, file: str = "file", key: str = "key") -> DataFrame:
    """``n`` random records of every file that has more, all records otherwise.

    ``n`` may be a column, the same in all records of a file; where it is null or not above zero all records stay.
    """
    ranked = df.withColumn("__draw", F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))))
    if isinstance(n, Column):
        n = F.when(n > 0, n).otherwise(F.lit(2**62))
    return ordered.last_rows(ranked, [file], ["__draw", key], n).drop("__draw")


def sample_files(df: DataFrame, n: int, seed: str, file: str = "file") -> DataFrame:
    """All records of ``n`` random files."""
    draw = F.md5(F.concat(F.lit(seed), F.col(file)))
    chosen = df.select(file).distinct().orderBy(draw.desc(), F.col(file).desc()).limit(n)
    # At most n rows by construction.
    return df.join(F.broadcast(chosen), file, "left_semi") if n <= joins.SMALL_ROWS else \
        joins.salted_join(df, chosen, [file], "left_semi", [c for c in df.columns if c != file])

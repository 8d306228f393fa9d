"""Equi-joins against a table with one row per key, safe for hot keys on the probing side."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SETTING = "promptloom.join.hot.rows"
HOT_ROWS = 2_000_000
SMALL_ROWS_SETTING = "promptloom.join.small.rows"
SMALL_ROWS = 20_000

SAMPLED_ROWS = 2_000
LONE_SALTS = 1 << 20
SMALL_BYTES = 8 << 20

_SALT = "__salt"


def _setting(df: DataFrame, name: str, default: int) -> int:
    return int(df.sparkSession.conf.get(name, str(default)))


def is_small(df: DataFrame, max_rows: int | None = None, max_bytes: int = SMALL_BYTES) -> bool:
    """True when ``df`` is shown to hold at most ``max_rows`` rows and ``max_bytes`` bytes of JSON; reads no further than that."""
    limit = max_rows if max_rows is not None else _setting(df, SMALL_ROWS_SETTING, SMALL_ROWS)
    size = F.octet_length(F.to_json(F.struct("*")))
    seen = df.limit(limit + 1).select(size.alias("size")).agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    return seen.n <= limit and (seen.size or 0) <= max_bytes


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str,
                spread: Sequence[str]) -> DataFrame:
    """Join where keys with many left rows are spread over several salts.

    Keys above the hot limit are at most ``rows / limit`` many, so their list is small by
    arithmetic and can be broadcast. Only those keys of ``right`` are repeated, once per salt.
    ``spread`` names columns that differ between left rows of one key.
    """
    on = list(on)
    limit = _setting(left, HOT_SETTING, HOT_ROWS)
    # A key with a null has no partner: its rows need no common place and are spread as they come.
    lone = reduce(or_, [F.col(c).isNull() for c in on])
    # Keys are counted on a share of the rows that shows every key over the limit some thousand times; the share is a function of the row, so both sides see the same salts.
    share = max(1, limit // SAMPLED_ROWS)
    seen = left.where(~lone & (F.pmod(F.xxhash64(*on, *spread, F.lit(7)), F.lit(share)) == 0))
    hot = (
        seen.groupBy(*on).agg((F.count("*") * share).alias("__n")).where(F.col("__n") > (limit if share == 1 else 0.8 * limit))
        .select(*on, F.ceil(F.col("__n") / limit).cast("int").alias("__salts"))
    )
    salts = F.coalesce("__salts", F.lit(1))
    spread_left = left.join(F.broadcast(hot), on, "left").withColumn(
        _SALT, F.pmod(F.xxhash64(*spread), F.when(lone, LONE_SALTS).otherwise(salts)).cast("int")).drop("__salts")
    spread_right = right.join(F.broadcast(hot), on, "left").withColumn(
        _SALT, F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return spread_left.join(spread_right, [*on, _SALT], how).drop(_SALT)


def lookup_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str,
                spread: Sequence[str], max_rows: int | None = None) -> DataFrame:
    """Broadcast ``right`` when its size is proven small, otherwise a salted shuffle join."""
    if is_small(right, max_rows):
        return left.join(F.broadcast(right), list(on), how)
    return salted_join(left, right, on, how, spread)

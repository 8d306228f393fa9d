"""Row numbers, previous values, running totals and last rows that hold when one key owns a third of all rows.

Keys that fit into one task take a plain window: one shuffle by key. Keys with more rows or bytes than that are few by arithmetic (rows / limit). Their rows alone are
range-partitioned by ``(keys, order)`` and stored, so a range holds a bounded stretch of a key and a lost executor's work finds the same ranges. Windows run per
``(key, range)``, and what a range must know of earlier ones (a count, a last row, a sum) comes from one summary row per hot key and range, which is put in front of the
range as one more row. Summaries are scanned per key; there are about as many as ranges, whatever the number of keys.
"""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptloom.sources import workspace

ROWS_SETTING = "promptloom.range.rows"
ROWS_PER_RANGE = 1_000_000
BYTES_SETTING = "promptloom.range.bytes"
BYTES_PER_RANGE = 64 << 20

_RANGE = "__range"
_CARRY = "__carry"


def range_rows(df: DataFrame) -> int:
    """Rows that one task may hold of a key; the session setting lets tests use tiny ranges."""
    return int(df.sparkSession.conf.get(ROWS_SETTING, str(ROWS_PER_RANGE)))


def _row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row has: its texts and binaries, 8 for an array's element and for any other column."""
    sizes = []
    for field in df.schema:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            sizes.append(F.coalesce(F.octet_length(F.col(field.name)), F.lit(0)))
        elif isinstance(field.dataType, T.ArrayType):
            sizes.append(F.coalesce(8 * F.size(F.col(field.name)), F.lit(0)))
    return sum((s.cast("bigint") for s in sizes), F.lit(8 * len(df.columns)).cast("bigint"))


def _order_value(order: Sequence[str]) -> Column:
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def split_hot(df: DataFrame, keys: Sequence[str], order: Sequence[str],
              descending: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Rows of keys that fit into one task, and the stored rows of the other keys with their ``__range`` (None without such keys).

    Ranges follow ``order``, which must be total inside a key, so a later range of a key has only later rows.
    """
    limit, most = range_rows(df), int(df.sparkSession.conf.get(BYTES_SETTING, str(BYTES_PER_RANGE)))
    crowded = df.groupBy(*keys).agg(F.count("*").alias("__rows"), F.sum(_row_bytes(df)).alias("__bytes")).where(
        (F.col("__rows") > limit) | (F.col("__bytes") > most))
    total = crowded.agg(F.sum("__rows").alias("rows"), F.sum("__bytes").alias("bytes")).first()
    if not total.rows:
        return df, None
    names = {k: f"__hot_{i}" for i, k in enumerate(keys)}
    hot = workspace.materialize(crowded.select(*[F.col(k).alias(n) for k, n in names.items()]), "hot-keys")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()], F.lit(True))
    rows = df.join(hot, same, "left_semi")
    ends = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    ranged = rows.repartitionByRange(max(-(-total.rows // limit), -(-total.bytes // most)), *keys, *ends).withColumn(_RANGE, F.spark_partition_id())
    return df.join(hot, same, "left_anti"), workspace.materialize(ranged, "ranges")


def _before(keys: Sequence[str]) -> WindowSpec:
    """Summaries of earlier ranges of the same key; about one for each ``range_rows`` rows or ``BYTES_PER_RANGE`` bytes of the key."""
    return Window.partitionBy(*keys).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)


def _scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], inputs: Mapping[str, Column],
          carry: Mapping[str, Column], carried: Mapping[str, Column],
          outputs: Callable[[WindowSpec], Mapping[str, Column]], descending: bool = False) -> DataFrame:
    """Ordered computation over keys of any size.

    ``inputs`` are columns added to each row, ``carry`` aggregates them per range, ``carried`` names the
    input values of the row in front of a range (windows over earlier summaries of the key), and ``outputs``
    are window functions over all rows of a key, or of a range including that one.
    """
    ends = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    cold, hot = split_hot(df.withColumns(dict(inputs)), keys, order, descending)
    done = cold.withColumns(dict(outputs(Window.partitionBy(*keys).orderBy(*ends)))).drop(*inputs)
    if hot is None:
        return done
    summary = hot.groupBy(*keys, _RANGE).agg(*[c.alias(name) for name, c in carry.items()])
    first = summary.select(*keys, _RANGE, *[c.alias(name) for name, c in carried.items()], F.lit(True).alias(_CARRY))
    rows = hot.withColumn(_CARRY, F.lit(False)).unionByName(first, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, _RANGE).orderBy(F.col(_CARRY).desc(), *ends)
    spread = rows.withColumns(dict(outputs(inside))).where(~F.col(_CARRY)).drop(_RANGE, _CARRY, *inputs)
    return done.unionByName(spread)


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "idx",
                start: int = 0, descending: bool = False) -> DataFrame:
    """Dense position of each row inside its key, counted from ``start``."""
    earlier = F.coalesce(F.sum("__n").over(_before(keys)), F.lit(0))
    return _scan(df, keys, order, {"__n": F.lit(1).cast("long")}, {"__n": F.sum("__n")}, {"__n": earlier},
                 lambda w: {name: F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1 + start}, descending)


def previous_values(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                    columns: Mapping[str, str]) -> DataFrame:
    """For ``{new: old}`` add the ``old`` value of the row just before, null for the first row of a key."""
    picked = F.struct(*[F.col(old).alias(new) for new, old in columns.items()])
    last = F.max_by("__values", _order_value(order))
    earlier = F.lag("__values").over(Window.partitionBy(*keys).orderBy(_RANGE))
    scanned = _scan(df, keys, order, {"__values": picked}, {"__values": last}, {"__values": earlier},
                    lambda w: {"__previous_row": F.lag("__values").over(w)})
    return scanned.withColumns({new: F.col("__previous_row")[new] for new in columns}).drop("__previous_row")


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                 columns: Mapping[str, str]) -> DataFrame:
    """For ``{new: old}`` add the sum of ``old`` up to and including each row (null counts as 0)."""
    parts = {new: f"__part_{new}" for new in columns}
    return _scan(
        df, keys, order,
        {parts[new]: F.coalesce(F.col(old), F.lit(0)) for new, old in columns.items()},
        {part: F.sum(part) for part in parts.values()},
        {part: F.coalesce(F.sum(part).over(_before(keys)), F.lit(0)) for part in parts.values()},
        lambda w: {new: F.sum(part).over(w.rowsBetween(Window.unboundedPreceding, 0)) for new, part in parts.items()})


def last_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Mapping[str, Column]) -> DataFrame:
    """For ``{new: value}`` add the last ``value`` that is not null in the rows before each row of its key, null where there is none."""
    own = {new: f"__own_{i}" for i, new in enumerate(columns)}
    at = _order_value(order)
    return _scan(
        df, keys, order, {own[new]: value for new, value in columns.items()},
        {c: F.max_by(c, F.when(F.col(c).isNotNull(), at)) for c in own.values()},
        {c: F.last(c, ignorenulls=True).over(_before(keys)) for c in own.values()},
        lambda w: {new: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) for new, c in own.items()})


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int | Column) -> DataFrame:
    """The last ``n`` rows of each key; ``n`` may be a column that is the same in all rows of a key.

    Map tasks keep the last ``n`` of a key before the shuffle where Spark can tell ``n``; a key of any size is ranked range by range.
    """
    if isinstance(n, int):
        cold, hot = split_hot(df, keys, order, descending=True)
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]))
        kept = cold.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")
        return kept if hot is None else kept.unionByName(_last_of_ranges(hot, keys, order, n))
    wanted = df.withColumn("__wanted", n)
    numbered = number_rows(wanted, keys, order, "__rank", start=1, descending=True)
    return numbered.where(F.col("__rank") <= F.col("__wanted")).drop("__rank", "__wanted")


def _last_of_ranges(hot: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """Last rows of stored ranges in descending order: only ranges with fewer than ``n`` rows in front of them are looked at."""
    sizes = hot.groupBy(*keys, _RANGE).agg(F.count("*").alias("__n"))
    starts = sizes.select(*[F.col(k).alias(f"__hot_{i}") for i, k in enumerate(keys)], F.col(_RANGE).alias("__at"),
                          F.coalesce(F.sum("__n").over(_before(keys)), F.lit(0)).alias("__start")).where(F.col("__start") < n)
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__hot_{i}")) for i, k in enumerate(keys)], F.col(_RANGE) == F.col("__at"))
    rows = hot.join(starts, same)
    rank = F.row_number().over(Window.partitionBy(*keys, _RANGE).orderBy(*[F.col(c).desc() for c in order])) + F.col("__start")
    return rows.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank", "__start", "__at", _RANGE, *[f"__hot_{i}" for i in range(len(keys))])

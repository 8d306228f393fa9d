"""Each response against the previous N of its task, and the waiting time between responses.

``seq`` orders the rows of a task and may have gaps. Rows are numbered inside, a task is cut into blocks of consecutive rows, and
each block also gets a copy of the N rows before it. The trailing window then runs inside
``(task, block)``: no pairs on the wire, and a huge task becomes many blocks.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptloom.functions.similarity import SCORERS, Scorer
from promptloom.operators import ordered


def _scorer(score: str | Scorer) -> Scorer:
    return SCORERS[score] if isinstance(score, str) else score


def with_previous(df: DataFrame, task: str, seq: str, value: str, n: int, name: str,
                  prepare: Callable[[DataFrame], DataFrame] = lambda numbered: numbered) -> DataFrame:
    """Add an array of ``(seq, value)`` of up to ``n`` rows just before each row; ``prepare`` may make ``value`` of the numbered rows."""
    numbered = prepare(ordered.number_rows(df, [task], [seq], "__place"))
    block_size = max(8 * n, 256)
    block = F.floor(F.col("__place") / block_size)
    near_end = F.col("__place") % block_size >= block_size - n
    copies = numbered.withColumn("__block", F.explode(
        F.when(near_end, F.array(block, block + 1)).otherwise(F.array(block))))
    # Spread by block even where the rows already lie together by task. A fixed number of tasks: the work per byte is high, so small partitions must not be merged.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = copies.repartition(tasks, task, "__block")
    trailing = Window.partitionBy(task, "__block").orderBy("__place").rowsBetween(-n, -1)
    item = F.struct(F.col(seq).alias("seq"), F.col(value).alias("value"))
    own = F.col("__block") == F.floor(F.col("__place") / block_size)
    return copies.withColumn(name, F.collect_list(item).over(trailing)).where(own).drop("__block", "__place")


def _featured(df: DataFrame, task: str, seq: str, value: str, scorer: Scorer) -> DataFrame:
    """Rows with ``__feature``, an aggregate, in place of the text."""
    rest = [c for c in df.columns if c not in (task, seq, value)]
    return scorer.aggregate(df, [task, seq, *rest], value, "__feature")


def _scored(df: DataFrame, task: str, seq: str, value: str, n: int, score: str | Scorer,
            at_least: float | None = None) -> DataFrame:
    """Add ``__scores``: previous ``seq`` and score, null where a cheap condition already rules ``at_least`` out."""
    scorer = _scorer(score)
    if scorer.aggregate is not None:
        near = with_previous(_featured(df, task, seq, value, scorer), task, seq, "__feature", n, "__previous")
    else:
        # Rows are counted and numbered with their texts, so that the count need not make the features as well.
        near = with_previous(df, task, seq, "__feature", n, "__previous",
                             lambda rows: rows.withColumn("__feature", scorer.feature(F.col(value))).drop(value))

    own = F.col("__feature")

    def if_needed(other: Column, found: Column) -> Column:
        if at_least is not None and scorer.needed is not None:
            for condition in reversed(scorer.needed(own, other, at_least)):
                found = F.when(condition, found)
        return found

    def pair(previous: Column, score: Column) -> Column:
        return F.struct(previous["seq"].alias("prev_seq"), if_needed(previous["value"], score).alias("score"))

    if scorer.measure is None:
        scores = F.transform("__previous", lambda p: pair(p, scorer.score(own, p["value"])))
    else:
        near = near.withColumn("__others", F.transform("__previous", lambda p: if_needed(p["value"], p["value"])))
        near = scorer.measure(near, "__feature", "__others", "__measured").drop("__others")
        scores = F.zip_with("__previous", "__measured", lambda p, m: pair(p, scorer.measured(own, p["value"], m)))
    return near.withColumn("__scores", scores).drop("__previous", "__feature", "__measured")


def similar_recent(df: DataFrame, task: str, seq: str, value: str, n: int,
                   score: str | Scorer = "jaccard", at_least: float | None = None) -> DataFrame:
    """One row per response and previous response with their score; at most ``n`` per response."""
    scored = _scored(df, task, seq, value, n, score, at_least)
    wanted = F.col("__scores") if at_least is None else F.filter("__scores", lambda s: s["score"] >= at_least)
    return scored.select(*[c for c in scored.columns if c != "__scores"], F.inline(wanted))


def similarity_flag(df: DataFrame, task: str, seq: str, value: str, n: int, threshold: float,
                    score: str | Scorer = "jaccard") -> DataFrame:
    """Best score among the previous ``n`` (0 when there are none) and whether it reaches the threshold."""
    scored = _scored(df, task, seq, value, n, score)
    best = F.coalesce(F.array_max(F.transform("__scores", lambda s: s["score"])), F.lit(0.0))
    return scored.withColumn("max_score", best).drop("__scores").withColumn(
        "is_similar", F.col("max_score") >= threshold)


def trim_history(df: DataFrame, task: str, seq: str, n: int) -> DataFrame:
    """The last ``n`` responses of each task."""
    return ordered.last_rows(df, [task], [seq], n)


def wait_seconds(micros: Column, previous: Column, cooldown: int) -> Column:
    """Whole seconds still to wait after the previous response; 0 for the first one."""
    elapsed = (micros - previous) / F.lit(1e6)
    left = F.greatest(F.lit(0.0), F.lit(float(cooldown)) - elapsed)
    return F.coalesce(F.floor(left).cast("bigint"), F.lit(0).cast("bigint"))


def cooldown_remaining(df: DataFrame, keys: Sequence[str], order: Sequence[str], micros: str,
                       cooldown: int) -> DataFrame:
    """Waiting time before each response, from the time of the one before it in its task."""
    prev = ordered.previous_values(df, keys, order, {"__prev_us": micros})
    waiting = F.coalesce((F.col(micros) - F.col("__prev_us")) < cooldown * 1_000_000, F.lit(False))
    return prev.withColumns({
        "remaining": wait_seconds(F.col(micros), F.col("__prev_us"), cooldown),
        "should_wait": waiting,
    }).drop("__prev_us")


def similar_cooldown(df: DataFrame, task: str, order: Sequence[str], micros: str, cooldown: int,
                     score: str = "max_score", is_similar: str = "is_similar") -> DataFrame:
    """Waiting time before each response that a similar response before it in its task causes; other responses cause none.

    ``df`` comes from ``similarity_flag``. A response is similar when it is flagged and its score is above 0, and the last
    similar one before a row counts, however many rows lie between them.
    """
    caused = F.when(F.col(is_similar) & (F.col(score) > 0), F.col(micros))
    after = ordered.last_before(df, [task], order, {"__similar_us": caused})
    waiting = F.coalesce((F.col(micros) - F.col("__similar_us")) < cooldown * 1_000_000, F.lit(False))
    return after.withColumns({
        "remaining": wait_seconds(F.col(micros), F.col("__similar_us"), cooldown),
        "should_wait": waiting,
    }).drop("__similar_us")


def load_history(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_history(rows: DataFrame, path: str) -> None:
    """Append ``(task, seq, text, ts)``; use ``trim_history`` when reading the recent ones."""
    rows.select("task", "seq", "text", "ts").write.mode("append").parquet(path)

"""Response cache as a table: lookups, upserts, statistics, expiry, and answering each key once."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.operators import joins, ordered


def cache_hits(requests: DataFrame, cache: DataFrame, key: str, spread: Sequence[str]) -> DataFrame:
    """Requests with their cached values. ``cache`` has one row per key."""
    return joins.salted_join(requests, cache, [key], "inner", spread)


def cache_misses(requests: DataFrame, cache: DataFrame, key: str, spread: Sequence[str]) -> DataFrame:
    """Requests the cache cannot answer."""
    return joins.salted_join(requests, cache.select(key), [key], "left_anti", spread)


def dedup_requests(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """First row (by ``order``) of each key, with the number of rows it stands for.

    The aggregate keeps one candidate per key and map task before the shuffle.
    """
    rest = [c for c in df.columns if c != key]
    kept = df.groupBy(key).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("__first"), F.count("*").alias("copies"))
    return kept.select(key, "__first.*", "copies")


def get_or_set(requests: DataFrame, cache: DataFrame, key: str, value: str, payload: Sequence[str],
               order: Sequence[str], answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Give every request its value, asking ``answer`` once per distinct key not in the cache.

    ``answer`` takes ``key, *payload`` and returns ``key, value`` and any further columns, such as the ``error`` and ``attempts``
    of a failed call; these reach the requests and are null where the cache had the value. Its result is used once
    here. A key that the cache holds more than once counts once.
    """
    # Of the cache only what is asked for is grouped.
    known = cache.join(requests.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.max(value).alias(value))
    unknown = dedup_requests(requests.select(key, *payload, *[o for o in order if o not in payload]), key, order)
    fresh = answer(unknown.join(known.select(key), [key], "left_anti").select(key, *payload))
    answers = known.unionByName(fresh, allowMissingColumns=True)
    return joins.salted_join(requests, answers, [key], "left", order)


def cache_upsert(writes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last write per key wins."""
    rest = [c for c in writes.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("__last")
    return writes.groupBy(*keys).agg(last).select(*keys, "__last.*")


def cache_stats(cache: DataFrame, key: str) -> DataFrame:
    """Items in the cache and distinct service prefixes."""
    return cache.agg(F.count("*").alias("total_items"),
                     F.count_distinct(F.split(key, "_")[0]).alias("services"))


def cache_hit_stats(requests: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """Hits, misses and size when each first use of a key is a miss and stores it."""
    return requests.groupBy(*by, key).agg(F.count("*").alias("__n")).groupBy(*by).agg(
        (F.sum("__n") - F.count("*")).alias("hits"), F.count("*").alias("misses"), F.count("*").alias("size"))


def ttl_hits(requests: DataFrame, keys: Sequence[str], order: Sequence[str], micros: str,
             ttl_seconds: int) -> DataFrame:
    """A repeat of a key no later than the time to live after its previous use is a hit."""
    prev = ordered.previous_values(requests, keys, order, {"__prev_us": micros})
    age = F.col(micros) - F.col("__prev_us")
    return prev.withColumn("hit", F.coalesce(age <= ttl_seconds * 1_000_000, F.lit(False))).drop("__prev_us")


def running_hits(requests: DataFrame, by: Sequence[str], order: Sequence[str], hit: str) -> DataFrame:
    """Hits and misses of a service up to and including each request."""
    flagged = requests.withColumns({
        "__hit": F.col(hit).cast("bigint"), "__miss": (~F.col(hit)).cast("bigint")})
    return ordered.running_sums(flagged, by, order, {"hits": "__hit", "misses": "__miss"}).drop(
        "__hit", "__miss")


def load_cache(spark, path: str) -> DataFrame:
    """Current view of the cache folder: the last write per key."""
    return cache_upsert(spark.read.parquet(path), ["service", "cache_key"], ["ts", "value"])


def flush_cache(writes: DataFrame, path: str) -> None:
    """Append writes ``(service, cache_key, value, ts)``; nothing already stored is rewritten."""
    writes.select("service", "cache_key", "value", "ts").write.mode("append").parquet(path)

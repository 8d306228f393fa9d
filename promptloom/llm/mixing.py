"""Mixing sources to target weights with hash thresholds.

Each source gets a target number of words: a share of ``share`` times all words by weight, at most ``most`` times its own words, what is
above being shared again among the others. Targets are met by whole copies of the source and one more copy of the documents
whose hash lies below a threshold. Thresholds come from histograms: words are summed by source and the first 8 bits of the hash; the bucket in
which the budget ends is cut by the next 8 bits, and so on through 32 bits. Only the rows of that bucket are read again. Nothing is sorted, and
tables of one row for each source and bucket are all that is shuffled.

Defined cases: a null text has size 0; null sources are one source, the last; rows without an id share a hash and are taken or left together, as are rows
that repeat an id; sources without words have target 0; an empty table gives no rows; further columns are ignored unless named in ``keep``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from promptloom.sources.workspace import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
WORDS = r"[^\x20\x09-\x0D]+"
_LEVELS, _BITS = 4, 8


def place(doc_id: Column) -> Column:
    """32 bits of a hash of the id, the same in every engine."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``target`` of every row of ``totals(source, source_size)``, one row a source: the level that fills all caps and weights.

    Sources are few beside documents; their rows are ordered in one task.
    """
    everything = W.partitionBy()
    ordered = totals.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    before = W.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(W.unboundedPreceding, -1)
    onward = W.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(0, W.unboundedFollowing)
    levels = (ordered.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
              .withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
              .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward))
              # The first source in this order that its cap does not stop sets the level for all after it.
              .withColumn("level", F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "rank", "level")))
                          .over(everything)["level"]))
    return levels.select("source", "source_size", F.coalesce(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")),
                                                             F.col("cap").cast("double")).alias("target"))


def mix(docs: DataFrame, keep: list[str] | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
        most: int = MOST) -> DataFrame:
    """Every row with its size, its source's size and target, and the words that the mix takes of it."""
    keep = keep or ["doc_id"]
    sized = materialize(docs.select(
        *[F.col(c).alias(f"keep_{c}") for c in keep], "source", place(F.col("doc_id")).alias("place"),
        F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size")), "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = materialize(targets(totals, weights, share, most).select(
        "source", "source_size", "target", copies.alias("copies"),
        (F.col("target") - copies * F.col("source_size")).alias("left"), F.lit(0).cast("long").alias("prefix")), "mix-state")
    for level in range(_LEVELS):
        state = materialize(_refine(sized, state, 32 - _BITS * (level + 1)), "mix-state")
    # One row a source, read from a file: broadcast if that file is small, else joined by shuffle.
    taken = F.col("size") * (F.col("copies") + F.when(F.col("place") < F.col("prefix"), 1).otherwise(0))
    return _with_state(sized, state).select(*[F.col(f"keep_{c}").alias(c) for c in keep], "size", "source_size", "target", taken.alias("taken"))


def _with_state(sized: DataFrame, state: DataFrame) -> DataFrame:
    right = state.withColumnRenamed("source", "state_source")
    return sized.join(right, F.col("source").eqNullSafe(F.col("state_source")), "left").drop("state_source")


def _refine(sized: DataFrame, state: DataFrame, shift: int) -> DataFrame:
    """Cut the bucket in which each source's budget ends into 256; the last cut rounds to the nearer side."""
    last = shift == 0
    parent = F.shiftright("place", shift + _BITS) if shift + _BITS < 32 else F.lit(0)
    rows = _with_state(sized.withColumn("parent", parent.cast("long")), state).where("parent = prefix")
    sums = rows.groupBy("source", F.shiftright("place", shift).alias("bucket")).agg(F.sum("size").alias("words"))
    here = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    known = state.withColumnRenamed("source", "state_source")
    ends = (sums.withColumn("until", F.sum("words").over(here))
            .join(known, F.col("source").eqNullSafe(F.col("state_source"))).where("until > left")
            .groupBy("state_source").agg(F.min(F.struct("bucket", "words", "until")).alias("end")))
    joined = known.withColumnRenamed("state_source", "source").join(ends, F.col("source").eqNullSafe(F.col("state_source")), "left")
    left = F.col("left") - (F.col("end.until") - F.col("end.words"))
    following = F.col("end.bucket") + (F.when(left * 2 >= F.col("end.words"), 1).otherwise(0) if last else F.lit(0))
    # A source without words has no bucket; nothing below 0 is ever taken.
    return joined.select("source", "source_size", "target", "copies", F.coalesce(left, F.lit(0.0)).alias("left"),
                         F.coalesce(following, F.lit(-1)).cast("long").alias("prefix"))


SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORDS}')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS place FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source),
weighed AS (SELECT *, CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, source_size * 2 AS cap,
            (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM totals),
levels AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM weighed),
chosen AS (SELECT level AS top FROM levels WHERE level <= cap / weight ORDER BY cap / weight, rank LIMIT 1),
goals AS (SELECT source, source_size, coalesce(least(cap::DOUBLE, (SELECT top FROM chosen) * weight), cap::DOUBLE) AS target FROM levels),
plans AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM goals),
sums AS (SELECT source, place, sum(size) AS words FROM sized GROUP BY ALL),
running AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY place) AS until FROM sums),
ends AS (SELECT r.source, min(r.place) AS place, arg_min(r.words, r.place) AS words, arg_min(r.until, r.place) AS until
         FROM running r JOIN plans p ON r.source IS NOT DISTINCT FROM p.source WHERE r.until > p.target - p.copies * p.source_size GROUP BY r.source),
bounds AS (SELECT p.*, CASE WHEN e.place IS NULL THEN -1
             WHEN 2 * (p.target - p.copies * p.source_size - (e.until - e.words)) >= e.words THEN e.place + 1 ELSE e.place END AS bound
           FROM plans p LEFT JOIN ends e ON p.source IS NOT DISTINCT FROM e.source)
SELECT s.doc_id, s.size, b.source_size, b.target, (s.size * (b.copies + CASE WHEN s.place < b.bound THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized s JOIN bounds b ON s.source IS NOT DISTINCT FROM b.source
"""

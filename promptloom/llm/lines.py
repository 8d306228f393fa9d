"""Line dedup over overlapping windows of three consecutive lines, with SQL functions only.

A text is cut at \\n. Every three consecutive lines with at least one character other than white space are a window; windows are known by two
64-bit hashes. The first occurrence of a window in the order of (doc_id, place) stays; every line that a later occurrence covers is removed.
What a later occurrence shares with the first one of another window goes too: its text is still in that other's first place.

Windows are shuffled as hashes; each repeated window keeps one first place by partial aggregation, however often it occurs. A text meets the list of
its own covered places, which is never longer than the text.

Defined cases: a null text has no lines and stays null; an empty text is one line; texts of under three lines are left alone; rows that repeat both id and
text count as one occurrence and are treated alike; rows without an id come before all others; an empty table gives no rows; further columns stay as they are,
but for earlier ``n_lines`` and ``n_removed`` where these are asked for.
"""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F


def _lines() -> Column:
    return F.split(F.col("text"), "\n", -1)


def _windows(lines: Column) -> Column:
    """The windows of three lines as (place, k1, k2); the lines are cut once, not again for each window."""
    count = F.greatest(F.size(lines) - 2, F.lit(0))
    threes = F.arrays_zip(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), F.slice(lines, F.lit(1), count), F.slice(lines, F.lit(2), count),
                          F.slice(lines, F.lit(3), count))

    def one(w: Column) -> Column:
        place, a, b, c = (w[k] for k in ("0", "1", "2", "3"))
        return F.struct(place.alias("place"), F.xxhash64(a, b, c).alias("k1"), F.xxhash64(c, F.lit(1), b, F.lit(2), a).alias("k2"),
                        F.concat(a, b, c).rlike(r"[^\x20\x09-\x0D]").alias("full"))
    return F.when(count > 0, F.filter(F.transform(threes, one), lambda w: w["full"]))


def remove_repeats(docs: DataFrame, counts: bool = True) -> DataFrame:
    """All columns of ``docs``, ``text`` without the later occurrences, and with ``counts`` also ``n_lines`` and ``n_removed``."""
    mark = uuid.uuid4().hex[:8]
    row, covered, cut = f"row_{mark}", f"covered_{mark}", f"cut_{mark}"
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    windows = (keyed.select("doc_id", row, F.explode(_windows(_lines())).alias("w"))
               .select("doc_id", row, "w.place", "w.k1", "w.k2"))
    firsts = (windows.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", row, "place")).alias("first"))
              .where("n > 1").select("k1", "k2", "first"))
    later = (windows.join(firsts, ["k1", "k2"]).where(~F.struct("doc_id", row, "place").eqNullSafe(F.col("first")))
             .groupBy(F.col("doc_id").alias(f"id_{mark}"), F.col(row).alias(f"of_{mark}"))
             .agg(F.collect_set("place").alias("places")))
    merged = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + 2))))
    later = later.select(f"id_{mark}", f"of_{mark}", merged.alias(covered))
    # Cut before the join, so that the lines cross it as a column and are not cut again for each line that stays.
    keyed = keyed.withColumn(cut, _lines())
    lines = F.col(cut)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(covered))
    text = F.array_join(F.when(F.col(covered).isNull(), lines).otherwise(F.transform(kept, lambda i: lines[i])), "\n")
    joined = keyed.join(later, (F.col(row) == F.col(f"of_{mark}")) & F.col("doc_id").eqNullSafe(F.col(f"id_{mark}")), "left")
    told = {"n_lines": F.when(lines.isNull(), 0).otherwise(F.size(lines)).cast("long"), "n_removed": F.coalesce(F.size(covered), F.lit(0)).cast("long")} if counts else {}
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in told],
                         *[value.alias(name) for name, value in told.items()])


SQL = r"""
WITH cut AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
numbered AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM cut),
windows AS (
  SELECT doc_id, place, line AS a, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c FROM numbered WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
full_windows AS (SELECT * FROM windows WHERE c IS NOT NULL AND regexp_matches(a || b || c, '[^\x20\x09-\x0D]')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, place) AS r FROM full_windows),
covered AS (SELECT DISTINCT doc_id, place + k AS place FROM ranked, (VALUES (0), (1), (2)) AS t(k) WHERE r > 1),
kept AS (SELECT n.doc_id, string_agg(n.line, chr(10) ORDER BY n.place) FILTER (c.place IS NULL) AS text, count(*) AS n_lines,
                count(c.place) AS n_removed FROM numbered n LEFT JOIN covered c USING (doc_id, place) GROUP BY n.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(k.n_lines, 0)::BIGINT AS n_lines,
       coalesce(k.n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

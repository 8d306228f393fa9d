"""Suffix-array dedup: removes every byte of a long string that also starts elsewhere in the corpus.

Texts are UTF-8 bytes. A byte goes if some string of ``LENGTH`` bytes that covers it starts at two places of the corpus or more; strings never cross texts, and are judged on the input.

Routing. Each string of ``LENGTH`` bytes is known by the least hash among its stretches of ``ANCHOR`` bytes, so equal strings have equal keys, and neighbouring strings mostly share one: a text
is a list of runs of starts with one key. Runs whose key occurs once hold no repeat and end there. Runs of one key that are equal as a whole repeat each other; one of them stands for all in what follows.
What is left are runs that share a key but not their whole stretch. Only their bytes, a small part of the corpus, go to the suffix arrays, in shards that hold whole keys.

Shards. Each shard's suffix array comes from Larsson-Sadakane refinement, its common prefixes from Kasai's method; neighbours with ``LENGTH`` bytes in common that are not the same
place repeat. Keys with more than ``SHARD_RUNS`` differing runs, or more than ``KEY_BYTES`` bytes of them, do not fit a shard. They are merged across shards by narrowing the anchor: ``LENGTH - ANCHOR`` is halved again and again until it is
nothing, a binary search for how far strings agree; runs that have no partner or have equal ones drop out at each step. At the last step a key is a whole string: all runs that share one,
or hold it twice, repeat as a whole, and nothing is left to compare.

Keys are shuffled with partial counts, texts once. Equality of whole runs and keys is that of two independent 64-bit hashes, at the last step of keys alone; inside shards bytes are compared.

Defined cases: null texts are empty; empty and short texts have nothing removed; rows that repeat an id and a text repeat each other and are removed whole if long enough; rows without an id are
texts like others; an empty table gives no rows; further columns are ignored unless named in ``keep``.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from promptloom.llm.spans import Prefix, emit, mix, slices
from promptloom.llm.suffixes import common_prefixes, eight_bytes, suffix_array
from promptloom.sources.workspace import materialize

LENGTH = 400
ANCHOR = 200
SHARD_RUNS = 1_000
SHARD_BYTES = 1 << 20
KEY_BYTES = 4 << 20
LANE = 256


def _slide(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values."""
    k = 1
    while 2 * k <= width:
        values = np.minimum(values[:len(values) - k], values[k:])
        k *= 2
    return np.minimum(values[:len(values) - (width - k)], values[width - k:]) if k < width else values


def key_runs(data: np.ndarray, bounds: np.ndarray, length: int, anchor: int):
    """Row, key, hash of the whole stretch, first and last start of each run, and how often its anchor occurs in it; starts count from the row's first byte."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return (none,) * 6
    prefix = Prefix(data)
    hashes, width = prefix.windows(anchor), length - anchor + 1
    least = _slide(hashes, width)
    fits = np.diff(bounds) >= length
    edges = np.zeros(len(least) + 1, np.int64)
    np.add.at(edges, bounds[:-1][fits], 1)
    np.add.at(edges, bounds[1:][fits] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(edges)[:-1] > 0)
    if not len(starts):
        return (none,) * 6
    keys = least[starts]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(fresh)
    first, last = starts[at], starts[np.append(at[1:], len(starts)) - 1]
    row = np.searchsorted(bounds, first, side="right") - 1
    whole = prefix.spans(first, last + length)
    # Where the anchor is there more than once, strings of one run may repeat each other.
    spans = last - first + width
    heads = np.cumsum(spans) - spans
    inside = np.repeat(first - heads, spans) + np.arange(spans.sum())
    own = np.add.reduceat(hashes[inside] == np.repeat(keys[at], spans), heads, dtype=np.int64)
    # The key and the hash of the stretch must not come from the same sums alone.
    return row, keys[at].view(np.int64), mix(whole ^ np.uint64(0x2545F4914F6CDD1D)).view(np.int64), first - bounds[row], last - bounds[row], own


def _runs(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    def run(batches):
        for batch, texts in slices(batches):
            row, key, whole, first, last, own = key_runs(texts.data, texts.bounds, length, anchor)
            taken = batch.select(["doc_id", "row"]).take(pa.array(row))
            yield emit(taken, ["doc_id", "row"], key=key, whole=whole, first=first.astype(np.int32), last=last.astype(np.int32), own=own)

    return docs.mapInArrow(run, "doc_id long, row long, key long, whole long, first int, last int, own long")


def judge(runs: DataFrame, across: bool = False) -> DataFrame:
    """Adds ``copies``, ``kinds`` (differing runs of the key) and ``asked``: whether the run must be compared byte by byte.

    With ``across``, only repeats in different rows count.
    """
    place = F.xxhash64("row", "first")
    count = F.when(F.min("row") == F.max("row"), 1).otherwise(F.count("*")) if across else F.count("*")
    classes = runs.groupBy("key", "whole").agg(count.alias("copies"), F.min(place).alias("chosen"), F.max(F.col("last") - F.col("first")).cast("long").alias("reach"))
    groups = (classes.groupBy("key").agg(F.count("*").alias("kinds"), F.sum((F.col("copies") == 1).cast("int")).alias("singles"), F.sum("reach").alias("reach")))
    # Stored: a join of two shuffled tables lets Spark split the rows of a run that very many texts hold.
    mixed = materialize(classes.drop("reach").join(groups, "key"), "repeats-classes")
    asked = F.when(F.col("copies") == 1, (F.col("kinds") > 1) | (F.col("own") > 1)).otherwise(
        (F.col("kinds") > 1) & (F.col("singles") > 0) & (place == F.col("chosen")))
    return (runs.join(mixed, ["key", "whole"]).where("copies > 1 OR kinds > 1 OR own > 1")
            .withColumn("asked", asked).drop("chosen", "singles", "own"))


def _crowded(length: int, shard_runs: int) -> Column:
    """Whether the differing runs of a key are too many, or too long together, for one shard."""
    return (F.col("kinds") > shard_runs) | (F.col("reach") + F.col("kinds") * length > KEY_BYTES)


def _shard_repeats(stretches: list[bytes], row: np.ndarray, first: np.ndarray, starts: np.ndarray, length: int,
                   across: bool = False) -> list[tuple[int, int, int]]:
    """(stretch, from, to) of the starts whose string occurs at another place of the shard."""
    # 0xFF is in no UTF-8 text: a suffix that runs out of its stretch shares no whole string with one that does not.
    lengths = np.array([len(s) + 1 for s in stretches])
    bases = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    data = np.frombuffer(b"".join(s + b"\xff" for s in stretches), np.uint8)
    eight = eight_bytes(data, length)
    order, place = suffix_array(eight[:len(data)], 8)
    common = np.zeros(len(data) + 1, np.int64)
    # Long stretches are several lanes.
    cuts = -(-starts // LANE)
    lane = np.repeat(bases, cuts) + LANE * (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts))
    lane_length = np.minimum(LANE, np.repeat(bases + starts, cuts) - lane)
    for t, values in enumerate(common_prefixes(eight, order, place, lane, lane_length, length)):
        common[place[lane[lane_length > t] + t]] = values
    owner = np.repeat(np.arange(len(stretches)), lengths)
    offset = np.arange(len(data)) - bases[owner]
    valid = (offset < starts[owner])[order]
    block = np.cumsum(common[:-1] < length)[valid]
    suffix = order[valid]
    # The same place of a text may be in two stretches; it is no repeat of itself.
    place_id = row[owner[suffix]].view(np.uint64)
    if not across:
        place_id = mix(place_id + mix((first[owner[suffix]] + offset[suffix]).astype(np.uint64)))
    if not len(block):
        return []
    heads = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    several = np.minimum.reduceat(place_id, heads) != np.maximum.reduceat(place_id, heads)
    repeated = np.zeros(len(data) + 1, bool)
    repeated[suffix[np.repeat(several, np.diff(np.append(heads, len(block))))]] = True
    found = []
    for k in range(len(stretches)):
        flags = np.concatenate([[False], repeated[bases[k]:bases[k] + starts[k]], [False]])
        edge = np.flatnonzero(flags[1:] != flags[:-1])
        found += [(k, int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])]
    return found


def _compare(stretches: DataFrame, length: int, across: bool) -> DataFrame:
    """Byte intervals that repeat, from the shards' suffix arrays; a key's stretches are all in one shard."""
    def flush(held):
        row, first = np.array([h[1] for h in held], np.int64), np.array([h[2] for h in held], np.int64)
        starts = np.array([h[3] for h in held], np.int64) - first + 1
        found = _shard_repeats([h[4] for h in held], row, first, starts, length, across)
        low = np.array([first[k] + a for k, a, _ in found], np.int64)
        high = np.array([first[k] + b - 1 + length for k, _, b in found], np.int64)
        return pa.RecordBatch.from_arrays([pa.array([held[k][0] for k, _, _ in found], pa.int64()), pa.array(row[[k for k, _, _ in found]] if found else [], pa.int64()),
                                           pa.array(low), pa.array(high)], names=["doc_id", "row", "low", "high"])

    def run(batches):
        held, size, key = [], 0, None
        for batch in batches:
            for r_key, *rest in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "doc_id", "row", "first", "last", "stretch"))):
                if r_key != key and size >= SHARD_BYTES:
                    yield flush(held)
                    held, size = [], 0
                key = r_key
                held.append(rest)
                size += len(rest[-1])
        if held:
            yield flush(held)

    return (stretches.select("key", "doc_id", "row", "first", "last", "stretch").repartition("key").sortWithinPartitions("key")
            .mapInArrow(run, "doc_id long, row long, low long, high long"))


def _narrow(stretches: DataFrame, length: int, anchor: int) -> DataFrame:
    """The runs of crowded stretches under a longer anchor."""
    def run(batches):
        for batch in batches:
            bodies = batch.column(batch.schema.get_field_index("stretch")).cast(pa.large_binary())
            bounds = np.frombuffer(bodies.buffers()[1], np.int64, len(bodies) + 1, bodies.offset * 8)
            data = np.frombuffer(bodies.buffers()[2], np.uint8)[bounds[0]:bounds[-1]]
            bounds = bounds - bounds[0]
            row, key, whole, first, last, own = key_runs(data, bounds, length, anchor)
            taken = batch.select(["doc_id", "row", "key", "first"]).take(pa.array(row))
            base = taken.column(3).to_numpy().astype(np.int64)
            above = taken.column(2).to_numpy().view(np.uint64)
            parts = [data[bounds[r] + a:bounds[r] + b + length].tobytes() for r, a, b in zip(row, first, last)]
            yield emit(taken, ["doc_id", "row"], key=mix(above + key.view(np.uint64)).view(np.int64), whole=whole,
                       first=(base + first).astype(np.int32), last=(base + last).astype(np.int32), own=own, stretch=pa.array(parts, pa.binary()))

    return stretches.mapInArrow(run, "doc_id long, row long, key long, whole long, first int, last int, own long, stretch binary")


def _intervals_of(runs: DataFrame, length: int) -> DataFrame:
    return runs.select("doc_id", "row", F.col("first").cast("long").alias("low"), (F.col("last") + length).cast("long").alias("high"))


def intervals(stretches: DataFrame, length: int, anchor: int, shard_runs: int = SHARD_RUNS, across: bool = False) -> DataFrame:
    """Repeated byte intervals of the stretches that must be compared."""
    too_many = _crowded(length, shard_runs)
    found = _compare(stretches.where(~too_many), length, across)
    crowded = stretches.where(too_many)
    while not crowded.isEmpty():
        anchor = length - (length - anchor) // 2 if length - anchor > 20 else length
        judged = materialize(judge(materialize(_narrow(crowded, length, anchor), "repeats-narrow"), across), "repeats-judged")
        if anchor == length:
            # Equal keys are equal strings, so whole runs repeat, however many a key has: those of different lengths too, as runs of one byte are.
            if across:
                judged = judged.join(judged.groupBy("key").agg(F.min("row").alias("a"), F.max("row").alias("z")).where("a <> z").select("key"), "key", "left_semi")
            return found.union(_intervals_of(judged, length))
        found = found.union(_intervals_of(judged.where("copies > 1"), length))
        asked = judged.where("asked")
        found = found.union(_compare(asked.where(~too_many), length, across))
        crowded = asked.where(too_many)
    return found


def _cut(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Removes the merged intervals ``lows``/``highs`` from each text."""
    def run(batches):
        for batch, texts in slices(batches):
            lows, highs = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("lows", "highs"))
            removed, spans, digests = [], [], []
            for k in range(texts.rows):
                body = texts.data[texts.bounds[k]:texts.bounds[k + 1]]
                edges = np.zeros(len(body) + 1, np.int64)
                np.add.at(edges, np.array(lows[k], np.int64), 1)
                np.add.at(edges, np.array(highs[k], np.int64), -1)
                gone = np.cumsum(edges)[:-1] > 0
                removed.append(int(gone.sum()))
                spans.append(int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and bool(gone[0]))))
                digests.append(hashlib.sha256(body[~gone].tobytes()).hexdigest())
            yield emit(batch, keep, n_removed=pa.array(removed, pa.int64()), n_spans=pa.array(spans, pa.int64()), kept_sha256=digests)

    return docs.select(*keep, "text", "lows", "highs").mapInArrow(run, "doc_id long, row long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, keep: list[str] | None = None, length: int = LENGTH, anchor: int = ANCHOR, shard_runs: int = SHARD_RUNS) -> DataFrame:
    """Bytes, removed bytes, removed runs and the digest of what stays, for every row, whether any byte goes and how many stay."""
    keep = keep or ["doc_id"]
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("row", F.xxhash64("doc_id", "text"))
    texts = docs.select("doc_id", "row", "text")
    runs = _runs(texts, length, anchor)
    again = runs.groupBy("key").agg(F.sum("own").alias("n")).where("n > 1").select("key")
    judged = materialize(judge(materialize(runs.join(again, "key"), "repeats-runs")), "repeats-judged")
    lists = (judged.groupBy(F.col("doc_id").alias("id"), F.col("row").alias("of"))
             .agg(F.collect_list(F.struct("key", "first", "last", "copies", "kinds", "reach", "asked")).alias("runs")))
    same = (F.col("row") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id"))
    held = materialize(texts.join(lists, same).drop("id", "of"), "repeats-texts")
    body = F.encode("text", "UTF-8")
    asked = held.select("doc_id", "row", F.explode(F.transform(F.filter("runs", lambda r: r["asked"]), lambda r: F.struct(
        r["key"].alias("key"), r["first"].alias("first"), r["last"].alias("last"), r["kinds"].alias("kinds"), r["reach"].alias("reach"),
        F.substring(body, r["first"] + 1, r["last"] - r["first"] + length).alias("stretch")))).alias("r")).select("doc_id", "row", "r.*")
    found = intervals(asked, length, anchor, shard_runs)
    more = (found.groupBy(F.col("doc_id").alias("id"), F.col("row").alias("of"))
            .agg(F.collect_list("low").alias("found_lows"), F.collect_list("high").alias("found_highs")))
    copied = F.filter("runs", lambda r: r["copies"] > 1)
    none = F.array().cast("array<long>")
    cut = _cut(held.join(more, same, "left").select(
        "doc_id", "row", "text",
        F.concat(F.transform(copied, lambda r: r["first"].cast("long")), F.coalesce("found_lows", none)).alias("lows"),
        F.concat(F.transform(copied, lambda r: (r["last"] + length).cast("long")), F.coalesce("found_highs", none)).alias("highs")), ["doc_id", "row"])
    cut = cut.dropDuplicates(["doc_id", "row"]).withColumnsRenamed({"doc_id": "id", "row": "of"})
    whole = docs.select(*keep, *[c for c in ("doc_id",) if c not in keep], "row", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                        F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("digest"))
    return whole.join(cut, same, "left").select(
        *keep, "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept_sha256", "digest").alias("kept_sha256"), (F.coalesce("n_removed", F.lit(0)) > 0).alias("has_repeats"),
        (F.col("n_bytes") - F.coalesce("n_removed", F.lit(0))).alias("n_kept"))

"""Prefix trie of conversations by time-forward processing.

Turns become 128-bit prefix keys: turns are numbered inside their conversation, each turn gets position-salted hashes, and running sums of these name the prefix that ends there. Both steps
work for a conversation of any length (``ordered``), and only hashes and lengths move, not texts. Grouping equal keys gives the nodes, with partial aggregation before the shuffle, so a first turn
that a third of all conversations share is no hot group.

Subtree totals are passed up in time-forward order. The turns below a node bound the size of its subtree: nodes with at most ``shard_rows`` of them form whole subtrees, the shards.
A task sorts the nodes of its shards by reverse level order (Spark's external sort); each node takes the messages addressed to it out of a priority queue, adds them up and sends its
total to its parent, one level on. The queue spills sorted runs beyond ``queue_rows`` messages. Totals of shard roots whose parents lie in no shard are added up per parent and start the next
level of shards, which holds ``growth`` times as many turns, and so on up to the root: few levels, each with shards of bounded size.

Defined cases: conversations with a null id are left out; turns are ordered by ``turn`` (null first), equal turns by the hash of role and text; repeated rows are turns of their own; null roles and
texts are empty; a conversation without turns after rebuilding ends at the root; an empty table gives no rows; further columns are ignored.
"""
from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from promptloom.operators import ordered
from promptloom.sources.workspace import materialize

FAMILY = 100
MOST_SHARED = 6
#: Turns below the root of a lowest shard, and how many times more each next level of shards holds.
SHARD_ROWS = 20_000
GROWTH = 1_000
#: Messages that a task's queue holds in memory.
QUEUE_ROWS = 1_000_000
#: Bytes of an id list that travel as one row.
CHUNK_BYTES = 256 << 10

_SUMS = [f"__s{i}" for i in range(4)]
_EMPTY = hashlib.sha256(b"").hexdigest()


def _halves(*values: Column) -> list[Column]:
    """Four 32-bit numbers of two 64-bit hashes; their sums do not overflow."""
    low = F.lit(0xFFFFFFFF)
    hashes = [F.xxhash64(F.lit(seed), *values) for seed in (17, 71)]
    return [part for h in hashes for part in (h.bitwiseAND(low), F.shiftrightunsigned(h, 32))]


def _key(depth: Column, sums: list[Column]) -> Column:
    """16 bytes that name the prefix of ``depth`` turns with these sums."""
    return F.unhex(F.md5(F.concat_ws(",", depth, *sums)))


def rebuild(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (conv_id, depth, x, y, chars; two hashes in place of the text), and all conv_ids with their length.

    A conversation starts with the first h turns of the conversation of its family (c - c % 100), h being its checksum modulo 6, and goes on with its own turns after the first h.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), "turn", F.xxhash64(F.lit(1), role, text).alias("x"), F.xxhash64(F.lit(2), text, role).alias("y"), F.length(text).cast("long").alias("chars"))
    # Read by four branches below.
    turns = materialize(ordered.number_rows(turns, ["conv_id"], ["turn", "x", "y"], "place", start=1).drop("turn"), "trie-turns")
    lengths = turns.groupBy("conv_id").agg(F.max("place").alias("own"))
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED
    convs = lengths.withColumns({"h": shared, "base": F.col("conv_id") - F.col("conv_id") % FAMILY})
    bases = lengths.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_own", F.lit(0)))).drop("base_own")
    convs = convs.withColumn("length", F.col("taken") + F.greatest(F.lit(0), F.col("own") - F.col("h")))
    convs = materialize(convs, "trie-convs")
    # Conversations start with at most five turns of a base, and a base has at most a hundred of them.
    heads = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("place") < MOST_SHARED)).withColumnRenamed("conv_id", "base")
    head = convs.where("taken > 0").select("conv_id", "base", "taken", "length").join(heads, "base").where("place <= taken").select(
        "conv_id", F.col("place").alias("depth"), "x", "y", "chars", "length")
    tail = turns.join(convs.where("own > h").select("conv_id", "h", "taken", "length"), "conv_id").where("place > h").select(
        "conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "x", "y", "chars", "length")
    return head.unionByName(tail), convs.select("conv_id", "length")


def _paths(turns: DataFrame) -> DataFrame:
    """One row a turn: conv_id, depth, key and parent key, chars, and the turns of the conversation from here on."""
    parts = [f"__p{i}" for i in range(4)]
    salted = turns.withColumns(dict(zip(parts, _halves(F.col("depth"), F.col("x"), F.col("y"))))).drop("x", "y")
    summed = ordered.running_sums(salted, ["conv_id"], ["depth"], dict(zip(_SUMS, parts)))
    before = [F.col(s) - F.col(p) for s, p in zip(_SUMS, parts)]
    return summed.select("conv_id", "depth", _key(F.col("depth"), [F.col(s) for s in _SUMS]).alias("key"), _key(F.col("depth") - 1, before).alias("up"),
                         "chars", (F.col("length") - F.col("depth") + 1).alias("below"), (F.col("length") == F.col("depth")).alias("ends"))


def _root_key() -> Column:
    return _key(F.lit(0), [F.lit(0)] * 4)


class Messages:
    """Priority queue of (level, key, values): messages come out level by level and by key inside a level, those of one key added up.

    Messages are kept as sorted runs. Beyond ``limit`` messages in memory the open runs are merged, added up and written to a file that ends with the task.
    """

    _KIND = np.dtype([("key", "S16"), ("values", np.int64, 3)])

    def __init__(self, limit: int, folder: str | None = None):
        self.limit, self.folder = limit, folder
        self.open: dict[int, list[np.ndarray]] = {}
        self.files: dict[int, list] = {}
        self.held = 0

    def push(self, level: int, keys: np.ndarray, values: np.ndarray) -> None:
        run = self._added_up(keys, values)
        self.open.setdefault(level, []).append(run)
        self.held += len(run)
        if self.held > self.limit:
            self._shrink()

    @classmethod
    def _added_up(cls, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        run = np.empty(len(at), cls._KIND)
        run["key"] = keys[at]
        if len(at):
            run["values"] = np.add.reduceat(values[order], at, axis=0)
        return run

    def _shrink(self) -> None:
        """Messages of one key become one; what is still too much is written as a sorted run a level."""
        for level, runs in self.open.items():
            joined = np.concatenate(runs)
            self.open[level] = [self._added_up(joined["key"], joined["values"])]
        self.held = sum(len(r) for runs in self.open.values() for r in runs)
        if 2 * self.held > self.limit:
            for level, (run,) in self.open.items():
                file = tempfile.TemporaryFile(dir=self.folder)
                run.tofile(file)
                file.flush()
                file.seek(0)
                self.files.setdefault(level, []).append(file)
            self.open, self.held = {}, 0

    def read(self, level: int) -> "_Reader":
        """The messages of a level, in order of their keys; a level is read once, after all its messages were sent."""
        runs = self.open.pop(level, [])
        self.held -= sum(len(r) for r in runs)
        return _Reader(runs, self.files.pop(level, []), max(1024, self.limit // 16), self._KIND)


class _Reader:
    """Merges the runs of a level: ``upto(key)`` gives what is addressed to keys up to this one and was not given before."""

    def __init__(self, runs: list[np.ndarray], files: list, block: int, kind: np.dtype):
        self.runs, self.files, self.block, self.kind = [*runs, *[np.empty(0, kind) for _ in files]], [None] * len(runs) + files, block, kind

    def upto(self, key: bytes) -> np.ndarray:
        taken = []
        for k in range(len(self.runs)):
            while True:
                run = self.runs[k]
                at = int(np.searchsorted(run["key"], np.bytes_(key), side="right"))
                taken.append(run[:at])
                self.runs[k] = run[at:]
                if at < len(run) or self.files[k] is None:
                    break
                more = np.frombuffer(self.files[k].read(self.block * self.kind.itemsize), self.kind)
                if not len(more):
                    self.files[k].close()
                    self.files[k] = None
                    break
                self.runs[k] = more
        joined = np.concatenate(taken) if taken else np.empty(0, self.kind)
        return Messages._added_up(joined["key"], joined["values"])


#: What a node sends to its parent: one child, its leaves, its saved tokens.
_SENT = ["children", "leaves", "saved"]
_NODE = "key binary, up binary, depth long, conv_id long, n_convs long"


def _forward(queue_rows: int):
    """A pass over nodes sorted by descending depth, then key; rows with ``sent`` are messages to parents outside the shard."""
    def keys_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
        column = batch.column(batch.schema.get_field_index(name)).cast(pa.binary(16))
        return np.frombuffer(column.buffers()[1], "S16", len(column), column.offset * 16)

    def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
        return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spill = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
        queue, level, reader = Messages(queue_rows, spill), None, None
        for whole in batches:
            depths = numbers(whole, "depth")
            cuts = [0, *(np.flatnonzero(np.diff(depths)) + 1).tolist(), len(depths)]
            for low, high in zip(cuts[:-1], cuts[1:]):
                if high == low:
                    continue
                batch = whole.slice(low, high - low)
                if level != depths[low]:
                    level = int(depths[low])
                    reader = queue.read(level)
                keys, ups = keys_of(batch, "key"), keys_of(batch, "up")
                totals = np.stack([numbers(batch, c) for c in _SENT], axis=1).astype(np.int64)
                came = reader.upto(keys[-1])
                totals[np.searchsorted(keys, came["key"])] += came["values"]
                totals[:, 1] += totals[:, 0] == 0  # a node without children is a leaf
                totals[:, 2] += (numbers(batch, "n_convs") - 1) * numbers(batch, "chars")
                sends = totals.copy()
                sends[:, 0] = 1
                root = numbers(batch, "is_root").astype(bool)
                if not root.all():
                    queue.push(level - 1, ups[~root], sends[~root])
                names = [f.split()[0] for f in _NODE.split(", ")]
                kept = [batch.column(batch.schema.get_field_index(n)) for n in names]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array(totals[:, i]) for i in range(3)], pa.array(np.zeros(len(keys), bool))], names=[*names, *_SENT, "sent"])
                if root.any():
                    at = pa.array(np.flatnonzero(root))
                    out = batch.take(at)
                    up = out.column(out.schema.get_field_index("up"))
                    none = pa.nulls(len(at), pa.int64())
                    yield pa.RecordBatch.from_arrays([up, pa.nulls(len(at), pa.binary()), none, none, none, *[pa.array(sends[root, i]) for i in range(3)], pa.array(np.ones(len(at), bool))],
                                                     names=[*names, *_SENT, "sent"])
    return run


def _shard_keys(nodes: DataFrame, paths: DataFrame, limits: list[int]) -> DataFrame:
    """For every conversation the key of the first node on its path that fits into a shard of each level: conv_id, shard0, shard1, ...

    Only nodes too large for the lowest level are looked up; they are about (turns / limit) * depth many.
    """
    level = sum((F.col("below") > limit).cast("int") for limit in limits)
    large = materialize(nodes.where(F.col("below") > limits[0]).select("key", level.alias("level")), "trie-large")
    placed = paths.select("conv_id", "depth", "key").join(large, "key", "left").withColumn("level", F.coalesce("level", F.lit(0)))
    return placed.groupBy("conv_id").agg(*[
        F.min_by("key", F.when(F.col("level") <= i, F.col("depth"))).alias(f"shard{i}") for i in range(len(limits))])


def totals(nodes: DataFrame, paths: DataFrame, root: DataFrame, shard_rows: int = SHARD_ROWS, growth: int = GROWTH, queue_rows: int = QUEUE_ROWS) -> DataFrame:
    """All nodes with children, leaves and saved tokens of their subtrees, shard level by shard level.

    ``nodes`` (key, up, depth, conv_id, n_convs, chars, below) do not hold the root.
    """
    most = nodes.agg(F.max("below")).first()[0]
    limits = [shard_rows]
    while most is not None and limits[-1] < most:
        limits.append(limits[-1] * growth)
    parts = [f.split()[0] for f in _NODE.split(", ")]
    if most is not None and len(limits) > 1:
        shards = _shard_keys(nodes, paths, limits)
        level = sum((F.col("below") > limit).cast("int") for limit in limits)
        own = F.coalesce(*[F.when(F.col("level") == i, F.col(f"shard{i}")) for i in range(len(limits))])
        nodes = nodes.join(shards, "conv_id").withColumn("level", level).withColumn("shard", own).select(*parts, "chars", "level", "shard")
        nodes = materialize(nodes, "trie-nodes")
    else:
        # One level: subtrees below the root are the shards, told apart by the first turn of any of their conversations.
        first = paths.where("depth = 1").select("conv_id", F.col("key").alias("shard"))
        nodes = nodes.join(first, "conv_id").select(*parts, "chars", F.lit(0).alias("level"), "shard")
    zero = {c: F.lit(0).cast("long") for c in _SENT}
    sent, done = None, []
    kinds = f"{_NODE}, children long, leaves long, saved long, sent boolean"
    for i in range(len(limits) + 1):
        if i < len(limits):
            rows = nodes.where(F.col("level") == i)
        else:
            rows = root.select("key", F.lit(None).cast("binary").alias("up"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("chars"), F.col("key").alias("shard"))
        start = zero if sent is None else {c: F.coalesce(c, F.lit(0)) for c in _SENT}
        rows = rows if sent is None else rows.join(sent, "key", "left")
        rows = rows.withColumns(start).select(*parts, "chars", *_SENT, F.col("key").eqNullSafe(F.col("shard")).alias("is_root"), "shard")
        rows = rows.withColumn("up", F.coalesce("up", F.col("key"))).repartition("shard").drop("shard").sortWithinPartitions(F.col("depth").desc(), "key")
        passed = materialize(rows.mapInArrow(_forward(queue_rows), kinds), "trie-totals")
        done.append(passed.where("NOT sent").drop("sent"))
        after = passed.where("sent").groupBy("key").agg(*[F.sum(c).alias(c) for c in _SENT])
        # Messages that skip a level wait for theirs.
        sent = after if sent is None else sent.unionByName(after).groupBy("key").agg(*[F.sum(c).alias(c) for c in _SENT])
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _digests(ends: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """key, ends_sha256: the digest of the ids that end at each node, ascending, joined by commas.

    Ids are ordered over all tasks first and travel on as joined chunks, so what one task hashes of a hot node is a stream of few rows.
    """
    def chunks(batches):
        key, first, parts, size = None, None, [], 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(parts)])], names=["key", "first", "ids"])

        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if parts and (k != key or size > chunk_bytes):
                    yield row()
                    parts, size = [], 0
                if not parts:
                    key, first = k, c
                parts.append(str(c))
                size += len(parts[-1]) + 1
        if parts:
            yield row()

    def digest(batches):
        key, running, keys, hexes = None, None, [], []
        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != key:
                    if key is not None:
                        keys.append(key)
                        hexes.append(running.hexdigest())
                    key, running = k, hashlib.sha256(ids.encode())
                else:
                    running.update(b"," + ids.encode())
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hexes)], names=["key", "ends_sha256"])
                keys, hexes = [], []
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([running.hexdigest()])], names=["key", "ends_sha256"])

    ranged = ends.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    cut = ranged.mapInArrow(chunks, "key binary, first long, ids string")
    return cut.repartition("key").sortWithinPartitions("key", "first").drop("first").mapInArrow(digest, "key binary, ends_sha256 string")


def build(conversations: DataFrame, shard_rows: int = SHARD_ROWS, growth: int = GROWTH, queue_rows: int = QUEUE_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, convs = rebuild(conversations)
    paths = materialize(_paths(turns), "trie-paths")
    nodes = materialize(paths.groupBy("key", "depth").agg(
        F.min("up").alias("up"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.sum("below").alias("below")), "trie-keys")
    # Stored, so that its key is a value to join by and no constant of the plan.
    root = materialize(convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").withColumn("key", _root_key()), "trie-root")
    summed = materialize(totals(nodes, paths, root, shard_rows, growth, queue_rows), "trie-summed")
    ends = paths.where("ends").select("key", "conv_id").unionByName(convs.where("length = 0").select(_root_key().alias("key"), "conv_id"))
    parents = summed.select(F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    joined = summed.join(_digests(ends, chunk_bytes), "key", "left").join(parents, "up", "left")
    return joined.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))


#: The same nodes in DuckDB; the checksum is worked out bit by bit.
SQL = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, own, xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ord(d)::BIGINT)),
      lambda sum, digit: list_reduce(list_concat([xor(sum, digit)], range(8)), lambda x, bit: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 6 AS h
  FROM (SELECT conv_id, list(said ORDER BY place) AS own FROM t GROUP BY conv_id)
), r AS (
  SELECT c.conv_id, list_concat(coalesce(b.own[:c.h], []), c.own[c.h + 1:]) AS path FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 100
), n AS (
  SELECT prefix, len(prefix) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(path) = len(prefix)), '')) AS ends_sha256
  FROM (SELECT conv_id, path, path[:d] AS prefix FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM r)) GROUP BY prefix
), k AS (
  SELECT n.*, coalesce(m.n_children, 0) AS n_children FROM n LEFT JOIN (SELECT prefix[:depth - 1] AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1) m USING (prefix)
), s AS (
  SELECT prefix[:d] AS prefix, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((n_convs - 1) * coalesce(length(prefix[depth].text), 0))::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM k) GROUP BY 1
)
SELECT k.conv_id, k.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved_tokens, k.ends_sha256
FROM k JOIN s USING (prefix) LEFT JOIN n p ON k.depth > 0 AND p.prefix = k.prefix[:k.depth - 1]
"""

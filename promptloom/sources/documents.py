"""JSON documents cut into elements by as many tasks as their files have splits.

A file is read as text that ends at commas, which every array of more than one element has, whatever its line breaks; so Spark splits it like any text file and no task sees a whole document.
Whether a comma ends an element depends on what stands before it. Each split of a file with several therefore first reports how it changes the state: the parity of its quotes,
and the change of bracket depth if it begins outside and if it begins inside a string. A prefix scan over these reports gives each split the state it begins in, and with it all splits are cut
at the same time. An element that crosses split borders comes in pieces, at most two a split, which are put together by a grouping of their own.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptloom.operators import joins, ordered
from promptloom.sources import workspace

#: Bounds of the table of split states that is broadcast; beyond them the text is shuffled by split instead.
STATE_ROWS = 1_000_000
STATE_BYTES = 64 << 20
EMIT_ROWS, EMIT_BYTES = 4_096, 16 << 20
CHANGED = "file splits differ from those counted; fix spark.sql.files.maxPartitionBytes and minPartitionNum"
PACKED = (".gz", ".bz2", ".lz4", ".snappy", ".zst", ".deflate")

_QUOTE, _ESCAPE, _COMMA, _OPEN, _CLOSE = ord('"'), ord("\\"), ord(","), ord("["), ord("]")
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in '"\\,[]{}']] = True
_STEP = np.zeros(256, np.int64)
_STEP[[ord("["), ord("{")]], _STEP[[ord("]"), ord("}")]] = 1, -1
_BLANK = b" \t\r\n"


def marks(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places of the quotes that open or close a string, and of all commas and brackets."""
    text = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(_MARKS[text])
    kind = text[at]
    quotes, escapes = at[kind == _QUOTE], at[kind == _ESCAPE]
    if len(escapes):
        # A quote behind an odd number of backslashes is part of a string.
        last = np.flatnonzero(np.diff(escapes, append=-1) != 1)
        lengths = np.diff(last, prepend=-1)
        quotes = quotes[~np.isin(quotes, escapes[last[lengths % 2 == 1]] + 1)]
    return quotes, at[(kind != _QUOTE) & (kind != _ESCAPE)]


class _Report:
    """How a split changes the state."""

    def __init__(self):
        self.parity, self.outside, self.inside, self.first, self.size = 0, 0, 0, None, 0

    def feed(self, data: bytes) -> None:
        quotes, others = marks(data)
        steps = _STEP[np.frombuffer(data, np.uint8)[others]]
        within = (np.searchsorted(quotes, others) + self.parity) % 2 == 1
        self.outside += int(steps[~within].sum())
        self.inside += int(steps[within].sum())
        self.parity = (self.parity + len(quotes)) % 2
        self.size += len(data)
        if self.first is None:
            rest = data.lstrip(_BLANK)
            self.first = rest[:1].decode("latin-1") if rest else None


@dataclass
class Cutter:
    """Cuts the text of one split, given the state that it begins in.

    ``kind`` is the first character of the document, None before it. ``pieces`` holds what belongs to elements that other splits hold too: (opens, text, opener, closer, complete elements so far).
    """
    name: str
    string: int = 0
    depth: int = 0
    kind: str | None = None
    alone: bool = True
    pending: list[bytes] = field(default_factory=list)
    rows: int = 0
    closed: bool = False

    def __post_init__(self):
        self.opener = None  # set once an element begins in this split
        self.pieces: list[tuple] = []
        self.after = b""
        if self.kind == "[" and self.depth == 0:
            self.closed = True

    def fail(self, why: str) -> None:
        raise ValueError(f"{self.name} is not one JSON document: {why}")

    def feed(self, data: bytes) -> list[bytes]:
        """Complete elements of the next text, which ends at a comma."""
        low = 0
        if self.kind is None:
            rest = data.lstrip(_BLANK)
            if rest in (b"", b","):
                if rest:
                    self.after += rest
                    if len(self.after) > 1:
                        self.fail("a comma without values")
                return []
            if self.after:
                self.fail("it begins with a comma")
            low = len(data) - len(rest)
            self.kind, self.opener = rest[:1].decode("latin-1"), rest[:1].decode("latin-1")
        if self.kind != "[":
            self.pending.append(data[low:])
            return []
        if self.closed:
            self._end(data)
            return []
        quotes, others = marks(data)
        others = others[(np.searchsorted(quotes, others) + self.string) % 2 == 0]
        codes = np.frombuffer(data, np.uint8)[others]
        depths = self.depth + np.cumsum(_STEP[codes])
        self.string = (self.string + len(quotes)) % 2
        ends = np.flatnonzero(((codes == _COMMA) & (depths == 1)) | ((_STEP[codes] < 0) & (depths <= 0)))
        if len(depths):
            self.depth = int(depths[-1])
        if self.opener == "[" and self.rows == 0 and not self.pending and low < len(data) and data[low] == _OPEN and depths[:1].tolist() == [1]:
            low += 1  # the bracket that opens the document
        out = []
        for k in ends.tolist():
            at = int(others[k])
            text = data[low:at]
            if self.pending:
                text = b"".join([*self.pending, text])
                self.pending = []
            last = codes[k] != _COMMA
            if last and (codes[k] != _CLOSE or depths[k] < 0):
                self.fail("brackets that do not match")
            low = at + 1
            self._take(text, "]" if last else ",", out)
            self.opener = ","
            if last:
                self.closed = True
                self._end(data[low:])
                return out
        if low < len(data):
            self.pending.append(data[low:])
        return out

    def _take(self, text: bytes, closer: str, out: list[bytes]) -> None:
        if self.opener is None:
            self.pieces.append((False, text, None, closer, 0))
            return
        text = text.strip(_BLANK)
        if text:
            self.rows += 1
            out.append(text)
        elif not (self.opener == "[" and closer == "]"):
            self.fail("an element is missing")

    def _end(self, data: bytes) -> None:
        """Behind the document stands nothing but the comma that ends every text."""
        self.after += data.strip(_BLANK)
        if self.after not in (b"", b","):
            self.fail("text after the document")

    def finish(self) -> list[bytes]:
        """The last elements of a document that has no other splits."""
        if self.alone:
            if self.kind is None:
                return []
            if self.kind == "[":
                if not self.closed:
                    self.fail("it ends too early")
                return []
            return [b"".join(self.pending)[:-1].strip(_BLANK)]
        if not self.closed and (self.pending or self.opener is not None):
            self.pieces.append((self.opener is not None, b"".join(self.pending), self.opener, None, self.rows))
        return []


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Row ranges of one split each."""
    path, start = batch.column("file_path"), batch.column("block_start")
    n = batch.num_rows
    if not n:
        return
    changed = pc.or_(pc.not_equal(path[1:], path[:-1]), pc.not_equal(start[1:], start[:-1])).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), n]
    yield from zip(cuts[:-1], cuts[1:])


def _text(batch: pa.RecordBatch, low: int, high: int) -> bytes:
    """The rows with the commas that ended them."""
    values = batch.column("value")[low:high].cast(pa.binary()).to_pylist()
    return b",".join(values) + b","


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict, bytes]]:
    """(split, its columns, text) for all text, split by split."""
    names = None
    for batch in batches:
        names = names or [n for n in batch.schema.names if n != "value"]
        for low, high in _runs(batch):
            first = {n: batch.column(n)[low].as_py() for n in names}
            yield (first["file_path"], first["block_start"]), first, _text(batch, low, high)


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, report, source = None, None, None

    def row():
        return pa.RecordBatch.from_pylist([{"file_path": at[0], "block_start": at[1], "file_size": source["file_size"], "parity": report.parity, "outside": report.outside,
                                            "inside": report.inside, "first": report.first, "size": report.size}], schema=kind)

    kind = pa.schema([("file_path", pa.string()), ("block_start", pa.int64()), ("file_size", pa.int64()), ("parity", pa.int64()), ("outside", pa.int64()),
                      ("inside", pa.int64()), ("first", pa.string()), ("size", pa.int64())])
    for split, first, data in _splits(batches):
        if split != at:
            if at:
                yield row()
            at, report, source = split, _Report(), first
        report.feed(data)
    if at:
        yield row()


def _complete(size: int, file_size: int, name: str) -> bool:
    """False where the file ends with a comma, which the reader does not show (with or without a byte order mark)."""
    return size not in (file_size, file_size - 3) or name.endswith(PACKED)


def _cut(pieces: bool):
    """Complete elements of all splits, or the pieces of the elements that cross borders."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cutter, source, size = None, None, None, 0
        lines: list[bytes] = []
        first_row, held = 0, 0

        def rows() -> pa.RecordBatch:
            n = len(lines)
            return pa.RecordBatch.from_arrays(
                [pa.array([source["file_path"]] * n, pa.string()), pa.array([source["file_name"]] * n, pa.string()), pa.array([source["block_start"]] * n, pa.int64()),
                 pa.array(range(first_row, first_row + n), pa.int64()), pa.array(lines, pa.binary()).cast(pa.string())],
                names=["file_path", "file_name", "block_start", "row_id", "line"])

        def parts() -> pa.RecordBatch:
            found = cutter.pieces
            n = len(found)
            return pa.RecordBatch.from_arrays(
                [pa.array([source["file_path"]] * n, pa.string()), pa.array([source["file_name"]] * n, pa.string()), pa.array([source["block_start"]] * n, pa.int64()),
                 pa.array([p[4] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.binary()).cast(pa.string()), pa.array([p[0] for p in found], pa.bool_()),
                 pa.array([p[2] for p in found], pa.string()), pa.array([p[3] for p in found], pa.string())],
                names=["file_path", "file_name", "block_start", "row_id", "line", "opens", "opener", "closer"])

        for split, first, data in _splits(batches):
            if split != at:
                if at:
                    lines += cutter.finish()
                    if cutter.alone and not _complete(size, source["file_size"], at[0]):
                        cutter.fail("it ends with a comma")
                    if pieces and cutter.pieces:
                        yield parts()
                    elif lines and not pieces:
                        yield rows()
                at, source, size, lines, first_row, held = split, first, 0, [], 0, 0
                if first["several"] and first["depth"] is None:
                    raise ValueError(CHANGED)
                cutter = Cutter(at[0], first["string"] or 0, first["depth"] or 0, first["kind"], not first["several"])
            size += len(data)
            found = cutter.feed(data)
            if not pieces:
                lines += found
                held += sum(map(len, found))
                if len(lines) >= EMIT_ROWS or held >= EMIT_BYTES:
                    yield rows()
                    first_row, lines, held = first_row + len(lines), [], 0
        if at:
            lines += cutter.finish()
            if cutter.alone and not _complete(size, source["file_size"], at[0]):
                cutter.fail("it ends with a comma")
            if pieces and cutter.pieces:
                yield parts()
            elif lines and not pieces:
                yield rows()
    return run


def _states(text: DataFrame) -> DataFrame:
    """The state in which each split of a file with several begins, stored; stops where a file ends in a string or inside brackets."""
    reports = text.where("several").select("file_path", "block_start", "file_size", "value").mapInArrow(
        _report, "file_path string, block_start long, file_size long, parity long, outside long, inside long, first string, size long")
    reports = workspace.materialize(reports, "split-reports")
    before = Window.partitionBy("file_path").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    upto = before.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("file_path")
    string = F.pmod(F.coalesce(F.sum("parity").over(before), F.lit(0)), F.lit(2))
    found = reports.withColumn("string", string).withColumn("change", F.when(F.col("string") == 1, F.col("inside")).otherwise(F.col("outside")))
    found = found.withColumns({
        "depth": F.coalesce(F.sum("change").over(before), F.lit(0)), "kind": F.first("first", ignorenulls=True).over(upto), "seen": F.first("first", ignorenulls=True).over(before),
        "end": F.sum("change").over(whole), "quotes": F.sum("parity").over(whole), "total": F.sum("size").over(whole)})
    packed = F.lit(False)
    for end in PACKED:
        packed = packed | F.col("file_path").endswith(end)
    wrong = ((F.col("kind") == "[") & ((F.col("end") != 0) | (F.col("quotes") % 2 != 0))) | (
        (F.col("total").isin(F.col("file_size")) | (F.col("total") == F.col("file_size") - 3)) & ~packed)
    stop = F.raise_error(F.concat("file_path", F.lit(" is not one JSON document: it ends too early or with a comma")))
    # A split in which the document itself begins is cut from there on.
    return found.select(F.xxhash64("file_path").alias("file_hash"), "block_start", F.when(wrong, stop.cast("long")).otherwise(F.col("string")).alias("string"), "depth",
                        F.col("seen").alias("kind"))


def elements(text: DataFrame, split: bool = True) -> DataFrame:
    """file_path, file_name, block_start, row_id and line of every element of the documents in ``text``.

    ``text`` holds what a text reader with a comma as line end gives, with the file's path, name and size, the split's start, and ``several``, whether the file has other splits. Without
    ``split`` no file has; then there is nothing to report or to put together.
    """
    kinds = "file_path string, file_name string, block_start long, row_id long, line string"
    if not split:
        nothing = {"string": F.lit(None).cast("long"), "depth": F.lit(None).cast("long"), "kind": F.lit(None).cast("string")}
        return text.withColumns(nothing).select("file_path", "file_name", "file_size", "block_start", "several", *nothing, "value").mapInArrow(_cut(False), kinds)
    states = workspace.materialize(_states(text), "split-states")
    if joins.is_small(states, STATE_ROWS, STATE_BYTES):
        known = text.withColumn("file_hash", F.xxhash64("file_path")).join(F.broadcast(states), ["file_hash", "block_start"], "left")
    else:
        known = text.withColumns({"file_hash": F.xxhash64("file_path"), "place": F.monotonically_increasing_id()}).join(states, ["file_hash", "block_start"], "left").repartition(
            "file_hash", "block_start").sortWithinPartitions("file_hash", "block_start", "place")
    known = known.select("file_path", "file_name", "file_size", "block_start", "several", "string", "depth", "kind", "value")
    whole = known.mapInArrow(_cut(False), kinds)
    pieces = known.where("several").mapInArrow(_cut(True), f"{kinds}, opens boolean, opener string, closer string")
    return whole.unionByName(_joined(pieces))


def _joined(pieces: DataFrame) -> DataFrame:
    """Elements that cross split borders: a piece that opens one and those that go on with it, file by file."""
    mark = F.when(F.col("opens"), F.struct("block_start", "row_id", "opener"))
    placed = pieces.withColumn("part", F.col("opens").cast("int"))
    placed = ordered.last_before(placed, ["file_path"], ["block_start", "part"], {"from": mark})
    placed = placed.withColumn("from", F.when(F.col("opens"), F.struct("block_start", "row_id", "opener")).otherwise(F.col("from")))
    grouped = placed.groupBy("file_path", "file_name", F.col("from.block_start").alias("block_start"), F.col("from.row_id").alias("row_id"), F.col("from.opener").alias("opener")).agg(
        F.array_sort(F.collect_list(F.struct("block_start", "part", "line"))).alias("parts"), F.max("closer").alias("closer"))
    joined = F.concat_ws("", F.transform("parts", lambda p: p["line"]))
    # A document that is no array ends with the comma that ends every text.
    text = F.regexp_replace(F.when(F.col("closer").isNull(), F.expr("substring(joined, 1, length(joined) - 1)")).otherwise(F.col("joined")), r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    found = grouped.withColumn("joined", joined).withColumn("line", text)
    empty = (F.col("line") == "") & (F.col("opener") == "[") & (F.col("closer") == "]")
    missing = F.raise_error(F.concat("file_path", F.lit(" is not one JSON document: an element is missing"))).cast("string")
    return found.where(~empty).select("file_path", "file_name", "block_start", "row_id", F.when(F.col("line") == "", missing).otherwise(F.col("line")).alias("line"))

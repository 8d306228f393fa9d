"""Ranked lexical search over an impact-ordered index, by the Best Position Algorithm.

``index`` cuts the documents into shards of bounded size where they lie and stores, for each shard, its terms with their documents and counts. Nothing is shuffled and nothing is left out.
``search`` takes the items in blocks. Document frequencies of a block's terms are summed over the shards; then every shard turns the postings of these terms into lists ordered by
impact and runs the Best Position Algorithm for each item: lists are read in parallel behind their best position (all places up to it have been seen); each new
document is looked up in all other lists at once, which marks its places there as seen and moves best positions on; the impacts at the best positions bound every unseen document.
A list read to its end adds nothing to that bound. Reading stops when the bound is strictly below the k-th score, so ties at the k-th place are all seen. Shards of one task pass on the
k-th score found so far; the best of all tasks are ranked by a window that first ranks hash slices of an item's rows.

A term is a run of characters other than ASCII non-alphanumerics, A-Z lower-cased, known by a 64-bit hash: with v different terms in the items and V in the documents,
two are taken for one another with a chance of about v * V / 2**64.

Defined cases: null texts and texts without a term are no documents and items without results; a text of any length is indexed whole (a shard holds at least one document); rows that repeat a doc_id
are documents of their own; a null doc_id stands before all others among equal scores; item rows that repeat both id and text count once, rows of one id and different texts are
items of their own; empty tables give no rows; further columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from promptloom.llm.spans import LOWER, Prefix, Texts, slices, texts_of
from promptloom.sources.workspace import materialize

TOP = 20
#: Text bytes of a shard.
SHARD_BYTES = 8 << 20
#: Text bytes of the items that are searched for at once; their terms and weights are all that is broadcast.
ITEM_BYTES = 4 << 20
_MERGE_SLICES = 64
_LEAST = np.iinfo(np.int64).min

_BREAK = np.ones(256, bool)
_BREAK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

_SHARD = "ids binary, has_id binary, sizes binary, terms binary, starts binary, docs binary, counts binary, n_docs long, n_terms long"


def find_terms(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each term and the row that it stands in."""
    broken = _BREAK[texts.data]
    before, after = np.ones(len(broken), bool), np.ones(len(broken), bool)
    before[1:], after[:-1] = broken[:-1], broken[1:]
    inner = texts.bounds[1:-1]
    before[inner[inner < len(broken)]] = True
    after[inner[inner > 0] - 1] = True
    starts, ends = np.flatnonzero(~broken & before), np.flatnonzero(~broken & after) + 1
    rows = np.searchsorted(texts.bounds, starts, side="right") - 1
    return Prefix(LOWER[texts.data]).spans(starts, ends).view(np.int64), rows


def _counted(terms: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (term, document) by term, then document, with the number of occurrences; ``docs`` ascend."""
    order = np.argsort(terms, kind="stable")
    terms, docs = terms[order], docs[order]
    first = np.ones(len(terms), bool)
    first[1:] = (terms[1:] != terms[:-1]) | (docs[1:] != docs[:-1])
    at = np.flatnonzero(first)
    return terms[at], docs[at], np.diff(at, append=len(terms))


class _Shard:
    """Postings of consecutive documents."""

    def __init__(self):
        self.parts, self.ids, self.sizes, self.bytes, self.rows = [], [], [], 0, 0

    def add(self, ids: pa.Array, texts: Texts) -> None:
        terms, rows = find_terms(texts)
        self.sizes.append(np.bincount(rows, minlength=texts.rows))
        self.ids.append(ids)
        self.parts.append(_counted(terms, (rows + self.rows).astype(np.int32)))
        self.bytes += len(texts.data)
        self.rows += texts.rows

    def batch(self) -> pa.RecordBatch:
        terms, docs, counts = (np.concatenate(c) for c in zip(*self.parts))
        order = np.argsort(terms, kind="stable")
        terms, docs, counts = terms[order], docs[order], counts[order]
        at = np.flatnonzero(np.diff(terms, prepend=terms[0] - 1 if len(terms) else 0) != 0) if len(terms) else np.zeros(0, np.int64)
        sizes = np.concatenate(self.sizes)
        ids = pa.chunked_array(self.ids).combine_chunks()
        has = ids.is_valid().to_numpy(zero_copy_only=False)
        body = [ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), has, sizes.astype(np.int32), terms[at], np.append(at, len(terms)).astype(np.int32),
                docs.astype(np.int32), counts.astype(np.int32)]
        arrays = [pa.array([b.tobytes()], pa.binary()) for b in body] + [pa.array([int((sizes > 0).sum())]), pa.array([int(sizes.sum())])]
        return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in _SHARD.split(", ")])


def index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row a shard of ``doc_id`` and ``text``, stored in the shared folder."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch, texts in slices(batches):
            if shard.rows and shard.bytes + len(texts.data) > shard_bytes:
                yield shard.batch()
                shard = _Shard()
            shard.add(batch.column(0), texts)
        if shard.rows:
            yield shard.batch()

    return materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SHARD), "lexical-index")


def _column(batch: pa.RecordBatch, name: str, row: int, kind) -> np.ndarray:
    return np.frombuffer(batch.column(batch.schema.get_field_index(name))[row].as_buffer(), kind)


def _places(wanted: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which ``wanted`` values are in ``terms``, and where; both ascend."""
    at = np.minimum(np.searchsorted(terms, wanted), max(0, len(terms) - 1))
    found = np.flatnonzero(terms[at] == wanted) if len(terms) else np.zeros(0, np.int64)
    return found, at[found]


def _item_terms(items: DataFrame) -> list[tuple]:
    """(item_id, text, distinct terms, occurrences) of a block of items."""
    out = []
    rows = items.collect()
    for row in rows:
        terms, counts = np.unique(find_terms(texts_of(pa.array([row.text], pa.string())))[0], return_counts=True)
        if len(terms):
            out.append((row.item_id, row["__item"], terms, counts.astype(np.int64)))
    return out


def _frequencies(shards: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """Number of documents that hold each of the ``wanted`` terms."""
    shared = shards.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        sums = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                found, at = _places(shared.value, _column(batch, "terms", row, np.int64))
                sums[found] += np.diff(_column(batch, "starts", row, np.int32))[at]
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums[held])], names=["term", "n"])

    # At most one row for each wanted term reaches the driver.
    rows = shards.select("terms", "starts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(wanted), np.int64)
    for row in rows:
        out[row.term] = row.n
    shared.destroy()
    return out


class _Lists:
    """Impact-ordered lists of the wanted terms of one shard, with direct access by document."""

    def __init__(self, batch: pa.RecordBatch, row: int, wanted: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        sizes = _column(batch, "sizes", row, np.int32).astype(np.int64)
        starts = _column(batch, "starts", row, np.int32).astype(np.int64)
        self.ids, self.has_id = _column(batch, "ids", row, np.int64), _column(batch, "has_id", row, bool)
        self.documents = len(sizes)
        found, at = _places(wanted, _column(batch, "terms", row, np.int64))
        self.list_of = np.full(len(wanted), -1, np.int64)
        self.list_of[found] = np.arange(len(found))
        lengths = starts[at + 1] - starts[at]
        self.bounds = np.concatenate([[0], np.cumsum(lengths)])
        source = np.repeat(starts[at] - self.bounds[:-1], lengths) + np.arange(self.bounds[-1])
        docs = _column(batch, "docs", row, np.int32)[source].astype(np.int64)
        tf = _column(batch, "counts", row, np.int32)[source].astype(np.int64)
        of = np.repeat(np.arange(len(found)), lengths)
        m = 75 + 25 * sizes[docs] * n_docs // n_terms
        self.impact = weights[found][of] * (1_000_000_000 * tf // (1000 * tf + 12 * m))  # by list, then document
        self.keys = of * self.documents + docs
        order = np.lexsort((docs, -self.impact, of))
        self.sorted_docs, self.sorted_impact = docs[order], self.impact[order]
        self.place = np.empty(len(order), np.int64)  # where a posting stands in its impact-ordered list
        self.place[order] = np.arange(len(order))
        self.seen = np.zeros(len(order), bool)

    def best(self, terms: np.ndarray, counts: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores that hold the ``k`` best of the item and all that tie with the last of them; those under ``floor`` may be missing."""
        lists = self.list_of[terms]
        counts, lists = counts[lists >= 0], lists[lists >= 0]
        low, high = self.bounds[lists], self.bounds[lists + 1]
        position, touched = low.copy(), []  # best positions: every place before them has been seen
        scored = np.zeros(self.documents, bool)
        docs, scores, step = [], [], 2 * k
        kth = floor
        while len(lists):
            ends = np.minimum(position + step, high)
            sizes = ends - position
            read = np.repeat(position - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            new = np.unique(self.sorted_docs[read])
            new = new[~scored[new]]
            if len(new):
                scored[new] = True
                keys = (lists[:, None] * self.documents + new[None, :]).ravel()
                at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
                hit = self.keys[at] == keys
                impact = np.where(hit, self.impact[at], 0).reshape(len(lists), len(new))
                places = self.place[at[hit]]
                self.seen[places] = True
                touched.append(places)
                docs.append(new)
                scores.append(counts @ impact)
                every = np.concatenate(scores)
                if len(every) >= k:
                    kth = max(floor, int(np.partition(every, len(every) - k)[len(every) - k]))
            for i in range(len(lists)):
                rest = self.seen[ends[i]:high[i]]
                stop = int(np.argmin(rest)) if len(rest) else 0
                position[i] = high[i] if not len(rest) or rest[stop] else ends[i] + stop
            open_ = position < high
            bound = int((counts[open_] * self.sorted_impact[position[open_] - 1]).sum())
            if not open_.any() or bound < kth:
                break
            step = min(2 * step, 4096)
        if touched:
            self.seen[np.concatenate(touched)] = False
        return (np.concatenate(docs), np.concatenate(scores)) if docs else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _top(ids: np.ndarray, has_id: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, has_id, -scores))[:k]
    order = order[scores[order] > 0]
    return ids[order], has_id[order], scores[order]


def _search_block(shards: DataFrame, items: list[tuple], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """Best ``k`` rows of each task and item of one block, stored."""
    spark = shards.sparkSession
    wanted = np.unique(np.concatenate([terms for _, _, terms, _ in items]))
    df = _frequencies(shards, wanted)
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    # Bounded by the bytes of a block of items.
    shared = spark.sparkContext.broadcast((wanted, weights, [(np.searchsorted(wanted, terms), counts) for _, _, terms, counts in items]))
    names = [(item_id, item) for item_id, item, _, _ in items]

    def run(batches):
        wanted, weights, asked = shared.value
        none = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
        tops = [none] * len(asked)
        for batch in batches:
            for row in range(batch.num_rows):
                lists = _Lists(batch, row, wanted, weights, n_docs, n_terms)
                for i, (terms, counts) in enumerate(asked):
                    ids, has_id, scores = tops[i]
                    docs, new = lists.best(terms, counts, k, int(scores[-1]) if len(scores) == k else 1)
                    tops[i] = _top(np.concatenate([ids, lists.ids[docs]]), np.concatenate([has_id, lists.has_id[docs]]), np.concatenate([scores, new]), k)
        counts = [len(s) for _, _, s in tops]
        ids, has_id, scores = (np.concatenate(c) if c else c for c in zip(*tops))
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat([n for _, n in names], counts), pa.int64()),
            pa.array(np.repeat(np.arange(len(names)), counts), pa.int32()),
            pa.array(ids, pa.int64(), mask=~has_id), pa.array(scores, pa.int64())], names=["__item", "__number", "doc_id", "score"])

    found = materialize(shards.mapInArrow(run, "__item long, __number int, doc_id long, score long"), "lexical-found")
    shared.destroy()
    return found


def search(shards: DataFrame, items: DataFrame, k: int = TOP, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The ``k`` best documents of an index for each row of ``items(item_id, text)``: item_id, rank, doc_id, score."""
    kind = items.schema["item_id"].dataType.simpleString()
    items = items.select("item_id", "text").where("text IS NOT NULL").distinct().withColumn("__item", F.xxhash64("item_id", "text"))
    sizes = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("l")).first()
    blocks = 1 + (items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0) // item_bytes
    found = None
    for b in range(blocks if sizes.l else 0):
        rows = _item_terms(items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)) == b))
        if rows:
            part = _search_block(shards, rows, int(sizes.n), int(sizes.l), k).drop("__number")
            found = part if found is None else found.unionByName(part)
    if found is None:
        return items.where("false").select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    best = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    sliced = found.withColumn("__slice", F.pmod(F.xxhash64("doc_id"), F.lit(_MERGE_SLICES)))
    for keys in (["__item", "__slice"], ["__item"]):
        sliced = sliced.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).where(F.col("rank") <= k)
    return sliced.join(items.select("item_id", "__item"), "__item").select(F.col("item_id").cast(kind), "rank", "doc_id", "score")


#: The same ranking in DuckDB.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), s AS (SELECT count(*) FILTER (len(ts) > 0)::BIGINT AS n_docs, coalesce(sum(len(ts)), 0)::BIGINT AS n_terms FROM d
), i AS (
  SELECT row_number() OVER () AS q, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)
), it AS (
  SELECT q, item_id, t, count(*)::BIGINT AS c FROM (
    SELECT q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM i)
  GROUP BY ALL
), p AS (
  SELECT r, doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(ts)::BIGINT AS n, unnest(ts) AS t FROM d)
  WHERE t IN (SELECT t FROM it) GROUP BY ALL
), w AS (
  SELECT t, floor(1000 * ln((2 * (SELECT n_docs FROM s) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p GROUP BY t
), e AS (
  SELECT q, item_id, r, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * (SELECT n_docs FROM s)) // (SELECT n_terms FROM s)))))::BIGINT AS score
  FROM p JOIN w USING (t) JOIN it USING (t) GROUP BY q, item_id, r, doc_id
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank, doc_id, score FROM e WHERE score > 0)
WHERE rank <= 20
"""

"""Near duplicates: MinHash signatures, bands, checked links on full sets, connected components.

A document is the set of its distinct word shingles (A-Z lower-cased; a text of fewer words is one shingle). Documents with the same set are one class from the start,
found by a 128-bit sum over the set, so copies are never compared with each other. One representative of each class gets
``BANDS * ROWS`` universal hash minima. Classes that agree in all rows of a band are candidates: at a similarity of 0.8 a pair is missed with probability
(1 - 0.8 ** ROWS) ** BANDS, about 5e-8.

Candidates of a band bucket are not paired with each other. Its hub, the member that meets most others over all its buckets, is compared with every member; that links most of a group of
copies at once. What is left are members that no hub links. They are compared with all others of the same hub in blocks of ``BLOCK`` documents: a block pair
counts common bits of hashed sets by one matrix product, which bounds every intersection from above, and looks at full sets only where the bound and the components leave a link open. Blocks hand out
links, never pairs, so every candidate pair is either compared or already connected. Comparisons with a hub look at the signatures first (a pair whose signatures agree in under half of the places is no link: at similarity
0.8 that has a chance under 1e-15), then at the full sets.

Defined cases: null or empty texts and texts without words have no shingles, are linked with nothing and form a component each; rows that repeat an id are one node
with the links of all its texts; rows without an id are never linked, have no component and are kept; an empty table gives no rows; further columns are ignored
unless named in ``keep``.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from promptloom.llm.components import components
from promptloom.llm.spans import emit, grams, mix, slices
from promptloom.sources.workspace import materialize

BANDS, ROWS = 32, 4
BLOCK = 256
_BITS = 13
SHINGLE_WORDS = 5
PERCENT = 80


def _hash_family(count: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(7)
    return draw.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 2**63, count, dtype=np.uint64)


def shingle_sets(texts, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every row."""
    texts.find_words()
    words = texts.word_hashes(lower=True)
    runs = grams(words, size)
    sets = []
    for low, high in zip(texts.words[:-1].tolist(), texts.words[1:].tolist()):
        if high - low >= size:
            sets.append(np.unique(runs[low:high - size + 1]))
        elif high > low:
            sets.append(grams(words[low:high], high - low) + np.uint64(high - low))
        else:
            sets.append(words[:0])
    return sets


def signature(values: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The minimum of each universal hash over a set, as its high 32 bits; long sets are taken in blocks."""
    a, b = family
    low = np.full(len(a), 2**64 - 1, np.uint64)
    for k in range(0, len(values), 2048):
        np.minimum(low, (values[k:k + 2048, None] * a + b).min(0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def _bands(sign: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for column in sign.reshape(bands, rows).T.astype(np.uint64):
        keys = mix(keys + column)
    return keys.view(np.int64)


def _sketches(docs: DataFrame, keep: list[str], size: int, bands: int, rows: int) -> DataFrame:
    """Set size, 128-bit key of the set and band keys of every row."""
    def run(batches):
        family = _hash_family(bands * rows)
        for batch, texts in slices(batches):
            sets = shingle_sets(texts, size)
            keys = [_bands(signature(s, family), bands, rows) if len(s) else np.zeros(0, np.int64) for s in sets]
            with np.errstate(over="ignore"):
                h1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                h2 = np.array([mix(s + np.uint64(1)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            lengths = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield emit(batch, keep, n_shingles=np.array([len(s) for s in sets], np.int64), h1=h1, h2=h2,
                       bands=pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat)))

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n_shingles long, h1 long, h2 long, bands array<long>"
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def _full_sets(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """``doc_id``, signature and full set as bytes."""
    def run(batches):
        family = _hash_family(bands * rows)
        for batch, texts in slices(batches):
            sets = shingle_sets(texts, size)
            yield emit(batch, ["doc_id"], sign=pa.array([signature(s, family).tobytes() for s in sets], pa.binary()),
                       items=pa.array([s.tobytes() for s in sets], pa.binary()))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, sign binary, items binary")


def _confirm(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose signatures are near enough and whose full sets reach the similarity."""
    def run(batches):
        for batch in batches:
            u_sign, v_sign, u_items, v_items = (batch.column(batch.schema.get_field_index(c)) for c in ("u_sign", "v_sign", "u_items", "v_items"))
            linked = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                a, b = np.frombuffer(u_sign[k].as_py(), np.uint32), np.frombuffer(v_sign[k].as_py(), np.uint32)
                if 2 * np.count_nonzero(a == b) < len(a):
                    continue
                a, b = np.frombuffer(u_items[k].as_py(), np.uint64), np.frombuffer(v_items[k].as_py(), np.uint64)
                if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                    continue
                common = len(np.intersect1d(a, b, assume_unique=True))
                linked[k] = 100 * common >= percent * (len(a) + len(b) - common)
            yield batch.select(["u", "v"]).filter(pa.array(linked))

    return pairs.select("u", "v", "u_sign", "v_sign", "u_items", "v_items").mapInArrow(run, "u long, v long")


def _hubs(members: DataFrame) -> DataFrame:
    """``hub, doc_id``: every member of every bucket with the bucket's hub, each pair once."""
    best = members.groupBy("bucket").agg(F.max_by("doc_id", F.struct("degree", -F.col("doc_id"))).alias("hub"))
    return members.join(best, "bucket").select("hub", "doc_id").distinct()


def _block_links(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links between documents of different components; rows are (left side?, right side?, doc_id, component, set)."""
    left = [k for k, r in enumerate(rows) if r[0]]
    right = [k for k, r in enumerate(rows) if r[1]]
    if not left or not right:
        return []
    sets = [np.frombuffer(r[4], np.uint64) for r in rows]
    size = np.array([len(s) for s in sets])
    bits = np.zeros((len(rows), 1 << _BITS), np.float32)
    for k, s in enumerate(sets):
        bits[k, s >> np.uint64(64 - _BITS)] = 1
    lost = size - bits.sum(1)
    # Elements of one document that share a bit are counted once, so what a document lost bounds what the product misses.
    bound = bits[left] @ bits[right].T + np.minimum(lost[left][:, None], lost[right][None, :])
    n = size[left][:, None] + size[right][None, :]
    open_ = np.argwhere(bound * (100 + percent) >= percent * n)
    root = {r[3]: r[3] for r in rows}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for i, j in open_.tolist():
        i, j = left[i], right[j]
        a, b = find(rows[i][3]), find(rows[j][3])
        if a == b:
            continue
        common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if 100 * common >= percent * (size[i] + size[j] - common):
            root[a] = b
            links.append((rows[i][2], rows[j][2]))
    return links


def _rest(hubs: DataFrame, sets: DataFrame, found: DataFrame, percent: int, block: int) -> DataFrame:
    """Links among documents of one hub that are not connected yet."""
    named = found.select(F.col("node").alias("doc_id"), "component")
    known = (hubs.join(named, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
             .join(named.select(F.col("doc_id").alias("hub"), F.col("component").alias("hub_component")), "hub", "left")
             .withColumn("joined", F.col("component") == F.coalesce("hub_component", "hub")))
    # A hub with fewer than two documents outside its component and none inside besides itself has nothing left to compare.
    sizes = (known.groupBy("hub").agg(F.sum((~F.col("joined")).cast("int")).alias("loose"), F.sum(F.col("joined").cast("int")).alias("tied"))
             .where("loose > 0 AND loose + tied > 2"))
    loose_blocks, tied_blocks = F.ceil(F.col("loose") / block).cast("int"), F.ceil(F.col("tied") / block).cast("int")
    own = F.pmod(F.xxhash64("doc_id", "hub"), F.when(F.col("joined"), tied_blocks).otherwise(loose_blocks)).cast("int")
    # Keys are (loose block, other block, whether the other block is loose too).
    with_loose = F.transform(F.sequence(F.lit(0), F.col("loose_blocks") - 1), lambda j: F.struct(
        F.least("own", j).alias("i"), F.greatest("own", j).alias("j"), F.lit(True).alias("both"),
        (F.col("own") <= j).alias("is_left"), (F.col("own") >= j).alias("is_right")))
    with_tied = F.when(F.col("tied_blocks") > 0, F.transform(F.sequence(F.lit(0), F.greatest("tied_blocks", F.lit(1)) - 1), lambda j: F.struct(
        F.col("own").alias("i"), j.alias("j"), F.lit(False).alias("both"), F.lit(True).alias("is_left"), F.lit(False).alias("is_right"))))
    none = F.array().cast("array<struct<i:int,j:int,both:boolean,is_left:boolean,is_right:boolean>>")
    to_loose = F.transform(F.sequence(F.lit(0), F.col("loose_blocks") - 1), lambda j: F.struct(
        j.alias("i"), F.col("own").alias("j"), F.lit(False).alias("both"), F.lit(False).alias("is_left"), F.lit(True).alias("is_right")))
    keyed = (known.join(sizes, "hub").withColumns({"own": own, "loose_blocks": loose_blocks, "tied_blocks": tied_blocks})
             .join(sets.select("doc_id", "items"), "doc_id")
             .select("hub", "doc_id", "component", "items",
                     F.explode(F.when(F.col("joined"), to_loose).otherwise(F.concat(with_loose, F.coalesce(with_tied, none)))).alias("k"))
             .select("hub", "k.*", "doc_id", "component", "items"))

    def run(batches):
        held, key = [], None
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("hub", "i", "j", "both", "is_left", "is_right", "doc_id", "component", "items")]
            for row in zip(*columns):
                if row[:4] != key:
                    yield from _link_batch(_block_links(held, percent))
                    held, key = [], row[:4]
                held.append(row[4:])
        yield from _link_batch(_block_links(held, percent))

    return keyed.repartition("hub", "i", "j", "both").sortWithinPartitions("hub", "i", "j", "both").mapInArrow(run, "u long, v long")


def _link_batch(links: list[tuple[int, int]]):
    if links:
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in links], pa.int64()), pa.array([v for _, v in links], pa.int64())], names=["u", "v"])


def near_duplicates(docs: DataFrame, keep: list[str] | None = None, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT,
                    bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """Every row with its set size, its component and whether it is the one that stays."""
    keep = keep or ["doc_id"]
    if "doc_id" not in keep:
        raise ValueError("keep must hold doc_id")
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    sketches = materialize(_sketches(docs, keep, shingle_words, bands, rows), "near-sketches")
    whole = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialize(whole.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("class_id")), "near-classes")
    # Rows that repeat an id with other texts are one node: each of their classes is linked to the id.
    shared = whole.select("doc_id", "h1", "h2", "n_shingles").join(classes, ["h1", "h2", "n_shingles"])
    same_id = (shared.groupBy("doc_id").agg(F.min("class_id").alias("u"), F.max("class_id").alias("v"), F.max("doc_id").alias("d"))
               .where("u <> v"))
    same_id = shared.join(same_id.select("doc_id"), "doc_id").select(F.col("doc_id").alias("u"), F.col("class_id").alias("v")).where("u <> v")

    heads = (whole.join(classes.select("h1", "h2", "n_shingles", F.col("class_id").alias("doc_id")), ["h1", "h2", "n_shingles", "doc_id"])
             .select("doc_id", F.explode("bands").alias("bucket")))
    crowded = (heads.groupBy("bucket").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.count("*").alias("size"))
               .where("a <> z").select("bucket", "size"))
    members = materialize(heads.join(crowded, "bucket").select("bucket", "doc_id", "size").distinct(), "near-members")
    links = materialize(same_id.distinct(), "near-links")
    if not members.isEmpty():
        # The member that meets most others is the likeliest to be linked to them all.
        wanted = members.groupBy("doc_id").agg(F.sum("size").alias("degree"))
        sets = materialize(_full_sets(docs.join(wanted.select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi"), shingle_words, bands, rows), "near-sets")
        hubs = materialize(_hubs(members.drop("size").join(wanted, "doc_id")), "near-hubs")
        u = sets.select(F.col("doc_id").alias("u"), F.col("sign").alias("u_sign"), F.col("items").alias("u_items"))
        v = sets.select(F.col("doc_id").alias("v"), F.col("sign").alias("v_sign"), F.col("items").alias("v_items"))
        pairs = hubs.where("hub <> doc_id").select(F.least("hub", "doc_id").alias("u"), F.greatest("hub", "doc_id").alias("v")).distinct()
        links = materialize(links.union(_confirm(pairs.join(u, "u").join(v, "v"), percent)), "near-links")
        links = materialize(links.union(_rest(hubs, sets, components(links), percent, block)), "near-links")
    found = components(links)
    labelled = (classes.join(found, F.col("class_id") == F.col("node"), "left")
                .select("h1", "h2", F.col("n_shingles").alias("size"), F.coalesce("component", "class_id").alias("component_id")))
    s = sketches.alias("s")
    return (s.join(labelled.alias("l"), (F.col("s.h1") == F.col("l.h1")) & (F.col("s.h2") == F.col("l.h2")) & (F.col("s.n_shingles") == F.col("l.size")), "left")
            .select(*[F.col(f"s.{c}") for c in keep], "s.n_shingles",
                    F.when(F.col("s.doc_id").isNotNull(), F.coalesce("l.component_id", "s.doc_id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))

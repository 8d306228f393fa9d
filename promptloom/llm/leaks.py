"""Benchmark decontamination: random-walk embedding, bit sampling, exact edit distance.

Texts and items are word sequences (A-Z lower-cased). A window of 12 words, or 6 for items of under 30 words, is
embedded by the CGK walk: a pointer reads a word, writes its hash and moves on or stays by a random bit of that hash, so two windows at a small edit distance fall
into step again and agree in most places of the embedding. Several walks with several samples of a few places each give one key a sample; short windows get more of them. Every window
of every text is looked up among the keys of all windows of the items; an item of n words offers n - 11 (n - 5) windows, and one hit at any of them makes a candidate. Candidates are
checked by the exact word edit distance between the whole item and the text around the hit (both ends in the text free): an item is leaked if
``100 * edits <= percent * words``.

An item with e edits keeps a run of (n - e) / (e + 1) words or more as it was, three words at a fifth of edits. Windows of a text that hold no run of that many words of any item
are no part of a leak and are passed over; this is exact and leaves few windows to walk. Items of under six words are found by such runs alone, which is exact too.

The items are the query set. They are taken in blocks of ``BLOCK_WORDS`` words, so what is broadcast has a fixed bound; the texts are read once a block and never
shuffled. The distance of one text and item is settled inside one task.

Defined cases: null or empty texts leak nothing; null items, items without words and items of under ``least_words`` words (none by default) are not searched; repeated rows and ids are
searched one by one; rows with equal ``item_id`` are separate items, of which each text reports the best; items without an id are searched and reported with a null id;
an empty table on either side gives no leaks; further columns never matter.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from promptloom.llm.spans import Texts, grams, mix, slices, texts_of

PERCENT = 20
LEAST_WORDS = 1
#: Items of fewer words are found by their runs of words alone.
SHORT_WORDS = 6
#: Least words of an item, window words, places sampled for one key, walks, samples of each walk. Items of under 30 words have too few windows of 12 words to be found under a fifth of edits.
CLASSES = ((30, 12, 6, 2, 6), (SHORT_WORDS, 6, 4, 4, 8))
BLOCK_WORDS = 200_000
#: Longest run of words that marks windows.
_RUN = 3
_CHUNK = 1 << 15
_MAP_BITS = 21
_MARK_BITS = 24


def _samples(size: int, taken: int, walks: int, tables: int) -> list[list[list[int]]]:
    """For each walk and table the sorted steps that make up its key."""
    draw = np.random.default_rng(size)
    return [[sorted(draw.choice(2 * size, taken, replace=False).tolist()) for _ in range(tables)] for _ in range(walks)]


def walk_keys(words: np.ndarray, starts: np.ndarray, size: int, samples: list[list[int]], seed: int) -> list[np.ndarray]:
    """The key of each table for the windows of ``size`` words at ``starts``; ``words`` must reach past every window."""
    hashed = mix(words ^ np.uint64(0x51ED270B * (seed + 1))) if len(starts) * size > len(words) else None
    at, last = starts.copy(), starts + (size - 1)
    keys = [np.zeros(len(starts), np.uint64) for _ in samples]
    for step in range(2 * size):
        read = hashed[at] if hashed is not None else mix(words[at] ^ np.uint64(0x51ED270B * (seed + 1)))
        for key, steps in zip(keys, samples):
            if step in steps:
                key += read
                key *= np.uint64(0x9E3779B97F4A7C15)
        at += ((read >> np.uint64(step)) & np.uint64(1)).astype(np.int64)
        np.minimum(at, last, out=at)
    return [mix(key) for key in keys]


def kept_run(length: int, percent: int) -> int:
    """Words of an item of ``length`` words that stand next to each other unedited in any leak of it, at least."""
    edits = length * percent // 100
    return max(1, -(-(length - edits) // (edits + 1)))


def _flat(items: list[np.ndarray], chosen: list[int], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the chosen items behind each other, and the start, item and offset of each of their windows of ``size`` words."""
    words = np.concatenate([items[i] for i in chosen])
    counts = np.array([len(items[i]) - size + 1 for i in chosen])
    bases = np.cumsum([0, *[len(items[i]) for i in chosen]])[:-1]
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return words, np.repeat(bases, counts) + offset, np.repeat(chosen, counts), offset


def _bitmap(keys: np.ndarray, bits: int) -> np.ndarray:
    present = np.zeros(1 << bits, bool)
    present[keys >> np.uint64(64 - bits)] = True
    return np.packbits(present)


def build_index(items: list[np.ndarray], percent: int = PERCENT) -> dict:
    """Keys of all items: ``runs`` finds short items, ``marks`` the windows of texts to look at, ``classes`` what these windows agree with."""
    index = {"runs": [], "classes": [], "marks": None}
    sizes = np.array([len(w) for w in items], np.int64)
    for length in np.unique(sizes[(sizes > 0) & (sizes < SHORT_WORDS)]).tolist():
        run = kept_run(length, percent)
        words, starts, item, offset = _flat(items, np.flatnonzero(sizes == length).tolist(), run)
        keys = grams(words, run)[starts]
        order = np.argsort(keys)
        index["runs"].append({"run": run, "keys": keys[order], "item": item[order], "offset": offset[order]})
    long = np.flatnonzero(sizes >= SHORT_WORDS).tolist()
    if long:
        run = min(_RUN, *[kept_run(n, percent) for n in np.unique(sizes[long]).tolist()], _RUN)
        words, starts, _, _ = _flat(items, long, run)
        keys = np.unique(grams(words, run)[starts])
        index["marks"] = {"run": run, "keys": keys, "map": _bitmap(keys, _MARK_BITS)}
    for k, (least, size, taken, walks, tables) in enumerate(CLASSES):
        top = CLASSES[k - 1][0] if k else 1 << 62
        chosen = np.flatnonzero((sizes >= least) & (sizes < top)).tolist()
        if not chosen:
            continue
        words, starts, item, offset = _flat(items, chosen, size)
        held = []
        for walk, samples in enumerate(_samples(size, taken, walks, tables)):
            for keys in walk_keys(words, starts, size, samples, walk):
                order = np.argsort(keys)
                held.append((keys[order], item[order], offset[order], _bitmap(keys, _MAP_BITS)))
        index["classes"].append({"size": size, "shape": (size, taken, walks, tables), "tables": held})
    return index


def _matches(keys: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every (place in ``keys``, place in the sorted ``held``) with the same value."""
    left, right = np.searchsorted(held, keys), np.searchsorted(held, keys, side="right")
    n = right - left
    return np.repeat(np.arange(len(keys)), n), np.repeat(left - np.cumsum(n) + n, n) + np.arange(n.sum())


def _marked(words: np.ndarray, marks: dict, size: int) -> np.ndarray:
    """Starts of the windows of ``size`` words that hold a run of words of some item."""
    runs = grams(words, marks["run"])
    present = np.unpackbits(marks["map"]).view(bool)
    at = np.flatnonzero(present[runs >> np.uint64(64 - _MARK_BITS)])
    near = np.minimum(np.searchsorted(marks["keys"], runs[at]), len(marks["keys"]) - 1)
    at = at[marks["keys"][near] == runs[at]]
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, np.maximum(at - (size - marks["run"]), 0), 1)
    np.add.at(edges, at + 1, -1)
    return np.flatnonzero(np.cumsum(edges)[:-1] > 0)


def candidates(words: np.ndarray, index: dict) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (item, start of the item in ``words``) that some key points to, by item; the start may lie before the text."""
    found = []
    base = np.int64(1 << 31)  # starts before the text are negative

    def add(item: np.ndarray, start: np.ndarray) -> None:
        found.append(np.unique((item.astype(np.int64) << 32) + start + base))

    for part in index["runs"]:
        at, to = _matches(grams(words, part["run"]), part["keys"])
        add(part["item"][to], at - part["offset"][to])
    for part in index["classes"]:
        size, padded = part["size"], np.concatenate([words, np.zeros(part["size"], np.uint64)])
        starts = _marked(words, index["marks"], size)
        maps = [np.unpackbits(t[3]).view(bool) for t in part["tables"]] if len(starts) else []
        for low in range(0, len(starts), _CHUNK):
            some = starts[low:low + _CHUNK]
            table = 0
            for walk, samples in enumerate(_samples(*part["shape"])):
                for keys in walk_keys(padded, some, size, samples, walk):
                    held, item, offset, _ = part["tables"][table]
                    hit = np.flatnonzero(maps[table][keys >> np.uint64(64 - _MAP_BITS)])
                    at, to = _matches(keys[hit], held)
                    table += 1
                    if len(at):
                        add(item[to], some[hit[at]] - offset[to])
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs >> 32, (pairs & ((1 << 32) - 1)) - base


def edit_distances(item: np.ndarray, words: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word edits between ``item`` and the best stretch of ``words[low:high]`` for each pair of bounds, and where that stretch lies."""
    width = int((high - low).max())
    place = low[:, None] + np.arange(width)
    inside = place < high[:, None]
    text = np.where(inside, words[np.minimum(place, len(words) - 1)], np.uint64(0))
    unit = np.int64(1 << 32)  # edits in the high half, the start of the stretch in the low half
    code = np.broadcast_to(np.arange(width + 1, dtype=np.int64), (len(low), width + 1)).copy()
    steps = np.arange(width + 1, dtype=np.int64) * unit
    for word in item:
        turned = code + unit
        np.minimum(turned[:, 1:], code[:, :-1] + unit * ((text != word) | ~inside), out=turned[:, 1:])
        code = np.minimum.accumulate(turned - steps, axis=1) + steps
    code[:, 1:][~inside] = np.iinfo(np.int64).max
    end = code.argmin(1)
    best = code[np.arange(len(low)), end]
    return best >> 32, low + (best & (unit - 1)), low + end


def _possible(item: np.ndarray, words: np.ndarray, spans: np.ndarray, least: int) -> np.ndarray:
    """The distinct (row, low, high) with ``least`` words that occur in the item; with fewer, too many edits are certain."""
    spans = np.unique(spans, axis=0)
    known = np.zeros(1 << 12, bool)
    known[item >> np.uint64(52)] = True
    good = []
    for k in range(0, len(spans), 4096):
        block = spans[k:k + 4096]
        place = block[:, 1:2] + np.arange(int((block[:, 2] - block[:, 1]).max()))
        held = known[words[np.minimum(place, len(words) - 1)] >> np.uint64(52)] & (place < block[:, 2:])
        good.append(block[held.sum(1) >= least])
    return np.concatenate(good)


def find_leaks(texts: Texts, items: list[np.ndarray], index: dict, percent: int) -> list[tuple[int, int, int, int, int]]:
    """(row, item, edits, first word, end word) of every leak of a row, the best one for each item."""
    texts.find_words()
    words = texts.word_hashes(lower=True)
    which, start = candidates(words, index)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    bounds = texts.words
    edges = np.flatnonzero(np.diff(which, prepend=-1, append=-1)) if len(which) else []
    for a, b in zip(edges[:-1], edges[1:]):
        k = int(which[a])
        item, at = items[k], start[a:b]
        slack = len(item) * percent // 100
        # The hit itself tells the row: a start before the row's first word still has its hit inside.
        middle = np.clip(at + len(item) // 2, 0, len(words) - 1)
        for probe in (at, middle, at + len(item) - 1):
            row = np.searchsorted(bounds, np.clip(probe, 0, len(words) - 1), side="right") - 1
            low = np.maximum(at - slack, bounds[row])
            high = np.minimum(at + len(item) + slack, bounds[row + 1])
            fits = high - low >= len(item) - slack
            if not fits.any():
                continue
            spans = _possible(item, words, np.column_stack([row[fits], low[fits], high[fits]]), len(item) - slack)
            for k0 in range(0, len(spans), 4096):
                block = spans[k0:k0 + 4096]
                edits, x, y = edit_distances(item, words, block[:, 1], block[:, 2])
                for r, e, s, t in zip(block[:, 0].tolist(), edits.tolist(), x.tolist(), y.tolist()):
                    if 100 * e <= percent * len(item):
                        first = int(bounds[r])
                        best[r, k] = min(best.get((r, k), (1 << 40, 0, 0)), (e, s - first, t - first))
    return [(r, k, *v) for (r, k), v in sorted(best.items())]


def item_blocks(benchmark: DataFrame, block_words: int, least_words: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """The items as ids and word hashes, in blocks of about ``block_words`` words, streamed one partition at a time."""
    ids, items, total = [], [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        texts = texts_of(pa.array([row.text], pa.string()))
        texts.find_words()
        words = texts.word_hashes(lower=True)
        if len(words) < least_words:
            continue
        ids.append(row.item_id)
        items.append(words)
        total += len(words)
        if total >= block_words:
            yield ids, items
            ids, items, total = [], [], 0
    if items:
        yield ids, items


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, block_words: int = BLOCK_WORDS, least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, item_id, edits, item_words, first_word, end_word`` for every leaked item of every row."""
    schema = "doc_id long, item_id long, edits long, item_words long, first_word long, end_word long"
    context = docs.sparkSession.sparkContext
    out = None
    for ids, items in item_blocks(benchmark, block_words, least_words):
        # 12 keys of 24 bytes a word, 32 for short items: at most about 160 MB a block.
        shared = context.broadcast((ids, items, build_index(items, percent)))

        def run(batches, shared=shared):
            names, held, index = shared.value
            for batch, texts in slices(batches):
                found = find_leaks(texts, held, index, percent)
                rows = batch.column(batch.schema.get_field_index("doc_id")).take(pa.array([f[0] for f in found], pa.int64()))
                item_ids = pa.array([names[f[1]] for f in found], pa.int64())
                lengths = pa.array([len(held[f[1]]) for f in found], pa.int64())
                numbers = [pa.array([f[k] for f in found], pa.int64()) for k in (2, 3, 4)]
                yield pa.RecordBatch.from_arrays([rows.cast(pa.int64()), item_ids, numbers[0], lengths, numbers[1], numbers[2]],
                                                 names=[c.split()[0] for c in schema.split(", ")])

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_leaked(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, block_words: int = BLOCK_WORDS,
                least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, that leak no item."""
    context = docs.sparkSession.sparkContext
    for ids, items in item_blocks(benchmark, block_words, least_words):
        shared = context.broadcast((ids, items, build_index(items, percent)))

        def run(batches, shared=shared):
            _, held, index = shared.value
            for batch, texts in slices(batches):
                clean = np.ones(texts.rows, bool)
                clean[[f[0] for f in find_leaks(texts, held, index, percent)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

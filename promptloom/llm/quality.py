"""Quality rules: counting rules and a calibrated logistic regression over hashed n-grams.

``score`` counts, for each whole text, words, characters in words, symbols, repeated lines and repeated eight-word windows, and
asks a classifier for the probability that the text is good. The classifier is a logistic regression over hashed
words, word pairs and character trigrams; it is fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``, the rows with the lowest hash of
the id) and its output is turned into a probability on rows held out from the fit. Thresholds are fixed parameters.

Defined cases: a null text counts as empty; a text without words has ``n_words`` 0 and fails the base rules; rows that repeat an id or
a text are scored one by one; with no usable labels (none, or one class only) the verdict is the base rules' alone and ``quality`` is null;
further columns of the input are kept by ``score(..., keep=...)`` and never enter the score.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from promptloom.llm.linear import fit_logistic, fit_platt
from promptloom.llm.spans import Prefix, Texts, emit, grams, mix, per_row, slices

SAMPLE_ROWS = 4_000
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MIN_PROBABILITY = 0.4
BITS = 18
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def _repeats(row_of: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value: does it occur twice or more in its row, and is it not the first there."""
    keys = mix(hashes + row_of.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    several, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    several[order[1:][same]] = True
    later[order[1:][same]] = True
    several[order[:-1][same]] = True
    return several, later


def base_counts(texts: Texts) -> dict[str, np.ndarray]:
    """The counts of the base rules for every row; needs ``find_words``."""
    words, data = texts.words, texts.data
    n_words = np.diff(words)
    row_of_word = np.repeat(np.arange(texts.rows), n_words)
    characters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    word_chars = per_row(words, characters[texts.ends] - characters[texts.starts])
    n_symbols = per_row(texts.bounds, _SYMBOLS[data])

    starts, ends, first = texts.find_lines()
    row_of_line = np.repeat(np.arange(texts.rows), np.diff(first))
    has_word = np.searchsorted(texts.starts, ends) > np.searchsorted(texts.starts, starts)
    prefix = Prefix(data)
    _, later = _repeats(row_of_line, prefix.spans(starts, ends))
    n_dup_lines = per_row(first, later & has_word)

    windows = grams(prefix.spans(texts.starts, texts.ends), 8)
    inside = np.flatnonzero(row_of_word[:len(windows)] == row_of_word[7:]) if len(windows) else np.zeros(0, np.int64)
    several, _ = _repeats(row_of_word[inside], windows[inside])
    edges = np.zeros(len(row_of_word) + 1, np.int64)
    np.add.at(edges, inside[several], 1)
    np.add.at(edges, inside[several] + 8, -1)
    n_repeat_words = per_row(words, np.cumsum(edges)[:-1] > 0)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines,
            "n_repeat_words": n_repeat_words}


def features(texts: Texts) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashed words, word pairs and character trigrams of all rows, each with the bounds of every row."""
    words = texts.word_hashes()
    shift = np.uint64(64 - BITS)
    pairs = grams(words, 2)
    trigrams = Prefix(texts.data).windows(3)
    parts = []
    for values, bounds, size in ((words, texts.words, 1), (pairs, texts.words, 2), (trigrams, texts.bounds, 3)):
        low = np.minimum(bounds[:-1], len(values))
        high = np.clip(bounds[1:] - size + 1, low, len(values))
        parts.append(((mix(values + np.uint64(size)) >> shift).astype(np.int32), low, high))
    return parts


def row_sums(parts, weights: np.ndarray, rows: int) -> np.ndarray:
    """Mean weight of each kind of feature, added over the kinds."""
    total = np.zeros(rows)
    for index, low, high in parts:
        sums = np.concatenate([[0.0], np.cumsum(weights[index], dtype=np.float64)])
        total += (sums[high] - sums[low]) / np.maximum(high - low, 1)
    return total


def _sparse_rows(batches):
    """The features of each row with their share, for the fit."""
    for batch, texts in slices(batches):
        texts.find_words()
        parts = features(texts)
        index, value = [], []
        for row in range(texts.rows):
            found, share = [], []
            for hashed, low, high in parts:
                i, n = np.unique(hashed[low[row]:high[row]], return_counts=True)
                found.append(i)
                share.append(n / max(1, high[row] - low[row]))
            index.append(np.concatenate(found).astype(np.int32).tobytes())
            value.append(np.concatenate(share).astype(np.float32).tobytes())
        yield emit(batch, ["doc_id", "label"], index=pa.array(index, pa.binary()), value=pa.array(value, pa.binary()))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict | None:
    """A classifier for ``labels.quality`` from at most ``sample_rows`` labelled rows; None without both classes."""
    chosen = (labels.where("doc_id IS NOT NULL AND quality IN (0, 1)")
              .groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    # At most sample_rows ids of 12 bytes.
    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
            .mapInArrow(_sparse_rows, "doc_id long, label int, index binary, value binary")
            .withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(sample_rows).collect())
    y = np.array([r["label"] for r in rows], float)
    if len(set(y.tolist())) < 2:
        return None
    lengths = np.array([len(r["index"]) // 4 for r in rows])
    index = np.frombuffer(b"".join(r["index"] for r in rows), np.int32)
    value = np.frombuffer(b"".join(r["value"] for r in rows), np.float32)
    del rows
    held = np.arange(len(y)) % 3 == 2
    if min(y[~held].sum(), (1 - y[~held]).sum(), y[held].sum(), (1 - y[held]).sum()) < 1:
        held = np.zeros(len(y), bool)
    learn = np.flatnonzero(~held)
    weights, bias, raw = fit_logistic(index, value, lengths, y, learn, 1 << BITS)
    check = np.flatnonzero(held) if held.any() else learn
    return {"weights": weights.astype(np.float32), "bias": bias, "platt": fit_platt(raw[check], y[check])}


def keep_good(docs: DataFrame, model: dict | None, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT,
              min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """The rows of ``docs``, all columns, that the rules and the classifier keep."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, texts in slices(batches):
            *_, good = _verdicts(texts, shared.value, min_words, max_repeat_percent, min_probability)
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def _verdicts(texts: Texts, fitted: dict | None, min_words: int, max_repeat_percent: int, min_probability: float):
    """Counts, base failure, probability (None without a classifier) and verdict of every row."""
    texts.find_words()
    counts = base_counts(texts)
    n, repeated = counts["n_words"], counts["n_repeat_words"]
    failed = (n < min_words) | (100 * repeated > max_repeat_percent * n)
    if fitted is None:
        return counts, failed, None, ~failed
    a, b = fitted["platt"]
    raw = row_sums(features(texts), fitted["weights"], texts.rows) + fitted["bias"]
    chance = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
    return counts, failed, chance, ~failed & (chance >= min_probability)


def score(docs: DataFrame, model: dict | None, keep: list[str] | None = None, min_words: int = MIN_WORDS,
          max_repeat_percent: int = MAX_REPEAT_PERCENT, min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """Counts, base verdict, probability and verdict of every row, beside the columns ``keep`` (``doc_id`` by default)."""
    keep = keep or ["doc_id"]
    # The weights have a fixed size, 4 bytes for each of 2 ** BITS features.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, texts in slices(batches):
            counts, failed, chance, good = _verdicts(texts, shared.value, min_words, max_repeat_percent, min_probability)
            quality = pa.nulls(texts.rows, pa.float64()) if chance is None else pa.array(chance)
            yield emit(batch, keep, **counts, base_failed=failed, kept=good, quality=quality)

    columns = list(dict.fromkeys([*keep, "text"]))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + (
        ", n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean,"
        " quality double")
    return docs.select(*columns).mapInArrow(run, schema)

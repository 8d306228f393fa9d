"""Toxicity: a gapped-subsequence string kernel, Nystroem landmarks and a linear support vector machine.

The kernel of two words counts the common three-character subsequences whose steps are 1 to 3 characters long, each weighted by ``DECAY`` to the power of its
length, and divides by the norms of words of these lengths. Characters that are inserted, dropped or replaced by punctuation only lengthen gaps, and letters set apart by single
spaces are read as one word, so disguised insults stay close to plain ones. Word starts and ends are characters of their own.

Training takes a bounded sample of labelled rows (``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN``, by hash of the id). Labels hold for whole texts, so which words carry them is learned too:
starting from words that are far more frequent in toxic texts, the machine is fitted, the highest word of each toxic text and the highest words of clean texts
become the next examples, and so on. Landmarks are spread over the examples. As the kernel is a product of explicit features, the fitted machine is one weight for each
subsequence; a text's raw score is that of its highest word. The operating point, the raw score that stands for ``THRESHOLD``, is chosen on sampled rows that were not used as examples:
the middle of all that come within ``TOLERANCE`` of the best balance of recall and precision. A steep sigmoid through it gives the score. Some labels are explained by no word; a
sigmoid fitted to all labels would be flattened by them.

Defined cases: null or empty texts and texts without words get the score of a word without features; rows without an id are never learned from and not held out;
repeated rows and ids are scored one by one; with no usable labels (none, or one class only) every score is 0; an empty table gives no rows; further columns are ignored unless named in ``keep``.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from promptloom.llm.spans import LOWER, Texts, emit, slices, texts_of

SAMPLE_TOXIC, SAMPLE_CLEAN = 1_500, 3_000
LANDMARKS = 160
ROUNDS = 3
#: Bounds inside the sample: words that landmarks are spread over, most frequent words and others of clean texts that serve as examples, and their hardest words.
SPREAD_WORDS, USUAL_WORDS, OTHER_WORDS, HARD_WORDS = 2_000, 4_000, 8_000, 3_000
DECAY = 0.7
STEPS = tuple((a, b) for a in (1, 2, 3) for b in (1, 2, 3))
THRESHOLD = 0.7
TOLERANCE, STEEPNESS = 0.01, 4.0
_EDGE = 31
#: 1-26 letters, 27-30 bytes of other scripts, 31 white space, 0 anything else.
_CLASS = np.zeros(256, np.uint16)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[128:] = 27 + np.arange(128) % 4
_CLASS[[0x20, *range(0x09, 0x0E)]] = _EDGE
_CLASS = _CLASS[LOWER]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Words:
    """Words of a slice as class codes, with single letters in a row read as one word."""

    def __init__(self, texts: Texts):
        # A space in front of every text gives its first word a start.
        padded = Texts(np.append(np.insert(texts.data, texts.bounds[:-1], 32), np.uint8(32)),
                       texts.bounds + np.arange(texts.rows + 1))
        padded.bounds[-1] = len(padded.data) - 1
        body = Texts(padded.data[:-1], padded.bounds)
        body.find_words()
        self.codes = _CLASS[padded.data]
        starts, ends, rows = body.starts, body.ends, body.words
        row = np.repeat(np.arange(texts.rows), np.diff(rows))
        single = ends - starts == 1
        joined = np.zeros(len(starts), bool)
        if len(starts) > 1:
            joined[1:] = single[1:] & single[:-1] & (starts[1:] - ends[:-1] == 1) & (row[1:] == row[:-1])
        if joined.any():
            held = np.ones(len(self.codes), bool)
            held[starts[joined] - 1] = False
            dropped = np.concatenate([[0], np.cumsum(~held)])
            self.codes, starts, ends = self.codes[held], starts - dropped[starts], ends - dropped[ends]
        first = np.flatnonzero(~joined)
        self.starts, self.row = starts[first], row[first]
        self.ends = ends[np.append(first[1:], len(starts)) - 1] if len(first) else ends
        self.rows = np.searchsorted(self.row, np.arange(texts.rows + 1))

    def subsequences(self):
        """For each step pattern the code of the subsequence at every place, whether it lies in one word, and its weight."""
        codes, n = self.codes, len(self.codes)
        spaces = np.concatenate([[0], np.cumsum(codes == _EDGE)]).astype(np.int32)
        for a, b in STEPS:
            m = n - a - b
            if m <= 0:
                continue
            x, y, z = codes[:m], codes[a:a + m], codes[a + b:a + b + m]
            # No white space between first and last, and no characters without a class.
            good = (spaces[a + b:a + b + m] == spaces[1:m + 1]) & (x > 0) & (y > 0) & (z > 0)
            yield (x << 10) | (y << 5) | z, good, DECAY ** (a + b)

    def norms(self) -> np.ndarray:
        letters = np.concatenate([[0], np.cumsum((self.codes > 0) & (self.codes != _EDGE))])
        length = letters[self.ends] - letters[self.starts] + 2
        total = np.zeros(len(length))
        for a, b in STEPS:
            total += DECAY ** (2 * (a + b)) * np.maximum(length - a - b, 0)
        return np.sqrt(np.maximum(total, 1e-9))

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Sum of the weights of each word's subsequences over its norm."""
        at = np.zeros(len(self.codes) + 1, np.float32)
        for code, good, decay in self.subsequences():
            at[1:len(code) + 1] += np.float32(decay) * weights[code] * good
        sums = np.cumsum(at, dtype=np.float64)
        # A word's subsequences start at the space before it or at its own characters.
        return (sums[self.ends] - sums[self.starts - 1]) / self.norms()


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes and normed weights of the subsequences of each word of a list, and the word each belongs to."""
    body = Words(texts_of(pa.array(words, pa.string())))
    norms = np.zeros(len(words))
    norms[body.row] = body.norms()
    owner = np.zeros(len(body.codes), np.int64)
    owner[np.maximum(body.starts - 1, 0)] = body.row
    np.maximum.accumulate(owner, out=owner)
    parts = [(code[good], np.full(good.sum(), decay), owner[:len(good)][good]) for code, good, decay in body.subsequences()]
    code, value, of = (np.concatenate(p) for p in zip(*parts))
    return code.astype(np.int64), value / norms[of], of


def _kernel(features, count: int, landmarks: np.ndarray) -> np.ndarray:
    """Products of every word's features with the landmark rows, in blocks."""
    code, value, of = features
    order = np.argsort(of, kind="stable")
    code, value, of = code[order], value[order].astype(np.float32), of[order]
    out = np.zeros((count, landmarks.shape[0]), np.float32)
    turned = np.ascontiguousarray(landmarks.T)
    for low in range(0, count, 1000):
        a, b = np.searchsorted(of, [low, min(low + 1000, count)])
        if a == b:
            continue
        terms = turned[code[a:b]] * value[a:b, None]
        inner, first = np.unique(of[a:b], return_index=True)
        out[inner] = np.add.reduceat(terms, first, axis=0)
    return out


def _dense(words: list[str]) -> np.ndarray:
    code, value, of = _features(words)
    out = np.zeros((len(words), 1 << 15), np.float32)
    np.add.at(out, (of, code), value)
    return out


def _spread(words: list[str], count: int) -> list[str]:
    """Up to ``count`` of the words, each as far as can be from those before, starting with the first."""
    if len(words) <= count:
        return words
    words = words[:SPREAD_WORDS]
    features, nearest = _features(words), np.full(len(words), -1.0)
    chosen = [0]
    while len(chosen) < count:
        nearest = np.maximum(nearest, _kernel(features, len(words), _dense([words[chosen[-1]]]))[:, 0])
        nearest[chosen[-1]] = np.inf
        chosen.append(int(nearest.argmin()))
    return [words[i] for i in chosen]


def _machine(words: list[str], y: np.ndarray, landmarks: list[str]) -> tuple[np.ndarray, float]:
    """Weights of the subsequences and the offset of a squared-hinge machine on Nystroem features."""
    rows = _dense(landmarks)
    values, vectors = np.linalg.eigh((rows @ rows.T).astype(np.float64))
    good = values > 1e-4 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    x = _kernel(_features(words), len(words), rows) @ root
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    w, bias = np.zeros(x.shape[1]), 0.0
    # Newton steps over the examples inside the margin.
    for _ in range(30):
        margin = 1 - y * (x @ w + bias)
        active = margin > 0
        xa = np.column_stack([x[active], np.ones(active.sum())])
        wa, ya = weight[active], y[active]
        ridge = np.diag(np.append(np.full(len(w), 2e-5), 1e-9))
        new = np.linalg.solve((xa * wa[:, None]).T @ xa + ridge, xa.T @ (wa * ya))
        step = np.abs(new - np.append(w, bias)).max()
        w, bias = new[:-1], new[-1]
        if step < 1e-6:
            break
    return ((root @ w) @ rows).astype(np.float32), float(bias)


def _bags(batches):
    """The distinct lower-case words of each text, one a line."""
    for batch, texts in slices(batches):
        bags = ["\n".join(sorted({w.decode("utf-8", "replace") for w in LOWER[np.frombuffer(texts.bytes_of(k), np.uint8)].tobytes().split()}))
                for k in range(texts.rows)]
        yield emit(batch, ["doc_id", "label"], words=pa.array(bags, pa.string()))


def fit(docs: DataFrame, labels: DataFrame, sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN) -> dict | None:
    """A machine for ``labels.toxic`` from a bounded sample of the rows that are not held out; None without both classes."""
    usable = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")))
    chosen = [usable.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, sample_toxic), (0, sample_clean))]
    # At most sample_toxic + sample_clean ids of 12 bytes.
    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")
            .mapInArrow(_bags, "doc_id long, label int, words string")
            .withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(sample_toxic + sample_clean).collect())
    y = np.array([r["label"] for r in rows])
    # Texts share most of their words: each word is held once.
    held: dict[str, str] = {}
    bags = [[held.setdefault(w, w) for w in r["words"].split("\n") if w] for r in rows]
    del rows
    return fit_bags(bags, y)


def fit_bags(bags: list[list[str]], y: np.ndarray) -> dict | None:
    """The machine for texts given as their distinct words."""
    learn = np.arange(len(bags)) % 3 != 2
    if min((y[learn] == 1).sum(), (y[learn] == 0).sum()) < 1:
        learn[:] = True
    if len(set(y.tolist())) < 2:
        return None
    toxic, clean = ([bags[i] for i in np.flatnonzero(learn & (y == k))] for k in (1, 0))
    in_toxic, in_clean = _frequencies(toxic), _frequencies(clean)

    def odds(word: str) -> float:
        return np.log((in_toxic.get(word, 0) + 0.2) / len(toxic)) - np.log((in_clean.get(word, 0) + 0.2) / len(clean))

    vocabulary = sorted(in_clean, key=lambda w: (-in_clean[w], w))
    usual = vocabulary[:USUAL_WORDS] + [w for w in vocabulary[USUAL_WORDS:] if zlib.crc32(w.encode()) % max(1, len(vocabulary) // OTHER_WORDS) == 0][:OTHER_WORDS]
    strength = {w: odds(w) * np.log1p(n) for w, n in in_toxic.items()}
    least = 0.3 * max(strength.values(), default=0.0)
    first = set()
    for bag in toxic:
        best = max((strength[w] for w in bag), default=0.0)
        first.update(w for w in bag if strength[w] >= max(0.6 * best, least))
    positive = sorted(first, key=lambda w: (-strength[w], w))
    model = None
    negative = usual
    for _ in range(ROUNDS):
        positive = [w for w in positive if w] or ["x"]
        negative = list(dict.fromkeys(w for w in negative if w not in set(positive))) or ["y"]
        half = LANDMARKS // 2
        landmarks = _spread(positive, half) + _spread(negative[::max(1, len(negative) // 1000)], LANDMARKS - half)
        words = positive + negative
        weights, bias = _machine(words, np.array([1.0] * len(positive) + [-1.0] * len(negative)), landmarks)
        model = {"weights": weights, "bias": bias}
        # The word of each toxic text that stands for its label, unless clean texts have it as often; the hardest words of clean texts.
        tops = [_top(bag, model, lambda w: odds(w) > 0) for bag in toxic]
        positive = sorted({w for w, s in tops if w and s > -0.5}, key=lambda w: (-in_toxic.get(w, 0), w)) or positive
        hard = [_top(bag, model) for bag in clean]
        negative = [w for w, _ in sorted(hard, key=lambda p: -p[1]) if w][:HARD_WORDS] + usual
    raw = np.array([_top(bag, model)[1] for bag in bags])
    check = ~learn if (~learn & (y == 1)).any() and (~learn & (y == 0)).any() else learn
    model["point"] = operating_point(raw[check], y[check])
    return model


def operating_point(raw: np.ndarray, y: np.ndarray) -> float:
    """The middle of the raw scores that separate the labels about as well as the best one does."""
    order = np.argsort(-raw, kind="stable")
    found = np.cumsum(y[order] == 1)
    last = np.flatnonzero(np.append(np.diff(raw[order]) != 0, True))  # thresholds fall between different scores
    balance = 2 * found[last] / (last + 1 + (y == 1).sum())
    below = np.append(raw[order][last[1:]] if len(last) > 1 else [], raw.min() - 1)
    between = (raw[order][last] + below) / 2
    good = between[balance >= balance.max() - TOLERANCE]
    return float((good.min() + good.max()) / 2)


def probability(raw: np.ndarray, model: dict) -> np.ndarray:
    """Rising with the raw score, ``THRESHOLD`` at the operating point."""
    return 1 / (1 + np.exp(-np.clip(np.log(THRESHOLD / (1 - THRESHOLD)) + STEEPNESS * (raw - model["point"]), -30, 30)))


def _frequencies(bags: list[list[str]]) -> dict[str, int]:
    counts: dict[str, int] = {}
    for bag in bags:
        for word in bag:
            counts[word] = counts.get(word, 0) + 1
    return counts


def _top(bag: list[str], model: dict, allowed=None) -> tuple[str, float]:
    bag = [w for w in bag if allowed(w)] if allowed else bag
    if not bag:
        return "", model["bias"]
    body = Words(texts_of(pa.array(bag, pa.string())))
    if not len(body.row):
        return "", model["bias"]
    scores = body.scores(model["weights"]) + model["bias"]
    k = int(scores.argmax())
    return bag[body.row[k]], float(scores[k])


def score(docs: DataFrame, model: dict | None, keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Probability and prediction of every row."""
    keep = keep or ["doc_id"]
    # A fixed size: 4 bytes for each of 32,768 subsequences.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        fitted = shared.value
        for batch, texts in slices(batches, limit=1 << 18):
            raw = np.zeros(texts.rows)
            if fitted is not None:
                body = Words(texts)
                raw[:] = fitted["bias"]
                full = np.diff(body.rows) > 0
                if full.any():
                    raw[full] += np.maximum.reduceat(body.scores(fitted["weights"]), body.rows[:-1][full])
                raw = probability(raw, fitted)
            yield emit(batch, [*keep, "held_out"], score=raw, predicted=pa.array((raw >= threshold).astype(np.int32)))

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", held_out boolean, score double, predicted int"
    return (docs.select(*dict.fromkeys([*keep, "text"]), held_out(F.col("doc_id")).alias("held_out"))
            .mapInArrow(run, schema))

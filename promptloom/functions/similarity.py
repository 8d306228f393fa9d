"""Similarity scores between two texts or vectors, as feature and score columns.

A scorer has two parts: ``feature`` turns the text column into what is compared (once per row, before
any shuffle), ``score`` compares two features and gives 0 to 1. Words travel as sorted 64-bit hashes, never as strings; two different words are
taken for one another with a chance of 2**-64.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptloom.functions.variants import let

TOKEN_BREAK = r"[^\p{L}\p{N}]+"

# Fixed values for the signature: a prime modulus and the two multiplicative steps that give
# permutation i the form (a_i * h + b_i) mod P.
SIGNATURE_SIZE = 32
SIGNATURE_PRIME = 2147483647
SIGNATURE_A_STEP = 48271
SIGNATURE_B_STEP = 69621
_ROWS_AT_ONCE = 256


@dataclass(frozen=True)
class Scorer:
    feature: Callable[[Column], Column]
    score: Callable[[Column, Column], Column]
    # Cheap conditions, the cheapest first, without which two features cannot reach a score, where there are any.
    needed: Callable[[Column, Column, float], list[Column]] | None = None
    # Takes the place of ``feature`` where it is made by an aggregate: (rows, their key columns, text column, new column).
    aggregate: Callable[[DataFrame, Sequence[str], str, str], DataFrame] | None = None
    # Where a pair is much work: adds the numbers for a feature and each of an array of features (null stays null), and the score of a pair made of its number.
    measure: Callable[[DataFrame, str, str, str], DataFrame] | None = None
    measured: Callable[[Column, Column, Column], Column] | None = None


def tokens(text: Column) -> Column:
    """Words of a text; an empty one at an end where the text begins or ends with another character."""
    return F.split(text, TOKEN_BREAK)


def word_hashes(text: Column) -> Column:
    """The distinct words of a text as sorted 64-bit hashes."""
    hashed = F.transform(tokens(text), lambda t: F.when(t != "", F.xxhash64(t)))
    return F.sort_array(F.array_distinct(F.array_compact(hashed)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays of distinct values; two empty ones count as equal."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(
        let(F.size(F.array_intersect(a, b)), lambda shared: shared / (both - shared)))


def _prefix(a: Column, at_least: float) -> Column:
    """Sorted sets that share ``at_least`` of their values share one of these."""
    kept = F.size(a) - F.ceil(F.size(a) * F.lit(at_least - 1e-9)).cast("int") + 1
    return F.slice(a, F.lit(1), F.least(kept, F.size(a)))


def _jaccard_needs(a: Column, b: Column, at_least: float) -> list[Column]:
    alike = F.arrays_overlap(_prefix(a, at_least), _prefix(b, at_least)) | (F.size(a) + F.size(b) == 0)
    return [_size_ratio(F.size(a), F.size(b)) >= at_least, alike]


def edit_distance(a: str, b: str) -> int:
    """Exact edit distance in code points by Myers' bit vectors: one column of the table is two integers as long as ``a``."""
    start, end = 0, 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start:len(a) - end], b[start:len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for k, letter in enumerate(a):
        places[letter] = places.get(letter, 0) | 1 << k
    every, top = (1 << len(a)) - 1, len(a) - 1
    up, down, distance = every, 0, len(a)
    for letter in b:
        here = places.get(letter, 0)
        diagonal = (((here & up) + up) ^ up) | here | down
        right, left = down | (every & ~(diagonal | up)), up & diagonal
        distance += (right >> top) - (left >> top)
        right = (right << 1 | 1) & every
        up, down = (left << 1 & every) | (every & ~(diagonal | right)), right & diagonal
    return distance


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """One minus edit distance over the longer length, on whole texts."""
    return _edit_share(a, b, F.levenshtein(a, b))


def _edit_share(a: Column, b: Column, distance: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - distance / longest)


def with_edit_distances(rows: DataFrame, text: str, others: str, name: str) -> DataFrame:
    """Add the edit distances between a text and each of an array of texts."""
    own, array = rows.columns.index(text), rows.columns.index(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS_AT_ONCE):
                batch = whole.slice(start, _ROWS_AT_ONCE)
                found = [[None if a is None or b is None else edit_distance(a, b) for b in texts]
                         for a, texts in zip(batch.column(own).to_pylist(), batch.column(array).to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], names=[*batch.schema.names, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))]))


def signature_steps() -> list[tuple[int, int]]:
    """The (a_i, b_i) pair of every permutation."""
    return [(pow(SIGNATURE_A_STEP, i + 1, SIGNATURE_PRIME), pow(SIGNATURE_B_STEP, i + 1, SIGNATURE_PRIME))
            for i in range(SIGNATURE_SIZE)]


def with_signature(rows: DataFrame, keys: Sequence[str], text: str, name: str) -> DataFrame:
    """Fixed-size summary of the word set: the smallest permuted hash per permutation, null for a text without words.

    Words are exploded and their minima aggregated where they lie; one row of minima for each of ``keys`` is all that is shuffled.
    """
    hashed = F.conv(F.substring(F.md5("__word"), 1, 7), 16, 10).cast("bigint")
    words = rows.select(*keys, F.explode_outer(tokens(F.col(text))).alias("__word")).select(
        *keys, F.when(F.col("__word") != "", hashed).alias("__hash"))
    lows = words.groupBy(*keys).agg(*[F.min((F.col("__hash") * a + b) % SIGNATURE_PRIME).alias(f"__low{i}") for i, (a, b) in enumerate(signature_steps())])
    return lows.select(*keys, F.array(*[f"__low{i}" for i in range(SIGNATURE_SIZE)]).alias(name))


def signature_agreement(a: Column, b: Column) -> Column:
    """Share of equal positions: an estimate of the Jaccard score."""
    equal = F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda e: e)
    return F.size(equal) / F.size(a)


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda total, v: total + v)


def with_norm(vector: Column) -> Column:
    """A numeric array in double precision together with its length."""
    return let(vector.cast("array<double>"), lambda v: F.struct(v.alias("v"), F.sqrt(_dot(v, v)).alias("norm")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors made by ``with_norm``; 0 when one has no length."""
    norms = a["norm"] * b["norm"]
    return F.when(norms == 0, F.lit(0.0)).otherwise(_dot(a["v"], b["v"]) / norms)


def _size_ratio(a: Column, b: Column) -> Column:
    return F.when(F.greatest(a, b) == 0, F.lit(1.0)).otherwise(F.least(a, b) / F.greatest(a, b))


SCORERS = {
    "jaccard": Scorer(word_hashes, jaccard, _jaccard_needs),
    "levenshtein": Scorer(lambda text: text.cast("string"), levenshtein_ratio, lambda a, b, at_least: [_size_ratio(F.length(a), F.length(b)) >= at_least],
                          measure=with_edit_distances, measured=_edit_share),
    "minhash": Scorer(lambda text: text, signature_agreement, aggregate=with_signature),
    "cosine": Scorer(with_norm, cosine),
}

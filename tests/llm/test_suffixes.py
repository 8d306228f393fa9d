"""Suffix order, common prefixes and shard repeats against plain versions."""
import collections

import numpy as np
import pytest

from promptloom.llm import repeats
from promptloom.llm.components import components
from promptloom.llm.suffixes import common_prefixes, eight_bytes, suffix_array


@pytest.mark.parametrize("letters", [1, 2, 4, 26])
def test_suffix_array(letters):
    rng = np.random.default_rng(letters)
    for n in (1, 2, 7, 60, 500):
        data = rng.integers(97, 97 + letters, n, dtype=np.uint8)
        eight = eight_bytes(data, 64)
        order, place = suffix_array(eight[:n], 8)
        body = data.tobytes()
        want = sorted(range(n), key=lambda k: body[k:])
        assert order.tolist() == want and [want[p] for p in place] == list(range(n))
        lanes = np.arange(0, n, 50)
        values = common_prefixes(eight, order, place, lanes, np.minimum(50, n - lanes), 40)
        for t, row in enumerate(values):
            for lane, got in zip(lanes[np.minimum(50, n - lanes) > t], row):
                k = place[lane + t]
                other = body[order[k - 1]:] if k else b""
                mine = body[lane + t:]
                plain = next((m for m, (a, b) in enumerate(zip(mine, other)) if a != b), min(len(mine), len(other)))
                assert got == min(plain, 40)


def test_shard_repeats():
    rng = np.random.default_rng(1)
    for _ in range(150):
        length = int(rng.integers(8, 40))
        base = bytes(rng.integers(97, 97 + int(rng.integers(1, 5)), 200, dtype=np.uint8))
        stretches, row, first, starts = [], [], [], []
        for k in range(int(rng.integers(1, 9))):
            at = int(rng.integers(0, 100))
            body = base[at:at + int(rng.integers(length, 90))] + bytes(rng.integers(97, 99, int(rng.integers(0, 30)), dtype=np.uint8))
            stretches.append(body)
            row.append(k // 2)
            first.append(int(rng.integers(0, 3)))
            starts.append(len(body) - length + 1)
        for across in (False, True):
            places = collections.defaultdict(set)
            for k, body in enumerate(stretches):
                for t in range(starts[k]):
                    places[body[t:t + length]].add(row[k] if across else (row[k], first[k] + t))
            want = {(k, t) for k, body in enumerate(stretches) for t in range(starts[k]) if len(places[body[t:t + length]]) > 1}
            found = repeats._shard_repeats(stretches, np.array(row), np.array(first), np.array(starts), length, across)
            assert {(k, t) for k, a, b in found for t in range(a, b)} == want


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2000 + k) for k in range(1, 80)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {x: find(x) for x in root if find(x) != x}
    assert {k: v for k, v in found.items() if k != v} == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0

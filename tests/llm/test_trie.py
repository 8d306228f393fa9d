"""The conversation trie against a trie built in plain Python."""
import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from promptloom.llm import trie
from promptloom.operators import ordered

SCHEMA = "conv_id long, turn int, role string, text string, n_convs string, depth int, key string"


def plain(rows):
    """Sorted (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    own = collections.defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    members = collections.defaultdict(list)
    ends = collections.defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children, leaves, saved = collections.Counter(p[:-1] for p in members if p), collections.Counter(), collections.Counter()
    for p, held in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(held) - 1) * len(p[-1][1]) if p else 0
    return sorted((held[0], len(p), members[p[:-1]][0] if p else -1, len(held), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, held in members.items())


def rows_of(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select(*names).collect())


def talks(rng, n, hot=0.3):
    """Conversations of all lengths, many with the same first turns or all turns; some families have no base."""
    rows = []
    for c in rng.sample(range(0, 8 * n), n) + [0, 100, 200]:
        length = rng.choice([1, 2, 3, 4, 6, 9, 14])
        copy = rng.random() < hot
        for turn in range(length):
            text = f"same {turn}" if copy else f"{'😀' * rng.randrange(3)}words {rng.randrange(3)}"
            rows.append((c, turn if rng.random() < 0.97 or turn else None, rng.choice(["user", "user", None]) if not copy else "user", text if rng.random() < 0.95 else None))
    return list({(r[0], r[1]): r for r in rows}.values())


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("limits", [(10**6, 1_000, 10**6, 1 << 18), (30, 6, 10**6, 40), (2, 20, 3, 1)])
def test_against_a_plain_trie(spark, limits):
    """One level of shards, and many with queues that spill and ids in several chunks."""
    rows = talks(random.Random(3), 150)
    assert rows_of(trie.build(frame(spark, rows), *limits)) == plain(rows)


def test_hot_and_long_conversations(spark, setting):
    """One conversation holds most rows and is numbered range by range; a third of the others are copies of each other."""
    setting(ordered.ROWS_SETTING, "300")
    rng = random.Random(9)
    rows = [(707, t, "user", f"t{t % 7}") for t in range(1_200)] + [(c, t, "user", f"same {t}") for c in range(1_000, 1_100) for t in range(4)] + talks(rng, 60)
    rows = list({(r[0], r[1]): r for r in rows}.values())
    assert rows_of(trie.build(frame(spark, rows), 50, 5)) == plain(rows)


def test_odd_rows(spark):
    """Null ids, roles, texts and turns, repeated rows, turns of one number, negative ids, conversations without turns, very long texts, no rows."""
    rows = [(None, 1, "user", "lost"), (5, None, "user", "a"), (5, 1, None, None), (300, 0, "user", "x" * 200_000), (301, 0, "user", "x" * 200_000),
            (302, 0, "user", "q"), (902, 0, "user", "alone"), (903, 0, "user", "alone"), (904, 0, "user", "alone")]
    assert rows_of(trie.build(frame(spark, rows))) == plain(rows)
    assert any(r[1] == 0 and r[7] != trie._EMPTY for r in plain(rows))
    doubled = rows + [(7, 1, "user", "b"), (7, 1, "user", "b"), (7, 2, "user", "c")]
    assert rows_of(trie.build(frame(spark, doubled))) == plain(doubled)
    tied = [(8, 1, "user", "b"), (8, 1, "assistant", "a")]
    one, two = (rows_of(trie.build(frame(spark, r))) for r in (tied, tied[::-1]))
    assert one == two
    below = trie.build(frame(spark, [(-5, 1, "user", "b")]))
    assert below.agg({"n_convs": "max"}).first()[0] == 1
    nothing = trie.build(frame(spark, rows).limit(0))
    assert nothing.count() == 0 and nothing.columns == below.columns
    assert trie.build(frame(spark, [(None, 1, "user", "a")])).count() == 0


@pytest.mark.parametrize("limit", [1, 7, 50, 10**6])
def test_queue(limit):
    """Messages come out by key, added up, whether they were spilled or not."""
    rng = np.random.default_rng(limit)
    queue, want = trie.Messages(limit), collections.defaultdict(lambda: np.zeros(3, np.int64))
    for _ in range(40):
        level = int(rng.integers(3))
        keys = np.array([bytes(rng.integers(0, 4, 16, dtype=np.uint8)[:15]) + bytes([int(rng.integers(3))]) for _ in range(20)], "S16")
        values = rng.integers(0, 100, (20, 3))
        queue.push(level, keys, values)
        for k, v in zip(keys, values):
            want[level, bytes(k)] += v
    for level in (2, 0, 1):
        reader, got = queue.read(level), []
        for stop in [b"\x01", b"\x02\x02", b"\xff" * 16]:
            got += reader.upto(stop).tolist()
        assert [k for k, _ in got] == sorted(k for k, _ in got)
        assert {k: tuple(v) for k, v in got} == {k: tuple(v) for (at, k), v in want.items() if at == level}
    assert queue.held == 0 and len(queue.read(1).upto(b"\xff" * 16)) == 0

"""Ranked search against scoring every document."""
import collections
import math
import random
import re
import string

import numpy as np
import pytest

from promptloom.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "doc_id long, text string, score string, rank int, item_id int"


def plain(docs, items, k=20):
    """(item_id, rank, doc_id, score) by scoring all documents."""
    held = [(i, collections.Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item_id, text in dict.fromkeys(items):
        asked = TERM.findall((text or "").translate(LOWER))
        rows = []
        for i, c in held:
            m = 75 + (25 * c.total() * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in asked if c[t])
            if score > 0:
                rows.append((-score, i is not None, i or 0))
        for rank, (score, has, i) in enumerate(sorted(rows)[:k], 1):
            out.append((item_id, rank, i if has else None, -score))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def corpus(rng, n, vocabulary):
    weights = [1 / (k + 1) for k in range(vocabulary)]
    return [" ".join(f"w{w}" for w in rng.choices(range(vocabulary), weights, k=rng.randrange(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("shard_bytes", [1, 4_000, 1 << 20])
def test_against_all_documents(spark, shard_bytes):
    """Ties, copies, a hot text, repeated terms, nulls, repeated ids, a very long text, and columns with clashing names."""
    rng = random.Random(6)
    texts = corpus(rng, 400, 120)
    texts += [texts[0]] * 200 + ["Äöü ß_x W1-w2!", "", None, " \n.,", "w3 " * 5_000 + "w7", "W0 w1\x00w2"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(5, "w1 w9"), (5, "w1 w9"), (None, "w2 w2 w11"), (None, "w2 w2 w11")]
    items = [(1, texts[0]), (2, "w1 w1 w1 w2"), (3, "nothing here"), (4, ""), (5, None), (6, "w0"), (7, "ß äöü ÄÖÜ Äöü x"), (2, "w1 w1 w1 w2"), (2, "w5"), (None, "w11 w3 w99")]
    items += [(20 + i, t) for i, t in enumerate(corpus(rng, 20, 120))]
    frame = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], SCHEMA).repartition(3)
    asked = spark.createDataFrame(items, "item_id int, text string")
    got = lexical.search(lexical.index(frame, shard_bytes), asked, item_bytes=500)
    assert got.schema.simpleString() == "struct<item_id:int,rank:int,doc_id:bigint,score:bigint>"
    assert rows_of(got) == plain(docs, items)


def test_small_k(spark):
    rng = random.Random(8)
    docs = list(enumerate(corpus(rng, 300, 15)))
    items = list(enumerate(corpus(rng, 10, 15)))
    shards = lexical.index(spark.createDataFrame(docs, "doc_id long, text string").repartition(2))
    for k in (1, 3):
        assert rows_of(lexical.search(shards, spark.createDataFrame(items, "item_id long, text string"), k)) == plain(docs, items, k)


def test_reading_stops_early(spark):
    """The best positions bound what is unseen: a query of one rare and one common term does not read the common list to its end."""
    texts = ["rare common"] * 30 + [f"common filler{i} " + "pad " * 40 for i in range(5_000)]
    shard = lexical.index(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), 1 << 24).toArrow().to_batches()[0]
    wanted, _ = lexical.find_terms(lexical.texts_of(lexical.pa.array(["rare common"])))
    wanted = np.sort(wanted)
    lists = lexical._Lists(shard, 0, wanted, np.array([1_000, 1_000]), 5_030, 5_030 * 30)
    docs, scores = lists.best(wanted.searchsorted(wanted), np.ones(2, np.int64), 20, 1)
    assert 30 <= len(docs) < 1_000 and np.sort(scores)[-30:].min() > 0 and set(range(30)) <= set(docs.tolist())
    assert not lists.seen.any()


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id int, text string")
    want = lexical.search(lexical.index(docs), items).schema.simpleString()
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0)), (docs, items.where("item_id = 1 AND text = 'zz'"))):
        got = lexical.search(lexical.index(d), i)
        assert got.count() == 0 and got.schema.simpleString() == want

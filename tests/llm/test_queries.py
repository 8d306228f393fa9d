"""Every registered query on the smallest data set, against its SQL where there is one, and the pipeline's stages."""
import collections
import re

import pytest
from conftest import SMALL
from oracle import compare, connect

import corpus_pipeline
from promptloom.llm import mixing, queries
from promptloom.sources.workspace import materialize

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    ok, note = compare(spark, connect(SMALL), name, queries.QUERIES[name], queries.CHECKS.get(name), SMALL)
    # The smallest data set leaks some items; every other query has a row for each row of its table.
    assert ok, note


def test_entry_offers_all():
    from __spark_entry__ import queries as offered
    assert set(queries.QUERIES) | {"pipeline"} <= set(offered())


def test_stages(spark):
    """Each stage keeps the columns, works on what the stage before kept and does what its name says."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(materialize(stage(spark, frames[-1], SMALL), f"test-{name}"))
    assert all(f.columns == docs.columns for f in frames[:-1])
    ids = [{r.doc_id for r in f.select("doc_id").collect()} for f in frames]
    assert all(after <= before for before, after in zip(ids, ids[1:]))
    texts = [{r.doc_id: r.text for r in f.collect()} for f in frames[:-1]]
    assert all(len(WORD.findall(t)) >= 20 for t in texts[1].values())
    sets = {}
    for i, t in texts[3].items():
        w = WORD.findall(t.lower())
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for i, s in sets.items():
        common = collections.Counter(j for x in s for j in holders[x] if j < i)
        assert all(100 * n < 80 * (len(s) + len(sets[j]) - n) for j, n in common.items())
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert not any(item in t for t in texts[4].values() for item in items)
    mixed = mixing.mix(frames[4]).where("taken > 0")
    assert sorted(r.taken for r in mixed.collect()) == sorted(r.taken for r in frames[5].collect())
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SMALL).collect()) == sorted(tuple(r) for r in frames[5].collect())


def test_stages_of_odd_tables(spark, tmp_path):
    """Nulls, empty tables and clashing columns pass all stages."""
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    schema = "doc_id long, text string, source string, n_words int, taken int, n_lines int, component_id int, n_chars long"
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(1, text, None, 1, 2, 3, 4, 5), (2, None, "a", None, None, None, None, None), (None, text + " more", "a", 1, 1, 1, 1, 1), (1, text, None, 1, 2, 3, 4, 5)]
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()} <= {1, None}

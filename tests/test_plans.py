"""Physical plans: what is read, what is shuffled, and where Python runs."""
import pytest
from conftest import SMALL

from promptloom.plans import catalog


def plan(spark, name):
    return catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().toString()


# Providers are Python, a JSON document is cut by a scan over its bytes, and the breaker is a replay.
PYTHON = {"dispatch", "dispatch_by_provider", "dispatch_once", "get_or_set", "circuit_state"}


@pytest.mark.parametrize("name", sorted(n for n in catalog.QUERIES if not n.startswith("stream_")))
def test_no_cross_joins_and_python_only_where_needed(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    if name not in PYTHON:
        assert "InPandas" not in text and "ArrowEvalPython" not in text and "BatchEvalPython" not in text


@pytest.mark.parametrize("name", ["select_system", "count_items", "cache_misses", "split_batches", "sample_records"])
def test_texts_are_not_read_when_not_needed(spark, name):
    reads = [line for line in plan(spark, name).splitlines() if "ReadSchema" in line and "documents" in line]
    assert reads and all("text:string" not in line for line in reads)


@pytest.mark.parametrize("name", ["normalize_prompt", "build_chat_body", "extract_content", "task_folder_name", "validate_config", "leaf_paths"])
def test_projections_do_not_shuffle(spark, name):
    assert "Exchange" not in plan(spark, name)


def test_filters_reach_the_scan(spark):
    assert "EqualTo(role,assistant)" in plan(spark, "extract_content")

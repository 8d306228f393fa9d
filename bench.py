"""Times the headline queries and prints one JSON line.

Settings: BENCH_SF_DIR (data folder), BENCH_CPUS (local cores), BENCH_RUNS (timed runs after a warm-up),
BENCH_QUERIES (comma-separated names, or ``all``).
"""
from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from promptloom.plans import catalog
from promptloom.session import local_session

HEADLINE = [
    "conversation_triples", "normalize_prompt", "find_prompt", "build_chat_body", "build_batch_line", "extract_content",
    "align_left", "align_by_custom_id", "cache_hits", "cache_misses", "dedup_requests", "dispatch", "get_or_set",
    "cache_upsert", "ttl_hits", "running_hits", "split_batches", "combine_batches", "batch_progress", "rollup_status",
    "status_changes", "cooldown_remaining", "circuit_state", "similar_recent", "similarity_flag", "sim_cosine",
    "trim_history", "sample_records", "number_tasks", "parse_task_path", "leaf_paths", "validate_config",
    "scan_jsonl", "with_position", "write_json_array", "stream_status_changes", "stream_cache_dedup", "sim_minhash",
    "stream_similarity", "scan_inputs",
]


def measure(spark, name: str, folder: str, runs: int) -> float:
    """Median seconds to compute the whole result, after one warm-up."""
    seconds = []
    for _ in range(runs + 1):
        started = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds.append(time.perf_counter() - started)
    return statistics.median(seconds[1:])


def main() -> None:
    with tempfile.TemporaryDirectory(prefix="bench-") as shared:
        run(f"file:{shared}")


def run(shared: str) -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = sorted(catalog.QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = local_session(cpus, spark__checkpoint__dir=shared)
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        times[name] = round(measure(spark, name, folder, runs), 3)
        print(f"{name}: {times[name]} s", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "sum of median query seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": cpus,
        "runs": runs, "spark": spark.version, "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()

"""Streams over files: restarts, repeated runs, and state that levels off."""
import json
import random

import pytest
from pyspark.sql import functions as F

from promptloom.plans import stream_queries
from promptloom.sources import scan
from promptloom.streaming import runner, streams


def test_inputs_of_both_kinds_over_restarts(spark, setting, tmp_path):
    """Arrays, objects and lines that arrive in steps; every record once, with the place that the batch reader gives it."""
    setting("spark.sql.files.maxPartitionBytes", "300")
    setting("spark.sql.files.openCostInBytes", "0")
    rng, folder = random.Random(2), tmp_path / "in"
    folder.mkdir()

    def calls():
        return streams.stream_inputs(spark, str(folder), f"{tmp_path}/out", f"{tmp_path}/checkpoint", max_files=2)

    def rows(df):
        return sorted((r.file_name, r.idx, json.loads(r.line)) if r.line.strip() != "broken {" else (r.file_name, r.idx, None) for r in df.collect())

    for step in range(2):
        for k in range(2):
            items = [{"n": i, "t": "x,]" * rng.randrange(20)} for i in range(rng.randrange(1, 25))]
            (folder / f"a{step}{k}.json").write_text(json.dumps(items))
            (folder / f"l{step}{k}.jsonl").write_text("\n".join(["", *map(json.dumps, items), "  ", json.dumps(step)]))
            (folder / f"other{step}{k}.txt").write_text("[1]")
        (folder / f"o{step}.json").write_text('{"one": [1, 2]}')
        got = rows(calls())
        assert got == rows(scan.with_position(scan.scan_inputs(spark, str(folder))))
        assert len({r[:2] for r in got}) == len(got) > 0
    assert rows(calls()) == got


def test_nothing_to_read(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert streams.stream_inputs(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint").count() == 0


def steps(spark, base, make, mode="append", n=4):
    """Jobs that live for a day each, a day's worth of them a step; the rows of state after each step."""
    kept, stream = [], None
    for day in range(n):
        rows = [(1000 * day + j, 100 * day + j, (day * 86_400 + j * 60 + k * 600) * 1_000_000, "s%d" % (k % 2)) for j in range(20) for k in range(3)]
        spark.createDataFrame(rows, "event_id long, job_id long, us long, status string").write.mode("append").parquet(f"{base}/in")
        stream = stream if stream is not None else make(streams.stream_table(spark, f"{base}/in", "event_id long, job_id long, us long, status string"))
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
        query = (writer.format("parquet").option("path", f"{base}/out") if mode == "append" else writer.foreachBatch(lambda batch, i: batch.count())).start()
        query.awaitTermination()
        kept.append(max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress[-1:] if p["stateOperators"]))
    return kept


DAY = 86_400
KINDS = {
    "changes": (lambda s, forget: streams.stream_status_changes(s, DAY if forget else None), "append"),
    "cooldown": (lambda s, forget: streams.stream_cooldown(s, 60, DAY if forget else None), "append"),
    "similarity": (lambda s, forget: streams.stream_similarity(s.select(F.col("job_id").cast("string").alias("task"), F.col("event_id").alias("seq"), F.col("status").alias("text"), "us"),
                                                               2, 0.5, DAY if forget else None), "append"),
    "latest": (lambda s, forget: streams.stream_latest_status(s, "1 day" if forget else None), "update"),
    "terminal": (lambda s, forget: streams.stream_terminal_jobs(s, ("s1",), "1 day" if forget else None), "append"),
}


@pytest.mark.parametrize("kind", sorted(KINDS))
def test_state_levels_off(spark, setting, tmp_path, kind):
    setting("spark.sql.shuffle.partitions", "2")
    make, mode = KINDS[kind]
    kept = steps(spark, str(tmp_path), lambda s: make(s, True), mode)
    assert max(kept) <= 60 and kept[-1] <= kept[1] + 20


def test_state_without_a_limit_grows(spark, setting, tmp_path):
    setting("spark.sql.shuffle.partitions", "2")
    make, mode = KINDS["changes"]
    assert steps(spark, str(tmp_path), lambda s: make(s, False), mode, 3) == [20, 40, 60]


def test_a_repeated_batch_replaces_its_rows(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # a second checkpoint numbers its batches anew, as a failed one does
        stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
        runner.drain_batches(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint{_}")
    assert runner.read_batches(spark, f"{tmp_path}/out", "id long").count() == 10


def test_bounded_arrivals_keep_the_order(spark, monkeypatch):
    """A task's responses in many micro-batches of bounded bytes score as in two."""
    rng = random.Random(4)
    data = [(rng.choice("ab"), 3 * i, " ".join(rng.choices("one two three four five".split(), k=6))) for i in range(300)]
    df = spark.createDataFrame(rng.sample(data, len(data)), "task string, seq bigint, text string").repartition(3)
    batches = []

    def run():
        batches.clear()
        return sorted(map(tuple, stream_queries.in_slices(df, F.col("seq") >= 450, lambda s: streams.stream_similarity(s, 4, 0.8), bounded=("seq", "text")).collect()))

    drain = runner.drain
    monkeypatch.setattr(runner, "drain", lambda *a: (batches.append(1), drain(*a)))
    expected = run()
    assert len(batches) == 2 and len(expected) == 300
    monkeypatch.setattr(stream_queries, "ARRIVAL_BYTES", 2_000)
    assert run() == expected and len(batches) > 4


def test_micro_batches_by_bytes(spark, tmp_path):
    """Many small files are one micro-batch where bytes bound it."""
    (tmp_path / "in").mkdir()
    for k in range(30):
        (tmp_path / "in" / f"a{k}.json").write_text(json.dumps([{"n": k}, {"n": -k}]))
    got = streams.stream_inputs(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint", max_bytes=1 << 20)
    assert sorted(json.loads(r.line)["n"] for r in got.collect()) == sorted([*range(30), *range(0, -30, -1)])
    assert [p.name for p in (tmp_path / "out" / "documents").iterdir()] == ["batch-0"]

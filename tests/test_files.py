"""Files: positions in split files, array documents, mixed folders, stored outputs."""
import glob
import json
import random

import pytest
from pyspark.sql import functions as F

from promptloom.functions import variants as V
from promptloom.operators import responses as R
from promptloom.sources import scan, sinks, workspace


def test_positions_in_split_files(spark, setting, tmp_path):
    setting("spark.sql.files.maxPartitionBytes", "4096")
    setting("spark.sql.files.openCostInBytes", "0")
    for name, size in (("a", 3_000), ("b", 7)):
        lines = []
        for i in range(size):
            lines.append(json.dumps({"n": i, "pad": "x" * (i % 50)}))
            if i % 10 == 0:
                lines.append("  ")
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines))
    placed = scan.with_position(scan.scan_jsonl(spark, str(tmp_path), "*.jsonl"))
    assert placed.select("file_name", "block_start").distinct().count() > 10
    assert placed.count() == 3_007
    assert placed.where(F.col("idx") != V.get(F.col("item"), "$.n", "bigint")).count() == 0


def test_scan_inputs_takes_arrays_objects_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"input_text":"1"},"2"]')
    (tmp_path / "b.json").write_text('{\n"input_text":\n"3"}')
    (tmp_path / "c.jsonl").write_text('{"input_text":"4"}\n\n"5"\nbroken\n')
    (tmp_path / "ignored.txt").write_text("x")
    rows = scan.with_position(scan.scan_inputs(spark, str(tmp_path))).select("file_name", "idx", F.to_json("item").alias("j")).collect()
    assert sorted((r["file_name"], r["idx"], r["j"]) for r in rows if r["j"]) == [
        ("a.json", 0, '{"input_text":"1"}'), ("a.json", 1, '"2"'), ("b.json", 0, '{"input_text":"3"}'),
        ("c.jsonl", 0, '{"input_text":"4"}'), ("c.jsonl", 1, '"5"')]
    assert [(r["file_name"], r["idx"]) for r in rows if r["j"] is None] == [("c.jsonl", 2)]


def test_array_documents_are_valid_json(spark, tmp_path):
    df = spark.range(25).select(F.lit("f").alias("file"), F.col("id").alias("idx"), F.to_json(F.struct("id")).alias("line"))
    sinks.write_json_array(df, f"{tmp_path}/out", "file", "idx", "line", 10)
    documents = sorted(glob.glob(f"{tmp_path}/out/file=f/document=*/part-*"))
    assert [[e["id"] for e in json.loads(open(d).read())] for d in documents] == [
        list(range(10)), list(range(10, 20)), list(range(20, 25))]


def test_documents_are_bounded_by_bytes(spark, setting, tmp_path):
    """Long and short elements, a file that is cut into ranges; documents in order hold the elements in order."""
    from promptloom.operators import ordered
    setting(ordered.ROWS_SETTING, "50")
    df = spark.range(300).select(F.when(F.col("id") < 250, "big").otherwise("small").alias("file"), F.col("id").alias("idx"),
                                 F.to_json(F.struct("id", F.repeat(F.lit("x"), (F.col("id") % 40).cast("int")).alias("t"))).alias("line"))
    sinks.write_json_array(df, f"{tmp_path}/out", "file", "idx", "line", bytes_per_document=400)
    for name, ids in (("big", range(250)), ("small", range(250, 300))):
        documents = sorted(glob.glob(f"{tmp_path}/out/file={name}/document=*/part-*"), key=lambda d: int(d.split("document=")[1].split("/")[0]))
        assert [e["id"] for d in documents for e in json.loads(open(d).read())] == list(ids)
        assert max(len(open(d).read()) for d in documents) < 500 and len(documents) > 3


def test_raw_response_files_round_trip(spark, tmp_path):
    names = ["batch_0", "a b%=c", "ünï"]
    df = spark.createDataFrame([(names[i % 3], i, json.dumps({"n": i, "pad": "p" * 40})) for i in range(60)], "name string, idx int, line string")
    count = sinks.write_raw_responses(df, f"{tmp_path}/raw", "name", "idx", "line", 300)
    files = sorted(f.name for f in (tmp_path / "raw").iterdir() if not f.name.startswith("."))
    assert len(files) == count > 9 and all(f.endswith("_raw_response.json") for f in files)
    assert {"batch_0_raw_response.json", "batch_0_part1_raw_response.json", "a b%=c_raw_response.json", "ünï_raw_response.json"} <= set(files)
    rows = scan.scan_raw_responses(spark, f"{tmp_path}/raw").select(V.get(F.col("item"), "$.n", "int").alias("n")).collect()
    assert sorted(r.n for r in rows) == list(range(60))
    with pytest.raises(FileExistsError):
        sinks.write_raw_responses(df, f"{tmp_path}/raw", "name", "idx", "line", 300)


def test_raw_responses_by_name(spark, tmp_path):
    answer = {"response": {"body": {"choices": [{"message": {"content": "hello"}}]}}, "custom_id": "request_0"}
    (tmp_path / "batch_0_raw_response.json").write_text(json.dumps([answer, answer]))
    (tmp_path / "batch_0_formatted_response.json").write_text("[{}]")
    assert scan.scan_raw_responses(spark, str(tmp_path)).count() == 2


def test_task_tree(spark, tmp_path):
    folder = tmp_path / "user1" / "openai_my_task_01_02_2024_030405" / "config"
    folder.mkdir(parents=True)
    (folder / "config.json").write_text(json.dumps({"task_name": "x", "user_id": "user1", "unknown": 1}))
    row = scan.scan_tasks(spark, str(tmp_path)).first()
    assert (row["user_id"], row["api_name"], row["task_name"], str(row["created_at"])) == ("user1", "openai", "my_task", "2024-02-01 03:04:05")


def test_outputs_are_written_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            calls.add(len(frame))
            yield frame

    df = spark.range(10).selectExpr("id", "'r' AS raw", "'s' AS system", "'u' AS user", "'a' AS assistant")
    sinks.write_outputs(df.mapInPandas(count, df.schema), f"{tmp_path}/o", "raw", ["system", "user", "assistant"], ["id"])
    assert calls.value == 10
    assert spark.read.json(f"{tmp_path}/o/parsed").columns == ["content", "id"]


def test_intermediate_tables_lie_in_the_shared_folder(spark):
    rows = workspace.materialize(spark.range(5), "five")
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    assert rows.count() == 5 and all(f"{folder}/promptloom-{spark.sparkContext.applicationId}/five-" in f for f in rows.inputFiles())


def test_the_warehouse_stands_in_for_a_missing_setting():
    session = type("Session", (), {"conf": {"spark.sql.warehouse.dir": "s3://house/"}})
    assert workspace.shared_folder(session) == "s3://house"
    session.conf["spark.checkpoint.dir"] = "s3://shared/"
    assert workspace.shared_folder(session) == "s3://shared"


def test_one_large_array_is_read_by_many_tasks(spark, tmp_path):
    """An array of more than 128 MiB in one document: every element comes back, in order, from one task a split."""
    text = "x" * 1400
    with open(tmp_path / "big.json", "w") as out:
        out.write("[")
        for k in range(100_000):
            out.write(("," if k else "") + '{"k":%d,"t":"%s"}' % (k, text))
        out.write("]\n")
    rows = scan.scan_json(spark, str(tmp_path), "*.json")
    got = scan.with_position(rows).select("idx", "block_start", V.get(F.col("item"), "$.k", "bigint").alias("k"), F.length(V.get(F.col("item"), "$.t")).alias("n")).agg(
        F.count("*").alias("rows"), F.sum((F.col("idx") == F.col("k")).cast("int")).alias("placed"), F.min("n").alias("n"), F.count_distinct("block_start").alias("splits")).first()
    assert tuple(got)[:3] == (100_000, 100_000, 1400) and got.splits >= 5


def nested(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.3:
        return rng.choice([1, -2.5, None, True, "a", 'q"u,o[t{e\\', "\\\\\"", ",,,", "]}", "", "äö\n", [], {}])
    if kind < 0.6:
        return {f"k{i},\"": nested(rng, depth - 1) for i in range(rng.randrange(5))}
    return [nested(rng, depth - 1) for _ in range(rng.randrange(5))]


@pytest.mark.parametrize("size", ["61", "1000"])
def test_splits_of_any_size_give_the_elements(spark, setting, tmp_path, size):
    """Files cut at every kind of place: strings with signs of all sorts, deep values, long elements, white space, objects, scalars, blank files."""
    setting("spark.sql.files.maxPartitionBytes", size)
    setting("spark.sql.files.openCostInBytes", "0")
    setting("spark.sql.files.minPartitionNum", "1")
    rng, want = random.Random(9), {}
    for k in range(6):
        items = [nested(rng, 4) for _ in range(rng.randrange(30))] + [["long", ",".join("ab" for _ in range(rng.randrange(200)))]]
        text = json.dumps(items, ensure_ascii=k % 2 == 0, indent=[None, 1][k % 3 == 0], separators=[(",", ":"), (" , ", " : ")][k % 2])
        want[f"a{k}.json"] = items
        (tmp_path / f"a{k}.json").write_text([text, f"\n \t{text}  \n\n"][k % 2])
    others = {"object.json": {"a": [1, 2, {"b": ",]["}], "c": "x" * 300}, "string.json": "a,b]", "number.json": 17, "empty.json": [], "spaced.json": [], "one.json": [[1, 2]], "null.json": [None]}
    for name, value in others.items():
        (tmp_path / name).write_text("[ \n ]" if name == "spaced.json" else json.dumps(value))
        want[name] = value if isinstance(value, list) else [value]
    (tmp_path / "blank.json").write_text(" \n ")
    (tmp_path / "nothing.json").write_text("")
    rows = scan.with_position(scan.scan_json(spark, str(tmp_path), "*.json")).select("file_name", "idx", "line").collect()
    got = {}
    for row in sorted(rows, key=lambda r: (r.file_name, r.idx)):
        assert row.idx == len(got.setdefault(row.file_name, []))
        got[row.file_name].append(json.loads(row.line))
    assert got == {name: items for name, items in want.items() if items}


BROKEN = ['[1,2', '[1,,2]', '[1,2,]', '[1,2],', '[1,2] 3', '[1,2],[3]', '[{"a":1]', '[1}', '{"a":1', '["open]', ',1', '[,1]', '[1,2]]', '[01,2]']


@pytest.mark.parametrize("size, texts", [("100000", BROKEN), ("16", ["[" + "1," * 40 + end for end in ("]", "2", '"b",c]', "2],", "2],[3]", '"open]')])])
def test_broken_documents_stop_the_job(spark, setting, tmp_path, size, texts):
    setting("spark.sql.files.maxPartitionBytes", size)
    setting("spark.sql.files.openCostInBytes", "0")
    setting("spark.sql.files.minPartitionNum", "1")
    for k, text in enumerate(texts):
        (tmp_path / str(k)).mkdir()
        (tmp_path / str(k) / "broken.json").write_text(text)
        with pytest.raises(Exception, match="is not one JSON document"):
            scan.scan_json(spark, str(tmp_path / str(k)), "*.json").collect()


def test_documents_that_are_not_json(spark, tmp_path):
    for name, text in (("a", "[1,]"), ("b", "[1] x"), ("c", '{"a":1}]')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "f.json").write_text(text)
        with pytest.raises(Exception, match="is not one JSON document"):
            scan.scan_json(spark, str(tmp_path / name)).collect()
    (tmp_path / "blank.json").write_text(" \n")
    assert scan.scan_json(spark, str(tmp_path), "blank.json").count() == 0


def test_positions_over_documents(spark, tmp_path):
    df = spark.range(25).selectExpr("'f' AS file", "id AS idx", "cast(id AS string) AS line")
    sinks.write_json_array(df, f"{tmp_path}/a", "file", "idx", "line", 10)
    rows = scan.scan_json(spark, f"{tmp_path}/a").withColumn("file", F.lit("f")).withColumn(
        "document", F.regexp_extract("file_path", "document=(\\d+)", 1).cast("int"))
    placed = scan.with_position(rows, "file", ["document"])
    assert sorted(tuple(r) for r in placed.select("idx", "line").collect()) == [(k, str(k)) for k in range(25)]


def test_white_lines_are_no_rows(spark, tmp_path):
    (tmp_path / "x.txt").write_text("1\n\t\n \u00a0\n  \n2\n")
    lines = {r.line for r in scan.scan_jsonl(spark, str(tmp_path)).collect()}
    assert {"1", "2"} <= lines and not lines & {"", "  ", "\t"}


def test_failed_rows_are_written(spark, tmp_path):
    df = spark.createDataFrame([(1, "r", "s", "u", "a"), (2, None, "s", "u", None), (3, "r", "s", "u", None)],
                               "id long, raw string, system string, user string, assistant string")
    sinks.write_outputs(df, f"{tmp_path}/o", "raw", ["system", "user", "assistant"], ["id"])
    formatted = {r.id: (r.system, r.user, r.assistant) for r in spark.read.json(f"{tmp_path}/o/formatted").collect()}
    assert formatted == {1: ("s", "u", "a"), 2: ("error", "error", R.NO_CONTENT), 3: ("error", "error", R.NO_CONTENT)}
    assert {r.id: r.content for r in spark.read.json(f"{tmp_path}/o/parsed").collect()} == {1: "a", 2: R.NO_CONTENT, 3: R.NO_CONTENT}


def test_null_fields_are_written(spark, tmp_path):
    sinks.write_jsonl(spark.sql("SELECT 1 AS a, cast(NULL AS string) AS b"), f"{tmp_path}/n")
    assert [r.value for r in spark.read.text(f"{tmp_path}/n").collect()] == ['{"a":1,"b":null}']


def test_configs_share_files_and_trees_have_several_writers(spark, setting, tmp_path, monkeypatch):
    from promptloom.plans import file_queries
    setting("spark.sql.shuffle.partitions", "4")
    spark.range(1500).selectExpr("id AS c_custkey", "'Customer' || id AS c_name", "CAST(id % 25 AS INT) AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    monkeypatch.setattr(workspace, "new_path", lambda spark, name: f"{tmp_path}/{name}")
    assert file_queries.scan_config(spark, str(tmp_path)).select("user_id").distinct().count() == 1500
    assert len(list(tmp_path.glob("configs/**/part-*.txt"))) == 2
    assert file_queries.scan_tasks(spark, str(tmp_path)).select("task_name").distinct().count() == 1500
    assert len({p.name.split("-")[1] for p in tmp_path.glob("tree/**/part-*.txt")}) == 4


def test_trees_are_written_as_spark_would(spark, tmp_path):
    """Names that Spark escapes, folders without a value, null and repeated lines; no checksum files, which cost as much as the files."""
    rows = [("u", "a b%=c/ü", "x"), ("u", None, "y"), ("u", "", "z"), (None, "t", None), ("u", "[1]{2}:*?'\"^\\", "é"), ("v", "t", "1"), ("v", "t", "2"), ("v", "t", None)]
    df = spark.createDataFrame(rows, "user string, task string, line string")
    sinks.write_tree(df, f"file:{tmp_path}/own", ["user", "task"], "line", 3)
    df.repartition(3, "user", "task").write.partitionBy("user", "task").text(f"{tmp_path}/spark")
    trees = [{p.parent.relative_to(tmp_path / name): sorted(p.read_text().split("\n")) for p in (tmp_path / name).glob("**/part-*.txt")} for name in ("own", "spark")]
    assert trees[0] == trees[1] and len(trees[0]) == 5
    assert not list(tmp_path.glob("own/**/.*"))
    assert workspace.mounted(spark, f"file://{tmp_path}") == workspace.mounted(spark, str(tmp_path)) == str(tmp_path)


def test_task_folders_are_listed_by_few_tasks(spark, tmp_path):
    """Two users of 300 folders each: Spark would list them by a task a folder."""
    for k in range(600):
        folder = tmp_path / f"user{k % 2}" / f"openai_job-{k}_01_02_2024_030405" / "config"
        folder.mkdir(parents=True)
        (folder / "config.json").write_text("{}")
    context, setting = spark.sparkContext, "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(setting)
    context.setJobGroup("listing", "listing")
    tasks = scan.scan_tasks(spark, str(tmp_path))
    context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(job).stageIds}
    assert sum(tracker.getStageInfo(s).numTasks for s in stages) <= 4 * context.defaultParallelism
    assert spark.conf.get(setting) == before and tasks.rdd.getNumPartitions() <= 2 * context.defaultParallelism
    assert {r.task_name for r in tasks.collect()} == {f"job-{k}" for k in range(600)}

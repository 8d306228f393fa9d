"""Sources and sinks: each query writes rows of the given tables as files and reads them back."""
from __future__ import annotations

from pyspark.sql import functions as F

from promptloom.functions import times as T
from promptloom.functions import variants as V
from promptloom.operators import prompts as P
from promptloom.operators import responses as R
from promptloom.plans import fixtures as X
from promptloom.plans.registry import query
from promptloom.sources import scan, sinks, workspace

RECORD = ["doc_id", "input_text", "target_lang"]


def _file_of(path):
    """Name of the folder ``file=<name>`` a row was written below."""
    return F.regexp_extract(path, r"file=([^/]+)/", 1)


def _record(*fields):
    return F.to_json(F.struct(*(fields or RECORD)))


def _arrays(spark, sf, rows_per_document=50):
    path = workspace.new_path(spark, "arrays")
    rows = X.prompts(spark, sf).select("file", "idx", _record().alias("line"))
    sinks.write_json_array(rows, path, "file", "idx", "line", rows_per_document)
    return path


def _lines(spark, sf):
    """Prompt lines in file order with blank and broken lines among them."""
    path = workspace.new_path(spark, "lines")
    rows = X.prompts(spark, sf).select("file", "idx", _record().alias("value"))
    extra = F.when(F.col("idx") % 9 == 4, F.array("value", F.lit("   "), F.lit("broken {"))).otherwise(F.array("value"))
    (rows.select("file", "idx", F.posexplode(extra).alias("k", "value"))
     .repartitionByRange(8, "file").sortWithinPartitions("file", "idx", "k")
     .select("file", "value").write.partitionBy("file").text(path))
    return path


def _fields_of():
    return [V.get(F.col("item"), "$.doc_id", "bigint").alias("doc_id"), V.get(F.col("item"), "$.input_text").alias("input_text"),
            V.get(F.col("item"), "$.target_lang").alias("target_lang")]


def _fields(df):
    return df.select(*_fields_of())


DOCS = "SELECT doc_id, text AS input_text, lang AS target_lang FROM documents"


@query("scan_json", DOCS)
def scan_json(spark, sf):
    return _fields(scan.scan_json(spark, _arrays(spark, sf)))


@query("scan_jsonl", f"""WITH {X.PROMPTS} SELECT doc_id, input_text, target_lang FROM prompts
  UNION ALL SELECT NULL, NULL, NULL FROM prompts WHERE idx % 9 = 4""")
def scan_jsonl(spark, sf):
    return _fields(scan.scan_jsonl(spark, _lines(spark, sf)))


@query("with_position", f"""WITH {X.PROMPTS}, parts AS (SELECT file, doc_id, idx, unnest(CASE WHEN idx % 9 = 4 THEN [0, 2] ELSE [0] END) AS k FROM prompts)
  SELECT file, CASE WHEN k = 0 THEN doc_id END AS doc_id, row_number() OVER (PARTITION BY file ORDER BY idx, k) - 1 AS idx FROM parts""")
def with_position(spark, sf):
    placed = scan.with_position(scan.scan_jsonl(spark, _lines(spark, sf)))
    return placed.select(_file_of("file_path").alias("file"), V.get(F.col("item"), "$.doc_id", "bigint").alias("doc_id"), "idx")


def _mixed(spark, sf):
    """Even documents as JSON arrays, odd ones as JSON Lines, in one folder tree."""
    path = workspace.new_path(spark, "mixed")
    rows = X.prompts(spark, sf).select("file", "idx", "doc_id", _record().alias("line"))
    sinks.write_json_array(rows.where("doc_id % 2 = 0"), f"{path}/a", "file", "idx", "line", 50)
    lines = rows.where("doc_id % 2 = 1").select("file", V.parse(F.col("line")).alias("v")).select(
        "file", V.get(F.col("v"), "$.doc_id", "bigint").alias("doc_id"), V.get(F.col("v"), "$.input_text").alias("input_text"),
        V.get(F.col("v"), "$.target_lang").alias("target_lang"))
    sinks.write_jsonl(lines, f"{path}/l", ["file"])
    return path


def _mixed_rows(spark, path):
    # Spark names its own parts .txt and .json, not .json and .jsonl, so the names to look for are given.
    return scan.scan_inputs(spark, path, "*.txt", "*.json")


@query("scan_inputs", DOCS)
def scan_inputs(spark, sf):
    path = _mixed(spark, sf)
    return _fields(_mixed_rows(spark, path))


@query("union_inputs", """SELECT source AS file, count(*) AS records, sum(doc_id)::BIGINT AS ids, sum(length(text))::BIGINT AS chars
  FROM documents GROUP BY source""")
def union_inputs(spark, sf):
    path = _mixed(spark, sf)
    both = _mixed_rows(spark, path)
    return both.groupBy(_file_of("file_path").alias("file")).agg(
        F.count("*").alias("records"), F.sum(V.get(F.col("item"), "$.doc_id", "bigint")).alias("ids"),
        F.sum(F.length(V.get(F.col("item"), "$.input_text")).cast("bigint")).alias("chars"))


@query("write_jsonl", DOCS)
def write_jsonl(spark, sf):
    path = workspace.new_path(spark, "jsonl")
    sinks.write_jsonl(X.prompts(spark, sf).select("file", *RECORD), path, ["file"])
    return spark.read.schema("doc_id bigint, input_text string, target_lang string").json(path).select(*RECORD)


@query("write_json_array", f"WITH {X.PROMPTS} SELECT file, idx, doc_id, input_text, target_lang FROM prompts")
def write_json_array(spark, sf):
    """Whole records in documents of 64 kB, read back with their places in the logical file."""
    path = workspace.new_path(spark, "arrays")
    sinks.write_json_array(X.prompts(spark, sf).select("file", "idx", _record().alias("line")), path, "file", "idx", "line", bytes_per_document=64 << 10)
    rows = scan.scan_json(spark, path).select("*", _file_of("file_path").alias("file"), F.regexp_extract("file_path", "document=([0-9]+)/", 1).cast("bigint").alias("document"))
    return scan.with_position(rows, "file", ["document"]).select("file", "idx", "item").select("file", "idx", *_fields_of())


def _answer_table(spark, sf):
    users, replies = X.pairs(spark, sf)
    raw = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("assistant").alias("content")).alias("message"))).alias("choices")))
    return R.align_left(replies.withColumn("raw", raw), users, ["conv_id", "turn"], "user").select(
        "conv_id", "turn", "raw", F.lit(P.DEFAULT_SYSTEM).alias("system"), "user",
        R.extract_content(V.parse(F.col("raw"))).alias("assistant"))


def _outputs(spark, sf):
    path = workspace.new_path(spark, "outputs")
    sinks.write_outputs(_answer_table(spark, sf), path, "raw", ["system", "user", "assistant"], ["conv_id", "turn"])
    return path


def _raw_files(spark, sf):
    """Raw answers as named files of about 16 kB, five batches of them."""
    path = workspace.new_path(spark, "raw-files")
    rows = _answer_table(spark, sf).select(F.concat(F.lit("batch_"), (F.col("conv_id") % 5).cast("string")).alias("batch"), (F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), "raw")
    sinks.write_raw_responses(rows, path, "batch", "idx", "raw", 16 << 10)
    return path


@query("sink_raw", """WITH r AS (SELECT 'batch_' || conv_id % 5 AS batch, text AS content, row_number() OVER (PARTITION BY conv_id % 5 ORDER BY conv_id, turn) - 1 AS place
    FROM conversations WHERE role = 'assistant') SELECT batch, place, content FROM r""")
def sink_raw(spark, sf):
    name = F.regexp_extract("file_name", "^(batch_[0-9]+)(?:_part([0-9]+))?_raw_response", 1)
    part = F.coalesce(F.nullif(F.regexp_extract("file_name", "^(batch_[0-9]+)(?:_part([0-9]+))?_raw_response", 2), F.lit("")), F.lit("0")).cast("bigint")
    rows = scan.scan_raw_responses(spark, _raw_files(spark, sf)).select("*", name.alias("batch"), part.alias("part"))
    return scan.with_position(rows, "batch", ["part"]).select("batch", F.col("idx").alias("place"), R.extract_content(F.col("item")).alias("content"))


@query("sink_formatted", f"""WITH {X.PAIRS} SELECT r.conv_id, r.turn, 'You are a helpful assistant' AS system,
    coalesce(u."user", 'Error: Input data not found') AS "user", r.assistant FROM replies r LEFT JOIN users u USING (conv_id, turn)""")
def sink_formatted(spark, sf):
    kind = "conv_id bigint, turn bigint, system string, user string, assistant string"
    return spark.read.schema(kind).json(f"{_outputs(spark, sf)}/formatted")


@query("sink_parsed", """SELECT conv_id, turn - 1 AS turn, text AS content FROM conversations WHERE role = 'assistant'""")
def sink_parsed(spark, sf):
    return spark.read.schema("conv_id bigint, turn bigint, content string").json(f"{_outputs(spark, sf)}/parsed")


@query("sink_combined", f"WITH {X.PROMPTS} SELECT file, idx, input_text AS content FROM prompts")
def sink_combined(spark, sf):
    """Contents in the order of their lines: part files by name, then their lines."""
    path = workspace.new_path(spark, "combined")
    sinks.write_combined(X.prompts(spark, sf), path, "file", "idx", "input_text")
    rows = scan.scan_jsonl(spark, path, "*.json").withColumn("file", _file_of("file_path"))
    return scan.with_position(rows, "file").select("file", "idx", V.get(F.col("item"), "$.content").alias("content"))


@query("scan_raw_responses", """SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 4 THEN text || chr(10) || 'end' WHEN 5 THEN NULL ELSE text END AS content
  FROM conversations WHERE role = 'assistant'""")
def scan_raw_responses(spark, sf):
    path = workspace.new_path(spark, "raw")
    rows = X.answers(spark, sf).select(
        F.lit("answers").alias("file"), F.struct("conv_id", "turn").alias("key"), "conv_id", "turn", "line")
    wrapped = F.concat(F.lit('{"conv_id":'), F.col("conv_id").cast("string"), F.lit(',"turn":'), F.col("turn").cast("string"),
                       F.lit(',"answer":'), F.col("line"), F.lit("}"))
    numbered = rows.withColumn("idx", F.col("conv_id") * 1000 + F.col("turn")).withColumn("wrapped", wrapped)
    sinks.write_json_array(numbered, path, "file", "idx", "wrapped", 50_000)
    answers = scan.scan_raw_responses(spark, path, "*.txt")
    return answers.select(V.get(F.col("item"), "$.conv_id", "bigint").alias("conv_id"), V.get(F.col("item"), "$.turn", "bigint").alias("turn"),
                          R.extract_content(V.get(F.col("item"), "$.answer", "variant")).alias("content"))


@query("decode_batch_output", """SELECT conv_id, turn, line_no::BIGINT AS line_no, CASE WHEN line_no = 1 AND turn % 3 = 1 THEN 'not json' ELSE text END AS content
  FROM conversations, (SELECT unnest([0, 1]) AS line_no) WHERE role = 'assistant' AND (turn % 3 <> 2 OR line_no = 0)""")
def decode_batch_output(spark, sf):
    rows = X.table(spark, sf, "conversations").where(F.col("role") == "assistant")
    one = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices")))
    kind = F.col("turn") % 3
    output = (F.when(kind == 0, F.concat_ws("\n", one, F.lit(""), one)).when(kind == 1, F.concat_ws("\n", one, F.lit("not json")))
              .otherwise(one))
    decoded = R.decode_batch_output(rows.select("conv_id", "turn", output.alias("output")), "output", ["conv_id", "turn"])
    return decoded.select("conv_id", "turn", F.col("line_no").cast("bigint"), R.extract_content(F.col("answer")).alias("content"))


@query("snapshot_inputs", """SELECT '20240101_000000' AS stamp, source AS file, count(*) AS records, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source
  UNION ALL SELECT '20240102_000000', source, count(*), sum(n_chars)::BIGINT FROM documents WHERE doc_id % 2 = 0 GROUP BY source""")
def snapshot_inputs(spark, sf):
    path = workspace.new_path(spark, "snapshots")
    docs = X.table(spark, sf, "documents")
    sinks.snapshot_inputs(docs, path, "20240101_000000")
    sinks.snapshot_inputs(docs.where("doc_id % 2 = 0"), path, "20240102_000000")
    stored = spark.read.schema("doc_id bigint, source string, n_chars bigint, snapshot_ts string").parquet(path)
    return stored.groupBy(F.col("snapshot_ts").alias("stamp"), F.col("source").alias("file")).agg(
        F.count("*").alias("records"), F.sum("n_chars").alias("chars"))


@query("append_run_log", """SELECT CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, event_type AS module, count(*) AS records,
    sum((props->>'$.k')::BIGINT)::BIGINT AS extra FROM events GROUP BY ALL""")
def append_run_log(spark, sf):
    path = workspace.new_path(spark, "log")
    level = F.when(F.col("status") == "error", "ERROR").otherwise("INFO")
    rows = sinks.log_rows(X.events(spark, sf), F.col("ts"), F.lit("run"), level, F.concat(F.lit("job "), F.col("status")),
                          F.col("status"), F.lit("run"), F.col("event_id") % 500, F.col("props"))
    sinks.append_run_log(rows.where("line_number % 2 = 0"), path)
    sinks.append_run_log(rows.where("line_number % 2 = 1"), path)
    return spark.read.parquet(path).groupBy("level", "module").agg(
        F.count("*").alias("records"), F.sum(V.get(V.parse(F.col("extra_data")), "$.k", "bigint")).alias("extra"))


@query("scan_config", """SELECT 'user' || c_custkey AS user_id, CASE WHEN c_custkey % 11 <> 0 THEN c_name END AS task_name,
    CASE WHEN c_custkey % 4 = 0 AND c_custkey % 13 <> 0 THEN (c_custkey % 50 + 1)::INT END AS batch_size,
    CASE WHEN c_custkey % 17 <> 0 THEN 10 END AS num_processes FROM customer""")
def scan_config(spark, sf):
    """Config files of up to 1,000 configs each, so that their number stays small; a customer has one config."""
    path = workspace.new_path(spark, "configs")
    rows = X.configs(spark, sf).where("config_text IS NOT NULL").dropDuplicates(["c_custkey"]).select(
        F.lit("customers").alias("file"), "c_custkey", "config_text")
    sinks.write_json_array(rows, path, "file", "c_custkey", "config_text", 1_000)
    return scan.scan_config(spark, path).select("user_id", "task_name", F.col("openai.batch.batch_size").alias("batch_size"),
                                                F.col("general.num_processes").alias("num_processes"))


@query("scan_tasks", """SELECT 'user' || c_nationkey AS user_id, 'openai' AS api_name, 'job-' || c_custkey AS task_name,
    epoch_us(TIMESTAMP '2024-02-01 03:04:05') AS created_us FROM customer""")
def scan_tasks(spark, sf):
    """Folders have ``name=`` in front as in partitioned tables, which is taken off again.

    A folder costs far more than its bytes, so the tree is written by a fixed number of tasks, which name their own files.
    """
    path = workspace.new_path(spark, "tree")
    folder = F.concat(F.lit("openai_job-"), F.col("c_custkey").cast("string"), F.lit("_01_02_2024_030405"))
    rows = X.configs(spark, sf).select(F.concat(F.lit("user"), F.col("c_nationkey").cast("string")).alias("user"), folder.alias("task"), F.lit("config").alias("leaf"),
                                       F.col("config_text").alias("value"))
    sinks.write_tree(rows, path, ["user", "task", "leaf"], "value", int(spark.conf.get("spark.sql.shuffle.partitions")))
    tasks = scan.scan_tasks(spark, path, glob=None)
    return tasks.select("user_id", "api_name", "task_name", T.epoch_micros(F.col("created_at")).alias("created_us"))

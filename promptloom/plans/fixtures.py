"""The given tables seen as prompts, answers, histories, jobs and tasks, in Spark and as check SQL."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.functions import times as T
from promptloom.functions import variants as V
from promptloom.operators import ordered


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as prompt rows numbered inside their file."""
    docs = table(spark, sf, "documents").select(
        F.col("source").alias("file"), "doc_id", F.col("text").alias("input_text"),
        F.concat(F.lit("Reply in "), "lang").alias("instructions"), F.col("lang").alias("target_lang"))
    return ordered.number_rows(docs, ["file"], ["doc_id"])


PROMPTS = """prompts AS (SELECT source AS file, doc_id, text AS input_text, 'Reply in ' || lang AS instructions,
  lang AS target_lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx FROM documents)"""


def json_string(text: Column) -> Column:
    """A text as a JSON string literal."""
    inside = F.to_json(F.array(text))
    return F.substring(inside, F.lit(2), F.length(inside) - 2)


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as prompt records of seven shapes, chosen by ``doc_id``, as JSON and VARIANT."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    text, reply = F.col("text"), F.concat(F.lit("Reply in "), "lang")
    direct = F.struct(text.alias("input_text"), reply.alias("instructions"))
    shape = F.col("doc_id") % 7
    line = (
        F.when(shape == 0, F.to_json(direct))
        .when(shape == 1, F.concat(F.lit('{"prompts":['), F.to_json(direct), F.lit(",5]}")))
        .when(shape == 2, json_string(text))
        .when(shape == 3, F.to_json(F.struct(text.alias("q"))))
        .when(shape == 4, F.to_json(F.struct(F.lit("").alias("input_text"), reply.alias("instructions"))))
        .when(shape == 5, F.lit('{"prompts":[]}'))
        .otherwise(F.to_json(F.struct(text.alias("input_text"), F.lit("").alias("instructions"))))
    )
    return docs.withColumn("line", line).withColumn("item", V.parse(F.col("line")))


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns as answers of six shapes, chosen by conversation and turn."""
    rows = table(spark, sf, "conversations").where(F.col("role") == "assistant").select("conv_id", "turn", "text")
    text = F.col("text")
    choices = F.array(F.struct(F.struct(text.alias("content")).alias("message")))
    shape = (F.col("conv_id") + F.col("turn")) % 6
    line = (
        F.when(shape == 0, F.to_json(F.struct(F.struct(F.struct(choices.alias("choices")).alias("body")).alias("response"))))
        .when(shape == 1, F.to_json(F.struct(choices.alias("choices"))))
        .when(shape == 2, F.to_json(F.struct(text.alias("content"))))
        .when(shape == 3, json_string(text))
        .when(shape == 4, F.to_json(F.array(text, F.lit("end"))))
        .otherwise(F.lit('{"choices":[]}'))
    )
    return rows.withColumn("line", line).withColumn("item", V.parse(F.col("line")))


def pairs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """User turns and the assistant turns that follow them, both keyed by ``conv_id, turn``."""
    rows = table(spark, sf, "conversations")
    users = rows.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("user"))
    replies = rows.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("assistant"))
    return users, replies


PAIRS = """users AS (SELECT conv_id, turn, text AS "user" FROM conversations WHERE role = 'user'),
  replies AS (SELECT conv_id, turn - 1 AS turn, text AS assistant FROM conversations WHERE role = 'assistant')"""


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as status records: job, status, and time in microseconds."""
    return table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), "ts", "value", "props",
        T.epoch_micros(F.col("ts")).alias("us"))


EVENTS = """ev AS (SELECT event_id, user_id AS job_id, event_type AS status, ts, value, props,
  epoch_us(ts) AS us FROM events)"""


def history(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as past responses: task is the language, ``seq`` the place in it."""
    docs = table(spark, sf, "documents").select(F.col("lang").alias("task"), "doc_id", "text")
    return ordered.number_rows(docs, ["task"], ["doc_id"], "seq")


HISTORY = """history AS (SELECT lang AS task, doc_id, text,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS seq FROM documents)"""

TOKENS = r"list_distinct(list_filter(regexp_split_to_array({0}, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''))"


def tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as task folders."""
    from promptloom.functions import names as N
    rows = table(spark, sf, "orders")
    api = F.when(F.col("o_orderstatus") == "F", "openai").when(F.col("o_orderstatus") == "O", "deepseek").otherwise("deepl")
    name = F.concat(F.lit("report_"), F.substring("o_orderpriority", 1, 1), F.lit("-"), F.col("o_orderkey").cast("string"))
    created = F.timestamp_add("SECOND", F.col("o_orderkey") % 86400, F.col("o_orderdate"))
    user = F.concat(F.lit("user"), F.col("o_custkey").cast("string"))
    base = rows.select("o_orderkey", "o_custkey", user.alias("user_id"), api.alias("api_name"),
                       name.alias("task_name"), created.alias("created_at"),
                       F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1).alias("kind"))
    folder = N.task_folder_name(F.col("api_name"), F.col("task_name"), F.col("created_at"))
    return base.withColumn("folder", folder).withColumn(
        "path", N.task_path(F.lit("tasks"), F.col("user_id"), F.col("folder")))


TASKS = """base AS (SELECT o_orderkey, o_custkey, 'user' || o_custkey AS user_id,
    CASE o_orderstatus WHEN 'F' THEN 'openai' WHEN 'O' THEN 'deepseek' ELSE 'deepl' END AS api_name,
    'report_' || substr(o_orderpriority, 1, 1) || '-' || o_orderkey AS task_name,
    o_orderdate + to_seconds(o_orderkey % 86400) AS created_at, o_orderstatus,
    substr(o_orderpriority, 1, 1) AS kind FROM orders),
  named AS (SELECT *, api_name || '_' || task_name || '_' || strftime(created_at, '%d_%m_%Y_%H%M%S') AS folder FROM base),
  tasks AS (SELECT *, 'tasks/' || user_id || '/' || folder AS path FROM named)"""


def configs(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as task configs in JSON, some of them incomplete, with the provider they are for."""
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    k = F.col("c_custkey")
    api = F.element_at(F.array(F.lit("openai"), F.lit("deepseek"), F.lit("deepl"), F.lit("other")), (k % 4 + 1).cast("int"))
    section = F.concat(
        F.lit('{"api_key":"k","prompt":"input_text","batch":{"is_batch_active":'),
        F.when(k % 3 == 0, F.lit("true")).otherwise(F.lit("false")),
        F.lit(',"file_batch":'), F.when(k % 2 == 0, F.lit("true")).otherwise(F.lit("false")),
        F.lit(',"batch_size":'), F.when(k % 13 == 0, F.lit('"many"')).otherwise((k % 50 + 1).cast("string")),
        F.lit('},"api_information":{"model":"m'), (k % 5).cast("string"), F.lit('"}}'))
    text = F.concat(
        F.lit("{"),
        F.when(k % 11 == 0, F.lit("")).otherwise(F.concat(F.lit('"task_name":'), json_string(F.col("c_name")), F.lit(","))),
        F.lit('"user_id":"user'), k.cast("string"), F.lit('","'), api, F.lit('":'), section,
        F.when(k % 17 == 0, F.lit("")).otherwise(F.lit(',"general":{"verbose":true,"num_processes":10}')),
        F.lit("}"))
    built = rows.select("c_custkey", "c_name", "c_nationkey", api.alias("api"), text.alias("config_text"))
    return built.withColumn("config", V.parse(F.col("config_text")))


CONFIGS = """raw AS (SELECT c_custkey AS k, c_name, c_nationkey,
    ['openai','deepseek','deepl','other'][(c_custkey % 4) + 1] AS api FROM customer),
  configs AS (SELECT k AS c_custkey, c_name, c_nationkey, api, '{'
    || CASE WHEN k % 11 = 0 THEN '' ELSE '"task_name":' || to_json(c_name)::VARCHAR || ',' END
    || '"user_id":"user' || k || '","' || api || '":{"api_key":"k","prompt":"input_text","batch":{"is_batch_active":'
    || CASE WHEN k % 3 = 0 THEN 'true' ELSE 'false' END || ',"file_batch":'
    || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END || ',"batch_size":'
    || CASE WHEN k % 13 = 0 THEN '"many"' ELSE (k % 50 + 1)::VARCHAR END
    || '},"api_information":{"model":"m' || (k % 5) || '"}}'
    || CASE WHEN k % 17 = 0 THEN '' ELSE ',"general":{"verbose":true,"num_processes":10}' END || '}' AS config_text FROM raw)"""

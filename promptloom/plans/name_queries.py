"""Names, keys, times, task catalogue and config values."""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from promptloom.functions import keys as K
from promptloom.functions import names as N
from promptloom.functions import times as T
from promptloom.functions import variants as V
from promptloom.operators import batches as B
from promptloom.operators import config as G
from promptloom.operators import tasks as C
from promptloom.plans import fixtures as X
from promptloom.plans.registry import query
from promptloom.sources import sinks

FILE_SQL = "(CASE WHEN doc_id % 3 = 0 THEN upper(lang) || '_' ELSE '' END || source || '.v1.jsonl')"
STEM_SQL = "(CASE WHEN doc_id % 3 = 0 THEN upper(lang) || '_' ELSE '' END || source || '.v1')"
LANG_SQL = "(CASE WHEN doc_id % 3 = 0 THEN lang ELSE 'en' END)"


def _files(spark, sf):
    prefix = F.when(F.col("doc_id") % 3 == 0, F.concat(F.upper("lang"), F.lit("_"))).otherwise(F.lit(""))
    return X.table(spark, sf, "documents").select("doc_id", "source", "lang", F.concat(prefix, "source", F.lit(".v1.jsonl")).alias("file"))


@query("language_from_name", f"SELECT doc_id, {LANG_SQL} AS language FROM documents")
def language_from_name(spark, sf):
    return _files(spark, sf).select("doc_id", N.language_from_name(F.col("file")).alias("language"))


@query("result_filename", f"SELECT doc_id, {LANG_SQL} || '_job_' || {STEM_SQL} || '_1.jsonl' AS result_name FROM documents")
def result_filename(spark, sf):
    return _files(spark, sf).select("doc_id", N.result_filename(F.col("file"), F.lit("job"), F.lit(1)).alias("result_name"))


@query("sink_per_item", f"SELECT doc_id, {LANG_SQL} || '_' || source || '_' || {STEM_SQL} || '_1.jsonl' AS result_name FROM documents")
def sink_per_item(spark, sf):
    return sinks.per_item_names(_files(spark, sf), "file", F.col("source")).select("doc_id", "result_name")


@query("final_result_name", "SELECT source AS file, source || '_' || count(*) || '.jsonl' AS final_name FROM documents GROUP BY source")
def final_result_name(spark, sf):
    counts = B.count_items(X.table(spark, sf, "documents").withColumnRenamed("source", "file"))
    return counts.select("file", N.final_result_name(F.col("file"), F.col("items")).alias("final_name"))


@query("output_names", f"""SELECT doc_id, {STEM_SQL} || '_raw_response.json' AS raw, {STEM_SQL} || '_formatted_response.json' AS formatted,
    'parsed_' || {STEM_SQL} || '.jsonl' AS parsed, {STEM_SQL} || '_combined_response.jsonl' AS combined FROM documents""")
def output_names(spark, sf):
    raw = _files(spark, sf).select("doc_id", "file", N.raw_name(F.col("file")).alias("raw"))
    return raw.select("doc_id", "raw", N.formatted_name(F.col("raw")).alias("formatted"),
                      N.parsed_name(F.col("raw")).alias("parsed"), N.combined_name(F.col("file")).alias("combined"))


@query("task_folder_name", f"""SELECT event_id, event_type || '_u' || user_id || '_' || strftime(ts, '%d_%m_%Y_%H%M%S') AS folder,
    'root/' || user_id || '/' || event_type || '_u' || user_id || '_' || strftime(ts, '%d_%m_%Y_%H%M%S') AS path FROM events""")
def task_folder_name(spark, sf):
    folder = N.task_folder_name(F.col("event_type"), F.concat(F.lit("u"), F.col("user_id").cast("string")), F.col("ts"))
    return X.table(spark, sf, "events").select("event_id", folder.alias("folder"),
                                               N.task_path(F.lit("root"), F.col("user_id").cast("string"), folder).alias("path"))


@query("parse_task_path", f"""WITH {X.TASKS} SELECT o_orderkey, user_id, CASE WHEN o_orderkey % 5 = 0 THEN 'loose' ELSE api_name END AS api_name,
    CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE task_name END AS task_name,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE epoch_us(created_at) END AS created_us FROM tasks""")
def parse_task_path(spark, sf):
    compact = F.concat_ws("_", "api_name", "task_name", F.date_format("created_at", N.COMPACT_STAMP))
    folder = F.when(F.col("o_orderkey") % 5 == 0, F.lit("loose")).when(F.col("o_orderkey") % 5 == 1, compact).otherwise(F.col("folder"))
    rows = X.tasks(spark, sf).select("o_orderkey", N.task_path(F.lit("tasks"), F.col("user_id"), folder).alias("path"))
    return C.catalogue(rows, "path").select("o_orderkey", "user_id", "api_name", "task_name", T.epoch_micros(F.col("created_at")).alias("created_us"))


@query("resolve_task_name", """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN 'nested' WHEN 2 THEN lower(c_mktsegment) ELSE 'task' END AS task_name FROM customer""")
def resolve_task_name(spark, sf):
    k = F.col("c_custkey") % 4
    name = N.resolve_task_name(F.when(k == 0, F.col("c_name")).otherwise(F.lit("")), F.when(k == 1, F.lit("nested")),
                               F.when(k == 2, F.concat(F.lower("c_mktsegment"), F.lit("_x_1"))).otherwise(F.lit("")))
    return X.table(spark, sf, "customer").select("c_custkey", name.alias("task_name"))


@query("cache_key_position", f"WITH {X.PROMPTS} SELECT doc_id, file || '_' || idx AS cache_key FROM prompts")
def cache_key_position(spark, sf):
    return X.prompts(spark, sf).select("doc_id", K.cache_key_position(F.col("file"), F.col("idx")).alias("cache_key"))


@query("cache_key_service", "SELECT doc_id, lang || '_' || source AS cache_key FROM documents")
def cache_key_service(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", K.cache_key_service(F.col("lang"), F.col("source")).alias("cache_key"))


CANONICAL = "to_json({'model': 'gpt-4o', 'temperature': 0.7::DOUBLE, 'user': text})::VARCHAR"


@query("cache_key_sha256", f"SELECT doc_id, sha256({CANONICAL}) AS cache_key FROM documents")
def cache_key_sha256(spark, sf):
    text = K.sorted_json(user=F.col("text"), model=F.lit("gpt-4o"), temperature=F.lit(0.7))
    return X.table(spark, sf, "documents").select("doc_id", K.cache_key_sha256(text).alias("cache_key"))


@query("cache_key_md5", f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR ELSE md5({CANONICAL}) END AS cache_key FROM documents")
def cache_key_md5(spark, sf):
    text = K.sorted_json(user=F.col("text"), model=F.lit("gpt-4o"), temperature=F.lit(0.7))
    scalar = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id"))
    return X.table(spark, sf, "documents").select("doc_id", K.cache_key_md5(scalar, text).alias("cache_key"))


@query("elapsed_text", """WITH s AS (SELECT event_id, floor(value * 1000)::BIGINT AS t FROM events)
  SELECT event_id, CASE WHEN t >= 172800 THEN (t // 86400) || ' days, ' WHEN t >= 86400 THEN '1 day, ' ELSE '' END ||
    ((t % 86400) // 3600) || ':' || lpad(((t % 3600) // 60)::VARCHAR, 2, '0') || ':' || lpad((t % 60)::VARCHAR, 2, '0') AS elapsed FROM s""")
def elapsed_text(spark, sf):
    return X.table(spark, sf, "events").select("event_id", T.elapsed_text(F.col("value") * 1000).alias("elapsed"))


@query("parse_created_at", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch_us(date_trunc('second', ts)) WHEN 1 THEN epoch_us(date_trunc('second', ts))
    WHEN 2 THEN epoch_us(date_trunc('second', ts)) - 7200000000 END AS created_us FROM events""")
def parse_created_at(spark, sf):
    k = F.col("event_id") % 4
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = (F.when(k == 0, F.concat(iso, F.lit("Z"))).when(k == 1, F.floor(T.epoch_micros(F.col("ts")) / 1_000_000).cast("bigint").cast("string"))
            .when(k == 2, F.concat(iso, F.lit("+02:00"))).otherwise(F.lit("yesterday")))
    return X.table(spark, sf, "events").select("event_id", T.epoch_micros(T.parse_created_at(text)).alias("created_us"))


# --- task catalogue ------------------------------------------------------------------------------

@query("task_by_path", f"WITH {X.TASKS} SELECT path, user_id, api_name, task_name FROM tasks WHERE o_custkey % 10 = 3")
def task_by_path(spark, sf):
    rows = X.tasks(spark, sf)
    return C.task_by_path(rows.where("o_custkey % 10 = 3").select("path"), rows.select("path", "user_id", "api_name", "task_name"))


@query("task_status", f"""WITH {X.TASKS} SELECT o_orderkey, path, CASE WHEN o_orderkey % 3 = 0 THEN 'unknown'
    WHEN o_orderstatus = 'F' THEN 'success' WHEN o_orderstatus = 'O' THEN 'running' ELSE 'pending' END AS status FROM tasks""")
def task_status(spark, sf):
    rows = X.tasks(spark, sf)
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "running").otherwise("pending")
    known = rows.where("o_orderkey % 3 <> 0").select("path", status.alias("status"))
    return C.task_status(rows.select("o_orderkey", "path"), known, ["o_orderkey"])


# --- config --------------------------------------------------------------------------------------

LEAVES = """SELECT c_custkey, replace(replace(replace(replace(substr(fullkey, 3), '"', ''), '.', '_'), '[', '_'), ']', '') AS path,
    json_extract_string(atom, '$') AS leaf FROM t WHERE type NOT IN ('OBJECT', 'ARRAY')"""


@query("leaf_paths", f"WITH {X.CONFIGS}, t AS (SELECT c_custkey, j.fullkey, j.atom, j.type FROM configs, json_tree(config_text) j) {LEAVES}")
def leaf_paths(spark, sf):
    return G.leaf_paths(X.configs(spark, sf), "config", ["c_custkey"])


# Every ninth record nests forty levels deeper.
@query("leaf_paths_deep", f"""WITH {X.CONFIGS}, deep AS (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN repeat('{{"d":[', 20) || config_text || repeat(']}}', 20) ELSE config_text END AS config_text FROM configs),
  t AS (SELECT c_custkey, j.fullkey, j.atom, j.type FROM deep, json_tree(config_text) j) {LEAVES}""")
def leaf_paths_deep(spark, sf):
    deep = F.concat(F.repeat(F.lit('{"d":['), F.lit(20)), F.col("config_text"), F.repeat(F.lit("]}"), F.lit(20)))
    text = F.when(F.col("c_custkey") % 9 == 0, deep).otherwise(F.col("config_text"))
    rows = X.configs(spark, sf).select("c_custkey", V.parse(text).alias("config"))
    return G.leaf_paths(rows, "config", ["c_custkey"])


# Every seventh record is broken, every fifth update asks for no task name; the check's own merge takes a null as an order to remove.
@query("deep_merge", f"""WITH {X.CONFIGS}, m AS (SELECT c_custkey, c_custkey % 7 = 0 AS broken, c_custkey % 5 = 0 AS unnamed, config_text::JSON->>'$.task_name' AS old_name,
    json_merge_patch(config_text::JSON, ('{{"user_id":"u2","general":{{"verbose":false}},"extra":{{"n":' || c_custkey || '}}}}')::JSON) AS j FROM configs)
  SELECT c_custkey, CASE WHEN NOT broken THEN j->>'$.user_id' END AS user_id, CASE WHEN NOT broken THEN old_name END AS task_name,
    CASE WHEN NOT broken THEN j->>'$.general.verbose' END AS verbose, CASE WHEN NOT broken THEN (j->>'$.general.num_processes')::BIGINT END AS num_processes,
    CASE WHEN NOT broken THEN (j->>'$.extra.n')::BIGINT END AS n, CASE WHEN broken THEN 'config_text is not a JSON object' END AS merged_error FROM m""")
def deep_merge(spark, sf):
    key = F.col("c_custkey")
    update = F.concat(F.lit('{"user_id":"u2","general":{"verbose":false},'), F.when(key % 5 == 0, F.lit('"task_name":null,')).otherwise(F.lit("")),
                      F.lit('"extra":{"n":'), key.cast("string"), F.lit("}}"))
    text = F.when(key % 7 == 0, F.concat("config_text", F.lit("}"))).otherwise(F.col("config_text"))
    rows = X.configs(spark, sf).select("c_custkey", text.alias("config_text"), update.alias("update"))
    merged = G.deep_merge(rows, "config_text", "update", "merged", kept=["task_name"]).withColumn("m", V.parse(F.col("merged")))
    return merged.select("c_custkey", V.get(F.col("m"), "$.user_id").alias("user_id"), V.get(F.col("m"), "$.task_name").alias("task_name"),
                         V.get(F.col("m"), "$.general.verbose").alias("verbose"), V.get(F.col("m"), "$.general.num_processes", "bigint").alias("num_processes"),
                         V.get(F.col("m"), "$.extra.n", "bigint").alias("n"), "merged_error")


@query("deep_merge_structs", """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_name END AS name,
    CASE WHEN c_custkey % 3 = 0 THEN 1::BIGINT ELSE c_nationkey::BIGINT END AS nation FROM customer""")
def deep_merge_structs(spark, sf):
    kind = Ty.StructType().add("name", "string").add("inner", Ty.StructType().add("nation", "long"))
    base = F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_nationkey").cast("bigint").alias("nation")).alias("inner"))
    update = F.struct(F.when(F.col("c_custkey") % 2 == 0, F.lit("new")).alias("name"),
                      F.struct(F.when(F.col("c_custkey") % 3 == 0, F.lit(1).cast("bigint")).alias("nation")).alias("inner"))
    rows = X.table(spark, sf, "customer").select("c_custkey", G.deep_merge_structs(base, update, kind).alias("m"))
    return rows.select("c_custkey", "m.name", "m.inner.nation")


@query("filter_config_section", """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name END AS openai,
    CASE c_custkey % 3 WHEN 1 THEN c_mktsegment END AS deepl FROM customer""")
def filter_config_section(spark, sf):
    k = F.col("c_custkey") % 3
    api = F.when(k == 0, "OpenAI").when(k == 1, "deepl").otherwise("other")
    kept = G.filter_config_section(api, {"openai": F.struct(F.col("c_name").alias("x")), "deepl": F.struct(F.col("c_mktsegment").alias("x"))}, [F.col("c_custkey")])
    return X.table(spark, sf, "customer").select(kept.alias("c")).select("c.c_custkey", F.col("c.openai.x").alias("openai"), F.col("c.deepl.x").alias("deepl"))


@query("apply_defaults", """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 7 ELSE 5 END AS batch_size,
    CASE WHEN c_custkey % 3 = 0 THEN 60 ELSE 3600 END AS ttl, 0.8 ::DOUBLE AS threshold FROM customer""")
def apply_defaults(spark, sf):
    rows = X.table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.lit(7)).alias("batch_size"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit(60)).alias("ttl"), F.lit(None).cast("double").alias("threshold"))
    return G.apply_defaults(rows, {"batch_size": "batch.batch_size", "ttl": "cache.memory_cache_ttl",
                                   "threshold": "general.similarity_check.settings.similarity_threshold"})


@query("validate_config", f"""WITH {X.CONFIGS} SELECT c_custkey, array_to_string(list_filter([
    CASE WHEN c_custkey % 11 = 0 THEN 'task_name is required' END, CASE WHEN c_custkey % 17 = 0 THEN 'general is required' END,
    CASE WHEN api = 'other' THEN 'section other not found' END,
    CASE WHEN api <> 'other' AND c_custkey % 13 = 0 THEN 'batch_size is not a number' END,
    CASE WHEN c_custkey % 17 <> 0 THEN 'general.multiprocessing_enabled is required; general.sampling is required; general.logs is required; general.db is required' END,
    CASE WHEN api IN ('openai', 'deepseek') THEN 'api_information.setting is required' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM configs""")
def validate_config(spark, sf):
    return X.configs(spark, sf).select("c_custkey", F.array_join(G.validate_config(F.col("config"), F.col("api")), "; ").alias("reasons"))


@query("batch_mode", f"""WITH {X.CONFIGS} SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 OR c_custkey % 13 = 0 THEN 'single'
    WHEN c_custkey % 2 = 0 AND api <> 'deepl' THEN 'file_batch' ELSE 'batch' END AS mode FROM configs""")
def batch_mode(spark, sf):
    section = F.coalesce(*[F.when(F.col("api") == p, V.get(F.col("config"), f"$.{p}.batch", "variant")) for p in ("openai", "deepseek", "deepl", "other")])
    mode = G.batch_mode(V.get(section, "$.is_batch_active", "boolean"), V.get(section, "$.file_batch", "boolean"), F.col("api"),
                        V.get(section, "$.batch_size", "int"))
    return X.configs(spark, sf).select("c_custkey", mode.alias("mode"))


@query("json_get", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 999 WHEN event_id % 3 = 1 THEN (props->>'$.k')::BIGINT ELSE (props->>'$.k')::BIGINT + 1000 END AS k FROM events""")
def json_get(spark, sf):
    kind = F.col("event_id") % 3
    number = V.get(V.parse(F.col("props")), "$.k", "bigint")
    text = (F.when(kind == 0, F.lit("{}")).when(kind == 1, F.col("props"))
            .otherwise(F.concat(F.lit('{"k":1,"openai":{"k":'), (number + 1000).cast("string"), F.lit("}}"))))
    return X.table(spark, sf, "events").select("event_id", G.json_get(V.parse(text), "k", "openai", F.lit(999).cast("bigint"), "bigint").alias("k"))

"""Matching answers with inputs, batches, cache, and provider lookups."""
from __future__ import annotations

from pyspark.sql import functions as F

from promptloom.functions import keys as K
from promptloom.operators import batches as B
from promptloom.operators import cache as C
from promptloom.operators import config as G
from promptloom.operators import dispatch as D
from promptloom.operators import responses as R
from promptloom.operators import tasks as T
from promptloom.plans import fixtures as X
from promptloom.plans.registry import query
from promptloom.sources import workspace


@query("align_inner", f"""WITH {X.PAIRS} SELECT conv_id, turn, "user", assistant FROM users JOIN replies USING (conv_id, turn)""")
def align_inner(spark, sf):
    return R.align_inner(*X.pairs(spark, sf), ["conv_id", "turn"])


@query("align_left", f"""WITH {X.PAIRS} SELECT r.conv_id, r.turn, r.assistant,
    CASE WHEN u."user" IS NULL OR u.conv_id % 5 = 0 THEN 'Error: Input data not found' ELSE u."user" END AS "user"
  FROM replies r LEFT JOIN users u USING (conv_id, turn)""")
def align_left(spark, sf):
    users, replies = X.pairs(spark, sf)
    return R.align_left(replies, users.where(F.col("conv_id") % 5 != 0), ["conv_id", "turn"], "user")


def _requests(spark, sf):
    return B.number_in_batch(B.split_batches(X.prompts(spark, sf), 20), 20)


@query("align_by_custom_id", f"""WITH {X.PROMPTS} SELECT doc_id, file, 'request_' || (idx % 20) AS custom_id,
    'batch_' || lpad((idx // 20)::VARCHAR, 4, '0') AS batch_id, input_text,
    CASE WHEN doc_id % 10 = 3 THEN NULL ELSE 're: ' || input_text END AS answer FROM prompts""")
def align_by_custom_id(spark, sf):
    requests = _requests(spark, sf)
    answers = requests.where(F.col("doc_id") % 10 != 3).select("file", "batch_id", "custom_id", F.concat(F.lit("re: "), "input_text").alias("answer"))
    return R.align_by_custom_id(requests.select("file", "batch_id", "custom_id", "doc_id", "input_text"), answers)


@query("resolve_input_file", """WITH inputs AS (SELECT DISTINCT lang AS task, source || '.jsonl' AS input_name FROM documents),
    responses AS (SELECT DISTINCT lang AS task, source, CASE WHEN doc_id % 3 = 0 THEN source || '_raw_response.json'
      WHEN doc_id % 3 = 1 THEN source || '_batch_response_raw_response.json' ELSE 'batch_' || source || '_raw_response.json' END AS response_name,
      doc_id % 3 AS k FROM documents)
  SELECT DISTINCT r.task, r.response_name, CASE WHEN k = 2 THEN f.first_file ELSE r.source || '.jsonl' END AS input_name
  FROM responses r JOIN (SELECT task, min(input_name) AS first_file FROM inputs GROUP BY task) f USING (task)""")
def resolve_input_file(spark, sf):
    docs = X.table(spark, sf, "documents").select(F.col("lang").alias("task"), "source", "doc_id")
    inputs = docs.select("task", F.concat("source", F.lit(".jsonl")).alias("input_name"))
    kind = F.col("doc_id") % 3
    name = (F.when(kind == 0, F.concat("source", F.lit("_raw_response.json")))
            .when(kind == 1, F.concat("source", F.lit("_batch_response_raw_response.json")))
            .otherwise(F.concat(F.lit("batch_"), "source", F.lit("_raw_response.json"))))
    return R.resolve_input_file(docs.select("task", name.alias("response_name")), inputs)


def _cache(spark, sf):
    """Labels as a cache: one row per labelled document."""
    return X.table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").cast("bigint").alias("value")).withColumn(
        "cache_key", F.col("doc_id").cast("string")).drop("doc_id")


def _cache_requests(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", "lang", F.col("doc_id").cast("string").alias("cache_key"))


@query("cache_hits", """SELECT d.doc_id, d.lang, d.doc_id::VARCHAR AS cache_key, l.value FROM documents d
  JOIN (SELECT doc_id, max(quality)::BIGINT AS value FROM labels GROUP BY doc_id) l USING (doc_id)""")
def cache_hits(spark, sf):
    return C.cache_hits(_cache_requests(spark, sf), _cache(spark, sf), "cache_key", ["doc_id"])


@query("cache_misses", """SELECT doc_id, lang, doc_id::VARCHAR AS cache_key FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def cache_misses(spark, sf):
    return C.cache_misses(_cache_requests(spark, sf), _cache(spark, sf), "cache_key", ["doc_id"])


class Echo:
    """Stand-in provider: answers with the body, refuses bodies that ask for it."""

    def __call__(self, body: str) -> str:
        if body.startswith("fail"):
            raise ValueError("refused")
        return "re " + body


def _bodies(spark, sf):
    """Requests with the whole text, whose key is its hash, so copies of a text share a key."""
    return X.table(spark, sf, "documents").select("doc_id", F.concat_ws(":", "lang", "text").alias("body")).withColumn(
        "request_key", K.cache_key_sha256(F.col("body")))


BODIES = """bodies AS (SELECT doc_id, lang || ':' || text AS body FROM documents)"""


@query("dispatch", f"""WITH {BODIES} SELECT sha256(body) AS request_key, 're ' || body AS answer, NULL::VARCHAR AS error, 1 AS attempts
  FROM (SELECT DISTINCT body FROM bodies WHERE body NOT LIKE 'de%')
  UNION ALL SELECT sha256(body), NULL, 'refused', 1 FROM (SELECT DISTINCT body FROM bodies WHERE body LIKE 'de%')""")
def dispatch(spark, sf):
    rows = _bodies(spark, sf)
    rows = rows.withColumn("sent", F.when(F.startswith("body", F.lit("de")), F.concat(F.lit("fail"), "body")).otherwise(F.col("body")))
    unique = C.dedup_requests(rows, "request_key", ["doc_id"])
    return D.dispatch(unique, Echo, body="sent")


class Named:
    """Stand-in providers by name; one of them refuses every body, one cannot be made."""

    def __init__(self, name: str):
        if name == "es":
            raise ValueError("no key for es")
        self.name = name

    def __call__(self, body: str) -> str:
        if self.name == "fr":
            raise ValueError("refused")
        return f"{self.name} says {body}"


@query("dispatch_by_provider", """SELECT doc_id AS request_key, CASE WHEN lang NOT IN ('es', 'fr') THEN lang || ' says ' || text END AS answer,
    CASE lang WHEN 'es' THEN 'no key for es' WHEN 'fr' THEN 'refused' END AS error, CASE WHEN lang = 'es' THEN 0 ELSE 1 END AS attempts FROM documents""")
def dispatch_by_provider(spark, sf):
    rows = X.table(spark, sf, "documents").select(F.col("doc_id").alias("request_key"), F.col("text").alias("body"), "lang")
    return D.dispatch(rows, Named, provider="lang")


@query("dispatch_once", """SELECT request_key, answer, CASE WHEN request_key % 3 = 0 THEN 1 ELSE 2 END AS run FROM (
    SELECT doc_id AS request_key, 're ' || text AS answer FROM documents)""")
def dispatch_once(spark, sf):
    """A run over a third of the requests, then one over all: answers of the first are not asked for again."""
    path = workspace.new_path(spark, "answers")
    rows = X.table(spark, sf, "documents").select(F.col("doc_id").alias("request_key"), F.col("text").alias("body"))
    first = workspace.materialize(D.dispatch_once(rows.where("request_key % 3 = 0"), Echo, path).select("request_key", F.col("attempts").alias("first")), "first")
    again = rows.withColumn("body", F.when(F.col("request_key") % 3 == 0, F.lit("fail: sent twice")).otherwise(F.col("body")))
    both = D.dispatch_once(again, Echo, path)
    return both.join(first, "request_key", "left").select("request_key", "answer", F.when(F.col("first").isNotNull(), 1).otherwise(2).alias("run"))


@query("get_or_set", f"""WITH {BODIES}, c AS (SELECT body, 'cached' AS value FROM bodies b JOIN
      (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY body)
  SELECT b.doc_id, sha256(b.body) AS request_key, CASE WHEN c.value IS NOT NULL THEN c.value WHEN b.body NOT LIKE 'de:%' THEN 're ' || b.body END AS value,
    CASE WHEN c.value IS NULL AND b.body LIKE 'de:%' THEN 'refused' END AS error, CASE WHEN c.value IS NULL THEN 1 END AS attempts
  FROM bodies b LEFT JOIN c USING (body)""")
def get_or_set(spark, sf):
    requests = _bodies(spark, sf)
    known = requests.join(X.table(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select(
        "request_key", F.lit("cached").alias("value")).distinct()

    def answer(rows):
        bodies = F.when(F.startswith("body", F.lit("de:")), F.concat(F.lit("fail"), "body")).otherwise(F.col("body"))
        sent = D.dispatch(rows.withColumn("body", bodies), Echo)
        return workspace.materialize(sent, "answers").withColumnRenamed("answer", "value")

    return C.get_or_set(requests, known, "request_key", "value", ["body"], ["doc_id"], answer).select(
        "doc_id", "request_key", "value", "error", "attempts")


@query("dedup_requests", """SELECT sha256(text) AS request_key, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, count(*) AS copies
  FROM documents GROUP BY text""")
def dedup_requests(spark, sf):
    rows = X.table(spark, sf, "documents").select(F.sha2("text", 256).alias("request_key"), "doc_id", "lang")
    return C.dedup_requests(rows, "request_key", ["doc_id"])


@query("join_config", f"""WITH {X.CONFIGS} SELECT o_orderkey, o_custkey, api, c_nationkey FROM orders
  LEFT JOIN configs ON o_custkey = c_custkey""")
def join_config(spark, sf):
    orders = X.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    config = X.configs(spark, sf).select(F.col("c_custkey").alias("o_custkey"), "api", "c_nationkey")
    return G.join_config(orders, config, "o_custkey", ["o_orderkey"])


@query("resolve_provider", """SELECT c_custkey, c_nationkey::VARCHAR AS provider, coalesce(n_name, 'openai') AS adapter FROM customer
  LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey""")
def resolve_provider(spark, sf):
    rows = X.table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("provider"))
    registry = X.table(spark, sf, "nation").where("n_regionkey < 3").select(
        F.col("n_nationkey").cast("string").alias("provider"), F.col("n_name").alias("adapter"))
    return T.resolve_provider(rows, registry, "provider", "adapter", F.lit("openai"), ["c_custkey"])


@query("task_status_join", f"""WITH {X.TASKS} SELECT c_custkey, coalesce(o.status, 'pending') AS status,
    CASE WHEN c_custkey % 2 = 0 THEN c_name WHEN c_custkey % 3 <> 0 THEN 'from config' ELSE 'unknown' END AS task_name
  FROM customer LEFT JOIN (SELECT o_custkey, CASE max(o_orderstatus) WHEN 'F' THEN 'success' WHEN 'O' THEN 'running' END AS status
    FROM tasks WHERE o_custkey % 4 <> 0 GROUP BY o_custkey) o ON o_custkey = c_custkey""")
def task_status_join(spark, sf):
    customers = X.table(spark, sf, "customer")
    rows = customers.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("task_name"))
    names = customers.where("c_custkey % 3 <> 0").select("c_custkey", F.lit("from config").alias("config_task_name"))
    last = F.max("o_orderstatus")
    status = F.when(last == "F", "success").when(last == "O", "running").otherwise("odd")
    statuses = X.table(spark, sf, "orders").where("o_custkey % 4 <> 0").groupBy(F.col("o_custkey").alias("c_custkey")).agg(status.alias("status"))
    return T.task_status_join(rows, statuses, names, "c_custkey")


# --- batches -------------------------------------------------------------------------------------

@query("count_items", "SELECT source AS file, count(*) AS items FROM documents GROUP BY source")
def count_items(spark, sf):
    return B.count_items(X.table(spark, sf, "documents").withColumnRenamed("source", "file"))


@query("batch_manifest", """SELECT source AS file, count(*) AS items, (count(*) + 19) // 20 AS batches,
    count(*) - ((count(*) + 19) // 20 - 1) * 20 AS last_size FROM documents GROUP BY source""")
def batch_manifest(spark, sf):
    return B.batch_manifest(X.table(spark, sf, "documents").withColumnRenamed("source", "file"), 20)


@query("split_batches", f"""WITH {X.PROMPTS} SELECT doc_id, file, idx, idx // 20 AS batch_no,
    'batch_' || lpad((idx // 20)::VARCHAR, 4, '0') AS batch_id FROM prompts""")
def split_batches(spark, sf):
    return B.split_batches(X.prompts(spark, sf).select("doc_id", "file", "idx"), 20)


@query("number_in_batch", f"""WITH {X.PROMPTS} SELECT doc_id, file, idx, idx % 20 AS idx_in_batch, 'request_' || (idx % 20) AS custom_id FROM prompts""")
def number_in_batch(spark, sf):
    return B.number_in_batch(X.prompts(spark, sf).select("doc_id", "file", "idx"), 20)


COMBINED = """kept AS (SELECT file, idx // 20 AS batch_no, idx % 20 AS idx_in_batch, target_lang AS content FROM prompts WHERE doc_id % 10 <> 3)"""


@query("combine_batches", f"""WITH {X.PROMPTS}, {COMBINED} SELECT *,
    row_number() OVER (PARTITION BY file ORDER BY batch_no, idx_in_batch) - 1 AS position FROM kept""")
def combine_batches(spark, sf):
    rows = _requests(spark, sf).where("doc_id % 10 <> 3")
    return B.combine_batches(rows.select("file", "batch_no", "idx_in_batch", F.col("target_lang").alias("content")))


@query("union_results", f"""SELECT doc_id, lang AS content, NULL::VARCHAR AS error FROM documents WHERE doc_id % 10 <> 3
  UNION ALL SELECT doc_id, NULL, 'refused' FROM documents WHERE doc_id % 10 = 3""")
def union_results(spark, sf):
    docs = X.table(spark, sf, "documents")
    good = docs.where("doc_id % 10 <> 3").select("doc_id", F.col("lang").alias("content"))
    bad = docs.where("doc_id % 10 = 3").select("doc_id", F.lit("refused").alias("error"))
    return B.union_results(good, bad)


@query("merge_by_name", """SELECT lang || '_' || source AS name, max(doc_id) AS doc_id, arg_max(n_chars, doc_id) AS n_chars FROM documents GROUP BY 1""")
def merge_by_name(spark, sf):
    rows = X.table(spark, sf, "documents").select(F.concat_ws("_", "lang", "source").alias("name"), "doc_id", "n_chars")
    return B.merge_by_name(rows, "name", ["doc_id"])


@query("result_summary", """SELECT source AS file, count(*) FILTER (lang <> 'de') AS success, count(*) FILTER (lang = 'de') AS failed
  FROM documents GROUP BY source""")
def result_summary(spark, sf):
    rows = X.table(spark, sf, "documents").select(F.col("source").alias("file"), F.when(F.col("lang") == "de", "refused").alias("error"))
    return B.result_summary(rows)


# --- cache tables --------------------------------------------------------------------------------

@query("cache_stats", "SELECT count(*) AS total_items, count(DISTINCT source) AS services FROM documents")
def cache_stats(spark, sf):
    rows = X.table(spark, sf, "documents").select(K.cache_key_service(F.col("source"), F.col("doc_id").cast("string")).alias("k"))
    return C.cache_stats(rows, "k")


@query("cache_hit_stats", """SELECT event_type, count(*) - count(DISTINCT user_id) AS hits, count(DISTINCT user_id) AS misses,
    count(DISTINCT user_id) AS size FROM events GROUP BY event_type""")
def cache_hit_stats(spark, sf):
    return C.cache_hit_stats(X.table(spark, sf, "events"), ["event_type"], "user_id")


@query("cache_upsert", f"""WITH {X.EVENTS} SELECT job_id, status, arg_max(value, us) AS value, max(us) AS us FROM ev GROUP BY job_id, status""")
def cache_upsert(spark, sf):
    return C.cache_upsert(X.events(spark, sf).select("job_id", "status", "value", "us"), ["job_id", "status"], ["us"])


def _with_ttl(spark, sf):
    rows = X.events(spark, sf).select("event_id", "job_id", "status", "us")
    return C.ttl_hits(rows, ["job_id", "status"], ["us", "event_id"], "us", 86_400)


TTL = """hits AS (SELECT event_id, job_id, status, us, coalesce(us - lag(us) OVER (PARTITION BY job_id, status ORDER BY us, event_id)
  <= 86400000000, false) AS hit FROM ev)"""


@query("ttl_hits", f"WITH {X.EVENTS}, {TTL} SELECT * FROM hits")
def ttl_hits(spark, sf):
    return _with_ttl(spark, sf)


@query("running_hits", f"""WITH {X.EVENTS}, {TTL} SELECT event_id, status,
    sum(hit::INT) OVER w AS hits, sum((NOT hit)::INT) OVER w AS misses FROM hits
  WINDOW w AS (PARTITION BY status ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)""")
def running_hits(spark, sf):
    return C.running_hits(_with_ttl(spark, sf), ["status"], ["us", "event_id"], "hit").select(
        "event_id", "status", "hits", "misses")


@query("load_cache", f"""WITH {X.EVENTS} SELECT status AS service, job_id::VARCHAR AS cache_key, arg_max(event_id, us)::VARCHAR AS value
  FROM ev GROUP BY status, job_id""")
def load_cache(spark, sf):
    path = workspace.new_path(spark, "cache")
    writes = X.events(spark, sf).select(F.col("status").alias("service"), F.col("job_id").cast("string").alias("cache_key"),
                                        F.col("event_id").cast("string").alias("value"), "ts")
    C.flush_cache(writes.where("event_id % 2 = 0"), path)
    C.flush_cache(writes.where("event_id % 2 = 1"), path)
    return C.load_cache(spark, path).drop("ts")


@query("flush_cache", """SELECT event_type AS service, user_id::VARCHAR AS cache_key, count(*) AS writes FROM events GROUP BY ALL""")
def flush_cache(spark, sf):
    path = workspace.new_path(spark, "cache")
    C.flush_cache(X.events(spark, sf).select(F.col("status").alias("service"), F.col("job_id").cast("string").alias("cache_key"),
                                             F.col("event_id").cast("string").alias("value"), "ts"), path)
    return spark.read.parquet(path).groupBy("service", "cache_key").agg(F.count("*").alias("writes"))

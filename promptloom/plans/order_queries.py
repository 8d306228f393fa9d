"""Ordered work: similarity windows, status sequences, circuit states, sampling."""
from __future__ import annotations

from pyspark.sql import functions as F

from promptloom.functions import times as T
from promptloom.functions import variants as V
from promptloom.functions.similarity import SIGNATURE_PRIME, signature_steps
from promptloom.operators import circuit as R
from promptloom.operators import config as G
from promptloom.operators import sampling as A
from promptloom.operators import similarity as M
from promptloom.operators import status as S
from promptloom.operators import tasks as K
from promptloom.plans import fixtures as X
from promptloom.plans.registry import query
from promptloom.sources import workspace

# Responses are ordered by a number with gaps; the operators count the rows of a task themselves.
GAPPY = """gappy AS (SELECT lang AS task, doc_id, 7 * doc_id + doc_id % 5 AS seq, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents)"""
WORDS = f"{GAPPY}, words AS (SELECT task, seq, n, {X.TOKENS.format('text')} AS w FROM gappy)"
NEAR = """near AS (SELECT a.task, a.seq, b.seq AS prev_seq, CASE WHEN len(a.w) + len(b.w) = 0 THEN 1.0 ELSE
    len(list_intersect(a.w, b.w))::DOUBLE / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) END AS score
  FROM words a JOIN words b ON a.task = b.task AND b.n BETWEEN a.n - 10 AND a.n - 1)"""


def gappy(spark, sf):
    """Documents as past responses of their language, in the order of a number with gaps."""
    number = 7 * F.col("doc_id") + F.col("doc_id") % 5
    return X.table(spark, sf, "documents").select(F.col("lang").alias("task"), "doc_id", number.alias("seq"), "text")


@query("similar_recent", f"""WITH {WORDS}, {NEAR} SELECT task, seq, prev_seq, round(score, 6) AS score FROM near""")
def similar_recent(spark, sf):
    rows = gappy(spark, sf).select("task", "seq", "text")
    return M.similar_recent(rows, "task", "seq", "text", 10).withColumn("score", F.round("score", 6))


FLAGGED = f"""{WORDS}, {NEAR}, flagged AS (SELECT h.task, h.seq, h.doc_id, round(coalesce(m, 0), 6) AS max_score,
    coalesce(m, 0) >= 0.8 AS is_similar FROM gappy h LEFT JOIN (SELECT task, seq, max(score) AS m FROM near GROUP BY task, seq) USING (task, seq))"""


@query("similarity_flag", f"WITH {FLAGGED} SELECT * FROM flagged")
def similarity_flag(spark, sf):
    rows = M.similarity_flag(gappy(spark, sf), "task", "seq", "text", 10, 0.8)
    return rows.withColumn("max_score", F.round("max_score", 6))


# Times with ties (eight rows a tick) and gaps between ticks.
@query("similar_cooldown", f"""WITH {FLAGGED}, timed AS (SELECT task, seq, is_similar AND max_score > 0 AS caused, (doc_id // 8 * 45 + doc_id // 100 * 600) * 1000000 AS us FROM flagged),
  last AS (SELECT *, last_value(CASE WHEN caused THEN us END IGNORE NULLS) OVER (PARTITION BY task ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS since FROM timed)
  SELECT task, seq, us, CASE WHEN since IS NULL THEN 0 ELSE floor(greatest(0, 300 - (us - since) / 1e6))::BIGINT END AS remaining,
    coalesce(us - since < 300000000, false) AS should_wait FROM last""")
def similar_cooldown(spark, sf):
    flagged = M.similarity_flag(gappy(spark, sf), "task", "seq", "text", 10, 0.8)
    ticks = F.floor(F.col("doc_id") / 8) * 45 + F.floor(F.col("doc_id") / 100) * 600
    timed = flagged.select("task", "seq", "max_score", "is_similar", (ticks * 1_000_000).alias("us"))
    return M.similar_cooldown(timed, "task", ["us", "seq"], "us", 300).select("task", "seq", "us", "remaining", "should_wait")


@query("sim_jaccard", f"""WITH {WORDS}, {NEAR} SELECT task, seq, prev_seq, round(score, 6) AS score FROM near WHERE score >= 0.5""")
def sim_jaccard(spark, sf):
    rows = gappy(spark, sf).select("task", "seq", "text")
    return M.similar_recent(rows, "task", "seq", "text", 10, at_least=0.5).withColumn("score", F.round("score", 6))


# The check's function counts bytes: each letter of more than one gets a sign of its own.
@query("sim_levenshtein", """WITH r AS (SELECT conv_id // 8 AS task, conv_id * 1000 + turn AS seq, translate(text, 'ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü', '#$%&*+/<=>@[]^_`{|}~;') AS t,
    row_number() OVER (PARTITION BY conv_id // 8 ORDER BY conv_id, turn) AS n FROM conversations WHERE role = 'assistant')
  SELECT a.task, a.seq, b.seq AS prev_seq, round(1 - levenshtein(a.t, b.t)::DOUBLE / greatest(length(a.t), length(b.t)), 6) AS score
  FROM r a JOIN r b ON a.task = b.task AND b.n BETWEEN a.n - 3 AND a.n - 1""")
def sim_levenshtein(spark, sf):
    answers = X.table(spark, sf, "conversations").where("role = 'assistant'").select(
        F.floor(F.col("conv_id") / 8).alias("task"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "text")
    return M.similar_recent(answers, "task", "seq", "text", 3, "levenshtein").withColumn("score", F.round("score", 6))


_STEPS = "[" + ", ".join(f"{{'a': {a}::BIGINT, 'b': {b}::BIGINT}}" for a, b in signature_steps()) + "]"


@query("sim_minhash", f"""WITH {WORDS},
  hashed AS (SELECT task, seq, n, list_transform(w, lambda t: ('0x' || substr(md5(t), 1, 7))::BIGINT) AS h FROM words),
  signed AS (SELECT task, seq, n, list_transform({_STEPS}, lambda s: list_min(list_transform(h, lambda x: (x * s.a + s.b) % {SIGNATURE_PRIME}))) AS g FROM hashed)
  SELECT a.task, a.seq, b.seq AS prev_seq, len(list_filter(range(1, len(a.g) + 1), lambda i: a.g[i] IS NOT DISTINCT FROM b.g[i])) / len(a.g)::DOUBLE AS score
  FROM signed a JOIN signed b ON a.task = b.task AND b.n BETWEEN a.n - 10 AND a.n - 1""")
def sim_minhash(spark, sf):
    rows = gappy(spark, sf).select("task", "seq", "text")
    return M.similar_recent(rows, "task", "seq", "text", 10, "minhash")


@query("sim_cosine", """WITH e AS (SELECT label AS task, embedding::DOUBLE[] AS v, vec_id AS seq,
    row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings)
  SELECT a.task, a.seq, b.seq AS prev_seq, round(list_cosine_similarity(a.v, b.v), 4) + 0::DOUBLE AS score
  FROM e a JOIN e b ON a.task = b.task AND b.n BETWEEN a.n - 5 AND a.n - 1""")
def sim_cosine(spark, sf):
    rows = X.table(spark, sf, "embeddings").select(F.col("label").alias("task"), F.col("vec_id").alias("seq"), "embedding")
    return M.similar_recent(rows, "task", "seq", "embedding", 5, "cosine").withColumn("score", F.round("score", 4) + 0.0)


@query("trim_history", f"WITH {X.HISTORY} SELECT task, seq, doc_id FROM history h WHERE seq >= (SELECT max(seq) FROM history g WHERE g.task = h.task) - 24")
def trim_history(spark, sf):
    return M.trim_history(X.history(spark, sf).select("task", "seq", "doc_id"), "task", "seq", 25)


@query("load_history", "SELECT lang AS task, count(*) AS responses, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang")
def load_history(spark, sf):
    return _stored_history(spark, sf).groupBy("task").agg(F.count("*").alias("responses"), F.sum(F.length("text")).alias("chars"))


@query("save_history", f"WITH {X.HISTORY} SELECT task, seq, d.text FROM history JOIN documents d USING (doc_id)")
def save_history(spark, sf):
    return _stored_history(spark, sf).select("task", "seq", "text")


def _stored_history(spark, sf):
    path = workspace.new_path(spark, "history")
    rows = X.history(spark, sf).select("task", "seq", "text",
                                       F.timestamp_add("SECOND", F.col("doc_id"), F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'")).alias("ts"))
    M.save_history(rows, path)
    return M.load_history(spark, path)


@query("status_changes", f"""WITH {X.EVENTS}, p AS (SELECT event_id, job_id, us, status, lag(status) OVER w AS previous_status,
    row_number() OVER w AS n FROM ev WINDOW w AS (PARTITION BY job_id ORDER BY us, event_id))
  SELECT event_id, job_id, us, status, previous_status FROM p WHERE n = 1 OR status IS DISTINCT FROM previous_status""")
def status_changes(spark, sf):
    return S.status_changes(X.events(spark, sf).select("event_id", "job_id", "us", "status"), "job_id", ["us", "event_id"], "status")


@query("cooldown_remaining", f"""WITH {X.EVENTS}, p AS (SELECT event_id, job_id, us, lag(us) OVER (PARTITION BY job_id ORDER BY us, event_id) AS prev FROM ev)
  SELECT event_id, job_id, us, CASE WHEN prev IS NULL THEN 0 ELSE floor(greatest(0, 20000 - (us - prev) / 1e6))::BIGINT END AS remaining,
    coalesce(us - prev < 20000000000, false) AS should_wait FROM p""")
def cooldown_remaining(spark, sf):
    rows = X.events(spark, sf).select("event_id", "job_id", "us")
    return M.cooldown_remaining(rows, ["job_id"], ["us", "event_id"], "us", 20_000)


CIRCUIT_SQL = f"""WITH RECURSIVE {X.EVENTS}, calls AS (SELECT job_id, event_id, us, status <> 'error' AS ok,
    row_number() OVER (PARTITION BY job_id ORDER BY us, event_id) AS n FROM ev),
  run AS (
    SELECT job_id, event_id, n, CASE WHEN ok THEN 0 ELSE 1 END AS f, NULL::BIGINT AS opened,
      CASE WHEN ok THEN 'success' ELSE 'failure' END AS outcome FROM calls WHERE n = 1
    UNION ALL
    SELECT c.job_id, c.event_id, c.n,
      CASE WHEN r.opened IS NOT NULL AND c.us - r.opened < 86400000000 THEN r.f WHEN c.ok THEN 0 ELSE least(r.f + 1, 2) END,
      CASE WHEN r.opened IS NOT NULL AND c.us - r.opened < 86400000000 THEN r.opened WHEN c.ok THEN NULL WHEN r.f + 1 >= 2 THEN c.us END,
      CASE WHEN r.opened IS NOT NULL AND c.us - r.opened < 86400000000 THEN 'rejected' WHEN c.ok THEN 'success' ELSE 'failure' END
    FROM run r JOIN calls c ON c.job_id = r.job_id AND c.n = r.n + 1)
  SELECT job_id::VARCHAR AS provider, event_id AS call_id, outcome, opened IS NOT NULL AS is_open FROM run"""


@query("circuit_state", CIRCUIT_SQL)
def circuit_state(spark, sf):
    calls = X.events(spark, sf).select("event_id", "job_id", "us", (F.col("status") != "error").alias("ok"))
    return R.circuit_state(calls, "job_id", "event_id", "us", "ok", max_failures=2, reset_seconds=86_400)


# --- status summaries ----------------------------------------------------------------------------

@query("distinct_statuses", "SELECT DISTINCT event_type AS status FROM events")
def distinct_statuses(spark, sf):
    return S.distinct_statuses(X.events(spark, sf), "status")


def _progress(spark, sf):
    return S.batch_progress(X.table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "job_id"), "job_id", F.col("l_linestatus") == "F")


PROGRESS = """p AS (SELECT l_orderkey AS job_id, count(*) FILTER (l_linestatus = 'F') AS done, count(*) AS total FROM lineitem GROUP BY l_orderkey)"""


@query("batch_progress", f"WITH {PROGRESS} SELECT job_id, done, total, (100 * done // total) || '%' AS progress FROM p")
def batch_progress(spark, sf):
    return _progress(spark, sf)


@query("percent_text", f"WITH {PROGRESS} SELECT job_id, (100 * done // CASE WHEN total <= 2 THEN 1 ELSE total END) || '%' AS percent FROM p")
def percent_text(spark, sf):
    total = F.when(F.col("total") == 1, F.lit(0)).when(F.col("total") > 2, F.col("total"))
    return _progress(spark, sf).select("job_id", T.percent_text(F.col("done"), total).alias("percent"))


@query("batch_eta", f"""WITH {PROGRESS}, s AS (SELECT job_id, done, total, floor(7200 * (total - done) / nullif(done, 0))::BIGINT AS t FROM p)
  SELECT job_id, done, total, CASE WHEN done > 0 AND done < total THEN
    CASE WHEN t >= 172800 THEN (t // 86400) || ' days, ' WHEN t >= 86400 THEN '1 day, ' ELSE '' END ||
    ((t % 86400) // 3600) || ':' || lpad(((t % 3600) // 60)::VARCHAR, 2, '0') || ':' || lpad((t % 60)::VARCHAR, 2, '0') ELSE 'n/a' END AS eta FROM s""")
def batch_eta(spark, sf):
    rows = _progress(spark, sf).select("job_id", "done", "total", F.expr("TIMESTAMP_NTZ'2024-01-01 10:00:00'").alias("created_at"))
    return S.batch_eta(rows, "created_at", F.expr("TIMESTAMP_NTZ'2024-01-01 12:00:00'")).drop("created_at")


@query("job_duration", f"WITH {X.EVENTS} SELECT job_id, (max(us) - min(us)) / 1e6 AS seconds FROM ev GROUP BY job_id")
def job_duration(spark, sf):
    return S.job_duration(X.events(spark, sf), "job_id", "us")


@query("rollup_status", """SELECT l_orderkey AS task, CASE WHEN bool_and(l_returnflag <> 'R') THEN 'success' ELSE 'failed' END AS status,
    count(*) AS parts FROM lineitem GROUP BY l_orderkey""")
def rollup_status(spark, sf):
    rows = X.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("task"), (F.col("l_returnflag") != "R").alias("ok"))
    return S.rollup_status(rows, "task", F.col("ok"))


# --- samples -------------------------------------------------------------------------------------

@query("sample_head", f"WITH {X.PROMPTS} SELECT file, idx, doc_id FROM prompts WHERE idx < 5")
def sample_head(spark, sf):
    return A.sample_head(X.prompts(spark, sf).select("file", "idx", "doc_id"), 5)


@query("sample_records", """SELECT source AS file, doc_id AS key FROM documents
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('seed' || doc_id) DESC, doc_id DESC) <= 30""")
def sample_records(spark, sf):
    return A.sample_records(X.table(spark, sf, "documents").select(F.col("source").alias("file"), F.col("doc_id").alias("key")), 30, "seed")


# Every source is a task of its own, whose config says whether and how much to sample.
@query("sample_by_config", """WITH t AS (SELECT DISTINCT source AS file, length(source) + ascii(substr(source, length(source), 1)) AS k FROM documents),
  c AS (SELECT file, CASE WHEN k % 4 = 0 THEN NULL ELSE k % 7 * 5 END AS n FROM t)
  SELECT d.source AS file, d.doc_id AS key FROM documents d JOIN c ON c.file = d.source
  QUALIFY n IS NULL OR n = 0 OR row_number() OVER (PARTITION BY d.source ORDER BY md5('seed' || d.doc_id) DESC, d.doc_id DESC) <= n""")
def sample_by_config(spark, sf):
    rows = X.table(spark, sf, "documents").select(F.col("source").alias("file"), F.col("doc_id").alias("key"))
    k = F.length("file") + F.ascii(F.substring("file", -1, 1))
    text = F.concat(F.lit('{"general":{"sampling":{"enable_sampling":'), F.when(k % 4 == 0, F.lit("false")).otherwise(F.lit("true")),
                    F.lit(',"sample_size":'), (k % 7 * 5).cast("string"), F.lit("}}}"))
    sizes = rows.select("file").distinct().withColumn("config", V.parse(text)).select("file", G.sample_size(F.col("config")).alias("n"))
    return A.sample_records(G.join_config(rows, sizes, "file", ["key"]), F.col("n"), "seed").drop("n")


@query("sample_files", """SELECT source AS file, doc_id FROM documents WHERE source IN
  (SELECT source FROM (SELECT DISTINCT source FROM documents) ORDER BY md5('seed' || source) DESC, source DESC LIMIT 6)""")
def sample_files(spark, sf):
    return A.sample_files(X.table(spark, sf, "documents").select(F.col("source").alias("file"), "doc_id"), 6, "seed")


# --- task order ----------------------------------------------------------------------------------

@query("number_tasks", f"WITH {X.TASKS} SELECT user_id, folder, row_number() OVER (PARTITION BY user_id ORDER BY folder) AS number FROM tasks")
def number_tasks(spark, sf):
    return K.number_tasks(X.tasks(spark, sf).select("user_id", "folder"), "user_id", ["folder"])


@query("pick_task", f"""WITH {X.TASKS} SELECT user_id, folder, number FROM (SELECT user_id, folder,
    row_number() OVER (PARTITION BY user_id ORDER BY folder) AS number FROM tasks) WHERE number = 3""")
def pick_task(spark, sf):
    return K.pick_task(number_tasks(spark, sf), F.lit(3))


@query("latest_task", f"WITH {X.TASKS} SELECT user_id, api_name, arg_max(folder, (created_at, folder)) AS folder FROM tasks GROUP BY user_id, api_name")
def latest_task(spark, sf):
    rows = X.tasks(spark, sf).select("user_id", "api_name", "folder", "created_at")
    return K.latest_task(rows, ["user_id", "api_name"], ["created_at", "folder"]).drop("created_at")


@query("sort_tasks", f"WITH {X.TASKS} SELECT user_id, folder FROM tasks ORDER BY folder DESC")
def sort_tasks(spark, sf):
    return K.sort_tasks(X.tasks(spark, sf).select("user_id", "folder"), ["folder"], newest_first=True)


@query("tasks_by_user", f"""WITH {X.TASKS} SELECT user_id, count(*) AS tasks, epoch_us(min(created_at)) AS first_us, epoch_us(max(created_at)) AS last_us
  FROM tasks GROUP BY user_id""")
def tasks_by_user(spark, sf):
    return K.tasks_by_user(X.tasks(spark, sf), "user_id", "created_at").select(
        "user_id", "tasks", T.epoch_micros(F.col("first_created")).alias("first_us"), T.epoch_micros(F.col("last_created")).alias("last_us"))

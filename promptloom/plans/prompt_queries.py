"""Projections and filters over prompts and answers."""
from __future__ import annotations

from pyspark.sql import functions as F

from promptloom.functions import variants as V
from promptloom.operators import batches as B
from promptloom.operators import prompts as P
from promptloom.operators import responses as R
from promptloom.operators import status as S
from promptloom.plans import fixtures as X
from promptloom.plans.registry import query

DIRECT = """'{"input_text":' || to_json(text)::VARCHAR || ',"instructions":"Reply in ' || lang || '"}'"""


@query("conversation_triples", f"""WITH {X.PAIRS}
, systems AS (SELECT conv_id, arg_min(text, turn) AS system FROM conversations WHERE role = 'system' GROUP BY conv_id)
  SELECT r.conv_id, r.turn, coalesce(nullif(s.system, ''), 'You are a helpful assistant') AS system,
    coalesce(u."user", 'Error: Input data not found') AS "user", r.assistant
  FROM replies r LEFT JOIN users u USING (conv_id, turn) LEFT JOIN systems s USING (conv_id)""")
def conversation_triples(spark, sf):
    """A conversation's own system turn, each user turn and the content taken out of the provider's answer."""
    users, replies = X.pairs(spark, sf)
    answer = F.to_variant_object(F.struct(F.array(F.struct(F.struct(F.col("assistant").alias("content")).alias("message"))).alias("choices")))
    systems = X.table(spark, sf, "conversations").where(F.col("role") == "system").groupBy("conv_id").agg(F.min_by("text", "turn").alias("own_system"))
    aligned = R.align_left(replies.withColumn("answer", answer), users, ["conv_id", "turn"], "user").join(systems, "conv_id", "left")
    return R.triples(aligned, P.select_system(F.col("own_system"), True), F.col("user"),
                     R.extract_content(F.col("answer")), ["conv_id", "turn"])


@query("normalize_prompt", f"""SELECT doc_id, CASE doc_id % 7
    WHEN 4 THEN '' WHEN 5 THEN '[]' WHEN 1 THEN '[' || {DIRECT} || ',5]' ELSE text END AS prompt
  FROM documents""")
def normalize_prompt(spark, sf):
    return X.items(spark, sf).select("doc_id", P.normalize_prompt(F.col("item"), "input_text").alias("prompt"))


@query("find_prompt", """SELECT doc_id,
    CASE WHEN doc_id % 7 IN (0, 1, 6) THEN text END AS "user",
    CASE WHEN doc_id % 7 IN (0, 1) THEN 'Reply in ' || lang WHEN doc_id % 7 = 6 THEN 'You are a helpful assistant' END AS system,
    CASE WHEN doc_id % 7 = 5 THEN 'Empty prompts list' WHEN doc_id % 7 IN (2, 3, 4)
      THEN 'Required prompt field ''input_text'' not found in input' END AS error
  FROM documents""")
def find_prompt(spark, sf):
    found = P.find_prompt(F.col("item"), "input_text", "instructions", True)
    return X.items(spark, sf).select("doc_id", found.alias("f")).select("doc_id", "f.*")


@query("find_text", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 3 = 1 THEN text END AS text,
    CASE WHEN doc_id % 3 = 2 THEN 'Required ''text'' field not found in input' END AS error FROM documents""")
def find_text(spark, sf):
    docs = X.table(spark, sf, "documents").select("doc_id", "text")
    flat = F.to_json(F.struct("text"))
    line = (F.when(F.col("doc_id") % 3 == 0, flat)
            .when(F.col("doc_id") % 3 == 1, F.concat(F.lit('{"prompts":['), flat, F.lit("]}")))
            .otherwise(F.lit('{"text":null}')))
    return docs.select("doc_id", P.find_text(V.parse(line)).alias("f")).select("doc_id", "f.*")


@query("select_system", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 <> 0 THEN 'Reply in ' || lang
    ELSE 'You are a helpful assistant' END AS system FROM documents""")
def select_system(spark, sf):
    docs = X.table(spark, sf, "documents").select("doc_id", "lang")
    own = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("Reply in "), "lang"))
    return docs.select("doc_id", P.select_system(own, F.col("doc_id") % 2 == 0).alias("system"))


def chat_body(user, system):
    return P.build_chat_body(user, system, F.lit("gpt-4o"), F.lit(0.7), F.lit(2000))


CHAT = """{'model': 'gpt-4o', 'messages': [{'role': 'system', 'content': instructions},
  {'role': 'user', 'content': input_text}], 'temperature': 0.7::DOUBLE, 'max_tokens': 2000}"""


@query("build_chat_body", f"""WITH {X.PROMPTS} SELECT doc_id, to_json({CHAT})::VARCHAR AS body,
    sha256(to_json({CHAT})::VARCHAR) AS body_hash FROM prompts""")
def build_chat_body(spark, sf):
    body = F.to_json(chat_body(F.col("input_text"), F.col("instructions")))
    docs = X.table(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("input_text"), F.concat(F.lit("Reply in "), "lang").alias("instructions"))
    return docs.select("doc_id", body.alias("body")).withColumn("body_hash", F.sha2("body", 256))


@query("build_translate_body", """SELECT doc_id, text, CASE WHEN doc_id % 4 = 0 THEN 'EN-US' ELSE lang END AS target_lang,
    CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'de' END AS source_lang FROM documents""")
def build_translate_body(spark, sf):
    target = F.when(F.col("doc_id") % 4 != 0, F.col("lang"))
    source = F.when(F.col("doc_id") % 5 != 0, F.lit("de"))
    body = P.build_translate_body(F.col("text"), target, source)
    return X.table(spark, sf, "documents").select("doc_id", body.alias("b")).select("doc_id", "b.*")


@query("build_translate_array_body", """SELECT doc_id,
    CASE WHEN doc_id % 6 = 0 OR doc_id % 5 = 0 THEN NULL ELSE text END AS text,
    CASE WHEN doc_id % 6 = 0 OR doc_id % 5 = 0 THEN NULL ELSE upper(lang) END AS target_lang,
    CASE WHEN doc_id % 6 = 0 OR doc_id % 5 = 0 THEN 'Missing translation text or target_lang' END AS error FROM documents""")
def build_translate_array_body(spark, sf):
    text = F.when(F.col("doc_id") % 6 == 0, F.lit("")).otherwise(F.col("text"))
    lang = F.when(F.col("doc_id") % 5 != 0, F.col("lang"))
    body = P.build_translate_array_body(text, lang)
    return X.table(spark, sf, "documents").select("doc_id", body.alias("b")).select(
        "doc_id", F.col("b.body.text")[0].alias("text"), F.col("b.body.target_lang").alias("target_lang"),
        F.col("b.error").alias("error"))


@query("build_batch_line", f"""WITH {X.PROMPTS} SELECT doc_id, 'batch_' || lpad((idx // 20)::VARCHAR, 4, '0') AS batch_id,
    to_json({{'custom_id': 'request_' || (idx % 20), 'method': 'POST', 'url': '/v1/chat/completions', 'body': {CHAT}}})::VARCHAR AS line
  FROM prompts""")
def build_batch_line(spark, sf):
    rows = B.number_in_batch(B.split_batches(X.prompts(spark, sf), 20), 20)
    line = B.build_batch_line(F.col("custom_id"), chat_body(F.col("input_text"), F.col("instructions")))
    return rows.select("doc_id", "batch_id", F.to_json(line).alias("line"))


@query("build_body", """SELECT doc_id, CASE lang WHEN 'en' THEN to_json({'model': 'gpt-4o', 'messages': [
      {'role': 'system', 'content': 'You are a helpful assistant'}, {'role': 'user', 'content': text}],
      'temperature': 0.7::DOUBLE, 'max_tokens': 2000})::VARCHAR
    WHEN 'de' THEN to_json({'text': text, 'target_lang': 'EN-US', 'source_lang': 'de'})::VARCHAR END AS body,
    CASE WHEN lang NOT IN ('en', 'de') THEN 'Unsupported service: ' || lang END AS error FROM documents""")
def build_body(spark, sf):
    service = F.when(F.col("lang") == "en", "openai").when(F.col("lang") == "de", "deepl").otherwise(F.col("lang"))
    chat = chat_body(F.col("text"), F.lit(P.DEFAULT_SYSTEM))
    translate = P.build_translate_body(F.col("text"), F.lit(None).cast("string"), F.col("lang"))
    return X.table(spark, sf, "documents").select("doc_id", P.build_body(service, chat, translate).alias("b")).select(
        "doc_id", "b.*")


ANSWER_TEXT = """CASE (conv_id + turn) % 6 WHEN 4 THEN text || chr(10) || 'end' WHEN 5 THEN NULL ELSE text END"""


@query("extract_content", f"""SELECT conv_id, turn, {ANSWER_TEXT} AS content
  FROM conversations WHERE role = 'assistant'""")
def extract_content(spark, sf):
    return X.answers(spark, sf).select("conv_id", "turn", R.extract_content(F.col("item")).alias("content"))


@query("mark_errors", f"""SELECT conv_id, turn, {ANSWER_TEXT} AS content,
    CASE WHEN (conv_id + turn) % 6 = 5 THEN 'Error formatting response' END AS error
  FROM conversations WHERE role = 'assistant'""")
def mark_errors(spark, sf):
    return R.mark_errors(extract_content(spark, sf), "content")


@query("extract_translation", """SELECT doc_id, text AS translated_text,
    CASE WHEN doc_id % 3 = 2 THEN NULL ELSE lang END AS detected_source_lang FROM documents""")
def extract_translation(spark, sf):
    docs = X.table(spark, sf, "documents")
    own = F.to_json(F.struct(F.col("text").alias("translated_text"), F.col("lang").alias("detected_source_lang")))
    provider = F.to_json(F.struct(F.array(F.struct("text", F.col("lang").alias("detected_source_language"))).alias("translations")))
    bare = F.to_json(F.struct(F.array(F.struct("text")).alias("translations")))
    line = F.when(F.col("doc_id") % 3 == 0, own).when(F.col("doc_id") % 3 == 1, provider).otherwise(bare)
    return docs.select("doc_id", R.extract_translation(V.parse(line)).alias("t")).select("doc_id", "t.*")


@query("normalize_response", """SELECT conv_id, turn, text AS content FROM conversations WHERE role = 'assistant'""")
def normalize_response(spark, sf):
    rows = X.table(spark, sf, "conversations").where(F.col("role") == "assistant")
    wrapped = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices")))
    raw = F.when(F.col("turn") % 4 == 1, wrapped).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", V.get(R.normalize_response(raw), "$.choices[0].message.content").alias("content"))


@query("is_batch_failure", """SELECT event_id, event_type = 'error' AS failed FROM events""")
def is_batch_failure(spark, sf):
    text = F.concat(F.when(F.col("status") == "error", F.lit("Batch job failed with status: ")).otherwise(F.lit("Batch job ")), F.col("status"))
    return X.events(spark, sf).select("event_id", R.is_batch_failure(text).alias("failed"))


@query("is_terminal", """SELECT event_id, event_type IN ('purchase', 'error') AS terminal FROM events""")
def is_terminal(spark, sf):
    status = F.when(F.col("status") == "purchase", "completed").when(F.col("status") == "error", "failed").otherwise("in_progress")
    return X.events(spark, sf).select("event_id", S.is_terminal(status).alias("terminal"))


@query("filter_blank", """SELECT doc_id, text FROM documents WHERE doc_id % 3 = 0""")
def filter_blank(spark, sf):
    text = F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, F.lit(" \t "))
    rows = X.table(spark, sf, "documents").select("doc_id", text.alias("text"))
    return P.filter_blank(rows, "text")


def _prompt_lists(spark, sf):
    """Conversations' turns in small lists: a turn and its copy with a number between them."""
    rows = X.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    entry = F.to_json(F.struct(F.col("text").alias("input_text"), F.col("role").alias("instructions")))
    line = F.concat(F.lit('{"note":"n","prompts":['), entry, F.lit(',7,"x",'), entry, F.lit("]}"))
    return rows.select("conv_id", "turn", V.parse(line).alias("item"))


@query("flatten_prompts", """SELECT conv_id, turn, 'n' AS note, 2::BIGINT AS prompts, text AS second FROM conversations""")
def flatten_prompts(spark, sf):
    flat = _prompt_lists(spark, sf).withColumn("flat", P.flatten_prompts(F.col("item")))
    kept = V.as_array(V.get(F.col("flat"), "$.prompts", "variant"))
    return flat.select("conv_id", "turn", V.get(F.col("flat"), "$.note").alias("note"),
                       F.size(kept).cast("bigint").alias("prompts"),
                       V.get(F.col("flat"), "$.prompts[1].input_text").alias("second"))


@query("explode_prompts", """SELECT conv_id, turn, i::BIGINT AS prompt_idx, text AS "user", role AS system
  FROM conversations, (SELECT unnest([0, 1]) AS i)""")
def explode_prompts(spark, sf):
    rows = P.explode_prompts(_prompt_lists(spark, sf), "item", ["conv_id", "turn"])
    return rows.select("conv_id", "turn", F.col("prompt_idx").cast("bigint"),
                       V.get(F.col("prompt"), "$.input_text").alias("user"), V.get(F.col("prompt"), "$.instructions").alias("system"))


@query("drop_nulls", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '{"lang":"' || lang || '"}'
    ELSE '{"lang":"' || lang || '","source":"' || source || '"}' END AS record FROM documents""")
def drop_nulls(spark, sf):
    source = F.when(F.col("doc_id") % 2 == 1, F.col("source"))
    return X.table(spark, sf, "documents").select("doc_id", P.drop_nulls(F.struct("lang", source.alias("source"))).alias("record"))


@query("build_batch_job", f"""WITH {X.PROMPTS}, m AS (SELECT file, count(*) AS n FROM prompts GROUP BY file)
  SELECT file, 'batch_' || lpad(b::VARCHAR, 4, '0') AS batch_id, '/v1/chat/completions' AS endpoint, '24h' AS completion_window,
    'Batch processing for ' || file || ' batch_' || lpad(b::VARCHAR, 4, '0') AS description, least(20, n - b * 20)::BIGINT AS requests
  FROM (SELECT file, n, unnest(range(0, (n + 19) // 20)) AS b FROM m)""")
def build_batch_job(spark, sf):
    return B.build_batch_job(B.split_batches(X.prompts(spark, sf), 20))


@query("result_envelope", f"""WITH {X.PAIRS} SELECT conv_id, turn, "user" AS input, assistant AS response,
    epoch_us(TIMESTAMP '2024-01-01' + to_seconds(conv_id) + to_milliseconds(1500 * (turn + 1)))::BIGINT AS ts_us, 1.5 * (turn + 1) AS duration
  FROM users JOIN replies USING (conv_id, turn)""")
def result_envelope(spark, sf):
    from promptloom.functions import times as T
    users, replies = X.pairs(spark, sf)
    start = F.timestamp_add("SECOND", F.col("conv_id"), F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'"))
    end = F.timestamp_add("MILLISECOND", 1500 * (F.col("turn") + 1), start)
    rows = R.align_inner(users, replies, ["conv_id", "turn"])
    return rows.select("conv_id", "turn", R.result_envelope(F.col("user"), F.col("assistant"), start, end).alias("e")).select(
        "conv_id", "turn", "e.input", "e.response", T.epoch_micros(F.col("e.timestamp")).alias("ts_us"), "e.duration")

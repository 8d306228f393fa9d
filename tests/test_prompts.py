"""Record shapes: prompts and answers, one literal table per operator."""
import json
import random

import pytest
from pyspark.sql import functions as F

from promptloom.functions import names as N
from promptloom.functions import times as T
from promptloom.functions import variants as V
from promptloom.operators import config as G
from promptloom.operators import prompts as P
from promptloom.operators import responses as R


def evaluate(spark, texts, column):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, line string").withColumn("item", V.parse(F.col("line")))
    return [r["out"] for r in df.select("i", column.alias("out")).orderBy("i").collect()]


def test_normalize_prompt(spark):
    texts = ['"hi"', '{"input_text":"x","b":1}', '{"q":"hi"}', '{"a":1,"b":2}', "5", '{"input_text":""}', '{"input_text":7}',
             '{"input_text":"größe ✓"}', '{"input_text":null,"b":1}', "broken {", '["a",1]']
    assert evaluate(spark, texts, P.normalize_prompt(F.col("item"), "input_text")) == [
        "hi", "x", "hi", '{"a":1,"b":2}', "5", "", "7", "größe ✓", None, None, '["a",1]']


MISSING = "Required prompt field 'input_text' not found in input"


@pytest.mark.parametrize("line, expected", [
    ('{"input_text":"a","instructions":"s"}', ("a", "s", None)),
    ('{"input_text":"a"}', ("a", P.DEFAULT_SYSTEM, None)),
    ('{"input_text":"a","instructions":""}', ("a", P.DEFAULT_SYSTEM, None)),
    ('{"prompts":[{"input_text":"n","instructions":"t"},{"input_text":"m"}]}', ("n", "t", None)),
    ('{"prompts":[]}', (None, None, P.EMPTY_PROMPTS)),
    ('{"prompts":"none","input_text":"a"}', ("a", P.DEFAULT_SYSTEM, None)),
    ('{"prompts":[5]}', (None, None, MISSING)),
    ('{"input_text":""}', (None, None, MISSING)),
    ('{"input_text":null}', (None, None, MISSING)),
    ('{"input_text":0}', (None, None, MISSING)),
    ('{"input_text":"0"}', ("0", P.DEFAULT_SYSTEM, None)),
    ('{"input_text":12}', ("12", P.DEFAULT_SYSTEM, None)),
    ('"bare"', (None, None, MISSING)),
    ("broken", (None, None, MISSING)),
])
def test_find_prompt(spark, line, expected):
    out = evaluate(spark, [line], P.find_prompt(F.col("item"), "input_text", "instructions", True))[0]
    assert tuple(out) == expected


def test_static_system_ignores_the_row(spark):
    out = evaluate(spark, ['{"input_text":"a","instructions":"s"}'], P.find_prompt(F.col("item"), "input_text", "instructions", False))
    assert out[0]["system"] == P.DEFAULT_SYSTEM


def test_extract_content(spark):
    nested = {"response": {"body": {"choices": [{"message": {"content": "deep"}}]}}}
    texts = [json.dumps(nested), '{"choices":[{"message":{"content":"one"}}]}', '{"content":"flat"}', '"text"', '["a",2]',
             '{"x":1,"y":2}', '{"choices":[]}', "3", "not json"]
    assert evaluate(spark, texts, R.extract_content(F.col("item"))) == [
        "deep", "one", "flat", "text", "a\n2", '{"x":1,"y":2}', None, "3", None]


def test_parse_takes_exactly_one_value(spark):
    texts = ['{"a":1} tail', "3 apples", '{"a":1}\n{"b":2}', "1,2", "1],[2", " [1] ", "", '{"a":[1],"b":"],"}']
    assert evaluate(spark, texts, F.to_json("item")) == [None, None, None, None, None, "[1]", None, '{"a":[1],"b":"],"}']


def test_decode_batch_output(spark):
    line = '{"content":"%s"}'
    texts = [line % "a" + "\n\n" + line % "b", "[" + line % "a" + ",\n" + line % "b" + "]", '{\n"content":\n"c"}', line % "d" + "\n7 dwarfs"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, out string")
    decoded = R.decode_batch_output(df, "out", ["i"]).select("i", "line_no", R.extract_content(F.col("answer")).alias("c"))
    assert [tuple(r) for r in decoded.orderBy("i", "line_no").collect()] == [
        (0, 0, "a"), (0, 1, "b"), (1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (3, 0, "d"), (3, 1, "7 dwarfs")]


def test_flatten_keeps_fields(spark):
    out = evaluate(spark, ['{"k":null,"prompts":[{"a":1},2,"x",{"b":[]}]}', '{"prompts":"p"}', "4"], F.to_json(P.flatten_prompts(F.col("item"))))
    assert out == ['{"k":null,"prompts":[{"a":1},{"b":[]}]}', '{"prompts":"p"}', "4"]


def test_bodies(spark):
    df = spark.createDataFrame([("openai",), ("deepl",), ("other",), (None,)], "s string")
    chat = P.build_chat_body(F.lit("u"), F.lit("s"), F.lit("m"), F.lit(0.5), F.lit(9))
    move = P.build_translate_body(F.lit("t"), F.lit(None).cast("string"), F.lit("de"))
    out = [tuple(r["b"]) for r in df.select(P.build_body(F.col("s"), chat, move).alias("b")).collect()]
    assert json.loads(out[0][0])["messages"][1] == {"role": "user", "content": "u"}
    assert json.loads(out[1][0]) == {"text": "t", "target_lang": "EN-US", "source_lang": "de"}
    assert out[2] == (None, "Unsupported service: other") and out[3] == (None, "Unsupported service: null")


def test_leaf_paths(spark):
    df = spark.createDataFrame([(1, '{"a":{"task_name":"x","l":[{"task_name":"y"},3]},"e":{},"f":[],"n":null}')], "i int, t string")
    leaves = G.leaf_paths(df.select("i", V.parse(F.col("t")).alias("v")), "v", ["i"])
    assert {(r["path"], r["leaf"]) for r in leaves.collect()} == {("a_task_name", "x"), ("a_l_0_task_name", "y"), ("a_l_1", "3"), ("n", None)}
    only = G.leaf_paths(df.select("i", V.parse(F.col("t")).alias("v")), "v", ["i"], suffix="task_name")
    assert only.count() == 2


@pytest.mark.parametrize("large", [1 << 20, 0])
def test_batch_outputs_of_any_size_decode_alike(spark, large):
    """Texts above the limit are cut by their bytes; the answers are those of the small ones."""
    texts = ['[{"a":1},{"b":"x,]"}]', '{"a":1}\n{"b":2}\n\nnot json\r\n{"c":3}', '{"one":\n [1,2]}', "plain", "", '[1', '{"a":1}{"b":2}', "[]"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "i int, t string").repartition(2)
    out = R.decode_batch_output(df, "t", ["i"], large).select("i", "line_no", F.to_json("answer").alias("j")).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.i, r.line_no)):
        got.setdefault(r.i, []).append(json.loads(r.j))

    def wrapped(text):
        return json.loads(spark.range(1).select(F.to_json(F.to_variant_object(R._wrapped(F.lit(text))))).first()[0])
    assert got == {0: [{"a": 1}, {"b": "x,]"}], 1: [{"a": 1}, {"b": 2}, wrapped("not json"), {"c": 3}], 2: [{"one": [1, 2]}], 3: [wrapped("plain")], 5: [wrapped("[1")],
                   6: [wrapped('{"a":1}{"b":2}')]}


def plain_leaves(value, path=""):
    if isinstance(value, dict):
        return [leaf for k, v in value.items() for leaf in plain_leaves(v, f"{path}_{k}" if path else k)]
    if isinstance(value, list):
        return [leaf for i, v in enumerate(value) for leaf in plain_leaves(v, f"{path}_{i}")]
    return [(path, value if isinstance(value, str) or value is None else json.dumps(value))]


def tree(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.25:
        return rng.choice([1, "x", None, True, 'a "quoted" [text]', "", {}, []])
    if kind < 0.6:
        return {rng.choice("abcdefgh") + str(i): tree(rng, depth - 1) for i in range(rng.randrange(4))}
    return [tree(rng, depth - 1) for _ in range(rng.randrange(4))]


def test_leaf_paths_of_any_depth(spark):
    """Random trees, one of 200 levels, and values that are no trees."""
    rng = random.Random(2)
    values = [tree(rng, rng.randrange(7)) for _ in range(120)]
    deep = "end"
    for i in range(200):
        deep = {"k": deep, "s": i} if i % 2 else [deep, i]
    values += [deep, 5, "text", [], {}]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(-1, None)], "i int, t string").select("i", V.parse(F.col("t")).alias("v"))
    got = sorted(((r["i"], r["path"] or "", r["leaf"]) for r in G.leaf_paths(df, "v", ["i"]).collect()), key=repr)
    want = sorted(((i, p, leaf) for i, v in enumerate(values) for p, leaf in plain_leaves(v)), key=repr)
    assert got == want
    assert G.leaf_paths(df.limit(0), "v", ["i"]).count() == 0


def test_leaf_paths_costs_its_own_depth(spark):
    df = spark.createDataFrame([('{"a":{"b":1}}',)], "t string").select(V.parse(F.col("t")).alias("v"))
    plan = G.leaf_paths(df, "v", [])._jdf.queryExecution().analyzed().toString()
    assert plan.count("Generate ") == 1 and plan.count("flatten(") == 2


def plain_merge(old, new):
    if isinstance(old, dict) and isinstance(new, dict):
        return {k: plain_merge(old[k], new[k]) if k in old and k in new else new.get(k, old.get(k)) for k in {**old, **new}}
    return new


def test_deep_merge(spark):
    rng = random.Random(6)
    pairs = [({"a": {"x": 1, "y": [1]}, "b": 2}, {"a": {"y": [2], "z": None}, "c": 3})]
    while len(pairs) < 150:
        old, new = tree(rng, 5), tree(rng, 5)
        if isinstance(old, dict) and isinstance(new, dict):
            pairs.append((old, new))
    deep_old, deep_new = {"end": 1, "kept": 1}, {"end": 2}
    for i in range(60):
        deep_old, deep_new = {"k": deep_old, f"o{i}": i}, {"k": deep_new, f"n{i}": [i]}
    pairs.append((deep_old, deep_new))
    df = spark.createDataFrame([(i, json.dumps(o), json.dumps(n)) for i, (o, n) in enumerate(pairs)], "i int, o string, n string")
    out = {r["i"]: r for r in G.deep_merge(df, "o", "n", "m").collect()}
    assert all(json.loads(out[i]["m"]) == plain_merge(o, n) and out[i]["m_error"] is None for i, (o, n) in enumerate(pairs))


def test_deep_merge_of_odd_texts(spark):
    rows = [(None, '{"a":1}'), ('{"a":1}', None), (None, None), ('{"a":', "{}"), ("{}", "[1]"), ('{"a":1,"a":2}', "{}"), ('{"task_name":"t","b":"c"}', '{"task_name":null,"b":null}'),
            ('{"b":1}', '{"task_name":null}')]
    df = spark.createDataFrame(rows, "o string, n string").coalesce(1)
    out = [(None if r["m"] is None else json.loads(r["m"]), r["m_error"]) for r in G.deep_merge(df, "o", "n", "m", kept=["task_name"]).collect()]
    assert out == [({"a": 1}, None), ({"a": 1}, None), (None, None), (None, "o is not a JSON object"), (None, "n is not a JSON object"), (None, "o is not a JSON object"),
                   ({"task_name": "t", "b": None}, None), ({"b": 1, "task_name": None}, None)]


def test_names_and_times(spark):
    row = spark.range(1).select(
        N.language_from_name(F.lit("DE_in.json")).alias("a"), N.language_from_name(F.lit("deu_in.json")).alias("b"),
        N.input_stem(F.lit("x_batch_response_raw_response.json")).alias("c"), N.stem(F.lit("/p/q/a.b.json")).alias("d"),
        T.elapsed_text(F.lit(90_061.9)).alias("e"), T.elapsed_text(F.lit(59)).alias("f"), T.percent_text(F.lit(3), F.lit(0)).alias("g"),
        N.parse_task_path(F.lit("tasks/u/openai_a_b_01_02_2024_030405")).alias("h"),
        N.parse_task_path(F.lit("u/openai_t_20240201_030405")).alias("i"), N.parse_task_path(F.lit("odd")).alias("j")).first()
    assert list(row)[:7] == ["de", "en", "x", "a.b", "1 day, 1:01:01", "0:00:59", "300%"]
    assert (row["h"]["api_name"], row["h"]["task_name"], str(row["h"]["created_at"])) == ("openai", "a_b", "2024-02-01 03:04:05")
    assert (row["i"]["task_name"], str(row["i"]["created_at"])) == ("t", "2024-02-01 03:04:05")
    assert tuple(row["j"]) == ("unknown", "odd", "unknown", None)


def test_what_is_one_json_value(spark):
    bad = ["5] garbage", '{"a":1}] x', '"a"] tail', "5]", "5}", '{"a":1}} x', "1,2", '1,"x":2', "", "x", "5]}"]
    good = ["5", '{"a":[1,{"b":"],"}]}', '"],"', "[]", " null ", "[1,2]"]
    rows = spark.createDataFrame([(t,) for t in bad + good], "t string").select("t", V.parse(F.col("t")).isNull().alias("broken")).collect()
    assert [r.t for r in rows if r.broken] == bad


def test_field_names_are_not_paths(spark):
    row = spark.createDataFrame([('{"input.text":"hi","who":{"x":1}}', "input.text")], "t string, name string").select(
        P.find_prompt(V.parse(F.col("t")), "input.text", "who.x", True).alias("a"), P.find_prompt(V.parse(F.col("t")), F.col("name"), F.lit("s"), F.lit(True)).alias("b"),
        P.find_prompt(V.parse(F.col("t")), "who.x", "s", True).alias("c")).first()
    assert row.a.user == row.b.user == "hi" and row.a.system == P.DEFAULT_SYSTEM and "'who.x'" in row.c.error


def test_keys_keep_nulls_and_sort_deep(spark):
    from promptloom.functions import keys as K
    df = spark.sql("SELECT named_struct('z', 1, 'b', cast(NULL AS string)) AS s, named_struct('b', cast(NULL AS string), 'z', 1) AS same")
    row = df.select(K.sorted_json(q=F.col("s"), a=F.lit(None).cast("string")).alias("x"), K.sorted_json(q=F.col("same"), a=F.lit(None).cast("string")).alias("y"),
                    K.sorted_json(q=F.col("s")).alias("other")).first()
    assert row.x == row.y == '{"a":null,"q":{"b":null,"z":1}}' and row.other != row.x

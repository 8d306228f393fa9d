"""Circuit states, provider calls and trailing similarity against plain Python."""
import os
import random
import sys
import time
import uuid

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from promptloom.functions import similarity as FS
from promptloom.operators import circuit as C
from promptloom.operators import dispatch as D
from promptloom.operators import ordered
from promptloom.operators import similarity as M

SECOND = 1_000_000


def brute(calls, max_failures, reset):
    failures, opened, out = 0, None, []
    for us, ok in calls:
        if opened is not None and us - opened < reset * SECOND:
            out.append("rejected")
        elif ok:
            failures, opened = 0, None
            out.append("success")
        else:
            failures += 1
            opened = us if failures >= max_failures else None
            out.append("failure")
    return out


@pytest.mark.parametrize("max_failures, reset, share", [(3, 60, 0.5), (1, 20, 0.3), (2, 500, 0.9), (3, 0, 0.7)])
@pytest.mark.parametrize("range_rows", ["1000000", "60"])
def test_circuit_state(spark, setting, max_failures, reset, share, range_rows):
    setting(ordered.ROWS_SETTING, range_rows)
    rng = random.Random(7)
    rows, expected = [], {}
    for provider in ("a", "b"):
        us, calls = 0, []
        for i in range(400 if provider == "a" else 30):
            us += rng.choice([0, 1, 5, 40, 90]) * SECOND
            calls.append((us, rng.random() > share))
            rows.append((provider, i if provider == "a" else 1000 + i, us, calls[-1][1]))
        expected[provider] = brute(calls, max_failures, reset)
    df = spark.createDataFrame(rows, "p string, id bigint, us bigint, ok boolean")
    got = C.circuit_state(df, "p", "id", "us", "ok", max_failures, reset).orderBy("call_id").collect()
    for provider in expected:
        assert [r["outcome"] for r in got if r["provider"] == provider] == expected[provider]


def test_back_off_doubles():
    assert [D.back_off(a, 1.0, lambda low, high: high) for a in (1, 2, 3)] == [1.5, 3.0, 6.0]


def test_send_retries_then_gives_up():
    waits, calls = [], []

    def busy(body):
        calls.append(body)
        raise D.Retryable("busy")

    out = D.send(busy, "x", D.Breaker(3, 60), 4, 1.0, waits.append)
    assert out == (None, "busy", 4) and len(calls) == 4 and len(waits) == 3


def test_other_errors_are_not_retried():
    def wrong(body):
        raise ValueError("bad body")
    assert D.send(wrong, "x", D.Breaker(3, 60), 5, 1.0) == (None, "bad body", 1)


def test_breaker_opens_and_probes():
    now = [0.0]
    breaker = D.Breaker(2, 10, lambda: now[0])
    breaker.record(False)
    assert not breaker.refuses()
    breaker.record(False)
    assert breaker.refuses()
    now[0] = 10.0
    assert not breaker.refuses()
    breaker.record(False)
    assert breaker.refuses()
    now[0] = 20.0
    breaker.record(True)
    assert not breaker.refuses()


def flaky():
    """A provider that fails the first try of every body with something worth retrying."""
    seen = set()

    def call(body):
        if body not in seen:
            seen.add(body)
            raise D.Retryable("first try")
        return body[::-1]
    return call


@pytest.fixture
def make():
    # Test modules are not on the workers' path: send the function itself.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    yield flaky
    cloudpickle.unregister_pickle_by_value(sys.modules[__name__])


def test_dispatch(spark, make):
    df = spark.createDataFrame([(f"k{i}", f"body{i}") for i in range(20)], "request_key string, body string")
    out = D.dispatch(df, make, tasks=3, base_delay=0.0).collect()
    assert len(out) == 20
    assert all(r["answer"] == f"body{r['request_key'][1:]}"[::-1] and r["attempts"] == 2 and r["error"] is None for r in out)


def picky():
    """A provider that turns down some bodies for good."""
    def call(body):
        if body.endswith("7"):
            raise ValueError("refused")
        return body
    return call


def test_bad_bodies_do_not_stop_others(spark, make):
    """Default breaker: bodies that are turned down in a row leave all others answered."""
    df = spark.createDataFrame([(f"k{i}", f"body{i}" if i > 20 else "bad7") for i in range(60)], "request_key string, body string").coalesce(1)
    out = {r.request_key: r for r in D.dispatch(df, picky, threads=1).collect()}
    assert len(out) == 60
    for i in range(60):
        bad = i <= 20 or i % 10 == 7
        assert (out[f"k{i}"].error == "refused") == bad and (out[f"k{i}"].answer is None) == bad


def test_open_breaker_waits_and_probes():
    now, waits = [0.0], []

    def sleep(seconds):
        waits.append(seconds)
        now[0] += seconds

    breaker = D.Breaker(2, 10, lambda: now[0])
    breaker.record(False)
    breaker.record(False)
    assert D.send(lambda body: body, "x", breaker, 3, 1.0, sleep) == ("x", None, 1) and waits == [10.0]
    assert breaker.remaining() == 0


def test_bucket_spreads_calls():
    now = [0.0]
    bucket = D.Bucket(2.0, 1.0, lambda: now[0])
    assert [bucket.take() for _ in range(3)] == [0.0, 0.5, 1.0]
    now[0] = 10.0
    assert bucket.take() == 0.0 and bucket.take() == 0.5


def named(name):
    """Providers by name: one is down, one cannot be made."""
    if name == "unmade":
        raise ValueError("no such provider")

    def call(body):
        if name == "down":
            raise D.Retryable("down")
        return f"{name}:{body}"
    return call


def test_provider_per_row(spark, make):
    rows = [(f"k{i}", f"body{i}", ["a", "b", "down", "unmade", None][i % 5]) for i in range(50)]
    df = spark.createDataFrame(rows, "request_key string, body string, provider string")
    out = {r.request_key: r for r in D.dispatch(df, named, provider="provider", tasks=2, rates={"a": 1000.0}, tries=1, base_delay=0.0, max_failures=2,
                                                reset_seconds=3600, deadline_seconds=2).collect()}
    for key, body, name in rows:
        r = out[key]
        if name == "unmade":
            assert (r.answer, r.error, r.attempts) == (None, "no such provider", 0)
        elif name == "down":
            assert r.answer is None and (r.error, r.attempts) in {("down", 1), (D.LATE, 0)}
        else:
            assert (r.answer, r.error, r.attempts) == (f"{name}:{body}", None, 1)
    assert any(r.error == D.LATE for r in out.values())
    with pytest.raises(ValueError, match="number"):
        D.dispatch(df, named, provider="provider", rates={"a": 1.0})


def killer():
    """A provider whose process ends at one body, after the other tasks have had time to finish; every call leaves a file."""
    def call(body):
        folder, name, kill = body.split("|")
        if kill == "kill" and not os.path.exists(f"{folder}/again"):
            time.sleep(6)
            os._exit(1)
        with open(f"{folder}/{name}-{uuid.uuid4().hex}", "w"):
            return name
    return call


def test_a_killed_run_sends_nothing_twice(spark, make, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    rows = [(f"k{i}", f"{calls}|k{i}|{'kill' if i == 39 else ''}") for i in range(40)]
    df = spark.createDataFrame(rows, "request_key string, body string").repartitionByRange(4, "request_key")
    with pytest.raises(Exception):
        D.dispatch_once(df, killer, f"{tmp_path}/answers", threads=1)
    committed = {r.request_key for r in D.answered(spark, f"{tmp_path}/answers").collect()}
    assert len(committed) >= 20
    (calls / "again").write_text("")
    out = D.dispatch_once(df, killer, f"{tmp_path}/answers", threads=1).collect()
    assert {r.request_key: r.answer for r in out} == {f"k{i}": f"k{i}" for i in range(40)}
    sent = [f.name.split("-")[0] for f in calls.iterdir() if "-" in f.name]
    assert all(sent.count(k) == 1 for k in committed)
    before = len(sent)
    assert len(D.dispatch_once(df, killer, f"{tmp_path}/answers", threads=1).collect()) == 40
    assert len([f for f in calls.iterdir() if "-" in f.name]) == before


def test_dispatch_of_nothing(spark, make):
    df = spark.createDataFrame([], "request_key string, body string")
    assert D.dispatch(df, make).count() == 0


GROUPS = ["explain how plants make food from light", "explain how plants make food from sun light",
          "tell me about the red planet", "tell me about the red planet mars", "write a haiku"]


@pytest.mark.parametrize("n", [1, 3, 40])
def test_similarity_flag(spark, n):
    rng = random.Random(3)
    rows = [(t, i, " ".join(rng.sample(rng.choice(GROUPS).split(), 3))) for t, size in (("x", 600), ("y", 5)) for i in range(size)]
    df = spark.createDataFrame(rows, "task string, seq bigint, text string")
    got = {(r["task"], r["seq"]): r["max_score"] for r in M.similarity_flag(df, "task", "seq", "text", n, 0.8).collect()}
    assert len(got) == len(rows)
    texts = {(t, i): set(text.split()) for t, i, text in rows}
    for (task, seq), score in got.items():
        own = texts[task, seq]
        before = [texts[task, s] for s in range(max(0, seq - n), seq)]
        assert score == pytest.approx(max((len(own & b) / len(own | b) for b in before), default=0.0))


@pytest.mark.parametrize("range_rows", ["1000000", "100"])
def test_gaps_and_repeats_lose_nothing(spark, setting, range_rows):
    """Any ascending order numbers: every row meets all of its previous n, with and without a threshold."""
    setting(ordered.ROWS_SETTING, range_rows)
    rng = random.Random(5)
    rows = [("x", 7 * i + rng.randrange(7), " ".join(rng.sample(rng.choice(GROUPS).split(), 3))) for i in range(700)]
    rows += [("y", -40 + 9 * i, rng.choice(["", "...", "a b", None])) for i in range(20)] + [(None, 3, "a"), (None, 5, "a")]
    df = spark.createDataFrame(rows, "task string, seq bigint, text string").repartition(4)
    want = {}
    for task in ("x", "y", None):
        mine = sorted(r[1:] for r in rows if r[0] == task)
        for i, (seq, text) in enumerate(mine):
            for other, before in mine[max(0, i - 3):i]:
                if text is not None and before is not None:
                    a, b = ({w for w in t.replace("...", "").split() if w} for t in (text, before))
                    want[task, seq, other] = len(a & b) / len(a | b) if a | b else 1.0
                else:
                    want[task, seq, other] = None
    got = {(r["task"], r["seq"], r["prev_seq"]): r["score"] for r in M.similar_recent(df, "task", "seq", "text", 3).collect()}
    assert got.keys() == want.keys() and all(got[k] == (None if v is None else pytest.approx(v)) for k, v in want.items())
    for at_least in (0.2, 0.5, 0.8, 1.0):
        high = {(r["task"], r["seq"], r["prev_seq"]) for r in M.similar_recent(df, "task", "seq", "text", 3, at_least=at_least).collect()}
        assert high == {k for k, v in want.items() if v is not None and v >= at_least - 1e-12}


def test_prefixes_keep_every_similar_pair(spark):
    rng = random.Random(8)
    rows = []
    for i in range(600):
        words = rng.sample(range(60), rng.randrange(1, 40))
        other = words[:rng.randrange(len(words) + 1)] + rng.sample(range(60, 90), rng.randrange(8))
        rows.append((i, " ".join(f"w{w}" for w in words), " ".join(f"w{w}" for w in other)))
    df = spark.createDataFrame(rows, "id int, a string, b string").select(FS.word_hashes(F.col("a")).alias("a"), FS.word_hashes(F.col("b")).alias("b"))
    for at_least in (0.1, 0.5, 0.75, 0.8, 1.0):
        needs = FS.SCORERS["jaccard"].needed(F.col("a"), F.col("b"), at_least)
        lost = df.where((FS.jaccard(F.col("a"), F.col("b")) >= at_least) & ~(needs[0] & needs[1]))
        assert lost.count() == 0
        assert at_least < 0.5 or df.where(~(needs[0] & needs[1])).count() > 50


@pytest.mark.parametrize("range_rows", ["1000000", "40"])
def test_similar_cooldown(spark, setting, range_rows):
    """Only similar responses make the next ones wait; ties, gaps and rows without a time."""
    setting(ordered.ROWS_SETTING, range_rows)
    rng = random.Random(4)
    rows = [(t, i, rng.choice([None, *range(0, 400)]) if i % 11 == 0 else i // 2 * 3, rng.random() < 0.2, rng.choice([0.0, 0.9])) for t in "ab" for i in range(0, 300, 2)]
    df = spark.createDataFrame([(t, i, None if s is None else s * SECOND, f, m) for t, i, s, f, m in rows],
                               "task string, seq int, us bigint, is_similar boolean, max_score double").repartition(3)
    got = {(r["task"], r["seq"]): (r["remaining"], r["should_wait"]) for r in M.similar_cooldown(df, "task", ["seq"], "us", 30).collect()}
    for task in "ab":
        last = None
        for t, i, s, f, m in sorted(r for r in rows if r[0] == task):
            left = 0 if last is None or s is None else max(0, 30 - (s - last))
            assert got[task, i] == (left, left > 0)
            last = s if f and m > 0 and s is not None else last


def test_signature_estimates_jaccard(spark):
    a = " ".join(f"w{i}" for i in range(200))
    b = " ".join(f"w{i}" for i in range(60, 260))
    texts = spark.createDataFrame([(1, a), (2, b), (3, "... "), (4, None)], "id int, text string")
    signed = {r["id"]: r["s"] for r in FS.with_signature(texts, ["id"], "text", "s").collect()}
    assert signed[3] == signed[4] == [None] * FS.SIGNATURE_SIZE
    row = spark.range(1).select(
        FS.signature_agreement(F.lit(signed[1]), F.lit(signed[2])).alias("estimate"),
        FS.jaccard(FS.word_hashes(F.lit(a)), FS.word_hashes(F.lit(b))).alias("exact"),
        FS.levenshtein_ratio(F.lit("kitten"), F.lit("sitting")).alias("edit"),
        FS.jaccard(FS.word_hashes(F.lit("...")), FS.word_hashes(F.lit(""))).alias("empty"),
        FS.cosine(FS.with_norm(F.array(F.lit(3.0), F.lit(4.0))), FS.with_norm(F.array(F.lit(4.0), F.lit(3.0)))).alias("cosine")).first()
    assert row["exact"] == pytest.approx(140 / 260) and abs(row["estimate"] - row["exact"]) < 0.3
    assert row["edit"] == pytest.approx(1 - 3 / 7) and row["empty"] == 1.0 and row["cosine"] == pytest.approx(0.96)


def test_edit_distance_of_long_and_odd_texts(spark):
    rng = random.Random(8)
    texts = ["", "a", None, "kitten", "sitting", *["".join(rng.choices("abcdeé😀", k=rng.randrange(300))) for _ in range(40)]]
    pairs = spark.createDataFrame([(a, texts) for a in texts], "a string, others array<string>")
    found = FS.with_edit_distances(pairs, "a", "others", "d")
    wrong = found.select("a", F.explode(F.arrays_zip("others", "d")).alias("p")).where(~F.col("p.d").eqNullSafe(F.levenshtein("a", F.col("p.others"))))
    assert found.count() == len(texts) and wrong.count() == 0


def test_levenshtein_against_the_function(spark):
    """With and without a wanted score, null and empty texts among them."""
    rng = random.Random(9)
    rows = [("x", i, rng.choice([None, "", "abcd", "abxd", "zzzzzzzzzzzz"])) for i in range(80)]
    df = spark.createDataFrame(rows, "task string, seq bigint, text string")
    for wanted in (None, 0.7):
        slow = FS.Scorer(lambda text: text, FS.levenshtein_ratio, FS.SCORERS["levenshtein"].needed)
        want, got = (sorted(map(repr, M.similar_recent(df, "task", "seq", "text", 3, how, wanted).collect())) for how in (slow, "levenshtein"))
        assert got == want and len(got) > 20


def test_requests_are_taken_in_slices(spark, monkeypatch):
    """Long bodies of one Arrow batch are not all Python objects at once."""
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(["x" * 1_000] * 50)], names=["request_key", "body"])
    monkeypatch.setattr(D, "SLICE_BYTES", 10_000)
    sizes = [part.num_rows for part in D._slices([batch])]
    assert sum(sizes) == 50 and max(sizes) <= 12

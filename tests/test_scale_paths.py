"""The ways taken for large tables give the rows of the small-table ways, and do not depend on partitions."""
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from promptloom.operators import joins, ordered
from promptloom.plans import catalog

# Streams and file round trips are left out: their ordered parts are the same operators.
ORDERED = ["number_tasks", "status_changes", "cooldown_remaining", "ttl_hits", "running_hits", "circuit_state",
           "combine_batches", "split_batches", "similarity_flag", "similar_recent", "write_json_array", "sample_records"]
JOINED = ["cache_hits", "cache_misses", "get_or_set", "join_config", "resolve_provider", "resolve_input_file"]


def rows(df):
    columns = sorted(df.columns)
    return sorted(map(repr, df.select(*columns).collect()))


@pytest.fixture(scope="module")
def plain(spark):
    known = {}

    def get(name):
        if name not in known:
            known[name] = rows(catalog.QUERIES[name](spark, SMALL))
        return known[name]
    return get


@pytest.mark.parametrize("name", ORDERED)
def test_many_ranges(spark, setting, plain, name):
    expected = plain(name)
    setting(ordered.ROWS_SETTING, "37")
    assert rows(catalog.QUERIES[name](spark, SMALL)) == expected


@pytest.mark.parametrize("name", JOINED)
def test_hot_keys_and_no_broadcast(spark, setting, plain, name):
    expected = plain(name)
    setting(joins.HOT_SETTING, "2")
    setting(joins.SMALL_ROWS_SETTING, "0")
    assert rows(catalog.QUERIES[name](spark, SMALL)) == expected


@pytest.mark.parametrize("name", ["number_tasks", "status_changes", "similarity_flag", "get_or_set", "circuit_state"])
@pytest.mark.parametrize("partitions", ["1", "50"])
def test_partitions_do_not_matter(spark, setting, plain, name, partitions):
    expected = plain(name)
    setting("spark.sql.shuffle.partitions", partitions)
    assert rows(catalog.QUERIES[name](spark, SMALL)) == expected


def test_only_hot_keys_are_cut_into_ranges(spark, setting):
    setting(ordered.ROWS_SETTING, "500")
    table = spark.range(20_000).selectExpr("CASE WHEN id < 15000 THEN 1 ELSE id END AS k", "id * id AS o")
    cold, hot = ordered.split_hot(table, ["k"], ["o"])
    sizes = [r["count"] for r in hot.groupBy("k", "__range").count().collect()]
    assert cold.count() == 5_000 and sum(sizes) == 15_000 and len(sizes) >= 25 and max(sizes) < 1_500
    ends = sorted(tuple(r) for r in hot.groupBy("__range").agg({"o": "min"}).collect())
    assert [o for _, o in ends] == sorted(o for _, o in ends)
    assert ordered.split_hot(table.where("k > 1"), ["k"], ["o"])[1] is None


@pytest.mark.parametrize("limit", ["1000000", "40"])
def test_ordered_work_against_plain_python(spark, setting, limit):
    """Null keys, null and text orders, gaps, one key with most rows."""
    import random
    rng = random.Random(1)
    data = [(None if i % 50 == 0 else 1 if i % 3 else i % 7 + 2, "a" if i % 2 else None, i * 10 % 1_009, rng.choice([None, 1, 5])) for i in range(900)]
    setting(ordered.ROWS_SETTING, limit)
    df = spark.createDataFrame(data, "k int, a string, o int, v int").repartition(5)
    groups = {}
    for row in sorted(data, key=lambda r: (r[1] is not None, r[1] or "", r[2])):
        groups.setdefault(row[0], []).append(row)
    numbered, before, sums, seen, last = [], [], [], [], []
    for rows_of_key in groups.values():
        for i, row in enumerate(rows_of_key):
            numbered.append((*row, i + 1))
            before.append((*row, rows_of_key[i - 1][3] if i else None, rows_of_key[i - 1][2] if i else None))
            sums.append((*row, sum(r[3] or 0 for r in rows_of_key[:i + 1])))
            seen.append((*row, next((r[2] for r in reversed(rows_of_key[:i]) if r[3] == 5), None)))
        last += rows_of_key[-70:]
    keys, order = ["k"], ["a", "o"]

    def plain(found):
        return sorted((tuple(r) for r in found.collect()), key=repr)

    assert plain(ordered.number_rows(df, keys, order, start=1)) == sorted(numbered, key=repr)
    assert plain(ordered.previous_values(df, keys, order, {"p": "v", "q": "o"})) == sorted(before, key=repr)
    assert plain(ordered.running_sums(df, keys, order, {"s": "v"})) == sorted(sums, key=repr)
    assert plain(ordered.last_before(df, keys, order, {"l": F.when(F.col("v") == 5, F.col("o"))})) == sorted(seen, key=repr)
    assert plain(ordered.last_rows(df, keys, order, 70)) == sorted(last, key=repr)
    assert plain(ordered.last_rows(df, keys, order, F.lit(70))) == sorted(last, key=repr)
    assert ordered.number_rows(df.limit(0), keys, order).count() == 0


def test_salting_spreads_the_hot_key(spark, setting):
    setting(joins.HOT_SETTING, "100")
    left = spark.range(5_000).selectExpr("id", "CASE WHEN id < 4000 THEN 0 ELSE id END AS k")
    right = spark.range(5_000).selectExpr("id AS k", "id * 2 AS v")
    got = joins.salted_join(left, right, ["k"], "left", ["id"])
    assert rows(got) == rows(left.join(right, "k", "left"))
    assert "SortMergeJoin" in got._jdf.queryExecution().toString() or "Hash" in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("n", [4, 1_500])
def test_last_rows_needs_no_whole_key(spark, setting, n):
    setting(ordered.ROWS_SETTING, "1000")
    table = spark.range(10_000).selectExpr("id % 3 AS k", "id")
    got = ordered.last_rows(table, ["k"], ["id"], n)
    assert sorted(r["id"] for r in got.collect()) == list(range(10_000 - 3 * n, 10_000))


def test_keys_of_many_bytes_are_cut_into_ranges(spark, setting):
    """Few rows, long texts: no range holds much more than its bytes, and the numbers are those of the plain window."""
    table = spark.range(600).selectExpr("CASE WHEN id < 500 THEN 1 WHEN id < 510 THEN NULL ELSE id END AS k", "id * 7 AS o", "repeat('é', 100) AS text")
    expected = rows(ordered.number_rows(table, ["k"], ["o"]))
    setting(ordered.BYTES_SETTING, "10000")
    cold, hot = ordered.split_hot(table, ["k"], ["o"])
    sizes = [r["count"] for r in hot.groupBy("k", "__range").count().collect()]
    assert cold.count() == 100 and sum(sizes) == 500 and max(sizes) < 150
    assert rows(ordered.number_rows(table, ["k"], ["o"])) == expected


@pytest.mark.parametrize("name", ["similarity_flag", "sim_jaccard", "similar_cooldown", "sim_levenshtein", "save_history", "load_history"])
def test_ranges_by_bytes(spark, setting, plain, name):
    expected = plain(name)
    setting(ordered.BYTES_SETTING, "20000")
    assert rows(catalog.QUERIES[name](spark, SMALL)) == expected

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tablewright.operators import relational as r
from tablewright.operators.clean import dedupe_rows, duplicate_count


def test_null_keys_match_and_shared_columns_get_suffixes(spark):
    a = spark.createDataFrame([(1.0, 10, "p"), (None, 20, "q"), (3.0, 30, "r")], "k double, a long, s string")
    b = spark.createDataFrame([(1.0, 7, "x"), (None, 8, "y"), (None, 9, "z"), (5.0, 1, "w")], "k double, b long, s string")
    inner = r.merge(a, b, "k")
    assert inner.columns == ["k", "a", "s_x", "b", "s_y"]
    assert rows(inner) == sorted([(1.0, 10, "p", 7, "x"), (None, 20, "q", 8, "y"), (None, 20, "q", 9, "z")], key=repr)
    assert r.merge(a, b, "k", "left").count() == 4
    with pytest.raises(ValueError):
        r.merge(a, b, "k", "outer")


def test_join_keeps_its_equality_plan(spark):
    a = spark.range(10).select(F.col("id").alias("k"))
    plan = r.merge(a, a.withColumn("v", F.lit(1)), "k")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_explode_drops_empty_lists_and_defaults_missing_fields(spark):
    schema = "asin string, questions array<struct<q: string, answers: array<struct<a: string, helpful: array<int>>>>>"
    df = spark.createDataFrame([("p", [("q1", [("yes", None), (None, [1])]), ("q2", [])]), ("empty", []), ("none", None)], schema)
    questions = r.explode_records(df, "questions", {"q": "q", "answers": "answers"}, ["asin"])
    got = r.explode_records(questions, "answers", {"a": "a", "helpful": "helpful"}, ["asin", "q"], {"a": F.lit(""), "helpful": F.array().cast("array<int>")})
    assert rows(got) == sorted([("p", "q1", "yes", []), ("p", "q1", "", [1])], key=repr)


def test_every_key_has_one_sorted_list(spark):
    hot = [("hot", v % 500) for v in range(3000)] + [("same", 1)] * 250
    df = spark.createDataFrame(hot + [("cold", 3), ("cold", 1), ("none", None), (None, 5)], "k string, v int").repartition(4)
    got = {row["k"]: row["v"] for row in r.collect_lists(df, "k", "v").collect()}
    assert r.collect_lists(df, "k", "v").count() == len(got)
    assert got == {"hot": sorted(v % 500 for v in range(3000)), "same": [1] * 250, "cold": [1, 3], "none": [None]}


def test_a_large_key_does_not_multiply_the_rows_it_joins(spark):
    owners = spark.createDataFrame([("a", v) for v in range(5000)] + [("b", 1)], "item string, owner int")
    likes = spark.createDataFrame([("u", "a"), ("v", "a"), ("w", "b"), ("x", "c")], "user string, item string")
    joined = r.merge(likes, r.collect_lists(owners, "item", "owner"), "item", "left")
    assert {row["user"]: len(row["owner"] or []) for row in joined.collect()} == {"u": 5000, "v": 5000, "w": 1, "x": 0}
    assert joined.count() == 4


def test_edges_in_both_directions_once(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c")], "x string, y string")
    assert rows(r.undirected_edges(edges, "x", "y")) == [("a", "b"), ("a", "c"), ("b", "a"), ("c", "a")]


def test_adjacency_has_both_directions_once(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("d", "d")], "user1 string, user2 string")
    got = {row["user"]: row["connections"] for row in r.undirected_adjacency(edges, "user1", "user2").collect()}
    assert got == {"a": ["b", "c"], "b": ["a"], "c": ["a"], "d": ["d"]}


def test_rows_with_maps_are_deduplicated_by_content(spark):
    schema = "m map<string,int>, s struct<inner: array<map<string,int>>>, x double"
    data = [({"a": 1, "b": 2}, ([{"k": 1}],), 1.0), ({"b": 2, "a": 1}, ([{"k": 1}],), 1.0), (None, None, None), (None, None, None), ({"a": 1}, None, float("nan"))]
    df = spark.createDataFrame(data, schema)
    assert dedupe_rows(df).count() == 3
    assert tuple(duplicate_count(df).first()) == (5, 2)
    assert dedupe_rows(dedupe_rows(df)).count() == 3


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    b = spark.createDataFrame([("y", True)], "b string, c boolean")
    assert rows(r.union_by_name(a, b)) == sorted([(1, "x", None), (None, "y", True)], key=repr)


def test_pop_target_and_null_split(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, None)], "x int, y string")
    features, target = r.pop_target(df, "y")
    assert rows(features) == [(1,)] and rows(target) == [("a",)]
    train, test = r.filter_null_split(df, "x")
    assert (train.count(), test.count()) == (2, 1)


def test_prefix_drop_keeps_the_target(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "t int, t_a int, t_label int, total int")
    assert r.drop_prefixed(df, "t").columns == ["t", "total"]


def test_rows_with_null_keys_are_dealt_over_many_tasks(spark):
    left = spark.range(400).select(F.when(F.col("id") % 4 == 0, F.col("id")).alias("k"), F.col("id").alias("a"))
    right = spark.range(40).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("k"), F.col("id").alias("b"))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        both = r.merge(left, right, "k").withColumn("task", F.spark_partition_id())
        lacking = [row["n"] for row in both.filter("k IS NULL").groupBy("task").agg(F.count("*").alias("n")).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(lacking) == 300 * 20 and len(lacking) > 4 and max(lacking) < 300 * 20 / 2
    assert r.merge(left, right, "k", "left").count() == 300 * 20 + 100 and both.columns[:3] == ["k", "a", "b"]


def test_neighbour_lists_take_more_tasks_for_more_edges(spark, monkeypatch):
    edges = spark.range(200).selectExpr("id % 5 AS a", "id % 40 + 100 AS b")
    want = sorted(tuple(row) for row in r.undirected_adjacency(edges, "a", "b").selectExpr("user", "concat_ws(',', connections)").collect())
    monkeypatch.setattr(r, "TASK_EDGES", 10)
    dealt = r.undirected_adjacency(edges, "a", "b")
    assert sorted(tuple(row) for row in dealt.selectExpr("user", "concat_ws(',', connections)").collect()) == want
    assert "REPARTITION_BY_NUM, [plan_id" in dealt._jdf.queryExecution().toString() and ", 40)" in dealt._jdf.queryExecution().toString()

import pytest
from pyspark.sql import functions as F

from tablewright.operators import profile as p
from tablewright.operators.roles import ColumnRoles, cast_by_role, classify_columns, stringify_columns


def test_unique_share_of_an_empty_column_is_null(spark):
    df = spark.createDataFrame([(None, 1), (None, 1)], "a string, b int")
    got = {r["column"]: (r["n"], r["n_unique"], r["proportion_unique"]) for r in p.nunique(df, ["a", "b"]).collect()}
    assert got == {"a": (0, 0, None), "b": (2, 1, 0.5)}
    close = {r["column"]: r["n_unique"] for r in p.nunique(df, ["a", "b"], approx=True).collect()}
    assert close == {"a": 0, "b": 1}


def test_mode_ties_go_to_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), (None,), (None,)], "c string")
    assert [tuple(r) for r in p.most_frequent(df, ["c"]).collect()] == [("c", "a", 2)]


def test_profile_without_values_keeps_the_shape(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("a"), F.lit(None).cast("string").alias("b"))
    exact = {r["column"]: r for r in p.table_profile(df).collect()}
    approx = {r["column"]: r for r in p.table_profile(df, distinct="approx").collect()}
    assert exact["a"]["n_distinct"] == approx["a"]["n_distinct"] == 7
    assert exact["a"]["zeros"] == 143 and exact["b"]["n_null"] == 1000 and exact["b"]["n_distinct"] == 0
    assert exact["a"]["mode"] == "0" and exact["b"]["mode"] is None and approx["a"]["mode"] is None


def test_same_table_has_no_anomaly(spark):
    df = spark.createDataFrame([("x", 1, 2.0), ("y", 2, None)], "a string, b int, c double")
    assert p.validate_schema(df, p.infer_schema(df)).count() == 0


def roles(spark, values, kind="string", mode="general", name="c"):
    df = spark.createDataFrame([(v,) for v in values], f"`{name}` {kind}")
    return classify_columns(df, mode).of(name)


def test_text_length_decides_between_short_and_long(spark):
    assert roles(spark, [f"w{i} " + "a " * 29 for i in range(40)]) == "short_text"
    assert roles(spark, [f"w{i} " + "a " * 30 for i in range(40)]) == "long_text"
    assert roles(spark, ["", "   ", None, "été là"]) == "short_text"
    assert roles(spark, [None, None]) == "short_text"


def test_category_limits(spark):
    assert roles(spark, [f"v{i % 100}" for i in range(500)]) == "categorical"
    assert roles(spark, [f"v{i % 101}" for i in range(505)]) == "short_text"
    assert roles(spark, [f"v{i % 101}" for i in range(500)]) == "short_text"
    assert roles(spark, [i % 4 for i in range(40)], "int", "strict") == "categorical"
    assert roles(spark, [i % 5 for i in range(40)], "int", "strict") == "numerical"
    assert roles(spark, [i % 5 for i in range(40)], "int") == "categorical"
    assert roles(spark, [None, None], "double") == "numerical"
    assert roles(spark, [True, False], "boolean") == "categorical"


def test_dates(spark):
    assert roles(spark, ["02 28, 2014", "2 8, 2014", None]) == "datetime"
    assert roles(spark, ["02 28, 2014", "2 8, 2014"], mode="strict") == "datetime"
    assert roles(spark, ["2014-02-28", "2014-03-01"]) == "datetime"
    assert roles(spark, ["2014-02-28", "2014-03-01"], mode="strict") != "datetime"
    assert roles(spark, ["02 28, 2014", "zz"]) == "short_text"
    assert roles(spark, [1400000000, 1400000001], "bigint", name="unixTime") == "datetime"
    assert roles(spark, [1400000000, 1400000001], "bigint", name="stamp") == "numerical"
    assert roles(spark, [1400000000, 1400000001], "bigint", "strict", name="unixTime") == "numerical"


def test_roles_by_hand_and_target(spark):
    df = spark.createDataFrame([(i, f"t{i}", i % 2) for i in range(50)], "a int, b string, y int")
    found = classify_columns(df, "strict", target=["y"])
    assert found.of("y") is None and found.target == ("y",)
    assert found.replace(categorical=["a"], numerical=[]).of("a") == "categorical"
    assert ColumnRoles().set_target("y").target == ("y",)
    assert dict(cast_by_role(df, found).dtypes)["a"] == "double"
    with pytest.raises(ValueError):
        classify_columns(df, "loose")


def test_nested_columns_become_text_and_nulls_stay(spark):
    df = spark.createDataFrame([([1, 2], {"k": 1}, "x"), (None, None, None)], "a array<int>, m map<string,int>, s string")
    got = [tuple(r) for r in stringify_columns(df).collect()]
    assert got == [("[1,2]", '{"k":1}', "x"), (None, None, None)]

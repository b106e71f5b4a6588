import pytest
from conftest import rows
from pyspark.sql import functions as F

from tablewright.functions.hashing import permuted
from tablewright.operators import clean, corrupt
from tablewright.operators.profile import iqr_bounds
from tablewright.operators.roles import ColumnRoles


@pytest.fixture
def table(spark):
    return spark.range(1000).select("id", (F.col("id") % 17).alias("n"), (F.col("id") * 0.5).alias("x"), F.concat(F.lit("name "), F.col("id")).alias("s"), F.lit("2 8, 2014").alias("d"))


def test_duplicates_then_dedupe_gives_the_original(table):
    more = corrupt.insert_duplicates(table, "id", 300, 1)
    assert more.count() == 1300
    assert rows(clean.dedupe_rows(more)) == rows(table)
    by_seed = corrupt.insert_duplicates(table, "id", seed=5).count()
    assert 1001 <= by_seed <= 2000


def test_copies_are_told_apart_and_can_be_damaged_again(table):
    once = corrupt.insert_duplicates(table, "id", 300, 1, copy="copy")
    twice = corrupt.insert_duplicates(once, ["id", "copy"], 500, 2, copy="copy")
    assert twice.count() == 1800 and twice.select("id", "copy").distinct().count() == 1800
    assert clean.dedupe_rows(twice, ignore=["copy"]).count() == 1000


def test_ordinals_of_copies_are_positions(table):
    df = table.withColumn("original_order", F.col("id"))
    mixed = corrupt.insert_duplicates(df, "id", 100, 1, ordinal="original_order")
    assert mixed.filter("original_order not between 0 and 999").count() == 0 and mixed.count() == 1100
    every = corrupt.insert_duplicates(df, "id", 1000, 1, ordinal="original_order")
    # Each position twice: the row that was there and one copy.
    assert sorted(r[0] for r in every.select("original_order").collect()) == sorted([*range(1000)] * 2) and every.dtypes == df.dtypes


@pytest.mark.parametrize("size", [1, 2, 3, 7, 99, 101, 1000, 4097])
def test_permutation_reaches_every_place_once(spark, size):
    places = [r[0] for r in spark.range(size).select(permuted(F.col("id"), size, "p", 3)).collect()]
    assert sorted(places) == list(range(size))
    if size > 50:
        assert places != sorted(places) and places != [r[0] for r in spark.range(size).select(permuted(F.col("id"), size, "p", 4)).collect()]


def test_copies_with_null_and_compound_keys_get_positions(spark):
    df = spark.createDataFrame([(None, 1, 0), (1, None, 1), (1, 1, 2)], "a int, b int, o int")
    out = corrupt.insert_duplicates(df, ["a", "b"], 3, 1, ordinal="o")
    assert out.count() == 6 and sorted(r["o"] for r in out.collect()) == [0, 0, 1, 1, 2, 2]
    assert corrupt.insert_duplicates(df.limit(0), ["a", "b"], 3, 1, ordinal="o").count() == 0


def test_nulls_reach_the_ratio_and_no_further(table):
    some = table.withColumn("x", F.when(F.col("id") >= 15, F.col("x")))
    out = corrupt.introduce_nulls(some, "id", ["x", "n", "absent"], 0.02, 3)
    assert out.filter("x is null").count() == 20 and out.filter("n is null").count() == 20
    assert corrupt.introduce_nulls(some, "id", ["x"], 0.01, 3).filter("x is null").count() == 15
    assert out.schema == some.schema


def test_one_column_per_role(table):
    roles = ColumnRoles(numerical=("x",), categorical=("n",), short_text=("s",))
    out = corrupt.introduce_nulls(table, "id", roles, 0.1, 1)
    counts = out.select([F.count_if(F.col(c).isNull()).alias(c) for c in out.columns]).first().asDict()
    assert counts == {"id": 0, "n": 100, "x": 100, "s": 100, "d": 0}


def test_outliers_are_limited_to_a_tenth(table):
    out = corrupt.introduce_outliers(table, "id", ["x", "n"], 5000, 3, preserve_integer=True)
    changed = out.join(table.select("id", F.col("x").alias("x0"), F.col("n").alias("n0")), "id").filter("x <> x0")
    assert 90 <= changed.count() <= 100  # the minimum is 0: a row already 0 may stay 0
    assert dict(out.dtypes)["n"] == "bigint" and dict(out.dtypes)["x"] == "double"
    assert out.filter("x > 499.5 and x < 999").count() == 0


def test_same_damage_on_one_and_many_partitions(table):
    def damage(df):
        df = corrupt.introduce_nulls(df, "id", ["x", "s"], 0.05, 9)
        df = corrupt.corrupt_missing(df, "id", "n", 0.2, "AR", 9, ["x"])
        return corrupt.corrupt_characters(df, "id", "s", 0.5, 0.5, 9)

    assert rows(damage(table.repartition(1))) == rows(damage(table.repartition(200)))


def test_character_noise_keeps_length_and_other_rows(table):
    out = corrupt.corrupt_characters(table, "id", "s", 0.3, 0.9, 2).join(table.select("id", F.col("s").alias("s0")), "id")
    assert out.filter("length(s) <> length(s0)").count() == 0
    assert 280 <= out.filter("s <> s0").count() <= 300


def test_winsorized_values_lie_within_the_fences(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (1000, None), (None, 1000.5)], "i int, x double")
    out = clean.winsorize(df, ["i", "x"])
    bounds = iqr_bounds(df, ["i", "x"])
    assert dict(out.dtypes) == {"i": "bigint", "x": "double"}
    for c in ("i", "x"):
        assert out.filter((F.col(c) < bounds[c][2]) | (F.col(c) > bounds[c][3])).count() == 0
        assert out.filter(F.col(c).isNull()).count() == 1
    assert [r[0] for r in out.select("i").collect()][3] == 628


def test_fills(spark):
    df = spark.createDataFrame([("a", 1, None), (None, None, None), ("a", 2, "t")], "c string, n int, t string")
    assert rows(clean.impute_simple(df.select("c", "n"), ["c", "n"])) == sorted([("a", 1), ("a", 1), ("a", 2)], key=repr)
    assert rows(clean.fill_text_empty(df, ["t"]), "t") == sorted([("",), ("",), ("t",)], key=repr)


def test_dates_to_seconds_and_back(spark):
    df = spark.createDataFrame([("02 28, 2014",), ("2 8, 2014",), ("zz",), (None,), ("2014-02-08 00:00:01",)], "d string")
    seconds = clean.datetime_to_unix(df, ["d"])
    assert [r[0] for r in seconds.collect()] == [1393545600, 1391817600, None, None, 1391817601]
    back = clean.unix_to_datetime(seconds, ["d"])
    assert str(back.first()[0]) == "2014-02-28 00:00:00"


def test_nan_is_null(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, 1)], "x double, n int")
    assert [tuple(r) for r in clean.nan_to_null(df).collect()] == [(None, 1), (2.0, 1)]

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tablewright.operators import selection as s


@pytest.fixture
def table(spark):
    return spark.range(0, 5000, 1, 7).select("id", (F.col("id") % 3).alias("three"), F.when(F.col("id") % 4 > 0, F.col("id") * 1.5).alias("x"))


@pytest.mark.parametrize("k", [0, 1, 17, 2500, 4999, 5000, 9000])
def test_exactly_k_rows(table, k):
    assert s.select_exact_k(table, "id", k, 3).count() == min(k, 5000)


def test_same_rows_under_any_partitioning(table):
    one = rows(s.select_exact_k(table.repartition(1), "id", 700, 5))
    assert one == rows(s.select_exact_k(table.repartition(200), "id", 700, 5))


def test_deeper_levels_give_the_same_rows(table, monkeypatch):
    want = rows(s.select_exact_k(table, "id", 700, 5))
    monkeypatch.setattr(s, "SMALL", 0.5)
    with pytest.raises(ValueError):  # a bucket never gets smaller than its one row
        s.select_exact_k(table, "id", 700, 5)
    monkeypatch.setattr(s, "SMALL", 1)
    monkeypatch.setattr(s, "DIGIT_BITS", 6)
    assert rows(s.select_exact_k(table, "id", 700, 5)) == want


def test_draws_only_from_eligible_rows(table):
    hit = s.exact_draws(table, "id", [s.Draw("a", 100, F.col("x").isNotNull()), s.Draw("b", lambda n, e: n - e, F.col("x").isNotNull())], 1)
    got = table.select(F.count_if(hit["a"]).alias("a"), F.count_if(hit["a"] & F.col("x").isNull()).alias("bad"), F.count_if(hit["b"]).alias("b")).first()
    assert tuple(got) == (100, 0, 1250)


def test_repeated_key_is_an_error(spark):
    df = spark.range(100).select(F.lit(1).alias("id"))
    with pytest.raises(ValueError):
        s.select_exact_k(df, "id", 40, 1)


def test_key_of_two_columns(table):
    df = table.select((F.col("id") % 50).alias("a"), F.floor(F.col("id") / 50).alias("b"))
    assert s.select_exact_k(df, ["a", "b"], 123, 1).count() == 123


def test_sample_n_small_and_large_agree(table, monkeypatch):
    small = rows(s.sample_n(table, "id", 300, 2))
    monkeypatch.setattr(s, "SMALL", 100)
    assert rows(s.sample_n(table, "id", 300, 2)) == small


def test_order_statistic_with_ties_and_strings(spark, monkeypatch):
    monkeypatch.setattr(s, "SMALL", 20)
    rng = np.random.default_rng(1)
    values = [7] * 700 + [int(v) for v in rng.integers(0, 1000, 1300)]
    df = spark.createDataFrame([(v, f"w{v:04d}") for v in values], "v int, w string").repartition(5)
    ranks = [1, 2, 500, 705, 1999, 2000]
    by_number, by_word = s.order_statistics(df, F.col("v"), ranks), s.order_statistics(df, F.col("w"), ranks)
    for rank in ranks:
        assert by_number[rank] == sorted(values)[rank - 1]
        assert by_word[rank] == f"w{sorted(values)[rank - 1]:04d}"
    with pytest.raises(ValueError):
        s.order_statistics(df, F.col("v"), [2001])


def test_rank_slice_takes_neighbours_and_puts_nulls_last(table, monkeypatch):
    monkeypatch.setattr(s, "SMALL", 50)
    hit = s.rank_slice(table, "x", "id", 3700, 100, 4)
    got = table.filter(hit)
    assert got.count() == 100
    assert got.filter("x is null").count() == 50  # 3750 values come before the nulls


def test_head_fraction(table, monkeypatch):
    want = [(i,) for i in range(50)]
    assert rows(s.head_fraction(table, "id"), "id") == sorted(want, key=repr)
    monkeypatch.setattr(s, "SMALL", 10)
    assert rows(s.head_fraction(table, "id"), "id") == sorted(want, key=repr)


def test_unknown_sampling(table):
    with pytest.raises(ValueError):
        s.sample_rows(table, "id", "x", 0.1, "XYZ", 1)


def test_whole_fraction_takes_all(table):
    assert table.filter(s.sample_rows(table, "id", "x", 1.0, "NAR", 1)).count() == 5000

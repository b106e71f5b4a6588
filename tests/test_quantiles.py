import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import quantiles as q
from tablewright.operators.profile import five_number_summary, iqr_bounds

PROBABILITIES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.mark.parametrize("limit", [10**6, 0])
def test_small_example(spark, limit):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double")
    assert q.exact_quantiles(df, ["x"], [0.25, 0.75], limit)["x"] == [1.75, 4.75]


@pytest.mark.parametrize("limit", [10**6, 0])
def test_empty_and_null_columns(spark, limit):
    df = spark.createDataFrame([(None, 1.0)], "x double, y double")
    assert q.exact_quantiles(df, ["x", "y"], [0.5], limit) == {"x": [None], "y": [1.0]}
    with pytest.raises(ValueError):
        iqr_bounds(df, ["x"])


def test_brackets_agree_with_numpy(spark, monkeypatch):
    monkeypatch.setattr(q, "FEW", 10)
    monkeypatch.setattr(q, "ACCURACY", 50)
    rng = np.random.default_rng(3)
    smooth = rng.normal(size=6000)
    # A third of the rows share one value, a few are far out.
    tied = np.concatenate([np.full(2000, 5.0), rng.integers(0, 40, 3990).astype(float), [1e9] * 10])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(smooth, tied)], "a double, b double").repartition(6)
    got = q.exact_quantiles(df, ["a", "b"], PROBABILITIES, limit=0)
    assert np.allclose(got["a"], np.percentile(smooth, [100 * p for p in PROBABILITIES]))
    assert np.allclose(got["b"], np.percentile(tied, [100 * p for p in PROBABILITIES]))


def test_a_hot_group_among_others(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 700, "hot").when(F.col("id") < 990, "warm").alias("g"), F.col("id").cast("double").alias("x"))
    got = {r["g"]: tuple(r)[1:] for r in five_number_summary(df, "g", "x").collect()}
    assert got["hot"] == (0.0, 174.75, 349.5, 524.25, 699.0)
    assert got[None] == (990.0, 992.25, 994.5, 996.75, 999.0)


def test_groups_of_all_sizes_agree_with_numpy(spark):
    rng = np.random.default_rng(5)
    data = [("hot", float(v)) for v in rng.normal(size=5000)] + [("tied", 4.0)] * 700 + [("tied", float(v)) for v in rng.integers(0, 9, 300)]
    data += [(f"g{i % 400}", float(v)) for i, v in enumerate(rng.integers(-50, 50, 2000))] + [("one", 2.5), ("empty", None), (None, 1.0), (None, 3.0), ("hot", None)]
    names = [f"p{i}" for i in range(len(PROBABILITIES))]
    df = spark.createDataFrame(data, "g string, x double").repartition(7)
    got = {r["g"]: tuple(r)[1:] for r in q.grouped_quantiles(df, "g", "x", PROBABILITIES, names).collect()}
    assert set(got) == {g for g, _ in data}
    for group, found in got.items():
        values = [v for g, v in data if g == group and v is not None]
        if values:
            assert np.allclose(found, np.percentile(values, [100 * p for p in PROBABILITIES])), group
        else:
            assert found == (None,) * len(PROBABILITIES)
    assert q.grouped_quantiles(df.limit(0), "g", "x", PROBABILITIES, names).count() == 0


def test_more_groups_do_not_cost_more_jobs(spark):
    def jobs(groups):
        tracker, name = spark.sparkContext.statusTracker(), f"groups-{groups}"
        spark.sparkContext.setJobGroup(name, name)
        five_number_summary(spark.range(3000).select((F.col("id") % groups).alias("g"), "id"), "g", "id").count()
        spark.sparkContext.setJobGroup("", "")
        return len(tracker.getJobIdsForGroup(name))

    assert jobs(1000) <= jobs(3) + 1

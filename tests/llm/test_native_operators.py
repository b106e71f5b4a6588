"""Mixing and line dedup against their SQL on tables with every odd row."""

import math
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.llm import line_dedup, mixing
from tablewright.llm.queries import ORACLES

SCHEMA = "doc_id long, text string, source string"


def rows(n=400, seed=1):
    rng = random.Random(seed)
    lines = ["All rights reserved.", "  Read more ", "menu\r", "\tshare\t"]
    out = []
    for k in range(n):
        source = "hot" if rng.random() < 0.4 else f"s{rng.randrange(14)}"
        body = [rng.choice(lines) if rng.random() < 0.3 else f"line {rng.randrange(300)}" for _ in range(rng.randint(1, 8))] + [""] * rng.randrange(2)
        out.append((k, "\n".join(body), source if rng.random() > 0.02 else None))
    return [*out, (1000, None, "s1"), (1001, "", "s2"), (1002, "\n\n", "empty"), (1003, "", "void"), (1004, "long line " * 20_000 + "\nmenu", "s3")]


def compared(spark, name, build, data):
    df = spark.createDataFrame(data, SCHEMA)
    documents = pd.DataFrame(data, columns=["doc_id", "text", "source"])  # noqa: F841
    db = duckdb.connect()
    db.register("documents", documents)
    result = db.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    want = sorted(map(repr, (tuple(None if isinstance(x, float) and math.isnan(x) else x for x in r) for r in result.fetchall())))
    got = sorted(map(repr, map(tuple, build(df).select(*names).collect())))
    assert got == want
    return df


def test_mixing_and_sql(spark):
    compared(spark, "op2_mix_sources", lambda df: mixing.mix_sources(df, "doc_id", "source", "text"), rows())


def test_line_dedup_and_sql(spark):
    build = lambda df: line_dedup.remove_boilerplate(df, "doc_id", "text", "source").select("doc_id", "text", "n_lines", "n_removed")
    compared(spark, "op6_line_dedup", build, rows())


def test_counts_follow_the_rates(spark):
    data = [(k, "x" * 100, "a" if k % 10 else "b") for k in range(20_000)]
    df = spark.createDataFrame(data, SCHEMA)
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "source string, weight double")
    out = mixing.mix_sources(df, "doc_id", "source", "text", weights)
    counts = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(counts["a"] - 10_000) < 500 and abs(counts["b"] - 10_000) < 500
    copies = out.groupBy("source", "doc_id").count().filter("source = 'b'").toPandas()["count"].tolist() + [0] * 0
    zero = 2000 - len(copies)
    assert abs(zero / 2000 - math.exp(-5)) < 0.01 and max(copies) > 9


def test_weights_of_absent_sources_and_given_columns(spark):
    df = spark.createDataFrame([(1, "aa", "a", 7, "q"), (2, "bb", "b", 8, "r")], SCHEMA + ", copy int, Rate string")
    weights = spark.createDataFrame([("b", 1.0), ("c", 5.0)], "source string, weight double")
    out = mixing.mix_sources(df, "doc_id", "source", "text", weights)
    assert set(out.columns) == {"doc_id", "text", "source", "copy_input", "Rate_input", "rate", "copy"}
    assert {r.source for r in out.collect()} <= {"b"}


def test_counts_do_not_depend_on_partitions_and_copies_are_shuffled(spark):
    data = [(k, "t" * (k % 50), f"s{k % 3}") for k in range(900)]
    a = spark.createDataFrame(data, SCHEMA)
    count = lambda df: sorted(map(tuple, mixing.mix_sources(df, "doc_id", "source", "text").groupBy("doc_id").count().collect()))
    assert count(a) == count(a.repartition(13))
    order = [r.doc_id for r in mixing.mix_sources(a, "doc_id", "source", "text").collect()]
    assert order != sorted(order)


@pytest.mark.parametrize("rate", [0.001, 0.7, 5.0, 300.0, 900.0])
def test_poisson_table(spark, rate):
    sums = spark.range(1).select(mixing.poisson_table(F.lit(rate)).alias("t")).first().t
    mass = [math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1)) for k in range(len(sums))]
    assert all(abs(a - sum(mass[: k + 1])) < 1e-9 for k, a in enumerate(sums)) and sums[-1] > 1 - 1e-9


def test_repeated_rows_add_no_sites_and_keep_their_lines(spark):
    data = [(5, "shared\nown", "a")] * 30 + [(None, "shared", "b"), (None, "other", "c")]
    out = line_dedup.remove_boilerplate(spark.createDataFrame(data, SCHEMA), "doc_id", "text", "source", sites=3)
    assert out.agg(F.sum("n_removed")).first()[0] == 0
    out = line_dedup.remove_boilerplate(spark.createDataFrame(data, SCHEMA), "doc_id", "text", "source", sites=2)
    assert sorted((r.text, r.n_lines, r.n_removed) for r in out.collect()) == [("", 1, 1)] + [("other", 1, 0)] + [("own", 2, 1)] * 30


def test_many_sites_are_counted_near_the_threshold(spark):
    data = [(k, f"w{n}" if k < n else "rest of it", f"site{k}") for n in (95, 99, 100, 101, 120, 300) for k in range(300)]
    df = spark.createDataFrame([(i, t, s) for i, (_, t, s) in enumerate(data)], SCHEMA)
    out = line_dedup.remove_boilerplate(df, "doc_id", "text", "source", sites=100)
    assert {r.text for r in out.select("text").distinct().collect()} == {"", "w95", "w99"}


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mixing.mix_sources(df, "doc_id", "source", "text").collect() == []
    assert line_dedup.remove_boilerplate(df, "doc_id", "text", "source").collect() == []


def test_clashing_columns_of_line_dedup(spark):
    df = spark.createDataFrame([(1, "a", "s", 1)], SCHEMA + ", n_lines int")
    assert line_dedup.remove_boilerplate(df, "doc_id", "text", "source").columns == ["doc_id", "text", "source", "n_lines_input", "n_lines", "n_removed"]


def test_line_dedup_is_linear_in_lines(spark):
    """One text of 400,000 lines, half of which go, among sites that share them."""
    import time

    shared = [f"shared {k}" for k in range(2000)]
    long = "\n".join(x for k in range(200_000) for x in (shared[k % 2000], f"own {k}"))
    data = [(k, "\n".join(shared), f"s{k}") for k in range(12)] + [(99, long, "log")]
    started = time.time()
    rows = {r.doc_id: r for r in line_dedup.remove_boilerplate(spark.createDataFrame(data, SCHEMA), "doc_id", "text", "source").collect()}
    assert time.time() - started < 60
    assert (rows[99].n_lines, rows[99].n_removed) == (400_000, 200_000)
    assert rows[99].text == "\n".join(f"own {k}" for k in range(200_000))


def test_line_dedup_of_rows_that_share_a_key(spark):
    common = [f"site {k}" for k in range(12)]
    data = [(7, "menu\nfirst", s) for s in common] + [(7, "second\nmenu", "x"), (None, "menu\nthird\nmenu", "y"), (None, "menu\nthird\nmenu", "y")]
    rows = line_dedup.remove_boilerplate(spark.createDataFrame(data, SCHEMA), "doc_id", "text", "source").collect()
    assert sorted(r.text for r in rows) == [""] * 12 + ["second", "third", "third"]

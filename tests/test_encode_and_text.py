import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from conftest import rows
from pyspark.ml.feature import StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tablewright.functions import vectors, words
from tablewright.operators import encode, text


def test_ten_values_are_indicators_eleven_are_codes(spark):
    df = spark.range(44).select((F.col("id") % 10).alias("ten"), (F.col("id") % 11).alias("eleven"), F.when(F.col("id") > 0, F.lit("a")).alias("one"))
    out = encode.encode_categorical(df, ["ten", "eleven", "one"])
    assert [c for c in out.columns if c.startswith("ten_")] == [f"ten_{i}" for i in range(10)]
    assert "eleven_label" in out.columns and "ten_label" not in out.columns
    assert rows(out.filter("one is null"), "one_a") == [(False,)]


def test_unseen_and_null_categories(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    test = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    coded = encode.OrdinalEncoder(["c"]).fit(train).transform(test)
    assert rows(coded) == sorted([("a", 0), ("z", -1), (None, -1)], key=repr)
    hot = encode.CategoricalEncoder(["c"]).fit(train).transform(test)
    assert rows(hot) == sorted([("a", True, False), ("z", False, False), (None, False, False)], key=repr)


@pytest.mark.parametrize("limit", [10**6, 300, 50])
def test_all_dictionary_paths_agree(spark, limit):
    # 290 values: an array up to 256, a shipped table up to the limit, a sorted table beyond it.
    df = spark.range(2000).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("v"), F.col("id") % 290)).alias("c"))
    out = encode.CategoricalEncoder(["c"], limit=limit).fit(df).transform(df)
    values = sorted({f"v{i % 290}" for i in range(2000) if i % 7})
    want = {i: values.index(f"v{i % 290}") if i % 7 else -1 for i in range(2000)}
    assert {r["id"]: r["c_label"] for r in out.collect()} == want


def test_missing_column_raises_or_is_skipped(spark):
    df = spark.createDataFrame([("a",)], "c string")
    with pytest.raises(ValueError):
        encode.encode_categorical(df, ["c", "zz"])
    assert "c_a" in encode.encode_categorical(df, ["c", "zz"], on_error="skip").columns
    with pytest.raises(ValueError):
        encode.convert_datetime(df, ["zz"])
    assert encode.convert_datetime(df, ["zz"], on_error="skip").columns == ["c"]


def test_indices_by_frequency(spark):
    df = spark.createDataFrame([("b",), ("b",), ("a",), ("c",)], "c string")
    out, features = encode.encode_categorical_ml(df, ["c"])
    assert features == ["c_ohe"]
    assert dict(rows(out.select("c", "c_index").distinct())) == {"b": 0.0, "a": 1.0, "c": 2.0}


def test_labels_come_back(spark):
    df = spark.createDataFrame([("x",), ("a",)], "c string")
    coded, names = encode.label_index(df, "c", "y")
    assert names == ["a", "x"]
    assert rows(encode.label_inverse(coded, "y", "back", names), "back") == [("a",), ("x",)]


def test_date_parts(spark):
    df = spark.createDataFrame([("02 28, 2014", 1393545600, 1393545600.5), (None, None, None)], "t string, n long, f double")
    out = encode.convert_datetime(df, ["t", "n", "f"]).collect()
    for c in "tnf":
        assert (out[0][f"{c}_year"], out[0][f"{c}_month"], out[0][f"{c}_day"], out[0][f"{c}_weekday"]) == (2014, 2, 28, 4)
        assert math.isclose(out[0][f"{c}_weekday_sin"], math.sin(2 * math.pi * 4 / 7))
        assert out[1][f"{c}_year"] is None


def test_zero_dates_are_dropped_only_if_there_are_rows(spark):
    columns = ", ".join(f"a_{p} int" for p in ("year", "month", "day", "weekday", "weekday_sin", "weekday_cos"))
    zero = spark.createDataFrame([(0, 0, 0, 5, 1, 1)], columns)
    assert encode.drop_zero_datetime(zero, "a").columns == []
    assert len(encode.drop_zero_datetime(zero.limit(0), "a").columns) == 6


def test_constant_column_is_scaled_by_one(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, y double")
    out = encode.StandardScaler(["x", "y"]).fit(df).transform(df)
    assert rows(out, "x_scaled", "y_scaled") == sorted([(-1.0, 0.0), (1.0, 0.0)], key=repr)


def test_stop_words_are_those_of_spark(spark):
    assert words.STOPWORDS == StopWordsRemover.loadDefaultStopWords("english")


def test_word_functions(spark):
    df = spark.createDataFrame([("The cat, the Hat!",), ("",), ("  ",), ("a b été_1 x",), (None,)], "t string")
    c = F.col("t")
    kept = words.remove_stopwords(words.tokenize(c))
    got = [
        tuple(r)
        for r in df.select(
            words.word_count(c), words.more_words_than(c, 3), words.terms(c), words.tokenize(c), words.ngrams(kept, 2),
            words.ngrams(words.tokenize(c), 3),
        ).collect()
    ]
    assert got[0] == (4, True, ["the", "cat", "the", "hat"], ["the", "cat", "the", "hat"], ["cat hat"], ["the cat the", "cat the hat"])
    assert got[1][:1] + got[1][2:] == (0, [], [], [], [])
    assert got[2][:3] == (0, False, [])
    assert got[3][:3] == (4, True, ["été_1"])
    assert got[4][0] == 0 and got[4][2] is None


def test_term_weights(spark):
    df = spark.createDataFrame([(1, "apple apple pear"), (2, "pear plum"), (3, ""), (4, None)], "id int, t string")
    got = {(r["id"], r["term"]): r["weight"] for r in text.tfidf_terms(df, "id", "t").collect()}
    idf = lambda d: math.log(5 / (1 + d)) + 1
    a, b = 2 * idf(1), idf(2)
    assert math.isclose(got[1, "apple"], a / math.hypot(a, b)) and math.isclose(got[1, "pear"], b / math.hypot(a, b))
    top = {r["term"] for r in text.tfidf_terms(df, "id", "t", 1).collect()}
    assert top == {"apple"}  # two each: the alphabet decides
    for size in (None, 3):
        out = text.TfidfVectorizer("t", size).fit(df).transform(df).select("id", vector_to_array("t_tfidf").alias("v"))
        values = {r["id"]: sorted(x for x in r["v"] if x) for r in out.collect()}
        assert np.allclose(values[1], sorted([a / math.hypot(a, b), b / math.hypot(a, b)])) and values[3] == values[4] == []


def test_two_text_columns_at_once(spark):
    df = spark.createDataFrame([("red fox runs", "big house here"), ("red fox", None)], "a string, b string")
    out, features = text.text_tfidf_hash(df, ["a", "b"])
    assert out.columns == ["a", "b", "a_tfidfFeatures", "b_tfidfFeatures"] == ["a", "b", *features]


def test_vector_statistics(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 10.0],), ([4.0],), ([1.0, 5.0, 3.0],)], "v array<float>")
    for r in df.select("v", *[x.alias(k) for k, x in vectors.stats(F.col("v")).items()]).collect():
        v = np.array(r["v"])
        want = [v.mean(), v.max(), v.min(), v.std(), np.median(v), np.linalg.norm(v)]
        assert np.allclose([r[k] for k in vectors.STATS], want)


def test_components_match_a_decomposition(spark):
    rng = np.random.default_rng(0)
    data = (rng.normal(size=(200, 6)) @ rng.normal(size=(6, 6)) + 3).astype("float32")
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(data)], "id int, v array<float>")
    model = text.PcaReducer("v", "p", k=4).fit(df)
    got = np.array([list(r)[2:] for r in model.transform(df).orderBy("id").collect()])
    centred = data - data.mean(axis=0)
    axes = np.linalg.svd(centred, full_matrices=False)[2][:4]
    want = centred @ axes.T
    assert model.features == ["p_PC1", "p_PC2", "p_PC3", "p_PC4"]
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-3)
    with pytest.raises(ValueError):
        text.PcaReducer("v", k=4).fit(df.limit(3))


def test_any_sentence_model_can_be_plugged_in(spark):
    def load():
        return lambda texts: np.array([[len(t), t.count("a")] for t in texts])

    df = spark.createDataFrame([("banana",), (None,)], "t string")
    out = text.embed_text(df, "t", text.model_embedder(load))
    assert [r["t_embedding"] for r in out.collect()] == [[6.0, 3.0], [0.0, 0.0]]


def test_text_features_skip_what_fails(spark):
    df = spark.createDataFrame([(i, f"word{i} thing{i % 3}", "same") for i in range(30)], "id int, a string, b string")
    out = text.extract_text_features(df, ["a"], k=5, size=16)
    assert [c for c in out.columns if c.startswith("a_")] == [f"a_PC{i}" for i in range(1, 6)] + [f"a_embedding_{s}" for s in vectors.STATS]
    assert text.extract_text_features(df.limit(3), ["a"], k=5, size=16, on_error="skip").columns == ["id", "a", "b"]
    with pytest.raises(ValueError):
        text.extract_text_features(df.limit(3), ["a"], k=5, size=16)


def test_no_term_is_lost_from_a_large_vocabulary(spark):
    df = spark.range(300).select("id", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: F.concat(F.lit("w"), (F.col("id") * 1000 + i).cast("string"))), " ").alias("t"))
    model = text.TfidfVectorizer("t").fit(df)
    assert len(model.stages.stages[0].vocabulary) == 300_000 > 1 << 18
    width = F.udf(lambda v: int(v.size) * 1000 + int((v.values > 0).sum()) % 1000, "bigint")
    assert {r[0] for r in model.transform(df.limit(3)).select(width("t_tfidf")).collect()} == {300_000_000}


def test_weights_agree_whether_the_vocabulary_is_shipped_or_joined(spark, monkeypatch):
    df = spark.createDataFrame([(1, "aa bb bb cc"), (2, "bb dd"), (3, ""), (4, None), (5, "ee ee ee")], "id long, t string")
    weigh = lambda size: {(r.id, r.term): round(r.weight, 12) for r in text.tfidf_terms(df, "id", "t", size).collect()}
    shipped = weigh(None), weigh(2)
    plan = text.tfidf_terms(df, "id", "t")._jdf.queryExecution().toString()
    monkeypatch.setattr(text, "SHIPPED_TERMS", 0)
    assert (weigh(None), weigh(2)) == shipped
    assert "Exchange" not in plan
    with pytest.raises(ValueError, match="too large"):
        text.TfidfVectorizer("t").fit(df)


def test_term_counts_in_the_row(spark):
    df = spark.createDataFrame([(1, "bb aa bb"), (2, ""), (3, None), (4, "zz")], "id long, t string")
    got = {r.id: (r.terms, r.tfs) for r in text.row_term_counts(df, "id", "t").collect()}
    assert got == {1: (["aa", "bb"], [1, 2]), 2: ([], []), 3: ([], []), 4: (["zz"], [1])}


@pytest.mark.parametrize("limit", [100_000, 3])
def test_indicators_as_one_vector(spark, limit):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("d",), ("c",), ("b",)], "c string")
    model = encode.IndicatorVector("c", limit).fit(df)
    other = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("zz",), (None,)], "c string")
    got = {r["c"]: r["v"] for r in model.transform(other).select("c", vector_to_array("c_vector").alias("v")).collect()}
    unit = lambda k: [float(k == i) for i in range(4)]
    assert got == {"a": unit(0), "b": unit(1), "c": unit(2), "d": unit(3), "zz": unit(9), None: unit(9)}


def test_indicators_of_very_many_values(spark):
    df = spark.range(150_000).select(F.format_string("v%06d", "id").alias("c"))
    model = encode.IndicatorVector("c").fit(df)
    assert model.width == 150_000 and model.codes.tables
    place = F.udf(lambda v: int(v.indices[0]) if v.values.sum() == 1 and v.size == 150_000 else -1, "bigint")
    some = df.filter(F.col("c").isin("v000000", "v077777", "v149999"))
    assert {r.c: r.p for r in model.transform(some).select("c", place("c_vector").alias("p")).collect()} == {"v000000": 0, "v077777": 77_777, "v149999": 149_999}
    with pytest.raises(ValueError, match="IndicatorVector"):
        encode.one_hot(df, ["c"])
    assert encode.one_hot(df.limit(3), ["c"]).columns[0] == "c"


def test_frequency_indices_of_many_values_agree_with_the_indexer(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), ("c",), (None,), ("d",)], "c string")
    shipped, joined = (encode.encode_categorical_ml(df, ["c"], limit) for limit in (100, 2))
    assert sorted((r.c or "", r.c_index) for r in joined[0].collect()) == sorted((r.c or "", r.c_index) for r in shipped[0].collect())
    with pytest.raises(ValueError, match="classes"):
        encode.label_index(df, "c", "label", limit=2)


def test_vectors_of_a_vocabulary_beyond_the_bound(spark, monkeypatch):
    """Joined vectors agree with the long form; hot terms travel or, beyond the bound again, are salted."""
    rows = [(k, f"every row {'often ' * (k % 3)}word{k} word{k % 40}" if k % 10 else ["", None][k % 20 // 10]) for k in range(200)] + [(7, "every row")]
    df = spark.createDataFrame(rows, "id long, t string").repartition(3)
    usual = text.TfidfVectorizer("t").fit(df)
    want = sorted((r.id, sorted(round(float(x), 9) for x in r.t_tfidf.values)) for r in usual.transform(df).collect())
    for terms in (3, 0):
        monkeypatch.setattr(text, "SHIPPED_TERMS", terms)
        model = text.TfidfVectorizer("t").fit(df)
        assert isinstance(model, text.JoinedTfidfModel)
        out = model.transform(df)
        got = out.collect()
        assert out.columns == ["id", "t", "t_tfidf"]
        assert sorted((r.id, sorted(round(float(x), 9) for x in r.t_tfidf.values)) for r in got) == want
        assert {r.t_tfidf.size for r in got} == {model.size}


def test_terms_are_weighed_in_slices_of_a_batch():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([["a"] * 3, [], ["b"] * 9, ["c"], None, ["d"] * 2])], names=["key", "terms"])
    first, second = text._slices(batch, 4)
    assert first.column(0).to_pylist() + second.column(0).to_pylist() == list(range(6))
    assert [part.column(1).flatten().to_pylist() for part in (first, second)] == [["a"] * 3 + ["b"] * 9, ["c", "d", "d"]]
    assert pc.list_parent_indices(second.column(1)).to_pylist() == [0, 2, 2]


def test_weights_of_a_joined_vocabulary_take_one_look_at_each_pair(spark, monkeypatch):
    """Frequent terms are weighed in the row; a row's length is not summed anew for each of its terms."""
    long = " ".join(f"w{i}" for i in range(3000))
    df = spark.createDataFrame([(1, long + " aa aa bb"), (2, "aa bb cc"), (3, ""), (4, None), (5, "cc cc aa")], "id long, t string")
    weigh = lambda: {(r.id, r.term): round(r.weight, 12) for r in text.tfidf_terms(df, "id", "t").collect()}
    shipped = weigh()
    for terms in (0, 2, 100):
        monkeypatch.setattr(text, "SHIPPED_TERMS", terms)
        assert weigh() == shipped
        assert "Window" not in text.tfidf_terms(df, "id", "t")._jdf.queryExecution().toString()
        out = text.TfidfVectorizer("t").fit(df).transform(df)
        assert "aggregate(" not in out._jdf.queryExecution().optimizedPlan().toString()
        assert out.columns == ["id", "t", "t_tfidf"]
        got = {r.id: sorted(round(float(x), 12) for x in r.t_tfidf.values) for r in out.collect()}
        assert got == {i: sorted(w for (of, _), w in shipped.items() if of == i) for i in range(1, 6)}
    monkeypatch.setattr(text, "SHIPPED_TERMS", 2)
    frequent, others = text._parted(text.vocabulary(text.term_counts(df, "id", "t"), 5).select("term", "idf"))
    assert {r.term for r in frequent.collect()} == {"aa"} and others.count() == 3002


def test_text_features_read_each_text_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(n):
        read.add(1)
        return f"word{n % 7} of row{n}"

    df = spark.range(40).select("id", counted(F.col("id")).alias("a"))
    out = text.extract_text_features(df, ["a"], k=5, size=16)
    assert out.count() == 40 and out.columns[:3] == ["id", "a", "a_PC1"]
    assert read.value == 40

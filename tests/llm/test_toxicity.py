"""Positive-unlabelled learning: held-out accuracy, and the risk it minimises."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tablewright.llm import toxicity as X
from tablewright.llm.queries import held_out

INSULTS = ["vile", "brute", "fool", "swine"]


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]
    rows = []
    for k in range(n):
        toxic = rng.random() < 0.2
        text = rng.choices(words, k=rng.randint(20, 120))
        if toxic:
            for _ in range(max(2, len(text) // 20)):
                text.insert(rng.randrange(len(text)), rng.choice(INSULTS) + rng.choice(["", "s", "ish"]))
        rows.append((k, " ".join(text), int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(1500)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    # A third of the labels are absent, as in an unlabelled corpus.
    labels = spark.createDataFrame([(k, t) for k, _, t in rows if k % 3], "doc_id long, toxic int")
    model = X.fit_classifier(docs, labels, "doc_id", "text", "toxic", ~held_out())
    scored = X.score_toxicity(docs, "text", model, ["doc_id"]).filter(held_out()).collect()
    truth = {k: t for k, _, t in rows}
    right = np.mean([(r.score >= 0.3) == bool(truth[r.doc_id]) for r in scored])
    assert right > 0.95


def test_labels_of_the_held_out_fold_change_nothing(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, t) for k, _, t in rows], "doc_id long, toxic int")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = (X.fit_classifier(docs, x, "doc_id", "text", "toxic", ~held_out()) for x in (labels, turned))
    assert a.bias == b.bias and (a.weights == b.weights).all()


def test_nulls_empty_long_and_repeated_rows(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([(k, t, "x") for k, t, _ in rows] + [(900, None, "x"), (901, "", "x"), (902, "vile brutes foolish swine " * 10_000, "x"), (5, rows[5][1], "x"), (None, "vile fool", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, t) for k, _, t in rows] + [(0, 1), (0, 0), (None, 1), (1, None)], "doc_id long, toxic int")
    model = X.fit_classifier(docs, labels, "doc_id", "text", "toxic", ~held_out())
    got = {}
    for r in X.score_toxicity(docs, "text", model, ["doc_id"]).collect():
        got.setdefault(r.doc_id, set()).add(r.score)
    base = 1 / (1 + np.exp(-model.bias))
    assert got[900] == got[901] and np.allclose(list(got[900]), base)
    assert max(got[902]) > 0.5 and len(got[5]) == 1 and None in got
    assert all(0 <= s <= 1 for scores in got.values() for s in scores)


def test_no_toxic_example_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = X.fit_classifier(docs, none, "doc_id", "text", "toxic", ~held_out())
    assert X.score_toxicity(docs, "text", model, ["doc_id"]).first().score < 1e-10
    assert X.score_toxicity(docs.limit(0), "text", model, ["doc_id"]).collect() == []


def test_features_are_shares_of_words():
    index, owner, value = X.features(pa.array(["abc abc de", "", "xyzxyzxyz"], pa.large_string()))
    assert set(owner.tolist()) == {0, 2} and value.max() == pytest.approx(X.MOST * X.SCALE)
    long = pa.array(["rare " + "word " * 999], pa.large_string())
    assert X.features(long)[2].min() == pytest.approx(0.001 * X.SCALE)
    assert len({(i, o) for i, o in zip(index, owner, strict=True)}) == index.size


def test_many_insults_each_in_few_toxic_texts():
    """200 insults, each in about one of a hundred toxic texts."""
    rng = random.Random(6)
    word = lambda letters: "".join(rng.choices(letters, k=rng.randint(5, 9)))
    clean, insults = [word("abcdefgh") for _ in range(400)], [word("klmnopqrst") for _ in range(200)]

    def texts(n, toxic):
        out = []
        for _ in range(n):
            text = rng.choices(clean, k=rng.randint(20, 60))
            for insult in rng.choices(insults, k=2 if toxic else 0):
                text.insert(rng.randrange(len(text)), insult)
            out.append(" ".join(text))
        return out

    sample = [pa.array(x, pa.large_string()) for x in (texts(2000, True), texts(800, True) + texts(3200, False))]
    held = [sum(insult in text for text in sample[0].to_pylist()) / 2000 for insult in insults]
    assert np.mean(held) < 0.015 and max(held) < 0.03
    model = X.train(*sample, prior=0.2)
    scores = model.scores(pa.array(texts(200, True) + texts(800, False), pa.large_string()))
    assert (scores[:200] >= 0.3).mean() > 0.8 and (scores[200:] < 0.3).mean() > 0.9


def test_scores_do_not_depend_on_blocks():
    model = X.train(*[pa.array([t for _, t, x in corpus(200) if x == y or not y], pa.large_string()) for y in (1, 0)], prior=0.2)
    texts = pa.array([t for _, t, _ in corpus(50, 3)], pa.large_string())
    whole = model.scores(texts)
    single = np.concatenate([model.scores(texts.slice(k, 1)) for k in range(len(texts))])
    assert np.allclose(whole, single)


def test_slope_of_the_risk():
    """The gradient against differences of the risk, on both sides of the kink."""
    from tablewright.llm.toxicity import risk, slope

    rng = np.random.default_rng(3)
    for shift in (0.0, -6.0):
        z, n = rng.normal(size=30), 10
        z[n:] += shift
        first, second = risk(z, n, 0.4)
        back_up = second < 0
        got = slope(z, n, 0.4)
        for k in range(z.size):
            moved = z.copy()
            moved[k] += 1e-6
            a, b = risk(moved, n, 0.4)
            want = (second - b) / 1e-6 if back_up else (a + b - first - second) / 1e-6
            assert abs(got[k] - want) < 1e-5
    assert back_up


def test_memory_of_training_with_long_texts():
    import tracemalloc

    rng = np.random.default_rng(4)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(20_000)]
    long = pa.array([" ".join(vocabulary[int(20_000 * x**3)] for x in rng.random(3500))[:20_000] for _ in range(800)], pa.large_string())
    tracemalloc.start()
    X.train(long.slice(0, 250), long.slice(250), 0.2, steps=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250e6


def test_sample_is_bounded_in_bytes(spark):
    from tablewright.llm.common import sample_texts

    df = spark.range(9000).selectExpr("id AS doc_id", "concat(cast(id AS string), repeat('word text ', 2000)) AS text")
    texts = sample_texts(df, "doc_id", "text", 9000, 3 << 20)
    assert 100 < len(texts) and sum(len(t.as_py()) for t in texts) <= 3 << 20
    assert texts == sample_texts(df.repartition(7), "doc_id", "text", 9000, 3 << 20)


def test_empty_table_and_clashing_names(spark):
    model = X.Classifier(np.zeros(1 << X.BITS), -1.0)
    df = spark.createDataFrame([(1, "a", 5.0)], "doc_id long, text string, score double")
    (row,) = X.score_toxicity(df, "text", model, ["doc_id", "score"]).collect()
    assert row.score_input == 5.0 and 0 < row.score < 1
    assert X.score_toxicity(df.limit(0), "text", model, ["doc_id"]).collect() == []


def test_the_driver_does_not_train(spark, monkeypatch):
    rows = corpus(300)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, t) for k, _, t in rows], "doc_id long, toxic int")
    here = X.train(*(pa.array([t for _, _, t in sorted(docs.filter(f).selectExpr("xxhash64(doc_id, text)", "doc_id", "text").collect(), key=lambda r: r[0])], pa.large_string()) for f in (f"doc_id IN ({','.join(str(k) for k, _, t in rows if t)})", "true")), prior=sum(t for _, _, t in rows) / len(rows))
    monkeypatch.setattr(X, "Matrix", None)  # of this process; tasks import their own
    there = X.fit_classifier(docs, labels, "doc_id", "text", "toxic", X.F.lit(True))
    assert there.bias == here.bias and (there.weights == here.weights).all() and here.used.any()

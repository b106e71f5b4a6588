"""Near duplicates against a comparison of all pairs, and the components below them."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tablewright.llm import jaccard_join as J
from tablewright.llm.components import components


def brute(rows, threshold=J.THRESHOLD):
    """{(key, text): (class, links)} by comparing every pair of rows."""
    sets = [set(s.tolist()) for s in J.shingle_sets(pa.array([t or "" for _, t in rows], pa.large_string()))]
    n = len(rows)
    usable = [bool(s) and k is not None for (k, _), s in zip(rows, sets, strict=True)]
    root, links = list(range(n)), [0] * n
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(n):
        for j in range(i):
            if usable[i] and usable[j] and len(sets[i] & sets[j]) * 1000 >= len(sets[i] | sets[j]) * round(threshold * 1000):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i in range(n):
        if usable[i]:
            least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted(((k, least.get(find(i), k) if usable[i] else k, links[i]) for i, (k, _) in enumerate(rows)), key=repr)


def corpus(seed, groups=12, copies=8, alone=60):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(2000)]
    licence = " ".join(rng.choices(words, k=20))
    texts = [" ".join(rng.choices(words, k=rng.randint(6, 200))) + rng.choice(["", " " + licence]) for _ in range(alone)]
    for _ in range(groups):
        base = rng.choices(words, k=rng.randint(30, 300))
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, len(base) // 25)):
                text[rng.randrange(len(text))] = rng.choice(words)
            texts.append(" ".join(text))
    texts += ["", "a b", "A  b!", "one", None, licence, licence.upper()]
    rng.shuffle(texts)
    return [(k * 2, t) for k, t in enumerate(texts)]


def run(spark, rows, extra=""):
    df = spark.createDataFrame(rows, "doc_id long, text string" + extra)
    return sorted(map(tuple, J.near_duplicates(df, "doc_id", "text").collect()), key=repr)


def test_against_all_pairs(spark):
    rows = corpus(1)
    assert run(spark, rows) == brute(rows)


def test_deep_splits_blocks_and_shuffled_texts(spark, monkeypatch):
    for name, value in (("BUCKET", 3), ("BLOCK_SETS", 4), ("BLOCK_SHINGLES", 500), ("KEYS", 5)):
        monkeypatch.setattr(J, name, value)
    rows = corpus(2, groups=4, copies=30, alone=20)
    assert run(spark, rows) == brute(rows)


def test_repeated_rows_null_keys_and_extra_columns(spark):
    text = "one two three four five six seven eight"
    rows = [(1, text), (1, text), (2, text.upper()), (None, text), (3, "other words stand here all alone"), (3, text)]
    got = run(spark, [(*r, "x", 1) for r in rows], ", id string, class_id int")
    assert got == brute(rows)


def test_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, "")]) == [(1, 1, 0), (2, 2, 0)]


def test_one_of_each_class_stays(spark):
    rows = corpus(3, groups=5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in J.keep_one(df, "doc_id", "text").collect())
    assert kept == sorted(k for k, c, _ in brute(rows) if k == c)
    again = spark.createDataFrame([*rows, rows[0], rows[0], (None, rows[0][1])], "doc_id long, text string")
    assert sorted((r.doc_id for r in J.keep_one(again, "doc_id", "text").collect()), key=repr) == sorted([*kept, None], key=repr)


def test_long_texts(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(30_000)]
    near = list(base)
    near[15_000] = "changed"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base[:12_000]))]
    assert run(spark, rows) == brute(rows)


def test_pairs_at_the_threshold(spark):
    shared = [f"s{k}" for k in range(84)]  # 80 shingles
    rows = [(1, " ".join(shared)), (2, " ".join(shared + [f"x{k}" for k in range(20)])), (3, " ".join(shared + [f"y{k}" for k in range(21)]))]
    assert run(spark, rows) == [(1, 1, 1), (2, 1, 1), (3, 3, 0)] == brute(rows)


def test_similar_is_exact():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(30, 300))) for _ in range(50)]
    got = J.similar(sets, 0.8)
    want = [[len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8 for b in sets] for a in sets]
    assert (got == np.array(want)).all()


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 62, 500).astype(np.uint64)
    b = np.concatenate([a[:445], rng.integers(0, 1 << 62, 55).astype(np.uint64)])  # 0.8
    agree = np.mean([np.mean(J.signature(a + np.uint64(k)) == J.signature(b + np.uint64(k))) for k in range(40)])
    assert abs(agree - 445 / 555) < 0.04


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(5, 5), (200, 201), (201, 200)]
    root = {}
    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_of_stars_take_one_round(spark):
    edges = spark.range(400).selectExpr("id AS a", "id % 40 AS b")
    spark.sparkContext.setJobGroup("stars", "")
    try:
        found = components(edges)
    finally:
        spark.sparkContext.setJobGroup("", "")
    tracker = spark.sparkContext.statusTracker()
    ran = [i for j in tracker.getJobIdsForGroup("stars") for s in tracker.getJobInfo(j).stageIds if (i := tracker.getStageInfo(s)) and i.numCompletedTasks]
    assert {(r.node, r.root) for r in found.collect()} == {(k, k % 40) for k in range(400)}
    assert len(ran) <= 11

"""Nearest neighbours against brute force."""

import numpy as np
from pyspark.sql import functions as F

from tablewright.llm import neighbours as N


def brute(rows, k, is_query):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in ok:
        if is_query(i):
            scores = sorted((-(w @ v) / (np.linalg.norm(w) * np.linalg.norm(v)), j) for j, w in ok if j != i)
            out[i] = [(j, -s) for s, j in scores[:k]]
    return out


def search(spark, rows, k=5, extra=""):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>" + extra)
    found = {}
    for r in N.nearest(df, "vec_id", "embedding", F.col("vec_id") % 10 == 0, k).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: [(i, s) for _, i, s in sorted(x)] for q, x in found.items()}


def recall(got, want):
    return sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))


def test_recall_on_isotropic_and_clustered_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 24))
    for vectors in (rng.normal(size=(1500, 24)), centres[rng.integers(0, 20, 1500)] + 0.1 * rng.normal(size=(1500, 24))):
        rows = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(vectors)]
        got, want = search(spark, rows), brute(rows, 5, lambda i: i % 10 == 0)
        assert got.keys() == want.keys() and recall(got, want) >= 0.9
        exact = {(q, j): s for q, x in brute(rows, 1500, lambda i: i % 10 == 0).items() for j, s in x}
        assert all(abs(exact[q, j] - s) < 1e-12 for q, x in got.items() for j, s in x)


def test_ties_go_to_smaller_ids_and_copies_are_not_cut(spark):
    rows = [(k, [1.0, 2.0]) for k in range(400)] + [(1000, [2.0, 1.0])]
    got = search(spark, rows)
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5] and [i for i, _ in got[10]] == [0, 1, 2, 3, 4]
    assert got[1000][0][0] == 0


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 1.0, 1.0]), (8, []), (10, [0.0, 0.0]), (None, [1.0, 0.0])]
    assert {q: [i for i, _ in x] for q, x in search(spark, rows).items()} == {0: [1]}


def test_empty_and_lonely_tables(spark):
    assert search(spark, []) == {}
    assert search(spark, [(0, [1.0, 2.0])]) == {}
    assert search(spark, [(3, [1.0, 2.0]), (4, [2.0, 1.0])]) == {}


def test_repeated_rows_and_extra_columns(spark):
    rows = [(0, [1.0, 0.0], 1, 2.0), (0, [1.0, 0.0], 1, 2.0), (1, [1.0, 0.5], 1, 2.0), (1, [1.0, 0.5], 1, 2.0), (2, [0.0, 1.0], 1, 2.0)]
    got = search(spark, rows, extra=", rank int, score double")
    assert [i for i, _ in got[0]] == [1, 1, 2]


def test_queries_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "QUERY_BLOCK", 7)
    monkeypatch.setattr(N, "SHARD_ROWS", 100)
    rng = np.random.default_rng(2)
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(rng.normal(size=(300, 8)))]
    got, want = search(spark, rows), brute(rows, 5, lambda i: i % 10 == 0)
    assert got.keys() == want.keys() and recall(got, want) >= 0.9


def test_candidates_share_the_longest_prefixes():
    rng = np.random.default_rng(3)
    unit = rng.normal(size=(200, 6))
    forest = N.Forest(unit, np.zeros(6), N.directions(6))
    query = rng.normal(size=(1, 6))
    keys, asked = N.strings_of(unit, forest.centre, forest.planes), N.strings_of(query, forest.centre, forest.planes)
    differ = keys ^ asked
    shared = np.array([[N.LENGTH - int(x).bit_length() for x in row] for row in differ]).max(1)
    mark = next(forest.candidates(query, 20))
    least = shared[mark].min()
    assert mark.sum() >= 20 and (mark == (shared >= least)).all() and (shared > least).sum() < 20

"""Repeated byte strings against a brute-force scan of all windows."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tablewright.llm import suffix_dedup as S

SCHEMA = "doc_id long, text string"


def brute(rows):
    """(id, bytes, removed, spans, digest) for rows in order of id."""
    seen, out = set(), []
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, int)
        for s in range(len(data) - S.LENGTH + 1):
            w = data[s : s + S.LENGTH]
            if w in seen:
                gone[s] += 1
                gone[s + S.LENGTH] -= 1
            seen.add(w)
        flags = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(data, np.uint8)[~flags])
        spans = int((np.diff(np.concatenate([[0], flags.astype(int)])) == 1).sum())
        out.append((key, len(data), int(flags.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r) for r in S.dedupe_substrings(df, "doc_id", "text").collect()), key=repr)


def corpus(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéü ") for _ in range(rng.randint(1, 9)))
    passages = ["".join(word() + " " for _ in range(rng.randint(10, 60))) for _ in range(6)]
    rows = []
    for k in range(n):
        text = "".join(word() + " " for _ in range(rng.randint(0, 80)))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a, b = sorted((rng.randint(0, len(p)), rng.randint(0, len(p))))
            at = rng.randint(0, len(text))
            text = text[:at] + p[a:b] + text[at:]
        if rows and rng.random() < 0.2:
            other = list(rng.choice(rows)[1])
            for _ in range(rng.randint(0, 3)):
                if other:
                    other[rng.randrange(len(other))] = rng.choice("xyz")
            text = "".join(other)
        rows.append((k * 3, text))
    return rows


def test_random_passages_and_near_copies(spark):
    rows = corpus(1)
    assert run(spark, rows) == brute(rows)


def test_hot_anchors_are_dealt_over_parts(spark, monkeypatch):
    monkeypatch.setattr(S, "PART", 3)
    monkeypatch.setattr(S, "TOGETHER", 10)
    rows = corpus(2)
    assert run(spark, rows) == brute(rows)


def test_records_in_small_batches_and_partitions(spark):
    rows = corpus(3, 60)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert run(spark, rows) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_periodic_long_empty_and_null_texts(spark):
    rows = [(1, "a" * 1000), (2, "ab" * 300), (3, None), (4, ""), (5, "x" * 99), (6, "a" * 99), (7, "a" * 100), (8, "ab" * 50 + "q"), (9, "é" * 200)]
    assert run(spark, rows) == brute(rows)


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 700)
    monkeypatch.setattr(S.blocks, "__defaults__", (500,))
    rng = random.Random(4)
    base = "".join(rng.choice("abcdef ") for _ in range(3000))
    rows = [(1, base), (2, base[500:2500]), (3, "z" + base + base[:300])]
    assert run(spark, rows) == brute(rows)


def test_repeated_and_null_keys(spark):
    t = "".join(random.Random(5).choices("abcdefgh ", k=400))
    got = run(spark, [(1, t), (1, t), (None, t), (2, t)])
    assert [r[:4] for r in got] == sorted([(1, 400, 0, 0), (1, 400, 0, 0), (None, 400, 400, 1), (2, 400, 400, 1)], key=repr)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_extra_columns_do_not_matter(spark):
    t = "k" * 150
    df = spark.createDataFrame([(1, t, "x", 2), (2, t, "y", 3)], "doc_id long, text string, anchor string, doc long")
    assert {r["doc_id"]: r["n_removed"] for r in S.dedupe_substrings(df, "doc_id", "text").collect()} == {r[0]: r[2] for r in brute([(1, t), (2, t)])}


def test_intervals_of_the_prefix_tree():
    words = sorted(["banana"[k:] for k in range(6)])
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    lcp = [-1, *(common(a, b) for a, b in zip(words, words[1:], strict=False))]
    found = {(depth, words[a][:depth], b - a + 1) for depth, a, b, _ in S.prefix_intervals(lcp)}
    assert {(3, "ana", 2), (1, "a", 3), (2, "na", 2)} <= found


def test_equal_windows_share_their_anchor():
    rng = np.random.default_rng(3)
    common = rng.integers(97, 110, 150).astype(np.uint8)
    texts = [np.concatenate([rng.integers(97, 110, k).astype(np.uint8), common, rng.integers(97, 110, 40).astype(np.uint8)]) for k in (17, 80)]
    seen = []
    for t in texts:
        _, _, _, first, last, place = S.records(t, np.array([0, t.size]))
        at = {int(w): int(p) for f, b, p in zip(first, last, place, strict=True) for w in range(f, b + 1)}
        assert len(at) == t.size - S.LENGTH + 1
        offset = t.tobytes().find(common.tobytes())
        seen.append([at[offset + k] - offset - k for k in range(51)])
    assert seen[0] == seen[1]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_windows_of_contexts_against_pairs(seed):
    rng = random.Random(seed)
    seedling = bytes(rng.choice(b"ab") for _ in range(S.SEED))
    n = 40
    left = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, S.PLACES - 1))) for _ in range(n)]
    left = [x if rng.random() < 0.4 else left[0][: len(x)] for x in left]
    right = [seedling + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 3))) + b"c" * rng.randint(0, 60) for _ in range(n)]
    right = [r[: S.LENGTH] for r in right]
    group, order = np.array([k % 2 for k in range(n)]), np.array(rng.sample(range(n), n))
    place = np.argsort(group, kind="stable")
    got = np.zeros((n, S.PLACES), bool)
    got[place] = S.repeated_windows(group[place], [left[k] for k in place], [right[k] for k in place], order[place])
    for i in range(n):
        for o in range(S.PLACES):
            mine = (left[i][:o], right[i][: S.LENGTH - o])
            whole = len(mine[0]) == o and len(mine[1]) == S.LENGTH - o
            want = whole and any(group[j] == group[i] and order[j] < order[i] and len(left[j]) >= o and (left[j][:o], right[j][: S.LENGTH - o]) == mine for j in range(n))
            assert got[i, o] == want


def test_arrow_pieces_cover_all_windows(monkeypatch):
    monkeypatch.setattr(S, "PIECE", 300)
    monkeypatch.setattr(S.blocks, "__defaults__", (100,))
    text = "".join(random.Random(6).choices("abcdefgh", k=1234))
    covered = []
    for data, offsets, _, skipped in S.pieces(pa.array([text], pa.large_string())):
        _, _, _, first, last, _ = S.records(data, offsets)
        covered += [w + int(skipped[0]) for f, b in zip(first, last, strict=True) for w in range(f, b + 1)]
    assert sorted(covered) == list(range(1234 - S.LENGTH + 1))

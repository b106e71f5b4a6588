"""Benchmark leaks: planted copies of several kinds, alignment against a plain table."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tablewright.llm import decontaminate as D
from tablewright.llm.common import lower_words

RNG = random.Random(8)
WORDS = ["".join(RNG.choices("abcdefghiklmnorst", k=RNG.randint(2, 8))) for _ in range(3000)]


def prose(n, rng):
    return " ".join(rng.choices(WORDS, k=n))


def edited(text, rate, rng):
    out = []
    for w in text.split():
        x = rng.random()
        if x < rate * 0.6:
            out.append(rng.choice(WORDS))
        elif x < rate * 0.8:
            continue
        elif x < rate:
            out += [w, rng.choice(WORDS)]
        else:
            out.append(w)
    return " ".join(out)


def plain_alignment(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i, j] = max(0, table[i - 1, j - 1] + (D.EQUAL if a[i - 1] == b[j - 1] else D.DIFFERENT), table[i - 1, j] + D.GAP, table[i, j - 1] + D.GAP)
    return table.max()


@pytest.mark.parametrize("seed", range(5))
def test_alignment(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 5, rng.integers(1, 20)).astype(np.uint64), rng.integers(0, 5, rng.integers(0, 30)).astype(np.uint64)
    assert D.align(a, b)[0] == plain_alignment(a, b)


def find(spark, docs, items, extra=""):
    df = spark.createDataFrame(docs, "doc_id long, text string" + extra)
    tests = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, x.item_id): x for r in D.find_leaks(df, "text", tests, "item_id", "text").collect() for x in r.leaks}


def test_exact_and_edited_copies_are_found_and_clean_texts_left_alone(spark):
    rng = random.Random(1)
    items = [(k, prose(rng.randint(15, 50), rng)) for k in range(40)]
    docs, want = [], set()
    for k in range(200):
        text = prose(rng.randint(20, 300), rng)
        if k < 80:
            cut = text.find(" ", len(text) // 2)
            text = f"{text[:cut]}. {edited(items[k % 40][1], 0.0 if k < 40 else 0.2, rng).upper()}! {text[cut:]}"
            want.add((k, k % 40))
        docs.append((k, text))
    got = find(spark, docs, items)
    exact = {p for p in want if p[0] < 40}
    assert exact <= set(got) and all(got[p].score == 1.0 for p in exact)
    assert len(want & set(got)) >= 79 and not set(got) - want


def test_rows_and_items_of_any_kind(spark):
    rng = random.Random(2)
    item, long = prose(30, rng), prose(60_000, rng)
    items = [(1, item), (1, item), (2, item), (3, None), (4, ""), (5, "two words"), (None, item), (6, "three little words")]
    docs = [(1, None), (2, ""), (3, item), (3, item), (None, item), (4, long + " " + item), (5, "two words"), (6, "x three little words y")]
    got = find(spark, [(*d, "x") for d in docs], items, ", leaks string")
    assert set(got) == {(d, i) for d in (3, None, 4) for i in (1, 2)} | {(6, 6)}
    assert got[4, 1].last_word == 60_030 and got[4, 1].first_word == 60_000


def test_empty_tables(spark):
    assert find(spark, [], [(1, "some benchmark item here")]) == {}
    assert find(spark, [(1, "some benchmark item here")], []) == {}


def test_items_that_stay_in_spark_give_the_same(spark, monkeypatch):
    rng = random.Random(3)
    items = [(k, prose(rng.randint(3, 40), rng)) for k in range(60)] + [(7, prose(20, rng)), (None, "no id here"), (61, None), (62, "two words")]
    items += [(63, items[0][1]), (63, items[0][1])]
    docs = [(1000, None), (1001, ""), (1002, "two words"), (None, items[3][1])]
    for k in range(200):
        parts = [edited(items[rng.randrange(60)][1], rng.choice([0, 0.1, 0.3]), rng) for _ in range(rng.randint(0, 3))]
        docs.append((k, " ".join([prose(20, rng), *parts, prose(rng.randint(0, 100), rng)])))
    docs += [(2000 + k, items[9][1] + " twice " + items[9][1]) for k in range(120)]
    docs = [(*d, "x") for d in docs]
    plain = find(spark, docs, items, ", leaks string")
    monkeypatch.setattr(D, "ITEM_BLOCK", 40)
    joined = find(spark, docs, items, ", leaks string")
    assert joined == plain and len({i for _, i in plain}) > 50


def test_empty_tables_with_items_that_stay_in_spark(spark, monkeypatch):
    monkeypatch.setattr(D, "ITEM_BLOCK", 1)
    assert find(spark, [], [(1, "some benchmark item here")]) == {}
    assert find(spark, [(1, "nothing of that kind"), (2, None)], [(1, "some benchmark item here")]) == {}
    assert set(find(spark, [(1, "Some benchmark item, here")], [(1, "some benchmark item here")])) == {(1, 1)}


def test_seeds_are_rare_runs():
    h = lower_words(pa.array(["the the the the rare word the the"], pa.large_string()))[2]
    vocabulary, inverse = np.unique(h, return_inverse=True)
    shares = np.where(np.bincount(inverse) > 1, 0.1, 1e-7)
    items = D.seeded([1], [h], vocabulary, shares)
    assert sorted(items.place.tolist()) == [2, 3, 4, 5]
    assert D.seeded([1], [h[:4]], vocabulary, shares).place.size == 2


def test_an_edit_at_any_place_of_an_item_of_common_words(spark):
    rng = random.Random(4)
    common = "what is the of in and to a it was".split()
    items = [(1, "what is the capital of france"), (2, "in the end it was the gift of a stranger to the queen and it is lost")]
    docs = [(-1 - k, " ".join(rng.choices(common, k=300) + rng.choices(WORDS, k=100))) for k in range(600)]
    want = set()
    for i, text in items:
        for k in range(len(text.split())):
            copy = text.split()
            copy[k] = "zzz"
            docs.append((100 * i + k, f"{prose(20, rng)} {' '.join(copy)} {prose(20, rng)}"))
            want.add((100 * i + k, i))
    assert want <= set(find(spark, docs, items))


def test_seeds_leave_no_place_bare():
    rng = np.random.default_rng(5)
    for n in range(3, 30):
        chance = 10.0 ** rng.uniform(-12, -2, n - D.RUN + 1)
        chance[rng.integers(chance.size)] = 1e-10
        seeds = np.flatnonzero(chance <= D.seed_limit(chance, n))
        assert D.apart(seeds) == n // D.RUN and set(np.flatnonzero(chance <= D.RARE)) <= set(seeds)

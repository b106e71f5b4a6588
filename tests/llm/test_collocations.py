"""Collocations against a plain count of all phrases, and against their SQL."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tablewright.llm import collocations as co
from tablewright.llm.queries import ORACLES

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, least, longest, top):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[s : s + k])) for s in range(len(words) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in candidates.items():
        score, cut = min((2_000_000 * a // (f[lang, p[:c]] + f[lang, p[c:]]), c) for c in range(1, len(p)))
        inside = any(q[0] == lang and len(q[1]) > len(p) and 100 * b >= 80 * a and any(q[1][s : s + len(p)] == p for s in range(len(q[1]) - len(p) + 1)) for q, b in candidates.items())
        if not inside:
            out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:cut]], f[lang, p[cut:]]))
    result, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            result.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(result)


def corpus(seed, docs=150, words=7):
    rng = random.Random(seed)
    vocabulary = ["Big", "big", "data", "new", "york", "city", "é", "日本", "of", "the", "\x00x"][:words]
    fixed = ["new york city hall", "as soon as possible", "big data"]
    rows = []
    for k in range(docs):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(vocabulary) for _ in range(rng.randrange(30))]
        rows.append((k, "".join(p + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for p in parts), rng.choice(["en", "en", "de", None, ""])))
    return [*rows, (None, None, "en"), (1, "", "en"), (2, "rare words only here", "fr"), (2, "same " * 500, "en"), *rows[:10]]


@pytest.mark.parametrize("seed,least,shards", [(1, 5, 4), (2, 30, 3), (3, 2, 2), (4, 9, 1)])
def test_all_phrases_counted(spark, seed, least, shards):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = co.mine_phrases(df, "text", "lang", least=least, shards=shards, top=25)
    assert sorted(map(tuple, got.collect())) == brute(rows, least, 4, 25)


def test_sql_and_clashing_names(spark):
    rows = corpus(7, 400)
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", shard int, n long")
    got = co.mine_phrases(df, "text", "lang")
    assert sorted(map(tuple, got.collect())) == sorted(db.execute(ORACLES["op11_collocations"]).fetchall())


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert co.mine_phrases(df, "text", "lang").collect() == []


def test_full_bit_tables_change_nothing(spark, monkeypatch):
    """Where chance lets every phrase pass, more is counted and the result is the same."""
    rows = corpus(8, 60)
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(co, "bit_table", lambda rows: np.full(1 << (co.BITS - 3), 255, np.uint8) if rows.limit(1).count() else np.zeros(1 << (co.BITS - 3), np.uint8))
    assert sorted(map(tuple, co.mine_phrases(df, "text", "lang", least=6).collect())) == brute(rows, 6, 4, 2000)


def test_equal_hashes_of_pairs_are_told_apart():
    a, b = np.array([1, 2, 1, 2], np.uint64), np.array([5, 6, 5, 6], np.uint64)
    place, n = co.tally(np.zeros(4, np.uint64), a, b)
    assert sorted(zip(a[place].tolist(), b[place].tolist(), n.tolist(), strict=True)) == [(1, 5, 2), (2, 6, 2)]


def test_equal_hashes_of_words_start_afresh(spark, monkeypatch):
    """Two words with one hash are noticed in the counts; the next salt keeps them apart."""
    plain, salts = co.words_of, []

    def clashing(texts, langs):
        start, end, h, g, *rest = plain(texts, langs)
        return start, end, np.where(np.isin(end - start, [3, 5]), np.uint64(7), h), g, *rest

    scan = co._scan

    def noted(shard, tables, longest, salt):
        salts.append(salt)
        monkeypatch.setattr(co, "words_of", clashing if salt == 0 else plain)
        return scan(shard, tables, longest, salt)

    monkeypatch.setattr(co, "_scan", noted)
    rows = corpus(9, 40)
    df = spark.createDataFrame(rows, SCHEMA)
    co.mine_phrases(df, "text", "lang", least=6)
    assert 0 in salts


def test_words_that_clash_when_hashed_are_hashed_again(spark, monkeypatch):
    plain, tokenized, salts = co.words_of, co._tokenized, []

    def clashing(texts, langs):
        start, end, h, g, *rest = plain(texts, langs)
        return start, end, np.where(np.isin(end - start, [3, 5]), np.uint64(7), h), g, *rest

    def noted(rows, shards, parts, salt):
        salts.append(salt)
        monkeypatch.setattr(co, "words_of", plain if salt else clashing)
        return tokenized(rows, shards, parts, salt)

    monkeypatch.setattr(co, "_tokenized", noted)
    rows = corpus(9, 40)
    got = co.mine_phrases(spark.createDataFrame(rows, SCHEMA), "text", "lang", least=6)
    assert sorted(map(tuple, got.collect())) == brute(rows, 6, 4, 2000) and salts == [0, 1]


def test_runs_of_few_words_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(co, "RUN", 5)
    monkeypatch.setattr(co, "BLOCK", 100)
    rows = corpus(10, 120)
    got = co.mine_phrases(spark.createDataFrame(rows, SCHEMA).repartition(3), "text", "lang", least=5)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, 4, 2000)


def test_packed_phrases_are_summed_by_part():
    rng = np.random.default_rng(6)
    a, b = (rng.integers(0, 9, 9000).astype(np.uint64) << np.uint64(60) for _ in range(2))
    blocks = []
    for some in np.array_split(np.arange(a.size), 3):
        key = co.phrase_id(2, a[some], b[some])
        place, n = co.tally(key, a[some], b[some])
        blocks.append(co._packed(2, key[place], a[some][place], b[some][place], n, 7))
    whole = co.pa.Table.from_batches(blocks)
    got = {}
    for part in range(7):
        mine = whole.filter(co.pc.equal(whole.column("part"), part))
        if mine.num_rows:
            for k, x, y, n in zip(*co._opened(co._merged(7)(mine))):
                assert k == 2 and (x, y) not in got
                got[x, y] = n
    pairs, n = np.unique(np.column_stack([a, b]), axis=0, return_counts=True)
    assert got == {(x, y): c for (x, y), c in zip(pairs, n)}

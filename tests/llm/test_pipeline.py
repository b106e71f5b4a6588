"""The pipeline over small tables: each stage against what it must drop and keep."""

import os
import random

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from tablewright.llm.queries import ORACLES, QUERIES
from tests_llm_corpus import brute_near

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
RNG = random.Random(9)
WORDS = ["".join(RNG.choices("abcdefghiklmnorst", k=RNG.randint(2, 8))) for _ in range(2500)]
INSULTS = ["vileones", "brutish", "foolery", "swinish", "cadger", "rotter"]
FOOTER = "All rights reserved by the owners of this site."


def prose(n):
    return " ".join(RNG.choices(WORDS, k=n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    bench = [(k, prose(25)) for k in range(10)]
    rows, labels, kind = [], [], {}
    for k in range(600):
        text = prose(RNG.randint(40, 160))
        what = "toxic" if k % 6 == 0 else "leak" if k % 31 == 1 else "near" if k % 37 == 5 else "clean"
        if what == "toxic":
            words = text.split()
            for _ in range(len(words) // 8):
                words.insert(RNG.randrange(len(words)), RNG.choice(INSULTS))
            text = " ".join(words)
        elif what == "leak":
            text += ". " + bench[k % 10][1]
        elif what == "near":
            original = next(t for i, t, *_ in reversed(rows) if kind[i] == "clean")
            words = original.split("\n")[0].split()
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        if k % 2:
            text += "\n" + FOOTER
        kind[k] = what
        rows.append((k, text, "en", f"src{k % 20}", len(text)))
        labels.append((k, int(what == "toxic")))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, kind


def test_stages_on_their_own_input(spark, folder):
    path, kind = folder
    docs, now = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, path).cache()
        assert out.columns == COLUMNS
        before, after = ({r.doc_id: r for r in x.collect()} for x in (docs, out))
        gone = set(before) - set(after)
        now[name] = gone
        if name == "toxicity":
            bad = {k for k in before if kind[k] == "toxic"}
            assert len(gone & bad) >= 0.95 * len(bad) and len(gone - bad) <= 3
        elif name == "line_dedup":
            assert not gone and all(r.text == "\n".join(x for x in before[k].text.split("\n") if x.strip() != FOOTER) and r.n_chars == len(r.text) for k, r in after.items())
        elif name == "jaccard_join":
            assert gone == {k for k, c in brute_near([(k, r.text) for k, r in before.items()]).items() if c != k}
        else:
            assert gone == {k for k in before if kind[k] == "leak"}
        docs = out
    assert all(now[s] for s in ("toxicity", "jaccard_join", "decontaminate"))
    mixed = P.STAGES[-1][1](spark, docs, path)
    assert mixed.columns == [*COLUMNS, "rate", "copy"] and {r.doc_id for r in mixed.select("doc_id").collect()} <= {r.doc_id for r in docs.collect()}


def test_run_is_its_stages_in_turn(spark, folder):
    path, kind = folder
    got = P.run(spark, path)
    rows = got.collect()
    assert 0 < len(rows) and not any(FOOTER in r.text for r in rows)
    assert sum(kind[r.doc_id] in ("toxic", "leak") for r in rows) <= 0.02 * len(rows)
    assert got.groupBy("doc_id").agg(F.countDistinct("copy").alias("a"), F.count("*").alias("b")).filter("a != b").isEmpty()


def test_odd_rows_pass_every_stage(spark, folder):
    path, _ = folder
    schema = "doc_id long, text string, lang string, source string, n_chars long, leaks int, copy string, id string, rate double, n_lines int"
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "some text", "en", None, 9), (3, "word " * 30_000, "en", "a", 1), (4, "x", "en", "a", 1), (4, "x", "en", "a", 1)]
    docs = spark.createDataFrame([(*r, 1, "c", "d", 0.5, 2) for r in rows], schema)
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert {r.doc_id for r in docs.collect()} == {1, 2, None, 3, 4} and docs.count() == 5
    assert P.STAGES[-1][1](spark, docs, path).count() >= 0


def test_empty_documents(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, path).count() == 0


def test_queries_and_stages_are_registered():
    assert [q.split("_")[0] for q in QUERIES if q.startswith("op")] == [f"op{n}" for n in range(1, 11)]
    assert "pipeline" in QUERIES and set(ORACLES) <= set(QUERIES) and P.ORACLE_SQL is None
    assert os.path.dirname(os.path.abspath(P.__file__)) == os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

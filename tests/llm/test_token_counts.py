"""Token counts against the library they must equal."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tablewright.llm import token_counts as C

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
MACHINE = C.Counter(PATH)


def expected(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def counted(texts):
    return np.concatenate([C.count_block(p, MACHINE) for _, p in C.blocks(pa.array(texts, pa.large_string()))]).tolist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=40), min_size=1, max_size=4))
def test_any_text(texts):
    assert counted(texts) == expected(texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("  \n\t'strevmldSTL01.,é　", max_size=60), min_size=1, max_size=4))
def test_blanks_quotes_and_contractions(texts):
    assert counted(texts) == expected(texts)


def test_special_tokens_inside_texts():
    texts = ["a<|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>  x  <|endoftext|>", "<|endof", "text|> <|endoftext|"]
    assert counted(texts) == expected(texts)


def test_long_words_and_texts_over_many_chunks():
    rng = random.Random(1)
    texts = ["a" * 3000, " " * 2000, "".join(rng.choices("abcdefgh \n'", k=50_000)), "they'll've" * 500]
    assert counted(texts) == expected(texts)


def test_forgetting_compiled_states_changes_nothing(monkeypatch):
    monkeypatch.setattr(C, "TRANSITIONS", 50)
    monkeypatch.setattr(C, "WORDS", 5)
    texts = ["".join(random.Random(k).choices("abcdefgh étion\n", k=400)) for k in range(20)]
    assert counted(texts) == expected(texts)


def test_prefix_scan_composes_maps():
    rng = np.random.default_rng(2)
    maps = rng.integers(0, C.STATES, (37, C.STATES))
    scanned, now = C.prefix_scan(maps), np.arange(C.STATES)
    for k in range(37):
        now = maps[k][now]
        assert (scanned[k] == now).all()


def test_table(spark):
    rows = [(1, "one two", "x"), (1, "one two", "x"), (None, None, None), (2, "", "y"), (3, "word " * 600, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, C.count_tokens(df, "text", PATH, keep=["doc_id"]).collect()), key=repr)
    want = sorted(((k, len((t or "").encode()), n, n > 512) for (k, t, _), n in zip(rows, expected([t or "" for _, t, _ in rows]), strict=True)), key=repr)
    assert got == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert C.count_tokens(df, "text", PATH, keep=["doc_id"]).collect() == []


@pytest.mark.parametrize("size", [1, 255, 256, 257, 600])
def test_chunk_edges(size):
    text = ("ab 'll\n\n x9" * 100)[:size]
    assert counted([text]) == expected([text])

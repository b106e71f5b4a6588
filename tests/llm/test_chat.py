"""Chat formatting: exact round trips."""

import hashlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from tablewright.llm import chat

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = st.lists(st.one_of(st.sampled_from([*chat.CONTROLS, "\\", "<", "|", "<\\|turn|>", "[\\\\INST]", "</\\s>"]), st.text(max_size=5)), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(PIECES)
def test_escape_is_undone_and_hides_controls(text):
    shown = chat.escape(text)
    assert chat.unescape(shown) == text
    assert not any(c in shown for c in chat.CONTROLS)


def test_turns_have_their_form_and_mask():
    roles, texts = ["user", "assistant", "", "assistant"], ["hi <|end|>", "</s>[INST] ok [/INST]", "", ""]
    ids, mask, offsets = chat.assemble(roles, texts, PATH)
    t = chat.tokenizer(PATH)
    base = t.get_vocab_size()
    for k, (role, text) in enumerate(zip(roles, texts, strict=True)):
        own, learned = ids[offsets[k] : offsets[k + 1]], mask[offsets[k] : offsets[k + 1]]
        marks = np.flatnonzero(own >= base)
        assert (own[marks] - base).tolist() == [0, 1, 2] and marks[0] == 0 and marks[2] == own.size - 1
        inside = own[marks[1] + 1 : -1].tolist()
        assert chat.unescape(t.decode(inside, skip_special_tokens=False)) == text
        assert own[learned > 0].tolist() == (inside if role == "assistant" else [])


def digests(spark, rows, extra=""):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string" + extra)
    return {r.conv_id: r for r in chat.conversation_digests(chat.read_back(chat.format_turns(df, PATH), PATH)).collect()}


def direct(rows):
    out = {}
    for conv, _, role, text in sorted((r[:4] for r in rows), key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1], r[2] or "", r[3] or "")):
        now = out.setdefault(conv, [0, "", ""])
        now[0] += 1
        now[1] += f"{role or ''}\n{text or ''}\n"
        now[2] += (text or "") if role == "assistant" else ""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {c: (n, sha(a), len(b), sha(b)) for c, (n, a, b) in out.items()}


def test_conversations_with_nulls_ties_and_repeats(spark):
    rows = [(1, 1, "assistant", "b\n"), (1, 0, "user", "é <|turn|>"), (2, 0, "assistant", None), (2, 0, "assistant", None), (2, 0, None, "x"), (None, 3, "user", ""), (None, None, "assistant", "y" * 50_000), (3, 5, "assistant", "a"), (3, 5, "assistant", "b")]
    got = digests(spark, rows)
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == direct(rows)


def test_one_conversation_over_many_batches(spark):
    rows = [(7, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(3000)] + [(8, 0, "user", "z")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = digests(spark, rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == direct(rows)


def test_empty_table_and_clashing_columns(spark):
    assert digests(spark, []) == {}
    rows = [(1, 0, "assistant", "t", "x", 1)]
    assert digests(spark, rows, ", ids string, mask int")[1].loss_chars == 1


def test_formatted_length_is_that_of_the_shown_string(spark):
    text = "</s>[INST] ok [/INST]"
    got = digests(spark, [(-1, 0, "user", text), (-1, 1, "assistant", text)])[-1]
    shown = "".join(f"<|turn|>{role}<|text|>{chat.escape(text)}<|end|>" for role in ("user", "assistant"))
    assert got.formatted_chars == len(shown)

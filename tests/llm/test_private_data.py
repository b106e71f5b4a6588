"""Personal data: fixed spans against their definition, contexts against a plain rendering of the scoring."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tablewright.llm import private_data as pd_

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def fixed(text):
    out = []
    for number, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            checks = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}
            if checks[kind]():
                out.append((m.start(), number, m.end()))
    return sorted(out)


def digest(spans):
    return hashlib.sha256(",".join(f"{pd_.KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def found(spark, texts, parts=4):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    return {r.doc_id: r for r in pd_.find_private(df, "text", ["doc_id"]).collect()}


def check_fixed(spark, texts):
    rows = found(spark, texts)
    assert len(rows) == len(texts)
    for k, text in enumerate(texts):
        assert rows[k].base_sha256 == digest(fixed(text or "")), text
        assert set(f"{pd_.KINDS[x]}:{a}:{b}" for a, x, b in fixed(text or "")) <= set(rows[k].spans.split(",")) | {""}


def test_fixed_spans_of_odd_texts(spark):
    texts = [
        None, "", " ", "a@b.c.d_e@f.g", "x@y", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1", "000255.1.1.01", "+12345678", "+1 (961) 555-6946 x",
        "+1 2 3 4 5 6 7 8 9.", "4111 1111 1111 1111", "4111-1111-1111-1111-", "4111111111111112", "4111  1111 1111 1111", "é4111111111111111é", "\U0001f600 a.b@c.de \U0001f600 1.2.3.4",
        "+" * 50 + "1 23456789", "a@b.c1.2.3.4", "+1.2.3.4", "+1 1.2.3.4 555", "mail a@b.co\nmail a@b.co", "0" * 40, "12 " * 9, "%@a.b", "a@-.-",
    ]
    check_fixed(spark, texts)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="a1.@+- 4()é\n%", max_size=60), min_size=30, max_size=60))
def test_fixed_spans_of_random_texts(spark, texts):
    check_fixed(spark, texts)


def test_very_long_texts(spark):
    texts = ["a" * 300_000, "a." * 150_000 + "@", "1" * 300_000, "1." * 100_000, "+1 " * 60_000, "a@b" + ".c" * 100_000, " ".join(f"u{i}@h.org" for i in range(20_000)), "!" * 200_000 + "1", "((" * 100_000 + "1"]
    started = time.time()
    rows = found(spark, texts)
    assert time.time() - started < 90
    assert rows[6].n_email == 20_000 and rows[6].base_sha256 == digest(fixed(texts[6]))
    assert rows[5].n_email == 1


def context_words(text, at):
    tail = re.sub(r"[\"'(<\[{]+$", "", text[max(0, at - 200) : at])
    if not re.search(r"\s$", tail):
        return []
    words = re.split(r"\s+", re.sub("[0-9]", "0", tail.lower()).rstrip(" "))
    words = [w[-24:] for w in words if w]
    return [(w,) for w in words[-1:]] + [tuple(words[-2:])] * (len(words) > 1)


def brute_contexts(texts):
    """Spans of the kind context, by the scoring written out plainly."""
    seeds, tokens = [], []
    for k, text in enumerate(texts):
        base = fixed(text)
        seeds += [(k, a, b, text[a:b].lower(), context_words(text, a)) for a, _, b in base]
        for m in re.finditer(r"\S+", text):
            lead = len(re.match(r"[\"'(<\[{]*", m[0])[0])
            core = re.sub(r"[.,;:!?\"')>\]}%#$&*|]+$", "", m[0][lead:])
            a, b = m.start() + lead, m.start() + lead + len(core)
            likely = 6 <= len(core) <= 64 and (len(re.findall("[0-9]", core)) >= 4 or re.fullmatch("[^@]+@[^@]+", core))
            if likely and all(y <= a or x >= b for x, _, y in base):
                tokens.append((k, a, b, core.lower(), context_words(text, m.start())))
    edges, times, total = defaultdict(dict), Counter(), Counter()
    for rows, seed in ((seeds, True), (tokens, False)):
        for *_, what, patterns in rows:
            for p in patterns:
                edges[p][what] = edges[p].get(what, False) or seed
                times[p] += 1
    for text in texts:
        words = [w[-24:] for w in re.sub("[0-9]", "0", text.lower()).split()]
        total.update((w,) for w in words[:-1])
        total.update(zip(words, words[1:-1], strict=False))
    edges = {p: e for p, e in edges.items() if len(e) >= 3 and total[p]}
    score = {}
    for _ in range(4):
        sure = {}
        for p, e in edges.items():
            worth = sum(1.0 if seed else score.get(w, 0.0) for w, seed in e.items())
            conf = min(worth / (len(e) + max(0, total[p] - times[p])), 0.999)
            if worth >= 3 and conf >= 0.5:
                sure[p] = conf
        err = defaultdict(float)
        for p, c in sure.items():
            for w, seed in edges[p].items():
                if not seed:
                    err[w] += math.log(1 - c)
        score = {w: 1 - math.exp(x) for w, x in err.items()}
    return {(k, a, b) for k, a, b, w, _ in tokens if score.get(w, 0) >= 0.5}


def corpus():
    rng = random.Random(5)
    word = lambda: rng.choice(["the", "of", "and", "report", "plan", "see"])
    texts = []
    for k in range(120):
        filler = " ".join(word() for _ in range(12))
        texts.append(f"{filler} write to: u{k}@mail{k % 7}.org {word()} the {k}.1.2.3 {filler}")
        if k % 4 == 0:
            texts.append(f"{filler} write to: member{k}4421, {filler} invoice no 2024{k:04d} {filler}")
        if k % 6 == 0:
            texts.append(f'{filler} ticket from "member{k}4421" {word()} ticket from user-{k:05d} {word()} (the 2024-{k:04d})')
    return texts


def test_contexts_reveal_unseen_identifiers(spark):
    texts = corpus()
    rows = found(spark, texts)
    got = {(k, *map(int, s.split(":")[1:])) for k, r in rows.items() for s in r.spans.split(",") if s.startswith("context")}
    assert got == brute_contexts(texts)
    marked = {texts[k][a:b] for k, a, b in got}
    assert {f"member{k}4421" for k in range(0, 120, 4)} <= marked
    assert not any(m.startswith("2024") for m in marked)
    assert found(spark, texts, 1)[3] == found(spark, texts, 9)[3]


def test_found_identifiers_vouch_for_new_contexts(spark):
    texts = [f"mail to u{k}@a.org" for k in range(12)] + [f"mail to member{k}4421" for k in range(8)]
    texts += [f"ticket from member{k}4421" for k in range(8)] + ["ticket from staff-90210"]
    rows = found(spark, texts)
    got = {(k, *map(int, s.split(":")[1:])) for k, r in rows.items() for s in r.spans.split(",") if s.startswith("context")}
    assert got == brute_contexts(texts) and rows[len(texts) - 1].n_context == 1


def test_empty_tables_nulls_and_clashing_names(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pd_.find_private(df, "text", ["doc_id"]).collect() == []
    df = spark.createDataFrame([(None, "a@b.org", 1, "x"), (None, "a@b.org", 1, "x"), (3, None, 2, None)], "doc_id long, text string, n_email int, Spans string")
    rows = pd_.find_private(df, "text", ["doc_id", "n_email", "Spans"]).collect()
    assert sorted((r.n_email, r.n_email_input, r.spans) for r in rows if hasattr(r, "spans")) == [(0, 2, ""), (1, 1, "email:0:7"), (1, 1, "email:0:7")]

"""Conversation repair against all edit sequences, and against its SQL."""

import hashlib
import itertools
import random
import zlib

import duckdb
import pandas as pd  # noqa: F401

from tablewright.llm import chat_repair as cr
from tablewright.llm.queries import ORACLES

COLUMNS = ["conv_id", "turn", "role", "text"]
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """(cost, audit, repaired) over all edits of (role, text, fault), by dynamic programming on whole strings."""
    best = {0: (0, "", ())}

    def offer(into, state, way):
        if state not in into or way[:2] < into[state][:2]:
            into[state] = way

    def inserted(ways):
        for _ in range(4):
            for s, (c, a, lines) in list(ways.items()):
                role, to = cr.DUE[s]
                offer(ways, to, (c + 3, a + "I", (*lines, f"{role}:")))
        return ways

    best = inserted(best)
    for role, text, fault in rows:
        now = {}
        for s, (c, a, lines) in best.items():
            offer(now, s, (c + 4, a + "D", lines))
            if fault not in (1, 2):
                c += 3 * (fault == 3)
                if role[:1] in cr.NEXT[s]:
                    offer(now, cr.NEXT[s][role[:1]], (c, a + "K", (*lines, f"{role}:{text}")))
                due, to = cr.DUE[s]
                offer(now, to, (c + 3, a + "R", (*lines, f"{due}:{text}")))
        best = inserted(now)
    return min(best[s] for s in cr.ENDS if s in best)


def every_edit(rows):
    """The same by trying all edits with up to two insertions at a place; for few rows."""
    import re

    found = []
    gaps = ["", "u", "a", "ua", "au"]
    for inserts in itertools.product(gaps, repeat=len(rows) + 1):
        for edits in itertools.product("DKR", repeat=len(rows)):
            for roles in itertools.product("ua", repeat=edits.count("R")):
                rewritten = iter(roles)
                cost, audit, lines, ok = 0, "", [], True
                for k in range(len(rows) + 1):
                    cost, audit = cost + 3 * len(inserts[k]), audit + "I" * len(inserts[k])
                    lines += [{"u": "user:", "a": "assistant:"}[c] for c in inserts[k]]
                    if k < len(rows):
                        role, text, fault = rows[k]
                        ok &= edits[k] == "D" or fault not in (1, 2)
                        cost += cr.COST[edits[k]] + (3 if fault == 3 and edits[k] != "D" else 0)
                        audit += edits[k]
                        if edits[k] == "K":
                            lines.append(f"{role}:{text}")
                        elif edits[k] == "R":
                            lines.append(f"{ {'u': 'user', 'a': 'assistant'}[next(rewritten)]}:{text}")
                if ok and re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines)):
                    found.append((cost, audit, tuple(lines)))
    return min(found)


def streamed(rows):
    conversation = cr.Conversation()
    for role, text, fault in rows:
        conversation.row(role, text, fault)
    return conversation.end(), conversation.survivors


def sample(rng, n):
    return [(rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "unknown"]), rng.choice(["a.", "b", "c!"]), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(n)]


def test_all_edits_of_short_conversations():
    rng = random.Random(3)
    for n in (0, 1, 2, 3):
        for _ in range(6 if n == 3 else 12):
            rows = sample(rng, n)
            want = every_edit(rows)
            got, _ = streamed(rows)
            assert got[4:] == (want[0], want[1], hashlib.sha256("\n".join(want[2]).encode()).hexdigest()), rows


def test_dynamic_programme_over_whole_strings():
    rng = random.Random(4)
    for _ in range(400):
        rows = sample(rng, rng.randrange(40))
        cost, audit, lines = brute(rows)
        got, _ = streamed(rows)
        assert got[4:] == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_memory_is_bounded_by_the_undecided_end():
    rng = random.Random(5)
    rows = [("user" if k % 2 == 0 else "assistant", "fine.", 3 * (rng.random() < 0.1)) for k in range(200_000)]
    got, survivors = streamed(rows)
    assert survivors.most < 100 and len(got[5]) >= 200_000


def test_tree_is_freed():
    _, survivors = streamed(sample(random.Random(6), 500))
    assert survivors.held <= survivors.most


def table_rows(seed=1, n=300):
    rng = random.Random(seed)
    out = []
    for conv in [None, *range(n)]:
        for turn in range(rng.randint(1, 9)):
            out.append((conv, rng.choice([turn, turn, turn, None, turn * 3]), rng.choice(["user", "assistant", "system", None, "", "User"]), rng.choice(["Yes.", "No!", "same", None, "", " \t\x0b", "é。", "so?  \n", "x" * 50])))
    return out + out[:20]


def compared(spark, rows, parts):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = sorted(map(repr, map(tuple, cr.repair(cr.damage(df, *COLUMNS), *COLUMNS).collect())))
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    if rows:
        db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert got == sorted(map(repr, db.execute(ORACLES["op13_chat_repair"]).fetchall()))
    return got


def test_odd_rows_and_sql(spark):
    assert compared(spark, table_rows(), 1) == compared(spark, table_rows(), 7)


def test_empty_table_and_one_row(spark):
    assert compared(spark, [], 1) == []
    assert len(compared(spark, [(5, 5, "user", "Hi.")], 1)) == 1


def test_damage_kinds(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(40) for t in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    seen = {}
    for r in cr.damage(df, *COLUMNS).collect():
        seen.setdefault((r.conv_id, r.turn), []).append((r.role, r.text, r["__gone"]))
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{c}:{t}".encode()) % 20
        want = {0: [(None, None, True)], 1: [(role, "", False)], 2: [(role, "One Two", False)], 3: [(role, text, False)] * 2, 4: [("user", text, False)]}
        assert seen[c, t] == want.get(kind, [(role, text, False)])


def test_one_long_conversation_and_extra_columns(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.", t, "x") for t in range(30_000)]
    df = spark.createDataFrame(rows, SCHEMA + ", gaps long, audit string")
    (row,) = cr.repair(df, *COLUMNS).collect()
    assert row.cost == 0 and row.audit == "K" * 30_000 and row.gaps == 0

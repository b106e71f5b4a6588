"""Conversation repair: the cheapest edits that make turns alternate, by a Viterbi with coalescing survivors.

Each row of a conversation is kept (K), given the role that is due (R) or deleted (D), and rows
may be inserted (I), so that the roles' initials read ``(s?(ua)+)?``. Four states remember what came
last: nothing, system, user, assistant. Every state's survivor is the cheapest way to it, and
of equally cheap ones the one whose edits read first in ASCII order.

Survivors are leaves of a tree of edits that point back and count who points at them. A survivor
that nobody follows any more takes its branch with it. As soon as all branches meet in one edit,
everything up to it is certain: those edits are emitted, their rows let go, and the tree is rooted
there. What is held is the undecided end of a conversation, not the conversation. Ties
are settled by the two branches' whole undecided length (before it they are one): survivors are
ranked by it after every row, so that a comparison only looks at what has come since. A state that
another can replace at no greater cost whatever follows is given up.

Spark brings the rows of a conversation together in order (one shuffle by conversation, sorts that
spill), marks repeated rows, and streams them through; the two digests grow as edits are emitted. One
conversation is one stream, since its digest is a chain; its memory does not grow with its length.

Order within a conversation: turn (nulls first), role, text; of equal rows the first counts and the others are repeats. Null roles and texts, and
null parts of the damage key, read as one space; a null conversation is one of its own. Empty tables give no rows,
conversations without rows zeros. Other columns are dropped before the shuffle, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Costs of the edits, and of a truncated row that stays.
COST = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED = 3
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: What may follow each state, by initial, and whether a conversation may end there.
NEXT = {NOTHING: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ENDS = (NOTHING, ASSISTANT)
#: The role that a rewritten or inserted row gets, and the state after it.
DUE = {NOTHING: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
#: The blanks of a text, in a character class.
BLANKS = r"\x20\x09-\x0D"
RESULT = "blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Edit:
    """A node of the tree: one edit, what it emits, where it came from and who points at it."""

    __slots__ = ("back", "kids", "letter", "line", "rank", "row", "survives")

    def __init__(self, back: Edit | None, letter: str, line: str | None, row: int):
        self.back, self.letter, self.line, self.row = back, letter, line, row
        self.kids: list[Edit] = []
        self.survives, self.rank = False, 0


class Survivors:
    """The cheapest edits to each state; ``emit(letter, line)`` is called once an edit is certain."""

    def __init__(self, emit: Callable[[str, str | None], None]):
        self.emit, self.now = emit, 0
        self.root = Edit(None, "", None, -1)
        self.root.survives = True
        self.best: dict[int, tuple[int, Edit]] = {NOTHING: (0, self.root)}
        self.held = self.most = 0
        self._insertions()
        self._order()

    def _since(self, node: Edit) -> tuple[Edit, list[str]]:
        """The survivor of the last row that ``node`` comes from, and the letters after it."""
        letters: list[str] = []
        while node.row == self.now and node is not self.root:
            letters.append(node.letter)
            node = node.back
        return node, letters[::-1]

    def _inserted(self, node: Edit, below: Edit) -> int:
        """How many insertions lead from ``below`` to ``node``; -1 if it isn't below it."""
        n = 0
        while node is not below:
            if node.letter != "I" or node is self.root:
                return -1
            node, n = node.back, n + 1
        return n

    def reads_first(self, x: Edit, y: Edit) -> bool:
        """Whether the undecided edits up to ``x`` read before those up to ``y``.

        Up to the last row they were compared when it ended (``rank``); neither begins with
        the other unless only insertions lie between.
        """
        (base, first), (other, second) = self._since(x), self._since(y)
        if base is not other:
            if (n := self._inserted(other, base)) >= 0:
                second = ["I"] * n + second
            elif (n := self._inserted(base, other)) >= 0:
                first = ["I"] * n + first
            else:
                return base.rank < other.rank
        return first < second

    def _order(self) -> None:
        """Rank the survivors by their undecided edits, for the comparisons of the next row."""
        nodes = [node for _, node in self.best.values()]
        ranks = [sum(self.reads_first(other, node) for other in nodes) for node in nodes]
        for node, rank in zip(nodes, ranks, strict=True):
            node.rank = rank

    def _offer(self, into: dict[int, tuple[int, Edit]], state: int, cost: int, back: Edit, letter: str, line: str | None) -> bool:
        old = into.get(state)
        if old and old[0] < cost:
            return False
        node = Edit(back, letter, line, self.now)
        if old and old[0] == cost and not self.reads_first(node, old[1]):
            return False
        back.kids.append(node)
        self.held += 1
        node.survives = True
        into[state] = (cost, node)
        if old:
            old[1].survives = False
            self._drop(old[1])
        return True

    def _drop(self, node: Edit) -> None:
        """Free a branch that nobody points at."""
        while not node.kids and not node.survives and node is not self.root:
            node.back.kids.remove(node)
            self.held -= 1
            node = node.back

    def _insertions(self) -> None:
        """Insert rows wherever that is cheaper; costs are positive, so this ends."""
        changed = True
        while changed:
            changed = False
            for state in STATES:
                if state in self.best:
                    cost, node = self.best[state]
                    role, after = DUE[state]
                    changed |= self._offer(self.best, after, cost + COST["I"], node, "I", f"{role}:")

    def row(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        """The next row of the conversation."""
        last, self.best = self.best, {}
        self.now += 1
        for state, (cost, node) in last.items():
            self._offer(self.best, state, cost + COST["D"], node, "D", None)
            if not must_go:
                more = cost + (TRUNCATED if truncated else 0)
                to = NEXT[state].get(role[:1])
                if to is not None:
                    self._offer(self.best, to, more + COST["K"], node, "K", f"{role}:{text}")
                due, after = DUE[state]
                self._offer(self.best, after, more + COST["R"], node, "R", f"{due}:{text}")
        for _, node in last.values():
            node.survives = False
            self._drop(node)
        self._insertions()
        # What may follow nothing may follow an assistant, once a system row is deleted; what may follow system too.
        for state, more in ((NOTHING, COST["D"]), (SYSTEM, 0)):
            if state in self.best and self.best[state][0] > self.best[ASSISTANT][0] + more:
                _, node = self.best.pop(state)
                node.survives = False
                self._drop(node)
        self._order()
        self.most = max(self.most, self.held)
        # All survivors come from the root's only child: that edit is certain.
        while len(self.root.kids) == 1 and not self.root.survives:
            self._advance(self.root.kids[0])

    def _advance(self, node: Edit) -> None:
        self.emit(node.letter, node.line)
        self.held -= 1
        self.root, node.back, node.line = node, None, None

    def end(self) -> int:
        """Emit the rest of the cheapest edits that may end here; their cost."""
        self.now += 1
        cost, node = None, None
        for state in ENDS:
            if state in self.best:
                c, other = self.best[state]
                if cost is None or c < cost or (c == cost and self.reads_first(other, node)):
                    cost, node = c, other
        path = []
        while node is not self.root:
            path.append(node)
            node = node.back
        for edit in reversed(path):
            self._advance(edit)
        return cost


class Conversation:
    """Running results of one conversation."""

    def __init__(self):
        self.counts = [0, 0, 0, 0]  # blank, duplicate, truncated, illegal
        self.audit: list[str] = []
        self.digest, self.lines, self.last = hashlib.sha256(), 0, None
        self.survivors = Survivors(self._emit)

    def _emit(self, letter: str, line: str | None) -> None:
        self.audit.append(letter)
        if line is not None:
            self.digest.update(("\n" if self.lines else "").encode() + line.encode())
            self.lines += 1

    def row(self, role: str, text: str, fault: int) -> None:
        """``fault``: 0 for none, else 1 blank, 2 duplicate, 3 truncated."""
        if fault:
            self.counts[fault - 1] += 1
        if self.last is not None and self.last[:1] + role[:1] not in ("su", "ua", "au"):
            self.counts[3] += 1
        self.last = role
        self.survivors.row(role, text, fault in (1, 2), fault == 3)

    def end(self) -> tuple:
        cost = self.survivors.end()
        return (*self.counts, cost, "".join(self.audit), self.digest.hexdigest())


def repair(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """One row per conversation: ``conv``, ``gaps``, counts of faults, cost and audit of the cheapest edits, digest.

    ``rows`` may hold a boolean column ``__gone``: such rows only say that the conversation exists.
    """
    gone = F.col("__gone") if "__gone" in rows.columns else F.lit(False)
    copy = F.col("__copy") if "__copy" in rows.columns else F.lit(0)
    plain = rows.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"),
        gone.alias("gone"), copy.alias("copy"),
    ).repartition("conv")
    time = F.asc_nulls_first("turn")
    again = F.row_number().over(Window.partitionBy("conv", "gone", "role", "text").orderBy(time, "copy"))
    solid = F.regexp_extract("text", rf"([^{BLANKS}])[{BLANKS}]*+\z", 1)
    fault = F.when(solid == "", 1).when(F.col("again") > 1, 2).when(~solid.rlike("^[.!?]"), 3).otherwise(0)
    streamed = plain.withColumn("again", again).withColumn("fault", fault).sortWithinPartitions(F.asc_nulls_first("conv"), "gone", time, "role", "text", "again")
    key = plain.schema["conv"].dataType
    schema = f"conv {key.simpleString()}, gaps long, {RESULT}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now, here, turns = (None,), Conversation(), [None, None, 0, None]  # first, last, distinct, latest

        def close() -> None:
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns[2] else 0
            done.append((now[0], gaps, *here.end()))

        def out() -> pa.RecordBatch:
            names = ["conv", "gaps", *(x.split()[0] for x in RESULT.split(", "))]
            columns = list(zip(*done, strict=True))
            made = pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:7]), *(pa.array(c, pa.string()) for c in columns[7:])], names=names)
            done.clear()
            return made

        started, size = False, 0
        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field("conv").type
            for conv_id, at, who, what, is_gone, wrong in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "gone", "fault")), strict=True):
                if not started or conv_id != now[0]:
                    if started:
                        close()
                        size += len(done[-1][-2])
                    started, now, here, turns = True, (conv_id,), Conversation(), [None, None, 0, None]
                    if len(done) >= 4096 or size >= 1 << 22:
                        yield out()
                        size = 0
                if is_gone:
                    continue
                if at is not None:
                    turns[0] = at if turns[0] is None else turns[0]
                    turns[2] += turns[3] != at
                    turns[1] = turns[3] = at
                here.row(who, what, wrong)
        if started:
            close()
        if done:
            yield out()

    return streamed.mapInArrow(run, schema).withColumnRenamed("conv", conv)


def damage(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The rows with faults put in by a hash of conversation and turn; rows that go are marked ``__gone``."""

    def part(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(part(conv), F.lit(":"), part(turn)).cast("binary")) % 20
    what = F.coalesce(F.col(text), F.lit(" "))
    worse = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(what, "[.!?]", "")).otherwise(what)
    who = F.when(kind == 4, "user").otherwise(F.coalesce(F.col(role), F.lit(" ")))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    gone = kind == 0
    return rows.select(
        F.col(conv), F.col(turn), F.when(~gone, who).alias(role), F.when(~gone, worse).alias(text),
        gone.alias("__gone"), F.explode(copies).alias("__copy"),
    )


#: The same in SQL. A way to a state is one text, its cost in ten digits and its edits, so the least text is the best way.
SQL = """
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT) AS bytes
  FROM {conversations}),
hashed AS (
  SELECT *, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda h, b:
    list_reduce(list_prepend(xor(h, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384)))) % 20 AS kind
  FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, c AS copy
  FROM hashed, (VALUES (0), (1)) AS t(c) WHERE kind <> 0 AND (c = 0 OR kind = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS i, nth > 1 AS again,
         regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS short
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM damaged)),
flawed AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS c,
         CASE WHEN short = '' THEN 1 WHEN again THEN 2 WHEN right(short, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS rows
  FROM flawed GROUP BY conv_id),
ways AS (
  SELECT conv_id, 0::BIGINT AS i, '0000000000' AS n, '0000000003I' AS u, '0000000006II' AS a, NULL::VARCHAR AS s FROM counts
  UNION ALL
  SELECT w.conv_id, f.i, {n2} AS n, least(u0, {n2_i}, {s2_i}, a0_i) AS u, least(a0, u0_i, {n2_ii}, {s2_ii}) AS a, {s2} AS s
  FROM ways w JOIN flawed f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1,
  LATERAL (SELECT CASE WHEN f.fault IN (1, 2) THEN NULL ELSE CASE WHEN f.fault = 3 THEN 3 ELSE 0 END END AS extra) AS e,
  LATERAL (SELECT {steps}) AS x,
  LATERAL (SELECT {u0_i} AS u0_i, {a0_i} AS a0_i) AS y),
ends AS (SELECT w.conv_id, least(n, a) AS best FROM ways w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = c.rows),
edits AS (
  SELECT conv_id, unnest(string_split(best[11:], '')) AS e, generate_subscripts(string_split(best[11:], ''), 1) AS j FROM ends WHERE len(best) > 10),
lines AS (
  SELECT conv_id, e, j, sum((e <> 'I')::INT) OVER o AS i, sum((e <> 'D')::INT) OVER o AS p FROM edits WINDOW o AS (PARTITION BY conv_id ORDER BY j)),
joined AS (
  SELECT l.conv_id, l.e, l.j, l.p, f.role, f.text, max(CASE WHEN l.p = 1 AND l.e = 'K' AND f.c = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS shift
  FROM lines l LEFT JOIN flawed f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i AND l.e <> 'I'),
repaired AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role ELSE CASE WHEN (p - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS text
  FROM joined WHERE e <> 'D' GROUP BY conv_id)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(best[:10]::BIGINT, 0) AS cost, coalesce(best[11:], '') AS audit, sha256(coalesce(r.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM {conversations}) d
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM d.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM d.conv_id"""


def sql(conversations: str) -> str:
    """The query over a table of that name."""

    def plus(way: str, cost: str, letter: str) -> str:
        return f"lpad(({way}[:10]::BIGINT + {cost})::VARCHAR, 10, '0') || {way}[11:] || '{letter}'"

    n2, s2 = plus("n", "4", "D"), "s0"
    keep = {"u": ["n", "s", "a"], "a": ["u"]}
    ways = {}
    for state, c in (("u", "u"), ("a", "a")):
        offers = [plus(state, "4", "D")]
        for back in keep[state]:
            offers += [f"CASE WHEN f.c = '{c}' THEN {plus(back, 'e.extra', 'K')} END", plus(back, "e.extra + 3", "R")]
        ways[state] = f"least({', '.join(offers)})"
    system = f"least({plus('s', '4', 'D')}, CASE WHEN f.c = 's' THEN {plus('n', 'e.extra', 'K')} END)"
    steps = f"{n2} AS n0, {system} AS s0, {ways['u']} AS u0, {ways['a']} AS a0"
    twice = lambda w: plus(f"({plus(w, '3', 'I')})", "3", "I")
    return SQL.format(conversations=conversations, steps=steps, n2="n0", s2=s2, n2_i=plus("n0", "3", "I"), s2_i=plus("s0", "3", "I"), u0_i=plus("u0", "3", "I"), a0_i=plus("a0", "3", "I"), n2_ii=twice("n0"), s2_ii=twice("s0"))

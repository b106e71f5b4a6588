"""Secret scan: fixed patterns, and a linear-chain conditional random field that adds to them.

Tokens (runs of letters, digits and ``+/_.-``) of a line form a chain with labels begin, inside
and outside. Scores come from a token's shape, its neighbouring words and the gaps between
them, and from the whole file. The field is trained on a bounded sample of texts, labelled by
the fixed patterns; half of the copies lose their keyword features, so that shape counts too.

Decoding is exact Viterbi. A token whose lead for *outside* exceeds all that neighbours and
transitions could bring is outside on the best path whatever its neighbours are, so chains are
cut there and only the few other tokens are run through the trellis.

Null and empty texts have no spans. A sample without any secret yields a field that adds none.
Rows are independent: repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.common import SALT, blocks, raw, sample_texts, span_hashes, strings

#: The fixed patterns, in the order of their kinds, with the least length of the group tested.
PATTERNS = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, 2, 12),
    "access": (r"AKIA[A-Z0-9]+", re.ASCII, 0, 18),
    "hex": (r"[0-9a-f]+", re.ASCII, 0, 16),
}
KINDS = [*PATTERNS, "crf"]
_COMPILED = {kind: (re.compile(p, flags), group, least) for kind, (p, flags, group, least) in PATTERNS.items()}
#: What a text with a match must hold; tested on whole columns before the patterns are run.
_HINTS = {"assign": (r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", True), "access": ("AKIA", False), "hex": ("[0-9a-f]{16}", True)}

#: Training: texts, characters of a text, passes, and runs of tokens without any secret.
SAMPLE_TEXTS, SAMPLE_CHARS, PASSES, CLEAN_RUNS = 2048, 16_000, 120, 600
NEAR = 5

B, I, O = 0, 1, 2  # noqa: E741
KEYWORDS = ["password", "passwd", "pwd", "secret", "token", "apikey", "api", "key", "credential", "credentials", "auth", "bearer", "private", "api_key", "api-key", "access_key", "secret_key", "auth_token", "access_token"]
WORDS = {w.encode() for w in KEYWORDS}
WORD_HASHES = np.concatenate([span_hashes(SALT[np.frombuffer(w, np.uint8)], np.array([0]), np.array([len(w)])) for w in sorted(WORDS)])
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
LENGTHS = np.array([4, 8, 12, 16, 20, 32, 40])
DIGIT, UPPER, LOWER, WIDE, MARK, NOT_HEX, SWITCHES = (1 << k for k in range(7))
CONTEXT = 15


def _byte_kinds() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for chars, bits in ((range(48, 58), DIGIT), (range(65, 91), UPPER | NOT_HEX), (range(97, 123), LOWER), (range(128, 256), WIDE | NOT_HEX), (b"+/_.-", MARK | NOT_HEX)):
        out[list(chars)] = bits
    out[103:123] |= NOT_HEX
    return out


BYTE_KINDS = _byte_kinds()


def base_spans(text: str, kinds: Sequence[str] = tuple(PATTERNS)) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the fixed patterns' matches, sorted."""
    found = []
    for number, (kind, (pattern, group, least)) in enumerate(_COMPILED.items()):
        if kind in kinds:
            found += [(m.start(), number, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found)


def _hinted(texts: pa.Array) -> dict[str, np.ndarray]:
    return {k: (pc.match_substring_regex if is_regex else pc.match_substring)(texts, p).to_numpy(zero_copy_only=False) for k, (p, is_regex) in _HINTS.items()}


def shape_features() -> np.ndarray:
    """Features of every shape code (length class * 128 + kinds of bytes): one row per code."""
    code = np.arange(128 * (LENGTHS.size + 1))
    length, kinds = code >> 7, code & 127
    flags = (kinds[:, None] >> np.arange(7)) & 1
    mixed = ((kinds & DIGIT) > 0) & ((kinds & (LOWER | UPPER)) > 0)
    return np.column_stack([np.ones(code.size), np.eye(LENGTHS.size + 1)[length], flags, flags * (length >= 4)[:, None], mixed, mixed & (length >= 3), mixed & (length >= 5)]).astype(np.float64)


SHAPES = shape_features()


@dataclass
class Tokens:
    """Tokens of a block of texts: where they are, their shape codes and what surrounds them."""

    start: np.ndarray
    end: np.ndarray
    owner: np.ndarray
    code: np.ndarray
    first: np.ndarray  # begins a line
    texts: pa.Array
    data: np.ndarray
    offsets: np.ndarray

    def context(self, at: np.ndarray) -> np.ndarray:
        """Features of neighbours, gaps and file of the tokens ``at``."""
        n = self.start.size
        last = np.ones(n, bool)
        last[:-1] = self.first[1:]
        lowered = LOWERED[self.data]

        known = np.isin(span_hashes(SALT[lowered], self.start, self.end), WORD_HASHES)
        some = np.flatnonzero(known)
        known[some] = [lowered[a:b].tobytes() in WORDS for a, b in zip(self.start[some], self.end[some], strict=True)]

        def gap(a: np.ndarray, b: np.ndarray, char: str) -> np.ndarray:
            return sums[char][b] > sums[char][a]

        sums = {c: np.concatenate([[0], np.cumsum(self.data == ord(c))]) for c in "=:\"'"}
        before, before2, after = np.maximum(at - 1, 0), np.maximum(at - 2, 0), np.minimum(at + 1, n - 1)
        has1 = ~self.first[at]
        has2 = has1 & ~self.first[before]
        has3 = ~last[at]
        gap_a, gap_b = np.where(has1, self.end[before], self.start[at]), self.start[at]
        tail_a, tail_b = self.end[at], np.where(has3, self.start[after], np.minimum(self.end[at] + 1, self.data.size))
        plain = LOWER | NOT_HEX | WIDE
        text_at, owner = self.offsets, self.owner[at]
        size = np.maximum(text_at[owner + 1] - text_at[owner], 1)
        digits = np.concatenate([[0], np.cumsum((self.data >= 48) & (self.data < 58))])
        equals = sums["="][text_at[owner + 1]] - sums["="][text_at[owner]]
        prev_code, next_code = self.code[before] & 127, self.code[after] & 127
        columns = [
            has1 & known[before], has2 & known[before2],
            has1 & gap(gap_a, gap_b, "="), has1 & gap(gap_a, gap_b, ":"), has1 & (gap(gap_a, gap_b, '"') | gap(gap_a, gap_b, "'")),
            gap(tail_a, tail_b, '"') | gap(tail_a, tail_b, "'"), gap(tail_a, tail_b, "="),
            self.first[at], last[at],
            has1 & ((prev_code & ~plain) == 0), has3 & ((next_code & ~plain) == 0), has1 & ((prev_code & DIGIT) > 0),
            has3 & ((next_code & DIGIT) > 0),
            equals * 500 > size, (digits[text_at[owner + 1]] - digits[text_at[owner]]) * 20 > size,
        ]
        return np.column_stack(columns).astype(np.float64)


def tokens(texts: pa.Array) -> Tokens:
    data, offsets = raw(texts)
    kinds = BYTE_KINDS[data]
    inside = kinds > 0
    edge = np.zeros(data.size + 1, bool)
    edge[offsets] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    a, b = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    if a.size == 0:
        none = np.zeros(0, np.int64)
        return Tokens(none, none, none, none, np.zeros(0, bool), texts, data, offsets)
    bits = np.bitwise_or.reduceat(kinds, a)
    digit = (kinds & DIGIT) > 0
    switch = np.zeros(data.size, np.int32)
    switch[1:] = (digit[1:] != digit[:-1]) & inside[1:] & inside[:-1]
    turns = np.concatenate([[0], np.cumsum(switch)])
    bits = bits.astype(np.int64) | np.where(turns[b] - turns[np.minimum(a + 1, data.size)] >= 4, SWITCHES, 0)
    owner = np.searchsorted(offsets, a, "right") - 1
    line = np.cumsum(data == 10)[a]
    first = np.ones(a.size, bool)
    first[1:] = (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])
    return Tokens(a, b, owner, np.searchsorted(LENGTHS, b - a, "right") << 7 | bits, first, texts, data, offsets)


@dataclass
class Field:
    """Weights: shape features x labels, context features x labels, transitions, first label."""

    shape: np.ndarray
    context: np.ndarray
    move: np.ndarray
    begin: np.ndarray

    def __post_init__(self):
        self.own = SHAPES @ self.shape
        gains = [self.begin[y] + max(self.move[y, c] - self.move[O, c] for c in range(3)) - self.begin[O] for y in (B, I)]
        gains += [self.move[a, y] - self.move[a, O] + max([0.0, *(self.move[y, c] - self.move[O, c] for c in range(3))]) for y in (B, I) for a in range(3)]
        gains += [self.begin[y] - self.begin[O] for y in (B, I)]
        self.slack = max(0.0, *gains)
        self.best = np.maximum(0, self.context - self.context[:, [O]]).sum(0)

    def lead(self, scores: np.ndarray, more: np.ndarray | float = 0.0) -> np.ndarray:
        """Whether a label other than outside could still win, given the most that may be added."""
        return ((scores - scores[:, [O]] + more)[:, :O] + self.slack >= 0).any(1)

    def labels(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """(tokens that may not be outside, their labels on the best path)."""
        at = np.flatnonzero(self.lead(self.own, self.best)[t.code])
        if at.size == 0:
            return at, at
        scores = self.own[t.code[at]] + t.context(at) @ self.context
        keep = self.lead(scores)
        at, scores = at[keep], scores[keep]
        out = np.full(at.size, O)
        cuts = np.flatnonzero((np.diff(at, prepend=-2) != 1) | t.first[at])
        if at.size == 0:
            return at, out
        for a, b in zip(cuts, [*cuts[1:], at.size], strict=True):
            # Neighbours outside the segment are outside for sure.
            head = self.begin if t.first[at[a]] else self.move[O]
            stop = at[b - 1] + 1 < t.first.size and not t.first[at[b - 1] + 1]
            out[a:b] = self.viterbi(scores[a:b], head, self.move[:, O] if stop else np.zeros(3))
        return at, out

    def viterbi(self, scores: np.ndarray, head: np.ndarray, tail: np.ndarray) -> list[int]:
        value, came = head + scores[0], []
        for row in scores[1:]:
            steps = value[:, None] + self.move
            came.append(steps.argmax(0))
            value = steps.max(0) + row
        path = [int((value + tail).argmax())]
        for back in reversed(came):
            path.append(int(back[path[-1]]))
        return path[::-1]


def silver(t: Tokens) -> np.ndarray:
    """Labels from the fixed patterns; all-digit runs count as numbers, not as secrets."""
    out = np.full(t.start.size, O)
    position = np.concatenate([[0], np.cumsum((t.data & 0xC0) != 0x80)])
    hints = _hinted(t.texts)
    some = hints["assign"] | hints["access"] | hints["hex"]
    for i in np.flatnonzero(some):
        text = t.texts[int(i)].as_py()
        base = position[t.offsets[i]]
        for start, kind, end in base_spans(text):
            if kind == 0:
                start = _COMPILED["assign"][0].match(text, start).start(2)
            elif kind == 2 and text[start:end].isdigit():
                continue
            x, y = np.searchsorted(position[t.start], [base + start, base + end])
            if x < y:
                out[x], out[x + 1 : y] = B, I
    return out


def train(texts: pa.Array, passes: int = PASSES) -> Field:
    """A field fitted to the given texts by gradient steps on the conditional likelihood."""
    rng = np.random.default_rng(11)
    code, context, label, length = [], [], [], []
    for _, part in blocks(texts):
        t = tokens(part)
        if t.start.size == 0:
            continue
        y = silver(t)
        odd = ((t.code >> 7) >= 2) & ((t.code & DIGIT) > 0)
        wanted = (y != O) | odd | (rng.random(y.size) < 0.002)
        spread = np.convolve(wanted, np.ones(2 * NEAR + 1))[NEAR : NEAR + y.size] > 0
        at = np.flatnonzero(spread)
        x = t.context(at)
        cuts = np.flatnonzero((np.diff(at, prepend=-2) != 1) | t.first[at])
        code.append(t.code[at]), context.append(x), label.append(y[at]), length.append(np.diff([*cuts, at.size]))
    none = Field(np.zeros((SHAPES.shape[1], 3)), np.zeros((CONTEXT, 3)), np.zeros((3, 3)), np.array([0.0, 0.0, 1e3]))
    if not code or not (np.concatenate(label) != O).any():
        none.own[:, O] += 1e6
        return none
    code, context, label, length = map(np.concatenate, (code, context, label, length))
    run = np.repeat(np.arange(length.size), length)
    chosen = np.bincount(run, label != O, length.size) > 0
    chosen[rng.permutation(np.flatnonzero(~chosen))[:CLEAN_RUNS]] = True
    code, context, label, length = code[chosen[run]], context[chosen[run]], label[chosen[run]], length[chosen]
    # Altered copies, so that neither the word before a secret nor one shape of it is all that counts.
    copies = [(code, context)]
    for drop in ([0, 1], [2, 3, 4, 5, 6]):
        masked = context.copy()
        masked[:, drop] = 0
        other = (rng.integers(2, LENGTHS.size + 1, code.size) << 7) | DIGIT | LOWER | NOT_HEX | rng.choice([0, UPPER, SWITCHES, UPPER | SWITCHES], code.size)
        copies.append((np.where(label != O, other, code), masked))
    label, length = np.tile(label, 3), np.tile(length, 3)
    code, context = (np.concatenate(x) for x in zip(*copies, strict=True))
    longest = int(min(length.max(), 32))
    pieces = [min(longest, n - k) for n in length for k in range(0, n, longest)]
    begin = np.cumsum([0, *pieces[:-1]])
    step = np.arange(longest)
    real = step < np.array(pieces)[:, None]
    index = np.where(real, begin[:, None] + step, 0)
    x = np.concatenate([SHAPES[code], context], 1)
    d = x.shape[1]
    w, first, second = np.zeros(d * 3 + 12), 0.0, 0.0
    hot = np.eye(3)[label]
    pairs = np.zeros((3, 3))
    inner = real[:, 1:]
    np.add.at(pairs, (label[index[:, :-1]][inner], label[index[:, 1:]][inner]), 1)
    heads = hot[index[:, 0]].sum(0)
    n = len(label)
    for k in range(1, passes + 1):
        emit, move, head = (x @ w[: d * 3].reshape(d, 3)), w[d * 3 : d * 3 + 9].reshape(3, 3), w[-3:]
        e = emit[index]
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = head + e[:, 0]
        for j in range(1, longest):
            alpha[:, j] = np.where(real[:, j, None], _lse(alpha[:, j - 1, :, None] + move, 1) + e[:, j], alpha[:, j - 1])
        for j in range(longest - 2, -1, -1):
            beta[:, j] = np.where(real[:, j + 1, None], _lse(move + (e[:, j + 1] + beta[:, j + 1])[:, None, :], 2), 0)
        total = _lse(alpha[:, -1], 1)
        prob = np.exp(alpha + beta - total[:, None, None]) * real[..., None]
        expected = np.zeros((n, 3))
        expected[index[real]] = prob[real]
        both = np.exp(alpha[:, :-1, :, None] + move + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]) * inner[..., None, None]
        gradient = np.concatenate([(x.T @ (hot - expected)).ravel(), (pairs - both.sum((0, 1))).ravel(), heads - prob[:, 0].sum(0)]) / len(pieces) - 1e-5 * w
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        w += 0.1 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    weights = w[: d * 3].reshape(d, 3)
    return Field(weights[: SHAPES.shape[1]], weights[SHAPES.shape[1] :], w[d * 3 : d * 3 + 9].reshape(3, 3), w[-3:])


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def fit_field(df: DataFrame, text: str, key: str) -> Field:
    """Train on at most ``SAMPLE_TEXTS`` texts of at most ``SAMPLE_CHARS`` characters, chosen by hash of ``key``."""
    return train(sample_texts(df.filter(F.length(text) <= SAMPLE_CHARS), key, text, SAMPLE_TEXTS))


def scan_block(texts: pa.Array, field: Field) -> list[list[tuple[int, int, int]]]:
    """All spans (start, number of the kind, end) of each text, in code points, sorted."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    hints = _hinted(texts)
    for i in np.flatnonzero(np.logical_or.reduce(list(hints.values()))):
        out[i] = base_spans(texts[int(i)].as_py(), [k for k in hints if hints[k][i]])
    t = tokens(texts)
    at, label = field.labels(t)
    if (label != O).any():
        position = np.concatenate([[0], np.cumsum((t.data & 0xC0) != 0x80)])
        run: list[int] = []
        for k, (token, y) in enumerate(zip(at, label, strict=True)):
            if y == O:
                continue
            run.append(token)
            goes_on = k + 1 < at.size and label[k + 1] == I and at[k + 1] == token + 1 and not t.first[token + 1]
            if not goes_on:
                i = int(t.owner[token])
                base = position[t.offsets[i]]
                a, b = int(position[t.start[run[0]]] - base), int(position[t.end[run[-1]]] - base)
                if all(b <= s or e <= a for s, kind, e in out[i] if kind < 3):
                    out[i].append((a, 3, b))
                run = []
        out = [sorted(spans) for spans in out]
    return out


def joined(spans: Sequence[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def scan_secrets(df: DataFrame, text: str, key: str, keep: Sequence[str] = (), field: Field | None = None) -> DataFrame:
    """``keep`` columns, counts by kind, spans ``kind:start:end`` and the digest of the fixed ones.

    One narrow pass after the field is fitted; the field is a few hundred numbers.
    """
    field = field or fit_field(df, text, key)
    fields = [df.schema[c] for c in keep]
    counts = [T.StructField(f"n_{kind}", T.LongType()) for kind in KINDS]
    schema = T.StructType([*fields, *counts, T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spans for _, part in blocks(strings(batch.column(len(keep)))) for spans in scan_block(part, field)]
            numbers = [pa.array([sum(kind == k for _, kind, _ in spans) for spans in found], pa.int64()) for k in range(len(KINDS))]
            digests = [hashlib.sha256(joined([s for s in spans if s[1] < 3]).encode()).hexdigest() for spans in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *numbers, pa.array(digests, pa.string()), pa.array(list(map(joined, found)), pa.string())], names=schema.names)

    return df.select(*[df[c] for c in keep], df[text].alias("__text")).mapInArrow(run, schema)

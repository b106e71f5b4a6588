"""Token counts by compiled finite-state transducers.

Two deterministic transducers are compiled from a byte-level BPE file:

* The **splitter** reads character classes and marks where pre-tokens begin. Its transitions
  carry marks (a token begins here, or began one character ago), so the look-ahead of the
  split pattern needs no backtracking. Text is cut into chunks of ``CHUNK`` characters; each
  chunk is run from every state at once, which gives a state map; the maps compose by a
  parallel prefix scan; a second run from the now known states yields the marks.
* The **counter** reads the bytes of a pre-token. Its state is what the rest of the word can
  depend on: the longest suffix that begins some token, with the last token and the relative
  count at each place in it. A transition carries the change in the number of tokens, so the
  count of a word is the sum along its path. States are compiled when first met.

That the last token of a prefix is its longest suffix token that stays next to the token before
it (checked by undoing merges) is the known equivalence for BPE; ranks must follow the merges.

Empty and null texts have no tokens; special tokens inside texts count as one, as the library
does by default. Extra columns are ignored unless named in ``keep``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import lru_cache
from unicodedata import category

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tablewright.llm.common import SALT, blocks, raw, span_hashes, strings

CHUNK = 256
#: Steps after which a chunk's states have nearly always met; the others go on from all states.
MEET = 16
#: Transitions and words that one worker holds before it starts afresh (memory, not results).
TRANSITIONS, WORDS = 500_000, 400_000

# Classes of characters and states of the splitter.
LETTER, STMD, RV, ELL, EE, NUMBER, SPACE, BLANK, QUOTE, OTHER, END = range(11)
START, IN_L, IN_N, IN_O, ONE_SP, ONE_BL, RUN_SP, RUN_BL, QUOTED, QUOTE_RV, QUOTE_L, SHORT = range(12)
HERE, BACK = 1, 2
STATES, CLASSES = 12, 11


@lru_cache(1)
def splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, marks) by state * CLASSES + class."""
    go, mark = np.zeros((STATES, CLASSES), np.uint8), np.zeros((STATES, CLASSES), np.uint8)
    plain = {c: IN_L for c in (LETTER, STMD, RV, ELL, EE)} | {NUMBER: IN_N, SPACE: ONE_SP, BLANK: ONE_BL, QUOTE: QUOTED, OTHER: IN_O, END: START}
    for state in range(STATES):
        for c, fresh in plain.items():
            go[state, c], mark[state, c] = fresh, HERE
    letters = [LETTER, STMD, RV, ELL, EE]
    for state, same in ((IN_L, letters), (IN_N, [NUMBER]), (IN_O, [QUOTE, OTHER])):
        go[state, same], mark[state, same] = state, 0
    for state in (ONE_SP, ONE_BL, RUN_SP, RUN_BL):
        go[state, SPACE], go[state, BLANK] = RUN_SP, RUN_BL
        mark[state, [SPACE, BLANK]] = 0
    for state, seen in ((ONE_SP, 0), (RUN_SP, BACK)):  # the last space goes with what follows
        follows = [*letters, NUMBER, QUOTE, OTHER]
        mark[state, follows] = seen
        go[state, QUOTE] = IN_O
    mark[RUN_BL, [*letters, NUMBER, QUOTE, OTHER]] = BACK | HERE
    mark[QUOTED, [STMD, RV, ELL, QUOTE, OTHER]] = 0
    go[QUOTED, [STMD, RV, ELL]], go[QUOTED, [QUOTE, OTHER]] = [SHORT, QUOTE_RV, QUOTE_L], IN_O
    mark[QUOTED, [RV, ELL]] = 0
    for state, done in ((QUOTE_RV, EE), (QUOTE_L, ELL)):
        mark[state] = np.where(np.isin(np.arange(CLASSES), letters), BACK, BACK | HERE)
        go[state, done], mark[state, done] = SHORT, 0
    return go.ravel(), mark.ravel()


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    major = np.array([ord(category(chr(c))[0]) for c in range(0x110000)])
    out[major == ord("L")] = LETTER
    out[major == ord("N")] = NUMBER
    # White space of Unicode, a fixed list.
    out[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK
    for chars, value in (("stmd", STMD), ("rv", RV), ("l", ELL), ("e", EE), (" ", SPACE), ("'", QUOTE)):
        out[[ord(c) for c in chars]] = value
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code point, first byte) of each character of UTF-8 bytes."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.uint32)
    code = lead.copy()
    for size, low, top, bits in ((2, 0xC0, 0xE0, 0x1F), (3, 0xE0, 0xF0, 0x0F), (4, 0xF0, 0xF8, 0x07)):
        some = np.flatnonzero((lead >= low) & (lead < top))
        value = lead[some] & bits
        for k in range(1, size):
            value = value << 6 | (data[at[some] + k] & 0x3F)
        code[some] = value
    return code, at


def _run(kinds: np.ndarray, states: np.ndarray, go: np.ndarray) -> np.ndarray:
    """``states`` (chunks x columns) after all characters of ``kinds`` (chunks x characters)."""
    states = states.astype(np.int32)
    for j in range(kinds.shape[1]):
        states = go[states * CLASSES + kinds[:, j, None]].astype(np.int32)
    return states


def state_maps(kinds: np.ndarray) -> np.ndarray:
    """For each chunk, the state it ends in from each state it may begin in."""
    go, _ = splitter()
    maps = _run(kinds[:, :MEET], np.broadcast_to(np.arange(STATES, dtype=np.int32), (len(kinds), STATES)), go)
    met = (maps == maps[:, :1]).all(1)
    one, all_ = np.flatnonzero(met), np.flatnonzero(~met)
    maps[one] = _run(kinds[one, MEET:], maps[one, :1], go)
    if all_.size:
        maps[all_] = _run(kinds[all_, MEET:], maps[all_], go)
    return maps


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Composition of all maps up to each chunk, by doubling."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step], 1)
        step *= 2
    return out


def token_starts(kinds: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at each character; ``kinds`` ends with END."""
    go, mark = splitter()
    n = kinds.size
    rows = -(-n // CHUNK)
    padded = np.full(rows * CHUNK, END, np.uint8)
    padded[:n] = kinds
    grid = padded.reshape(rows, CHUNK)
    state = np.full(rows, START, np.int32)
    state[1:] = prefix_scan(state_maps(grid))[:-1, START]
    marks = np.empty((CHUNK, rows), np.uint8)
    for j in range(CHUNK):
        at = state * CLASSES + grid[:, j]
        marks[j] = mark[at]
        state = go[at].astype(np.int32)
    marks = marks.T.ravel()[:n]
    starts = (marks & HERE).astype(bool)
    starts[:-1] |= (marks[1:] & BACK).astype(bool)
    return starts


class Counter:
    """The counting transducer of one byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        tokens = {bytes(byte[c] for c in text): i for text, i in spec["model"]["vocab"].items() if all(c in byte for c in text)}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.tokens = tokens
        self.begins = {token[:k] for token in tokens for k in range(len(token))}
        size = max(tokens.values()) + 1
        self.parts: list[tuple[int, int]] = [(i, i) for i in range(size)]
        self.joined: dict[tuple[int, int], int] = {}
        for pair in spec["model"]["merges"]:
            left, right = (tokens[bytes(byte[c] for c in x)] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            whole = tokens[bytes(byte[c] for c in "".join(pair if isinstance(pair, list) else pair.split(" ")))]
            self.joined[left, right] = whole
            self.parts[whole] = (left, right)
        self.clear()

    def clear(self) -> None:
        self.words: dict[bytes, int] = {}
        self.steps: dict[int, int] = {}
        self.near: dict[tuple[int, int], bool] = {}
        first: tuple = (b"", (-1,), (0,))
        self.states, self.numbers = [first], {first: 0}

    def stays(self, left: int, right: int) -> bool:
        """Whether two adjacent tokens are what BPE makes of their joint bytes.

        Undo the later of the two merges again and again along the seam: a merge across the
        seam that would have come before it shows that BPE had joined them otherwise.
        """
        known = self.near.get((left, right))
        if known is None:
            before, known = len(self.parts) + 1, True
            a, b = left, right
            while True:
                across = self.joined.get((a, b))
                if across is not None and across < before:
                    known = False
                    break
                can_a, can_b = self.parts[a][1] != a, self.parts[b][0] != b
                if not can_a and not can_b:
                    break
                # Of equal tokens the left one is made first, so the right one is undone first.
                if can_a and (not can_b or a > b):
                    before, a = a, self.parts[a][1]
                else:
                    before, b = b + 1, self.parts[b][0]
            self.near[left, right] = known
        return known

    def compile(self, state: int, byte: int) -> int:
        """The transition as next state * 256 + change + 128."""
        suffix, last, rest = self.states[state]
        suffix += bytes([byte])
        for k in range(len(suffix)):
            if last[k] is not None:
                token = self.tokens.get(suffix[k:])
                if token is not None and (last[k] < 0 or self.stays(last[k], token)):
                    break
        change = rest[k] + 1
        last, rest = (*last, token), (*rest, change)
        # Only places from which a longer token may still come matter to the rest of the word.
        open_ = [last[k] is not None and suffix[k:] in self.begins for k in range(len(last))]
        cut = open_.index(True)
        key = (suffix[cut:], tuple(x if o else None for x, o in zip(last[cut:], open_[cut:], strict=True)), tuple(x - change if o else 0 for x, o in zip(rest[cut:], open_[cut:], strict=True)))
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
        found = self.steps[state << 8 | byte] = number << 8 | change + 128
        return found

    def count(self, word: bytes) -> int:
        known = self.words.get(word)
        if known is None:
            state = known = 0
            for byte in word:
                step = self.steps.get(state << 8 | byte) or self.compile(state, byte)
                state = step >> 8
                known += (step & 255) - 128
            if len(self.steps) > TRANSITIONS:
                self.clear()
            if len(self.words) > WORDS:
                self.words.clear()
            if len(word) < 64:
                self.words[word] = known
        return known


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_block(texts: pa.Array, machine: Counter) -> np.ndarray:
    """The number of tokens of each text."""
    data, offsets = raw(texts)
    out = np.zeros(len(texts), np.int64)
    if data.size == 0:
        return out
    # A special token ends the piece before it and counts as one; its bytes belong to no piece.
    ends, skip = [offsets[1:]], []
    if any(bool(pc.any(pc.match_substring(texts, s)).as_py()) for s in machine.special):
        whole = data.tobytes()
        for m in regex.finditer(b"|".join(regex.escape(s.encode()) for s in sorted(machine.special, key=len, reverse=True)), whole):
            owner = int(np.searchsorted(offsets, m.start(), "right")) - 1
            if m.end() <= offsets[owner + 1]:
                out[owner] += 1
                skip.append((m.start(), m.end()))
                ends.append(np.array(m.span()))
    code, at = code_points(data)
    kinds = classes()[code]
    cuts = np.unique(np.concatenate(ends))
    places = np.searchsorted(at, cuts)
    kinds = np.insert(kinds, places, END)
    first = np.insert(at, places, -1)
    starts = token_starts(kinds) & (first >= 0)
    a = first[starts]
    b = np.append(a[1:], data.size)
    over = np.searchsorted(cuts, a, "right")
    b = np.minimum(b, cuts[np.minimum(over, cuts.size - 1)])
    if skip:
        s = np.array(skip)
        k = np.searchsorted(s[:, 0], a, "right") - 1
        keep = (k < 0) | (a >= s[np.maximum(k, 0), 1])
        a, b = a[keep], b[keep]
    _, where, back = np.unique(span_hashes(SALT[data], a, b), return_index=True, return_inverse=True)
    view = data.tobytes()
    counts = np.array([machine.count(view[x:y]) for x, y in zip(a[where].tolist(), b[where].tolist(), strict=True)], np.int64)
    owner = np.searchsorted(offsets, a, "right") - 1
    return out + np.bincount(owner, counts[back], len(texts)).astype(np.int64)


def count_tokens(df: DataFrame, text: str, path: str, keep: Sequence[str] = (), limit: int = 512) -> DataFrame:
    """``keep`` columns, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of each row.

    ``path`` names the tokenizer's file on every node. One narrow pass: no shuffle, and rows
    lost with an executor are counted again from their input split.
    """
    fields = [df.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = counter(path)
        for batch in batches:
            texts = strings(batch.column(len(keep)))
            counts = [count_block(part, machine) for _, part in blocks(texts)]
            n = pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64))
            size = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], size, n, pc.greater(n, limit)], names=schema.names)

    return df.select(*[df[c] for c in keep], df[text].alias("__text")).mapInArrow(run, schema)

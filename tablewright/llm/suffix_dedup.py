"""Removal of repeated byte strings by an enhanced suffix array over anchored suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a row with a
smaller key, or earlier in the same row. Strings are judged on the input, and none crosses rows.

**Anchors.** Each window of ``LENGTH`` bytes names one of its ``SEED``-byte strings, the one with
the least hash (leftmost of equal ones). Equal windows name the same string at the same offset, so
windows need only be compared where anchors are equal. Consecutive windows with one anchor make
one record: about one per 35 bytes instead of one per byte.

**Records.** Records are dealt by range of (anchor, row) and sorted; what has no equal anchor goes
no further. Records whose whole context is equal are copies: all but the first lose their windows,
most of them while the sorted records stream by, the rest by an aggregation and a join.

**Suffixes.** The contexts that are left differ although their anchors are equal. Their suffixes
from the anchor on are sorted with longest common prefixes, and a stack scan yields the tree of
prefix intervals. The members of an interval are told apart by what stands left of the anchor:
those that agree to both sides by enough for a window are its occurrences, all of them, and all
but the first lose the window. An anchor with more than ``PART`` contexts is dealt over several
tasks; the windows that are first in their part then meet in one more aggregation.

Null texts count as empty. Rows with null keys come after all others. If keys repeat, rows are
ordered by key and then by a hash of the text; rows that are equal in both are one row, and each
gets its result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import SALT, blocks, mixed, raw, span_hashes, strings, written
from tablewright.operators.ranking import dense_codes

LENGTH, SEED = 100, 32
#: Seeds in a window.
PLACES = LENGTH - SEED + 1
#: Contexts of one anchor that one task takes.
PART = 100_000
#: Contexts that are scanned together, if their anchors have fewer.
TOGETHER = 20_000
#: Bytes of a text that are anchored together; longer texts are taken in overlapping pieces.
PIECE = 1 << 22
_MIX = (np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93))


def seed_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``SEED`` bytes from each position (``SEED`` is a power of two)."""
    h, width = SALT[data], 1
    multiplier = 0x9E3779B97F4A7C15 | 1
    while width < SEED:
        h = h[:-width] * np.uint64(pow(multiplier, width, 1 << 64)) + h[width:]
        width *= 2
    return mixed(h)


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: values.size - (width - have)], values[width - have :]) if have < width else values


def records(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, context, text, first window, last window, place of the anchor) of texts laid end to end.

    Windows and places are positions in ``data``.
    """
    none = np.zeros(0, np.int64)
    if data.size < LENGTH:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none, none
    seeds = seed_hashes(data)
    tagged = (seeds >> np.uint64(24) << np.uint64(24)) | np.arange(seeds.size, dtype=np.uint64)
    anchor = (least_of(tagged, PLACES) & np.uint64((1 << 24) - 1)).astype(np.int64)
    size = np.diff(offsets)
    whole = np.flatnonzero(size >= LENGTH)
    if whole.size == 0:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none, none
    count = size[whole] - LENGTH + 1
    text = np.repeat(whole, count)
    window = np.arange(count.sum()) + np.repeat(offsets[whole] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    at = anchor[window]
    new = np.ones(at.size, bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], at.size) - 1
    first, last, place = window[head], window[tail], at[head]
    context = span_hashes(SALT[data], first, last + LENGTH)
    context = mixed(context ^ ((place - first).astype(np.uint64) * _MIX[0]) ^ ((last - first).astype(np.uint64) * _MIX[1]))
    return seeds[place], context, text[head], first, last, place


def pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, text numbers, skipped bytes): texts in blocks, long ones in overlapping pieces."""
    for number, block in blocks(texts):
        data, offsets = raw(block)
        if len(block) > 1 or data.size <= PIECE:
            yield data, offsets, np.arange(number, number + len(block)), np.zeros(len(block), np.int64)
            continue
        for begin in range(0, data.size - LENGTH + 1, PIECE):
            part = data[begin : begin + PIECE + LENGTH - 1]
            yield part, np.array([0, part.size]), np.array([number]), np.array([begin])


RECORD = "anchor long, context long, doc long, pack long"


def pack(first: np.ndarray, last: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Position of the anchor, bytes from the first window to it, and windows after the first."""
    return place << 14 | (place - first) << 7 | (last - first)


def all_records(rows: DataFrame) -> DataFrame:
    """Records of every text of ``rows`` (doc, text); positions count from the text's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).to_numpy()
            for data, offsets, numbers, skipped in pieces(strings(batch.column(1))):
                anchor, context, text, first, last, place = records(data, offsets)
                shift = skipped[text] - offsets[text]
                packed = pack(first + shift, last + shift, place + shift)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64)), pa.array(doc[numbers[text]]), pa.array(packed)], names=["anchor", "context", "doc", "pack"])

    return rows.select("doc", "text").mapInArrow(run, RECORD)


def sifted(found: DataFrame) -> DataFrame:
    """Records that matter: copies, and the first of each context of anchors with several.

    Records are dealt by range of (anchor, row), so a hot anchor spreads over tasks, and sorted.
    Where a context was already met in a row or place before, the record is a copy and keeps no
    anchor. An anchor with one context only has no other work, unless it may go on in the next
    partition. A partition's run of one anchor is the most that is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now, first = None, True
        for batch in batches:
            if batch.num_rows == 0:
                continue
            anchor = batch.column(0).to_numpy()
            if now is not None and anchor[-1] != now:
                cut = int(np.searchsorted(anchor, anchor[-1]))
                yield sift([*held, batch.slice(0, cut)], first, False)
                held, first, batch = [], False, batch.slice(cut)
            elif now is None and anchor[0] != anchor[-1]:
                cut = int(np.searchsorted(anchor, anchor[-1]))
                yield sift([batch.slice(0, cut)], True, False)
                first, batch = False, batch.slice(cut)
            now = anchor[-1]
            held.append(batch)
        if held:
            yield sift(held, first, True)

    def sift(parts: list[pa.RecordBatch], first: bool, last: bool) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        anchor, context, doc, packed = (c.to_numpy() for c in rows.columns)
        new_anchor, head = np.ones(anchor.size, bool), np.ones(anchor.size, bool)
        new_anchor[1:] = anchor[1:] != anchor[:-1]
        head[1:] = new_anchor[1:] | (context[1:] != context[:-1])
        number = np.cumsum(new_anchor) - 1
        several = np.bincount(number, head) > 1
        several[0] |= first
        several[-1] |= last
        keep = ~head | several[number]
        copies = ~head[keep]
        columns = [pa.array(x[keep], mask=copies) for x in (anchor, context)] + [pa.array(x[keep]) for x in (doc, packed)]
        return pa.RecordBatch.from_arrays(columns, names=["anchor", "context", "doc", "pack"])

    return found.repartitionByRange("anchor", "doc", "pack").sortWithinPartitions("anchor", "context", "doc", "pack").mapInArrow(run, RECORD)


def _matrix(parts: Sequence[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(-1, width)


def _sorted(matrix: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of the rows by group, bytes and length."""
    padded = np.zeros((len(matrix), -(-matrix.shape[1] // 8) * 8), np.uint8)
    padded[:, : matrix.shape[1]] = matrix
    columns = padded.view(">u8").astype(np.uint64)
    return np.lexsort((size, *columns.T[::-1], group))


def _common(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of rows."""
    equal = a == b
    return np.minimum(np.where(equal.all(1), a.shape[1], equal.argmin(1)), np.minimum(size_a, size_b))


def prefix_intervals(lcp: Sequence[int]) -> Iterator[tuple[int, int, int, int]]:
    """(depth, first, last, depth of the parent) of every interval of a suffix array.

    ``lcp[i]`` is what suffixes i - 1 and i have in common; lcp[0] is ignored. One scan with a
    stack of open intervals; an interval is closed by the first smaller value.
    """
    open_ = [(-1, 0)]
    for i, depth in enumerate([*lcp[1:], -1], 1):
        begin = i - 1
        while depth < open_[-1][0]:
            top, begin = open_.pop()
            yield top, begin, i - 1, max(depth, open_[-1][0])
        if depth > open_[-1][0]:
            open_.append((depth, begin))


def repeated_windows(group: np.ndarray, left: Sequence[bytes], right: Sequence[bytes], order: np.ndarray) -> np.ndarray:
    """Which windows of each context occur earlier: contexts x bytes left of the anchor.

    ``group`` tells anchors apart, ``left`` is reversed, and ``order`` says what is earlier.
    """
    n = len(group)
    gone = np.zeros((n, PLACES), bool)
    if n < 2:
        return gone
    size_l, size_r = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    before, after = _matrix(left, PLACES - 1), _matrix(right, LENGTH)
    array = _sorted(after, size_r, group)
    rank_l = np.empty(n, np.int64)
    rank_l[_sorted(before, size_l, group)] = np.arange(n)
    x, y = array[:-1], array[1:]
    lcp = np.full(n, -1)
    lcp[1:] = np.where(group[x] == group[y], _common(after[x], after[y], size_r[x], size_r[y]), -1)
    beside = np.zeros(n, np.int64)
    beside[1:] = _common(before[x], before[y], size_l[x], size_l[y])
    for depth, a, b, parent in prefix_intervals(lcp.tolist()):
        low, high = max(0, LENGTH - depth), min(PLACES - 1, LENGTH - 1 - max(parent, SEED - 1))
        if low > high or depth < SEED:
            continue
        if b == a + 1:
            # Two occurrences: they share the windows as far as their left sides agree.
            later = array[a] if order[array[a]] > order[array[b]] else array[b]
            gone[later, low : min(high, int(beside[b])) + 1] = True
            continue
        members = array[a : b + 1]
        members = members[np.argsort(rank_l[members])]
        p, q = members[:-1], members[1:]
        agree = _common(before[p], before[q], size_l[p], size_l[q])
        place = order[members]
        # Left sides split the occurrences further as more bytes are asked of them.
        steps = [low, *(np.unique(agree[(agree >= low) & (agree < high)]) + 1).tolist(), high + 1]
        for o, stop in zip(steps[:-1], steps[1:], strict=True):
            heads = np.concatenate([[0], np.flatnonzero(agree < o) + 1])
            first = np.repeat(np.minimum.reduceat(place, heads), np.diff([*heads, members.size]))
            gone[members[place > first], o:stop] = True
    return gone


SPAN = "doc long, start long, end long, window binary"


def scan_contexts(contexts: DataFrame) -> DataFrame:
    """Spans of windows that occur earlier, from contexts (anchor, part, parts, doc, pack, bytes).

    Where an anchor is dealt over several parts, windows that are first in their part are given
    too, with a hash of their bytes.
    """

    def work(batch: pa.Table) -> pa.RecordBatch:
        packed, doc, parts = (batch.column(c).combine_chunks().to_numpy() for c in ("pack", "doc", "parts"))
        text = batch.column("bytes").to_pylist()
        place, lead, windows = packed >> 14, packed >> 7 & 127, packed & 127
        left = [t[:k][::-1] for t, k in zip(text, lead.tolist(), strict=True)]
        right = [t[k : k + LENGTH] for t, k in zip(text, lead.tolist(), strict=True)]
        key = np.stack([batch.column(c).combine_chunks().to_numpy() for c in ("anchor", "part")])
        group = np.cumsum(np.concatenate([[False], (key[:, 1:] != key[:, :-1]).any(0)]))
        order = np.empty(len(text), np.int64)
        order[np.lexsort((place, doc))] = np.arange(len(text))
        gone = repeated_windows(group, left, right, order)
        edges = np.diff(np.pad(gone, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, low = np.nonzero(edges == 1)
        _, high = np.nonzero(edges == -1)
        docs, starts, ends = [doc[row]], [place[row] - (high - 1)], [place[row] - low + LENGTH]
        hashes: list[bytes | None] = [None] * row.size
        split = np.flatnonzero(parts > 1)
        if split.size:
            o = np.arange(PLACES)
            valid = (o <= lead[split, None]) & (o >= (lead - windows)[split, None]) & ~gone[split]
            r, o = np.nonzero(valid)
            r = split[r]
            docs.append(doc[r]), starts.append(place[r] - o), ends.append(place[r] - o + LENGTH)
            hashes += [hashlib.blake2b(text[k][a : a + LENGTH], digest_size=16).digest() for k, a in zip(r.tolist(), (lead[r] - o).tolist(), strict=True)]
        columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in (docs, starts, ends)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(hashes, pa.binary())], names=["doc", "start", "end", "window"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, last = 0, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            # Scan what is held when enough of it is there and an anchor begins.
            keys = np.stack([batch.column(c).to_numpy() for c in ("anchor", "part")])
            new = np.concatenate([[last is not None and tuple(keys[:, 0]) != last], (keys[:, 1:] != keys[:, :-1]).any(0)])
            cut = 0
            if rows >= TOGETHER and new.any():
                cut = int(new.argmax())
                yield work(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held, rows = [], 0
            last = tuple(keys[:, -1])
            held.append(batch.slice(cut))
            rows += batch.num_rows - cut
        if held:
            yield work(pa.Table.from_batches(held))

    return contexts.repartition("anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(run, SPAN)


def with_bytes(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of each wanted record (anchor, part, parts, doc, pack)."""
    schema = "anchor long, part int, parts int, doc long, pack long, bytes binary"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc, text, found in zip(batch.column(0).to_pylist(), strings(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes()
                for w in found:
                    first = (w["pack"] >> 14) - (w["pack"] >> 7 & 127)
                    values = (w["anchor"], w["part"], w["parts"], doc, w["pack"], data[first : first + (w["pack"] & 127) + LENGTH])
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("anchor", "part", "parts", "pack")).alias("found"))
    return rows.select("doc", "text").join(lists, "doc").mapInArrow(run, schema)


def removed_spans(rows: DataFrame) -> DataFrame:
    """(doc, start, end): strings of at least ``LENGTH`` bytes that also start earlier; they may overlap."""
    found = written(sifted(all_records(rows)), "records")
    firsts = found.filter("anchor IS NOT NULL")
    contexts = written(firsts.groupBy("anchor", "context").agg(F.min(F.struct("doc", "pack")).alias("first"), F.count("*").alias("n")), "contexts")
    # Copies of a whole context: every occurrence but the first loses all its windows. Most were
    # seen while sorting; the rest are first in their partition only.
    later = firsts.join(contexts.filter("n > 1").select("anchor", "context", "first"), ["anchor", "context"]).filter(F.struct("doc", "pack") != F.col("first"))
    copied = found.filter("anchor IS NULL").select("doc", "pack").unionByName(later.select("doc", "pack"))
    start = F.shiftright("pack", 14) - F.shiftright("pack", 7).bitwiseAND(127)
    copies = copied.select("doc", start.alias("start"), (start + F.col("pack").bitwiseAND(127) + LENGTH).alias("end"))
    # Different contexts of one anchor.
    shared = contexts.groupBy("anchor").agg(F.count("*").alias("size")).filter("size > 1")
    wanted = contexts.select("anchor", "context", "first.*").join(shared, "anchor").withColumn("parts", F.ceil(F.col("size") / PART).cast("int"))
    wanted = written(wanted.withColumn("part", F.pmod("context", F.col("parts")).cast("int")).select("anchor", "part", "parts", "doc", "pack"), "wanted")
    scanned = written(scan_contexts(with_bytes(rows, wanted)), "spans")
    spans = copies.unionByName(scanned.filter("window IS NULL").drop("window"))
    if not wanted.filter("parts > 1").isEmpty():
        firsts = scanned.filter("window IS NOT NULL")
        least = firsts.groupBy("window").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1")
        spans = spans.unionByName(firsts.join(least, "window").filter(F.struct("doc", "start") != F.col("first")).select("doc", "start", "end"))
    return spans


def merged(spans: DataFrame) -> DataFrame:
    """(doc, starts, ends): maximal removed runs of each row, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, starts, ends = None, [], []
        for batch in batches:
            out: list[tuple[int, list[int], list[int]]] = []
            for doc, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if doc != now:
                    if now is not None:
                        out.append((now, starts, ends))
                    now, starts, ends = doc, [a], [b]
                elif a <= ends[-1]:
                    ends[-1] = max(ends[-1], b)
                else:
                    starts.append(a), ends.append(b)
            yield _spans(out)
        if now is not None:
            yield _spans([(now, starts, ends)])

    def _spans(rows: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["doc", "starts", "ends"])

    return spans.repartition("doc").sortWithinPartitions("doc", "start").mapInArrow(run, "doc long, starts array<bigint>, ends array<bigint>")


def numbered(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """All rows as (key, doc, text) with a ``doc`` per key and text in the order of keys, and each doc once."""
    rows = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    again = rows.groupBy("key").count().filter((F.col("count") > 1) | F.col("key").isNull())
    if again.isEmpty():
        rows = rows.select("key", F.col("key").alias("doc"), "text")
        return rows, rows
    place = F.struct(F.col("key").isNull().alias("last"), F.coalesce("key", F.lit(0)).alias("key"), F.xxhash64("text").alias("text"))
    rows = rows.withColumn("place", place)
    codes = dense_codes(rows, "place").select(F.col("value").alias("place"), F.col("code").alias("doc"))
    rows = rows.join(codes, "place").select("key", "doc", "text")
    return rows, rows.dropDuplicates(["doc"])


RESULT = "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def dedupe_substrings(df: DataFrame, key: str, text: str, with_kept: bool = False) -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept_sha256 of each row (and ``kept``, the bytes left)."""
    rows, once = numbered(df, key, text)
    spans = merged(removed_spans(once))
    names = [f.split()[0] for f in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key_, value, starts, ends in zip(batch.column(0).to_pylist(), strings(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                data = value.as_buffer().to_pybytes()
                starts, ends = starts or [], ends or []
                kept = b"".join(data[a:b] for a, b in zip([0, *ends], [*starts, len(data)], strict=True))
                out.append((key_, len(data), len(data) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)

    joined = rows.join(spans, "doc", "left").select("key", "text", "starts", "ends")
    result = joined.mapInArrow(run, RESULT).withColumnRenamed("key", key)
    return result if with_kept else result.drop("kept")

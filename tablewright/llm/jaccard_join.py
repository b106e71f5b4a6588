"""Similarity join of word-shingle sets by chosen paths.

Texts become sets of hashed runs of ``WORDS`` words; texts with equal sets are one class from the
start, so copies never meet each other. A set is embedded as ``SIGNS`` MinHash values. From the
root of each run, a node samples ``BRANCH`` positions, and the sets that agree at a position go
down together. A node with at most ``BUCKET`` sets is compared by brute force; larger ones are
split again, up to ``DEPTH`` times. What cannot be split by then (near copies of each other) is
compared in pairs of blocks, so no task holds or emits more than a block. Runs are repeated until
a pair at the threshold shares a leaf with probability ``RECALL``.

Leaves compare signatures with a margin of ``MARGIN`` standard errors and emit only a spanning
forest. Inside the components of that forest every pair of sets is compared exactly, again in
blocks: this counts links and finds the classes. A set's shingles travel once per block pair.

Texts of 1 to ``WORDS - 1`` words have one shingle, all their words. Texts without words (null and
empty ones too) and rows with a null key take no part: no class but their own, no links. Repeated
rows are copies. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import blocks, lower_words, maybe_broadcast, mixed, run_hashes, stored, strings
from tablewright.llm.components import components

WORDS, THRESHOLD = 5, 0.8
SIGNS, BRANCH, BUCKET, DEPTH, RECALL = 64, 2, 64, 3, 0.999
MARGIN = 4.0
#: Sets in a block, and shingles in a block: what one task holds of a large bucket or component.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1_000_000
#: Most keys that are sent to all executors instead of shuffling the texts (8 bytes each).
KEYS = 1_000_000

_RNG = np.random.Generator(np.random.PCG64(77))
_A = _RNG.integers(1, 1 << 63, SIGNS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, SIGNS, dtype=np.uint64)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each text."""
    for _, part in blocks(texts):
        _, _, h, owner = lower_words(part)
        runs, at = run_hashes(h, owner, WORDS)
        first = np.searchsorted(owner, np.arange(len(part) + 1))
        cuts = np.searchsorted(at, first)
        for i in range(len(part)):
            size = first[i + 1] - first[i]
            if 0 < size < WORDS:
                yield run_hashes(h[first[i] : first[i + 1]], owner[first[i] : first[i + 1]], int(size))[0]
            else:
                yield np.unique(runs[cuts[i] : cuts[i + 1]])


def set_id(shingles: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    return np.array([mixed(shingles).sum(dtype=np.uint64), mixed(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)], np.uint64).tobytes()


def signature(shingles: np.ndarray) -> np.ndarray:
    low = np.full(SIGNS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, shingles.size, 4096):
        np.minimum(low, ((shingles[k : k + 4096, None] * _A + _B) >> np.uint64(32)).min(0), out=low)
    return low.astype(np.uint32).view(np.int32)


def sketch(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, id, signs) of each row; id and signs are null where there is nothing to compare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, signs = [], []
            for key_, s in zip(batch.column(0).to_pylist(), shingle_sets(strings(batch.column(1))), strict=True):
                usable = s.size > 0 and key_ is not None
                ids.append(set_id(s) if usable else None)
                signs.append(signature(s) if usable else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(signs, pa.list_(pa.int32()))], names=["key", "id", "signs"])

    return df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "key long, id binary, signs array<int>")


def shingles_of(df: DataFrame, text: str) -> DataFrame:
    """(id, shingles) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(strings(batch.column(0))))
            yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["id", "shingles"])

    return df.select(F.col(text).alias("text")).mapInArrow(run, "id binary, shingles array<bigint>")


def runs_needed(threshold: float) -> int:
    """Runs after which a pair at the threshold has met in a leaf with probability ``RECALL``."""
    one = (1 - (1 - threshold) ** BRANCH) ** 2
    return math.ceil(math.log(1 - RECALL) / math.log(1 - one))


def _blocked(rows: DataFrame, blocks_of: Column) -> DataFrame:
    """Each row once for every pair of blocks that its own block is part of (i <= j)."""
    rows = rows.withColumn("blocks", blocks_of).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    paired = rows.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    return paired.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("blocks", "other")


def leaves(sets: DataFrame, threshold: float) -> DataFrame:
    """(bucket, size, id) after all runs: buckets of at least two sets that are not split further."""
    roots = [(r, r * BRANCH + b) for r in range(runs_needed(threshold)) for b in range(BRANCH)]
    start = F.explode(F.array(*[F.xxhash64(F.lit(r), F.lit(p % SIGNS), F.element_at("signs", p % SIGNS + 1)) for r, p in roots]))
    rows, out = sets.select("id", start.alias("bucket")), None
    for depth in range(DEPTH):
        counted = rows.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
        rows = stored(rows.join(counted, "bucket"))
        last = depth == DEPTH - 1
        done = rows if last else rows.filter(F.col("size") <= BUCKET)
        out = done if out is None else out.unionByName(done)
        large = rows.filter(F.col("size") > BUCKET)
        if last or large.isEmpty():
            break
        place = lambda b: F.pmod(F.xxhash64("bucket", F.lit(b)), F.lit(SIGNS)).cast("int")
        child = F.explode(F.array(*[F.xxhash64("bucket", place(b), F.element_at("signs", place(b) + 1)) for b in range(BRANCH)]))
        rows = large.select("bucket", "id").join(sets, "id").select("id", child.alias("child")).withColumnRenamed("child", "bucket")
    return out


def _streamed(batches: Iterator[pa.RecordBatch], group: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows sorted by ``group``, one group at a time."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in group]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if now is not None and key != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def _roots(linked: np.ndarray) -> np.ndarray:
    """The least member of each member's component in a matrix of links."""
    out = np.full(len(linked), -1)
    for k in range(len(linked)):
        if out[k] < 0:
            reached = np.zeros(len(linked), bool)
            reached[k] = True
            front = np.array([k])
            while front.size:
                new = linked[front].any(0) & ~reached
                reached |= new
                front = np.flatnonzero(new)
            out[reached] = k
    return out


def candidate_edges(buckets: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) that span the sets of each bucket whose signatures are close enough."""
    least = threshold * SIGNS - MARGIN * math.sqrt(threshold * (1 - threshold) * SIGNS)
    rows = _blocked(buckets, F.greatest(F.lit(1), F.ceil(F.when(F.col("size") > 2 * BLOCK_SETS, F.col("size") / BLOCK_SETS).otherwise(1))))
    rows = rows.join(sets.select("id", "signs"), "id").select("bucket", "i", "j", "id", "signs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for _, group in _streamed(batches, ["bucket", "i", "j"]):
            if group.num_rows < 2:
                continue
            ids = group.column("id").to_pylist()
            signs = group.column("signs").combine_chunks().flatten().to_numpy().reshape(-1, SIGNS)
            same = np.zeros((len(ids), len(ids)), np.uint8)
            for column in signs.T:
                same += column[:, None] == column
            for k, root in enumerate(_roots(same >= least)):
                if root != k:
                    a.append(ids[k]), b.append(ids[root])
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "id").mapInArrow(run, "a binary, b binary")


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of at least ``threshold``; exact."""
    n = len(sets)
    size = np.array([s.size for s in sets])
    shared = np.zeros((n, n), np.int64)
    owner = np.repeat(np.arange(n), size)
    token, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(inverse, kind="stable")
    order = order[count[inverse[order]] > 1]
    owner, column = owner[order], np.unique(inverse[order], return_inverse=True)[1]
    width = max(64, min(2048, (1 << 22) // max(n, 1)))
    ends = np.searchsorted(column, np.arange(0, (column[-1] if column.size else -1) + width + 1, width))
    for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        part = np.zeros((n, width), np.float32)
        part[owner[a:b], column[a:b] - k * width] = 1
        shared += (part @ part.T).astype(np.int64)
    # Integers on both sides where the threshold allows: 0.8 of a union is tested as 5 * shared >= 4 * union.
    whole = round(threshold * 1000)
    return shared * 1000 >= (size[:, None] + size - shared) * whole


def exact_links(members: DataFrame, threshold: float) -> DataFrame:
    """(id, links, root) of each set and block pair: linked copies counted, and a spanning edge."""
    size = members.groupBy("comp").agg(F.count("*").alias("n"), F.sum(F.size("shingles")).alias("total"))
    block_count = F.greatest(F.lit(1), F.when((F.col("n") > 2 * BLOCK_SETS) | (F.col("total") > 2 * BLOCK_SHINGLES), F.ceil(F.greatest(F.col("n") / BLOCK_SETS, F.col("total") / BLOCK_SHINGLES))))
    rows = _blocked(members.join(size, "comp"), block_count).select("comp", "i", "j", "own", "id", "copies", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), group in _streamed(batches, ["comp", "i", "j"]):
            ids = group.column("id").to_pylist()
            copies, own = group.column("copies").to_numpy(), group.column("own").to_numpy()
            sets = np.split(*_flat(group.column("shingles").combine_chunks()))
            linked = similar(sets, threshold)
            np.fill_diagonal(linked, False)
            roots = _roots(linked)
            counted = linked if i == j else linked & (own[:, None] != own)
            links = counted @ copies
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(links.astype(np.int64)), pa.array([ids[r] for r in roots], pa.binary())], names=["id", "links", "root"])

    return rows.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "id").mapInArrow(run, "id binary, links long, root binary")


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    at = lists.offsets.to_numpy()
    return lists.flatten().to_numpy(), (at - at[0])[1:-1]


def near_duplicates(df: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``df``: key, class_id (least key of its class) and n_links.

    Rows are of one class if a chain of links joins them; ``n_links`` counts the other rows whose
    similarity is at least the threshold, copies included.
    """
    sketched = stored(sketch(df, key, text))
    sets = stored(sketched.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min("key").alias("least"), F.count("*").alias("copies"), F.first("signs").alias("signs")))
    edges = candidate_edges(leaves(sets, threshold), sets, threshold)
    found = components(edges).select(F.col("node").alias("id"), F.col("root").alias("comp"))
    members = found.join(sets.select("id", "least", "copies"), "id")
    members = stored(members)
    wanted = maybe_broadcast(members.select(F.col("least").alias("__key")), KEYS)
    # A key may stand for several texts; those of other sets fall out by their ids.
    texts = df.join(wanted, df[key].cast("long") == F.col("__key"), "left_semi")
    shingled = shingles_of(texts, text).dropDuplicates(["id"]).join(members, "id")
    linked = stored(exact_links(shingled.select("comp", "id", "copies", "shingles"), threshold))
    roots = components(linked.filter("id != root").select(F.col("id").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("id"), "root")
    classed = linked.groupBy("id").agg(F.sum("links").alias("links")).join(roots, "id").join(members.select("id", "least"), "id")
    heads = classed.groupBy("root").agg(F.min("least").alias("class_id"))
    classes = sets.select("id", "least", "copies").join(classed.join(heads, "root").select("id", "class_id", "links"), "id", "left")
    classes = classes.select("id", F.coalesce("class_id", "least").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = sketched.select("key", "id").join(classes, "id", "left")
    return out.select(F.col("key").alias(key), F.coalesce("class_id", "key").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(df: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with one row of each class, the one with the least key; rows with null keys stay.

    Rows with one key and different texts count as different documents and stay if any of them
    is kept; equal rows with one key are one document.
    """
    classes = near_duplicates(df, key, text, threshold)
    rows = classes.filter(F.col(key).isNotNull()).groupBy(key).agg(F.bool_and(F.col(key) != F.col("class_id")).alias("gone"), F.count("*").alias("rows"))
    rows = stored(rows.filter("gone OR rows > 1"))
    gone = rows.filter("gone").select(F.col(key).alias("__key"))
    kept = df.join(maybe_broadcast(gone, KEYS), df[key].cast("long") == F.col("__key"), "left_anti")
    if rows.filter("NOT gone").isEmpty():
        return kept
    with_key = kept.filter(F.col(key).isNotNull()).dropDuplicates([key, text])
    return with_key.unionByName(kept.filter(F.col(key).isNull()))

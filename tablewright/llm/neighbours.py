"""Approximate nearest neighbours by a forest of hash prefixes.

Each tree gives a vector a string of ``LENGTH`` bits (the signs of its products with random
directions). Every partition of the rows keeps, for each tree, its strings in a sorted array. A
query goes down every tree to the rows with which it shares the longest prefix, then up all trees
at once, one bit at a time, until the rows met in any tree are enough. All rows of the last level
count, so a large set of equal vectors is never cut. Those rows are scored exactly, and the best
of each partition meet in one aggregation per query.

How far up to go is fitted: on a bounded sample, the smallest share of rows is taken whose recall
against brute force is at least ``RECALL``. Clustered vectors need few rows, isotropic ones many.

Vectors that are null, all zero, of another length than most, or that hold null or non-finite
components take no part. Equal scores go to the smaller id. Repeated rows (same id and vector)
are candidates each; a query is asked once per id and vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import small, stored

TREES, LENGTH = 48, 32
#: The fit: rows and queries of the sample, the recall to reach on it, and the shares tried.
SAMPLE_ROWS, SAMPLE_QUERIES, RECALL = 8192, 200, 0.97
SHARES = [0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
#: Queries that travel together, and rows that one array of a forest holds.
QUERY_BLOCK, SHARD_ROWS = 4096, 16_384


def directions(width: int, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, TREES * LENGTH))


def strings_of(unit: np.ndarray, centre: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """The hash string of each vector in each tree, as an unsigned integer (first bit highest)."""
    bits = ((unit - centre) @ planes > 0).reshape(len(unit), TREES, LENGTH)
    return bits @ (np.uint64(1) << np.arange(LENGTH - 1, -1, -1, dtype=np.uint64))


@dataclass
class Forest:
    """Sorted arrays of hash strings of some rows, one per tree."""

    unit: np.ndarray
    centre: np.ndarray
    planes: np.ndarray

    def __post_init__(self):
        keys = strings_of(self.unit, self.centre, self.planes).T
        self.order = np.argsort(keys, axis=1, kind="stable")
        self.keys = np.take_along_axis(keys, self.order, 1)

    def candidates(self, queries: np.ndarray, enough: int) -> Iterator[np.ndarray]:
        """For each query, whether each row is a candidate."""
        n = len(self.unit)
        asked = strings_of(queries, self.centre, self.planes)
        met = np.zeros((len(queries), LENGTH + 1), np.int64)
        low = np.zeros((LENGTH + 1, TREES, len(queries)), np.int32)
        high = np.full_like(low, n)
        for depth in range(1, LENGTH + 1):
            shift = np.uint64(LENGTH - depth)
            for t in range(TREES):
                first = asked[:, t] >> shift << shift
                low[depth, t] = np.searchsorted(self.keys[t], first)
                high[depth, t] = np.searchsorted(self.keys[t], first + (np.uint64(1) << shift))
            met[:, depth] = (high[depth] - low[depth]).sum(0)
        # Rows met in several trees count once: go up from the deepest level that could be enough.
        for q in range(len(queries)):
            depth = int(np.flatnonzero((met[q] >= enough) | (np.arange(LENGTH + 1) == 0))[-1])
            while True:
                mark = np.zeros(n, bool)
                if depth == 0:
                    mark[:] = True
                else:
                    for t in range(TREES):
                        mark[self.order[t, low[depth, t, q] : high[depth, t, q]]] = True
                if depth == 0 or int(mark.sum()) >= enough:
                    break
                depth -= 1
            yield mark


def cosines(vectors: np.ndarray, norms: np.ndarray, query: np.ndarray) -> np.ndarray:
    return (vectors @ query) / (norms * np.linalg.norm(query))


def best(forest: Forest, vectors: np.ndarray, norms: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, enough: int, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the query, ids, scores) of its ``k`` nearest candidates; its own id is none."""
    unit = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    for q, mark in enumerate(forest.candidates(unit, enough)):
        at = np.flatnonzero(mark & (ids != query_ids[q]))
        score = cosines(vectors[at], norms[at], queries[q])
        if at.size > k:
            least = np.partition(score, at.size - k)[at.size - k]
            at, score = at[score >= least], score[score >= least]
        top = np.lexsort((ids[at], -score))[:k]
        yield q, ids[at][top], score[top]


def fit_share(vectors: np.ndarray, k: int) -> float:
    """The smallest share of rows to look at with the wanted recall on the sample."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    forest = Forest(unit, unit.mean(0), directions(vectors.shape[1]))
    norms, ids = np.linalg.norm(vectors, axis=1), np.arange(len(vectors))
    asked = np.arange(min(SAMPLE_QUERIES, len(vectors)))
    truth = [set(np.lexsort((ids, -np.where(ids == q, -np.inf, s)))[: min(k, len(ids) - 1)]) for q in asked for s in [cosines(vectors, norms, vectors[q])]]
    total = sum(map(len, truth))
    for share in SHARES:
        enough = max(4 * k, int(np.ceil(share * len(vectors))))
        hits = sum(len(truth[q] & set(found)) for q, found, _ in best(forest, vectors, norms, ids, vectors[asked], asked, enough, k))
        if hits >= RECALL * total:
            return share
    return 1.0


def usable(vector: str) -> Column:
    """Whether a vector takes part: no null or non-finite component, and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _stack(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(df: DataFrame, key: str, vector: str, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found for each query row.

    Queries travel in blocks of ``QUERY_BLOCK`` to all rows; only the best of each shard are
    shuffled. Rows are hashed and sorted where they lie.
    """
    spark = df.sparkSession
    rows = df.filter(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"), is_query.alias("q"))
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if width is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("v") == width[0])
    spread = F.xxhash64("id")
    total = rows.count()
    sample = rows.filter(spread < int((3.0 * SAMPLE_ROWS / total - 1) * (1 << 63))) if total > 2 * SAMPLE_ROWS else rows
    sample = np.array([r[0] for r in sample.orderBy(spread, "v").select("v").limit(SAMPLE_ROWS).collect()], np.float64)
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    centre, share = unit.mean(0), fit_share(sample, k)
    queries = rows.filter("q").select("id", "v").distinct()
    if not small(queries, QUERY_BLOCK):
        # Each query belongs to one block; blocks are read in turn from the stored queries.
        queries = stored(queries)
    count = queries.count()
    block_count = -(-count // QUERY_BLOCK)
    found = None
    for b in range(block_count):
        part = queries.filter(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(block_count)) == b).collect()
        out = _search_block(rows, [r[0] for r in part], np.array([r[1] for r in part], np.float64).reshape(len(part), width[0]), centre, share, k)
        found = out if found is None else found.unionByName(out)
    if found is None:
        return spark.createDataFrame([], schema)
    # The limit on the rank is also applied by each task before the shuffle.
    place = Window.partitionBy("query", "twin").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), "rank", "vec_id", "score")


def _search_block(rows: DataFrame, ids: list[int], vectors: np.ndarray, centre: np.ndarray, share: float, k: int) -> DataFrame:
    shipped = rows.sparkSession.sparkContext.broadcast((np.array(ids, np.int64), vectors, centre))
    schema = "query long, twin int, vec_id long, score double"

    def shard(own: list[np.ndarray], at: list[np.ndarray]) -> pa.RecordBatch:
        asked_ids, asked, middle = shipped.value
        vectors, own_ids = np.concatenate(own), np.concatenate(at)
        norms = np.linalg.norm(vectors, axis=1)
        forest = Forest(vectors / norms[:, None], middle, directions(vectors.shape[1]))
        enough = max(4 * k, int(np.ceil(share * len(vectors))))
        hits = list(best(forest, vectors, norms, own_ids, asked, asked_ids, enough, k))
        size = [len(found) for _, found, _ in hits]
        q = np.repeat(np.array([q for q, _, _ in hits], np.int32), size)
        found, score = (np.concatenate([np.zeros(0, kind), *(h[j] for h in hits)]) for j, kind in ((1, np.int64), (2, np.float64)))
        # An id need not tell queries apart: a query is an id and a vector (its twin number).
        return pa.RecordBatch.from_arrays([pa.array(asked_ids[q]), pa.array(q), pa.array(found), pa.array(score)], names=["query", "twin", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at, held = [], [], 0
        for batch in batches:
            if batch.num_rows:
                own.append(_stack(batch.column(1))), at.append(batch.column(0).to_numpy())
                held += batch.num_rows
            if held >= SHARD_ROWS:
                yield shard(own, at)
                own, at, held = [], [], 0
        if held:
            yield shard(own, at)

    return rows.select("id", "v").mapInArrow(run, schema)


"""Benchmark decontamination: word runs find candidates, the rarest first, alignment scores them.

The words of the test items are counted over all training texts. The rarity of a run of ``RUN``
words of an item is the probability that its words, drawn independently at their corpus shares,
make it up. An item's rarest runs are its seeds, until ``n // RUN`` of them (n words in the item)
lie side by side without overlap, and beyond that all runs of at most ``RARE``. So a copy with
fewer than ``n // RUN`` changed words, wherever they are, keeps a seed; with that many, it may
have no run of the item left. Items of fewer than ``2 * RUN`` words, and items without a run of at
most ``RARE``, seed all of their runs. Seeds are looked up in every text. Around the seeds of one
item the text is aligned with the whole item (Smith-Waterman over words, so that replaced, added
and dropped words cost a little), and the pair is reported if the score is at least ``SCORE`` of
what an exact copy gets; for a short item of common words, half of its words in a row are enough.

Items of ``ITEM_BLOCK`` words together, at most, travel to all texts, and no text is shuffled. More
items than that stay in Spark, with the same result: words are counted and joined with those of the
items, each item's seeds are chosen in a row of its own, and texts that a bit table of the seeds (8 MB,
whatever their number) lets through are joined with seeds, cut into windows, and joined with the
items. Words, seeds and items that many rows share are salted. Texts meet their leaks by a digest of
the text, so copies of a text are searched once; a hot one is left to the adaptive skew join.

Items with fewer than ``RUN`` words (null and empty ones too) cannot be told from chance and are
never reported; null and empty texts hold nothing. Equal rows get equal answers, equal items are
reported each. Input columns named like the added one get the suffix ``_input``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.collocations import bit_table, hits
from tablewright.llm.common import blocks, lower_words, run_hashes, set_aside, strings, written

RUN = 3
RARE = 1e-8
SCORE = 0.45
#: Scores of equal and different words, and of a word that only one side has.
EQUAL, DIFFERENT, GAP = 2.0, -1.0, -1.0
ITEM_BLOCK = 1_000_000
#: Copies of a row that a hot value is dealt over.
SALTS = 16

LEAK = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("n_seeds", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType())]))
_ARROW_LEAK = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("n_seeds", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())]))


@dataclass
class Items:
    """Test items as word hashes, with a sorted table of their seeds."""

    ids: list[int]
    words: list[np.ndarray]
    seeds: np.ndarray
    item: np.ndarray
    place: np.ndarray


def listed(items: DataFrame, key: str, text: str) -> DataFrame:
    """item (a digest of id and text), item_id, words (hashes as bytes) and n of items of ``RUN`` words or more."""
    rows = items.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("item_id"), F.coalesce(text, F.lit("")).alias("text")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, block in blocks(strings(batch.column(2))):
                _, _, h, owner = lower_words(block)
                cuts = np.searchsorted(owner, np.arange(len(block) + 1))
                held = [h[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, len(block)) for i in (0, 1)), pa.array(held, pa.binary()), pa.array(np.diff(cuts))], names=["item", "item_id", "words", "n"])

    digest = F.sha2(F.concat_ws(":", F.col("item_id").cast("string"), "text"), 256)
    return rows.select(digest.alias("item"), "item_id", "text").mapInArrow(run, "item string, item_id long, words binary, n long").filter(F.col("n") >= RUN)


def word_shares(df: DataFrame, text: str, vocabulary: np.ndarray) -> np.ndarray:
    """The share that each of the (sorted) words has in all words of all texts."""
    shipped = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        counts, total = np.zeros(known.size, np.int64), 0
        for batch in batches:
            for _, part in blocks(strings(batch.column(0))):
                h = lower_words(part)[2]
                total += h.size
                at = np.minimum(np.searchsorted(known, h), known.size - 1)
                counts += np.bincount(at[known[at] == h], minlength=known.size)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(counts[seen], total))], names=["word", "n"])

    rows = df.select(text).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out, total = np.zeros(vocabulary.size), 1
    for word, n in rows:
        if word < 0:
            total = max(n, 1)
        else:
            out[word] = n
    return np.maximum(out, 1) / total


def apart(places: np.ndarray) -> int:
    """How many runs that begin at the (sorted) places fit side by side without overlap."""
    n, free = 0, 0
    for at in places.tolist():
        if at >= free:
            n, free = n + 1, at + RUN
    return n


def seed_limit(chance: np.ndarray, words: int) -> float:
    """The rarity up to which the runs of an item of so many words are seeds."""
    if words < 2 * RUN or not (chance <= RARE).any():
        return np.inf
    # The least rarity at which as many runs lie apart as the item has room for.
    steps = np.unique(chance)
    low, high = 0, steps.size - 1
    while low < high:
        middle = (low + high) // 2
        if apart(np.flatnonzero(chance <= steps[middle])) >= words // RUN:
            high = middle
        else:
            low = middle + 1
    return max(RARE, steps[low])


def rare_runs(shares: np.ndarray) -> np.ndarray:
    """Which runs of an item are seeds, given the share of each of its words."""
    chance = np.prod([shares[j : shares.size - RUN + 1 + j] for j in range(RUN)], 0)
    return chance <= seed_limit(chance, shares.size)


def seeded(ids: list[int], held: list[np.ndarray], vocabulary: np.ndarray, shares: np.ndarray) -> Items:
    """Choose the seeds of a block of items."""
    seeds, item, place = [], [], []
    for k, h in enumerate(held):
        runs, at = run_hashes(h, np.zeros(h.size, np.int64), RUN)
        use = rare_runs(shares[np.searchsorted(vocabulary, h)])
        seeds.append(runs[use]), item.append(np.full(use.sum(), k)), place.append(at[use])
    seeds, item, place = map(np.concatenate, (seeds, item, place))
    order = np.argsort(seeds, kind="stable")
    return Items(ids, held, seeds[order], item[order], place[order])


def align(item: np.ndarray, window: np.ndarray) -> tuple[float, int]:
    """Best local alignment score of two word lists, and the word of the window it ends at."""
    steps = np.arange(window.size + 1) * -GAP
    above = np.zeros(window.size + 1)
    best, end = 0.0, 0
    for word in item:
        row = np.zeros(window.size + 1)
        row[1:] = np.maximum(above[:-1] + np.where(window == word, EQUAL, DIFFERENT), above[1:] + GAP)
        np.maximum(row, 0, out=row)
        # The best of coming from any place to the left: a running maximum of score plus distance.
        row = np.maximum.accumulate(row + steps) - steps
        k = int(row.argmax())
        if row[k] > best:
            best, end = float(row[k]), k
        above = row
    return best, end


def leaks_of_block(texts: pa.Array, items: Items, least: float) -> list[list[dict]]:
    """For each text, the items it holds a copy of."""
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    _, _, h, owner = lower_words(texts)
    runs, at = run_hashes(h, owner, RUN)
    if runs.size == 0 or items.seeds.size == 0:
        return out
    low, high = np.searchsorted(items.seeds, runs), np.searchsorted(items.seeds, runs, "right")
    hit = np.flatnonzero(low < high)
    if hit.size == 0:
        return out
    times = (high - low)[hit]
    seed = np.repeat(low[hit], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    where = np.repeat(at[hit], times)
    text, item, start = owner[where], items.item[seed], where - items.place[seed]
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    for k in _groups(text, item, start, [w.size for w in items.words]):
        i, j = int(text[k[0]]), int(item[k[0]])
        wanted = items.words[j]
        slack = max(5, wanted.size // 4)
        a = max(int(first[i]), int(start[k].min()) - slack)
        b = min(int(first[i + 1]), int(start[k].max()) + wanted.size + slack)
        # Each word of the item that the window lacks is lost to the score.
        if EQUAL * np.isin(wanted, h[a:b]).sum() < least * EQUAL * wanted.size:
            continue
        score, end = align(wanted, h[a:b])
        if score >= least * EQUAL * wanted.size:
            out[i].append({"item_id": items.ids[j], "score": score / (EQUAL * wanted.size), "n_seeds": int(np.unique(where[k]).size), "first_word": max(0, a + end - wanted.size - int(first[i])), "last_word": a + end - int(first[i])})
    # One row per item: the best place it is found at.
    for i, found in enumerate(out):
        if len(found) > 1:
            best: dict[int, dict] = {}
            for x in sorted(found, key=lambda x: (-x["score"], x["first_word"], x["last_word"], x["n_seeds"])):
                best.setdefault(x["item_id"], x)
            out[i] = [best[x] for x in sorted(best)]
    return out


def _groups(text: np.ndarray, item: np.ndarray, start: np.ndarray, sizes: list[int]) -> Iterator[np.ndarray]:
    """Hits of one text and item whose implied starts lie within the item's length of each other."""
    order = np.lexsort((start, item, text))
    reach = np.array(sizes)[item[order]]
    new = np.ones(order.size, bool)
    new[1:] = (np.diff(text[order]) != 0) | (np.diff(item[order]) != 0) | (np.diff(start[order]) > reach[1:])
    cuts = np.append(np.flatnonzero(new), order.size)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield order[a:b]


def salted(left: DataFrame, right: DataFrame, on: str, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join where many rows of ``left`` may share a value: they are dealt, by the hash of ``by``, over copies of its ``right`` row."""
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = left.withColumn("__salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))
    return dealt.join(copies, [on, "__salt"], how).drop("__salt")


def joined_seeds(df: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """seed, item, place and n (words of the item) of every seed; nothing comes to the driver but one total."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, held in zip(batch.column(0), batch.column(1), strict=True):
                h = np.frombuffer(held.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * h.size), pa.array(np.arange(h.size)), pa.array(h)], names=["item", "place", "word"])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in blocks(strings(batch.column(0))):
                word, n = np.unique(lower_words(part)[2], return_counts=True)
                # The row without a word holds the total.
                words = pa.concat_arrays([pa.array(word.view(np.int64)), pa.nulls(1, pa.int64())])
                yield pa.RecordBatch.from_arrays([words, pa.array(np.append(n, n.sum()).astype(np.int64))], names=["word", "times"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, held, times in zip(*(batch.column(i) for i in range(3)), strict=True):
                h = np.frombuffer(held.as_py(), np.uint64)
                runs, at = run_hashes(h, np.zeros(h.size, np.int64), RUN)
                use = rare_runs(np.maximum(times.values.to_numpy(), 1) / total)
                yield pa.RecordBatch.from_arrays([pa.array(runs[use].view(np.int64)), pa.array([item.as_py()] * int(use.sum()), pa.string()), pa.array(at[use]), pa.array(np.full(use.sum(), h.size))], names=["seed", "item", "place", "n"])

    word_at = wanted.select("item", "words").mapInArrow(places, "item string, place long, word long")
    asked = word_at.select("word").distinct().union(word_at.sparkSession.range(1).select(F.lit(None).cast("long"))).withColumnRenamed("word", "asked")
    all_words = df.select(text).mapInArrow(counts, "word long, times long").groupBy("word").agg(F.sum("times").alias("times"))
    known = written(all_words.join(asked, F.col("word").eqNullSafe(F.col("asked")), "left_semi"), "words")
    row = known.filter(F.col("word").isNull()).first()
    total = max(row["times"], 1) if row else 1
    priced = salted(word_at, known.filter(F.col("word").isNotNull()), "word", ["item", "place"], "left")
    of_item = priced.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("place", F.coalesce("times", F.lit(0)).alias("times")))).alias("all"))
    rows = wanted.join(of_item, "item").select("item", "words", F.col("all.times").alias("times"))
    return written(rows.mapInArrow(choose, "seed long, item string, place long, n long"), "seeds")


def joined_leaks(df: DataFrame, text: str, wanted: DataFrame, least: float) -> DataFrame:
    """``__text`` (digest) and ``leaks`` of the texts that hold a copy of an item; all sides are tables."""
    seeds = joined_seeds(df, text, wanted)
    bits = df.sparkSession.sparkContext.broadcast(bit_table(seeds.select(F.lit(1).alias("k"), F.col("seed").alias("a"), F.lit(0).cast("long").alias("b"))))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, block in blocks(strings(batch.column(1))):
                _, _, h, owner = lower_words(block)
                runs, at = run_hashes(h, owner, RUN)
                use = hits(bits.value, runs)
                runs, at = runs[use].view(np.int64), at[use]
                cuts = np.searchsorted(owner, np.arange(len(block) + 1))
                of_text = np.searchsorted(at, cuts)
                kept = np.flatnonzero(np.diff(of_text)).tolist()
                spans = [slice(of_text[i], of_text[i + 1]) for i in kept]
                held = [h[cuts[i] : cuts[i + 1]].tobytes() for i in kept]
                numbers = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(block)).take(pa.array(kept, pa.int64())), pa.array(held, pa.binary()), pa.array([runs[x] for x in spans], numbers), pa.array([at[x] - cuts[i] for i, x in zip(kept, spans, strict=True)], numbers)],
                    names=["t", "words", "seeds", "places"],
                )

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                start, at = (np.array([x[c] for x in row["hits"]], np.int64) for c in ("start", "at"))
                slack = max(5, row["n"] // 4)
                for k in np.split(np.arange(start.size), np.flatnonzero(np.diff(start) > row["n"]) + 1):
                    out.append((row["t"], row["item"], max(0, int(start[k[0]]) - slack), int(start[k[-1]]) + row["n"] + slack, int(np.unique(at[k]).size)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["t", "item", "a", "b", "n_seeds"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, held, wins in zip(*(batch.column(i) for i in range(3)), strict=True):
                h = np.frombuffer(held.as_py(), np.uint64)
                for w in wins:
                    w = w.as_py()
                    yield pa.RecordBatch.from_arrays([pa.array([t.as_py()]), pa.array([w["item"]]), pa.array([w["a"]]), pa.array([w["n_seeds"]]), pa.array([h[w["a"] : w["b"]].tobytes()], pa.binary())], names=["t", "item", "a", "n_seeds", "window"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for t, a, n_seeds, window, item_id, held in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                item, here = np.frombuffer(held, np.uint64), np.frombuffer(window, np.uint64)
                if EQUAL * np.isin(item, here).sum() < least * EQUAL * item.size:
                    continue
                got, end = align(item, here)
                if got >= least * EQUAL * item.size:
                    for column, x in zip(out, (t, item_id, got / (EQUAL * item.size), n_seeds, max(0, a + end - item.size), a + end), strict=True):
                        column.append(x)
            kinds = (pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["t", *_ARROW_LEAK.value_type.names])

    texts = df.filter(F.col(text).isNotNull()).select(F.sha2(text, 256).alias("t"), text)
    found = written(texts.mapInArrow(look, "t string, words binary, seeds array<long>, places array<long>").dropDuplicates(["t"]), "candidates")
    bits.destroy()
    each = found.select("t", F.explode(F.arrays_zip("seeds", "places")).alias("x")).select("t", F.col("x.seeds").alias("seed"), F.col("x.places").alias("at"))
    pairs = salted(each, seeds, "seed", ["t", "at"]).groupBy("t", "item").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct((F.col("at") - F.col("place")).alias("start"), "at"))).alias("hits"))
    wins = written(pairs.mapInArrow(windows, "t string, item string, a long, b long, n_seeds long"), "windows")
    of_text = wins.groupBy("t").agg(F.collect_list(F.struct("item", "a", "b", "n_seeds")).alias("windows"))
    parts = found.select("t", "words").join(of_text, "t").mapInArrow(cut, "t string, item string, a long, n_seeds long, window binary")
    aligned = salted(parts, wanted.select("item", "item_id", "words"), "item", ["t", "a"]).select("t", "a", "n_seeds", "window", "item_id", "words")
    fields = [f.name for f in LEAK.elementType.fields]
    scored = aligned.mapInArrow(score, "t string, item_id long, score double, n_seeds long, first_word long, last_word long")
    best = scored.groupBy("t", "item_id").agg(F.min_by(F.struct(*fields), F.struct(-F.col("score"), "first_word", "last_word", "n_seeds")).alias("leak"))
    return written(best.groupBy(F.col("t").alias("__text")).agg(F.sort_array(F.collect_list("leak")).alias("leaks")), "leaks")


def find_leaks(df: DataFrame, text: str, items: DataFrame, item_key: str, item_text: str, keep: Sequence[str] | None = None, least: float = SCORE) -> DataFrame:
    """``keep`` columns (all, if not given) and ``leaks``: the test items found in each row."""
    df = set_aside(df, "leaks") if keep is None else df
    keep = df.columns if keep is None else list(keep)
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("leaks", LEAK)])
    wanted = written(listed(items, item_key, item_text), "items")
    size = wanted.agg(F.sum("n")).first()[0]
    if not size:
        return df.select(*keep, F.array().cast(LEAK).alias("leaks"))
    if size > ITEM_BLOCK:
        leaks = joined_leaks(df, text, wanted, least)
        marked = df.select(*keep, F.sha2(text, 256).alias("__text")).join(leaks.withColumnRenamed("leaks", "__leaks"), "__text", "left")
        return marked.select(*keep, F.coalesce("__leaks", F.array().cast(LEAK)).cast(LEAK).alias("leaks"))
    rows = wanted.select("item_id", "words").orderBy("item_id", "item").collect()
    ids, held = [r[0] for r in rows], [np.frombuffer(bytes(r[1]), np.uint64) for r in rows]
    vocabulary = np.unique(np.concatenate(held))
    shipped = df.sparkSession.sparkContext.broadcast(seeded(ids, held, vocabulary, word_shares(df, text, vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(len(keep)))
            found: list[list[dict]] = []
            for _, block in blocks(texts):
                found += leaks_of_block(block, shipped.value, least)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, _ARROW_LEAK)], names=schema.names)

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)

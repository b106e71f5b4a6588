"""Collocations by dynamic itemset counting: phrases of 2 to 4 words that occur often and together.

The corpus is written once as ``SHARDS`` shards of hashed words, which are then scanned in a circle. Words are
counted as they are hashed. At every stop between two scans the phrases that have reached ``LEAST``
occurrences so far are looked up, and a longer phrase becomes active as soon as both phrases it
has less one word (its beginning and its end) have. It is counted from the next shard on, until
the circle has come round to where it began: one full cycle, after which its count is exact.
Lengths are therefore counted side by side, and the scans end when a whole cycle activates nothing.

Which phrases have reached the threshold goes to the tasks as a bit table of fixed size
(2 ** ``BITS`` bits, three bits a phrase), whatever the corpus. A phrase that passes it by chance is
counted without need, never wrongly: the tables only grow, and in shard j of a cycle a task counts
what is active now and was not when j was last scanned, so every occurrence counts once.
An exact threshold on the sums ends the work.

A phrase that reaches ``LEAST`` within a cycle has a shard with ``LEAST / SHARDS`` of them. Sums are
therefore made only for phrases with such a shard (again by a bit table); all others, most of the
rows, are never shuffled a second time. Within a cycle a stop adds up the shards with so many alone,
which may activate a phrase late but never wrongly; at the end of a cycle the sums are exact. A phrase of
k words is active by the end of cycle k - 1, so at the end of cycle k all of its length are complete.

Words are known by 64-bit hashes that contain the language, phrases by the pair of their beginning
and their end. All counted words are checked for two with one hash; if there were any, the work is
done again with another salt.

Null and empty texts have no words; a null language is ``und``. Repeated rows count as often as
they occur. An empty table yields no rows. Other columns are not looked at, so their names are free.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.llm.common import BASE, BLOCK, SALT, blocks, mixed, raw, span_hashes, strings, written
from tablewright.session import scratch_path

#: Occurrences of a candidate, words of the longest one, shards of the circle, phrases reported of a language.
LEAST, LONGEST, SHARDS, TOP = 30, 4, 2, 2000
#: A phrase goes if a longer one around it has this many hundredths of its occurrences.
COVERED = 80
#: Size of the bit tables: 8 MB each, at every size of the corpus.
BITS = 26
SHIFTS = tuple(range(0, 64 - BITS + 1, (64 - BITS) // 2))

SECOND = np.random.Generator(np.random.PCG64(577215)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BREAK, BLANK = np.zeros(256, bool), np.zeros(256, bool)
BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
BLANK[[32, 9]] = True
#: The corpus has rows of about so many words, if texts are not longer: an Arrow batch has 1,024 rows, and is held by JVM and Python. Phrases are packed in rows of at most so many, and dealt to parts of about so many bytes of text, 64 at least.
RUN, ROW, PART_BYTES, PARTS = 1 << 11, 1 << 9, 16 << 20, 64
COUNTS = "part int, k int, a binary, b binary, n binary, lang array<string>, word array<string>"


def words_of(texts: pa.Array, langs: np.ndarray):
    """Words of a block: (start, end, hash, second hash, piece, text number), and the lower-case bytes."""
    data, offsets = raw(pc.ascii_lower(texts))
    broken = BREAK[data]
    inside = ~(broken | BLANK[data])
    edge = np.zeros(data.size + 1, bool)
    edge[offsets] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    a, b = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    owner = np.searchsorted(offsets, a, "right") - 1
    piece = np.cumsum(broken)[a] + owner
    h = mixed(span_hashes(SALT[data], a, b) ^ langs[owner])
    return a, b, h, mixed(span_hashes(SECOND[data], a, b) + langs[owner]), piece, owner, data


def phrase_id(k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * np.uint64(BASE) + b + np.uint64(k))


def bits_of(ids: np.ndarray) -> Iterator[np.ndarray]:
    for shift in SHIFTS:
        yield (ids >> np.uint64(shift)) & np.uint64((1 << BITS) - 1)


def hits(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids the table may hold."""
    at = np.arange(ids.size)
    for place in bits_of(ids):
        place = place[at]
        at = at[(table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0]
    out = np.zeros(ids.size, bool)
    out[at] = True
    return out


def active(h: np.ndarray, piece: np.ndarray, table: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, first words, beginnings, ends) of the occurrences whose two parts the table holds."""
    at, ids = np.arange(h.size), h
    for k in range(2, longest + 1):
        known = hits(table, ids)
        at, ids = at[known], ids[known]
        pair = np.flatnonzero(np.diff(at) == 1)
        pair = pair[piece[at[pair]] == piece[at[pair] + k - 1]]
        first, a, b = at[pair], ids[pair], ids[pair + 1]
        yield k, first, a, b
        at, ids = first, phrase_id(k, a, b)


def tally(key: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(one place of each pair (a, b), how often it occurs), in order of ``key``, a hash of the pair."""
    order = np.argsort(key)
    one, two, new = a[order], b[order], np.diff(key[order], prepend=0) != 0
    new[:1] = True
    if (~new[1:] & ((one[1:] != one[:-1]) | (two[1:] != two[:-1]))).any():
        order = np.lexsort((b, a, key))
        one, two, key = a[order], b[order], key[order]
        new[1:] = (key[1:] != key[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    heads = np.flatnonzero(new)
    if n is None:
        return order[heads], np.diff(heads, append=key.size)
    return order[heads], np.add.reduceat(n[order], heads) if heads.size else n[:0]


def _texts(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Array:
    ends = np.cumsum(b - a)
    at = np.repeat(a - (ends - (b - a)), b - a) + np.arange(ends[-1] if ends.size else 0)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.StringArray.from_buffers(a.size, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[at].tobytes()))


def _binary(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), cuts.size - 1, [None, pa.py_buffer((cuts * values.itemsize).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _packed(k: int, key: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, parts: int, lang: pa.Array | None = None, word: pa.Array | None = None) -> pa.RecordBatch:
    """Phrases in order of ``key`` as rows of at most ``ROW`` of one part of the keys."""
    # Equal steps of the keys, so that parts are runs of them.
    first = np.array([(i << 64) // parts for i in range(parts)], np.uint64)
    cuts = np.unique(np.concatenate([np.searchsorted(key, first), np.arange(0, key.size, ROW), [key.size]]))
    part = np.searchsorted(first, key[cuts[:-1]], "right") - 1
    columns = [pa.array(part.astype(np.int32)), pa.array(np.full(part.size, k, np.int32)), *[_binary(x, cuts) for x in (a, b, n.astype(np.int64))]]
    for text in (lang, word):
        columns.append(pa.nulls(part.size, pa.list_(pa.string())) if text is None else pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), text.cast(pa.string())))
    return pa.RecordBatch.from_arrays(columns, names=["part", "k", "a", "b", "n", "lang", "word"])


def _numbers(column: pa.Array | pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers in a column of packed ones, and how many each row has."""
    data, sizes = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(chunk):
            chunk = chunk.cast(pa.binary())
            ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            data.append(np.frombuffer(chunk.buffers()[2], np.uint8)[ends[0] : ends[-1]])
            sizes.append(np.diff(ends) // np.dtype(kind).itemsize)
    return np.concatenate(data).view(kind), np.concatenate(sizes)


def _opened(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(k, a, b, n) of all phrases in packed rows."""
    a, sizes = _numbers(batch.column("a"), np.uint64)
    k = np.repeat(batch.column("k").to_numpy(), sizes)
    return k, a, _numbers(batch.column("b"), np.uint64)[0], _numbers(batch.column("n"), np.int64)[0]


def _merged(parts: int):
    """Sums of the phrases of one part."""

    def run(table: pa.Table) -> pa.Table:
        out = []
        for k in np.unique(table.column("k").to_numpy()):
            mine = table.filter(pc.equal(table.column("k"), int(k)))
            _, a, b, n = _opened(mine)
            key = a if k == 1 else phrase_id(int(k), a, b)
            place, n = tally(key, a, b, n)
            texts = [mine.column(c).combine_chunks().flatten().take(pa.array(place)) if k == 1 else None for c in ("lang", "word")]
            out.append(_packed(int(k), key[place], a[place], b[place], n, parts, *[x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in texts]))
        return pa.Table.from_batches(out)

    return run


@contextmanager
def _shipped(spark: SparkSession, *tables: np.ndarray | None):
    """Bit tables on all executors, packed, and gone from them (and their disks) afterwards."""
    sent = spark.sparkContext.broadcast([None if t is None else zlib.compress(t.tobytes(), 1) for t in tables])
    yield lambda: [None if t is None else np.frombuffer(zlib.decompress(t), np.uint8) for t in sent.value]
    sent.destroy()


def _tokenized(rows: DataFrame, shards: int, parts: int, salt: int) -> DataFrame:
    """The words of (text, lang) as hashes, a run of whole texts a row (k = 0), and counted by block (k = 1), dealt to shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, held = TaskContext.get().partitionId(), []

        def counted() -> pa.RecordBatch:
            h, g, n = (np.concatenate([x[i] for x in held]) for i in range(3))
            at, n = tally(h, h, g, n)
            texts = [pa.concat_arrays([x[i] for x in held]).take(pa.array(at)) for i in (3, 4)]
            held.clear()
            return _packed(1, h[at], h[at], g[at], n, parts, *texts)

        def dealt(out: pa.RecordBatch) -> pa.RecordBatch:
            return out.append_column("shard", pa.array(np.full(out.num_rows, turn % shards, np.int32)))

        for batch in batches:
            lang = batch.column(1).dictionary_encode()
            names = lang.dictionary
            codes = np.array([int.from_bytes(hashlib.sha256(f"{salt}:{x}".encode()).digest()[:8], "little") for x in names.to_pylist()], np.uint64)
            of_text = lang.indices.to_numpy(zero_copy_only=False)
            for first, part in blocks(strings(batch.column(0)), 3 * BLOCK):
                mine = of_text[first : first + len(part)]
                start, end, h, g, piece, owner, data = words_of(part, codes[mine])
                if not h.size:
                    continue
                at, n = tally(h, h, g)
                held.append((h[at], g[at], n, names.take(pa.array(mine[owner[at]])), _texts(data, start[at], end[at])))
                texts = np.flatnonzero(np.diff(owner)) + 1
                cuts = np.concatenate([[0], texts[np.diff(texts // RUN, prepend=0) > 0], [h.size]])
                none = pa.nulls(cuts.size - 1, pa.list_(pa.string()))
                zero = pa.array(np.zeros(cuts.size - 1, np.int32))
                heads = _binary((np.diff(piece, prepend=-1) != 0).astype(np.uint8), cuts)
                yield dealt(pa.RecordBatch.from_arrays([zero, zero, _binary(h, cuts), heads, pa.nulls(cuts.size - 1, pa.binary()), none, none], names=["part", "k", "a", "b", "n", "lang", "word"]))
                # Words of many blocks are counted together, and go with them to one shard.
                if sum(x[0].size for x in held) >= BLOCK >> 1:
                    yield dealt(counted())
                    turn += 1
        if held:
            yield dealt(counted())

    return rows.mapInArrow(run, COUNTS + ", shard int")


def _scan(shard: DataFrame, tables, longest: int, salt: int) -> DataFrame:
    """What is counted in one scan of a shard (of words hashed with ``salt``): phrases newly active.

    ``tables`` gives the bit tables of now and of the last scan of the shard. Most phrases occur once in a block: they
    are packed, some hundred or thousand in a row, and summed by ``_merged``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, past = tables()
        for whole in batches:
            sizes = _numbers(whole.column("a"), np.uint64)[1]
            steps = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // (BLOCK >> 1), prepend=-1))
            for first, last in zip(steps, [*steps[1:], whole.num_rows]):
                batch = whole.slice(first, last - first)
                parts = batch.column("parts")[0].as_py()
                h, piece = _numbers(batch.column("a"), np.uint64)[0], np.cumsum(_numbers(batch.column("b"), np.uint8)[0], dtype=np.int64)
                old = active(h, piece, past, longest) if past is not None else iter([(0, np.zeros(0, np.int64))] * longest)
                for (k, at, a, b), (_, done, *_) in zip(active(h, piece, table, longest), old, strict=False):
                    if done.size:
                        new = np.ones(h.size, bool)
                        new[done] = False
                        new = new[at]
                        a, b = a[new], b[new]
                    if a.size:
                        key = phrase_id(k, a, b)
                        place, n = tally(key, a, b)
                        yield _packed(k, key[place], a[place], b[place], n, parts)

    return shard.mapInArrow(run, COUNTS)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    k, a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
    a, b = a.astype(np.int64).view(np.uint64), b.astype(np.int64).view(np.uint64)
    return np.where(k == 1, a, mixed(a * np.uint64(BASE) + b + k.astype(np.uint64)))


def bit_table(rows: DataFrame) -> np.ndarray:
    """Bits of all phrases in ``rows`` (k, a, b), joined on the executors; 8 MB come back at most."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = np.unique(np.concatenate(list(bits_of(_ids(batch)))))
            yield pa.RecordBatch.from_arrays([pa.array(every.astype(np.int64) + 1)], names=["place"])

    bucket = F.bitmap_bucket_number("place")
    parts = rows.select("k", "a", "b").mapInArrow(places, "place long").groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for bucket, bits in parts.collect():
        out[(bucket - 1) << 12 : bucket << 12] = np.frombuffer(bytes(bits), np.uint8)
    return out


def _loose(counted: DataFrame, tables, share: int) -> DataFrame:
    """(k, a, b, n) of the packed phrases with ``share`` in a scan, or in the bit table if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (table,) = tables() if tables else (None,)
        for batch in batches:
            k, a, b, n = _opened(batch)
            often = n >= share
            if table is not None:
                rest = np.flatnonzero(~often)
                often[rest] = hits(table, np.where(k[rest] == 1, a[rest], mixed(a[rest] * np.uint64(BASE) + b[rest] + k[rest].astype(np.uint64))))
            yield pa.RecordBatch.from_arrays([pa.array(k[often]), pa.array(a[often].view(np.int64)), pa.array(b[often].view(np.int64)), pa.array(n[often])], names=["k", "a", "b", "n"])

    return counted.select("k", "a", "b", "n").mapInArrow(run, "k int, a long, b long, n long")


def _words(counted: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, a, b, n = _opened(batch)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), batch.column("lang").flatten(), batch.column("word").flatten(), pa.array(n)], names=["a", "b", "lang", "word", "n"])

    return counted.filter("k = 1").mapInArrow(run, "a long, b long, lang string, word string, n long")


def _sums(counted: DataFrame, heavy, share: int, least: int) -> DataFrame:
    """(k, a, b, n) of all phrases counted ``least`` times or more, given the bit table of those with ``share`` in one scan."""
    return _loose(counted, heavy, share).groupBy("k", "a", "b").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _with_id(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("id", pa.array(_ids(batch).view(np.int64)))

    return rows.select("k", "a", "b", "n").mapInArrow(run, "k int, a long, b long, n long, id long")


def count_phrases(df: DataFrame, text: str, lang: str, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS, salt: int = 0) -> tuple[DataFrame, DataFrame]:
    """All words (id, lang, word, n) and all phrases of 2 to ``longest`` words counted ``least`` times (k, a, b, n, id).

    ``a`` and ``b`` are the ids of a phrase without its last and without its first word.
    """
    spark: SparkSession = df.sparkSession
    rows = df.select(F.coalesce(text, F.lit("")).alias("text"), F.coalesce(lang, F.lit("und")).alias("lang"))
    parts = max(PARTS, (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shards // PART_BYTES)
    source = scratch_path(spark, "shards")
    _tokenized(rows, shards, parts, salt).write.partitionBy("shard").parquet(source)
    circle = spark.read.schema(COUNTS + ", shard int").parquet(source)

    share = -(-least // shards)
    empty = np.zeros(1 << (BITS - 3), np.uint8)
    heavy, reached, scans = empty.copy(), [empty], []
    # Few phrases have the share in a scan: these are kept apart, for the bits and for stops within a cycle.
    often, exact = [], []
    # It ends with a cycle, since only then all sums are exact.
    while len(scans) % shards or not scans or (reached[-1] != reached[-1 - shards]).any():
        visit = len(scans)
        shard = circle.filter(F.col("shard") == visit % shards).drop("shard")
        corpus = shard.filter("k = 0").select("a", "b", F.lit(parts).alias("parts"))
        with _shipped(spark, reached[-1], reached[-1 - shards] if visit >= shards else None) as tables:
            counted = _scan(corpus, tables, longest, salt)
            if visit < shards:
                counted = shard.filter("k = 1").unionByName(counted)
            scans.append(written(counted.groupBy("part").applyInArrow(_merged(parts), COUNTS), "counts"))
        often.append(written(_loose(scans[-1], None, share), "often"))
        heavy |= bit_table(often[-1])
        # Lengths up to the number of full cycles so far are complete, and were looked up when they became so.
        done, open_ = divmod(visit + 1, shards)
        lengths = (F.col("k") < longest) & (F.col("k") >= (done if open_ == 0 else done + 1))
        if open_:
            found = bit_table(reduce(DataFrame.unionByName, often).filter(lengths).groupBy("k", "a", "b").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))
        else:
            with _shipped(spark, heavy) as tables:
                sums = written(_sums(reduce(DataFrame.unionByName, scans).filter(lengths), tables, share, least), "sums")
            if 1 < done < longest:
                exact.append(sums.filter(F.col("k") == done))
            found = bit_table(sums)
        reached = [*reached[-shards:], reached[-1] | found]

    every = reduce(DataFrame.unionByName, scans)
    words = written(_words(every).groupBy("a", "b", "lang", "word").agg(F.sum("n").alias("n")).select(F.col("a").alias("id"), "lang", "word", "n"), "words")
    with _shipped(spark, heavy) as tables:
        rest = _sums(every.filter(F.col("k") > 1 + len(exact)), tables, share, least)
        phrases = written(_with_id(reduce(DataFrame.unionByName, exact, rest)), "phrases")
    if words.groupBy("id").count().filter("count > 1").limit(1).count() or phrases.groupBy("id").count().filter("count > 1").limit(1).count():
        return count_phrases(df, text, lang, least, longest, shards, salt + 1)
    return words, phrases


def _whole(x: Column) -> Column:
    return x.cast("decimal(28,0)")


def mine_phrases(df: DataFrame, text: str, lang: str, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS, top: int = TOP) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score (see the module)."""
    words, phrases = count_phrases(df, text, lang, least, longest, shards)
    none = F.array().cast("array<bigint>")
    level = words.filter(F.col("n") >= least).select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "n", none.alias("left"), none.alias("right"))
    around = phrases.select(F.col("a").alias("id"), "n").unionByName(phrases.select(F.col("b").alias("id"), "n")).groupBy("id").agg(F.max("n").alias("longer"))
    found = []
    for k in range(2, longest + 1):
        begin = level.select(F.col("id").alias("a"), "lang", "phrase", F.concat("left", F.array("n")).alias("left"))
        end = level.select(F.col("id").alias("b"), "last", F.concat(F.array("n"), "right").alias("right"))
        own = phrases.filter(F.col("k") == k).select("id", "a", "b", "n")
        level = written(own.join(begin, "a").join(end, "b").select("id", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "n", "left", "right"), f"phrases{k}")
        cuts = []
        for cut in range(k - 1):
            l, r = F.col("left")[cut], F.col("right")[cut]
            score = F.call_function("div", _whole(F.col("n")) * F.lit(2_000_000).cast("decimal(8,0)"), _whole(l) + _whole(r)).cast("long")
            cuts.append(F.struct(score.alias("score"), F.lit(cut).alias("cut"), l.alias("l"), r.alias("r")))
        found.append(level.select("id", "lang", "phrase", F.col("n").alias("a"), F.array_min(F.array(*cuts)).alias("best")))
    every = reduce(DataFrame.unionByName, found).join(around, "id", "left")
    kept = every.filter(F.col("longer").isNull() | (_whole(F.col("longer")) * 100 < _whole(F.col("a")) * COVERED)).select("lang", "phrase", "a", "best.score", "best.l", "best.r")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language may hold most phrases: each of 64 parts of it sends its own first ones.
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    some = kept.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same in SQL.
SQL = f"""
WITH pieces AS (
  SELECT lang, i, unnest(parts) AS piece, generate_subscripts(parts, 1) AS j
  FROM (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS i,
               regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS parts
        FROM {{documents}})),
words AS (SELECT i, j, lang, unnest(w) AS x, generate_subscripts(w, 1) AS s
          FROM (SELECT i, j, lang, list_filter(regexp_split_to_array(piece, '[ \\x09]+'), lambda x: x <> '') AS w FROM pieces)),
runs AS (SELECT lang, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z, lead(x, 3) OVER o AS u FROM words WINDOW o AS (PARTITION BY i, j ORDER BY s)),
every AS (SELECT lang, 1 AS k, x AS phrase FROM runs
          UNION ALL SELECT lang, 2, x || ' ' || y FROM runs WHERE y IS NOT NULL
          UNION ALL SELECT lang, 3, x || ' ' || y || ' ' || z FROM runs WHERE z IS NOT NULL
          UNION ALL SELECT lang, 4, x || ' ' || y || ' ' || z || ' ' || u FROM runs WHERE u IS NOT NULL),
f AS (SELECT lang, k, phrase, count(*) AS a FROM every GROUP BY ALL),
sizes AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS p FROM f WHERE k > 1 AND a >= {LEAST}),
cuts AS (SELECT lang, k, phrase, a, c, array_to_string(p[:c], ' ') AS x, array_to_string(p[c + 1:], ' ') AS y
         FROM candidates, (VALUES (1), (2), (3)) AS t(c) WHERE c < k),
scored AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.c, l.a AS l, r.a AS r, ((2000000::HUGEINT * c.a) // (l.a + r.a))::BIGINT AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.x AND l.k = c.c JOIN f r ON r.lang = c.lang AND r.phrase = c.y AND r.k = c.k - c.c),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inner_ones AS (
  SELECT lang, array_to_string(p[s:e], ' ') AS phrase, max(a) AS longer
  FROM candidates, (VALUES (1), (2), (3)) AS t(s), (VALUES (2), (3), (4)) AS u(e)
  WHERE e <= k AND e > s AND e - s + 1 < k GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inner_ones i USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < {COVERED}::HUGEINT * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= {TOP}"""

"""Helpers that the operators share: tables, Arrow blocks, hashed words.

Texts reach Python as Arrow columns. A block is a run of rows whose texts together have about
``BLOCK`` bytes (one longer text is a block by itself), so the numpy arrays made from a block
have a size that does not depend on the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.session import configure, scratch_path, shared_dir

BLOCK = 1 << 19
#: Rows of an Arrow batch; with long texts the default of 10,000 rows fills a worker's memory.
BATCH_ROWS = 1024

#: Bytes of words in lower-case UTF-8: digits, letters, and all bytes of characters beyond ASCII.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: One random number per byte value; fixed, so that hashes agree between tasks and runs.
SALT = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there; lost executors cost nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same as ``stored``, as Parquet: smaller where columns repeat or are null."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; looks at no more than ``rows + 1``."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its size allows; a plain (shuffled) join side otherwise."""
    return F.broadcast(df) if small(df, rows) else df


def sample_rows(df: DataFrame, key: str, text: str, most: int, size: int | None = None) -> DataFrame:
    """``spread`` (hash of key and text) and text of at most ``most`` rows, the first by both; see ``sample_texts``."""
    spread = F.xxhash64(F.col(key), F.col(text))
    rows = df.filter(F.col(text).isNotNull())
    total, held = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    share = min(1.5 * most / max(total, 1), 1.5 * size / max(held, 1) if size else 1.0)
    if share < 0.75:
        rows = rows.filter(spread < F.lit(int((2 * share - 1) * (1 << 63))))
    return rows.select(spread.alias("spread"), F.col(text).alias("text")).orderBy("spread", "text").limit(most)


def within(texts: list[str], size: int) -> list[str]:
    """The first texts, of ``size`` bytes together; one at least."""
    ends = np.cumsum([len(t.encode()) for t in texts])
    return texts[: int(np.searchsorted(ends, size, "right"))] or texts[:1]


def sample_texts(df: DataFrame, key: str, text: str, most: int, size: int | None = None) -> pa.Array:
    """At most ``most`` texts of ``size`` bytes together, the first by hash of key and text; the driver gets few more.

    For training only. A share of the hash range that holds about one and a half times as many
    rows (or bytes) is cut out first, so what each partition sends shrinks as the table grows.
    """
    texts = [r[0] for r in sample_rows(df, key, text, most, size).select("text").collect()]
    return pa.array(within(texts, size) if size else texts, pa.large_string())


def strings(column) -> pa.Array:
    """A text column as one array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def blocks(texts: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) such that each slice has about ``size`` bytes of text."""
    if len(texts) == 0:
        return
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    first, base = 0, 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, base + size, "right")))
        yield first, texts.slice(first, last - first)
        base = int(ends[last - 1])
        first = last


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string array; offset i is where text i starts."""
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return every[offsets[0] : offsets[-1]], offsets - offsets[0]


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    if n > _POWERS.get(base, np.zeros(0)).size:
        out = np.full(max(n, BLOCK + (BLOCK >> 2)), base, np.uint64)
        out[0] = 1
        np.cumprod(out, out=out)
        if n > 4 * BLOCK:
            return out[:n]
        _POWERS[base] = out
    return _POWERS[base][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """The 64 bits stirred (splitmix64), as a new array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span; equal spans have equal hashes."""
    n = values.size
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(n), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * powers(n + 1, INVERSE)[starts])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash, text number) of each word of lower-case texts; none crosses a text's end."""
    inside = WORD_BYTES[data]
    edge = np.zeros(data.size + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    a, b = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return a, b, span_hashes(SALT[data], a, b), np.searchsorted(offsets, a, "right") - 1


def lower_words(texts: pa.Array):
    """``words`` of texts in any case."""
    return words(*raw(pc.utf8_lower(texts)))


def run_hashes(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of each run of ``n`` words within one text."""
    count = max(0, hashes.size - n + 1)
    if count == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = out * np.uint64(BASE) + hashes[k : k + count]
    at = np.flatnonzero(owner[:count] == owner[n - 1 :])
    return mixed(out[at]), at


def set_aside(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with columns that an operator is about to add renamed to ``<name>_input``."""
    taken, out = {n.lower() for n in names}, df
    for c in df.columns:
        if c.lower() in taken:
            out = out.withColumnRenamed(c, f"{c}_input")
    return out

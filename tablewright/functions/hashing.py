"""Reproducible pseudo-random numbers computed from a row key.

``rand()`` depends on partitioning and on retries. A hash of the key does not, so a
corrupted table is the same on one partition and on a thousand, and on any engine
that has md5.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 52
HALF_STEPS = 6  # of the permutation: each half is mixed three times
LONGEST_WALK = 64


def as_keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def hash52(key: str | Sequence[str] | Column, salt: str, seed: int) -> Column:
    """52 hash bits of (key, salt, seed) as a bigint. Null key parts read as empty."""
    if isinstance(key, Column):
        parts = [key.cast("string")]
    else:
        parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in as_keys(key)]
    text = F.concat_ws(":", *parts, F.lit(str(salt)), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def u(key: str | Sequence[str] | Column, salt: str, seed: int) -> Column:
    """Uniform double in [0, 1)."""
    return hash52(key, salt, seed).cast("double") / F.lit(float(1 << HASH_BITS))


def draw(seed: int, salt: str, bound: int) -> int:
    """A whole number in [0, bound) for choices made once per table, not per row."""
    digest = hashlib.md5(f"{salt}:{seed}".encode()).hexdigest()
    return int(digest[:13], 16) % bound


def permuted(index: Column, size: int, salt: str, seed: int) -> Column:
    """Where a seeded permutation of 0 .. size-1 puts ``index``: distinct places, no sort.

    The numbers are read as cells of a grid just large enough. Its two coordinates are shifted
    in turn by a hash of the other, which is a permutation of the cells, and a cell beyond
    ``size`` is sent on until it lands inside. Fewer cells than one row of the grid lie
    beyond, so more than ``LONGEST_WALK`` of them in a row do not occur.
    """
    down = max(math.isqrt(size), 1)
    across = max(-(-size // down), 1)

    def shift(cell: Column, i: Column) -> Column:
        a, b = cell["a"], cell["b"]
        moved = lambda other: hash52(F.concat_ws(":", i.cast("string"), other.cast("string")), salt, seed)
        turn = F.struct(F.pmod(a + moved(b), F.lit(down)).alias("a"), b.alias("b"))
        return F.when(i % 2 == 0, turn).otherwise(F.struct(a.alias("a"), F.pmod(b + moved(a), F.lit(across)).alias("b")))

    def once(x: Column) -> Column:
        b = F.pmod(x, F.lit(across).cast("bigint"))
        start = F.struct(((x - b) / F.lit(across)).cast("bigint").alias("a"), b.alias("b"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(HALF_STEPS - 1)), start, shift, lambda cell: cell["a"] * F.lit(across) + cell["b"])

    beyond = min(down * across - size, LONGEST_WALK)
    at = once(index.cast("bigint"))
    if beyond <= 0:
        return at
    return F.aggregate(F.sequence(F.lit(1), F.lit(beyond)), at, lambda x, _: F.when(x < F.lit(size), x).otherwise(once(x)))

"""Exact-size random subsets, rank slices and order statistics without a global sort.

Each routine narrows down on a cutoff with bounded aggregates: a histogram or a few
splitters per pass come back to the driver, never rows. The answer is a cutoff, so the
selection itself is a row-wise predicate: no shuffle and no join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.hashing import HASH_BITS, as_keys, draw, hash52

DIGIT_BITS = 12  # 4096 counters per draw and pass
SMALL = 10_000  # rows that may be ordered in one place
SPLITTERS = 24


@dataclass(frozen=True)
class Draw:
    """One random subset: its name, which rows may be taken, how many.

    ``k`` is a number or a function of (rows in the table, rows that may be taken).
    ``salt`` (by default the name) picks the hash; draws with one salt and rising ``k``
    are nested.
    """

    name: str
    k: int | Callable[[int, int], int]
    eligible: Column | None = None
    salt: str | None = None


def exact_draws(df: DataFrame, key: str | Sequence[str], draws: Sequence[Draw], seed: int) -> dict[str, Column]:
    """For each draw, a boolean column that is true on exactly ``k`` rows of ``df``.

    The rows with the smallest (hash, key) are taken. All draws share each pass over
    the table. The key must identify a row; that is checked at the cutoff.
    """
    keys = as_keys(key)
    eligible = {d.name: F.lit(True) if d.eligible is None else d.eligible for d in draws}
    salts = list(dict.fromkeys(d.salt or d.name for d in draws))
    hashes = {d.name: F.col(f"__h{salts.index(d.salt or d.name)}") for d in draws}
    may = {d.name: F.col(f"__e{i}") for i, d in enumerate(draws)}
    # Each hash and each test once per row, however many draws use it.
    narrow = df.select(
        F.struct(*[F.col(k) for k in keys]).alias("__key"),
        *[hash52(keys, salt, seed).alias(f"__h{i}") for i, salt in enumerate(salts)],
        *[F.coalesce(eligible[d.name], F.lit(False)).alias(f"__e{i}") for i, d in enumerate(draws)],
    )
    prefix: dict[str, int] = {d.name: 0 for d in draws}  # digits fixed so far
    wanted: dict[str, int] = {}
    chosen: dict[str, Column] = {}
    open_draws = list(draws)
    depth = 0
    while open_draws:
        shift = HASH_BITS - DIGIT_BITS * (depth + 1)
        if shift < 0:
            raise ValueError(f"key {keys} does not identify the rows of the table")
        entries = [F.struct(F.lit(-1).alias("draw"), F.lit(0).cast("bigint").alias("digit"))] if depth == 0 else []
        for i, d in enumerate(open_draws):
            h = hashes[d.name]
            inside = may[d.name]
            if depth:
                inside = inside & (F.shiftright(h, shift + DIGIT_BITS) == F.lit(prefix[d.name]))
            digit = F.shiftright(h, shift).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1).cast("bigint"))
            entries.append(F.when(inside, F.struct(F.lit(i).alias("draw"), digit.alias("digit"))))
        histogram = narrow.select(F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull())))
        counts: dict[int, dict[int, int]] = {}
        for row in histogram.groupBy("draw", "digit").count().collect():
            counts.setdefault(row["draw"], {})[row["digit"]] = row["count"]
        total = counts.get(-1, {}).get(0, 0)
        finish: list[Draw] = []
        deeper: list[Draw] = []
        for i, d in enumerate(open_draws):
            buckets = counts.get(i, {})
            if depth == 0:
                available = sum(buckets.values())
                k = d.k(total, available) if callable(d.k) else d.k
                if k <= 0:
                    chosen[d.name] = F.lit(False)
                    continue
                if k >= available:
                    chosen[d.name] = eligible[d.name]
                    continue
                wanted[d.name] = k
            for digit in sorted(buckets):
                if wanted[d.name] <= buckets[digit]:
                    break
                wanted[d.name] -= buckets[digit]
            prefix[d.name] = (prefix[d.name] << DIGIT_BITS) + digit
            (finish if buckets[digit] <= SMALL else deeper).append(d)
        if finish:
            cuts = _cutoffs(narrow, keys, [(d.name, may[d.name], hashes[d.name], prefix[d.name], wanted[d.name]) for d in finish], shift)
            for d in finish:
                place = F.struct(hash52(keys, d.salt or d.name, seed), F.struct(*[F.col(k) for k in keys]))
                chosen[d.name] = eligible[d.name] & (place <= cuts[d.name])
        open_draws = deeper
        depth += 1
    return {d.name: chosen[d.name] for d in draws}


def _cutoffs(narrow: DataFrame, keys: list[str], draws: list[tuple], shift: int) -> dict[str, Column]:
    """Order the few rows left in each draw's bucket; the wanted one is the last taken."""
    key_type = narrow.schema["__key"].dataType
    entries = []
    for i, (_, may, h, prefix, _) in enumerate(draws):
        entry = F.struct(F.lit(i).alias("draw"), h.alias("h"), F.col("__key").alias("k"))
        entries.append(F.when(may & (F.shiftright(h, shift) == F.lit(prefix)), entry))
    left = narrow.select(F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull())))
    found: dict[int, list] = {}
    for row in left.orderBy("draw", "h", "k").collect():
        found.setdefault(row["draw"], []).append((row["h"], tuple(row["k"])))
    out = {}
    for i, (name, _, _, _, wanted) in enumerate(draws):
        ordered = found[i]
        cut = ordered[wanted - 1]
        if ordered[wanted:] and ordered[wanted] == cut:
            raise ValueError(f"key {keys} does not identify the rows of the table")
        out[name] = F.struct(F.lit(cut[0]).cast("bigint"), _literal(cut[1], key_type))
    return out


def select_exact_k(df: DataFrame, key: str | Sequence[str], k: int, seed: int, salt: str = "k") -> DataFrame:
    """Exactly ``k`` rows (all rows if there are fewer), chosen by hash."""
    return df.filter(exact_draws(df, key, [Draw(salt, k)], seed)[salt])


def sample_fraction(df: DataFrame, key: str | Sequence[str], fraction: float, seed: int, salt: str = "fraction") -> DataFrame:
    """About ``fraction`` of the rows, by a row-wise test."""
    bound = F.lit(int(fraction * (1 << HASH_BITS)))
    return df.filter(hash52(key, salt, seed) < bound)


def sample_n(df: DataFrame, key: str | Sequence[str], n: int, seed: int, salt: str = "n") -> DataFrame:
    """Exactly ``n`` rows. A small ``n`` is a top-n; a large one uses the hash cutoff."""
    if n > SMALL:
        return select_exact_k(df, key, n, seed, salt)
    return df.orderBy(hash52(key, salt, seed), *as_keys(key)).limit(n)


def head_fraction(df: DataFrame, ordinal: str, divisor: int = 100) -> DataFrame:
    """The first ``rows // divisor`` rows by an ordinal column that has no repeats."""
    k = df.count() // divisor
    if k <= SMALL:
        return df.orderBy(ordinal).limit(k)
    return df.filter(F.col(ordinal) <= F.lit(order_statistics(df, F.col(ordinal), [k])[k]))


# --- order statistics --------------------------------------------------------------


def _literal(value, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return F.struct(*[_literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind.fields)])
    return F.lit(value).cast(kind)


def order_statistics(df: DataFrame, value: Column, ranks: Sequence[int]) -> dict[int, object]:
    """The values at 1-based ``ranks`` among the non-null values of ``value``.

    Works for any orderable type. Each pass draws a few splitters from the open
    interval, counts the rows between them and keeps the intervals that hold a rank,
    until few enough rows are left to order. Values that repeat often come up as
    splitters and are counted whole, so ties cost nothing.
    """
    column = df.select(value.alias("v")).filter(F.col("v").isNotNull())
    kind = column.schema["v"].dataType
    rows = column.count()
    if any(not 1 <= rank <= rows for rank in ranks):
        raise ValueError(f"ranks {list(ranks)} are not all in 1..{rows}")
    found: dict[int, object] = {}
    # Open intervals: the rows inside, how many there are, how many lie below, ranks sought.
    pending = [(column, rows, 0, sorted(set(ranks)))]
    attempt = 0
    while pending:
        inside, left, below, sought = pending.pop()
        if left <= SMALL:
            last = sought[-1] - below
            ordered = [row["v"] for row in inside.orderBy("v").limit(last).collect()]
            found.update({rank: ordered[rank - below - 1] for rank in sought})
            continue
        attempt += 1
        sample = inside.orderBy(F.rand(attempt)).limit(SPLITTERS).distinct().orderBy("v")
        splitters = [row["v"] for row in sample.collect()]
        literals = [_literal(s, kind) for s in splitters]
        ladder = F.array(*literals)
        step = F.size(F.filter(ladder, lambda s: s < F.col("v"))).alias("step")
        hits = inside.groupBy(step, F.array_contains(ladder, F.col("v")).alias("same")).count().collect()
        counts = {(row["step"], row["same"]): row["count"] for row in hits}
        for i in range(len(splitters) + 1):
            between, equal = counts.get((i, False), 0), counts.get((i, True), 0)
            here = [rank for rank in sought if below < rank <= below + between]
            if here:
                part = inside
                if i > 0:
                    part = part.filter(F.col("v") > literals[i - 1])
                if i < len(splitters):
                    part = part.filter(F.col("v") < literals[i])
                pending.append((part, between, below, here))
            below += between
            found.update({rank: splitters[i] for rank in sought if below < rank <= below + equal})
            below += equal
    return found


def rank_order(column: str, key: str | Sequence[str], seed: int) -> Column:
    """Total order by value, nulls last; equal values by hash, then key."""
    keys = as_keys(key)
    return F.struct(
        F.col(column).isNull().alias("last"),
        F.col(column).alias("value"),
        hash52(keys, "rank", seed).alias("h"),
        *[F.col(k).alias(f"key{i}") for i, k in enumerate(keys)],
    )


def rank_slice(df: DataFrame, column: str, key: str | Sequence[str], start: int, k: int, seed: int) -> Column:
    """A predicate true on the ``k`` rows ranked ``start+1 .. start+k`` by ``column``."""
    if k <= 0:
        return F.lit(False)
    order = rank_order(column, key, seed)
    kind = df.select(order.alias("o")).schema["o"].dataType
    ends = order_statistics(df, order, [start + 1, start + k])
    return (order >= _literal(ends[start + 1], kind)) & (order <= _literal(ends[start + k], kind))


def rows_at_random(df: DataFrame, key, fraction: float, seed: int, salt: str = "car") -> Column:
    """Completely at random: whole part of rows x fraction; 1.0 takes all."""
    if fraction >= 1.0:
        return F.lit(True)
    return exact_draws(df, key, [Draw(salt, lambda n, _: int(n * fraction))], seed)[salt]


def rows_by_rank(df: DataFrame, key, fraction: float, order_column: str, seed: int) -> Column:
    """A contiguous run of ranks of ``order_column``, its start drawn from the seed."""
    if fraction >= 1.0:
        return F.lit(True)
    n = df.count()
    k = int(n * fraction)
    return rank_slice(df, order_column, key, draw(seed, "start", max(n - k, 1)), k, seed)


def sample_rows(
    df: DataFrame, key, column: str, fraction: float, sampling: str, seed: int, others: Sequence[str] | None = None
) -> Column:
    """Which rows a corruption hits.

    ``CAR``: completely at random. ``NAR``: not at random, a run of ranks of the column
    itself. ``AR``: at random given another column, a run of ranks of one of ``others``
    (by default any other column).
    """
    kind = sampling.upper()
    if kind == "CAR":
        return rows_at_random(df, key, fraction, seed)
    if kind == "NAR":
        return rows_by_rank(df, key, fraction, column, seed)
    if kind == "AR":
        pool = list(others) if others else [c for c in df.columns if c != column]
        return rows_by_rank(df, key, fraction, pool[draw(seed, "depends", len(pool))], seed)
    raise ValueError(f"sampling {sampling!r} is none of CAR, NAR, AR")

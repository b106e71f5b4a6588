"""Reproducible damage: duplicates, nulls, outliers, character noise.

Every choice is a hash of the row key, the step's name and the seed. The result does
not depend on partitioning and no step shuffles the table: counts come back first, the
change is then a projection.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.hashing import as_keys, draw, hash52, permuted, u
from tablewright.operators.profile import is_integer_valued
from tablewright.operators.ranking import dense_codes
from tablewright.operators.roles import ColumnRoles
from tablewright.operators.selection import Draw, exact_draws, sample_rows

# Fixed values of the corruption rules.
MOST_ROWS = 10_000
NULL_RATIO = 0.02
OUTLIER_SHARE = 10
FACTOR_RANGE = (2.0, 10.0)
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def insert_duplicates(
    df: DataFrame, key: str | Sequence[str], n: int | None = None, seed: int = 0, ordinal: str | None = None, copy: str | None = None
) -> DataFrame:
    """Repeat ``n`` rows (by default 1 to 10000 by seed, at most all).

    With ``ordinal``, each copy gets a position of its own in [0, rows) in that column, so
    that sorting by it mixes the copies in: the copies are numbered by hash and the numbers
    permuted. Only the keys of the copies are sorted. With ``copy``, that
    column tells copies apart: (key, copy) identifies the rows of the result, which the
    next corruption step needs.
    """
    wanted = n if n is not None else 1 + draw(seed, "duplicates", MOST_ROWS)
    copies = df.filter(exact_draws(df, key, [Draw("duplicates", wanted)], seed)["duplicates"])
    if ordinal is not None:
        rows = df.count()
        copies = copies.withColumn("__at", F.struct(hash52(key, "duplicates", seed).alias("h"), *as_keys(key)))
        numbers = dense_codes(copies, "__at").withColumnRenamed("value", "__of")
        place = permuted(F.col("code"), rows, "position", seed).cast(df.schema[ordinal].dataType)
        copies = copies.join(numbers, F.col("__at").eqNullSafe(F.col("__of")))
        copies = copies.withColumn(ordinal, place).select(*df.columns)
    if copy is not None:
        before = F.col(copy) * 2 if copy in df.columns else F.lit(0).cast("bigint")
        df, copies = df.withColumn(copy, before), copies.withColumn(copy, before + 1)
    return df.unionByName(copies)


def one_per_role(roles: ColumnRoles, seed: int) -> list[str]:
    """One column of each role that has any, by seed; both text roles count as one."""
    pools = {"numerical": roles.numerical, "categorical": roles.categorical, "datetime": roles.datetime, "text": roles.text}
    return [pool[draw(seed, name, len(pool))] for name, pool in pools.items() if pool]


def introduce_nulls(
    df: DataFrame, key: str | Sequence[str], columns: ColumnRoles | Sequence[str], ratio: float = NULL_RATIO, seed: int = 0
) -> DataFrame:
    """Raise the nulls of each column to the whole part of rows x ratio.

    Given roles, one column per role is hit. Columns the table lacks are skipped.
    """
    names = one_per_role(columns, seed) if isinstance(columns, ColumnRoles) else list(columns)
    names = [c for c in names if c in df.columns]
    draws = [
        Draw(f"null:{c}", lambda rows, filled: int(rows * ratio) - (rows - filled), F.col(c).isNotNull()) for c in names
    ]
    if not draws:
        return df
    hit = exact_draws(df, key, draws, seed)
    return df.withColumns({c: F.when(~hit[f"null:{c}"], F.col(c)) for c in names})


def introduce_outliers(
    df: DataFrame, key: str | Sequence[str], columns: Sequence[str], n: int | None = None, seed: int = 0, preserve_integer: bool = False
) -> DataFrame:
    """In each column, give ``n`` rows the maximum times f or the minimum over f.

    f is uniform in [2, 10), both cases are equally likely. ``n`` is 1 to 10000 by seed
    and never more than a tenth of the rows. The minimum over f moves towards zero, so it
    is no outlier where the minimum is near zero or negative; the formula is kept as
    given. ``preserve_integer`` truncates columns that held only whole numbers.
    """
    columns = list(columns)
    wanted = n if n is not None else 1 + draw(seed, "outliers", MOST_ROWS)
    hit = exact_draws(df, key, [Draw(f"outlier:{c}", lambda rows, _: min(wanted, rows // OUTLIER_SHARE)) for c in columns], seed)
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.min(c).cast("double").alias(f"lo{i}"), F.max(c).cast("double").alias(f"hi{i}")]
        aggs.append(is_integer_valued(F.col(c)).alias(f"whole{i}"))
    facts = df.agg(*aggs).first()
    low, high = FACTOR_RANGE
    changed = {}
    for i, c in enumerate(columns):
        factor = F.lit(low) + F.lit(high - low) * u(key, f"factor:{c}", seed)
        up = u(key, f"side:{c}", seed) > F.lit(0.5)
        value = F.when(up, F.lit(facts[f"hi{i}"]) * factor).otherwise(F.lit(facts[f"lo{i}"]) / factor)
        result = F.when(hit[f"outlier:{c}"], value).otherwise(F.col(c).cast("double"))
        changed[c] = result.cast("bigint") if preserve_integer and facts[f"whole{i}"] else result
    return df.withColumns(changed)


def corrupt_missing(
    df: DataFrame, key: str | Sequence[str], column: str, fraction: float, sampling: str = "CAR", seed: int = 0, others: Sequence[str] | None = None
) -> DataFrame:
    """Null out ``fraction`` of one column.

    The mapping of the missing method to the CAR, AR and NAR row choices is our reading
    of its parameters; no other definition is available.
    """
    hit = sample_rows(df, key, column, fraction, sampling, seed, others)
    return df.withColumn(column, F.when(~hit, F.col(column)))


def corrupt_characters(df: DataFrame, key: str | Sequence[str], column: str, fraction: float, rate: float, seed: int = 0) -> DataFrame:
    """In ``fraction`` of the rows, replace about ``rate`` of the characters by letters.

    The meaning is taken from the parameter names; no other definition is available.
    """
    hit = sample_rows(df, key, column, fraction, "CAR", seed)
    base = F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in as_keys(key)])

    def noisy(ch: Column, i: Column) -> Column:
        here = F.concat_ws(":", base, i.cast("string"))
        letter = F.substring(F.lit(LETTERS), (F.pmod(hash52(here, "letter", seed), F.lit(len(LETTERS))) + 1).cast("int"), F.lit(1))
        return F.when(u(here, "char", seed) < F.lit(rate), letter).otherwise(ch)

    noise = F.array_join(F.transform(F.split(F.col(column), ""), noisy), "")
    return df.withColumn(column, F.when(hit, noise).otherwise(F.col(column)))


Step = Callable[[DataFrame], DataFrame]


def apply_steps(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """Apply corruption or cleaning steps in the order given."""
    return reduce(lambda table, step: table.transform(step), steps, df)

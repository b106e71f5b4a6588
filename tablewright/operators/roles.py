"""Column roles: which columns are numbers, categories, dates, short or long text."""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.dates import STRICT_LAYOUT, UNIX_RANGE, parse_text
from tablewright.functions.words import more_words_than
from tablewright.operators.profile import is_numeric
from tablewright.session import small_table

# Fixed values of the two rule sets.
UNIQUE_SHARE = 0.2
CATEGORY_LIMIT = 100
STRICT_NUMERIC_LIMIT = 4
SHORT_TEXT_WORDS = 30


@dataclass(frozen=True)
class ColumnRoles:
    numerical: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    datetime: tuple[str, ...] = ()
    short_text: tuple[str, ...] = ()
    long_text: tuple[str, ...] = ()
    target: tuple[str, ...] = ()

    @property
    def text(self) -> tuple[str, ...]:
        return self.short_text + self.long_text

    def replace(self, **roles: Sequence[str]) -> ColumnRoles:
        """These roles with some lists set by hand."""
        return dataclasses.replace(self, **{k: tuple(v) for k, v in roles.items()})

    def set_target(self, *target: str) -> ColumnRoles:
        return self.replace(target=target)

    def of(self, column: str) -> str | None:
        for role in ("numerical", "categorical", "datetime", "short_text", "long_text"):
            if column in getattr(self, role):
                return role
        return None


def stringify_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Arrays, structs and maps as JSON text; text and null stay as they are."""
    nested = {
        f.name: F.to_json(F.col(f.name))
        for f in df.schema
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) and (columns is None or f.name in columns)
    }
    return df.withColumns(nested) if nested else df


def any_in_range(col: Column, low: float = UNIX_RANGE[0], high: float = UNIX_RANGE[1]) -> Column:
    """Aggregate: some value lies in [low, high]; false on an empty column."""
    return F.coalesce(F.bool_or(col.between(F.lit(low), F.lit(high))), F.lit(False))


def classify_columns(df: DataFrame, mode: str = "general", target: Sequence[str] = ()) -> ColumnRoles:
    """Roles of all columns, from one pass over the table and at most one more.

    ``general``: any date layout; Unix seconds count as dates if the name says "time";
    numbers with at most 100 distinct values that make up at most a fifth of the rows
    are categories. ``strict``: only the "month day, year" layout, the limit for numbers
    is 4, the target is left out, all text is short text.

    The whole column is judged. The distinct counts are sketched first and counted exactly only near the limit, so no
    near-unique column is ever shuffled.
    """
    if mode not in ("general", "strict"):
        raise ValueError(f"mode {mode!r} is neither general nor strict")
    strict = mode == "strict"
    table = stringify_columns(df.select(*[c for c in df.columns if c not in target]))
    kinds = {f.name: f.dataType for f in table.schema}
    fixed = {}
    aggs = []
    judged = []
    for i, (name, kind) in enumerate(kinds.items()):
        c = F.col(name)
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            fixed[name] = "datetime"
        elif isinstance(kind, T.BooleanType):
            fixed[name] = "categorical"
        else:
            judged.append(name)
            aggs += [F.count(c).alias(f"n{i}"), F.approx_count_distinct(c).alias(f"u{i}")]
            if is_numeric(kind):
                aggs.append(any_in_range(c).alias(f"x{i}"))
            else:
                layouts = [STRICT_LAYOUT] if strict else None
                parsed = F.bool_and(F.when(c.isNotNull(), parse_text(c, layouts).isNotNull()))
                aggs += [F.coalesce(parsed, F.lit(False)).alias(f"d{i}"), F.bool_or(more_words_than(c, SHORT_TEXT_WORDS)).alias(f"w{i}")]
    facts = table.agg(*aggs).first().asDict() if aggs else {}
    place = {name: i for i, name in enumerate(kinds)}
    close = [c for c in judged if facts[f"u{place[c]}"] <= 2 * CATEGORY_LIMIT]
    if close:
        exact = table.agg(*[F.count_distinct(c).alias(f"u{place[c]}") for c in close]).first()
        facts.update(exact.asDict())

    def role(name: str) -> str:
        i = place[name]
        n, unique = facts[f"n{i}"], facts[f"u{i}"]
        numeric = is_numeric(kinds[name])
        limit = STRICT_NUMERIC_LIMIT if strict and numeric else CATEGORY_LIMIT
        if numeric and not strict and facts[f"x{i}"] and "time" in name.lower():
            return "datetime"
        if not numeric and facts[f"d{i}"]:
            return "datetime"
        if n and unique <= limit and unique / n <= UNIQUE_SHARE:
            return "categorical"
        if numeric:
            return "numerical"
        return "long_text" if facts[f"w{i}"] and not strict else "short_text"

    roles = {name: fixed.get(name) or role(name) for name in kinds}
    by_role = {r: tuple(c for c, x in roles.items() if x == r) for r in ("numerical", "categorical", "datetime", "short_text", "long_text")}
    return ColumnRoles(**by_role, target=tuple(target))


def roles_table(df: DataFrame, roles: ColumnRoles) -> DataFrame:
    rows = [(c, roles.of(c)) for c in df.columns if roles.of(c)]
    return small_table(df.sparkSession, rows, "column string, role string")


def cast_by_role(df: DataFrame, roles: ColumnRoles) -> DataFrame:
    """Categories as text, numbers as double."""
    casts = {c: F.col(c).cast("string") for c in roles.categorical if c in df.columns}
    casts |= {c: F.col(c).cast("double") for c in roles.numerical if c in df.columns}
    return df.withColumns(casts) if casts else df

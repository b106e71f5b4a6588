"""Pieces of SQL shared by the checks."""

from __future__ import annotations


def h(key: str, salt: str, seed: int) -> str:
    """The 52-bit row hash."""
    return f"('0x'||substr(md5(concat_ws(':', {key}, '{salt}', '{seed}')),1,13))::BIGINT"


def u(key: str, salt: str, seed: int) -> str:
    return f"({h(key, salt, seed)} / 4503599627370496.0)"


def nth(key: str, salt: str, seed: int, where: str = "true") -> str:
    """Place of a row among the rows that may be drawn."""
    return f"row_number() OVER (PARTITION BY ({where}) ORDER BY {h(key, salt, seed)}, {key})"


def with_nulls(table: str, key: str, columns: list[str], others: list[str], ratio: float, seed: int) -> str:
    """A table with the same nulls as ``introduce_nulls`` makes where there were none."""
    cells = [
        f"CASE WHEN {nth(key, 'null:' + c, seed)} > floor((SELECT count(*) FROM {table}) * {ratio}) THEN {c} END AS {c}" for c in columns
    ]
    return f"SELECT {', '.join([*others, *cells])} FROM {table}"


def bounds(table: str, column: str, name: str) -> str:
    """Quartile fences of a column as a one-row relation."""
    q1, q3 = (f"quantile_cont({column}, {p})" for p in (0.25, 0.75))
    return f"{name} AS (SELECT {q1} - 1.5*({q3}-{q1}) AS lo, {q3} + 1.5*({q3}-{q1}) AS hi FROM {table})"


def clamp(column: str, name: str) -> str:
    return f"CASE WHEN {column} < {name}.lo THEN {name}.lo WHEN {column} > {name}.hi THEN {name}.hi ELSE {column} END"

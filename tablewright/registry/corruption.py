"""Damage: the SQL draws the same rows by the same hash."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import corrupt, selection
from tablewright.registry import query
from tablewright.registry.sql import h, nth, u, with_nulls

LETTER = "substr('abcdefghijklmnopqrstuvwxyz', ({h} % 26)::INTEGER + 1, 1)"


def _place(table: str, key: str, salt: str, seed: int) -> str:
    return f"(SELECT *, {nth(key, salt, seed)} AS place, count(*) OVER () AS n_rows FROM {table})"


@query("select_exact_k", f"SELECT o_orderkey, o_totalprice FROM {_place('orders', 'o_orderkey', 'k', 11)} WHERE place <= 6000")
def select_exact_k(t):
    return selection.select_exact_k(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", 6000, 11)


@query(
    "insert_duplicates",
    f"""SELECT o_orderkey, o_custkey, o_totalprice FROM orders
        UNION ALL SELECT o_orderkey, o_custkey, o_totalprice FROM {_place('orders', 'o_orderkey', 'duplicates', 2)} WHERE place <= 700""",
)
def insert_duplicates(t):
    return corrupt.insert_duplicates(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", 700, 2)


_MOVED = "CASE WHEN i % 2 = {even} THEN ({own} + {hash}) % {size} ELSE {own} END"


@query(
    "insert_duplicates_mixed",
    f"""WITH RECURSIVE size AS (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT count(*) AS n, floor(sqrt(count(*)))::BIGINT AS a FROM orders)),
        cell(d, x, y, i) AS (
            SELECT d, d // b, d % b, 0 FROM (SELECT unnest(range(a * b)) AS d, b FROM size)
            UNION ALL SELECT d, {_MOVED.format(even=0, own='x', hash=h("concat_ws(':', i, y)", 'position', 3), size='a')},
                             {_MOVED.format(even=1, own='y', hash=h("concat_ws(':', i, x)", 'position', 3), size='b')}, i + 1 FROM cell, size WHERE i < 6),
        once AS (SELECT d, x * b + y AS e FROM cell, size WHERE i = 6),
        walk(d, e) AS (SELECT d, e FROM once UNION ALL SELECT walk.d, once.e FROM walk, once, size WHERE walk.e >= n AND once.d = walk.e)
        SELECT o_orderkey, o_orderkey AS original_order FROM orders
        UNION ALL SELECT o_orderkey, e FROM {_place('orders', 'o_orderkey', 'duplicates', 3)}, walk WHERE place <= 900 AND d = place - 1 AND e < n_rows""",
)
def insert_duplicates_mixed(t):
    """Copies mixed in between the rows, each at a position of its own."""
    df = t.orders.select("o_orderkey", F.col("o_orderkey").alias("original_order"))
    return corrupt.insert_duplicates(df, "o_orderkey", 900, 3, ordinal="original_order")


@query("introduce_nulls", with_nulls("customer", "c_custkey", ["c_acctbal", "c_mktsegment"], ["c_custkey", "c_name"], 0.02, 4))
def introduce_nulls(t):
    df = t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return corrupt.introduce_nulls(df, "c_custkey", ["c_acctbal", "c_mktsegment"], 0.02, 4)


def _outlier_sql(table: str, key: str, column: str, n: int, seed: int, whole: bool = False) -> str:
    factor = f"(2.0 + 8.0 * {u(key, 'factor:' + column, seed)})"
    value = f"CASE WHEN {u(key, 'side:' + column, seed)} > 0.5 THEN hi * {factor} ELSE lo / {factor} END"
    cell = f"CASE WHEN {nth(key, 'outlier:' + column, seed)} <= least({n}, (SELECT count(*) // 10 FROM {table})) THEN {value} ELSE {column}::DOUBLE END"
    shown = f"trunc({cell})::BIGINT" if whole else f"round({cell}, 6)"
    return f"""SELECT {key}, {shown} AS {column} FROM {table}, (SELECT min({column})::DOUBLE AS lo, max({column})::DOUBLE AS hi FROM {table})"""


@query("introduce_outliers", _outlier_sql("customer", "c_custkey", "c_acctbal", 120, 6))
def introduce_outliers(t):
    df = corrupt.introduce_outliers(t.customer.select("c_custkey", "c_acctbal"), "c_custkey", ["c_acctbal"], 120, 6)
    return df.withColumn("c_acctbal", F.round("c_acctbal", 6))


@query("introduce_outliers_integer", _outlier_sql("part", "p_partkey", "p_size", 150, 8, whole=True))
def introduce_outliers_integer(t):
    return corrupt.introduce_outliers(t.part.select("p_partkey", "p_size"), "p_partkey", ["p_size"], 150, 8, preserve_integer=True)


@query("sample_rows_car", f"SELECT o_orderkey, o_totalprice FROM {_place('orders', 'o_orderkey', 'car', 5)} WHERE place <= floor(n_rows * 0.3)")
def sample_rows_car(t):
    df = t.orders.select("o_orderkey", "o_totalprice")
    return df.filter(selection.sample_rows(df, "o_orderkey", "o_totalprice", 0.3, "CAR", 5))


def _slice_sql(order: str, fraction: float, seed: int) -> str:
    """Rank slice; the start is md5(start:seed) modulo the starts there are."""
    start = f"('0x'||substr(md5('start:{seed}'),1,13))::BIGINT % (n_rows - k)"
    return f"""(SELECT *, place > {start} AND place <= {start} + k AS hit FROM (
                 SELECT *, floor(n_rows * {fraction})::BIGINT AS k FROM (
                   SELECT *, count(*) OVER () AS n_rows,
                          row_number() OVER (ORDER BY {order} NULLS LAST, {h('o_orderkey', 'rank', seed)}, o_orderkey) AS place FROM orders)))"""


@query("sample_rows_nar", f"SELECT o_orderkey, o_totalprice FROM {_slice_sql('o_totalprice', 0.2, 9)} WHERE hit")
def sample_rows_nar(t):
    df = t.orders.select("o_orderkey", "o_totalprice")
    return df.filter(selection.sample_rows(df, "o_orderkey", "o_totalprice", 0.2, "NAR", 9))


@query("sample_rows_ar", f"SELECT o_orderkey, o_totalprice FROM {_slice_sql('o_orderstatus', 0.2, 9)} WHERE hit")
def sample_rows_ar(t):
    # Three distinct values over all rows: nearly every rank is a tie.
    df = t.orders
    hit = selection.sample_rows(df, "o_orderkey", "o_totalprice", 0.2, "AR", 9, ["o_orderstatus"])
    return df.filter(hit).select("o_orderkey", "o_totalprice")


@query("corrupt_missing", f"SELECT o_orderkey, CASE WHEN NOT hit THEN o_totalprice END AS o_totalprice FROM {_slice_sql('o_totalprice', 0.1, 12)}")
def corrupt_missing(t):
    return corrupt.corrupt_missing(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice", 0.1, "NAR", 12)


NOISE = f"""array_to_string(list_transform(range(length(c_name)), lambda i: CASE WHEN {u("c_custkey, i", "char", 13)} < 0.25
            THEN {LETTER.format(h=h("c_custkey, i", "letter", 13))} ELSE substr(c_name, (i + 1)::BIGINT, 1) END), '')"""


@query(
    "corrupt_characters",
    f"SELECT c_custkey, CASE WHEN place <= floor(n_rows * 0.4) THEN {NOISE} ELSE c_name END AS c_name FROM {_place('customer', 'c_custkey', 'car', 13)}",
)
def corrupt_characters(t):
    return corrupt.corrupt_characters(t.customer.select("c_custkey", "c_name"), "c_custkey", "c_name", 0.4, 0.25, 13)


CHAIN = f"""WITH a AS (SELECT o_orderkey, o_custkey, o_totalprice, 0::BIGINT AS copy FROM orders
            UNION ALL SELECT o_orderkey, o_custkey, o_totalprice, 1 FROM {_place('orders', 'o_orderkey', 'duplicates', 21)} WHERE place <= 900),
       b AS (SELECT o_orderkey, o_custkey, copy, CASE WHEN {nth('o_orderkey, copy', 'null:o_totalprice', 21)} > floor((SELECT count(*) FROM a) * 0.05)
             THEN o_totalprice END AS o_totalprice FROM a),
       c AS (SELECT o_orderkey, o_custkey, copy, CASE WHEN {nth('o_orderkey, copy', 'outlier:o_totalprice', 21)} <= least(500, (SELECT count(*) // 10 FROM b))
             THEN CASE WHEN {u('o_orderkey, copy', 'side:o_totalprice', 21)} > 0.5
                       THEN hi * (2.0 + 8.0 * {u('o_orderkey, copy', 'factor:o_totalprice', 21)})
                       ELSE lo / (2.0 + 8.0 * {u('o_orderkey, copy', 'factor:o_totalprice', 21)}) END
             ELSE o_totalprice END AS o_totalprice FROM b, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM b))"""


def damaged_orders(t):
    key = ["o_orderkey", "copy"]
    steps = [
        lambda d: corrupt.insert_duplicates(d, "o_orderkey", 900, 21, copy="copy"),
        lambda d: corrupt.introduce_nulls(d, key, ["o_totalprice"], 0.05, 21),
        lambda d: corrupt.introduce_outliers(d, key, ["o_totalprice"], 500, 21),
    ]
    return corrupt.apply_steps(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), steps)


@query("corruption_chain", f"{CHAIN} SELECT o_orderkey, o_custkey, copy, round(o_totalprice, 4) AS o_totalprice FROM c")
def corruption_chain(t):
    return damaged_orders(t).withColumn("o_totalprice", F.round("o_totalprice", 4))



"""Repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import clean
from tablewright.operators.corrupt import introduce_nulls
from tablewright.operators.impute import impute_missing
from tablewright.operators.knn import impute_knn
from tablewright.operators.roles import ColumnRoles
from tablewright.registry import query
from tablewright.registry.corruption import CHAIN, damaged_orders
from tablewright.registry.reshaping import CUSTOMER_NULLS, customer_nulls
from tablewright.registry.sql import bounds, clamp, with_nulls

LINES = "(SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_partkey % 50 = 0 THEN l_extendedprice * 20 ELSE l_extendedprice END AS l_extendedprice FROM lineitem)"


@query(
    "winsorize",
    f"""WITH t AS {LINES}, {bounds('t', 'l_quantity', 'q')}, {bounds('t', 'l_extendedprice', 'e')}
        SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, trunc({clamp('l_quantity', 'q')})::BIGINT AS l_quantity,
               round({clamp('l_extendedprice', 'e')}, 4) AS l_extendedprice FROM t, q, e""",
)
def winsorize(t):
    far = F.when(F.col("l_partkey") % 50 == 0, F.col("l_extendedprice") * 20).otherwise(F.col("l_extendedprice"))
    df = t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_quantity", far.alias("l_extendedprice"))
    out = clean.winsorize(df, ["l_quantity", "l_extendedprice"])
    return out.withColumn("l_extendedprice", F.round("l_extendedprice", 4))


@query(
    "winsorize_nulls",
    f"""WITH t AS ({CUSTOMER_NULLS}), {bounds('t', 'c_acctbal', 'b')}
        SELECT c_custkey, round({clamp('c_acctbal', 'b')}, 4) AS c_acctbal FROM t, b""",
)
def winsorize_nulls(t):
    return clean.winsorize(customer_nulls(t).select("c_custkey", "c_acctbal"), ["c_acctbal"]).withColumn("c_acctbal", F.round("c_acctbal", 4))


@query(
    "impute_simple",
    f"""WITH t AS ({CUSTOMER_NULLS}), m AS (SELECT c_mktsegment AS v FROM t WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
        SELECT c_custkey, coalesce(c_mktsegment, m.v) AS c_mktsegment FROM t, m""",
)
def impute_simple(t):
    return clean.impute_simple(customer_nulls(t).select("c_custkey", "c_mktsegment"), ["c_mktsegment"])


def _knn_sql() -> str:
    """Fill p_size and p_retailprice from one another's distances to the rest, all pairs compared."""
    table = with_nulls("part", "p_partkey", ["p_size", "p_retailprice"], ["p_partkey", "p_partkey % 997 AS spread"], 0.05, 17)
    fills = []
    for target, other in (("p_size", "p_retailprice"), ("p_retailprice", "p_size")):
        common = f"1 + (r.{other} IS NOT NULL AND d.{other} IS NOT NULL)::INT"
        total = f"(r.spread - d.spread)**2 + coalesce((r.{other} - d.{other})**2, 0)"
        fills.append(
            f"""{target}_fill AS (SELECT p_partkey, avg(v) AS v FROM (
                  SELECT r.p_partkey, d.{target}::DOUBLE AS v,
                         row_number() OVER (PARTITION BY r.p_partkey ORDER BY ({total}) * 3.0 / ({common}), d.p_partkey) AS place
                  FROM t r, t d WHERE r.{target} IS NULL AND d.{target} IS NOT NULL) WHERE place <= 3 GROUP BY p_partkey)"""
        )
    return f"""WITH t AS ({table}), {', '.join(fills)}
               SELECT t.p_partkey, spread::DOUBLE AS spread, round(coalesce(p_size, p_size_fill.v), 6) AS p_size,
                      round(coalesce(p_retailprice, p_retailprice_fill.v), 6) AS p_retailprice
               FROM t LEFT JOIN p_size_fill USING (p_partkey) LEFT JOIN p_retailprice_fill USING (p_partkey)"""


@query("impute_knn", _knn_sql())
def impute_knn_(t):
    df = t.part.select("p_partkey", (F.col("p_partkey") % 997).alias("spread"), "p_size", "p_retailprice")
    df = introduce_nulls(df, "p_partkey", ["p_size", "p_retailprice"], 0.05, 17)
    out = impute_knn(df, "p_partkey", ["spread", "p_size", "p_retailprice"])
    return out.withColumns({c: F.round(c, 6) for c in ("p_size", "p_retailprice")})


@query(
    "impute_missing",
    f"""WITH t AS ({with_nulls('customer', 'c_custkey', ['c_acctbal', 'c_mktsegment', 'c_name'], ['c_custkey', 'c_nationkey'], 0.02, 19)})
        SELECT c_custkey, c_acctbal IS NULL AS filled_acctbal, c_mktsegment IS NULL AS filled_mktsegment, coalesce(c_name, '') AS c_name,
               c_acctbal AS seen_acctbal, c_mktsegment AS seen_mktsegment, 0::BIGINT AS nulls_left FROM t""",
)
def impute_missing_(t):
    """Which cells a model filled, and every observed cell as it came out: forests differ, this must not."""
    df = t.customer.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment", "c_name")
    before = introduce_nulls(df, "c_custkey", ["c_acctbal", "c_mktsegment", "c_name"], 0.02, 19)
    roles = ColumnRoles(numerical=("c_acctbal", "c_nationkey"), categorical=("c_mktsegment",), short_text=("c_name",))
    after = impute_missing(before, "c_custkey", roles, seed=1)
    marks = before.select("c_custkey", F.col("c_acctbal").isNull().alias("filled_acctbal"), F.col("c_mktsegment").isNull().alias("filled_mktsegment"))
    both = after.join(marks, "c_custkey")
    left = F.col("c_acctbal").isNull().cast("bigint") + F.col("c_mktsegment").isNull().cast("bigint")
    return both.select(
        "c_custkey", "filled_acctbal", "filled_mktsegment", "c_name", F.when(~F.col("filled_acctbal"), F.col("c_acctbal")).alias("seen_acctbal"),
        F.when(~F.col("filled_mktsegment"), F.col("c_mktsegment")).alias("seen_mktsegment"), left.alias("nulls_left"),
    )


DATED = """(SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'zz' WHEN event_id % 9 = 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
            ELSE strftime(ts, '%m %d, %Y') END AS moment FROM events)"""


@query(
    "datetime_to_unix",
    f"""SELECT event_id, CASE WHEN moment = 'zz' THEN NULL WHEN event_id % 9 = 1 THEN epoch(moment::TIMESTAMP)::BIGINT
                              ELSE epoch(strptime(moment, '%m %d, %Y'))::BIGINT END AS moment FROM {DATED}""",
)
def datetime_to_unix(t):
    at = F.when(F.col("event_id") % 9 == 0, "zz").when(F.col("event_id") % 9 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    df = t.events.select("event_id", at.otherwise(F.date_format("ts", "MM dd, yyyy")).alias("moment"))
    return clean.datetime_to_unix(df, ["moment"])


@query("unix_to_datetime", "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS moment FROM events")
def unix_to_datetime(t):
    df = clean.unix_to_datetime(t.events.select("event_id", F.unix_timestamp("ts").alias("moment")), ["moment"])
    return df.withColumn("moment", F.date_format("moment", "yyyy-MM-dd HH:mm:ss"))


@query(
    "cleaning_chain",
    f"""{CHAIN}, d AS (SELECT DISTINCT o_orderkey, o_custkey, o_totalprice FROM c), {bounds('d', 'o_totalprice', 'fence')}
        SELECT o_orderkey, o_custkey, round({clamp('o_totalprice', 'fence')}, 4) AS o_totalprice FROM d, fence""",
)
def cleaning_chain(t):
    cleaned = clean.winsorize(clean.dedupe_rows(damaged_orders(t).drop("copy")), ["o_totalprice"])
    return cleaned.withColumn("o_totalprice", F.round("o_totalprice", 4))

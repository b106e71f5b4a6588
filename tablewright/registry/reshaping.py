"""Projections, filters, samples, nested records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import clean, relational, selection
from tablewright.operators.corrupt import introduce_nulls
from tablewright.operators.encode import one_hot
from tablewright.operators.roles import any_in_range, stringify_columns
from tablewright.registry import query
from tablewright.registry.sql import nth, u, with_nulls

CUSTOMER_NULLS = with_nulls("customer", "c_custkey", ["c_acctbal", "c_mktsegment"], ["c_custkey", "c_name"], 0.4, 3)


def customer_nulls(t):
    """Customers with two fifths of the balances and of the segments missing."""
    df = t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return introduce_nulls(df, "c_custkey", ["c_acctbal", "c_mktsegment"], 0.4, 3)


@query("select_reorder", "SELECT o_orderdate, o_custkey, o_orderkey FROM orders")
def select_reorder(t):
    df = t.spark.read.parquet(t.path("orders"))
    return relational.select_reorder(df, ["o_orderdate", "o_custkey", "o_orderkey"])


@query(
    "rename_columns",
    "SELECT c_custkey AS id, c_name AS name, c_nationkey, c_acctbal AS balance, c_mktsegment FROM customer",
)
def rename_columns(t):
    return relational.rename_columns(t.customer, {"c_custkey": "id", "c_name": "name", "c_acctbal": "balance"})


@query("suffix_columns", "SELECT p_partkey AS base, p_name AS p_name_base, p_brand AS p_brand_base FROM part")
def suffix_columns(t):
    return relational.suffix_columns(t.part.select("p_partkey", "p_name", "p_brand"), "base", "p_partkey")


@query("drop_columns", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def drop_columns(t):
    return t.orders.drop("o_orderstatus", "o_orderdate", "o_orderpriority")


@query(
    "drop_prefixed",
    """SELECT l_orderkey, l_linestatus, l_returnflag, l_returnflag = 'A' AS "l_returnflag_A", l_returnflag = 'N' AS "l_returnflag_N",
              l_returnflag = 'R' AS "l_returnflag_R" FROM lineitem""",
)
def drop_prefixed(t):
    df = one_hot(t.lineitem.select("l_orderkey", "l_linestatus", "l_returnflag"), ["l_linestatus", "l_returnflag"])
    return relational.drop_prefixed(df, "l_linestatus")


@query("pop_target", f"SELECT c_mktsegment FROM ({CUSTOMER_NULLS}) WHERE c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL")
def pop_target(t):
    return relational.pop_target(customer_nulls(t), "c_mktsegment")[1]


@query(
    "drop_all_null_rows",
    f"SELECT c_acctbal, c_mktsegment FROM ({CUSTOMER_NULLS}) WHERE c_acctbal IS NOT NULL OR c_mktsegment IS NOT NULL",
)
def drop_all_null_rows(t):
    return customer_nulls(t).select("c_acctbal", "c_mktsegment").na.drop("all")


@query(
    "drop_any_null_rows",
    f"SELECT * FROM ({CUSTOMER_NULLS}) WHERE c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL",
)
def drop_any_null_rows(t):
    return customer_nulls(t).na.drop("any")


@query("fill_text_empty", f"SELECT c_custkey, c_name, c_acctbal, coalesce(c_mktsegment, '') AS c_mktsegment FROM ({CUSTOMER_NULLS})")
def fill_text_empty(t):
    return clean.fill_text_empty(customer_nulls(t), ["c_mktsegment"])


@query(
    "filter_null_split",
    f"SELECT CASE WHEN c_acctbal IS NULL THEN 'test' ELSE 'train' END AS side, c_custkey, c_mktsegment FROM ({CUSTOMER_NULLS})",
)
def filter_null_split(t):
    train, test = relational.filter_null_split(customer_nulls(t), "c_acctbal")
    sides = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return sides.select("side", "c_custkey", "c_mktsegment")


@query(
    "filter_range_any",
    """SELECT bool_or(epoch(ts) BETWEEN 1e9 AND 2e9) AS unix_time, bool_or(value BETWEEN 1e9 AND 2e9) AS value,
              bool_or(event_id BETWEEN 1e9 AND 2e9) AS event_id FROM events""",
)
def filter_range_any(t):
    return t.events.agg(
        any_in_range(F.unix_timestamp("ts")).alias("unix_time"), any_in_range(F.col("value")).alias("value"),
        any_in_range(F.col("event_id")).alias("event_id"),
    )


@query("sample_fraction", f"SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE {u('l_orderkey, l_linenumber', 'fraction', 5)} < 0.01")
def sample_fraction(t):
    return selection.sample_fraction(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"], 0.01, 5)


@query("sample_n", f"SELECT o_orderkey, o_totalprice FROM (SELECT *, {nth('o_orderkey', 'n', 7)} AS place FROM orders) WHERE place <= 1000")
def sample_n(t):
    return selection.sample_n(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", 1000, 7)


@query("head_fraction", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT (SELECT count(*) // 100 FROM events)")
def head_fraction(t):
    return selection.head_fraction(t.events.select("event_id", "event_type"), "event_id")


@query(
    "explode_records",
    """SELECT c.conv_id AS asin, c.turn, c.role, length(c.text)::BIGINT AS n_chars, i.w AS place, 'none' AS helpful
       FROM conversations c, (SELECT unnest(range(1, 3)) AS w) i""",
)
def explode_records(t):
    # Conversations are nested two deep, then taken apart again; `helpful` is never set.
    mark = F.lit(None).cast("string").alias("helpful")
    answers = F.array(*[F.struct(F.lit(i).cast("bigint").alias("place"), mark) for i in (1, 2)]).alias("answers")
    turn = F.struct("turn", "role", F.length("text").cast("bigint").alias("n_chars"), answers)
    nested = t.conversations.groupBy(F.col("conv_id").alias("asin")).agg(F.collect_list(turn).alias("questions"))
    questions = relational.explode_records(nested, "questions", {c: c for c in ("turn", "role", "n_chars", "answers")}, ["asin"])
    return relational.explode_records(
        questions, "answers", {"place": "place", "helpful": "helpful"}, ["asin", "turn", "role", "n_chars"], {"helpful": F.lit("none")}
    )


@query("flatten_struct", "SELECT o_orderkey AS uid, o_custkey AS selling, o_orderstatus AS sold, o_totalprice AS want FROM orders")
def flatten_struct(t):
    lists = F.struct(F.col("o_custkey").alias("selling"), F.col("o_orderstatus").alias("sold"), F.col("o_totalprice").alias("want"))
    return relational.flatten_struct(t.orders.select(F.col("o_orderkey").alias("uid"), lists.alias("lists")), "lists", ["uid"])


@query("concat_features", "SELECT o_orderkey, o_totalprice, year(o_orderdate)::BIGINT AS year, o_orderstatus FROM orders")
def concat_features(t):
    numbers = t.orders.select("o_orderkey", "o_totalprice")
    dates = t.orders.select("o_orderkey", F.year("o_orderdate").cast("bigint").alias("year"))
    return relational.concat_features(numbers, dates, t.orders.select("o_orderkey", "o_orderstatus"), key="o_orderkey")


@query("stringify_columns", "SELECT event_id, event_type, props FROM events")
def stringify_columns_(t):
    parsed = F.from_json("props", "k bigint")
    df = t.events.select("event_id", "event_type", F.to_json(parsed).alias("plain"), parsed.alias("props"))
    # The data are written with a space after the colon, to_json writes none.
    return stringify_columns(df).select("event_id", "event_type", F.replace("props", F.lit(":"), F.lit(": ")).alias("props"))

"""Counts, quantiles, profiles, schemas, roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import clean, profile
from tablewright.operators import roles as role_ops
from tablewright.registry import query
from tablewright.registry.reshaping import CUSTOMER_NULLS, customer_nulls
from tablewright.session import small_table

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount"]


def _each(columns, text, join=" UNION ALL "):
    return join.join(text.format(c=c) for c in columns)


@query("dedupe_rows", "SELECT DISTINCT text, lang FROM documents")
def dedupe_rows(t):
    return clean.dedupe_rows(t.documents.select("text", "lang"))


@query("dedupe_lines", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def dedupe_lines(t):
    return clean.dedupe_rows(t.lineitem.select("l_orderkey", "l_linenumber"))


@query(
    "duplicate_count",
    """SELECT count(*) AS n_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS n_duplicate
       FROM lineitem""",
)
def duplicate_count(t):
    return clean.duplicate_count(t.lineitem.select("l_orderkey", "l_linenumber"))


@query("null_count_total", f"SELECT count(*) * 4 - count(c_custkey) - count(c_name) - count(c_acctbal) - count(c_mktsegment) AS n_null FROM ({CUSTOMER_NULLS})")
def null_count_total(t):
    return profile.null_count_total(customer_nulls(t))


@query(
    "null_count_by_col",
    f"""SELECT count(*) - count(c_custkey) AS c_custkey, count(*) - count(c_name) AS c_name, count(*) - count(c_acctbal) AS c_acctbal,
               count(*) - count(c_mktsegment) AS c_mktsegment FROM ({CUSTOMER_NULLS})""",
)
def null_count_by_col(t):
    return profile.null_counts(customer_nulls(t))


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@query("nunique", _each(ORDER_COLUMNS, """SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_unique FROM orders"""))
def nunique(t):
    return profile.nunique(t.orders, ORDER_COLUMNS).select("column", "n_unique")


@query(
    "proportion_unique",
    _each(ORDER_COLUMNS, """SELECT '{c}' AS "column", count({c}) AS n, round(count(DISTINCT {c}) / count({c}), 9) AS proportion_unique FROM orders"""),
)
def proportion_unique(t):
    return profile.nunique(t.orders, ORDER_COLUMNS).select("column", "n", F.round("proportion_unique", 9).alias("proportion_unique"))


@query("min_max", _each(NUMBERS, """SELECT '{c}' AS "column", min({c}) AS "min", max({c}) AS "max" FROM lineitem"""))
def min_max(t):
    return profile.min_max(t.lineitem, NUMBERS)


@query(
    "quantiles_exact",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {p}::DOUBLE AS p, round(quantile_cont({c}, {p}), 6) AS value FROM lineitem"""
        for c in NUMBERS
        for p in (0.25, 0.5, 0.75)
    ),
)
def quantiles_exact(t):
    table = profile.quantile_table(t.lineitem, NUMBERS, [0.25, 0.5, 0.75])
    return table.withColumn("value", F.round("value", 6))


@query(
    "iqr_bounds",
    _each(
        NUMBERS,
        """SELECT '{c}' AS "column", round(q1, 6) AS q1, round(q3, 6) AS q3, round(q1 - 1.5*(q3-q1), 6) AS lower_bound,
                  round(q3 + 1.5*(q3-q1), 6) AS upper_bound
           FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem)""",
    ),
)
def iqr_bounds(t):
    rows = [(c, *b) for c, b in profile.iqr_bounds(t.lineitem, NUMBERS).items()]
    df = small_table(t.spark, rows, "column string, q1 double, q3 double, lower_bound double, upper_bound double")
    return df.select("column", *[F.round(c, 6).alias(c) for c in df.columns[1:]])


@query("is_integer_valued", "SELECT bool_and(l_quantity % 1 = 0) AS l_quantity, bool_and(l_tax % 1 = 0) AS l_tax FROM lineitem")
def is_integer_valued(t):
    return t.lineitem.agg(*[profile.is_integer_valued(F.col(c)).alias(c) for c in ("l_quantity", "l_tax")])


@query(
    "outlier_count",
    _each(
        ["o_totalprice", "half"],
        """SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} < q1 - 1.5*(q3-q1) OR {c} > q3 + 1.5*(q3-q1)) AS n_outlier
           FROM (SELECT o_totalprice, CASE WHEN o_orderkey % 20 = 0 THEN o_totalprice * 10 ELSE o_totalprice / 2 END AS half FROM orders) o,
                (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3
                 FROM (SELECT o_totalprice, CASE WHEN o_orderkey % 20 = 0 THEN o_totalprice * 10 ELSE o_totalprice / 2 END AS half FROM orders))""",
    ),
)
def outlier_count(t):
    far = F.when(F.col("o_orderkey") % 20 == 0, F.col("o_totalprice") * 10).otherwise(F.col("o_totalprice") / 2)
    return profile.outlier_count(t.orders.select("o_totalprice", far.alias("half")), ["o_totalprice", "half"])


PART_COLUMNS = ["p_name", "p_brand", "p_type", "p_size"]


@query(
    "most_frequent",
    _each(
        PART_COLUMNS,
        """SELECT * FROM (SELECT '{c}' AS "column", {c}::VARCHAR AS value, count(*) AS n FROM part GROUP BY {c} ORDER BY n DESC, value LIMIT 1)""",
    ),
)
def most_frequent(t):
    return profile.most_frequent(t.part, PART_COLUMNS)


@query(
    "five_number_summary",
    """SELECT event_type, min(value) AS "min", round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median,
              round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS "max" FROM events GROUP BY event_type""",
)
def five_number_summary(t):
    df = profile.five_number_summary(t.events, "event_type", "value")
    return df.select("event_type", "min", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")], "max")


@query(
    "five_number_summary_many",
    """SELECT l_partkey, min(l_extendedprice) AS "min", round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.5), 4) AS median,
              round(quantile_cont(l_extendedprice, 0.75), 4) AS q3, max(l_extendedprice) AS "max" FROM lineitem GROUP BY l_partkey""",
)
def five_number_summary_many(t):
    """Box-plot statistics of every part: as many groups as parts."""
    df = profile.five_number_summary(t.lineitem, "l_partkey", "l_extendedprice")
    return df.select("l_partkey", "min", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3")], "max")


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    "results_pivot",
    "SELECT strftime(ts, '%Y-%m-%d') AS run, "
    + ", ".join(f"nullif(count(*) FILTER (WHERE event_type = '{e}'), 0) AS {e}" for e in EVENT_TYPES)
    + " FROM events GROUP BY 1",
)
def results_pivot(t):
    days = t.events.select(F.date_format("ts", "yyyy-MM-dd").alias("run"), "event_type")
    return profile.results_pivot(days, "run", "event_type", F.count(F.lit(1)), EVENT_TYPES)


def _profile_sql(table: str, columns: dict[str, str]) -> str:
    rows = []
    for c, kind in columns.items():
        number = kind in ("int", "bigint", "double")
        value = f"{c}::DOUBLE" if number else "NULL::DOUBLE"
        zeros = f"count(*) FILTER (WHERE {c} = 0)" if number else "NULL::BIGINT"
        rows.append(
            f"""SELECT '{c}' AS "column", '{kind}' AS type, count(*) AS n, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct,
                       min({value}) AS "min", max({value}) AS "max", round(avg({value}), 4) AS mean, round(stddev_samp({value}), 4) AS std, {zeros} AS zeros,
                       (SELECT {c}::VARCHAR FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c}::VARCHAR LIMIT 1) AS mode
                FROM {table}"""
        )
    return " UNION ALL ".join(rows)


PROFILE_KINDS = {"c_custkey": "bigint", "c_name": "string", "c_acctbal": "double", "c_mktsegment": "string"}


@query("table_profile", f"WITH x AS ({CUSTOMER_NULLS}) {_profile_sql('x', PROFILE_KINDS)}")
def table_profile(t):
    df = profile.table_profile(customer_nulls(t))
    return df.withColumns({c: F.round(c, 4) for c in ("mean", "std")})


def _schema_sql(table: str, columns: dict[str, str], texts: list[str]) -> str:
    rows = []
    for c, kind in columns.items():
        number = kind in ("int", "bigint", "double")
        value = f"{c}::DOUBLE" if number else "NULL::DOUBLE"
        domain = "NULL::VARCHAR"
        if c in texts:
            domain = f"(SELECT CASE WHEN count(DISTINCT {c}) <= 100 THEN string_agg(DISTINCT {c}, '|' ORDER BY {c}) END FROM {table})"
        rows.append(
            f"""SELECT '{c}' AS "column", '{kind}' AS type, count({c}) = count(*) AS required, {domain} AS domain, min({value}) AS "min", max({value}) AS "max" FROM {table}"""
        )
    return " UNION ALL ".join(rows)


@query("infer_schema", f"WITH x AS ({CUSTOMER_NULLS}) {_schema_sql('x', PROFILE_KINDS, ['c_name', 'c_mktsegment'])}")
def infer_schema(t):
    return profile.infer_schema(customer_nulls(t)).withColumn("domain", F.array_join("domain", "|"))


@query(
    "validate_schema",
    """WITH old AS (SELECT * FROM part WHERE p_partkey % 2 = 0),
            new AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'Brand#new' ELSE p_brand END AS p_brand,
                           CASE WHEN p_partkey % 11 <> 0 THEN p_type END AS p_type, p_size::VARCHAR AS p_size, p_retailprice * 2 AS p_retailprice, 1 AS extra
                    FROM part)
       SELECT 'p_name' AS "column", 'missing column' AS anomaly, NULL::BIGINT AS cells
       UNION ALL SELECT 'extra', 'new column', NULL
       UNION ALL SELECT 'p_size', 'type change', NULL
       UNION ALL SELECT * FROM (
           SELECT 'p_brand', 'outside domain', count(*) FILTER (WHERE p_brand NOT IN (SELECT p_brand FROM old)) FROM new
           UNION ALL SELECT 'p_type', 'null in required column', count(*) FILTER (WHERE p_type IS NULL) FROM new
           UNION ALL SELECT 'p_retailprice', 'outside range', count(*) FILTER (WHERE p_retailprice NOT BETWEEN (SELECT min(p_retailprice) FROM old)
                             AND (SELECT max(p_retailprice) FROM old)) FROM new
           UNION ALL SELECT 'p_partkey', 'outside range', count(*) FILTER (WHERE p_partkey NOT BETWEEN (SELECT min(p_partkey) FROM old)
                             AND (SELECT max(p_partkey) FROM old)) FROM new) v("column", anomaly, cells) WHERE cells > 0""",
)
def validate_schema(t):
    expected = profile.infer_schema(t.part.filter("p_partkey % 2 = 0"))
    new = t.part.select(
        "p_partkey",
        F.when(F.col("p_partkey") % 7 == 0, "Brand#new").otherwise(F.col("p_brand")).alias("p_brand"),
        F.when(F.col("p_partkey") % 11 != 0, F.col("p_type")).alias("p_type"),
        F.col("p_size").cast("string").alias("p_size"),
        (F.col("p_retailprice") * 2).alias("p_retailprice"),
        F.lit(1).alias("extra"),
    )
    return profile.validate_schema(new, expected)


@query("row_count", "SELECT count(*) AS n FROM lineitem")
def row_count(t):
    return t.lineitem.agg(F.count(F.lit(1)).alias("n"))


@query(
    "column_types",
    """SELECT * FROM (VALUES (0, 'o_orderkey', 'bigint'), (1, 'o_custkey', 'bigint'), (2, 'o_orderstatus', 'string'),
       (3, 'o_totalprice', 'double'), (4, 'o_orderdate', 'timestamp'), (5, 'o_orderpriority', 'string')) v(position, "column", type)""",
)
def column_types(t):
    return profile.column_types(t.orders)


@query(
    "head_tail",
    """SELECT * FROM (SELECT o_orderkey, o_totalprice, 'head' AS part FROM orders ORDER BY o_orderkey LIMIT 5)
       UNION ALL SELECT * FROM (SELECT o_orderkey, o_totalprice, 'tail' AS part FROM orders ORDER BY o_orderkey DESC LIMIT 5)""",
)
def head_tail(t):
    return profile.head_tail(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey")


# --- roles -----------------------------------------------------------------------------

WORDS = r"len(regexp_extract_all({c}, '[^\s\x0B\x85\p{{Z}}]+'))"


def _role_sql(table: str, columns: dict[str, str], strict: bool) -> str:
    rows = []
    for c, kind in columns.items():
        few = f"count(DISTINCT {c}) <= {{}} AND count(DISTINCT {c}) / count({c}) <= 0.2"
        if kind == "date":
            role = "max('datetime')"
        elif kind == "number":
            rule = few.format(4 if strict else 100)
            unix = f"bool_or({c} BETWEEN 1e9 AND 2e9)" if "time" in c and not strict else "false"
            role = f"CASE WHEN {unix} THEN 'datetime' WHEN {rule} THEN 'categorical' ELSE 'numerical' END"
        else:
            date = f"bool_and(try_strptime({c}, '%m %d, %Y') IS NOT NULL)" if strict else f"bool_and(try_cast({c} AS TIMESTAMP) IS NOT NULL)"
            text = "'short_text'" if strict else f"CASE WHEN max({WORDS.format(c=c)}) <= 30 THEN 'short_text' ELSE 'long_text' END"
            role = f"CASE WHEN {date} THEN 'datetime' WHEN {few.format(100)} THEN 'categorical' ELSE {text} END"
        rows.append(f"""SELECT '{c}' AS "column", {role} AS role FROM {table}""")
    return " UNION ALL ".join(rows)


LINEITEM = {
    "l_orderkey": "number", "l_partkey": "number", "l_suppkey": "number", "l_linenumber": "number", "l_quantity": "number", "l_extendedprice": "number",
    "l_discount": "number", "l_tax": "number", "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "date",
}
DOCUMENTS = {"doc_id": "number", "text": "text", "lang": "text", "source": "text", "n_chars": "number"}
# Events with the time as Unix seconds, as text of two layouts, and as a plain number.
EVENTS = {"event_id": "number", "unixtime": "number", "stamp": "number", "day": "text", "iso": "text", "event_type": "text", "value": "number", "props": "text"}
EVENTS_SQL = """(SELECT event_id, epoch(ts) AS unixtime, epoch(ts) AS stamp, strftime(ts, '%m %d, %Y') AS day, strftime(ts, '%Y-%m-%d') AS iso,
                        event_type, value, props FROM events)"""


def dated_events(t):
    seconds = F.unix_timestamp("ts")
    return t.events.select(
        "event_id", seconds.alias("unixtime"), seconds.alias("stamp"), F.date_format("ts", "MM dd, yyyy").alias("day"),
        F.date_format("ts", "yyyy-MM-dd").alias("iso"), "event_type", "value", "props",
    )


def _general_events() -> str:
    # `day` is a date under the layouts tried, which the plain SQL cast does not know.
    return _role_sql(EVENTS_SQL, {**EVENTS, "day": "date"}, False)


@query("classify_columns_general", " UNION ALL ".join([_role_sql("lineitem", LINEITEM, False), _role_sql("documents", DOCUMENTS, False), _general_events()]))
def classify_columns_general(t):
    tables = [t.lineitem, t.documents, dated_events(t)]
    parts = [role_ops.roles_table(df, role_ops.classify_columns(df)) for df in tables]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


STRICT_LINEITEM = {c: k for c, k in LINEITEM.items() if c != "l_returnflag"}


@query("classify_columns_strict", " UNION ALL ".join([_role_sql("lineitem", STRICT_LINEITEM, True), _role_sql("documents", DOCUMENTS, True), _role_sql(EVENTS_SQL, EVENTS, True)]))
def classify_columns_strict(t):
    lines = role_ops.roles_table(t.lineitem, role_ops.classify_columns(t.lineitem, "strict", target=["l_returnflag"]))
    rest = [role_ops.roles_table(df, role_ops.classify_columns(df, "strict")) for df in (t.documents, dated_events(t))]
    return lines.unionByName(rest[0]).unionByName(rest[1])


@query("cast_by_role", "SELECT p_partkey::DOUBLE AS p_partkey, p_name, p_brand, p_type, p_size::VARCHAR AS p_size, p_retailprice FROM part")
def cast_by_role(t):
    # Roles set by hand: what the data say about p_size changes with the number of parts.
    roles = role_ops.classify_columns(t.part).replace(numerical=["p_partkey", "p_retailprice"], categorical=["p_brand", "p_type", "p_size"])
    return role_ops.cast_by_role(t.part, roles)

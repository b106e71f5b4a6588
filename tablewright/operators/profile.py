"""Counts, ranges, distinct values, table profile, inferred schema and its validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.quantiles import exact_quantiles, grouped_quantiles
from tablewright.session import small_table

DOMAIN_LIMIT = 100
IQR_FACTOR = 1.5


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def numeric_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """Names of the numeric and of the other columns."""
    numeric = [f.name for f in df.schema if is_numeric(f.dataType)]
    return numeric, [c for c in df.columns if c not in numeric]


def column_types(df: DataFrame) -> DataFrame:
    rows = [(i, name, kind) for i, (name, kind) in enumerate(df.dtypes)]
    return small_table(df.sparkSession, rows, "position int, column string, type string")


def head_tail(df: DataFrame, ordinal: str, n: int = 5) -> DataFrame:
    """First and last ``n`` rows by an ordinal column."""
    first = df.orderBy(F.col(ordinal)).limit(n).withColumn("part", F.lit("head"))
    last = df.orderBy(F.col(ordinal).desc()).limit(n).withColumn("part", F.lit("tail"))
    return first.unionByName(last)


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: nulls per column, in a single pass."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns or df.columns])


def null_count_total(df: DataFrame) -> DataFrame:
    counts = null_counts(df)
    total = sum((F.col(c) for c in counts.columns), F.lit(0).cast("bigint"))
    return counts.select(total.alias("n_null"))


def to_long(row: DataFrame, names: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """One wide row of ``{name}__{measure}`` to one row per name."""
    entries = [
        F.struct(F.lit(n).alias("column"), *[F.col(f"{n}__{m}").alias(m) for m in measures]) for n in names
    ]
    return row.select(F.inline(F.array(*entries)))


def nunique(df: DataFrame, columns: Sequence[str], approx: bool = False, rsd: float = 0.02) -> DataFrame:
    """Per column: non-null values, distinct values and their ratio (null if no value)."""

    def distinct(c: str) -> Column:
        return F.approx_count_distinct(c, rsd) if approx else F.count_distinct(c)

    aggs = []
    for c in columns:
        aggs += [F.count(c).alias(f"{c}__n"), distinct(c).alias(f"{c}__n_unique")]
    long = to_long(df.agg(*aggs), columns, ["n", "n_unique"])
    ratio = F.when(F.col("n") > 0, F.col("n_unique") / F.col("n"))
    return long.withColumn("proportion_unique", ratio)


def min_max(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    aggs = []
    for c in columns:
        aggs += [F.min(c).cast("double").alias(f"{c}__min"), F.max(c).cast("double").alias(f"{c}__max")]
    return to_long(df.agg(*aggs), columns, ["min", "max"])


def is_integer_valued(col: Column) -> Column:
    """Aggregate: every non-null value is whole (true if there is none)."""
    return F.coalesce(F.bool_and(col % F.lit(1) == F.lit(0)), F.lit(True))


def iqr_bounds(
    df: DataFrame, columns: Sequence[str], factor: float = IQR_FACTOR, counts: Mapping[str, int] | None = None
) -> dict[str, tuple[float, float, float, float]]:
    """Per column: first quartile, third quartile and the two fences around them."""
    out = {}
    for name, (q1, q3) in exact_quantiles(df, list(columns), [0.25, 0.75], counts=counts).items():
        if q1 is None:
            raise ValueError(f"column {name!r} has no value to take quartiles of")
        reach = factor * (q3 - q1)
        out[name] = (q1, q3, q1 - reach, q3 + reach)
    return out


def quantile_table(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    rows = [
        (name, float(p), value)
        for name, values in exact_quantiles(df, list(columns), probabilities).items()
        for p, value in zip(probabilities, values)
    ]
    return small_table(df.sparkSession, rows, "column string, p double, value double")


def outlier_count(df: DataFrame, columns: Sequence[str], factor: float = IQR_FACTOR) -> DataFrame:
    """Values outside the fences, per column."""
    bounds = iqr_bounds(df, columns, factor)
    aggs = [
        F.count_if((F.col(c) < F.lit(lo)) | (F.col(c) > F.lit(hi))).alias(f"{c}__n_outlier")
        for c, (_, _, lo, hi) in bounds.items()
    ]
    return to_long(df.agg(*aggs), list(columns), ["n_outlier"])


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per (column, value as text), nulls included: one shuffle for all columns."""
    entries = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    return df.select(F.inline(F.array(*entries))).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def most_frequent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent non-null value per column, ties to the smallest text."""
    counts = value_counts(df, columns).filter(F.col("value").isNotNull())
    # min_by on (-n, value) is a partial aggregate: no per-column group is gathered.
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("value"))).alias("best")
    return counts.groupBy("column").agg(best).select("column", F.col("best.value").alias("value"), (-F.col("best.less")).alias("n"))


def five_number_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    """Minimum, quartiles and maximum of ``value`` per group (box-plot statistics)."""
    return grouped_quantiles(df, group, value, [0.0, 0.25, 0.5, 0.75, 1.0], ["min", "q1", "median", "q3", "max"])


def results_pivot(df: DataFrame, run: str, variant: str, value: Column, variants: Sequence[str]) -> DataFrame:
    """One row per run, one column per variant. Variants are given, so no extra pass."""
    return df.groupBy(run).pivot(variant, list(variants)).agg(value)


# --- profile, schema, validation -----------------------------------------------------

MEASURES = ["min", "max", "mean", "std", "zeros"]


def table_profile(df: DataFrame, columns: Sequence[str] | None = None, distinct: str = "exact") -> DataFrame:
    """One row per column: type, rows, nulls, distinct values, mode; range and moments of numbers.

    ``distinct="approx"`` replaces distinct values by a sketch and leaves the mode null:
    one pass without the shuffle of values.
    """
    names = list(columns or df.columns)
    types = dict(df.dtypes)
    aggs = []
    for c in names:
        numeric = is_numeric(df.schema[c].dataType)
        value = F.col(c).cast("double") if numeric else F.lit(None).cast("double")
        aggs += [
            F.count(F.lit(1)).alias(f"{c}__n"),
            F.count_if(F.col(c).isNull()).alias(f"{c}__n_null"),
            F.min(value).alias(f"{c}__min"),
            F.max(value).alias(f"{c}__max"),
            F.avg(value).alias(f"{c}__mean"),
            F.stddev_samp(value).alias(f"{c}__std"),
            (F.count_if(value == 0.0) if numeric else F.lit(None).cast("bigint")).alias(f"{c}__zeros"),
        ]
        if distinct == "approx":
            aggs += [F.approx_count_distinct(c).alias(f"{c}__n_distinct"), F.lit(None).cast("string").alias(f"{c}__mode")]
    measures = ["n", "n_null", *MEASURES] + (["n_distinct", "mode"] if distinct == "approx" else [])
    out = to_long(df.agg(*aggs), names, measures)
    if distinct == "exact":
        counts = value_counts(df, names)
        best = F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("less"), F.col("value"))))
        shape = counts.groupBy("column").agg(F.count("value").alias("n_distinct"), best["value"].alias("mode"))
        out = out.join(shape, "column", "left").withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0).cast("bigint")))
    kind = F.create_map(*[F.lit(x) for c in names for x in (c, types[c])])
    return out.select("column", kind[F.col("column")].alias("type"), "n", "n_null", "n_distinct", *MEASURES, "mode")


def infer_schema(df: DataFrame, columns: Sequence[str] | None = None, domain_limit: int = DOMAIN_LIMIT) -> DataFrame:
    """Expected type, presence, text domain and numeric range of each column."""
    names = list(columns or df.columns)
    profile = table_profile(df, names)
    texts = [c for c in names if isinstance(df.schema[c].dataType, T.StringType)]
    none = F.lit(None).cast("array<string>")
    if not texts:
        return _schema_columns(profile.withColumn("domain", none))
    # Approximate counts decide which columns may have a small domain; only those are listed.
    row = df.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in texts]).first()
    small = [c for c in texts if row[c] <= 2 * domain_limit]
    if not small:
        return _schema_columns(profile.withColumn("domain", none))
    values = value_counts(df, small).filter(F.col("value").isNotNull())
    domains = values.groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("domain"))
    domains = domains.filter(F.size("domain") <= domain_limit)
    return _schema_columns(profile.join(domains, "column", "left"))


def _schema_columns(profile: DataFrame) -> DataFrame:
    return profile.select("column", "type", (F.col("n_null") == 0).alias("required"), "domain", "min", "max")


def validate_schema(df: DataFrame, schema: DataFrame) -> DataFrame:
    """One row per violation of an inferred schema: column, anomaly, cells concerned.

    Anomalies: missing column, new column, type change, nulls in a required column,
    value outside the domain, value outside the range. The schema has one row per
    column; the table is read once.
    """
    expected = {row["column"]: row for row in schema.collect()}
    present = dict(df.dtypes)
    found: list[tuple[str, str, int | None]] = []
    checks: list[tuple[str, str, Column]] = []
    for name in present:
        if name not in expected:
            found.append((name, "new column", None))
    for name, want in expected.items():
        if name not in present:
            found.append((name, "missing column", None))
            continue
        if present[name] != want["type"]:
            found.append((name, "type change", None))
        if want["required"]:
            checks.append((name, "null in required column", F.col(name).isNull()))
        if want["domain"] is not None:
            checks.append((name, "outside domain", ~F.col(name).cast("string").isin(list(want["domain"]))))
        if want["min"] is not None and is_numeric(df.schema[name].dataType):
            value = F.col(name).cast("double")
            checks.append((name, "outside range", (value < F.lit(want["min"])) | (value > F.lit(want["max"]))))
    spark = df.sparkSession
    out = small_table(spark, found, "column string, anomaly string, cells bigint")
    if checks:
        counts = df.agg(*[F.count_if(test).alias(f"x{i}") for i, (_, _, test) in enumerate(checks)])
        rows = [
            F.struct(F.lit(c).alias("column"), F.lit(a).alias("anomaly"), F.col(f"x{i}").alias("cells"))
            for i, (c, a, _) in enumerate(checks)
        ]
        out = out.unionByName(counts.select(F.inline(F.array(*rows))).filter(F.col("cells") > 0))
    return out

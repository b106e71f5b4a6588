"""Repairs that need no model: duplicates, outliers, plain fills, date coercion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.dates import from_unix, to_unix
from tablewright.functions.nulls import nan_to_null
from tablewright.operators.profile import IQR_FACTOR, iqr_bounds, is_integer_valued, most_frequent
from tablewright.operators.relational import contains_map, groupable


def dedupe_rows(df: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """Drop repeated rows; nulls and NaN are equal to themselves, maps compare by content.

    Copies are folded on the map side before the shuffle, so many copies of one row
    never meet in one task. Columns in ``ignore`` (row numbers) do not count.
    """
    maps = [f for f in df.schema if contains_map(f.dataType) and f.name not in ignore]
    plain = [c for c in df.columns if c not in {f.name for f in maps} and c not in ignore]
    if not maps:
        return df.dropDuplicates(plain)
    keyed = df.withColumns({f"__{f.name}": groupable(F.col(f.name), f.dataType) for f in maps})
    return keyed.dropDuplicates(plain + [f"__{f.name}" for f in maps]).select(*df.columns)


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows, and rows that ``dedupe_rows`` would drop."""
    keys = [groupable(F.col(f.name), f.dataType).alias(f.name) for f in df.schema]
    copies = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = F.coalesce(F.sum("__n"), F.lit(0).cast("bigint"))
    return copies.agg(total.alias("n_rows"), (total - F.count(F.lit(1))).alias("n_duplicate"))


def fill_text_empty(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.fill("", list(columns))


def datetime_to_unix(df: DataFrame, columns: Sequence[str], layouts: list[str] | None = None) -> DataFrame:
    """Dates in any form to Unix seconds; what cannot be read becomes null."""
    return df.withColumns({c: to_unix(df, c, layouts) for c in columns})


def unix_to_datetime(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: from_unix(F.col(c)) for c in columns})


class Winsorizer(Estimator):
    """Clamp numbers to the quartile fences. Columns of whole numbers are truncated to bigint."""

    def __init__(self, columns: Sequence[str], factor: float = IQR_FACTOR):
        super().__init__()
        self.columns, self.factor = list(columns), factor

    def _fit(self, df: DataFrame) -> WinsorModel:
        aggs = []
        for i, c in enumerate(self.columns):
            floating = isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType, T.DecimalType))
            aggs += [F.count(c).alias(f"n{i}"), (is_integer_valued(F.col(c)) if floating else F.lit(True)).alias(f"w{i}")]
        if not aggs:
            return WinsorModel({})
        facts = df.agg(*aggs).first()
        bounds = iqr_bounds(df, self.columns, self.factor, {c: facts[f"n{i}"] for i, c in enumerate(self.columns)})
        whole = {c: facts[f"w{i}"] for i, c in enumerate(self.columns)}
        return WinsorModel({c: (lo, hi, whole[c]) for c, (_, _, lo, hi) in bounds.items()})


class WinsorModel(Model):
    def __init__(self, bounds: dict[str, tuple[float, float, bool]]):
        super().__init__()
        self.bounds = bounds

    def _transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, (lo, hi, whole) in self.bounds.items():
            value = F.col(c).cast("double")
            clamped = F.when(value < F.lit(lo), F.lit(lo)).when(value > F.lit(hi), F.lit(hi)).otherwise(value)
            out[c] = clamped.cast("bigint") if whole else clamped
        return df.withColumns(out) if out else df


def winsorize(df: DataFrame, columns: Sequence[str], factor: float = IQR_FACTOR) -> DataFrame:
    return Winsorizer(columns, factor).fit(df).transform(df)


class MostFrequentImputer(Estimator):
    """Fill nulls of each column with its most frequent value (ties: smallest text)."""

    def __init__(self, columns: Sequence[str]):
        super().__init__()
        self.columns = list(columns)

    def _fit(self, df: DataFrame) -> FillModel:
        return FillModel({row["column"]: row["value"] for row in most_frequent(df, self.columns).collect()})


class FillModel(Model):
    def __init__(self, values: dict[str, str]):
        super().__init__()
        self.values = values

    def _transform(self, df: DataFrame) -> DataFrame:
        fills = {c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in self.values.items()}
        return df.withColumns(fills) if fills else df


def impute_simple(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return MostFrequentImputer(columns).fit(df).transform(df)


__all__ = [
    "FillModel", "MostFrequentImputer", "WinsorModel", "Winsorizer", "datetime_to_unix", "dedupe_rows",
    "duplicate_count", "fill_text_empty", "impute_simple", "nan_to_null", "unix_to_datetime", "winsorize",
]

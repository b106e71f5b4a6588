"""Null handling shared by the readers and the profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    """A NaN is a missing value: turn it into null in every floating-point column."""
    fixes = {
        f.name: F.when(F.isnan(F.col(f.name)), None).otherwise(F.col(f.name))
        for f in df.schema
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(fixes) if fixes else df


def count_if(condition: Column) -> Column:
    return F.count_if(condition)

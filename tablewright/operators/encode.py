"""Encoders for categories, dates and numbers. Fit once, apply to any table or stream."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.feature import IndexToString, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions import dates
from tablewright.operators.ranking import dense_codes
from tablewright.session import small_table

logger = logging.getLogger(__name__)

ONE_HOT_LIMIT = 10
WIDEST = 2000  # indicator columns of one category column that a table may get
DICTIONARY_LIMIT, DICTIONARY_BYTES = 100_000, 64 << 20  # categories that may travel to every task


def dictionaries(df: DataFrame, columns: Sequence[str], limit: int = DICTIONARY_LIMIT) -> dict[str, list | None]:
    """Sorted distinct non-null values per column; null where there are more than ``limit``.

    One pass sketches the number of values and finds the longest; only columns that fit, and
    together have at most ``DICTIONARY_BYTES``, come to the driver.
    """
    if not columns:
        return {}
    longest = [F.max(F.octet_length(F.col(c).cast("string"))).alias(f"__{i}") for i, c in enumerate(columns)]
    sizes = df.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in columns], *longest).first()
    out: dict[str, list | None] = {}
    small, held = [], 0
    for i, c in sorted(enumerate(columns), key=lambda ic: sizes[ic[1]]):
        need = sizes[c] * (sizes[f"__{i}"] or 0)
        if sizes[c] <= limit and held + need <= DICTIONARY_BYTES:
            small.append(c)
            held += need
    # Small columns share one job: the set of values of each is bounded by the check above.
    if small:
        sets = df.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in small]).first()
        out.update({c: list(sets[c]) for c in small})
    out.update({c: None for c in columns if c not in small})
    return {c: out[c] for c in columns}


def indicator_columns(column: str, values: Sequence) -> dict[str, Column]:
    """``{column}_{value}`` per known value; null and unknown values are false everywhere."""
    return {f"{column}_{v}": F.col(column).eqNullSafe(F.lit(v)) for v in values}


def code_column(column: str, values: Sequence) -> Column:
    """Place of the value among the sorted values from 0; null and unknown give -1."""
    if not values:
        return F.lit(-1).cast("bigint")
    place = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column)) - 1
    return F.coalesce(place, F.lit(-1)).cast("bigint")


class CategoricalEncoder(Estimator):
    """Indicators for columns of at most 10 values, sorted codes ``{column}_label`` for others.

    ``one_hot_limit=None`` makes indicators for every column, ``0`` codes for every column. A
    column with too many values for indicator columns raises; see ``IndicatorVector``.
    With ``on_error="skip"`` a column that cannot be encoded is logged and left out.
    """

    def __init__(self, columns: Sequence[str], one_hot_limit: int | None = ONE_HOT_LIMIT, label_suffix: str = "_label", on_error: str = "raise", limit: int = DICTIONARY_LIMIT):
        super().__init__()
        self.columns, self.one_hot_limit, self.label_suffix = list(columns), one_hot_limit, label_suffix
        self.on_error, self.limit = on_error, limit

    def _fit(self, df: DataFrame) -> CategoricalModel:
        known = [c for c in self.columns if c in df.columns]
        for c in self.columns:
            if c not in known:
                if self.on_error != "skip":
                    raise ValueError(f"the table has no column {c!r}")
                logger.warning("no column %r to encode", c)
        words = dictionaries(df, known, self.limit)
        hot = {c: v for c, v in words.items() if v is not None and (self.one_hot_limit is None or len(v) <= self.one_hot_limit)}
        for c, v in words.items():
            if self.one_hot_limit is None and (v is None or len(v) > WIDEST):
                raise ValueError(f"{c!r} has too many values for a column each; use IndicatorVector")
        tables = {c: dense_codes(df, c) for c, v in words.items() if v is None}
        labels = {c: v for c, v in words.items() if v is not None and c not in hot}
        return CategoricalModel(known, hot, labels, tables, self.label_suffix)


class CategoricalModel(Model):
    """Row-wise except for columns beyond the dictionary limit, which join their code table."""

    def __init__(self, columns, hot, labels, tables, label_suffix):
        super().__init__()
        self.columns, self.hot, self.labels, self.tables, self.label_suffix = columns, hot, labels, tables, label_suffix

    @property
    def features(self) -> list[str]:
        out: list[str] = []
        for c in self.columns:
            out += list(indicator_columns(c, self.hot[c])) if c in self.hot else [c + self.label_suffix]
        return out

    def _transform(self, df: DataFrame) -> DataFrame:
        new: dict[str, Column] = {}
        for c in self.columns:
            if c in self.hot:
                new.update(indicator_columns(c, self.hot[c]))
            elif c in self.labels:
                values = self.labels[c]
                if len(values) <= 256:
                    new[c + self.label_suffix] = code_column(c, values)
                else:
                    # A map is searched by hash, an array from its start.
                    kind = df.schema[c].dataType.simpleString()
                    table = small_table(df.sparkSession, [(v, i) for i, v in enumerate(values)], f"value {kind}, code bigint")
                    df = self._join_codes(df, c, table, small=True)
        out = df.withColumns(new) if new else df
        for c, table in self.tables.items():
            out = self._join_codes(out, c, table, small=False)
        return out

    def _join_codes(self, df: DataFrame, column: str, table: DataFrame, small: bool) -> DataFrame:
        codes = table.select(F.col("value").alias("__value"), F.col("code").alias("__code"))
        joined = df.join(F.broadcast(codes) if small else codes, F.col(column) == F.col("__value"), "left")
        code = F.coalesce(F.col("__code"), F.lit(-1).cast("bigint"))
        return joined.withColumn(column + self.label_suffix, code).drop("__value", "__code")


def one_hot(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return CategoricalEncoder(columns, one_hot_limit=None).fit(df).transform(df)


class IndicatorVector(Estimator):
    """Indicators for all values of a column as one sparse vector ``{column}_vector``.

    Values are numbered in sorted order; null and unknown values are all zero. Works for any
    number of values: beyond the dictionary limit their numbers are joined, not shipped.
    """

    def __init__(self, column: str, limit: int = DICTIONARY_LIMIT):
        super().__init__()
        self.column, self.limit = column, limit

    def _fit(self, df: DataFrame) -> IndicatorVectorModel:
        codes = CategoricalEncoder([self.column], one_hot_limit=0, label_suffix="__code", limit=self.limit).fit(df.select(self.column))
        table = codes.tables.get(self.column)
        width = table.count() if table is not None else len(codes.labels.get(self.column) or codes.hot.get(self.column) or [])
        return IndicatorVectorModel(self.column, codes, width)


class IndicatorVectorModel(Model):
    def __init__(self, column: str, codes: CategoricalModel, width: int):
        super().__init__()
        self.column, self.codes, self.width = column, codes, width

    @property
    def output(self) -> str:
        return f"{self.column}_vector"

    def _transform(self, df: DataFrame) -> DataFrame:
        place = f"{self.column}__code"
        coded = self.codes.transform(df).withColumn(place, F.when(F.col(place) < 0, self.width).otherwise(F.col(place)).cast("double"))
        # The number after the last value stands for the others; its place in the vector is dropped.
        sizes = small_table(df.sparkSession, [(float(max(self.width, 1) - 1),)], f"{place} double")
        hot = OneHotEncoder(inputCol=place, outputCol=self.output, handleInvalid="keep", dropLast=True).fit(sizes)
        return hot.transform(coded).drop(place)


def label_encode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return CategoricalEncoder(columns, one_hot_limit=0).fit(df).transform(df)


def encode_categorical(df: DataFrame, columns: Sequence[str], on_error: str = "raise") -> DataFrame:
    return CategoricalEncoder(columns, on_error=on_error).fit(df).transform(df)


class OrdinalEncoder(CategoricalEncoder):
    """Sorted codes under ``{column}_ordinal``; a value unseen at fit time gives -1."""

    def __init__(self, columns: Sequence[str]):
        super().__init__(columns, one_hot_limit=0, label_suffix="_ordinal")


def frequency_codes(df: DataFrame, column: str) -> DataFrame:
    """``value, code``: non-null values numbered from 0, the most frequent first, ties in order."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg((-F.count(F.lit(1))).alias("n"))
    codes = dense_codes(counts.select(F.struct("n", "value").alias("place")), "place")
    return codes.select(F.col("value.value").alias("value"), "code")


def encode_categorical_ml(df: DataFrame, columns: Sequence[str], limit: int = DICTIONARY_LIMIT) -> tuple[DataFrame, list[str]]:
    """Frequency-ordered indices ``{column}_index``, as vectors ``{column}_ohe`` for few values.

    Returns the table and the names of the features to use. One aggregate sizes all columns;
    one indexer is fitted for those with at most ``limit`` values, the others are numbered by a
    distributed sort and joined. A null gets the number after the last.
    """
    columns = list(columns)
    sizes = df.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in columns]).first()
    near = [c for c in columns if sizes[c] <= 4 * ONE_HOT_LIMIT]
    exact = df.agg(*[F.count_distinct(c).alias(c) for c in near]).first().asDict() if near else {}
    held = [c for c in columns if sizes[c] <= limit]
    few = [c for c in near if exact[c] <= ONE_HOT_LIMIT and c in held]
    stages: list = [StringIndexer(inputCols=held, outputCols=[f"{c}_index" for c in held], handleInvalid="keep")] if held else []
    if few:
        stages.append(OneHotEncoder(inputCols=[f"{c}_index" for c in few], outputCols=[f"{c}_ohe" for c in few]))
    out = Pipeline(stages=stages).fit(df).transform(df) if stages else df
    for c in columns:
        if c not in held:
            codes = frequency_codes(df, c).select(F.col("value").alias("__value"), F.col("code").cast("double").alias("__code"))
            last = codes.count()
            out = out.join(codes, F.col(c) == F.col("__value"), "left").withColumn(f"{c}_index", F.coalesce("__code", F.lit(float(last)))).drop("__value", "__code")
    return out, [f"{c}_ohe" if c in few else f"{c}_index" for c in columns]


def label_index(df: DataFrame, column: str, output: str, limit: int = DICTIONARY_LIMIT) -> tuple[DataFrame, list[str]]:
    """Consecutive class numbers in alphabetical order, and the class names.

    The names are a list for the caller, so more than ``limit`` classes raise; number such a
    column with ``label_encode``.
    """
    size = df.agg(F.approx_count_distinct(column, 0.02)).first()[0]
    if size > limit:
        raise ValueError(f"{column!r} has about {size} classes; at most {limit} can be named")
    model = StringIndexer(inputCol=column, outputCol=output, stringOrderType="alphabetAsc").fit(df)
    return model.transform(df), list(model.labels)


def label_inverse(df: DataFrame, column: str, output: str, labels: Sequence[str]) -> DataFrame:
    return IndexToString(inputCol=column, outputCol=output, labels=list(labels)).transform(df)


# --- dates ---------------------------------------------------------------------------


class DatetimeEncoder(Estimator):
    """Year, month, day, weekday and cyclic weekday of each date column.

    A calendar date never has year, month and day 0, so nothing is left to drop here;
    ``drop_zero_datetime`` does that for parts that come from elsewhere.
    """

    def __init__(self, columns: Sequence[str], on_error: str = "raise"):
        super().__init__()
        self.columns, self.on_error = list(columns), on_error

    def _fit(self, df: DataFrame) -> DatetimeModel:
        known = [c for c in self.columns if c in df.columns]
        if len(known) < len(self.columns):
            if self.on_error != "skip":
                raise ValueError(f"the table lacks one of {self.columns}")
            logger.warning("date columns not found: %s", set(self.columns) - set(known))
        return DatetimeModel(known)


class DatetimeModel(Model):
    def __init__(self, columns: Sequence[str]):
        super().__init__()
        self.columns = list(columns)

    @property
    def features(self) -> list[str]:
        return [f"{c}_{p}" for c in self.columns for p in dates.PARTS]

    def _transform(self, df: DataFrame) -> DataFrame:
        new = {}
        for c in self.columns:
            for part, value in dates.parts(dates.to_timestamp(df, c)).items():
                new[f"{c}_{part}"] = value
        return df.withColumns(new) if new else df


def drop_zero_datetime(df: DataFrame, column: str) -> DataFrame:
    """Drop the six date features of ``column`` if year, month and day are 0 in every row."""
    zero = F.lit(True)
    for part in ("year", "month", "day"):
        zero = zero & F.coalesce(F.col(f"{column}_{part}") == 0, F.lit(False))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.bool_and(zero).alias("zero")).first()
    if row["n"] and row["zero"]:
        return df.drop(*[f"{column}_{p}" for p in dates.PARTS])
    return df


def convert_datetime(df: DataFrame, columns: Sequence[str], on_error: str = "raise") -> DataFrame:
    return DatetimeEncoder(columns, on_error=on_error).fit(df).transform(df)


# --- numbers -------------------------------------------------------------------------


class StandardScaler(Estimator):
    """Mean 0 and population deviation 1, under ``{column}_scaled``; a constant keeps scale 1."""

    def __init__(self, columns: Sequence[str]):
        super().__init__()
        self.columns = list(columns)

    def _fit(self, df: DataFrame) -> ScalerModel:
        aggs = []
        for i, c in enumerate(self.columns):
            aggs += [F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}")]
        row = df.agg(*aggs).first()
        return ScalerModel({c: (row[f"m{i}"], row[f"s{i}"] or 1.0) for i, c in enumerate(self.columns)})


class ScalerModel(Model):
    def __init__(self, scales: dict[str, tuple[float, float]]):
        super().__init__()
        self.scales = scales

    @property
    def features(self) -> list[str]:
        return [f"{c}_scaled" for c in self.scales]

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"{c}_scaled": (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in self.scales.items()})


def assemble_features(df: DataFrame, columns: Sequence[str], output: str = "features") -> DataFrame:
    """Chosen columns as one vector; all others stay outside it. Nulls become NaN."""
    flags = {f.name: F.col(f.name).cast("double") for f in df.schema if f.name in columns and f.dataType.simpleString() in ("boolean",)}
    table = df.withColumns(flags) if flags else df
    return VectorAssembler(inputCols=list(columns), outputCol=output, handleInvalid="keep").transform(table)

"""CSV, JSON lines, JSON maps, Python literals, gzip and Parquet."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.nulls import nan_to_null
from tablewright.session import scratch_path

# Cell texts that mean "missing" in a CSV file.
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
WHOLE = r"^\s*[+-]?\d{1,18}\s*$"
NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI]nf(inity)?)\s*$"
TRUTH = ["True", "TRUE", "true", "False", "FALSE", "false"]


def load_table(spark: SparkSession, path: str, sep: str = ",", schema: T.StructType | str | None = None) -> DataFrame:
    """Read a file or folder by its suffix: .csv, .json, .jsonl or .parquet, plain or .gz."""
    plain = path.removesuffix(".gz")
    if plain.endswith(".csv"):
        return read_csv(spark, path, sep=sep, schema=schema)
    if plain.endswith((".json", ".jsonl")):
        return read_jsonl(spark, path, schema)
    if plain.endswith(".parquet"):
        return read_parquet(spark, path)
    raise ValueError(f"cannot tell the format of {path!r} from its suffix")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


def _text_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _csv(spark: SparkSession, sep: str, header: bool, multiline: bool):
    return spark.read.options(sep=sep, header=header, multiLine=multiline, quote='"', escape='"')


def missing_to_null(df: DataFrame) -> DataFrame:
    """Text cells that mean "missing" become null."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~F.col(c).isin(MISSING), F.col(c)) for c in texts}) if texts else df


def infer_text_types(df: DataFrame) -> DataFrame:
    """Whole numbers, numbers and truth values held as text get their type; one pass over the table."""
    if not df.columns:
        return df
    aggs = []
    for i, c in enumerate(df.columns):
        aggs += [
            F.count(c).alias(f"n{i}"),
            F.bool_and(F.col(c).rlike(WHOLE)).alias(f"w{i}"),
            F.bool_and(F.col(c).rlike(NUMBER)).alias(f"f{i}"),
            F.bool_and(F.col(c).isin(TRUTH)).alias(f"b{i}"),
        ]
    row = df.agg(*aggs).first()
    casts = {}
    for i, c in enumerate(df.columns):
        if not row[f"n{i}"]:
            continue
        if row[f"w{i}"]:
            casts[c] = F.trim(c).cast("bigint")
        elif row[f"f{i}"]:
            casts[c] = F.trim(c).cast("double")
        elif row[f"b{i}"]:
            casts[c] = F.col(c).cast("boolean")
    return df.withColumns(casts) if casts else df


def read_csv(
    spark: SparkSession, path: str, sep: str = ",", schema: T.StructType | str | None = None, multiline: bool = False
) -> DataFrame:
    """CSV with a header line. Without a schema the types are inferred from all cells.

    ``multiline`` allows line breaks inside quotes, at the price of one task per file.
    """
    reader = _csv(spark, sep, True, multiline)
    if schema is not None:
        return nan_to_null(missing_to_null(reader.schema(schema).csv(path)))
    return infer_text_types(missing_to_null(reader.option("inferSchema", False).csv(path)))


def read_csv_named(spark: SparkSession, path: str, schema: T.StructType | str | Sequence[str], sep: str = ",", multiline: bool = False) -> DataFrame:
    """CSV without a header: columns by schema, or by names with inferred types."""
    reader = _csv(spark, sep, False, multiline)
    if isinstance(schema, (str, T.StructType)):
        return nan_to_null(missing_to_null(reader.schema(schema).csv(path)))
    return infer_text_types(missing_to_null(reader.schema(_text_schema(schema)).csv(path)))


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str | Sequence[str], sep: str = " ") -> DataFrame:
    """Headerless lines with another separator."""
    return read_csv_named(spark, path, schema, sep)


def _field_count(line: Column, sep: str) -> Column:
    """Fields of a CSV line; separators inside quotes do not count."""
    bare = F.regexp_replace(line, '"(?:[^"]|"")*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1


def read_csv_skip_bad(spark: SparkSession, path: str, sep: str = ",", multiline: bool = False) -> DataFrame:
    """CSV with a header that leaves out lines with too many fields; short lines end in nulls."""
    names = _csv(spark, sep, True, multiline).option("inferSchema", False).csv(path).columns
    # One column more than the header has: it is filled only on lines that are too long.
    schema = _text_schema([*names, "__extra", "__line"])
    reader = _csv(spark, sep, True, multiline).schema(schema).option("columnNameOfCorruptRecord", "__line")
    lines = reader.csv(path)
    fits = F.col("__extra").isNull() & F.col("__line").isNotNull() & (_field_count(F.col("__line"), sep) <= len(names))
    return infer_text_types(missing_to_null(lines.filter(fits).select(*names)))


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None) -> DataFrame:
    """One JSON object per line. A schema saves the pass that infers one."""
    reader = spark.read.option("mode", "FAILFAST")
    if schema is not None:
        reader = reader.schema(schema)
    return nan_to_null(reader.json(path if isinstance(path, str) else list(path)))


def _mode(on_error: str) -> dict[str, str]:
    if on_error not in ("raise", "null"):
        raise ValueError(f"on_error {on_error!r} is neither raise nor null")
    return {"mode": "FAILFAST" if on_error == "raise" else "PERMISSIVE"}


def read_json_records(spark: SparkSession, path: str | Sequence[str], record: str, key: str | None = None, on_error: str = "raise") -> DataFrame:
    """Files that each hold one object ``{key: [record, ...]}``: one row per record.

    ``record`` is the DDL of the wanted fields; a field a record lacks is null. A file is
    one JSON value and cannot be split, so each is read by one task (up to 2 GB). A malformed
    file or a value of another type raises; with ``on_error="null"`` they are null.
    """
    whole = spark.read.text(path if isinstance(path, str) else list(path), wholetext=True)
    entries = whole.select(F.explode(F.from_json("value", f"map<string, array<struct<{_fields(record)}>>>", _mode(on_error))))
    parent = [F.col("key").alias(key)] if key else []
    return nan_to_null(entries.select(*parent, F.inline("value")))


def read_json_pairs(spark: SparkSession, path: str | Sequence[str], key: str, value: str, kind: str = "string", on_error: str = "raise") -> DataFrame:
    """Files that each hold one object ``{key: value}``: one row per entry (one task per file).

    Malformed files and values of another type raise, or are null with ``on_error="null"``.
    """
    whole = spark.read.text(path if isinstance(path, str) else list(path), wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string, {kind}>", _mode(on_error))).alias(key, value))


def _fields(ddl: str) -> str:
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in T.StructType.fromDDL(ddl).fields)


def _jsonable(value):
    return value.decode("utf-8", "replace") if isinstance(value, bytes) else list(value)


# Strings without escapes, and what may stand between them where Python and JSON agree.
PLAIN_STRING = re.compile(r"""[uU]?(?:'([^'\\\x00\r\n]*)'|"([^"\\\x00\r\n]*)")""")
BETWEEN = re.compile(r"(?:[ \t\[\]{},:|]+|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|True|False|None)*")
JSON_ONLY = re.compile("true|false|null|NaN|Infinity")
CONSTANTS = (("True", "true"), ("False", "false"), ("None", "null"))


def literal_to_json(line: str) -> str:
    """The JSON of a Python literal. Most lines only need their quotes changed, or nothing;
    whatever is not plainly the same in both languages takes the syntax tree."""
    # literal_eval reads constants only: nothing in a file is ever executed.
    line = line.strip()
    try:
        if "\\" not in line and not JSON_ONLY.search(line):
            if "'" not in line:
                return json.dumps(json.loads(line))
            parts = PLAIN_STRING.split(line)  # outside, '...', "...", outside, ...
            outside = "|".join(parts[::3])
            if outside.count("|") == len(parts) // 3 and BETWEEN.fullmatch(outside):
                for python, plain in CONSTANTS:
                    outside = outside.replace(python, plain)
                strings = [json.dumps(single if single is not None else double) for single, double in zip(parts[1::3], parts[2::3])]
                return json.dumps(json.loads("".join(x for pair in zip(outside.split("|"), [*strings, ""]) for x in pair)))
    except ValueError:
        pass
    return json.dumps(ast.literal_eval(line), default=_jsonable)


@F.pandas_udf(T.StringType())
def _literal_to_json(lines: pd.Series) -> pd.Series:
    return lines.map(literal_to_json)


def read_pyliteral_lines(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None, partitions: int | None = None, on_error: str = "raise") -> DataFrame:
    """Lines that are Python dict literals (``True``, ``None``, ``u''``), plain or gzipped.

    A small Arrow function turns each line into JSON; Spark does the rest. Without a schema
    the JSON is written once to the scratch folder and read back with inferred types.
    ``partitions`` spreads the lines of an unsplittable (gzip) file before the work starts.
    A value that does not fit the schema raises; with ``on_error="null"`` it is null.
    """
    lines = spark.read.text(path if isinstance(path, str) else list(path))
    if partitions:
        lines = lines.repartition(partitions)
    texts = lines.filter(F.trim("value") != "").select(_literal_to_json("value").alias("value"))
    if schema is not None:
        ddl = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        return nan_to_null(texts.select(F.from_json("value", ddl, _mode(on_error)).alias("r")).select("r.*"))
    folder = scratch_path(spark, "literals")
    texts.write.text(folder)
    return nan_to_null(spark.read.option("mode", "FAILFAST").json(folder))


def read_gzip(spark: SparkSession, path: str, schema: T.StructType | str | None = None, partitions: int | None = None) -> DataFrame:
    """Gzipped JSON lines. One task decompresses a file; ``partitions`` spreads what follows."""
    df = read_jsonl(spark, path, schema)
    return df.repartition(partitions) if partitions else df

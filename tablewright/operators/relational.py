"""Merges, unions, reshaping, lists per key and neighbour sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


NULL_SALTS = 32  # parts that the rows with a null key are dealt over


def merge(
    left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y")
) -> DataFrame:
    """Equi-join where a null key matches a null key.

    Other columns that both sides have get the suffixes. No side is forced to be
    broadcast: Spark chooses by measured size, and splits skewed keys at run time. Nulls that meet
    give rows x rows from few bytes, which no measured size shows: rows of the left side with a
    null key are dealt over ``NULL_SALTS`` parts, and each part meets all such rows of the right.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if how not in ("inner", "left"):
        raise ValueError(f"how {how!r} is neither inner nor left")
    shared = {c for c in left.columns if c in right.columns and c not in keys}
    a = left.select(*[F.col(c).alias(c + suffixes[0] if c in shared else c) for c in left.columns])
    marked = [F.col(k).alias(f"__{k}") for k in keys]
    b = right.select(*marked, *[F.col(c).alias(c + suffixes[1] if c in shared else c) for c in right.columns if c not in keys])
    condition = None
    for k in keys:
        same = a[k].eqNullSafe(b[f"__{k}"])
        condition = same if condition is None else condition & same
    if all(left.schema[k].nullable and right.schema[k].nullable for k in keys):
        lacking = F.array_contains(F.array(*[a[k].isNull() for k in keys]), True)
        lacked = F.array_contains(F.array(*[F.col(f"__{k}").isNull() for k in keys]), True)
        hashed = [F.col(f.name) for f in a.schema if not contains_map(f.dataType)]
        part = F.pmod(F.xxhash64(*hashed), F.lit(NULL_SALTS)).cast("int") if hashed else F.lit(0)
        a = a.withColumn("__salt_x", F.when(lacking, part).otherwise(0))
        b = b.withColumn("__salt_y", F.explode(F.when(lacked, F.sequence(F.lit(0), F.lit(NULL_SALTS - 1))).otherwise(F.array(F.lit(0)))))
        condition = None
        for k in keys:
            same = a[k].eqNullSafe(b[f"__{k}"])
            condition = same if condition is None else condition & same
        condition = condition & (a["__salt_x"] == b["__salt_y"])
    return a.join(b, condition, how).drop(*[f"__{k}" for k in keys], "__salt_x", "__salt_y")


def join_role_pair(
    facts: DataFrame, dimension: DataFrame, dimension_key: str, first: str, second: str
) -> DataFrame:
    """Join one dimension twice, once per role column; its columns get the role as suffix."""
    out = facts
    for role in (first, second):
        out = merge(out, suffix_columns(dimension, role, dimension_key), role)
    return out


def suffix_columns(df: DataFrame, suffix: str, key: str | None = None) -> DataFrame:
    """Every column becomes ``{name}_{suffix}``; the key column becomes ``suffix`` itself."""
    return df.select(*[F.col(c).alias(suffix if c == key else f"{c}_{suffix}") for c in df.columns])


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def select_reorder(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def drop_prefixed(df: DataFrame, target: str) -> DataFrame:
    """Drop the columns derived from the target (``{target}_...``): they leak the label."""
    return df.drop(*[c for c in df.columns if c.startswith(f"{target}_")])


def pop_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Rows without nulls, as (features, target)."""
    whole = df.na.drop("any")
    return whole.drop(target), whole.select(target)


def filter_null_split(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows where the column has a value, and rows where it has none."""
    return df.filter(F.col(column).isNotNull()), df.filter(F.col(column).isNull())


def union_by_name(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Concatenate; a column one side lacks is null there."""
    out = first
    for other in others:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def explode_records(
    df: DataFrame, records: str, fields: Mapping[str, str | Column], keep: Sequence[str] = (), defaults: Mapping[str, Column] | None = None
) -> DataFrame:
    """One row per element of a list of structs, with chosen fields and parent columns.

    ``fields`` maps output names to fields of the element. A parent with an empty list
    gives no row. A field with a default takes it where the value is missing.
    """
    defaults = defaults or {}
    rows = df.select(*keep, F.explode(records).alias("__r"))
    out = []
    for name, source in fields.items():
        value = F.col(f"__r.{source}") if isinstance(source, str) else source
        out.append((F.coalesce(value, defaults[name]) if name in defaults else value).alias(name))
    return rows.select(*keep, *out)


def flatten_struct(df: DataFrame, struct: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, f"{struct}.*")


def concat_features(first: DataFrame, *others: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Columns of several tables side by side, aligned on the row key."""
    keys = [key] if isinstance(key, str) else list(key)
    out = first
    for other in others:
        out = out.join(other, keys, "inner")
    return out


def sort_by_ordinal(df: DataFrame, ordinal: str, *key: str) -> DataFrame:
    return df.orderBy(ordinal, *key)


def sort_by_column(df: DataFrame, column: str, *key: str) -> DataFrame:
    return df.orderBy(F.col(column).asc_nulls_last(), *key)


# What one array of the engine can hold.
LONGEST_LIST = (1 << 31) - 16
LIST_BUCKETS = 64
TASK_EDGES = 1 << 20  # edges of one task


def collect_lists(df: DataFrame, key: str, value: str) -> DataFrame:
    """All values per key as one sorted list; rows with a null key are left out.

    Equal values are counted before the shuffle. Lists are built in two stages, per key and
    bucket of values and then per key, so a large key is gathered by many tasks; its one
    list is the result, and as long as the caller's data make it. A list longer than the
    engine's arrays raises.
    """
    counted = df.filter(F.col(key).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("__n"))
    bucket = F.pmod(F.xxhash64(value), F.lit(LIST_BUCKETS))
    size = F.when(F.col("__n") <= LONGEST_LIST, F.col("__n").cast("int")).otherwise(F.raise_error(F.lit("a list is longer than an array can be")).cast("int"))
    repeated = F.array_repeat(F.struct(F.col(value).alias("v")), size)
    parts = counted.groupBy(key, bucket.alias("__bucket")).agg(F.flatten(F.collect_list(repeated)).alias("__v"))
    return parts.groupBy(key).agg(F.flatten(F.collect_list("__v")).alias("__v")).select(key, F.sort_array(F.transform("__v", lambda s: s["v"])).alias(value))


def undirected_edges(edges: DataFrame, a: str, b: str, node: str = "user", neighbour: str = "connection") -> DataFrame:
    """Each edge in both directions, repeated ones once: the neighbours of a node as rows."""
    both = F.array(F.struct(F.col(a).alias(node), F.col(b).alias(neighbour)), F.struct(F.col(b).alias(node), F.col(a).alias(neighbour)))
    return edges.select(F.inline(both)).distinct()


def undirected_adjacency(edges: DataFrame, a: str, b: str, node: str = "user", neighbours: str = "connections") -> DataFrame:
    """Neighbour set of each node of an undirected edge list, one row per node.

    For nodes with more neighbours than a list should hold, use ``undirected_edges``. Edges are dealt
    by node and bucket of neighbours, at most ``TASK_EDGES`` to a task on average, so that a
    task's memory does not grow with the table; equal edges meet there.
    """
    both = F.array(F.struct(F.col(a).alias(node), F.col(b).alias(neighbours)), F.struct(F.col(b).alias(node), F.col(a).alias(neighbours)))
    parts = max(edges.sparkSession.sparkContext.defaultParallelism, -(-2 * edges.count() // TASK_EDGES))
    dealt = edges.select(F.inline(both)).filter(F.col(node).isNotNull()).withColumn("__bucket", F.pmod(F.xxhash64(neighbours), F.lit(LIST_BUCKETS)))
    once = dealt.repartition(parts, node, "__bucket").groupBy(node, "__bucket", neighbours).agg(F.count(F.lit(1)).alias("__n"))
    lists = once.groupBy(node, "__bucket").agg(F.collect_list(F.struct(F.col(neighbours).alias("v"))).alias("__v"))
    return lists.groupBy(node).agg(F.flatten(F.collect_list("__v")).alias("__v")).select(node, F.sort_array(F.transform("__v", lambda s: s["v"])).alias(neighbours))


def groupable(col: Column, kind: T.DataType) -> Column:
    """An expression equal for equal values that Spark can group by: maps become sorted entries."""
    if isinstance(kind, T.MapType):
        entries = F.transform(
            F.map_entries(col),
            lambda e: F.struct(groupable(e["key"], kind.keyType).alias("key"), groupable(e["value"], kind.valueType).alias("value")),
        )
        return F.array_sort(entries)
    if isinstance(kind, T.ArrayType) and contains_map(kind.elementType):
        return F.transform(col, lambda x: groupable(x, kind.elementType))
    if isinstance(kind, T.StructType) and contains_map(kind):
        return F.when(
            col.isNotNull(),
            F.struct(*[groupable(col[f.name], f.dataType).alias(f.name) for f in kind.fields]),
        )
    return col


def contains_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.MapType):
        return True
    if isinstance(kind, T.ArrayType):
        return contains_map(kind.elementType)
    return isinstance(kind, T.StructType) and any(contains_map(f.dataType) for f in kind.fields)

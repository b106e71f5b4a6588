"""Consecutive codes for a dictionary too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.session import checkpoint


def dense_codes(df: DataFrame, column: str) -> DataFrame:
    """``value, code``: the distinct non-null values numbered from 0 in sorted order.

    The values are range-partitioned and sorted, written once, and numbered by the row
    count of the preceding partitions; only those counts reach the driver.
    """
    values = df.select(F.col(column).alias("value")).filter(F.col("value").isNotNull()).distinct()
    # The checkpoint pins the ranges: they are drawn by sampling and must not change between jobs.
    ordered = checkpoint(values.orderBy("value").withColumn("id", F.monotonically_increasing_id()))
    # The id holds the partition in its upper bits and the place inside it in the lower 33.
    place = F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    part = F.shiftright("id", 33)
    counts = ordered.groupBy(part.alias("part")).count().orderBy("part").collect()
    offsets, total = [], 0
    for row in counts:
        offsets += [F.lit(row["part"]), F.lit(total)]
        total += row["count"]
    if not offsets:
        return ordered.select("value", F.lit(0).cast("bigint").alias("code"))
    return ordered.select("value", (place + F.create_map(*offsets)[part]).cast("bigint").alias("code"))

"""Mixing sources to target weights by Poisson replication. DataFrame expressions only.

A source of size s that should make up the share w of a mixture as large as the input gets the
rate w * total / s: the mean number of times each of its rows is repeated. A row's number of
copies is the Poisson quantile at a number in [0, 1) hashed from its key, so it does not change
with partitioning, retries or other rows, and a hot source needs no shuffle by source. Copies
are dealt to partitions and ordered within them by another hash: a global shuffle.

A null source is a source of its own. Null and empty texts have size 0; a source of such texts
only has rate 1. A source without a weight has rate 0. Rows with equal keys get equal counts,
and null keys hash alike. Input columns named like the added ones get the suffix ``_input``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.hashing import hash52, u
from tablewright.llm.common import maybe_broadcast, set_aside

#: Weights follow size ** TEMPERATURE where none are given.
TEMPERATURE = 0.7
#: Rates are cut to this many parts of one, so that every engine computes the same ones.
GRAIN = 1_000_000
#: Most sources that are sent to all executors (a name, a number and a short array each).
SOURCES = 20_000


def poisson_table(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... up to where the rest is below the grain of the hash."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    start = F.struct((-rate).alias("log"), F.array(F.exp(-rate)).alias("sums"))
    step = lambda acc, k: F.struct(
        (acc["log"] + F.log(rate) - F.log(k.cast("double"))).alias("log"),
        F.concat(acc["sums"], F.array(F.element_at(acc["sums"], -1) + F.exp(acc["log"] + F.log(rate) - F.log(k.cast("double"))))).alias("sums"),
    )
    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["sums"])


def source_rates(df: DataFrame, source: str, text: str, weights: DataFrame | None = None) -> DataFrame:
    """One row per source: ``__source``, ``rate`` and the Poisson table of that rate.

    ``weights`` has columns source and weight (they need not add up to 1).
    """
    sizes = df.groupBy(F.col(source).alias("__source")).agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("__size"))
    if weights is None:
        sizes = sizes.withColumn("__weight", F.when(F.col("__size") > 0, F.pow(F.col("__size").cast("double"), F.lit(TEMPERATURE))).otherwise(0.0))
    else:
        given = weights.select(F.col("source").alias("__name"), F.col("weight").cast("double").alias("__weight"))
        sizes = sizes.join(given, F.col("__source").eqNullSafe(F.col("__name")), "left").fillna(0.0, ["__weight"])
    totals = sizes.agg(F.sum("__size"), F.sum(F.when(F.col("__size") > 0, F.col("__weight")))).first()
    size, weight = float(totals[0] or 0), float(totals[1] or 0) or 1.0
    rate = F.when(F.col("__size") > 0, F.floor(F.col("__weight") / weight * size / F.col("__size") * GRAIN) / GRAIN).otherwise(1.0)
    rated = sizes.select("__source", rate.alias("rate"))
    return rated.withColumn("__table", F.when(F.col("rate") > 0, poisson_table(F.col("rate"))).otherwise(F.array(F.lit(1.0))))


def mix_sources(df: DataFrame, key: str, source: str, text: str, weights: DataFrame | None = None, seed: int = 1) -> DataFrame:
    """Each row repeated by its Poisson count, with its ``rate`` and the number of the ``copy``, shuffled."""
    df = set_aside(df, "rate", "copy")
    columns = df.columns
    rates = maybe_broadcast(source_rates(df, source, text, weights), SOURCES)
    rated = df.join(rates, F.col(source).eqNullSafe(F.col("__source")), "inner")
    place = u([key], "mix", seed)
    counted = rated.withColumn("__u", place).withColumn("__copies", F.size(F.filter("__table", lambda c: c <= F.col("__u"))))
    copies = counted.filter("__copies > 0").select(*columns, "rate", F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("copy"))
    order = hash52([key, "copy"], "order", seed)
    return copies.withColumn("__order", order).repartition("__order").sortWithinPartitions("__order").drop("__order")


#: The same in SQL for the weights that follow size.
SQL = f"""
WITH sizes AS (SELECT source, coalesce(sum(length(text)), 0)::BIGINT AS size FROM {{documents}} GROUP BY source),
weighed AS (SELECT *, CASE WHEN size > 0 THEN pow(size::DOUBLE, {TEMPERATURE}) ELSE 0.0 END AS weight FROM sizes),
rated AS (
  SELECT source, CASE WHEN size > 0 THEN floor(weight / sum(weight) OVER () * (sum(size) OVER ())::DOUBLE / size * {GRAIN}) / {GRAIN} ELSE 1.0 END AS rate
  FROM weighed),
mass AS (
  SELECT source, rate, k, CASE WHEN rate > 0 THEN exp(-rate + k * ln(rate) - lgamma(k + 1)) ELSE CASE WHEN k = 0 THEN 1.0 ELSE 0.0 END END AS p
  FROM (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 21)::BIGINT)) AS k FROM rated)),
sums AS (SELECT source, rate, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM mass),
tables AS (SELECT source, rate, list(cdf ORDER BY k) AS cdfs FROM sums GROUP BY source, rate),
placed AS (SELECT *, ('0x'||substr(md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), 'mix', '1')),1,13))::BIGINT / 4503599627370496.0 AS u FROM {{documents}}),
counted AS (
  SELECT d.* EXCLUDE (u), t.rate, len(list_filter(t.cdfs, lambda c: c <= d.u)) AS n
  FROM placed d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source)
SELECT * EXCLUDE (n), unnest(range(1, n + 1))::INTEGER AS copy FROM counted WHERE n > 0"""

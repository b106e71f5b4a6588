"""Lines that spread over many sites are boilerplate. DataFrame expressions only.

Every line (less its outer blanks) is known by two 64-bit hashes. A HyperLogLog sketch of the
sites is built per line; sketches merge on the way to the reducers, so a line that a third of
all rows hold is one small row per task. Lines whose estimate is clearly above the threshold are
boilerplate, those clearly below are not, and the few near it get an exact count of sites.

Boilerplate lines leave every text that holds them. Empty lines stay, so do all others, in order.
Null texts stay null and empty ones empty; a null site is a site of its own. Repeated rows do
not add sites. The work is linear in the lines of a text, however long. Input columns named like the added ones get the suffix ``_input``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import maybe_broadcast, set_aside, stored

#: Sites from which on a line is boilerplate, and the logarithm of a sketch's size.
SITES, SKETCH = 10, 12
#: Half of the band around the threshold that is counted exactly: five standard errors and one.
BAND = 5 * 1.04 / 2 ** (SKETCH / 2)
#: Most boilerplate lines that are sent to all executors (16 bytes each).
LINES = 200_000


def _line(x: Column) -> Column:
    return F.btrim(x, F.lit(" \t\r"))


def _hashes(x: Column) -> Column:
    return F.struct(F.xxhash64(_line(x)).alias("a"), F.xxhash64(F.lit(1), _line(x)).alias("b"))


def _lines(text: str) -> Column:
    return F.split(text, "\n", -1)


def _held(df: DataFrame, text: str, *columns: Column) -> DataFrame:
    """One row per line that is not empty: its place, its hashes (a, b), and ``columns``.

    Repeated lines of a text stay apart here; the groupings that follow bring them together.
    """
    # The columns are computed once a text, below the explosion, not once a line.
    texts = df.select(*columns, F.transform(_lines(text), _line).alias("__all"))
    names = [c for c in texts.columns if c != "__all"]
    every = texts.select(*names, F.posexplode("__all").alias("place", "line")).filter(F.col("line") != "")
    return every.withColumns({"a": F.xxhash64("line"), "b": F.xxhash64(F.lit(1), "line")}).drop("line")


def boilerplate(df: DataFrame, text: str, site: str, sites: int = SITES) -> DataFrame:
    """Hashes (a, b) of the lines on at least ``sites`` distinct sites."""
    name = F.coalesce(F.concat(F.lit("="), F.col(site).cast("string")), F.lit("null"))
    held = _held(df, text, name.alias("site"))
    sketched = held.groupBy("a", "b").agg(F.hll_sketch_agg("site", F.lit(SKETCH)).alias("sketch"))
    spread = sketched.select("a", "b", F.hll_sketch_estimate("sketch").alias("n"))
    low, high = sites * (1 - BAND) - 1, sites * (1 + BAND) + 1
    # Stored, so that the pass over all lines is not made again for each use.
    spread = stored(spread.filter(F.col("n") >= low))
    near = maybe_broadcast(spread.filter(F.col("n") <= high).select("a", "b"), LINES)
    exact = held.join(near, ["a", "b"], "left_semi").groupBy("a", "b", "site").count().groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= sites)
    return spread.filter(F.col("n") > high).select("a", "b").unionByName(exact.select("a", "b"))


def remove_boilerplate(df: DataFrame, key: str, text: str, site: str, sites: int = SITES) -> DataFrame:
    """All rows and columns, ``text`` without boilerplate lines; ``n_lines`` and ``n_removed`` added."""
    df = set_aside(df, "n_lines", "n_removed")
    columns = df.columns
    lines = maybe_broadcast(stored(boilerplate(df, text, site, sites)), LINES)
    # A row is known by its key and its text: rows that share both have the same lines in the same places.
    own = [F.col(key).cast("string").alias("__key"), F.xxhash64(text).alias("__text"), F.xxhash64(F.lit(1), text).alias("__other")]
    per_row = _held(df, text, *own).join(lines, ["a", "b"], "left_semi").groupBy("__key", "__text", "__other").agg(F.collect_list("place").alias("__drop"))
    joined = df.select("*", *own)
    same = joined["__key"].eqNullSafe(per_row["__key"]) & (joined["__text"] == per_row["__text"]) & (joined["__other"] == per_row["__other"])
    joined = joined.join(per_row, same, "left").select(*[joined[c] for c in columns], "__drop").withColumn("__lines", _lines(text))
    # Places that stay, by a set difference: linear in the lines of the text, however many go.
    count = F.coalesce(F.size("__lines"), F.lit(0))
    places = F.when(count > 0, F.sequence(F.lit(0), count - 1))
    stay = F.when(F.col("__drop").isNull(), places).otherwise(F.array_except(places, "__drop"))
    cleaned = joined.withColumn("__stay", stay).withColumn("__kept", F.transform("__stay", lambda i: F.get("__lines", i)))
    kept = F.when(F.col("__drop").isNull(), F.col(text)).otherwise(F.array_join("__kept", "\n"))
    n_lines = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size("__lines")).cast("long")
    n_removed = n_lines - F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size("__stay")).cast("long")
    return cleaned.select(*[kept.alias(c) if c == text else c for c in columns], n_lines.alias("n_lines"), n_removed.alias("n_removed"))


#: The same in SQL, exactly counted.
SQL = f"""
WITH parts AS (
  SELECT doc_id, coalesce('=' || source, 'null') AS site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM {{documents}}),
lines AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS short FROM parts),
spread AS (SELECT short FROM lines WHERE short <> '' GROUP BY short HAVING count(DISTINCT site) >= {SITES}),
marked AS (SELECT l.doc_id, l.line, l.i, s.short IS NOT NULL AS gone FROM lines l LEFT JOIN spread s ON l.short = s.short),
kept AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text FROM marked GROUP BY doc_id)"""

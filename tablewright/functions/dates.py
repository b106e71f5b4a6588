"""Date parsing and calendar parts. Values are naive wall-clock times (UTC session)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The text layouts tried when a column is read as a date, each with the shape
# a text must have to be tried at all. Most cells of a text column fail the shape, which
# costs far less than a failed parse.
ISO_SHAPE = r"^\s*[+-]?\d{4,6}(-\d{1,2}(-\d{1,2}([ T].*)?)?)?\s*$"
DATE_LAYOUTS = {
    "M d, yyyy": r"^\d{1,2} \d{1,2}, \d{4}$",
    "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "yyyy/M/d": r"^\d{4}/\d{1,2}/\d{1,2}$",
    "d MMM yyyy": r"^\d{1,2} \p{L}{3} \d{4}$",
    "MMM d, yyyy": r"^\p{L}{3} \d{1,2}, \d{4}$",
    "MMMM d, yyyy": r"^\p{L}{4,} \d{1,2}, \d{4}$",
}
STRICT_LAYOUT = "M d, yyyy"
SHORTEST_DATE, LONGEST_DATE = 4, 128  # bytes, time zone names included
UNIX_RANGE = (1e9, 2e9)

PARTS = ["year", "month", "day", "weekday", "weekday_sin", "weekday_cos"]


def _parse(col: Column, layout: str) -> Column:
    parsed = F.try_to_timestamp(col, F.lit(layout))
    return F.when(col.rlike(DATE_LAYOUTS[layout]), parsed) if layout in DATE_LAYOUTS else parsed


def parse_text(col: Column, layouts: list[str] | None = None) -> Column:
    """Text to timestamp; whatever no layout reads becomes null."""
    if layouts is not None:
        return F.coalesce(*[_parse(col, layout) for layout in layouts])
    iso = F.when(col.rlike(ISO_SHAPE), col.try_cast("timestamp"))
    parsed = F.coalesce(iso, *[_parse(col, layout) for layout in DATE_LAYOUTS])
    # The length in bytes is stored with the text: most texts never reach a pattern.
    return F.when(F.octet_length(col).between(SHORTEST_DATE, LONGEST_DATE), parsed)


def from_unix(col: Column) -> Column:
    """Whole or fractional seconds since the epoch to timestamp."""
    return F.timestamp_seconds(col)


def to_timestamp(df: DataFrame, name: str, layouts: list[str] | None = None) -> Column:
    """Whatever ``name`` holds (date, text or Unix seconds) as a timestamp."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.NumericType):
        return from_unix(F.col(name))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.col(name).cast("timestamp")
    return parse_text(F.col(name), layouts)


def to_unix(df: DataFrame, name: str, layouts: list[str] | None = None) -> Column:
    """Whatever ``name`` holds as whole Unix seconds."""
    if isinstance(df.schema[name].dataType, T.NumericType):
        return F.col(name).cast("bigint")
    return F.unix_timestamp(to_timestamp(df, name, layouts))


def weekday_cyclic(weekday: Column) -> tuple[Column, Column]:
    """Sine and cosine of the place in the week."""
    angle = F.lit(2.0) * F.pi() * weekday / F.lit(7)
    return F.sin(angle), F.cos(angle)


def parts(moment: Column) -> dict[str, Column]:
    """Year, month, day, weekday (Monday is 0) and the cyclic weekday."""
    weekday = F.weekday(moment)
    sine, cosine = weekday_cyclic(weekday)
    values = [F.year(moment), F.month(moment), F.dayofmonth(moment), weekday, sine, cosine]
    return dict(zip(PARTS, values))

"""Calendar and time expressions: parsing, calendar parts, day/night,
season and season-year attribution, season → month predicates."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values (must equal the reference's semantics) -------------------
# Meteorological seasons by calendar month.
SEASON_MONTHS = {
    "winter": (12, 1, 2),
    "spring": (3, 4, 5),
    "summer": (6, 7, 8),
    "autumn": (9, 10, 11),
}
# Ordinal used to step through the seasons of one year; other values map to 0.
SEASON_ORDER = {"spring": 1, "summer": 2, "autumn": 3, "winter": 4}
# Months attributed to the previous season-year (January and February belong
# to the winter that started in December).
CARRY_BACK_MONTHS = (1, 2)
# Default text pattern of raw observation timestamps.
TIME_PATTERN = "yyyy-MM-dd HH:mm:ss"
# Day hours are [6, 18).
DAY_START_HOUR = 6
DAY_END_HOUR = 18
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_time(c, pattern: str = TIME_PATTERN) -> Column:
    """Text → TIMESTAMP; unparsable text becomes NULL instead of failing
    the job (ANSI ``to_timestamp`` raises)."""
    return F.try_to_timestamp(_c(c), F.lit(pattern))


def parse_time_any(c, patterns: Sequence[str]) -> tuple[Column, Column]:
    """(time, reason) of a text: the first of ``patterns`` that fits gives the time.
    Patterns with a zone give UTC instants. Where none fits the time is NULL and the
    reason says why: ``missing`` (NULL), ``empty`` (blank), ``not a time`` (it has the
    shape of a pattern, as far as digits go, but no such time exists) or ``unknown
    format``."""
    text = F.trim(_c(c))
    time = F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in patterns])
    # digits and letters of a text, against those of the patterns
    shape = F.regexp_replace(F.regexp_replace(text, "[0-9]", "9"), "Z$|[+-]99:?99$", "")
    shapes = [re.sub("[A-Za-z]", "9", re.sub("[XxZ]+$", "", p.replace("'T'", "T")).replace("T", "\0"))
              .replace("\0", "T") for p in patterns]
    reason = (F.when(time.isNotNull(), F.lit(None).cast("string")).when(text.isNull(), "missing")
              .when(text == "", "empty").when(shape.isin(*shapes), "not a time")
              .otherwise("unknown format"))
    return time, reason


def to_event_time(df: DataFrame, col: str, pattern: str = TIME_PATTERN) -> Column:
    """Return ``col`` as a TIMESTAMP (LTZ) column whatever its stored type.

    Streaming watermarks need TIMESTAMP. NTZ values are read as UTC wall
    clock whatever the session zone (a plain cast would read them in the
    session zone)."""
    dt = df.schema[col].dataType
    if isinstance(dt, T.StringType):
        return parse_time(col, pattern)
    if isinstance(dt, T.TimestampType):
        return F.col(col)
    if isinstance(dt, T.TimestampNTZType):
        return F.convert_timezone(F.lit("UTC"), F.current_timezone(),
                                  F.col(col)).cast(T.TimestampType())
    return F.col(col).cast(T.TimestampType())


def utc_wall_clock(c) -> Column:
    """TIMESTAMP instant → TIMESTAMP_NTZ wall clock in UTC (the inverse of
    :func:`to_event_time` on NTZ input), independent of the session zone."""
    return F.convert_timezone(None, F.lit("UTC"), _c(c))


def day_flag(hour, start: int = DAY_START_HOUR, end: int = DAY_END_HOUR) -> Column:
    """TRUE iff start <= hour < end; NULL hour → FALSE."""
    h = _c(hour)
    return F.when((h >= start) & (h < end), F.lit(True)).otherwise(F.lit(False))


def season_of(month) -> Column:
    """Season name of a month number. NULL month → NULL (documented
    deviation: such rows are quarantined by ``enrich``)."""
    m = _c(month)
    expr = None
    for name, months in SEASON_MONTHS.items():
        expr = (F.when(m.isin(*months), F.lit(name)) if expr is None
                else expr.when(m.isin(*months), F.lit(name)))
    return expr


def season_year(month, year) -> Column:
    """Year the season started in: January/February → year − 1."""
    return F.when(_c(month).isin(*CARRY_BACK_MONTHS), _c(year) - 1).otherwise(_c(year))


def season_order(season) -> Column:
    """spring 1, summer 2, autumn 3, winter 4, anything else 0."""
    s = _c(season)
    expr = None
    for name, k in SEASON_ORDER.items():
        expr = F.when(s == name, F.lit(k)) if expr is None else expr.when(s == name, F.lit(k))
    return expr.otherwise(F.lit(0))


def in_season(month, *seasons: str) -> Column:
    """Season membership written on the month column, so that a table
    partitioned by month is pruned at planning time (a predicate on the stored
    ``season`` column cannot prune month partitions)."""
    months = sorted({m for s in seasons for m in SEASON_MONTHS[s]})
    return _c(month).isin(*months)


def calendar_features(df: DataFrame, ts: str) -> DataFrame:
    """Add year, month, day, hour, date and the ``MM-dd`` key from ``ts``."""
    t = F.col(ts)
    return (df.withColumn("month_day", F.date_format(t, "MM-dd"))
              .withColumn("year", F.year(t))
              .withColumn("month", F.month(t))
              .withColumn("day", F.dayofmonth(t))
              .withColumn("hour", F.hour(t))
              .withColumn("date", F.to_date(t)))

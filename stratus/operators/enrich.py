"""Raw observations → enriched observations (the ingest transform)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratus.functions.calendar import (
    DAY_END_HOUR, DAY_START_HOUR, TIME_PATTERN, calendar_features, day_flag,
    parse_time, parse_time_any, season_of, season_year,
)
from stratus.functions.numeric import flag

# --- Fixed values (the reference's ingest rules) ---------------------------
# km/h → m/s, two decimals, on the three wind columns.
WIND_TO_MS = {"wind_speed_10m": (3.6, 2), "wind_speed_100m": (3.6, 2),
              "wind_gusts_10m": (3.6, 2)}
# Columns dropped at ingest.
DROPPED_COLUMNS = (
    "shortwave_radiation_instant", "direct_radiation_instant",
    "diffuse_radiation_instant", "direct_normal_irradiance_instant",
    "global_tilted_irradiance_instant", "terrestrial_radiation_instant",
)
# Snow hour: snowfall > 0. Sunny hour: direct radiation > 120 and cloud < 50.
SNOW_MIN = 0
SUNNY_RADIATION_MIN = 120
SUNNY_CLOUD_MAX = 50
# ---------------------------------------------------------------------------


def weather_flags() -> dict[str, Column]:
    """The reference's two hourly flags on the weather columns."""
    return {
        "is_snow_day": F.col("snowfall") > SNOW_MIN,
        "is_sunny_hour": (F.col("direct_radiation") > SUNNY_RADIATION_MIN)
        & (F.col("cloud_cover") < SUNNY_CLOUD_MAX),
    }


def convert_units(df: DataFrame, conversions: Mapping[str, tuple[float, int]]) -> DataFrame:
    """``col → round(col / divisor, digits)`` for each listed column present."""
    for c, (divisor, digits) in conversions.items():
        if c in df.columns:
            df = df.withColumn(c, F.round(F.col(c) / divisor, digits))
    return df


def enrich(df: DataFrame, *, time_col: str = "datetime", entity_col: str = "city_name",
           conversions: Mapping[str, tuple[float, int]] = WIND_TO_MS,
           flags: Mapping[str, Column] | None = None,
           drop: Iterable[str] = DROPPED_COLUMNS,
           day_hours: tuple[int, int] = (DAY_START_HOUR, DAY_END_HOUR),
           time_pattern: str | Sequence[str] = TIME_PATTERN,
           reason_col: str | None = None) -> DataFrame:
    """Parse time, trim the entity name, convert units, add calendar parts,
    day/night flag, season, season-year and boolean flags; drop columns.

    ``time_pattern`` may be several patterns, tried in order. With ``reason_col``,
    rows keep the reason why their time did not parse (see ``parse_time_any``).

    One narrow projection — no shuffle. Rows whose time does not parse keep a
    NULL time and NULL calendar parts; split them off with :func:`quarantine`
    before writing (they would otherwise land in a NULL partition).
    """
    flags = weather_flags() if flags is None else flags
    # text is parsed; TIMESTAMP and TIMESTAMP_NTZ columns keep their type
    out = df
    if isinstance(df.schema[time_col].dataType, T.StringType):
        patterns = [time_pattern] if isinstance(time_pattern, str) else time_pattern
        time, reason = parse_time_any(time_col, patterns)
        if isinstance(time_pattern, str):
            time = parse_time(time_col, time_pattern)
        out = df.withColumns({time_col: time} | ({reason_col: reason} if reason_col else {}))
    elif reason_col:
        out = df.withColumn(reason_col, F.when(F.col(time_col).isNull(), "missing"))
    if entity_col:
        out = out.withColumn(entity_col, F.trim(F.col(entity_col)))
    out = convert_units(out, conversions)
    out = calendar_features(out, time_col)
    out = (out.withColumn("is_day", day_flag("hour", *day_hours))
              .withColumn("season", season_of("month"))
              .withColumn("winter_season_year", season_year("month", "year")))
    for name, predicate in flags.items():
        out = out.withColumn(name, flag(predicate))
    return out.drop(*[c for c in drop if c in out.columns])


def quarantine(df: DataFrame, time_col: str = "datetime") -> tuple[DataFrame, DataFrame]:
    """Split enriched rows into (valid, rejected-by-time)."""
    bad = F.col(time_col).isNull()
    return df.filter(~bad), df.filter(bad)

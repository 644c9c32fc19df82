"""Alert rules over window aggregates. Pure projections: the same function
runs on a batch frame, a streaming frame or inside ``foreachBatch``.
Boolean results are three-valued where the inputs can be NULL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratus.functions.numeric import circular_gap, deviation, rise_pct

# --- Fixed values: reference alert thresholds -------------------------------
# Heat: humidity jump (max − min, percentage points) and humidity/temperature
# combinations, tested CRITICAL → HIGH → MEDIUM, else LOW.
HEAT_CRITICAL_JUMP = 20
HEAT_CRITICAL_HUMIDITY = 85
HEAT_CRITICAL_TEMP = 35
HEAT_HIGH_JUMP = 12
HEAT_HIGH_HUMIDITY = 75
HEAT_HIGH_TEMP = 33
HEAT_MEDIUM_JUMP = 8
HEAT_LEVELS = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
# Flood: cloud anomaly %, pressure drop inside the window (hPa), pressure
# below the historical mean (hPa, inclusive).
FLOOD_CLOUD_ANOMALY = 30.0
FLOOD_PRESSURE_DROP = 3.0
FLOOD_BELOW_HIST = 2.0
# Wind: speed rise %, gust above mean speed %, direction change (degrees).
WIND_SPEED_RISE = 50.0
WIND_GUST_ABOVE = 30.0
WIND_DIR_CHANGE = 45.0
FULL_CIRCLE = 360.0
# ---------------------------------------------------------------------------


def heat_rule(df: DataFrame, *, min_h: str = "min_humidity", max_h: str = "max_humidity",
              avg_t: str = "avg_temp", jump: str = "humidity_jump",
              out: str = "risk_level") -> DataFrame:
    """humidity_jump = round(max − min, 2); risk level by the first matching
    tier; NULL inputs fall through to LOW."""
    j = F.col(jump)
    mh, at = F.col(max_h), F.col(avg_t)
    crit, high, med, low = HEAT_LEVELS
    return (df.withColumn(jump, F.round(F.col(max_h) - F.col(min_h), 2))
              .withColumn(out,
                          F.when((j > HEAT_CRITICAL_JUMP)
                                 | ((mh > HEAT_CRITICAL_HUMIDITY) & (at > HEAT_CRITICAL_TEMP)), crit)
                           .when((j > HEAT_HIGH_JUMP)
                                 | ((mh > HEAT_HIGH_HUMIDITY) & (at > HEAT_HIGH_TEMP)), high)
                           .when(j > HEAT_MEDIUM_JUMP, med)
                           .otherwise(low)))


def _with_alerts(df: DataFrame, measures: dict, alerts: dict, out: str, every: bool) -> DataFrame:
    """``df`` with the measures, one alert column per test of a measure, and
    ``out``: all (``every``) or any of the alerts, three-valued."""
    join = (lambda a, b: a & b) if every else (lambda a, b: a | b)
    tested = df.withColumns(measures).withColumns(alerts)
    return tested.withColumn(out, reduce(join, [F.col(name) for name in alerts]))


def flood_rule(df: DataFrame, *, stream_cloud: str = "stream_avg_cloud",
               hist_cloud: str = "hist_avg_cloud", stream_pressure: str = "stream_avg_pressure",
               min_pressure: str = "stream_min_pressure", max_pressure: str = "stream_max_pressure",
               hist_pressure: str = "hist_avg_pressure") -> DataFrame:
    """Cloud anomaly (% of the historical mean; a zero mean divides by 1.0),
    pressure drop inside the window, pressure below the historical mean, and
    ``flood_risk`` = all three (three-valued AND)."""
    measures = {
        "cloud_anomaly_pct": deviation(stream_cloud, hist_cloud, 3, zero_as=1.0)[1],
        "pressure_drop_hpa": deviation(max_pressure, min_pressure, 3)[0],
        "pressure_below_hist": deviation(hist_pressure, stream_pressure, 3)[0],
    }
    alerts = {
        "high_cloud_anomaly": F.col("cloud_anomaly_pct") > FLOOD_CLOUD_ANOMALY,
        "pressure_drop_alert": F.col("pressure_drop_hpa") > FLOOD_PRESSURE_DROP,
        "pressure_below_hist_alert": F.col("pressure_below_hist") >= FLOOD_BELOW_HIST,
    }
    return _with_alerts(df, measures, alerts, "flood_risk", every=True)


def wind_rule(df: DataFrame, *, avg_speed: str = "avg_wind_speed",
              min_speed: str = "min_wind_speed", max_speed: str = "max_wind_speed",
              max_gust: str = "max_gust", min_dir: str = "min_wind_dir",
              max_dir: str = "max_wind_dir") -> DataFrame:
    """Speed rise over the window minimum and gust over the mean speed (%,
    NULL without a positive base), direction change the shorter way round, and
    ``wind_alert`` = any of the three (three-valued OR)."""
    measures = {
        "wind_speed_rise_pct": rise_pct(max_speed, min_speed),
        "gust_above_avg_pct": rise_pct(max_gust, avg_speed),
        "wind_dir_change": circular_gap(max_dir, min_dir, FULL_CIRCLE),
    }
    alerts = {
        "speed_alert": F.col("wind_speed_rise_pct") > WIND_SPEED_RISE,
        "gust_alert": F.col("gust_above_avg_pct") > WIND_GUST_ABOVE,
        "direction_alert": F.col("wind_dir_change") > WIND_DIR_CHANGE,
    }
    return _with_alerts(df, measures, alerts, "wind_alert", every=False)

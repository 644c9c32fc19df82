"""Result contracts: column order and types of every output table, and
``conform`` to enforce one before a write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, I, L, D, B, TS = (T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(),
                     T.BooleanType(), T.TimestampType())


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


CONTRACTS: dict[str, T.StructType] = {
    "diurnal_temp_variation": _schema(
        ("city_name", S), ("avg_temp_variation", D), ("max_single_day_variation", D),
        ("min_single_day_variation", D), ("rank", I)),
    "monthly_climate_trends": _schema(
        ("city_name", S), ("month", I), ("avg_temperature", D), ("avg_humidity", D),
        ("avg_daily_precipitation", D), ("avg_wind_speed", D), ("avg_cloud_cover", D)),
    "snowy_winters_ranking": _schema(
        ("city_name", S), ("winter_season_year", I), ("snow_days_count", L),
        ("rank_in_winter", I)),
    "extreme_temp_days": _schema(
        ("city_name", S), ("year", I), ("total_extreme_days", L), ("extreme_cold_days", L),
        ("extreme_heat_days", L), ("rank_in_year", I)),
    "seasonal_pressure_precipitation": _schema(
        ("city_name", S), ("year", I), ("season", S), ("avg_pressure", D),
        ("avg_daily_precipitation", D), ("avg_temperature", D),
        ("pressure_change_vs_prev_year", D), ("precipitation_change_vs_prev_year", D)),
    "wind_speed_seasonal_changes": _schema(
        ("city_name", S), ("year", I), ("season", S), ("avg_wind_speed_10m", D),
        ("avg_wind_speed_100m", D), ("avg_wind_gusts", D), ("season_order", I),
        ("wind_change_vs_prev_season", D)),
    "least_sunny_winters": _schema(
        ("city_name", S), ("winter_season_year", I), ("sunny_hours_count", L),
        ("total_hours", L), ("sunny_hours_pct", D), ("rank_in_winter", I)),
    "sunny_hours_vs_city_avg": _schema(
        ("city_name", S), ("winter_season_year", I), ("sunny_hours_count", L),
        ("total_hours", L), ("sunny_hours_pct", D), ("city_avg_sunny_hours", D),
        ("diff_from_city_avg", D), ("vs_city_avg", S)),
    "hot_day_precipitation": _schema(
        ("city_name", S), ("year", I), ("total_hot_days", L), ("hot_days_with_rain", L),
        ("total_precip_on_hot_days", D), ("rain_pct_yearly", D),
        ("total_hot_days_all_years", L), ("total_hot_rainy_days_all_years", L),
        ("total_precip_all_years", D), ("rain_pct_all_years", D)),
    "humidity_oscillation_ranking": _schema(
        ("city_name", S), ("year", I), ("avg_humidity_oscillation", D),
        ("max_humidity_oscillation", D), ("min_humidity_oscillation", D),
        ("rank_in_year", I), ("overall_avg_oscillation", D), ("overall_rank", I)),
    "temp_precipitation_correlation": _schema(
        ("city_name", S), ("avg_temperature", D), ("avg_daily_precipitation", D),
        ("avg_humidity", D), ("precipitation_quartile", I), ("quartile_label", S)),
    "temp_precipitation_quartile_summary": _schema(
        ("precipitation_quartile", I), ("quartile_label", S), ("avg_temp_in_quartile", D),
        ("avg_precip_in_quartile", D), ("avg_humidity_in_quartile", D)),
    "realtime_temp_vs_history": _schema(
        ("city", S), ("window_start", TS), ("window_end", TS), ("hist_year", I),
        ("hist_month", I), ("stream_avg_temp", D), ("hist_avg_temp", D),
        ("abs_deviation", D), ("pct_deviation", D), ("event_count", L), ("batch_id", L)),
    "realtime_flood_risk": _schema(
        ("city", S), ("window_start", TS), ("window_end", TS), ("hist_year", I),
        ("hist_month", I), ("stream_avg_cloud", D), ("hist_avg_cloud", D),
        ("cloud_anomaly_pct", D), ("stream_avg_pressure", D), ("stream_min_pressure", D),
        ("stream_max_pressure", D), ("hist_avg_pressure", D), ("pressure_drop_hpa", D),
        ("pressure_below_hist", D), ("high_cloud_anomaly", B), ("pressure_drop_alert", B),
        ("pressure_below_hist_alert", B), ("flood_risk", B), ("event_count", L),
        ("batch_id", L)),
    "realtime_heat_risk": _schema(
        ("city", S), ("window_start", TS), ("window_end", TS), ("min_humidity", I),
        ("max_humidity", I), ("avg_humidity", D), ("humidity_jump", I), ("avg_temp", D),
        ("max_temp", D), ("risk_level", S), ("batch_id", L)),
    "realtime_wind": _schema(
        ("city", S), ("window_start", TS), ("window_end", TS), ("avg_wind_speed", D),
        ("min_wind_speed", D), ("max_wind_speed", D), ("wind_speed_rise_pct", D),
        ("avg_gust", D), ("max_gust", D), ("gust_above_avg_pct", D), ("avg_wind_dir", D),
        ("wind_dir_change", D), ("speed_alert", B), ("gust_alert", B),
        ("direction_alert", B), ("wind_alert", B), ("batch_id", L)),
    "realtime_pressure_vs_history": _schema(
        ("city", S), ("window_start", TS), ("window_end", TS), ("hist_year", I),
        ("hist_month", I), ("stream_avg_pressure", D), ("hist_avg_pressure", D),
        ("abs_deviation", D), ("pct_deviation", D), ("event_count", L), ("batch_id", L)),
}


def conform(df: DataFrame, contract: T.StructType, *, allow_extra: bool = True) -> DataFrame:
    """Select the contract's columns in order, cast to its types. A missing
    column is an error; extra columns are dropped (or an error when
    ``allow_extra`` is False). ``computed_at`` is kept when present."""
    missing = [f.name for f in contract.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns for contract: {missing}")
    extra = [c for c in df.columns if c not in contract.fieldNames() and c != "computed_at"]
    if extra and not allow_extra:
        raise ValueError(f"columns outside the contract: {extra}")
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in contract.fields]
    if "computed_at" in df.columns and "computed_at" not in contract.fieldNames():
        cols.append(F.col("computed_at"))
    return df.select(*cols)

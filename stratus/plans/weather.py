"""The reference's jobs on the hourly weather schema.

Batch: each ``BATCH_JOBS`` entry maps the enriched observation table to one
result table (contract name → builder). Streaming: ``STREAM_JOBS`` gives the
window aggregates, window size/slide, watermark and per-batch
post-processing of the five alert jobs; ``start_stream_job`` wires one to a
source and a sink.

Differences from the reference, all deliberate:

* every job serves a list of cities (or all) instead of one hard-coded city;
* the baseline month is the month of each window's start, not the driver's
  clock at start-up, and the baseline is joined on (city, month) instead of
  being collected to the driver and cross-joined;
* event time is always UTC;
* ``computed_at`` is stamped in the sink only, and every row carries
  ``batch_id``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stratus.functions.calendar import parse_time
from stratus.operators.baseline import add_deviation, monthly_baseline, versus_baseline
from stratus.operators.buckets import bucket_summary, pearson, quantile_bucket
from stratus.operators.changes import season_step_change, season_yoy_change
from stratus.operators.enrich import enrich, quarantine
from stratus.operators.profiles import (
    calendar_profile, extreme_days_rank, flagged_days_rank, flagged_hours,
    flagged_hours_rank, hot_day_cooccurrence, season_vs_entity_mean,
)
from stratus.operators.rollups import daily_table, diurnal_oscillation_rank, diurnal_range_rank
from stratus.operators.rules import flood_rule, heat_rule, wind_rule
from stratus.session import materialize
from stratus.sinks.contracts import CONTRACTS, conform
from stratus.sinks.writers import batch_sink, write_observations
from stratus.sources.observations import (
    read_observations, read_observations_csv, split_corrupt,
)
from stratus.streaming.runner import start_window_job

CITY = "city_name"

# --- Fixed values: the reference's baseline period -------------------------
BASELINE_YEARS = (1990, 1999)
# ---------------------------------------------------------------------------


# --------------------------------------------------------------------------- ingest

def ingest(spark: SparkSession, raw_path: str, out_path: str,
           rejected_path: str | None = None, strict: bool = False) -> dict:
    """Raw CSV → enriched, year/month-partitioned Parquet; returns row counts.

    One pass over the raw files: rows and rejected rows (time does not
    parse) are counted with an ``Observation`` while the valid rows are
    written. Only when rejects exist and ``rejected_path`` is given does a
    second pass write them there (instead of a NULL partition).

    By default a number that does not parse is NULL and a short line's fields are. With
    ``strict`` such lines are no rows: ``rejected_path`` gets them as they came (``lines``)
    beside the rows without a time (``times``), and ``corrupt`` counts them."""
    if strict:
        raw, lines = split_corrupt(read_observations_csv(spark, raw_path, corrupt="_line"), "_line")
    else:
        raw, lines = read_observations_csv(spark, raw_path), None
    metrics = Observation("ingest")
    enriched = enrich(raw).observe(
        metrics, F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("datetime").isNull()).alias("rejected"))
    good, _ = quarantine(enriched)
    write_observations(good, out_path)
    counts = dict(metrics.get)
    times = rejected_path
    if strict:
        counts["corrupt"] = lines.count()
        counts["rows"] += counts["corrupt"]
        if rejected_path:
            times = f"{rejected_path}/times"
            lines.write.mode("overwrite").text(f"{rejected_path}/lines")
    if times and counts.get("rejected"):
        again = raw if strict else read_observations_csv(spark, raw_path)
        _, bad = quarantine(enrich(again, reason_col="time_error") if strict else enrich(again))
        bad.write.mode("overwrite").parquet(times)
    return counts


# --------------------------------------------------------------------------- batch

def diurnal_temp_variation(obs: DataFrame, scale: int | None = None, daily=None) -> DataFrame:
    return diurnal_range_rank(obs, CITY, "temperature_2m", scale=scale, daily=daily)


def monthly_climate_trends(obs: DataFrame, scale: int | None = None) -> DataFrame:
    return calendar_profile(obs, CITY, {
        "avg_temperature": ("temperature_2m", 1),
        "avg_humidity": ("relative_humidity_2m", 1),
        "avg_daily_precipitation": ("precipitation", 24),
        "avg_wind_speed": ("wind_speed_10m", 1),
        "avg_cloud_cover": ("cloud_cover", 1),
    }, scale=scale)


def snowy_winters_ranking(obs: DataFrame, scale: int | None = None) -> DataFrame:
    return flagged_days_rank(obs, CITY, "is_snow_day")


def extreme_temp_days(obs: DataFrame, scale: int | None = None, daily=None) -> DataFrame:
    return extreme_days_rank(obs, CITY, "temperature_2m", daily=daily)


def seasonal_pressure_precipitation(obs: DataFrame, scale: int | None = None) -> DataFrame:
    return season_yoy_change(obs, CITY, {
        "avg_pressure": ("pressure_msl", 1),
        "avg_daily_precipitation": ("precipitation", 24),
        "avg_temperature": ("temperature_2m", 1),
    }, {"pressure_change_vs_prev_year": "avg_pressure",
        "precipitation_change_vs_prev_year": "avg_daily_precipitation"}, scale=scale)


def wind_speed_seasonal_changes(obs: DataFrame, scale: int | None = None) -> DataFrame:
    return season_step_change(obs, CITY, {
        "avg_wind_speed_10m": ("wind_speed_10m", 1),
        "avg_wind_speed_100m": ("wind_speed_100m", 1),
        "avg_wind_gusts": ("wind_gusts_10m", 1),
    }, "avg_wind_speed_10m", scale=scale)


def least_sunny_winters(obs: DataFrame, scale: int | None = None, hours=None) -> DataFrame:
    return flagged_hours_rank(obs, CITY, "is_sunny_hour", hours=hours)


def sunny_hours_vs_city_avg(obs: DataFrame, scale: int | None = None, hours=None) -> DataFrame:
    return season_vs_entity_mean(obs, CITY, "is_sunny_hour", hours=hours)


def hot_day_precipitation(obs: DataFrame, scale: int | None = None, daily=None) -> DataFrame:
    return hot_day_cooccurrence(obs, CITY, "temperature_2m", "precipitation", scale=scale,
                                daily=daily,
                                names=("total_hot_days", "hot_days_with_rain",
                                       "total_precip_on_hot_days", "rain_pct_yearly",
                                       "total_hot_days_all_years",
                                       "total_hot_rainy_days_all_years",
                                       "total_precip_all_years", "rain_pct_all_years"))


def humidity_oscillation_ranking(obs: DataFrame, scale: int | None = None,
                                 daily=None) -> DataFrame:
    return diurnal_oscillation_rank(obs, CITY, "relative_humidity_2m", scale=scale,
                                    daily=daily)


_CITY_MEANS = {"avg_temperature": ("temperature_2m", 1),
               "avg_daily_precipitation": ("precipitation", 24),
               "avg_humidity": ("relative_humidity_2m", 1)}


def temp_precipitation_correlation(obs: DataFrame, scale: int | None = None) -> DataFrame:
    return quantile_bucket(obs, CITY, _CITY_MEANS, "avg_daily_precipitation", scale=scale)


def temp_precipitation_quartile_summary(obs: DataFrame, scale: int | None = None) -> DataFrame:
    return bucket_summary(temp_precipitation_correlation(obs, scale), {
        "avg_temp_in_quartile": "avg_temperature",
        "avg_precip_in_quartile": "avg_daily_precipitation",
        "avg_humidity_in_quartile": "avg_humidity",
    }, scale=scale)


def temp_precipitation_pearson(obs: DataFrame, scale: int | None = None) -> DataFrame:
    return pearson(obs, "temperature_2m", "precipitation")


BATCH_JOBS: dict[str, Callable[..., DataFrame]] = {
    "diurnal_temp_variation": diurnal_temp_variation,
    "monthly_climate_trends": monthly_climate_trends,
    "snowy_winters_ranking": snowy_winters_ranking,
    "extreme_temp_days": extreme_temp_days,
    "seasonal_pressure_precipitation": seasonal_pressure_precipitation,
    "wind_speed_seasonal_changes": wind_speed_seasonal_changes,
    "least_sunny_winters": least_sunny_winters,
    "sunny_hours_vs_city_avg": sunny_hours_vs_city_avg,
    "hot_day_precipitation": hot_day_precipitation,
    "humidity_oscillation_ranking": humidity_oscillation_ranking,
    "temp_precipitation_correlation": temp_precipitation_correlation,
    "temp_precipitation_quartile_summary": temp_precipitation_quartile_summary,
    "temp_precipitation_pearson": temp_precipitation_pearson,
}


def batch_result(obs: DataFrame, job: str, scale: int | None = None) -> DataFrame:
    """One result table, conformed to its contract when it has one."""
    out = BATCH_JOBS[job](obs, scale)
    return conform(out, CONTRACTS[job]) if job in CONTRACTS else out


def write_quartile_results(obs: DataFrame, write_detail: Callable[[DataFrame], None],
                           write_summary: Callable[[DataFrame], None],
                           scale: int | None = None) -> None:
    """Both quartile tables from one per-city table: it is materialised once
    (checkpoint) and read by the detail write and by the summary."""
    city = materialize(temp_precipitation_correlation(obs, scale))
    write_detail(conform(city, CONTRACTS["temp_precipitation_correlation"]))
    summary = bucket_summary(city, {
        "avg_temp_in_quartile": "avg_temperature",
        "avg_precip_in_quartile": "avg_daily_precipitation",
        "avg_humidity_in_quartile": "avg_humidity",
    }, scale=scale)
    write_summary(conform(summary, CONTRACTS["temp_precipitation_quartile_summary"]))


# Jobs that can start from the shared day-level table / flagged-hours table.
DAILY_JOBS = ("diurnal_temp_variation", "extreme_temp_days", "hot_day_precipitation",
              "humidity_oscillation_ranking")
HOURS_JOBS = ("least_sunny_winters", "sunny_hours_vs_city_avg")


def batch_all(obs: DataFrame, write: Callable[[str, DataFrame], None],
              scale: int | None = None, jobs: Sequence[str] | None = None) -> None:
    """Run several batch jobs with shared sub-plans: one day-level table
    (day/night extremes of temperature and humidity, daily min/max
    temperature, daily precipitation) and one winter flagged-hours table are
    materialised once and feed the jobs that start from them, instead of one
    scan of the hourly table per job. ``write(job, df)`` stores each result."""
    jobs = list(BATCH_JOBS) if jobs is None else list(jobs)
    daily = hours = None
    if any(j in DAILY_JOBS for j in jobs):
        daily = materialize(daily_table(
            obs, CITY, day_night=["temperature_2m", "relative_humidity_2m"],
            extremes=["temperature_2m"], sums=["precipitation"], extra_keys=["year"],
            scale=scale))
    if any(j in HOURS_JOBS for j in jobs):
        hours = materialize(flagged_hours(obs, CITY, "is_sunny_hour"))
    detail, summary = "temp_precipitation_correlation", "temp_precipitation_quartile_summary"
    if detail in jobs and summary in jobs:
        # both from one per-city table
        write_quartile_results(obs, lambda df: write(detail, df), lambda df: write(summary, df),
                               scale)
        jobs = [j for j in jobs if j not in (detail, summary)]
    for job in jobs:
        if job in DAILY_JOBS:
            out = BATCH_JOBS[job](obs, scale, daily=daily)
        elif job in HOURS_JOBS:
            out = BATCH_JOBS[job](obs, scale, hours=hours)
        else:
            out = BATCH_JOBS[job](obs, scale)
        write(job, conform(out, CONTRACTS[job]) if job in CONTRACTS else out)


def run_batch(spark: SparkSession, obs_path: str, job: str, write: Callable[[DataFrame], None],
              scale: int | None = None) -> None:
    """Read the enriched table, build ``job`` and hand it to ``write`` (e.g.
    ``lambda df: write_jdbc(df, job, url, props)``). One action per job."""
    write(batch_result(read_observations(spark, obs_path), job, scale))


# --------------------------------------------------------------------------- streaming

@dataclass(frozen=True)
class StreamJob:
    contract: str
    size: str
    slide: str
    watermark: str
    aggs: Callable[[], Mapping[str, Column]]
    post: Callable[[DataFrame, DataFrame | None], DataFrame]
    baseline_values: Mapping[str, str] = field(default_factory=dict)
    payload_time: bool = False   # event time from the payload instead of the record


def _vs_history(stream_col: str, hist_col: str) -> Callable:
    def post(windows: DataFrame, baseline: DataFrame | None) -> DataFrame:
        out = versus_baseline(windows, baseline, entity_pair=("city", CITY))
        return add_deviation(out, stream_col, hist_col)
    return post


def _flood_post(windows: DataFrame, baseline: DataFrame | None) -> DataFrame:
    return flood_rule(versus_baseline(windows, baseline, entity_pair=("city", CITY)))


STREAM_JOBS: dict[str, StreamJob] = {
    "temp_vs_history": StreamJob(
        "realtime_temp_vs_history", "60 minutes", "5 minutes", "5 minutes",
        lambda: {"stream_avg_temp": F.round(F.avg("temperature"), 3),
                 "event_count": F.count(F.lit(1))},
        _vs_history("stream_avg_temp", "hist_avg_temp"),
        {"hist_avg_temp": "temperature_2m"}),
    "flood_risk": StreamJob(
        "realtime_flood_risk", "90 minutes", "5 minutes", "5 minutes",
        lambda: {"stream_avg_cloud": F.round(F.avg("cloud_cover"), 3),
                 "stream_avg_pressure": F.round(F.avg("pressure"), 3),
                 "stream_min_pressure": F.round(F.min("pressure"), 3),
                 "stream_max_pressure": F.round(F.max("pressure"), 3),
                 "event_count": F.count(F.lit(1))},
        _flood_post,
        {"hist_avg_cloud": "cloud_cover", "hist_avg_pressure": "pressure_msl"}),
    "heat_risk": StreamJob(
        "realtime_heat_risk", "30 minutes", "5 minutes", "30 minutes",
        lambda: {"min_humidity": F.min("humidity"), "max_humidity": F.max("humidity"),
                 "avg_humidity": F.avg("humidity"), "avg_temp": F.avg("temperature"),
                 "max_temp": F.max("temperature")},
        lambda w, _b: heat_rule(w), payload_time=True),
    "wind": StreamJob(
        "realtime_wind", "30 minutes", "5 minutes", "5 minutes",
        lambda: {"avg_wind_speed": F.round(F.avg("wind_speed"), 2),
                 "min_wind_speed": F.round(F.min("wind_speed"), 2),
                 "max_wind_speed": F.round(F.max("wind_speed"), 2),
                 "avg_gust": F.round(F.avg("wind_gust"), 2),
                 "max_gust": F.round(F.max("wind_gust"), 2),
                 "avg_wind_dir": F.round(F.avg("wind_deg"), 2),
                 "min_wind_dir": F.round(F.min("wind_deg"), 2),
                 "max_wind_dir": F.round(F.max("wind_deg"), 2)},
        lambda w, _b: wind_rule(w)),
    "pressure_vs_history": StreamJob(
        "realtime_pressure_vs_history", "60 minutes", "5 minutes", "5 minutes",
        lambda: {"stream_avg_pressure": F.round(F.avg("pressure"), 3),
                 "event_count": F.count(F.lit(1))},
        _vs_history("stream_avg_pressure", "hist_avg_pressure"),
        {"hist_avg_pressure": "pressure_msl"}),
}


def history_baseline(obs: DataFrame, job: str, entities: Sequence[str] | None,
                     years: tuple[int, int] = BASELINE_YEARS) -> DataFrame | None:
    """Per (city, year, month) means over the baseline years (partition
    pruned on ``year``). Small: cities × years × 12 rows."""
    values = STREAM_JOBS[job].baseline_values
    if not values:
        return None
    return monthly_baseline(obs, values, entity=CITY, entities=entities, years=years)


def start_stream_job(spark: SparkSession, job: str, events: DataFrame, *, checkpoint: str,
                     sink_format: str, sink_options: Mapping[str, str] | None = None,
                     sink_path: str | None = None, obs: DataFrame | None = None,
                     entities: Sequence[str] | None = None, trigger: Mapping | None = None,
                     preview: int = 0, idempotent: bool = False,
                     state_store: str | None = None, state_partitions: int | None = None):
    """Start one alert job on a parsed event stream (see
    :func:`stratus.sources.events.read_event_stream`). Jobs comparing with
    history need ``obs`` (the enriched table). The baseline is materialised
    once per start (it changes only when history is reloaded) — written to
    the shared checkpoint folder, so a lost executor never re-scans history —
    and joined in every micro-batch."""
    spec = STREAM_JOBS[job]
    baseline = None
    if spec.baseline_values:
        if obs is None:
            raise ValueError(f"{job} needs the historical table")
        baseline = materialize(history_baseline(obs, job, entities))
    if spec.payload_time:
        events = events.withColumn("event_time", parse_time("payload_time"))
    contract = CONTRACTS[spec.contract]
    sink = batch_sink(sink_format, sink_options, path=sink_path,
                      transform=lambda w: spec.post(w, baseline), contract=contract,
                      preview=preview, with_computed_at=spec.contract != "realtime_heat_risk",
                      idempotent=idempotent)
    return start_window_job(events, aggs=spec.aggs(), size=spec.size, slide=spec.slide,
                            watermark=spec.watermark, sink=sink, checkpoint=checkpoint,
                            entity="city", entities=entities, trigger=trigger,
                            query_name=job, state_store=state_store,
                            state_partitions=state_partitions)

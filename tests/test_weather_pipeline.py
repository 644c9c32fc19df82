"""Raw CSV → enriched partitioned Parquet → the reference's batch jobs."""

import os

import pytest
from pyspark.sql import functions as F

from stratus.plans import weather as W
from stratus.sinks.contracts import CONTRACTS
from stratus.sources.observations import read_observations

HEADER = ("datetime,city_name,temperature_2m,relative_humidity_2m,precipitation,snowfall,"
          "cloud_cover,pressure_msl,wind_speed_10m,wind_speed_100m,wind_gusts_10m,"
          "direct_radiation,shortwave_radiation_instant,direct_radiation_instant,"
          "diffuse_radiation_instant,direct_normal_irradiance_instant,"
          "global_tilted_irradiance_instant,terrestrial_radiation_instant,extra_col")


def _row(ts, city, t, h=50, p=0.0, snow=0.0, cloud=10, pres=1010, w10=36, w100=72, g=18,
         rad=0):
    vals = [ts, city, t, h, p, snow, cloud, pres, w10, w100, g, rad, 1, 1, 1, 1, 1, 1, "x"]
    return ",".join("" if v is None else str(v) for v in vals)


ROWS = [
    # Dubai with spaces: day/night edges on 1999-12-31
    _row("1999-12-31 05:00:00", " Dubai ", 10.0),
    _row("1999-12-31 06:00:00", " Dubai ", 20.0, rad=121, cloud=49),
    _row("1999-12-31 17:00:00", " Dubai ", 25.5, rad=120, cloud=49),
    _row("1999-12-31 18:00:00", " Dubai ", 8.0, snow=0.1),
    _row("2000-01-01 03:00:00", " Dubai ", 41.0, p=0.2),
    _row("2000-01-01 12:00:00", " Dubai ", 45.0, rad=121, cloud=50, snow=None),
    _row("2000-02-29 12:00:00", " Dubai ", None, snow=1.0),
    _row("2000-02-29 23:00:00", " Dubai ", -11.0),
    _row("not a time", " Dubai ", 1.0),
    _row("1999-07-01 10:00:00", "Oslo", 31.0, p=0.06),
    _row("1999-07-01 11:00:00", "Oslo", 30.0, p=0.05),
    _row("1999-07-01 22:00:00", "Oslo", 12.0),
    _row("1999-07-01 22:00:00", "Oslo", 12.0),   # duplicate (city, datetime) kept
    _row("2000-07-01 10:00:00", "Oslo", 29.0),
    _row("2000-07-01 23:00:00", "Oslo", 9.0),
]


@pytest.fixture(scope="module")
def enriched_path(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("weather")
    raw = d / "raw.csv"
    raw.write_text(HEADER + "\n" + "\n".join(ROWS) + "\n")
    out, rejected = str(d / "obs"), str(d / "rejected")
    counts = W.ingest(spark, str(raw), out, rejected_path=rejected)
    assert counts == {"rows": 15, "rejected": 1}
    return out, rejected


def test_ingest_layout_and_features(spark, enriched_path):
    out, rejected = enriched_path
    assert [d for d in sorted(os.listdir(out)) if d.startswith("year=")] == ["year=1999", "year=2000"]
    assert sorted(os.listdir(os.path.join(out, "year=2000"))) == ["month=1", "month=2", "month=7"]
    obs = read_observations(spark, out)
    assert obs.count() == 14
    assert spark.read.parquet(rejected).count() == 1
    cols = set(obs.columns)
    assert "shortwave_radiation_instant" not in cols and "extra_col" in cols
    r = {(x.city_name, str(x.datetime)): x for x in obs.collect()}
    a = r[("Dubai", "1999-12-31 05:00:00")]
    assert (a.is_day, a.season, a.winter_season_year, a.month_day) == (False, "winter", 1999, "12-31")
    assert a.wind_speed_10m == 10.0 and a.wind_speed_100m == 20.0 and a.wind_gusts_10m == 5.0
    assert r[("Dubai", "1999-12-31 06:00:00")].is_day is True
    assert r[("Dubai", "1999-12-31 06:00:00")].is_sunny_hour is True
    assert r[("Dubai", "1999-12-31 17:00:00")].is_sunny_hour is False
    assert r[("Dubai", "1999-12-31 18:00:00")].is_day is False
    assert r[("Dubai", "1999-12-31 18:00:00")].is_snow_day is True
    jan = r[("Dubai", "2000-01-01 12:00:00")]
    assert (jan.winter_season_year, jan.is_snow_day, jan.is_sunny_hour) == (1999, False, False)
    assert r[("Dubai", "2000-02-29 12:00:00")].winter_season_year == 1999


def test_season_filter_prunes_month_partitions(spark, enriched_path):
    obs = read_observations(spark, enriched_path[0])
    plan = obs.filter(F.col("month").isin(12, 1, 2))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan or "month#" in plan.split("PartitionFilters")[1]


@pytest.mark.parametrize("job", sorted(W.BATCH_JOBS))
def test_batch_jobs_conform(spark, enriched_path, job):
    obs = read_observations(spark, enriched_path[0])
    out = W.batch_result(obs, job, scale=2)
    rows = out.collect()
    if job in CONTRACTS:
        assert [(f.name, f.dataType) for f in out.schema] == \
            [(f.name, f.dataType) for f in CONTRACTS[job]]
    assert rows is not None


def test_diurnal_values(spark, enriched_path):
    obs = read_observations(spark, enriched_path[0])
    got = {r.city_name: r for r in W.batch_result(obs, "diurnal_temp_variation").collect()}
    # Dubai 1999-12-31: day max 25.5, night min 8 → 17.5; 2000-01-01: 45 − 41 = 4;
    # 2000-02-29: day max NULL → dropped. Oslo 1999-07-01: 31 − 12 = 19; 2000: 29 − 9 = 20.
    assert got["Dubai"].avg_temp_variation == 10.75
    assert (got["Dubai"].max_single_day_variation, got["Dubai"].min_single_day_variation) == (17.5, 4.0)
    assert got["Oslo"].avg_temp_variation == 19.5 and got["Oslo"].rank == 1
    assert got["Dubai"].rank == 2


def test_extreme_and_hot_days(spark, enriched_path):
    obs = read_observations(spark, enriched_path[0])
    ext = {(r.city_name, r.year): r for r in W.batch_result(obs, "extreme_temp_days").collect()}
    # 2000-01-01 max 45 (heat), 2000-02-29 min −11 (cold)
    assert (ext[("Dubai", 2000)].total_extreme_days, ext[("Dubai", 2000)].extreme_cold_days,
            ext[("Dubai", 2000)].extreme_heat_days) == (2, 1, 1)
    assert ("Oslo", 1999) not in ext
    hot = {(r.city_name, r.year): r for r in W.batch_result(obs, "hot_day_precipitation").collect()}
    # Oslo 1999-07-01 max 31, precipitation 0.06 + 0.05 = 0.11 > 0.1 → rainy
    o = hot[("Oslo", 1999)]
    assert (o.total_hot_days, o.hot_days_with_rain, o.total_precip_on_hot_days) == (1, 1, 0.11)
    assert o.rain_pct_all_years == 100.0
    d = hot[("Dubai", 2000)]
    assert (d.total_hot_days, d.hot_days_with_rain, d.rain_pct_yearly) == (1, 1, 100.0)


def test_snow_and_sun_winters(spark, enriched_path):
    obs = read_observations(spark, enriched_path[0])
    snow = W.batch_result(obs, "snowy_winters_ranking").collect()
    # snow hours: 1999-12-31 18:00 and 2000-02-29 12:00 → winter 1999, 2 distinct days
    assert [(r.city_name, r.winter_season_year, r.snow_days_count, r.rank_in_winter)
            for r in snow] == [("Dubai", 1999, 2, 1)]
    sun = W.batch_result(obs, "least_sunny_winters").collect()
    assert [(r.city_name, r.sunny_hours_count, r.total_hours, r.sunny_hours_pct)
            for r in sun] == [("Dubai", 1, 8, 12.5)]


def test_quartile_results_written_together(spark, enriched_path):
    obs = read_observations(spark, enriched_path[0])
    got = {}
    W.write_quartile_results(obs, lambda d: got.setdefault("detail", d.collect()),
                             lambda d: got.setdefault("summary", d.collect()))
    assert sorted(r.city_name for r in got["detail"]) == ["Dubai", "Oslo"]
    assert sorted(r.precipitation_quartile for r in got["summary"]) == [1, 2]


def test_batch_all_shares_sub_plans_with_same_results(spark, enriched_path):
    obs = read_observations(spark, enriched_path[0])
    shared = {}
    W.batch_all(obs, lambda job, df: shared.setdefault(job, sorted(map(tuple, df.collect()))),
                scale=2)
    assert set(shared) == set(W.BATCH_JOBS)
    for job in W.DAILY_JOBS + W.HOURS_JOBS:
        alone = sorted(map(tuple, W.batch_result(obs, job, scale=2).collect()))
        assert shared[job] == alone, job


def test_csv_reader_is_by_name_and_permissive(spark, tmp_path):
    from stratus.sources.observations import read_observations_csv
    p = tmp_path / "odd.csv"
    # columns in another order, an unknown column, a malformed number
    p.write_text("temperature_2m,note,city_name,datetime\n"
                 "12.5,a,Oslo,2000-01-01 00:00:00\n"
                 "abc,b,Oslo,2000-01-01 01:00:00\n")
    df = read_observations_csv(spark, str(p))
    assert dict(df.dtypes)["temperature_2m"] == "double"
    assert dict(df.dtypes)["note"] == "string"
    assert [r.temperature_2m for r in df.orderBy("datetime").collect()] == [12.5, None]


def test_monthly_profile_values(spark, enriched_path):
    obs = read_observations(spark, enriched_path[0])
    got = {(r.city_name, r.month): r for r in W.batch_result(obs, "monthly_climate_trends").collect()}
    oslo = got[("Oslo", 7)]        # July 1999 and 2000 pooled: the profile spans all years
    assert (oslo.avg_temperature, oslo.avg_humidity, oslo.avg_daily_precipitation,
            oslo.avg_wind_speed, oslo.avg_cloud_cover) == (20.5, 50.0, 0.44, 10.0, 10.0)

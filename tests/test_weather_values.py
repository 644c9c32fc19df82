"""Values of the weather jobs on random readings (with NULLs) against SQL
written from the job descriptions; means are compared before rounding."""

import random

import duckdb
import pytest

from stratus.plans import weather as W
from stratus.sources.observations import read_observations
from tests.test_weather_pipeline import HEADER, _row

MEANS = {"a": "avg(temperature_2m)", "p": "avg(precipitation) * 24", "h": "avg(relative_humidity_2m)"}

SQL = {
    "seasonal_pressure_precipitation": """
        WITH s AS (SELECT city_name, year, season, avg(pressure_msl) x, avg(precipitation) * 24 p,
                          avg(temperature_2m) t
                   FROM obs WHERE season IN ('summer', 'winter') GROUP BY ALL)
        SELECT city_name, year, season, x AS avg_pressure, p AS avg_daily_precipitation,
               t AS avg_temperature,
               coalesce(x - lag(x) OVER w, 0) AS pressure_change_vs_prev_year,
               coalesce(p - lag(p) OVER w, 0) AS precipitation_change_vs_prev_year
        FROM s WINDOW w AS (PARTITION BY city_name, season ORDER BY year)""",
    "wind_speed_seasonal_changes": """
        WITH s AS (SELECT city_name, year, season, avg(wind_speed_10m) x, avg(wind_speed_100m) y,
                          avg(wind_gusts_10m) z,
                          CASE season WHEN 'spring' THEN 1 WHEN 'summer' THEN 2
                                      WHEN 'autumn' THEN 3 ELSE 4 END AS season_order
                   FROM obs GROUP BY ALL)
        SELECT city_name, year, season, x AS avg_wind_speed_10m, y AS avg_wind_speed_100m,
               z AS avg_wind_gusts, season_order,
               coalesce(x - lag(x) OVER (PARTITION BY city_name, year ORDER BY season_order), 0)
                 AS wind_change_vs_prev_season FROM s""",
    "humidity_oscillation_ranking": """
        WITH d AS (SELECT city_name, year, date,
                          max(relative_humidity_2m) FILTER (is_day)
                          - min(relative_humidity_2m) FILTER (NOT is_day) AS r
                   FROM obs GROUP BY ALL HAVING r IS NOT NULL),
             y AS (SELECT city_name, year, round(avg(r), 2) a, max(r) m, min(r) n FROM d GROUP BY ALL),
             o AS (SELECT city_name, round(avg(a), 2) oa FROM y GROUP BY ALL),
             k AS (SELECT city_name, oa, rank() OVER (ORDER BY oa DESC) ok FROM o)
        SELECT city_name, year, a AS avg_humidity_oscillation, m AS max_humidity_oscillation,
               n AS min_humidity_oscillation, rank() OVER (PARTITION BY year ORDER BY a DESC)
                 AS rank_in_year, oa AS overall_avg_oscillation, ok AS overall_rank
        FROM y JOIN k USING (city_name)""",
    "temp_precipitation_correlation": f"""
        WITH c AS (SELECT city_name, {MEANS['a']} a, round({MEANS['p']}, 2) p, {MEANS['h']} h
                   FROM obs GROUP BY ALL)
        SELECT city_name, a AS avg_temperature, p AS avg_daily_precipitation, h AS avg_humidity,
               ntile(4) OVER (ORDER BY p, city_name) AS precipitation_quartile FROM c""",
    "temp_precipitation_pearson": """
        SELECT corr(temperature_2m, precipitation) AS pearson_correlation FROM obs""",
    "sunny_hours_vs_city_avg": """
        WITH y AS (SELECT city_name, winter_season_year, count(*) FILTER (is_sunny_hour) n,
                          count(*) t FROM obs WHERE month IN (12, 1, 2) GROUP BY ALL),
             m AS (SELECT *, avg(n) OVER (PARTITION BY city_name) a FROM y)
        SELECT city_name, winter_season_year, n AS sunny_hours_count, t AS total_hours,
               n * 100.0 / t AS sunny_hours_pct, a AS city_avg_sunny_hours,
               n - a AS diff_from_city_avg FROM m""",
}


@pytest.fixture(scope="module")
def obs(spark, tmp_path_factory):
    random.seed(41)
    rows = []
    for _ in range(2500):
        ts = (f"{random.randint(1998, 2001)}-{random.randint(1, 12):02d}-{random.randint(1, 6):02d} "
              f"{random.randint(0, 23):02d}:00:00")
        some = lambda v: None if random.random() < 0.05 else v
        rows.append(_row(ts, random.choice(["Ann", "Bor", "Cis", "Dub", "Els", "Fur"]),
                         some(round(random.uniform(-20, 40), 1)), some(random.randint(20, 99)),
                         some(round(random.uniform(0, 3), 2)), 0, random.randint(0, 99),
                         some(random.randint(980, 1040)), some(random.randint(0, 90)),
                         random.randint(0, 90), random.randint(0, 90), random.randint(0, 400)))
    d = tmp_path_factory.mktemp("values")
    (d / "raw.csv").write_text("\n".join([HEADER, *rows]) + "\n")
    W.ingest(spark, str(d / "raw.csv"), str(d / "obs"))
    return read_observations(spark, str(d / "obs"))


@pytest.mark.parametrize("job", sorted(SQL))
def test_values(obs, job):
    got = W.batch_result(obs, job, scale=2).toPandas()
    frame = obs.toPandas()
    con = duckdb.connect()
    con.register("obs", frame)
    want = con.execute(SQL[job]).df()
    keys = [c for c in ("city_name", "year", "season", "winter_season_year") if c in want]
    if keys:
        got, want = got.sort_values(keys), want.sort_values(keys)
    assert len(got) == len(want) > 0
    for c in want.columns:
        for a, b in zip(got[c].tolist(), want[c].tolist()):
            if isinstance(b, str) or "rank" in c or "quartile" in c or c in ("year", "total_hours"):
                assert a == b, c
            else:
                assert a == pytest.approx(b, abs=0.0151), c     # two or three roundings to 2 digits
    if job == "temp_precipitation_pearson":
        assert got.iloc[0, 0] == pytest.approx(want.iloc[0, 0], abs=1e-12)
    if job == "sunny_hours_vs_city_avg":
        assert set(got["vs_city_avg"]) <= set(W.season_vs_entity_mean.__kwdefaults__["labels"])


def test_quartile_tables_are_built_once(obs, monkeypatch):
    calls = []
    plain = W.quantile_bucket
    monkeypatch.setattr(W, "quantile_bucket", lambda *a, **k: calls.append(1) or plain(*a, **k))
    seen = []
    W.batch_all(obs, lambda job, df: seen.append(job) or df.collect(), scale=2, jobs=[
        "temp_precipitation_correlation", "temp_precipitation_quartile_summary"])
    assert len(calls) == 1 and len(seen) == 2

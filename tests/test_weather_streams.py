"""The five alert jobs end to end: JSON event files → watermarked sliding
windows → rules / baseline join in the micro-batch sink → Parquet."""

import json

import pytest
from pyspark.sql import functions as F

from stratus.plans import weather as W
from stratus.sinks.contracts import CONTRACTS
from stratus.sources.events import read_event_stream
from stratus.sources.observations import read_observations

HIST = [  # (datetime, city, temperature, cloud, pressure)
    ("1995-07-01 10:00:00", "Oslo", 20.0, 40.0, 1010.0),
    ("1995-07-02 10:00:00", "Oslo", 22.0, 60.0, 1012.0),
    ("1996-07-01 10:00:00", "Oslo", 0.0, 0.0, 1005.0),
    ("1996-06-01 10:00:00", "Oslo", 99.0, 99.0, 999.0),   # other month
    ("1989-07-01 10:00:00", "Oslo", 50.0, 50.0, 1000.0),  # before the baseline years
    ("1995-07-01 10:00:00", "Rome", 30.0, 10.0, 1015.0),
]

EVENTS = [
    {"name": "Oslo", "main": {"temp": 21.0, "humidity": 80, "pressure": 1004.0},
     "clouds": {"all": 70.0}, "wind": {"speed": 4.0, "deg": 10.0, "gust": 9.0},
     "timestamp": "2024-07-01 10:01:00", "event_time": "2024-07-01T10:01:00Z"},
    {"name": "Oslo", "main": {"temp": 23.0, "humidity": 100, "pressure": 1000.0},
     "clouds": {"all": 90.0}, "wind": {"speed": 8.0, "deg": 350.0},
     "timestamp": "2024-07-01 10:03:00", "event_time": "2024-07-01T10:03:00Z", "x": 1},
    {"name": "Oslo", "main": {"temp": 25.0, "humidity": 65.5},
     "timestamp": "2024-07-01 10:04:00", "event_time": "2024-07-01T10:04:00Z"},
    {"name": "Oslo", "timestamp": "2024-07-01 10:04:30", "event_time": "2024-07-01T10:04:30Z"},
    {"name": "Rome", "main": {"temp": 31.0, "humidity": 50, "pressure": 1013.0},
     "clouds": {"all": 5.0}, "wind": {"speed": 2.0, "deg": 90.0, "gust": 3.0},
     "timestamp": "2024-07-01 10:02:00", "event_time": "2024-07-01T10:02:00Z"},
]


@pytest.fixture(scope="module")
def setup(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("streams")
    hist = spark.createDataFrame(HIST, "datetime string, city_name string, temperature_2m double, "
                                       "cloud_cover double, pressure_msl double")
    from stratus.operators.enrich import enrich
    from stratus.sinks.writers import write_observations
    write_observations(enrich(hist, flags={}), str(d / "obs"))
    src = d / "events"
    src.mkdir()
    with open(src / "part-0.json", "w") as fh:
        for e in EVENTS:
            fh.write(json.dumps(e) + "\n")
        fh.write("{not json\n\n")
    return d, read_observations(spark, str(d / "obs"))


@pytest.mark.parametrize("job", sorted(W.STREAM_JOBS))
def test_stream_job(spark, setup, job):
    d, obs = setup
    events = read_event_stream(spark, "files", path=str(d / "events"))
    out, ckpt = str(d / f"out-{job}"), str(d / f"ckpt-{job}")
    q = W.start_stream_job(spark, job, events, checkpoint=ckpt, sink_format="parquet",
                           sink_path=out, obs=obs, entities=["Oslo"],
                           trigger={"availableNow": True})
    q.awaitTermination(300)
    assert q.exception() is None
    res = spark.read.parquet(out)
    contract = CONTRACTS[W.STREAM_JOBS[job].contract]
    assert [c for c in res.columns if c != "computed_at"] == contract.fieldNames()
    assert res.filter(F.col("city") != "Oslo").count() == 0
    first = res.filter(F.col("window_start") == "2024-07-01 10:00:00")
    if job == "temp_vs_history":
        # window 10:00–11:00 holds 21, 23, 25 (the event without `main` has no temp)
        rows = {r.hist_year: r for r in first.collect()}
        assert set(rows) == {1995, 1996}
        assert rows[1995].stream_avg_temp == 23.0 and rows[1995].hist_avg_temp == 21.0
        assert rows[1995].abs_deviation == 2.0 and rows[1995].pct_deviation == 9.524
        assert rows[1996].pct_deviation is None            # baseline mean 0
        assert rows[1995].event_count == 4
    if job == "flood_risk":
        rows = {r.hist_year: r for r in first.collect()}
        assert rows[1996].cloud_anomaly_pct == 8000.0      # zero baseline divides by 1.0
        assert rows[1995].pressure_drop_hpa == 4.0 and rows[1995].pressure_drop_alert
    if job == "pressure_vs_history":
        rows = {r.hist_year: r for r in first.collect()}
        assert rows[1995].stream_avg_pressure == 1002.0 and rows[1995].hist_avg_pressure == 1011.0
        assert (rows[1995].abs_deviation, rows[1995].pct_deviation) == (-9.0, -0.89)
        assert (rows[1996].abs_deviation, rows[1996].pct_deviation) == (-3.0, -0.299)
    if job == "heat_risk":
        r = res.filter(F.col("window_start") == "2024-07-01 09:35:00").first()
        # humidity 65.5 is not an int → NULL; jump 100 − 80 = 20 → not > 20
        assert (r.min_humidity, r.max_humidity, r.humidity_jump) == (80, 100, 20)
        assert r.risk_level == "HIGH"
    if job == "wind":
        r = first.first()
        assert r.wind_dir_change == 20.0 and r.wind_speed_rise_pct == 100.0
        assert r.speed_alert is True and r.wind_alert is True

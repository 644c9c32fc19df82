"""The job entry point runs ingest, a batch job and an alert stream."""

import json
import os

from stratus.__main__ import main
from tests.test_weather_pipeline import HEADER, ROWS


def test_cli_end_to_end(spark, scratch):
    raw = os.path.join(scratch, "raw.csv")
    with open(raw, "w") as fh:
        fh.write(HEADER + "\n" + "\n".join(ROWS) + "\n")
    obs, out = os.path.join(scratch, "obs"), os.path.join(scratch, "results")
    assert main(["ingest", "--raw", raw, "--out", obs]) == 0
    assert main(["batch", "diurnal_temp_variation", "--obs", obs, "--out", out]) == 0
    got = spark.read.parquet(os.path.join(out, "diurnal_temp_variation"))
    assert sorted(r.city_name for r in got.collect()) == ["Dubai", "Oslo"]

    events = os.path.join(scratch, "events")
    os.makedirs(events)
    with open(os.path.join(events, "e.json"), "w") as fh:
        fh.write(json.dumps({"name": "Oslo", "wind": {"speed": 3.0, "deg": 10.0, "gust": 5.0},
                             "event_time": "2024-01-01T10:00:00Z"}) + "\n")
    sink = os.path.join(scratch, "alerts")
    assert main(["stream", "wind", "--source", "files", "--path", events,
                 "--checkpoint", os.path.join(scratch, "ckpt"), "--sink-format", "parquet",
                 "--sink-path", sink, "--available-now", "--idempotent"]) == 0
    rows = spark.read.parquet(sink).collect()
    assert len(rows) == 6 and {r.batch_id for r in rows} == {0}


def test_cli_batch_all_to_jdbc(spark, scratch, monkeypatch):
    raw = os.path.join(scratch, "raw.csv")
    with open(raw, "w") as fh:
        fh.write(HEADER + "\n" + "\n".join(ROWS) + "\n")
    obs = os.path.join(scratch, "obs")
    assert main(["ingest", "--raw", raw, "--out", obs]) == 0
    monkeypatch.setenv("STRATUS_TEST_DRIVER", "org.apache.derby.iapi.jdbc.AutoloadedDriver")
    url = "jdbc:derby:memory:stratus_cli;create=true"
    assert main(["batch", "all", "--obs", obs, "--jdbc-url", url,
                 "--jdbc-prop", "driver=@env:STRATUS_TEST_DRIVER"]) == 0
    back = (spark.read.format("jdbc").option("url", url)
            .option("dbtable", "extreme_temp_days")
            .option("driver", "org.apache.derby.iapi.jdbc.AutoloadedDriver").load())
    assert [tuple(r) for r in back.collect()] == [("Dubai", 2000, 2, 1, 1, 1)]

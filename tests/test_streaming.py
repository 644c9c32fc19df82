"""Streaming jobs: late data against the watermark, restart from the
checkpoint, and streaming result = batch result."""

import json
import os
import time

from pyspark.sql import functions as F

from stratus.operators.windows import latest_per_window, sliding_stats
from stratus.sinks.writers import batch_sink
from stratus.sources.events import read_event_stream
from stratus.streaming.runner import start_window_job

FILES = [
    [("10:02", 10), ("10:40", 20)],
    [("12:00", 30)],
    [("10:10", 99), ("11:20", 40)],
    [("12:03", 50), ("bad", 0)],
]


def _write_event_files(d):
    os.makedirs(d)
    base = time.time() - 100
    for i, rows in enumerate(FILES):
        p = os.path.join(d, f"part-{i}.json")
        with open(p, "w") as fh:
            for t, v in rows:
                ts = f"2024-01-01T{t}:00Z" if t != "bad" else "bad"
                fh.write(json.dumps({"name": "A", "main": {"temp": v, "extra": 1},
                                     "event_time": ts}) + "\n")
            fh.write("\n")
        os.utime(p, (base + i * 10, base + i * 10))


def _run(spark, src, out, ckpt):
    events = read_event_stream(spark, "files", path=src, max_per_trigger=1)
    sink = batch_sink("parquet", path=out)
    q = start_window_job(events, aggs={"avg_temp": F.avg("temperature"),
                                       "n": F.count(F.lit(1))},
                         size="60 minutes", slide="5 minutes", watermark="5 minutes",
                         sink=sink, checkpoint=ckpt, trigger={"availableNow": True})
    q.awaitTermination(300)
    return q


def test_late_data_golden(spark, scratch):
    src, out, ckpt = (os.path.join(scratch, x) for x in ("in", "out", "ckpt"))
    _write_event_files(src)
    q = _run(spark, src, out, ckpt)
    assert q.exception() is None
    res = spark.read.parquet(out)
    per_batch = {r.batch_id: r.c for r in res.groupBy("batch_id").agg(F.count("*").alias("c")).collect()}
    assert per_batch == {0: 20, 1: 12, 2: 19, 3: 12}

    def at(batch, hhmm):
        rows = res.filter((F.col("batch_id") == batch)
                          & (F.date_format("window_start", "HH:mm") == hhmm)).collect()
        return [(r.avg_temp, r.n) for r in rows]

    assert at(0, "09:45") == [(15.0, 2)]
    assert at(1, "11:05") == [(30.0, 1)] and at(1, "12:00") == [(30.0, 1)]
    assert at(2, "09:40") == [(54.5, 2)] and at(2, "09:45") == [(43.0, 3)]
    assert at(2, "09:15") == [] and at(2, "09:35") == []      # late for closed windows
    assert at(2, "11:05") == [(35.0, 2)]
    assert at(3, "11:05") == [(40.0, 3)]

    latest = latest_per_window(res.drop("window_end"), keys=("city", "window_start"))
    assert latest.filter(F.date_format("window_start", "HH:mm") == "11:05").first().n == 3

    # restart on the same checkpoint: nothing new is emitted
    before = res.count()
    q2 = _run(spark, src, out, ckpt)
    assert q2.exception() is None
    assert spark.read.parquet(out).count() == before


def test_stream_equals_batch_on_events(spark, scratch):
    sf = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
              .parquet(sf).withColumnRenamed("ts", "event_time"))
    out, ckpt = os.path.join(scratch, "out"), os.path.join(scratch, "ckpt")
    aggs = {"total": F.sum("value"), "n": F.count(F.lit(1))}
    q = start_window_job(stream, aggs=aggs, size="60 minutes", slide="5 minutes",
                         watermark="5 minutes", sink=batch_sink("parquet", path=out),
                         checkpoint=ckpt, entity="event_type", trigger={"availableNow": True})
    q.awaitTermination(300)
    assert q.exception() is None
    got = latest_per_window(spark.read.parquet(out).drop("window_end"),
                            keys=("event_type", "window_start"))
    batch = spark.read.parquet(f"{sf}/events.parquet").withColumn(
        "ts", F.col("ts").cast("timestamp"))
    want = sliding_stats(batch, "ts", "event_type", aggs, size="60 minutes", slide="5 minutes")
    a = {(r.event_type, r.window_start): (round(r.total, 6), r.n) for r in got.collect()}
    b = {(r.event_type, r.window_start): (round(r.total, 6), r.n) for r in want.collect()}
    assert a == b and len(a) > 1000


def test_rocksdb_state_store(spark, scratch):
    src, out, ckpt = (os.path.join(scratch, x) for x in ("in", "out", "ckpt"))
    _write_event_files(src)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    try:
        events = read_event_stream(spark, "files", path=src)
        q = start_window_job(events, aggs={"n": F.count(F.lit(1))}, size="60 minutes",
                             slide="5 minutes", watermark="5 minutes",
                             sink=batch_sink("parquet", path=out), checkpoint=ckpt,
                             trigger={"availableNow": True}, state_store="rocksdb")
        q.awaitTermination(300)
        assert q.exception() is None
        assert spark.read.parquet(out).count() > 0
    finally:
        if before:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
        else:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_flood_stream_equals_batch(spark):
    """Stateful 90/5 windows → baseline join and three-valued flood rule
    applied per micro-batch in the sink → last emission per (window, baseline
    year) equals the batch flood query."""
    from stratus.functions.numeric import mean_exact
    from stratus.operators.baseline import versus_baseline
    from stratus.operators.rules import flood_rule
    from stratus.plans import driver as D
    sf = "/root/testdata/sf0.001"
    base = D.monthly_baseline(D._lineitem_months(spark, sf),
                              {"hist_avg_cloud": "l_quantity", "hist_avg_pressure": "l_quantity"},
                              scale=D.SCALE)

    def post(w):
        return flood_rule(versus_baseline(w, base))
    cols = ("stream_avg_cloud", "hist_avg_cloud", "cloud_anomaly_pct", "stream_avg_pressure",
            "stream_min_pressure", "stream_max_pressure", "hist_avg_pressure",
            "pressure_drop_hpa", "pressure_below_hist", "high_cloud_anomaly",
            "pressure_drop_alert", "pressure_below_hist_alert", "flood_risk", "event_count")
    streamed = D._stream_replay(spark, sf, "90 minutes", {
        "stream_avg_cloud": F.round(mean_exact("k", D.SCALE), 3),
        "stream_avg_pressure": F.round(mean_exact("value", D.SCALE), 3),
        "stream_min_pressure": F.round(F.min("value"), 3),
        "stream_max_pressure": F.round(F.max("value"), 3),
        "event_count": F.count(F.lit(1)),
    }, transform=post, columns=cols, extra_keys=("hist_year", "hist_month"))
    batch = D.QUERIES["flood_rule"](spark, sf)
    order = sorted(batch.columns)
    a = sorted(tuple(r) for r in streamed.select(order).collect())
    b = sorted(tuple(r) for r in batch.select(order).collect())
    assert len(a) > 10000 and a == b

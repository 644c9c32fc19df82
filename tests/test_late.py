"""Late rows as an output: the rule against Spark's own late filter and watermark."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from stratus.plans import driver as D
from stratus.plans import streams as S
from stratus.sinks.writers import batch_sink
from stratus.sources.events import read_event_stream
from stratus.streaming.late import late_router, open_windows, read_batches, read_rows
from stratus.streaming.runner import start_window_job
from tests.conftest import SF_SMALL
from tests.test_streaming import _write_event_files

OPTIONS = {"size": "60 minutes", "slide": "5 minutes", "delay": "5 minutes"}


def _route(spark, src, out, ckpt, router=None):
    q = (read_event_stream(spark, "files", path=src, max_per_trigger=1).writeStream
         .foreachBatch(router or late_router(out, **OPTIONS))
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination(300)
    return q


def test_golden_batches_and_rows(spark, scratch):
    src, out = f"{scratch}/in", f"{scratch}/out"
    _write_event_files(src)
    _route(spark, src, out, f"{scratch}/c")
    got = {r.batch_id: r for r in read_batches(spark, out).withColumn(
        "watermark", F.date_format("watermark", "HH:mm")).collect()}
    assert [got[i].watermark for i in range(4)] == [None, None, "10:35", "11:55"]
    # 10:10 is dropped from the five windows 09:15 to 09:35, which ended by 10:35
    assert [(got[i].n_rows, got[i].n_untimed, got[i].n_late, got[i].n_closed) for i in range(4)] == [
        (2, 0, 0, 0), (1, 0, 0, 0), (2, 0, 0, 5), (2, 1, 0, 0)]
    # the same batch again: nothing twice
    batch = (read_rows(spark, out).where("batch_id = 2").drop("batch_id", "late", "open_windows"))
    late_router(out, **OPTIONS)(spark.createDataFrame(batch.collect(), batch.schema), 2)
    assert read_rows(spark, out).count() == 7 and read_batches(spark, out).count() == 4


def test_open_windows_equal_the_window_list(spark):
    base = dt.datetime(2024, 1, 1, 12)
    times = [(base + dt.timedelta(seconds=s),) for s in range(0, 7200, 97)]
    df = spark.createDataFrame(times, "t timestamp").withColumn(
        "w", F.window("t", "60 minutes", "5 minutes"))
    for mark in (None, "2024-01-01 12:00:00", "2024-01-01 12:34:56.789", "2024-01-01 14:55:00",
                 "2024-01-01 16:00:00"):
        watermark = F.lit(mark).cast("timestamp")
        want = df.groupBy("t").agg(F.count_if(watermark.isNull() | (F.col("w.end") > watermark)).alias("n"))
        got = want.withColumn("m", open_windows(F.col("t"), watermark, 3600, 300))
        assert got.where("n <> m").count() == 0


def test_watermarks_and_drops_equal_those_of_the_query(spark, scratch):
    """Spark's progress of the stateful job over the same files, batch by batch."""
    path, stream = S._arrivals(spark, SF_SMALL)
    out = f"{scratch}/out"
    q = (stream.writeStream.foreachBatch(late_router(out, **OPTIONS))
         .option("checkpointLocation", f"{scratch}/c1").trigger(availableNow=True).start())
    q.awaitTermination(300)
    mine = {r.batch_id: r for r in read_batches(spark, out).withColumn(
        "us", F.unix_micros("watermark")).collect()}
    job = start_window_job(stream, aggs={"n": F.count(F.lit(1))}, size=OPTIONS["size"],
                           slide=OPTIONS["slide"], watermark=OPTIONS["delay"],
                           sink=batch_sink("noop", batch_col=None), checkpoint=f"{scratch}/c2",
                           entity="event_type", trigger={"availableNow": True})
    job.awaitTermination(300)
    shown = {p.batchId: p.eventTime["watermark"] for p in job.recentProgress if p.numInputRows}
    assert len(shown) == S.ARRIVALS
    for i in range(1, S.ARRIVALS - 1):
        # what a batch shows is what the late filter of the next one uses
        stamp = dt.datetime.strptime(shown[i], "%Y-%m-%dT%H:%M:%S.%fZ").replace(tzinfo=dt.timezone.utc)
        assert round(stamp.timestamp() * 1000) == mine[i + 1].us // 1000
    assert sum(r.n_late for r in mine.values()) > 0
    dropped = {p.batchId: sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
               for p in job.recentProgress}
    assert {i for i, n in dropped.items() if n} == {i for i, r in mine.items() if r.n_closed}


def test_sliced_replay_equals_the_single_batch(spark, monkeypatch):
    want = sorted(map(tuple, D.q_stream_heat_replay(spark, SF_SMALL).collect()))
    monkeypatch.setattr(D, "SLICE_ROWS", 300)
    assert sorted(map(tuple, D.q_stream_heat_replay(spark, SF_SMALL).collect())) == want


def test_slices_in_a_store_without_file_times(spark, monkeypatch):
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    monkeypatch.setattr(D, "set_file_time", lambda *a: False)
    path, _ = D.time_slices(events, "ts", 3, files=2)
    files = D.list_files(spark, path)
    files.sort(key=lambda f: os.stat(f.removeprefix("file:")).st_mtime_ns)
    numbers = [int(f.split("slice_no=")[1].split("/")[0]) for f in files]
    assert numbers == sorted(numbers) and set(numbers) == {0, 1, 2} and len(files) <= 6
    assert spark.read.parquet(path).drop("slice_no").exceptAll(events).count() == 0


def test_replay_in_the_wrong_order_fails_loudly(spark, monkeypatch):
    """Slices whose files carry times in reverse: rows come after their windows closed."""
    keep, plain = D.set_file_time, D.time_slices

    def reverse(events, col, n):
        path, seconds = plain(events, col, n, 1)
        for f in D.list_files(spark, path):
            number = int(f.split("slice_no=")[1].split("/")[0])
            keep(spark, f, 1_700_000_000_000 - 10_000 * number)
        return path, seconds
    monkeypatch.setattr(D, "SLICE_ROWS", 200)
    monkeypatch.setattr(D, "SLICE_FILES", 1)
    monkeypatch.setattr(D, "time_slices", reverse)
    monkeypatch.setattr(D, "slice_stream", lambda s, p, schema: read_event_stream(
        s, "files", path=p, file_format="parquet", file_schema=schema, max_per_trigger=1))
    with pytest.raises(RuntimeError, match="after their windows had closed"):
        D.q_stream_window_replay(spark, SF_SMALL)

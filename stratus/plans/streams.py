"""Streaming runs whose course is the result: what came late, what a restart repeats,
and what the state holds. All of them replay ``events`` through the window job.

* ``late_data_report``    each micro-batch with its watermark and its late rows
* ``late_data_windows``   the windows that Spark's own late filter leaves
* ``stream_restart``      a run that fails, restarts and finds new files
* ``entity_list_stream``  windows of listed entities only, and the state they take
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratus.functions.calendar import utc_wall_clock
from stratus.operators.windows import latest_per_window
from stratus.plans.driver import _value_aggs, slice_stream, time_slices
from stratus.session import delete_path, list_files, materialize, move_path, scratch_path
from stratus.sinks.writers import batch_sink
from stratus.sources.events import read_event_stream
from stratus.sources.tables import table
from stratus.streaming.late import late_router, read_batches, read_rows
from stratus.streaming.runner import start_window_job

SIZE, SLIDE, DELAY = "60 minutes", "5 minutes", "5 minutes"
KEYS = ("event_type", "window_start")


def _final(emitted: DataFrame, columns) -> DataFrame:
    """The last emission of each window, times as UTC wall clock."""
    last = latest_per_window(emitted.drop("window_end"), keys=KEYS)
    start = utc_wall_clock("window_start")
    return last.select("event_type", start.alias("window_start"),
                       (start + F.expr(f"INTERVAL {SIZE}")).alias("window_end"), *columns)


def _finish(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


# --- late data ------------------------------------------------------------------

#: Micro-batches of the replay, each a file, in the order of arrival.
ARRIVALS = 6


def with_arrival(events: DataFrame) -> DataFrame:
    """Events with the time at which they arrive: a tenth comes 8 days late, a fiftieth 15."""
    days = (F.when(F.col("event_id") % 10 == 3, 8).when(F.col("event_id") % 50 == 7, 15)
            .otherwise(0))
    return events.withColumn("arrival", F.col("ts") + F.make_dt_interval(days=days))


def _arrivals(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """Files of the arrivals, and the stream that takes one a micro-batch."""
    events = with_arrival(table(spark, sf, "events").select("event_id", "ts", "event_type", "value"))
    path, _ = time_slices(events, "arrival", ARRIVALS, files=1)
    return path, slice_stream(spark, path, events.schema, files=1).withColumnRenamed("ts", "event_time")


def q_late_data_report(spark: SparkSession, sf: str) -> DataFrame:
    """Every micro-batch, with one row for each of its late rows (or one without)."""
    path, stream = _arrivals(spark, sf)
    run = scratch_path(spark, "late")
    router = late_router(f"{run}/out", size=SIZE, slide=SLIDE, delay=DELAY)
    _finish(stream.writeStream.foreachBatch(router).option("checkpointLocation", f"{run}/checkpoint")
            .trigger(availableNow=True).start())
    late = read_rows(spark, f"{run}/out").where("late").select(
        F.col("batch_id").cast("long").alias("batch_id"), "event_id",
        utc_wall_clock("event_time").alias("ts"))
    batches = read_batches(spark, f"{run}/out").select(
        "batch_id", utc_wall_clock("watermark").alias("watermark"), "n_rows", "n_late", "n_closed")
    report = materialize(batches.where("n_rows > 0").join(late, "batch_id", "left"), "report")
    delete_path(spark, run)
    delete_path(spark, path)
    return report


def q_late_data_windows(spark, sf):
    """The same replay through the stateful window job."""
    path, stream = _arrivals(spark, sf)
    run = scratch_path(spark, "late")
    _finish(start_window_job(stream, aggs=_value_aggs(), size=SIZE, slide=SLIDE, watermark=DELAY,
                             sink=batch_sink("parquet", path=f"{run}/out", idempotent=True),
                             checkpoint=f"{run}/checkpoint", entity="event_type",
                             trigger={"availableNow": True}))
    last = materialize(_final(spark.read.parquet(f"{run}/out"), _value_aggs()), "last")
    delete_path(spark, run)
    delete_path(spark, path)
    return last


# --- restart --------------------------------------------------------------------

RESTART_SLICES = 4


def q_stream_restart(spark, sf):
    """Half of the time slices are there at first. The run stops in its second
    micro-batch, after the sink has written and before Spark knows. It starts again from
    its checkpoint, with the other half beside. ``n_emissions``: how often the sink holds a window."""
    events = table(spark, sf, "events")
    path, seconds = time_slices(events, "ts", RESTART_SLICES, files=1)
    run = scratch_path(spark, "restart")
    slices = sorted({int(re.search(r"slice_no=(\d+)", f)[1]) for f in list_files(spark, path)})

    def arrive(numbers):
        for i in numbers:
            move_path(spark, f"{path}/slice_no={i}", f"{run}/in/slice_no={i}")
    store = batch_sink("parquet", path=f"{run}/out", idempotent=True)

    def stopping(batch, batch_id):
        store(batch, batch_id)
        if batch_id == 1:
            raise RuntimeError("stopped after the write")

    def start(sink):
        stream = slice_stream(spark, f"{run}/in", events.schema, files=1)
        return start_window_job(stream.withColumnRenamed("ts", "event_time"), aggs=_value_aggs(),
                                size=SIZE, slide=SLIDE, watermark=f"{seconds} seconds", sink=sink,
                                checkpoint=f"{run}/checkpoint", entity="event_type",
                                trigger={"availableNow": True})
    half = -(-len(slices) // 2)
    arrive(slices[:half])
    try:
        start(stopping).awaitTermination()
    except StreamingQueryException as stop:
        if "stopped after the write" not in str(stop):
            raise
    arrive(slices[half:])
    _finish(start(store))
    emitted = spark.read.parquet(f"{run}/out")
    times = (emitted.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_emissions"))
             .withColumn("window_start", utc_wall_clock("window_start")))
    last = materialize(_final(emitted, _value_aggs()).join(times, list(KEYS)), "last")
    delete_path(spark, run)
    delete_path(spark, path)
    return last


# --- listed entities --------------------------------------------------------------

LISTED = ("view", "purchase")


def q_entity_list_stream(spark, sf):
    """Windows of the listed event types, with the most rows that the state ever held."""
    events = table(spark, sf, "events")
    run = scratch_path(spark, "listed")
    stream = read_event_stream(spark, "files", path=f"{sf.rstrip('/')}/events.{{parquet}}",
                               file_format="parquet", file_schema=events.schema)
    query = start_window_job(stream.withColumnRenamed("ts", "event_time"), aggs=_value_aggs(),
                             size=SIZE, slide=SLIDE, watermark=DELAY,
                             sink=batch_sink("parquet", path=f"{run}/out", idempotent=True),
                             checkpoint=f"{run}/checkpoint", entity="event_type", entities=LISTED,
                             trigger={"availableNow": True})
    _finish(query)
    state = max(op.numRowsTotal for p in query.recentProgress for op in p.stateOperators)
    last = materialize(_final(spark.read.parquet(f"{run}/out"), _value_aggs())
                       .withColumn("state_rows", F.lit(state).cast("long")), "last")
    delete_path(spark, run)
    return last


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "late_data_report": q_late_data_report,
    "late_data_windows": q_late_data_windows,
    "stream_restart": q_stream_restart,
    "entity_list_stream": q_entity_list_stream,
}

"""Start a watermarked sliding-window aggregation as a streaming query.

source (Kafka / files) → [entity filter] → event time as TIMESTAMP →
watermark → sliding windows (stateful, update mode) → ``foreachBatch`` sink
that applies stateless post-processing (rules, baseline join) per batch.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratus.functions.calendar import to_event_time
from stratus.operators.windows import sliding_stats


def window_stream(events: DataFrame, *, aggs: Mapping[str, Column], size: str, slide: str,
                  watermark: str, time_col: str = "event_time", entity: str = "city",
                  entities: Sequence[str] | None = None) -> DataFrame:
    """The streaming (or batch) window aggregate of an event frame.

    Event time is converted to TIMESTAMP (watermarks reject NTZ); rows with
    NULL event time never enter a window. ``entities`` restricts to a list
    (the reference's per-city jobs); ``None`` serves every entity in one
    query — state then grows with entities × open windows, bounded by the
    watermark."""
    df = events
    if entities is not None:
        df = df.filter(F.col(entity).isin(*entities))
    df = df.withColumn(time_col, to_event_time(df, time_col))
    return sliding_stats(df, time_col, entity, aggs, size=size, slide=slide,
                         watermark=watermark)


@contextmanager
def _settings(spark: SparkSession, values: Mapping[str, str]):
    """Session settings for the length of a block."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def dropped_rows(query: StreamingQuery) -> int:
    """Rows that came too late for their window and were dropped so far."""
    return sum(int(op.numRowsDroppedByWatermark) for p in query.recentProgress
               for op in p.stateOperators)


ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start_window_job(events: DataFrame, *, aggs: Mapping[str, Column], size: str, slide: str,
                     watermark: str, sink, checkpoint: str, time_col: str = "event_time",
                     entity: str = "city", entities: Sequence[str] | None = None,
                     trigger: Mapping | None = None, query_name: str | None = None,
                     state_store: str | None = None, state_partitions: int | None = None
                     ) -> StreamingQuery:
    """Start the job; ``checkpoint`` (a shared, durable folder) is required —
    offsets, commits and window state live there, so a restarted query
    resumes without losing or re-emitting finished batches.

    ``trigger``: e.g. ``{"availableNow": True}`` to replay what is there and
    stop, ``{"processingTime": "3 seconds"}`` for a paced live run.

    ``state_store='rocksdb'`` keeps window state in RocksDB on executor disk
    instead of the JVM heap (large state: many entities × open windows).
    ``state_partitions`` sets the shuffle partitions of the stateful
    aggregation; it is fixed by the first run of a checkpoint, later values
    are ignored by Spark for that checkpoint."""
    if not checkpoint:
        raise ValueError("a checkpoint location is required")
    if state_store not in (None, "rocksdb"):
        raise ValueError("state_store is 'rocksdb' or None")
    settings = {}
    if state_store:
        settings["spark.sql.streaming.stateStore.providerClass"] = ROCKSDB_PROVIDER
    if state_partitions:
        settings["spark.sql.shuffle.partitions"] = str(state_partitions)
    windows = window_stream(events, aggs=aggs, size=size, slide=slide, watermark=watermark,
                            time_col=time_col, entity=entity, entities=entities)
    writer = (windows.writeStream.outputMode("update").foreachBatch(sink)
              .option("checkpointLocation", checkpoint))
    if query_name:
        writer = writer.queryName(query_name)
    if trigger:
        writer = writer.trigger(**dict(trigger))
    with _settings(events.sparkSession, settings):
        return writer.start()       # the query runs in a copy of the session as it is now

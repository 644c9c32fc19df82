"""Late rows of a stream as an output of their own.

Spark drops a row from each window that its late filter counts as closed, and tells
only how many. :func:`late_router` applies the same rule to the rows themselves, as a
``foreachBatch`` function: the filter of batch n uses the watermark of batch n - 1,
that is the largest event time of batches up to n - 2 less the delay (whole
milliseconds; none before), and a window is closed once it ends at or before it. A row
none of whose windows is open is late.

Under ``path``: ``rows`` (every row with batch_id, ``late`` and its open windows'
number) and ``batches`` (one row a batch). Both are partitioned by batch id and
overwritten when a batch comes again, so a restart repeats nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratus.functions.calendar import to_event_time
from stratus.operators.windows import duration_seconds
from stratus.session import path_exists

BATCHES = ("batch_id long, watermark timestamp, n_rows long, n_untimed long, n_late long, "
           "n_closed long, last_time timestamp")


def open_windows(time: Column, watermark: Column, size: int, slide: int) -> Column:
    """Of the windows (seconds) that hold ``time``, those that end after ``watermark``
    (null: all). Windows end at a multiple of the slide after the time, up to its size."""
    step = slide * 1_000_000
    last = F.floor(F.unix_micros(time) / step) * step + size * 1_000_000
    total = size // slide
    still = F.ceil((last - F.unix_micros(watermark)) / step)
    return F.when(watermark.isNull(), F.lit(total)).otherwise(
        F.greatest(F.lit(0), F.least(F.lit(total), still))).cast("int")


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """The per-batch table of a :func:`late_router`."""
    if not path_exists(spark, f"{path}/batches"):
        return spark.createDataFrame([], BATCHES)
    return spark.read.schema(BATCHES).parquet(f"{path}/batches")


def late_router(path: str, *, size: str, slide: str, delay: str, time_col: str = "event_time"
                ) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that marks late rows; see the module."""
    size_s, slide_s = duration_seconds(size), duration_seconds(slide)
    behind = duration_seconds(delay) * 1_000_000

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = (read_batches(spark, path).where(F.col("batch_id") <= batch_id - 2)
                .agg(F.unix_millis(F.max("last_time"))).first()[0])
        watermark = (F.lit(None).cast("timestamp") if seen is None else
                     F.timestamp_micros(F.lit(seen * 1000 - behind)))
        rows = batch.withColumn(time_col, to_event_time(batch, time_col))
        rows = rows.withColumn("open_windows", F.when(
            F.col(time_col).isNotNull(), open_windows(F.col(time_col), watermark, size_s, slide_s)))
        rows = rows.withColumn("late", F.coalesce(F.col("open_windows") == 0, F.lit(False)))
        place = f"{path}/rows/batch_id={batch_id}"
        rows.write.mode("overwrite").parquet(place)
        total = size_s // slide_s
        (spark.read.schema(rows.schema).parquet(place).agg(
            watermark.alias("watermark"), F.count(F.lit(1)).alias("n_rows"),
            F.count_if(F.col(time_col).isNull()).alias("n_untimed"),
            F.count_if("late").alias("n_late"),
            F.coalesce(F.sum(total - F.col("open_windows")), F.lit(0)).alias("n_closed"),
            F.max(time_col).alias("last_time"))
         .write.mode("overwrite").parquet(f"{path}/batches/batch_id={batch_id}"))
    return run


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a :func:`late_router` with batch_id, late and open_windows."""
    return spark.read.parquet(f"{path}/rows")

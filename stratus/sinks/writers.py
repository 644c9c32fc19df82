"""Batch writers and the ``foreachBatch`` sink."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratus.session import delete_path, path_exists
from stratus.sinks.contracts import conform


def write_observations(df: DataFrame, path: str, *,
                       partition_cols: Sequence[str] = ("year", "month"),
                       mode: str = "overwrite", max_records_per_file: int | None = None) -> None:
    """Write an enriched table partitioned by ``partition_cols``.

    ``rebalance`` (not ``repartition``) on the partition columns: AQE groups
    rows of one partition directory together but splits a hot one into
    advisory-size tasks, so one month with a third of the data does not end
    up in one task or one huge file. Overwrite is dynamic: only the
    partitions present in ``df`` are replaced (incremental reloads)."""
    out = df.hint("rebalance", *partition_cols)
    writer = (out.write.mode(mode).option("partitionOverwriteMode", "dynamic")
              .partitionBy(*partition_cols))
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    writer.parquet(path)


def write_jdbc(df: DataFrame, table: str, url: str, properties: Mapping[str, str], *,
               mode: str = "overwrite", num_partitions: int | None = None,
               batch_size: int = 10000) -> None:
    """Write a result table over JDBC. Credentials come from the caller
    (``properties``: user, password, driver …), never from literals here.
    ``num_partitions`` caps concurrent connections to the database."""
    out = df.coalesce(num_partitions) if num_partitions else df
    (out.write.format("jdbc").option("url", url).option("dbtable", table)
        .option("batchsize", batch_size).options(**dict(properties))
        .mode(mode).save())


def write_table(df: DataFrame, fmt: str, options: Mapping[str, str] | None = None, *,
                mode: str = "append", path: str | None = None) -> None:
    """Write with any DataFrame source (parquet, jdbc, a search-index
    connector …); the format is configuration."""
    writer = df.write.format(fmt).options(**dict(options or {})).mode(mode)
    writer.save(path) if path else writer.save()


def batch_sink(fmt: str, options: Mapping[str, str] | None = None, *, mode: str = "append",
               path: str | None = None, transform: Callable[[DataFrame], DataFrame] | None = None,
               contract: T.StructType | None = None, batch_col: str | None = "batch_id",
               preview: int = 0, with_computed_at: bool = False,
               idempotent: bool = False) -> Callable[[DataFrame, int], None]:
    """Build a ``foreachBatch`` function.

    Per micro-batch: apply ``transform`` (rules, baseline join …), tag rows
    with the batch id (update mode re-emits a window in every batch that
    changes it; the id lets readers keep the latest, see
    ``latest_per_window``, and makes retried batches recognisable), optionally
    stamp processing time, conform to ``contract``, persist once, skip empty
    batches without a full count, print a bounded preview, write, unpersist.

    ``idempotent`` (path sinks): each micro-batch goes to its own
    ``batch_col=N`` partition written with dynamic overwrite, so a batch
    re-run after a failure replaces its earlier output instead of adding a
    second copy — exactly-once files on top of the at-least-once callback.
    """
    if idempotent and not (path and batch_col):
        raise ValueError("idempotent writes need a path and a batch column")
    def _sink(batch_df: DataFrame, batch_id: int) -> None:
        out = transform(batch_df) if transform else batch_df
        if batch_col:
            out = out.withColumn(batch_col, F.lit(batch_id).cast(T.LongType()))
        if with_computed_at:
            out = out.withColumn("computed_at", F.current_timestamp())
        if contract is not None:
            out = conform(out, contract)
        out = out.persist()
        try:
            if out.isEmpty():
                return
            if preview:
                out.show(preview, truncate=False)
            if idempotent:
                (out.write.format(fmt).options(**dict(options or {})).mode("overwrite")
                    .option("partitionOverwriteMode", "dynamic").partitionBy(batch_col)
                    .save(path))
            else:
                write_table(out, fmt, options, mode=mode, path=path)
        finally:
            out.unpersist()
    return _sink


def replace_partition(df: DataFrame, path: str, **values: int | str) -> None:
    """Replace one partition (``year=1996, month=3``) of a table that
    :func:`write_observations` wrote, and nothing else.

    A row of another partition fails the job before anything is replaced (dynamic
    overwrite would silently replace that row's partition too). Without rows the
    partition is removed."""
    inside = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in values.items()])
    place = "/".join(f"{c}={v}" for c, v in values.items())
    if df.isEmpty():
        delete_path(df.sparkSession, f"{path}/{place}")
        return
    checked = df.withColumns({c: F.when(inside, F.col(c)).otherwise(F.raise_error(F.lit(
        f"a row lies outside {place}")).cast(df.schema[c].dataType)) for c in values})
    write_observations(checked, path, partition_cols=tuple(values))


def write_ordered(df: DataFrame, path: str, by: Sequence[str], *, files: int | None = None) -> None:
    """Write ``df`` sorted by ``by`` (``name`` or ``name:desc``) as files whose ranges do
    not overlap: file order and position in a file are the order of the table.
    Each task sorts one range; rows equal in ``by`` are in one file."""
    sorts = [F.col(c).desc_nulls_last() if way == "desc" else F.col(c).asc_nulls_first()
             for c, _, way in (item.partition(":") for item in by)]
    dealt = df.repartitionByRange(files, *sorts) if files else df.repartitionByRange(*sorts)
    (dealt.sortWithinPartitions(*sorts).write.mode("overwrite")
     .option("maxRecordsPerFile", 0).parquet(path))


def read_ordered(spark: SparkSession, path: str, out: str = "row_no") -> DataFrame:
    """The rows that :func:`write_ordered` wrote with their place in the whole order
    (``out``, from 1), from file and position alone: nothing is sorted again. One count a
    file is added up; the counts are broadcast."""
    rows = spark.read.parquet(path).select(
        "*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    counts = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    number = F.regexp_extract("_file", r"part-(\d+)", 1).cast("long")
    before = Window.orderBy(number).rowsBetween(Window.unboundedPreceding, -1)     # one row a file
    starts = counts.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (rows.join(F.broadcast(starts), "_file")
            .withColumn(out, F.col("_start") + F.col("_at") + 1).drop("_file", "_at", "_start"))


LEDGER = "batch_id long, computed_at timestamp"


def once_per_batch(sink: Callable[[DataFrame, int], None], ledger: str,
                   stamp_col: str = "computed_at") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that hands every batch id to ``sink`` once.

    ``foreachBatch`` is at least once: after a failure a batch comes again. A batch that
    the ledger holds is skipped, also an empty one. Its entry is written after the
    sink, so a batch that failed in between comes to the sink a second time: with an
    idempotent sink each row is stored once in every case. Rows get the
    batch's processing time in ``stamp_col``, later than that of all entries before it
    even when the clock steps back, so stamps order the batches."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        entries = read_ledger(spark, ledger)
        if not entries.where(F.col("batch_id") == batch_id).isEmpty():
            return
        last = entries.agg(F.max(F.unix_micros("computed_at"))).first()[0] or 0
        stamp = F.timestamp_micros(F.lit(max(time.time_ns() // 1000, last + 1)))
        sink(batch.withColumn(stamp_col, stamp), batch_id)
        (spark.range(1).select(stamp.alias("computed_at"))
         .write.mode("overwrite").parquet(f"{ledger}/batch_id={batch_id}"))
    return run


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """The batches that a :func:`once_per_batch` sink has stored, and when."""
    if not path_exists(spark, ledger):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(ledger).select("batch_id", "computed_at")

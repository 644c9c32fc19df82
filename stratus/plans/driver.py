"""Every operator bound to the driver tables (the ``queries()`` registry).

Mapping (entity / time / measures):

* hour-level operators run on ``events`` (entity ``user_id`` or
  ``event_type``, time ``ts``, measure ``value``, integer ``k`` from
  ``props``);
* day/season/year operators run on lineitem ⋈ supplier ⋈ nation (entity
  ``n_name``, time ``l_shipdate``);
* baselines come from ``lineitem`` (and ``orders``) per (year, month).

Means and sums use the exact decimal form (``scale=2``: every measure has at
most two decimals), so results do not depend on partitioning and match the
SQL oracle bit for bit.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratus.operators.baseline import add_deviation, monthly_baseline, versus_baseline
from stratus.operators.buckets import bucket_summary, pearson, quantile_bucket
from stratus.operators.changes import season_step_change, season_yoy_change
from stratus.operators.enrich import enrich
from stratus.operators.profiles import (
    calendar_profile, extreme_days_rank, flagged_days_rank, flagged_hours_rank,
    hot_day_cooccurrence, season_vs_entity_mean,
)
from stratus.operators.ranking import distinct_entities, rank_within
from stratus.operators.rollups import diurnal_oscillation_rank, diurnal_range_rank
from stratus.operators.rules import flood_rule, heat_rule, wind_rule
from stratus.functions.calendar import utc_wall_clock
from stratus.functions.numeric import mean_exact
from stratus.operators.windows import latest_per_window, pane_sliding_stats
from stratus.session import (
    delete_path, list_files, materialize, scratch_path, set_file_time,
)
from stratus.sinks.writers import batch_sink
from stratus.sources.events import read_event_stream
from stratus.sources.tables import event_observations, shipment_observations, table
from stratus.streaming.runner import dropped_rows, start_window_job

SCALE = 2  # decimals present in every driver-table measure

# --- query parameters (thresholds chosen so every branch occurs) -----------
FLAG_DISCOUNT_MIN = 0.08          # flagged day: l_discount > 0.08
EXTREME_QTY_LOW = 2               # daily min quantity below → "low" day
EXTREME_QTY_HIGH = 49             # daily max quantity above → "high" day
FLAG_TAX_MIN = 0.04               # flagged hour: l_tax > 0.04 and
FLAG_DISCOUNT_MAX = 0.05          #               l_discount < 0.05
HOT_PRICE_MIN = 60000             # "hot" day: max l_extendedprice > 60000
WET_QTY_MIN = 50                  # "wet" day: daily sum l_quantity > 50
LARGE_VALUE_MIN = 3               # enrich flag on the converted value
# ---------------------------------------------------------------------------


def _events(spark, sf):
    return event_observations(spark, sf)


def _ship(spark, sf):
    return shipment_observations(spark, sf)


def q_enrich(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    return enrich(ev, time_col="ts", entity_col="event_type",
                  conversions={"value": (3.6, 2)},
                  flags={"is_large": F.col("value") > LARGE_VALUE_MIN,
                         "is_large_view": (F.col("value") > LARGE_VALUE_MIN)
                         & (F.col("event_type") == "view")},
                  drop=("props",))


def q_diurnal_range_rank(spark, sf):
    return diurnal_range_rank(_events(spark, sf), "user_id", "value", scale=SCALE,
                              names=("avg_range", "max_day_range", "min_day_range", "rank"))


def q_top_k_range(spark, sf):
    return diurnal_range_rank(_events(spark, sf), "user_id", "value", scale=SCALE, top=10,
                              names=("avg_range", "max_day_range", "min_day_range", "rank"))


def q_order_ranks(spark, sf):
    """Ranks over an entity as large as the table: orders by total price."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    orders = rank_within(orders, [("o_totalprice", True)], method="rank", out="price_rank")
    orders = rank_within(orders, ["o_orderpriority"], method="dense_rank", out="priority_rank")
    return rank_within(orders, [("o_totalprice", True), "o_orderkey"], method="ntile", n=100,
                       partition_by=["o_orderpriority"], out="price_percentile")


def q_calendar_profile(spark, sf):
    return calendar_profile(_ship(spark, sf), "n_name", {
        "avg_quantity": ("l_quantity", 1),
        "avg_price": ("l_extendedprice", 1),
        "avg_daily_discount": ("l_discount", 24),
        "avg_tax": ("l_tax", 1),
        "avg_discount": ("l_discount", 1),
    }, period="month", scale=SCALE)


def _with_flags(df):
    return (df.withColumn("is_flag_day", F.col("l_discount") > FLAG_DISCOUNT_MIN)
              .withColumn("is_flag_hour", (F.col("l_tax") > FLAG_TAX_MIN)
                          & (F.col("l_discount") < FLAG_DISCOUNT_MAX)))


def q_flagged_days_rank(spark, sf):
    return flagged_days_rank(_with_flags(_ship(spark, sf)), "n_name", "is_flag_day",
                             names=("flagged_days", "rank_in_season"))


def q_extreme_days_rank(spark, sf):
    return extreme_days_rank(_ship(spark, sf), "n_name", "l_quantity",
                             low=EXTREME_QTY_LOW, high=EXTREME_QTY_HIGH,
                             names=("total_extreme_days", "extreme_low_days",
                                    "extreme_high_days", "rank_in_year"))


def q_season_yoy_change(spark, sf):
    return season_yoy_change(_ship(spark, sf), "n_name", {
        "avg_price": ("l_extendedprice", 1),
        "avg_daily_quantity": ("l_quantity", 24),
        "avg_tax": ("l_tax", 1),
    }, {"price_change_vs_prev_year": "avg_price",
        "quantity_change_vs_prev_year": "avg_daily_quantity"}, scale=SCALE)


def q_season_step_change(spark, sf):
    return season_step_change(_ship(spark, sf), "n_name", {
        "avg_quantity": ("l_quantity", 1),
        "avg_discount": ("l_discount", 1),
        "avg_tax": ("l_tax", 1),
    }, "avg_quantity", out="quantity_change_vs_prev_season", scale=SCALE)


_HOUR_NAMES = ("flagged_count", "total_count", "flagged_pct")


def q_flagged_hours_rank(spark, sf):
    return flagged_hours_rank(_with_flags(_ship(spark, sf)), "n_name", "is_flag_hour",
                              names=(*_HOUR_NAMES, "rank_in_season"))


def q_season_vs_entity_mean(spark, sf):
    return season_vs_entity_mean(_with_flags(_ship(spark, sf)), "n_name", "is_flag_hour",
                                 names=(*_HOUR_NAMES, "entity_avg_count",
                                        "diff_from_entity_avg", "vs_entity_avg"))


def q_hot_day_cooccurrence(spark, sf):
    return hot_day_cooccurrence(
        _ship(spark, sf), "n_name", "l_extendedprice", "l_quantity",
        hot=HOT_PRICE_MIN, wet=WET_QTY_MIN, scale=SCALE,
        names=("total_hot_days", "hot_days_with_high_qty", "total_qty_on_hot_days",
               "high_qty_pct_yearly", "total_hot_days_all_years",
               "total_hot_high_qty_days_all_years", "total_qty_all_years",
               "high_qty_pct_all_years"))


def q_diurnal_oscillation_rank(spark, sf):
    ev = _events(spark, sf).withColumn("week", F.to_date(F.date_trunc("week", "ts")))
    return diurnal_oscillation_rank(ev, "user_id", "value", period="week", scale=SCALE,
                                    names=("avg_oscillation", "max_oscillation",
                                           "min_oscillation", "rank_in_week",
                                           "overall_avg_oscillation", "overall_rank"))


_BUCKET_MEANS = {"avg_quantity": ("l_quantity", 1),
                 "avg_daily_discount": ("l_discount", 24),
                 "avg_price": ("l_extendedprice", 1)}


def q_quantile_bucket(spark, sf):
    return quantile_bucket(_ship(spark, sf), "n_name", _BUCKET_MEANS, "avg_daily_discount",
                           names=("discount_quartile", "quartile_label"), scale=SCALE)


def q_bucket_summary(spark, sf):
    return bucket_summary(q_quantile_bucket(spark, sf), {
        "avg_quantity_in_quartile": "avg_quantity",
        "avg_daily_discount_in_quartile": "avg_daily_discount",
        "avg_price_in_quartile": "avg_price",
    }, keys=("discount_quartile", "quartile_label"), scale=SCALE)


def q_pearson(spark, sf):
    return pearson(_ship(spark, sf), "l_quantity", "l_extendedprice", digits=10)


def q_pearson_nulls(spark, sf):
    """Either side missing in some rows."""
    df = _ship(spark, sf).withColumns({
        "x": F.when(F.col("l_quantity") > 5, F.col("l_quantity")),
        "y": F.when(F.col("l_discount") < 0.07, F.col("l_extendedprice"))})
    return pearson(df, "x", "y", by=["n_name"], digits=10)


def q_pearson_by_entity(spark, sf):
    return pearson(_ship(spark, sf), "l_quantity", "l_extendedprice", by=["n_name"], digits=10)


def q_distinct_entities(spark, sf):
    return distinct_entities(_ship(spark, sf), "n_name")


# --- windows over the event log --------------------------------------------
# Batch windows are built from 5-minute panes (pane_sliding_stats): every
# event is aggregated once, then pane partials are copied into the windows
# that contain them. The streaming jobs use the same aggregates per window.

def _windows(spark, sf, size, aggs, rounding=None, events=None):
    ev = _events(spark, sf) if events is None else events
    return pane_sliding_stats(ev, "ts", "event_type", aggs, size=size, slide="5 minutes",
                              scale=SCALE, rounding=rounding)


def q_sliding_stats(spark, sf):
    return _windows(spark, sf, "60 minutes", {
        "avg_value": ("mean", "value"),
        "min_value": ("min", "value"),
        "max_value": ("max", "value"),
        "event_count": ("count", None),
    }, {"avg_value": 3})


def _lineitem_months(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.withColumns({"year": F.year("l_shipdate"), "month": F.month("l_shipdate")})


def q_monthly_baseline(spark, sf):
    return monthly_baseline(_lineitem_months(spark, sf),
                            {"hist_avg_quantity": "l_quantity"}, scale=SCALE)


def q_value_vs_baseline(spark, sf):
    """60/5 windows of ``value`` against every year of the window's month of
    the lineitem quantity baseline (the temperature-vs-history job)."""
    w = _windows(spark, sf, "60 minutes", {
        "stream_avg_value": ("mean", "value"),
        "event_count": ("count", None),
    }, {"stream_avg_value": 3})
    base = q_monthly_baseline(spark, sf)
    out = versus_baseline(w, base)
    out = add_deviation(out, "stream_avg_value", "hist_avg_quantity")
    return out.select("event_type", "window_start", "window_end", "hist_year", "hist_month",
                      "stream_avg_value", "hist_avg_quantity", "abs_deviation",
                      "pct_deviation", "event_count")


def _order_baseline(spark, sf):
    orders = table(spark, sf, "orders")
    orders = orders.withColumns({"year": F.year("o_orderdate"),
                                 "month": F.month("o_orderdate")})
    return monthly_baseline(orders, {"hist_avg_totalprice": "o_totalprice"}, scale=SCALE)


def q_k_vs_order_baseline(spark, sf):
    """Same operator on another pair (the pressure-vs-history job): 60/5
    windows of ``k`` against the monthly mean order total."""
    w = _windows(spark, sf, "60 minutes", {
        "stream_avg_k": ("mean", "k"),
        "event_count": ("count", None),
    }, {"stream_avg_k": 3})
    out = versus_baseline(w, _order_baseline(spark, sf))
    out = add_deviation(out, "stream_avg_k", "hist_avg_totalprice")
    return out.select("event_type", "window_start", "window_end", "hist_year", "hist_month",
                      "stream_avg_k", "hist_avg_totalprice", "abs_deviation",
                      "pct_deviation", "event_count")


FLOOD_COLUMNS = ("stream_avg_cloud", "hist_avg_cloud", "cloud_anomaly_pct",
                 "stream_avg_pressure", "stream_min_pressure", "stream_max_pressure",
                 "hist_avg_pressure", "pressure_drop_hpa", "pressure_below_hist",
                 "high_cloud_anomaly", "pressure_drop_alert", "pressure_below_hist_alert",
                 "flood_risk", "event_count")


def _flood_baseline(spark, sf):
    return monthly_baseline(_lineitem_months(spark, sf),
                            {"hist_avg_cloud": "l_quantity",
                             "hist_avg_pressure": "l_quantity"}, scale=SCALE)


def q_flood_rule(spark, sf):
    w = _windows(spark, sf, "90 minutes", {
        "stream_avg_cloud": ("mean", "k"),
        "stream_avg_pressure": ("mean", "value"),
        "stream_min_pressure": ("min", "value"),
        "stream_max_pressure": ("max", "value"),
        "event_count": ("count", None),
    }, {"stream_avg_cloud": 3, "stream_avg_pressure": 3, "stream_min_pressure": 3,
        "stream_max_pressure": 3})
    out = flood_rule(versus_baseline(w, _flood_baseline(spark, sf)))
    return out.select("event_type", "window_start", "window_end", "hist_year", "hist_month",
                      *FLOOD_COLUMNS)


def q_heat_rule(spark, sf):
    w = _windows(spark, sf, "30 minutes", {
        "min_humidity": ("min", "k"),
        "max_humidity": ("max", "k"),
        "avg_humidity": ("mean", "k"),
        "avg_temp": ("mean", "value"),
        "max_temp": ("max", "value"),
    })
    return heat_rule(w).select("event_type", "window_start", "window_end", "min_humidity",
                               "max_humidity", "avg_humidity", "humidity_jump", "avg_temp",
                               "max_temp", "risk_level")


WIND_COLUMNS = ("avg_wind_speed", "min_wind_speed", "max_wind_speed", "wind_speed_rise_pct",
                "avg_gust", "max_gust", "gust_above_avg_pct", "avg_wind_dir",
                "wind_dir_change", "speed_alert", "gust_alert", "direction_alert", "wind_alert")


def _wind_inputs():
    return {"gust": F.col("k").cast(T.DoubleType()), "dir": F.col("k") * 3.6}


def q_wind_rule(spark, sf):
    ev = _events(spark, sf).withColumns(_wind_inputs())
    w = _windows(spark, sf, "30 minutes", {
        "avg_wind_speed": ("mean", "value"),
        "min_wind_speed": ("min", "value"),
        "max_wind_speed": ("max", "value"),
        "avg_gust": ("mean", "gust"),
        "max_gust": ("max", "gust"),
        "avg_wind_dir": ("mean", "dir"),
        "min_wind_dir": ("min", "dir"),
        "max_wind_dir": ("max", "dir"),
    }, {k: 2 for k in ("avg_wind_speed", "min_wind_speed", "max_wind_speed", "avg_gust",
                       "max_gust", "avg_wind_dir", "min_wind_dir", "max_wind_dir")},
        events=ev)
    return wind_rule(w).select("event_type", "window_start", "window_end", *WIND_COLUMNS)


def q_entity_baseline(spark, sf):
    """60/5 windows against the history of the same entity: its own monthly
    mean (the entity-keyed comparison of the alert jobs)."""
    ev = _events(spark, sf)
    w = _windows(spark, sf, "60 minutes", {"stream_avg_value": ("mean", "value"),
                                           "event_count": ("count", None)},
                 {"stream_avg_value": 3})
    base = monthly_baseline(ev, {"hist_avg_value": "value"}, entity="event_type", scale=SCALE)
    base = base.withColumnRenamed("event_type", "hist_type")
    out = versus_baseline(w, base, entity_pair=("event_type", "hist_type"))
    out = add_deviation(out, "stream_avg_value", "hist_avg_value")
    return out.select("event_type", "window_start", "window_end", "hist_year", "hist_month",
                      "stream_avg_value", "hist_avg_value", "abs_deviation", "pct_deviation",
                      "event_count")


# --- the same jobs as streams -------------------------------------------------

#: Slices of an ordered replay at least, rows of one on average at most, and its files.
REPLAY_SLICES, SLICE_ROWS, SLICE_FILES = 3, 4_000_000, 8


def time_slices(events: DataFrame, time_col: str, n: int, files: int = SLICE_FILES
                ) -> tuple[str, int]:
    """Write ``events`` as ``n`` or, in a large table, more successive time
    slices (folders ``slice_no=0`` …) of at most ``files`` files each, for a file
    stream that reads the earliest first. Returns the folder and the slice length
    in seconds.

    One job writes all slices. A file stream goes by modification time, so the
    files then get times in the order of their slices; in a store that keeps none, each
    slice is written again in turn. Rows without a time go to the first slice."""
    spark = events.sparkSession
    first, last, rows = events.agg(F.min(time_col), F.max(time_col), F.count(F.lit(1))).first()
    n = max(n, -(-rows // SLICE_ROWS))
    seconds = int((last - first).total_seconds()) // n + 1 if first else 1
    at = F.floor((F.unix_micros(F.col(time_col).cast("timestamp"))
                  - F.unix_micros(F.lit(first).cast("timestamp"))) / (seconds * 1_000_000))
    dealt = (events.withColumn("slice_no", F.coalesce(at, F.lit(0)).cast("int"))
             .withColumn("_file", F.pmod(F.xxhash64(*events.columns), F.lit(files))))
    path = scratch_path(spark, "slices")
    (dealt.repartition(n * files, "slice_no", "_file").drop("_file")
     .write.partitionBy("slice_no").parquet(path))
    start = int(time.time() * 1000) - 1000 * (n + 1)
    for file in list_files(spark, path):
        if not set_file_time(spark, file, start + 1000 * int(re.search(r"slice_no=(\d+)", file)[1])):
            return _write_in_turn(spark, path, n, files), seconds
    return path, seconds


def _write_in_turn(spark: SparkSession, path: str, n: int, files: int) -> str:
    again = scratch_path(spark, "slices")
    slices = spark.read.parquet(path)
    for i in range(n):
        (slices.where(F.col("slice_no") == i).repartition(files)
         .write.mode("append").partitionBy("slice_no").parquet(again))
    delete_path(spark, path)
    return again


def slice_stream(spark: SparkSession, path: str, schema: T.StructType, files: int = SLICE_FILES
                 ) -> DataFrame:
    """File stream over :func:`time_slices`, a slice's files a micro-batch."""
    return read_event_stream(spark, "files", path=path, file_format="parquet",
                             file_schema=T.StructType([*schema.fields]).add("slice_no", T.IntegerType()),
                             max_per_trigger=files).drop("slice_no")


def _stream_replay(spark, sf, size, aggs, *, transform=None, columns, extra_keys=(),
                   extra=None, slices=0):
    """Replay ``events`` as a file stream (``availableNow``) through the
    watermarked window job — stateful aggregation, update mode,
    ``foreachBatch`` (optionally applying ``transform`` per micro-batch, as
    the alert jobs do) into an idempotent Parquet sink in the shared folder —
    and return the last emission of every window.

    The table may be a file or a folder of files. One of at most ``SLICE_ROWS`` rows is
    one micro-batch, unless ``slices`` asks for more; a larger one is dealt into
    successive time slices first, each about a micro-batch, and the watermark covers
    the disorder inside a slice. So a micro-batch is bounded at any size, and no row
    comes too late for its windows; should one, the replay fails with the
    number of such rows, as they are never dropped unseen."""
    run = scratch_path(spark, "replay")
    events = table(spark, sf, "events")
    slices = max(slices, 2 if events.count() > SLICE_ROWS else 0)
    if slices:
        path, seconds = time_slices(events, "ts", slices)
        watermark = f"{seconds} seconds"
        stream = slice_stream(spark, path, events.schema)
    else:
        # written as a pattern, which a file stream takes for a file and for a folder
        path, watermark = f"{sf.rstrip('/')}/events.{{parquet}}", "5 minutes"
        stream = read_event_stream(spark, "files", path=path, file_format="parquet",
                                   file_schema=events.schema)
    stream = (stream.withColumnRenamed("ts", "event_time")
                    .withColumn("k", F.get_json_object("props", "$.k").try_cast("int")))
    q = start_window_job(stream.withColumns(extra or {}), aggs=aggs, size=size,
                         slide="5 minutes", watermark=watermark,
                         sink=batch_sink("parquet", path=f"{run}/out", idempotent=True,
                                         transform=transform),
                         checkpoint=f"{run}/checkpoint", entity="event_type",
                         trigger={"availableNow": True})
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    if late := dropped_rows(q):
        raise RuntimeError(f"{late} rows came after their windows had closed; "
                           "replay the table in time order (slices)")
    emitted = spark.read.parquet(f"{run}/out").drop("window_end")
    last = latest_per_window(emitted, keys=("event_type", "window_start", *extra_keys))
    start = utc_wall_clock("window_start")
    last = materialize(last.select(
        "event_type", start.alias("window_start"),
        (start + F.expr(f"INTERVAL {size}")).alias("window_end"), *extra_keys, *columns), "last")
    delete_path(spark, run)
    if slices:
        delete_path(spark, path)
    return last


def _value_aggs():
    return {"avg_value": F.round(mean_exact("value", SCALE), 3), "min_value": F.min("value"),
            "max_value": F.max("value"), "event_count": F.count(F.lit(1))}


def q_stream_window_replay(spark, sf):
    """The streaming window job itself on ``events`` (60/5)."""
    return _stream_replay(spark, sf, "60 minutes", _value_aggs(), columns=tuple(_value_aggs()))


def q_stream_ordered_replay(spark, sf):
    """The same in several micro-batches, with a moving watermark."""
    return _stream_replay(spark, sf, "60 minutes", _value_aggs(), columns=tuple(_value_aggs()),
                          slices=REPLAY_SLICES)


def q_stream_heat_replay(spark, sf):
    """The heat alert as a stream: 30/5 windows, rule applied per micro-batch
    in the sink."""
    return _stream_replay(spark, sf, "30 minutes", {
        "min_humidity": F.min("k"),
        "max_humidity": F.max("k"),
        "avg_humidity": mean_exact("k", 0),
        "avg_temp": mean_exact("value", SCALE),
        "max_temp": F.max("value"),
    }, transform=heat_rule, columns=("min_humidity", "max_humidity", "avg_humidity",
                                     "humidity_jump", "avg_temp", "max_temp", "risk_level"))


def _history_replay(spark, sf, base, stream, hist, aggs, size="60 minutes"):
    """Windows compared with a baseline inside the sink."""
    base = materialize(base, "baseline")

    def compare(windows):
        return add_deviation(versus_baseline(windows, base), stream, hist)
    return _stream_replay(spark, sf, size, aggs, transform=compare,
                          extra_keys=("hist_year", "hist_month"),
                          columns=(stream, hist, "abs_deviation", "pct_deviation", "event_count"))


def q_stream_value_history_replay(spark, sf):
    return _history_replay(spark, sf, q_monthly_baseline(spark, sf), "stream_avg_value",
                           "hist_avg_quantity", {
        "stream_avg_value": F.round(mean_exact("value", SCALE), 3),
        "event_count": F.count(F.lit(1))})


def q_stream_k_history_replay(spark, sf):
    return _history_replay(spark, sf, _order_baseline(spark, sf), "stream_avg_k",
                           "hist_avg_totalprice", {
        "stream_avg_k": F.round(mean_exact("k", SCALE), 3),
        "event_count": F.count(F.lit(1))})


def q_stream_flood_replay(spark, sf):
    base = materialize(_flood_baseline(spark, sf), "baseline")
    return _stream_replay(spark, sf, "90 minutes", {
        "stream_avg_cloud": F.round(mean_exact("k", SCALE), 3),
        "stream_avg_pressure": F.round(mean_exact("value", SCALE), 3),
        "stream_min_pressure": F.round(F.min("value"), 3),
        "stream_max_pressure": F.round(F.max("value"), 3),
        "event_count": F.count(F.lit(1)),
    }, transform=lambda w: flood_rule(versus_baseline(w, base)),
        extra_keys=("hist_year", "hist_month"), columns=FLOOD_COLUMNS)


def q_stream_wind_replay(spark, sf):
    mean, low, high = (lambda c: F.round(mean_exact(c, SCALE), 2), lambda c: F.round(F.min(c), 2),
                       lambda c: F.round(F.max(c), 2))
    return _stream_replay(spark, sf, "30 minutes", {
        "avg_wind_speed": mean("value"), "min_wind_speed": low("value"),
        "max_wind_speed": high("value"), "avg_gust": mean("gust"), "max_gust": high("gust"),
        "avg_wind_dir": mean("dir"), "min_wind_dir": low("dir"), "max_wind_dir": high("dir"),
    }, transform=wind_rule, columns=WIND_COLUMNS, extra=_wind_inputs())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "enrich": q_enrich,
    "diurnal_range_rank": q_diurnal_range_rank,
    "top_k": q_top_k_range,
    "calendar_profile": q_calendar_profile,
    "flagged_days_rank": q_flagged_days_rank,
    "extreme_days_rank": q_extreme_days_rank,
    "season_yoy_change": q_season_yoy_change,
    "season_step_change": q_season_step_change,
    "flagged_hours_rank": q_flagged_hours_rank,
    "season_vs_entity_mean": q_season_vs_entity_mean,
    "hot_day_cooccurrence": q_hot_day_cooccurrence,
    "diurnal_oscillation_rank": q_diurnal_oscillation_rank,
    "quantile_bucket": q_quantile_bucket,
    "bucket_summary": q_bucket_summary,
    "pearson": q_pearson,
    "pearson_by_entity": q_pearson_by_entity,
    "distinct_entities": q_distinct_entities,
    "sliding_stats": q_sliding_stats,
    "monthly_baseline": q_monthly_baseline,
    "stream_vs_baseline": q_value_vs_baseline,
    "stream_vs_baseline_orders": q_k_vs_order_baseline,
    "flood_rule": q_flood_rule,
    "heat_rule": q_heat_rule,
    "wind_rule": q_wind_rule,
    "stream_window_replay": q_stream_window_replay,
    "stream_heat_replay": q_stream_heat_replay,
    "stream_ordered_replay": q_stream_ordered_replay,
    "stream_value_history_replay": q_stream_value_history_replay,
    "stream_k_history_replay": q_stream_k_history_replay,
    "stream_flood_replay": q_stream_flood_replay,
    "stream_wind_replay": q_stream_wind_replay,
    "order_ranks": q_order_ranks,
    "pearson_nulls": q_pearson_nulls,
    "entity_baseline": q_entity_baseline,
}

"""Driver tables (TPC-H-like star schema plus an event log) viewed as
observation tables, so every operator can run on them unchanged.

* ``event_observations``: one row per event; entity = user or event type,
  time = ``ts`` (hour-level operators need sub-day times).
* ``shipment_observations``: lineitem ⋈ supplier ⋈ nation; entity = nation
  name, time = ship date (midnight only, so used for day/season/year work).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratus.functions.calendar import day_flag, season_of, season_year
from stratus.operators.joins import join_dimension


_handles: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str, refresh: bool = False) -> DataFrame:
    """Read handle of one driver table. Handles are kept per session and
    path (listing files and reading the footer schema happens once);
    ``refresh=True`` re-lists after the files changed."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if refresh or key not in _handles:
        _handles[key] = spark.read.parquet(path)
    return _handles[key]


def add_calendar(df: DataFrame, ts: str) -> DataFrame:
    """Calendar parts, day flag, season and season-year from ``ts`` (a
    narrow projection: no shuffle)."""
    t = F.col(ts)
    month, year = F.month(t), F.year(t)
    return df.withColumns({
        "year": year, "month": month, "date": F.to_date(t), "hour": F.hour(t),
        "is_day": day_flag(F.hour(t)), "season": season_of(month),
        "winter_season_year": season_year(month, year),
    })


def event_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with calendar features and the integer ``k`` from ``props``."""
    ev = table(spark, sf_dir, "events")
    ev = ev.withColumn("k", F.get_json_object("props", "$.k").try_cast("int"))
    return add_calendar(ev, "ts")


def shipment_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem ⋈ supplier ⋈ nation with calendar features of the ship date.

    Both dimensions go through ``join_dimension``: a side is broadcast only
    while its files are within the byte bound; beyond it the join is shuffled
    on the supplier key. Only the used columns are read."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    sup = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    nat = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("s_nationkey"), "n_name")
    sup_nat = join_dimension(sup, nat, "s_nationkey").select("l_suppkey", "n_name")
    obs = join_dimension(li, sup_nat, "l_suppkey", source=sup).drop("l_suppkey")
    return add_calendar(obs, "l_shipdate")

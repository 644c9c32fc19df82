"""Day-level roll-ups and day/night range rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratus.functions.numeric import mean_exact, sum_exact
from stratus.operators.ranking import rank_top, rank_within


def daily_rollup(df: DataFrame, entity: str, aggs: dict, *, date_col: str = "date",
                 extra_keys: Sequence[str] = ()) -> DataFrame:
    """One row per (entity, day[, extra keys]) with the given aggregates.

    Partial aggregation runs before the shuffle, so the shuffle carries at
    most one row per (map task, entity, day) even for a hot entity."""
    return df.groupBy(entity, date_col, *extra_keys).agg(
        *[expr.alias(name) for name, expr in aggs.items()])


def daily_table(df: DataFrame, entity: str, *, day_night: Sequence[str] = (),
                extremes: Sequence[str] = (), sums: Sequence[str] = (),
                date_col: str = "date", is_day_col: str = "is_day",
                extra_keys: Sequence[str] = (), scale: int | None = None) -> DataFrame:
    """One day-level table serving several day-based operators (one scan of
    the hourly data instead of one per operator). Columns per measure:
    ``_dmax_c`` / ``_nmin_c`` (max over day hours, min over night hours),
    ``_min_c`` / ``_max_c``, ``_sum_c`` (exact with ``scale``). Operators
    accept it through their ``daily`` argument."""
    aggs = {}
    for c in day_night:
        aggs[f"_dmax_{c}"] = F.max(F.when(F.col(is_day_col), F.col(c)))
        aggs[f"_nmin_{c}"] = F.min(F.when(~F.col(is_day_col), F.col(c)))
    for c in extremes:
        aggs[f"_min_{c}"] = F.min(c)
        aggs[f"_max_{c}"] = F.max(c)
    for c in sums:
        aggs[f"_sum_{c}"] = sum_exact(c, scale)
    return daily_rollup(df, entity, aggs, date_col=date_col, extra_keys=extra_keys)


def diurnal_range(df: DataFrame, entity: str, value: str, *, out: str,
                  date_col: str = "date", is_day_col: str = "is_day",
                  extra_keys: Sequence[str] = (), digits: int = 2,
                  daily: DataFrame | None = None) -> DataFrame:
    """Per (entity, day): max of ``value`` over day hours minus min over night
    hours, rounded; days lacking either half are dropped. ``daily``: a
    :func:`daily_table` with ``day_night`` on ``value`` (and the extra keys)."""
    if daily is None:
        daily = daily_table(df, entity, day_night=[value], date_col=date_col,
                            is_day_col=is_day_col, extra_keys=extra_keys)
    hi, lo = F.col(f"_dmax_{value}"), F.col(f"_nmin_{value}")
    return (daily.filter(hi.isNotNull() & lo.isNotNull())
                 .select(entity, date_col, *extra_keys, F.round(hi - lo, digits).alias(out)))


def diurnal_range_rank(df: DataFrame, entity: str, value: str, *,
                       date_col: str = "date", is_day_col: str = "is_day",
                       names: Sequence[str] = ("avg_temp_variation",
                                               "max_single_day_variation",
                                               "min_single_day_variation", "rank"),
                       scale: int | None = None, daily: DataFrame | None = None,
                       top: int | None = None) -> DataFrame:
    """Entities ranked by their mean day–night range (global ``rank``, desc).

    Output: entity, mean, max and min daily range (2 decimals), rank. With
    ``top`` only the rows up to that rank, the others are never ranked."""
    avg_n, max_n, min_n, rank_n = names
    days = diurnal_range(df, entity, value, out="_range", date_col=date_col,
                         is_day_col=is_day_col, daily=daily)
    per_entity = days.groupBy(entity).agg(
        F.round(mean_exact("_range", scale), 2).alias(avg_n),
        F.round(F.max("_range"), 2).alias(max_n),
        F.round(F.min("_range"), 2).alias(min_n))
    if top:
        return rank_top(per_entity, (avg_n, True), top, out=rank_n)
    return rank_within(per_entity, [(avg_n, True)], method="rank", out=rank_n)


def diurnal_oscillation_rank(df: DataFrame, entity: str, value: str, *,
                             period: str = "year", date_col: str = "date",
                             is_day_col: str = "is_day",
                             names: Sequence[str] = ("avg_humidity_oscillation",
                                                     "max_humidity_oscillation",
                                                     "min_humidity_oscillation",
                                                     "rank_in_year",
                                                     "overall_avg_oscillation",
                                                     "overall_rank"),
                             scale: int | None = None,
                             daily: DataFrame | None = None) -> DataFrame:
    """Day–night range per (entity, period): mean/max/min, rank inside each
    period; overall mean of the rounded period means per entity and a global
    rank, attached with a left join.

    ``period`` is any column constant within a day (calendar year in the
    reference)."""
    avg_n, max_n, min_n, rank_n, overall_n, overall_rank_n = names
    days = diurnal_range(df, entity, value, out="_osc", date_col=date_col,
                         is_day_col=is_day_col, extra_keys=[period], daily=daily)
    per_period = days.groupBy(entity, period).agg(
        F.round(mean_exact("_osc", scale), 2).alias(avg_n),
        F.round(F.max("_osc"), 2).alias(max_n),
        F.round(F.min("_osc"), 2).alias(min_n))
    written: list[DataFrame] = []         # the period rows, read by both rankings
    ranked = rank_within(per_period, [(avg_n, True)], partition_by=[period],
                         method="rank", out=rank_n, written=written)
    overall = written[0].groupBy(entity).agg(
        F.round(mean_exact(avg_n, scale), 2).alias(overall_n))
    overall = rank_within(overall, [(overall_n, True)], method="rank", out=overall_rank_n)
    # one row per entity on the right: the join never multiplies rows
    return ranked.join(overall, on=entity, how="left")

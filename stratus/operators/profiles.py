"""Calendar profiles, flagged-day / flagged-hour rankings, extreme-day counts,
entity-mean comparisons and co-occurrence rates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratus.functions.calendar import SEASON_MONTHS, in_season
from stratus.functions.numeric import (
    deviation_class, from_scaled, mean_exact, pct, scaled_long, sum_exact,
)
from stratus.operators.ranking import rank_within
from stratus.operators.rollups import daily_table

# --- Fixed values (reference thresholds and labels) ------------------------
EXTREME_LOW = -10       # daily minimum below this is an extreme cold day
EXTREME_HIGH = 40       # daily maximum above this is an extreme heat day
HOT_DAY_MIN = 30        # daily maximum above this is a hot day
WET_DAY_MIN = 0.1       # daily total above this is a day with precipitation
VS_MEAN_THRESHOLD = 10  # |difference| beyond this is "significantly"
# Class names for the difference from the entity mean, in test order:
# far below, below, far above, above, at the mean.
VS_MEAN_LABELS = ("znacajno ispod proseka", "ispod proseka",
                  "znacajno iznad proseka", "iznad proseka", "prosek")
# ---------------------------------------------------------------------------


def calendar_profile(df: DataFrame, entity: str, means: Mapping[str, tuple[str, float]],
                     *, period: str = "month", digits: int = 2,
                     scale: int | None = None) -> DataFrame:
    """Mean of each measure per (entity, calendar period across all years).

    ``means`` maps output name → (column, factor); factor 24 turns an hourly
    mean into a mean daily total."""
    return df.groupBy(entity, period).agg(*[
        F.round(mean_exact(c, scale) * factor if factor != 1 else mean_exact(c, scale),
                digits).alias(name)
        for name, (c, factor) in means.items()])


def flagged_days_rank(df: DataFrame, entity: str, flag_col: str, *,
                      season: str = "winter", month_col: str = "month",
                      season_year_col: str = "winter_season_year", date_col: str = "date",
                      names: Sequence[str] = ("snow_days_count", "rank_in_winter"),
                      complete_only: bool = False) -> DataFrame:
    """Distinct flagged days per (entity, season-year) within one season,
    dense-ranked (most days first) inside each season-year. Entities with no
    flagged day are absent.

    The season test is written on the month column so a month-partitioned
    table is pruned. ``complete_only`` keeps only season-years in which the
    entity has data in every month of the season (drops the partial first
    and last winters of a history)."""
    count_n, rank_n = names
    in_s = df.filter(in_season(month_col, season))
    if complete_only:
        days = (in_s.groupBy(entity, season_year_col)
                    .agg(F.count_distinct(F.when(F.col(flag_col), F.col(date_col))).alias(count_n),
                         F.count_distinct(month_col).alias("_months"))
                    .filter((F.col("_months") == len(SEASON_MONTHS[season]))
                            & (F.col(count_n) > 0))
                    .drop("_months"))
    else:
        days = (in_s.filter(F.col(flag_col))
                    .groupBy(entity, season_year_col)
                    .agg(F.count_distinct(date_col).alias(count_n)))
    return rank_within(days, [(count_n, True)], partition_by=[season_year_col],
                       method="dense_rank", out=rank_n)


def extreme_days_rank(df: DataFrame, entity: str, value: str, *, low: float = EXTREME_LOW,
                      high: float = EXTREME_HIGH, date_col: str = "date",
                      year_col: str = "year",
                      names: Sequence[str] = ("total_extreme_days", "extreme_cold_days",
                                              "extreme_heat_days", "rank_in_year"),
                      daily: DataFrame | None = None) -> DataFrame:
    """Days whose minimum is below ``low`` or maximum above ``high``, counted
    per (entity, year) — a day may be both cold and hot but counts once in
    the total — dense-ranked per year by the total."""
    total_n, cold_n, heat_n, rank_n = names
    if daily is None:
        daily = daily_table(df, entity, extremes=[value], date_col=date_col,
                            extra_keys=[year_col])
    cold = F.coalesce(F.col(f"_min_{value}") < low, F.lit(False))
    heat = F.coalesce(F.col(f"_max_{value}") > high, F.lit(False))
    counts = (daily.filter(cold | heat)
                   .groupBy(entity, year_col)
                   .agg(F.count(F.lit(1)).alias(total_n),
                        F.count_if(cold).alias(cold_n),
                        F.count_if(heat).alias(heat_n)))
    return rank_within(counts, [(total_n, True)], partition_by=[year_col],
                       method="dense_rank", out=rank_n)


def flagged_hours(df: DataFrame, entity: str, flag_col: str, *, season: str = "winter",
                  month_col: str = "month", season_year_col: str = "winter_season_year",
                  names: Sequence[str] = ("sunny_hours_count", "total_hours",
                                          "sunny_hours_pct"),
                  complete_only: bool = False) -> DataFrame:
    """Flagged hours, all hours and their share per (entity, season-year)
    within one season — the common base of :func:`flagged_hours_rank` and
    :func:`season_vs_entity_mean` (pass it as ``hours`` to share one scan).
    ``complete_only``: only season-years with data in every season month."""
    count_n, total_n, pct_n = names
    aggs = [F.count_if(F.col(flag_col)).alias(count_n), F.count(F.lit(1)).alias(total_n)]
    if complete_only:
        aggs.append(F.count_distinct(month_col).alias("_months"))
    out = (df.filter(in_season(month_col, season))
             .groupBy(entity, season_year_col).agg(*aggs))
    if complete_only:
        out = out.filter(F.col("_months") == len(SEASON_MONTHS[season])).drop("_months")
    return out.withColumn(pct_n, pct(count_n, total_n, 2))


def flagged_hours_rank(df: DataFrame, entity: str, flag_col: str, *, season: str = "winter",
                       month_col: str = "month", season_year_col: str = "winter_season_year",
                       names: Sequence[str] = ("sunny_hours_count", "total_hours",
                                               "sunny_hours_pct", "rank_in_winter"),
                       hours: DataFrame | None = None,
                       complete_only: bool = False) -> DataFrame:
    """Flagged hours, all hours and their share per (entity, season-year) in
    one season; dense rank ascending (fewest flagged hours first). Entities
    with zero flagged hours are kept."""
    if hours is None:
        hours = flagged_hours(df, entity, flag_col, season=season, month_col=month_col,
                              season_year_col=season_year_col, names=names[:3],
                              complete_only=complete_only)
    return rank_within(hours, [(names[0], False)], partition_by=[season_year_col],
                       method="dense_rank", out=names[3])


def season_vs_entity_mean(df: DataFrame, entity: str, flag_col: str, *,
                          season: str = "winter", month_col: str = "month",
                          season_year_col: str = "winter_season_year",
                          threshold: float = VS_MEAN_THRESHOLD,
                          labels: Sequence[str] = VS_MEAN_LABELS,
                          names: Sequence[str] = ("sunny_hours_count", "total_hours",
                                                  "sunny_hours_pct", "city_avg_sunny_hours",
                                                  "diff_from_city_avg", "vs_city_avg"),
                          hours: DataFrame | None = None,
                          complete_only: bool = False) -> DataFrame:
    """Flagged-hour counts per (entity, season-year) against the entity's own
    mean over all its season-years: mean (2 dp), difference (2 dp), class.

    The entity window holds one row per season-year of that entity (bounded
    by the time span, not by the row count)."""
    count_n, _, _, mean_n, diff_n, class_n = names
    if hours is None:
        hours = flagged_hours(df, entity, flag_col, season=season, month_col=month_col,
                              season_year_col=season_year_col, names=names[:3],
                              complete_only=complete_only)
    w = Window.partitionBy(entity)
    return (hours.withColumn(mean_n, F.round(F.avg(count_n).over(w), 2))
                 .withColumn(diff_n, F.round(F.col(count_n) - F.col(mean_n), 2))
                 .withColumn(class_n, deviation_class(diff_n, threshold, labels)))


def hot_day_cooccurrence(df: DataFrame, entity: str, heat_value: str, wet_value: str, *,
                         hot: float = HOT_DAY_MIN, wet: float = WET_DAY_MIN,
                         date_col: str = "date", year_col: str = "year",
                         scale: int | None = None,
                         names: Sequence[str] = ("total_hot_days", "hot_days_with_rain",
                                                 "total_precip_on_hot_days", "rain_pct_yearly",
                                                 "total_hot_days_all_years",
                                                 "total_hot_rainy_days_all_years",
                                                 "total_precip_all_years",
                                                 "rain_pct_all_years"),
                         daily: DataFrame | None = None) -> DataFrame:
    """Hot days (daily max of ``heat_value`` > ``hot``) and how many of them
    are wet (daily total of ``wet_value`` > ``wet``), per (entity, year) and
    over all years of the entity."""
    (hot_n, wet_n, precip_n, pct_n, hot_all_n, wet_all_n, precip_all_n, pct_all_n) = names
    if daily is None:
        daily = daily_table(df, entity, extremes=[heat_value], sums=[wet_value],
                            date_col=date_col, extra_keys=[year_col], scale=scale)
    daily = daily.select(entity, year_col, F.col(f"_max_{heat_value}").alias("_max"),
                         F.round(F.col(f"_sum_{wet_value}"), 2).alias("_total"))
    yearly = (daily.filter(F.col("_max") > hot)
                   .groupBy(entity, year_col)
                   .agg(F.count(F.lit(1)).alias(hot_n),
                        F.count_if(F.col("_total") > wet).alias(wet_n),
                        F.round(sum_exact("_total", scale), 2).alias(precip_n))
                   .withColumn(pct_n, pct(wet_n, hot_n, 2)))
    # one row per (entity, year): the window over an entity is bounded by the
    # number of years
    w = Window.partitionBy(entity)
    precip_sum = (F.sum(F.col(precip_n)).over(w) if scale is None else
                  from_scaled(F.sum(scaled_long(precip_n, scale)).over(w), scale))
    return (yearly.withColumn(hot_all_n, F.sum(hot_n).over(w))
                  .withColumn(wet_all_n, F.sum(wet_n).over(w))
                  .withColumn(precip_all_n, F.round(precip_sum, 2))
                  .withColumn(pct_all_n, pct(wet_all_n, hot_all_n, 2)))

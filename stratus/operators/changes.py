"""Period-over-period changes: year over year within a season, season to
season within a year."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratus.functions.calendar import in_season, season_order
from stratus.functions.numeric import mean_exact


def lag_change(value: str, partition_by: Sequence[str], order_by: str | Column,
               digits: int = 2, first: float = 0.0) -> Column:
    """round(value − previous value, digits) inside the partition; ``first``
    where there is no previous row (or the previous value is NULL). A missing
    period compares with the previous *present* one."""
    w = Window.partitionBy(*partition_by).orderBy(order_by)
    prev = F.lag(value, 1).over(w)
    return F.round(F.when(prev.isNotNull(), F.col(value) - prev).otherwise(F.lit(first)), digits)


def _seasonal_means(df: DataFrame, entity: str, year_col: str, season_col: str,
                    means: Mapping[str, tuple[str, float]], digits: int,
                    scale: int | None) -> DataFrame:
    return df.groupBy(entity, year_col, season_col).agg(*[
        F.round(mean_exact(c, scale) * factor if factor != 1 else mean_exact(c, scale),
                digits).alias(name)
        for name, (c, factor) in means.items()])


def season_yoy_change(df: DataFrame, entity: str, means: Mapping[str, tuple[str, float]],
                      changes: Mapping[str, str], *, seasons: Sequence[str] = ("summer", "winter"),
                      year_col: str = "year", season_col: str = "season",
                      month_col: str = "month", digits: int = 2,
                      scale: int | None = None) -> DataFrame:
    """Seasonal means per (entity, year, season) for the chosen seasons and
    their change against the previous year of the same season (0.0 for the
    first year). ``changes`` maps output name → mean column.

    The window per (entity, season) holds one row per year."""
    base = _seasonal_means(df.filter(in_season(month_col, *seasons)), entity, year_col,
                           season_col, means, digits, scale)
    for out, src in changes.items():
        base = base.withColumn(out, lag_change(src, [entity, season_col], year_col))
    return base


def season_step_change(df: DataFrame, entity: str, means: Mapping[str, tuple[str, float]],
                       change_of: str, *, out: str = "wind_change_vs_prev_season",
                       order_name: str = "season_order", year_col: str = "year",
                       season_col: str = "season", digits: int = 2,
                       scale: int | None = None) -> DataFrame:
    """Seasonal means per (entity, year, season), seasons ordered spring →
    winter inside a year, change against the previous season of the same
    year (0.0 for the first)."""
    base = _seasonal_means(df, entity, year_col, season_col, means, digits, scale)
    base = base.withColumn(order_name, season_order(season_col))
    return base.withColumn(out, lag_change(change_of, [entity, year_col], order_name))

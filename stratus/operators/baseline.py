"""Historical monthly baseline and the comparison of live windows with it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratus.functions.calendar import utc_wall_clock
from stratus.functions.numeric import deviation, mean_exact


def monthly_baseline(df: DataFrame, values: Mapping[str, str], *, entity: str | None = None,
                     entities: Sequence[str] | None = None,
                     years: tuple[int, int] | None = None, months: Sequence[int] | None = None,
                     year_col: str = "year", month_col: str = "month", digits: int = 3,
                     scale: int | None = None, by_year: bool = True) -> DataFrame:
    """Mean of each value per ([entity,] year, month), rounded.

    ``years``/``months`` are partition filters on an enriched table. The
    result has at most entities × years × 12 rows. ``by_year=False`` gives
    one long-term mean per ([entity,] month) over all the years instead."""
    if entities is not None and entity:
        df = df.filter(F.col(entity).isin(*entities))
    if years is not None:
        df = df.filter(F.col(year_col).between(*years))
    if months is not None:
        df = df.filter(F.col(month_col).isin(*months))
    keys = ([entity] if entity else []) + ([year_col] if by_year else []) + [month_col]
    return df.groupBy(*keys).agg(*[
        F.round(mean_exact(c, scale), digits).alias(name) for name, c in values.items()])


def versus_baseline(windows: DataFrame, baseline: DataFrame, *, entity_pair: tuple[str, str] | None = None,
                    year_col: str = "year", month_col: str = "month",
                    month_of: str = "window_start") -> DataFrame:
    """Attach every baseline year of the window's month to each window.

    Join key: month(``month_of``) [and entity]. One window meets at most one
    row per baseline year. Whether the baseline is broadcast is left to the
    planner and AQE, which see its measured size.
    Adds ``hist_year`` and ``hist_month``.
    """
    b = baseline.withColumnRenamed(month_col, "hist_month")
    if year_col in baseline.columns:
        b = b.withColumnRenamed(year_col, "hist_year")
    else:   # long-term baseline (by_year=False)
        b = b.withColumn("hist_year", F.lit(None).cast("int"))
    if entity_pair:
        b = b.withColumnRenamed(entity_pair[1], "_hist_entity")
    start = F.col(month_of)
    if isinstance(windows.schema[month_of].dataType, T.TimestampType):
        start = utc_wall_clock(start)      # the UTC month, whatever the session zone
    cond = F.month(start) == F.col("hist_month")
    if entity_pair:
        cond = cond & (F.col(entity_pair[0]) == F.col("_hist_entity"))
    out = windows.join(b, cond, "inner")
    return out.drop("_hist_entity") if entity_pair else out


def add_deviation(df: DataFrame, stream: str, hist: str, *, abs_out: str = "abs_deviation",
                  pct_out: str = "pct_deviation", digits: int = 3) -> DataFrame:
    """Absolute and percent deviation of a window mean from a baseline mean
    (percent is NULL when the baseline is 0)."""
    a, p = deviation(stream, hist, digits)
    return df.withColumn(abs_out, a).withColumn(pct_out, p)

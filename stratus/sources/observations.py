"""Observation tables: raw delimited hourly readings and the enriched,
year/month-partitioned Parquet table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratus.session import materialize

# Columns of the raw hourly CSV that the operators read, with the type they
# are used as. Any other CSV column passes through as text.
RAW_HOURLY_TYPES = {
    "datetime": T.StringType(),
    "city_name": T.StringType(),
    "temperature_2m": T.DoubleType(),
    "relative_humidity_2m": T.DoubleType(),
    "precipitation": T.DoubleType(),
    "snowfall": T.DoubleType(),
    "cloud_cover": T.DoubleType(),
    "pressure_msl": T.DoubleType(),
    "wind_speed_10m": T.DoubleType(),
    "wind_speed_100m": T.DoubleType(),
    "wind_gusts_10m": T.DoubleType(),
    "direct_radiation": T.DoubleType(),
    "shortwave_radiation_instant": T.DoubleType(),
    "direct_radiation_instant": T.DoubleType(),
    "diffuse_radiation_instant": T.DoubleType(),
    "direct_normal_irradiance_instant": T.DoubleType(),
    "global_tilted_irradiance_instant": T.DoubleType(),
    "terrestrial_radiation_instant": T.DoubleType(),
}


def read_observations_csv(spark: SparkSession, path: str | list[str],
                          types: dict | None = None, sep: str = ",",
                          infer_other: bool = False, corrupt: str | None = None) -> DataFrame:
    """Read raw delimited observations with a header row.

    No inference pass over the data: every column is read as text and the
    known columns are converted by name with ``try_cast`` (a malformed number
    becomes NULL, like a PERMISSIVE read, instead of failing the job). The
    order of the columns is free, but all files read together must share it: a
    file whose header differs from the first one's fails the read (values
    would land in the wrong columns). Timestamps stay text here; ``enrich``
    parses them. ``infer_other`` gives columns outside ``types`` the type
    that Spark infers, at the price of a pass over the data; otherwise they
    stay text.

    ``corrupt`` names a column that keeps the raw line of every row that does not
    fit: too few or too many fields, or text that is not of its column's type
    (null in rows that fit). Spark looks at the columns that a query reads and at no
    others, so use :func:`split_corrupt`, which parses whole lines once.
    """
    types = RAW_HOURLY_TYPES if types is None else types
    reader = (spark.read.option("header", True).option("sep", sep)
              .option("mode", "PERMISSIVE").option("enforceSchema", False))
    raw = reader.csv(path)
    if infer_other and set(raw.columns) - set(types):
        guessed = reader.option("inferSchema", True).csv(path).schema
        types = {f.name: f.dataType for f in guessed} | types
    if corrupt:
        stated = T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in raw.columns])
        return (reader.schema(stated.add(corrupt, T.StringType()))
                .option("inferSchema", False).option("columnNameOfCorruptRecord", corrupt)
                .option("columnPruning", False).csv(path))
    cols = []
    for name in raw.columns:
        dt = types.get(name)
        if dt is None or isinstance(dt, T.StringType):
            cols.append(F.col(f"`{name}`"))
        else:
            cols.append(F.col(f"`{name}`").try_cast(dt).alias(name))
    return raw.select(*cols)


def split_corrupt(raw: DataFrame, corrupt: str) -> tuple[DataFrame, DataFrame]:
    """(rows that fit, raw lines that don't) of a CSV read with ``corrupt``.

    The parsed rows are written once, so the text is parsed once, and a query
    of the raw lines alone sees what the parse of whole lines found."""
    parsed = materialize(raw, "parsed")
    bad = F.col(f"`{corrupt}`")
    return parsed.where(bad.isNull()).drop(corrupt), parsed.where(bad.isNotNull()).select(bad)


def read_observations(spark: SparkSession, path: str, years: Iterable[int] | None = None,
                      months: Iterable[int] | None = None,
                      between: tuple[tuple[int, int], tuple[int, int]] | None = None) -> DataFrame:
    """Read the enriched table. ``years``, ``months`` and ``between`` (first and last
    (year, month)) become partition filters (directories outside them are never
    listed into tasks)."""
    df = spark.read.parquet(path)
    if between is not None:
        (y0, m0), (y1, m1) = between
        df = df.filter(F.col("year").between(y0, y1)).filter(
            (F.col("year") * 100 + F.col("month")).between(y0 * 100 + m0, y1 * 100 + m1))
    if years is not None:
        df = df.filter(F.col("year").isin(*list(years)))
    if months is not None:
        df = df.filter(F.col("month").isin(*list(months)))
    return df

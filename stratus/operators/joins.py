"""Joins against dimension tables with a checked size bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bytes up to which a dimension is broadcast.
BROADCAST_MAX_BYTES = 64 << 20


def planned_bytes(df: DataFrame) -> int:
    """Size of ``df`` as the planner knows it, measured now: the bytes of the
    files it reads, scaled to the columns in use. Nothing is scanned or kept."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def join_dimension(fact: DataFrame, dim: DataFrame, on, *, source: DataFrame | None = None,
                   how: str = "inner", max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Join a fact table with a dimension, broadcast only while ``source``
    (the table whose rows it has; default: the dimension itself) is within
    ``max_bytes``. Beyond that the planner and AQE choose from measured sizes
    and split skewed keys. ``source`` is for dimensions that are joins
    themselves: for those the planner only has the product of the sides."""
    small = planned_bytes(dim if source is None else source) <= max_bytes
    return fact.join(F.broadcast(dim) if small else dim, on, how)

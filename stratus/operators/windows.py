"""Sliding event-time windows (batch or streaming) and de-duplication of
update-mode re-emissions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratus.functions.numeric import from_scaled, scaled_long

_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def duration_seconds(text: str) -> int:
    """'90 minutes', '1 hour 30 minutes' → seconds."""
    total = 0
    for num, unit in re.findall(r"(\d+)\s*([a-z]+?)s?\b", text.lower()):
        total += int(num) * _UNITS[unit]
    if total <= 0:
        raise ValueError(f"bad duration {text!r}")
    return total


def sliding_stats(df: DataFrame, time_col: str, entity: str | Sequence[str],
                  aggs: Mapping[str, Column], *, size: str, slide: str,
                  watermark: str | None = None) -> DataFrame:
    """Aggregates per (entity, sliding window) of ``size`` every ``slide``.

    Each row belongs to size/slide windows; Spark expands the rows and
    aggregates partially before the shuffle. On a streaming frame pass
    ``watermark`` so window state is evicted once the watermark passes the
    window end; the same call runs unchanged on a batch frame.
    Output: entity, window_start, window_end, aggregates.
    """
    entities = [entity] if isinstance(entity, str) else list(entity)
    if watermark:
        df = df.withWatermark(time_col, watermark)
    grouped = df.groupBy(F.window(F.col(time_col), size, slide).alias("window"), *entities)
    out = grouped.agg(*[expr.alias(name) for name, expr in aggs.items()])
    return out.select(*entities, F.col("window.start").alias("window_start"),
                      F.col("window.end").alias("window_end"), *aggs.keys())


def latest_per_window(df: DataFrame, keys: Sequence[str] = ("window_start",),
                      order_col: str = "batch_id") -> DataFrame:
    """Keep the last emission of every window key (highest ``order_col``).

    Update-mode sinks receive a window once per micro-batch that changed it;
    this collapses the history to the final values. ``max_by`` aggregates
    partially before the shuffle — no sort, no per-key row list."""
    others = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.max_by(F.struct(*others), F.col(order_col)).alias("_last"))
    return picked.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in others])


# Decomposable aggregates: (partial per pane, merge of partials).
_PANE_KINDS = ("mean", "sum", "min", "max", "count")


def pane_sliding_stats(df: DataFrame, time_col: str, entity: str | Sequence[str],
                       aggs: Mapping[str, tuple[str, str | None]], *, size: str, slide: str,
                       scale: int | None = None,
                       rounding: Mapping[str, int] | None = None) -> DataFrame:
    """Batch sliding windows computed from panes; same rows and values as
    :func:`sliding_stats` for decomposable aggregates.

    ``F.window`` with a slide copies every event into size/slide windows
    before aggregating (12–18× the input for the alert jobs). Here events are
    first aggregated into their ``slide``-long pane per entity (one hash
    update per event, partial aggregation before the shuffle, so a hot
    entity is pre-reduced), and only the pane partials are copied into the
    windows that contain them and merged.

    ``aggs``: output name → (kind, column) with kind in mean, sum, min, max,
    count (column ``None`` counts rows). ``scale`` makes mean/sum exact
    decimal sums (see ``mean_exact``). ``rounding``: output name → digits.
    """
    size_s, slide_s = duration_seconds(size), duration_seconds(slide)
    if size_s % slide_s:
        raise ValueError("size must be a multiple of slide for pane aggregation")
    entities = [entity] if isinstance(entity, str) else list(entity)
    n = size_s // slide_s

    def part_sum(c):
        return F.sum(F.col(c) if scale is None else scaled_long(c, scale))

    partial, merged = [], {}
    for name, (kind, c) in aggs.items():
        if kind not in _PANE_KINDS:
            raise ValueError(f"aggregate kind {kind!r} is not decomposable")
        if kind in ("mean", "sum"):
            partial.append(part_sum(c).alias(f"_s_{name}"))
        if kind in ("mean", "count"):
            partial.append((F.count(F.lit(1)) if c is None else F.count(c)).alias(f"_n_{name}"))
        if kind in ("min", "max"):
            partial.append(getattr(F, kind)(c).alias(f"_{kind}_{name}"))
        if kind == "mean":
            total = F.sum(f"_s_{name}")
            total = total if scale is None else from_scaled(total, scale)
            merged[name] = F.try_divide(total, F.sum(f"_n_{name}"))
        elif kind == "sum":
            total = F.sum(f"_s_{name}")
            merged[name] = total if scale is None else from_scaled(total, scale)
        elif kind == "count":
            merged[name] = F.sum(f"_n_{name}")
        else:
            merged[name] = getattr(F, kind)(f"_{kind}_{name}")

    panes = (df.groupBy(*entities, F.window(F.col(time_col), slide).start.alias("_pane"))
               .agg(*partial))
    copies = panes.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    start = F.col("_pane") - F.make_dt_interval(secs=F.col("_k") * F.lit(slide_s))
    windows = (copies.groupBy(*entities, start.alias("window_start"))
                     .agg(*[e.alias(k) for k, e in merged.items()]))
    rounding = rounding or {}
    out = [F.round(F.col(k), rounding[k]).alias(k) if k in rounding else F.col(k)
           for k in aggs]
    end = F.col("window_start") + F.make_dt_interval(secs=F.lit(size_s))
    return windows.select(*entities, "window_start", end.alias("window_end"), *out)

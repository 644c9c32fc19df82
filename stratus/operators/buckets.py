"""Quantile buckets of entities, bucket summaries, Pearson correlation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratus.functions.numeric import label_bucket, mean_exact, pearson_expr
from stratus.operators.ranking import rank_within

# --- Fixed values: quartile labels of the reference ------------------------
QUARTILE_LABELS = {1: "Q1 - Najsuvlji", 2: "Q2 - Suvlji", 3: "Q3 - Kišovitiji",
                   4: "Q4 - Najkišovitiji"}
# ---------------------------------------------------------------------------


def quantile_bucket(df: DataFrame, entity: str, means: Mapping[str, tuple[str, float]],
                    by: str, *, n: int = 4, labels: Mapping[int, str] = QUARTILE_LABELS,
                    names: Sequence[str] = ("precipitation_quartile", "quartile_label"),
                    digits: int = 2, scale: int | None = None) -> DataFrame:
    """Per-entity means, then NTILE(n) of the entities ordered by mean
    ``by`` ascending (entity key breaks ties so buckets are reproducible),
    plus a text label."""
    bucket_n, label_n = names
    stats = df.groupBy(entity).agg(*[
        F.round(mean_exact(c, scale) * factor if factor != 1 else mean_exact(c, scale),
                digits).alias(name)
        for name, (c, factor) in means.items()])
    stats = rank_within(stats, [by, entity], method="ntile", n=n, out=bucket_n)
    return stats.withColumn(label_n, label_bucket(bucket_n, labels))


def bucket_summary(buckets: DataFrame, means: Mapping[str, str], *,
                   keys: Sequence[str] = ("precipitation_quartile", "quartile_label"),
                   digits: int = 2, scale: int | None = None) -> DataFrame:
    """Unweighted mean of the per-entity means inside each bucket."""
    return buckets.groupBy(*keys).agg(*[
        F.round(mean_exact(c, scale), digits).alias(name) for name, c in means.items()])


def pearson(df: DataFrame, x: str, y: str, *, by: Sequence[str] = (),
            out: str = "pearson_correlation", digits: int | None = None) -> DataFrame:
    """Pearson r of two columns over all rows (or per ``by`` group) as a
    DataFrame — NULL for constant or empty input, never an error."""
    r = pearson_expr(x, y)
    if digits is not None:
        r = F.round(r, digits)
    return df.groupBy(*by).agg(r.alias(out))

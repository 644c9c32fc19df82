"""Ranking without a single-partition window.

``Window.orderBy`` with no ``partitionBy`` (a global rank, ``ntile``) puts
every row in one task, and ``Window.partitionBy(g)`` puts a whole group in
one task. :func:`rank_within` computes the same numbers from a range sort, by
the same steps at every size:

1. the input is dealt over tasks by a range partitioning on group, order
   columns and all others (Spark samples it, any orderable type; a value tied by
   a third of all rows spreads over ranges) and written once to the shared
   folder with the number of the range. From here on each branch reads the
   same rows and ranges whatever is recomputed after an executor loss;
2. it is reduced to distinct (group, order columns) keys with their
   multiplicity and first range, map side;
3. running counts inside each (group, range), plus the totals of the ranges
   before it (groups × ranges rows), give rank and dense rank;
4. the ranks are joined back on the key (for ``row_number`` and ``ntile`` the
   key is the whole row, so nothing is joined back).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratus.session import materialize

_METHODS = ("rank", "dense_rank", "row_number", "ntile")


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys`` treating NULL = NULL; right-side key columns are
    dropped. Without keys the right side is a single row."""
    rk = [f"__rk{i}" for i in range(len(keys))]
    renamed = right.select(*[F.col(k).alias(r) for k, r in zip(keys, rk)],
                           *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b,
                  [F.col(k).eqNullSafe(F.col(r)) for k, r in zip(keys, rk)])
    return left.join(renamed, cond, "inner").drop(*rk)


def rank_within(df: DataFrame, order_by: Sequence, *, partition_by: Sequence[str] = (),
                method: str = "rank", out: str = "rank", n: int | None = None,
                ranges: int | None = None, written: list | None = None) -> DataFrame:
    """Add column ``out`` = ``method`` over (PARTITION BY ``partition_by``
    ORDER BY ``order_by``), computed without single-task windows.

    ``order_by`` items are column names (ascending, NULLS FIRST) or
    ``(name, descending)`` pairs (descending → NULLS LAST), Spark's defaults.
    ``method``: ``rank``, ``dense_rank``, ``row_number`` or ``ntile``.
    ``row_number`` and ``ntile`` number tied rows by their remaining columns
    (ascending), so the numbering is a function of the data alone; rows equal
    in every column are interchangeable. Results are ``int`` like Spark's.
    ``ranges``: number of range partitions (default: Spark's shuffle
    partitions, coalesced by AQE when small). ``written``: a list that gets the rows as
    they were written on the way, for other uses of ``df`` that would compute it again.
    """
    if method not in _METHODS:
        raise ValueError(f"method must be one of {_METHODS}")
    if method == "ntile" and not n:
        raise ValueError("ntile needs n")
    order = [(o, False) if isinstance(o, str) else (o[0], bool(o[1])) for o in order_by]
    parts = list(partition_by)
    cols = df.columns
    whole_row = method in ("row_number", "ntile")
    if whole_row:
        used = set(parts) | {c for c, _ in order}
        order += [(c, False) for c in cols if c not in used]
    sorts = [F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_first() for c, d in order]
    key = parts + [c for c, _ in order if c not in parts]

    spread = [F.col(f.name) for f in df.schema.fields
              if f.name not in key and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    by = [F.col(p) for p in parts] + sorts + spread
    rows = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    rows = materialize(rows.withColumn("_range", F.spark_partition_id()), "rank-rows")
    if written is not None:
        written.append(rows.select(*cols))
    keys = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_m"), F.min("_range").alias("_range"))

    within = Window.partitionBy(*parts, "_range").orderBy(*sorts)
    before = F.sum("_m").over(within.rowsBetween(Window.unboundedPreceding, -1))
    local = keys.withColumns({"_before": F.coalesce(before, F.lit(0)),
                              "_dense": F.row_number().over(within)})
    earlier = Window.partitionBy(*parts).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1)
    totals = (keys.groupBy(*parts, "_range")
              .agg(F.sum("_m").alias("_rows"), F.count(F.lit(1)).alias("_keys")))
    offsets = totals.select(*parts, "_range",
                            F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_o"),
                            F.coalesce(F.sum("_keys").over(earlier), F.lit(0)).alias("_od"),
                            F.sum("_rows").over(Window.partitionBy(*parts)).alias("_total"))
    ranked = _null_safe_join(local, offsets, [*parts, "_range"])
    first = F.col("_o") + F.col("_before") + 1
    if whole_row:
        number = F.explode(F.sequence(first, F.col("_o") + F.col("_before") + F.col("_m")))
        numbered = ranked.select(*cols, "_total", number.alias("_i"))
        value = _ntile(F.col("_i"), F.col("_total"), n) if method == "ntile" else F.col("_i")
        return numbered.select(*cols, value.cast(T.IntegerType()).alias(out))
    value = first if method == "rank" else F.col("_od") + F.col("_dense")
    ranked = ranked.select(*key, value.cast(T.IntegerType()).alias(out))
    return _null_safe_join(rows, ranked, key).select(*cols, out)


def _ntile(row_number: Column, total: Column, n: int) -> Column:
    """SQL NTILE(n) from a 1-based row number and the group size: the first
    (total mod n) buckets hold one row more."""
    i = row_number - 1
    q = F.floor(total / n).cast(T.LongType())
    rem = total - q * n
    big = rem * (q + 1)
    return (F.when(i < big, F.floor(i / (q + 1)) + 1)
             .otherwise(rem + F.floor(F.try_divide(i - big, q)) + 1))


def top_k(df: DataFrame, rank_col: str, k: int) -> DataFrame:
    """Keep rows whose rank is at most ``k`` (ties kept)."""
    return df.filter(F.col(rank_col) <= k)


def rank_top(df: DataFrame, order: tuple[str, bool], k: int, out: str = "rank") -> DataFrame:
    """Rows of rank at most ``k`` (ties kept) with their rank, without ranking
    the rest: the k-th value is found first, and rows from it on have at most
    k distinct values to count. ``order`` is (column, descending)."""
    col, desc = order
    by = F.col(col).desc_nulls_last() if desc else F.col(col).asc_nulls_first()
    rows = materialize(df, "rank-rows")
    first = rows.orderBy(by).limit(k).select(col)
    values = first.distinct()
    counts = (_null_safe_join(rows.select(col), F.broadcast(values), [col])    # at most k values
              .groupBy(col).agg(F.count(F.lit(1)).alias("_m")))
    before = F.sum("_m").over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1))
    ranks = counts.select(col, (F.coalesce(before, F.lit(0)) + 1).cast(T.IntegerType()).alias(out))
    return _null_safe_join(rows, F.broadcast(ranks), [col]).select(*df.columns, out)


def ordered(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """``df`` sorted as a whole by the columns of ``by`` (``name`` or
    ``name:desc``) that it has; Spark sorts by ranges, in as many tasks as
    there are. Without any, ``df`` as it is."""
    sorts = []
    for item in by:
        name, _, way = item.partition(":")
        if name in df.columns:
            sorts.append(F.col(name).desc_nulls_last() if way == "desc" else F.col(name).asc_nulls_first())
    return df.orderBy(*sorts) if sorts else df


def distinct_entities(df: DataFrame, *cols: str) -> DataFrame:
    """Distinct values of the entity columns (partial + final aggregation)."""
    return df.select(*cols).distinct()

"""Pieces that several operators of this folder share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratus.session import materialize

#: White space of the document contracts: space and U+0009 to U+000D.
BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables (a Parquet file or a directory of them)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_kept: dict = {}


def worker_state(key, make: Callable):
    """What a Python worker keeps from one task to the next (caches, tables),
    made by ``make()``: only that of the operator it ran last, so operators
    that follow each other don't add up."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def tidy(run: Callable, keep: bool = False) -> Callable:
    """``run`` (a function over Arrow batches), after which the Python worker
    gives free memory back to the system, so that it holds little while it
    waits. Unless ``keep``, what it kept for the next task goes too."""
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            _give_back(keep)
    return tidied


def _give_back(keep: bool) -> None:
    # a function of its own: a nested one is pickled with a copy of ``_kept``, and
    # would clear that instead of the worker's
    if not keep:
        _kept.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):     # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def numbered(df: DataFrame, *cols: str) -> tuple[DataFrame, list[str], Callable]:
    """``df`` with its columns named c0, c1, …, so that no helper column's name clashes
    and dots don't matter; those names of ``cols``; and a function that gives a
    result its columns and their names back."""
    names = df.columns
    inner = df.toDF(*(f"c{i}" for i in range(len(names))))
    return (inner, [f"c{names.index(c)}" for c in cols],
            lambda out: out.select(*inner.columns).toDF(*names))


#: Keys that :func:`join_hot_first` broadcasts, at most.
HOT_KEYS = 1024


def join_hot_first(rows: DataFrame, key: str, facts: DataFrame, fact_key: str,
                   hot: int = HOT_KEYS) -> DataFrame:
    """``rows`` with the columns of ``facts`` (one row a key, the key itself left out), for
    rows that have some; null keys have none.

    The ``hot`` keys with the most rows are joined by broadcast, so their rows are not moved;
    any other key has less than 1/``hot`` of the rows and is joined by shuffling."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(fact_key)).agg(
        F.count(F.lit(1)).alias("_m"))
    known = materialize(facts.join(counts, fact_key).withColumnRenamed(fact_key, "_key"), "facts")
    most = F.broadcast(materialize(known.orderBy(F.desc("_m"), "_key").limit(hot), "hot"))
    columns = [*rows.columns, *(c for c in facts.columns if c != fact_key)]
    same = F.col(key) == F.col("_key")
    rest = rows.join(F.broadcast(most.select("_key")), same, "left_anti")
    return (rows.join(most, same).select(*columns)
            .unionByName(rest.join(known, same).select(*columns)))


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_table(df: DataFrame, run: Callable, fields: list[T.StructField]) -> DataFrame:
    """``df`` through ``run``, a function from Arrow batches to lists of arrays in
    the order of ``fields``. Columns go by place, so any names will do, with dots
    or twice."""
    places = [f"o{i}" for i in range(len(fields))]

    def batches(given):
        for arrays in run(given):
            yield pa.RecordBatch.from_arrays(arrays, places)

    schema = T.StructType([T.StructField(p, f.dataType) for p, f in zip(places, fields)])
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.mapInArrow(tidy(batches), schema).toDF(*(f.name for f in fields))


def hash_sample(df: DataFrame, turn: Column, n: int, total: int, *ties: str,
                over: int = 4) -> DataFrame:
    """The ``n`` rows of smallest 64-bit hash ``turn`` (added as a column;
    ``ties`` order equal hashes) of a table of about ``total`` rows.

    A bound on the hash that about ``over * n`` rows meet comes first, so few
    rows are sorted however large the table is. With filters in ``df`` that
    leave a part of the ``total`` rows, ``over`` should be as much larger."""
    share = min(1.0, over * n / max(total, 1))
    bound = min(2 ** 63 - 1, int(-2 ** 63 + share * 2 ** 64))
    return (df.withColumn("turn", turn).where(F.col("turn") <= F.lit(bound))
            .orderBy("turn", *ties).limit(n))


def whole_text(col: str = "text") -> Column:
    """The text, null as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))

"""Exact duplicates with a heavy-hitter split.

Texts are equal when they are identical after each run of white space
(space, U+0009 to U+000D) became one space; the SHA-256 of that normal form
stands for the text. A frequent digest would send all its rows to one
task, so rows are split by frequency:

1. every task summarises its digests with Misra-Gries counters; the summed
   lower bounds over ``1/(k+1)`` of all rows leave at most ``k`` candidates,
   among them every digest with more than ``2/(k+1)`` of the rows;
2. the candidates are verified: exact group size and winner, aggregated map
   side. These at most ``k`` winners are broadcast, and their copies are
   decided (or removed) without a shuffle;
3. all other digests, none of them frequent, are shuffled as usual.

Defined results: a null text counts as empty, empty texts are equal to each
other. The row with the smallest id stays; null ids come last; of rows
repeated with the same id exactly one stays. An empty table gives no rows.
Other columns, whatever their names, pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratus.llm.common import BLANK, numbered, whole_text
from stratus.session import materialize

#: Misra-Gries counters, and so the most winners that are ever broadcast.
COUNTERS = 4095


def text_digest(text_col: str = "text"):
    """SHA-256 (lower-case hex) of the text with white space normalised."""
    return F.sha2(F.regexp_replace(whole_text(text_col), BLANK, " "), 256)


def misra_gries(column: str, k: int):
    """A ``mapInPandas`` function: at most ``k`` rows (key, low) per task,
    ``low`` at most the task's count of the key and at least that count less
    ``rows / (k + 1)``."""
    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.Series(dtype="int64")
        for batch in batches:
            held = held.add(batch[column].value_counts(), fill_value=0).astype("int64")
            if len(held) > k:
                # taking the (k+1)-th largest from all of them removes at
                # least k+1 rows of the count for each unit of error
                held = held - held.nlargest(k + 1).iloc[-1]
                held = held[held > 0]
        yield pd.DataFrame({"key": held.index.astype(str), "low": held.to_numpy("int64")})
    return summarise


def frequent_keys(df: DataFrame, column: str, k: int = COUNTERS) -> DataFrame:
    """At most ``k`` keys of ``column`` (string), among them every key that
    holds more than ``2/(k+1)`` of the rows."""
    parts = (df.select(column).mapInPandas(misra_gries(column, k), "key string, low long")
             .groupBy("key").agg(F.sum("low").alias("low")))
    return parts.where(F.col("low") * (k + 1) > F.lit(df.count())).select(
        F.col("key").alias(column))


def _order(id_col: str):
    """Winner order: smallest id, null ids last, then the row number."""
    return F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"),
                    F.col("row").alias("row"))


def _split(docs: DataFrame, id_col: str, text_col: str, k: int):
    """(digest table, verified winners of frequent digests)."""
    marked = materialize(docs.select(
        F.col(id_col).alias("doc_id"), text_digest(text_col).alias("digest"),
        F.monotonically_increasing_id().alias("row")), "digests")
    # written, as both sides of the split must use the same set
    heavy = materialize(frequent_keys(marked, "digest", k), "frequent")
    winners = materialize(
        marked.join(F.broadcast(heavy), "digest")
        .groupBy("digest").agg(F.min(_order("doc_id")).alias("first"),
                               F.count(F.lit(1)).alias("group_size")), "winners")
    return marked, winners


def _decide(marked: DataFrame, winners: DataFrame) -> DataFrame:
    """The digest table with keep_id, group_size and kept."""
    frequent = marked.join(F.broadcast(winners), "digest")
    alone = Window.partitionBy("digest")
    rest = (marked.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
            .withColumns({"first": F.min(_order("doc_id")).over(alone),
                          "group_size": F.count(F.lit(1)).over(alone)}))
    return frequent.unionByName(rest).select(
        "doc_id", F.col("first.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.col("digest").alias("text_sha256"))


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                k: int = COUNTERS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id (id of the row of the same
    text that stays), group_size, kept, text_sha256."""
    return _decide(*_split(docs, id_col, text_col, k))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                k: int = COUNTERS) -> DataFrame:
    """``docs`` without the copies; all columns and whole texts are kept.

    Copies of frequent texts go map side. The others are removed by an anti
    join with the (digest, id) pairs to drop. Only texts whose winning id is
    repeated need their rows brought together."""
    inner, (id_col, text_col), back = numbered(docs, id_col, text_col)
    marked, winners = _split(inner, id_col, text_col, k)
    fate = materialize(_decide(marked, winners), "fate").withColumnRenamed(
        "text_sha256", "_digest")
    same = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    frequent = F.broadcast(winners.select(F.col("digest").alias("_digest"),
                                          F.col("first.id").alias("_keep")))
    out = (inner.withColumn("_digest", text_digest(text_col))
           .join(frequent.withColumn("_frequent", F.lit(True)), "_digest", "left")
           .where(F.col("_frequent").isNull() | F.col(id_col).eqNullSafe(F.col("_keep"))))
    light = (fate.where(~same)
             .join(F.broadcast(winners.select(F.col("digest").alias("_digest"))), "_digest",
                   "left_anti")
             .select(F.col("_digest").alias("_d"), F.col("doc_id").alias("_i")))
    out = out.join(light, (F.col("_digest") == F.col("_d"))
                   & F.col(id_col).eqNullSafe(F.col("_i")), "left_anti")
    again = fate.where(same & ~F.col("kept")).select("_digest").distinct()
    if not again.isEmpty():
        again = materialize(again, "repeated-ids")
        repeated = Window.partitionBy("_digest").orderBy(F.col(id_col).asc_nulls_last())
        out = (out.join(again, "_digest", "left_anti").unionByName(
            out.join(again, "_digest", "left_semi")
            .withColumn("_n", F.row_number().over(repeated)).where("_n = 1").drop("_n")))
    return back(out)

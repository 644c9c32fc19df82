"""Mixing sources to target weights, with DataFrame functions only.

The mix is as large as the whole table (in words). Every source gets a target
in proportion to its weight, at most ``max_epochs`` times its own size; what a
full source cannot take is shared again by weight. Whole epochs of a source
are taken first. The last, partial epoch takes its documents in hash-random
order up to the exact word budget:

1. every document gets a hash key; the key's range within its source is its
   bucket (a range sort by a uniform key needs no sampling);
2. word totals per (source, bucket) give distributed prefix sums;
3. buckets below the budget are taken whole and those above it not at all;
   only the one bucket per source where the budget ends is ordered row by row,
   and the document on which it ends gives the words that are left.

A hot source is spread over all buckets, and rows repeated with one id and
size are counted first, so no task gets a group that grows with it.

Defined results: null or blank texts have size 0 and take 0; the null source
is a source like any other, last in order; an empty table gives no rows. Equal
hash keys are ordered by id (null last) and size. The plan depends on the data
only, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratus.llm.common import WORD, numbered, whole_text
from stratus.session import materialize

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
#: Buckets per source: ranges of the hash key.
BUCKETS = 4096
SEED = 20240


def word_count(col: str = "text") -> Column:
    return F.regexp_count(whole_text(col), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources in order of cap/weight fill up first: with the caps of all before
    it paid, the rest is shared by the weights that remain. A source whose
    share there exceeds its cap gets the cap. The others share at the level
    of the first that stays below. One row per source is ordered in one task,
    after aggregation."""
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.array(*[F.lit(float(w)) for w in weights])
    per = (per.withColumn("w", F.element_at(
        pick, ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size").cast("double") * max_epochs))
    every = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    onward = every.rowsBetween(0, Window.unboundedFollowing)
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(whole).cast("double")
    per = per.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                         / F.sum("w").over(onward))
    # it rises while sources are full and falls from the first that is not
    settled = F.max("level").over(whole)
    return (per.withColumn("level", settled)
            .select("source", "source_size",
                    F.least("cap", F.col("level") * F.col("w")).alias("target")))


def _bucket(key: Column, buckets: int) -> Column:
    """Range number (0 … buckets-1) of a signed 64-bit hash key."""
    return F.least(F.lit(buckets - 1), F.floor(
        (key.cast("double") / 2.0 ** 64 + 0.5) * buckets)).cast("int")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", weights=WEIGHTS, max_epochs: int = MAX_EPOCHS,
        buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target
    (of its source), taken (words the mix takes of the row, repeats counted).

    Taken words of a source sum to its target, rounded to whole words."""
    sizes = materialize(docs.select(F.col(id_col).alias("doc_id"),
                                    F.col(source_col).alias("source"),
                                    word_count(text_col).alias("size")), "sizes")
    targets = materialize(source_targets(sizes, weights, max_epochs), "targets")
    # equal rows are one key with a count
    keyed = (sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("m"))
             .withColumn("key", F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")))
             .withColumn("bucket", _bucket(F.col("key"), buckets)))
    keyed = materialize(keyed, "keyed")
    totals = keyed.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("m")).alias("words"))
    earlier = (Window.partitionBy("source").orderBy("bucket")
               .rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    goal = F.round("target").cast("long")
    ranges = (totals.alias("t").join(
        targets.withColumnRenamed("source", "s"),
        F.col("t.source").eqNullSafe(F.col("s"))).drop("s")
        .withColumn("epochs", F.when(F.col("source_size") > 0,
                                     F.floor(goal / F.col("source_size"))).otherwise(0))
        .withColumn("rest", goal - F.col("epochs") * F.col("source_size")))
    ranges = materialize(ranges.select(
        F.col("source").alias("s"), F.col("bucket").alias("b"), "source_size", "target", "epochs",
        (F.col("rest") - F.col("before")).alias("room"),
        F.when(F.col("before") + F.col("words") <= F.col("rest"), "all")
        .when(F.col("before") >= F.col("rest"), "none").otherwise("cut").alias("part")), "ranges")
    placed = keyed.join(ranges, F.col("source").eqNullSafe(F.col("s"))
                        & (F.col("bucket") == F.col("b"))).drop("s", "b")
    # only the bucket in which a source's budget ends needs the order of its rows
    row_order = (Window.partitionBy("source", "bucket")
                 .orderBy("key", F.col("doc_id").asc_nulls_last(), "size")
                 .rowsBetween(Window.unboundedPreceding, -1))
    cut = (placed.where("part = 'cut'")
           .withColumn("ahead", F.coalesce(
               F.sum(F.col("size") * F.col("m")).over(row_order), F.lit(0))))
    sure = placed.where("part <> 'cut'").withColumn("ahead", F.lit(0).cast("long"))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("m")))
    rows = sure.unionByName(cut).withColumn("nth", each)
    left = F.col("room") - F.col("ahead") - (F.col("nth") - 1) * F.col("size")
    last = (F.when(F.col("part") == "all", F.col("size")).when(F.col("part") == "none", F.lit(0))
            .otherwise(F.greatest(F.lit(0), F.least(F.col("size"), left))))
    return rows.select("doc_id", "source", "size", "source_size", "target",
                       (F.col("epochs") * F.col("size") + last).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source", **options) -> DataFrame:
    """The mix as documents: each row of ``docs`` as often as the mix takes it
    (the document on which a budget ends counts whole, as texts are never
    cut). Rows without words, which no budget reaches, are left out."""
    inner, (id_col, text_col, source_col), back = numbered(docs, id_col, text_col, source_col)
    taken = mix(inner, id_col, text_col, source_col, **options)
    # rows that repeat with one id, source and size differ in the cut at most
    # at their last copy: the copies are dealt over them by their sum
    times = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0)
    plan = (taken.withColumn("times", times.cast("long")).groupBy("doc_id", "source", "size")
            .agg(F.sum("times").alias("_times"), F.count(F.lit(1)).alias("_rows"))
            .select(F.col("doc_id").alias("_i"), F.col("source").alias("_s"),
                    F.col("size").alias("_n"), "_times", "_rows").where("_times > 0"))
    plan = materialize(plan, "plan")
    joined = (inner.withColumn("_size", word_count(text_col)).join(
        plan, F.col(id_col).eqNullSafe(F.col("_i")) & F.col(source_col).eqNullSafe(F.col("_s"))
        & (F.col("_size") == F.col("_n"))))
    if plan.where("_rows > 1").isEmpty():
        nth = F.lit(0)
    else:
        nth = F.row_number().over(Window.partitionBy("_i", "_s", "_n").orderBy(
            F.xxhash64(text_col))) - 1
    share = F.floor((F.col("_times") + F.col("_rows") - 1 - F.col("_nth")) / F.col("_rows"))
    return back(joined.withColumn("_nth", nth)
                .withColumn("_copies", share.cast("int"))
                .where("_copies > 0")
                .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))))

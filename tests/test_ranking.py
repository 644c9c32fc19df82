"""The distributed rank equals Spark's window functions (ties, NULLs,
hot values, tiny groups)."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stratus.operators.ranking import rank_within, top_k


@pytest.fixture(scope="module")
def data(spark):
    random.seed(7)
    rows = []
    for i in range(1500):
        g = random.choice(["a", "b", "c", None]) if i % 3 else "a"   # "a" is hot
        v = (None if i % 17 == 0 else 7.0 if i % 3 == 0
             else round(random.random() * 40, 1))
        rows.append((i, g, v, f"e{random.randint(0, 9999):04d}"))
    return spark.createDataFrame(rows, "id long, g string, v double, e string")


CASES = [
    ([], [("v", True)], "rank"),
    ([], [("v", False)], "dense_rank"),
    (["g"], [("v", True)], "rank"),
    (["g"], [("v", False)], "dense_rank"),
    ([], [("v", False), ("id", False)], "ntile"),
    (["g"], [("v", True), ("e", False), ("id", True)], "row_number"),
    (["g"], [("v", False), ("id", False)], "ntile"),
]


@pytest.mark.parametrize("ranges", [None, 7])
@pytest.mark.parametrize("parts,order,method", CASES)
def test_matches_window_functions(spark, data, parts, order, method, ranges):
    mine = rank_within(data, order, partition_by=parts, method=method, out="r", n=4,
                       ranges=ranges)
    sorts = [F.col(c).desc() if d else F.col(c).asc() for c, d in order]
    w = Window.partitionBy(*parts).orderBy(*sorts) if parts else Window.orderBy(*sorts)
    fn = {"rank": F.rank(), "dense_rank": F.dense_rank(), "row_number": F.row_number(),
          "ntile": F.ntile(4)}[method]
    ref = data.withColumn("r2", fn.over(w)).select("id", "r2")
    joined = mine.join(ref, "id")
    assert mine.count() == data.count()
    assert joined.filter(F.col("r") != F.col("r2")).count() == 0
    assert dict(mine.dtypes)["r"] == "int"


@pytest.mark.parametrize("n_rows", [3, 5])
def test_ntile_small_groups(spark, n_rows):
    df = spark.createDataFrame([(i, float(i % 2)) for i in range(n_rows)], "id long, v double")
    got = [r.q for r in rank_within(df, ["v", "id"], method="ntile", n=4, out="q")
           .orderBy("v", "id").collect()]
    want = [r.q for r in df.withColumn("q", F.ntile(4).over(Window.orderBy("v", "id")))
            .orderBy("v", "id").collect()]
    assert got == want


def test_top_k_keeps_ties(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 4.0), (4, 1.0)], "id long, v double")
    ranked = rank_within(df, [("v", True)], out="rank")
    assert sorted(r.id for r in top_k(ranked, "rank", 1).collect()) == [1, 2]
    assert sorted(r.id for r in top_k(ranked, "rank", 3).collect()) == [1, 2, 3]


def test_ties_are_numbered_the_same_at_any_range_count(spark):
    df = spark.createDataFrame([(5, "a"), (5, "b"), (6, "c"), (6, "c")], "v long, name string")
    for method, want in (("row_number", [1, 2, 3, 4]), ("ntile", [1, 1, 2, 3])):
        for ranges in (1, 3):
            got = rank_within(df, ["v"], method=method, n=3, out="r", ranges=ranges)
            assert [r.r for r in got.orderBy("v", "name", "r").collect()] == want


def test_long_common_string_prefix_spreads_over_ranges(spark, monkeypatch):
    import stratus.operators.ranking as R
    seen = []
    plain = R.materialize
    monkeypatch.setattr(R, "materialize", lambda df, label="t": seen.append(
        out := plain(df, label)) or out)
    df = spark.range(2000).select(F.format_string("customer#%09d", "id").alias("name"))
    got = rank_within(df, ["name"], out="r", ranges=1024)
    assert got.agg(F.max("r"), F.countDistinct("r")).first()[:2] == (2000, 2000)
    assert seen[-1].select("_range").distinct().count() > 500

"""Property tests: random inputs (ties, NULLs, hot values) against Spark's
own window functions / window expansion."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from stratus.operators.ranking import rank_within
from stratus.operators.windows import pane_sliding_stats, sliding_stats

SETTINGS = settings(max_examples=6, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])

rows_st = st.lists(
    st.tuples(st.sampled_from(["a", "b", None]),
              st.one_of(st.none(), st.integers(-3, 3).map(float), st.floats(-5, 5).map(
                  lambda x: round(x, 1)))),
    min_size=1, max_size=60)


@SETTINGS
@given(rows=rows_st, desc=st.booleans(),
       method=st.sampled_from(["rank", "dense_rank"]), grouped=st.booleans())
def test_rank_within_matches_window(spark, rows, desc, method, grouped):
    df = spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(rows)],
                               "id long, g string, v double")
    parts = ["g"] if grouped else []
    mine = rank_within(df, [("v", desc)], partition_by=parts, method=method, out="r")
    order = F.col("v").desc() if desc else F.col("v").asc()
    w = Window.partitionBy(*parts).orderBy(order) if parts else Window.orderBy(order)
    fn = F.rank() if method == "rank" else F.dense_rank()
    want = {r.id: r.r for r in df.withColumn("r", fn.over(w)).collect()}
    got = {r.id: r.r for r in mine.collect()}
    assert got == want


@SETTINGS
@given(rows=rows_st)
def test_ntile_matches_window(spark, rows):
    df = spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(rows)],
                               "id long, g string, v double")
    mine = rank_within(df, ["v", "id"], partition_by=["g"], method="ntile", n=3, out="q")
    want = {r.id: r.q for r in df.withColumn(
        "q", F.ntile(3).over(Window.partitionBy("g").orderBy("v", "id"))).collect()}
    assert {r.id: r.q for r in mine.collect()} == want


events_st = st.lists(
    st.tuples(st.sampled_from(["x", "y"]), st.integers(0, 6 * 3600 - 1),
              st.one_of(st.none(), st.integers(-500, 500).map(lambda c: c / 100))),
    min_size=1, max_size=80)


@SETTINGS
@given(events=events_st, size_panes=st.sampled_from([1, 3, 12]))
def test_pane_windows_match_window_expansion(spark, events, size_panes):
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(e, base + dt.timedelta(seconds=s), v) for e, s, v in events],
                               "e string, ts timestamp_ntz, v double")
    size = f"{5 * size_panes} minutes"
    mine = pane_sliding_stats(df, "ts", "e", {"m": ("mean", "v"), "lo": ("min", "v"),
                                              "n": ("count", None), "s": ("sum", "v")},
                              size=size, slide="5 minutes", scale=2)
    want = sliding_stats(df, "ts", "e", {
        "m": F.try_divide(F.sum(F.rint(F.col("v") * 100).cast("long")).cast("double") / 100.0,
                          F.count("v")),
        "lo": F.min("v"), "n": F.count(F.lit(1)),
        "s": F.sum(F.rint(F.col("v") * 100).cast("long")).cast("double") / 100.0,
    }, size=size, slide="5 minutes")
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, want.collect()))

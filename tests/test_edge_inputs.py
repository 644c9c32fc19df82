"""Inputs that the given tables do not hold: missing values, several files,
unordered streams, values that an exact mean cannot hold."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

import stratus.plans.driver as D
from stratus.functions.numeric import circular_gap, mean_exact, pearson_expr, rise_pct
from stratus.operators.ranking import ordered, rank_top, rank_within
from stratus.sources.observations import read_observations_csv
from stratus.streaming.runner import start_window_job

SF = "/root/testdata/sf0.001"


def test_pearson_skips_rows_with_one_side_missing(spark):
    rows = [(1.0, 2.0), (2.0, 1.0), (3.0, 5.0), (4.0, 4.0), (None, 100.0), (50.0, None)]
    df = spark.createDataFrame(rows, "x double, y double")
    got, want = df.agg(pearson_expr("x", "y"), F.corr("x", "y")).first()
    assert got == pytest.approx(want)
    assert df.where("x is null").agg(pearson_expr("x", "y")).first()[0] is None


def test_exact_mean_refuses_what_it_cannot_hold(spark):
    fine = spark.createDataFrame([(1.25,), (0.1 + 0.2,), (None,)], "v double")
    assert fine.agg(mean_exact("v", 2)).first()[0] == 0.775
    for bad in (1.234, float("nan"), float("inf")):
        df = spark.createDataFrame([(1.0,), (bad,)], "v double")
        with pytest.raises(Exception, match="decimals or is not finite"):
            df.agg(mean_exact("v", 2)).collect()


def test_circular_gap_and_rise(spark):
    df = spark.createDataFrame([(10.0, 350.0), (0.0, 180.0), (725.0, 5.0)], "a double, b double")
    assert [r[0] for r in df.select(circular_gap("a", "b", 360.0)).collect()] == [20.0, 180.0, 0.0]
    df = spark.createDataFrame([(3.0, 2.0), (3.0, 0.0), (3.0, -1.0), (None, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(rise_pct("a", "b")).collect()] == [50.0, None, None, None]


def test_csv_files_with_other_header_order_fail(spark, tmp_path):
    for name, head, row in (("a", "datetime,city_name,temperature_2m,precipitation", "2000-01-01 00:00:00,A,1,9"),
                            ("b", "datetime,city_name,precipitation,temperature_2m", "2000-01-01 00:00:00,B,2,20")):
        (tmp_path / f"{name}.csv").write_text(f"{head}\n{row}\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_observations_csv(spark, str(tmp_path)).collect()
    one = read_observations_csv(spark, str(tmp_path / "b.csv")).first()
    assert (one.precipitation, one.temperature_2m) == (2.0, 20.0)


def test_csv_types_of_other_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("datetime,city_name,level\n2000-01-01 00:00:00,A,7\n")
    assert dict(read_observations_csv(spark, str(tmp_path)).dtypes)["level"] == "string"
    assert dict(read_observations_csv(spark, str(tmp_path), infer_other=True).dtypes)["level"] == "int"


def _in_parts(spark, folder, n=3):
    os.makedirs(folder)
    spark.read.parquet(f"{SF}/events.parquet").repartition(n).write.parquet(f"{folder}/events.parquet")
    return folder


def test_replay_of_a_folder_equals_the_file(spark, scratch):
    sf = _in_parts(spark, f"{scratch}/sf")
    want = sorted(map(tuple, D.q_stream_window_replay(spark, SF).collect()))
    assert sorted(map(tuple, D.q_stream_window_replay(spark, sf).collect())) == want
    assert sorted(map(tuple, D.q_stream_ordered_replay(spark, sf).collect())) == want


def test_time_slices_grow_with_the_table_in_files_of_many_tasks(spark, monkeypatch):
    events = spark.read.parquet(f"{SF}/events.parquet")
    monkeypatch.setattr(D, "SLICE_ROWS", events.count() // 5 + 1, raising=False)
    path, seconds = D.time_slices(events, "ts", 3)
    files = spark.read.parquet(path).groupBy(F.input_file_name()).agg(F.min("ts"), F.max("ts"),
                                                                     F.count("ts")).collect()
    assert len(files) > 20 and max(r[3] for r in files) < events.count() / 10
    folder = path.removeprefix("file:")
    age = lambda r: os.stat(folder + r[0].split(folder)[1]).st_mtime_ns // 10 ** 6
    files.sort(key=age)
    for one, other in zip(files, files[1:]):
        assert (one[2] - other[1]).total_seconds() < seconds       # in order, but for one slice
    rows = spark.read.parquet(path).drop("slice_no")
    assert rows.exceptAll(events).count() == events.exceptAll(rows).count() == 0


def test_stream_settings_do_not_leak(spark, scratch):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    src = f"{scratch}/in"
    shutil.copytree(_in_parts(spark, f"{scratch}/sf") + "/events.parquet", src)
    schema = spark.read.parquet(src).schema
    events = spark.readStream.schema(schema).parquet(src).withColumnRenamed("ts", "event_time")
    q = start_window_job(events, aggs={"n": F.count(F.lit(1))}, size="60 minutes", slide="5 minutes",
                         watermark="5 minutes", sink=lambda df, i: df.write.format("noop").mode("append").save(), checkpoint=f"{scratch}/c",
                         entity="event_type", trigger={"availableNow": True}, state_store="rocksdb",
                         state_partitions=3)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")
    q.awaitTermination(120)
    assert q.exception() is None


def test_rank_top_equals_the_full_rank(spark):
    df = spark.createDataFrame([(i, float(i * 7 % 10) if i % 6 else None) for i in range(60)],
                               "id long, v double")
    for k in (1, 5, 59, 200):
        for desc in (True, False):
            want = rank_within(df, [("v", desc)], out="r").where(F.col("r") <= k)
            got = rank_top(df, ("v", desc), k, out="r")
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_ordered(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a")], "x int, y string")
    assert [r.x for r in ordered(df, ["y"]).collect()] == [2, 3, 1]
    assert [r.x for r in ordered(df, ["none", "x:desc"]).collect()] == [3, 2, 1]
    assert ordered(df, []) is df

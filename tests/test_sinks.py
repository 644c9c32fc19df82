"""Sinks: JDBC round trip (embedded in-memory Derby, no server), contract
enforcement, partitioned writes, micro-batch sink on empty batches."""

import os

import pytest
from pyspark.sql import functions as F

from stratus.sinks.contracts import CONTRACTS, conform
from stratus.sinks.writers import batch_sink, write_jdbc, write_observations

DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def test_jdbc_round_trip(spark):
    url = "jdbc:derby:memory:stratus_test;create=true"
    df = spark.createDataFrame([("Oslo", 1, 2.5), ("Dubai", 2, 7.25)],
                               "city_name string, rank int, v double")
    write_jdbc(df, "RESULT_T", url, DERBY, num_partitions=1)
    back = (spark.read.format("jdbc").option("url", url).option("dbtable", "RESULT_T")
            .options(**DERBY).load())
    assert sorted((r[0], r[1], r[2]) for r in back.collect()) == [("Dubai", 2, 7.25),
                                                                   ("Oslo", 1, 2.5)]
    write_jdbc(df.limit(1), "RESULT_T", url, DERBY)   # overwrite replaces the table
    assert back.count() == 1


def test_conform_orders_casts_and_rejects(spark):
    df = spark.createDataFrame([(1, "x", 2.0, 3.0, 4.0, 5)],
                               "rank long, city_name string, avg_temp_variation double, "
                               "max_single_day_variation double, min_single_day_variation double,"
                               " extra int")
    out = conform(df, CONTRACTS["diurnal_temp_variation"])
    assert out.columns == ["city_name", "avg_temp_variation", "max_single_day_variation",
                           "min_single_day_variation", "rank"]
    assert dict(out.dtypes)["rank"] == "int"
    with pytest.raises(ValueError):
        conform(df.drop("rank"), CONTRACTS["diurnal_temp_variation"])
    with pytest.raises(ValueError):
        conform(df, CONTRACTS["diurnal_temp_variation"], allow_extra=False)


def test_partitioned_write_dynamic_overwrite(spark, scratch):
    path = os.path.join(scratch, "obs")
    df = spark.createDataFrame([(1999, 12, 1.0), (2000, 1, 2.0), (2000, 1, 3.0)],
                               "year int, month int, v double")
    write_observations(df, path)
    # reloading one month replaces only that month
    write_observations(spark.createDataFrame([(2000, 1, 9.0)], "year int, month int, v double"),
                       path)
    got = sorted((r.year, r.month, r.v) for r in spark.read.parquet(path).collect())
    assert got == [(1999, 12, 1.0), (2000, 1, 9.0)]


def test_batch_sink_skips_empty_and_tags_batch(spark, scratch):
    path = os.path.join(scratch, "sink")
    sink = batch_sink("parquet", path=path, transform=lambda d: d.withColumn("x", F.lit(1)))
    empty = spark.createDataFrame([], "a int")
    sink(empty, 0)
    assert not os.path.exists(path)
    sink(spark.createDataFrame([(5,)], "a int"), 7)
    r = spark.read.parquet(path).first()
    assert (r.a, r.x, r.batch_id) == (5, 1, 7)


def test_idempotent_sink_replaces_a_retried_batch(spark, scratch):
    path = os.path.join(scratch, "idem")
    sink = batch_sink("parquet", path=path, idempotent=True)
    sink(spark.createDataFrame([(1,), (2,)], "a int"), 0)
    sink(spark.createDataFrame([(3,)], "a int"), 1)
    sink(spark.createDataFrame([(3,)], "a int"), 1)      # the same batch again
    got = sorted((r.batch_id, r.a) for r in spark.read.parquet(path).collect())
    assert got == [(0, 1), (0, 2), (1, 3)]

"""Sources and sinks bound to the driver tables: what is written is read back, so
every query's rows passed through the files it is about.

* ``csv_quarantine``    delimited text with ragged lines and bad values
* ``partition_reload``  partitioned write, one month replaced, pruned read
* ``kafka_payloads``    records with binary JSON payloads and their rejects
* ``published_pair``    two results published together, or not at all
* ``batch_ledger``      micro-batches that are delivered twice
* ``text_times``        text times in several formats
* ``ordered_files``     a global sort as files with disjoint ranges
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratus.functions.calendar import utc_wall_clock
from stratus.operators.buckets import bucket_summary, quantile_bucket
from stratus.operators.enrich import enrich, quarantine
from stratus.plans.driver import SCALE, _BUCKET_MEANS
from stratus.session import materialize, scratch_path
from stratus.sinks.publish import publish, read_published
from stratus.sinks.writers import (
    batch_sink, once_per_batch, read_ledger, read_ordered, replace_partition, write_observations,
    write_ordered,
)
from stratus.sources.events import accept_payloads
from stratus.sources.observations import read_observations, read_observations_csv, split_corrupt
from stratus.sources.tables import shipment_observations, table

# --- delimited text -----------------------------------------------------------

CSV_TYPES = {"l_orderkey": T.LongType(), "l_linenumber": T.IntegerType(),
             "l_quantity": T.DoubleType(), "l_extendedprice": T.DoubleType(),
             "l_shipdate": T.DateType(), "l_returnflag": T.StringType()}


def write_csv_lines(lines: DataFrame, header: str, path: str) -> None:
    """The text column ``line`` as a CSV table: each file begins with ``header``."""
    (lines.select(F.col("line").alias(header)).write.option("header", True)
     .option("sep", "\u0001").option("quote", "").option("escape", "").csv(path))


def _csv_lines(li: DataFrame) -> DataFrame:
    """Line items as text, each fortieth with each of seven peculiarities."""
    kind = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 40
    amount = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    plain = [F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
             amount("l_quantity"), amount("l_extendedprice"),
             F.date_format("l_shipdate", "yyyy-MM-dd"), F.col("l_returnflag")]

    def line(**changed: Column) -> Column:
        return F.concat_ws(",", *[changed.get(f"f{i}", c) for i, c in enumerate(plain)])
    return li.select(
        F.when(kind == 0, F.concat_ws(",", *plain[:4]))                       # too few fields
        .when(kind == 1, F.concat_ws(",", *plain, F.lit("extra")))            # too many
        .when(kind == 2, line(f2=F.lit("n/a")))                               # not a number
        .when(kind == 3, line(f3=F.lit("12.3.4")))
        .when(kind == 4, line(f4=F.lit("1996-13-45")))                        # not a date
        .when(kind == 5, line(f5=F.concat(F.lit('"'), plain[5], F.lit(',x"'))))      # quoted
        .when(kind == 6, line(f2=F.lit("")))                                  # a missing value
        .otherwise(line()).alias("line"))


def q_csv_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that fit their schema, and the raw lines of those that don't."""
    path = scratch_path(spark, "csv")
    write_csv_lines(_csv_lines(table(spark, sf, "lineitem")), ",".join(CSV_TYPES), path)
    good, bad = split_corrupt(
        read_observations_csv(spark, path, CSV_TYPES, corrupt="_corrupt"), "_corrupt")
    return (good.withColumn("raw_line", F.lit(None).cast("string"))
            .unionByName(bad.withColumnRenamed("_corrupt", "raw_line"), allowMissingColumns=True))


# --- partitioned table --------------------------------------------------------

RELOADED = {"year": 1996, "month": 3}
RANGE = ((1996, 2), (1997, 1))


def write_shipments(spark: SparkSession, sf: str) -> str:
    """Shipments by year and month; one month then is replaced: its larger
    quantities come again, raised by 100."""
    path = scratch_path(spark, "shipments")
    rows = shipment_observations(spark, sf).select(
        "n_name", "l_shipdate", "l_quantity", "year", "month")
    write_observations(rows, path)
    again = (read_observations(spark, path, between=((1996, 3), (1996, 3)))
             .where(F.col("l_quantity") > 10).withColumn("l_quantity", F.col("l_quantity") + 100))
    # the month is read from the files that it replaces
    replace_partition(materialize(again, "reload"), path, **RELOADED)
    return path


def q_partition_reload(spark, sf):
    return read_observations(spark, write_shipments(spark, sf), between=RANGE)


# --- payloads -----------------------------------------------------------------

PAYLOAD = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("main", T.StructType([T.StructField("temp", T.DoubleType()),
                                        T.StructField("humidity", T.IntegerType())])),
    T.StructField("wind", T.StructType([T.StructField("gust", T.DoubleType())])),
])
PAYLOAD_FIELDS = {"name": "name", "temperature": "main.temp", "humidity": "main.humidity",
                  "gust": "wind.gust"}
RECORD = ["topic", "partition", "offset", "timestamp"]


def kafka_records(events: DataFrame) -> DataFrame:
    """Events as the Kafka source gives them: key and value are binary. Each
    fiftieth record has each of seven faults, and one kind lacks an optional field."""
    kind = F.col("event_id") % 50
    k = F.get_json_object("props", "$.k")
    value = F.col("value").cast("decimal(18,2)").cast("string")
    name = F.concat(F.lit('"name":"'), F.col("event_type"), F.lit('"'))
    main = F.concat(F.lit('"main":{"temp":'), value, F.lit(',"humidity":'), k, F.lit("}"))
    wind = F.concat(F.lit('"wind":{"gust":'), k, F.lit('.5,"deg":1},"other":[1]'))
    body = F.concat(F.lit("{"), F.concat_ws(",", name, main, wind), F.lit("}"))
    text = (F.when(kind == 0, F.substring(body, 1, 20))                       # cut off
            .when(kind == 1, F.lit("[1, 2]")).when(kind == 2, F.lit(""))
            .when(kind == 3, F.replace(body, F.lit('"humidity":'), F.lit('"humidity":"x",'
                                                                         '"was":')))
            .when(kind == 4, F.concat(F.lit("{"), F.concat_ws(",", main, wind), F.lit("}")))
            .when(kind == 5, F.concat(F.lit("{"), F.concat_ws(",", name, main), F.lit("}")))
            .otherwise(body))
    raw = (F.when(kind == 6, F.lit(None).cast("binary"))
           .when(kind == 7, F.concat(text.cast("binary"), F.unhex(F.lit("FF"))))
           .otherwise(text.cast("binary")))
    return events.select(
        F.col("user_id").cast("string").cast("binary").alias("key"), raw.alias("value"),
        F.lit("observations").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"),
        F.col("event_id").alias("offset"), F.col("ts").alias("timestamp"))


def q_kafka_payloads(spark, sf):
    accepted, rejected = accept_payloads(
        kafka_records(table(spark, sf, "events")), PAYLOAD, PAYLOAD_FIELDS,
        required=("name", "main.temp"), keep=RECORD, store=materialize)
    return accepted.unionByName(rejected.drop("value"), allowMissingColumns=True)


# --- results that belong together ------------------------------------------------

def quartile_pair(obs: DataFrame) -> dict[str, DataFrame]:
    detail = materialize(quantile_bucket(
        obs, "n_name", _BUCKET_MEANS, "avg_daily_discount",
        names=("discount_quartile", "quartile_label"), scale=SCALE), "detail")
    return {"detail": detail, "summary": bucket_summary(detail, {
        "avg_quantity_in_quartile": "avg_quantity",
        "avg_daily_discount_in_quartile": "avg_daily_discount",
        "avg_price_in_quartile": "avg_price",
    }, keys=("discount_quartile", "quartile_label"), scale=SCALE)}


def q_published_pair(spark, sf):
    """Both quartile tables as readers see them: after the first publication, after one
    that failed between its two writes, and after the next."""
    path, obs = scratch_path(spark, "published"), shipment_observations(spark, sf)

    def seen(stage):
        detail, summary = read_published(spark, path, "detail", "summary")
        return materialize(detail.join(summary, ["discount_quartile", "quartile_label"])
                           .withColumn("stage", F.lit(stage)), "seen")
    publish(spark, path, quartile_pair(obs.where(F.col("l_shipdate") < "1998-01-01")))
    first = seen("first")
    pair = quartile_pair(obs)
    broken = pair["summary"].withColumn("avg_price_in_quartile", F.raise_error(
        F.lit("stopped between the writes")).cast("double"))
    try:
        publish(spark, path, pair | {"summary": broken})
    except Exception as stop:  # noqa: BLE001  (Spark wraps it)
        if "stopped between the writes" not in str(stop):
            raise
    after_failure = seen("after failure")
    publish(spark, path, pair)
    return first.unionByName(after_failure).unionByName(seen("second"))


# --- deliveries ---------------------------------------------------------------

def q_batch_ledger(spark, sf):
    """Five batches, one of them empty, delivered nine times in all."""
    path, ledger = scratch_path(spark, "sink"), scratch_path(spark, "ledger")
    events = table(spark, sf, "events").select("event_id", "user_id", "value")
    store = batch_sink("parquet", path=path, idempotent=True)

    def interrupted(batch, batch_id):
        store(batch, batch_id)
        raise RuntimeError("stopped after the write")

    def part(i):
        return events.where(F.col("event_id") % 4 == i)
    empty = events.where("event_id < 0 AND event_id > 0")
    run = once_per_batch(store, ledger)
    for batch_id, batch in [(0, part(0)), (1, part(1)), (1, part(1)), (2, empty), (2, empty),
                            (0, part(0))]:
        run(batch, batch_id)
    try:
        once_per_batch(interrupted, ledger)(part(2), 3)
    except RuntimeError:
        run(part(2), 3)
    run(part(3), 4)
    # a ledger has one entry a batch
    order = read_ledger(spark, ledger).withColumn(
        "delivery", F.row_number().over(Window.orderBy("computed_at")))
    return (spark.read.parquet(path).join(F.broadcast(order), ["batch_id", "computed_at"])
            .select("event_id", "user_id", "value", F.col("batch_id").cast("long").alias("batch_id"),
                    "delivery"))


# --- text times ---------------------------------------------------------------

TIME_PATTERNS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "dd/MM/yyyy HH:mm")


def with_text_times(events: DataFrame) -> DataFrame:
    """``ts`` as text, in three formats; each twelfth is missing, blank, no such
    time, cut off or of no known format."""
    kind = F.col("event_id") % 12
    iso = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return events.withColumn("ts", (
        F.when(kind == 0, F.lit(None).cast("string")).when(kind == 1, F.lit("  "))
        .when(kind == 2, F.concat(F.lit("2024-02-30 "), F.date_format("ts", "HH:mm:ss")))
        .when(kind == 3, F.substring(iso, 1, 10)).when(kind == 4, F.lit("yesterday"))
        .when(kind == 5, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
        .when(kind == 6, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
        .when(kind == 7, F.date_format("ts", "dd/MM/yyyy HH:mm"))
        .when(kind == 8, F.concat(F.lit(" "), iso, F.lit(" "))).otherwise(iso)))


def q_text_times(spark, sf):
    """Enriched rows, and those whose time did not parse with the reason."""
    events = with_text_times(table(spark, sf, "events").select(
        "event_id", "ts", "event_type", "value"))
    rows = enrich(events, time_col="ts", entity_col="event_type", conversions={"value": (3.6, 2)},
                  flags={}, drop=(), time_pattern=TIME_PATTERNS, reason_col="time_error")
    good, bad = quarantine(rows, "ts")
    return good.unionByName(bad).withColumn("ts", utc_wall_clock("ts"))


# --- global order -------------------------------------------------------------

ORDER_FILES = 16


def q_ordered_files(spark, sf):
    """Orders by price, numbered from the files that hold them in order."""
    path = scratch_path(spark, "ordered")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    write_ordered(orders, path, ["o_totalprice:desc", "o_orderkey"], files=ORDER_FILES)
    return read_ordered(spark, path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "csv_quarantine": q_csv_quarantine,
    "partition_reload": q_partition_reload,
    "kafka_payloads": q_kafka_payloads,
    "published_pair": q_published_pair,
    "batch_ledger": q_batch_ledger,
    "text_times": q_text_times,
    "ordered_files": q_ordered_files,
}

"""Event sources: JSON payloads from Kafka or files, flattened to columns.

Batch and streaming frames are handled alike; ``read_event_stream`` only
chooses the source."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Declared payload of one observation event. Unknown JSON fields are ignored;
# a malformed document or a value of the wrong type gives NULL fields.
EVENT_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("main", T.StructType([
        T.StructField("temp", T.DoubleType()),
        T.StructField("humidity", T.IntegerType()),
        T.StructField("pressure", T.DoubleType()),
    ])),
    T.StructField("clouds", T.StructType([T.StructField("all", T.DoubleType())])),
    T.StructField("wind", T.StructType([
        T.StructField("speed", T.DoubleType()),
        T.StructField("deg", T.DoubleType()),
        T.StructField("gust", T.DoubleType()),
    ])),
])

# Flattened names used by the alert operators.
EVENT_FIELDS = {
    "city": "name",
    "temperature": "main.temp",
    "humidity": "main.humidity",
    "pressure": "main.pressure",
    "cloud_cover": "clouds.all",
    "wind_speed": "wind.speed",
    "wind_deg": "wind.deg",
    "wind_gust": "wind.gust",
    "payload_time": "timestamp",
}


def parse_events(df: DataFrame, value_col: str = "value",
                 schema: T.StructType = EVENT_SCHEMA, out: str = "data") -> DataFrame:
    """Parse a JSON text (or Kafka binary) column into struct ``out``."""
    return df.withColumn(out, F.from_json(F.col(value_col).cast("string"), schema))


def accept_payloads(records: DataFrame, schema: T.StructType = EVENT_SCHEMA,
                    fields: Mapping[str, str] = EVENT_FIELDS, required: Sequence[str] = ("name",),
                    value_col: str = "value", keep: Sequence[str] = (),
                    store: Callable[[DataFrame], DataFrame] | None = None
                    ) -> tuple[DataFrame, DataFrame]:
    """Records with a binary (or text) JSON payload as (accepted, rejected).

    Accepted rows hold ``keep`` and the payload's ``fields`` as columns. Rejected
    ones hold ``keep``, the payload as it came and a ``reason``: ``no payload``, ``not
    UTF-8``, ``not JSON`` (also an array or a bare value), ``wrong type`` (a declared
    field holds another type) or ``no <path>`` for the first required path without
    a value. One projection over the records, batch or stream: each branch filters it.
    The reason passes a generator of one row, which filters stay above; otherwise Spark
    puts the whole parsing into the filter, once for every place that names it. With
    ``store`` (such as ``materialize``) both branches read what it stored of a batch, so
    each payload is parsed once.
    """
    raw = F.col(value_col)
    text = F.try_validate_utf8(raw.cast("string"))
    whole = T.StructType([*schema.fields, T.StructField("_line", T.StringType())])
    parsed = F.from_json(text, whole, {"columnNameOfCorruptRecord": "_line"})
    # JSON that Spark reads as a document of any kind, to tell it from none
    any_kind = F.try_parse_json(text)
    reason = (F.when(raw.isNull(), "no payload").when(text.isNull(), "not UTF-8")
              .when(~F.coalesce(F.schema_of_variant(any_kind).startswith("OBJECT"), F.lit(False)),
                    "not JSON")
              .when(F.col("_data._line").isNotNull(), "wrong type"))
    for path in required:
        reason = reason.when(F.col(f"_data.{path}").isNull(), f"no {path}")
    marked = (records.withColumn("_data", parsed).withColumn("_reason", reason)
              .withColumn("_reason", F.explode(F.array("_reason"))))
    if store:
        marked = store(marked)
    accepted = flatten_event(marked.where("_reason IS NULL"), fields, "_data", tuple(keep))
    rejected = marked.where("_reason IS NOT NULL").select(
        *keep, F.col(value_col), F.col("_reason").alias("reason"))
    return accepted, rejected


def flatten_event(df: DataFrame, fields: Mapping[str, str] = EVENT_FIELDS,
                  struct: str = "data", keep: tuple[str, ...] = ()) -> DataFrame:
    """Project nested payload paths to top-level columns."""
    cols = [F.col(f"{struct}.{path}").alias(name) for name, path in fields.items()]
    return df.select(*keep, *cols)


def read_event_stream(spark: SparkSession, source: str, *, path: str | None = None,
                      options: Mapping[str, str] | None = None,
                      schema: T.StructType = EVENT_SCHEMA,
                      max_per_trigger: int | None = None,
                      file_schema: T.StructType | None = None,
                      file_format: str = "json") -> DataFrame:
    """Streaming frame of parsed events with an ``event_time`` column.

    ``source='kafka'``: ``options`` are the Kafka source options (bootstrap
    servers, subscribe, startingOffsets …); event time is the record
    timestamp; ``max_per_trigger`` maps to ``maxOffsetsPerTrigger``. The Kafka
    connector jar must be on the classpath.

    ``source='files'``: a directory of JSON lines (``file_format='json'``,
    payload per line, event time in column ``event_time`` if present) or any
    other file format with ``file_schema``; ``max_per_trigger`` maps to
    ``maxFilesPerTrigger``. Files are the replay form of the stream.
    """
    opts = dict(options or {})
    if source == "kafka":
        reader = spark.readStream.format("kafka").options(**opts)
        if max_per_trigger:
            reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
        raw = reader.load()
        parsed = parse_events(raw.select("value", F.col("timestamp").alias("event_time")))
        return flatten_event(parsed, keep=("event_time",))
    if source == "files":
        reader = spark.readStream.options(**opts)
        if max_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_per_trigger)
        if file_format == "json":
            fields = list(schema.fields)
            if "event_time" not in schema.fieldNames():
                fields.append(T.StructField("event_time", T.TimestampType()))
            raw = reader.schema(T.StructType(fields)).json(path)
            return raw.select("event_time",
                              *[F.col(p).alias(n) for n, p in EVENT_FIELDS.items()])
        if file_schema is None:
            raise ValueError("file_schema is required for non-JSON file streams")
        return reader.schema(file_schema).format(file_format).load(path)
    raise ValueError(f"unknown source {source!r}")

"""Sources and sinks: what they refuse, keep apart, replace and number."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratus.functions.calendar import parse_time_any
from stratus.operators.enrich import enrich, quarantine
from stratus.plans import ingest as I
from stratus.plans import weather as W
from stratus.sinks import publish as P
from stratus.sinks import writers
from stratus.sinks.writers import (
    batch_sink, once_per_batch, read_ledger, read_ordered, replace_partition, write_observations,
    write_ordered,
)
from stratus.sources.events import EVENT_SCHEMA, accept_payloads, read_event_stream
from stratus.sources.observations import read_observations, read_observations_csv, split_corrupt
from tests.conftest import SF_SMALL

# ------------------------------------------------------------------ delimited text

TYPES = {"id": T.IntegerType(), "v": T.DoubleType(), "name": T.StringType()}


def _csv(folder, **files):
    os.makedirs(folder, exist_ok=True)
    for name, text in files.items():
        with open(os.path.join(folder, f"{name}.csv"), "w") as fh:
            fh.write(text)
    return folder


def test_corrupt_lines_are_kept_apart(spark, scratch):
    path = _csv(f"{scratch}/in", a='id,v,name\n1,2.5,x\n2,bad,y\n3\n4,1.0,z,more\n5,,"a,b"\n',
                b='id,v,name\n\n6,7,\nseven,7,q\n8,1e3,"open\n')
    raw = read_observations_csv(spark, path, TYPES, corrupt="_line")
    good, bad = split_corrupt(raw, "_line")
    assert sorted(map(tuple, good.collect())) == [
        (1, 2.5, "x"), (5, None, "a,b"), (6, 7.0, None)] + (
        [(8, 1000.0, "open")] if good.count() == 4 else [])
    lines = {r[0] for r in bad.collect()}
    assert {"2,bad,y", "3", "4,1.0,z,more", "seven,7,q"} <= lines
    assert good.count() + bad.count() == 8          # the blank line is no row


def test_a_narrow_query_sees_the_same_corrupt_lines(spark, scratch):
    """Columns that a query does not read must not hide their faults."""
    path = _csv(f"{scratch}/in", a="id,v,name\n1,bad,x\n2,1.0,y\n3,1.0\n")
    good, bad = split_corrupt(read_observations_csv(spark, path, TYPES, corrupt="_line"), "_line")
    assert good.select("id").collect() == [(2,)] and good.count() == 1
    assert bad.count() == 2


def test_differing_headers_still_fail(spark, scratch):
    path = _csv(f"{scratch}/in", a="id,v,name\n1,1.0,x\n", b="v,id,name\n1.0,2,y\n")
    with pytest.raises(Exception, match="header|schema"):
        read_observations_csv(spark, path, TYPES, corrupt="_line").collect()


def test_strict_ingest_writes_raw_lines_and_bad_times(spark, scratch):
    head = "datetime,city_name,temperature_2m,snowfall,direct_radiation,cloud_cover"
    path = _csv(f"{scratch}/in", a=f"{head}\n2000-01-01 06:00:00, Oslo ,1.5,0,0,0\n"
                "2000-01-01 07:00:00,Oslo,warm,0,0,0\nnever,Oslo,1.0,0,0,0\n2000-01-01 08:00:00,Oslo\n")
    counts = W.ingest(spark, path, f"{scratch}/obs", f"{scratch}/rejected", strict=True)
    assert counts == {"rows": 4, "rejected": 1, "corrupt": 2}
    assert [r.city_name for r in read_observations(spark, f"{scratch}/obs").collect()] == ["Oslo"]
    lines = spark.read.text(f"{scratch}/rejected/lines").collect()
    assert sorted(r[0] for r in lines) == ["2000-01-01 07:00:00,Oslo,warm,0,0,0",
                                           "2000-01-01 08:00:00,Oslo"]
    assert spark.read.parquet(f"{scratch}/rejected/times").count() == 1


# ------------------------------------------------------------------ partitioned table

def test_pruned_read_touches_the_chosen_folders_only(spark):
    path = I.write_shipments(spark, SF_SMALL)
    got = read_observations(spark, path, between=I.RANGE)
    run = got._jdf.queryExecution()
    filters = run.executedPlan().toString().split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "year" in filters and "month" in filters
    run.toRdd().count()
    scan = run.executedPlan().collectLeaves().head()
    read = {n: scan.metrics().apply(n).value() for n in ("numPartitions", "numFiles")}
    every = [(int(f.split("year=")[1][:4]), int(f.split("month=")[1].split("/")[0]))
             for f in spark.read.parquet(path).inputFiles()]
    chosen = [(y, m) for y, m in every if 199602 <= 100 * y + m <= 199701]
    assert read == {"numPartitions": len(set(chosen)), "numFiles": len(chosen)}
    assert 10 <= len(set(chosen)) <= 12 < len(set(every)) / 4


def test_replace_partition_replaces_nothing_else(spark, scratch):
    path = f"{scratch}/t"
    rows = [(y, m, float(i)) for y in (2000, 2001) for m in (1, 2) for i in range(3)]
    write_observations(spark.createDataFrame(rows, "year int, month int, v double"), path)
    new = spark.createDataFrame([(2000, 2, 9.0)], "year int, month int, v double")
    replace_partition(new, path, year=2000, month=2)
    held = lambda: sorted((r.year, r.month, r.v) for r in spark.read.parquet(path).collect())
    want = sorted([r for r in rows if r[:2] != (2000, 2)] + [(2000, 2, 9.0)])
    assert held() == want
    stray = new.unionByName(spark.createDataFrame([(2001, 1, 5.0)], new.schema))
    with pytest.raises(Exception, match="outside year=2000/month=2"):
        replace_partition(stray, path, year=2000, month=2)
    assert held() == want                              # neither partition was touched
    replace_partition(new.limit(0), path, year=2000, month=2)
    assert held() == [r for r in want if r[:2] != (2000, 2)]


# ------------------------------------------------------------------ payloads

CASES = [
    (b'{"name":"Oslo","main":{"temp":1.5,"humidity":60},"new":[1]}', None),
    (b'{"name":"Oslo"}', "no main.temp"), (b'{"main":{"temp":1}}', "no name"),
    (b'{"name":null,"main":{"temp":1}}', "no name"), (None, "no payload"), (b"", "not JSON"),
    (b"{", "not JSON"), (b'["a"]', "not JSON"), (b'"a"', "not JSON"), (b"\xff{}", "not UTF-8"),
    (b'{"name":"Oslo","main":{"temp":"warm"}}', "wrong type"),
    (b'{"name":"Oslo","main":7}', "wrong type"),
]


def test_payload_reasons(spark):
    records = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(CASES)],
                                    "offset long, value binary")
    good, bad = accept_payloads(records, required=("name", "main.temp"), keep=("offset",))
    assert [(r.offset, r.city, r.temperature, r.humidity) for r in good.collect()] == [
        (0, "Oslo", 1.5, 60)]
    assert {r.offset: r.reason for r in bad.collect()} == {
        i: why for i, (_, why) in enumerate(CASES) if why}
    assert {r.offset: r.value and bytes(r.value) for r in bad.collect()} == {
        i: v for i, (v, why) in enumerate(CASES) if why}


def test_payloads_of_a_stream(spark, scratch):
    lines = [json.dumps({"name": "A", "main": {"temp": i}}) for i in range(4)] + ["broken"]
    os.makedirs(f"{scratch}/in")
    with open(f"{scratch}/in/a.txt", "w") as fh:
        fh.write("\n".join(lines))
    stream = spark.readStream.text(f"{scratch}/in").withColumn("value", F.col("value").cast("binary"))
    for name, df in zip(("good", "bad"), accept_payloads(stream, EVENT_SCHEMA)):
        (df.writeStream.format("parquet").option("path", f"{scratch}/{name}")
         .option("checkpointLocation", f"{scratch}/c-{name}").trigger(availableNow=True).start()
         .awaitTermination(120))
    assert spark.read.parquet(f"{scratch}/good").count() == 4
    assert [r.reason for r in spark.read.parquet(f"{scratch}/bad").collect()] == ["not JSON"]


def test_payloads_are_parsed_once(spark):
    """Not once more for every place of a filter that names the parsed record."""
    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()
    events = spark.createDataFrame(
        [(i, None, i, "a", 1.5, '{"k": 3}') for i in range(60)],
        "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    records, stored = I.kafka_records(events), []
    for df in accept_payloads(records, I.PAYLOAD, I.PAYLOAD_FIELDS, ("name", "main.temp")):
        assert plan(df).count("from_json(") == 1 and plan(df).count("parseJson(") <= 2

    def store(df):
        stored.append(df)
        return I.materialize(df)
    pairs = [accept_payloads(records, I.PAYLOAD, I.PAYLOAD_FIELDS, ("name", "main.temp"),
                             keep=("offset",), store=s) for s in (None, store)]
    assert len(stored) == 1 and not any("from_json(" in plan(df) for df in pairs[1])
    for one, two in zip(*pairs):
        assert one.schema == two.schema
        assert sorted(one.collect()) == sorted(two.collect()) != []


def test_kafka_needs_its_connector(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        read_event_stream(spark, "kafka", options={"subscribe": "t"})


# ------------------------------------------------------------------ publications

def test_a_failed_publication_leaves_the_last_one(spark, scratch):
    path = f"{scratch}/pub"
    one, two = spark.range(3), spark.range(5)
    with pytest.raises(FileNotFoundError):
        P.read_published(spark, path, "a")
    first = P.publish(spark, path, {"a": one, "b": one})
    broken = two.select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        P.publish(spark, path, {"a": two, "b": broken})
    assert P.current(spark, path) == first
    assert [d.count() for d in P.read_published(spark, path, "a", "b")] == [3, 3]
    opened = P.read_published(spark, path, "a", "b")
    P.publish(spark, path, {"a": two, "b": two}, keep=3)
    assert [d.count() for d in opened] == [3, 3]       # a reader keeps what it opened
    assert [d.count() for d in P.read_published(spark, path, "a", "b")] == [5, 5]
    for _ in range(3):
        last = P.publish(spark, path, {"a": one, "b": one})
    assert len([n for n in os.listdir(path) if n.startswith("v")]) == 2
    assert P.current(spark, path) == last
    assert not [n for n in os.listdir(path) if n.startswith("CURRENT-")]


# ------------------------------------------------------------------ deliveries

def test_ledger_skips_known_batches_and_orders_stamps(spark, scratch, monkeypatch):
    path, ledger = f"{scratch}/out", f"{scratch}/ledger"
    calls = []
    store = batch_sink("parquet", path=path, idempotent=True)

    def sink(batch, batch_id):
        calls.append(batch_id)
        store(batch, batch_id)
    run = once_per_batch(sink, ledger)
    clock = iter([5_000_000_000, 4_000_000_000, 3_000_000_000, 9_000_000_000])
    monkeypatch.setattr(writers.time, "time_ns", lambda: next(clock))      # steps back
    df = spark.createDataFrame([(1,), (2,)], "x int")
    for batch_id, batch in [(0, df), (0, df), (1, df.limit(0)), (1, df), (2, df), (7, df)]:
        run(batch, batch_id)
    assert calls == [0, 1, 2, 7]
    stamps = [(r.batch_id, r.us) for r in read_ledger(spark, ledger).withColumn(
        "us", F.unix_micros("computed_at")).orderBy("computed_at").collect()]
    assert stamps == [(0, 5_000_000), (1, 5_000_001), (2, 5_000_002), (7, 9_000_000)]
    rows = spark.read.parquet(path).groupBy("batch_id", F.unix_micros("computed_at").alias("us")).count()
    assert sorted(map(tuple, rows.collect())) == [(0, 5_000_000, 2), (2, 5_000_002, 2),
                                                  (7, 9_000_000, 2)]


# ------------------------------------------------------------------ text times

TEXTS = {
    "2024-02-29 10:00:01": ("2024-02-29 10:00:01", None),
    " 2024-02-29 10:00:01 ": ("2024-02-29 10:00:01", None),
    "2024-02-29T10:00:01Z": ("2024-02-29 10:00:01", None),
    "2024-02-29T10:00:01-03:00": ("2024-02-29 13:00:01", None),
    "29/02/2024 10:00": ("2024-02-29 10:00:00", None),
    "2023-02-29 10:00:01": (None, "not a time"), "2024-01-01T25:00:00Z": (None, "not a time"),
    "32/01/2024 10:00": (None, "not a time"), "2024-02-29": (None, "unknown format"),
    "soon": (None, "unknown format"), "": (None, "empty"), "  ": (None, "empty"),
    None: (None, "missing"),
}


def test_text_times(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    time, reason = parse_time_any("t", I.TIME_PATTERNS)
    got = df.select("t", F.date_format(time, "yyyy-MM-dd HH:mm:ss"), reason).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == TEXTS


def test_enrich_with_one_pattern_keeps_its_reason(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00", "a"), ("x", "b"), (None, "c")],
                               "datetime string, city_name string")
    good, bad = quarantine(enrich(df, flags={}, reason_col="why"))
    assert [r.city_name for r in good.collect()] == ["a"] and good.first().why is None
    assert {r.city_name: r.why for r in bad.collect()} == {"b": "unknown format", "c": "missing"}
    assert "why" not in enrich(df, flags={}).columns


# ------------------------------------------------------------------ global order

def test_ordered_files_do_not_overlap(spark, scratch):
    rows = [(i, None if i % 17 == 0 else (i * 7919) % 101) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, v int").repartition(7)
    write_ordered(df, f"{scratch}/o", ["v:desc", "id"], files=9)
    got = read_ordered(spark, f"{scratch}/o", "n").orderBy("n").collect()
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [(r.id, r.v) for r in got] == want and [r.n for r in got] == list(range(1, 2001))
    spans = (spark.read.parquet(f"{scratch}/o").groupBy(F.input_file_name().alias("f"))
             .agg(F.min(F.struct(-F.coalesce("v", F.lit(-1)), "id")).alias("a"),
                  F.max(F.struct(-F.coalesce("v", F.lit(-1)), "id")).alias("b")).orderBy("f").collect())
    assert len(spans) > 5 and all(x.b < y.a for x, y in zip(spans, spans[1:]))


def test_ordered_files_of_few_rows(spark, scratch):
    df = spark.createDataFrame([(3,), (1,), (1,)], "v int")
    write_ordered(df, f"{scratch}/o", ["v"], files=20)
    assert sorted((r.v, r.row_no) for r in read_ordered(spark, f"{scratch}/o").collect()) == [
        (1, 1), (1, 2), (3, 3)]

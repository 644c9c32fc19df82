"""WARC archives of web pages: writing, reading, and assembly of captures.

Writing. Every page gives a request, a response (or revisit) and a metadata
record. Pages with equal payloads share one response, that of the smallest
page id; the others are revisits that refer to it and carry no payload.
Records are plain WARC/1.1 text, written with Spark's text writer, whose line
separator is the end of a record; files are gzip streams of bounded size.

Reading. Files are taken whole (their size is bounded), unpacked as a stream
and cut by Content-Length, never by a separator, so payloads may hold
anything.

Assembly. Request and metadata records name the record they belong to
(WARC-Concurrent-To). They are joined to it through this identifier, wherever
they lie, and one nested row per capture comes out.

Defined results: a null payload is empty; every row of the smallest page id of
a group is a response (repeated rows are the same capture again), null ids
come last; control characters in an URL are percent-encoded; a null URL gives
records without a target; an empty table gives no records.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratus.llm.common import join_hot_first
from stratus.session import materialize

#: Bytes of records in a file, about.
FILE_BYTES = 16 << 20
#: Payloads shorter than this are never revisits.
REVISIT_FROM = 0
DATE = "2024-01-01T00:00:00Z"

# --- Fixed values of the format ----------------------------------------------
CRLF = "\r\n"
END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
# -----------------------------------------------------------------------------

RECORD = ("type string, record_id string, concurrent_to string, refers_to string, "
          "target_uri string, date string, content_type string, stated_digest string, "
          "http_head string, fields map<string,string>, payload binary")


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary or string column."""
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    sha = F.sha1(data)
    return F.concat(*[F.translate(F.lpad(F.upper(F.conv(F.substring(sha, i, 5), 16, 32)), 4, "0"),
                                  digits, BASE32) for i in range(1, 41, 5)])


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(headers: list[tuple[str, Column | str]], block: Column) -> Column:
    """One record without the blank lines after it; null headers are left out."""
    lines = [F.lit("WARC/1.1")]
    for name, value in [*headers, ("Content-Length", F.octet_length(block).cast("string"))]:
        value = F.lit(value) if isinstance(value, str) else value
        lines.append(F.concat(F.lit(f"{name}: "), value))
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(END), block)


def _clean(url: Column) -> Column:
    for code in (*range(0x20), 0x7F):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return url


def plan_revisits(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """(sha, first): for every payload that two or more rows share, its hash
    and the page id of its response. Aggregated map side."""
    id_ = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("id"))
    return (pages.where(F.col("n") >= revisit_from).groupBy("sha")
            .agg(F.min(id_).alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1")
            .select("sha", F.col("first.id").alias("first")))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", revisit_from: int = REVISIT_FROM, date: str = DATE,
                  file_bytes: int = FILE_BYTES) -> None:
    """Write ``pages`` as WARC files (gzip) under ``path``."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                        payload.alias("payload"))
    rows = rows.withColumns({"sha": F.sha2("payload", 256), "n": F.octet_length("payload")})
    digests = materialize(rows.select("page_id", "sha", "n"), "payload-digests")
    total = digests.agg(F.sum(F.col("n") + 2000)).first()[0] or 0
    files = max(1, -(-int(total) // file_bytes))
    shared = plan_revisits(digests, revisit_from)
    # one payload may be that of most pages
    revisits = materialize(
        join_hot_first(digests.distinct(), "sha", shared, "sha")
        .where(~F.col("page_id").eqNullSafe(F.col("first")))
        .select(F.col("sha").alias("s"), F.col("page_id").alias("p"), "first"), "revisits")
    rows = rows.join(revisits, (F.col("sha") == F.col("s")) & F.col("page_id").eqNullSafe(F.col("p")),
                     "left")
    again = F.col("s").isNotNull()
    own = _uuid(F.col("page_id"), F.col("sha"))
    url, digest = _clean(F.col("url")), F.concat(F.lit("sha1:"), base32_sha1(F.col("payload")))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"
                          "Content-Length: "), F.col("n").cast("string"), F.lit(END))
    http = "application/http; msgtype="
    request = _record(
        [("WARC-Type", "request"), ("WARC-Record-ID", _uuid(F.lit("request"), own)),
         ("WARC-Concurrent-To", own), ("WARC-Target-URI", url), ("WARC-Date", date),
         ("Content-Type", f"{http}request")],
        F.concat(F.lit("GET "), F.coalesce(url, F.lit("/")), F.lit(f" HTTP/1.1{END}")))
    answer = _record(
        [("WARC-Type", F.when(again, "revisit").otherwise("response")), ("WARC-Record-ID", own),
         ("WARC-Refers-To", F.when(again, _uuid(F.col("first"), F.col("sha")))),
         ("WARC-Profile", F.when(again, REVISIT_PROFILE)), ("WARC-Target-URI", url),
         ("WARC-Date", date), ("WARC-Payload-Digest", digest), ("Content-Type", f"{http}response")],
        F.concat(head, F.when(again, "").otherwise(F.col("payload"))))
    metadata = _record(
        [("WARC-Type", "metadata"), ("WARC-Record-ID", _uuid(F.lit("metadata"), own)),
         ("WARC-Concurrent-To", own), ("WARC-Target-URI", url), ("WARC-Date", date),
         ("Content-Type", "application/warc-fields")],
        F.concat(F.lit("payloadLength: "), F.col("n").cast("string"), F.lit(CRLF),
                 F.coalesce(F.concat(F.lit("pageId: "), F.col("page_id").cast("string"),
                                     F.lit(CRLF)), F.lit(""))))
    dealt = F.xxhash64("page_id", "sha", F.monotonically_increasing_id())
    (rows.withColumn("dealt", dealt).repartition(files, "dealt")
     .select(F.concat_ws(END, request, answer, metadata).alias("value"))
     .write.option("lineSep", END).option("compression", "gzip").text(path))


def parse_records(read) -> Iterator[dict]:
    """Records of one unpacked archive. ``read(n)`` gives up to ``n`` bytes."""
    held = bytearray()

    def more(n: int) -> bool:
        while len(held) < n:
            data = read(1 << 20)
            if not data:
                return False
            held.extend(data)
        return True

    while True:
        while held[:2] == b"\r\n" or (len(held) < 2 and more(2) and held[:2] == b"\r\n"):
            del held[:2]
        at = -1
        while (at := held.find(b"\r\n\r\n")) < 0:
            if not more(len(held) + 1):
                if held.strip():
                    raise ValueError("an archive ends inside a record's header")
                return
        lines = bytes(held[:at]).decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        header = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        size = int(header["content-length"])
        if not more(at + 4 + size):
            raise ValueError("an archive ends inside a record's block")
        yield header | {"block": bytes(held[at + 4:at + 4 + size])}
        del held[:at + 4 + size]


def _unpacked(data: bytes):
    """``read(n)`` over a gzip stream of one or more members, or plain bytes."""
    state = {"at": 0, "z": None, "rest": b""}
    packed = data[:2] == b"\x1f\x8b"

    def read(n: int) -> bytes:
        if not packed:
            out = data[state["at"]:state["at"] + n]
            state["at"] += len(out)
            return out
        while True:
            z = state["z"]
            if z is None or z.eof:
                if z is not None:
                    state["rest"] = z.unused_data
                if not state["rest"] and state["at"] >= len(data):
                    return b""
                state["z"] = z = zlib.decompressobj(31)
            more = state["rest"]
            if not more:
                more = data[state["at"]:state["at"] + (1 << 16)]
                state["at"] += len(more)
            out = z.decompress(more, n)
            state["rest"] = z.unconsumed_tail
            if out:
                return out
            if not more:
                return b""
    return read


def _row(record: dict) -> dict:
    block, kind = record["block"], record.get("content-type", "")
    head, fields, payload = None, None, block
    if kind.startswith("application/http"):
        top, _, payload = block.partition(b"\r\n\r\n")
        head = top.decode("utf-8", "replace")
    elif kind.startswith("application/warc-fields"):
        fields = [(k.strip(), v.strip()) for k, _, v in (
            x.partition(":") for x in block.decode("utf-8").split("\r\n") if x)]
        payload = None
    return {"type": record.get("warc-type"), "record_id": record.get("warc-record-id"),
            "concurrent_to": record.get("warc-concurrent-to"),
            "refers_to": record.get("warc-refers-to"), "target_uri": record.get("warc-target-uri"),
            "date": record.get("warc-date"), "content_type": record.get("content-type"),
            "stated_digest": record.get("warc-payload-digest"), "http_head": head,
            "fields": fields, "payload": payload}


_SCHEMA = pa.schema([(n, pa.string()) for n in (
    "type", "record_id", "concurrent_to", "refers_to", "target_uri", "date", "content_type",
    "stated_digest", "http_head")] + [("fields", pa.map_(pa.string(), pa.string())),
                                      ("payload", pa.binary())])


def _parse(batches):
    for batch in batches:
        for data in batch.column(0):
            held, size = [], 0
            for record in parse_records(_unpacked(data.as_py())):
                held.append(_row(record))
                size += len(record["block"])
                if size > 1 << 22 or len(held) >= 1024:
                    yield pa.RecordBatch.from_pylist(held, _SCHEMA)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, _SCHEMA)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under ``path`` (see ``RECORD``)."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_parse, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per response or revisit record, with all columns of it, and the
    records that are concurrent to it as structs ``request`` and ``metadata``
    (null where there is none)."""
    # an archive may hold the same request or metadata record again
    requests = (records.where("type = 'request'").groupBy(F.col("concurrent_to").alias("to"))
                .agg(F.min(F.struct("record_id", "date", "http_head")).alias("request")))
    metadata = (records.where("type = 'metadata'")
                .select(F.col("concurrent_to").alias("to"), "record_id", "date",
                        F.map_entries("fields").alias("entries"))
                .groupBy("to").agg(F.min(F.struct("record_id", "date", "entries")).alias("m"))
                .select("to", F.struct("m.record_id", "m.date", F.map_from_entries("m.entries")
                                       .alias("fields")).alias("metadata")))
    found = records.where(F.col("type").isin("response", "revisit")).drop("concurrent_to", "fields")
    for side in (requests, metadata):
        found = found.join(side, F.col("record_id") == F.col("to"), "left").drop("to")
    return found


def resolve(captures: DataFrame) -> DataFrame:
    """``captures`` with ``page_id`` (text, from the metadata) and
    ``refers_to_page``: that of the response a revisit refers to."""
    named = captures.withColumn("page_id", F.col("metadata.fields")["pageId"])
    target = (named.where("type = 'response'").groupBy(F.col("record_id").alias("t"))
              .agg(F.first("page_id").alias("refers_to_page")))
    # one response may be referred to by most captures
    revisits = named.where("type = 'revisit'")
    found = join_hot_first(revisits, "refers_to", target, "t")
    lost = revisits.join(target, F.col("refers_to") == F.col("t"), "left_anti")
    none = F.lit(None).cast("string")
    return (named.where("type = 'response'").unionByName(lost).withColumn("refers_to_page", none)
            .unionByName(found))


def captures(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Captures of the archives under ``path`` with payload_bytes and
    payload_digest of the full payload: measured where the payload is stored,
    as stated by the record for revisits.

    The archives are read once: records are written as a table, without their payloads
    unless ``payloads``, and assembled from it."""
    records = read_records(spark, path).withColumns({
        "payload_bytes": F.octet_length("payload").cast("long"),
        "payload_digest": base32_sha1(F.col("payload"))})
    records = materialize(records if payloads else records.drop("payload"), "records")
    stated = F.regexp_extract("http_head", r"(?i)(?:^|\r\n)Content-Length:\s*(\d+)", 1).cast("long")
    again = F.col("type") == "revisit"
    return resolve(assemble(records)).withColumns({
        "payload_bytes": F.when(again, stated).otherwise(F.col("payload_bytes")),
        "payload_digest": F.when(again, F.regexp_replace("stated_digest", "^sha1:", ""))
        .otherwise(F.col("payload_digest"))})

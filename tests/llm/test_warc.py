import base64
import gzip
import hashlib
import io
import random

import pytest

import stratus.llm.warc as W
from stratus.session import scratch_path

SCHEMA = "page_id long, url string, html string, type string"
HTML = ["", None, "<p>a</p>", "WARC/1.1\r\n\r\n", "x\r\n\r\ny\n", "é 東京 \x00", "hot", "big " * 90000,
        "\r\n", "last\r\n\r\n"]


def rows():
    random.seed(3)
    out = [(i, random.choice([f"http://h/{i}", None, "http://x/\r\nWARC-Type: y"]),
            random.choice(HTML + ["hot"] * 6), "c") for i in range(120)]
    return out + [(2, "u", out[2][2], "c"), (500, "u", "alone", "c"), (500, "u", "alone", "c"),
                  (None, "u", "hot", "c"), (None, "u", "none", "c")]


def expected(data, least=0):
    groups = {}
    for i, _, h, *_ in data:
        groups.setdefault(h or "", []).append(i)
    out = []
    for i, _, h, *_ in data:
        raw = (h or "").encode()
        known = [x for x in groups[h or ""] if x is not None]
        first = min(known) if known else None
        again = len(raw) >= least and i != first
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                    "revisit" if again else "response", first if again else None))
    return sorted(map(str, out))


@pytest.mark.parametrize("least,file_bytes", [(0, 1 << 24), (5, 3000)])
def test_round_trip(spark, least, file_bytes):
    data, path = rows(), scratch_path(spark, "warc")
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    W.write_archive(df, path, revisit_from=least, file_bytes=file_bytes)
    got = W.captures(spark, path).collect()
    as_id = lambda x: None if x is None else int(x)
    assert sorted(str((as_id(r.page_id), r.payload_bytes, r.payload_digest, r.type,
                       as_id(r.refers_to_page))) for r in got) == expected(data, least)
    texts = sorted(h or "" for _, _, h, *_ in data)
    stored = {r.record_id: bytes(r.payload).decode() for r in got if r.type == "response"}
    assert sorted(stored[r.record_id if r.type == "response" else r.refers_to] for r in got) == texts
    for r in got:
        assert r.stated_digest == "sha1:" + r.payload_digest
        assert r.request.record_id != r.metadata.record_id != r.record_id
        assert r.request.http_head.startswith("GET ") and r.metadata.fields["payloadLength"]
        assert r.target_uri is None or "\n" not in r.target_uri


def test_hot_payload_and_captures_without_payloads(spark, monkeypatch):
    """Most pages share the empty payload; keys beyond the broadcast ones are shuffled."""
    import stratus.llm.common as C
    data = [(i, "u", "" if i % 3 else f"p{i % 5}", "c") for i in range(200)]
    for hot in (1024, 1):
        monkeypatch.setattr(C.join_hot_first, "__defaults__", (hot,))
        path = scratch_path(spark, "warc")
        W.write_archive(spark.createDataFrame(data, SCHEMA), path)
        got = W.captures(spark, path, payloads=False)
        assert "payload" not in got.columns
        assert sorted(str((int(r.page_id), r.payload_bytes, r.payload_digest, r.type,
                           r.refers_to_page and int(r.refers_to_page))) for r in got.collect()
                      ) == expected(data)


def test_revisit_of_a_record_that_is_not_there(spark):
    row = lambda t, i, refers, page: (t, i, None, refers, "u", "d", "c", None, "head", None, b"p", page)
    data = [row("response", "a", None, "1"), row("revisit", "b", "a", "2"), row("revisit", "c", "gone", "3"),
            row("revisit", "d", None, "4")]
    df = spark.createDataFrame(data, W.RECORD + ", page string").withColumn(
        "metadata", W.F.struct(W.F.create_map(W.F.lit("pageId"), "page").alias("fields")))
    got = W.resolve(df).collect()
    assert sorted((r.page_id, r.refers_to_page) for r in got if r.refers_to_page) == [("2", "1")]
    assert sorted(r.page_id for r in got) == ["1", "2", "3", "4"]


def test_records_in_any_order_and_alone(spark):
    row = lambda t, i, to=None, f=None: (t, i, to, None, "u", "d", "c", None, f"{t} head", f, b"p")
    data = [row("metadata", "m1", "a", {"pageId": "1"}), row("response", "b"), row("request", "r1", "a"),
            row("response", "a"), row("request", "r9", "gone"), row("request", "r1", "a"),
            row("warcinfo", "w"), row("response", "a")]
    got = W.assemble(spark.createDataFrame(data, W.RECORD)).collect()
    assert sorted((r.record_id, r.request and r.request.record_id, r.metadata and
                   r.metadata.fields["pageId"]) for r in got if r.request) == [("a", "r1", "1")] * 2
    assert [r.request for r in got if r.record_id == "b"] == [None]


def test_reader_takes_other_archives():
    record = lambda b: b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b), b)
    blocks = [b"", b"a", b"\r\n\r\n", b"WARC/1.0\r\n", bytes(3 << 20), b"end"]
    plain = b"".join(map(record, blocks))
    members = b"".join(gzip.compress(record(b)) for b in blocks)
    for data in (plain, gzip.compress(plain), members):
        assert [r["block"] for r in W.parse_records(W._unpacked(data))] == blocks
    for bad in (plain[:-20] [:60], b"hello\r\n\r\n", record(b"abc")[:-6]):
        with pytest.raises((ValueError, KeyError)):
            list(W.parse_records(io.BytesIO(bad).read))


def test_empty(spark):
    path = scratch_path(spark, "warc")
    W.write_archive(spark.createDataFrame([], SCHEMA), path)
    assert W.captures(spark, path).count() == 0

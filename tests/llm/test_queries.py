"""The registered queries: names, contracts' columns and types, and SQL where
there is some, on the smallest tables."""

import hashlib
import os
import re
import zlib

import duckdb
import pytest

import __spark_entry__ as E
from stratus.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: "doc_id bigint, held_out boolean, score double, predicted int",
    2: "query_id bigint, rank int, vec_id bigint, score double",
    3: "page_id bigint, url string, text string, n_chars bigint",
    4: "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    5: "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    6: "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
       "base_sha256 string, spans string",
    7: "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, "
       "refers_to bigint",
    8: "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    9: "doc_id bigint, n_shingles bigint, component_id bigint",
    10: "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    11: "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
        "n_leaves bigint, saved_tokens bigint, ends_sha256 string",
    12: "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string",
    13: "doc_id bigint, held_out boolean, score double, predicted int, "
        "evidence array<struct<id:string,cosine:double,label:int>>",
}


def test_registered():
    assert set(QUERIES) <= set(E.queries()) and set(SQL) <= set(E.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline") == sorted(COLUMNS)
    assert "pipeline" in QUERIES


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n != "pipeline"))
def test_columns_rows_and_sql(spark, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[int(name[2:].split("_")[0])]
    tables = {"op2": "embeddings", "op12": "embeddings", "op11": "conversations", "op3": "pages", "op7": "pages"}
    table = tables.get(name.split("_")[0], "documents")
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF, t)}.parquet')")
    if table not in ("embeddings", "conversations"):
        assert len(rows) == con.execute(f"SELECT count(*) FROM {table}").fetchone()[0]
    if name in SQL:
        cur = con.execute(f"SELECT {', '.join(df.columns)} FROM ({SQL[name]})")
        assert sorted(map(str, cur.fetchall())) == sorted(map(str, rows))


def test_hash_sample_takes_the_smallest_hashes(spark):
    from pyspark.sql import functions as F

    from stratus.llm.common import hash_sample
    df = spark.range(5000)
    turn = F.xxhash64("id")
    want = [r.id for r in df.orderBy(turn).limit(50).collect()]
    for total in (5000, 40, 0):
        assert [r.id for r in hash_sample(df, turn, 50, total).orderBy("turn").collect()] == want
    part = df.where("id % 10 = 0")
    assert hash_sample(part, turn, 50, 5000, over=40).count() == 50
    assert hash_sample(part, turn, 9000, 5000).count() == 500


def test_op1_columns_follow_from_score_and_id(spark):
    rows = QUERIES["op1_quality_classifier"](spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(r.predicted == (1 if r.score >= 0.7 else 0) for r in rows)
    assert {r.predicted for r in rows} == {0, 1}


def test_op6_columns_equal_the_stated_patterns(spark):
    """Counts, digest and spans from the patterns alone, one kind at a time."""
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
                "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
                "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    kinds = list(patterns)

    def fits(kind, span):
        digits = [int(c) for c in span if c in "0123456789"]
        if kind == "ip":
            return all(int(p) <= 255 for p in span.split("."))
        if kind == "card":
            twice = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
            return 14 <= len(digits) <= 19 and sum(twice) % 10 == 0
        return kind != "phone" or 10 <= len(digits) <= 15
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op6_personal_data"](spark, SF).collect()
    assert len(rows) == len(docs) and any(r.n_email for r in rows) and any(r.n_phone for r in rows)
    for r in rows:
        base = sorted(((m.start(), kinds.index(k), m.end()) for k, p in patterns.items()
                       for m in re.finditer(p, docs[r.doc_id]) if fits(k, m[0])))
        text = [f"{kinds[k]}:{s}:{e}" for s, k, e in base]
        assert r.base_sha256 == hashlib.sha256(",".join(text).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [
            sum(k == i for _, k, _ in base) for i in range(4)]
        every = [x for x in r.spans.split(",") if x]
        assert set(text) <= set(every)
        places = [(int(s), kinds.index(k), int(e)) for k, s, e in (x.split(":") for x in every)]
        assert places == sorted(places)
        added = [p for p, x in zip(places, every) if x not in set(text)]
        assert all(e <= s2 or e2 <= s for s, _, e in added for s2, _, e2 in base)


OP8_SQL = r"""
    WITH d AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''),
                      '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS size FROM documents),
         s AS (SELECT source, sum(size) AS source_size,
                      (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
         o AS (SELECT *, (SELECT sum(source_size) FROM s) AS total,
                      sum(3 * source_size) OVER e - 3 * source_size AS full_before,
                      sum(w) OVER (ORDER BY 3.0 * source_size / w DESC, source DESC) AS w_left
               FROM s WINDOW e AS (ORDER BY 3.0 * source_size / w, source)),
         l AS (SELECT max((total - full_before) / w_left) AS level FROM o)
    SELECT doc_id, size, source_size, least(3.0 * source_size, level * w) AS target
    FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, l"""


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op8_sizes_and_targets_equal_sql(spark, sf):
    """All columns of op8 that don't hang on its hash order."""
    folder = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    want = {r[0]: r[1:] for r in con.execute(OP8_SQL).fetchall()}
    rows = QUERIES["op8_source_mix"](spark, folder).collect()
    assert len(rows) == len(want)
    for r in rows:
        size, source_size, target = want[r.doc_id]
        assert (r.size, r.source_size) == (size, source_size)
        assert r.target == pytest.approx(float(target), rel=1e-9) and 0 <= r.taken <= 3 * r.size

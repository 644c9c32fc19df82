import collections
import hashlib
import random
import re

from pyspark.sql import functions as F

from stratus.llm.exact_dedup import drop_copies, frequent_keys, mark_copies, misra_gries

SCHEMA = "doc_id long, text string, digest string, row int"


def _rows():
    random.seed(3)
    texts = ["a b", "a  b", "a\tb", " a b", "", None, "A b", "x" * 50000, "é b", "q"]
    rows = [(i, random.choice(texts + ["hot"] * 8), f"c{i}", i) for i in range(400)]
    return rows + [(3, "hot", "dup", 1), (3, "hot", "dup", 1), (None, "hot", "n", 0),
                   (None, "only", "n", 0), (None, "only", "n", 0), (900, "u", "u", 0),
                   (900, "u", "u", 0)]


def _groups(rows):
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return groups


def test_marks_equal_a_plain_grouping(spark):
    rows = _rows()
    want = collections.Counter()
    for text, ids in _groups(rows).items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        for i in ids:
            want[(i, keep, len(ids), sha)] += 1
    df = spark.createDataFrame(rows, SCHEMA)
    for k in (3, 4095):
        got = mark_copies(df, k=k).collect()
        assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256)
                                   for r in got) == want
        kept = collections.Counter(r.text_sha256 for r in got if r.kept)
        assert set(kept.values()) == {1} and len(kept) == len(_groups(rows))
        assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_drop_keeps_one_row_with_all_columns(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA)
    for k in (3, 4095):
        got = drop_copies(df, k=k)
        assert got.columns == df.columns
        got = [tuple(r) for r in got.collect()]
        assert len(got) == len(_groups(rows)) and set(got) <= set(rows)
        assert {i for i, *_ in got} == {min((i for i in v if i is not None), default=None)
                                        for v in _groups(rows).values()}


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mark_copies(df).count() == 0 and drop_copies(df).count() == 0


def test_misra_gries_bounds(spark):
    random.seed(5)
    keys = ["hot"] * 300 + ["warm"] * 90 + [f"k{random.randint(0, 2000)}" for _ in range(600)]
    random.shuffle(keys)
    true = collections.Counter(keys)
    df = spark.createDataFrame([(x,) for x in keys], "key string").repartition(5)
    k = 9
    for r in df.mapInPandas(misra_gries("key", k), "key string, low long").groupBy("key").agg(
            F.sum("low").alias("low")).collect():
        assert true[r.key] - len(keys) / (k + 1) <= r.low <= true[r.key]
    found = {r.key for r in frequent_keys(df, "key", k).collect()}
    assert "hot" in found and len(found) <= k

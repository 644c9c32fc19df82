import hashlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as C
from stratus.llm.queries import QUERIES
from tests.llm.test_ngram_join import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in C.STAGES:
        out.append(C.materialize(stage(spark, out[-1], SF)))
    return out


def test_stages_in_order(steps):
    docs, quality, exact, near, mix, last = steps
    for df in (quality, exact, near, mix):
        assert df.columns == docs.columns
    assert 0 < quality.count() < docs.count()
    have = [tuple(r) for r in exact.collect()]
    before = [tuple(r) for r in quality.collect()]
    norm = [" ".join((r[1] or "").replace("\t", " ").replace("\n", " ").split(" ")) for r in before]
    assert len(have) <= len(set(norm)) and set(have) <= set(before)
    rows = [(r.doc_id, r.text) for r in exact.collect()]
    keep = {c for _, _, c in brute(rows, 5, 80)}
    assert {str(r.doc_id) for r in near.collect()} == keep and near.count() == len(keep)
    assert {tuple(r) for r in mix.collect()} <= {tuple(r) for r in near.collect()}
    counts = Counter(r.doc_id for r in mix.collect())
    assert max(counts.values()) <= 3


def test_last_stage_equals_the_library(steps):
    *_, mix, last = steps
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in mix.collect():
        ids = t.encode(r.text, add_special_tokens=False).ids
        want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
             hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in last.collect()) == want


def test_registered_query_equals_the_stages(spark, steps):
    got = QUERIES["pipeline"](spark, SF)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, steps[-1].collect()))


def test_odd_rows_pass_every_stage(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, None, None, None, 0),
            (None, "x y z q r", "en", None, 9), (None, "x y z q r", "en", None, 9), (3, "", "en", "s", 0),
            (1, "other text of the same id", "en", "s", 25), (4, "w " * 50000, "en", "t", 100000)]
    df = spark.createDataFrame(rows, schema)
    assert C.exact(spark, df, SF).count() == 5
    assert C.near(spark, df, SF).where("text like 'other%'").count() == 1
    for _, stage in C.STAGES:
        assert stage(spark, df.limit(0), SF).count() == 0
        stage(spark, df, SF).agg(F.count(F.lit(1))).first()


#: Names that the operators use for columns of their own, and odd ones.
HELPERS = ("_digest _keep _frequent _d _i _n _size _nth _copies _copy _times _s _rows _key _id _sha score "
           "c0 c1 c9 digest row first keep_id kept group_size size taken target source_size part n node "
           "label turn places vector component_id n_shingles a.b `a`b").split()


def test_columns_of_any_name_pass_every_stage_unchanged(spark):
    names = ["doc_id", "text", "lang", "source", "n_chars", *HELPERS]
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").collect()
    extra = [tuple(f"{h}:{r.doc_id}" for h in HELPERS) for r in docs]
    rows = [(*r, *e) for r, e in zip(docs, extra)]
    df = spark.createDataFrame([(r[0], r[1], *map(str, r[2:])) for r in rows], "doc_id long, text string, "
                               + ", ".join(f"x{i} string" for i in range(len(names) - 2)))
    df = C.materialize(df.toDF(*names))
    given = {tuple(r) for r in df.collect()}
    for name, stage in C.STAGES[:-1]:
        got = stage(spark, df, SF)
        assert got.columns == names, name
        kept = [tuple(r) for r in got.collect()]
        assert kept and set(kept) <= given, name
    assert C.tokens(spark, df, SF).count() == len(rows)


def test_near_stage_takes_five_words_and_four_fifths(spark):
    """200 words of which 4 apart are replaced: 176 of 216 five-word shingles in common."""
    words = [f"w{i}" for i in range(200)]
    copy = list(words)
    for i in (20, 70, 120, 170):
        copy[i] = f"z{i}"
    other = [w if i % 9 else f"y{i}" for i, w in enumerate(words)]
    rows = [(i, " ".join(t), "en", "s", 1) for i, t in enumerate((words, copy, other))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in C.near(spark, df, SF).collect()) == [0, 2]

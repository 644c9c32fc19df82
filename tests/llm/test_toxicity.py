import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratus.llm import quality
from stratus.llm import toxicity as X
from stratus.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    labels = table(spark, SF, "labels").where(~quality.held_out())
    return X.fit(table(spark, SF, "documents"), labels)


def test_held_out_accuracy(spark, model):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = (X.score(docs.select("doc_id", "text"), model).join(labels, "doc_id")
            .where(quality.held_out()).select("doc_id", "score", "toxic").collect())
    assert len(rows) > 50
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    # 37 toxic examples in four languages: words of some were never seen
    assert sum((r.score >= 0.3) == (r.toxic == 1) for r in rows) / len(rows) >= 0.93
    clean = [r.score for r in rows if r.toxic == 0]
    assert sum(s < 0.3 for s in clean) / len(clean) >= 0.97


def test_no_held_out_label_is_read(spark):
    """Turning every held-out label changes nothing."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    turned = labels.withColumn("toxic", F.when(quality.held_out(), 1 - F.col("toxic"))
                               .otherwise(F.col("toxic")))
    one, two = (X.fit(docs, x.where(~quality.held_out())) for x in (labels, turned))
    assert one.terms == two.terms and one.index.ids == two.index.ids
    assert one.rates.tolist() == two.rates.tolist()


@pytest.mark.parametrize("block", [1, 4, 64])
def test_search_equals_all_cosines(block):
    """Block-max search against scoring every example, with many ties."""
    rng = np.random.default_rng(block)
    rows = []
    for _ in range(150):
        t = np.sort(rng.choice(40, rng.integers(0, 7), replace=False))
        w = rng.integers(1, 3, len(t)).astype(float)
        rows.append((t, w / np.sqrt(w @ w) if len(t) else w))
    ids = [f"{i:03d}" for i in rng.permutation(150)]
    index = X.BlockMaxIndex(rows, ids, np.zeros(150, int), 40, block)
    dense = {i: np.bincount(t, w, 40) for i, (t, w) in zip(ids, rows)}
    for t, w in rows:
        found, cosines = index.nearest(t, w, 9)
        q = np.bincount(t, w, 40)
        every = sorted(((round(float(-q @ v), 9), i) for i, v in dense.items() if q @ v > 0))[:9]
        got = [(round(-c, 9), index.ids[p]) for p, c in zip(found, cosines.tolist())]
        assert [c for c, _ in got] == [c for c, _ in every]
        # below the k-th cosine, up to rounding, the ids are the same
        last = every[-1][0] if every else 0
        assert {i for c, i in got if c < last - 1e-9} == {i for c, i in every if c < last - 1e-9}


def test_blocks_are_skipped_and_bounds_hold(model):
    index, opened = model.index, Counter()
    plain = X.BlockMaxIndex.cosines

    class Counting(X.BlockMaxIndex):
        def cosines(self, b, terms, weights):
            opened["n"] += 1
            got = plain(self, b, terms, weights)
            assert got.max(initial=0) <= self.bounds(terms, weights)[b] + 1e-9
            return got

    small = Counting.__new__(Counting)
    rng = random.Random(3)
    rows = [model.vector([(t, rng.randint(1, 3)) for t in rng.sample(range(len(model.terms)), 2)])
            for _ in range(400)]
    small.__init__(rows, [str(i) for i in range(400)], np.zeros(400, int), len(model.terms), 8)
    for t, w in rows[:50]:
        small.nearest(t, w, 3)
    assert opened["n"] < 50 * small.n_blocks / 2
    assert index.n_blocks == -(-len(index.ids) // X.BLOCK)


def test_likelihood_ratio_and_calibration():
    assert X.likelihood_ratio(np.array([5.0]), np.array([10.0]), 50, 100)[0] == pytest.approx(0)
    assert X.likelihood_ratio(np.array([10.0]), np.array([0.0]), 50, 100)[0] > 20
    votes = np.array([0.1, 0.2, 0.3, 0.9, 0.95])
    steps, rates = X.monotone(votes, np.array([0, 1, 0, 1, 1]), np.ones(5))
    assert (np.diff(steps) > 0).all() and (np.diff(rates) >= 0).all()


def test_edges(spark, model):
    long = "you idiot " + "word " * 60000
    rows = [(1, None, "x", 2.0), (1, "", "x", 2.0), (None, "hello there", None, 2.0),
            (2, long, "x", 2.0), (2, long, "x", 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, score double")
    got = X.score(df, model).collect()
    assert X.score(df, model).columns == ["doc_id", "text", "a.b", "score", "evidence"]
    assert got[0].score == got[1].score == model.alone and got[0].evidence == []
    assert got[3] == got[4] and 0 <= got[3].score <= 1 and 0 < len(got[3].evidence) <= model.k
    assert [e.cosine for e in got[3].evidence] == sorted((e.cosine for e in got[3].evidence),
                                                         reverse=True)
    assert X.score(df.limit(0), model).collect() == []


def test_no_labels_one_class_and_repeated_rows(spark):
    docs = spark.createDataFrame([(i, f"text of document {i % 3}") for i in range(30)] * 2,
                                 "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = X.fit(docs, none)
    assert {r.score for r in X.score(docs, model).collect()} == {0.5}
    one = spark.createDataFrame([(i, 0) for i in range(9)] * 2 + [(None, 1), (99, 1), (4, None)],
                                "doc_id long, toxic int")
    model = X.fit(docs, one)
    assert len(model.index.ids) == 9
    assert all(r.score < 0.5 for r in X.score(docs, model).collect())
    empty = X.fit(docs.limit(0), one)
    assert empty.index.ids == [] and X.score(docs, empty).count() == 60


def test_models_that_follow_each_other_in_a_worker(spark):
    """Workers are used again: words cached for one model are not another's."""
    def made(n):
        docs = spark.createDataFrame(
            [(i, " ".join([f"{'bad' if i % 2 else 'good'}{j}word" for j in range(n)] + ["all"]))
             for i in range(24)], "doc_id long, text string")
        return docs, X.fit(docs, docs.selectExpr("doc_id", "doc_id % 2 AS toxic"))
    (docs, large), (_, small) = made(60), made(2)
    assert len(large.terms) > 4 * len(small.terms) > 0
    for model in (large, small, large):
        got = X.score(docs.repartition(4), model).select("doc_id", "score", "evidence").collect()
        texts = {r.doc_id: r.text for r in docs.collect()}
        for r in got:
            found, cosines = model.index.nearest(*model.text_vector(texts[r.doc_id]), model.k)
            assert r.score == model.score(found, cosines)
            assert [e.id for e in r.evidence] == [model.index.ids[p] for p in found]

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratus.llm import quality as Q
from stratus.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def weights(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    return Q.fit(docs, labels.where(~Q.held_out()))


def test_held_out_accuracy(spark, weights):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = (Q.score(docs.select("doc_id", "text"), weights).join(labels, "doc_id")
            .where(Q.held_out()).select("doc_id", "score", "quality").collect())
    assert len(rows) > 50
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    right = sum((r.score >= 0.7) == (r.quality == 1) for r in rows)
    assert right / len(rows) >= 0.97


def test_features_equal_plain_counting():
    random.seed(1)
    for n in (0, 1, 2, 300):
        words = random.choices(["The", "THE", "a", "a***", "12", "é", "x|"], k=n)
        text = "\n ".join(words)
        places, values = Q.features(text, 18)
        grams = Counter()
        h = [int.from_bytes(Q._hash(w)[:8], "little") for w in words]
        s = [int.from_bytes(Q._hash(w)[8:], "little") for w in words]
        a, b, m = int(Q._LEFT), int(Q._RIGHT), (1 << 64) - 1
        for g in h + s:
            grams[g] += 1
        for i in range(n - 1):
            same = words[i] == words[i + 1]
            grams[int(Q._SAME_WORD) if same else (h[i] * a + h[i + 1] * b) & m] += 1
            grams[((s[i] * a + s[i + 1] * b) & m) ^ (int(Q._SAME_SHAPE) if same else 0)] += 1
        folded = Counter()
        for g, c in grams.items():
            folded[(g ^ (g >> 32)) & ((1 << 18) - 1)] += c
        assert places.tolist() == sorted(folded)
        assert [round(v * v * sum(folded.values())) for v in values] == [
            folded[p] for p in places.tolist()]


def test_ftrl_step_by_step():
    """The vector update against a scalar loop over the published formulas."""
    random.seed(2)
    state, z, n = Q.Ftrl(4), [0.0] * 17, [0.0] * 17
    for _ in range(60):
        places = np.array(sorted(random.sample(range(16), 4)))
        values, y = np.random.default_rng(len(z)).random(4), random.randint(0, 1)
        w = {}
        for i in [*places.tolist(), 16]:
            w[i] = 0.0 if abs(z[i]) <= Q.L1 else -(z[i] - math.copysign(Q.L1, z[i])) / (
                (Q.BETA + math.sqrt(n[i])) / Q.ALPHA + Q.L2)
        x = dict(zip(places.tolist(), values.tolist())) | {16: 1.0}
        p = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x)))
        for i in x:
            g = (p - y) * x[i]
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / Q.ALPHA
            z[i] += g - sigma * w[i]
            n[i] += g * g
        state.update(places, values, y)
    assert np.allclose(state.z, z) and np.allclose(state.n, n)


def test_edges(spark, weights):
    long = "word " * 60000
    rows = [(1, None, "x"), (1, "", "x"), (None, "hello there", None), (2, long, "x"),
            (2, long, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = Q.score(df, weights).collect()
    assert got[0].score == got[1].score == pytest.approx(Q.logistic(weights[-1]))
    assert got[3].score == got[4].score and all(0 <= r.score <= 1 for r in got)
    assert Q.score(df.limit(0), weights).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert not Q.fit(df, none).any()
    odd = spark.createDataFrame([(1, None), (77, 1), (None, 0)], "doc_id long, quality int")
    assert not Q.fit(df, odd).any()
    assert Q.shape("HELLO") == "A" and Q.shape("ab12!!!!") == "a9!!" and not re.search("b", Q.shape("b"))
    assert df.select(F.max(Q.held_out().cast("int"))).first()[0] in (0, 1)

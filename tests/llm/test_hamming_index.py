import random
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

import stratus.llm.hamming_index as H
from stratus.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, rank int"


def brute(ids, vectors, k):
    out = {}
    for i in sorted(set(ids[ids % 100 == 0].tolist())):
        q = vectors[ids == i][0]
        d = np.sqrt(((vectors - q) ** 2).sum(1))
        best = sorted((x, int(j)) for x, j in zip(d, ids) if j != i)
        out[i] = best[:k]
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    df = table(spark, f"/root/testdata/{sf}", "embeddings")
    rows = df.collect()
    want = brute(np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float), 10)
    got = H.nearest(df, F.col("vec_id") % 100 == 0).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r.rank] = (r.score, r.vec_id)
    assert set(found) == set(want)
    assert all(sorted(v) == list(range(1, 11)) for v in found.values())
    assert all([v[i] for i in range(1, 11)] == sorted(v.values()) for v in found.values())
    true = dict(zip((r.vec_id for r in rows), (np.array(r.embedding, float) for r in rows)))
    for r in got[:200]:
        assert r.score == pytest.approx(np.linalg.norm(true[r.query_id] - true[r.vec_id]), abs=1e-12)
    hits = sum(len({j for _, j in v} & {j for _, j in found[i].values()}) for i, v in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_tables_are_looked_up_and_retrieve_less_than_a_tenth(spark):
    """Neighbourhoods of substrings in the tables, whatever the block's size: the places
    looked up are the masks of the reach, and no list of codes or keys is gone through."""
    rows = table(spark, "/root/testdata/sf0.1", "embeddings").collect()
    vectors = np.array([r.embedding for r in rows], float)
    model = H.Codes(vectors, 10)
    indexes = [H.MultiIndex(codes) for codes in model.encode(vectors)]
    share = []
    for i in range(0, len(vectors), 100):
        before = [x.lookups for x in indexes]
        share.append(len(H._retrieved(indexes, model.encode(vectors[i:i + 1])[:, 0], model.radius))
                     / len(vectors))
        a, b = divmod(model.radius, 4)
        masks = [sum(comb(16, j) for j in range(reach + 1))
                 for reach in [a] * (b + 1) + [a - 1] * (3 - b)]
        assert [x.lookups - y for x, y in zip(indexes, before)] == [sum(masks)] * len(indexes)
    assert model.radius <= 24 and np.mean(share) < 0.1


def test_probing_retrieves_every_code_in_the_radius():
    rng = np.random.default_rng(1)
    for bits in (64, 30, 5):
        codes = rng.integers(0, 1 << min(bits, 63), 400, dtype=np.uint64)
        codes[:50] = codes[0] ^ (np.uint64(1) << rng.integers(0, bits, 50).astype(np.uint64))
        index = H.MultiIndex(codes, bits=bits)
        for radius in (0, 1, 2, 3, 4, 5, 7, 11, 20, bits):
            for q in codes[:5]:
                want = np.flatnonzero(np.bitwise_count(codes ^ q) <= radius)
                assert index.within(q, radius).tolist() == want.tolist()


def test_small_and_odd_tables(spark, monkeypatch):
    random.seed(1)
    one = [1.0, 0.0, 2.0]
    rows = [(0, one, 9), (100, one, 9), (100, one, 9), (3, one, 9), (2, one, 9), (7, [1.0, 0.0, 2.5], 9),
            (200, None, 9), (5, [0.0, 0.0, 0.0], 9), (6, [1.0, None, 1.0], 9),
            (8, [float("nan"), 1.0, 1.0], 9), (9, [float("inf"), 1.0, 1.0], 9), (None, one, 9),
            (10, [1.0], 9), (300, [], 9), (11, [9.0, 9.0, 9.0], 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    for size in (8192, 2):
        monkeypatch.setattr(H, "BLOCK_ROWS", size)
        monkeypatch.setattr(H, "QUERY_ROWS", size // 2)
        got = {}
        for r in H.nearest(df, F.col("vec_id") % 100 == 0, k=4).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        assert sorted(got) == [0, 100]
        assert sorted(got[0]) == [(1, 2, 0.0), (2, 3, 0.0), (3, 100, 0.0), (4, 7, 0.5)]
        assert sorted(got[100]) == [(1, 0, 0.0), (2, 2, 0.0), (3, 3, 0.0), (4, 7, 0.5)]
    ask = F.col("vec_id") % 100 == 0
    assert H.nearest(df, ask, k=50).where("query_id = 0").count() == 5
    assert H.nearest(df.limit(0), ask).count() == 0
    assert H.nearest(df.where("vec_id = 0"), ask).count() == 0
    assert H.nearest(df, F.lit(False)).count() == 0

import random
import re

import numpy as np
import pytest

import stratus.llm.ngram_join as J
from stratus.llm.components import components

SCHEMA = "doc_id long, text string, n string, digest int"


def brute(rows, n=4, percent=85):
    sets = []
    for i, t, *_ in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[j:j + n]) for j in range(max(1, len(w) - n + 1))} if w else set())
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                top[find(i)] = find(j)
    least = {}
    for i, row in enumerate(rows):
        r = find(i)
        if row[0] is not None:
            least[r] = min(least.get(r, row[0]), row[0])
    return sorted((str(row[0]), len(sets[i]), str(least.get(find(i))))
                  for i, row in enumerate(rows))


def edited(words, k):
    words = list(words)
    for _ in range(k):
        words[random.randrange(len(words))] = f"z{random.randrange(10 ** 6)}"
    return words


@pytest.fixture(scope="module")
def rows():
    random.seed(21)
    vocab = [f"w{i}" for i in range(400)]
    common = random.choices(vocab, k=60)
    docs = [None, "", " \n", "One", "one", "one two", "ONE  two", "a b c d", "a b c d e", "É b c d"]
    for _ in range(40):
        base = random.choices(vocab, k=random.randint(20, 200))
        docs.append(" ".join(base))
        for _ in range(random.randint(0, 3)):
            docs.append(" ".join(edited(base, random.randint(0, 5))))
    big = random.choices(vocab, k=150)                       # one large near-copy group
    docs += [" ".join(edited(big, random.randint(0, 4))) for _ in range(60)]
    chain = random.choices(vocab, k=160)                     # links only along a chain
    for _ in range(15):
        docs.append("\t".join(chain))
        chain = edited(chain, 2)
    docs += [" ".join(common + random.choices(vocab, k=30)) for _ in range(25)]
    docs += [docs[12].upper()] * 6 + ["long " * 3000 + f"tail{i}" for i in range(3)]
    out = [(i, t, "x", i) for i, t in enumerate(docs)]
    return out + [(12, docs[12], "x", 0), (12, docs[20], "x", 0), (None, docs[30], "x", 0),
                  (None, "lonely words here now", "x", 0)]


@pytest.mark.parametrize("stars", [0, 1, 3])
def test_components_equal_brute_force(spark, rows, stars):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = J.near_duplicates(df, stars=stars).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows)


def test_other_parameters(spark, rows):
    rows = rows[:120]
    df = spark.createDataFrame(rows, SCHEMA)
    got = J.near_duplicates(df, n=2, percent=60).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(
        rows, 2, 60)


TEMPLATE = "please sign in to read the rest of this page"


def test_texts_of_a_template_do_not_meet(spark):
    """No two link, so no pair of classes passes, and the join is empty at any number."""
    for n in (200, 400):
        join = J.NgramJoin(spark.createDataFrame(
            [(i, f"{TEMPLATE} {i}", "", 0) for i in range(n)], SCHEMA))
        _, sketch = join.profile()
        members = join.members(join.nodes(sketch)).withColumn("label", J.F.col("node"))
        assert members.count() == n
        assert join.all_pairs(members).count() == 0
        classes = members.groupBy("gram", "n", "pos").agg(
            J.F.count("*").alias("m"), J.F.min("label").alias("lo"), J.F.max("label").alias("hi"))
        assert join.class_pairs(classes).count() == 0


def test_templates_of_several_lengths(spark):
    """Classes of different sizes and positions that do pair, beside those that don't."""
    random.seed(8)
    long = TEMPLATE + " which goes on with more words of the same kind until it is over"
    rows = [(i, f"{random.choice([TEMPLATE, long, long + ' x'])} {i % 37}", "", 0) for i in range(90)]
    rows += [(100 + i, f"{i % 9} {long} {i % 5} {long[:40]}", "", 0) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    for chunk, stars in ((1024, 3), (4, 0), (4, 3)):
        keep, J.CHUNK = J.CHUNK, chunk
        try:
            got = J.near_duplicates(df, stars=stars).collect()
        finally:
            J.CHUNK = keep
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows)


def test_small_filters_and_sketches_lose_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(J, "FILTER", 64)
    monkeypatch.setattr(J, "FILTER_MOST", 64)
    monkeypatch.setattr(J, "SKETCH", 64)
    monkeypatch.setattr(J, "SKETCH_MOST", 64)
    df = spark.createDataFrame(rows[:100], SCHEMA)
    got = J.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows[:100])
    assert [J.power_of_two(x, 4, 64) for x in (0, 4, 5, 33, 10 ** 9)] == [4, 4, 8, 64, 64]


def test_empty_and_blank_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert J.near_duplicates(none).count() == 0
    blank = spark.createDataFrame([(1, " ", "", 0), (2, None, "", 0)], SCHEMA)
    assert sorted(map(tuple, J.near_duplicates(blank).collect())) == [(1, 0, 1), (2, 0, 2)]


def test_filters_lose_no_linked_pair():
    """Prefixes of any two linked sets meet, at positions the filters accept."""
    rng = np.random.default_rng(3)
    for _ in range(400):
        x = rng.choice(10 ** 6, rng.integers(1, 60), replace=False)
        y = np.unique(np.concatenate([x[rng.integers(0, 4):], rng.choice(10 ** 6, rng.integers(0, 4))]))
        x = np.sort(x)
        both = len(np.intersect1d(x, y))
        if 100 * both < 85 * (len(x) + len(y) - both):
            continue
        a = x[:J.prefix_length(len(x), 85)].tolist()
        b = y[:J.prefix_length(len(y), 85)].tolist()
        shared = set(a) & set(b)
        assert shared
        i, j = a.index(min(shared)), b.index(min(shared))
        assert 185 * min(len(x) - i, len(y) - j) >= 85 * (len(x) + len(y))


def test_components(spark):
    random.seed(4)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(150)]
    edges += [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 600)] + [(7, 7)]
    top = {x: x for e in edges for x in e}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for a, b in edges:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.label for r in got} == {x: find(x) for x in top if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

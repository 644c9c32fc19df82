import collections
import random
import re

from stratus.llm.mixing import mix, mixed_documents, source_targets

SCHEMA = "doc_id long, text string, source string, m int"


def _rows(n=300):
    random.seed(11)
    rows = []
    for i in range(n):
        s = random.choice(["a", "b", None, "c", "Z", "é"]) if i % 3 else "hot"
        words = 0 if i % 29 == 0 else random.randint(1, 40)
        sep = random.choice([" ", "\n", "\t\t", "\x0b"])
        rows.append((i, None if i % 58 == 0 else sep.join(["w x"] * words), s, i))
    return rows + [(7, "a b c", "hot", 0)] * 5 + [(1000, "x " * 20000, "b", 0),
                                                  (None, "n n", "a", 0)]


def _targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s])
    names += [None] if None in sizes else []
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > 3 * sizes[s]}
        if not full:
            out.update({s: level * w[s] for s in open_})
            break
        for s in full:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def _sizes(rows):
    return [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s, *_ in rows]


def test_targets_and_budgets(spark):
    rows = _rows()
    sizes = _sizes(rows)
    per = collections.Counter()
    for _, s, n in sizes:
        per[s] += n
    want = _targets(per)
    df = spark.createDataFrame(rows, SCHEMA)
    for buckets in (1, 4, 4096):
        got = mix(df, buckets=buckets).collect()
        assert collections.Counter((r.doc_id, r.source, r.size) for r in got) == \
            collections.Counter(sizes)
        taken = collections.Counter()
        for r in got:
            taken[r.source] += r.taken
            assert 0 <= r.taken <= 3 * r.size and r.source_size == per[r.source]
            assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)
        partial = collections.Counter(r.source for r in got if r.size and r.taken % r.size)
        assert all(v == 1 for v in partial.values())   # the budget ends in one document
    assert sorted(map(str, got)) == sorted(map(str, mix(df.repartition(3)).collect()))


def test_documents_repeat_as_the_mix_says(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixed_documents(df)
    assert got.columns == df.columns
    have = collections.Counter(tuple(r) for r in got.collect())
    want = collections.Counter()
    for r in mix(df).collect():
        want[r.doc_id, r.source, r.size] += -(-r.taken // r.size) if r.size else 0
    by_key = collections.Counter()
    for row, n in have.items():
        by_key[_sizes([row])[0]] += n
    assert by_key == +want


def test_one_source_and_empty(spark):
    one = spark.createDataFrame([(1, "a b", "s", 0), (2, "c", "s", 0)], SCHEMA)
    assert {(r.doc_id, r.taken) for r in mix(one).collect()} == {(1, 2), (2, 1)}
    none = spark.createDataFrame([], SCHEMA)
    assert mix(none).count() == 0 and mixed_documents(none).count() == 0
    blank = spark.createDataFrame([(1, " ", "s", 0), (2, None, None, 0)], SCHEMA)
    assert [(r.size, r.target, r.taken) for r in mix(blank).collect()] == [(0, 0.0, 0)] * 2
    assert source_targets(spark.createDataFrame([], "source string, size long")).count() == 0


def test_targets_fill_up_in_any_order(spark):
    random.seed(2)
    for _ in range(8):
        per = {f"s{i}": random.choice([0, 1, 5, 40, 400, 3000]) for i in range(random.randint(1, 9))}
        df = spark.createDataFrame(list(per.items()), "source string, size long")
        want = _targets(per)
        for r in source_targets(df).collect():
            assert abs(r.target - want[r.source]) < 1e-6, (per, r, want)

import hashlib
import random

import numpy as np
import pytest

from stratus.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=8, entries=16, rounds=6):
    """Plain Lloyd rounds over every distance, in Python integers."""
    import math
    kept = [(i, [math.floor(V.SCALE * float(c)) for c in v], y) for i, v, y in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    w = len(kept[0][1]) // parts
    kept = [r for r in kept if len(r[1]) == w * parts]
    cut = [[r[1][p * w:p * w + w] for p in range(parts)] for r in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(books[p]))
    for _ in range(rounds):
        codes = [[nearest(p, c[p])[1] for p in range(parts)] for c in cut]
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [c[p] for c, k in zip(cut, codes) if k[p] == j]
                if mine:
                    books[p][j] = [sum(col) // len(mine) for col in zip(*mine)]
    out = []
    for (i, _, y), c in zip(kept, cut):
        got = [nearest(p, c[p]) for p in range(parts)]
        out.append((i, "".join(f"{j:02x}" for _, j in got), sum(d for d, _ in got), y))
    total = {y: sum(r[2] for r in out if r[3] == y) for y in {r[3] for r in out}}
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, code, e, total[y], sha) for i, code, e, y in out]


def ours(df, **options):
    codes, books, scans = V.compress(df, **options)
    rows = [(r.id, r.code.hex(), r.error, r.label_error, books.digest())
            for r in V.with_label_error(codes).collect()]
    return rows, scans


def same(a, b):
    return sorted(map(str, a)) == sorted(map(str, b))


def test_against_brute_force_with_bad_rows(spark):
    rng = random.Random(4)
    centre = [[rng.uniform(-2, 2) for _ in range(16)] for _ in range(5)]
    rows = [(i, [float(np.float32(c + rng.gauss(0, 0.2))) for c in rng.choice(centre)],
             rng.choice([None, 1, 2])) for i in range(300)]
    rows += rows[:20] * 3                                     # repeated rows: more ties
    rows += [(900, None, 1), (901, [1.0] * 15 + [None], 1), (902, [float("nan")] * 16, 2),
             (903, [float("inf")] * 16, 2), (904, [0.5] * 8, 2), (None, [0.25] * 16, None),
             (-5, [0.0] * 16, 1), (-4, [0.0] * 16, 1), (905, [], 1)]
    rng.shuffle(rows)
    got, scans = ours(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert same(got, brute(rows))
    # the bounds spare most of the exact scans of the last pass
    assert scans[0] == 8 * len(got) and scans[-1] < scans[0] * 0.8


def test_hot_labels_and_the_rest(spark, monkeypatch):
    monkeypatch.setattr(V, "HOT_LABELS", 3)
    rng = random.Random(5)
    rows = [(i, [rng.random() for _ in range(8)], i % 11 if i % 3 else None) for i in range(200)]
    rows = [(i, [float(np.float32(c)) for c in v], y) for i, v, y in rows]
    got, _ = ours(spark.createDataFrame(rows, SCHEMA))
    assert same(got, brute(rows))


def test_small_empty_clashing_and_refused(spark):
    assert ours(spark.createDataFrame([], SCHEMA))[0] == []
    few = [(i, [float(i)] * 8, None) for i in range(3)]
    wide = "vec_id long, embedding array<float>, label int, id long, v int, `a.b` int, code int"
    got, _ = ours(spark.createDataFrame([(*r, 7, 7, 7, 7) for r in few], wide))
    assert same(got, brute(few)) and {r[2] for r in got} == {0}
    with pytest.raises(ValueError):
        V.compress(spark.createDataFrame([(1, [1.0] * 9, 1)], SCHEMA))
    with pytest.raises(Exception, match="beyond 8192"):
        V.compress(spark.createDataFrame([(1, [9000.0] * 8, 1)], SCHEMA))


def test_bounds_never_miss_and_use_net_displacement():
    """Books that swing back and forth: assignments equal full scans every
    round, and a bound from round 0 is usable again once the book is back."""
    rng = np.random.default_rng(6)
    x = rng.integers(-50, 50, (400, 2, 3))
    home = rng.integers(-50, 50, (2, 6, 3))
    books = V.Codebooks([home])
    state = V.assign(x, books, books.moves())[:3]
    for turn in range(1, 6):
        books.history.append(home + (turn % 2) * rng.integers(-9, 9, home.shape))
        *state, error, scanned = V.assign(x, books, books.moves(), state)
        for p in range(2):
            d = ((x[:, p, None] - books.now[p]) ** 2).sum(2)
            assert (d.argmin(1) == state[0][:, p]).all()
    # net displacement is 0 where the drift summed over rounds is not
    assert V.Codebooks([home, home + 9, home]).moves()[0].max() == 0
    big = np.array([[[1 << 24, 0, -(1 << 24)]]])
    assert V.squared(big[0], -big[0])[0, 0] == 2 * (1 << 25) ** 2


def test_binary_columns_round_trip():
    a = np.arange(24, dtype=np.float32).reshape(6, 4)
    column = V.to_binary(a)
    assert (V.from_binary(column.slice(2, 3), np.float32, 4) == a[2:5]).all()

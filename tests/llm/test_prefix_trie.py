import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from stratus.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string"


def key(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def brute(rows):
    """Every prefix of every rebuilt conversation, counted plainly."""
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, key(role or "", text or ""),
                                            role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    members = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        seq = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append((c, len(seq) == d))
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    saved, leaves = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in kids.get(p, []))
        leaves[p] = sum(leaves[k] for k in kids[p]) if p in kids else 1
    return sorted(
        (min(c for c, _ in m), len(p), min(c for c, _ in members[p[:-1]]) if p else -99, len(m),
         len(kids.get(p, [])), leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(c for c, e in m if e))).encode()).hexdigest())
        for p, m in members.items())


def ours(spark, rows, parts=3, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted((r.conv_id, r.depth, -99 if r.parent_conv_id is None else r.parent_conv_id,
                   r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
                  for r in P.prefix_nodes(df, **options).collect())


def some(seed, convs, turns, texts=("a", "a b", "", "c d e"), low=-30):
    rng = random.Random(seed)
    rows = [(c, t if rng.random() > 0.1 else None, rng.choice(["u", "v", None]),
             rng.choice([*texts, None]))
            for c in range(low, convs) for t in range(rng.randint(0, turns))]
    rows += [r for r in rows if rng.random() < 0.05] + [(None, 1, "u", "a"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("segment,shard", [(8192, 1 << 16), (4, 16), (3, 1)])
def test_against_brute_force(spark, segment, shard):
    """Deep levels and tiny shards give the same nodes as one trie."""
    rows = some(segment, 90, 11)
    assert ours(spark, rows, segment=segment, shard=shard) == brute(rows)


def test_hot_conversation_prefix_and_copies(spark):
    """A third of all rows in one conversation, a third below one first turn, and
    hundreds of equal conversations."""
    rng = random.Random(9)
    rows = [(7, t, "u", f"w{t % 13} x") for t in range(600)]
    rows += [(1000 + c, t, "u", "same" if t < 2 else rng.choice("pq")) for c in range(100)
             for t in range(6)]
    rows += [(5000 + c, t, "v", f"t {t}") for c in range(300) for t in range(2)]
    want = brute(rows)
    assert ours(spark, rows, parts=5, segment=64, shard=50) == want
    assert ours(spark, rows, parts=2) == want


def test_member_lists_over_tasks_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(P, "PIECE", 7)
    rows = [(bytes([k]) * 16, c) for k, n in ((1, 500), (2, 1), (3, 8), (4, 7)) for c in range(-3, n)]
    got = P.member_lists(spark.createDataFrame(rows, "path binary, conv long").repartition(6)).collect()
    assert {bytes(r.path)[0]: r.ends for r in got} == {
        k: hashlib.sha256(",".join(map(str, range(-3, n))).encode()).hexdigest()
        for k, n in ((1, 500), (2, 1), (3, 8), (4, 7))} and len(got) == 4


def test_double_array_holds_exactly_what_was_placed():
    rng = random.Random(2)
    paths = sorted({bytes(16) + b"".join(hashlib.md5(bytes([rng.randint(0, 40)])).digest()
                                         for _ in range(rng.randint(0, 5))) for _ in range(400)})
    ids, lengths = P.dense_ids(paths)
    trie, count, state = P.DoubleArray(), int(ids.max()) + 1, np.zeros(len(paths), np.int64)
    seen = {(0, ()): 0}
    for j in range(ids.shape[1]):
        at = np.flatnonzero(lengths > j)
        pairs = np.unique(state[at] * count + ids[at, j])
        trie.place(pairs // count, pairs % count)
        state[at] = trie.step(state[at], ids[at, j])
        for r in at:
            assert seen.setdefault((j + 1, tuple(ids[r, :j + 1])), state[r]) == state[r]
    assert len(set(seen.values())) == len(seen)                # a slot for each prefix
    assert (trie.check >= 0).sum() == len(seen)
    every = np.arange(count)
    for (j, path), slot in seen.items():
        to = trie.step(np.full(count, slot), every)
        assert {int(c) for c in every[to > 0]} == {p[j] for k, p in seen if k == j + 1 and p[:j] == path}


def test_common_units():
    a, b = bytes(range(64)), bytes(range(48))
    assert P.common_units(a, b) == 3 and P.common_units(b, b) == 3
    assert P.common_units(a, bytes(15) + a[15:]) == 0
    assert P.common_units(a, a[:20] + b"\xff" * 44) == 1


def test_empty_and_clashing_columns(spark):
    assert ours(spark, []) == [] and ours(spark, [(None, 1, "u", "x")]) == []
    rows = some(3, 30, 4, low=0)
    df = spark.createDataFrame(
        [(*r, 1, "x", 2, 3) for r in rows],
        SCHEMA + ", conv long, key string, `a.b` int, depth int")
    got = [tuple(r) for r in P.prefix_nodes(df).collect()]
    assert len(got) == len(brute(rows))
    long = [(1, 1, "u", "word " * 100000), (2, 1, "u", "word " * 100000)]
    assert ours(spark, long) == brute(long)

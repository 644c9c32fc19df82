import heapq
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import stratus.llm.token_store as S
from stratus.session import scratch_path

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, " ", "Hello World", "don't WE'LL", "a<|endoftext|>b <|startoftext|>", "ΑΣ ΑΣΑ Σ",
         "é é ́e", "a\x1cb\x85c  d", "東京 😀", "x" * 3000, "1234 5,6", "İstanbul ﬁ",
         "<|endoftext", "\x00\x01", "İ.x İ", "DON'T'LL o'Reilly'S 'ſ K", "e\u0301. a\u0301b"]


def test_words_encode_like_whole_texts():
    t = Tokenizer.from_file(PATH)
    random.seed(5)
    alphabet = list("aeinorst hldTHE   \n\t'.,0123$*<|>") + ["é", "ß", "́", "Σ", " ", " the", "ing"]
    texts = [x or "" for x in TEXTS] + ["".join(random.choices(alphabet, k=300)) for _ in range(150)]
    latin = [chr(c) for c in range(256)]
    texts += ["".join(random.choices(latin, k=200)) for _ in range(200)]
    wide = latin + [chr(random.randrange(0x100, 0xD000)) for _ in range(400)]
    texts += ["".join(random.choices(wide, k=60)) for _ in range(300)]
    encoder = S.WordEncoder(open(PATH, encoding="utf-8").read())
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids, text[:60]
    with pytest.raises(ValueError):
        S.WordEncoder(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())


def test_table_that_fills_up_and_parts_of_a_text(monkeypatch):
    """A table emptied again and again, crowded slots, and texts dealt over many parts."""
    t = Tokenizer.from_file(PATH)
    rng = random.Random(6)
    letters = [chr(c) for c in range(256) if chr(c).isalpha()]
    words = ["".join(rng.choices(letters, k=rng.choice([1, 3, 8, 9, 16, 17, 23, 24, 25, 40])))
             for _ in range(900)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) + rng.choice(["", ".", "\x00", "12"])
             for _ in range(400)] + ["", "\x00\x00 \x00", "it's", "a'sb", "l'eau d'or", "x' 'y", "''"]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    spec = open(PATH, encoding="utf-8").read()
    for entries, part, probes in ((1 << 20, 1 << 21, 8), (60, 700, 8), (500, 1, 1)):
        monkeypatch.setattr(S, "TABLE", entries)
        monkeypatch.setattr(S, "_PART", part)
        monkeypatch.setattr(S._Table, "PROBES", probes)
        encoder = S.WordEncoder(spec)
        for _ in range(2):
            assert [x.tolist() for x in encoder.encode(texts)] == want
        first = encoder.table
        if entries == 60:
            encoder.encode(texts[:50])
            assert encoder.table is not first or encoder.table.room >= 0


def test_table_finds_exactly_what_was_put_in():
    rng = np.random.default_rng(8)
    keys = [rng.integers(0, 4, 3000).astype(np.uint64) for _ in range(3)]
    length = rng.integers(1, 4, 3000).astype(np.uint8)
    every = {k: i for i, k in enumerate(zip(*(c.tolist() for c in keys), length.tolist()))}
    at = np.array(sorted(every.values()))
    half = at[::2]
    table = S._Table(4000)
    table.insert([k[half] for k in keys], length[half], half, half.astype(np.int32))
    slot = table.find([k[at] for k in keys], length[at])
    inside = np.isin(at, half)
    assert (slot[~inside] < 0).all() and (slot[inside] >= 0).all()
    assert (table.start[slot[inside]] == at[inside]).all()


def test_histograms_come_with_the_ids(spark):
    """The codebook's lengths follow the counts of every id of the corpus."""
    rows = [(i, "the quick brown fox it's " * (i % 7)) for i in range(40)]
    path = scratch_path(spark, "store")
    S.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), path, PATH)
    t = Tokenizer.from_file(PATH)
    counts = np.zeros(t.get_vocab_size(True), np.int64)
    for _, text in rows:
        for i in t.encode(text, add_special_tokens=False).ids + [1]:
            counts[i] += 1
    want = S.code_lengths(counts)
    got = {r.id: r.length for r in spark.read.parquet(f"{path}/codebook").collect()}
    assert got == {int(i): int(want[i]) for i in np.flatnonzero(want)}


def huffman_cost(counts):
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    return cost


def test_code_lengths():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 17, 300, 5000):
        counts = np.zeros(n + 5, np.int64)
        counts[:n] = rng.zipf(1.3, n).clip(1, 10 ** 9)
        free = S.code_lengths(counts, 60)
        assert (free > 0).sum() == n
        if n > 1:
            assert sum(0.5 ** float(x) for x in free if x) == 1.0
            assert int((counts * free).sum()) == huffman_cost(counts)
        for limit in (12, 16):
            some = S.code_lengths(counts, limit)
            assert some.max(initial=0) <= max(limit, int(np.ceil(np.log2(max(n, 2)))))
            if n > 1:
                assert sum(0.5 ** float(x) for x in some if x) == 1.0
    fib = [1, 1]
    while len(fib) < 30:
        fib.append(fib[-1] + fib[-2])
    assert S.code_lengths(np.array(fib), 60).max() == 29
    assert S.code_lengths(np.array(fib), 8).max() == 8
    # smallest possible cost under a limit, by trying all Kraft-full lengths
    counts = np.array([1, 2, 4, 8, 30])
    best = min(sum(c * x for c, x in zip(counts, ls)) for ls in __import__("itertools").product(
        (1, 2, 3), repeat=5) if sum(2.0 ** -x for x in ls) <= 1)
    assert int((counts * S.code_lengths(counts, 3)).sum()) == best


def test_blocks_round_trip():
    rng = np.random.default_rng(2)
    counts = rng.zipf(1.2, 900).clip(1, 10 ** 6)
    code = S.Code(S.code_lengths(counts, 14))
    codes = {format(int(c), f"0{n}b") for c, n in zip(code.codes, code.lengths)}
    assert not any(a != b and b.startswith(a) for a in list(codes)[:80] for b in codes)
    for sizes in ([], [1], [0, 5, 0], [128, 129, 127, 1], [70000], [3] * 50):
        ids = [rng.integers(0, 900, s) for s in sizes]
        made = code.encode(np.concatenate([*ids, np.zeros(0, np.int64)]), np.array(sizes, np.int64))
        plain = ["".join(format(int(code.codes[i]), f"0{code.lengths[i]}b") for i in x) for x in ids]
        assert [b for b, _ in made] == [
            bytes(int(p[k:k + 8].ljust(8, "0"), 2) for k in range(0, len(p), 8)) for p in plain]
        starts = np.cumsum([0, *(len(b) for b, _ in made)])[:-1] * 8
        marks = np.concatenate([m + np.uint32(s) for (_, m), s in zip(made, starts)]
                               or [np.zeros(0, "<u4")])
        got = code.decode(b"".join(b for b, _ in made), marks, np.array(sizes, np.int64))
        assert got.tolist() == [int(i) for x in ids for i in x]


def check(spark, rows):
    t = Tokenizer.from_file(PATH)
    df = spark.createDataFrame(rows, "doc_id long, text string, row long, ids string")
    path = scratch_path(spark, "store")
    S.write_tokens(df.repartition(3), path, PATH)
    got = S.read_tokens(spark, path).withColumn("crc", F.crc32("ids")).collect()
    want = [(i, t.encode(x or "", add_special_tokens=False).ids + [1]) for i, x, *_ in rows]
    key = [(i is None, i or 0) for i, _ in want]
    want = [w for _, w in sorted(zip(key, want), key=lambda p: p[0])]
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [i for i, _ in want]
    assert sorted((str(r.doc_id), r.crc, r.n_tokens) for r in got) == sorted(
        (str(i), zlib.crc32(np.array(x, "<u4").tobytes()), len(x)) for i, x in want)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens


def test_store(spark, monkeypatch):
    rows = [(i * 7 % 31, x, 5, "c") for i, x in enumerate(TEXTS * 3)]
    rows += [(4, "same", 1, "c"), (4, "same", 1, "c"), (None, "no id", 1, "c")]
    rows += [(100 + i, "the quick brown fox " * 40, 1, "c") for i in range(50)]
    check(spark, rows)


def test_texts_longer_than_a_block(spark):
    check(spark, [(2, "a b " * 40000, 0, ""), (1, "c", 0, ""), (3, "d e f " * 50000, 0, "")])


def test_empty_store(spark):
    path = scratch_path(spark, "store")
    S.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert S.read_tokens(spark, path).count() == 0

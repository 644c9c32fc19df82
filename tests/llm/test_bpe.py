import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import stratus.llm.bpe as B

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "  ", "\n", " \n", "a", " a", "a ", "  a  b  ", "\n\n a\t\tb\r\n", "don't we'll I'M 'sx",
    "naïve façade ñ 東京 Ωμέγα 😀😀", "x" * 5000, "ab" * 3000 + " " * 900 + "c", "  x　",
    "a\x1cb\x85c​d", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext",
    "$$$ *** %%%, 12 345 6a7", "éé", "hello world next", "\x00\x01\x7f",
]


@pytest.fixture(scope="module")
def vocabulary():
    return B.Vocabulary(open(PATH, encoding="utf-8").read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _random_texts(n=150):
    random.seed(9)
    alphabet = list("aeinorst hldTHE   \n\t'.,0123$*") + ["é", "ß", "东", "😀", " the", "ing", "tion"]
    return ["".join(random.choices(alphabet, k=random.choice([3, 20, 200, 2000])))
            for _ in range(n)]


def test_ids_and_text_equal_the_library(vocabulary, library):
    encoder, decoder = B.Encoder(vocabulary), B.Decoder(vocabulary)
    for t in TEXTS + _random_texts():
        want = library.encode(t, add_special_tokens=False).ids
        got = encoder.encode(t)
        assert got.tolist() == want, t[:80]
        assert decoder.decode(got) == library.decode(want, skip_special_tokens=False) == t


def test_any_block_size_gives_the_same_ids(vocabulary, library, monkeypatch):
    for block in (1, 7, 64):
        monkeypatch.setattr(B, "BLOCK", block)
        encoder = B.Encoder(vocabulary)
        for t in TEXTS + _random_texts(25):
            assert encoder.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids


def test_transducer_is_exact_and_bounded(vocabulary):
    random.seed(4)
    for alphabet in (b"a", b"ab", b"the in", b"=-_*", bytes(range(256))):
        for size in (0, 1, 500, 20000):
            data = bytes(random.choices(alphabet, k=size))
            stream, got, most = B.Transducer(vocabulary, step=16), [], 0
            at = 0
            while at < size:
                n = random.randint(1, 90)
                got += stream.feed(data[at:at + n])
                most = max(most, len(stream.window))
                at += n
            got += stream.finish()
            assert got == B.merge(vocabulary, data)
            assert most <= vocabulary.lookahead + 16 + 128
    assert 0 < vocabulary.lookahead < 4096


def test_both_merge_loops_agree(vocabulary, monkeypatch):
    random.seed(6)
    pieces = [bytes(random.choices(b"thein aros", k=random.randint(1, 120))) for _ in range(200)]
    short = [B.merge(vocabulary, p) for p in pieces]
    monkeypatch.setattr(B, "SHORT", 0)
    assert short == [B.merge(vocabulary, p) for p in pieces]


def test_decoder_replaces_what_is_not_text(vocabulary, library):
    decoder = B.Decoder(vocabulary)
    random.seed(8)
    for _ in range(60):
        ids = [random.randrange(50257) for _ in range(40)]
        assert decoder.decode(np.array(ids, "<i4")) == library.decode(ids, skip_special_tokens=False)


def test_out_of_order_merges_are_refused(vocabulary):
    with pytest.raises(ValueError):
        vocabulary._read_merges([["th", "e"], ["t", "h"]], {"t": 83, "h": 71, "th": 400, "e": 68,
                                                            "the": 500})


def test_tables(spark, library):
    rows = [(i, t, i, "c") for i, t in enumerate(TEXTS)] + [(1, None, 0, None), (1, "a", 0, "c"),
                                                            (None, "a b", 0, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int, other string")
    tokens = B.encode(df, PATH, out="tokens")
    assert tokens.columns == ["doc_id", "ids", "other", "tokens"]
    back = B.decode(tokens, PATH, "tokens").collect()
    assert sorted((str(r.doc_id), r.ids, r.text) for r in back) == sorted(
        (str(i), x, t or "") for i, t, x, _ in rows)
    assert sorted(map(len, (r.tokens for r in back))) == sorted(
        len(library.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in rows)
    assert B.decode(B.encode(df.limit(0), PATH), PATH).count() == 0


def test_a_task_runs_one_python_worker_and_decoders_hold_no_merges(spark, monkeypatch):
    import corpus_pipeline
    from stratus.llm import common
    docs = spark.createDataFrame([(2, "a b"), (1, None), (2, "a b")], "doc_id long, text string")
    back = corpus_pipeline.tokens(spark, docs, "")
    assert back._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(r.n_tokens for r in back.collect()) == [0, 2, 2]
    monkeypatch.setattr(common, "_kept", {})
    assert not hasattr(B._worker(B.Decoder, open(PATH, encoding="utf-8").read()), "vocabulary")
    assert [type(kept) for kept in common._kept.values()] == [B.Decoder]

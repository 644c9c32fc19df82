import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import stratus.llm.pii as P
from stratus.llm.common import table

SF = "/root/testdata/sf0.1"
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
         "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.findall("[0-9]", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                  "phone": 10 <= len(digits) <= 15,
                  "card": 14 <= len(digits) <= 19 and sum(
                      sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0}
            if ok[kind]:
                out.append((m.start(), k, m.end(), kind))
    return [(kind, s, e) for s, _, e, kind in sorted(out)]


@pytest.fixture(scope="module")
def weights(spark):
    return P.fit(table(spark, SF, "documents"))


def test_base_spans_equal_the_patterns():
    random.seed(2)
    bits = ["a@b.c", "@", "a@b", "x.y%+z@h-1.co.uk", "@@a@b.c@d.e", "1.2.3.4", "1.2.3.4.5.6.7.8",
            "256.1.1.1", "0001.2.3.4", "4058826588634783", "4058 8265-8863 4783", "+1 (203) 555-8282",
            "+12", "++1 555 555 5555", "+1 2 3 ... 4", "1", " ", ".", "-", "é", "東", "\n", "+", "٣"]
    texts = ["".join(random.choices(bits, k=random.randint(1, 14))) for _ in range(3000)]
    texts += ["".join(random.choices("0123456789.+- @a()", k=60)) for _ in range(3000)]
    for t in texts:
        assert P.base_spans(t) == plain(t), t
    for t in ("1" * 100000, "a" * 100000 + "@", "1." * 50000, "+1" * 50000, "a@" * 50000, "1 " * 50000):
        P.base_spans(t)


def test_gradient():
    rng = np.random.default_rng(0)
    model = P.Tagger(seed=3, embed=3, hidden=2)
    chars = rng.integers(0, P.ALPHABET, (3, 6))
    tags = np.array([[0, 1, 2, 2, 0, 3], [5, 6, 0, 0, 7, 8], [0, 0, 0, 1, 1, 2]])
    _, grad = model.loss_and_gradient(chars, tags)
    for name in P.Tagger.NAMES:
        x = getattr(model, name)
        for at in [tuple(rng.integers(0, s) for s in x.shape) for _ in range(6)] + [
                tuple(i[0] for i in np.nonzero(grad[name]))]:
            if name == "step" and P.Tagger.no_step[at] or name == "first" and P.Tagger.no_first[at]:
                continue
            x[at] += 1e-5
            up = model.loss_and_gradient(chars, tags)[0]
            x[at] -= 2e-5
            down = model.loss_and_gradient(chars, tags)[0]
            x[at] += 1e-5
            assert grad[name][at] == pytest.approx((up - down) / 2e-5, abs=2e-5), (name, at)


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(1)
    model = P.Tagger()
    model.step, model.first = rng.standard_normal((P.TAGS, P.TAGS)), rng.standard_normal(P.TAGS)
    emit = rng.standard_normal((5, 4, P.TAGS))
    step, first = model.step + model.no_step, model.first + model.no_first
    for e, got in zip(emit, model.best_tags(emit)):
        best = max(itertools.product(range(P.TAGS), repeat=4), key=lambda p: (
            first[p[0]] + sum(e[i, t] for i, t in enumerate(p))
            + sum(step[a, b] for a, b in zip(p, p[1:]))))
        assert tuple(got) == best


def test_model_finds_held_out_spans(spark, weights):
    """The model alone, on documents of other tables than it was trained on."""
    finder, hit, true, wrong = P.Finder(weights), 0, 0, 0
    docs = table(spark, "/root/testdata/sf0.01", "documents").where(F.col("text").rlike("[0-9@]"))
    for r in docs.select("text").collect():
        want, got = set(P.base_spans(r.text)), set(finder.model_spans(r.text))
        hit, true, wrong = hit + len(want & got), true + len(want), wrong + len(got - want)
    assert true > 40 and hit >= 0.9 * true and wrong <= 0.05 * true


def test_new_forms_and_borders(weights):
    finder = P.Finder(weights)
    found = 0
    for pad in range(0, 200, 7):
        text = "word " * (pad // 5) + "x" * (pad % 5) + " call (203) 555-8282 at once, please do"
        base, spans = finder.spans(text)
        assert base == []
        found += any("555-8282" in text[s:e] for _, s, e in spans)
    assert found >= 20
    for clean in ("The year 1999 and 2024, page 12.", "a b c", "", "token = \"dc11d1a2a11dc6572c8df\""):
        assert finder.spans(clean) == ([], [])


def test_tables(spark, weights):
    long = "filler text " * 9000 + "mail a.b@c.de now " + "filler " * 9000
    rows = [(1, None, "b"), (1, "", "b"), (2, "a@b.cd +1 (203) 555-8282 x 1.2.3.4 é", "b"),
            (2, "a@b.cd +1 (203) 555-8282 x 1.2.3.4 é", "b"), (None, long, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, base string")
    got = P.find(df, weights)
    assert got.columns == ["doc_id", "base", "spans"]
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[1].base == rows[1].spans == []
    assert [tuple(x) for x in rows[2].base] == [("email", 0, 6), ("phone", 7, 24), ("ip", 27, 34)]
    assert [tuple(x) for x in rows[None].base] == [("email", 108005, 108013)]
    assert got.where("doc_id = 2").select("base", "spans").distinct().count() == 1
    assert P.find(df.limit(0), weights).count() == 0
    assert P.fit(df.where("doc_id = 1")) is None
    assert P.find(df, None).where("size(spans) > 0").count() == 3


def test_sample_is_of_distinct_texts(spark):
    """Copies take no place in the sample from other texts."""
    texts = spark.range(40).select(F.concat(F.lit("mail a"), "id", F.lit("@b.cd")).alias("text"))
    first = texts.orderBy(F.xxhash64(F.lit(P.SEED), "text")).limit(1)
    copies = texts.union(first.crossJoin(spark.range(500)).select("text"))
    assert P.fit(copies, sample=10) == P.fit(texts, sample=10)


def test_sample_is_whole_where_few_texts_can_hold_a_span(spark):
    plain = spark.range(100000).select(F.translate(F.col("id").cast("string"), "0123456789",
                                                   "abcdefghij").alias("text"))
    some = spark.range(20).select(F.concat(F.lit("mail a"), "id", F.lit("@b.cd")).alias("text"))
    assert P.fit(plain.union(some), sample=10) == P.fit(some, sample=10)

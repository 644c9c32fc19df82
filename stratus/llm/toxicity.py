"""Toxicity: votes of the nearest labelled examples by exact TF-IDF cosine.

**Examples.** Of the labelled ids, the ``SAMPLE`` smallest hashes of each class
(bounded, so the index is). An id's label is the larger of its labels and its
text the largest of its texts, so repeated rows take one place.

**Terms** are lower-cased words and their beginnings of 4 to 6 characters.
Those that tell the classes apart in the examples span the vector space: a
likelihood ratio of ``RATIO`` or more and a share ``LIFT`` times that of the
other class, the ``VOCABULARY`` strongest at most. A vector is (1 + log count) times
the inverse document frequency, scaled to length one.

**Search.** Examples with a like heaviest term stand together, in blocks of
``BLOCK``. Each term keeps its largest weight in each block it is in; the sum of
those bounds every cosine of a block. Blocks are opened from the highest bound
on, until the bound is below the k-th best cosine: the result is exactly that
of scoring all examples (ties to the smaller id).

**Score.** Neighbours vote with weight (1 - distance)², beside one full vote for
clean, so that far neighbours alone decide little. The share of
toxic votes goes through a monotone calibration, fitted on the examples
themselves, each without its own vote and classes weighted back to their
share of all labels. A text without any example of positive cosine gets the
rate of such examples. The neighbours are returned as evidence.

Scoring is a map over the table with the index broadcast: no shuffle. Its size
is bounded by 2 · SAMPLE examples over VOCABULARY terms at any table size.

Defined results: a null or empty text has no neighbours and gets the rate of such
texts; without labels every score is 0.5; null labels and labels of missing
documents are not used; repeated rows score the same; an empty table gives no
rows; other columns pass through, one named like an output is replaced.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratus.llm.common import hash_sample, map_table, tidy, whole_text, worker_state
from stratus.session import materialize

#: Examples of each class, at most.
SAMPLE = 2048
#: Neighbours that vote, and tasks that count the examples' terms.
K, FIT_TASKS = 15, 32
#: Terms at most; likelihood ratio and lift that a term needs; examples that hold it, at least.
VOCABULARY, RATIO, LIFT, HELD = 1 << 13, 20.0, 3.0, 3
BLOCK = 64
#: Words whose terms a Python worker keeps; a full cache is emptied.
CACHE = 1 << 18

_WORD = re.compile(r"\w+")
EVIDENCE = T.ArrayType(T.StructType([
    T.StructField("id", T.StringType()), T.StructField("cosine", T.DoubleType()),
    T.StructField("label", T.IntegerType())]))


def word_terms(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in (4, 5, 6) if len(word) >= n)]


def term_counts(text: str) -> Counter:
    counts: Counter = Counter()
    for word, n in Counter(_WORD.findall(text.lower())).items():
        for term in word_terms(word):
            counts[term] += n
    return counts


def likelihood_ratio(a, b, n, m):
    """G² of a of n against b of m."""
    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-300) / expected), 0.0)
    share = (a + b) / (n + m)
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * (part(a, n * share) + part(b, m * share)
                    + part(n - a, n * (1 - share)) + part(m - b, m * (1 - share)))


class BlockMaxIndex:
    """Sparse unit vectors of examples, searched by block maxima."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], ids: list[str],
                 labels: np.ndarray, n_terms: int, block: int = BLOCK):
        """``rows``: (terms ascending, weights) of each example."""
        lead = [int(t[np.argmax(w)]) if len(t) else -1 for t, w in rows]
        order = sorted(range(len(rows)), key=lambda i: (lead[i], ids[i]))
        self.ids, self.labels = [ids[i] for i in order], np.asarray(labels)[order]
        # ties of cosine go by id
        self.rank = np.empty(len(ids), np.int64)
        self.rank[sorted(range(len(ids)), key=self.ids.__getitem__)] = np.arange(len(ids))
        at = np.repeat(np.arange(len(order)), [len(rows[i][0]) for i in order])
        term = np.concatenate([rows[i][0] for i in order] or [np.zeros(0, np.int64)]).astype(np.int64)
        weight = np.concatenate([rows[i][1] for i in order] or [np.zeros(0)])
        self.block, self.n_blocks = block, -(-len(order) // block)
        by = np.lexsort((at, term, at // block))
        self.term, self.at, self.weight = term[by], at[by], weight[by]
        self.starts = np.searchsorted(self.at // block, np.arange(self.n_blocks + 1))
        # block maxima, by term
        key = term * max(self.n_blocks, 1) + at // block
        keys, place = np.unique(key, return_inverse=True)
        top = np.zeros(len(keys))
        np.maximum.at(top, place, weight)
        self.top, self.top_block = top, keys % max(self.n_blocks, 1)
        self.top_starts = np.searchsorted(keys // max(self.n_blocks, 1), np.arange(n_terms + 1))

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        bound = np.zeros(self.n_blocks)
        for t, w in zip(terms, weights):
            s, e = self.top_starts[t], self.top_starts[t + 1]
            bound[self.top_block[s:e]] += w * self.top[s:e]
        return bound

    def cosines(self, b: int, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact cosines of the examples of one block."""
        s, e = self.starts[b], self.starts[b + 1]
        held = self.term[s:e]
        place = np.minimum(np.searchsorted(terms, held), len(terms) - 1)
        same = np.flatnonzero(terms[place] == held)
        return np.bincount(self.at[s:e][same] - b * self.block, minlength=self.block,
                           weights=weights[place[same]] * self.weight[s:e][same])

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = K, skip: int = -1
                ) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of the k examples of largest positive cosine."""
        found, best = np.zeros(0, np.int64), np.zeros(0)
        if not len(terms):
            return found, best
        bound = self.bounds(terms, weights)
        for b in np.argsort(-bound, kind="stable"):
            # rounding may put a cosine a little over its bound
            if bound[b] <= 0 or (len(best) == k and bound[b] + 1e-9 < best[-1]):
                break
            cos = self.cosines(b, terms, weights)
            hit = np.flatnonzero(cos > 0)
            hit = hit[hit + b * self.block != skip]
            found = np.concatenate([found, hit + b * self.block])
            best = np.concatenate([best, cos[hit]])
            keep = np.lexsort((self.rank[found], -best))[:k]
            found, best = found[keep], best[keep]
        return found, best


@dataclass
class Model:
    terms: dict[str, int]
    idf: np.ndarray
    index: BlockMaxIndex
    steps: np.ndarray        # calibration: votes ascending
    rates: np.ndarray        # and the rate at each of them
    alone: float             # rate of texts without a neighbour
    k: int = K
    #: Names the model in a worker's cache: places of terms differ between models.
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def vector(self, counts: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        if not counts:
            return np.zeros(0, np.int64), np.zeros(0)
        both = np.array(sorted(counts), np.int64)
        weights = (1 + np.log(both[:, 1])) * self.idf[both[:, 0]]
        return both[:, 0], weights / np.sqrt(weights @ weights)

    def text_vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        known, get = worker_state(("toxicity", self.key), dict), self.terms.get
        counts: dict[int, int] = {}
        for word in _WORD.findall(text.lower()):
            places = known.get(word)
            if places is None:
                if len(known) >= CACHE:
                    known.clear()
                places = known[word] = tuple(
                    p for t in word_terms(word) if (p := get(t)) is not None)
            for p in places:
                counts[p] = counts.get(p, 0) + 1
        return self.vector(list(counts.items()))

    def vote(self, places: np.ndarray, cosines: np.ndarray) -> float:
        weights = cosines ** 2
        return float(weights @ self.index.labels[places] / (weights.sum() + 1.0))

    def score(self, places: np.ndarray, cosines: np.ndarray) -> float:
        if not len(places):
            return self.alone
        return float(np.interp(self.vote(places, cosines), self.steps, self.rates))


def monotone(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression: (vote, rate) at the middle of each pooled step."""
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []          # weight, weighted label, weighted vote
    for v, y, w in zip(votes[order], labels[order], weights[order]):
        pools.append([w, w * y, w * v])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    w, wy, wv = (np.array(c) for c in zip(*pools))
    return wv / w, (wy + 0.5) / (w + 1.0)


def build(examples: list[tuple[str, int, Counter]], totals: tuple[float, float],
          k: int = K) -> Model:
    """The model of (id, label, counts of the terms to use); ``totals``: rows of
    label 0 and of label 1 that the examples stand for."""
    labels = np.array([y for _, y, _ in examples], np.int64)
    held = Counter(t for _, _, counts in examples for t in counts)
    terms = {t: i for i, t in enumerate(sorted(held))}
    idf = np.log(1 + len(examples) / np.array([held[t] for t in terms] or [1.0]))
    model = Model(terms, idf, None, np.zeros(1), np.full(1, 0.5), 0.5, k)
    if not examples:
        model.index = BlockMaxIndex([], [], labels, 0)
        return model
    rows = [model.vector([(terms[t], n) for t, n in c.items()]) for _, _, c in examples]
    index = model.index = BlockMaxIndex(rows, [i for i, _, _ in examples], labels, len(terms))
    by_id = {e[0]: row for e, row in zip(examples, rows)}
    share = [totals[y] / max((labels == y).sum(), 1) for y in (0, 1)]
    weights = np.array([share[y] for y in index.labels]) / max(min(share), 1e-9)
    votes = np.full(len(examples), -1.0)
    for place, i in enumerate(index.ids):
        found, cosines = index.nearest(*by_id[i], k, skip=place)
        if len(found):
            votes[place] = model.vote(found, cosines)
    lone = votes < 0
    prior = (weights @ index.labels) / weights.sum()
    model.alone = float((weights[lone] @ index.labels[lone] + prior) / (weights[lone].sum() + 1))
    if (~lone).any():
        model.steps, model.rates = monotone(votes[~lone], index.labels[~lone], weights[~lone])
    return model


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 128):                   # lists take much room
            some = batch.iloc[at:at + 128]
            counts = [term_counts(t) for t in some["text"]]
            yield pd.DataFrame({"id": some["id"].to_numpy(), "label": some["label"].to_numpy(),
                                "term": [list(c) for c in counts],
                                "n": [list(c.values()) for c in counts]})


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id",
        text_col: str = "text", sample: int = SAMPLE, k: int = K) -> Model:
    """Index and calibration from at most ``sample`` labelled ids of each class."""
    known = materialize(
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).cast("string").alias("id"))
        .agg((F.max(F.col(label_col).cast("double")) > 0.5).cast("int").alias("label")), "known")
    sizes = dict(known.groupBy("label").count().collect())
    totals = (float(sizes.get(0, 0)), float(sizes.get(1, 0)))
    parts = [hash_sample(known.where(F.col("label") == y), F.xxhash64("id"), sample,
                         int(totals[y]), "id") for y in (0, 1)]
    chosen = F.broadcast(materialize(parts[0].unionByName(parts[1]), "examples"))
    texts = (docs.select(F.col(id_col).cast("string").alias("id"),
                         whole_text(text_col).alias("text"))
             .join(chosen, "id").groupBy("id", "label").agg(F.max("text").alias("text")))
    counted = materialize(texts.repartition(FIT_TASKS, "id").mapInPandas(
        tidy(_count), "id string, label int, term array<string>, n array<int>"), "counted")
    n = dict(counted.groupBy("label").count().collect())
    n0, n1 = n.get(0, 0), n.get(1, 0)
    # the terms that enough examples hold, with their examples of each class
    held = (counted.select("label", F.explode("term").alias("term")).groupBy("term")
            .agg(F.sum(1 - F.col("label")).alias("clean"), F.sum("label").alias("toxic"))
            .where(F.col("clean") + F.col("toxic") >= HELD))

    def strong(batches):
        for batch in batches:
            a, b = batch["toxic"].to_numpy(float), batch["clean"].to_numpy(float)
            ratio = likelihood_ratio(a, b, max(n1, 1), max(n0, 1))
            p, q = (a + 0.5) / (n1 + 1), (b + 0.5) / (n0 + 1)
            yield pd.DataFrame({"term": batch["term"], "ratio": ratio})[
                (ratio >= RATIO) & (np.maximum(p / q, q / p) >= LIFT)]

    terms = F.broadcast(materialize(
        held.mapInPandas(strong, "term string, ratio double")
        .orderBy(F.desc("ratio"), "term").limit(VOCABULARY).select("term"), "terms"))
    kept = (counted.select("id", F.explode(F.arrays_zip("term", "n")).alias("e"))
            .select("id", "e.term", "e.n").join(terms, "term")
            .groupBy("id").agg(F.collect_list(F.struct("term", "n")).alias("held")))
    # at most 2 * sample rows of at most VOCABULARY terms
    rows = counted.select("id", "label").join(kept, "id", "left").orderBy("id").collect()
    return build([(r.id, r.label, Counter({t: c for t, c in r.held or []})) for r in rows],
                 totals, k)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score",
          evidence: str = "evidence") -> DataFrame:
    """``docs`` with ``out`` (probability that the text is toxic) and ``evidence``
    (id, cosine and label of the examples that voted, nearest first)."""
    places = [i for i, f in enumerate(docs.schema.fields) if f.name.lower() not in (out.lower(), evidence.lower())]
    fields = [*(docs.schema.fields[i] for i in places), T.StructField(out, T.DoubleType()),
              T.StructField(evidence, EVIDENCE)]
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        kind = pa.list_(pa.struct([("id", pa.string()), ("cosine", pa.float64()),
                                   ("label", pa.int32())]))
        for batch in batches:
            scores, seen = [], []
            for text in batch.column(at):
                found, cosines = m.index.nearest(*m.text_vector(text.as_py() or ""), m.k)
                scores.append(m.score(found, cosines))
                seen.append([{"id": m.index.ids[p], "cosine": c, "label": int(m.index.labels[p])}
                             for p, c in zip(found, cosines.tolist())])
            yield [*(batch.column(i) for i in places), pa.array(scores, pa.float64()),
                   pa.array(seen, kind)]

    return map_table(docs, run, fields)

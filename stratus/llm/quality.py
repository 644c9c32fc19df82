"""Quality classifier: logistic regression on hashed word n-grams, fitted with
follow-the-regularised-leader (FTRL-proximal) updates.

A text becomes a sparse vector: unigrams and bigrams of its words and of its
words' shapes (letters → a, upper-case words → A, digits → 9, a repeated sign
twice at most) are hashed into ``2**BITS`` places; an immediate repeat of a
word is a bigram of its own. Values are square roots of counts, scaled to
length one, so length itself does not count. A score is the logistic function
of the sparse dot product with the weights, plus a bias.

Fitting uses a bounded sample (``SAMPLE`` labelled rows, the smallest hashes
of the id): their vectors are made where their texts are, then streamed in
hash order through one task that holds the two FTRL accumulators and one
batch. At most ``2**BITS + 1`` weights come back and are broadcast. Scoring
reads every whole text, in the tasks that read the table.

Defined results: a null or empty text has an empty vector and scores the
bias; without labels all weights are 0 and every score is 0.5; a label of a
missing document or a null label is not used; of an id's texts the largest is learned from; a
repeated row scores the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratus.llm.common import hash_sample, map_table, tidy, whole_text, worker_state
from stratus.session import materialize

BITS = 18
#: Labelled rows the classifier is fitted on, at most.
SAMPLE = 4096
#: FTRL-proximal: learning rate, smoothing, L1 and L2 strength, passes over a batch.
ALPHA, BETA, L1, L2, PASSES = 2.0, 1.0, 0.05, 1e-3, 3
#: Rows of a training batch, and tasks that make the vectors.
BATCH, FIT_TASKS = 512, 32
#: Words whose hashes a Python worker keeps; a full cache is emptied.
CACHE = 1 << 18

_LETTERS, _DIGITS, _RUN = re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"(.)\1+")
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SAME_WORD, _SAME_SHAPE = np.uint64(12345), np.uint64(0x5851F42D4C957F2D)


def shape(word: str) -> str:
    if word.isalpha():
        return "A" if len(word) > 1 and word.isupper() else "a"
    word = _LETTERS.sub(lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "a", word)
    return _RUN.sub(r"\1\1", _DIGITS.sub("9", word))[:12]


def _hash(word: str) -> bytes:
    """16 bytes: hash of the word and of its shape."""
    hashes = worker_state("quality", dict)
    if len(hashes) >= CACHE:
        hashes.clear()
    data = word.encode("utf-8", "surrogatepass")
    got = hashes[word] = (xxhash.xxh3_64_intdigest(data).to_bytes(8, "little")
                           + xxhash.xxh3_64_intdigest(b"shape:" + shape(word).encode(
                               "utf-8", "surrogatepass")).to_bytes(8, "little"))
    return got


def features(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of a whole text, places ascending."""
    known = worker_state("quality", dict).get
    both = np.frombuffer(b"".join([known(w) or _hash(w) for w in text.split()]), "<u8")
    if not len(both):
        return np.zeros(0, np.int64), np.zeros(0)
    word, form = both[::2], both[1::2]
    same = word[:-1] == word[1:]
    pairs = np.where(same, _SAME_WORD, word[:-1] * _LEFT + word[1:] * _RIGHT)
    forms = (form[:-1] * _LEFT + form[1:] * _RIGHT) ^ np.where(same, _SAME_SHAPE, np.uint64(0))
    grams = np.concatenate([word, form, pairs, forms])
    grams = (grams ^ (grams >> np.uint64(32))) & np.uint64((1 << bits) - 1)
    places, counts = np.unique(grams, return_counts=True)
    values = np.sqrt(counts)
    return places.astype(np.int64), values / np.sqrt(counts.sum())


class Ftrl:
    """FTRL-proximal state; the last place is the bias."""

    def __init__(self, bits: int = BITS):
        self.z = np.zeros((1 << bits) + 1)
        self.n = np.zeros((1 << bits) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        lead = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, lead)

    def update(self, places: np.ndarray, values: np.ndarray, label: float) -> None:
        places, values = np.append(places, len(self.z) - 1), np.append(values, 1.0)
        w = self.weights(places)
        gradient = (logistic(w @ values) - label) * values
        grown = self.n[places] + gradient ** 2
        sigma = (np.sqrt(grown) - np.sqrt(self.n[places])) / ALPHA
        self.z[places] += gradient - sigma * w
        self.n[places] = grown


def logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def _vectors(batches: Iterator[pd.DataFrame], bits: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), BATCH // 4):            # lists take much room
            some = batch.iloc[at:at + BATCH // 4]
            made = [features(t, bits) for t in some["text"]]
            yield pd.DataFrame({"turn": some["turn"].to_numpy(), "label": some["label"].to_numpy(),
                                "places": [p.tolist() for p, _ in made],
                                "gram_values": [v.tolist() for _, v in made]})


def _train(batches: Iterator[pd.DataFrame], bits: int) -> Iterator[pd.DataFrame]:
    state = Ftrl(bits)
    for batch in batches:
        for at in range(0, len(batch), BATCH):
            rows = [(np.asarray(p, np.int64), np.asarray(v, float), float(y)) for p, v, y in zip(
                *(batch[c].iloc[at:at + BATCH] for c in ("places", "gram_values", "label")))]
            for _ in range(PASSES):
                for row in rows:
                    state.update(*row)
    w = state.weights()
    places = np.flatnonzero(w)
    yield pd.DataFrame({"place": places, "weight": w[places]})


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
        text_col: str = "text", sample: int = SAMPLE, bits: int = BITS) -> np.ndarray:
    """Weights (bias last) learned from at most ``sample`` rows of ``labels``."""
    turn = F.xxhash64(F.col("_id").cast("string"))
    known = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
             .select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("label")))
    chosen = hash_sample(known, turn, sample, known.count(), "_id", "label")
    chosen = F.broadcast(materialize(chosen, "labelled"))      # at most ``sample`` rows
    # an id that is repeated gives one row for each of its labels, whatever its rows
    texts = (docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("text"))
             .join(chosen, "_id").groupBy("_id", "turn", "label").agg(F.max("text").alias("text"))
             .select("turn", "label", "text"))
    vectors = materialize(texts.repartition(FIT_TASKS, "turn").mapInPandas(
        tidy(lambda b: _vectors(b, bits)),
        "turn long, label double, places array<long>, gram_values array<double>"), "vectors")
    # the sample is bounded, so one task may read it
    learned = (vectors.repartition(1).sortWithinPartitions("turn", "label")
               .mapInPandas(lambda b: _train(b, bits), "place long, weight double").collect())
    weights = np.zeros((1 << bits) + 1)
    for row in learned:
        weights[row.place] = row.weight
    return weights


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text",
          out: str = "score") -> DataFrame:
    """``docs`` with ``out``: probability that the text is of good quality. A column
    of that name is replaced; all others, whatever their names, pass through."""
    bits = (len(weights) - 1).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index(text_col)
    places = [i for i, f in enumerate(docs.schema.fields) if f.name.lower() != out.lower()]
    fields = [*(docs.schema.fields[i] for i in places), T.StructField(out, T.DoubleType())]

    def run(batches):
        w = shared.value
        for batch in batches:
            scores = []
            for text in batch.column(at):
                hit, values = features(text.as_py() or "", bits)
                scores.append(float(logistic(w[hit] @ values + w[-1])))
            yield [*(batch.column(i) for i in places), pa.array(scores, pa.float64())]

    return map_table(docs, run, fields)


def held_out(id_col: str = "doc_id") -> Column:
    """True for rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2,
                      F.lit(False))

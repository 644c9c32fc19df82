"""Personal data: fixed patterns, and a character-level bidirectional LSTM with
CRF transitions that adds what the patterns miss.

The patterns give the base spans of four kinds (email, ip, card, phone). The
model is trained in numpy on labelled spans: windows of a bounded sample of
documents (``SAMPLE`` distinct texts with a digit or an at sign, smallest hashes of
the text; ``WINDOWS`` windows of theirs at most) with the base spans as labels, some of them
rewritten (numbers regrouped, country codes dropped) so that it learns more than
the patterns say. Training runs in one task on this bounded sample;
the weights (some tens of kB) are broadcast.

Reading a text: windows of ``WIDTH`` characters every ``STRIDE``, on a fixed
grid over the whole text. A window without digit or at sign can hold no
span of any kind, so it is passed over; the others go through the LSTM. Where
windows overlap, their tag scores are averaged with weights that fall towards a window's
edges, and one Viterbi path is found for each stretch of joined windows, so
spans are consistent across window borders. Model spans that hold what their
kind needs and touch no base span are added.

Defined results: a null text counts as empty and has no spans; offsets count
code points, ends are exclusive; repeated rows give repeated results; other columns
pass through. Memory is linear in one text plus a fixed number of windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratus.llm.common import hash_sample, whole_text

KINDS = ("email", "ip", "card", "phone")
SAMPLE, WINDOWS = 3000, 1536
WIDTH, STRIDE = 128, 64
#: Sizes of character vectors and of the LSTM state per direction.
EMBED, HIDDEN = 12, 16
EPOCHS, BATCH, RATE = 6, 64, 0.02
#: Windows that are scored at a time.
LANES = 256
SEED = 17

# --------------------------------------------------------------------------- patterns

# --- Fixed values: the base patterns ------------------------------------------
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# -------------------------------------------------------------------------------
_TRIGGER = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _is_card(text: str) -> bool:
    digits = "".join(_DIGITS.findall(text))
    return 14 <= len(digits) <= 19 and luhn(digits)


def _is_phone(text: str) -> bool:
    return 10 <= len(_DIGITS.findall(text)) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their at signs: a match begins where the
    run of local characters before the sign does."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind."""
    if not _TRIGGER.search(text):
        return []
    found = [(s, 0, e) for s, e in _emails(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text)
              if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if _is_card(m[0])]
    found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if _is_phone(m[0])]
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]

# --------------------------------------------------------------------------- model

#: Tags: 0 outside; 2k+1 first and 2k+2 further characters of a span of kind k.
TAGS = 1 + 2 * len(KINDS)
ALPHABET = 100


def characters(text: str) -> np.ndarray:
    """0 no character, 1 line break, 2-96 ASCII, 97 other letters, 98 white
    space, 99 the rest."""
    if not text:
        return np.zeros(0, np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    out = np.where((codes >= 32) & (codes < 127), codes - 30, 99)
    for i in np.flatnonzero(out == 99):
        c = chr(codes[i])
        out[i] = 1 if c == "\n" else 97 if c.isalpha() else 98 if c.isspace() else 99
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forbidden() -> np.ndarray:
    """Score of impossible steps: a further character needs its own kind before."""
    no = np.zeros((TAGS, TAGS))
    for inner in range(2, TAGS, 2):
        no[:, inner] = -1e4
        no[inner - 1, inner] = no[inner, inner] = 0
    return no


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


class Tagger:
    """Both LSTM directions run as one batch of two; a linear layer gives tag
    scores, the CRF their transitions."""

    NAMES = ("embed", "inp", "rec", "bias", "out", "out_bias", "step", "first")
    no_step = _forbidden()
    no_first = np.array([0.0] + [0.0, -1e4] * len(KINDS))

    def __init__(self, seed: int = SEED, embed: int = EMBED, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        scale = lambda *s: rng.standard_normal(s) / np.sqrt(s[-2])
        self.hidden = hidden
        self.embed = rng.standard_normal((ALPHABET, embed)) * 0.3
        self.inp, self.rec = scale(2, embed, 4 * hidden), scale(2, hidden, 4 * hidden)
        self.bias = np.zeros((2, 1, 4 * hidden))
        self.bias[:, :, hidden:2 * hidden] = 1.0          # the forget gates begin open
        self.out, self.out_bias = scale(2 * hidden, TAGS), np.zeros(TAGS)
        self.step, self.first = np.zeros((TAGS, TAGS)), np.zeros(TAGS)

    def _both(self, x: np.ndarray) -> np.ndarray:
        return np.stack([x, x[:, ::-1]])

    def _lstm(self, chars: np.ndarray, keep: bool):
        """States (2, B, T, H) of windows (B, T); with ``keep`` also what the
        gradient needs."""
        both, h_ = self._both(chars), self.hidden
        drive = np.matmul(self.embed[both].reshape(2, -1, self.embed.shape[1]), self.inp)
        drive = (drive + self.bias).reshape(*both.shape, 4 * h_)
        h = c = np.zeros((2, len(chars), h_))
        states, kept = np.empty((*both.shape, h_)), []
        for t in range(chars.shape[1]):
            z = drive[:, :, t] + np.matmul(h, self.rec)
            gate = _sigmoid(z[..., :3 * h_])
            i, f, o = gate[..., :h_], gate[..., h_:2 * h_], gate[..., 2 * h_:]
            g = np.tanh(z[..., 3 * h_:])
            before, c_before = h, c
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            states[:, :, t] = h
            if keep:
                kept.append((i, f, o, g, tc, before, c_before))
        return states, kept, both

    @staticmethod
    def _joined(states: np.ndarray) -> np.ndarray:
        return np.concatenate([states[0], states[1][:, ::-1]], axis=-1)

    def scores(self, chars: np.ndarray) -> np.ndarray:
        """Tag scores (B, T, TAGS)."""
        return self._joined(self._lstm(chars, False)[0]) @ self.out + self.out_bias

    def loss_and_gradient(self, chars: np.ndarray, tags: np.ndarray):
        """Mean negative log-likelihood per window, and its gradient."""
        states, kept, both = self._lstm(chars, True)
        joined = self._joined(states)
        emit = joined @ self.out + self.out_bias
        n, length = tags.shape
        step, first = self.step + self.no_step, self.first + self.no_first
        ahead, behind = np.empty_like(emit), np.zeros_like(emit)
        ahead[:, 0] = emit[:, 0] + first
        for t in range(1, length):
            ahead[:, t] = emit[:, t] + _log_sum(ahead[:, t - 1, :, None] + step, 1)
        for t in range(length - 2, -1, -1):
            behind[:, t] = _log_sum(step + (emit[:, t + 1] + behind[:, t + 1])[:, None], 2)
        total = _log_sum(ahead[:, -1], 1)
        at = np.arange(n)[:, None], np.arange(length)[None]
        gold = (emit[(*at, tags)].sum(1) + first[tags[:, 0]]
                + step[tags[:, :-1], tags[:, 1:]].sum(1))
        loss = (total - gold).mean()
        d_emit = np.exp(ahead + behind - total[:, None, None])
        d_first = d_emit[:, 0].sum(0)
        pairs = np.exp(ahead[:, :-1, :, None] + step + (emit + behind)[:, 1:, None]
                       - total[:, None, None, None]).sum((0, 1))
        np.subtract.at(pairs, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
        np.subtract.at(d_first, tags[:, 0], 1)
        d_emit[(*at, tags)] -= 1
        d_emit /= n
        grad = {"step": pairs / n, "first": d_first / n, "out_bias": d_emit.sum((0, 1)),
                "out": joined.reshape(n * length, -1).T @ d_emit.reshape(n * length, -1)}
        d_joined = d_emit @ self.out.T
        h_ = self.hidden
        d_states = np.stack([d_joined[..., :h_], d_joined[:, ::-1, h_:]])
        d_drive = np.empty((*both.shape, 4 * h_))
        d_rec, d_h, d_c = np.zeros_like(self.rec), 0.0, 0.0
        for t in range(length - 1, -1, -1):
            i, f, o, g, tc, before, c_before = kept[t]
            d_h = d_h + d_states[:, :, t]
            d_c = d_c + d_h * o * (1 - tc * tc)
            d_z = np.concatenate([d_c * g * i * (1 - i), d_c * c_before * f * (1 - f),
                                  d_h * tc * o * (1 - o), d_c * i * (1 - g * g)], axis=-1)
            d_drive[:, :, t] = d_z
            d_rec += np.matmul(before.transpose(0, 2, 1), d_z)
            d_h = np.matmul(d_z, self.rec.transpose(0, 2, 1))
            d_c = d_c * f
        flat = d_drive.reshape(2, -1, 4 * h_)
        seen = self.embed[both].reshape(2, -1, self.embed.shape[1])
        grad["bias"] = flat.sum(1, keepdims=True)
        grad["rec"], grad["inp"] = d_rec, np.matmul(seen.transpose(0, 2, 1), flat)
        grad["embed"] = np.zeros_like(self.embed)
        np.add.at(grad["embed"], both.ravel(),
                  np.matmul(flat, self.inp.transpose(0, 2, 1)).reshape(-1, self.embed.shape[1]))
        return loss, grad

    def train(self, chars: np.ndarray, tags: np.ndarray, epochs: int = EPOCHS,
              batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> float:
        """Adam with a falling rate; returns the last epoch's mean loss."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        v, turn, loss = {k: np.zeros_like(x) for k, x in m.items()}, 0, 0.0
        steps = epochs * -(-len(chars) // batch)
        for _ in range(epochs):
            order, losses = rng.permutation(len(chars)), []
            for at in range(0, len(chars), batch):
                some = order[at:at + batch]
                one, grad = self.loss_and_gradient(chars[some], tags[some])
                losses.append(one)
                turn += 1
                size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                for k, g in grad.items():
                    g = g * min(1.0, 5.0 / (size + 1e-12))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    now = rate * (1 - turn / (steps + 1))
                    getattr(self, k)[...] -= now * (m[k] / (1 - 0.9 ** turn)) / (
                        np.sqrt(v[k] / (1 - 0.99 ** turn)) + 1e-8)
            loss = float(np.mean(losses))
        return loss

    def dump(self) -> bytes:
        return b"".join(getattr(self, k).astype("<f8").tobytes() for k in self.NAMES)

    @classmethod
    def load(cls, data: bytes) -> Tagger:
        model, at = cls(), 0
        for k in cls.NAMES:
            x = getattr(model, k)
            setattr(model, k, np.frombuffer(data, "<f8", x.size, at).reshape(x.shape).copy())
            at += 8 * x.size
        return model

    def best_tags(self, emit: np.ndarray) -> np.ndarray:
        """Viterbi path of tag scores (B, T, TAGS)."""
        step = self.step + self.no_step
        back = np.empty(emit.shape, np.int8)
        score = emit[:, 0] + self.first + self.no_first
        for t in range(1, emit.shape[1]):
            ways = score[:, :, None] + step
            back[:, t] = ways.argmax(1)
            score = np.take_along_axis(ways, back[:, t][:, None].astype(np.int64), 1)[:, 0] + emit[:, t]
        out = np.empty(emit.shape[:2], np.int64)
        out[:, -1] = score.argmax(1)
        rows = np.arange(len(emit))
        for t in range(emit.shape[1] - 1, 0, -1):
            out[:, t - 1] = back[rows, t, out[:, t]]
        return out

# --------------------------------------------------------------------------- training data


def _tags(n: int, spans) -> np.ndarray:
    tags = np.zeros(n, np.int64)
    for kind, start, end in spans:
        k = KINDS.index(kind)
        if not tags[start:end].any():
            tags[start], tags[start + 1:end] = 2 * k + 1, 2 * k + 2
    return tags


def _rewritten(text: str, spans, rng) -> tuple[str, list]:
    """Half of the phones and cards in forms that the patterns do not know."""
    out, moved, at = [], [], 0
    for kind, start, end in spans:
        if start < at:
            continue
        out.append(text[at:start])
        span = text[start:end]
        if kind == "phone" and rng.random() < 0.5 and len(_DIGITS.findall(span)) >= 11:
            span = re.sub(r"^\+[0-9]+[ .-]*", "", span)
        elif kind == "card" and rng.random() < 0.5:
            digits = "".join(_DIGITS.findall(span))
            span = ".".join(digits[i:i + 4] for i in range(0, len(digits), 4))
        begin = sum(map(len, out))
        out.append(span)
        moved.append((kind, begin, begin + len(span)))
        at = end
    return "".join([*out, text[at:]]), moved


def _examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Windows around digits and at signs, with their labels."""
    for batch in batches:
        rows = []
        for turn, text in zip(batch["turn"], batch["text"]):
            rng = np.random.default_rng(abs(int(turn)))
            for form in (0, 1):
                spans = base_spans(text)
                some, spans = _rewritten(text, spans, rng) if form else (text, spans)
                if form and some == text:
                    continue
                chars, tags = characters(some), _tags(len(some), spans)
                done = -1
                for m in _TRIGGER.finditer(some):
                    if m.start() < done:
                        continue
                    start = max(0, m.start() - int(rng.integers(8, WIDTH // 2)))
                    done = start + WIDTH
                    c, t = (np.zeros(WIDTH, np.uint8) for _ in "ct")
                    part = chars[start:done]
                    c[:len(part)] = part
                    t[:len(part)] = tags[start:done]
                    if t[0] and t[0] % 2 == 0:               # cut inside a span
                        cut = int(np.argmax(t != t[0]))
                        t[:cut] = 0
                    rows.append((int(rng.integers(1 << 62)), c.tobytes(), t.tobytes()))
        yield pd.DataFrame(rows, columns=["turn", "chars", "tags"])


def _fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    frames = [f for f in batches if len(f)]
    model = Tagger()
    if frames:
        rows = pd.concat(frames)
        read = lambda c: np.stack([np.frombuffer(x, np.uint8) for x in rows[c]]).astype(np.int64)
        model.train(read("chars"), read("tags"))
        yield pd.DataFrame({"weights": [model.dump()]})


def _sample(docs: DataFrame, text_col: str, n: int) -> DataFrame:
    """``n`` distinct texts that can hold a span, however often each is there."""
    texts = docs.select(whole_text(text_col).alias("text")).where(F.col("text").rlike("[0-9@]"))
    turn = F.xxhash64(F.lit(SEED), "text")
    total = texts.select(turn.alias("turn")).distinct().count()
    # the bound on the hash goes below distinct(), so few texts are grouped
    return hash_sample(texts.distinct(), turn, n, total)


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE,
        windows: int = WINDOWS) -> bytes | None:
    """Weights trained on a bounded sample; None without any example."""
    some = _sample(docs, text_col, sample)
    examples = (some.select("text", "turn").mapInPandas(_examples, "turn long, chars binary, tags binary")
                .orderBy("turn", "chars").limit(windows))
    learned = examples.repartition(1).sortWithinPartitions("turn", "chars").mapInPandas(
        _fit, "weights binary").collect()                 # bounded sample, one row
    return bytes(learned[0].weights) if learned else None

# --------------------------------------------------------------------------- finding


def _needs(kind: str, span: str) -> bool:
    """What a span of a kind must hold, whatever its form."""
    if kind == "email":
        return bool(re.fullmatch(r"\S+@\S+\.\S+", span)) and span.count("@") == 1
    if kind == "ip":
        parts = re.findall(r"[0-9]+", span)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return _is_card(span) if kind == "card" else _is_phone(span)


class Finder:
    def __init__(self, weights: bytes | None):
        self.model = Tagger.load(weights) if weights else None
        edge = np.arange(WIDTH)
        self.weight = np.minimum(edge + 1, WIDTH - edge)[:, None].astype(float)

    def model_spans(self, text: str) -> list[tuple[str, int, int]]:
        """Spans of the stitched best paths."""
        starts = sorted({s * STRIDE for m in _TRIGGER.finditer(text) for s in range(
            max(0, (m.start() - WIDTH) // STRIDE + 1), m.start() // STRIDE + 1)})
        if not starts or self.model is None:
            return []
        chars = np.concatenate([characters(text), np.zeros(WIDTH, np.int64)])
        out, held = [], []
        for i, start in enumerate(starts):
            held.append(start)
            if i + 1 == len(starts) or starts[i + 1] >= start + WIDTH:
                out += self._stretch(text, chars, held)
                held = []
        return out

    def _stretch(self, text: str, chars: np.ndarray, starts: list[int]):
        first = starts[0]
        end = min(len(text), starts[-1] + WIDTH)
        total = np.zeros((starts[-1] + WIDTH - first, TAGS))
        weight = np.zeros((len(total), 1))
        for at in range(0, len(starts), LANES):
            some = starts[at:at + LANES]
            emit = self.model.scores(np.stack([chars[s:s + WIDTH] for s in some]))
            for s, e in zip(some, emit):
                total[s - first:s - first + WIDTH] += e * self.weight
                weight[s - first:s - first + WIDTH] += self.weight
        n = end - first
        tags = self.model.best_tags((total[:n] / weight[:n])[None])[0]
        found, i = [], 0
        while i < n:
            if tags[i] % 2:
                j = i + 1
                while j < n and tags[j] == tags[i] + 1:
                    j += 1
                kind = KINDS[tags[i] // 2]
                if _needs(kind, text[first + i:first + j]):
                    found.append((kind, first + i, first + j))
                i = j
            else:
                i += 1
        return found

    def spans(self, text: str) -> tuple[list, list]:
        """(base spans, all spans), each by start, then kind."""
        base = base_spans(text)
        held = np.zeros(len(text) + 1, bool)
        for _, s, e in base:
            held[s:e] = True
        more = [x for x in self.model_spans(text) if not held[x[1]:x[2]].any()]
        return base, sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0])))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_SPANS = T.ArrayType(T.StructType().add("kind", T.StringType()).add(
    "start", T.IntegerType()).add("end", T.IntegerType()))


def find(docs: DataFrame, weights: bytes | None, text_col: str = "text") -> DataFrame:
    """``docs`` without its text and with ``base`` and ``spans``: arrays of
    (kind, start, end)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    keep = [c for c in docs.columns if c not in (text_col, "base", "spans")]

    def run(batches):
        finder = Finder(shared.value)
        for batch in batches:
            both = [finder.spans(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            made = [pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in pair[i]]
                              for pair in both], pa.list_(_SPAN)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made],
                                             [*batch.schema.names[:-1], "base", "spans"])

    schema = T.StructType([docs.schema[c] for c in keep]).add("base", _SPANS).add("spans", _SPANS)
    return docs.select(*[F.col(f"`{c}`") for c in keep],
                       whole_text(text_col).alias("text")).mapInArrow(run, schema)

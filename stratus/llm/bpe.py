"""Byte-level BPE as a streaming transducer, and its decoder.

Encoding. Text is cut into pieces by the tokenizer's fixed pattern. Inside a
piece, merges are applied lowest rank first. How far can text to the right of
a token boundary change it? A merge (a, b) at a boundary needs b, and b can
only be spoilt by a merge (c, d) of lower rank that starts on b's right edge
and itself needs d, and so on with falling ranks. So the reach of a merge is

    reach(a, b) = len(b) + max reach(c, d),  c on the right edge of b,
                                             rank(c, d) < rank(a, b)

which one pass over the merge list in rank order computes. The largest reach
is the list's sufficient lookahead: a boundary that lies further than this
from the end of what has been read is final, whatever follows. Tokens are
emitted as soon as they are final, and the transducer restarts at the last
final boundary, so it holds a window of constant size however long a piece is.

Decoding is a byte-to-text state machine: token bytes go through an
incremental UTF-8 decoder that keeps at most the bytes of one unfinished
character; bytes that are not UTF-8 become U+FFFD.

The tokenizer file is a parameter (JSON of the tokenizers library, byte-level
BPE, no normaliser). Its text is broadcast; its size is that of the
vocabulary and does not depend on the data.

Defined results: null and empty texts have no tokens and decode to the empty
text. The strings of special tokens inside a text become those tokens.
Repeated rows give repeated results; every other column passes through.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratus.llm.common import tidy, whole_text, worker_state

# --- Fixed values: the byte-level pre-tokenizer's pattern --------------------
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
           r"|\s+(?!\S)|\s+")
# -----------------------------------------------------------------------------

#: Characters that are cut into pieces at a time.
BLOCK = 1 << 16
#: Pieces up to this many bytes are merged directly.
SHORT = 128
#: Bytes that a long piece advances at a time, besides the lookahead.
STEP = 1024
#: Entries of each generation of a cache.
CACHE = 3 << 16
#: Rows whose results are held in Python at a time.
ROWS = 256

_EDGE = re.compile(r"(?<=\S)(?=\s)")
_IRREGULAR = re.compile(r"\s(?: |\Z)")


def byte_symbols() -> dict[str, int]:
    """Symbol → byte: printable Latin-1 bytes stand for themselves, the others
    are numbered from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and the sufficient lookahead of a tokenizer file."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if (model.get("type") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel"
                or pre.get("add_prefix_space") or not pre.get("use_regex", True)):
            raise ValueError("a byte-level BPE without a normaliser is expected")
        symbols = byte_symbols()
        ids = model["vocab"]
        self.token_bytes = [b""] * (1 + max([*ids.values(), *(t["id"] for t in
                                                              spec["added_tokens"])]))
        for token, i in ids.items():
            self.token_bytes[i] = bytes(symbols[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.byte_id = [0] * 256
        for symbol, b in symbols.items():
            self.byte_id[b] = ids[symbol]
        self.merges: dict[int, tuple[int, int]] = {}
        self.lookahead = self._read_merges(model["merges"], ids)

    def _read_merges(self, merges, ids) -> int:
        """Fill ``merges`` (pair → rank, result) and return the sufficient
        lookahead in bytes. A list in which a token has two makings, or is
        used before it is made, has no such bound by this argument."""
        right: dict[int, int] = {}
        reach: dict[int, int] = {}       # by left part: largest reach so far
        made = set(self.byte_id)
        most = 0
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, second, whole = ids[a], ids[b], ids[a + b]
            if whole in made or left not in made or second not in made:
                raise ValueError(f"merge {rank} is not in making order")
            made.add(whole)
            right[whole] = second
            self.merges[left << 32 | second] = (rank, whole)
            edge, beyond = second, 0
            while edge is not None:
                beyond = max(beyond, reach.get(edge, 0))
                edge = right.get(edge)
            far = len(self.token_bytes[second]) + beyond
            reach[left] = max(reach.get(left, 0), far)
            most = max(most, far)
        return most


def merge(vocabulary: Vocabulary, piece: bytes) -> list[int]:
    """Token ids of one piece: merges by rank, leftmost first among equals."""
    ids = [vocabulary.byte_id[b] for b in piece]
    merges, n = vocabulary.merges, len(ids)
    if n <= SHORT:
        none = (len(merges), 0)
        get = merges.get
        known = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while known:
            best = min(known)
            if best is none:
                break
            i = known.index(best)
            ids[i:i + 2] = [best[1]]
            del known[i]
            if i < len(known):
                known[i] = get(ids[i] << 32 | ids[i + 1], none)
            if i:
                known[i - 1] = get(ids[i - 1] << 32 | ids[i], none)
        return ids
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = [(merges[k][0], i, k) for i in range(n - 1)
             if (k := ids[i] << 32 | ids[i + 1]) in merges]
    heapq.heapify(queue)
    while queue:
        _, i, pair = heapq.heappop(queue)
        j = after[i] if ids[i] >= 0 else n
        if j >= n or ids[i] << 32 | ids[j] != pair:
            continue                                  # one of the two was merged since
        ids[i], ids[j] = merges[pair][1], -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
        for x, y in ((before[i], i), (i, k)):
            if x >= 0 and y < n and (p := ids[x] << 32 | ids[y]) in merges:
                heapq.heappush(queue, (merges[p][0], x, p))
    return [i for i in ids if i >= 0]


class Transducer:
    """Bytes of one piece in, final tokens out; holds a bounded window."""

    def __init__(self, vocabulary: Vocabulary, step: int = STEP):
        self.vocabulary, self.step, self.window = vocabulary, step, bytearray()

    def feed(self, data: bytes) -> list[int]:
        """Tokens that became final. ``data`` may have any length."""
        out: list[int] = []
        most = self.vocabulary.lookahead + self.step
        for at in range(0, len(data), self.step):
            self.window += data[at:at + self.step]
            if len(self.window) >= most:
                out += self._final(len(self.window) - self.vocabulary.lookahead)
        return out

    def _final(self, until: int) -> list[int]:
        end, out = 0, []
        for i in merge(self.vocabulary, bytes(self.window)):
            size = len(self.vocabulary.token_bytes[i])
            if end + size > until:
                break
            out.append(i)
            end += size
        del self.window[:end]
        return out

    def finish(self) -> list[int]:
        out = merge(self.vocabulary, bytes(self.window))
        self.window.clear()
        return out


class Encoder:
    """Text → int32 ids, block by block, with bounded caches of encoded pieces:
    a full cache becomes the old generation, from which hits come back."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.pieces = regex.compile(PATTERN)
        self.special = (re.compile("(%s)" % "|".join(map(re.escape, sorted(
            vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None)
        self.by_piece: dict[str, bytes] = {}
        self.by_word: dict[str, bytes] = {}      # a word with the space before it
        self.old_pieces: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}

    @staticmethod
    def _pack(ids) -> bytes:
        return array("i", ids).tobytes()

    def _merged(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "surrogatepass")
        if len(data) > SHORT:
            stream = Transducer(self.vocabulary)
            return self._pack(stream.feed(data)) + self._pack(stream.finish())
        return self._pack(merge(self.vocabulary, data))

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece; a piece with a space before it is kept as a word."""
        if piece[0] == " " and len(piece) > 1:
            return self.by_word.get(piece[1:]) or self._word(piece[1:], (piece,))
        got = self.by_piece.get(piece) or self.old_pieces.get(piece)
        if got is None:
            got = self._merged(piece)
            if len(piece) <= SHORT:
                if len(self.by_piece) >= CACHE:
                    self.old_pieces, self.by_piece = self.by_piece, {}
                self.by_piece[piece] = got
        return got

    def _span(self, text: str) -> bytes:
        return b"".join([self._piece(p) for p in self.pieces.findall(text)])

    def _word(self, word: str, parts=None) -> bytes:
        """Ids of a word with the space before it."""
        got = self.old_words.get(word)
        if got is None:
            parts = parts or self.pieces.findall(" " + word)
            got = self._merged(parts[0]) if len(parts) == 1 else b"".join(map(self._piece, parts))
        if len(word) <= SHORT:
            if len(self.by_word) >= CACHE:
                self.old_words, self.by_word = self.by_word, {}
            self.by_word[word] = got
        return got

    def _block(self, text: str) -> bytes:
        """A block that ends at a piece boundary. No piece holds a non-space
        before a space, so words with the space before them encode alone. Where
        a blank stands before a space or the end, pieces are cut one by one."""
        if _IRREGULAR.search(text):
            return self._span(text)
        words = text.split(" ")
        known, unknown = self.by_word.get, self._word
        out = [known(w) or unknown(w) for w in words[1:]]
        return (self._span(words[0]) if words[0] else b"") + b"".join(out)

    def blocks(self, text: str) -> Iterator[bytes]:
        """Ids of ``text`` in order, as bytes of bounded length."""
        parts = self.special.split(text) if self.special else [text]
        for part in parts:
            if part in self.vocabulary.special:
                yield self._pack([self.vocabulary.special[part]])
                continue
            at = 0
            while at < len(part):
                end = min(len(part), at + BLOCK)
                if end < len(part):
                    edges = [m.start() for m in _EDGE.finditer(part, at + 1, end)]
                    if not edges:      # one long run: its pieces, read lazily
                        for m in self.pieces.finditer(part, at):
                            yield self._piece(m.group())
                            at = m.end()
                            if at >= end:
                                break
                        continue
                    end = edges[-1]
                yield self._block(part[at:end])
                at = end

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.blocks(text)), "<i4")


class Decoder:
    """Ids in, text out; between calls it holds at most the bytes of one
    unfinished character."""

    def __init__(self, vocabulary: Vocabulary):
        self.token_bytes = vocabulary.token_bytes
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids, last: bool = False) -> str:
        data = b"".join([self.token_bytes[i] for i in ids])
        return self.state.decode(data, last)

    def decode(self, ids: np.ndarray) -> str:
        self.state.reset()
        out = [self.feed(ids[at:at + BLOCK].tolist()) for at in range(0, len(ids), BLOCK)]
        return "".join([*out, self.feed([], True)])


def _worker(kind, spec):
    """One encoder or decoder per Python worker and tokenizer."""
    return worker_state((kind.__name__, hash(spec)), lambda: kind(Vocabulary(spec)))


def _slices(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _with(batch: pa.RecordBatch, column: pa.Array, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, name])


def _read_spec(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as file:
        text = file.read()
    Vocabulary(text)                              # fails here, not in a task
    return df.sparkSession.sparkContext.broadcast(text)


def encode(docs: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` without its text and with ``out``: array of token ids."""
    spec = _read_spec(docs, path)
    keep = [c for c in docs.columns if c not in (text_col, out)]

    def run(batches):
        encoder = _worker(Encoder, spec.value)
        for batch in _slices(batches):
            ids = [encoder.encode(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype="int32")
            values = pa.array(np.concatenate(ids) if ids else np.zeros(0, "<i4"), pa.int32())
            column = pa.ListArray.from_arrays(pa.array(ends), values)
            rest = pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1])
            yield _with(rest, column, out)

    schema = T.StructType([docs.schema[c] for c in keep]).add(out, T.ArrayType(T.IntegerType()))
    return docs.select(*[F.col(f"`{c}`") for c in keep],
                       whole_text(text_col).alias("text")).mapInArrow(
                           tidy(run, keep=True), schema)


def decode(tokens: DataFrame, path: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """``tokens`` with ``out``: the text of its ids (null ids: empty)."""
    spec = _read_spec(tokens, path)
    at = tokens.columns.index(ids_col)

    def run(batches):
        decoder = _worker(Decoder, spec.value)        # holds the tokens, not the merges
        for batch in _slices(batches):
            column = batch.column(at)
            texts = [decoder.decode(column[i].values.to_numpy(zero_copy_only=False)
                                    if column[i].is_valid else np.zeros(0, "<i4"))
                     for i in range(len(column))]
            yield _with(batch, pa.array(texts, pa.string()), out)

    schema = T.StructType(list(tokens.schema.fields)).add(out, T.StringType())
    return tokens.mapInArrow(tidy(run, keep=True), schema)

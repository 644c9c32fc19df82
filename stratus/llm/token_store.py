"""Token ids in canonical length-limited Huffman code.

Files under one folder, written by Spark (so commits are atomic and any store
will do):

``codebook``  one row per id that occurs: id, length. Canonical codes follow
              from the lengths alone: by length, then by id.
``blocks``    one row per block of at most ``BLOCK`` ids, decodable alone:
              part, seq (order of blocks), before (ids of the part before it),
              doc_ids, rows, pieces, sizes (of the texts in it, in order),
              marks (bit offset of every ``MARK``-th id of each text,
              little-endian uint32), bits (the codes, high bit first; each
              text starts on a byte).

Steps: encode texts to ids and write them, with each task's histogram of ids in the
same write; sum the histograms (at most one count per vocabulary entry reaches
the driver); code lengths by package-merge; code every text, deal the codes
out by ranges of the document id and pack each range into blocks.

Decoding looks up ``limit`` bits at a time in a table and runs all checkpoints
of a block at once, as many ids per step as there are checkpoints.

Defined results: null and empty texts hold the end id alone; ids ascend,
null ids last; rows repeated with one id follow each other; a text longer than
a block spans several. An empty table writes an empty store.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratus.llm.common import whole_text, worker_state
from stratus.session import delete_path, materialize, scratch_path

BLOCK = 1 << 16
MARK = 128
#: Bits of the longest code, unless the ids that occur need more.
LIMIT = 16
END = 1
#: Pieces whose ids a Python worker keeps: of Latin-1 texts in a table, which is emptied
#: when full, and of other texts in each of two generations.
TABLE, CACHE = 1 << 20, 1 << 17
#: Rows encoded at a time.
ROWS = 512

_ASCII_BLANK = re.compile("[\\x20\\x09-\\x0D]+")

# --------------------------------------------------------------------------- ids


# --- Fixed value: the pieces of the tokenizers that are taken word by word ------
PIECES = (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# -------------------------------------------------------------------------------
#: The same pieces in a text that is not lower-cased yet.
_ANY_CASE = (r"'[sS]|'[tT]|'[rR][eE]|'[vV][eE]|'[mM]|'[lL][lL]|'[dD]"
             r"|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: The same pieces in lower-cased Latin-1, for Python's faster re.
_BLANKS, _LETTERS, _DIGITS = "\x20\x09-\x0D\x85\xA0", "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
_CONTRACTION = re.compile("'(?:[stmd]|re|ve|ll)")
_LATIN = re.compile(f"[{_LETTERS}]+|{_CONTRACTION.pattern}|[{_DIGITS}]"
                    f"|[^{_BLANKS}{_LETTERS}{_DIGITS}]+")
#: Kind of each Latin-1 byte (a blank 0, a letter 1, a digit 2, another sign 3) and its
#: lower case.
_LOWER = bytes(ord(chr(i).lower()) if len(chr(i).lower().encode("latin-1", "ignore")) == 1 else i
               for i in range(256))
_KIND = np.array([0 if re.match(f"[{_BLANKS}]", c) else 1 if re.match(f"[{_LETTERS}]", c)
                  else 2 if re.match(f"[{_DIGITS}]", c) else 3
                  for c in map(chr, _LOWER)], np.uint8)
#: Bytes of text that are taken apart at once, and of the longest piece in a table.
_PART, _WIDE = 1 << 21, 24
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


class _Table:
    """Ids of Latin-1 pieces of at most 24 bytes: open addressing, looked up for a whole
    array of pieces at once. A key is the piece's bytes and its length, so it is exact."""

    PROBES = 8

    def __init__(self, entries: int):
        slots = 1 << (2 * entries - 1).bit_length()
        self.room, self.mask = entries, np.uint64(slots - 1)
        self.length = np.zeros(slots, np.uint8)              # 0: free
        self.keys = [np.zeros(slots, np.uint64) for _ in range(_WIDE // 8)]
        self.start, self.count = np.zeros(slots, np.int64), np.zeros(slots, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.long: dict[bytes, tuple[int, int]] = {}         # pieces without a place

    def add_ids(self, ids: np.ndarray) -> int:
        """Place of ``ids`` in the store of all ids."""
        at, self.used = self.used, self.used + len(ids)
        if self.used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(self.used, np.uint32)])
        self.flat[at:self.used] = ids
        return at

    def _slots(self, keys: list[np.ndarray], length: np.ndarray) -> np.ndarray:
        mixed = length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for key, by in zip(keys, (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)):
            mixed ^= key * np.uint64(by)
            mixed ^= mixed >> np.uint64(29)
        return mixed * np.uint64(0x9FB21C651E98DF25) >> np.uint64(20)

    def find(self, keys: list[np.ndarray], length: np.ndarray) -> np.ndarray:
        """Slot of each piece, -1 where it has none."""
        first, found = self._slots(keys, length), np.full(len(length), -1, np.int64)
        left = np.arange(len(length))
        for probe in range(self.PROBES):
            at = (first[left] + np.uint64(probe)) & self.mask
            held = self.length[at]
            same = held == length[left]
            for key, mine in zip(keys, self.keys):
                same &= mine[at] == key[left]
            found[left[same]] = at[same]
            left = left[~same & (held > 0)]
            if not len(left):
                break
        return found

    def insert(self, keys: list[np.ndarray], length: np.ndarray, start: np.ndarray,
               count: np.ndarray) -> None:
        """Add pieces that are not there, each once; those that find no slot near
        theirs are left out."""
        first, left = self._slots(keys, length), np.arange(len(length))
        for probe in range(self.PROBES):
            at = (first[left] + np.uint64(probe)) & self.mask
            free = np.flatnonzero(self.length[at] == 0)
            slots, chosen = np.unique(at[free], return_index=True)
            who = left[free[chosen]]
            self.length[slots], self.start[slots], self.count[slots] = length[who], start[who], count[who]
            for key, mine in zip(keys, self.keys):
                mine[slots] = key[who]
            left = np.setdiff1d(left, who, assume_unique=True)
            if not len(left):
                break
        self.room -= len(length)


class _Known(dict):
    """Pieces and their ids. A new piece gets an empty place at once, which is filled
    when it is learned, so every piece of a text is looked up just once."""

    def __init__(self, old: dict):
        self.old, self.new = old, {}

    def __missing__(self, key: str):
        found = self.old.get(key)
        if found is None:
            found = self.new[key] = bytearray()
        self[key] = found
        return found


class WordEncoder:
    """Ids of whole texts, from the tokenizers library.

    The tokenizer drops white space and encodes each piece (letters, a digit,
    other signs) alone, so texts are split into pieces; known pieces come from
    a cache, and new ones go through the library together, separated by
    spaces, and are told apart by the end-of-word suffix of their last token. Latin-1
    texts are taken apart as arrays of bytes, with a table as the cache.
    Words in which normalising or special tokens could reach over a piece's edge
    are encoded whole.
    :meth:`check` refuses tokenizers of another kind."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"     # Spark's tasks are the parallelism
        spec_ = json.loads(spec)
        self.check(spec_)
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        suffix = spec_["model"]["end_of_word_suffix"]
        self.last = np.zeros(self.tokenizer.get_vocab_size(True), bool)
        for token, i in self.tokenizer.get_vocab(True).items():
            self.last[i] = token.endswith(suffix)
        self.pieces = regex.compile(_ANY_CASE)
        self.known = _Known({})
        self.table = _Table(TABLE)

    @staticmethod
    def check(spec: dict) -> None:
        pre = spec.get("pre_tokenizer") or {}
        steps = pre.get("pretokenizers", [pre])
        norm = spec.get("normalizer") or {}
        kinds = [n["type"] for n in norm.get("normalizers", [norm] if norm else [])]
        alone = all(not (t["lstrip"] or t["rstrip"] or t["single_word"])
                    and t["content"].startswith("<|") for t in spec["added_tokens"])
        if not (steps[0].get("type") == "Split" and steps[0].get("invert")
                and steps[0]["behavior"] == "Removed" and steps[0]["pattern"]["Regex"] == PIECES
                and kinds == ["NFC", "Replace", "Lowercase"] and alone
                and spec["model"].get("end_of_word_suffix")):
            raise ValueError("the tokenizer does not treat words alone")

    def _whole(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _learn(self, new: list[str]) -> list[bytes]:
        """Ids of new pieces, from one call of the library (no offsets needed)."""
        ids = np.array(self.tokenizer.encode_batch_fast(
            [" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(new) or len(ids) != (ends[-1] if len(ends) else 0):
            return [self._whole(p) for p in new]
        data, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [data[i:j] for i, j in zip(cuts, cuts[1:])]

    def _keys(self, text: str) -> list[str]:
        """Pieces of a text; words that are encoded whole, with a space before."""
        if "<|" not in text and "İ" not in text and is_normalized("NFC", text):
            try:
                text.encode("latin-1")
                return _LATIN.findall(text.lower())        # lower case sign by sign
            except UnicodeEncodeError:
                return self.pieces.findall(text)
        keys: list[str] = []
        for word in _ASCII_BLANK.split(text):
            if "<|" in word or "İ" in word or not is_normalized("NFC", word):
                keys.append(" " + word)
            else:
                keys += self.pieces.findall(word)
        return keys

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list = [None] * len(texts)
        part, size, other = [], 0, []
        for i, text in enumerate(texts):
            data = self._latin(text)
            if data is None:
                other.append(i)
                continue
            if part and size + len(data) > _PART:
                self._encode_latin(part, out)
                part, size = [], 0
            part.append((i, data))
            size += len(data) + 1
        if part:
            self._encode_latin(part, out)
        for i, ids in zip(other, self._encode_any([texts[i] for i in other])):
            out[i] = ids
        return out

    @staticmethod
    def _latin(text: str) -> bytes | None:
        """Lower-case bytes of a text in which every byte's kind tells the pieces (Latin-1 is
        in NFC)."""
        if "<|" in text:
            return None
        try:
            data = text.encode("latin-1").translate(_LOWER)
        except UnicodeEncodeError:
            return None
        return None if b"'" in data and _CONTRACTION.search(data.decode("latin-1")) else data

    def _encode_latin(self, part: list[tuple[int, bytes]], out: list) -> None:
        data = b" ".join(d for _, d in part)
        if self.table.room < 0:
            self.table = _Table(TABLE)
        table = self.table
        kind = _KIND[np.frombuffer(data, np.uint8)]
        edge = np.zeros(len(kind) + 1, bool)               # a piece ends or begins before it
        np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
        edge[:1] = edge[-1:] = True
        digits = np.flatnonzero(kind == 2)
        edge[digits] = edge[digits + 1] = True
        edges = np.flatnonzero(edge)
        start, end = edges[:-1], edges[1:]
        solid = kind[start] > 0 if len(kind) else np.zeros(0, bool)
        start, length = start[solid], (end - start)[solid]
        padded = np.frombuffer(data + bytes(_WIDE + 8), np.uint8)
        words = np.ndarray((len(data) + _WIDE,), "<u8", padded, 0, (1,))
        keys = [words[start + 8 * i] & _MASKS[np.clip(length - 8 * i, 0, 8)]
                for i in range(_WIDE // 8)]
        slot = table.find(keys, length)
        slot[length > _WIDE] = -1
        lost = np.flatnonzero(slot < 0)
        first, count = table.start[slot], table.count[slot].astype(np.int64)
        if len(lost):
            names = [data[s:s + n] for s, n in zip(start[lost].tolist(), length[lost].tolist())]
            unknown = dict(zip(reversed(names), reversed(lost.tolist())))      # a place of each
            new = [p for p in unknown if p not in table.long]
            fresh: dict[bytes, tuple[int, int]] = {}
            for at in range(0, len(new), 4096):
                some = new[at:at + 4096]
                got = self._learn([p.decode("latin-1") for p in some])
                sizes = [len(x) // 4 for x in got]
                base = table.add_ids(np.frombuffer(b"".join(got), "<u4"))
                for p, n in zip(some, sizes):
                    fresh[p] = (base, n)
                    base += n
            short = [p for p in new if len(p) <= _WIDE]
            if short:
                at = np.array([unknown[p] for p in short])
                table.insert([k[at] for k in keys], length[at].astype(np.uint8),
                             np.array([fresh[p][0] for p in short]),
                             np.array([fresh[p][1] for p in short], np.int32))
            table.long.update((p, v) for p, v in fresh.items() if len(p) > _WIDE)
            table.room -= len(new) - len(short)
            found = [fresh.get(p) or table.long[p] for p in names]
            first[lost] = [f for f, _ in found]
            count[lost] = [n for _, n in found]
        before = np.concatenate([[0], np.cumsum(count)])
        ids = table.flat[np.repeat(first - before[:-1], count) + np.arange(before[-1])]
        sizes = np.array([len(d) + 1 for _, d in part])
        cuts = before[np.searchsorted(start, np.cumsum(sizes) - sizes)].tolist() + [len(ids)]
        for (i, _), a, b in zip(part, cuts, cuts[1:]):
            out[i] = ids[a:b]

    def _encode_any(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) >= CACHE:
            self.known = _Known(dict(self.known))          # the older half goes
        get = self.known.__getitem__
        parts = [list(map(get, self._keys(t))) for t in texts]
        places, self.known.new = self.known.new, {}
        whole = [k for k in places if k[0] == " "]
        pieces = sorted(places.keys() - set(whole))
        learned = list(zip(whole, (self._whole(k[1:]) for k in whole)))
        for at in range(0, len(pieces), 4096):
            some = pieces[at:at + 4096]
            learned += zip(some, self._learn(some))
        for key, ids in learned:
            places[key].extend(ids)
            self.known[key] = ids
        return [np.frombuffer(b"".join(p), "<u4") for p in parts]


def _to_ids(spec, end: int, narrow: bool, places: int):
    """Rows (doc_id, row, ids): ids with the end id, as little-endian bytes; then the
    task's histogram in rows (token, n)."""
    kind = "<u2" if narrow else "<u4"
    names = ["doc_id", "row", "ids", "token", "n"]

    def run(batches):
        encoder = worker_state(("words", hash(spec.value)), lambda: WordEncoder(spec.value))
        counts, key = np.zeros(places, np.int64), pa.null()
        for batch in batches:
            key = batch.schema.field(0).type
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                ids = [np.append(x, np.uint32(end)).astype(kind)
                       for x in encoder.encode(some.column(2).to_pylist())]
                counts += np.bincount(np.concatenate(ids), minlength=places)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1),
                     pa.array([x.tobytes() for x in ids], pa.binary()),
                     pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), pa.int64())], names)
        seen = np.flatnonzero(counts)
        if len(seen):
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(seen), key), pa.nulls(len(seen), pa.int64()),
                 pa.nulls(len(seen), pa.binary()), pa.array(seen), pa.array(counts[seen])], names)
    return run

# --------------------------------------------------------------------------- code


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code with no code over ``limit`` bits
    (package-merge); 0 where the count is 0. One lone symbol gets one bit."""
    symbols = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(symbols)
    if n <= 1:
        lengths[symbols] = 1
        return lengths
    limit = max(limit, int(np.ceil(np.log2(n))))
    order = symbols[np.argsort(counts[symbols], kind="stable")]
    weight = counts[order].astype(np.int64)
    # at every level, in ascending weight: which items are packages
    levels, merged = [], weight
    is_package = np.zeros(n, bool)
    for _ in range(limit):
        levels.append(is_package)
        pairs = merged[:len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weight, pairs])
        by = np.argsort(both, kind="stable")
        merged, is_package = both[by], by >= n
    # of the last level take the 2n - 2 lightest; every package taken takes two below
    take, depth = 2 * n - 2, np.zeros(n + 1, np.int64)
    for is_package in reversed(levels):
        packages = int(is_package[:take].sum())
        depth[take - packages] += 1                # the lightest leaves, one bit more each
        take = 2 * packages
    lengths[order] = np.cumsum(depth[::-1])[::-1][1:]
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then by id."""
    codes = np.zeros(len(lengths), np.uint32)
    code = last = 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)):
        if lengths[i]:
            code <<= int(lengths[i]) - last
            last = int(lengths[i])
            codes[i] = code
            code += 1
    return codes


class Code:
    """Code and decoding table of one codebook."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.codes = canonical_codes(lengths).astype(np.uint64)
        self.limit = int(lengths.max(initial=1))
        self.symbol = np.zeros(1 << self.limit, np.uint32)
        self.width = np.ones(1 << self.limit, np.int64)
        used = np.flatnonzero(lengths)
        for i in used:
            spare = self.limit - int(self.lengths[i])
            first = int(self.codes[i]) << spare
            self.symbol[first:first + (1 << spare)] = i
            self.width[first:first + (1 << spare)] = self.lengths[i]

    def encode(self, ids: np.ndarray, sizes: np.ndarray) -> list[tuple[bytes, np.ndarray]]:
        """For every text of ``ids`` (lengths ``sizes``): its bits, which begin
        on a byte, and the bit offset of every MARK-th id."""
        widths = self.lengths[ids]
        ends = np.cumsum(widths)
        last = np.cumsum(sizes)
        upto = np.append(0, ends)[np.append(0, last)]           # bits before each text
        inside = ends - widths - np.repeat(upto[:-1], sizes)
        spans = (np.diff(upto) + 7) // 8
        base = np.cumsum(spans) - spans
        starts = inside + np.repeat(8 * base, sizes)
        word = starts >> 5
        value = self.codes[ids] << (64 - widths - (starts & 31)).astype(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out = np.zeros(int(word[-1]) + 2 if len(word) else 0, np.uint64)
        if len(word):
            out[word[first]] = np.bitwise_or.reduceat(value >> np.uint64(32), first)
            out[word[first] + 1] |= np.bitwise_or.reduceat(value & np.uint64(0xFFFFFFFF), first)
        data = out.astype(">u4").tobytes()
        return [(data[b:b + n], inside[e - k:e:MARK].astype("<u4"))
                for b, n, e, k in zip(base.tolist(), spans.tolist(), last.tolist(), sizes.tolist())]

    def decode(self, bits: bytes, marks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Ids of a block, all checkpoints in step."""
        lanes = -(-sizes // MARK)
        fill = np.full(len(marks), MARK)
        ends = np.cumsum(lanes) - 1
        fill[ends[lanes > 0]] = (sizes - (lanes - 1) * MARK)[lanes > 0]
        data = np.frombuffer(bits + bytes(MARK * self.limit // 8 + 8), np.uint8).astype(np.uint32)
        window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
        at, mask = marks.astype(np.int64), (1 << self.limit) - 1
        out = np.empty((MARK, len(marks)), np.uint32)
        for step in range(int(fill.max(initial=0))):
            look = (window[at >> 3] >> (32 - self.limit - (at & 7))) & mask
            out[step] = self.symbol[look]
            at += self.width[look]
        return out.T[np.arange(MARK) < fill[:, None]]

# --------------------------------------------------------------------------- writing


class _Packer:
    """Collects coded pieces of one range and gives out blocks."""

    def __init__(self, part: int, id_type: pa.DataType):
        self.part, self.id_type, self.seq, self.before, self.held = part, id_type, 0, 0, []

    def block(self) -> pa.RecordBatch:
        ids, rows, pieces, sizes, bits, marks = zip(*self.held)
        starts = np.cumsum([0, *map(len, bits)])[:-1] * 8
        placed = [m + np.uint32(s) for m, s in zip(marks, starts)]
        names = ["part", "seq", "before", "doc_ids", "rows", "pieces", "sizes", "marks", "bits"]
        out = pa.RecordBatch.from_arrays([
            pa.array([self.part], pa.int32()), pa.array([self.seq], pa.int64()),
            pa.array([self.before], pa.int64()), pa.array([list(ids)], pa.list_(self.id_type)),
            pa.array([list(rows)], pa.list_(pa.int64())),
            pa.array([list(pieces)], pa.list_(pa.int32())),
            pa.array([list(sizes)], pa.list_(pa.int32())),
            pa.array([np.concatenate(placed).astype("<u4").tobytes()], pa.binary()),
            pa.array([b"".join(bits)], pa.binary())], names)
        self.seq, self.before, self.held = self.seq + 1, self.before + sum(sizes), []
        return out


def _to_blocks(kind: str, shared):
    """Code the texts of one range, in order, and pack them into blocks; a text
    longer than a block is cut into pieces."""
    def run(batches):
        code, packer, total = Code(shared.value), None, 0
        for batch in batches:
            if packer is None:
                packer = _Packer(TaskContext.get().partitionId(), batch.schema.field(0).type)
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                keys, cut = [], []
                for doc_id, row, data in zip(some.column(0).to_pylist(), some.column(1).to_pylist(),
                                             some.column(2)):
                    ids = np.frombuffer(data.as_buffer(), kind)
                    for piece, start in enumerate(range(0, len(ids), BLOCK)):
                        keys.append((doc_id, row, piece))
                        cut.append(ids[start:start + BLOCK])
                sizes = np.array([len(c) for c in cut], np.int64)
                for key, size, (bits, marks) in zip(
                        keys, sizes.tolist(), code.encode(np.concatenate(cut), sizes)):
                    if packer.held and total + size > BLOCK:
                        yield packer.block()
                        total = 0
                    packer.held.append((*key, size, bits, marks))
                    total += size
        if packer is not None and packer.held:
            yield packer.block()
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id",
                 text_col: str = "text", end: int = END) -> None:
    """Encode ``docs`` and write its store under ``path``, in ascending id."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = file.read()
    places = max(Tokenizer.from_str(spec).get_vocab_size(True), end + 1)
    narrow = places <= 1 << 16
    kind = "<u2" if narrow else "<u4"
    id_type = docs.schema[id_col].dataType.simpleString()
    raw = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                      whole_text(text_col).alias("text"))
    ids_path = scratch_path(spark, "ids")
    (raw.mapInArrow(_to_ids(spark.sparkContext.broadcast(spec), end, narrow, places),
                    f"doc_id {id_type}, row long, ids binary, token long, n long")
     .write.option("compression", "zstd").parquet(ids_path))
    written = spark.read.parquet(ids_path)
    ids = written.where("token IS NULL").select("doc_id", "row", "ids")
    counts = np.zeros(places, np.int64)
    for row in (written.where("token IS NOT NULL").groupBy("token")
                .agg(F.sum("n").alias("n")).collect()):                  # at most the vocabulary
        counts[row.token] = row.n
    lengths = code_lengths(counts)
    book = pd.DataFrame({"id": np.flatnonzero(lengths), "length": lengths[lengths > 0].astype(int)})
    spark.createDataFrame(book, "id long, length int").coalesce(1).write.parquet(f"{path}/codebook")
    order = [F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    (ids.repartitionByRange(*order).sortWithinPartitions(*order)
     .mapInArrow(_to_blocks(kind, spark.sparkContext.broadcast(lengths)),
                 f"part int, seq long, before long, doc_ids array<{id_type}>, rows array<long>, "
                 "pieces array<int>, sizes array<int>, marks binary, bits binary")
     .write.parquet(f"{path}/blocks"))
    delete_path(spark, ids_path)

# --------------------------------------------------------------------------- reading


def _from_codes(shared):
    """One row per text piece of a block: doc_id, row, piece, part, at (ids of
    the part before it), n_tokens, ids (little-endian uint32)."""
    def run(batches):
        code = Code(shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                cell = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
                sizes = np.array(cell["sizes"].as_py(), np.int64)
                ids = code.decode(cell["bits"].as_py(), np.frombuffer(
                    cell["marks"].as_buffer(), "<u4"), sizes)
                ends = np.cumsum(sizes)
                data = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [cell["doc_ids"].values, cell["rows"].values, cell["pieces"].values,
                     pa.array([cell["part"].as_py()] * len(sizes), pa.int32()),
                     pa.array(cell["before"].as_py() + ends - sizes, pa.int64()),
                     pa.array(sizes, pa.int64()),
                     pa.array([data[4 * (e - s):4 * e] for e, s in zip(ends, sizes)], pa.binary())],
                    ["doc_id", "row", "piece", "part", "at", "n_tokens", "ids"])
    return run


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per text of a store: doc_id, start (ids of all texts before
    it), n_tokens, ids (little-endian uint32, the end id last)."""
    book = spark.read.parquet(f"{path}/codebook").toPandas()       # at most the vocabulary
    lengths = np.zeros(int(book["id"].max()) + 1 if len(book) else 1, np.uint8)
    lengths[book["id"]] = book["length"]
    blocks = spark.read.parquet(f"{path}/blocks")
    id_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    count = F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x)
    # one row per written range
    parts = blocks.groupBy("part").agg(F.sum(count).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    pieces = blocks.mapInArrow(
        _from_codes(spark.sparkContext.broadcast(lengths)),
        f"doc_id {id_type}, row long, piece int, part int, at long, n_tokens long, ids binary")
    pieces = pieces.join(F.broadcast(parts), "part").withColumn(
        "start", F.col("offset") + F.col("at"))
    # only texts longer than a block have more pieces than one
    longer = blocks.where(F.exists("pieces", lambda p: p > 0)).select(
        F.explode(F.arrays_zip("rows", "pieces")).alias("x")).where("x.pieces > 0").select(
        F.col("x.rows").alias("row")).distinct()
    longer = materialize(longer, "longer")
    columns = ["doc_id", "start", "n_tokens", "ids"]
    if longer.isEmpty():
        return pieces.select(*columns)
    whole = pieces.join(longer, "row", "left_anti").select(*columns)
    cut = pieces.join(longer, "row", "left_semi").groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"),
        F.sum("n_tokens").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda done, p: F.concat(done, p["ids"]))
    return whole.unionByName(cut.withColumn("ids", joined).select(*columns))

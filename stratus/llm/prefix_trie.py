"""Prefix trie of conversations, in double arrays.

Every distinct sequence of a conversation's first turns is a node; a node knows
its members, children, leaves and the words that sharing its subtree saves.

1. **Order.** Turns become 16-byte digests where their texts are; a range sort
   by conversation, turn and digest numbers them, so one conversation may hold
   most rows: it spreads over ranges, whose offsets are added up.
2. **Segments.** A rebuilt conversation is cut every ``SEGMENT`` turns. A segment is its
   root (the digest of all turns before it) and its turns' digests, as one binary
   key. Equal segments collapse map side into one row with their number.
3. **Prefix shards.** Distinct segments are sorted by key over ranges, so a shard (a run of
   at most ``SHARD`` turns) holds conversations of like beginnings, and a prefix
   that very many share spreads over shards. Each row knows how many turns it has in
   common with the row before and after it, also across ranges. So a node belongs to the first
   row that has it, and the nodes that another shard may hold too are known: they lie on
   the first or last path.
4. **Double arrays.** A shard's distinct turns get dense ids in the order of their
   first place, breadth first. BASE and CHECK are packed level by level: the child by turn
   t of node s is at BASE[s] + t, and CHECK there is s. All rows traverse
   the arrays together, adding up members, smallest ids and words at their nodes; sums
   then go up along CHECK.
5. **Merging.** Only the upper nodes that shards share carry a digest of their
   prefix; their parts are added up globally, map side first. All others are final.

Deeper levels (turns beyond ``SEGMENT``) are done first; their totals join the
segments above them, one round of steps 3 to 5 a level. Most tables have one.

A member list's digest needs its ids in order: they are sorted over ranges, written out as
text in pieces, and a list that spans ranges is read piece by piece into one SHA-256.

Defined results: rows without a conversation id are in no conversation; a null
role or text is empty; null turns come first, turns of one number go by the
digest of role and text, repeated rows count each time; an empty table
has no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratus.llm.common import WORD, tidy, whole_text
from stratus.session import materialize

#: Turns of a segment, and of a shard, at most.
SEGMENT, SHARD = 8192, 1 << 16
#: Bytes of a turn's digest.
WIDTH = 16
#: Ids of a member list that are written out as one piece of text.
PIECE = 4096

ROOT = "00" * WIDTH
NODE = ("shard string, key binary, parent_key binary, top boolean, depth long, conv long, "
        "parent_conv long, n_convs long, n_children long, n_leaves long, shared long, "
        "distinct_words long, ends string")


def digest(*parts: Column) -> Column:
    """Hex digest of ``WIDTH`` bytes."""
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 2 * WIDTH)


# ---- 1. order ----

def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place of each turn among those of its conversation in this task."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        conv = batch.column(0).to_numpy()
        n = len(conv)
        if not n:
            continue
        new = np.flatnonzero(np.concatenate([[conv[0] != last], conv[1:] != conv[:-1]]))
        start = np.zeros(n, np.int64)
        start[new] = new
        start = np.maximum.accumulate(start)
        pos = np.arange(n) - start + 1
        if not len(new) or new[0]:
            pos[:new[0] if len(new) else n] += seen
        last, seen = conv[-1], int(pos[-1])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(pos), batch.column(1), batch.column(2),
             pa.array(np.full(n, part, np.int32))], ["conv", "pos", "key", "words", "part"])


def numbered_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
                   role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(conv, pos, key, words) of every turn and (conv, turns) of every conversation."""
    role, text = whole_text(f"`{role_col}`"), whole_text(f"`{text_col}`")
    rows = conversations.where(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").alias("turn"),
        digest(F.char_length(role).cast("string"), F.lit(":"), role, text).alias("key"),
        F.regexp_count(text, F.lit(WORD)).alias("words"))
    by = ["conv", F.col("turn").asc_nulls_first(), "key"]
    local = materialize(rows.repartitionByRange(*by).sortWithinPartitions(*by)
                        .select("conv", "key", "words").mapInArrow(
        tidy(_number), "conv long, pos long, key string, words int, part int"), "turns")
    counts = materialize(local.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n")), "counts")
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a conversation that goes on in a range is that range's first: one row a range at most
    offsets = (counts.withColumn("offset", F.sum("n").over(before)).where("offset > 0")
               .select("conv", "part", "offset"))
    turns = (local.join(F.broadcast(offsets), ["conv", "part"], "left")
             .select("conv", (F.col("pos") + F.coalesce("offset", F.lit(0))).alias("pos"),
                     "key", "words"))
    return turns, counts.groupBy("conv").agg(F.sum("n").alias("turns"))


# ---- 2. segments ----

def heads_of(conv: Column) -> Column:
    """Turns that a rebuilt conversation takes over from its group's first one."""
    return (F.crc32(conv.cast("string").cast("binary")) % 4).cast("int")


def segments(turns: DataFrame, convs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv, level, path, words, last, next) of every segment of the rebuilt
    conversations; ``path``: root and turns; ``next``: root of the segment after it."""
    conv = F.col("conv")
    heads = (turns.where((conv % 20 == 0) & (F.col("pos") <= 3)).groupBy("conv")
             .agg(F.array_sort(F.collect_list(F.struct("pos", "key", "words"))).alias("head"))
             .withColumnRenamed("conv", "base"))
    convs = (convs.withColumns({"h": heads_of(conv), "base": conv - conv % 20})
             .join(heads, "base", "left")
             .withColumn("head", F.coalesce(F.slice("head", F.lit(1), F.col("h")),
                                            F.slice(F.array(F.struct(
                                                F.lit(0).cast("long").alias("pos"),
                                                F.lit("").alias("key"),
                                                F.lit(0).alias("words"))), 1, 0)))
             .withColumn("shift", F.col("h") - F.size("head"))
             .withColumn("level", F.explode(F.sequence(
                 F.lit(0), F.floor((F.col("turns") - 1) / segment).cast("int")))))
    # an own turn moves up by as many places as the head is short of, 3 at most: a
    # segment's first ones are given to the segment before it as well
    level = F.floor((F.col("pos") - 1) / segment).cast("int")
    own = (turns.where(F.col("pos") > heads_of(conv))
           .withColumn("level", F.explode(F.when(
               (level > 0) & ((F.col("pos") - 1) % segment < 3), F.array(level - 1, level))
               .otherwise(F.array(level))))
           .groupBy("conv", "level")
           .agg(F.array_sort(F.collect_list(F.struct("pos", "key", "words"))).alias("own")))
    first = F.col("level").cast("long") * segment + F.col("shift")
    cut = (convs.join(own, ["conv", "level"], "left")
           .withColumn("own", F.filter(F.coalesce("own", F.slice("head", 1, 0)),
                                       lambda x: (x["pos"] > first) & (x["pos"] <= first + segment)))
           .withColumn("all", F.when(F.col("level") == 0, F.concat("head", "own"))
                       .otherwise(F.col("own")))
           .withColumn("total", F.col("turns") - F.least(F.col("turns"), F.col("h"))
                       + F.size("head"))
           .where((F.col("level") == 0) | (F.size("all") > 0))
           .select("conv", "level", "total",
                   F.array_join(F.transform("all", lambda x: x["key"]), "").alias("keys"),
                   F.transform("all", lambda x: x["words"]).alias("words")))
    cut = materialize(cut, "segments")
    short = cut.where(F.col("total") <= segment).select(
        "conv", "level", F.unhex(F.concat(F.lit(ROOT), "keys")).alias("path"), "words",
        F.lit(True).alias("last"), F.lit(None).cast("binary").alias("next"))
    # roots of deeper levels: position-wise digests of the segments before, added up
    # in four 32-bit pieces
    each = digest(F.col("level").cast("string"), F.lit(":"), F.col("keys"))
    upto = Window.partitionBy("conv").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    deep = cut.where(F.col("total") > segment).withColumn("each", each)
    sums = [F.sum(F.conv(F.substring("each", 8 * i + 1, 8), 16, 10).cast("long")).over(upto)
            .cast("string") for i in range(4)]
    deep = (deep.withColumn("after", digest(F.concat_ws(",", *sums)))
            .withColumn("root", F.coalesce(F.lag("after").over(
                Window.partitionBy("conv").orderBy("level")), F.lit(ROOT)))
            .withColumn("last", (F.col("level") + 1) * segment >= F.col("total")))
    return short.unionByName(deep.select(
        "conv", "level", F.unhex(F.concat("root", "keys")).alias("path"), "words", "last",
        F.when(~F.col("last"), F.unhex("after")).alias("next")))


# ---- member lists ----

def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (path, conv) rows as (path, part, piece, text), in runs of a path."""
    part, piece = TaskContext.get().partitionId(), 0
    for batch in batches:
        paths, convs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out, at = ([], [], []), 0
        for i in range(1, len(paths) + 1):
            if i == len(paths) or paths[i] != paths[at] or i - at == PIECE:
                out[0].append(paths[at])
                out[1].append(piece)
                out[2].append(",".join(map(str, convs[at:i])))
                at, piece = i, piece + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.binary()), pa.array([part] * len(out[0]), pa.int32()),
             pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())],
            ["path", "part", "piece", "text"])


def _read_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each path's pieces, which come in order, joined by commas."""
    def made(paths, ends):
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.binary()), pa.array(ends, pa.string())],
                                          ["path", "ends"])
    now, sha = None, None
    for batch in batches:
        paths, ends = [], []
        for path, text in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
            if path == now:
                sha.update(b"," + text.encode())
                continue
            if now is not None:
                paths.append(now)
                ends.append(sha.hexdigest())
            now, sha = path, hashlib.sha256(text.encode())
        yield made(paths, ends)
    if now is not None:
        yield made([now], [sha.hexdigest()])


def member_lists(members: DataFrame) -> DataFrame:
    """(path, ends) of (path, conv) rows: SHA-256 of the ascending ids of each path."""
    by = ["path", "conv"]
    pieces = members.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(
        tidy(_pieces), "path binary, part int, piece long, text string")
    return (pieces.repartition("path").sortWithinPartitions("path", "part", "piece")
            .mapInArrow(tidy(_read_pieces), "path binary, ends string"))


# ---- 3. prefix shards ----

def common_units(a: bytes, b: bytes) -> int:
    """Digests that two paths have in common from the start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    x, y = np.frombuffer(a[:n], np.uint8), np.frombuffer(b[:n], np.uint8)
    return int(np.argmax(x != y)) // WIDTH


#: What a distinct segment carries: (shared, distinct_words, n_leaves) are the totals
#: of the segments after it.
BELOW = ["shared", "distinct_words", "n_leaves"]
SEGMENT_ROW = ["path", "words", "n", "conv", "next", "ends", *BELOW]
SORTED = ("part int, no long, path binary, words array<int>, n long, conv long, next binary, "
          "ends string, shared long, distinct_words long, n_leaves long, before int, after int")


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with their number and the units in common with the rows
    before and after; null at the ends of the task's range."""
    part, no, held, last = TaskContext.get().partitionId(), 0, None, None
    names = [c.split()[0] for c in SORTED.split(", ")]

    def made(rows, before, after):
        nonlocal no
        numbers = pa.array(range(no, no + rows.num_rows), pa.int64())
        no += rows.num_rows
        return pa.RecordBatch.from_arrays(
            [pa.array([part] * rows.num_rows, pa.int32()), numbers, *rows.columns,
             pa.array(before, pa.int32()), pa.array(after, pa.int32())], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        paths = batch.column(0).to_pylist()
        link = [common_units(a, b) for a, b in zip(paths, paths[1:])]
        join = None if last is None else common_units(last, paths[0])
        if held is not None:            # the row before this batch, now that its end is known
            yield made(held[0], held[1], [*held[2], join])
        held, last = (batch, [join, *link], link), paths[-1]
    if held is not None:
        yield made(held[0], held[1], [*held[2], None])


def sort_segments(rows: DataFrame) -> DataFrame:
    """``rows`` (``SEGMENT_ROW``) sorted over ranges, with what each has in
    common with its neighbours."""
    got = materialize(rows.select(*SEGMENT_ROW)
                      .repartitionByRange("path").sortWithinPartitions("path")
                      .mapInArrow(tidy(_neighbours), SORTED), "sorted")
    # the ends of the ranges: two rows a range, whatever the table holds
    firsts = got.where("before IS NULL").select("part", F.col("path").alias("first"))
    lasts = got.where("after IS NULL").select("part", F.col("path").alias("last"))
    order = Window.orderBy("part")
    follow = (firsts.select("part").withColumn("prior", F.lag("part").over(order))
              .where("prior IS NOT NULL"))
    pairs = (follow.join(firsts, "part")
             .join(lasts.withColumnRenamed("part", "prior"), "prior"))

    def common(batches):
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([common_units(x, y) for x, y in zip(a, b)], pa.int32())],
                ["part", "prior", "units"])
    seams = materialize(pairs.select("part", "prior", "last", "first").mapInArrow(
        tidy(common), "part int, prior int, units int"), "seams")
    before = F.broadcast(seams.select("part", F.col("units").alias("b")))
    after = F.broadcast(seams.select(F.col("prior").alias("part"), F.col("units").alias("a")))
    return (got.join(before, "part", "left").join(after, "part", "left")
            .withColumn("before", F.coalesce("before", "b", F.lit(0)))
            .withColumn("after", F.coalesce("after", "a", F.lit(0))).drop("a", "b"))


# ---- 4. double arrays ----

class DoubleArray:
    """BASE and CHECK over dense turn ids. Slot 0 is above the roots; a free slot
    has CHECK -1. BASE may be negative: only BASE + id is a place."""

    def __init__(self):
        self.base = np.zeros(1, np.int64)
        self.check = np.zeros(1, np.int64)
        self.low = 1                      # no slot below is free

    def grow(self, size: int) -> None:
        more = size - len(self.check)
        if more > 0:
            more = max(more, len(self.check) // 2)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1)])

    def free(self, count: int) -> np.ndarray:
        """The ``count`` lowest free slots."""
        have = np.flatnonzero(self.check[self.low:self.low + 4 * count] < 0)
        if len(have) < count:
            have = np.flatnonzero(self.check[self.low:] < 0)
        if len(have) < count:
            self.grow(len(self.check) + count - len(have))
            have = np.flatnonzero(self.check[self.low:] < 0)
        return have[:count] + self.low

    def place(self, parents: np.ndarray, codes: np.ndarray) -> None:
        """Add the children ``codes`` of ``parents`` (sorted by parent and code, no
        pair twice)."""
        starts = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
        sizes = np.diff(np.append(starts, len(parents)))
        for s, n in zip(starts[sizes > 1], sizes[sizes > 1]):
            steps = codes[s:s + n] - codes[s]
            for t in self.free(64):
                self.grow(t + steps[-1] + 1)
                if (self.check[t + steps] < 0).all():
                    break
            else:                         # beyond all that is taken
                t = len(self.check)
                self.grow(t + steps[-1] + 1)
            self.base[parents[s]] = t - codes[s]
            self.check[t + steps] = parents[s]
        one = starts[sizes == 1]
        slots = self.free(len(one))
        self.base[parents[one]] = slots - codes[one]
        self.check[slots] = parents[one]
        taken = np.flatnonzero(self.check[self.low:] < 0)
        self.low = self.low + int(taken[0]) if len(taken) else len(self.check)

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The children by ``codes``; 0 where there is none."""
        to = self.base[states] + codes
        inside = (to > 0) & (to < len(self.check))
        to = np.where(inside, to, 0)
        return np.where((to > 0) & (self.check[to] == states), to, 0)


def dense_ids(paths: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids by row and place, lengths): ids in the order of first places, breadth
    first, so children of a node have ids close together; -1 past a row's end."""
    lengths = np.array([len(p) // WIDTH for p in paths], np.int64)
    units = np.frombuffer(b"".join(paths), np.dtype([("a", ">u8"), ("b", ">u8")]))
    _, kind = np.unique(units, return_inverse=True)
    row = np.repeat(np.arange(len(paths)), lengths)
    place = np.arange(len(units)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    order = np.lexsort((row, place))
    first = np.full(kind.max(initial=-1) + 1, len(units))
    np.minimum.at(first, kind[order], np.arange(len(units)))
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    ids = np.full((len(paths), int(lengths.max(initial=0))), -1, np.int64)
    ids[row, place] = rank[kind]
    return ids, lengths


def shard_nodes(rows: list[tuple], shard: str, level: int, segment: int) -> dict[str, list]:
    """The nodes of one shard, by columns of ``NODE``. ``rows``: ``SEGMENT_ROW`` and
    the units in common with the rows before and after, in order."""
    path, words, n, conv, nexts, ends, *below, before, after = zip(*rows)
    ids, lengths = dense_ids(path)
    n, conv = np.array(n, np.int64), np.array(conv, np.int64)
    before, after = np.array(before), np.array(after)
    trie, count = DoubleArray(), int(ids.max(initial=0)) + 1
    state, depths = np.zeros(len(rows), np.int64), []
    for j in range(ids.shape[1]):                       # pack
        at = np.flatnonzero(lengths > j)
        pairs = np.unique(state[at] * count + ids[at, j])
        trie.place(pairs // count, pairs % count)
        state[at] = trie.step(state[at], ids[at, j])
    size = len(trie.check)
    members, smallest = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max)
    word, depth = np.zeros(size, np.int64), np.zeros(size, np.int64)
    children, leaves = np.zeros(size, np.int64), np.zeros(size, np.int64)
    shared, distinct = np.zeros(size, np.int64), np.zeros(size, np.int64)
    carry = np.zeros((3, size), np.int64)
    flat = np.concatenate([np.asarray(w, np.int64) for w in words])
    begin = np.cumsum(lengths - 1) - (lengths - 1)
    state = np.zeros(len(rows), np.int64)
    open_key: dict[int, bytes] = {}
    end_text: dict[int, str] = {}
    for j in range(ids.shape[1]):                       # traverse
        at = np.flatnonzero(lengths > j)
        slot = trie.step(state[at], ids[at, j])
        if not slot.all():
            raise AssertionError("a path is missing in its trie")
        np.add.at(members, slot, n[at])
        np.minimum.at(smallest, slot, conv[at])
        depth[slot] = j
        if j:
            word[slot] = flat[begin[at] + j - 1]
            own = before[at] <= j
            np.add.at(children, state[at][own], 1)
            distinct[slot[own]] += word[slot[own]]
        for r, common in ((0, before[0]), (len(rows) - 1, after[-1])):
            if j < min(common, lengths[r]):
                open_key[int(slot[np.searchsorted(at, r)])] = (
                    path[r][:WIDTH] if j == 0 else
                    hashlib.sha256(path[r][:WIDTH * (j + 1)]).digest()[:WIDTH])
        if j == 0 and level:
            for s, r in zip(slot.tolist(), at.tolist()):
                open_key[s] = path[r][:WIDTH]
        for s, r in zip(slot[lengths[at] == j + 1].tolist(), at[lengths[at] == j + 1].tolist()):
            if ends[r] is not None:
                end_text[s] = ends[r]
            if nexts[r] is not None:
                open_key[s] = nexts[r]
                carry[:, s] = [b[r] or 0 for b in below]
            elif after[r] < lengths[r]:
                leaves[s] = 1
        state[at] = slot
        depths.append(np.unique(slot))
    shared += members * word
    if level:       # the node above the level's first turns is counted where its turn is
        top = depths[0]
        members[top], smallest[top] = 0, np.iinfo(np.int64).max
    for slots in reversed(depths[1:]):                  # sums go up
        parent = trie.check[slots]
        for total, extra in ((shared, carry[0]), (distinct, carry[1]), (leaves, carry[2])):
            np.add.at(total, parent, total[slots] + extra[slots])
    slots = np.concatenate(depths)
    parent = trie.check[slots]
    keys = [open_key.get(s) for s in slots.tolist()]
    none = np.iinfo(np.int64).max
    return {
        "shard": [shard] * len(slots), "key": keys,
        "parent_key": [open_key.get(p) for p in parent.tolist()],
        "top": (depth[slots] == 0).tolist(),
        "depth": (depth[slots] + level * segment).tolist(),
        "conv": [None if c == none else c for c in smallest[slots].tolist()],
        "parent_conv": [None if p == 0 or c == none else c
                        for p, c in zip(parent.tolist(), smallest[parent].tolist())],
        "n_convs": members[slots].tolist(), "n_children": children[slots].tolist(),
        "n_leaves": leaves[slots].tolist(), "shared": shared[slots].tolist(),
        "distinct_words": distinct[slots].tolist(),
        "ends": [end_text.get(s) for s in slots.tolist()]}


def _tries(level: int, segment: int, shard: int):
    """Rows of (part, no, path, …) in order to the nodes of their shards."""
    types = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(),
             "boolean": pa.bool_()}
    fields = [c.split() for c in NODE.split(", ")]

    def made(at, rows):
        got = shard_nodes(rows, f"{level}:{at[0]}:{at[1]}", level, segment)
        return pa.RecordBatch.from_arrays(
            [pa.array(got[name], types[kind]) for name, kind in fields],
            [name for name, _ in fields])

    def run(batches):
        rows, units, at, due = [], 0, None, None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for part, no, *row in zip(*columns):
                if rows and ((part, no) != due or units + len(row[1]) > shard):
                    yield made(at, rows)
                    rows, units = [], 0
                if not rows:
                    at = (part, no)
                rows.append(tuple(row))
                units += len(row[1]) + 1
                due = (part, no + 1)
        if rows:
            yield made(at, rows)
    return run


# ---- 5. merging ----

def merge_nodes(nodes: DataFrame) -> DataFrame:
    """Final rows of the nodes of all shards and levels."""
    measures = ["n_convs", "n_children", "n_leaves", "shared", "distinct_words"]
    closed = nodes.where("key IS NULL")
    parts = nodes.where("key IS NOT NULL")
    merged = materialize(parts.groupBy("key").agg(
        F.min("conv").alias("conv"), F.max("depth").alias("depth"),
        F.max("parent_key").alias("parent_key"), F.min("parent_conv").alias("parent_conv"),
        *[F.sum(c).alias(c) for c in measures], F.max("ends").alias("ends")), "merged")
    # a shard's children of a merged node meet that node's part in their own shard,
    # so no task gets all children of the root
    here = (parts.select("shard", "key").join(merged.select("key", F.col("conv").alias("whole")), "key")
            .select("shard", F.col("key").alias("parent_key"), "whole"))
    up = merged.select(F.col("key").alias("parent_key"), F.col("conv").alias("whole"))
    held = ["depth", "conv", "whole", "parent_conv", *measures, "ends"]
    return (closed.where("parent_key IS NULL").withColumn("whole", F.lit(None).cast("long")).select(*held)
            .unionByName(closed.join(here, ["shard", "parent_key"]).select(*held))
            .unionByName(merged.join(up, "parent_key", "left").select(*held)))


def prefix_nodes(conversations: DataFrame, segment: int = SEGMENT, shard: int = SHARD,
                 **columns: str) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256."""
    turns, convs = numbered_turns(conversations, **columns)
    cut = segments(turns, convs, segment)
    # without "level" in the key: the root says it
    short = F.substring(F.unhex(F.sha2("path", 256)), 1, WIDTH)
    cut = cut.withColumn("id", short)
    ends = member_lists(cut.where("last").select(F.col("id").alias("path"), "conv"))
    rows = (cut.groupBy("id").agg(
        F.max("level").alias("level"), F.max("path").alias("path"), F.max("words").alias("words"),
        F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv"), F.max("next").alias("next"))
        .join(ends.withColumnRenamed("path", "id"), "id", "left"))
    rows = materialize(rows, "distinct")
    deepest = rows.agg(F.max("level")).first()[0] or 0
    nodes, totals = None, None
    for level in range(deepest, -1, -1):
        here = rows.where(F.col("level") == level)
        here = (here.join(totals, "next", "left") if totals is not None else
                here.withColumns({c: F.lit(0).cast("long") for c in BELOW}))
        made = materialize(sort_segments(here).select("part", "no", *SEGMENT_ROW, "before", "after")
                           .mapInArrow(tidy(_tries(level, segment, shard)), NODE), "nodes")
        nodes = made if nodes is None else nodes.unionByName(made)
        totals = (made.where("top").groupBy(F.col("key").alias("next"))
                  .agg(*[F.sum(c).alias(c) for c in BELOW]))
    got = merge_nodes(nodes)
    return got.select(
        F.col("conv").alias("conv_id"), "depth",
        F.when(F.col("depth") > 0, F.coalesce("whole", "parent_conv")).alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves",
        (F.col("shared") - F.col("distinct_words")).alias("saved_tokens"),
        F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


#: DuckDB SQL of the query's rows: prefixes as lists, and CRC-32 bit by bit.
ORACLE = r"""
    WITH o AS (SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                   sha256(length(coalesce(role, '')) || ':' || coalesce(role, '')
                          || coalesce(text, ''))) AS pos
               FROM conversations WHERE conv_id IS NOT NULL),
         c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_concat(
                   [4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''),
                   lambda s: [ascii(s)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                   lambda a, x: CASE WHEN x >= 0 THEN xor(a, x)
                                     ELSE xor(a >> 1, (a & 1) * 3988292384) END),
                   4294967295) % 4 AS h
               FROM (SELECT DISTINCT conv_id FROM o)),
         r AS (SELECT c.conv_id, t, pos FROM c JOIN o ON o.conv_id = base AND pos <= h
               UNION ALL
               SELECT c.conv_id, t, pos FROM c JOIN o ON o.conv_id = c.conv_id AND pos > h),
         l AS (SELECT conv_id, coalesce(s, []) AS s FROM c LEFT JOIN (
                   SELECT conv_id, list(t ORDER BY pos) AS s FROM r GROUP BY conv_id) USING (conv_id)),
         n AS MATERIALIZED (SELECT s[1:d] AS path, d AS depth, min(conv_id) AS conv_id,
                   count(*) AS n_convs,
                   string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = len(s)) AS ends
               FROM (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM l) GROUP BY 1, 2),
         k AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0
               GROUP BY 1),
         v AS (SELECT n.*, coalesce(n_children, 0) AS n_children,
                   CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(list_filter(
                       string_split_regex(path[depth].text, '[\x20\x09-\x0D]+'),
                       lambda w: w <> '')) END AS saved
               FROM n LEFT JOIN k USING (path)),
         u AS (SELECT path[1:d] AS path, sum(saved) AS saved_tokens,
                   count(*) FILTER (n_children = 0) AS n_leaves
               FROM (SELECT *, unnest(range(depth + 1)) AS d FROM v) GROUP BY 1)
    SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves,
           saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
    FROM v JOIN u USING (path) LEFT JOIN n p ON p.depth = v.depth - 1 AND p.path = v.path[1:v.depth - 1]"""

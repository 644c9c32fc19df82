"""Jaccard join on word n-grams: rare-first prefix filtering with length,
positional and suffix filters, candidates joined on prefix n-grams and verified
once per pair; linked texts form components.

A text is the set of its distinct n-grams (64-bit hashes of lower-cased word
runs). All sets are ordered the same way, rare n-grams first: by a count
sketch of bounded size over the whole corpus, then by hash. Two sets that reach the
threshold share an n-gram in their first ``n - ceil(t n) + 1``.

1. Equal texts are one node (smallest id); copies are never paired.
2. Prefix n-grams of one node only are dropped. The rest are ``members``.
3. Stars: in each n-gram's group a few members are centres and only pairs
   (centre, member) arise, of which every node keeps, for each kind of centre,
   the one with the most n-grams in common. The first kind of centre is the member
   in which the n-gram comes earliest, that is the one with the fewest n-grams
   of its own, so the middle of a group of near copies; the others are random.
   Verified links join components. A group of near copies thus costs pairs in
   proportion to its size, not to its square.
4. The last step is exact: all pairs of a group whose members are still in
   different components, less those verified before. Pairs arise between classes (an n-gram's
   members of one size and position) that pass the filters, so texts of one template that
   cannot link don't meet at all, however many there are.

Filters on a pair with a common n-gram at positions i and j: length (sizes
within t of each other), position (from the n-gram on there is room for the
overlap needed; a pair that meets at an earlier n-gram is found there), suffix
(both sets cut at fixed pivots of the hash; the overlap is at most the sum of
the smaller parts). None loses a pair.

Text is read for the profile, for the prefixes, and for the sets of those nodes
that are in a pair which passed all filters (for each of steps 3 and 4); these
rows are picked by a filter whose false hits a join removes. Sketch and filter grow with the
number of texts up to a fixed size; nothing else of the corpus is broadcast.

Defined results: null, empty and blank texts have no n-grams and link with
nothing, not even each other; a text of fewer than ``n`` words is one n-gram;
rows repeated with one id share their component; a null id counts last. Columns
other than id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratus.llm.common import tidy, whole_text, worker_state
from stratus.llm.components import components
from stratus.session import materialize

WORDS = 4
PERCENT = 85
#: Places of the count sketch at least and at most (four a document in between), and
#: rows that carry it.
SKETCH, SKETCH_MOST, PARTS = 1 << 20, 1 << 24, 64
#: Parts into which the suffix filter cuts a set.
PIVOTS = 64
#: Bits of the row filter of the third pass at least and at most (32 a wanted text in
#: between); beyond that it lets more texts through than it must, and loses none.
FILTER, FILTER_MOST = 1 << 20, 1 << 31
#: Members of a class that meet those of another in one key.
CHUNK = 1024
#: Kinds of centres: the earliest, and so many random ones less one.
STARS = 3
#: Rows whose words are held in Python at a time.
ROWS = 256
#: Words whose hashes a Python worker keeps; a full cache is emptied.
CACHE = 1 << 18

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                         0xD6E8FEB86659FD93, 0xA0761D6478BD642F], "<u8")


def _hash(word: bytes) -> bytes:
    hashes = worker_state("ngrams", dict)
    if len(hashes) >= CACHE:
        hashes.clear()
    got = hashes[word] = xxhash.xxh3_64_intdigest(word).to_bytes(8, "little")
    return got


def words_of(text: str) -> list[bytes]:
    """Words with A-Z in lower case; bytes split at ASCII white space only."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def ngrams(words: list[bytes], n: int = WORDS) -> np.ndarray:
    """Distinct n-gram hashes, ascending."""
    if not words:
        return np.zeros(0, "<u8")
    known = worker_state("ngrams", dict).get
    h = np.frombuffer(b"".join([known(w) or _hash(w) for w in words]), "<u8")
    n = min(n, len(h))
    grams = np.full(len(h) - n + 1, np.uint64(n))
    for i in range(n):
        grams = (grams ^ (grams >> np.uint64(29))) * _MULTIPLIERS[i % 5] + h[i:len(h) - n + 1 + i]
    grams ^= grams >> np.uint64(32)
    grams *= _MULTIPLIERS[0]
    return np.unique(grams ^ (grams >> np.uint64(29)))


def digest(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def power_of_two(wanted: int, least: int, most: int) -> int:
    return min(most, max(least, 1 << max(wanted - 1, 0).bit_length()))


def _place(grams: np.ndarray, places: int) -> np.ndarray:
    return (grams >> np.uint64(64 - (places.bit_length() - 1))).astype(np.int64)


def prefix_length(n: int, percent: int) -> int:
    return n + (-percent * n) // 100 + 1


def _texts(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            some = batch.slice(at, ROWS)
            yield some.column(0), [words_of(t) for t in some.column(1).to_pylist()]


def _profile(n: int, places: int):
    """Rows (doc_id, digest, n) and, at the end, the task's count sketch."""
    def run(batches):
        counts = np.zeros(places, "<i4")
        schema, width = None, places // PARTS
        for ids, docs in _texts(batches):
            sizes = []
            for words in docs:
                grams = ngrams(words, n)
                sizes.append(len(grams))
                counts[_place(grams, places)] += 1        # places of one text may meet: counted once
            nothing = pa.nulls(len(docs), pa.int32())
            batch = pa.RecordBatch.from_arrays(
                [ids, pa.array([digest(w) for w in docs], pa.binary()),
                 pa.array(sizes, pa.int32()), nothing, pa.nulls(len(docs), pa.binary())],
                ["doc_id", "digest", "n", "part", "counts"])
            schema = batch.schema
            yield batch
        if schema is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(PARTS, schema.field(0).type), pa.nulls(PARTS, pa.binary()),
                 pa.nulls(PARTS, pa.int32()), pa.array(range(PARTS), pa.int32()),
                 pa.array([counts[i * width:(i + 1) * width].tobytes() for i in range(PARTS)],
                          pa.binary())], schema=schema)
    return run


def _add_counts(part: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(1, "<i8")
    for frame in frames:
        for data in frame["counts"]:
            total = total + np.frombuffer(data, "<i4")
    yield pd.DataFrame({"part": [part[0]],
                        "counts": [np.minimum(total, 2 ** 31 - 1).astype("<i4").tobytes()]})


def _prefixes(n: int, percent: int, sketch):
    """Rows (doc_id, digest, n, prefix, bins) of texts with n-grams."""
    def run(batches):
        counts = sketch.value
        for ids, docs in _texts(batches):
            at, out = [], []
            for i, words in enumerate(docs):
                grams = ngrams(words, n)
                if len(grams):
                    order = np.lexsort((grams, counts[_place(grams, len(counts))]))
                    first = grams[order[:prefix_length(len(grams), percent)]]
                    bins = np.bincount((grams & np.uint64(PIVOTS - 1)).astype(np.int64),
                                       minlength=PIVOTS)
                    at.append(i)
                    out.append((digest(words), len(grams), first.view("<i8"), bins))
            ends = np.cumsum([0, *(len(p) for *_, p, _ in out)], dtype="int32")
            flat = np.concatenate([p for *_, p, _ in out]) if out else np.zeros(0, "<i8")
            bins = np.concatenate([b for *_, b in out]) if out else np.zeros(0, "<i8")
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at, pa.int64())),
                 pa.array([d for d, *_ in out], pa.binary()),
                 pa.array([s for _, s, *_ in out], pa.int32()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64())),
                 pa.ListArray.from_arrays(
                     pa.array(np.arange(len(out) + 1, dtype="int32") * PIVOTS),
                     pa.array(bins, pa.int32()))],
                ["doc_id", "digest", "n", "prefix", "bins"])
    return run


def _filter_bits(key: np.ndarray, size: int) -> list[np.ndarray]:
    """Four bit numbers of each 16-byte digest."""
    low, high = key[:, 0], key[:, 1]
    return [((low + np.uint64(i) * high) % np.uint64(size)).astype(np.int64) for i in range(4)]


def _marks(size: int):
    """Words (64 bits) of the row filter that the batch's digests set."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                key = np.frombuffer(b"".join(batch["digest"]), "<u8").reshape(-1, 2)
                bit = np.unique(np.concatenate(_filter_bits(key, size)))
                yield pd.DataFrame({"word": bit >> 6, "bits": np.left_shift(np.int64(1), bit & 63)})
    return run


def _sets(n: int, marks):
    """Rows (digest, grams) of the texts that the row filter lets through."""
    def run(batches):
        field = marks.value
        for _, docs in _texts(batches):
            docs = [w for w in docs if w]
            if not docs:
                continue
            keys = [digest(w) for w in docs]
            key = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
            hit = np.ones(len(docs), bool)
            for bit in _filter_bits(key, 64 * len(field)):
                hit &= (field[bit >> 6] >> (bit & 63)) & 1 == 1
            for i in np.flatnonzero(hit):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[i]], pa.binary()),
                     pa.array([ngrams(docs[i], n).tobytes()], pa.binary())], ["digest", "grams"])
    return run


def _gathered(run, rows: int = 256):
    """Joins the small batches of ``run`` to batches of up to ``rows``."""
    def gather(batches):
        held = []
        for batch in run(batches):
            held.append(batch)
            if len(held) == rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
    return gather


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = []
            for i in range(batch.num_rows):
                x = np.frombuffer(left[i].as_buffer(), "<u8")
                y = np.frombuffer(right[i].as_buffer(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
    return run


def _room(n1: Column, p1: Column, n2: Column, p2: Column, percent: int) -> Column:
    """Length and positional filter."""
    overlap = F.least(n1 - p1, n2 - p2)
    return ((100 * F.least(n1, n2) >= percent * F.greatest(n1, n2))
            & ((100 + percent) * overlap >= percent * (n1 + n2)))


class NgramJoin:
    """One join over ``docs``; the steps above as methods."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 n: int = WORDS, percent: int = PERCENT, stars: int = STARS):
        self.spark, self.n, self.percent, self.stars = docs.sparkSession, n, percent, stars
        self.docs = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
        self.id_type = self.docs.schema["doc_id"].dataType.simpleString()

    def profile(self) -> tuple[DataFrame, np.ndarray]:
        """(rows doc_id, digest, n; count sketch of all n-grams)."""
        places = power_of_two(4 * self.docs.count(), SKETCH, SKETCH_MOST)
        both = materialize(self.docs.mapInArrow(
            tidy(_profile(self.n, places)), f"doc_id {self.id_type}, digest binary, n int, part int, "
            "counts binary"), "profile")
        counts = np.zeros(places, "<i4")
        width = places // PARTS
        for row in (both.where("part is not null").select("part", "counts").groupBy("part")
                    .applyInPandas(_add_counts, "part int, counts binary").collect()):
            counts[row.part * width:(row.part + 1) * width] = np.frombuffer(row.counts, "<i4")
        return both.where("part is null").select("doc_id", "digest", "n"), counts

    def nodes(self, sketch: np.ndarray) -> DataFrame:
        """One row per distinct text: node, digest, n, doc_id (its smallest),
        prefix, bins. Written, so the node numbers are fixed."""
        rows = self.docs.mapInArrow(
            tidy(_prefixes(self.n, self.percent, self.spark.sparkContext.broadcast(sketch))),
            f"doc_id {self.id_type}, digest binary, n int, prefix array<long>, bins array<int>")
        return materialize(
            rows.groupBy("digest").agg(F.first("n").alias("n"), F.min("doc_id").alias("doc_id"),
                                       F.first("prefix").alias("prefix"),
                                       F.first("bins").alias("bins"))
            .withColumn("node", F.monotonically_increasing_id()), "nodes")

    @staticmethod
    def members(nodes: DataFrame) -> DataFrame:
        """(gram, node, n, pos) of prefix n-grams that two or more nodes have."""
        rows = nodes.select("node", "n", F.posexplode("prefix").alias("pos", "gram"))
        shared = (rows.groupBy("gram").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
                  .select("gram"))
        return materialize(rows.join(shared, "gram"), "members")

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(node, grams) of the nodes ``wanted`` (node, digest)."""
        size = power_of_two(32 * wanted.count(), FILTER, FILTER_MOST)
        field = np.zeros(size // 64, "<i8")
        marks = (wanted.select("digest").mapInPandas(_marks(size), "word long, bits long")
                 .groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow())
        field[marks["word"].to_numpy()] = marks["bits"].to_numpy()
        found = self.docs.mapInArrow(
            tidy(_gathered(_sets(self.n, self.spark.sparkContext.broadcast(field)))),
            "digest binary, grams binary")
        found = found.groupBy("digest").agg(F.first("grams").alias("grams"))
        return materialize(wanted.join(found, "digest").select("node", "grams"), "sets")

    def suffix_filter(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        parts = nodes.select("node", "n", "bins")
        a, b = (parts.select(*[F.col(c).alias(f"{c}_{x}") for c in parts.columns]) for x in "ab")
        near = (pairs.join(a, F.col("a") == F.col("node_a")).join(b, F.col("b") == F.col("node_b")))
        most = F.aggregate(F.zip_with("bins_a", "bins_b", lambda x, y: F.least(x, y)), F.lit(0),
                           lambda s, x: s + x)
        return near.where((100 + self.percent) * most
                          >= self.percent * (F.col("n_a") + F.col("n_b"))).select("a", "b")

    def verify(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """The linked (a, b) of ``pairs`` (a, b), each checked once."""
        pairs = materialize(self.suffix_filter(pairs, nodes), "pairs")
        if pairs.isEmpty():
            return pairs
        wanted = materialize(
            pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            .join(nodes.select("node", "digest"), "node"), "wanted")
        sets = self.sets(wanted)
        left = sets.select(F.col("node").alias("a"), F.col("grams").alias("grams_a"))
        right = sets.select(F.col("node").alias("b"), F.col("grams").alias("grams_b"))
        return materialize(
            pairs.join(left, "a").join(right, "b").select("a", "b", "grams_a", "grams_b")
            .mapInArrow(tidy(_verify(self.percent)), "a long, b long"), "links")

    def star_pairs(self, members: DataFrame) -> DataFrame:
        """For every node and kind of centre one pair: with the centre it has
        most n-grams in common."""
        kinds = []
        for kind in range(self.stars):
            h = F.xxhash64("node", F.lit(kind))
            first = F.struct(F.col("pos").alias("x"), h.alias("h")) if kind == 0 else F.struct(
                F.lit(0).alias("x"), h.alias("h"))
            kinds.append(F.min(F.struct(first.alias("first"), F.lit(kind).alias("kind"),
                                        F.col("node").alias("c"), F.col("n").alias("cn"),
                                        F.col("pos").alias("cp"))))
        centres = (members.groupBy("gram").agg(F.array(*kinds).alias("all"))
                   .select("gram", F.explode("all").alias("s"))
                   .select("gram", "s.kind", "s.c", "s.cn", "s.cp"))
        pairs = members.join(centres, "gram").where((F.col("node") != F.col("c")) & _room(
            F.col("n"), F.col("pos"), F.col("cn"), F.col("cp"), self.percent))
        most = (pairs.groupBy("node", "kind", "c").agg(F.count(F.lit(1)).alias("m"))
                .groupBy("node", "kind").agg(F.max_by("c", F.struct("m", "c")).alias("c")))
        return most.select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct()

    def class_pairs(self, classes: DataFrame) -> DataFrame:
        """Pairs of an n-gram's classes (n, pos) whose members pass the length and
        positional filters, each once. Sizes within the threshold of each other
        are in the same range of sizes or in adjacent ones."""
        step = math.log(100 / self.percent) + 1e-6
        size = F.floor(F.log(F.col("n").cast("double")) / step).cast("int")
        ranged = classes.withColumn("range", size)
        other = ranged.select("gram", *[F.col(c).alias(f"{c}_b") for c in ("n", "pos", "m", "lo", "hi")],
                              F.explode(F.array(*[F.col("range") + i for i in (-1, 0, 1)])).alias("range"))
        one, two = F.struct("n", "pos"), F.struct("n_b", "pos_b")
        return (ranged.join(other, ["gram", "range"]).where(
            _room(F.col("n"), F.col("pos"), F.col("n_b"), F.col("pos_b"), self.percent)
            & (one <= two) & ((one < two) | (F.col("m") > 1))
            & ((F.col("lo") != F.col("hi")) | (F.col("lo_b") != F.col("hi_b"))
               | (F.col("lo") != F.col("lo_b"))))
            .select("gram", "n", "pos", "m", "n_b", "pos_b", "m_b"))

    def all_pairs(self, members: DataFrame) -> DataFrame:
        """Every pair that shares a prefix n-gram across components and passes the length
        and positional filters.

        Members of an n-gram with one size and position are a class. Which classes can
        pair is found from their counts, so members that no other can meet, however
        many share the n-gram, never meet. A large class is dealt into chunks, and
        each pair of chunks is a key of its own."""
        mixed = (members.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
                 .where("lo <> hi").select("gram"))
        open_ = materialize(members.join(mixed, "gram"), "open")
        classes = materialize(open_.groupBy("gram", "n", "pos").agg(
            F.count(F.lit(1)).alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi")), "classes")
        chunks = lambda m: F.ceil(F.col(m) / CHUNK).cast("int")
        pairs = materialize(
            self.class_pairs(classes).withColumn("chunks", chunks("m")).withColumn("chunks_b", chunks("m_b"))
            .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .withColumn("chunk_b", F.explode(F.sequence(F.lit(0), F.col("chunks_b") - 1)))
            .select("gram", "n", "pos", "chunk", "n_b", "pos_b", "chunk_b"), "classpairs")
        dealt = open_.join(classes.select("gram", "n", "pos", "m"), ["gram", "n", "pos"]).withColumn(
            "chunk", F.pmod(F.xxhash64("node"), chunks("m")).cast("int"))
        # members of classes that pair at all
        able = pairs.select("gram", "n", "pos", "chunk").unionByName(pairs.select(
            "gram", F.col("n_b").alias("n"), F.col("pos_b").alias("pos"),
            F.col("chunk_b").alias("chunk"))).distinct()
        dealt = materialize(dealt.join(able, ["gram", "n", "pos", "chunk"], "left_semi")
                            .select("gram", "n", "pos", "chunk", "node", "label"), "dealt")
        other = dealt.select("gram", *[F.col(c).alias(f"{c}_b")
                                       for c in ("n", "pos", "chunk", "node", "label")])
        met = (dealt.join(pairs, ["gram", "n", "pos", "chunk"])
               .join(other, ["gram", "n_b", "pos_b", "chunk_b"])
               .where((F.col("label") != F.col("label_b"))
                      & ((F.col("n") != F.col("n_b")) | (F.col("pos") != F.col("pos_b"))
                         | (F.col("node") < F.col("node_b")))))
        return met.select(F.least("node", "node_b").alias("a"),
                          F.greatest("node", "node_b").alias("b")).distinct()

    def run(self) -> DataFrame:
        """One row per row of the input: doc_id, n_shingles, component_id."""
        rows, sketch = self.profile()
        nodes = self.nodes(sketch)
        members = self.members(nodes)
        tried = labels = None
        if self.stars:
            tried = materialize(self.star_pairs(members), "stars")
            links = self.verify(tried, nodes)
            labels = components(links)
            members = (members.join(labels, "node", "left")
                       .withColumn("label", F.coalesce("label", "node")))
        else:
            members = members.withColumn("label", F.col("node"))
        pairs = self.all_pairs(materialize(members, "members"))
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        rest = self.verify(materialize(pairs, "rest"), nodes)
        if not rest.isEmpty():
            links = links.unionByName(rest) if labels is not None else rest
            labels = components(links)
        ids = nodes.select("node", "digest", "doc_id")
        if labels is not None:
            linked = ids.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
            linked = materialize(linked, "linked")
            smallest = linked.groupBy("label").agg(F.min("doc_id").alias("component_id"))
            ids = linked.join(smallest, "label")
        else:
            ids = ids.withColumn("component_id", F.col("doc_id"))
        ids = ids.select("digest", "component_id")
        alone = rows.where("n = 0").select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                                           F.col("doc_id").alias("component_id"))
        return (rows.where("n > 0").join(ids, "digest")
                .select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
                .unionByName(alone))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    n: int = WORDS, percent: int = PERCENT, **options) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest id reachable by links) of
    every row of ``docs``."""
    return NgramJoin(docs, id_col, text_col, n, percent, **options).run()

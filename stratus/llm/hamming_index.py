"""Nearest neighbours by multi-index hashing.

Fitting (a bounded sample, ``SAMPLE`` rows of smallest id hash): principal
axes, then ``ROTATIONS`` rotations, from different starts, that each bring the signs of the
rotated axes close to the values themselves (iterative quantisation). The signs are a
code of up to 64 bits for each rotation. The radius is the Hamming distance within which, by
one code or another, ``COVER`` of the sample's true neighbours lie; neighbours in the
whole table are nearer, so it covers at least as many there. Several codes need a
smaller radius than one, so each retrieves far fewer rows.

Search: codes are split into four substrings, each with a table from substring
to rows. Two codes within radius ``r = 4a + b`` differ by at most ``a`` in one
of the first ``b + 1`` substrings or by at most ``a - 1`` in one of the others,
so looking up those substrings' neighbourhoods in the tables retrieves every code in the
radius; where fewer than k are found the radius grows until there are k. What any of the
codes retrieves is ranked by distance on the original vectors, in double precision.

At scale: vectors are shuffled once, to count an id once, and written. A task reads its
part in index blocks of at most ``BLOCK_ROWS`` rows (and ``BLOCK_BYTES``) and builds
the tables of each. Queries come in blocks of about ``QUERY_ROWS``, so what is broadcast is
bounded; for each, one job maps the written vectors to k rows per query and index block, of
which the best k are taken. Index vectors never move for it.

Defined results: vectors that are null, zero, of another length than most or
hold null or non-finite components take no part, nor do null ids; rows repeated
with one id count once (the smallest vector); a query never finds its own id;
ties go to the smaller id; with fewer than k others all are returned.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratus.llm.common import hash_sample, tidy
from stratus.session import materialize, scratch_path

SAMPLE = 8192
#: Codes of a vector.
ROTATIONS = 8
#: Share of the sample's neighbours that the radius must hold.
COVER = 0.95
TUNE_QUERIES = 512
ITERATIONS = 40
TABLES = 4
BLOCK_ROWS, BLOCK_BYTES = 1 << 16, 1 << 26
QUERY_ROWS = 1 << 15
SEED = 7


class Codes:
    """Axes, rotations and radius learned from a sample."""

    def __init__(self, sample: np.ndarray, k: int, seed: int = SEED, rotations: int = ROTATIONS):
        rng = np.random.default_rng(seed)
        self.mean = sample.mean(0)
        centred = sample - self.mean
        _, axes = np.linalg.eigh(centred.T @ centred)
        self.bits = min(64, sample.shape[1])
        axes = axes[:, ::-1][:, :self.bits]
        values = centred @ axes
        self.projections = []
        for _ in range(rotations):
            turn = np.linalg.qr(rng.standard_normal((self.bits, self.bits)))[0]
            for _ in range(ITERATIONS):
                signs = np.where(values @ turn >= 0, 1.0, -1.0)
                u, _, v = np.linalg.svd(signs.T @ values)
                turn = (u @ v).T
            self.projections.append(axes @ turn)
        self.radius = self._tune(sample, k)

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """Codes (rotations, rows)."""
        out = np.zeros((len(self.projections), len(vectors)), "<u8")
        for code, projection in zip(out, self.projections):
            some = np.packbits((vectors - self.mean) @ projection >= 0, axis=1, bitorder="little")
            code.view(np.uint8).reshape(len(vectors), 8)[:, :some.shape[1]] = some
        return out

    def _tune(self, sample: np.ndarray, k: int) -> int:
        codes, far = self.encode(sample), []
        for i in range(min(TUNE_QUERIES, len(sample))):
            d = ((sample - sample[i]) ** 2).sum(1)
            d[i] = np.inf
            near = np.argsort(d, kind="stable")[:min(k, len(sample) - 1)]
            far.append(np.bitwise_count(codes[:, near] ^ codes[:, i:i + 1]).min(0))
        far = np.sort(np.concatenate(far)) if far else np.zeros(0)
        return int(far[min(len(far) - 1, int(COVER * len(far)))]) if len(far) else 0


def _neighbourhoods(bits: int) -> list[np.ndarray]:
    """By radius: all masks of ``bits`` bits with at most that many set."""
    out, masks = [], [0]
    for r in range(bits + 1):
        if r:
            masks += [sum(1 << i for i in c) for c in combinations(range(bits), r)]
        out.append(np.array(masks, np.int64))
    return out


class MultiIndex:
    """Substring tables over one block of codes."""

    _masks: dict[int, list[np.ndarray]] = {}

    def __init__(self, codes: np.ndarray, tables: int = TABLES, bits: int = 64):
        self.codes, self.tables = codes, tables
        edges = [bits * i // tables for i in range(tables + 1)]
        self.widths = [b - a for a, b in zip(edges, edges[1:])]
        self.shifts = edges[:-1]
        self.rows, self.starts, self.slots = [], [], []
        self.lookups = 0                  # table places looked up so far
        for at, width in zip(self.shifts, self.widths):
            sub = self._part(codes, at, width)
            order = np.argsort(sub, kind="stable")
            keys, first = np.unique(sub[order], return_index=True)
            slot = np.full(1 << width, -1, np.int32)
            slot[keys] = np.arange(len(keys))
            self.rows.append(order)
            self.starts.append(np.append(first, len(sub)))
            self.slots.append(slot)
            if width not in self._masks:
                self._masks[width] = _neighbourhoods(width)

    @staticmethod
    def _part(codes, at: int, width: int):
        return ((codes >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64)

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Rows of every code within ``radius`` of ``code``."""
        mark = np.zeros(len(self.codes), bool)
        a, b = divmod(radius, self.tables)
        for t, (at, width) in enumerate(zip(self.shifts, self.widths)):
            reach = min(width, a if t <= b else a - 1)
            if reach < 0:
                continue
            own = int(self._part(np.array([code], np.uint64), at, width)[0])
            masks = self._masks[width][reach]
            self.lookups += len(masks)
            hit = self.slots[t][masks ^ own]
            hit = hit[hit >= 0]
            starts, ends = self.starts[t][hit], self.starts[t][hit + 1]
            sizes = ends - starts
            if len(sizes):
                offset = np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
                mark[self.rows[t][offset + np.arange(sizes.sum())]] = True
        rows = np.flatnonzero(mark)
        return rows[np.bitwise_count(self.codes[rows] ^ code) <= radius]


def _retrieved(indexes: list[MultiIndex], codes: np.ndarray, radius: int) -> np.ndarray:
    """Rows that one of a query's codes retrieves."""
    mark = np.zeros(len(indexes[0].codes), bool)
    for index, code in zip(indexes, codes):
        mark[index.within(code, radius)] = True
    return np.flatnonzero(mark)


def _search(model: Codes, k: int, ids, vectors, query_ids, queries):
    """(query, id, distance) of the k nearest that each query retrieves."""
    indexes = [MultiIndex(codes, bits=model.bits) for codes in model.encode(vectors)]
    out = ([], [], [])
    for own, query, codes in zip(query_ids, queries, model.encode(queries).T):
        radius = model.radius
        while True:
            rows = _retrieved(indexes, codes, radius)
            rows = rows[ids[rows] != own]
            if len(rows) >= k or radius >= model.bits:
                break
            radius = min(model.bits, radius + 2)
        d = np.sqrt(((vectors[rows] - query) ** 2).sum(1))
        best = np.lexsort((ids[rows], d))[:k]
        out[0].extend([own] * len(best))
        out[1].extend(ids[rows[best]])
        out[2].extend(d[best])
    return out


def _blocks(batches, size: int, rows: int):
    """(ids, vectors) of up to ``rows`` rows at a time."""
    held: list[pa.RecordBatch] = []
    count = 0

    def made():
        table = pa.Table.from_batches(held)
        return _matrix(table, size)
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            some = batch.slice(at, rows - count)
            held.append(some)
            at, count = at + some.num_rows, count + some.num_rows
            if count == rows:
                yield made()
                held, count = [], 0
    if held:
        yield made()


def _matrix(table: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors)."""
    flat = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return table["id"].to_numpy(), flat.astype(np.float64).reshape(-1, size)


def usable(vector: str, size: int | None = None) -> Column:
    """Null, zero and non-finite vectors out."""
    v = F.col(vector)
    fine = (v.isNotNull() & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
            & F.exists(v, lambda x: x != 0))
    fine = F.coalesce(fine, F.lit(False))
    return fine if size is None else fine & (F.size(v) == size)


def nearest(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id",
            vector_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """The ``k`` nearest rows found for every row that ``queries`` selects:
    query_id, rank, vec_id, score (Euclidean distance)."""
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"),
                          F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable("vector"))
    size = (rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "d").first())
    none = (spark.createDataFrame([], schema)
            .select("query_id", F.lit(1).alias("rank"), "vec_id", "score"))
    if size is None:
        return none
    # each id once
    rows = materialize(rows.where(F.size("vector") == size.d).groupBy("id").agg(
        F.min("vector").alias("vector"), F.max("asks").alias("asks")), "vectors")
    total, asked = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    if not asked:
        return none
    learn = (hash_sample(rows, F.xxhash64(F.lit(SEED), "id"), sample, total, "id")
             .select("id", "vector").toArrow())                          # bounded by ``sample``
    model = spark.sparkContext.broadcast(Codes(_matrix(learn, size.d)[1], k))
    block_rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * size.d)))

    query_blocks = -(-asked // QUERY_ROWS)
    block = F.pmod(F.xxhash64(F.lit(SEED + 1), "id"), F.lit(query_blocks))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    path = scratch_path(spark, "nearest")
    for i in range(query_blocks):
        asks = rows.where("asks").where(block == i).select("id", "vector").toArrow()
        if not asks.num_rows:
            continue
        found = rows.select("id", "vector").mapInArrow(
            _searcher(model, spark.sparkContext.broadcast(_matrix(asks, size.d)), k, size.d, block_rows),
            schema)
        (found.withColumn("rank", F.row_number().over(order).cast(T.IntegerType()))
         .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
         .write.mode("append").parquet(path))
    return spark.read.schema("query_id long, rank int, vec_id long, score double").parquet(path)


def _searcher(model, queries, k: int, size: int, block_rows: int):
    def run(batches):
        for ids, vectors in _blocks(batches, size, block_rows):
            found = _search(model.value, k, ids, vectors, *queries.value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()),
                 pa.array(found[2], pa.float64())], ["query_id", "vec_id", "score"])
    return tidy(run)

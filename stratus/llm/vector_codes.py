"""Vector code compression: each vector becomes one codebook index per part.

Vectors are cut into ``PARTS`` equal parts; each part position has a codebook of
``ENTRIES`` entries, which starts as that part of the first vectors and is
improved by rounds of nearest-entry assignment and componentwise means, all in
integers (``floor(SCALE * x)``), so results are the same however the rows are dealt.

**Norm-of-sum bounds.** A part keeps its entry, a lower bound on the distance to
every other entry and the stamp of the round whose codebook the bound was
measured with. The codebooks of all rounds are retained (a few kB each), so the
bound is carried to the present codebook by the true net displacement
``|c_now - c_then|`` of the entries. That is never more than the sum of their drifts round by round,
as entries swing back. While the exact distance to the own entry stays
below the carried bound, no other entry can be nearer or tie, and the other
distances are not computed; otherwise the part is scanned exactly again and the
bound gets a new stamp. Distances are exact integers, bounds are rounded down.

**Spark.** A pass is a map over the vectors with the codebook history in the
task; it writes vectors and state as Parquet for the next pass and, in the same
write, one extra row a task with its sums and counts, from which the next
codebook is added up (ENTRIES · (dimension + PARTS) numbers). No vector is
shuffled. A lost executor costs the tasks of one pass; a pass deletes what the
one before it wrote.

Defined results: rows whose vector is null or holds null or non-finite components
are left out; so are those whose length differs from that of the first kept row (by id,
null ids last, ties by vector). A length that PARTS does not divide is an error, as
is a component of 8,192 or more (integers beyond that could overflow). Rows of
one id are rows of their own; with fewer rows than ENTRIES the codebooks are that
much smaller; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratus.llm.common import tidy
from stratus.session import delete_path, materialize, scratch_path

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integer components stay below this in size.
LARGEST = 1 << 25
#: Labels whose totals are broadcast: the most frequent ones. Each other label
#: has less than a 256th of the rows and is joined by shuffling.
HOT_LABELS = 256

#: A pass's table: vectors with their state, and the extra rows with sums.
STATE = ("id long, label string, v array<int>, code binary, stamp binary, lower binary, "
         "error long, sums array<long>, scanned long")


def to_binary(rows: np.ndarray) -> pa.Array:
    """A row of bytes for each row of a 2-d array."""
    data = np.ascontiguousarray(rows)
    width = data.shape[1] * data.itemsize
    offsets = np.arange(len(data) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(data),
                                 [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def from_binary(column: pa.Array, kind, width: int) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[len(column)]]
    return data.view(kind).reshape(len(column), width)


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows by entries) of int64 arrays."""
    reach = int(np.abs(x).max(initial=0)) + int(np.abs(entries).max(initial=0))
    if reach * reach * max(x.shape[1], 1) < 1 << 52:      # exact in doubles as well
        a, b = x.astype(float), entries.astype(float)
        got = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
        return np.rint(got).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in entries], 1)


@dataclass
class Codebooks:
    """History of codebooks, each (parts, entries, part length) int64."""
    history: list[np.ndarray]

    @property
    def now(self) -> np.ndarray:
        return self.history[-1]

    def moves(self) -> np.ndarray:
        """(stamps, parts, entries): the largest net displacement since a stamp
        among the entries other than the one given."""
        now = self.now.astype(float)
        out = np.zeros((len(self.history), *now.shape[:2]))
        for t, then in enumerate(self.history):
            net = np.sqrt(((now - then) ** 2).sum(2))
            for j in range(net.shape[1]):
                out[t, :, j] = np.delete(net, j, 1).max(1, initial=0.0)
        return out

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.now.ravel().tolist())).encode()).hexdigest()


def assign(x: np.ndarray, books: Codebooks, moves: np.ndarray, state=None):
    """Codes, stamps, bounds, error and number of exact scans of vectors
    ``x`` (rows, parts, part length); ``state``: codes, stamps and bounds so far."""
    n, parts, _ = x.shape
    now = len(books.history) - 1
    if state is None:
        code = np.zeros((n, parts), np.uint8)
        stamp, lower = np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.float32)
    else:
        code, stamp, lower = (s.copy() for s in state)
    error, scanned = np.zeros(n, np.int64), 0
    for p in range(parts):
        own = ((x[:, p] - books.now[p][code[:, p]]) ** 2).sum(1)
        if state is None:
            again = np.arange(n)
        else:
            reach = lower[:, p] - moves[stamp[:, p], p, code[:, p]]
            # a margin far above the rounding of square roots
            again = np.flatnonzero(np.sqrt(own) * (1 + 1e-9) + 1e-6 >= reach)
        scanned += len(again)
        if len(again):
            d = squared(x[again, p], books.now[p])
            best = d.argmin(1)
            at = np.arange(len(again))
            own[again] = d[at, best]
            d[at, best] = np.iinfo(np.int64).max
            second = d.min(1).astype(float)
            code[again, p], stamp[again, p] = best, now
            bound = (np.sqrt(second) * (1 - 1e-9)).astype(np.float32)
            lower[again, p] = np.nextafter(bound, np.float32(-np.inf))
        error += own
    return code, stamp, lower, error, scanned


def add_up(x: np.ndarray, code: np.ndarray, entries: int) -> np.ndarray:
    """Sums (parts, entries, part length + 1) of the parts of each entry; the
    last place counts them."""
    n, parts, width = x.shape
    out = np.zeros((parts, entries, width + 1), np.int64)
    for p in range(parts):
        order = np.argsort(code[:, p], kind="stable")
        used, starts = np.unique(code[order, p], return_index=True)
        if len(used):
            out[p, used, :width] = np.add.reduceat(x[order, p], starts)
        out[p, :, width] = np.bincount(code[:, p], minlength=entries)
    return out


def _pass(books: Codebooks, first: bool):
    """The map of one pass."""
    parts, entries, width = books.now.shape
    moves = books.moves()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, scanned, some = np.zeros((parts, entries, width + 1), np.int64), 0, False
        names = [c.split()[0] for c in STATE.split(", ")]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            some = True
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            x = x.reshape(n, parts, width)
            state = None if first else (
                from_binary(batch.column(3), np.uint8, parts),
                from_binary(batch.column(4), np.uint8, parts),
                from_binary(batch.column(5), np.float32, parts))
            code, stamp, lower, error, scans = assign(x, books, moves, state)
            sums += add_up(x, code, entries)
            scanned += scans
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), to_binary(code), to_binary(stamp),
                 to_binary(lower), pa.array(error), pa.nulls(n, pa.list_(pa.int64())),
                 pa.nulls(n, pa.int64())], names)
        if some:
            extra = [pa.array([sums.ravel().tolist()], pa.list_(pa.int64())),
                     pa.array([scanned], pa.int64())]
            kinds = [pa.int64(), pa.string(), pa.list_(pa.int32()), *[pa.binary()] * 3, pa.int64()]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds), *extra], names)
    return run


def integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str,
             scale: int = SCALE) -> DataFrame:
    """(id, label, v): the rows that take part, components as integers."""
    vector = F.col(f"`{vector_col}`")
    usable = vector.isNotNull() & F.coalesce(F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))

    def whole(x: Column) -> Column:
        y = F.floor(x.cast("double") * F.lit(float(scale)))
        return (F.when(F.abs(y) < LARGEST, y.cast("int")).otherwise(F.raise_error(F.lit(
            f"a component is beyond {LARGEST // scale}: codes are exact below that")).cast("int")))

    return vectors.where(usable).select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{label_col}`").cast("string").alias("label"),
        F.transform(vector, whole).alias("v"))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
             label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks, list[int]]:
    """(id, label, code, error) of each row that takes part (code: a byte per
    part), the codebooks and the exact part scans of each pass."""
    spark = vectors.sparkSession
    kept = integers(vectors, id_col, vector_col, label_col)
    start = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    size = len(start[0].v) if start else 0
    if size % parts:
        raise ValueError(f"vectors of length {size} cannot be cut into {parts} equal parts")
    start = [r.v for r in start if len(r.v) == size]
    if len(start) < entries:       # others of another length stood among the first
        start = [r.v for r in kept.where(F.size("v") == size).orderBy(
            F.col("id").asc_nulls_last(), "v").limit(entries).collect()]
    if not start:
        empty = spark.createDataFrame([], "id long, label string, code binary, error long")
        return empty, Codebooks([np.zeros((parts, 0, 0), np.int64)]), []
    first = np.array(start, np.int64).reshape(len(start), parts, size // parts).transpose(1, 0, 2)
    books, scans = Codebooks([first]), []
    table, path = kept.where(F.size("v") == size), None
    for turn in range(rounds + 1):
        after = scratch_path(spark, "codes")
        table.mapInArrow(tidy(_pass(books, turn == 0)), STATE).write.parquet(after)
        if path:
            delete_path(spark, path)
        path = after
        written = spark.read.schema(STATE).parquet(path)
        table = written.where("sums IS NULL")
        extra = written.where("sums IS NOT NULL")
        scans.append(extra.agg(F.sum("scanned")).first()[0])
        if turn < rounds:
            # as many rows as the codebook has numbers
            rows = (extra.select(F.posexplode("sums").alias("place", "x")).groupBy("place")
                    .agg(F.sum("x").alias("x")).collect())
            sums = np.zeros(first.size + first.shape[0] * first.shape[1], np.int64)
            for r in rows:
                sums[r.place] = r.x
            sums = sums.reshape(parts, len(start), size // parts + 1)
            n = sums[:, :, -1:]
            books.history.append(np.where(n > 0, sums[:, :, :-1] // np.maximum(n, 1), books.now))
    return table.select("id", "label", "code", "error"), books, scans


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``: the error summed over equal labels, nulls
    together. The totals of the most frequent labels are broadcast, so a label with
    a third of all rows is added up map side and never joined by shuffling."""
    totals = materialize(codes.groupBy("label").agg(
        F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "labels")
    totals = totals.withColumnRenamed("label", "of")
    hot = materialize(totals.orderBy(F.desc("n"), "of").limit(HOT_LABELS), "labels")
    joined = codes.join(F.broadcast(hot), F.col("label").eqNullSafe(F.col("of")), "left")
    held = [*codes.columns, "label_error"]
    rest = (joined.where("n IS NULL").select(*codes.columns)
            .join(totals, F.col("label").eqNullSafe(F.col("of"))).select(*held))
    return joined.where("n IS NOT NULL").select(*held).unionByName(rest)


#: DuckDB SQL of the query's rows, round by round.
def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    steps = [f"""
        k AS MATERIALIZED (SELECT vec_id, label, embedding AS v FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        x AS MATERIALIZED (SELECT vec_id, p, i,
                floor({SCALE} * v[p * (len(v) // {parts}) + i + 1]::DOUBLE)::BIGINT AS x
            FROM k, range({parts}) a(p), range((SELECT max(len(v)) FROM k) // {parts}) b(i)),
        c0 AS MATERIALIZED (SELECT p, e, i, x AS c FROM x JOIN (
            SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e
            FROM k ORDER BY vec_id LIMIT {entries}) USING (vec_id))"""]
    for r in range(rounds + 1):
        steps.append(f"""
        d{r} AS (SELECT vec_id, p, e, sum((x - c) * (x - c)) AS d
            FROM x JOIN c{r} USING (p, i) GROUP BY ALL),
        a{r} AS MATERIALIZED (SELECT vec_id, p, arg_min(e, d * {entries} + e) AS e, min(d) AS d
            FROM d{r} GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""
        m{r} AS (SELECT p, e, i, sum(x) AS s, count(*) AS n FROM x JOIN a{r} USING (vec_id, p)
            GROUP BY ALL),
        c{r + 1} AS MATERIALIZED (SELECT p, e, i, coalesce(
                (s - ((s % n) + n) % n) // n, c)::BIGINT AS c
            FROM c{r} LEFT JOIN m{r} USING (p, e, i))""")
    return f"""WITH {','.join(steps)},
        z AS (SELECT vec_id, string_agg(format('{{:02x}}', e::INT), '' ORDER BY p) AS code,
                     sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
        SELECT vec_id, code, error,
               (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
               (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, i)) FROM c{rounds})
                   AS codebooks_sha256
        FROM z JOIN k USING (vec_id)"""

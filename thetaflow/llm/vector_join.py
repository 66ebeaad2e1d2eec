"""Embedding near-dedup: exact metric range join.

Vectors are scaled to length 1; cosine >= c then means a Euclidean distance of
at most r = sqrt(2 - 2c).  Equal directions are one class and joined once.
Pivots are vectors with the smallest hashes, one for each ``CELL`` classes, ``PIVOTS`` at
most, and the nearest pivot says which cell a vector belongs to.  By the triangle inequality a vector x within r of
a member of cell p has d(x, p) <= R_p + r, where R_p is the cell's radius, and
lies within r of the cell's side of the boundary: d(x, p) - d(x, own pivot) <= 2 r.  In
Euclidean space the distance to that boundary is known exactly, (d(x, p)^2 -
d(x, own)^2) / (2 d(p, own)), which must be at most r too.  Only then x is
a guest of cell p.  Cells are cut into blocks of bounded size, and of two
blocks whose cells may have links only one gets the other's vectors as guests,
in turn, so work is spread evenly.

Neighbouring blocks are packed into chunks of at most ``CHUNK`` bytes, one row
each, stored once.  Every two chunks whose cells may have links meet in a task, one as
hosts and one as visitors; it deals the visitors ``BATCH`` at a time to the hosts'
blocks and joins each block with its guests: copies of vectors are neither
shuffled nor held, so disk is in proportion to the vectors and a task's memory
to two chunks, however many blocks there are.  Half of the components, with
the length of the rest as one more, bound a cosine from above in single
precision; pairs within that bound are verified in double precision.
A task returns, for each vector, how many others it links with, and a
spanning forest of the links, never the pairs themselves; a dense group costs
rows in proportion to its vectors, for each two chunks that it fills.  Vectors that lie evenly in many dimensions
let the inequality rule nothing out; each block then meets half of
all vectors, and the result is as exact.

Equal vectors are told by a 128-bit hash of their bytes.

Defined results: vectors that are null, empty, zero or hold null or non-finite components,
and vectors of different dimensions, link with nothing; rows of one id are one node,
counted and linked by any of them; rows without id return their own null id,
no links and ``kept`` false; an empty table gives an empty one; other columns, whatever their
names, are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thetaflow.llm.common import components, partitions, stored

COSINE = 0.9
#: Vectors of a block at most, and bytes of the vectors, as doubles, of a block, of a chunk, and of the chunks on one side of a task.
CELL = 4096
BLOCK = 4 << 20
CHUNK = 8 << 20
SIDE = 64 << 20
PIVOTS = 1024
#: Rows that a task works on at a time.
BATCH = 2048
#: Guests and members that are compared at a time, and links that wait to become a forest.
TILE = 256, 1024
LINKS = 1 << 20
KEY = ["dim", "hi", "lo"]
#: Room for rounding in what the triangle inequality may rule out.
SLACK = 1e-6


def unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Rows of an array column that are proper vectors, their dimensions, and their numbers as bytes."""
    kind = np.float32 if pa.types.is_float32(column.type.value_type) else np.float64
    ends = column.offsets.to_numpy().astype(np.int64)
    values = column.values.slice(ends[0], ends[-1] - ends[0]).cast(pa.from_numpy_dtype(kind))
    flat = pa.compute.fill_null(values, float("nan")).to_numpy(zero_copy_only=False) + kind(0)  # no negative zeros
    ends -= ends[0]
    odd, some = (np.r_[0, np.cumsum(x)][ends] for x in (~np.isfinite(flat), flat != 0))
    dims = np.diff(ends)
    kept = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) & (np.diff(odd) == 0) & (np.diff(some) > 0))
    packed = pa.Array.from_buffers(pa.binary(), len(dims), [
        None, pa.py_buffer((ends * flat.itemsize).astype(np.int32)), pa.py_buffer(flat)])
    return kept, dims[kept].astype(np.int32), packed.take(pa.array(kept))


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vector) -> (id, dim, vector as bytes, its hash in two halves), proper vectors only."""
    for whole in batches:
        for batch in pieces(whole):
            kept, dims, vectors = unit(batch.column(1))
            names = np.frombuffer(b"".join(xxhash.xxh3_128_digest(v.as_buffer()) for v in vectors), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(kept)), pa.array(dims), vectors, pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy())],
                names=["id", "dim", "vector", "hi", "lo"])


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, BATCH):
        yield batch.slice(a, BATCH)


def numbers(column: pa.Array, dim: int) -> np.ndarray:
    """Packed vectors, of singles or doubles, as a matrix; nothing is copied."""
    n, (_, ends, data) = len(column), column.buffers()
    if not n:
        return np.zeros((0, dim))
    ends = np.frombuffer(ends, np.int32)[column.offset:column.offset + n + 1]
    kind = np.float32 if ends[-1] - ends[0] == 4 * n * dim else np.float64
    return np.frombuffer(data, kind, n * dim, ends[0]).reshape(n, dim)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows as doubles, scaled to length 1."""
    x = x.astype(np.float64)
    x /= np.maximum(x.max(1, initial=-np.inf), -x.min(1, initial=np.inf))[:, None]
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Packed vectors as a matrix of unit rows."""
    return scaled(numbers(column, dim))


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    gaps = x @ pivots.T
    gaps *= -2
    gaps += 2
    np.maximum(gaps, 0, out=gaps)
    return np.sqrt(gaps, out=gaps)


def _cells(shared):
    """Adds the nearest pivot and the distance to it to (id, dim, vector, ...)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for whole in batches:
            for batch in pieces(whole):
                dims = batch.column(1).to_numpy()
                cell, far = np.zeros(len(dims), np.int32), np.zeros(len(dims))
                for d in np.unique(dims).tolist():
                    rows = np.flatnonzero(dims == d)
                    gaps = distances(matrix(batch.column(2).take(pa.array(rows)), d), pivots[d])
                    cell[rows] = gaps.argmin(1)
                    far[rows] = gaps.min(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)],
                                                 names=[*batch.schema.names, "cell", "far"])
    return run


def _dealt(shared, reach: float):
    """(id, dim, vector, copies, cell, far, block) -> rows' numbers in the batch, with the blocks they are members or guests of.

    Only blocks of the layout count; a batch gives a row for each vector and block at most, so batches are to be small.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, layout = shared.value  # layout: dim -> (cells of blocks, radius of each cell, blocks' numbers)
        for batch in batches:
            dims, cells, far, own = (batch.column(i).to_numpy() for i in (1, 4, 5, 6))
            rows, to, guest = [], [], []
            for d in np.unique(dims).tolist():
                if d not in layout:
                    continue
                at = np.flatnonzero(dims == d)
                cell_of, radius, number = layout[d]
                asked, place = np.unique(cell_of, return_inverse=True)
                p = pivots[d]
                gaps = distances(matrix(batch.column(2).take(pa.array(at)), d), p[asked])
                near = far[at][:, None]
                between = distances(p, p[asked])[cells[at]]
                # not divided: pivots may coincide but for rounding
                beyond = gaps ** 2 - near ** 2 > 2 * (between + SLACK) * (reach + SLACK) + 1e-9
                visits = (gaps <= radius[asked] + reach + SLACK) & ((gaps - near) <= 2 * reach + SLACK) & ~beyond
                visits |= asked == cells[at][:, None]
                mine = own[at][:, None]
                turn = ((number + mine) % 2 == 0) == (number < mine)  # one of two blocks gets the other's vectors
                j, i = np.nonzero((visits[:, place] & (turn | (number == mine))).T)
                rows.append(at[i])
                to.append(number[j])
                guest.append(number[j] != own[at][i])
            if rows:
                take = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(to).astype(np.int64)), pa.array(np.concatenate(guest)), batch.column(0).take(pa.array(take)),
                     pa.array(take)], names=["block", "guest", "id", "row"])
    return run


def _packed(meets: dict[int, list[int]]):
    """Rows sorted by chunk and block -> one row for each chunk: its number, the chunks it may have links with, its rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(number: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, parts[0].schema) as out:
                out.write_table(pa.Table.from_batches(parts).combine_chunks())
            rows = sink.getvalue()
            rows = pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, rows.size], np.int32)), rows])
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([meets[number]], pa.list_(pa.int32())), rows],
                                              names=["chunk", "meets", "rows"])

        now, held = None, []
        for batch in batches:
            chunk = batch.column(7).to_numpy()
            cuts = np.flatnonzero(chunk[1:] != chunk[:-1]) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(chunk)]):
                if a == b:
                    continue
                if held and chunk[a] != now:
                    yield row(now, held)
                    held = []
                now = int(chunk[a])
                held.append(batch.slice(a, b - a).select(range(7)))
        if held:
            yield row(now, held)
    return run


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest of n numbers that each is connected to by the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label, new)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def short(x: np.ndarray) -> np.ndarray:
    """Unit rows as fewer numbers, whose products are no less than the cosines but for rounding: half of them, and the length of the rest."""
    half = x.shape[1] // 2 - 1
    if half < 15:
        return x.astype(np.float32)
    return np.c_[x[:, :half], np.sqrt(np.einsum("ij,ij->i", x[:, half:], x[:, half:]))].astype(np.float32)


class Links:
    """Links of two chunks' rows, numbered on from the first's to the second's: weights of their ends, and links that connect as all do."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.count = weights, np.zeros(len(weights))
        self.ends, self.waiting = [], 0

    def add(self, a: np.ndarray, b: np.ndarray, both: bool) -> None:
        np.add.at(self.count, a, self.weights[b])
        if both:
            np.add.at(self.count, b, self.weights[a])
        self.connect(a, b)

    def add_block(self, near: np.ndarray, a: np.ndarray, b: np.ndarray, both: bool) -> None:
        """Links of many of the pairs of ``a`` and ``b``."""
        self.count[a] += near @ self.weights[b]
        if both:
            self.count[b] += self.weights[a] @ near
        none = len(b)
        label = np.arange(none, dtype=np.int32)
        while True:
            of_a = np.where(near, label, none).min(1)
            new = np.minimum(label, np.where(near, of_a[:, None], none).min(0))
            if (new == label).all():
                break
            label = new
        some = of_a < none
        self.connect(np.r_[a[some], b], b[np.r_[of_a[some], label]])

    def connect(self, a: np.ndarray, b: np.ndarray) -> None:
        self.ends.append((a, b))
        self.waiting += len(a)
        if self.waiting > LINKS:
            label = self.labels()
            some = np.flatnonzero(label != np.arange(len(label)))
            self.ends, self.waiting = [(some, label[some])], 0

    def labels(self) -> np.ndarray:
        if not self.ends:
            return np.arange(len(self.count))
        return forest(*(np.concatenate(x) for x in zip(*self.ends)), len(self.count))


def _compared(links: Links, y: np.ndarray, ys: np.ndarray, a: np.ndarray, x: np.ndarray, xs: np.ndarray, b: np.ndarray,
              cosine: float, same: bool) -> None:
    """Adds the links of unit vectors ``y``, rows ``a``, with vectors ``x``, rows ``b``; ``same``: these are members of one block, met from both sides."""
    cut = np.float32(cosine - 1e-6 - 1e-7 * x.shape[1])  # room for the rounding of singles
    for i in range(0, len(y), TILE[0]):
        for j in range(0, len(x), TILE[1]):
            at, to = a[i:i + TILE[0]], b[j:j + TILE[1]]
            near = ys[i:i + TILE[0]] @ xs[j:j + TILE[1]].T >= cut
            hit = np.flatnonzero(near)
            if not len(hit):
                continue
            if len(hit) * x.shape[1] > LINKS:
                near = y[i:i + TILE[0]] @ scaled(x[j:j + TILE[1]]).T >= cosine
                if same:
                    near &= at[:, None] != to
                links.add_block(near, at, to, not same)
                continue
            g, h = np.divmod(hit, near.shape[1])
            if same:
                g, h = g[at[g] != to[h]], h[at[g] != to[h]]
            linked = np.einsum("ij,ij->i", y[i + g], scaled(x[j + h])) >= cosine
            links.add(at[g[linked]], to[h[linked]], not same)


def _met(plan, reach: float, cosine: float):
    """(rows of a chunk as hosts, of one as visitors) -> link counts, and links that connect as all do."""
    def opened(rows: pa.Scalar) -> pa.RecordBatch:
        return pa.ipc.open_stream(rows.as_buffer()).read_next_batch()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, radius = plan.value
        for batch in batches:
            for hosts, visitors, same in zip(*batch.columns):
                hosts, visitors, same = opened(hosts), opened(visitors), same.as_py()
                dim = hosts.column(1)[0].as_py()
                x = numbers(hosts.column(2), dim)
                xs = np.concatenate([short(scaled(x[a:a + BATCH])) for a in range(0, len(x), BATCH)])
                number, starts = np.unique(hosts.column(6).to_numpy(), return_index=True)
                stops = np.r_[starts[1:], len(x)]
                deal = _dealt(SimpleNamespace(value=(pivots, {dim: (hosts.column(4).to_numpy()[starts], radius[dim], number)})), reach)
                # a chunk that meets itself: rows are the same on both sides
                ids, weights = (np.concatenate([c.column(k).to_numpy() for c in ([hosts] if same else [hosts, visitors])]) for k in (0, 3))
                links = Links(weights.astype(np.float64))
                for at, piece in zip(range(0 if same else len(x), len(ids), BATCH), pieces(visitors)):
                    y = matrix(piece.column(2), dim)
                    ys = short(y)
                    for out in deal([piece]):
                        block, guest, row = (out.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3))
                        for k, (a, b) in enumerate(zip(np.searchsorted(block, number), np.searchsorted(block, number, "right"))):
                            s = slice(starts[k], stops[k])
                            for members in (False, True):
                                some = row[a:b][guest[a:b] != members]
                                if len(some):
                                    _compared(links, y[some], ys[some], some + at, x[s], xs[s], np.arange(s.start, s.stop), cosine, members)
                some = np.flatnonzero(links.count)
                if len(some):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[some]), pa.array(links.count[some].astype(np.int64)), pa.array(ids[links.labels()[some]])],
                        names=["id", "n", "to"])
    return run


@contextmanager
def _row_by_row(spark: SparkSession):
    """Arrow batches of single rows, each of which is large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, 1)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def chain(gaps: np.ndarray) -> list[int]:
    """Pivots in an order in which each is followed by the nearest one left."""
    order, left = [0], np.ones(len(gaps), bool)
    left[0] = False
    while left.any():
        order.append(int(np.where(left, gaps[order[-1]], np.inf).argmin()))
        left[order[-1]] = False
    return order


def join(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding",
         cell: int = CELL, most_pivots: int = PIVOTS) -> DataFrame:
    """One row for each row of ``vectors``: id, ``n_links``, ``component_id``, ``kept``."""
    spark = vectors.sparkSession
    reach = math.sqrt(2 - 2 * cosine)
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    given, prepared_as = source.where("id IS NOT NULL AND vector IS NOT NULL"), "id long, dim int, vector binary, hi long, lo long"
    prepared = given.mapInArrow(_prepared, prepared_as)
    keys = stored(prepared.select(*KEY).distinct(), "keys")
    totals = {r[0]: r[1] for r in keys.groupBy("dim").count().collect()}  # a row for each dimension
    most = {dim: max(1, min(cell, BLOCK // (8 * dim))) for dim in totals}
    names = []
    for dim, n in totals.items():
        many = min(most_pivots, math.ceil(n / most[dim]))
        names += keys.where(F.col("dim") == dim).orderBy("hi", "lo").limit(many).collect()
    rows = prepared.join(F.broadcast(spark.createDataFrame(names, keys.schema)), KEY).dropDuplicates(KEY).select(*KEY, "vector").collect()
    pivots = {dim: matrix(pa.array([bytes(r["vector"]) for r in sorted(rows) if r["dim"] == dim]), dim) for dim in totals}
    shared = spark.sparkContext.broadcast(pivots)
    proper = stored(given.mapInArrow(lambda batches: _cells(shared)(_prepared(batches)), prepared_as + ", cell int, far double")
                    .drop("vector"), "cells")
    classes = proper.groupBy(*KEY).agg(F.min(F.struct("id", "cell", "far")).alias("first"), F.count_distinct("id").alias("copies"))
    classes = stored(classes.select("first.*", *KEY, "copies"), "classes")
    sizes = {(r["dim"], r["cell"]): (r["n"], r["radius"]) for r in
             classes.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()}  # a row for each pivot
    total, sides = sum(n * 8 * d for (d, _), (n, _) in sizes.items()), math.ceil(math.sqrt(4 * partitions(spark)))
    room = min(CHUNK, total / sides)
    first, radii, meets, number, chunk = [], {}, {}, 0, -1
    for dim in sorted(pivots):
        gaps = distances(pivots[dim], pivots[dim])
        radii[dim] = np.array([sizes.get((dim, c), (0, -np.inf))[1] for c in range(len(gaps))])
        cells, filled = {}, math.inf  # chunk -> its cells
        for c in chain(gaps):
            if (dim, c) not in sizes:
                continue
            n = sizes[dim, c][0]
            blocks = math.ceil(n / most[dim])
            to = []
            for _ in range(blocks):
                if filled + n / blocks * 8 * dim > room:
                    chunk, filled = chunk + 1, 0
                filled += n / blocks * 8 * dim
                cells.setdefault(chunk, []).append(c)
                to.append(chunk)
            first.append((dim, c, number, blocks, to))
            number += blocks
        may = gaps <= radii[dim][:, None] + radii[dim] + reach + SLACK
        for c, own in cells.items():
            reached = may[own].any(0)
            meets[c] = [d for d, theirs in cells.items() if d == c or reached[theirs].any()]
    where = F.broadcast(spark.createDataFrame(first, "dim int, cell int, first int, blocks int, chunks array<int>"))  # a row for each pivot
    hash_of = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    placed = classes.join(where, ["dim", "cell"]).select(
        "id", *KEY, "copies", "cell", "far", (F.col("first") + hash_of).alias("block"), F.get("chunks", hash_of).alias("chunk"))
    chunks = stored(prepared.join(placed, ["id", *KEY]).dropDuplicates(["id", *KEY])
                    .select("id", "dim", "vector", "copies", "cell", "far", "block", "chunk")
                    .repartitionById(max(1, chunk + 1), F.col("chunk")).sortWithinPartitions("chunk", "block", "id")
                    .mapInArrow(_packed(meets), "chunk int, meets array<int>, rows binary"), "chunks")
    plan = spark.sparkContext.broadcast((pivots, radii))
    chunks = chunks.coalesce(max(sides, math.ceil(total / SIDE)))
    pairs = (chunks.select("meets", F.col("chunk").alias("host"), F.col("rows").alias("hosts"))
             .join(chunks.select("chunk", "rows").hint("shuffle_replicate_nl"), F.array_contains("meets", F.col("chunk")))
             .select("hosts", "rows", (F.col("host") == F.col("chunk")).alias("same")))
    with _row_by_row(spark):
        found = stored(pairs.mapInArrow(_met(plan, reach, cosine), "id long, n long, to long"), "links")
    of = (proper.select("id", *KEY).distinct().join(classes.select(F.col("id").alias("rep"), *KEY, "copies"), KEY)
          .select("id", "rep", "copies"))
    twice = of.groupBy("id").agg(F.min("rep").alias("b"), F.collect_set("rep").alias("r")).where(F.size("r") > 1).select(
        F.explode("r").alias("a"), "b")
    nodes = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")).unionAll(twice))
    counts = found.groupBy(F.col("id").alias("rep")).agg(F.sum("n").alias("n"))
    result = (of.join(counts, "rep", "left").join(nodes.withColumnRenamed("node", "rep"), "rep", "left").groupBy("id").agg(
        F.sum(F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.min(F.coalesce("component", "rep")).alias("component_id")))
    return (source.select("id").join(result, "id", "left")
            .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                    F.coalesce("component_id", "id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False))))


def report(vectors: DataFrame) -> DataFrame:
    """The rows of query ``op7_vector_join``."""
    return join(vectors)

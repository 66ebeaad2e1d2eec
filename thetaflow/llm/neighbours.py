"""Approximate nearest neighbours by multi-index hashing.

Binary codes: for each number of dimensions a rotation is learned on at most ``SAMPLE`` vectors
(principal axes, then alternating sign and Procrustes steps that bring the rotated vectors close to
their signs), and a vector's code is the signs of its rotated components, ``BITS``
of them (from several rotations where there are fewer dimensions).  All vectors are indexed: they are dealt to
shards of about ``SHARD`` vectors, and each shard has a table for every 16-bit substring of the codes.

A query retrieves all codes of a shard within a Hamming radius by the
pigeonhole principle: of codes that differ in at most m s + a of m substrings'
bits (0 <= a < m), either one of the first a + 1 substrings differs in at most s bits, or one of the others in at most s - 1.
All values in these balls are probed, and the codes found are kept when their whole distance is
within the radius.  Then the vectors themselves are compared, in double precision.

The radius follows from the data.  In a first round each query widens its radius in each shard until it has ``FIRST``
codes, and the best k + 1 scores of all shards give a bound t that the k-th best score reaches at least.  A vector
with inner product t has an angle of at most arccos(t / |q| |x|), hence an expected share of
angle / pi of differing bits; the second round's radius is that plus ``MARGIN`` standard deviations of the binomial law.  It thus
narrows where vectors lie dense, and no count of candidates is capped.  Shards
hold vectors of one band of norms (a quarter octave), so |x| is known up to a fifth; a band whose largest norm cannot reach
t is skipped, which is exact.  The stated queries meet all shards in blocks: the work is the product of both
where vectors lie evenly in many dimensions, as nothing can be ruled out there.

Equal vectors are one class with the smallest k + 1 of their ids, which is all that a result can hold of it, so a vector that
a third of all rows share is compared once.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows
without id, take no part; rows of one id count once, with the smallest of their vectors; vectors of
different dimensions are not compared; a query with fewer than k candidates gets all; an
empty table gives an empty one; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thetaflow.llm.common import stored

K, EVERY = 20, 20
BITS, SUBSTRING = 128, 16
SAMPLE = 4096
SHARD = 16_384
FIRST = 100
MARGIN = 1.0
#: Bands of norms to an octave.
BANDS = 4
#: Queries, and candidate pairs, that a task handles at a time.
QUERIES, PAIRS = 64, 1 << 20
#: Rows of a shard that say where a query's radius begins to widen.
BEGIN = 512

_VALUES = np.arange(1 << SUBSTRING, dtype=np.uint16)
_WEIGHTS = np.bitwise_count(_VALUES)


def ball(radius: int) -> np.ndarray:
    """All substrings with at most ``radius`` bits set."""
    return _VALUES[_WEIGHTS <= radius]


# ---------------------------------------------------------------- codes

def n_bits(dim: int) -> int:
    return max(BITS, -(-dim // 64) * 64)


def rotation(x: np.ndarray, bits: int, steps: int = 30) -> np.ndarray:
    """A (dim, bits) matrix whose signs of ``x @ matrix`` are the codes, learned on the unit rows ``x``."""
    rng = np.random.default_rng(12)
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    parts, have = [], 0
    while have < bits:
        v = x @ axes[:, :bits - have]
        r = np.linalg.qr(rng.normal(size=(v.shape[1], v.shape[1])))[0]
        for _ in range(steps):
            left, _, right = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
            r = (left @ right).T
        parts.append(axes[:, :bits - have] @ r)
        have += v.shape[1]
    return np.concatenate(parts, 1)


def directions(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one dimension, stored as bytes of doubles."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def _coded(rotations):
    """Adds each vector's code."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, out = batch.column(2).to_numpy(), [None] * batch.num_rows
            for d in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == d)
                x = directions(matrix(batch.column(1).take(pa.array(rows))))
                for row, code in zip(rows.tolist(), np.packbits(x @ rotations.value[d] > 0, axis=1)):
                    out[row] = code.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())],
                                             names=[*batch.schema.names, "code"])
    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ids, vector, asked) -> the same with the vector as bytes of doubles, its dimension and norm."""
    for batch in batches:
        vectors = [np.array(v, np.float64) for v in batch.column(1).to_pylist()]
        tops = [np.abs(v).max() for v in vectors]
        norms = [float(t * np.sqrt(((v / t) ** 2).sum())) for v, t in zip(vectors, tops)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([v.tobytes() for v in vectors], pa.binary()),
             pa.array([len(v) for v in vectors], pa.int32()), pa.array(norms, pa.float64()), batch.column(2)],
            names=["ids", "vector", "dim", "norm", "asked"])


# ---------------------------------------------------------------- the index of a shard

class Shard:
    """Tables of the substrings of a bounded number of codes."""

    def __init__(self, ids: list[list[int]], vectors: np.ndarray, codes: np.ndarray):
        self.vectors, self.codes = vectors, codes
        self.rep = np.array([i[0] for i in ids], np.int64)
        self.ids = np.array([x for i in ids for x in i], np.int64)
        self.size = np.array([len(i) for i in ids])
        self.start = np.r_[0, np.cumsum(self.size)]
        self.m, self.wide = codes.shape[1], codes.view(np.uint64)
        self.tables = []
        for j in range(self.m):
            order = np.argsort(codes[:, j], kind="stable")
            keys, first, many = np.unique(codes[order, j], return_index=True, return_counts=True)
            slot = np.full(1 << SUBSTRING, -1, np.int32)
            slot[keys] = np.arange(len(keys))
            self.tables.append((order, keys, first, many, slot))

    def apart(self, rows: np.ndarray, wide: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Hamming distances of pairs."""
        total = np.zeros(len(rows), np.int64)
        for w in range(self.wide.shape[1]):
            total += np.bitwise_count(self.wide[rows, w] ^ wide[q, w])
        return total

    def within(self, codes: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of all rows within each query's radius, every pair once."""
        s, a = np.divmod(radius, self.m)
        reach = np.where(np.arange(self.m) <= a[:, None], s[:, None], s[:, None] - 1)  # (query, substring)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for j in range(self.m):
            for r in np.unique(reach[:, j]).tolist():
                if r < 0:
                    continue
                masks = ball(r)
                some = np.flatnonzero(reach[:, j] == r)
                step = max(1, PAIRS // max(len(masks), len(self.codes)))
                for i in range(0, len(some), step):
                    found.append(self._probe(j, some[i:i + step], masks, codes, radius, reach))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _probe(self, j, some, masks, codes, radius, reach):
        order, keys, first, many, slot = self.tables[j]
        mine = codes[some, j][:, None]
        if 4 * len(masks) > len(keys):  # fewer keys are there than values to probe
            q, at = np.nonzero(np.bitwise_count(mine ^ keys) <= reach[some[0], j])
        else:
            slots = slot[mine ^ masks]
            q, at = np.nonzero(slots >= 0)
            at = slots[q, at]
        first, many = first[at], many[at]
        q = np.repeat(some[q], many)
        rows = order[np.repeat(first - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(len(q))]
        keep = self.apart(rows, codes.view(np.uint64), q) <= radius[q]
        q, rows = q[keep], rows[keep]
        if j:  # leave out what an earlier substring has found
            new = ~(np.bitwise_count(self.codes[rows, :j] ^ codes[q, :j]) <= reach[q, :j]).any(1)
            q, rows = q[new], rows[new]
        return q, rows

    def widening(self, codes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Like ``within``, for each query with the first of growing radii that has ``least`` rows.

        Some of the rows, evenly spread, say where to begin.
        """
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        n, bits, left = len(self.codes), self.m * SUBSTRING, np.arange(len(codes))
        few = np.arange(0, n, max(1, n // BEGIN))
        pairs = np.tile(few, len(codes)), np.repeat(left, len(few))
        gaps = np.sort(self.apart(pairs[0], codes.view(np.uint64), pairs[1]).reshape(len(codes), -1), 1)
        radius = gaps[:, min(len(few) - 1, least * len(few) // n)]
        while len(left):
            q, rows = self.within(codes[left], radius)
            enough = (np.bincount(q, minlength=len(left)) >= min(least, n)) | (radius >= bits)
            done = enough[q]
            found.append((left[q[done]], rows[done]))
            left, radius = left[~enough], np.minimum(radius[~enough] + self.m // 2, bits)
        return tuple(np.concatenate(x) for x in zip(*found))

    def best(self, q: np.ndarray, rows: np.ndarray, vectors: np.ndarray, k: int):
        """(query, score, id) of each query's ``k`` best ids among the rows found for it."""
        score = np.empty(len(q))
        for i in range(0, len(q), PAIRS // 8):
            part = slice(i, i + PAIRS // 8)
            score[part] = np.einsum("ij,ij->i", self.vectors[rows[part]], vectors[q[part]])
        keep = _leading(q, score, self.rep[rows], k)
        q, rows, score = q[keep], rows[keep], score[keep]
        many = self.size[rows]
        ids = self.ids[np.repeat(self.start[rows] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())]
        q, score = np.repeat(q, many), np.repeat(score, many)
        keep = _leading(q, score, ids, k)
        return q[keep], score[keep], ids[keep]


def _leading(q: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's first ``k`` by score, then by id."""
    if not len(q):
        return np.zeros(0, np.int64)
    order = np.lexsort((ids, -score, q))
    sorted_q = q[order]
    first = np.flatnonzero(np.r_[True, sorted_q[1:] != sorted_q[:-1]])
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return order[rank < k]


def _searched(k: int, least: int | None):
    """Rows sorted by (shard, kind): the shard's classes, then queries -> each query's best ids in the shard.

    With ``least`` the radius widens until so many codes are found, else each query brings its own.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, shard = None, [], None
        for now, query, part in _streaks(batches):
            if now != key:
                key, members, shard = now, [], None
            if not query:
                members.append(part)
                continue
            if shard is None:
                if not members:
                    continue
                shard = Shard([i for m in members for i in m.column(3).to_pylist()],
                              np.concatenate([matrix(m.column(4)) for m in members]),
                              np.concatenate([_substrings(m.column(5)) for m in members]))
                members = []
            codes, vectors = _substrings(part.column(5)), matrix(part.column(4))
            if least is None:
                q, rows = shard.within(codes, part.column(6).to_numpy().astype(np.int64))
            else:
                q, rows = shard.widening(codes, least)
            q, score, ids = shard.best(q, rows, vectors, k)
            yield pa.RecordBatch.from_arrays([part.column(2).take(pa.array(q)), pa.array(score), pa.array(ids)],
                                             names=["query", "score", "id"])
    return run


def _substrings(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint16).reshape(len(rows), -1)


def _streaks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """Pieces of one shard, all classes or ``QUERIES`` queries at most."""
    for batch in batches:
        shard, query = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (query[1:] != query[:-1])) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(shard)]):
            step = QUERIES if query[a] else b - a
            for c in range(a, b, step):
                yield int(shard[c]), bool(query[c]), batch.slice(c, min(step, b - c))


# ---------------------------------------------------------------- the search

def classes_of(vectors: DataFrame, k: int, every: int, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors with their smallest ``k + 1`` ids; and (query id, smallest id of its class) of all queries."""
    good = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    proper = (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
              .where(F.col("id").isNotNull() & F.exists("vector", lambda x: x != 0) & good)
              .groupBy("id").agg(F.min("vector").alias("vector")))
    proper = stored(proper, "vectors")
    # a hot vector's rows are cut to k + 1 for each task before they meet
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    few = stored(proper.withColumn("rank", rank).where(F.col("rank") <= k + 1).groupBy("vector").agg(
        F.array_sort(F.collect_list("id")).alias("ids")), "classes")
    asked = proper.where(F.col("id") % every == 0)
    own = stored(asked.join(few, "vector").select(F.col("id").alias("query_id"), F.element_at("ids", 1).alias("query")), "queries")
    classes = few.join(asked.groupBy("vector").agg(F.lit(True).alias("asked")), "vector", "left").select(
        "ids", "vector", F.coalesce("asked", F.lit(False)).alias("asked"))
    return classes, own


def search(vectors: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding",
           shard: int = SHARD, first: int = FIRST, margin: float = MARGIN) -> DataFrame:
    """``(query_id, rank, id, score)``: the ``k`` largest inner products found for each id divisible by ``every``."""
    spark = vectors.sparkSession
    classes, own = classes_of(vectors, k, every, id_col, vector_col)
    packed = stored(classes.mapInArrow(_packed, "ids array<long>, vector binary, dim int, norm double, asked boolean"), "packed")
    dims = [r[0] for r in packed.select("dim").distinct().collect()]
    rotations = {}
    for d in dims:
        sample = packed.where(F.col("dim") == d).orderBy(F.xxhash64("vector")).limit(SAMPLE).select("vector").collect()
        rotations[d] = rotation(directions(matrix(pa.array([bytes(r[0]) for r in sample], pa.binary()))), n_bits(d))
    band = F.floor(F.log2("norm") * BANDS + 0.5).cast("int")
    coded = packed.mapInArrow(_coded(spark.sparkContext.broadcast(rotations)),
                              "ids array<long>, vector binary, dim int, norm double, asked boolean, code binary")
    coded = stored(coded.withColumn("band", band), "coded")
    # a row for each dimension and quarter octave
    layout = coded.groupBy("dim", "band").agg(F.count("*").alias("n"), F.min("norm").alias("lo"), F.max("norm").alias("hi"))
    rows, number = [], 0
    for r in layout.orderBy("dim", "band").collect():
        parts = -(-r["n"] // shard)
        rows.append((r["dim"], r["band"], r["lo"], r["hi"], number, parts))
        number += parts
    bands = F.broadcast(spark.createDataFrame(rows, "dim int, band int, lo double, hi double, first int, parts int"))
    rep = F.element_at("ids", 1)
    index = coded.join(bands, ["dim", "band"]).select(
        (F.col("first") + F.pmod(F.xxhash64("vector"), F.col("parts"))).cast("int").alias("shard"), F.lit(False).alias("query"),
        rep.alias("id"), "ids", "vector", "code", F.lit(None).cast("int").alias("radius"))
    queries = coded.where("asked").select(rep.alias("id"), "dim", "norm", "vector", "code")

    def scattered(targets: DataFrame, least: int | None) -> DataFrame:
        """The queries' best ids in the shards that they are sent to, then of all shards."""
        sent = targets.select(
            F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("shard"), F.lit(True).alias("query"),
            "id", F.lit(None).cast("array<long>").alias("ids"), "vector", "code", "radius")
        met = index.unionAll(sent).repartition(max(1, number), "shard").sortWithinPartitions("shard", "query")
        found = met.mapInArrow(_searched(k + 1, least), "query long, score double, id long")
        order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        return stored(found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1), "found")

    tried = scattered(queries.join(bands, "dim").withColumn("radius", F.lit(None).cast("int")), first)
    bound = tried.where(F.col("place") == k + 1).select(F.col("query").alias("id"), F.col("score").alias("bound"))
    aimed = queries.join(bound, "id", "left").join(bands, "dim")
    least = F.col("bound") / F.col("norm")  # what a vector's component along the query must reach
    cosine = F.greatest(F.lit(-1.0), F.when(least > 0, least / F.col("hi")).otherwise(least / F.col("lo")))
    share, bits = F.acos(F.least(cosine, F.lit(1.0))) / np.pi, F.length("code") * 8
    radius = F.coalesce(F.ceil(bits * share + margin * F.sqrt(bits * share * (1 - share))), bits)
    near = aimed.where(F.col("bound").isNull() | (cosine <= 1 + 1e-9)).withColumn("radius", F.least(radius, bits).cast("int"))
    best = scattered(near, None)
    # an id may be found in both rounds; its own row is left out before the first k are taken
    both = best.unionAll(tried).groupBy("query", "id").agg(F.max("score").alias("score"))
    listed = both.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("all"))
    mine = own.join(listed, "query").select("query_id", F.slice(F.filter("all", lambda x: x["id"] != F.col("query_id")), 1, k).alias("all"))
    return mine.select("query_id", F.posexplode("all").alias("rank", "x")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias(id_col), (-F.col("x.s")).alias("score"))


def report(vectors: DataFrame) -> DataFrame:
    """The rows of query ``op12_neighbours``."""
    return search(vectors)

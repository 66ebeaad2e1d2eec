"""Centroid clustering on subvector dictionaries.

Components are turned into integers, so every distance and every centroid is
exact.  The vectors are dictionary-encoded once, a chunk of ``CHUNK`` at
most at a time, without loss: the dimensions are cut into blocks, each block
has a dictionary of the distinct subvectors that occur in the chunk, and a vector is one code for
each block.  Neighbouring blocks are merged as long as the dictionary stays
smaller than a share of the chunk, so copies end up in few wide blocks and
scattered vectors in blocks of one dimension.  The encoded chunks are stored in the shared folder.

A round then computes, for each chunk, the distances of the dictionaries'
entries to the centroids, once for each entry, and gets a vector's distance as the sum over
its codes.  Sums for the new centroids come out of the same tables: entries times how
often a cluster has them.  Only (cluster, dimension) sums are shuffled and collected,
``K`` times ``DIM`` rows whatever the data; nothing but the centroids is sent
to the tasks.

Defined results: a vector that is null, has another number of components, or
holds null or non-finite ones is left out; rows are vectors of their own, also when their ids or
components are equal; a row without id is assigned too, but is a seed only after all ids.  Fewer
vectors than ``K`` give as many centroids; an empty table gives an empty one;
other columns, whatever their names, are left alone.  A component beyond +-2**17 raises, since
squared distances need not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thetaflow.llm.common import stored

DIM, K, ROUNDS, SCALE = 64, 8, 10, 1024
#: Vectors with a dictionary of their own.
CHUNK = 8192
#: Two blocks are merged while there are this many times fewer distinct subvectors than vectors.
DENSE = 8
#: Largest integer component; ``DIM`` squares of twice as much fit a long.
LARGEST = 1 << 27

ENCODED = "ids array<long>, blocks array<struct<first:int, width:int, entries:binary, codes:binary>>"


def integers(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of ``dim`` components as the integers floor(1024 x)."""
    x = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1, dim)
    if len(x) and np.abs(x).max() > LARGEST:
        raise ValueError("a component is too large: squared distances would not fit a long")
    return x.astype(np.int64)


def dictionaries(x: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(first dimension, distinct subvectors, codes) of blocks that together hold ``x`` without loss."""
    blocks = []
    for d in range(x.shape[1]):
        entries, codes = np.unique(x[:, d], return_inverse=True)
        blocks.append((d, entries[:, None], codes.ravel()))
    merged = True
    while merged:
        merged, out = False, []
        while blocks:
            block = blocks.pop(0)
            if blocks:
                wider = _merge(block, blocks[0], len(x) // DENSE)
                if wider:
                    blocks.pop(0)
                    block, merged = wider, True
            out.append(block)
        blocks = out
    return blocks


def _merge(a, b, most: int):
    """One block of two neighbours, if it has at most ``most`` distinct subvectors."""
    if max(len(a[1]), len(b[1])) > most:
        return None
    pairs, codes = np.unique(a[2] * len(b[1]) + b[2], return_inverse=True)
    if len(pairs) > most:
        return None
    return a[0], np.concatenate([a[1][pairs // len(b[1])], b[1][pairs % len(b[1])]], 1), codes.ravel()


def _encoded(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                rows = [{"first": first, "width": entries.shape[1], "entries": entries.tobytes(),
                         "codes": codes.astype(np.uint16).tobytes()}
                        for first, entries, codes in dictionaries(integers(part.column(1), dim))]
                yield pa.RecordBatch.from_arrays([
                    pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())),
                    pa.array([rows], pa.list_(pa.struct([("first", pa.int32()), ("width", pa.int32()),
                                                         ("entries", pa.binary()), ("codes", pa.binary())])))],
                    names=["ids", "blocks"])
    return run


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list]]:
    """(ids, [(first, entries, codes)]) of every encoded chunk."""
    for batch in batches:
        for i in range(batch.num_rows):
            blocks = []
            for b in batch.column(1)[i].as_py():
                entries = np.frombuffer(b["entries"], np.int64).reshape(-1, b["width"])
                blocks.append((b["first"], entries, np.frombuffer(b["codes"], np.uint16)))
            yield batch.column(0)[i].values, blocks


def distances(blocks, n: int, centroids: np.ndarray) -> np.ndarray:
    """Squared distances (vectors, centroids): each dictionary entry is compared once, then codes are looked up."""
    total = np.zeros((n, len(centroids)), np.int64)
    for first, entries, codes in blocks:
        gap = entries[:, None, :] - centroids[None, :, first:first + entries.shape[1]]
        total += np.einsum("ukw,ukw->uk", gap, gap)[codes]
    return total


def _sums(centroids: np.ndarray):
    """Counts and component sums of the vectors that are nearest to each centroid."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = centroids.shape
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for ids, blocks in _chunks(batches):
            nearest = distances(blocks, len(ids), centroids).argmin(1)
            count += np.bincount(nearest, minlength=k)
            for first, entries, codes in blocks:
                often = np.bincount(nearest * len(entries) + codes, minlength=k * len(entries)).reshape(k, -1)
                total[:, first:first + entries.shape[1]] += often @ entries
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, dim).astype(np.int32)), pa.array(np.tile(np.arange(dim, dtype=np.int32), len(used))),
             pa.array(np.repeat(count[used], dim)), pa.array(total[used].ravel())], names=["cluster", "at", "n", "total"])
    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, blocks in _chunks(batches):
            gaps = distances(blocks, len(ids), centroids)
            nearest = gaps.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(nearest.astype(np.int32)), pa.array(gaps[np.arange(len(ids)), nearest])],
                names=["id", "cluster", "distance"])
    return run


def proper(vectors: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """(id, vector) of the rows with ``dim`` finite components."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
            .where((F.size("vector") == dim) & ~bad))


def seeds(kept: DataFrame, k: int, dim: int) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest hashes, in that order."""
    first = (kept.orderBy(F.sha2(F.concat(F.lit("3:"), F.col("id").cast("string")), 256).asc_nulls_last(), "vector")
             .select("vector").limit(k).collect())
    return integers(pa.array([r[0] for r in first], pa.list_(pa.float64())), dim)


def fit(kept: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM) -> tuple[DataFrame, np.ndarray]:
    """The stored, encoded vectors of ``kept`` (id, vector), and the centroids after ``rounds`` rounds."""
    centroids = seeds(kept, k, dim)
    encoded = stored(kept.mapInArrow(_encoded(dim), ENCODED), "encoded")
    for _ in range(rounds if len(centroids) else 0):
        sums = (encoded.mapInArrow(_sums(centroids), "cluster int, at int, n long, total long")
                .groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect())
        centroids = centroids.copy()
        for r in sums:  # K x DIM rows at most
            centroids[r["cluster"], r["at"]] = r["total"] // r["n"]
    return encoded, centroids


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS,
            dim: int = DIM) -> DataFrame:
    """A row for each kept vector: its cluster, squared distance, the sums of distances, and the centroid's hash."""
    spark = vectors.sparkSession
    encoded, centroids = fit(proper(vectors, id_col, vector_col, dim), k, rounds, dim)
    found = stored(encoded.mapInArrow(_assigned(centroids), "id long, cluster int, distance long"), "clusters")
    inertia = {r[0]: r[1] for r in found.groupBy("cluster").agg(F.sum("distance")).collect()}  # K rows at most
    about = spark.createDataFrame(
        [(i, inertia[i], sum(inertia.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest())
         for i, c in enumerate(centroids) if i in inertia],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def report(vectors: DataFrame) -> DataFrame:
    """The rows of query ``op13_centroids``."""
    return cluster(vectors)

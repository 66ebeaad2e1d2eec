"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thetaflow.session import checkpoint_dir

#: Work inside a Python task is cut into runs of about this many text bytes,
#: so memory does not follow the Arrow batch size or a table's longest texts.
RUN_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as parquet in the shared checkpoint folder and read it back.

    Cuts the lineage, and a lost executor takes none of it along.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ------------------------------------------------------------ words and hashes

class WordHashes(dict):
    """word bytes -> 64-bit hash, remembered; ``trim()`` bounds the memory."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))

    def trim(self, most: int = 400_000) -> None:
        if len(self) > most:
            self.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit hash for every ``n`` consecutive word hashes."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for i, odd in enumerate(np.random.default_rng(21).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)):
        total += words[i:len(words) - n + 1 + i] * odd
    return mix(total)


_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
#: A random number for each byte at each of the first places of a word.
SHORT = 48
_PLACED = np.random.default_rng(20).integers(0, 1 << 64, SHORT * 256, np.uint64)


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words between ASCII white space, and the number of words of each text.

    A word of up to ``SHORT`` bytes is the sum of random numbers drawn for its bytes and their places,
    taken from running sums, so there is no work for each word in Python; a longer one is hashed by
    xxh3.  Equal words of any text are equal.
    """
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    white = _WHITE[raw]
    starts = np.flatnonzero(~white & np.r_[True, white[:-1]])
    stops = np.flatnonzero(white & np.r_[False, ~white[:-1]])
    first = np.zeros(len(raw), np.int32)
    first[starts] = starts
    place = np.arange(len(raw), dtype=np.int32) - np.maximum.accumulate(first)
    np.minimum(place, SHORT - 1, out=place)
    sums = np.r_[np.uint64(0), np.cumsum(_PLACED[place * 256 + raw])]
    sizes = stops - starts
    names = mix(sums[stops] - sums[starts] + sizes.astype(np.uint64))
    for i in np.flatnonzero(sizes > SHORT).tolist():
        names[i] = xxhash.xxh3_64_intdigest(raw[starts[i]:stops[i]].tobytes())
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.r_[0, np.searchsorted(starts, ends)])
    return names, counts


def runs(sizes: list[int], most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Cut consecutive rows into ranges of about ``most`` bytes, one row at least."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if sizes and start < len(sizes):
        yield start, len(sizes)


def texts_of(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes (null: None)."""
    return column.cast(pa.binary()).to_pylist()


def text_runs(batches: Iterator[pa.RecordBatch], text: int = 1) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches of bounded size, each with its texts (null: empty)."""
    for part in sliced(batches, text):
        yield part, [t or b"" for t in texts_of(part.column(text))]


def sliced(batches: Iterator[pa.RecordBatch], text: int = 1) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of bounded text size; only one is held as Python objects at a time."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy() + 64
        for a, b in runs(sizes.tolist()):
            yield batch.slice(a, b - a)


# -------------------------------------------------------- connected components

def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node id reachable from every node of ``edges`` (a long, b long).

    Alternating large-star and small-star steps: every step replaces each
    node's links by links to the smallest node it knows, which keeps
    components and never adds rows, until only stars around the smallest ids
    are left.  Each step is an aggregation and a join on the node id; its
    result is stored in the shared folder.  Nothing is collected but one
    (count, checksum) pair for each round.  Returns (node, component) for all
    nodes, the smallest of each component included.
    """
    spark = edges.sparkSession
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = stored(edges.distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        # large-star: neighbours above a node move to the smallest in its neighbourhood
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .distinct())
        # small-star: a node and its smaller neighbours move to the smallest of them
        large = large.where("a <> b")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a")
                 .select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        edges = stored(small, "edges")
        state = edges.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("s"),
                          F.max("b").alias("b")).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError("connected components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

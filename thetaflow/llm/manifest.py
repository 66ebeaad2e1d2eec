"""Merkle dataset manifest as a postorder append log.

Each source is a tree whose leaves are the digests of its rows in ascending order of id; every ``ARITY`` consecutive nodes (the
last run: fewer, even one) become their hash until one is left, and the sources' roots are the leaves
of one more such tree.

A tree is written as a log: each node is appended as soon as it is complete, so all nodes of a subtree lie
side by side and end with its root.  Node i of level l is complete after leaf e = min((i + 1) 3**l, n) - 1, and
before leaf e come e leaves and e div 3**j nodes of each level j, so its place is known from sizes
alone: e + sum of e div 3**j + l (``position``).  Nothing is searched for: builders and readers address
nodes, siblings included, by that formula.

The log is cut into segments aligned to ``SPAN`` = 3**HEIGHT leaves.  Builders write segments independently, one row each; the roots
of a tree's segments are the leaves of the next, much smaller, round, which the same builders write.  So a source that holds a
third of all rows is many segments, and no task sees more than ``SPAN`` leaves at once.  Proofs are read the other way: a leaf's
proof is its siblings in its segment, addressed in the segment's log, then the proof of the segment's
root, which is found once for all of the segment's leaves.

Rows' places among their source come from a range partitioning on (source, id, leaf) and sums of counts over
partitions; no task sorts a whole source.

Defined results: a field is ``-`` if null, else its UTF-8 length, ``:`` and the value; rows without id come first in their source and
are not tampered with; rows of one id are ordered by leaf, then by tampered leaf; equal rows are leaves of their own; rows
without source are a source of their own, before all others; an empty table gives an empty one;
other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thetaflow.llm.common import stored

ARITY = 3
HEIGHT = 6
SPAN = ARITY ** HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

SEGMENT = "tree string, segment long, n long, leaves int, log binary, root binary"
PATH = "array<struct<at:int, siblings:array<binary>>>"
PATH_TYPE = pa.list_(pa.struct([("at", pa.int32()), ("siblings", pa.list_(pa.binary()))]))


def node(children: list[str]) -> str:
    """The digest of a run of digests, all as hexadecimal text."""
    return hashlib.sha256("".join(children).encode()).hexdigest()


def levels(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    up = 0
    while n > 1:
        n, up = -(-n // ARITY), up + 1
    return up


def position(level: int, i: int, n: int) -> int:
    """Place of node ``i`` of ``level`` in the log of a tree of ``n`` leaves."""
    e = min((i + 1) * ARITY ** level, n) - 1
    place, size = e + level, e // ARITY
    while size:
        place, size = place + size, size // ARITY
    return place


def built(leaves: list[str], up: int) -> list[str]:
    """The log of ``up`` levels above some leaves, in order of completion; the last node is the root."""
    log: list[str] = []
    open_runs: list[list[str]] = [[] for _ in range(up + 1)]

    def append(digest: str, level: int) -> None:
        log.append(digest)
        if level < up:
            open_runs[level].append(digest)
            if len(open_runs[level]) == ARITY:
                close(level)

    def close(level: int) -> None:
        run, open_runs[level] = open_runs[level], []
        append(node(run), level + 1)

    for leaf in leaves:
        append(leaf, 0)
    for level in range(up):  # what is left is complete, too
        if open_runs[level]:
            close(level)
    return log


class Segment:
    """The nodes of a segment, read from its log by their positions, and the proof of its root."""

    def __init__(self, n: int, leaves: int, log: bytes, above: list[dict]):
        text, many = log.hex(), leaves
        self.above = [(s["at"], [x.hex() for x in s["siblings"]]) for s in above]
        self.nodes: list[list[str]] = []
        for level in range((HEIGHT if n > SPAN else levels(n)) + 1):
            places = [64 * position(level, i, leaves) for i in range(many)]
            self.nodes.append([text[p:p + 64] for p in places])
            many = -(-many // ARITY)
        self.proofs: dict = {}
        self.roots: dict = {}

    def siblings(self, level: int, i: int) -> tuple[int, list[str]]:
        """Place of a node in its run, and the run's other nodes."""
        first = i - i % ARITY
        run = self.nodes[level][first:first + ARITY]
        return i - first, run[:i - first] + run[i - first + 1:]

    def path(self, leaf: int) -> list[tuple[int, list[str]]]:
        """The whole proof of a leaf."""
        out = []
        for level in range(len(self.nodes) - 1):
            out.append(self.siblings(level, leaf))
            leaf //= ARITY
        return out + self.above

    def proof(self, level: int, i: int) -> str:
        """The siblings of a node and of all nodes above it, as text; what leaves share is put together once."""
        if (level, i) not in self.proofs:
            if level == len(self.nodes) - 1:
                text = "".join(x for _, run in self.above for x in run)
            else:
                text = "".join(self.siblings(level, i)[1]) + self.proof(level + 1, i // ARITY)
            if not level:
                return text
            self.proofs[level, i] = text
        return self.proofs[level, i]

    def root(self, level: int, i: int, digest: str) -> str:
        """The root that ``digest`` leads to in the place of a node; the same digest in the same place is folded once."""
        if (level, i, digest) not in self.roots:
            if level == len(self.nodes) - 1:
                root = folded(digest, self.above)
            else:
                at, others = self.siblings(level, i)
                root = self.root(level + 1, i // ARITY, node([*others[:at], digest, *others[at:]]))
            self.roots[level, i, digest] = root
        return self.roots[level, i, digest]


def folded(digest: str, path) -> str:
    """The root that a leaf's digest and its proof lead to."""
    for at, others in path:
        digest = node([*others[:at], digest, *others[at:]])
    return digest


# ---------------------------------------------------------------- leaves and their places

def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves_of(docs: DataFrame) -> DataFrame:
    """(tree, id, leaf, other): both digests of each row, the second of the tampered row."""
    id_, source, lang, n_chars, text = (F.col(c) for c in FIELDS)
    head = F.concat(*[field(c) for c in (id_, source, lang, n_chars)])
    hit = F.crc32(id_.cast("string").cast("binary")) % 2 == 0
    other = F.when(hit, F.translate(text, "\n", "")).otherwise(text)

    def digest(t: Column) -> Column:
        return F.unhex(F.sha2(F.concat(head, field(t)), 256))

    return docs.select(tree_of(source).alias("tree"), id_.cast("long").alias("id"), digest(text).alias("leaf"), digest(other).alias("other"))


def tree_of(source: Column) -> Column:
    """A source as a name that is never null and sorts in the same order."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit(""))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition's number and each row's place among its tree's rows in the partition."""
    part, tree, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        places = np.empty(batch.num_rows, np.int64)
        names = batch.column(0).to_pylist()
        for i, name in enumerate(names):
            if name != tree:
                tree, seen = name, 0
            places[i] = seen
            seen += 1
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(places)],
            names=[*batch.schema.names, "part", "place"])


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (tree, ...) with ``idx``, their place in their tree by ``order``, and ``n``, the tree's size."""
    keys = ["tree", *order]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    numbered = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
                      .mapInArrow(_numbered, f"{schema}, part int, place long"), "placed")
    # a row for each partition, and one for each tree
    sizes = numbered.groupBy("tree", "part").agg(F.count("*").alias("size"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("tree", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"),
                          F.sum("size").over(Window.partitionBy("tree")).alias("n"))
    return numbered.join(starts, ["tree", "part"]).withColumn("idx", F.col("start") + F.col("place")).drop("part", "place", "start")


# ---------------------------------------------------------------- builders

def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that are sorted by their first ``keys`` columns, one group at a time."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield key, rows


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tree, segment, n, idx, digest, ...) sorted by (tree, segment, idx) -> a segment of the log, its root, and the leaves' other columns."""
    for (tree, segment, n), rows in _runs(batches, 3):
        log = built([r[1].hex() for r in rows], HEIGHT if n > SPAN else levels(n))
        yield pa.RecordBatch.from_arrays([
            pa.array([tree]), pa.array([segment]), pa.array([n]), pa.array([len(rows)], pa.int32()),
            pa.array([bytes.fromhex("".join(log))]), pa.array([bytes.fromhex(log[-1])]), 
            pa.array([[r[2] for r in rows]], pa.list_(pa.int64())), pa.array([[r[3] for r in rows]], pa.list_(pa.binary()))],
            names=["tree", "segment", "n", "leaves", "log", "root", "ids", "others"])


def written(nodes: DataFrame) -> list[DataFrame]:
    """The stored segments, round by round, of trees whose leaves are ``nodes`` (tree, idx, n, digest, id, other)."""
    largest = nodes.agg(F.max("n")).first()[0] or 0
    rounds = []
    while True:
        keyed = nodes.select("tree", F.expr(f"idx DIV {SPAN}").alias("segment"), "n", "idx", "digest", "id", "other")
        keyed = keyed.repartition("tree", "segment").sortWithinPartitions("tree", "segment", "n", "idx")
        rounds.append(stored(keyed.mapInArrow(_segments, f"{SEGMENT}, ids array<long>, others array<binary>"), "log"))
        if largest <= SPAN:
            return rounds
        largest = -(-largest // SPAN)
        nodes = rounds[-1].where(F.col("n") > SPAN).select(
            "tree", F.col("segment").alias("idx"), F.ceil(F.col("n") / SPAN).alias("n"), F.col("root").alias("digest"),
            F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("other"))


def roots(rounds: list[DataFrame]) -> DataFrame:
    """(tree, root) of all trees."""
    out = None
    for r in rounds:
        last = r.where(F.col("n") <= SPAN).select("tree", "root")
        out = last if out is None else out.unionAll(last)
    return out


def log_rows(rounds: list[DataFrame]) -> DataFrame:
    """The log as rows (tree, position, level, digest)."""
    def run(height: int):
        def rows(batches):
            for batch in batches:
                for tree, segment, n, total, leaves, log in zip(*(c.to_pylist() for c in batch.columns)):
                    up = HEIGHT if n > SPAN else levels(n)
                    many, out = leaves, []
                    for level in range(up + 1):
                        if level or not height:  # a round's leaves are the last round's roots
                            out += [(tree, position(height + level, segment * ARITY ** (HEIGHT - level) + i, total), height + level,
                                     log[32 * position(level, i, leaves):][:32]) for i in range(many)]
                        many = -(-many // ARITY)
                    if out:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int32(), pa.binary()))],
                            names=["tree", "position", "level", "digest"])
        return rows

    totals = rounds[0].groupBy("tree").agg(F.max("n").alias("total"))
    parts = [r.join(totals, "tree").select("tree", "segment", "n", "total", "leaves", "log").mapInArrow(
        run(HEIGHT * i), "tree string, position long, level int, digest binary") for i, r in enumerate(rounds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


# ---------------------------------------------------------------- proofs

def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tree, segment, n, leaves, log, above) -> (tree, idx, path) of the segment's leaves."""
    for batch in batches:
        for tree, segment, n, leaves, log, above in zip(*(c.to_pylist() for c in batch.columns)):
            s = Segment(n, leaves, log, above)
            paths = [[{"at": at, "siblings": [bytes.fromhex(x) for x in o]} for at, o in s.path(i)] for i in range(leaves)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([tree] * leaves), pa.array([segment * SPAN + i for i in range(leaves)]), pa.array(paths, PATH_TYPE)],
                names=["tree", "idx", "path"])


def above(rounds: list[DataFrame], of_trees: DataFrame) -> DataFrame:
    """The first round's segments with ``above``, the proof of their roots; ``of_trees`` (tree, path) has that of the trees' roots."""
    lower = None
    for r in reversed(rounds):
        ends = r.join(of_trees.withColumnRenamed("path", "above"), "tree").where(F.col("n") <= SPAN)
        if lower is not None:
            ends = ends.unionByName(r.where(F.col("n") > SPAN).join(lower, ["tree", "segment"]))
        if r is rounds[0]:
            return ends
        lower = stored(ends.select("tree", "segment", "n", "leaves", "log", "above").mapInArrow(
            _paths, f"tree string, idx long, path {PATH}"), "paths").select(
            "tree", F.col("idx").alias("segment"), F.col("path").alias("above"))


def _proven(root: str):
    """Segments with their proofs -> a row for each leaf."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, leaves, log, subroot, ids, others, above in zip(*(c.to_pylist() for c in batch.columns)):
                s = Segment(n, leaves, log, above)
                proofs = [hashlib.sha256(s.proof(0, i).encode()).hexdigest() for i in range(leaves)]
                found = [s.root(0, i, other.hex()) for i, other in enumerate(others)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(s.nodes[0]), pa.array([subroot.hex()] * leaves), pa.array([root] * leaves),
                     pa.array(proofs), pa.array(found), pa.array([x == root for x in found])],
                    names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
    return run


def manifest(docs: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """The logs of the sources' trees, and of the tree over their roots, round by round."""
    leaves = placed(leaves_of(docs), ["id", "leaf", "other"]).withColumnRenamed("leaf", "digest")
    sources = written(leaves)
    ends = roots(sources).select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("root").alias("digest"))
    tops = placed(ends, ["source"]).select("tree", "idx", "n", "digest", F.col("idx").alias("id"), F.encode("source", "utf-8").alias("other"))
    return sources, written(tops)


def verified(docs: DataFrame) -> DataFrame:
    """Each row's leaf, roots, proof and the root that its tampered form leads to."""
    spark = docs.sparkSession
    sources, top = manifest(docs)
    last = roots(top).first()
    names = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if last is None:
        return spark.createDataFrame([], names)
    no_path = roots(top).select("tree", F.array().cast(PATH).alias("path"))
    tops = above(top, no_path).select("tree", "segment", "n", "leaves", "log", "above")
    paths = tops.mapInArrow(_paths, f"tree string, idx long, path {PATH}")
    listed = top[0].select(F.explode(F.arrays_zip(F.col("ids").alias("idx"), F.col("others").alias("name"))).alias("x")).select(
        F.col("x.idx").alias("idx"), F.decode("x.name", "utf-8").alias("name"))
    of_trees = stored(paths.join(listed, "idx").select(F.col("name").alias("tree"), "path"), "paths")
    subroots = roots(sources).withColumnRenamed("root", "subroot")
    return (above(sources, of_trees).join(subroots, "tree")
            .select("n", "leaves", "log", "subroot", "ids", "others", "above").mapInArrow(_proven(bytes(last["root"]).hex()), names))


def report(docs: DataFrame) -> DataFrame:
    """The rows of query ``op11_manifest``."""
    return verified(docs)

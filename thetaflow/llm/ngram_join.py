"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds the hashes of its distinct ``n``-word shingles.  All
sets are sorted in one global order: by an estimate of how many documents hold
a shingle, then by hash.  Two sets with Jaccard similarity t share at least l
shingles among the first ``size - ceil(t * size) + l`` of each (the l-prefix).
A document lengthens its prefix, l = 1, 2, ... ``MOST_MATCHES``, as long as
that lowers its estimated cost: postings written, plus the candidates that
share l of them, of which there are at most the sum of the frequencies without
the l - 1 largest.  A pair is verified if it shares the smaller l of the two.

Steps, each a Spark job over all rows:

1. hash the word sequences; equal sequences are one class with the smallest
   id as representative, so exact copies are never paired;
2. estimate frequent shingles (they only order the sets; the ``HOT_SHINGLES``
   most frequent ones are broadcast, any others sort by hash);
3. write prefixes as postings, dealt by shingle; drop those of one document
   only; the centre of a posting list is the document with the fewest shingles that aren't
   frequent, which in a group of near copies is one close to most others;
4. verify each document against one centre, that of most of its lists, and
   take connected components: a large group of near copies becomes one
   component through its centres, in linear work;
5. fold lists of the same documents into one with a weight, and pair
   documents of different components in what is left: every pair that
   shares l prefix shingles, and enough of them for what lies behind the
   prefixes to make up the rest, and that no component links yet, is verified.  No pair is left out, and none inside a component is made.

Verification compares whole sets, in a stream of texts grouped by centre; a centre with many candidates is dealt to several
tasks.  Sets hold 64-bit hashes: two different shingles of one candidate pair
would have to collide to change a similarity.

Defined results: null, empty and word-free texts have an empty set and link
with nothing; a text of fewer than ``n`` words is one shingle; rows of one id
are one node, linked by any of its texts; rows without id get a component only
from equal texts; an empty table gives an empty one; other columns, whatever
their names, are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thetaflow.llm.common import components, hashed_words, stored, text_runs, window_hashes

WORDS = 5
PERCENT = 80
MOST_MATCHES = 4
#: Bounds the broadcast of frequency estimates (16 bytes each); only the order of the sets depends on it.
HOT_SHINGLES = 300_000
HOT_COUNT = 4
#: Candidates of one centre that one task verifies.
CENTRE_ROWS = 20_000
#: Up to so many ids (8 bytes each), a list of ids is broadcast.
BROADCAST_IDS = 100_000


def shingle_sets(texts: list[bytes], n: int, keys: list[int] | None = None) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text, of lower-cased (A-Z) words between ASCII white space.
    ``keys`` gets a 128-bit hash of each word sequence."""
    hashes, counts = hashed_words([t.lower() for t in texts])
    every, start = window_hashes(hashes, n), 0
    for end in np.cumsum(counts).tolist():
        if keys is not None:
            keys.append(xxhash.xxh3_128_intdigest(hashes[start:end].tobytes()))
        if end - start >= n:
            yield np.unique(every[start:end - n + 1])
        else:
            yield window_hashes(hashes[start:end], end - start) if end > start else np.zeros(0, np.uint64)
        start = end


def _longs(x) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def _heads(n: int):
    """Rows (id, key1, key2, n, false): a 128-bit hash of the word sequence, the set's size.  And rows
    (null, shingle, null, n, true): shingles that n documents, several, of one run of rows hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_runs(batches):
            keys: list[int] = []
            sets = list(shingle_sets(texts, n, keys))
            sizes = np.array([len(s) for s in sets], np.int64)
            none = pa.array(sizes == 0)
            null = pa.scalar(None, pa.int64())
            low, high = _longs([k & 0xFFFFFFFFFFFFFFFF for k in keys]), _longs([k >> 64 for k in keys])
            found, counts = np.unique(np.concatenate(sets), return_counts=True)
            several = counts >= 2
            extra = int(several.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([part.column(0), pa.nulls(extra, pa.int64())]),
                 pa.concat_arrays([pa.compute.if_else(none, null, low), _longs(found[several])]),
                 pa.concat_arrays([pa.compute.if_else(none, null, high), pa.nulls(extra, pa.int64())]),
                 pa.array(np.r_[sizes, counts[several]]), pa.array(np.arange(len(sizes) + extra) >= len(sizes))],
                names=["id", "key1", "key2", "n", "frequent"])
    return run


def prefix(shingles: np.ndarray, hot: np.ndarray, counts: np.ndarray, percent: int,
           most: int = MOST_MATCHES) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(prefix, level of each, l, rare): the l-prefix with the least estimated cost, and how many of the set's
    shingles aren't frequent.

    A shingle's level is the smallest l whose l-prefix has it.
    """
    size = len(shingles)
    shared = -(-size * percent // 100)
    base = size - shared
    if len(hot):
        at = np.searchsorted(hot, shingles)
        at[at == len(hot)] = 0
        often = np.where(hot[at] == shingles, counts[at], 1)
    else:
        often = np.ones(size, np.int64)
    if often.max() > 1:
        order = np.argsort(often, kind="stable")
        shingles, often = shingles[order], often[order]
    best, l = None, 1
    for k in range(1, min(most, shared) + 1):
        top = often[:base + k]  # sorted by frequency
        cost = 2 * len(top) + int(top[:len(top) - (k - 1)].sum())
        if best is not None and cost >= best:
            break
        best, l = cost, k
    level = np.ones(base + l, np.int32)
    level[base + 1:] += np.arange(1, l, dtype=np.int32)
    return shingles[:base + l], level, l, int((often == 1).sum())


def _postings(n: int, percent: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, counts = shared.value
        for part, texts in text_runs(batches):
            rows, shingle, level, match, size, few = [], [], [], [], [], []
            for i, s in enumerate(shingle_sets(texts, n)):
                if len(s):
                    p, lv, l, rare = prefix(s, hot, counts, percent)
                    rows.append(np.full(len(p), i))
                    shingle.append(p)
                    level.append(lv)
                    match.append(np.full(len(p), l, np.int32))
                    size.append(np.full(len(p), len(s), np.int32))
                    few.append(np.full(len(p), rare, np.int32))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [_longs(np.concatenate(shingle)), part.column(0).take(pa.array(np.concatenate(rows))),
                     pa.array(np.concatenate(level)), pa.array(np.concatenate(match)), pa.array(np.concatenate(size)),
                     pa.array(np.concatenate(few))],
                    names=["shingle", "id", "level", "l", "size", "rare"])
    return run


def _compare(n: int, percent: int):
    """(centre, salt, role, id, text) sorted by (centre, salt, role): each centre's texts (role 0) before its
    candidates; yields the candidates that are alike."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []
        for part, texts in text_runs(batches, 4):
            a, b = [], []
            fields = [part.column(i).to_pylist() for i in range(4)]
            for centre, salt, role, doc, mine in zip(*fields, shingle_sets(texts, n)):
                if (centre, salt) != key:
                    key, own = (centre, salt), []
                if role == 0:
                    own.append(mine)
                elif any(alike(mine, other, percent) for other in own):
                    a.append(doc)
                    b.append(centre)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return run


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(x), len(y)))
    if not small or 100 * small < percent * large:
        return False
    both = np.sort(np.concatenate([x, y]), kind="stable")
    inter = int((both[1:] == both[:-1]).sum())
    return 100 * inter >= percent * (small + large - inter)


def _near(a: str, b: str, percent: int):
    """Sizes of sets that can be alike."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int, few: bool = False) -> DataFrame:
    """The (a, b) of ``pairs`` (member, centre) whose texts are alike.  ``docs`` is (id, text).

    If the pairs may be ``few``, their ids are counted, and broadcast if they are."""
    degree = pairs.groupBy("centre").agg(F.ceil(F.count("*") / CENTRE_ROWS).cast("int").alias("salts"))
    members = (pairs.join(degree, "centre")
               .select(F.col("id"), "centre", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"),
                       F.lit(1).alias("role")))
    own = degree.select(F.col("centre").alias("id"), "centre",
                        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"))
    wanted = members.unionAll(own)
    ids = wanted.select("id").distinct()
    if few and ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        docs = docs.join(F.broadcast(ids), "id", "left_semi")
    rows = docs.join(wanted, "id").select("centre", "salt", "role", "id", "text")
    return (rows.repartition("centre", "salt").sortWithinPartitions("centre", "salt", "role")
            .mapInArrow(_compare(n, percent), "a long, b long"))


def join(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, ``n_shingles``, ``component_id``."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = stored(docs.mapInArrow(_heads(n), "id long, key1 long, key2 long, n long, frequent boolean"), "heads")
    heads = found.where("NOT frequent").select("id", "key1", "key2", F.col("n").alias("n_shingles"))
    classes = heads.where("key1 IS NOT NULL").groupBy("key1", "key2").agg(F.min("id").alias("rep"))
    heads = stored(heads.join(classes, ["key1", "key2"], "left"), "classes")
    of = heads.where("id IS NOT NULL AND rep IS NOT NULL").select("id", "rep").distinct()
    # texts that share an id are one node
    edges = of.groupBy("id").agg(F.min("rep").alias("b"), F.collect_set("rep").alias("r")).where(F.size("r") > 1).select(
        F.explode("r").alias("a"), "b")

    hot = (found.where("frequent").groupBy(F.col("key1").alias("shingle")).agg(F.sum("n").alias("n"))
           .where(F.col("n") >= HOT_COUNT).orderBy(F.desc("n"), "shingle").limit(HOT_SHINGLES).toPandas())
    shingle = hot["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(shingle)
    shared = spark.sparkContext.broadcast((shingle[order], hot["n"].to_numpy(np.int64)[order]))

    # exact copies are in their class already: they post nothing
    copies = stored(of.groupBy("id").agg(F.max((F.col("rep") == F.col("id")).cast("int")).alias("own"))
                    .where("own = 0").select("id"), "copies")
    few = copies.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    source = docs.where("id IS NOT NULL").join(F.broadcast(copies) if few else copies, "id", "left_anti").select("id", "text")
    # a list's centre, its length, and a hash of the documents on it; lists of one document go
    whole, name = Window.partitionBy("shingle"), F.xxhash64("id")
    lists = (source.mapInArrow(_postings(n, percent, shared), "shingle long, id long, level int, l int, size int, rare int")
             .repartition("shingle")
             .select("shingle", "id", "level", "l", "size", F.count("*").over(whole).alias("n"),
                     F.min(F.struct("rare", "id", "level", "l", "size")).over(whole).alias("c"),
                     F.sum(F.shiftright(name, 32)).over(whole).alias("high"),
                     F.sum(name.bitwiseAND(F.lit(0xFFFFFFFF))).over(whole).alias("low"))
             .where("n > 1"))
    lists = stored(lists.select("id", "level", "l", "size", "n", F.xxhash64("n", "high", "low").alias("set"),
                                F.col("c.id").alias("centre"), F.col("c.level").alias("centre_level"),
                                F.col("c.l").alias("centre_l"), F.col("c.size").alias("centre_size")), "lists")
    # of the centres that a document shares enough with, the one it shares most with
    least = F.least("l", "centre_l")
    starred = (lists.where((F.col("id") != F.col("centre")) & _near("size", "centre_size", percent))
               .groupBy("id", "centre").agg(
                   F.sum(F.when(F.greatest("level", "centre_level") <= least, 1).otherwise(0)).alias("n"),
                   F.first(least).alias("l")).where("n >= l"))
    starred = starred.groupBy("id").agg(F.max_by("centre", F.struct("n", -F.col("centre"))).alias("centre"))
    first = stored(verified(stored(starred, "starred"), docs, n, percent, few=True).unionAll(edges), "links")
    nodes = components(first)

    # Lists with the same documents are one list with a weight, so near copies that share hundreds of shingles meet once.
    # If two sets of documents had one hash, weights would only be too large: more pairs would be verified, none left out.
    # Texts of one id are told apart by their sizes and prefixes.
    rows = (lists.groupBy("set", F.struct("id", "size", "l").alias("d"))
            .agg(F.count("*").alias("w"), F.first("n").alias("n"))
            .withColumn("node", F.col("d.id")).join(nodes, "node", "left")
            .withColumn("component", F.coalesce("component", "node")).drop("node"))
    every, part = Window.partitionBy("set"), Window.partitionBy("set", "component")
    rows = (rows.repartition("set").withColumn("c", F.count("*").over(part))
            .select("set", "d", "w", "n", "component", F.min("component").over(every).alias("low"),
                    F.max("component").over(every).alias("high"),
                    F.max_by("component", F.struct("c", "component")).over(every).alias("main"))  # a list's largest
            .where("low < high").drop("low", "high"))
    rows = stored(rows, "mixed")
    # Of a document's mixed lists, shortest first, what weighs from one on bounds what a pair shares that meets there first.
    own = Window.partitionBy("d")
    so_far = F.sum("w").over(own.orderBy("n", "set").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = stored(rows.select("*", (F.sum("w").over(own) - so_far + F.col("w")).alias("left")), "ranked")
    # all rows but those of a list's largest component meet all others
    x, y = rows.where("component <> main").alias("x"), rows.alias("y")

    def enough(a: str, b: str, shared):
        """The prefix that ends first in the global order is compared in full: of its set at most what lies behind it,
        and the shingles found to be shared, can be common."""
        behind = F.greatest(*[F.ceil(F.col(f"{d}.size") * F.lit(percent) / 100).cast("long") - F.col(f"{d}.l") for d in (a, b)])
        return (shared >= F.least(f"{a}.l", f"{b}.l")) & (
            (shared + behind) * (100 + percent) >= percent * (F.col(f"{a}.size").cast("long") + F.col(f"{b}.size")))

    met = (x.join(y, (F.col("x.set") == F.col("y.set")) & (F.col("x.component") != F.col("y.component"))
                  & ((F.col("y.component") == F.col("y.main")) | (F.col("x.d") < F.col("y.d")))
                  & _near("x.d.size", "y.d.size", percent) & enough("x.d", "y.d", F.least("x.left", "y.left")))
           .select(F.least("x.d", "y.d").alias("a"), F.greatest("x.d", "y.d").alias("b")).distinct())
    met = stored(met, "met")
    meeting = met.select(F.explode(F.array("a", "b")).alias("d")).distinct()
    # a document's prefix bounds its lists here
    posted = rows.join(meeting, "d", "left_semi").groupBy("d").agg(
        F.map_from_entries(F.collect_list(F.struct("set", "w"))).alias("sets"))
    shared = F.aggregate(F.array_intersect(F.map_keys("x.sets"), F.map_keys("y.sets")), F.lit(0).cast("long"),
                         lambda total, k: total + F.element_at(F.col("x.sets"), k))
    rest = (met.join(posted.alias("x"), F.col("a") == F.col("x.d")).join(posted.alias("y"), F.col("b") == F.col("y.d"))
            .where(enough("a", "b", shared)).select(F.col("a.id").alias("id"), F.col("b.id").alias("centre")).distinct())
    rest = stored(rest, "pairs")
    if rest.isEmpty():
        final = nodes
    else:
        second = stored(verified(rest, docs, n, percent, few=True), "more-links")
        final = nodes if second.isEmpty() else components(
            nodes.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(second))
    return (heads.join(final.withColumnRenamed("node", "rep"), "rep", "left")
            .select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "rep", "id").alias("component_id")))


def keep_one(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """The documents, with their columns: of each component the one with the
    smallest id; of equal rows all stay if they are that one."""
    kept = (join(docs, n, percent, id_col, text_col).where(F.col(id_col) == F.col("component_id"))
            .select(F.col(id_col).cast(docs.schema[id_col].dataType).alias("kept_id")).distinct())
    nameless = docs[id_col].isNull()
    return docs.join(kept, docs[id_col] == kept["kept_id"], "left_semi").unionAll(docs.where(nameless))


def report(docs: DataFrame) -> DataFrame:
    """The rows of query ``op8_ngram_join``."""
    return join(docs)

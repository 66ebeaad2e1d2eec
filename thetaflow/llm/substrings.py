"""Substring dedup by recompression: repeated word sequences across documents.

Recompression rounds name runs of equal symbols and then pairs.  A name is a
64-bit hash of what it stands for, so every task gives equal runs and pairs
the same name in the whole corpus without a naming shuffle.  A pair is joined
where a symbol of the left half of the alphabet meets one of the right half; a
bit of the name, drawn anew each round, says which half.  What a symbol is
depends on a few symbols around it only; each carries the range of words that
it depends on.

A window of ``n`` words therefore has the same symbols inside, the consistent
ones, wherever it occurs: those whose range lies within it.  Its key is the
smallest hash of ``TUPLE`` consecutive consistent symbols of the highest level
that has so many (at level 0, the words, every window has).  Neighbouring
windows mostly share a key, so a document gives one row for each stretch of
windows with one key: the key, where the stretch lies against the key's
symbols, and the hashes of its windows.

Repeats within the run of rows that a task has at hand are found there, so a
passage that very many documents share costs a row for each run, not for each
document.  One shuffle brings the other rows of a key together, sorted by document id.  A key
of one document only goes; for others a stream remembers the smallest id of
each (place against the key, window hash) and reports windows seen under a
smaller id.  A key with over ``held`` windows passes what it knows and the rest of its
windows on to an aggregation by window, so no task holds an unbounded
key.  The ranges found are bounded by a document's length and are joined to
the texts by id.

Exact copies of a text with a smaller id need no search; they are told by a
128-bit hash and left out of it (the search gives the same result, so this changes the work only).

Defined results: null, empty and short texts lose nothing; rows without id
neither lose words nor make others lose any; rows of one id are judged one by
one against smaller ids, never against each other; an empty table gives an
empty one; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thetaflow.llm.common import hashed_words, mix, sliced, stored, text_runs, texts_of, window_hashes

WINDOW = 13
#: Rounds of runs and pairs.  More rounds give longer symbols that depend on more words around them; in 13 words
#: there is room for one round's (4.4 windows share a key; with a second round of pairs, 3.7).
ROUNDS = 1
TUPLE = 2
#: Bytes of a window's hash; it is compared under a 64-bit key and a place only.
HASH_BYTES = 5
#: Windows of one key that a task remembers.
HELD = 2_000_000


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, unchanged."""
    return text.split()


# --------------------------------------------------------------- recompression

class Symbols:
    """Names, their words [start, end), and the words [low, high) they depend on."""

    def __init__(self, name, start, end, low, high, first, last):
        self.name, self.start, self.end, self.low, self.high = name, start, end, low, high
        self.first, self.last = first, last  # of their document

    @classmethod
    def of_words(cls, names: np.ndarray, ends: np.ndarray) -> "Symbols":
        at = np.arange(len(names), dtype=np.int64)
        first, last = np.zeros(len(names), bool), np.zeros(len(names), bool)
        sizes = np.diff(np.r_[0, ends])
        ends = ends[sizes > 0]
        last[ends - 1] = True
        first[ends - sizes[sizes > 0]] = True
        return cls(names, at, at + 1, at, at + 1, first, last)

    def before(self) -> np.ndarray:
        """low of the symbol before; outside the document if there is none."""
        return np.where(self.first, self.start - 1, np.r_[0, self.low[:-1]])

    def after(self) -> np.ndarray:
        return np.where(self.last, self.end + 1, np.r_[self.high[1:], 0])

    def runs(self) -> "Symbols":
        """Runs of one symbol become one; each run depends on what ends it."""
        same = (self.name[1:] == self.name[:-1]) & ~self.last[:-1]
        a = np.flatnonzero(np.r_[True, ~same])
        b = np.r_[a[1:], len(self.name)] - 1
        many = (b - a + 1).astype(np.uint64)
        name = np.where(many > 1, mix(self.name[a] + mix(many)), self.name[a])
        return Symbols(name, self.start[a], self.end[b], self.before()[a], self.after()[b], self.first[a], self.last[b])

    def pairs(self, number: int) -> "Symbols":
        """Left symbols join the right symbol that follows."""
        left = (mix(self.name ^ np.uint64(0xA0761D6478BD642F * (number + 1) & (1 << 64) - 1)) & np.uint64(1)) == 1
        joins = np.r_[left[:-1] & ~left[1:] & ~self.last[:-1], False]
        joined = np.r_[False, joins[:-1]]
        low = np.where(~left & ~joined, self.before(), self.low)
        high = np.where(left & ~joins, self.after(), self.high)
        a = np.flatnonzero(~joined)
        b = a + joins[a]
        name = np.where(joins[a], mix(mix(self.name[a]) + (self.name[b] << np.uint64(1) | np.uint64(1))), self.name[a])
        return Symbols(name, self.start[a], self.end[b], low[a], high[b], self.first[a], self.last[b])


def levels(names: np.ndarray, ends: np.ndarray, rounds: int) -> list[Symbols]:
    out = [Symbols.of_words(names, ends)]
    for k in range(rounds):
        out.append(out[-1].runs().pairs(k))
    return out


def window_keys(names: np.ndarray, ends: np.ndarray, n: int, rounds: int = ROUNDS,
                width: int = TUPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of all documents: where they start, their keys, and the word at which the key's symbols start."""
    starts = np.r_[0, ends[:-1]]
    count = np.maximum(ends - starts - n + 1, 0)
    total = int(count.sum())
    if not total:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none
    begin = np.repeat(starts - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(total)
    key, place = np.zeros(total, np.uint64), np.zeros(total, np.int64)
    rest = np.arange(total)  # windows without a key so far
    for level, s in reversed(list(enumerate(levels(names, ends, rounds)))):
        if not len(rest) or len(s.name) < width:
            continue
        tuples = np.zeros(len(s.name) - width + 1, np.uint64)
        for i in range(width):
            tuples = mix(tuples + s.name[i:i + len(tuples)] + np.uint64(level + 1))
        window = begin[rest]
        low = np.searchsorted(s.low, window)
        high = np.searchsorted(s.high[width - 1:], window + n, side="right") - 1
        best = np.full(len(rest), ~np.uint64(0))
        where = np.full(len(rest), -1, np.int64)
        for k in range(int((high - low).max(initial=-1)) + 1):
            at = low + k
            fits = at <= high
            value = tuples[np.where(fits, at, 0)]
            better = fits & ((value < best) | (where < 0))
            best[better], where[better] = value[better], at[better]
        got = where >= 0
        key[rest[got]], place[rest[got]] = best[got], s.start[where[got]]
        rest = rest[~got]
    return begin, key, place


# ------------------------------------------------------------------ Spark steps

def _stretches(n: int):
    """(id, text, tag) -> a row for each stretch of windows with one key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_runs(batches):
            names, counts = hashed_words(texts)
            ends = np.cumsum(counts)
            begin, key, place = window_keys(names, ends, n)
            if not len(begin):
                continue
            doc = np.searchsorted(ends, begin, side="right")
            hashes = window_hashes(names, n)[begin]
            first = np.r_[0, ends[:-1]]
            ids = part.column(0).to_numpy()[doc]
            # repeats within this run of rows are found here and cross no shuffle
            order = np.lexsort((ids, hashes))
            group = np.cumsum(np.r_[0, hashes[order][1:] != hashes[order][:-1]])
            least = ids[order][np.r_[0, np.flatnonzero(np.diff(group)) + 1]]
            late = np.zeros(len(begin), bool)
            late[order] = ids[order] > least[group]
            yield _here(part, begin[late], doc[late], first, n)
            begin, key, place, doc, hashes = (x[~late] for x in (begin, key, place, doc, hashes))
            new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
                                       | (begin[1:] != begin[:-1] + 1)][:len(begin)])
            sizes = np.diff(np.r_[new, len(begin)])
            packed = np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]).tobytes()
            offsets = pa.py_buffer((np.r_[new, len(begin)] * HASH_BYTES).astype(np.int32).tobytes())
            docs = pa.array(doc[new])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[new].view(np.int64)), part.column(0).take(docs), part.column(2).take(docs),
                 pa.array((begin[new] - first[doc[new]]).astype(np.int32)),
                 pa.array((begin[new] - place[new] + n).astype(np.int8)),
                 pa.Array.from_buffers(pa.binary(), len(sizes), [None, offsets, pa.py_buffer(packed)])],
                names=["key", "id", "tag", "at", "place", "hashes"])
    return run


def _here(part: pa.RecordBatch, begin: np.ndarray, doc: np.ndarray, first: np.ndarray, n: int) -> pa.RecordBatch:
    """Word ranges of repeated windows, as rows of place 0 whose bytes are the range's end."""
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (begin[1:] > begin[:-1] + n)][:len(begin)])
    last = np.r_[new[1:], len(begin)][:len(new)] - 1
    start, end = begin[new] - first[doc[new]], begin[last] - first[doc[new]] + n
    docs = pa.array(doc[new])
    ids = part.column(0).take(docs)
    return pa.RecordBatch.from_arrays(
        [pa.array(mix(ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)).view(np.int64)), ids,
         part.column(2).take(docs), pa.array(start.astype(np.int32)), pa.array(np.zeros(len(new), np.int8)),
         pa.array([int(e).to_bytes(4, "little") for e in end], pa.binary())],
        names=["key", "id", "tag", "at", "place", "hashes"])


_ROWS = "key long, id long, tag long, at int, place tinyint, hashes binary"
_FOUND = "id long, tag long, start int, end int, key long, code long"


def _repeated(n: int, held: int):
    """Rows sorted by (key, id) -> word ranges that occur under a smaller id.

    Rows with a code are windows of keys too large to remember: reported with
    the smallest id known (start null) or to be compared (start set).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen, full = None, {}, False
        for batch in batches:
            here = batch.filter(pa.compute.equal(batch.column(4), 0))
            if here.num_rows:
                ends = np.array([int.from_bytes(e, "little") for e in here.column(5).to_pylist()], np.int32)
                none = pa.nulls(here.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([here.column(1), here.column(2), here.column(3), pa.array(ends), none, none],
                                                 names=["id", "tag", "start", "end", "key", "code"])
                batch = batch.filter(pa.compute.not_equal(batch.column(4), 0))
            if not batch.num_rows:
                continue
            key, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            # rows of keys that several ids hold, as far as this batch shows
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            for_each = np.diff(np.r_[starts, len(key)])
            several = np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts)
            several[0] |= key[0] == last
            several[-1] = True  # may go on in the next batch
            shared = np.flatnonzero(np.repeat(several, for_each))
            out: list[tuple] = []
            rows = batch.take(pa.array(shared))
            for k, doc, tag, at, place, packed in zip(*(c.to_pylist() for c in rows.columns)):
                if k != last:
                    last, seen, full = k, {}, False
                covered = None
                for i in range(len(packed) // HASH_BYTES):
                    code = place + i << 8 * HASH_BYTES | int.from_bytes(packed[i * HASH_BYTES:(i + 1) * HASH_BYTES], "little")
                    if full:
                        out.append((doc, tag, at + i, at + i + n, k, code))
                        continue
                    if seen.setdefault(code, doc) < doc:
                        if covered is not None and covered[1] >= at + i:
                            covered[1] = at + i + n
                        else:
                            if covered:
                                out.append((doc, tag, *covered, None, None))
                            covered = [at + i, at + i + n]
                if covered:
                    out.append((doc, tag, *covered, None, None))
                if len(seen) > held:
                    out += [(d, None, None, None, k, c) for c, d in seen.items()]
                    seen, full = {}, True
            last = int(key[-1])
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int32(),
                                                                pa.int64(), pa.int64()))],
                    names=["id", "tag", "start", "end", "key", "code"])
    return run


def repeated_ranges(docs: DataFrame, n: int = WINDOW, held: int = HELD) -> DataFrame:
    """(id, tag, ranges) for documents (id, text, tag) with repeated words; ranges are merged word ranges."""
    rows = (docs.mapInArrow(_stretches(n), _ROWS).repartition("key").sortWithinPartitions("key", "id")
            .mapInArrow(_repeated(n, held), _FOUND))
    rows = stored(rows, "repeats")
    large = rows.where("code IS NOT NULL")
    least = large.groupBy("key", "code").agg(F.min("id").alias("least"))
    late = (large.where("start IS NOT NULL").join(least, ["key", "code"]).where("id > least")
            .select("id", "tag", "start", "end"))
    found = rows.where("code IS NULL").select("id", "tag", "start", "end").unionAll(late)
    return found.groupBy("id", "tag").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"))


def tagged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, tag): the tag tells texts of one id apart; 0 if ids are unique."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    twice = docs.where("id IS NOT NULL").groupBy("id").count().where("count > 1").isEmpty()
    return docs.withColumn("tag", F.lit(0).cast("long") if twice else F.xxhash64("text"))


def removal(docs: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
            held: int = HELD) -> DataFrame:
    """(id, text, tag, ranges): documents with the word ranges to remove (null: none)."""
    docs = tagged(docs, id_col, text_col)
    keyed = docs.where("id IS NOT NULL AND text IS NOT NULL").select("id", "tag", F.md5(F.col("text").cast("binary")).alias("key"))
    least = keyed.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    copies = stored(keyed.join(least, "key").where("id > least").select("id", "tag").distinct(), "copies")
    source = docs.where("id IS NOT NULL").join(copies, ["id", "tag"], "left_anti").select("id", "text", "tag")
    whole = copies.select("id", "tag", F.array(F.struct(F.lit(0).alias("start"), F.lit(-1).alias("end"))).alias("ranges"))
    ranges = repeated_ranges(source, n, held).unionAll(whole)
    ranges = stored(ranges, "ranges")
    return docs.join(ranges, ["id", "tag"], "left").select("id", "text", "tag", "ranges")


def kept_words(text: bytes, ranges: list[dict] | None, n: int) -> tuple[list[bytes], int]:
    """The words that stay, and how many there were.  A range to -1 is a copy of another text."""
    words = words_of(text)
    if not ranges:
        return words, len(words)
    if ranges[0]["end"] < 0:
        return (words if len(words) < n else []), len(words)
    keep, at = [], 0
    for r in ranges:
        if r["start"] > at:
            keep += words[at:r["start"]]
        at = max(at, r["end"])
    return keep + words[at:], len(words)


def _digest(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            count, removed, sha = [], [], []
            for text, ranges in zip(texts_of(batch.column(1)), batch.column(3).to_pylist()):
                kept, total = kept_words(text or b"", ranges, n)
                count.append(total)
                removed.append(total - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())],
                names=["id", "n_words", "n_removed", "kept_sha256"])
    return run


def _texts(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            new = [None if t is None else b" ".join(kept_words(t, r, n)[0]) if r else t
                   for t, r in zip(texts_of(batch.column(1)), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.binary()).cast(pa.string())],
                                             names=["id", "text"])
    return run


def dedup(docs: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): the texts without repeated words; those that lose some are joined by single spaces."""
    return removal(docs, n, id_col, text_col).mapInArrow(_texts(n), "id long, text string").toDF(id_col, text_col)


def report(docs: DataFrame, n: int = WINDOW, held: int = HELD) -> DataFrame:
    """The rows of query ``op10_substrings``."""
    return (removal(docs, n, held=held)
            .mapInArrow(_digest(n), "id long, n_words long, n_removed long, kept_sha256 string")
            .withColumnRenamed("id", "doc_id"))

"""Benchmark decontamination: a broadcast hash set of benchmark n-grams.

Words are lower-cased (A-Z) runs of characters other than ASCII punctuation,
space and control characters.  A window is ``n`` consecutive words of a
benchmark item; an item of fewer words, but not none, is one window.  The
windows are hashed into sorted arrays, one for each window length, that every
task gets; a task slides over a document's words, looks the hashes up, and
compares the words of each hit, so a hash collision never counts.

The benchmark is measured before it is broadcast.  Beyond ``block_chars``
characters it is split into blocks by item, and the scan carries the hits of
one block on to the next: still one pass over the documents without a shuffle,
with one block in a task at a time.

Defined results: a null or word-free text has no hits; null or word-free
items have no windows; items with a null id are ignored; rows are judged one
by one, so repeated ids and rows each give a row; an empty table gives an
empty one; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thetaflow.llm.common import WordHashes, sliced, text_runs, texts_of, window_hashes

WINDOW = 10
BLOCK_CHARS = 16_000_000

#: Bytes that separate words become spaces, A-Z becomes a-z; 0x80 and above stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
              for b in range(256))
#: The same words as positions in the unchanged text.
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Windows:
    """The windows of one block of benchmark items."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        hashes = WordHashes()
        self.by_length: dict[int, np.ndarray] = {}
        self.exact: dict[tuple[int, int], dict[bytes, set[str]]] = {}
        found: dict[int, set[int]] = {}
        for item, text in items:
            words = words_of(text)
            size = min(n, len(words))
            if not size:
                continue
            for i, h in enumerate(window_hashes(hashes.of(words), size).tolist()):
                found.setdefault(size, set()).add(h)
                window = b" ".join(words[i:i + size])
                self.exact.setdefault((size, h), {}).setdefault(window, set()).add(item)
        for size, values in found.items():
            self.by_length[size] = np.sort(np.fromiter(values, np.uint64, len(values)))

    def hits(self, words: list[bytes], hashes: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges covered by windows (merged), and the items they come from."""
        ranges: list[tuple[int, int]] = []
        items: set[str] = set()
        for size, known in self.by_length.items():
            mine = window_hashes(hashes, size)
            if not len(mine):
                continue
            at = np.searchsorted(known, mine)
            at[at == len(known)] = 0
            for i in np.flatnonzero(known[at] == mine).tolist():
                got = self.exact[size, int(mine[i])].get(b" ".join(words[i:i + size]))
                if got:
                    items |= got
                    ranges.append((i, i + size))
        return merged(ranges), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def benchmark_blocks(bench: DataFrame, n: int, item_col: str, text_col: str, block_chars: int) -> list[Windows]:
    """Benchmark items in blocks of about ``block_chars`` characters."""
    items = bench.select(F.col(item_col).cast("string").alias("item"),
                         F.col(text_col).cast("binary").alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_chars))
    if blocks == 1:
        return [Windows([(r[0], bytes(r[1])) for r in items.collect()], n)]
    block = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    return [Windows([(r[0], bytes(r[1])) for r in items.where(block == b).collect()], n) for b in range(blocks)]


def scan(docs: DataFrame, bench: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each document: its id, ``n_words``, ``hits`` (merged word
    ranges, end exclusive) and ``items`` (sorted ids of items with a window in it)."""
    spark = docs.sparkSession
    blocks = benchmark_blocks(bench, n, item_col, item_text_col, block_chars)
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(None).cast("long").alias("n_words"),
                      F.lit(None).cast(_SPANS).alias("hits"), F.lit(None).cast("array<string>").alias("items"))
    for i, block in enumerate(blocks):
        last = i == len(blocks) - 1
        out = out.mapInArrow(_scanner(spark.sparkContext.broadcast(block), last), out.schema if not last else T.StructType(
            [f for f in out.schema if f.name != "text"]))
    return out.withColumnRenamed("id", id_col)


def _scanner(block, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, cache = block.value, WordHashes()
        for part, texts in text_runs(batches):
            n_words, hits, items = [], [], []
            for text, old_hits, old_items in zip(texts, part.column(3).to_pylist(), part.column(4).to_pylist()):
                words = words_of(text)
                got, names = windows.hits(words, cache.of(words))
                if old_hits or old_items:
                    got = merged(got + [(h["start"], h["end"]) for h in old_hits])
                    names |= set(old_items)
                n_words.append(len(words))
                hits.append([{"start": a, "end": b} for a, b in got])
                items.append(sorted(names))
            cache.trim()
            spans = pa.array(hits, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            columns = {"id": part.column(0), "text": part.column(1), "n_words": pa.array(n_words, pa.int64()),
                       "hits": spans, "items": pa.array(items, pa.list_(pa.string()))}
            if last:
                del columns["text"]
            yield pa.RecordBatch.from_pydict(columns)
    return run


def clean(docs: DataFrame, bench: DataFrame, n: int = WINDOW, drop_share: float = 0.5, text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents, with their columns, without benchmark passages.

    Hit word ranges are cut out of the text (from the first word's first to
    the last word's last character).  A document of which ``drop_share`` of
    the words or more are hit goes as a whole; null and word-free texts stay.
    """
    spark, schema, at = docs.sparkSession, docs.schema, docs.columns.index(text_col)
    carried = f"hits_{uuid.uuid4().hex}"
    out = docs.withColumn(carried, F.array().cast(_SPANS))
    blocks = [spark.sparkContext.broadcast(b)
              for b in benchmark_blocks(bench, n, item_col, item_text_col, block_chars)]
    for block in blocks[:-1]:
        out = out.mapInArrow(_marker(block, at), out.schema)
    return out.mapInArrow(_cleaner(blocks[-1], drop_share, at), schema)


def _found(windows: Windows, cache: WordHashes, text: bytes | None, before: list[dict]) -> tuple[list[bytes], list]:
    words = words_of(text or b"")
    got = windows.hits(words, cache.of(words))[0] if words else []
    return words, merged(got + [(h["start"], h["end"]) for h in before]) if before else got


def _marker(block, at: int):
    """Adds one block's hits to the last column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, cache = block.value, WordHashes()
        for batch in sliced(batches, at):
            hits = [[{"start": a, "end": b} for a, b in _found(windows, cache, text, before)[1]]
                    for text, before in zip(texts_of(batch.column(at)), batch.columns[-1].to_pylist())]
            cache.trim()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(hits, batch.columns[-1].type)], schema=batch.schema)
    return run


def _cleaner(block, drop_share: float, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, cache = block.value, WordHashes()
        for batch in sliced(batches, at):
            keep, new = [], []
            for text, before in zip(texts_of(batch.column(at)), batch.columns[-1].to_pylist()):
                words, ranges = _found(windows, cache, text, before)
                hit = sum(b - a for a, b in ranges)
                keep.append(not hit or hit < drop_share * len(words))
                new.append(cut(text.decode("utf-8", "replace"), ranges).encode() if hit else text)
            cache.trim()
            batch = pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1])
            columns = [pa.array(new, pa.binary()).cast(c.type) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array(keep, pa.bool_()))
    return run


def cut(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without the given word ranges; what is left is joined by one space."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in ranges:
        out.append(text[at:places[a][0]].rstrip(" "))
        at = places[b - 1][1]
    out.append(text[at:].lstrip(" "))
    return " ".join(x for x in out if x)


def report(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of query ``op9_decontaminate``."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda t, h: t + h["end"] - h["start"])
    return scan(docs, bench).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))

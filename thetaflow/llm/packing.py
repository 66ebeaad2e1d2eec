"""Best-fit packing of token pieces into sequences: large-item matching.

A document's token ids, and the end id, are cut into pieces of at most
``capacity`` (all but the first piece are full).  Lengths are whole numbers
from 1 to ``capacity``, so which lengths share a sequence is decided on the
table of lengths and their counts, at most ``capacity`` rows at any input
size.  Pieces above a third of the capacity are matched first: at most two fit
in a sequence, so each length takes, greedily from the longest, the longest
partner that still fits.  Smaller pieces, longest first, then go to the
sequences with the least room that still holds them, and open new ones when
none does.  Alike sequences are handled as one pattern with a count, so a
length that holds a third of all pieces is one row.

The plan is a list of (length, from rank, to rank, first sequence, offset).
Each piece finds its place by its rank among pieces of its length.  Ranks come
from counts for each (length, block of ids) and a row number in the block;
blocks are hashes of the document id, as many as the table needs to keep each
under ``block_rows`` rows, so no length meets in one task.

Defined results: a null or empty text is the end id alone, one piece of
length 1; repeated rows give pieces of their own; an empty table packs
into an empty one; other columns, whatever their names, are left alone.
Pieces of equal length, document and number have equal ids or differ in
``ids_crc32``, which breaks the tie.
"""

from __future__ import annotations

import base64
import math
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thetaflow.llm.common import stored, text_runs

CAPACITY = 1024
END_ID = 2
BLOCK_ROWS = 50_000
TOKENIZER = "byte_bpe_50k.json"

_PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


# ---------------------------------------------------------------- tokenization

#: Texts of these characters alone (Latin letters, digits, ASCII) are split alike by both libraries, whatever
#: their Unicode version; all others go the slower way.
_OTHER_LEADS = bytes(range(0xCA))
_CONTROLS = re.compile(b"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|\xc2[\x80-\xa0]")


class Encoder:
    """Token ids by the ``tokenizers`` file; texts in plain Latin letters take
    the ranks file of the same vocabulary, which gives the same ids faster."""

    def __init__(self, name: str = TOKENIZER):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(public_tokenizers.path(name))
        # texts that may hold a token of the file's own, which is found before any splitting, go the file's way
        added = [re.escape(t.content.strip()) for t in self.slow.get_added_tokens_decoder().values()]
        self.own = re.compile("|".join(added).encode()) if added else None
        with open(public_tokenizers.path(name.replace(".json", ".tiktoken")), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                      special_tokens={})

    def ids(self, text: bytes) -> list[int]:
        string = text.decode("utf-8")
        if text.translate(None, _OTHER_LEADS) or _CONTROLS.search(text) or self.own and self.own.search(text):
            return self.slow.encode(string, add_special_tokens=False).ids
        return self.fast.encode_ordinary(string)


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """One encoder for each Python worker."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: full ones, but for the first."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str = TOKENIZER,
           id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece; with ``with_ids`` its token ids too."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for part, texts in text_runs(batches):
            doc, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(texts):
                all_ids = np.array([*encode.ids(text), end_id], "<u4")
                for k, (s, n) in enumerate(cuts(len(all_ids), capacity)):
                    own = all_ids[s:s + n]
                    doc.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(own.tobytes()))
                    if with_ids:
                        ids.append(own)
            columns = [part.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()),
                       pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = _PIECES.format(id=kind) + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


# ------------------------------------------------------------------------ plan

def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, from rank, to rank, first sequence, offset) for the counts of lengths.

    Works on patterns: a pattern is a tuple of lengths and how many sequences
    hold just these.  The table of lengths bounds the work; the counts do not.
    """
    left = {n: c for n, c in counts.items() if c}
    open_by_room: dict[int, dict[tuple[int, ...], int]] = {}

    def add(pattern: tuple[int, ...], count: int) -> None:
        if count:
            held = open_by_room.setdefault(capacity - sum(pattern), {})
            held[pattern] = held.get(pattern, 0) + count

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        count = left[n]
        fit = bisect_left(large, capacity - n + 1) - 1  # the longest partner that fits
        if fit < 0:
            add((n,), count)
            large.pop()
            continue
        m = large[fit]
        if m == n:
            add((n, n), count // 2)
            add((n,), count % 2)
            large.pop()
            continue
        pairs = min(count, left[m])
        add((n, m), pairs)
        left[n] -= pairs
        left[m] -= pairs
        if not left[m]:
            large.remove(m)
        if not left[n]:
            large.remove(n)
    rooms = sorted(open_by_room)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        count = left[n]
        while count:
            at = bisect_left(rooms, n)
            if at == len(rooms):  # none has room: as many new ones as these fill
                each = capacity // n
                pattern, new = ((n,) * each, count // each) if count >= each else ((n,) * count, 1)
                count -= new * len(pattern)
            else:
                room = rooms[at]
                held = open_by_room[room]
                base = next(iter(held))
                each = min(room // n, count)
                new = min(held[base], count // each)
                pattern = base + (n,) * each
                count -= new * each
                held[base] -= new
                if not held[base]:
                    del held[base]
                if not held:
                    del open_by_room[room]
                    rooms.pop(at)
            new_room = capacity - sum(pattern)
            if new_room not in open_by_room:
                insort(rooms, new_room)
            add(pattern, new)
    slots, used, sequence = [], dict.fromkeys(counts, 0), 0
    for held in open_by_room.values():
        for pattern, count in held.items():
            offset = 0
            for n in pattern:
                slots.append((n, used[n], used[n] + count, sequence, offset))
                used[n] += count
                offset += n
            sequence += count
    return slots


def pack(items: DataFrame, capacity: int = CAPACITY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (doc_id, piece, start, length, ids_crc32)."""
    spark = items.sparkSession
    counts = {r[0]: r[1] for r in items.groupBy("length").count().collect()}  # capacity rows at most
    slots = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 5)
    total = sum(counts.values())
    blocks = max(1, math.ceil(total / block_rows) * 2)
    columns = items.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema)
    items = items.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)))
    order = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")
    # ranks before each block of a length: a running sum of counts over the blocks of that length
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = items.groupBy("length", "block").agg(F.count("*").alias("n")).select(
        "length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    ranked = (items.join(offsets, ["length", "block"])
              .withColumn("rank", F.col("ahead") + F.row_number().over(order) - 1)
              .select(*columns, "rank"))
    return ranked.mapInArrow(_placer(spark.sparkContext.broadcast(slots)), schema + ", sequence_id long, offset long")


def _placer(shared):
    """Looks each (length, rank) up in the slots, sorted by length and first rank."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        if not len(slots):
            return
        high = int(slots[:, 2].max()) + 1
        # (length, rank) as one number; Python ints where 64 bits could overflow
        wide = high > (1 << 50)
        starts = [(int(a), int(b)) for a, b in slots[:, :2]] if wide else slots[:, 0] * high + slots[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.names.index(n)).to_numpy() for n in ("length", "rank"))
            if wide:
                at = np.array([bisect_left(starts, (int(a), int(b) + 1)) - 1 for a, b in zip(length, rank)], np.int64)
            else:
                at = np.searchsorted(starts, length * high + rank, side="right") - 1
            row = slots[at]
            kept = [i for i, n in enumerate(batch.schema.names) if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in kept] + [pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])],
                names=[batch.schema.names[i] for i in kept] + ["sequence_id", "offset"])
    return run


def packed(docs: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """Pieces of ``docs`` with their places.  The pieces are stored once, so
    no text is tokenized twice."""
    return pack(stored(pieces(docs, capacity, **options), "pieces"), capacity)


def sequences(docs: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids, doc_ids, lengths); ``ids`` has at most ``capacity`` ids."""
    rows = pack(stored(pieces(docs, capacity, with_ids=True, **options), "pieces"), capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))  # capacity pieces at most
    return rows.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"),
        F.col("p.length").alias("lengths"))


def report(docs: DataFrame) -> DataFrame:
    """The rows of query ``op6_pack``."""
    return packed(docs)

"""Line dedup: segment-partition edit join.

Lines are trimmed of white space at both ends; lines of fewer than ``least``
characters, too short to tell a copy from common language, are left alone.
Lines are alike if their edit distance is at most ``edits``; alike lines, and
lines linked by others, are one class.  The first line of each class, by
document id, then place, stays; all others are removed.
A document that loses all of them is a copy if its short lines, too, stand after
lines of the same class in earlier documents; ``drop_emptied`` drops it whole.

A line of length l is cut into ``edits + 1`` segments.  Of two alike lines
the longer one, or either of equal ones, has at least one segment of the other unchanged, near its
place; which substrings can be it follows from the lengths and the errors that fit
to the left and right of it.  Each line posts its segments, and the
substrings that could be another line's segments, under a hash of (length,
number, characters).  A window over each list keeps lists of different lines,
few of all.  Then, natively:

1. each line is compared with one line, the smallest of most of its lists, and links are
   gathered into components (so a large group of near copies needs linear work);
2. lines of different components in one list are compared: all but those of the
   list's largest component with all others.

Pairs whose characters' counts already differ by more than the edits allow (64
bits of parity for each line tell) are not compared.

A comparison runs a banded bit-parallel automaton: bit d of the word for e
errors says whether the two beginnings, of lengths j + d - edits and j,
are within e edits; only the 2 * edits + 1 diagonals that matter have bits, whatever
the lines' lengths.  What lines have in common at their beginning is skipped,
and pairs that no state survives for ``PROBE`` characters are dropped
before the rest is read.

Equality of lines is by 128-bit hashes.  Lines so frequent that their postings would
flood a list post once; their number is bounded, so they are broadcast.  Texts
are sent by document once, to cut them; other shuffles hold hashes only, and
the texts of the few lines that are compared.

Only DataFrame functions are used.  Defined results: null texts stay null;
empty texts have one empty line; rows of equal id and text lose the same lines,
and of rows of one id each is judged by its own text; rows without id come after
all others; an empty table gives an empty one; other columns, whatever their
names, are carried along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thetaflow.llm.common import components, stored

EDITS = 2
LEAST = 20
#: Characters after which a pair without a surviving state is dropped.
PROBE = 24
#: Lines that occur in over one of so many of all lines post their segments once; at most so many are broadcast.
HOT_LINES = 50_000
HOT_LEAST = 64
#: Up to so many line hashes (8 bytes each) are broadcast.
BROADCAST_IDS = 200_000


def occurrences(docs: DataFrame, least: int) -> DataFrame:
    """(id, tag, at, line, h1, h2) of the lines of documents (id, tag, text) that are long enough."""
    return (docs.select("id", "tag", F.posexplode(F.split("text", "\n")).alias("at", "raw"))
            .select("id", "tag", "at", F.btrim("raw", F.lit(" \t\r\x0b\x0c")).alias("line"))
            .where(F.length("line") >= least)
            .select("id", "tag", "at", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")))


def _place() -> Column:
    """What lines are ordered by; rows without id come last."""
    return F.struct(F.col("id").isNull().alias("none"), "id", "tag", "at")


def posted(lines: DataFrame, edits: int, least: int) -> DataFrame:
    """(key, line, side) of lines (h1, line): side 1 for segments, 2 for substrings that may be segments, 3 for both."""
    n = edits + 1
    size = F.col("size")
    rows = []
    for i in range(n):
        for shorter in range(edits + 1):
            other = size - shorter
            start = F.expr(f"int({i} * (size - {shorter}) div {n})")
            length = F.expr(f"int({i + 1} * (size - {shorter}) div {n}) - int({i} * (size - {shorter}) div {n})")
            for shift in range(max(-i, shorter - (edits - i)), min(i, shorter + edits - i) + 1):
                piece = F.substring(F.col("wide"), 4 * (start + shift) + 1, 4 * length)
                side = 3 if not shorter and not shift else 2
                rows.append(F.struct(F.when(other >= least, F.xxhash64(other, F.lit(i), piece)).alias("key"),
                                     F.lit(side).cast("tinyint").alias("side")))
    # four bytes for each character: pieces are cut without reading what stands before them
    wide = lines.select("h1", F.encode("line", "UTF-32").alias("wide")).select(
        "h1", "wide", (F.octet_length("wide") / 4).cast("int").alias("size"))
    return wide.select(F.col("h1").alias("line"), F.inline(F.array(*rows))).where("key IS NOT NULL")


def shared_lists(rows: DataFrame) -> DataFrame:
    """Postings of lists that hold different lines."""
    every = Window.partitionBy("key")
    return (rows.select("*", F.min("line").over(every).alias("low"), F.max("line").over(every).alias("high"))
            .where("low < high").groupBy("key", "line").agg(F.bit_or("side").alias("side")))


# ----------------------------------------------------------------- verification

def odd(line: Column) -> Column:
    """64 bits: which classes of characters occur an odd number of times.  An edit changes two bits at most."""
    one = F.lit(1).cast("long")
    return F.aggregate(F.split(line, ""), F.lit(0).cast("long"), lambda bits, c: bits.bitwiseXOR(
        F.call_function("shiftleft", one, F.pmod(F.ascii(c), F.lit(64)))))


def _step(state: Column, j: Column, a: Column, b: Column, edits: int) -> Column:
    """The automaton's words after character j (from 1) of b; word e has the diagonals within e errors."""
    width = 2 * edits + 1
    mask = (1 << width) - 1
    char = F.get(b, j - 1)
    match = None
    for d in range(width):
        bit = F.when(F.get(a, j - 1 + (d - edits)) == char, 1 << d).otherwise(0)
        match = bit if match is None else match + bit
    words, before = [], None
    for e in range(edits + 1):
        old = state[f"r{e}"]
        word = old.bitwiseAND(match)
        if before is not None:
            below = state[f"r{e - 1}"]
            word = (word.bitwiseOR(below).bitwiseOR(F.shiftright(below, 1))
                    .bitwiseOR(F.shiftleft(before, 1).bitwiseAND(F.lit(mask))))
        before = word
        words.append(word.cast("int").alias(f"r{e}"))
    return F.struct(*words)


def _start(edits: int) -> Column:
    return F.struct(*[F.lit(sum(1 << edits + i for i in range(e + 1))).cast("int").alias(f"r{e}") for e in range(edits + 1)])


def common_start(a: Column, b: Column) -> Column:
    """How many characters two strings have in common at the beginning, found by halving."""
    short = F.least(F.length(a), F.length(b))
    steps = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(short + 1)).cast("int")), lambda k: k)
    return F.aggregate(
        steps, F.struct(F.lit(0).alias("low"), short.alias("high")),
        lambda s, _: F.when(
            F.substring(a, F.lit(1), F.floor((s["low"] + s["high"] + 1) / 2).cast("int"))
            == F.substring(b, F.lit(1), F.floor((s["low"] + s["high"] + 1) / 2).cast("int")),
            F.struct(F.floor((s["low"] + s["high"] + 1) / 2).cast("int").alias("low"), s["high"].alias("high")))
        .otherwise(F.struct(s["low"].alias("low"),
                            F.greatest(s["low"], F.floor((s["low"] + s["high"] + 1) / 2).cast("int") - 1).alias("high"))),
        lambda s: s["low"])


def alike(pairs: DataFrame, edits: int) -> DataFrame:
    """The pairs (a, b, text_a, text_b) whose texts are within ``edits`` edits."""
    # Each step's columns come out of a generator: the optimizer would else repeat their expressions in every later one.
    def step(df: DataFrame, *columns: Column) -> DataFrame:
        return df.select("a", "b", F.explode(F.array(F.struct(*columns))).alias("s")).select("a", "b", "s.*")

    def characters(c: str) -> Column:
        rest = F.split(F.substring(c, F.col("skip") + 1, F.length(c)), "")
        return F.when(F.col("skip") < F.length(c), rest).otherwise(F.array().cast("array<string>"))

    def run(state: Column, first: Column, last: Column) -> Column:
        return F.when(last < first, state).otherwise(F.aggregate(
            F.sequence(first, F.greatest(first, last)), state, lambda s, j: _step(s, j, F.col("x"), F.col("y"), edits)))

    near = pairs.where(F.abs(F.length("text_a") - F.length("text_b")) <= edits)
    same = step(near, common_start(F.col("text_a"), F.col("text_b")).alias("skip"), F.col("text_a"), F.col("text_b"))
    chars = step(same, characters("text_a").alias("x"), characters("text_b").alias("y"))
    probed = run(_start(edits), F.lit(1), F.least(F.size("y"), F.lit(PROBE)))
    alive = step(chars, F.col("x"), F.col("y"), probed.alias("state")).where(F.col(f"state.r{edits}") != 0)
    done = step(alive, run(F.col("state"), F.lit(PROBE + 1), F.size("y")).alias("state"),
                (F.size("x") - F.size("y") + edits).alias("end"))
    return done.where(F.expr(f"shiftright(state.r{edits}, end) & 1") == 1).select("a", "b")


def linked(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """Pairs (a, b) of line hashes whose lines (h1, line) are alike."""
    x = texts.select(F.col("h1").alias("a"), F.col("line").alias("text_a"))
    y = texts.select(F.col("h1").alias("b"), F.col("line").alias("text_b"))
    return alike(pairs.join(x, "a").join(y, "b"), edits)


def line_classes(lines: DataFrame, hot: DataFrame, edits: int, least: int) -> DataFrame:
    """(node, component): line hashes that are alike to others, with the smallest hash of their class.

    ``hot`` has the frequent lines (h1, h2, first place), which post once.
    """
    first = F.col("first").isNull() | (F.col("first") == _place())
    posting = lines.join(F.broadcast(hot), ["h1", "h2"], "left").where(first)
    lists = stored(shared_lists(posted(posting, edits, least)), "lists")
    ids = lists.select(F.col("line").alias("h1")).distinct()
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = stored(lines.select("h1", "line").join(ids, "h1", "left_semi").distinct().withColumn("odd", odd(F.col("line"))),
                   "texts")
    rows = stored(lists.join(texts.select(F.col("h1").alias("line"), "odd"), "line"), "signed-lists")
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= 2 * edits
    centres = (rows.groupBy("key").agg(F.min(F.struct("line", "odd")).alias("c"))
               .select("key", F.col("c.line").alias("centre"), F.col("c.odd").alias("centre_odd")))
    pairs = (rows.join(centres, "key").where((F.col("line") != F.col("centre")) & near("odd", "centre_odd"))
             .groupBy("line", "centre").agg(F.count("*").alias("n"))
             .groupBy("line").agg(F.max_by("centre", F.struct("n", "centre")).alias("b")).select(F.col("line").alias("a"), "b"))
    found = stored(linked(pairs, texts, edits), "links")
    nodes = components(found)
    rows = rows.join(nodes.withColumnRenamed("node", "line"), "line", "left").withColumn(
        "component", F.coalesce("component", "line"))
    main = (rows.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key")
            .agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("k"))
            .where("k > 1").select("key", "main"))
    rows = stored(rows.join(main, "key"), "rest")
    x, y = rows.where("component <> main").alias("x"), rows.alias("y")
    # one of the two posts the key as a segment, the other as a substring
    sides = (F.col("x.side").bitwiseOR(F.col("y.side")) == 3)
    rest = (x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & sides
                   & near("x.odd", "y.odd") & ((F.col("y.component") == F.col("y.main")) | (F.col("x.line") < F.col("y.line"))))
            .select(F.least("x.line", "y.line").alias("a"), F.greatest("x.line", "y.line").alias("b")).distinct())
    more = stored(linked(rest, texts, edits), "more-links")
    if more.isEmpty():
        return nodes
    return components(nodes.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more))


def _copied(docs: DataFrame, named: DataFrame, least: int) -> DataFrame:
    """(id, tag, copied): whether earlier documents have each short line that holds a word, after a line of the same class.

    Lines that no long line stands before count as after the document's first one.
    """
    short = (docs.select("id", "tag", F.posexplode(F.split("text", "\n")).alias("at", "raw"))
             .select("id", "tag", "at", F.btrim("raw", F.lit(" \t\r\x0b\x0c")).alias("line"))
             .where(F.length("line").between(1, least - 1))
             .select("id", "tag", "at", F.xxhash64("line").alias("x1"), F.xxhash64(F.lit(1), "line").alias("x2"),
                     F.lit(True).alias("short")))
    both = named.select("id", "tag", "at", F.col("c1").alias("x1"), F.col("c2").alias("x2"), F.lit(False).alias("short"))
    document = Window.partitionBy("id", "tag")
    line = F.when(~F.col("short"), F.struct("x1", "x2"))
    before = F.last(line, True).over(document.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    top = F.first(line, True).over(document.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    keys = ["c1", "c2", "x1", "x2"]
    rows = (both.unionAll(short).withColumn("after", F.coalesce(before, top)).where("short AND after IS NOT NULL")
            .select("id", "tag", F.col("after.x1").alias("c1"), F.col("after.x2").alias("c2"), "x1", "x2",
                    F.struct(F.col("id").isNull().alias("none"), "id", "tag").alias("place")))
    rows = stored(rows, "short-lines")
    first = rows.groupBy(*keys).agg(F.min("place").alias("first"), F.max("place").alias("last"))
    first = first.where(F.col("first") < F.col("last")).drop("last")
    return (rows.join(first, keys, "left").groupBy("id", "tag")
            .agg(F.min(F.coalesce(F.col("first") < F.col("place"), F.lit(False))).alias("copied")))


def removals(docs: DataFrame, edits: int = EDITS, least: int = LEAST, short: bool = False) -> DataFrame:
    """(id, tag, gone): for documents (id, tag, text), the numbers of the lines to remove.

    With ``short``, also ``copied``: whether earlier documents have all their short lines too (null: there are none).
    """
    lines = occurrences(docs, least)
    slim = stored(lines.select("id", "tag", "at", "h1", "h2"), "lines")
    total = slim.count()
    hot = (slim.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(_place()).alias("first"))
           .where(F.col("n") > max(HOT_LEAST, total // HOT_LINES)).select("h1", "h2", "first"))
    classes = line_classes(lines, hot, edits, least)
    named = (slim.join(classes.withColumnRenamed("node", "h1"), "h1", "left")
             .select("id", "tag", "at", F.coalesce("component", "h1").alias("c1"),
                     F.when(F.col("component").isNull(), F.col("h2")).otherwise(0).alias("c2")))
    first = (named.groupBy("c1", "c2").agg(F.min(_place()).alias("first"), F.count("*").alias("n"))
             .where("n > 1").select("c1", "c2", "first"))
    gone = (named.join(first, ["c1", "c2"]).where(F.col("first") != _place())
            .groupBy("id", "tag").agg(F.collect_set("at").alias("gone")))  # a document's lines at most
    if not short:
        return gone
    copied = _copied(docs, named, least)
    return (gone.alias("g").join(copied.alias("c"), (F.col("g.tag") == F.col("c.tag"))
                                 & F.col("g.id").eqNullSafe(F.col("c.id")), "left")
            .select("g.id", "g.tag", "g.gone", "c.copied"))


def dedup(docs: DataFrame, edits: int = EDITS, least: int = LEAST, id_col: str = "doc_id",
          text_col: str = "text", drop_emptied: bool = False) -> DataFrame:
    """The documents, with their columns, without removed lines.

    With ``drop_emptied``, documents that had words and are left without any go, and
    so do those that lose all lines of ``least`` characters or more and whose shorter
    lines all stand after the same lines in earlier documents.
    """
    return _applied(docs, edits, least, id_col, text_col, drop_emptied).select(*[F.col(f"`{c}`") for c in docs.columns])


def _applied(docs: DataFrame, edits: int, least: int, id_col: str, text_col: str, drop_emptied: bool,
             report: bool = False) -> DataFrame:
    own = {c: f"{c}_{uuid.uuid4().hex}" for c in ("id", "tag", "gone", "copied")}
    text = F.col(f"`{text_col}`")
    keyed = docs.withColumns({own["id"]: F.col(f"`{id_col}`"), own["tag"]: F.xxhash64(text)})
    gone = removals(keyed.select(F.col(own["id"]).alias("id"), F.col(own["tag"]).alias("tag"), text.alias("text")),
                    edits, least, drop_emptied)
    gone = gone.select(*[F.col(c).alias(own[c]) for c in gone.columns])
    joined = keyed.alias("k").join(gone.alias("g"), (F.col(f"k.{own['tag']}") == F.col(f"g.{own['tag']}"))
                                   & F.col(f"k.{own['id']}").eqNullSafe(F.col(f"g.{own['id']}")), "left")
    away = F.col(own["gone"])
    parts = F.split(text, "\n")
    kept = F.when(away.isNull(), text).otherwise(
        F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(away, i)), "\n"))
    if report:
        return joined.select(F.col(f"k.{id_col}").alias(id_col), F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"),
                             F.when(text.isNull() | away.isNull(), 0).otherwise(F.size(away)).cast("long").alias("n_removed"),
                             F.sha2(F.coalesce(kept, F.lit("")), 256).alias("kept_sha256"))
    copied = F.lit(False)
    if drop_emptied:
        long = F.filter(parts, lambda x: F.length(F.btrim(x, F.lit(" \t\r\x0b\x0c"))) >= least)
        copied = F.coalesce(F.col(own["copied"]) & (F.size(long) == F.size(away)), F.lit(False))
    out = joined.withColumn(own["gone"], F.struct(kept.alias("text"), away.isNotNull().alias("cut"), copied.alias("copied")))
    if drop_emptied:
        out = out.where(~F.col(own["gone"]).getField("copied"))
        out = out.where(~F.col(own["gone"]).getField("cut") | F.col(own["gone"]).getField("text").rlike(r"[^\s]"))
    return out.select(*[F.col(f"k.`{c}`") if c != text_col else F.col(own["gone"]).getField("text").alias(c)
                        for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """The rows of query ``op3_lines``: doc_id, n_lines, n_removed, kept_sha256 (of the lines that stay, joined)."""
    return _applied(docs, EDITS, LEAST, "doc_id", "text", False, report=True)

"""Main text of web pages: nearest-URL page differencing on parsed pages.

A page is parsed into text lines, one for each block element, in page order; what
stands in scripts, styles and other unseen elements is no line.  Pages of a host are
sorted by URL path, each is paired with the neighbour whose path has the
longer common beginning, and the lines of both are aligned by a longest common
subsequence.  Shared lines are the site's, not the page's, and are deleted.

Differencing alone is wrong in two ways, so two rules follow it on every page.  An article
may share lines with its neighbour (a licence line, a quoted passage): inside
the page's ``article`` or ``main`` element no line is deleted for being
shared, and what is around such an element is not the article.  And a menu or advert may be the page's own: lines in elements that
are by name, role or class a menu, header, footer, sidebar, notice, advert,
form or comment section are dropped, shared or not.  Inside an article only block elements' whole
classes and roles tell that, and compounds that name nothing else (``ad-slot``, ``related-posts``); elsewhere a
word of a class does (but in ``with-sidebar`` and the like), and an id only if all its words do.  A page whose
article lies in a wrapper that a compound or a form would drop (``header-fixed``) keeps the article, unless it has another.

Paths are sorted in ranges of about ``HOST_PAGES`` pages, and the ends of each
range are handed to its neighbours: no host meets in one task, and each page
has the same neighbours however many ranges there are.  Hashes and paths
alone are sorted.

Defined results: a null or empty html gives an empty text; a null url is a
host of its own kind; a page alone on its host has no shared lines; pages of a host
with equal lines are one in the sorting, never each other's neighbours, and give a row each; an empty table gives an empty one;
other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import hashlib
import html as entities
import math
import os.path
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thetaflow.llm.common import partitions, sliced, stored

#: Pages of one range of paths.
HOST_PAGES = 5_000
#: A table of alignment of up to so many bits is kept whole; larger ones are halved.
ALIGN_BITS = 1 << 28

# ----------------------------------------------------------------------- parsing

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)

#: Contents that are never text, up to the end tag.
_RAW = frozenset("script style textarea title noscript template iframe noframes noembed xmp svg math".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
                    "samp small span strike strong sub sup time tt u var wbr img".split())
_DROPPED = frozenset("head nav footer aside form button select dialog menu object audio video canvas map "
                     "fieldset".split())
_MAIN = frozenset(("article", "main"))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of classes, ids and roles that tell what an element is.
_ROLES = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar "
                   "navigation menu menubar breadcrumb breadcrumbs pagination pager header masthead footer sidebar aside "
                   "complementary contentinfo cookie cookies consent gdpr notice notices alert popup modal overlay dialog "
                   "newsletter subscribe subscription signup login search share sharing social comment comments "
                   "commentlist reply replies respond disqus related recommended form".split())
#: Whole classes and roles that tell the same inside an article; others there may name its own parts.
_FURNITURE = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo nav navbar navigation menu "
                       "menubar breadcrumb breadcrumbs pagination pager sidebar complementary contentinfo cookie cookies consent "
                       "newsletter subscribe signup login share sharing social comment comments commentlist respond "
                       "disqus notice notices banner".split())
#: Parts of compound classes that tell the same inside an article, and pairs of which both must be there.
_PARTS = frozenset("ad ads advert adverts advertisement sponsor sponsored newsletter comments commentlist disqus breadcrumb "
                   "breadcrumbs pagination consent gdpr signup subscribe".split())
_SUBJECTS = frozenset("related recommended share sharing social cookie cookies comment reply site nav".split())
_KINDS = frozenset("area articles banner bar box button buttons content form icons items links list menu news notice popup "
                   "posts section stories thread tools widget".split())
#: Ids that name the readers' comments wherever they are.
_COMMENTS = frozenset("comments respond disqus_thread comment-list".split())
#: A class with such a word says what an element has, not what it is.
_STATES = frozenset("with without has no not".split())
#: Words of the page's frame: a compound of these may be the name of a wrapper around everything.
_FRAME = frozenset("nav navbar navigation menu menubar header masthead footer sidebar aside banner overlay modal popup dialog form "
                   "login search alert notice notices promo pager pagination".split())
_FORMS = frozenset("form fieldset dialog".split())
_CLOSES = {"p": frozenset("p".split()), "li": frozenset(("li", "p")), "dt": frozenset("dt dd p".split()),
           "dd": frozenset("dt dd p".split()), "tr": frozenset("tr td th p".split()), "td": frozenset("td th p".split()),
           "th": frozenset("td th p".split()), "option": frozenset(("option",))}
#: A start tag closes open elements only inside these.
_SCOPE = frozenset("html body article main section div ul ol dl table nav aside header footer form blockquote".split())

#: What a line stands in.  ``FRAMED`` is dropped but for articles, which are ``INNER``: the page's if it has no ``MAIN``.
OTHER, DROPPED, MAIN, FRAMED, INNER = range(5)


def _words(token: str) -> set[str]:
    words = set(re.split(r"[^a-z]+", token)) - {""}
    return set() if words & _STATES else words


def _furniture(name: str, attributes: str) -> bool:
    """Whether an element inside an article is none of its parts."""
    for attribute, value in _ATTRIBUTE.findall(attributes):
        value = value.strip("\"'").lower()
        if attribute.lower() == "id":
            if value in _COMMENTS and name not in _HEADINGS:
                return True
            continue
        tokens = value.split()
        if name in _INLINE:  # code marks its comments by classes
            tokens = [t for t in tokens if not t.startswith("comment")]
        elif any((w := _words(t)) & _PARTS and len(w) > 1 or w & _SUBJECTS and w & _KINDS for t in tokens):
            return True
        if not _FURNITURE.isdisjoint(tokens):
            return True
    return False


def _kind(name: str, attributes: str, kind: int) -> int:
    """What an element's lines stand in, if those around it stand in ``kind``."""
    if kind in (MAIN, INNER):
        return DROPPED if name in _DROPPED or attributes and name not in _MAIN and _furniture(name, attributes) else kind
    if name in _MAIN:
        if kind == FRAMED:
            return FRAMED if attributes and _furniture("div", attributes) else INNER
        return MAIN
    if name in _DROPPED and name not in _FORMS or name == "header":
        return DROPPED
    framed = kind == FRAMED or name in _FORMS
    if attributes and name not in ("html", "body"):
        for attribute, value in _ATTRIBUTE.findall(attributes):
            value = value.strip("\"'").lower()
            if attribute.lower() == "id":  # often a slug of a title: all of its words must tell
                if name not in _HEADINGS and _ROLES.issuperset(re.split(r"[^a-z0-9]+", value)):
                    return DROPPED
                continue
            for token in value.split():
                told = _words(token) & _ROLES
                if told and (token in _ROLES or told - _FRAME):
                    return DROPPED
                framed = framed or bool(told)
    return FRAMED if framed else kind


def lines(html: str) -> list[tuple[int, str]]:
    """The text lines of a page, each with what it stands in."""
    out: list[tuple[int, str]] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = []
    at, size = 0, len(html)

    def close() -> None:
        if text:
            line = " ".join(entities.unescape("".join(text)).split())
            if line:
                out.append((stack[-1][1] if stack else OTHER, line))
            text.clear()

    while at < size:
        m = _TOKEN.search(html, at)
        if m is None:
            text.append(html[at:])
            break
        if m.start() > at:
            text.append(html[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name not in _INLINE:
            close()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if name not in _INLINE:
                        del stack[i:]
                    elif all(x in _INLINE for x, _ in stack[i:]):
                        if stack[-1][1] != (stack[i - 1][1] if i else OTHER):
                            close()
                        del stack[i:]
                    break
            continue
        if name in _RAW:
            end = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(html, at)
            after = html.find(">", end.end()) if end else -1
            at = after + 1 if after >= 0 else size
            continue
        if name in _VOID:
            continue
        if name in _CLOSES:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in _CLOSES[name]:
                    del stack[i:]
                    break
                if stack[i][0] in _SCOPE:
                    break
        around = stack[-1][1] if stack else OTHER
        kind = around if around == DROPPED else _kind(name, m[3], around)
        if kind != around:
            close()
        stack.append((name, kind))
    close()
    return out


# --------------------------------------------------------------------- alignment

def shared(a: list, b: list) -> set[int]:
    """Positions in ``a`` of a longest common subsequence of both."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = set(range(head)) | set(range(len(a) - tail, len(a)))
    out.update(head + i for i in _common(a[head:len(a) - tail], b[head:len(b) - tail]))
    return out


def _rows(a: list, b: list) -> Iterator[int]:
    """Bit-parallel rows of the table of common subsequences: bit j is 0 where b[j] adds one."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    every = (1 << len(b)) - 1
    v = every
    yield v
    for x in a:
        u = v & where.get(x, 0)
        v = (v + u | v - u) & every
        yield v


def _lengths(v: int, n: int) -> np.ndarray:
    """Lengths of common subsequences with b[:j], for j = 0 ... n."""
    bits = np.unpackbits(np.frombuffer(v.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


def _common(a: list, b: list) -> list[int]:
    if not a or not b:
        return []
    if len(a) == 1:
        return [0] if a[0] in b else []
    if len(a) * len(b) > ALIGN_BITS:
        half = len(a) // 2
        *_, top = _rows(a[:half], b)
        *_, low = _rows(a[half:][::-1], b[::-1])
        j = int((_lengths(top, len(b)) + _lengths(low, len(b))[::-1]).argmax())
        return _common(a[:half], b[:j]) + [half + i for i in _common(a[half:], b[j:])]
    table = list(_rows(a, b))
    out, i, j = [], len(a), len(b)
    while i and j:
        if table[i] >> j - 1 & 1:  # b[j - 1] adds nothing to a[:i]
            j -= 1
        elif not table[i - 1] >> j - 1 & 1:  # nor does a[i - 1] to what b[:j] has
            i -= 1
        else:
            out.append(i - 1)
            i, j = i - 1, j - 1
    return out[::-1]


# ------------------------------------------------------------------- Spark steps

def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page, url, host, path, html) -> the same with, for html, a hash of what is kept, and the kept lines: digest, in an article or not, text."""
    for part in sliced(batches, 4):
        keys, marks, mains, texts = [], [], [], []
        for html in part.column(4).to_pylist():
            every = lines(html or "")
            if not any(k == MAIN for k, _ in every):
                every = [(MAIN if k == INNER else k, x) for k, x in every]
            kept = [(x, k) for k, x in every if k in (OTHER, MAIN)]
            keys.append(hashlib.md5("\n".join(f"{k}{x}" for x, k in kept).encode("utf-8", "surrogatepass")).digest())
            marks.append([hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=12).digest() for x, _ in kept])
            mains.append([k == MAIN for _, k in kept])
            texts.append([x for x, _ in kept])
        yield pa.RecordBatch.from_arrays(
            [*(part.column(i) for i in range(4)), pa.array(keys, pa.binary()), pa.array(marks, pa.list_(pa.binary())),
             pa.array(mains, pa.list_(pa.bool_())), pa.array(texts, pa.list_(pa.string()))],
            names=["page", "url", "host", "path", "key", "marks", "mains", "lines"])


def main_text(own: list, mains: list, common: set[int]) -> str:
    """Text of a page, given its lines, which of them its article has, and the places of those that are its neighbour's too."""
    bare = not any(mains)
    return " ".join(x for i, x in enumerate(own) if (mains[i] or bare and i not in common))


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, key, path, before, after) -> (host, key, near): the neighbour whose path has the longer common beginning."""
    for batch in batches:
        near = []
        for path, *sides in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
            best = max((x for x in sides if x is not None), default=None,
                       key=lambda x: len(os.path.commonprefix([x["path"], path])))
            near.append(best and best["key"])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.binary())],
                                         names=["host", "key", "near"])


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, key, own, other), the last two (marks, mains) -> (host, key, common): places in ``own`` of lines that ``other`` has.

    A neighbour's article is not its site's: a page without one is aligned with what is around it.
    """
    for batch in batches:
        for i in range(batch.num_rows):  # pages may be long: one at a time
            row = batch.slice(i, 1)
            own, other = row.column(2)[0].as_py(), row.column(3)[0].as_py()
            there = [m for m, main in zip(other["marks"], other["mains"]) if not main or any(own["mains"])] if other else []
            common = sorted(shared(own["marks"], there)) if there else []
            yield pa.RecordBatch.from_arrays([row.column(0), row.column(1), pa.array([common], pa.list_(pa.int32()))],
                                             names=["host", "key", "common"])


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page, url, lines, mains, common) -> (page, url, text)."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            own, mains, common = (row.column(j)[0].as_py() for j in (2, 3, 4))
            yield pa.RecordBatch.from_arrays([row.column(0), row.column(1), pa.array([main_text(own, mains, set(common))], pa.string())],
                                             names=["page", "url", "text"])


def neighbours(rows: DataFrame, host_pages: int) -> DataFrame:
    """(host, key, near): for every page, the nearest page of the host that differs.

    Equal pages are one here, at the first of their paths.
    """
    spark = rows.sparkSession
    reps = rows.groupBy("host", "key").agg(F.min(F.struct("path", "page")).alias("at"))
    reps = stored(reps.select("host", "at.path", "at.page", "key"), "differing")
    ranges = max(partitions(spark), math.ceil(reps.count() / host_pages))
    keys = ["host", "path", "page", "key"]
    parts = stored(reps.repartitionByRange(ranges, *keys).withColumn("part", F.spark_partition_id()), "ranges")
    place = F.struct(*keys)
    ends = parts.groupBy("part").agg(F.min(place).alias("low"), F.max(place).alias("high"))
    every = Window.orderBy("part")  # a row for each range
    ends = ends.select("part", F.lag("high").over(every).alias("previous"), F.lead("low").over(every).alias("following"))
    order = Window.partitionBy("part").orderBy(*keys)
    sides = (parts.select("*", F.lag(place).over(order).alias("lag"), F.lead(place).over(order).alias("lead"))
             .join(F.broadcast(ends), "part")
             .withColumns({"before": F.coalesce("lag", "previous"), "after": F.coalesce("lead", "following")})
             .select("host", "key", "path", *[F.when(F.col(f"{c}.host") == F.col("host"), F.col(c)).alias(c) for c in ("before", "after")]))
    return stored(sides.mapInArrow(_nearest, "host string, key binary, near binary"), "neighbours")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            host_pages: int = HOST_PAGES) -> DataFrame:
    """(id, url, text) of every row."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)", 2)
    pages = pages.select(
        F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"),
        F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).alias("host"),
        rest.alias("path"), F.col(html_col).alias("html"))
    # parsed twice: digests of the lines are stored and aligned, their texts go straight to what is kept of them
    rows = pages.mapInArrow(_parsed, "page long, url string, host string, path string, key binary, marks array<binary>, "
                                     "mains array<boolean>, lines array<string>")
    index = stored(rows.drop("url", "lines"), "pages")
    near = neighbours(index, host_pages)
    lists = index.groupBy("host", "key").agg(F.first(F.struct("marks", "mains")).alias("own"))
    other = lists.toDF("host", "near", "other")
    places = (near.join(lists, ["host", "key"]).join(other, ["host", "near"], "left").select("host", "key", "own", "other")
              .mapInArrow(_aligned, "host string, key binary, common array<int>"))
    return (rows.join(places, ["host", "key"]).select("page", "url", "lines", "mains", "common")
            .mapInArrow(_chosen, "page long, url string, text string").toDF(id_col, url_col, "text"))


def report(pages: DataFrame) -> DataFrame:
    """The rows of query ``op2_html_text``."""
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))

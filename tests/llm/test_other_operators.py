"""Packing, classifier, vectors, archives, pages, helpers and the pipeline."""

import base64
import gzip
import hashlib
import math
import random
import zlib
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scripts.check_oracle import digest, type_diffs
from tests.llm import brute
from tests.llm.data import CLASHING, documents, frame
from thetaflow.llm import common, html_text, packing, quality, queries, vector_join, warc

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ helpers

def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(70)]
    links += [(5000, 5000 + i) for i in range(200)] + [(9, 9), (7, 3), (3, 7)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = brute.reach({x for l in links for x in l}, links)
    assert got == {n: c for n, c in want.items() if any(n in l and l[0] != l[1] for l in links)}
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_word_hashes_tell_words_apart():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abAB \t\n\r\x0b\x0cé\x00") for _ in range(rng.randrange(200))).encode() for _ in range(300)]
    names, counts = common.hashed_words(texts)
    words = [w for t in texts for w in t.split()]
    assert counts.tolist() == [len(t.split()) for t in texts]
    assert len(set(zip(words, names.tolist()))) == len(set(words)) == len(set(names.tolist()))
    windows = {}
    for i, h in enumerate(common.window_hashes(names, 5).tolist()):
        assert windows.setdefault(h, words[i:i + 5]) == words[i:i + 5]


@pytest.mark.parametrize("size", [32, 256, 1024, 8192])
def test_word_hashes_of_long_alike_words(size):
    """Words that polynomial hashes modulo a power of two can't tell apart, and words that differ at one place."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(size)).encode()
    other = one.translate(bytes.maketrans(b"ab", b"ba"))
    alike = [one, other, one[::-1] + b"c", one[:-1] + b"c", b"c" + one[1:], one[:size // 2], one[1:], other[1:]]
    names, counts = common.hashed_words([w + b" x" for w in alike] + [b" ".join(alike)])
    assert counts.tolist() == [2] * len(alike) + [len(alike)]
    assert names[:2 * len(alike):2].tolist() == names[2 * len(alike):].tolist() and len(set(names.tolist())) == len(set(alike)) + 1


# ------------------------------------------------------------------ packing

@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=40))
@settings(max_examples=200, deadline=None)
def test_plan_places_every_piece_once(counts):
    slots = packing.plan(counts, 64)
    used, filled = {}, {}
    for n, a, b, sequence, offset in slots:
        used.setdefault(n, []).append((a, b))
        for k in range(b - a):
            filled.setdefault(sequence + k, []).append((offset, n))
    for n, c in counts.items():
        assert [x for r in sorted(used[n]) for x in range(*r)] == list(range(c))
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
        assert sum(3 * n > 64 for _, n in parts) <= 2
    total = sum(n * c for n, c in counts.items())
    assert len(filled) <= 1.75 * -(-total // 64) + 1


def test_packing(spark, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    rows = documents(n=40) + [(900, "<|endoftext|> hi  there's x\u0085y"), (901, "数字 ١٢٣ Ǆ 😀\x00\x1f"), (2, ""), (None, "abc")]
    got = packing.pack(common.stored(packing.pieces(frame(spark, rows, True), 64), "p"), 64, block_rows=7).collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
    for i, t in rows:
        ids = np.array(slow.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        mine = sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces[i]})
        assert [p for p, *_ in mine] == list(range(len(mine)))
        assert all(n == 64 for _, _, n, _ in mine[1:])
        assert sum(n for *_, n, _ in mine) == len(ids)
        assert all(zlib.crc32(ids[s:s + n].tobytes()) == c for _, s, n, c in mine)
    assert sum(r["doc_id"] == 2 for r in got) == 2
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert len(by) <= 1.05 * sum(r["length"] for r in got) / 64 + 2
    whole = packing.sequences(frame(spark, rows[:9]), 64).collect()
    assert all(len(r["ids"]) == sum(r["lengths"]) <= 64 for r in whole)
    assert packing.report(frame(spark, [])).collect() == []


# --------------------------------------------------------------- classifier

def test_gradients():
    rng = np.random.default_rng(0)
    x, starts, y = rng.normal(size=(12, 5)), np.array([0, 1, 5, 9]), np.array([1.0, 0, 1, 0])
    model = quality.fit(x, starts, y, hidden=4, gate=3, steps=3)
    weight = np.full(4, 0.25)

    def loss():
        p = model.forward(x, starts)["p"]
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    g = model.gradients(model.forward(x, starts), y, weight)
    for k, w in model.weights.items():
        for i in list(np.ndindex(w.shape))[:6]:
            old, step = w[i], 1e-6
            w[i] = old + step
            up = loss()
            w[i] = old - step
            down = loss()
            w[i] = old
            assert g[k][i] == pytest.approx((up - down) / (2 * step), abs=1e-6)


def test_scores_do_not_depend_on_neighbours():
    texts = [t.encode() if t else b"" for _, t in documents()] + [b" \n\n x", b"\n", b""]
    x, starts = quality.encode(texts)
    ends = np.r_[starts[1:], len(x)]
    for t, a, b in zip(texts, starts, ends):
        alone, _ = quality.encode([t])
        assert np.array_equal(alone, x[a:b])


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    extra = frame(spark, [(10**9, None), (10**9 + 1, ""), (10**9 + 1, ""), (None, "x")])
    rows = quality.report(docs.select("doc_id", "text").unionAll(extra), labels).collect()
    assert len(rows) == docs.count() + 4 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows if r["doc_id"] is not None)
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    test = [(marks[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in marks]
    assert sum(a == b for a, b in test) / len(test) > 0.93
    assert all(b == 1 for a, b in test if a == 1)


def test_quality_without_labels(spark):
    labels = spark.createDataFrame([(1, None), (2, 1)], "doc_id long, quality int")
    clashing = frame(spark, [(1, "a"), (2, "b"), (3, None)], True)
    scores = {r["score"] for r in quality.report(clashing, labels).collect()}
    assert scores <= {1.0, 0.5} and len(scores) == 1
    model = quality.train(clashing, labels)
    assert quality.keep(clashing, model).columns == clashing.columns
    assert quality.report(frame(spark, []), labels).collect() == []


# ------------------------------------------------------------------ vectors

@pytest.mark.parametrize("cell", [3, 4096])
def test_vectors(spark, cell):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 6))
    rows = [(int(i), (centres[rng.integers(12)] + rng.normal(size=6) * rng.choice([0, 0.1, 0.4])).tolist()) for i in range(150)]
    rows += [(1000 + i, rows[4][1]) for i in range(20)] + [(2000, [2 * x for x in rows[4][1]]), (2001, [1.0, 2.0]), (2002, [2.0, 4.0])]
    bad = [(3000, None), (3001, []), (3002, [0.0] * 6), (3003, [None] + [1.0] * 5), (3004, [float("nan")] * 6),
           (3005, [float("inf")] + [0.0] * 5)]
    good = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    links = [(a, b) for a in good for b in good if a != b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.9]
    low = brute.reach([i for i, _ in rows + bad], links)
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in CLASHING})
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_join.join(df, cell=cell).collect()}
    assert got == {i: (sum(a == i for a, _ in links), c, c == i) for i, c in low.items()}


def test_vectors_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.1]), (None, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in vector_join.join(df).collect())
    assert got == [(0, 0, None, False), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]
    assert vector_join.join(df.limit(0)).collect() == []


def test_pivots_of_one_direction_rule_nothing_out():
    for seed in range(8):
        rng = np.random.default_rng(seed)
        base = rng.normal(size=16)
        pivots = vector_join.matrix(pa.array([(base * s).tobytes() for s in rng.uniform(0.1, 9, 4)]), 16)
        rows = [(base * s + rng.normal(size=16) * e).tobytes() for s in rng.uniform(0.1, 9, 100) for e in (0, 0.1)]
        n = len(rows)
        batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([16] * n, pa.int32()), pa.array(rows), pa.array([1] * n)],
                                           names=["id", "dim", "vector", "copies"])
        cells, = vector_join._cells(SimpleNamespace(value={16: pivots}))([batch])
        cell = cells.column(4).to_numpy()
        radius = np.array([cells.column(5).to_numpy()[cell == c].max(initial=-np.inf) for c in range(4)])
        plan = SimpleNamespace(value=({16: pivots}, {16: (np.arange(4), radius, np.arange(4))}))
        placed = pa.RecordBatch.from_arrays([*cells.columns, pa.array(cell)], names=[*cells.schema.names, "block"])
        out, = vector_join._dealt(plan, math.sqrt(0.2))([placed])
        seen = set(zip(out.column(2).to_pylist(), out.column(0).to_pylist()))
        x = vector_join.matrix(batch.column(2), 16)
        assert all((i, cell[j]) in seen or (j, cell[i]) in seen for i, j in zip(*np.nonzero(x @ x.T >= 0.9)))


def evenly(n, dim=64, seed=7):
    return vector_join.scaled(np.random.default_rng(seed).normal(size=(n, dim)))


def vector_rows(x, copies=1, first=0, **more):
    """Vectors as the columns (id, dim, vector, copies), and more."""
    n = len(x)
    columns = {"id": pa.array(range(first, first + n)), "dim": pa.array([x.shape[1]] * n, pa.int32()),
               "vector": pa.array([v.tobytes() for v in x], pa.binary()), "copies": pa.array(np.full(n, copies, np.int64))}
    return pa.RecordBatch.from_pydict(columns | {k: pa.array(np.asarray(v, np.float64 if k == "far" else np.int32)) for k, v in more.items()})


def test_guests_of_many_blocks_take_no_copies_of_vectors():
    x, pivots, blocks = evenly(2048), evenly(100, seed=8), 800
    gaps = vector_join.distances(x, pivots)
    cell = gaps.argmin(1)
    batch = vector_rows(x, cell=cell, far=gaps.min(1), block=cell * 8)
    plan = SimpleNamespace(value=({64: pivots}, {64: (np.repeat(np.arange(100), 8), np.full(100, 2.0), np.arange(blocks))}))
    out = list(vector_join._dealt(plan, math.sqrt(0.2))([batch]))
    assert sum(b.num_rows for b in out) > 2048 * blocks / 4  # evenly spread vectors are guests of half of all blocks
    assert sum(b.nbytes for b in out) < 40e6


@pytest.mark.parametrize("tile, links", [((7, 11), 500), ((256, 1024), 1 << 20), ((64, 64), 1 << 12)])
def test_links_of_two_chunks(monkeypatch, tile, links):
    monkeypatch.setattr(vector_join, "TILE", tile)
    monkeypatch.setattr(vector_join, "LINKS", links)
    rng = np.random.default_rng(4)
    x = evenly(300, 40)
    x[:120] = vector_join.scaled(x[0] + rng.normal(size=(120, 40)) * rng.choice([0.02, 0.06, 0.09], (120, 1)))  # a dense group
    x[150:200] = x[140] + rng.normal(size=(50, 40)) * 0.06
    x, copies = x[rng.permutation(300)], rng.integers(1, 4, 300)
    block = np.sort(rng.integers(0, 6, 300))
    chunk = block // 3
    batch = vector_rows(x, cell=[0] * 300, far=vector_join.distances(vector_join.scaled(x), evenly(1, 40))[:, 0], block=block, chunk=chunk)
    batch = batch.set_column(3, "copies", pa.array(copies))
    rows = pa.Table.from_batches(vector_join._packed({0: [0, 1], 1: [0, 1]})([batch.slice(0, 100), batch.slice(100)]))
    assert rows["chunk"].to_pylist() == [0, 1] and rows["meets"].to_pylist() == [[0, 1]] * 2
    packed = rows["rows"].combine_chunks()
    pairs = pa.RecordBatch.from_arrays([packed.take(pa.array([0, 0, 1, 1])), packed.take(pa.array([0, 1, 0, 1])),
                                        pa.array([True, False, False, True])], names=["hosts", "rows", "same"])
    plan = SimpleNamespace(value=({40: evenly(1, 40)}, {40: np.array([2.0])}))
    n, edges = np.zeros(300, int), []
    for out in vector_join._met(plan, math.sqrt(0.2), 0.9)([pairs]):
        assert out.num_rows <= 300
        np.add.at(n, out["id"].to_numpy(), out["n"].to_numpy())
        edges += zip(out["id"].to_pylist(), out["to"].to_pylist())
    near = vector_join.scaled(x) @ vector_join.scaled(x).T >= 0.9
    np.fill_diagonal(near, False)
    assert near.sum() > 5000 and n.tolist() == (near @ copies).tolist()
    assert brute.reach(range(300), edges + [(b, a) for a, b in edges]) == brute.reach(range(300), list(zip(*np.nonzero(near))))


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_in_several_chunks(spark, monkeypatch, kind):
    monkeypatch.setattr(vector_join, "CHUNK", 20 * 8 * 40)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(10, 40))
    x = (centres[rng.integers(10, size=200)] + rng.normal(size=(200, 40)) * rng.choice([0.1, 0.3], (200, 1))).astype(np.float32)
    x[0], x[-20:] = 0, x[5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[9].tolist()), (7, x[7].tolist()), (300, [1.0, 2.0]), (301, [2.0, 4.0])]
    good = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows[1:] if i != 7]
    links = [(a, b) for a, v in good for b, w in good if a != b and len(v) == len(w) and v @ w >= 0.9]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    got = {r["vec_id"]: r for r in vector_join.join(df.where("vec_id <> 7"), cell=9).collect()}
    low = brute.reach([i for i, _ in rows if i != 7], links)
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()} == {
        i: (sum(a == i for a, _ in links), c, c == i) for i, c in low.items()}
    twice = [r for r in vector_join.join(df, cell=9).collect() if r["vec_id"] == 7]
    assert len(twice) == 3 and len(set(twice)) == 1 and twice[0]["n_links"] > 0  # one node, linked by any of its vectors


# ----------------------------------------------------------------- archives

def test_archives(spark):
    hard = "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n0\r\n\r\n" * 40
    rows = [(i, f"http://h/{i}", "p" * (i * 997 % 60_000)) for i in range(60)]
    rows += [(100, None, None), (101, "u", ""), (102, "a b\r\nc", hard), (103, "u", hard), (104, "u", "é" * 90_000),
             (104, "u", "é" * 90_000), (None, "u", hard), (None, "u", "own")]
    pages = frame(spark, rows, True, "page_id long, url string, html string")
    want, first = set(), {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, _, t in rows:
        b = (t or "").encode()
        again = i is not None and first[t or ""] != i
        want.add((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response",
                  first[t or ""] if again else None))
    got = [tuple(r) for r in warc.report(pages).collect()]
    assert set(got) == want and len(got) == len(want)
    path = common.scratch_path(spark, "archives")
    warc.write(pages, path, segment_bytes=500, chunk_bytes=77, least=10**6)
    back = warc.read(spark, path).collect()
    assert all(r["complete"] and r["record_type"] == "response" for r in back)
    assert {bytes(r["payload"]) for r in back} == {(t or "").encode() for *_, t in rows}
    assert warc.report(pages.limit(0)).collect() == []


def test_broken_segments_are_reported():
    def run(records):
        import pyarrow as pa

        out = warc._read(iter([pa.RecordBatch.from_arrays([pa.array([b"".join(gzip.compress(x + b"\r\n\r\n") for x in records)])], names=["content"])]))
        cut = sorted((r for b in out for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: (r[5], r[6]))
        return [r for b in warc._joined(True)(iter([warc._batch(cut, warc._FIELDS)])) for r in zip(*(c.to_pylist() for c in b.columns))]

    records = list(warc.records(1, "u", b"payload " * 400, None, 700, 64))
    assert run(records)[0][4:6] == (True, 3200)
    for k in range(len(records)):
        assert run(records[:k] + records[k + 1:])[0][4] is False
    assert run(records + records[1:2])[0][4] is True


# -------------------------------------------------------------------- pages

def test_alignment():
    rng = random.Random(1)

    def longest(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    for bits in (4, 1 << 28):
        html_text.ALIGN_BITS, old = bits, html_text.ALIGN_BITS
        for _ in range(600):
            a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2))
            common_at = sorted(html_text.shared(a, b))
            rest = iter(b)
            assert len(common_at) == longest(a, b) and all(a[i] in rest for i in common_at)
        html_text.ALIGN_BITS = old


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>Home</ul></nav>
<div class="cookie-notice">We use cookies<p>ok</div><!-- <p>no --><article><h1>A &amp; B&#33;</h1><p><b>One
 two</b> x<i>y</i>z<br>four<p>five<script>var x = "</p>";</script><aside>side</aside>&copy six</article>
<form><p>mail</p></form><section id="comments"><p>nice</section><footer>end</footer></body></html>"""


def test_pages(spark):
    rows = [(1, "http://h/a", PAGE), (2, "http://h/a", None), (3, None, ""), (4, "http://h/b", PAGE[:PAGE.index("five") + 2]),
            (5, "http://g/x1", "<p>Top</p><p>own 1</p><p>Bottom</p>"), (6, "http://g/x2", "<p>Top</p><div>own<b>2</b></div><p>Bottom"),
            (7, "u", "<p" * 50_000), (8, "u", "a<b 'c" * 1000), (9, "u", "<div>" * 30_000 + "deep"), (None, "http://h/a", PAGE)]
    df = frame(spark, rows, True, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.report(df).collect()}
    assert got[1] == got[None] == "A & B! One two xyz four five © six"
    assert got[2] == got[3] == "" and got[4] == "A & B! One two xyz four fi"
    assert (got[5], got[6], got[9]) == ("own 1", "own2", "deep")
    many = frame(spark, [(i, f"http://h/{i}", f"<p>menu {i % 2}<p>text {i}") for i in range(60)], names="page_id long, url string, html string")
    assert {r["page_id"] for r in html_text.extract(many, host_pages=10).collect()} == set(range(60))
    assert html_text.report(df.limit(0)).collect() == []


def test_slugs_and_article_headers_stay():
    inside = """<article><div class="entry-header"><h1>Title</h1></div><h2 id="related-work">Related</h2>
        <section id="search-for-a-proof"><p>Proof</section><h2 id="comments">Remarks</h2><p id="form-of-government">Forms
        <div class="x ad">Buy</div><div class="share">Share</div><div role="navigation">Next</div></article>"""
    assert [x for k, x in html_text.lines(inside) if k == html_text.MAIN] == ["Title", "Related", "Proof", "Remarks", "Forms"]
    outside = '<h2 id="related">A</h2><section id="search-for-a-proof"><p>B</section><div id="cookie-notice">C</div><p data-id="ad">D'
    assert [x for k, x in html_text.lines(outside) if k == html_text.OTHER] == ["A", "B", "D"]


def kept(html):
    every = html_text.lines(html)
    return [x for k, x in every if k == html_text.MAIN] or [x for k, x in every if k == html_text.INNER]


@pytest.mark.parametrize("wrapper", ['<div class="layout with-sidebar">', '<div class="page header-fixed">', '<form id="aspnetForm" action="x">',
                                     '<div class="menu-open"><div class="has-footer content">', '<div id="page" class="no-banner">'])
def test_wrappers_keep_the_article(wrapper):
    for main in ("article", "main"):
        page = f'{wrapper}<nav>Menu</nav><p>Site</p><{main}><h1>Title</h1><p>Text</p></{main}><div class="footer">End</div>'
        assert kept(page) == ["Title", "Text"]
    bare = f'<div class="layout with-sidebar"><p>Text</p><div class="sidebar">Side</div></div>'
    assert [x for k, x in html_text.lines(bare) if k == html_text.OTHER] == ["Text"]
    teasers = '<div class="sidebar-box"><article>Teaser</article></div><article>Text</article>'
    assert kept(teasers) == ["Text"]
    comments = '<div class="comments-area"><article class="comment">Nice</article></div><div class="page-form"><article class="comment">So</article></div>'
    assert kept(comments) == []


def test_furniture_inside_articles_goes():
    for what in ('class="cookie-notice"', 'class="notice"', 'class="banner"', 'class="comments-area"', 'class="ad-slot"', 'id="comments"',
                 'class="related-posts"', 'class="newsletter-signup"', 'class="x share-buttons"', 'class="comment-list"', 'role="complementary"'):
        assert kept(f"<article><h1>Title</h1><p>Text</p><div {what}><p>Other</p></div><p>End</p></article>") == ["Title", "Text", "End"], what
    for what in ('class="related-work"', 'class="market-share"', 'class="entry-header"', 'class="with-ads"', 'id="related-posts-of-ours"', 'class="note"'):
        assert kept(f"<article><h1>Title</h1><div {what}><p>Own</p></div></article>") == ["Title", "Own"], what
    assert kept('<article><pre><code>x = 1 <span class="token comment"># why</span></code></pre></article>') == ["x = 1 # why"]


def test_pages_without_article_against_plain_differencing(spark):
    """The whole query against a plain pairing and a quadratic alignment, on pages that differ in many lines."""
    rng = random.Random(6)
    rows = []
    for i in range(60):
        top = ["Site", "Menu one", "Menu two", f"Section {i // 6}"]
        own = [f"{rng.choice('abcd')} line {rng.randrange(9)} of {i if rng.random() < 0.8 else 'many'}" for _ in range(rng.randrange(0, 8))]
        rows.append((i, f"http://H/{'ab'[i % 2]}/{i // 6:02}/{i:02}", "".join(f"<p>{x}|</p>" for x in top + own + ["End"])))
    rows += [(90, rows[7][1], rows[7][2]), (91, "http://alone/x", "<p>Text|")]
    got = {r["page_id"]: r["text"] for r in html_text.report(frame(spark, rows, False, "page_id long, url string, html string")).collect()}

    def parts(row):
        return row[1].split("/")[2].lower(), "/" + "/".join(row[1].split("/")[3:]), [x for x in row[2].replace("</p>", "").split("<p>") if x]

    firsts = {}  # equal pages are one, at the first of their paths
    for row in rows:
        host, path, own = parts(row)
        key = host, tuple(own)
        firsts[key] = min(firsts.get(key, (path, row[0])), (path, row[0]))
    for row in rows:
        host, path, own = parts(row)
        order = sorted((at, list(k)) for (h, k), at in firsts.items() if h == host)
        at = next(i for i, (_, k) in enumerate(order) if k == own)
        mine = order[at][0][0]
        sides = [order[j] for j in (at - 1, at + 1) if 0 <= j < len(order)]
        best = max(sides, key=lambda x: len(__import__("os").path.commonprefix([x[0][0], mine])), default=None)
        other = best[1] if best else []
        table = [[0] * (len(other) + 1) for _ in range(len(own) + 1)]
        for i, a in enumerate(own):
            for j, b in enumerate(other):
                table[i + 1][j + 1] = table[i][j] + 1 if a == b else max(table[i][j + 1], table[i + 1][j])
        left = [x.strip() + "|" for x in got[row[0]].split("|") if x]
        assert len(left) == len(own) - table[-1][-1]
        gone, at = [], 0  # what is left is in order, and the rest is in the other page in order
        for x in own:
            if at < len(left) and x == left[at] and (x not in other or own.count(x) == 1 and x not in gone):
                at += 1
            else:
                gone.append(x)
        steps = iter(other)
        assert at == len(left) and all(any(x == y for y in steps) for x in gone)


def test_copies_are_no_neighbours(spark):
    def page(own):
        return f"<p>Top<p>{own}<p>Bottom"

    rows = [(1, "http://h/a/x", page("one")), (2, "http://h/a/x", page("one")), (3, "http://h/a/x?again", page("one")),
            (4, "http://h/a/x2", page("one") + '<div class="ad">other'), (5, "http://h/b", page("two")), (6, "http://i/a", "<p>alone"),
            (7, "http://i/a", "<p>alone")]
    got = {r["page_id"]: r["text"] for r in html_text.report(frame(spark, rows, True, "page_id long, url string, html string")).collect()}
    assert got == {1: "one", 2: "one", 3: "one", 4: "one", 5: "two", 6: "alone", 7: "alone"}


def test_neighbours_do_not_depend_on_size(spark):
    rows = [(i, f"http://h/{i // 4:02}/{i % 4}", f"<p>menu<p>section {i // 4}<p>text {i}") for i in range(80)]
    pages = frame(spark, rows, names="page_id long, url string, html string").repartition(3, "page_id")
    for size in (1, 7, 1000):
        got = {r["page_id"]: r["text"] for r in html_text.extract(pages, host_pages=size).collect()}
        assert got == {i: f"text {i}" for i in range(80)}


# ------------------------------------------------------- queries and pipeline

@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    rows, res = [tuple(r) for r in df.collect()], con.execute(queries.ORACLE_SQL[name])
    assert type_diffs(df.schema, res.description) == []
    assert digest(df.columns, rows)[0] == digest([d[0] for d in res.description], res.fetchall())[0]


def test_pipeline(spark):
    import corpus_pipeline

    docs = common.table(spark, SF, "documents")
    names = docs.columns
    marks = {r["doc_id"]: r["quality"] for r in common.table(spark, SF, "labels").collect()}
    items = {r["item_id"]: r["text"] for r in common.table(spark, SF, "benchmark").collect()}
    for stage, (name, step) in zip(range(5), corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = common.stored(step(spark, docs, SF), "stage")
        rows = docs.collect()
        after = {r["doc_id"]: r["text"] for r in rows} if stage < 4 else {}
        if stage == 0:
            gone = set(before) - set(after)
            assert not [i for i in gone if marks.get(i) == 1] and [i for i in gone if marks.get(i) == 0]
        elif stage == 1:
            want = {i: n for i, _, n, _ in brute.line_removal(list(before.items()), 2, 20)}
            lines = {i: (before[i] or "").count("\n") - (after[i] or "").count("\n") for i in after}
            assert all(want[i] == lines[i] or want[i] == lines[i] + 1 and not after[i] for i in after)
            assert all(want[i] for i in set(before) - set(after))
        elif stage == 2:
            assert set(after) == {i for i, c in brute.jaccard_components(before).items() if i == c}
        elif stage == 3:
            hit = brute.contamination(before, items)
            assert set(after) == {i for i, h in hit.items() if h[1] < 0.5 * h[0] or not h[1]}
            assert all(after[i] == before[i] for i in after if not hit[i][1])
        else:
            assert {r["doc_id"] for r in rows} == set(before)
        if stage < 4:
            assert docs.columns == names


def test_pages_with_an_article_are_differenced_too(spark, monkeypatch):
    rows = [(i, f"https://h.org/a/{i}", f"<p>Site line</p><article><p>Licence</p><p>Own {i}</p></article>") for i in range(4)]
    seen = []
    near = html_text.neighbours
    monkeypatch.setattr(html_text, "neighbours", lambda *a: seen.append(near(*a)) or seen[-1])
    got = {r["page_id"]: r["text"] for r in html_text.report(frame(spark, rows, False, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Licence Own {i}" for i in range(4)}
    assert seen[0].where("near IS NOT NULL").count() == 4
    own = {"marks": [b"s", b"l", b"1"], "mains": [False, True, True]}
    other = {"marks": [b"s", b"l", b"2"], "mains": [False, True, True]}
    bare = {"marks": [b"s", b"l"], "mains": [False, False]}
    kinds = pa.struct([("marks", pa.list_(pa.binary())), ("mains", pa.list_(pa.bool_()))])
    batch = pa.RecordBatch.from_arrays([pa.array(["h", "h"]), pa.array([b"k", b"b"]), pa.array([own, bare], kinds), pa.array([other, other], kinds)],
                                       names=["host", "key", "own", "other"])
    assert [b.column(2)[0].as_py() for b in html_text._aligned(iter([batch]))] == [[0, 1], [0]]

"""Manifest, nearest neighbours and clustering against plain Python."""

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest

from scripts.check_oracle import digest, type_diffs
from tests.llm.data import frame
from thetaflow.llm import centroids, manifest, neighbours, queries
from thetaflow.llm.oracles import ORACLE_SQL

SF = "/root/testdata/sf0.001"


def check(spark, name, table, rows=None):
    """Query against its SQL, on given tables or a frame."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    res = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    assert type_diffs(df.schema, res.description) == []
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(names, res.fetchall())[0]


# ------------------------------------------------------------------ manifest

def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def proof(levels, i):
    for level in levels[:-1]:
        a = i - i % 3
        yield i - a, [x for j, x in enumerate(level[a:a + 3], a) if j != i]
        i //= 3


def brute_manifest(rows):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    sources = {}
    for doc, source, lang, n, text in rows:
        cut = text.replace("\n", "") if doc is not None and text is not None and zlib.crc32(str(doc).encode()) % 2 == 0 else text
        leaf, other = (h(*map(field, (doc, source, lang, n, t))) for t in (text, cut))
        sources.setdefault(source, []).append((doc is not None, doc or 0, leaf, other))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(sources[s])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    for k, s in enumerate(names):
        for i, (known, doc, leaf, other) in enumerate(sorted(sources[s])):
            path, now = [*proof(trees[s], i), *proof(top, k)], other
            for at, run in path:
                now = h(*run[:at], now, *run[at:])
            yield (doc if known else None, leaf, trees[s][-1][0], top[-1][0], h(*[x for _, run in path for x in run]), now, now == top[-1][0])


DOCUMENT = "doc_id long, source string, lang string, n_chars long, text string"


def manifest_rows(n=2300):
    rng = random.Random(3)
    rows = [(i * 7, "hot" if i % 3 else f"s{rng.randrange(40)}", rng.choice(("en", None, "fr")), rng.choice((None, i)),
             rng.choice((None, "", "a\nb", "é\n", "x" * 50, "\n"))) for i in range(n)]
    rows += [(3, None, None, None, None), (5, None, "en", 1, "t\n"), (8, "", "en", 1, "t"), (10, "É", "en", 1, "t"), (None, "hot", None, None, "a\nb")]
    return rows + rows[:5] + [(rows[0][0], rows[0][1], "de", 4, "other"), (-4, "hot", "en", 1, "minus\n"), (1, "hot", "en", 1, "l\n" * 90_000)]


def test_manifest(spark):
    rows = manifest_rows()
    got = sorted(map(str, (tuple(r) for r in manifest.report(frame(spark, rows, True, DOCUMENT)).collect())))
    assert got == sorted(map(str, brute_manifest(rows)))
    assert sum(x.endswith("True)") for x in got) > 0 < sum(x.endswith("False)") for x in got)


@pytest.mark.parametrize("rows", [[], [(1, "a", "en", 2, "x")], [(1, None, None, None, None)] * 4])
def test_manifest_of_few_rows(spark, rows):
    got = sorted(map(str, (tuple(r) for r in manifest.report(frame(spark, rows, False, DOCUMENT)).collect())))
    assert got == sorted(map(str, brute_manifest(rows)))


def test_log_is_in_order_of_completion(spark):
    rows = [(i, "a" if i < 2000 else "b" if i < 2010 else "c", None, None, str(i)) for i in range(2011)]
    sources, top = manifest.manifest(frame(spark, rows, False, DOCUMENT))
    log = manifest.log_rows(sources).collect()
    for name, n in (("sa", 2000), ("sb", 10), ("sc", 1)):
        mine = sorted((r["position"], bytes(r["digest"]).hex()) for r in log if r["tree"] == name)
        assert [p for p, _ in mine] == list(range(len(mine)))
        leaves = [bytes(r["digest"]).hex() for r in sorted(log, key=lambda r: r["position"]) if r["tree"] == name and not r["level"]]
        assert len(leaves) == n and [d for _, d in mine] == manifest.built(leaves, manifest.levels(n))
    assert sources[0].where("leaves > 729").isEmpty() and sources[0].count() == 3 + 2


def test_positions_without_a_search():
    for n in (1, 2, 3, 4, 9, 10, 28, 81, 100):
        placed, run = {}, [str(i) for i in range(n)]
        log = manifest.built(run, manifest.levels(n))
        for level, nodes in enumerate(tree(run)):
            for i, digest_ in enumerate(nodes):
                placed[manifest.position(level, i, n)] = digest_
        assert [placed[i] for i in range(len(log))] == log and len(placed) == len(log)


def test_manifest_sql(spark):
    check(spark, "op11_manifest", "documents")


# ------------------------------------------------------------------ nearest neighbours

VECTOR = "vec_id long, embedding array<float>"


def proper(v):
    return bool(v) and None not in v and all(math.isfinite(x) for x in v) and any(v)


def brute_neighbours(rows, k=20):
    own = {}
    for i, v in rows:
        if i is not None and proper(v):
            v = np.array(v, np.float32).astype(np.float64)
            if i not in own or v.tolist() < own[i].tolist():
                own[i] = v
    out = {}
    for i, v in own.items():
        if i % 20 == 0:
            near = sorted((-float(w @ v), j) for j, w in own.items() if j != i and len(w) == len(v))
            out[i] = [(j, -s) for s, j in near[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got = out.setdefault(r["query_id"], [])
        got.append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got)
    return out


def recall(got, want):
    return sum(len({j for j, _ in got.get(q, ())} & {j for j, _ in w}) for q, w in want.items()) / max(1, sum(map(len, want.values())))


def scattered(n, dim, seed, clusters=6):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 1, (clusters, dim))
    x = middles[rng.integers(0, clusters, n)] + rng.normal(0, 1.2, (n, dim))
    return (x * rng.lognormal(0, 0.5, (n, 1))).astype(np.float32)


@pytest.mark.parametrize("dim, shard", [(64, 500), (64, 100_000), (10, 300), (130, 700)])
def test_neighbours_recall(spark, dim, shard):
    rows = [(i, v.tolist()) for i, v in enumerate(scattered(2400, dim, dim))]
    got, want = found(neighbours.search(frame(spark, rows, False, VECTOR), shard=shard)), brute_neighbours(rows)
    assert set(got) == set(want) and all(len(got[q]) == 20 for q in want)
    assert recall(got, want) >= 0.95
    scores = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    for q, near in got.items():
        assert near == sorted(near, key=lambda x: (-x[1], x[0])) and q not in {j for j, _ in near}
        assert all(s == pytest.approx(float(scores[q] @ scores[j]), rel=1e-12, abs=1e-12) for j, s in near)


def test_neighbours_of_a_hot_vector_and_odd_rows(spark):
    base = scattered(300, 64, 5).tolist()
    hot = base[0]
    rows = [(i, v) for i, v in enumerate(base)] + [(1000 + i, hot) for i in range(400)]
    rows += [(2000, None), (2020, []), (2040, [0.0] * 64), (2060, [1.0, None] + [0.0] * 62), (2080, [float("nan")] * 64),
             (2100, [float("inf")] * 64), (None, hot), (None, None), (20, base[20]), (40, base[41]), (-20, base[7]),
             (3000, [1.0, 2.0]), (3001, [2.0, 2.0]), (3002, [-1.0, 0.5]), (3003, [1.0, 2.0]), (3020, [1e30, 0.0]), (4000, [5.0])]
    got, want = found(neighbours.report(frame(spark, rows, True, VECTOR))), brute_neighbours(rows)
    assert {q for q in want if want[q]} == set(got)
    assert {len(got[q]) for q in got if q < 3000} == {20} and len(got[3000]) == 4 and len(got[3020]) == 4
    assert [j for j, _ in got[3000]] == [j for j, _ in want[3000]] == [3020, 3001, 3003, 3002]
    for q in (0, 1000, 1020, 1380):  # ties go to the smallest ids of a class
        assert [j for j, _ in got[q]][:20] == [j for j, _ in want[q]][:20]
    assert recall(got, want) >= 0.95


def test_neighbours_of_few_vectors(spark):
    assert neighbours.report(frame(spark, [], False, VECTOR)).collect() == []
    assert neighbours.report(frame(spark, [(20, [1.0, 2.0])], False, VECTOR)).collect() == []
    rows = [(20 * i, [float(i), 1.0]) for i in range(5)]
    got = found(neighbours.report(frame(spark, rows, False, VECTOR)))
    assert {q: [j for j, _ in n] for q, n in got.items()} == {q: [j for j, _ in n] for q, n in brute_neighbours(rows).items()}


def test_every_code_within_the_radius_is_retrieved_once():
    rng = np.random.default_rng(8)
    codes = rng.integers(0, 1 << 16, (400, 8)).astype(np.uint16)
    codes[200:] = codes[:200] ^ np.where(rng.random((200, 8)) < 0.5, 1 << rng.integers(0, 16, (200, 8)), 0).astype(np.uint16)
    shard = neighbours.Shard([[i] for i in range(400)], np.ones((400, 1)), codes)
    gaps = np.bitwise_count(codes[:, None] ^ codes[None, :50]).sum(2).T
    for radius in (0, 1, 5, 7, 8, 20, 43, 60, 128):
        q, rows = shard.within(codes[:50], np.full(50, radius))
        pairs = list(zip(q.tolist(), rows.tolist()))
        assert len(pairs) == len(set(pairs)) and set(pairs) == set(zip(*map(np.ndarray.tolist, np.nonzero(gaps <= radius))))
    q, rows = shard.widening(codes[:50], 30)
    assert (np.bincount(q, minlength=50) >= 30).all() and len(set(zip(q.tolist(), rows.tolist()))) == len(q)


# ------------------------------------------------------------------ clustering

def brute_centroids(rows, k=8, rounds=10, dim=64):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and None not in v and all(math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    middles = [list(v) for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(middles))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for c, members in groups.items():
            middles[c] = [sum(x) // len(members) for x in zip(*members)]
    out = [(i, *nearest(v)[::-1]) for i, v in kept]
    sums = {c: sum(d for _, x, d in out if x == c) for c in range(len(middles))}
    return [(i, c, d, sums[c], sum(sums.values()), hashlib.sha256(",".join(map(str, middles[c])).encode()).hexdigest()) for i, c, d in out]


def same_clusters(spark, rows, clashing=False):
    got = [tuple(r) for r in centroids.report(frame(spark, rows, clashing, VECTOR)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_centroids(rows)))
    return got


def test_centroids(spark):
    x = scattered(260, 64, 9).tolist()
    rows = [(i * 3, v) for i, v in enumerate(x)] + [(5000 + i, x[0]) for i in range(150)]
    rows += [(6000, None), (6001, []), (6002, x[1][:63]), (6003, x[1] + [0.0]), (6004, [None] + x[1][1:]), (6005, [float("nan")] + x[1][1:]),
             (6006, [float("-inf")] + x[1][1:]), (6007, [0.0] * 64), (3, x[2]), (3, x[1]), (None, x[4]), (None, None), (-9, [-0.0004] * 64)]
    assert len(same_clusters(spark, rows, True)) == 260 + 150 + 5


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5] * 64)], [(i, [0.25] * 64) for i in range(30)]])
def test_centroids_of_few_vectors(spark, rows):
    same_clusters(spark, rows)


def test_dictionaries_lose_nothing():
    rng = np.random.default_rng(10)
    for x in (rng.integers(-300, 300, (500, 64)), np.repeat(rng.integers(-9, 9, (5, 64)), 100, 0), rng.integers(0, 2, (300, 64)), np.zeros((1, 64), np.int64)):
        blocks = centroids.dictionaries(x)
        assert (np.concatenate([entries[codes] for _, entries, codes in blocks], 1) == x).all()
        middles = rng.integers(-300, 300, (8, 64))
        assert (centroids.distances(blocks, len(x), middles) == ((x[:, None] - middles) ** 2).sum(2)).all()
    assert len(centroids.dictionaries(np.repeat(rng.integers(-9, 9, (5, 64)), 100, 0))) == 1  # copies: one wide block


def test_components_beyond_a_long_raise(spark):
    with pytest.raises(Exception, match="too large"):
        centroids.report(frame(spark, [(1, [1e30] * 64)], False, VECTOR)).collect()


def test_centroids_sql(spark):
    check(spark, "op13_centroids", "embeddings")

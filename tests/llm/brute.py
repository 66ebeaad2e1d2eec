"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re

WORDS = re.compile("[^ \t-\r]+")
BENCH_WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def reach(nodes, links) -> dict:
    """node -> smallest node that it is connected to."""
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def shingles(text: str | None, n: int = 5) -> set:
    w = WORDS.findall(lower(text))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def jaccard_components(docs: dict) -> dict:
    sets = {i: shingles(t) for i, t in docs.items()}
    ids = sorted(docs)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k]
             if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return reach(ids, links)


def substring_removal(docs: dict, n: int = 13) -> dict:
    words = {i: WORDS.findall(t or "") for i, t in docs.items()}
    first: dict = {}
    for i in sorted(words):
        for k in range(len(words[i]) - n + 1):
            first.setdefault(tuple(words[i][k:k + n]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k:k + n])] < i:
                gone[k:k + n] = [True] * n
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def contamination(docs: dict, items: dict, n: int = 10) -> dict:
    windows: dict = {}
    for i, t in items.items():
        w = BENCH_WORDS.findall(lower(t))
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[k:k + size]), set()).add(str(i))
    out = {}
    for i, t in docs.items():
        w = BENCH_WORDS.findall(lower(t))
        hit, names = [False] * len(w), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k:k + size]) in windows:
                    hit[k:k + size] = [True] * size
                    names |= windows[tuple(w[k:k + size])]
        out[i] = (len(w), sum(hit), len(names), sha(",".join(sorted(names))), any(hit))
    return out


def line_removal(rows: list, edits: int, least: int) -> list:
    """(id, n_lines, n_removed, digest) of rows (id, text) with different ids."""
    strip = " \t\r\x0b\x0c"
    lines = {l.strip(strip) for _, t in rows for l in (t or "").split("\n")}
    lines = sorted(l for l in lines if len(l) >= least)
    links = [(a, b) for k, a in enumerate(lines) for b in lines[:k]
             if abs(len(a) - len(b)) <= edits and edit_distance(a, b) <= edits]
    low = reach(lines, links)
    first: dict = {}
    for i, t in rows:
        for k, l in enumerate((t or "").split("\n")):
            l = l.strip(strip)
            if l in low:
                place = (i is None, i or 0, k)
                first[low[l]] = min(first.get(low[l], place), place)
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, 0, 0, sha("")))
            continue
        every = t.split("\n")
        kept = [l for k, l in enumerate(every)
                if l.strip(strip) not in low or first[low[l.strip(strip)]] == (i is None, i or 0, k)]
        out.append((i, len(every), len(every) - len(kept), sha("\n".join(kept))))
    return out

"""Small hostile documents: copies, near copies, shared passages, nulls, long texts."""

from __future__ import annotations

import random

#: Columns of other tables' and the operators' own names.
CLASHING = ["id", "key", "tag", "line", "n", "size", "component", "gone", "hits", "rep", "at", "block", "score"]


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{int(rng.paretovariate(0.6)) % vocabulary}" for _ in range(n)]


def documents(seed: int = 5, n: int = 80) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    base = [words(rng, rng.choice((3, 4, 5, 12, 40, 150, 600))) for _ in range(n // 2)]
    passage = words(rng, 60, 5000)
    out: list[tuple[int, str | None]] = []
    for i in range(n):
        w = list(base[rng.randrange(len(base))])
        for _ in range(rng.choice((0, 0, 1, 2, 8))):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        if rng.random() < 0.3:
            w[len(w) // 2:len(w) // 2] = passage
        if rng.random() < 0.1:
            w = ["aa"] * rng.randrange(1, 90)
        out.append((i * 3, rng.choice((" ", "\n", "  \t")).join(w)))
    out += [(1, None), (2, ""), (4, " \n\t "), (5, "é " * 30), (7, "Ab aB AB ab " * 20), (8, "ab AB ab aB " * 20),
            (10, "word " * 20_000), (11, "z" * 200_000)]
    return out


def frame(spark, rows, clashing: bool = False, names: str = "doc_id long, text string"):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, names)
    return df.withColumns({c: F.lit(7) for c in CLASHING}) if clashing else df

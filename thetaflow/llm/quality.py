"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  Each passage is encoded
by what its characters and words look like (shares of character classes,
repetition, word lengths), then by a learned layer.  A gated attention,
softmax over the document's passages of w . (tanh(V h) * sigmoid(U h)), weighs
them; the score is a logistic function of the weighted sum.  Only document
labels are needed: which passages matter is learned with the rest.

The model is fitted on a sample of labelled documents, at most ``sample``
of them, of at most ``sample_chars`` characters each, those with the smallest
hashes of their ids.  That bound is the only one: every passage of every text
is scored, in one pass without a shuffle.

Inputs of a score are the text's passages alone.  Defined results: null, empty and
word-free texts are one empty passage, which has a score like any other;
labels that are null or whose document is missing are not learned from;
repeated labels of a document count by their mean; without labels of both
kinds every score is the share of label 1 (0.5 without labels); rows are
scored one by one; an empty table gives an empty one; other columns,
whatever their names, are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thetaflow.llm.common import hashed_words, text_runs

PASSAGE = 64
SAMPLE = 2000
SAMPLE_CHARS = 60_000
THRESHOLD = 0.3

# ---------------------------------------------------------------------- encoding

_CLASSES = ["a-z", "A-Z", "0-9", "space", "\n", ".", ",", "!", "?", "|", "#", "%", "&", "*", "$", "-", "'\"", "/\\",
            "@", ":;", "()[]{}<>", "=+_~^`", "control", "lead", "tail"]
_SPACE, _NEWLINE = _CLASSES.index("space"), _CLASSES.index("\n")


def _class_of(b: int) -> int:
    c = chr(b)
    if b >= 0x80:
        return _CLASSES.index("tail" if b < 0xC0 else "lead")
    for name, inside in (("a-z", "a" <= c <= "z"), ("A-Z", "A" <= c <= "Z"), ("0-9", "0" <= c <= "9"),
                         ("\n", c == "\n"), ("space", c in " \t\r\x0b\x0c")):
        if inside:
            return _CLASSES.index(name)
    return next((i for i, name in enumerate(_CLASSES) if i > _NEWLINE and c in name and len(name) < 9 and not name.isalpha()),
                _CLASSES.index("control"))


_CLASS = np.array([_class_of(b) for b in range(256)], np.uint8)
_WHITE = np.isin(_CLASS, (_SPACE, _NEWLINE))
N_FEATURES = len(_CLASSES) + 8


def encode(texts: list[bytes], passage: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Passage features, in document order, and where each document's passages start."""
    sizes = np.array([len(t) + 1 for t in texts])
    data = b" ".join(texts) + b" "
    raw = np.frombuffer(data, np.uint8)
    white = _WHITE[raw]
    starts = np.flatnonzero(~white & np.r_[True, white[:-1]])
    stops = np.flatnonzero(white & np.r_[False, ~white[:-1]])
    length = (stops - starts).astype(np.float64)
    ends = np.cumsum(sizes)
    doc = np.searchsorted(ends, starts, side="right")
    count = np.bincount(doc, minlength=len(texts))
    bags = np.maximum(1, -(-count // passage))
    first = np.r_[0, np.cumsum(bags)]
    n = int(first[-1])
    place = np.arange(len(starts)) - np.r_[0, np.cumsum(count)[:-1]][doc]
    of_word = first[doc] + place // passage
    # white space before a text's first word belongs to its first passage
    of_byte = np.maximum(np.repeat(np.r_[0, of_word], np.diff(np.r_[0, starts, len(raw)])), np.repeat(first[:-1], sizes))
    shape = np.bincount(of_byte * len(_CLASSES) + _CLASS[raw], minlength=n * len(_CLASSES)).reshape(n, -1).astype(float)
    newlines = shape[:, _NEWLINE].copy()
    shape[:, (_SPACE, _NEWLINE)] = 0
    shape /= shape.sum(1, keepdims=True) + 1

    words = np.bincount(of_word, minlength=n).astype(float)
    total = np.maximum(words, 1)
    names = hashed_words(texts)[0]
    order = np.lexsort((names, of_word))
    new = np.r_[True, (names[order][1:] != names[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])][:len(order)]
    distinct = np.bincount(of_word[order][new], minlength=n)
    again = (names[1:] == names[:-1]) & (of_word[1:] == of_word[:-1])
    again = np.bincount(of_word[1:][again], minlength=n)
    mean = np.bincount(of_word, length, n) / total
    spread = np.sqrt(np.maximum(np.bincount(of_word, length ** 2, n) / total - mean ** 2, 0))
    capital = np.bincount(of_word[_CLASS[raw[starts]] == 1], minlength=n) / total
    longest = np.zeros(n)
    np.maximum.at(longest, of_word, length)
    extra = [np.log1p(words), distinct / total, again / total, mean / 10, spread / 10, capital,
             np.minimum(newlines / total, 5), np.log1p(longest)]
    return np.column_stack([np.sqrt(shape), *extra]).astype(np.float32), first[:-1]


# ------------------------------------------------------------------------- model

def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


@dataclass
class Model:
    """Gated-attention multiple-instance learning on passage features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ w["H"] + w["h"])
        v, u = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        logit = (v * u) @ w["w"]
        bag = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(x)]))
        e = np.exp(logit - np.maximum.reduceat(logit, starts)[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"x": x, "h": h, "v": v, "u": u, "bag": bag, "a": a, "z": z, "p": _sigmoid(z @ w["c"] + w["d"][0])}

    def score(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(starts), self.constant)
        return self.forward(x.astype(float), starts)["p"]

    def gradients(self, f: dict[str, np.ndarray], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        d = (f["p"] - y) * weight
        dz = d[:, None] * w["c"]
        from_bag = dz[f["bag"]]
        da = (from_bag * f["h"]).sum(1)
        mean = np.bincount(f["bag"], f["a"] * da, len(y))
        ds = f["a"] * (da - mean[f["bag"]])
        dv = ds[:, None] * w["w"] * f["u"] * (1 - f["v"] ** 2)
        du = ds[:, None] * w["w"] * f["v"] * f["u"] * (1 - f["u"])
        dh = (f["a"][:, None] * from_bag + dv @ w["V"].T + du @ w["U"].T) * (1 - f["h"] ** 2)
        return {"H": f["x"].T @ dh, "h": dh.sum(0), "V": f["h"].T @ dv, "U": f["h"].T @ du,
                "w": (f["v"] * f["u"]).T @ ds, "c": f["z"].T @ d, "d": np.array([d.sum()])}


def fit(x: np.ndarray, starts: np.ndarray, y: np.ndarray, hidden: int = 16, gate: int = 8, steps: int = 200,
        rate: float = 0.03, decay: float = 1e-3, seed: int = 7) -> Model:
    """Adam on all bags at once; deterministic."""
    if not len(y) or len(set((y >= 0.5).tolist())) < 2:
        return Model(np.zeros(0), np.zeros(0), {}, float(y.mean()) if len(y) else 0.5)
    x = x.astype(float)
    rng = np.random.default_rng(seed)
    shape = {"H": (x.shape[1], hidden), "h": (hidden,), "V": (hidden, gate), "U": (hidden, gate), "w": (gate,),
             "c": (hidden,), "d": (1,)}
    weights = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in ("h", "d") else np.zeros(s) for k, s in shape.items()}
    model = Model(x.mean(0), x.std(0) + 1e-3, weights)
    weight = np.full(len(y), 1 / len(y))
    m, v = {k: np.zeros(s) for k, s in shape.items()}, {k: np.zeros(s) for k, s in shape.items()}
    for t in range(1, steps + 1):
        g = model.gradients(model.forward(x, starts), y, weight)
        for k in weights:
            grad = g[k] + (decay * weights[k] if k not in ("h", "d") else 0)
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad ** 2
            step = rate * (0.5 + 0.5 * np.cos(np.pi * t / steps))
            weights[k] -= step * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
    return model


# -------------------------------------------------------------------- Spark steps

def held_out(id_col: Column) -> Column:
    """Documents that labels are never learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Model:
    marks = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"))
             .where(F.col("y").isNotNull() & ~held_out(F.col("id"))).groupBy("id").agg(F.avg("y").alias("y"))
             .orderBy(F.xxhash64("id"), "id").limit(sample))
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .join(F.broadcast(marks), "id")  # sample rows at most
            .where(F.coalesce(F.length("text"), F.lit(0)) <= sample_chars)
            .select("id", "text", "y").mapInArrow(_features, "id long, y double, x binary")
            .orderBy("id", "x").limit(sample).collect())
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES) for r in rows]
    starts = np.cumsum([0] + [len(b) for b in bags])[:-1]
    return fit(np.concatenate(bags) if bags else np.zeros((0, N_FEATURES)), starts, np.array([r["y"] for r in rows]))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in text_runs(batches):
        x, starts = encode(texts)
        ends = np.r_[starts[1:], len(x)]
        yield pa.RecordBatch.from_arrays(
            [part.column(0).cast(pa.int64()), part.column(2), pa.array([x[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())],
            names=["id", "y", "x"])


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part, texts in text_runs(batches):
            scores = model.score(*encode(texts))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=["id", "score"])
    return run


def _keeps(shared, at: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part, texts in text_runs(batches, at):
            yield part.filter(pa.array(model.score(*encode(texts)) >= threshold))
    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(_scores(shared), f"id {kind}, score double")


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents, with their columns, that score ``threshold`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_keeps(shared, docs.columns.index(text_col), threshold), docs.schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of query ``op5_quality``."""
    scored = score(docs, train(docs, labels))
    return scored.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

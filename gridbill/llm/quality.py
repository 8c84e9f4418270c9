"""Quality by attention-based multiple-instance learning (operator 5).

A document is a bag of passages (runs of words). Each passage is encoded (shape
statistics, then a learned layer); a gated attention, learned from the documents'
labels alone, weighs the passages; the weighted sum of their representations is
the document's, and a logistic layer scores it. Training is numpy on a bounded
sample of labelled documents; scoring covers every passage of every document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridbill.llm import common, sample

#: Labelled rows for training: at most so many of each label.
MOST = {1: 1200, 0: 800}
PASSAGE = 64
HIDDEN, GATE, STEPS, RATE = 16, 8, 150, 0.03
THRESHOLD = 0.3
FEATURES = 13

#: Class of each byte: 0 other symbols, 1 lower case, 2 upper case, 3 digit, 4 white space, 5 sentence marks, 6 beyond ASCII.
_CLASS = np.zeros(256, np.int64)
for _k, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:?'\"()-", bytes(range(128, 256)))):
    _CLASS[list(_bytes)] = _k + 1


def passages(text: str | None) -> np.ndarray:
    """One row of statistics for each run of ``PASSAGE`` words; a text without words has one row of zeros."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    if not n:
        return np.zeros((1, FEATURES))
    kinds = _CLASS[np.frombuffer(data, np.uint8)]
    inside = kinds != 4
    starts = np.flatnonzero(inside & np.r_[True, ~inside[:-1]])
    count = -(-n // PASSAGE)
    of = (np.searchsorted(starts, np.arange(len(data)), "right") - 1).clip(0) // PASSAGE
    shares = np.bincount(of * 7 + kinds, minlength=count * 7).reshape(count, 7).astype(float)
    total = shares.sum(1, keepdims=True)
    size = np.full(count, PASSAGE)
    size[-1] = n - PASSAGE * (count - 1)
    codes = np.fromiter(map(hash, words), np.int64, n)
    again = np.r_[False, codes[1:] == codes[:-1]].astype(float)
    lengths = np.fromiter(map(len, words), np.int64, n)
    cut = np.arange(count) * PASSAGE
    order = np.lexsort((codes, np.arange(n) // PASSAGE))
    new = np.r_[True, codes[order][1:] != codes[order][:-1]]
    new[cut] = True
    return np.c_[
        shares / total,
        np.add.reduceat(again, cut) / size,
        np.add.reduceat(new.astype(float), cut) / size,
        np.add.reduceat(lengths, cut) / size / 10,
        np.maximum.reduceat(lengths, cut).clip(0, 100) / 50,
        np.add.reduceat((lengths <= 1).astype(float), cut) / size,
        np.log1p(size) / 5,
    ]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Weights, and the scaling of the statistics."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0, s[0] ** -0.5, s)
        self.mean, self.scale = mean, scale
        self.w = {"W": draw(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "g": draw(GATE), "c": draw(HIDDEN), "d": np.zeros(1)}

    def forward(self, x: np.ndarray, start: np.ndarray, bag: np.ndarray) -> dict:
        """Scores of bags; row ``i`` of ``x`` belongs to bag ``bag[i]``, whose rows begin at ``start``."""
        w, s = self.w, {"x": (x - self.mean) / self.scale}
        s["h"] = np.tanh(s["x"] @ w["W"] + w["b"])
        s["t"], s["s"] = np.tanh(s["h"] @ w["V"]), _sigmoid(s["h"] @ w["U"])
        e = (s["t"] * s["s"]) @ w["g"]
        e = np.exp(e - np.maximum.reduceat(e, start)[bag])
        s["a"] = (e / np.add.reduceat(e, start)[bag])[:, None]
        s["z"] = np.add.reduceat(s["a"] * s["h"], start)
        s["p"] = _sigmoid(s["z"] @ w["c"] + w["d"])
        return s

    def gradients(self, s: dict, start: np.ndarray, bag: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        """Of the weighted cross-entropy."""
        w, dl = self.w, weight * (s["p"] - y)
        dz = (dl[:, None] * w["c"])[bag]
        da = (s["h"] * dz).sum(1, keepdims=True)
        de = s["a"] * (da - np.add.reduceat(s["a"] * da, start)[bag])
        dg = de * w["g"]
        dt, ds = dg * s["s"] * (1 - s["t"] ** 2), dg * s["t"] * s["s"] * (1 - s["s"])
        dh = (s["a"] * dz + dt @ w["V"].T + ds @ w["U"].T) * (1 - s["h"] ** 2)
        return {"W": s["x"].T @ dh, "b": dh.sum(0), "V": s["h"].T @ dt, "U": s["h"].T @ ds, "g": ((s["t"] * s["s"]).T @ de)[:, 0], "c": s["z"].T @ dl, "d": dl.sum(keepdims=True)}

    def attention(self, text: str | None) -> np.ndarray:
        """The weight of each passage of a text."""
        x = passages(text)
        return self.forward(x, np.zeros(1, int), np.zeros(len(x), int))["a"][:, 0]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x, start, bag = _bags(texts)
        return self.forward(x, start, bag)["p"]


class Constant:
    """The model of a sample without both labels: the share of label 1, or 0 where there are no rows."""

    def __init__(self, share: float):
        self.share = share

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return np.full(len(texts), self.share)


def _bags(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bags = [passages(t) for t in texts]
    sizes = np.array([len(b) for b in bags])
    return np.concatenate(bags), np.cumsum(sizes) - sizes, np.repeat(np.arange(len(bags)), sizes)


def train(rows: list[tuple[int, int, str]], counts: dict[int, int]) -> Model | Constant:
    """Adam over the whole sample; rows weigh as the labels' shares among all labelled rows demand."""
    y = np.array([label for _, label, _ in rows], float)
    if len({*y.tolist()}) < 2:
        return Constant(float(y.mean()) if len(y) else 0.0)
    x, start, bag = _bags([t for _, _, t in rows])
    weight = np.where(y == 1, counts[1] / y.sum(), counts[0] / (1 - y).sum())
    weight /= weight.sum()
    model = Model(x.mean(0), x.std(0) + 1e-6)
    first, second = ({k: np.zeros_like(v) for k, v in model.w.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        grads = model.gradients(model.forward(x, start, bag), start, bag, y, weight)
        for k, g in grads.items():
            g = g + 1e-5 * model.w[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            model.w[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def score(df: DataFrame, model: Model | Constant, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each whole text, from 0 to 1; a null text counts as an empty one."""

    def make():
        return lambda b: pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(b.column(1).to_pylist()), pa.float64())], [id_col, "score"])

    return common.map_batches(df.select(id_col, text_col), text_col, make, f"`{id_col}` bigint, score double", 1 << 20)


def fit(documents: DataFrame, labels: DataFrame) -> Model | Constant:
    """Learn from labelled rows whose crc32(doc_id as text) mod 5 is not 0; at most ``MOST`` rows of each label."""
    return train(*sample.labelled(documents, labels, "quality", sample.fold(5) != 0, MOST))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: whether its label was held out, score and decision."""
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    model = fit(docs, common.table(spark, sf_dir, "labels", "doc_id", "quality"))
    return score(docs, model).select(
        "doc_id", F.coalesce(sample.fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )

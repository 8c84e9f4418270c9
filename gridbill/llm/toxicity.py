"""Toxicity by compression distance (operator 4).

Two zstandard dictionaries are made from a bounded sample of labelled documents:
one of ordinary text, and one of toxic text, whose content comes on top of the
ordinary one (toxic documents are mostly ordinary words). A text is cut into
windows of a few words; each window is compressed with either dictionary. Where
the toxic dictionary saves bytes, the window holds what toxic text has and
ordinary text lacks. The savings of all windows make the document's score through
a logistic regression and a threshold calibrated on sample rows that the
dictionaries have not seen.

The dictionaries are raw content (lists of words), not the output of zstandard's
trainer: that one keeps what is frequent in its samples, which is ordinary words in
toxic text too. README gives held-out figures of trained dictionaries of several sizes.
What a dictionary holds is chosen by the number of different contexts (preceding
words) of a word rather than by its count: a passage copied into many documents
has one context however often it occurs.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridbill.llm import common, sample

#: Labelled rows for training: at most so many toxic and ordinary ones.
MOST = {1: 1600, 0: 3200}
WINDOW = 48
LEVEL = 12
ORDINARY_BYTES = 128 << 10
#: Sizes of the toxic dictionary's own content; the one that ranks the calibration rows best is taken.
TOXIC_BYTES = (500, 1000, 2000)
THRESHOLD = 0.3
MARKS = b".,;:!?\"'()[]|"


def prepared(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


def windows(words: list[bytes], size: int = WINDOW) -> list[bytes]:
    """Consecutive words, at least ``size`` bytes in each window but the last."""
    out, now, n = [], [b""], 0
    for w in words:
        now.append(w)
        n += len(w) + 1
        if n >= size:
            out.append(b" ".join(now))
            now, n = [b""], 0
    if n:
        out.append(b" ".join(now))
    return out


def contexts(texts: list[list[bytes]]) -> dict[bytes, int]:
    """Different preceding words of each word."""
    seen = defaultdict(set)
    for words in texts:
        for before, w in zip([b"", *words], words, strict=False):
            seen[w.strip(MARKS)].add(before)
    return {w: len(s) for w, s in seen.items() if len(w) > 1}


def content(words: list[bytes], size: int) -> bytes:
    """Dictionary content of at most ``size`` bytes, the first words last (nearest to the text)."""
    out, n = [], 0
    for w in words:
        n += len(w) + 1
        if n > size:
            break
        out.append(b" " + w)
    return b"".join(reversed(out))


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    calibration: tuple | None = None

    def compressors(self) -> tuple:
        return common.held(("toxicity", self.ordinary, self.toxic), lambda: (_compressor(self.ordinary), _compressor(self.toxic + self.ordinary)))

    def features(self, text: str | None) -> list[float]:
        """Savings over the windows: mean, largest, sum over the root of the number, shares of 2 and 3 bytes."""
        plain, toxic = self.compressors()
        d = np.array([len(plain.compress(w)) - len(toxic.compress(w)) for w in windows(prepared(text))], float)
        if not len(d):
            return [0.0] * 6
        return [d.mean(), d.max(), d.sum() / math.sqrt(len(d)), (d >= 2).mean(), (d >= 3).mean(), math.log1p(np.clip(d, 0, None).sum())]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.calibration is None:
            return np.zeros(len(texts))
        return sample.probability(self.calibration, np.array([self.features(t) for t in texts]).reshape(-1, 6))


def _compressor(data: bytes) -> zstandard.ZstdCompressor:
    how = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, source_size=64, dict_size=len(data), format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0
    )
    held = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=how)


def train(rows: list[tuple[int, int, str]], counts: dict[int, int]) -> Model:
    """A model from (id, label, text); half of the rows make the dictionaries, the other half the calibration.

    Without rows of both labels in both halves there is nothing to learn, and every score is 0.
    """
    texts = [(prepared(t), t, y) for _, y, t in rows]
    build, held = texts[::2], texts[1::2]
    y = np.array([x[2] for x in held])
    if len({x[2] for x in build}) < 2 or len({*y.tolist()}) < 2:
        return Model(b" ", b" ")
    toxic, plain = (contexts([w for w, _, label in build if label == k]) for k in (1, 0))
    ratio = sum(x[2] for x in build) / sum(1 - x[2] for x in build)
    expected = lambda w: plain.get(w, 0) * ratio + 0.5
    telling = sorted((w for w, k in toxic.items() if k >= 3 and len(w) > 2 and k > 4 * expected(w)), key=lambda w: (-toxic[w] * math.log(toxic[w] / expected(w)), w))
    ordinary = content(sorted(plain, key=lambda w: (-plain[w], w)), ORDINARY_BYTES) or b" "
    weight = np.array([counts[k] / (y == k).sum() for k in y.tolist()])
    weight *= len(y) / weight.sum()
    best = (-1.0, Model(ordinary, b" "))
    for size in TOXIC_BYTES:
        m = Model(ordinary, content(telling, size) or b" ")
        x = np.array([m.features(t) for _, t, _ in held])
        fitted = sample.logistic(x, y, weight)
        best = max(best, (sample.auc(sample.probability(fitted, x), y), Model(m.ordinary, m.toxic, fitted)), key=lambda b: b[0])
    return best[1]


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each whole text, from 0 to 1; a null or empty text has no windows and gets the score of no savings."""

    def make():
        return lambda b: pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(b.column(1).to_pylist()), pa.float64())], [id_col, "score"])

    return common.map_batches(df.select(id_col, text_col), text_col, make, f"`{id_col}` bigint, score double", 4 << 20)


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """Learn from labelled rows whose crc32(doc_id as text) mod 4 is not 2; at most ``MOST`` rows of each label."""
    return train(*sample.labelled(documents, labels, "toxic", sample.fold(4) != 2, MOST))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: whether its label was held out, score and decision."""
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    model = fit(docs, common.table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return score(docs, model).select(
        "doc_id", F.coalesce(sample.fold(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )

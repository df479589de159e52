"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader updates.

Features are counts of hashed words, word shapes and pairs of either, with one for a word that repeats the one
before. A text's score is the sigmoid of a sparse dot product over the length of its feature vector's square root.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, coded, labelled_sample, mix, slices, sums, texts, tidy, word_hashes, words

BITS = 18
_SHAPES = [(re.compile(r"[^\W\d_]*[a-zß-ÿ][^\W\d_]*"), "a"), (re.compile(r"[^\W\d_]+"), "A"), (re.compile(r"\d+"), "9")]


_LOWER = re.compile("[a-zß-ÿ]").search


def shape(word: str) -> str:
    """Runs of letters as a (some lower case) or A (none), of digits as 9; other characters stay, repeats shortened."""
    if word.isalpha():
        return "a" if _LOWER(word) else "A"
    out = []
    for run in re.findall(r"[^\W\d_]+|\d+|[\W_]", word):
        kind = next((k for pattern, k in _SHAPES if pattern.fullmatch(run)), run)
        if out[-2:] != [kind, kind]:
            out.append(kind)
    return "".join(out)


def hashes(distinct: list[str]) -> np.ndarray:
    """Hash of each lower-cased word and of its shape."""
    return np.stack([word_hashes([w.lower() for w in distinct]), word_hashes(["\0" + shape(w) for w in distinct])], axis=1)


class Features:
    def __init__(self, bits: int = BITS):
        self.mask, self.memo = np.uint64((1 << bits) - 1), Memo(hashes, 2, np.uint64)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of texts, and five features of each word (the last text's end has none): [word, 5]."""
        offsets, flat = words(column)
        codes, distinct = coded(flat)
        if not distinct:
            return offsets, np.zeros((0, 5), np.int64)
        h = self.memo(distinct)[codes]
        before = np.roll(h, 1, axis=0)
        before[offsets[:-1][offsets[:-1] < len(h)]] = np.uint64(1)
        same = np.where(before[:, 0] == h[:, 0], np.uint64(11), np.uint64(12))
        five = [mix(h[:, 0]), mix(h[:, 1] + np.uint64(3)), mix(before[:, 0] * np.uint64(5) + h[:, 0]), mix(before[:, 1] * np.uint64(7) + h[:, 1]), mix(same)]
        return offsets, np.stack([(x & self.mask).astype(np.int64) for x in five], axis=1)


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, column: pa.Array, features: Features) -> np.ndarray:
        offsets, five = features(column)
        dot = sums(self.weights[five].sum(axis=1), offsets)
        return 1 / (1 + np.exp(-np.clip(self.bias + dot / np.sqrt(np.maximum(1, 5 * np.diff(offsets))), -40, 40)))


def train(samples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = BITS, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 0.01, epochs: int = 3) -> Model:
    """FTRL-proximal (McMahan et al., 2013), one update for each text in a fixed shuffled order; the last feature is the bias."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(at):
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(samples)):
            at, x = samples[k]
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -40, 40))) - labels[k]) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weights(np.arange(len(z)))
    return Model(w[:-1], float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", text_col: str = "text", key: str = "doc_id", per_label: int = 3000, longest: int = 20_000, bits: int = BITS) -> Model | None:
    """A model from the texts of docs that labels marks 0 or 1; None without any.

    The fit sees about per_label rows of each label, chosen by a hash of key, and of a text over `longest` characters
    a stretch of so many: that bounds what reaches the driver. Scoring has no such bounds.
    """
    got = labelled_sample(docs, labels, label_col, key, text_col, per_label, longest).toPandas().sort_values([key, text_col], kind="stable")
    if not len(got):
        return None
    features, samples = Features(bits), []
    for at in range(0, len(got), 500):
        offsets, five = features(pa.array(got[text_col][at : at + 500], pa.string()))
        for a, b in zip(offsets[:-1], offsets[1:]):
            ids, count = np.unique(five[a:b], return_counts=True)
            samples.append((np.append(ids, 1 << bits), np.append(count / np.sqrt(max(1, 5 * (b - a))), 1.0)))
    return train(samples, got["label"].to_numpy(float), bits)


def score(docs: DataFrame, model: Model | None, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """id, score, predicted (1 if score >= threshold) and, if asked for, the text of each row, from its whole text alone.

    Null and empty texts have no words and get the bias's score; without a model each score is 0.5. A score equal to the
    threshold is predicted 1. Every row gives a row, ids may be null or repeat; other columns are ignored.
    """
    ids = docs.schema[id_col].dataType
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** bits numbers

    def apply(batches):
        model = shipped.value
        features = Features() if model is None else Features(int(np.log2(len(model.weights))))
        for whole in batches:
            for batch in slices(whole, "_text"):
                p = np.full(batch.num_rows, 0.5) if model is None else model.scores(texts(batch["_text"]), features)
                yield pa.RecordBatch.from_arrays([batch["_id"], pa.array(p), pa.array((p >= threshold).astype(np.int32)), *[batch["_text"]] * keep_text], ["_id", "score", "predicted", *["text"] * keep_text])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = T.StructType().add("_id", ids).add("score", "double").add("predicted", "integer")
    return rows.mapInArrow(tidy(apply), kind.add("text", "string") if keep_text else kind).withColumnRenamed("_id", id_col)

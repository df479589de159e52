"""Toxicity by maximum-scoring segments of token log-odds, calibrated by extreme-value statistics.

Token weights are log-odds of toxic against clean rows with an informative Dirichlet prior (Monroe et al., 2008): those
of significantly toxic tokens count for a passage, those of tokens typical of clean rows against it, and each word
that is not toxic costs a constant besides, so that passages end. A linear-time scan (Ruzzo and Tompa, 1999) finds all maximal scoring segments of a text. A segment of score s among n
words is expected K n exp(-lambda s) times by chance (Karlin and Altschul, 1990); the surprise of the significant
ones adds up to the text's evidence, and a logistic curve turns that into a score.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, coded, labelled_sample, slices, texts, tidy, words

PREFIXES = (4, 5, 6)
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def keys(word: str) -> list[str]:
    """The word in lower case without marks at its ends, and its prefixes."""
    w = _EDGE.sub("", word.lower())
    return [f"={w}", *(w[:n] for n in PREFIXES if len(w) >= n)] if w else []


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, sum) of a sequence, in linear time."""
    found: list[list] = []  # start, end, sum before it, sum with it
    total = 0.0
    for k, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        own = [k, k + 1, before, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= own[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= own[3]:
                own.append(j)
                found.append(own)
                break
            own = [found[j][0], own[1], found[j][2], own[3]]
            del found[j:]
    return [(a, b, r - l) for a, b, l, r, _ in found]


def squeezed(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sums of the runs that a scan needs: each positive score, and each run of others."""
    up = scores > 0
    head = np.flatnonzero(np.concatenate([[True], up[1:] | up[:-1]])) if len(scores) else np.zeros(0, np.int64)
    return head, np.add.reduceat(scores, head) if len(head) else scores


class Model:
    def __init__(self, weight: dict[str, float], rest: float, lam: float, k: float, curve: tuple[float, float]):
        self.weight, self.rest, self.lam, self.k, self.curve = weight, rest, lam, k, curve

    def words(self, distinct: list[str]) -> np.ndarray:
        get, rest, out = self.weight.get, self.rest, np.zeros((len(distinct), 1))
        for k, w in enumerate(distinct):
            own = [get(x, 0.0) for x in keys(w)]
            top = max(own, default=0.0)
            out[k] = top if top > 0 else rest + (own[0] if own else 0.0)
        return out

    def passages(self, column: pa.Array, memo: Memo) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """Words in each text, and its significant segments (first word, end, surprise)."""
        offsets, flat = words(column)
        codes, distinct = coded(flat)
        scores = memo(distinct)[codes, 0] if distinct else np.zeros(0)
        n, out = np.diff(offsets), [[] for _ in range(len(column))]
        hot = np.unique(np.searchsorted(offsets, np.flatnonzero(scores > 0), "right") - 1)
        for t in hot.tolist():
            own = scores[offsets[t] : offsets[t + 1]]
            head, runs = squeezed(own)
            chance = np.log(self.k * max(int(n[t]), 2))
            ends = np.append(head, len(own))
            out[t] = [(int(head[a]), int(ends[b]), float(self.lam * s - chance)) for a, b, s in segments(runs.tolist()) if self.lam * s > chance]
        return n, out

    def score(self, evidence: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * np.log1p(evidence) + b, -40, 40)))


def log_odds(toxic: Counter, clean: Counter, prior: float = 500.0, least_z: float = 3.0, least: float = 3.0) -> dict[str, float]:
    """Log-odds of tokens, a standard error nearer to zero; counts are of texts that have them.

    Above zero are only the significantly toxic ones, below zero those of which a standard error leaves something.
    """
    n1, n0 = sum(toxic.values()), sum(clean.values())
    out = {}
    for w in toxic.keys() | clean.keys():
        y1, y0 = toxic.get(w, 0), clean.get(w, 0)
        a = 0.5 + prior * (y1 + y0) / (n1 + n0)
        delta = np.log((y1 + a) / (n1 + prior - y1)) - np.log((y0 + a) / (n0 + prior - y0))
        error = np.sqrt(1 / (y1 + a) + 1 / (y0 + a))
        if delta / error > least_z and delta - error > least:
            out[w] = float(delta - error)
        elif delta + error < 0:
            out[w] = float(delta + error)
    return out


def decay(values: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share * exp(l * values)) = 1, for scores of negative mean."""
    low, high = 0.0, 1.0
    while (share * np.exp(high * values)).sum() < 1 and high < 64:
        low, high = high, 2 * high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (share * np.exp(mid * values)).sum() < 1 else (low, mid)
    return high


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", text_col: str = "text", key: str = "doc_id", per_label: int = 6000, longest: int = 20_000, rest: float = -0.7) -> Model | None:
    """A model from the texts of docs that labels marks 0 or 1; None without any.

    The fit sees about per_label rows of each label, chosen by a hash of key, and of a text over `longest` characters
    a stretch of so many: that bounds what reaches the driver. Scoring has no such bounds.
    """
    got = labelled_sample(docs, labels, label_col, key, text_col, per_label, longest).toPandas().sort_values([key, text_col], kind="stable")
    if not len(got):
        return None
    counts, by_key = Counter(), [Counter(), Counter()]  # of words in clean texts; of texts that have a token
    for text, label in zip(got[text_col], got["label"]):
        own = Counter(text.split())
        by_key[label].update({x for w in own for x in keys(w)})
        if not label:
            counts.update(own)
    weight = log_odds(by_key[1], by_key[0])
    model = Model(weight, rest, 1.0, 1.0, (1.0, 0.0))
    distinct = list(counts)
    values, share = (model.words(distinct)[:, 0], np.array([counts[w] for w in distinct], float)) if distinct else (np.array([rest]), np.ones(1))
    toxic = [x for x in weight.values() if x > 0]
    high = max(toxic, default=1.0)
    values, share = np.append(values, high), np.append(share, 1.0)  # a chance hit that the sample happens to lack
    model.lam = decay(values, share / share.sum())
    # K by the mean number of segments of clean texts over their expected number at the least positive score.
    model.k = max(1e-3, float((share * (values > 0)).sum() / share.sum() * np.exp(model.lam * max(min(toxic, default=1.0), 0.1))))
    memo, x = Memo(model.words, 1), []
    for at in range(0, len(got), 500):
        x += [sum(s for _, _, s in own) for own in model.passages(pa.array(got[text_col][at : at + 500], pa.string()), memo)[1]]
    model.curve = _logistic(np.log1p(np.array(x)), got["label"].to_numpy(float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> tuple[float, float]:
    """Slope and intercept by Newton's method."""
    a = np.stack([x, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        w = w - np.linalg.solve(h, a.T @ (p - y) + ridge * w)
    return float(max(w[0], 0.0)), float(w[1])


def score(docs: DataFrame, model: Model | None, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, predicted (1 if score >= threshold), evidence, passages of each row, from its whole text alone.

    passages: first word, end (exclusive) and surprise of each significant segment, in order. Null and empty texts
    have none. Without a model each score is 0. A score equal to the threshold is predicted 1. Every row gives a row,
    ids may be null or repeat; other columns are ignored.
    """
    ids = docs.schema[id_col].dataType
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # the significant tokens of a bounded sample
    kind = "array<struct<start:int,end:int,surprise:double>>"
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("surprise", pa.float64())]))

    def apply(batches):
        model = shipped.value
        memo = Memo(model.words, 1) if model else None
        for whole in batches:
            for batch in slices(whole, "_text"):
                found = model.passages(texts(batch["_text"]), memo)[1] if model else [[] for _ in range(batch.num_rows)]
                evidence = np.array([sum(s for _, _, s in own) for own in found], float)
                p = model.score(evidence) if model else np.zeros(batch.num_rows)
                listed = pa.array([[{"start": a, "end": b, "surprise": s} for a, b, s in own] for own in found], arrow)
                yield pa.RecordBatch.from_arrays([batch["_id"], pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(evidence), listed], ["_id", "score", "predicted", "evidence", "passages"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(tidy(apply), f"_id {ids.simpleString()}, score double, predicted int, evidence double, passages {kind}").withColumnRenamed("_id", id_col)

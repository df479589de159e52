"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum,
over all ways to cut it into pieces, of the product of their probabilities: a forward algorithm. Words are
independent, so a text's log-probability is the sum over its words. A word of any length is summed over all its
segmentations: a long one in blocks, each a linear map of the forward sums that enter it. Piece probabilities come
from expectation maximisation over the words of labelled rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, bounded_sample, coded, slices, stretch, sums, texts, tidy, words

START = "▁"
#: Characters of a block of a long word (short enough for the product of as many probabilities), and the bits of a filter.
BLOCK, FILTER = 32, 22
_B = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(file: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model, in the order of their ids."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=file)
    return [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))]


def _points(strings: list[str], width: int) -> np.ndarray:
    """Code points of each string plus one, 0 after its end."""
    flat = np.frombuffer("".join(s.ljust(width, "\0")[:width] for s in strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter((min(len(s), width) for s in strings), np.int64, len(strings))
    return np.where(np.arange(width) < size[:, None], flat.reshape(len(strings), width).astype(np.uint64) + np.uint64(1), np.uint64(0))


class Pieces:
    """The lattice of pieces in words. Piece number len(vocabulary) is any single character the vocabulary lacks."""

    def __init__(self, vocab: list[str]):
        vocab = [v for v in vocab if v]
        self.n, self.long = len(vocab), max(map(len, vocab), default=1)
        h = self._hashes(_points(vocab, self.long))
        own = h[np.fromiter(map(len, vocab), np.int64, len(vocab)) - 1, np.arange(len(vocab)), 0]
        self.order = np.argsort(own)
        self.sorted = own[self.order]
        self.some = np.zeros(1 << FILTER, bool)
        self.some[self._bits(own)] = True

    @staticmethod
    def _bits(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(29))) & np.uint64((1 << FILTER) - 1)).astype(np.int64)

    def _hashes(self, points: np.ndarray) -> np.ndarray:
        """[l - 1, word, i]: hash of the l characters from i."""
        n, width = points.shape
        out = np.zeros((min(self.long, width), n, width), np.uint64)
        for k in range(len(out)):
            out[k, :, : width - k] = points[:, k:] if not k else out[k - 1, :, : width - k] * _B + points[:, k:]
        return out

    def lattice(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths, and the piece numbers [l - 1, word, start]; -1 where there is none."""
        size = np.fromiter(map(len, strings), np.int64, len(strings))
        width = int(size.max())
        h = self._hashes(_points(strings, width))
        start, long = np.arange(width), np.arange(1, len(h) + 1)[:, None, None]
        inside = start + long <= size[:, None]
        piece = np.full(h.shape, -1, np.int32)
        at = np.flatnonzero(inside & self.some[self._bits(h)])
        own = h.reshape(-1)[at]
        found = np.minimum(np.searchsorted(self.sorted, own), self.n - 1)
        good = self.sorted[found] == own
        piece.reshape(-1)[at[good]] = self.order[found[good]]
        piece[0][(piece[0] < 0) & inside[0]] = self.n
        return size, piece


def _forward(piece: np.ndarray, p: np.ndarray) -> np.ndarray:
    """alpha[i]: probability of the first i characters, summed over segmentations; p: [piece, language], last row 0."""
    long, n, width = piece.shape
    alpha = np.zeros((width + 1, n, p.shape[1]))
    alpha[0] = 1
    for j in range(1, width + 1):
        for k in range(1, min(long, j) + 1):
            own = piece[k - 1, :, j - k]
            has = np.flatnonzero(own >= 0)
            if len(has):
                alpha[j, has] += alpha[j - k, has] * p[own[has]]
    return alpha


def _maps(piece: np.ndarray, ends: np.ndarray, p: np.ndarray) -> np.ndarray:
    """[block, language, to, from]: how the last `long` forward sums before a block give those at its end.

    piece: [l - 1, block, start], of blocks with the long - 1 characters before each; ends: their characters.
    """
    long, n, width = piece.shape
    alpha = np.zeros((width + 1, n, long, p.shape[1]))  # from long - 1 characters before the block on
    for k in range(long):
        alpha[k, :, k] = 1
    for j in range(long, width + 1):
        for k in range(1, long + 1):
            own = piece[k - 1, :, j - k]
            has = np.flatnonzero(own >= 0)
            if len(has):
                alpha[j, has] += alpha[j - k, has] * p[own[has]][:, None, :]
    return alpha[ends[:, None] + np.arange(long), np.arange(n)[:, None]].transpose(0, 3, 1, 2)


def _expected(piece: np.ndarray, size: np.ndarray, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected uses of each piece [piece, language]; weight: [word, language]."""
    alpha = _forward(piece, p)
    long, n, width = piece.shape
    beta = np.zeros_like(alpha)
    beta[size, np.arange(n)] = 1
    for i in range(width - 1, -1, -1):
        for k in range(1, min(long, width - i) + 1):
            own = piece[k - 1, :, i]
            has = own >= 0
            beta[i, has] += p[own[has]] * beta[i + k, has]
    total = weight / np.maximum(beta[0], 1e-300)
    out = np.zeros_like(p)
    for k in range(long):
        for i in range(width - k):
            own = piece[k, :, i]
            has = np.flatnonzero(own >= 0)
            np.add.at(out, own[has], alpha[i, has] * p[own[has]] * beta[i + k + 1, has] * total[has])
    return out


class Model:
    """languages, and log-likelihoods of words under each."""

    def __init__(self, vocab: list[str], languages: list[str], p: np.ndarray):
        self.pieces, self.languages, self.p = Pieces(vocab), languages, p

    def loglik(self, distinct: list[str]) -> np.ndarray:
        out = np.zeros((len(distinct), len(self.languages)))
        order = sorted((len(w), k) for k, w in enumerate(distinct))
        short = [k for n, k in order if n < BLOCK]
        for at in range(0, len(short), 4096):
            own = short[at : at + 4096]
            size, piece = self.pieces.lattice([START + distinct[k] for k in own])
            out[own] = np.log(np.maximum(_forward(piece, self.p)[size, np.arange(len(own))], 1e-300))
        long = [k for n, k in order if n >= BLOCK]
        out[long] = self.long([START + distinct[k] for k in long])
        return out

    def long(self, strings: list[str], at_once: int = 256) -> np.ndarray:
        """Log-likelihoods of words of any length: block after block, with the sums scaled between them."""
        lead = self.pieces.long - 1
        out = np.zeros((len(strings), len(self.languages)))
        blocks = [(k, a) for k, w in enumerate(strings) for a in range(0, len(w), BLOCK)]
        state = np.zeros((len(self.languages), lead + 1))
        for at in range(0, len(blocks), at_once):
            own = blocks[at : at + at_once]
            ends = np.array([min(BLOCK, len(strings[k]) - a) for k, a in own])
            _, piece = self.pieces.lattice([strings[k][max(0, a - lead) : a + BLOCK].rjust(lead + end, "\0") for (k, a), end in zip(own, ends.tolist())])
            piece[:, np.arange(piece.shape[2]) < np.array([max(0, lead - a) for _, a in own])[:, None]] = -1  # before the word
            for (k, a), m in zip(own, _maps(piece, ends, self.p)):
                if not a:
                    state = np.eye(lead + 1)[[lead] * len(self.languages)]
                state = np.einsum("lts,ls->lt", m, state)
                top = np.maximum(state.max(axis=1, keepdims=True), 1e-300)
                out[k] += np.log(top[:, 0])
                state = state / top
                if a + BLOCK >= len(strings[k]):
                    out[k] += np.log(np.maximum(state[:, -1], 1e-300))
        return out

    def scores(self, column: pa.Array, memo: Memo) -> np.ndarray:
        """Log-likelihood of each text under each language."""
        offsets, flat = words(column)
        codes, distinct = coded(flat)
        return sums(memo(distinct)[codes] if distinct else np.zeros((0, len(self.languages))), offsets)


def fit(rows: DataFrame, vocab_file: str, lang_col: str = "lang", text_col: str = "text", key: str = "doc_id", per_language: int = 800, longest: int = 20_000, rounds: int = 3, smooth: float = 0.02) -> Model:
    """Piece probabilities by expectation maximisation from the rows with a text and a language.

    The fit sees about per_language rows of each language, chosen by a hash of key, and of a text over `longest`
    characters a stretch of so many; words of BLOCK characters and more teach in parts of that length. That bounds
    what reaches the driver. Scoring has no such bounds.
    """
    rows = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sample = bounded_sample(rows.select(lang_col, text_col, key), lang_col, key, per_language).withColumn(text_col, stretch(text_col, key, longest))
    counted = sample.select(lang_col, F.explode(F.split(F.trim(F.translate(text_col, "\t\n\x0b\x0c\r", "     ")), " +")).alias("w")).where("w <> ''").groupBy(lang_col, "w").count().toPandas()
    languages = sorted(counted[lang_col].unique().tolist())
    vocab = vocabulary(vocab_file)
    pieces = Pieces(vocab)
    p = np.zeros((pieces.n + 1, len(languages)))
    if not languages:
        return Model(vocab, [], p)
    counted = counted.sort_values("w", kind="stable")
    distinct, code = np.unique(counted["w"].to_numpy(str), return_inverse=True) if len(counted) else (np.zeros(0, str), np.zeros(0, int))
    weight = np.zeros((len(distinct), len(languages)))
    np.add.at(weight, (code, np.searchsorted(languages, counted[lang_col].to_numpy(str))), counted["count"].to_numpy(float))
    parts = sorted(((k, (START + w)[i : i + BLOCK]) for k, w in enumerate(distinct.tolist()) for i in range(0, len(w) + 1, BLOCK)), key=lambda x: len(x[1]))
    lattices = [(part, *pieces.lattice([s for _, s in part])) for part in (parts[at : at + 4096] for at in range(0, len(parts), 4096))]
    p[:] = 1 / len(p)
    for _ in range(rounds):
        uses = np.zeros_like(p)
        for part, size, piece in lattices:
            uses += _expected(piece, size, p, weight[[k for k, _ in part]])
        p = (uses + smooth) / (uses + smooth).sum(axis=0)
    return Model(vocab, languages, p)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, margin of each row, from its whole text alone.

    score: the posterior of lang_pred with equal priors; ties go to the language that sorts first. A text that is
    null or has no letter gives `und` and 0, as does a model without languages. margin: the difference from the
    second language's log-probability for each character. Every row gives a row; other columns are ignored.
    """
    ids = docs.schema[id_col].dataType
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # at most vocabulary x languages numbers
    names = np.array([*model.languages, "und"], object)

    def label(batches):
        model = shipped.value
        memo = Memo(model.loglik, len(model.languages))
        for whole in batches:
            for batch in slices(whole, "_text"):
                lettered = batch["_letters"].to_numpy(zero_copy_only=False).astype(bool)
                best = np.full(batch.num_rows, len(names) - 1)
                score, margin = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
                if model.languages:
                    column = texts(batch["_text"])
                    ll = model.scores(column, memo)
                    top = ll.max(axis=1, keepdims=True)
                    best = np.where(lettered, ll.argmax(axis=1), best)
                    score = np.where(lettered, 1 / np.exp(ll - top).sum(axis=1), 0.0)
                    if ll.shape[1] > 1:
                        margin = np.where(lettered, np.diff(np.sort(ll, axis=1)[:, -2:], axis=1)[:, 0], 0.0)
                yield pa.RecordBatch.from_arrays([batch["_id"], pa.array(names[best], pa.string()), pa.array(score), pa.array(margin)], ["_id", "lang_pred", "score", "margin"])

    lettered: Column = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), lettered.alias("_letters"))
    return rows.mapInArrow(tidy(label), f"_id {ids.simpleString()}, lang_pred string, score double, margin double").withColumnRenamed("_id", id_col)

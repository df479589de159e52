"""Secret scans: fixed patterns, and a linear-chain conditional random field that tags further secrets.

The field labels each word as secret begin, inside or outside, from its shape, the words beside it and features of its
file. It learns from the pattern matches of a sample, from the same with their key words taken away, and from made-up
secrets put into the sample's texts, against all other words there, the numbers and addresses above all. So what it
adds are secrets that no pattern names. Decoding is by Viterbi over whole texts.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, bounded_sample, coded, slices, stretch, sums, texts, tidy, words
from .quality import shape

KINDS = ("assign", "access", "hex", "crf")
#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Any text with a base span matches this.
HINT = r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"""
BUCKETS, FILE_BUCKETS, SPAN = 4096, 16, 16
_KEYWORD = re.compile(r"pass|secret|token|key|auth|cred|pwd|bearer|login", re.I)
_DIGITS = re.compile(r"\d")
_HEX = re.compile(r"[0-9a-fA-F]{16,}").fullmatch
FEATURES = 12


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the pattern matches, by start and kind."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


_CODES: dict[tuple, int] = {}


def _code(name: tuple) -> int:
    got = _CODES.get(name)
    if got is None:
        if len(_CODES) > 500_000:
            _CODES.clear()
        got = _CODES[name] = zlib.crc32(repr(name).encode()) % BUCKETS
    return got


def word_features(word: str) -> list[int]:
    """Hashed features of a word: shape, length, mixture of characters, marks and key words in it."""
    body = word.strip("\"'.,;()[]{}<>!?#%&*$")
    size, plain = len(body), body.isalpha()
    digits, letters = (0, size) if plain else (len(_DIGITS.findall(body)), sum(map(str.isalpha, body)))
    kind, length = shape(body), min(size // 4, 12)
    cased = 0 if plain and body.islower() else (body != body.lower()) + 2 * (body != body.upper())
    return [
        _code(("shape", kind)), _code(("turns", min(len(kind), 24) // 2, length > 3)), _code(("length", length)), _code(("digits", min(digits, 6), 8 * digits // max(size, 1))),
        _code(("mixed", digits > 1, letters > 1, cased, size - digits - letters > 1)), _code(("cased", cased, digits > 0, length)), _code(("variety", min(len(set(body)) // 4, 8), min(size // 8, 6))),
        _code(("assigns", word[-1:] in ":=", "=" in word[:-1], ":" in word[:-1], "@" in word, length)), _code(("key word", _KEYWORD.search(word) is not None, length > 2, digits > 0)),
        _code(("start", body[:2], size > 15)), _code(("quoted", word[:1] in "\"'", "--" in word, "@" in word and ":" not in word)), _code(("hex", _HEX(body) is not None, digits == size, kind.count(".") > 1)),
    ]


class Field:
    """Weights: own, before and after [bucket, label], file [bucket, label], step [label, label]; labels: outside, begin, inside."""

    def __init__(self):
        self.own, self.before, self.after = (np.zeros((BUCKETS, 3)) for _ in range(3))
        self.file, self.step = np.zeros((FILE_BUCKETS, 3)), np.zeros((3, 3))

    def parts(self) -> list[np.ndarray]:
        return [self.own, self.before, self.after, self.file, self.step]

    def words(self, distinct: list[str]) -> np.ndarray:
        """Scores by label that a word gives itself, the word after it and the word before it; then its share in the file features."""
        f = np.array([word_features(w) for w in distinct])
        marks = np.array([[_KEYWORD.search(w) is not None, len(w) > 12 and bool(_DIGITS.search(w))] for w in distinct], float)
        return np.concatenate([self.own[f].sum(axis=1), self.before[f].sum(axis=1), self.after[f].sum(axis=1), marks], axis=1)

    def emissions(self, column: pa.Array, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
        offsets, flat = words(column)
        codes, distinct = coded(flat)
        if not distinct:
            return offsets, np.zeros((0, 3))
        rows = memo(distinct)[codes]
        e = rows[:, :3].copy()
        inner = np.ones(len(e), bool)
        inner[offsets[:-1][offsets[:-1] < len(e)]] = False
        at = np.flatnonzero(inner)
        e[at] += rows[at - 1, 3:6]
        e[at - 1] += rows[at, 6:9]
        return offsets, e + self.file[np.repeat(file_bucket(sums(rows[:, 9:], offsets)), np.diff(offsets))]

    def viterbi(self, e: np.ndarray) -> list[int]:
        """The best labels; inside never starts a text or follows outside."""
        (oo, ob, _), (bo, bb, bi), (io, ib, ii) = self.step.tolist()
        back, o, b, i = [], 0.0, -1e18, -1e18
        for eo, eb, ei in e.tolist():
            po, pb = max((o + oo, 0), (b + bo, 1), (i + io, 2)), max((o + ob, 0), (b + bb, 1), (i + ib, 2))
            pi = max((b + bi, 1), (i + ii, 2))
            back.append((po[1], pb[1], pi[1]))
            o, b, i = po[0] + eo, pb[0] + eb, pi[0] + ei
        label = max((o, 0), (b, 1), (i, 2))[1]
        out = []
        for step in reversed(back):
            out.append(label)
            label = step[label]
        return out[::-1]

    def tagged(self, column: pa.Array, memo: Memo) -> dict[int, list[tuple[int, int]]]:
        """Runs (first word, end) of tagged words by text.

        A text whose words all favour outside by twice the range of the step weights is outside throughout: putting a
        tagged run outside changes one step more than it has words. The others are decoded.
        """
        offsets, e = self.emissions(column, memo)
        if not len(e):
            return {}
        margin = 2 * (self.step.max() - self.step.min())
        hot = np.flatnonzero(e[:, 1:].max(axis=1) - e[:, 0] > -margin)
        out = {}
        for t in np.unique(np.searchsorted(offsets, hot, "right") - 1).tolist():
            labels = self.viterbi(e[offsets[t] : offsets[t + 1]])
            runs = [[k, k + 1] for k, x in enumerate(labels) if x == 1]
            for run in runs:
                while run[1] < len(labels) and labels[run[1]] == 2:
                    run[1] += 1
            if runs:
                out[t] = [tuple(r) for r in runs]
        return out


def file_bucket(marks: np.ndarray) -> np.ndarray:
    """From a file's number of words with key words and of long words with digits."""
    return np.minimum(marks[:, 0], 3).astype(np.int64) * 4 + np.minimum(marks[:, 1], 3).astype(np.int64)


def word_places(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]


_LOWERS, _UPPERS, _NUMERALS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Words before a made-up secret; the bare ones suit any, a short password needs a cue.
_CUES = ("Bearer", "auth =>", "pwd is", "Authorization: Bearer", "credential:", "key", "login with", "passphrase:", "pwd:", "use the key", "signed with", "access key is", "auth", "pwd =", "cred =>")


def made_up(rng: np.random.Generator) -> tuple[list[str], list[int]]:
    """Words that hold a secret without a base pattern, and their labels."""

    def draw(alphabet: str, low: int, high: int) -> str:
        return "".join(alphabet[k] for k in rng.integers(0, len(alphabet), int(rng.integers(low, high + 1))))

    mixed = _LOWERS + _UPPERS + _NUMERALS
    kind, cue = int(rng.integers(0, 9)), _CUES[int(rng.integers(0, len(_CUES)))].split()
    if kind == 0:
        value = [draw(mixed, 20, 48)]
    elif kind == 1:
        value = [draw(mixed + "+/", 22, 64) + "=" * int(rng.integers(0, 3))]
    elif kind == 2:
        value = [draw(_LOWERS, 2, 6) + "_-"[int(rng.integers(0, 2))] + draw(mixed, 16, 40)]
    elif kind == 3:
        value = [".".join(draw(mixed + "_-", *size) for size in ((18, 40), (30, 120), (20, 44)))]
    elif kind == 4:
        value = [draw(_UPPERS + _NUMERALS, 16, 40)]
    elif kind == 5:
        value = [draw(mixed + "!@#$%^&*", 9, 18) + draw(_NUMERALS, 1, 2) + draw("!@#$%^&*", 1, 1)]
    elif kind == 6:
        value = [f"{draw(_LOWERS, 4, 8)}://{draw(_LOWERS, 4, 9)}:{draw(mixed, 8, 20)}@{draw(_LOWERS, 4, 10)}.{draw(_LOWERS, 3, 8)}"]
    elif kind == 7:
        value = ["-".join(draw(mixed, 5, 12) for _ in range(int(rng.integers(3, 6))))]
    else:
        name = ("RSA ", "EC ", "")[int(rng.integers(0, 3))]
        lines = [draw(mixed + "+/", 64, 64) for _ in range(int(rng.integers(2, 7)))]
        value = [*f"-----BEGIN {name}PRIVATE KEY-----".split(), *lines, draw(mixed + "+/", 10, 60) + "=", *f"-----END {name}PRIVATE KEY-----".split()]
    if kind in (6, 8) or kind != 5 and rng.random() < 0.35:
        cue = []
    mark = int(rng.integers(0, 5))
    if mark == 0 and kind != 8:
        value = [f'"{value[0]}"']
    elif mark == 1 and kind < 5:
        value = [f"{draw(_UPPERS, 3, 6)}_KEY={value[0]}"]
    return [*cue, *value], [0] * len(cue) + [1] + [2] * (len(value) - 1)


def harmless(rng: np.random.Generator) -> list[str]:
    """Words that look a little like secrets and are none."""

    def number(n: int) -> str:
        return "".join(map(str, rng.integers(0, 10, n)))

    def word(n: int) -> str:
        return "".join(_LOWERS[k] for k in rng.integers(0, 26, n))

    kinds = (
        lambda: [number(int(rng.integers(5, 20)))], lambda: [".".join(str(x) for x in rng.integers(0, 256, 4))], lambda: [f"{word(int(rng.integers(2, 9)))}.{number(2)}@{word(5)}{number(1)}.{word(7)}.com"], lambda: [f"{word(int(rng.integers(6, 20))).capitalize()}{'&%$#*!'[int(rng.integers(0, 6))] * 3}"], lambda: [f"https://www.{word(7)}.com/{word(5)}/{number(4)}/{word(9)}-{word(4)}.html"],
        lambda: [f"20{number(2)}-0{number(1)}-1{number(1)}T{number(2)}:{number(2)}:{number(2)}Z"], lambda: [f"+{number(2)}", f"({number(3)})", f"{number(3)}-{number(4)}"], lambda: [f"v{number(1)}.{number(2)}.{number(1)}"], lambda: [f"/{word(3)}/{word(6)}/{word(8)}_{word(5)}.txt"],
        lambda: [f"{word(5)}{word(6).title()}{word(7).title()}"], lambda: [word(int(rng.integers(13, 30)))], lambda: [word(8).upper(), word(14).upper()], lambda: ["the", "key", "point", "is"], lambda: ["his", "password", "was", word(6)], lambda: ["auth", word(5)], lambda: [f"{word(6)}-{word(5)}-{word(7)}-{word(4)}"], lambda: [f"<{word(4)}>{word(7)}</{word(4)}>"],
        lambda: ["##", f"{number(2)}%", f"${number(5)}.{number(2)}"], lambda: ["-" * 40], lambda: [f"{word(6)}_{word(7)}_{number(3)}"],
    )
    return kinds[int(rng.integers(0, len(kinds)))]()


def _marks(own: list[str]) -> np.ndarray:
    return np.array([[sum(_KEYWORD.search(w) is not None for w in own), sum(len(w) > 12 and bool(_DIGITS.search(w)) for w in own)]], float)


def _lessons(text: str, rng: np.random.Generator, made: int) -> list[tuple[list[str], np.ndarray, list[int], np.ndarray]]:
    """Words, labels, starts of windows and marks to learn from: the text, it without its key words, and its words around things put in."""
    places, spans = word_places(text), base_spans(text)
    own, labels = [text[a:b] for a, b in places], np.zeros(len(places), np.int64)
    for a, b, _ in spans:
        hit = [k for k, (x, y) in enumerate(places) if x < b and y > a]
        labels[hit] = 2
        if not hit[0] or not labels[hit[0] - 1]:
            labels[hit[0]] = 1
    if not own:
        return []
    last, marks = max(0, len(own) - SPAN), _marks(own)
    odd = [k for k, w in enumerate(own) if not labels[k] and len(w) > 8 and not w.isalpha()]
    near = [*np.flatnonzero(labels == 1).tolist(), *(odd[int(k)] for k in rng.integers(0, len(odd), 4) if odd)] if odd else np.flatnonzero(labels == 1).tolist()
    out = [(own, labels, sorted({min(last, max(0, k - int(rng.integers(2, SPAN - 2)))) for k in near} | {int(x) for x in rng.integers(0, last + 1, 2)}), marks)]
    keep = np.array([not (x and (w[-1:] in ":=" or _KEYWORD.search(w) and not _DIGITS.search(w))) for w, x in zip(own, labels)])
    if labels.any() and not keep.all():
        less, bare = [w for w, k in zip(own, keep) if k], labels[keep]
        bare = np.where((bare == 2) & (np.concatenate([[0], bare[:-1]]) == 0), 1, bare)
        out.append((less, bare, sorted({max(0, k - int(rng.integers(2, SPAN - 2))) for k in np.flatnonzero(bare == 1).tolist()}), marks - _marks([w for w, k in zip(own, keep) if not k])))
    for _ in range(made):
        at = int(rng.integers(0, len(own) + 1))
        extra, tags = made_up(rng) if rng.random() < 0.6 else (harmless(rng), [])
        tags = [*tags, *[0] * (len(extra) - len(tags))]
        low, high = max(0, at - SPAN), at + SPAN
        out.append(([*own[low:at], *extra, *own[at:high]], np.concatenate([labels[low:at], tags, labels[at:high]]).astype(np.int64), [max(0, at - low - int(rng.integers(1, SPAN - 2)))], marks + _marks(extra)))
    return out


def fit(docs: DataFrame, text_col: str = "text", key: str = "doc_id", most: int = 12_000, longest: int = 20_000, quiet: int = 20, made: int = 4000, rounds: int = 150, rate: float = 0.4, ridge: float = 1e-3) -> Field:
    """A field from a sample of texts and about `made` made-up passages put into them.

    The fit sees about `most` rows, chosen by a hash of key, of a text over `longest` characters a stretch of so many,
    and of the ones without a hint one in `quiet`: that bounds what reaches the driver. Scanning has no such bounds.
    Without any text the field tags nothing.
    """
    rows = docs.where(F.col(key).isNotNull() & F.col(text_col).isNotNull()).select(key, text_col, F.lit(1).alias("all"))
    sample = bounded_sample(rows, "all", key, most).withColumn(text_col, stretch(text_col, key, longest))
    sample = sample.where(F.col(text_col).rlike(HINT) | (F.pmod(F.xxhash64(F.lit("quiet"), F.col(key)), F.lit(quiet)) == 0)).select(key, text_col).distinct()
    rng, numbers, chosen, labels, file = np.random.default_rng(11), {}, [], [], []
    got = sample.toPandas().sort_values([key, text_col], kind="stable")[text_col].tolist()
    for text in got:
        for own, tags, starts, marks in _lessons(text, rng, -(-made // len(got))):
            bucket = int(file_bucket(marks)[0])
            for s in starts:
                part = own[s : s + SPAN]
                around = [own[s - 1] if s else None, *part, *[None] * (SPAN - len(part)), own[s + SPAN] if s + SPAN < len(own) else None]
                chosen.append([-1 if w is None else numbers.setdefault(w, len(numbers)) for w in around])
                y = [*tags[s : s + SPAN].tolist(), *[0] * (SPAN - len(part))]
                labels.append([1 if y[0] == 2 else y[0], *y[1:]])
                file.append(bucket)
    return _trained(list(numbers), np.array(chosen, np.int64).reshape(-1, SPAN + 2), np.array(labels, np.int64).reshape(-1, SPAN), np.array(file, np.int64), rounds, rate, ridge)


def _trained(distinct: list[str], chosen: np.ndarray, y: np.ndarray, file: np.ndarray, rounds: int, rate: float, ridge: float) -> Field:
    """A field by gradient ascent of the likelihood of the labels y of windows; chosen: numbers of their words and of one on each side, -1 for none."""
    field, n = Field(), len(y)
    if not n:
        field.step[:, 1:] = -1.0  # nothing to learn from: everything is outside
        field.file[:, 0] = 10.0
        return field
    f = np.array([word_features(w) for w in distinct]).reshape(-1)
    spans = [chosen[:, 1:-1], chosen[:, :-2], chosen[:, 2:]]  # own, before, after
    inside = spans[0] >= 0
    has = [(x >= 0) & inside for x in spans]
    sizes = [np.zeros_like(p) for p in field.parts()]
    allowed = np.array([[1.0, 1, 0], [1, 1, 1], [1, 1, 1]])  # inside never follows outside
    onehot, seen = np.eye(3), np.zeros((3, 3))
    np.add.at(seen, (y[:, :-1][inside[:, 1:]], y[:, 1:][inside[:, 1:]]), 1)

    def tally(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
        return np.stack([np.bincount(at, values[:, k], size) for k in range(3)], axis=1)

    for _ in range(rounds):
        e = np.repeat(field.file[file][:, None, :], SPAN, axis=1)
        for x, h, w in zip(spans, has, (field.own, field.before, field.after)):
            e += w[f].reshape(-1, FEATURES, 3).sum(axis=1)[x] * h[..., None]
        # Forward and backward sums of probabilities, scaled at each word; what the scales are does not matter to the posteriors.
        step, likely = np.exp(field.step) * allowed, np.exp(e - e.max(axis=2, keepdims=True))
        alpha, beta = np.empty((SPAN, n, 3)), np.ones((SPAN, n, 3))
        alpha[0] = likely[:, 0] * [1, 1, 0]
        for t in range(1, SPAN):
            alpha[t] = np.where(inside[:, t, None], alpha[t - 1] @ step * likely[:, t], alpha[t - 1])
            alpha[t] /= alpha[t].sum(axis=1, keepdims=True)
        for t in range(SPAN - 1, 0, -1):
            beta[t - 1] = np.where(inside[:, t, None], (likely[:, t] * beta[t]) @ step.T, beta[t])
            beta[t - 1] /= beta[t - 1].sum(axis=1, keepdims=True)
        share = alpha * beta
        share /= share.sum(axis=2, keepdims=True)
        gap = (onehot[y] - share.transpose(1, 0, 2)) * inside[..., None]
        gs = []
        for x, h in zip(spans, has):
            of_words = tally(x[h], gap[h], len(distinct))
            gs.append(tally(f, np.repeat(of_words, FEATURES, axis=0), BUCKETS))
        gs += [tally(file, gap.sum(axis=1), FILE_BUCKETS), np.zeros((3, 3))]
        for t in range(1, SPAN):
            pair = alpha[t - 1][:, :, None] * step * (likely[:, t] * beta[t])[:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            gs[4] -= pair[inside[:, t]].sum(axis=0)
        gs[4] += seen
        for p, g, s in zip(field.parts(), gs, sizes):
            g = g / n - ridge * p / max(1, len(p) // 64)
            s += g * g
            p += rate * g / np.sqrt(s + 1e-12)
    return field


def found_in(column: pa.Array, field: Field, memo: Memo) -> dict[int, tuple[str, list[tuple[int, int, str]]]]:
    """Of the texts that have any: the text and its spans, by start and kind."""
    hinted = set(np.flatnonzero(pc.match_substring_regex(column, HINT).to_numpy(zero_copy_only=False)).tolist())
    runs = field.tagged(column, memo)
    out = {}
    for t in sorted(hinted | runs.keys()):
        text = column[t].as_py()
        spans = base_spans(text) if t in hinted else []
        if t in runs:
            places, base = word_places(text), list(spans)
            for i, j in runs[t]:
                a, b = places[i][0], places[j - 1][1]
                if not any(a < y and x < b for x, y, _ in base):
                    spans.append((a, b, "crf"))
            spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
        if spans:
            out[t] = text, spans
    return out


def scan(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, found: the spans (kind, start, end) of each row's whole text, by start and kind.

    Places are code points, end exclusive. Pattern matches always stay; the field adds runs of words that overlap none.
    Spans of the same start go by kind. Null and empty texts have no spans; every row gives a row, ids may be null or
    repeat; other columns are ignored.
    """
    ids = docs.schema[id_col].dataType
    shipped = docs.sparkSession.sparkContext.broadcast(field)  # of a fixed size
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def apply(batches):
        field = shipped.value
        memo = Memo(field.words, 11)
        for whole in batches:
            for batch in slices(whole, "_text"):
                found = found_in(texts(batch["_text"]), field, memo)
                out = [[{"kind": k, "start": a, "end": b} for a, b, k in found[t][1]] if t in found else [] for t in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([batch["_id"], pa.array(out, arrow)], ["_id", "found"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(tidy(apply), f"_id {ids.simpleString()}, found array<struct<kind:string,start:bigint,end:bigint>>").withColumnRenamed("_id", id_col)


def cover(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with each stretch of overlapping spans replaced by the first one's kind in angle brackets."""
    out, at, end = [], 0, -1
    for a, b, kind in spans:
        if a >= end:
            out += [text[at:a], f"<{kind}>"]
        at = end = max(end, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """docs with the spans of each text covered; a null text stays null, rows without spans stay as they are."""
    rest = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_rest"), F.col(text_col).alias("_text"))
    shipped = docs.sparkSession.sparkContext.broadcast(field)

    def apply(batches):
        field = shipped.value
        memo = Memo(field.words, 11)
        for whole in batches:
            for batch in slices(whole, "_text"):
                found = found_in(texts(batch["_text"]), field, memo)
                column = batch["_text"]
                if found:
                    own = column.to_pylist()
                    for t, (text, spans) in found.items():
                        own[t] = cover(text, spans)
                    column = pa.array(own, pa.string())
                yield pa.RecordBatch.from_arrays([batch["_rest"], column], ["_rest", "_text"])

    covered = rows.mapInArrow(tidy(apply), T.StructType().add("_rest", rows.schema["_rest"].dataType).add("_text", "string"))
    return covered.select(*[F.col("_text").alias(c) if c == text_col else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns])

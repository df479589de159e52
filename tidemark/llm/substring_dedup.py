"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Windows are dealt by a second hash, packed by batch and bucket. A batch sends only the first of its equal windows and
settles the others itself, so a window that every document has costs a row for each batch, not for each document.
In a bucket, all but the first of equal windows are repeats; a document's repeats merge into maximal intervals.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, coded, inside, mix, parts, rolling, slices, texts, tidy, word_hashes, words

BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_FIELDS = ["bucket", "hashes", "docs", "kinds", "runs", "places"]
_SCHEMA = "bucket int, hashes binary, docs binary, kinds binary, runs binary, places binary"
#: Bits of the filter of ids that have several texts.
FILTER = 24


def planes(x: np.ndarray) -> bytes:
    """Integers byte by byte, all lowest bytes first: the high ones are mostly zeros, which shuffles compress."""
    x = np.ascontiguousarray(x)
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unplanes(b: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def later(h: np.ndarray, doc: np.ndarray, kind: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which entries have an equal hash with a smaller (doc, kind, place)."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    many = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(h) else order
    out = np.zeros(len(h), bool)
    many = many[np.lexsort((place[many], kind[many], doc[many], h[many]))]
    if len(many):
        new = np.concatenate([[True], h[many][1:] != h[many][:-1]])
        first = many[np.maximum.accumulate(np.where(new, np.arange(len(many)), 0))]
        out[many] = (doc[many] != doc[first]) | (kind[many] != kind[first]) | (place[many] != place[first])
    return out


def _heads(doc: np.ndarray, kind: np.ndarray, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of (doc, kind); with places, a run also ends where they do not rise, as between equal rows."""
    new = (doc[1:] != doc[:-1]) | (kind[1:] != kind[:-1])
    if place is not None:
        new |= place[1:] <= place[:-1]
    head = np.flatnonzero(np.concatenate([[True], new])) if len(doc) else np.zeros(0, np.int64)
    return head, np.diff(np.append(head, len(doc))).astype(np.int32)


def _row(bucket: int, hashes: bytes, doc: np.ndarray, kind: np.ndarray, place: np.ndarray) -> tuple:
    """One packed row. Places are kept as differences in runs of a row in which they rise, in two bytes if they fit; kinds only if any is not 0."""
    head, count = _heads(doc, kind, place)
    step = np.diff(place, prepend=0)
    step[head] = place[head]
    narrow = len(step) == 0 or step.max() < 1 << 16
    kinds = kind[head].astype("<i8").tobytes() if kind.any() else b""
    return bucket, hashes, planes(np.diff(doc[head], prepend=0).astype("<i8")), kinds, planes(count.astype("<i4")), planes(step.astype("<u2" if narrow else "<u4"))


def _unrow(docs: bytes, kinds: bytes, runs: bytes, places: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    count = unplanes(runs, "<i4")
    total = int(count.sum())
    step = unplanes(places, "<u2" if len(places) == 2 * total else "<u4").astype(np.int64)
    sums = np.cumsum(step)
    head = np.cumsum(count) - count
    kind = np.repeat(np.frombuffer(kinds, "<i8"), count) if kinds else np.zeros(total, np.int64)
    return np.repeat(np.cumsum(unplanes(docs, "<i8")), count), kind, sums - np.repeat(sums[head] - step[head], count)


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 6))], _FIELDS)


def _dealt(doc: np.ndarray, kind: np.ndarray, place: np.ndarray, n: int) -> pa.RecordBatch:
    """Removals, packed by a bucket of the doc."""
    bucket = (mix(doc.view(np.uint64)) % np.uint64(n)).astype(np.int64)
    order = np.lexsort((place, kind, doc, bucket))
    doc, kind, place, bucket = doc[order], kind[order], place[order], bucket[order]
    head = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    return _packed([_row(int(bucket[a]), b"", doc[a:b], kind[a:b], place[a:b]) for a, b in zip(head, np.append(head[1:], len(doc)))])


def ambiguous(rows: DataFrame) -> np.ndarray:
    """A filter, of a fixed size, of the ids (_id) that have several texts (_text): bits by filter_bits."""
    twice = rows.groupBy("_id").agg(F.min(F.xxhash64("_text")).alias("a"), F.max(F.xxhash64("_text")).alias("b")).where("a <> b")
    bit = F.pmod(F.xxhash64("_id"), F.lit(1 << FILTER)) + 1
    maps = twice.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("m")).collect()
    out = np.zeros(((1 << FILTER) >> 15, 1 << 12), np.uint8)
    for r in maps:
        out[r["k"] - 1] = np.frombuffer(bytes(r["m"]), np.uint8)
    return out.reshape(-1)


def repeated(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kind, starts): the packed starts of a row's windows that occur earlier, for each row that has any.

    kind is 0 for the one text of an id; rows of an id with several texts have a hash of their text.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    n = parts(rows)
    several = docs.sparkSession.sparkContext.broadcast(ambiguous(rows))
    rows = rows.select("*", F.xxhash64("_text").alias("_kind"), (F.pmod(F.xxhash64("_id"), F.lit(1 << FILTER))).alias("_bit"))

    def windows(batches):
        memo, bits = Memo(lambda w: word_hashes(w)[:, None], 1, np.uint64), several.value
        for whole in batches:
            for batch in slices(whole.sort_by([("_id", "ascending"), ("_kind", "ascending")]), "_text"):
                offsets, flat = words(texts(batch["_text"]))
                codes, distinct = coded(flat)
                if len(codes) < width:
                    continue
                h = memo(distinct)[codes, 0]
                row, place, at = inside(offsets, width)
                if not len(row):
                    continue
                bit = batch["_bit"].to_numpy(zero_copy_only=False)
                own = np.where(bits[bit >> 3] >> (bit & 7) & 1, batch["_kind"].to_numpy(zero_copy_only=False), 0)
                doc, kind = batch["_id"].to_numpy(zero_copy_only=False)[row], own[row]
                main, second = rolling(h, width, BASES[0])[at], rolling(h, width, BASES[1])[at]
                late = later(main, doc, kind, place)
                bucket = (second % np.uint64(n)).astype(np.int64)
                if late.any():  # settled here; without hashes it only passes through a bucket
                    d, t, p = doc[late], kind[late], place[late]
                    order = np.lexsort((p, t, d))
                    yield _packed([_row(int(bucket[0]), b"", d[order], t[order], p[order])])
                keep = np.flatnonzero(~late)
                keep = keep[np.argsort(bucket[keep].astype(np.uint16) if n <= 1 << 16 else bucket[keep], kind="stable")]
                edge = np.flatnonzero(np.concatenate([[True], np.diff(bucket[keep]) > 0]))
                yield _packed([_row(int(bucket[keep[a]]), main[keep[a:b]].astype("<u8").tobytes(), doc[keep[a:b]], kind[keep[a:b]], place[keep[a:b]]) for a, b in zip(edge, np.append(edge[1:], len(keep)))])

    def meet(batches):
        got = [[], [], [], [], []]
        for batch in batches:
            for b, h, *rest in zip(*(batch[f].to_pylist() for f in _FIELDS)):
                own = _unrow(*rest)
                if not h:
                    yield _dealt(*own, n)
                    continue
                for x, y in zip(got, (np.frombuffer(h, "<u8"), *own, np.full(len(own[0]), b, np.int32))):
                    x.append(y)
        if got[0]:
            h, doc, kind, place, bucket = (np.concatenate(x) for x in got)
            got = None
            for b in np.unique(bucket).tolist():
                own = np.flatnonzero(bucket == b)
                own = own[later(h[own], doc[own], kind[own], place[own])]
                if len(own):
                    yield _dealt(doc[own], kind[own], place[own], n)

    def gather(batches):
        got = [_unrow(*rest) for batch in batches for rest in zip(*(batch[f].to_pylist() for f in _FIELDS[2:]))]
        if not got:
            return
        doc, kind, place = (np.concatenate(x) for x in zip(*got))
        order = np.lexsort((place, kind, doc))
        doc, kind, place = doc[order], kind[order], place[order].astype("<i4")
        head, count = _heads(doc, kind)
        for at in range(0, len(head), 1000):
            own = slice(at, at + 1000)
            yield pa.RecordBatch.from_arrays([pa.array(doc[head[own]], pa.int64()), pa.array(kind[head[own]], pa.int64()), pa.array([place[a : a + c].tobytes() for a, c in zip(head[own], count[own])], pa.binary())], ["id", "kind", "starts"])

    packed = rows.mapInArrow(tidy(windows), _SCHEMA).repartitionById(n, F.col("bucket")).mapInArrow(tidy(meet), _SCHEMA)
    return packed.repartitionById(n, F.col("bucket")).mapInArrow(tidy(gather), "id long, kind long, starts binary")


def substring_dedup(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 and, if asked for, kept (the words left, joined by a space) of each row.

    A word goes if a window of `width` words over it also starts earlier: in a smaller id, or earlier in its own text.
    Null texts have no words; texts shorter than a window keep all. Equal rows are judged alike and none is earlier
    than its twin; rows of one id with different texts are different documents, in the order of a hash of the text. Rows
    with a null id compare with nothing. Ids are integers; other columns are ignored. Windows are told apart by 64
    bits of hash and the bucket's bits of another.
    """
    starts = repeated(docs, width, id_col, text_col)
    ids = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    own = (F.col("_id").cast("long") == F.col("id")) & ((F.col("kind") == 0) | (F.col("kind") == F.xxhash64("_text")))
    rows = rows.join(starts, own, "left").select("_id", "_text", "starts")

    def apply(batches):
        for whole in batches:
            for batch in slices(whole, "_text"):
                n, gone, digests, kept = [], [], [], []
                for text, packed in zip(batch["_text"].to_pylist(), batch["starts"].to_pylist()):
                    own = (text or "").encode().split()
                    n.append(len(own))
                    if packed:
                        delta = np.zeros(len(own) + 1, np.int64)
                        at = np.frombuffer(packed, "<i4")
                        np.add.at(delta, at, 1)
                        np.add.at(delta, at + width, -1)
                        own = [own[k] for k in np.flatnonzero(np.cumsum(delta)[:-1] == 0).tolist()]
                    gone.append(n[-1] - len(own))
                    left = b" ".join(own)
                    digests.append(hashlib.sha256(left).hexdigest())
                    kept.append(left.decode() if with_text else None)
                yield pa.RecordBatch.from_arrays([batch["_id"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string()), *([pa.array(kept, pa.string())] * with_text)], ["_id", "n_words", "n_removed", "kept_sha256", *["kept"] * with_text])

    kind = f"_id {ids.simpleString()}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return rows.mapInArrow(tidy(apply), kind).withColumnRenamed("_id", id_col)

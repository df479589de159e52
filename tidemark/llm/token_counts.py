"""Token counts: batch encoding in Arrow functions that return lengths only.

A byte-level vocabulary splits text before it merges, and no split crosses a place where a character that is not
white space meets a space. There texts are cut, so that equal stretches are encoded once for a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import coded, held, slices, sums, texts


class Lengths:
    """Token counts of a tokenizers file for many texts. most: distinct stretches remembered."""

    def __init__(self, file: str, most: int = 600_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.most = Tokenizer.from_file(file), {}, most

    def encode(self, stretches: list[str]) -> np.ndarray:
        """Counts of whole stretches, encoded in batches of about 1 MB."""
        out, at = np.zeros(len(stretches), np.int64), 0
        while at < len(stretches):
            to, size = at, 0
            while to < len(stretches) and (to == at or size < 1 << 20):
                size += len(stretches[to]) + 16
                to += 1
            out[at:to] = [len(e.ids) for e in self.tokenizer.encode_batch_fast(stretches[at:to], add_special_tokens=False)]
            at = to
        return out

    def inner(self, distinct: list[str]) -> np.ndarray:
        """Counts of stretches that follow a space in the text."""
        if len(self.known) > self.most:
            self.known = {}
        known = self.known
        fresh = [w for w in distinct if w not in known]
        if fresh:
            known.update(zip(fresh, self.encode([f" {w}" for w in fresh]).tolist()))
        return np.fromiter((known[w] for w in distinct), np.int64, len(distinct))

    def __call__(self, column: pa.Array) -> np.ndarray:
        lists = pc.split_pattern(column, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.flatten()
        offsets -= offsets[0]
        n = len(flat)
        if not n:
            return np.zeros(len(column), np.int64)
        first = np.zeros(n + 1, bool)
        first[offsets[:-1]] = True  # each text has a stretch, be it empty
        first = first[:n]
        joined = np.zeros(n, bool)  # the space before it is not a safe boundary
        joined[1:] = ~_ends_safely(flat)[:-1]
        joined &= ~first
        head = np.flatnonzero(~joined)  # each run of joined stretches is one
        many = np.diff(np.append(head, n)) > 1
        plain = ~first & ~joined
        plain[head[many]] = False
        counts = np.zeros(n, np.int64)
        codes, distinct = coded(flat.filter(pa.array(plain)))
        if distinct:
            counts[plain] = self.inner(distinct)[codes]
        whole = head[many | first[head]]
        ends = np.append(head, n)[np.searchsorted(head, whole) + 1]
        if len(whole):
            counts[whole] = self.encode([("" if first[a] else " ") + (flat[a].as_py() if b == a + 1 else " ".join(flat.slice(a, b - a).to_pylist())) for a, b in zip(whole.tolist(), ends.tolist())])
        return sums(counts, offsets)


def _ends_safely(flat: pa.Array) -> np.ndarray:
    """Whether each string surely ends in a character that is not white space: ASCII, or of two bytes above U+00BF."""
    flat = pa.concat_arrays([flat])
    _, offsets, data = flat.buffers()
    at = np.frombuffer(offsets, np.int32)[flat.offset : flat.offset + len(flat) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    size = np.diff(at)
    last, before = raw[np.clip(at[1:] - 1, 0, len(raw) - 1)], raw[np.clip(at[1:] - 2, 0, len(raw) - 1)]
    return ((size > 0) & (last > 0x20) & (last < 0x7F)) | ((size > 1) & (last >= 0x80) & (before >= 0xC3) & (before <= 0xDF))


def token_counts(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each row.

    Whole texts, whatever their length; a null text counts as empty (0 bytes, 0 tokens); ids may be null or repeat,
    each row gives a row; other columns are ignored. Special strings inside texts count as the library's default does.
    """
    ids = docs.schema[id_col].dataType

    def count(batches):
        lengths = held(Lengths, file)
        for whole in batches:
            for batch in slices(whole, "_text"):
                column = texts(batch["_text"])
                n = lengths(column)
                yield pa.RecordBatch.from_arrays([batch["_id"], pc.binary_length(column).cast(pa.int64()), pa.array(n), pa.array(n > limit)], ["_id", "n_bytes", "n_tokens", "over_limit"])

    kind = f"_id {ids.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(count, kind).withColumnRenamed("_id", id_col)

"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words: positions that it ignores may differ. Hashes of benchmark and document
words under the same mask are joined; around each hit the overlap is extended both ways and verified, so that passages
with substituted words are found. What a hit carries of its texts reaches AROUND words each way; overlaps that go on
beyond are verified again on the whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, coded, cut, inside, mix, slices, texts, tidy, word_hashes, words

#: The masks, 1 for a word that counts. Of any 13 words or more with four fifths equal, one finds six.
MASKS = ("111111", "11010111", "110100001011", "10101100101")
#: Items of fewer words than LONG are found by the longest run that must be equal in the whole item, of four words at most.
LONG, SHORT = 13, ("1", "11", "111", "1111")
FILTER_BITS, PROBES = 24, 3
AROUND = 256
#: Packed benchmark windows, in bytes, up to which they are broadcast; larger ones are joined by a merge.
BROADCAST = 64 << 20
#: Overlaps that go on, in rows of a few numbers, up to which they are broadcast to the documents; more are joined.
FEW = 1 << 20


def normal(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Offsets, codes and distinct words of texts: lower case, anything but letters and digits as white space."""
    offsets, flat = words(pc.replace_substring_regex(pc.utf8_lower(column), r"[^\p{L}\p{N}]+", " "))
    return offsets, *coded(flat)


def seeds(h: np.ndarray, offsets: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place and hash of every window under a mask."""
    row, place, at = inside(offsets, len(mask))
    out = np.full(len(row), np.uint64(int(mask, 2)), np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[at + k]
    return row, place, mix(out)


def _hashed(batch: pa.RecordBatch, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    offsets, codes, distinct = normal(texts(batch["_text"]))
    return offsets, memo(distinct)[codes, 0] if distinct else np.zeros(0, np.uint64)


def _memo() -> Memo:
    return Memo(lambda w: word_hashes(w)[:, None], 1, np.uint64)


def overlap(doc: np.ndarray, at: int, item: np.ndarray, place: int, span: int, slack: int) -> tuple[int, int, int, bool, bool]:
    """The best stretch through a hit, of equal words +1 and others -2: item words from, to, how many are equal, and
    whether the search ended before the texts did, on the left and on the right.

    Each way it ends where the score falls `slack` below its best, or where a text ends.
    """
    low, high = max(0, place - at), min(len(item), place + len(doc) - at)
    same = doc[low + at - place : high + at - place] == item[low:high]
    value = np.where(same, 1, -2)

    def reach(v):
        total = np.cumsum(v)
        best = np.maximum.accumulate(np.maximum(total, 0))
        stop = np.flatnonzero(best - total >= slack)
        total = total[: stop[0]] if len(stop) else total
        return int(total.argmax()) + 1 if len(total) and total.max() > 0 else 0, len(stop) > 0

    left, right = reach(value[: place - low][::-1]), reach(value[place + span - low :])
    a, b = place - left[0], place + span + right[0]
    return a, b, int(same[a - low : b - low].sum()), left[1], right[1]


def run_length(n: np.ndarray, share: float) -> np.ndarray:
    """Words of the longest equal run, at least, where `share` or more of n words are equal; 1 to len(SHORT)."""
    differ = n - np.ceil(share * n - 1e-9).astype(np.int64)
    return np.clip(-(-(n - differ) // (differ + 1)), 1, len(SHORT))


def window(doc: np.ndarray, at: int, item: np.ndarray, place: int, length: int, share: float) -> tuple[int, int, int] | None:
    """The stretch of `length` or more words with the most equal words over `share`, as in overlap; None if all have fewer."""
    low, high = max(0, place - at), min(len(item), place + len(doc) - at)
    if high - low < length:
        return None
    same = doc[low + at - place : high + at - place] == item[low:high]
    total = np.concatenate([[0], np.cumsum(same - share)])
    best = np.minimum.accumulate(total[: len(total) - length])
    b = int((total[length:] - best[: len(total) - length]).argmax())
    a = int(total[: b + 1].argmin())
    b += length
    return (low + a, low + b, int(same[a:b].sum())) if total[b] - total[a] >= -1e-9 else None


def verified(doc: np.ndarray, at: int, item: np.ndarray, place: int, n: int, span: int, least: int, share: float, slack: int) -> tuple[tuple[int, int, int] | None, bool, bool]:
    """The stretch (item words from, to, equal ones) through a hit that is an overlap, if any, and where the search ended, as in overlap.

    n: words of the whole item, of which `item` may be a part.
    """
    a, b, same, *ended = overlap(doc, at, item, place, span, slack)
    found = (a, b, same) if b - a >= min(least, n) and same >= share * (b - a) - 1e-9 else window(doc, at, item, place, min(least, n), share)
    return found, *ended


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = 13, share: float = 0.8, slack: int = 9, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id, item, doc_start, item_start, n_words, n_equal: for each document and item its longest verified overlap.

    An overlap is a stretch of aligned words of which `share` or more are equal, `least` words long or as long as the
    item, if that is shorter. With `least` of 13 or more and a share of 0.8 or more none is missed: an item of 13 words or
    more is found by MASKS, a shorter one by a run of words that it must share, down to one word. Where the stretch of
    best score is too short, that of at least the length asked for counts. Of equally long ones with as many equal words
    the first counts. Words are runs of letters and digits in lower case. Null and empty texts and rows with a null id or
    item match nothing; rows that share an id count as one document or item. Documents without an overlap give no row;
    other columns are ignored.
    """
    ids, items = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    context = docs.sparkSession.sparkContext

    def of_items(batches):
        memo = _memo()
        for whole in batches:
            for batch in slices(whole, "_text", 2 << 20):
                offsets, h = _hashed(batch, memo)
                size = np.diff(offsets)
                run = np.where(size < LONG, len(MASKS) - 1 + run_length(size, share), -1)  # the mask of a short item
                for k, mask in enumerate([*MASKS, *SHORT]):
                    row, place, key = seeds(h, offsets, mask)
                    mine = run[row] == (k if k >= len(MASKS) else -1)
                    row, place, key = row[mine], place[mine], key[mine]
                    for a in range(0, len(row), 4096):
                        own = slice(a, a + 4096)
                        near = [(max(offsets[r], offsets[r] + p - AROUND), min(offsets[r + 1], offsets[r] + p + AROUND)) for r, p in zip(row[own], place[own])]
                        yield pa.RecordBatch.from_arrays([pa.array(key[own].view(np.int64)), pa.array(np.full(len(near), k, np.int32)), batch["_id"].take(pa.array(row[own])), pa.array(place[own]), pa.array([int(offsets[r] + p - x) for (x, _), r, p in zip(near, row[own], place[own])], pa.int64()), pa.array(np.diff(offsets)[row[own]]), pa.array([h[x:y].tobytes() for x, y in near], pa.binary())], ["key", "mask", "item", "item_place", "item_at", "item_words", "item_near"])

    kind = f"key long, mask int, item {items.simpleString()}, item_place long, item_at long, item_words long, item_near binary"
    known = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("_id"), F.col(item_text_col).alias("_text")).mapInArrow(tidy(of_items), kind)
    # A Bloom filter of a fixed size, whatever the benchmark's.
    low = known.select(F.explode(F.array(*(F.shiftrightunsigned("key", 13 * k).bitwiseAND((1 << FILTER_BITS) - 1).cast("int") for k in range(PROBES)))).alias("low")).distinct().toPandas()["low"].to_numpy(np.int64)
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[low] = True
    shipped = context.broadcast(np.packbits(bits))
    used = sorted(r[0] for r in known.select("mask").distinct().collect())

    def of_docs(batches):
        memo, bits = _memo(), np.unpackbits(shipped.value).astype(bool)
        for whole in batches:
            for batch in slices(whole, "_text", 2 << 20):
                offsets, h = _hashed(batch, memo)
                for k in used:
                    row, place, key = seeds(h, offsets, [*MASKS, *SHORT][k])
                    around = AROUND if k < len(MASKS) else LONG
                    hit = np.arange(len(key))
                    for probe in range(PROBES):
                        hit = hit[bits[((key[hit] >> np.uint64(13 * probe)) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)]]
                    for a in range(0, len(hit), 4096):
                        own = hit[a : a + 4096]
                        r, p = row[own], place[own]
                        start, end = np.maximum(offsets[r], offsets[r] + p - around), np.minimum(offsets[r + 1], offsets[r] + p + around)
                        yield pa.RecordBatch.from_arrays([pa.array(key[own].view(np.int64)), pa.array(np.full(len(own), k, np.int32)), batch["_id"].take(pa.array(r)), pa.array(p), pa.array(offsets[r] + p - start), pa.array(np.diff(offsets)[r]), pa.array([h[x:y].tobytes() for x, y in zip(start, end)], pa.binary())], ["key", "mask", "id", "place", "at", "words", "near"])

    kind = f"key long, mask int, id {ids.simpleString()}, place long, at long, words long, near binary"
    hits = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(tidy(of_docs), kind)

    seed = [len(m) for m in (*MASKS, *SHORT)]
    columns = ["id", "item", "doc_start", "item_start", "n_words", "n_equal", "goes_on", "place", "item_place", "span"]
    kind = f"id {ids.simpleString()}, item {items.simpleString()}, doc_start long, item_start long, n_words long, n_equal long, goes_on boolean, place long, item_place long, span int"

    def rows_of(batch, out):
        """The rows of a batch that gave a result (start in the document, in the item, words, equal, goes on, hit's places and span)."""
        chosen = pa.array([k for k, x in enumerate(out) if x], pa.int64())
        got = [x for x in out if x]
        kinds = [pa.int64()] * 4 + [pa.bool_(), pa.int64(), pa.int64(), pa.int32()]
        return pa.RecordBatch.from_arrays([batch["id"].take(chosen), batch["item"].take(chosen), *(pa.array([x[k] for x in got], t) for k, t in enumerate(kinds))], columns)

    def verify(batches):
        for batch in batches:
            out = []
            for mask, place, at, m, near, item_place, item_at, n, item_near in zip(*(batch[c].to_pylist() for c in ("mask", "place", "at", "words", "near", "item_place", "item_at", "item_words", "item_near"))):
                doc, item = np.frombuffer(near, np.uint64), np.frombuffer(item_near, np.uint64)
                good, left, right = verified(doc, at, item, item_at, n, seed[mask], least, share, slack)
                goes_on = not left and min(at, item_at) < min(place, item_place) or not right and min(len(doc) - at, len(item) - item_at) < min(m - place, n - item_place)
                out.append((place + good[0] - item_at, item_place + good[0] - item_at, good[1] - good[0], good[2], goes_on, place, item_place, seed[mask]) if good else None)
            best: dict[tuple, int] = {}  # of the hits of a pair, and of its stretches that go on, one is enough
            for k, own in enumerate(zip(batch["id"].to_pylist(), batch["item"].to_pylist())):
                if x := out[k]:
                    own = (*own, x[5] - x[6], x[5] // AROUND) if x[4] else own
                    if own in best and (x[3], x[2], -x[0], -x[1]) <= (lambda y: (y[3], y[2], -y[0], -y[1]))(out[best[own]]):
                        out[k] = None
                    elif own in best:
                        out[best[own]] = None
                    if out[k]:
                        best[own] = k
            yield rows_of(batch, out)

    # Spark cannot know how large the benchmark's windows are, so they are measured.
    size = known.agg(F.coalesce(F.sum(F.octet_length("item_near") + 64), F.lit(0))).first()[0]
    known = F.broadcast(known) if size <= BROADCAST else known.hint("merge")
    found = cut(hits.join(known, ["key", "mask"]).select("mask", "id", "place", "at", "words", "near", "item", "item_place", "item_at", "item_words", "item_near").mapInArrow(tidy(verify), kind))
    # One hit of each AROUND places of a diagonal stands for the others there, as it leads to the same stretch.
    on = found.where("goes_on").groupBy("id", "item", (F.col("place") - F.col("item_place")).alias("_"), F.floor(F.col("place") / AROUND).alias("__")).agg(F.min(F.struct("place", "item_place", "span")).alias("hit")).select("id", "item", "hit.*")
    open_hits = on.count()

    def again(batches):
        memo = _memo()
        for whole in batches:
            for batch in slices(whole, "_text", 2 << 20):
                (at, h), (item_at, g), out = _hashed(batch, memo), _hashed(batch.select(["_item_text"]).rename_columns(["_text"]), memo), []
                for k, (place, item_place, span) in enumerate(zip(*(batch[c].to_pylist() for c in ("place", "item_place", "span")))):
                    doc, item = h[at[k] : at[k + 1]], g[item_at[k] : item_at[k + 1]]
                    fits = place + span <= len(doc) and item_place + span <= len(item)  # else it is another row of the id
                    good = fits and verified(doc, place, item, item_place, len(item), span, least, share, slack)[0]
                    out.append((place + good[0] - item_place, good[0], good[1] - good[0], good[2], False, place, item_place, span) if good else None)
                yield rows_of(batch, out)

    if open_hits:
        on = F.broadcast(on) if open_hits <= FEW else on
        texts_of = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")).join(on, "id")
        whole = texts_of.join(benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("_item_text")), "item")
        found = found.unionByName(whole.select("id", "item", "place", "item_place", "span", "_text", "_item_text").mapInArrow(tidy(again), kind))
    best = F.max(F.struct("n_equal", "n_words", (-F.col("doc_start")).alias("back"), (-F.col("item_start")).alias("item_back"))).alias("m")
    return found.groupBy("id", "item").agg(best).select(F.col("id").alias(id_col), F.col("item").alias(item_col), (-F.col("m.back")).alias("doc_start"), (-F.col("m.item_back")).alias("item_start"), F.col("m.n_words").alias("n_words"), F.col("m.n_equal").alias("n_equal"))

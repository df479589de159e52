"""Best-fit packing: bounded-space online best fit over token pieces, the open bins in a bitset keyed by free space."""

from __future__ import annotations

import re
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import coded, held, slices, sums, texts, words

#: Lower-case words of letters that no Unicode normal form changes.
_PLAIN = re.compile(r"[a-zß-öø-ÿ]+").fullmatch
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


class Ids:
    """Token ids of texts for a byte-pair vocabulary that drops white space and case and splits letters from marks.

    Each word, lower-cased in A-Z and without a full stop or comma behind it, is encoded once and remembered, up to
    `most` words. Words of plain letters go through the model alone, many in one string: each gives one token that
    ends a word. The others go through the whole tokenizer one by one. Another kind of vocabulary is a ValueError.
    """

    def __init__(self, file: str, most: int = 400_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most = Tokenizer.from_file(file), most
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()
        probe = "The quick  brown fox's\tden, Été ça.\nDON'T stop... (it)."
        if self(pa.array([probe]))[1].tolist() != self.tokenizer.encode(probe, add_special_tokens=False).ids:
            raise ValueError(f"{file}: not a vocabulary of words without case")

    def clear(self) -> None:
        self.at, self.pool, self.used = {}, np.zeros(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def tidy(self, column: pa.Array) -> pa.Array:
        """The texts in lower case (A-Z), with a space before a full stop or comma between a letter and white space.

        Neither changes a token. Case stays where an added token, which heeds case, would else be met or lost.
        """
        low = pc.ascii_lower(column)
        if any(pc.any(pc.match_substring(low, t)).as_py() for t in self.added):
            low = column
        ends = np.frombuffer(low.buffers()[1], np.int32)[low.offset : low.offset + len(low) + 1].astype(np.int64) if len(low) else np.zeros(1, np.int64)
        if ends[-1] == ends[0]:
            return low
        data = np.frombuffer(low.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        ends -= ends[0]
        at = np.flatnonzero((data == ord(".")) | (data == ord(",")))
        last = ends[np.searchsorted(ends, at + 1)] == at + 1
        at = at[(ends[np.searchsorted(ends, at)] != at) & (last | _SPACE[data[np.minimum(at + 1, len(data) - 1)]])]
        before, lead = data[at - 1], data[np.maximum(at - 2, 0)]
        latin = (lead == 0xC3) & (before >= 0x9F) & (before != 0xB7) & (before < 0xC0)
        at = at[((before >= ord("a")) & (before <= ord("z"))) | latin]
        ends += np.searchsorted(at, ends)
        return pa.Array.from_buffers(pa.large_string(), len(low), [None, pa.py_buffer(ends), pa.py_buffer(np.insert(data, at, 32))])

    def learn(self, fresh: list[str]) -> None:
        plain, odd = [w for w in fresh if _PLAIN(w)], [w for w in fresh if not _PLAIN(w)]
        flat, size = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        if plain:
            many = [" ".join(plain[k : k + 500]) for k in range(0, len(plain), 500)]
            flat.extend(np.array(e.ids, np.uint32) for e in self.bare.encode_batch_fast(many, add_special_tokens=False))
            size.append(np.diff(np.flatnonzero(self.ends[np.concatenate(flat)]), prepend=-1))
            if len(size[-1]) != len(plain):
                raise ValueError("not a vocabulary that marks the ends of words")
        for k in range(0, len(odd), 20_000):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(odd[k : k + 20_000], add_special_tokens=False)]
            size.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat.append(np.fromiter(chain.from_iterable(ids), np.uint32, int(size[-1].sum())))
        flat, size, n = np.concatenate(flat), np.concatenate(size), len(self.at)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while n + len(size) > len(self.size):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.pool[self.used : self.used + len(flat)] = flat
        self.start[n : n + len(size)] = self.used + np.cumsum(size) - size
        self.size[n : n + len(size)] = size
        self.used += len(flat)
        self.at.update(zip(chain(plain, odd), range(n, n + len(size))))

    def rows(self, distinct: list[str]) -> np.ndarray:
        """Where each word's tokens are, learnt if need be."""
        if len(self.at) > self.most:
            self.clear()
        row = np.fromiter(map(self.at.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(row < 0)
        if len(new):
            fresh = [distinct[k] for k in new.tolist()]
            self.learn(fresh)
            row[new] = np.fromiter(map(self.at.__getitem__, fresh), np.int64, len(fresh))
        return row

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and flat ids of each text."""
        offsets, flat = words(self.tidy(column))
        codes, distinct = coded(flat)
        row = self.rows(distinct)[codes] if distinct else codes
        size = self.size[row]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.arange(total, dtype=np.int32) + np.repeat((self.start[row] - (ends - size)).astype(np.int32), size)]
        return np.concatenate([[0], np.cumsum(sums(size, offsets))]).astype(np.int64), ids


def pack(lengths: list[int], capacity: int, open_bins: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, in the order given.

    A piece goes to the open bin whose free space is the least that suffices. Without one, a bin is opened; if
    open_bins are open already, the fullest is closed first. A bin without free space closes at once.
    """
    bits, at, fill = 0, {}, []  # at: bins by free space; bits: the spaces that have one
    bins, offsets, opened = [], [], 0
    for need in lengths:
        above = bits >> need
        if above:
            free = need + (above & -above).bit_length() - 1
            own = at[free]
            k = own.pop()
            if not own:
                bits ^= 1 << free
        else:
            if opened == open_bins:
                fullest = (bits & -bits).bit_length() - 1
                at[fullest].pop()
                if not at[fullest]:
                    bits ^= 1 << fullest
                opened -= 1
            k, free = len(fill), capacity
            fill.append(0)
            opened += 1
        bins.append(k)
        offsets.append(fill[k])
        fill[k] += need
        free -= need
        if free:
            at.setdefault(free, []).append(k)
            bits |= 1 << free
        else:
            opened -= 1
    return bins, offsets


def pieces(docs: DataFrame, file: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of capacity tokens at most."""
    ids = docs.schema[id_col].dataType

    def cut_up(batches):
        encode = held(Ids, file)
        for whole in batches:
            for batch in slices(whole, "_text"):
                offsets, flat = encode(texts(batch["_text"]))
                row, piece, start, length, crc = [], [], [], [], []
                end = np.array([end_id], np.uint32)
                for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    own = np.concatenate([flat[a:b], end]).astype("<u4")
                    for p, s in enumerate(range(0, len(own), capacity)):
                        part = own[s : s + capacity]
                        row.append(k)
                        piece.append(p)
                        start.append(s)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                yield pa.RecordBatch.from_arrays([batch["_id"].take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["_id", "piece", "start", "length", "ids_crc32"])

    kind = f"_id {ids.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(cut_up, kind).withColumnRenamed("_id", id_col)


def best_fit(docs: DataFrame, file: str, capacity: int = 2048, open_bins: int = 512, per_packer: int = 65_536, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all texts with the sequence and the place in it that each gets: sequence_id, offset.

    One packer takes about per_packer pieces, dealt by a hash, and reads them in the order of that hash, so a lost
    task gives the same sequences again. Null and empty texts are the end token alone; equal ids are separate
    documents; an empty table gives an empty result; other columns are ignored.
    """
    n = docs.count()
    packers = max(1, -(-n // per_packer))
    ids = docs.schema[id_col].dataType

    def place(key, group):
        group = group.sort_by([(c, "ascending") for c in ("order", "_id", "piece", "ids_crc32", "length")])
        bins, offsets = pack(group["length"].to_pylist(), capacity, open_bins)
        sequence = np.asarray(bins, np.int64) + (np.int64(key[0].as_py()) << 40)
        return pa.table({c: group[c] for c in ("_id", "piece", "start", "length", "ids_crc32")} | {"sequence_id": pa.array(sequence), "offset": pa.array(offsets, pa.int64())})

    kind = f"_id {ids.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    dealt = pieces(docs, file, capacity, end_id, id_col, text_col).withColumnRenamed(id_col, "_id").withColumn("order", F.xxhash64("_id", "piece")).withColumn("packer", F.pmod("order", F.lit(packers)))
    return dealt.groupBy("packer").applyInArrow(place, kind).withColumnRenamed("_id", id_col)

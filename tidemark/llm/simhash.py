"""SimHash near-dedup with Golay-code fuzzy hashing.

A fingerprint is cut into three segments, each padded to the 23 bits of the perfect Golay code. The codewords nearest
to a segment and to its 23 neighbours give it up to six 12-bit indices; segments at distance two or less share one,
as they share a neighbour. At most four (even five) differing bits leave two segments with two errors or fewer, so
the pairs of indices of two segments are the join keys. Fingerprints that share a key are verified by Hamming
distance in their bucket, which yields a spanning forest of its links and never the pairs.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, coded, components, cut, inside, mix, parts, rolling, slices, spread_join, sums, texts, tidy, word_hashes, words

GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, of the (23, 12) Golay code
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # shift and bits


def _remainders() -> tuple[np.ndarray, np.ndarray]:
    """Remainder modulo the generator of each of the 23 bits, and the error pattern (weight 3 or less) of each of the 2048 remainders."""
    bit = []
    for k in range(23):
        r = 1 << k
        for j in range(22, 10, -1):
            if r >> j & 1:
                r ^= GENERATOR << (j - 11)
        bit.append(r)
    errors = np.zeros(2048, np.int64)
    for weight in range(1, 4):
        for at in itertools.combinations(range(23), weight):
            r = 0
            for k in at:
                r ^= bit[k]
            errors[r] = sum(1 << k for k in at)
    return np.array(bit), errors


_BIT, _ERROR = _remainders()
_LOW = np.zeros(1 << 12, np.int64)
_HIGH = np.zeros(1 << 11, np.int64)
for _k in range(12):
    _LOW[1 << _k : 2 << _k] = _LOW[: 1 << _k] ^ _BIT[_k]
for _k in range(11):
    _HIGH[1 << _k : 2 << _k] = _HIGH[: 1 << _k] ^ _BIT[12 + _k]


def decode(v: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword within three bits of each 23-bit vector."""
    return (v ^ _ERROR[_LOW[v & 0xFFF] ^ _HIGH[v >> 12]]) >> 11


def indices(v: np.ndarray) -> np.ndarray:
    """[vector, 6]: the distinct indices of each vector's ball of radius 1, -1 beyond the last."""
    ball = v[:, None] ^ np.concatenate([[0], 1 << np.arange(23)])
    own = np.sort(decode(ball), axis=1)
    new = np.concatenate([np.ones((len(v), 1), bool), own[:, 1:] != own[:, :-1]], axis=1)
    out = np.full((len(v), 6), -1, np.int64)
    row, col = np.nonzero(new)
    out[row, (np.cumsum(new, axis=1) - 1)[row, col]] = own[row, col]
    return out


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of every join key of 64-bit fingerprints."""
    rows, out = [], []
    own = [indices(((prints >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)) for shift, bits in SEGMENTS]
    for k, (a, b) in enumerate(itertools.combinations(range(3), 2)):
        key = (own[a][:, :, None] << 12) | own[b][:, None, :] | (k << 24)
        good = (own[a][:, :, None] >= 0) & (own[b][:, None, :] >= 0)
        row, i, j = np.nonzero(good)
        rows.append(row)
        out.append(key[row, i, j])
    return np.concatenate(rows), np.concatenate(out)


def fingerprint(text: str, shingle: int = 4, seed: int = 42, chunk: int = 65_536) -> int:
    """64-bit SimHash: a bit is 1 if set in over half of the hashes of the text's shingles; 0 without words."""
    import xxhash

    own = text.encode().lower().split()
    if not own:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(own) <= shingle:
        return digest(b" ".join(own), seed)
    joined = b" ".join(own)
    size = np.fromiter(map(len, own), np.int64, len(own))
    end = np.cumsum(size + 1) - 1
    start, end = (end - size)[: len(own) - shingle + 1], end[shingle - 1 :]
    total = np.zeros(64, np.int64)
    for at in range(0, len(start), chunk):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(start[at : at + chunk].tolist(), end[at : at + chunk].tolist())], ">u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(start)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, seeds: tuple[int, ...] = (42,), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and one long (fp0, fp1, ...) for each seed."""
    ids = docs.schema[id_col].dataType
    names = [f"fp{k}" for k in range(len(seeds))]

    def apply(batches):
        for whole in batches:
            for batch in slices(whole, "_text"):
                made = [[fingerprint(t, shingle, s) for t in texts(batch["_text"]).to_pylist()] for s in seeds]
                yield pa.RecordBatch.from_arrays([batch["_id"], *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in made)], ["_id", *names])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(tidy(apply), f"_id {ids.simpleString()}, " + ", ".join(f"{n} long" for n in names)).withColumnRenamed("_id", id_col)


def forest(prints: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join the components of one bucket: each member is compared once with those not yet reached."""
    left, out = np.arange(len(prints)), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(prints[left] ^ prints[at]).sum(axis=1) <= bits
            if near.any():
                found = left[near]
                out.append((np.full(len(found), at), found))
                queue.extend(found.tolist())
                left = left[~near]
    return out


def bucket_links(key: np.ndarray, prints: np.ndarray, bits: int, small: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Rows of linked members of the same bucket; prints: [row, word]. Enough links for its components, not all."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(s)))
    found = []
    for n in np.unique(size[(size > 1) & (size <= small)]).tolist():
        own = order[head[size == n][:, None] + np.arange(n)]
        for i in range(n - 1):
            for j in range(i + 1, n):
                near = np.bitwise_count(prints[own[:, i]] ^ prints[own[:, j]]).sum(axis=1) <= bits
                found.append((own[near, i], own[near, j]))
    for at, n in zip(head[size > small].tolist(), size[size > small].tolist()):
        own = order[at : at + n]
        found += [(own[a], own[b]) for a, b in forest(prints[own], bits)]
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in ([a for a, _ in found], [b for _, b in found]))


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components as a, b: each member but the least with the least of its component."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while len(u):
        low = np.minimum(root[u], root[v])
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        while (root[root] != root).any():
            root = root[root]
        open_ = root[u] != root[v]
        u, v = u[open_], v[open_]
    far = root != np.arange(len(ids))
    return ids[far], ids[root[far]]


PACKED = "to int, keys binary, at binary, ids binary, prints binary"


def packed(row: np.ndarray, key: np.ndarray, ids: np.ndarray, prints: np.ndarray, n: int) -> pa.RecordBatch:
    """Keys of rows by destination, of n: 32 bits of each key's hash, and each row's id and fingerprints once for a destination.

    Keys whose 32 bits agree in a destination share a bucket; members are compared there in any case.
    """
    mixed = mix(key)
    to = (mixed % np.uint64(n)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], np.diff(to[order]) > 0])) if len(order) else order
    out = []
    for a, b in zip(head, np.append(head[1:], len(order))):
        own = order[a:b]
        rows, at = np.unique(row[own], return_inverse=True)
        out.append((int(to[own[0]]), (mixed[own] >> np.uint64(32)).astype("<u4").tobytes(), at.astype("<u4").tobytes(), ids[rows].astype("<i8").tobytes(), prints[rows].astype("<u8").tobytes()))
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), *(pa.array([x[k] for x in out], pa.binary()) for k in range(1, 5))], ["to", "keys", "at", "ids", "prints"])


def unpacked(batches, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, the place of each one's owner, and the owners' ids and fingerprints [owner, word]."""
    key, at, ids, prints, n = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, words), np.uint64)], 0
    for batch in batches:
        for k, a, i, p in zip(*(batch[c].to_pylist() for c in ("keys", "at", "ids", "prints"))):
            key.append(np.frombuffer(k, "<u4"))
            at.append(np.frombuffer(a, "<u4") + n)
            ids.append(np.frombuffer(i, "<i8"))
            prints.append(np.frombuffer(p, "<u8").reshape(-1, words))
            n += len(ids[-1])
    return tuple(np.concatenate(x) for x in (key, at, ids, prints))


def link(prints: DataFrame, bits: int = 4, id_col: str = "doc_id") -> DataFrame:
    """id, the fingerprints, component_id: prints of fp0, fp1, ... linked where in all at most `bits` bits differ.

    Candidates share a Golay key of one of the fingerprints; with one fingerprint and 5 bits or fewer none is missed.
    """
    names = [c for c in prints.columns if c.startswith("fp")]
    prints = cut(prints)
    reps = cut(prints.groupBy(*names).agg(F.min(id_col).alias("rep"), F.count("*").alias("size")).where("rep is not null"))
    n = parts(reps, 4 << 20)

    def emit(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                batch = whole.slice(at, 4000)
                fps = np.stack([batch[c].to_numpy().view(np.uint64) for c in names], axis=1)
                made = [(row, key | (k << 26)) for k in range(len(names)) for row, key in [keys(fps[:, k])]]
                yield packed(*(np.concatenate(x) for x in zip(*made)), batch["rep"].to_numpy(), fps, n)

    def meet(batches):
        key, at, rep, fps = unpacked(batches, len(names))
        a, b = bucket_links(key, fps[at], bits)
        a, b = stars(rep[at[a]], rep[at[b]])  # a row for each member at most, and mostly the same ones from all tasks
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    edges = reps.select(F.col("rep").cast("long"), *names).repartition(n, "rep").mapInArrow(tidy(emit), PACKED).repartitionById(n, F.col("to")).mapInArrow(tidy(meet), "a long, b long")
    found = components(edges)
    owner = reps.join(found, F.col("rep") == F.col("id"), "left").select(*names, "size", F.coalesce("component", "rep").alias("component_id"))
    return spread_join(prints, owner, names, "size", prints.count()).select(id_col, *names, "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 4, bits: int = 4, seeds: tuple[int, ...] = (42,), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp0 (and fp1, ... for more seeds), component_id of each row.

    Words are lower-cased in ASCII and split at ASCII white space, shingles count with repeats; a text with fewer words
    than a shingle is one shingle; null, empty and wordless texts have fingerprint 0, linked like any other. Equal
    fingerprints are one class before any key is made. component_id is the least id reachable; a null id is never it,
    and is null where no other id is. Equal ids are fine; ids are integers; other columns are ignored.
    """
    return link(fingerprints(docs, shingle, seeds, id_col, text_col), bits, id_col)


BASE = 0x9E3779B97F4A7C15
#: Of similar(): fingerprints of a set (the first two give Golay keys, all are compared), bands of MinHash values and values a band.
PRINTS, KEYED, BANDS, WIDE = 3, 2, 16, 4
FILTER = 1 << 24


def shingle_sets(column: pa.Array, width: int, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and flat 64-bit hashes, ascending in each text: its distinct shingles; fewer words than `width` are one shingle."""
    offsets, flat = words(pc.ascii_lower(texts(column)))
    codes, distinct = coded(flat)
    h = memo(distinct)[codes, 0] if distinct else np.zeros(0, np.uint64)
    row, _, at = inside(offsets, width)
    made = rolling(h, width, BASE)[at]
    size = np.diff(offsets)
    short = np.flatnonzero((size > 0) & (size < width))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            more = size[short] > k
            whole[more] = whole[more] * np.uint64(BASE) + h[offsets[:-1][short[more]] + k]
        row, made = np.concatenate([row, short]), np.concatenate([made, mix(whole ^ mix(size[short].astype(np.uint64)))])
    order = np.lexsort((made, row))
    row, made = row[order], made[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (made[1:] != made[:-1])]) if len(row) else np.zeros(0, bool)
    return np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(size)))]), made[new]


def digests(offsets: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """64 bits that tell sets of hashes apart; 0 for an empty one."""
    size = np.diff(offsets).astype(np.uint64)
    return np.where(size > 0, mix(sums(mix(flat ^ np.uint64(BASE)), offsets) ^ mix(size)), np.uint64(0))


def set_prints(offsets: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """[set, PRINTS]: SimHashes of independent hashes of the members."""
    out = np.zeros((len(offsets) - 1, PRINTS), np.uint64)
    size, full = np.diff(offsets), np.flatnonzero(np.diff(offsets))
    for k in range(PRINTS if len(full) else 0):
        h = mix(flat ^ mix(np.uint64(k + 1)))
        ones = np.add.reduceat(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1), offsets[full], axis=0, dtype=np.int32)
        out[full, k] = np.packbits(2 * ones > size[full, None], axis=1).view(np.uint64)[:, 0]
    return out


def set_bands(offsets: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """[set, BANDS]: hashes of WIDE MinHash values each; 0 for an empty set."""
    out = np.zeros((len(offsets) - 1, BANDS), np.uint64)
    full = np.flatnonzero(np.diff(offsets))
    for k in range(BANDS if len(full) else 0):
        own = np.full(len(full), np.uint64(k), np.uint64)
        for j in range(WIDE):
            one = mix(np.uint64(1000 + WIDE * k + j)) | np.uint64(1)
            own = mix(own * np.uint64(BASE) + np.minimum.reduceat(flat * one, offsets[full]))
        out[full, k] = own
    return out


def similar_groups(offsets: np.ndarray, flat: np.ndarray, least: float) -> np.ndarray:
    """The least member connected to each set by links of Jaccard similarity `least` or more: each is compared once with those not yet reached."""
    n, size = len(offsets) - 1, np.diff(offsets)
    distinct, code = np.unique(flat, return_inverse=True)
    root, left = np.arange(n), np.arange(n)
    held, at = code, offsets  # the members of the sets that are left
    while len(left) > 1:
        first, queue = left[0], [left[0]]
        while queue:
            mark = np.zeros(len(distinct), bool)
            now = queue.pop()
            mark[code[offsets[now] : offsets[now + 1]]] = True
            both = sums(mark[held].astype(np.int64), at)
            near = (both > 0) & (both >= least * (size[left] + size[now] - both) - 1e-9)
            near |= left == first
            if near.any():
                found = left[near]
                root[found] = first
                queue.extend(found[found != first].tolist())
                held = held[np.repeat(~near, size[left])]
                left = left[~near]
                at = np.concatenate([[0], np.cumsum(size[left])])
            if not len(left):
                break
    return root


def similar(docs: DataFrame, width: int = 5, least: float = 0.8, bits: int = 48, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, component_id of each row: texts linked where the Jaccard similarity of their sets of `width`-word shingles is `least` or more.

    Words and short, null and empty texts are as in near_duplicates; texts without words are one class. Candidates
    share a Golay key of one of two SimHashes or a band of MinHash values, and differ in at most `bits` of 192 SimHash
    bits; of their components, the sets themselves are compared, so no link is below `least`, and one above is missed
    only where candidates do not connect it. Shingles and sets are told apart by 64 bits. component_id is the least id
    reachable; null ids as in near_duplicates.
    """
    ids = docs.schema[id_col].dataType.simpleString()
    names = [f"fp{k}" for k in range(PRINTS)]
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def sketch(batches):
        memo = Memo(lambda w: word_hashes(w)[:, None], 1, np.uint64)
        for whole in batches:
            for batch in slices(whole, "_text", 2 << 20):
                own = shingle_sets(batch["_text"], width, memo)
                made, bands = set_prints(*own), set_bands(*own)
                yield pa.RecordBatch.from_arrays([batch["_id"], pa.array(digests(*own).view(np.int64)), *(pa.array(made[:, k].copy().view(np.int64)) for k in range(PRINTS)), pa.array([b.tobytes() for b in bands], pa.binary())], ["_id", "node", *names, "bands"])

    prints = cut(rows.mapInArrow(tidy(sketch), f"_id {ids}, node long, " + ", ".join(f"{c} long" for c in names) + ", bands binary"))
    reps = cut(prints.groupBy("node").agg(F.min("_id").cast("long").alias("rep"), F.count("*").alias("size"), *(F.first(c).alias(c) for c in [*names, "bands"])).where("rep is not null"))
    n = parts(reps, 4 << 20)

    def emit(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                batch = whole.slice(at, 4000)
                fps = np.stack([batch[c].to_numpy().view(np.uint64) for c in names], axis=1)
                made = [(row, key | (k << 26)) for k in range(KEYED) for row, key in [keys(fps[:, k])]]
                bands = np.frombuffer(b"".join(batch["bands"].to_pylist()), np.uint64).reshape(-1, BANDS)
                row, col = np.nonzero(bands)
                made.append((row, ((bands[row, col] >> np.uint64(2)) | np.uint64(1 << 62)).view(np.int64)))
                yield packed(*(np.concatenate(x) for x in zip(*made)), batch["node"].to_numpy(), fps, n)

    def meet(batches):
        key, at, node, fps = unpacked(batches, PRINTS)
        a, b = bucket_links(key, fps[at], bits)
        a, b = stars(node[at[a]], node[at[b]])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    edges = reps.select("node", *names, "bands").repartition(n, "node").mapInArrow(tidy(emit), PACKED).repartitionById(n, F.col("to")).mapInArrow(tidy(meet), "a long, b long")
    near = cut(components(edges).join(reps.select(F.col("node").alias("id"), "rep"), "id"))
    # Texts are read again for members of candidate components only, told by bits of a fixed size, whatever the input's.
    bit = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(FILTER)) + 1
    maps = near.select(bit("rep").alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("m")).collect()
    wanted = np.zeros((FILTER >> 15, 1 << 12), np.uint8)
    for r in maps:
        wanted[r["k"] - 1] = np.frombuffer(bytes(r["m"]), np.uint8)
    shipped = context.broadcast(wanted.reshape(-1))

    def sets(batches):
        memo, chosen = Memo(lambda w: word_hashes(w)[:, None], 1, np.uint64), shipped.value
        for whole in batches:
            at = whole["bit"].to_numpy() - 1
            whole = whole.filter(pa.array((chosen[at >> 3] >> (at & 7) & 1).astype(bool)))
            for batch in slices(whole, "_text", 2 << 20):
                offsets, flat = shingle_sets(batch["_text"], width, memo)
                yield pa.RecordBatch.from_arrays([pa.array(digests(offsets, flat).view(np.int64)), pa.array([flat[a:b].tobytes() for a, b in zip(offsets, offsets[1:])], pa.binary())], ["id", "shingles"])

    def verify(batches):
        got = {}
        for batch in batches:
            for c, i, rep, own in zip(*(batch[x].to_pylist() for x in ("component", "id", "rep", "shingles"))):
                got.setdefault(c, {})[i] = rep, own
        for members in got.values():
            nodes = sorted(members, key=lambda i: members[i][0])
            flat = [np.frombuffer(members[i][1], np.uint64) for i in nodes]
            root = similar_groups(np.concatenate([[0], np.cumsum([len(x) for x in flat])]), np.concatenate(flat), least)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([members[nodes[k]][0] for k in root.tolist()], pa.int64())], ["node", "component_id"])

    own = rows.where("_id is not null").select(bit("_id").alias("bit"), "_text").mapInArrow(tidy(sets), "id long, shingles binary")
    found = own.join(near, "id").repartition(n, "component").mapInArrow(tidy(verify), "node long, component_id long")
    owner = reps.select("node", "rep", "size").join(found, "node", "left").select("node", "size", F.coalesce("component_id", "rep").alias("component_id"))
    return spread_join(prints.select("_id", "node"), owner, ["node"], "size", prints.count()).select(F.col("_id").alias(id_col), "component_id")

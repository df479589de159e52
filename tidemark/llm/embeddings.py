"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosine checks, connected components.

Equal vectors of a label are one class. A class meets others in the buckets of every table, where only a sketch of more
signs stands for its vector: classes whose sketches are near are candidates, of which a bucket keeps a spanning forest.
The vectors themselves travel once their component of candidates is known, to rooms in which every two members of a
component meet once; a room gives each class its number of links and a spanning forest of them, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, mix, parts, spread_join, tidy
from .simhash import forest, stars
from .substring_dedup import planes, unplanes

#: Signs of a sketch; members of a block of a product, of a bucket that is compared at once, and of a room's side.
SKETCH, BLOCK, SMALL, ROOM = 128, 1024, 2048, 4096
#: Bits of the filter of classes whose vectors are wanted.
FILTER = 24


def tables_for(n: int, cosine: float, miss: float = 1e-3, each: int = 512) -> tuple[int, int]:
    """Bits and tables for n vectors: about `each` vectors a bucket, and a pair at `cosine` missed with probability `miss`."""
    bits = max(6, math.ceil(math.log2(max(n, 1) / each + 1)))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-same))


def sketch_limit(cosine: float, miss: float = 1e-4) -> int:
    """Differing signs of sketches that a pair at `cosine` exceeds with probability `miss` at most."""
    p, tail, k = math.acos(cosine) / math.pi, 1.0, -1
    while tail > miss:
        k += 1
        tail -= math.comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k)
    return k


def signs(unit: np.ndarray, n: int, seed: int) -> np.ndarray:
    """[vector, n]: on which side of n random hyperplanes each vector is."""
    return unit @ np.random.default_rng(seed).standard_normal((unit.shape[1], n)) > 0


def unit_vectors(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and matrix of the vectors of each length in a list array without nulls."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    flat, size = column.flatten().to_numpy(zero_copy_only=False), np.diff(offsets)
    for d in np.unique(size).tolist():
        own = np.flatnonzero(size == d)
        yield own, flat[(offsets[own] - offsets[0])[:, None] + np.arange(d)]


def nodes(m: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """A 64-bit number of each class: a hash of the label's tag and the vector."""
    import xxhash

    m = m + 0.0  # one zero only
    return np.array([xxhash.xxh3_64_intdigest(v.tobytes(), int(t)) for v, t in zip(m, tags)], np.uint64).view(np.int64)


def tagged(labels: pa.Array, length: int) -> np.ndarray:
    import xxhash

    known = {x: xxhash.xxh3_64_intdigest(f"{length}:{x}") for x in labels.unique().to_pylist()}
    return np.array([known[x] for x in labels.to_pylist()], np.uint64)


def bucket_links(key: np.ndarray, sketch: np.ndarray, limit: int, small: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """Rows of members of the same bucket whose sketches, [row, word], differ in at most `limit` signs: enough of them for their components."""
    order = np.argsort(key, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0])) if len(key) else order
    a, b = [], []
    for x, y in zip(head, np.append(head[1:], len(key))):
        own = order[x:y]
        if len(own) > small:
            for p, q in forest(sketch[own], limit):
                a.append(own[p])
                b.append(own[q])
        elif len(own) > 1:
            s = 1 - 2 * np.unpackbits(sketch[own].view(np.uint8), axis=1).astype(np.float32)
            p, q = np.nonzero(np.triu(s @ s.T >= SKETCH - 2 * limit - 0.5, 1))
            a.append(own[p])
            b.append(own[q])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))


def room_links(unit: np.ndarray, tag: np.ndarray, weight: np.ndarray, other: np.ndarray | None, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a room: the weight of those that each member is linked with, and links that span its components.

    other: which members are of the second side, where only members of different sides meet; None where every two do.
    """
    sides = (np.arange(len(unit)),) * 2 if other is None else (np.flatnonzero(~other), np.flatnonzero(other))
    degree, a, b = np.zeros(len(unit), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, len(sides[0]), BLOCK):
        x = sides[0][i : i + BLOCK]
        for j in range(i if other is None else 0, len(sides[1]), BLOCK):
            y = sides[1][j : j + BLOCK]
            near = (unit[x] @ unit[y].T >= cosine) & (tag[x][:, None] == tag[y])
            if other is None and i == j:
                near = np.triu(near, 1)
            if near.any():
                degree[x] += near @ weight[y]
                degree[y] += weight[x] @ near
                p, q = stars(*(s[k] for s, k in zip((x, y), np.nonzero(near))))
                a.append(p)
                b.append(q)
    return degree, *stars(np.concatenate(a), np.concatenate(b))


def near_duplicates(rows: DataFrame, cosine: float = 0.93, miss: float = 1e-3, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, n_links, component_id, kept of each row.

    Rows link when their labels are equal and not null and their cosine, in double precision, is at least `cosine`;
    a pair at that cosine is missed with probability `miss` (and as much as a tenth of it by sketches) and nearer pairs
    less often. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do
    vectors of different lengths. Equal vectors link; each row counts, also of a repeated id. component_id is the least
    id reachable; a null id is never it and never kept, and component_id is null where no other id is. Classes are told
    apart by 64 bits. Ids are integers; other columns are ignored; an empty table gives an empty result.
    """
    context = rows.sparkSession.sparkContext
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    good = base.where(usable)
    bits, tables = tables_for(rows.count(), cosine, miss)
    wide = -(-bits // 8)

    def sketched(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                for own, m in by_length(batch["v"]):
                    tag = tagged(batch["label"].take(pa.array(own)), m.shape[1])
                    unit = unit_vectors(m)
                    side = np.packbits(signs(unit, tables * bits, 7).reshape(len(own), tables, bits), axis=2)
                    more = np.packbits(signs(unit, SKETCH, 8), axis=1)
                    yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(own)), pa.array(nodes(m, tag)), pa.array(tag.view(np.int64)), pa.array([x.tobytes() for x in side], pa.binary()), pa.array([x.tobytes() for x in more], pa.binary())], ["id", "node", "tag", "sides", "sketch"])

    lean = good.mapInArrow(tidy(sketched), "id long, node long, tag long, sides binary, sketch binary")
    classes = cut(lean.groupBy("node").agg(F.min("id").alias("rep"), F.count("*").alias("weight"), *(F.first(c).alias(c) for c in ("tag", "sides", "sketch"))))
    n = parts(classes, 1 << 18)

    def emit(batches):
        """Of each destination: keys, classes and sketches of all that goes there, in the order of the classes."""
        for batch in batches:
            node = batch["node"].to_numpy()
            order = np.argsort(node)
            node, tag = node[order], batch["tag"].to_numpy().view(np.uint64)[order]
            side = np.frombuffer(b"".join(batch["sides"].to_pylist()), np.uint8).reshape(-1, tables, wide)[order]
            sketch = np.frombuffer(b"".join(batch["sketch"].to_pylist()), np.uint64).reshape(-1, SKETCH // 64)[order]
            number = (side.astype(np.uint64) << (np.uint64(8) * np.arange(wide, dtype=np.uint64))).sum(axis=2) if wide <= 8 else mix(side.astype(np.uint64)).sum(axis=2)
            key = mix(tag[:, None] ^ mix(number + (np.arange(tables, dtype=np.uint64) << np.uint64(48)))).reshape(-1)
            to, row = (key % np.uint64(n)).astype(np.int64), np.repeat(np.arange(len(node)), tables)
            order = np.argsort(to, kind="stable")
            edge = np.flatnonzero(np.concatenate([[True], np.diff(to[order]) > 0])) if len(order) else order
            out = []
            for a, b in zip(edge, np.append(edge[1:], len(order))):
                own = order[a:b]
                out.append((int(to[own[0]]), planes((key[own] >> np.uint64(32)).astype("<u4")), planes(np.diff(node[row[own]], prepend=0).astype("<i8")), sketch[row[own]].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), *(pa.array([x[k] for x in out], pa.binary()) for k in (1, 2, 3))], ["to", "keys", "nodes", "sketches"])

    limit = sketch_limit(cosine)

    def meet(batches):
        got = [(unplanes(k, "<u4"), np.cumsum(unplanes(c, "<i8")), np.frombuffer(s, np.uint64).reshape(-1, SKETCH // 64)) for batch in batches for k, c, s in zip(*(batch[x].to_pylist() for x in ("keys", "nodes", "sketches")))]
        if got:
            key, node, sketch = (np.concatenate(x) for x in zip(*got))
            a, b = bucket_links(key, sketch, limit)
            a, b = stars(node[a], node[b])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    dealt = classes.select("node", "tag", "sides", "sketch").repartition(n, "node").mapInArrow(tidy(emit), "to int, keys binary, nodes binary, sketches binary").repartitionById(n, F.col("to"))
    near = components(dealt.mapInArrow(tidy(meet), "a long, b long"))
    sized = cut(near.join(near.groupBy("component").agg(F.count("*").alias("members")), "component").join(classes.select(F.col("node").alias("id"), "tag", "weight"), "id"))

    # Of the vectors only those of the candidates are dealt, one for each class; which, a filter of a fixed size tells.
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << FILTER)) + 1
    wanted = np.zeros(((1 << FILTER) >> 15, 1 << 12), np.uint8)
    for r in sized.select(bit("id").alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("m")).collect():
        wanted[r["k"] - 1] = np.frombuffer(bytes(r["m"]), np.uint8)
    some = context.broadcast(wanted.reshape(-1))

    def numbered(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                for own, m in by_length(batch["v"]):
                    yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(own)), pa.array(nodes(m, tagged(batch["label"].take(pa.array(own)), m.shape[1]))), batch["v"].take(pa.array(own))], ["id", "node", "v"])

    def chosen(batches):
        for batch in batches:
            at, bits = batch["bit"].to_numpy() - 1, some.value
            batch = batch.filter(pa.array((bits[at >> 3] >> (at & 7) & 1).astype(bool)))
            first = np.unique(batch["node"].to_numpy(), return_index=True)[1]
            batch = batch.take(pa.array(first))
            narrow = batch["v"].cast(pa.list_(pa.float32()), safe=False)
            exact = narrow.flatten().to_numpy(zero_copy_only=False).astype(float) == batch["v"].flatten().to_numpy(zero_copy_only=False)
            column = narrow if exact.all() else batch["v"]  # four bytes a component where they tell all
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array([np.asarray(v).tobytes() for v in np.split(column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()[1:-1] - column.offsets.to_numpy()[0])] if len(batch) else [], pa.binary()), pa.array(np.full(len(batch), 4 if exact.all() else 8, np.int32))], ["node", "v", "bytes"])

    own = good.mapInArrow(tidy(numbered), "id long, node long, v array<double>")
    vectors = own.select("node", "v", bit("node").alias("bit")).mapInArrow(tidy(chosen), "node long, v binary, bytes int").groupBy("node").agg(F.first("v").alias("v"), F.first("bytes").alias("bytes"))
    sides = F.ceil(F.col("members") / ROOM).cast("int")
    seated = sized.join(vectors, sized["id"] == vectors["node"]).select("component", "node", "tag", "weight", "v", "bytes", sides.alias("sides"), F.pmod(F.xxhash64("node"), sides).cast("int").alias("side"))
    rooms = seated.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("sides") - 1))).select("component", F.least("side", "with").alias("i"), F.greatest("side", "with").alias("j"), "side", "node", "tag", "weight", "v", "bytes")

    def settle(batches):
        def close(table):
            """Links of all whole rooms of a sorted table."""
            c, i, j, side, node, tag, weight, size = (table[x].to_numpy() for x in ("component", "i", "j", "side", "node", "tag", "weight", "bytes"))
            v = table["v"].to_pylist()
            head = np.flatnonzero(np.concatenate([[True], (np.diff(c) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)]))
            for a, b in zip(head, np.append(head[1:], len(c))):
                if b - a < 2:
                    continue
                degree, x, y, kinds = np.zeros(b - a, np.int64), [], [], np.array([len(z) // s for z, s in zip(v[a:b], size[a:b])])
                for d in np.unique(kinds).tolist():
                    own = a + np.flatnonzero(kinds == d)
                    unit = unit_vectors(np.stack([np.frombuffer(v[k], np.float32 if size[k] == 4 else np.float64).astype(float) for k in own.tolist()]))
                    more, p, q = room_links(unit, tag[own], weight[own], None if i[a] == j[a] else side[own] == j[a], cosine)
                    degree[own - a] += more
                    x.append(node[own[p]])
                    y.append(node[own[q]])
                linked = np.flatnonzero(degree)
                if len(linked):
                    p, q = np.concatenate(x), np.concatenate(y)
                    yield pa.RecordBatch.from_arrays([pa.array(node[a + linked]), pa.nulls(len(linked), pa.int64()), pa.array(degree[linked])], ["a", "b", "degree"])
                    yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q), pa.nulls(len(p), pa.int64())], ["a", "b", "degree"])

        kept = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
            c, i, j = (table[x].to_numpy() for x in ("component", "i", "j"))
            whole = int(np.flatnonzero((c != c[-1]) | (i != i[-1]) | (j != j[-1])).max(initial=-1)) + 1
            if whole:
                yield from close(table.slice(0, whole).combine_chunks())
            kept = table.slice(whole)
        if kept is not None and kept.num_rows:
            yield from close(kept.combine_chunks())

    found = cut(rooms.repartition(n, "component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(tidy(settle), "a long, b long, degree long"))
    degree = found.where("degree is not null").groupBy("a").agg(F.sum("degree").alias("degree"))
    joined = components(found.where("b is not null").select("a", "b")).join(classes.select(F.col("node").alias("id"), "rep"), "id")
    least = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    owner = classes.join(degree, F.col("node") == F.col("a"), "left").join(joined.join(least, "component").select("id", "component_id"), F.col("node") == F.col("id"), "left")
    owner = owner.select("node", "weight", (F.coalesce("degree", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    ends = spread_join(own.select("id", "node"), owner, ["node"], "weight", rows.count()).select("id", "n_links", "component_id")
    alone = base.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return ends.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))

"""Shared pieces: Arrow batches as flat word arrays, bounded samples, lineage cuts, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one call of a vectorised kernel gets; a longer document is a slice of its own.
SLICE_BYTES = 3 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Unset, a temporary one serves a local master; on a cluster that is an error."""
    context = spark.sparkContext
    known = context.getConf().get("spark.checkpoint.dir")
    if known:
        return known
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset: executors and driver need a folder that they share")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Has the session hand rows to Python by `rows` at a time, as texts are long: a batch stands in the JVM and in the worker at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(rows, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))))


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id's text modulo n; -1 for a null id, which belongs to no fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % n, F.lit(-1))


def release() -> None:
    """Gives freed memory back to the system: Arrow's pool and the C heap keep it otherwise, in each worker process."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about `most` bytes of text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        start = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, start + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def texts(column: pa.Array) -> pa.Array:
    return pc.fill_null(column.cast(pa.string()), "")


def ragged(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets (from 0) and values of a list array."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], lists.flatten()


def words(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words of each text, split at ASCII white space: offsets and a flat string array."""
    offsets, flat = ragged(pc.ascii_split_whitespace(column))
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        flat = flat.filter(pa.array(full))
    return offsets, flat


def coded(flat: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Code of each word, and the distinct words."""
    if not len(flat):
        return np.zeros(0, np.int64), []
    d = flat.dictionary_encode()
    return d.indices.to_numpy().astype(np.int64), d.dictionary.to_pylist()


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values in each run of offsets; 0 for an empty run. Runs are added one by one, without cancellation."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full], axis=0)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(distinct: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))


#: What a worker process keeps from task to task, one thing at a time.
HELD: dict[tuple, object] = {}


def held(kind: type, *args):
    """The worker's object of that kind and arguments, made if it holds another."""
    key = (kind, *args)
    if key not in HELD:
        HELD.clear()
        release()
        HELD[key] = kind(*args)
    return HELD[key]


def tidy(work):
    """A function of batches that gives memory back before and after its work, as worker processes outlive their tasks.

    What a worker still holds of another kind of work goes too.
    """

    def run(batches):
        HELD.clear()
        release()
        yield from work(batches)
        release()

    return run


class Memo:
    """Rows of numbers by word, filled by `make` for words not met yet; emptied beyond `most` words or `chars` characters."""

    def __init__(self, make, width: int, dtype=np.float64, most: int = 250_000, chars: int = 16 << 20):
        HELD.clear()
        self.make, self.width, self.dtype, self.most, self.chars = make, width, dtype, most, chars
        self.clear()

    def clear(self) -> None:
        self.at, self.size, self.rows = {}, 0, np.zeros((1024, self.width), self.dtype)

    def __call__(self, distinct: list[str]) -> np.ndarray:
        if len(self.at) > self.most or self.size > self.chars:
            self.clear()
        at, n = self.at, len(self.at)
        fresh = [w for w in distinct if w not in at]
        if fresh:
            made = self.make(fresh)
            at.update(zip(fresh, range(n, n + len(fresh))))
            self.size += sum(map(len, fresh))
            if n + len(fresh) > len(self.rows):
                grown = np.zeros((2 * (n + len(fresh)), self.width), self.dtype)
                grown[:n] = self.rows[:n]
                self.rows = grown
            self.rows[n : n + len(fresh)] = made
        return self.rows[np.fromiter((at[w] for w in distinct), np.int64, len(distinct))]


def share_limit(n: int, most: int) -> int:
    """The 64-bit signed number that about `most` of n evenly spread hashes stay below, whatever n; all do if n <= most."""
    return (1 << 63) - 1 if n <= most else (most << 64) // n - (1 << 63)


def bounded_sample(rows: DataFrame, by: str, key: str, most: int) -> DataFrame:
    """About `most` rows at most for each value of `by`, chosen by a 64-bit hash of `key`; for fitting only.

    The values of `by` are the classes of a model, so there are as many as it has outputs. Rows that share a key are
    chosen together.
    """
    limits = [x for r in rows.where(F.col(by).isNotNull()).groupBy(by).count().collect() for x in (F.lit(r[0]), F.lit(share_limit(r[1], most)))]
    if not limits:
        return rows.where("false")
    return rows.where(F.xxhash64(F.lit("sample"), F.col(key)) <= F.try_element_at(F.create_map(*limits), F.col(by)))


def stretch(text: str, key: str, most: int) -> Column:
    """The text if it has `most` characters or fewer, else a stretch of `most` from a place that a hash of key picks."""
    start = F.pmod(F.xxhash64(F.lit("stretch"), F.col(key)), F.greatest(F.lit(1), F.length(text) - most + 1)) + 1
    return F.when(F.length(text) <= most, F.col(text)).otherwise(F.substring(F.col(text), start.cast("int"), F.lit(most)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, key: str, text_col: str, most: int, longest: int) -> DataFrame:
    """key, label, text of about `most` rows at most for each 0/1 label; of a text over `longest` characters a stretch of so many.

    The labels are chosen first; as many as that are broadcast to the rows, so that no text is shuffled. Labels that
    are repeated count once, an id with both labels teaches nothing, and equal rows are one.
    """
    own = labels.where(F.col(label_col).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.min(label_col).cast("int").alias("label"), F.max(label_col).cast("int").alias("_other"))
    chosen = F.broadcast(bounded_sample(own.where("label = _other").select(key, "label"), "label", key, most))
    rows = docs.where(F.col(text_col).isNotNull() & F.col(key).isNotNull()).select(key, stretch(text_col, key, longest).alias(text_col))
    return rows.join(chosen, key).select(key, "label", text_col).distinct()


def hot_size(n: int, least: int = 256) -> int:
    """Rows of a key from which on it counts as hot among n rows: at most 100,000 keys do, at any n."""
    return max(least, n // 100_000)


def spread_join(rows: DataFrame, owner: DataFrame, keys: list[str], size: str, n: int) -> DataFrame:
    """rows left-joined with owner, which has one row for each key; size: its column of how many rows have the key, n in all.

    The hot keys of owner, 100,000 at most, are broadcast, so no key's rows meet in one task; the others are shuffled.
    """
    limit = hot_size(n)
    gets = [c for c in owner.columns if c not in (*keys, size)]
    hot = owner.where(F.col(size) > limit).select(*keys, F.lit(True).alias("_hot"), *(F.col(c).alias(f"_{c}") for c in gets))
    near = rows.join(F.broadcast(hot), keys, "left")
    # Rows that have their answer are spread by their own hash and meet nothing in the second join.
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*(F.col(c) for c in rows.columns)), F.lit(1 << 20)) + 1).otherwise(F.lit(0))
    rest = owner.where(F.col(size) <= limit).select(*keys, F.lit(0).cast("long").alias("_salt"), *gets)
    return near.withColumn("_salt", salt.cast("long")).join(rest, [*keys, "_salt"], "left").select(*rows.columns, *(F.when(F.col("_hot"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in gets))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b): (id, component), the least id of each component, for every id in an edge.

    Alternates large-star and small-star steps (Kiveris et al., 2014) as min-aggregates and joins, with the lineage cut
    each round, until the edges no longer change. No neighbourhood is gathered anywhere: a hub's edges get its least
    neighbour by a broadcast of the hubs, whose number is bounded.
    """

    def tally(e):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = tally(e)
    while last[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = spread_join(both.where("b > a"), least, ["a"], "n", 2 * last[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, low, ["a"], "n", last[0]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        e = cut(small.distinct())
        now = tally(e)
        if now == last:
            break
        last = now
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def parts(df: DataFrame, each: int = 32 << 20) -> int:
    """Shuffle partitions for df's input: as set for the session, or more where one would read over `each` bytes of it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = 0 if size >= 1 << 60 else size  # Spark's guess for rows of unknown size
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // each)


def rolling(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hash, modulo 2 ** 64, of every `width` consecutive numbers, from a running sum and powers of base (odd)."""
    n = len(h)
    if n < width:
        return np.zeros(0, np.uint64)
    power = np.cumprod(np.full(n, base, np.uint64))
    back = np.cumprod(np.full(n, pow(base, -1, 1 << 64), np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power)])
    return mix((total[width:] - total[:-width]) * back[: n - width + 1])


def inside(offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows of `width` words that lie in one text: the text, the place in it, the place in all words."""
    count = np.maximum(np.diff(offsets) - width + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return row, place, offsets[:-1][row] + place

"""The training-data pipeline: five stages over documents, each written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, packing, quality, secrets, simhash
from tidemark.llm.common import shared_dir, small_batches, table
from tidemark.llm.queries import learning_labels, vocabulary

#: Near duplicates: sets of five-word shingles of Jaccard similarity 0.8 or more. That is a cosine of 8/9, so an expected
#: 0.151 of the SimHash bits of candidates differ, 29 of 192; 48 is 3.8 standard deviations above.
SHINGLE, LEAST, BITS = 5, 0.8, 48


def _named(names: list[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in names]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects; it learns from labelled rows of its input.

    Each row is judged by its own text: equal texts fare alike, null and empty ones get the score of the bias, a score
    equal to the threshold stays. Rows without an id teach nothing. Without labels every score is 0.5 and all stay.
    """
    small_batches(spark)
    model = quality.fit(docs, learning_labels(spark, sf_dir, 5, 0))
    rest = docs.select(F.struct(*_named([c for c in docs.columns if c != "text"])).alias("_rest"), "text")
    kept = quality.score(rest, model, id_col="_rest", keep_text=True).where("predicted = 1")
    return kept.select(*(F.col("text") if c == "text" else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: that of least id, of rows without one if there is no other.

    Of several rows of the least id one stays. Null, empty and wordless texts are one group.
    """
    small_batches(spark)
    rows = docs.withColumn("_row", F.monotonically_increasing_id())  # the same in each scan of the files
    found = simhash.similar(rows.select("_row", "text"), SHINGLE, LEAST, BITS, "_row")
    first = found.join(rows.select("_row", "doc_id"), "_row").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("m"))
    return rows.join(first.select(F.col("m._row").alias("_row")), "_row", "left_semi").select(*_named(docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark passage.

    Each row is judged by its own text, also of a repeated or missing id. Null and empty texts stay, as does everything
    where the benchmark is empty; its rows without a text match nothing.
    """
    small_batches(spark)
    own = F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64("text").cast("string"))
    found = decontamination.overlaps(docs.select(own.alias("_own"), "text"), table(spark, sf_dir, "benchmark"), id_col="_own")
    return docs.withColumn("_own", own).join(found.select("_own").distinct(), "_own", "left_anti").select(*_named(docs.columns))


def drop_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret in the texts by its kind in angle brackets and counts n_chars anew; no document goes.

    A null text stays null, its n_chars too; repeated rows and ids fare alike.
    """
    small_batches(spark)
    return secrets.redact(docs, secrets.fit(docs)).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, packed into sequences. A null or empty text is its end token; each row is a document, also of a repeated or missing id."""
    small_batches(spark)
    return packing.best_fit(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality classifier", quality_filter), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("secret scans", drop_secrets), ("best-fit packing", pack)]

#: SQL can express none of the stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder and removed once the next one is there."""
    top = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{top}/{k}"
    return docs

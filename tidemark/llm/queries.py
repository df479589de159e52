"""The registered queries of this subpackage: thin digests of the operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, embeddings, language_id, packing, quality, secrets, simhash, substring_dedup, token_counts, toxicity
from .common import fold, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def learning_labels(spark: SparkSession, sf_dir: str, n: int, out: int) -> DataFrame:
    """Labels but those of the held-out fold."""
    return table(spark, sf_dir, "labels").where(~fold("doc_id", n).isin(out, -1))


def held(rows: DataFrame, n: int, out: int) -> DataFrame:
    """Adds held_out next to doc_id."""
    rest = [c for c in rows.columns if c != "doc_id"]
    return rows.select("doc_id", (fold("doc_id", n) == out).alias("held_out"), *rest)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = docs.where(~fold("doc_id", 3).isin(1, -1))
    return held(language_id.identify(docs, language_id.fit(learn, vocabulary("piece_bpe_32k.model"))), 3, 1)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return held(toxicity.score(docs, toxicity.fit(docs, learning_labels(spark, sf_dir, 3, 1))), 3, 1)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.fit(docs))

    def count(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = listed(F.filter("found", lambda s: s["kind"] != "crf"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return held(quality.score(docs, quality.fit(docs, learning_labels(spark, sf_dir, 5, 0))), 5, 0)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_best_fit_packing, op3_toxicity, op4_embedding_dedup, op5_decontamination, op6_simhash, op7_token_counts, op8_secrets, op9_quality, op10_substring_dedup)}

#: None of the ten has a query that SQL answers over whole tables in reasonable time; tests/llm holds them against
#: brute force, the tokenizer libraries or held-out labels.
ORACLE_SQL: dict[str, str] = {}

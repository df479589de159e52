"""Readers and writers of files: corpus, comparison log, series, archives, page texts."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.dates import period_start
from tidemark.functions.text import clean_pdf, content_id, unspace, word_count
from tidemark.schema import DOCUMENT, LOG


def is_missing(error: Exception) -> bool:
    """Whether a read failed as there is nothing at the path."""
    return "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder on whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A JSONL corpus under the fixed schema; a broken line fails. Word counts and ids are derived where missing."""
    docs = spark.read.schema(DOCUMENT).option("mode", "FAILFAST").json(path)
    words = F.when(F.coalesce("word_count", F.lit(0)) == 0, word_count(F.col("text")).cast("int")).otherwise(F.col("word_count"))
    own = content_id(F.col("date"), F.col("speaker"), F.col("title"), F.col("source_url"))
    return docs.withColumn("word_count", words).withColumn("id", F.coalesce("id", own))


def write_corpus(docs: DataFrame, path: str) -> str:
    """Writes to a new folder below path and returns it; earlier versions stay, so a failed write loses nothing."""
    import uuid

    to = f"{path.rstrip('/')}/v-{uuid.uuid4().hex}"
    docs.write.json(to)
    return to


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Comparison log without broken or incomplete lines."""
    rows = spark.read.schema(LOG).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad is null and a is not null and b is not null").drop("_bad")


def read_periods(spark: SparkSession, path: str) -> DataFrame:
    """(ts, value) of a statistics JSON: months, else quarters, else years, the first that is not empty; other values go."""
    item = "array<struct<year:string,quarter:string,month:string,value:string>>"
    raw = spark.read.schema(f"months {item}, quarters {item}, years {item}").option("multiLine", True).json(path)
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    rows = raw.select(F.inline(F.coalesce(some("months"), some("quarters"), some("years"))))
    month = F.month(F.try_to_date(F.concat_ws(" ", F.lit("1"), F.initcap("month"), F.lit("2000")), "d MMMM yyyy"))
    quarter = F.nullif(F.regexp_extract("quarter", r"(\d)", 1), F.lit(""))
    return rows.select(period_start(F.col("year").try_cast("int"), quarter.try_cast("int"), month).alias("ts"), F.col("value").try_cast("double").alias("value")).dropna()


def read_rates(spark: SparkSession, path: str, code: str) -> DataFrame:
    """(ts, value) of a CSV with a DATE column like `02 Jan 2024` and one named by the code; bad cells go."""
    raw = spark.read.option("header", True).csv(path)
    if code not in raw.columns:
        return raw.select(F.lit(None).cast("date").alias("ts"), F.lit(None).cast("double").alias("value")).where("false")
    return raw.select(F.try_to_date("DATE", "dd MMM yyyy").alias("ts"), F.col(code).try_cast("double").alias("value")).dropna()


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all CSV files in ZIP archives: url, title, description, date, text, author."""
    fields = ["url", "title", "description", "date", "text", "author"]

    def unzip(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(n for n in z.namelist() if n.endswith(".csv")):
                        reader = csv.DictReader(io.TextIOWrapper(z.open(name), "utf-8", "replace"))
                        while rows := [[r.get(f) for f in fields] for _, r in zip(range(1000), reader)]:
                            yield pd.DataFrame(rows, columns=fields)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unzip, ", ".join(f"{f} string" for f in fields))


def archive_filter(rows: DataFrame, bank: str, others: str, start: int = 0, end: int = 0) -> DataFrame:
    """Archive rows whose description names the bank and no other, with 400 characters or more, an author and a date."""
    day = F.try_to_date(F.substring("date", 1, 10))
    out = rows.where(F.col("description").rlike(f"(?i){bank}") & ~F.col("description").rlike(f"(?i){others}") & (F.length("text") >= 400) & (F.btrim("author") != "") & day.isNotNull())
    out = out.withColumn("date", day).withColumn("title", F.substring("title", 1, 220))
    return year_bounds(out, F.year("date"), start, end)


def year_bounds(rows: DataFrame, year: Column, start: int = 0, end: int = 0) -> DataFrame:
    """Rows within inclusive years; 0 leaves a side open."""
    rows = rows.where(year >= start) if start else rows
    return rows.where(year <= end) if end else rows


def read_pdfs(spark: SparkSession, path: str, pages: Callable[[bytes], list[str]]) -> DataFrame:
    """path, pages of PDF files; a file that the given parser cannot read has none."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = []
            for content in part["content"]:
                try:
                    got.append(list(pages(content)))
                except Exception:  # whatever a parser raises on a broken file
                    got.append([])
            yield pd.DataFrame({"path": part["path"], "pages": got})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, pages array<string>")


def pdf_texts(pages: DataFrame, headers: Sequence[str] = ()) -> DataFrame:
    """path, text of read_pdfs' result: all pages joined, cleaned and, where need be, closed up; empty for a file without pages."""
    whole = clean_pdf(F.array_join("pages", "\n"), headers)
    return pages.select("path", unspace(whole).alias("text"))


def staged(spark: SparkSession, keys: DataFrame, key: str, path: str, load: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of the staging table at path for keys; those that it lacks are loaded and appended first.

    load takes a DataFrame of the missing keys and returns rows with the key; so a page, a PDF's pages or a series is
    fetched once. Rows are never refreshed; remove the table to fetch anew.
    """
    own = keys.select(key).distinct()
    try:
        missing = own.join(spark.read.parquet(path).select(key), key, "left_anti")
    except Exception as e:
        if not is_missing(e):
            raise
        missing = own
    load(missing).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(own, key, "left_semi").dropDuplicates([key])


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a published output (one JSON object with an array `speeches`) that have a rating."""
    item = "array<struct<id:string,d:date,m:double,ma:double,s:double,n:int,ds:double,dsa:double,a:string,tt:string,st:string,wc:int,inst:string>>"
    return spark.read.schema(f"speeches {item}").option("multiLine", True).json(path).select(F.inline("speeches")).where("m is not null")


def read_overlay(spark: SparkSession, path: str) -> DataFrame:
    """series, d, v of an overlay (one JSON object whose `series` maps a name to its points)."""
    kind = "series map<string,struct<label:string,unit:string,shape:string,data:array<array<string>>>>"
    raw = spark.read.schema(kind).option("multiLine", True).json(path).select(F.explode("series").alias("series", "own"))
    return raw.select("series", F.explode("own.data").alias("p")).select("series", F.try_to_date(F.get("p", F.lit(0))).alias("d"), F.get("p", F.lit(1)).try_cast("double").alias("v")).dropna()

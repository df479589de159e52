"""Addresses and pages: sitemaps, fetches, generated addresses, assembly of sources."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.dedup import keep_first
from tidemark.sources.files import staged, year_bounds


def sitemap_urls(sitemaps: DataFrame, xml: str, pattern: str, start: int = 0, end: int = 0) -> DataFrame:
    """url, year of the sitemaps' entries that match pattern, whose first group is the year; newest first."""
    urls = sitemaps.select(F.explode(F.regexp_extract_all(xml, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("url"))
    rows = urls.where(F.col("url").rlike(pattern)).select("url", F.regexp_extract("url", pattern, 1).try_cast("int").alias("year")).distinct()
    return year_bounds(rows, F.col("year"), start, end).orderBy(F.desc("year"), "url")


def month_gaps(spark: SparkSession, seen: DataFrame, first: int, last: int, recent: str, early: str, turn: int = 2000) -> DataFrame:
    """year, month, url of the months without a row in seen(year, month); years up to `turn` use the early template."""
    months = spark.sql(f"SELECT y AS year, m AS month FROM (SELECT explode(sequence({first}, {last})) AS y) LATERAL VIEW explode(sequence(1, 12)) t AS m")
    name = F.date_format(F.make_date("year", "month", F.lit(1)), "MMMM")
    fill = lambda t: F.replace(F.replace(F.lit(t), F.lit("{year}"), F.col("year").cast("string")), F.lit("{month}"), F.lower(name))
    return months.join(seen, ["year", "month"], "left_anti").withColumn("url", F.when(F.col("year") <= turn, fill(early)).otherwise(fill(recent)))


def fetch(urls: DataFrame, get: Callable[[str], tuple[int, bytes]], tries: int = 3, at_once: int = 8, wait: float = 0.0) -> DataFrame:
    """url, status, content, error of each address, by `get`, in at_once partitions.

    403, 404 and 410 end at once; other failures are tried again here, not by task retries, and leave an error.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for url in part["url"]:
                status, content, error = None, None, None
                for k in range(tries):
                    try:
                        status, content = get(url)
                        error = None
                    except Exception as e:  # whatever a client raises
                        error = str(e)[:200]
                    if error is None and status < 400:
                        break
                    content, error = None, error or f"status {status}"
                    if status in (403, 404, 410):
                        break
                    time.sleep(wait * k)
                out.append((url, status, content, error))
            yield pd.DataFrame(out, columns=["url", "status", "content", "error"]).astype({"status": "Int32"})

    return urls.select("url").repartition(at_once).mapInPandas(run, "url string, status int, content binary, error string")


def decoded(content: Column, declared: Column | None = None) -> Column:
    """Bytes as text: in UTF-8 if they are, whatever Latin-1 or ASCII a server declares by default; else as declared, or Latin-1."""
    as_utf8 = F.try_validate_utf8(content.cast("string"))
    latin = F.decode(content, F.lit("ISO-8859-1"))
    if declared is None:
        return F.coalesce(as_utf8, latin)
    wide = F.lower(declared).isin("utf-16", "utf-16le", "utf-16be")
    return F.when(wide, F.decode(content, F.lit("UTF-16"))).otherwise(F.coalesce(as_utf8, latin))


def fetch_once(spark: SparkSession, urls: DataFrame, path: str, get: Callable[[str], tuple[int, bytes]], **how) -> DataFrame:
    """url, text of each address, fetched where the staging table at path lacks it; failures are not staged."""
    load = lambda missing: fetch(missing, get, **how).where("content is not null").select("url", decoded(F.col("content")).alias("text"))
    return staged(spark, urls, "url", path, load)


def ask(prompts: DataFrame, prompt: str, post: Callable[[str], tuple[int, str, float | None]], tries: int = 8, longest: float = 60.0, at_once: int = 8, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """prompts with reply and error, by `post`, which gives a status, a body and the wait that the server asks for, if any.

    429 and 5xx are tried again after that wait, or after a doubling one with a share by the prompt's hash, `longest`
    seconds at most; other statuses of 400 and more fail at once. A failure leaves an error, so others are not lost.
    """
    kind = prompts.select("*", *(F.lit(None).cast("string").alias(c) for c in ("reply", "error"))).schema

    def one(text: str) -> tuple[str | None, str | None]:
        error = None
        for k in range(tries):
            try:
                status, body, wait = post(text)
            except Exception as e:  # whatever a client raises
                status, body, wait, error = 599, "", None, str(e)[:200]
            if status < 400:
                return body, None
            error = error if status == 599 and error else f"status {status}"
            if status != 429 and status < 500:
                break
            if k + 1 < tries:
                sleep(min(longest, wait if wait is not None else 2.0**k + zlib.crc32(f"{k}{text}".encode()) / 2**32))
        return None, error

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = [one(t) for t in part[prompt]]
            yield part.assign(reply=[r for r, _ in got], error=[e for _, e in got])

    return prompts.repartition(at_once).mapInPandas(run, kind)


def assemble(sources: Sequence[tuple[str, Callable[[], DataFrame]]], key: str, order: str, skip: Sequence[str] = ()) -> tuple[DataFrame | None, dict[str, str]]:
    """All sources' rows, the first of each key in the sources' order, and the errors of sources that could not be planned."""
    frames, failed = [], {}
    for rank, (name, load) in enumerate(sources):
        if name in skip:
            continue
        try:
            frames.append(load().withColumn("_source", F.lit(rank)))
        except Exception as e:  # one source's failure is not the others'
            failed[name] = str(e)[:200]
    if not frames:
        return None, failed
    both = frames[0]
    for f in frames[1:]:
        both = both.unionByName(f)
    return keep_first(both, key, F.col("_source"), F.col(order)).drop("_source"), failed

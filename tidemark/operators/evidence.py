"""Landing pages and evidence sessions: from fetched pages to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import MONTHS, document_date
from tidemark.functions.text import clean_title, meta, speaker, strip_html
from tidemark.operators.corpus import type_of
from tidemark.operators.dedup import keep_first
from tidemark.operators.transcript import last_name, listed, qa_blocks, resolve_witness, turns, witness_documents, witnesses

#: Characters that a document needs; the series of sessions that are read, and the marks of a listing's cards.
SHORTEST = 800
SERIES = r"(?i)monetary policy report|inflation report"
CARD = '<div class="card card-button card-publication">'


def _some(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def landing_documents(pages: DataFrame, institution: str) -> DataFrame:
    """Documents of pages(url, html, title, body, stated_date, pdf_text).

    The text is the PDF's, or the page's own where that of the PDF is short and the page's longer. Pages without a
    title, of a missing page, or without 800 characters, a speaker or a date give none.
    """
    pdf, body = F.coalesce("pdf_text", F.lit("")), F.coalesce("body", F.lit(""))
    text = F.when((F.length(pdf) < SHORTEST) & (F.length(body) > F.length(pdf)), body).otherwise(pdf)
    own = pages.withColumn("_text", text).where((F.length("_text") >= SHORTEST) & (F.btrim("title") != "") & ~F.startswith(F.lower(F.btrim("title")), F.lit("page not found")))
    own = own.withColumn("_speaker", speaker(F.col("title"), meta(F.col("html"), "og:description"), F.col("url"))).withColumn("_date", document_date(F.col("_text"), F.col("stated_date"), F.col("url")))
    own = own.where(F.col("_speaker").isNotNull() & F.col("_date").isNotNull())
    return own.select(F.col("_date").alias("date"), F.col("_speaker").alias("speaker"), F.substring(clean_title(F.btrim("title")), 1, 220).alias("title"), F.col("_text").alias("text"), type_of(F.col("title")).alias("source_type"), F.lit(institution).alias("institution"), F.col("url").alias("source_url"))


def sessions(listings: DataFrame, page: str, html: str, site: str) -> DataFrame:
    """date, category, url of the listings' sessions of the series that have a transcript page and a date; newest first, each address once."""
    cards = listings.select(F.col(page).alias("_page"), F.posexplode(F.slice(F.split(html, CARD), 2, 1 << 20)).alias("_at", "card"))
    card = F.element_at(F.split("card", '<div class="section" id="pagination'), 1)
    category = strip_html(F.regexp_extract(card, r'<span class="label">(?:Work|Inquiry)</span>([^<]*)', 1))
    link = _some(card, r'href="(/oralevidence/\d+/html/)"')
    shown = F.regexp_extract(F.regexp_extract(card, r'<div class="primary-info">([^<]+)</div>', 1), rf"(?i)(\d{{1,2}}\s+(?:{MONTHS})\s+(?:19|20)\d{{2}})", 1)
    day = F.try_to_date(F.initcap(F.regexp_replace(shown, r"\s+", " ")), "d MMMM yyyy")
    found = cards.select("_page", "_at", day.alias("date"), category.alias("category"), F.concat(F.lit(site), link).alias("url")).where(F.col("category").rlike(SERIES) & F.col("url").isNotNull() & F.col("date").isNotNull())
    return keep_first(found, "url", F.col("_page"), F.col("_at")).select("date", "category", "url").orderBy(F.desc("date"), "url")


def session_documents(found: DataFrame, pages: DataFrame, roster: DataFrame, institution: str, least_words: int = 250, start: int = 0, end: int = 0) -> DataFrame:
    """Documents of the witnesses of found(date, category, url) sessions, whose transcripts are pages(url, html); roster(name) has who counts.

    A turn is its witness's where its label names them; every other turn is a question.
    """
    from tidemark.sources.files import year_bounds

    own = year_bounds(found, F.year("date"), start, end).join(pages.select("url", "html"), "url")
    lists = listed(own, "url", "html")
    known = witnesses(lists, "url", F.col("witnesses"), roster)
    spoken = turns(own, "url", "html").withColumn("surname", last_name(F.col("label")))
    committee = F.array_distinct(F.transform(F.split(F.coalesce("members", F.lit("")), r"[;,]|\band\b"), last_name))
    members = lists.select("url", F.explode(committee).alias("surname")).where("surname <> ''").withColumn("_shared", F.lit(True))
    named = spoken.join(known, ["url", "surname"], "left").join(members, ["url", "surname"], "left")
    titled = F.col("label").rlike(r"(?i)^(?:Sir|Dame|Dr|Professor|Prof|Lord|Lady|Baroness|Governor)\b")
    named = named.withColumn("witness", F.when(F.col("_shared").isNull() | titled, F.col("witness"))).select("url", "turn", "witness", "text")
    blocks = qa_blocks(named, ["url"], "turn", F.col("witness").isNull())
    texts = witness_documents(blocks, ["url"], "turn", "witness", "text", least_words)
    title = F.concat(F.lit("Oral evidence: "), F.col("category"))
    return texts.join(own.select("url", "date", "category"), "url").select("date", F.col("witness").alias("speaker"), title.alias("title"), F.col("document").alias("text"), F.lit("testimony").alias("source_type"), F.lit(institution).alias("institution"), F.col("url").alias("source_url"))


__all__ = ["landing_documents", "resolve_witness", "session_documents", "sessions"]

"""Transcripts: turns, question-and-answer blocks, and a document for each witness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import strip_html, word_count


#: How a transcript opens the lines that list the committee and the witnesses, and a question's number.
MEMBERS_LINE, WITNESS_LINE, QUESTION_NUMBER = r"(?i)Members present:\s*(.+?)(?:\.|$)", r"(?i)^Witness(?:es)?:\s*(.+)$", r"^Q\d+\s*"


def paragraphs(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, turn, p, text: the paragraphs of a page that have a text, in order."""
    found = F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1))).alias("turn", "p")
    return pages.select(key, found).withColumn("text", strip_html(F.col("p"))).where("text <> ''")


def turns(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, turn, label, text: paragraphs of a page with the last bold label at or before each; those before the first go.

    A label loses the question's number before it; a bold text that is only that, or opens with Q, is none. The lines
    that list the committee (the first) and the witnesses are no turns. The text keeps number and label.
    """
    own = paragraphs(pages, key, html)
    first = F.min(F.when(F.col("text").rlike(MEMBERS_LINE), F.col("turn"))).over(Window.partitionBy(key))
    own = own.withColumn("_first", first).where("(_first is null or turn <> _first)").where(~F.col("text").rlike(WITNESS_LINE))
    bold = F.regexp_extract("p", r"(?is)<(?:b|strong)\b[^>]*>(.*?)</(?:b|strong)>", 1)
    wide = F.regexp_extract("p", r"(?is)<span[^>]*font-weight:\s*bold[^>]*>(.*?)</span>", 1)
    label = F.regexp_replace(strip_html(F.when(bold != "", bold).otherwise(wide)), QUESTION_NUMBER, "")
    label = F.nullif(F.btrim(F.regexp_replace(F.btrim(label), r":+$", "")), F.lit(""))
    rows = own.select(key, "turn", "text", label.alias("_bold")).withColumn("_label", F.when(~F.startswith("_bold", F.lit("Q")), F.col("_bold")))
    return forward_fill(rows.select(key, "turn", "_label", "text"), [key], "turn", "_label", "label")


def listed(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, members, witnesses: what a page's lines list; witnesses of several lines are joined by semicolons."""
    own = paragraphs(pages, key, html)
    members = F.nullif(F.regexp_extract("text", MEMBERS_LINE, 1), F.lit(""))
    witness = F.nullif(F.regexp_extract("text", WITNESS_LINE, 1), F.lit(""))
    rows = own.select(key, "turn", members.alias("m"), witness.alias("w")).where("m is not null or w is not null")
    names = F.array_sort(F.collect_list(F.when(F.col("w").isNotNull(), F.struct("turn", "w"))))
    return rows.groupBy(key).agg(F.min_by("m", F.when(F.col("m").isNotNull(), F.col("turn"))).alias("members"), F.array_join(F.transform(names, lambda x: x["w"]), "; ").alias("witnesses"))


#: Honorifics before a name, and the numerals of a panel of witnesses.
HONORIFIC, PANEL = r"(?i)^(?:Rt\s+Hon\s+|(?:Dr|Sir|Dame|Lord|Baroness|Professor|Prof|Mr|Mrs|Ms|Miss)\.?\s+)", r"^(?:I{1,3}|IV)\s*:\s*"


def last_name(name: Column) -> Column:
    """The last word of a name in lower case, without its honorific, initials and what a bracket or comma opens."""
    bare = F.regexp_replace(F.regexp_replace(F.btrim(name), HONORIFIC, ""), r"\s*[(,].*$", "")
    return F.lower(F.coalesce(F.get(F.reverse(F.filter(F.split(bare, r"\s+"), lambda w: F.length(w) > 1)), F.lit(0)), F.lit("")))


def witnesses(lists: DataFrame, key: str, line: str, roster: DataFrame) -> DataFrame:
    """key, surname, witness: those in a witness line who are on roster(name).

    Names, offices and institutions stand between the same marks, so each piece of two words or more is tried. Where
    two share a surname the later one counts.
    """
    piece = F.posexplode(F.split(line, r"[;,]|(?<![A-Z])\band\b")).alias("at", "piece")
    bare = F.btrim(F.regexp_replace(F.regexp_replace("piece", r"\s*\(.*$", ""), r"^[\s.]+|[\s.]+$", ""))
    name = F.btrim(F.regexp_replace(F.btrim(F.regexp_replace(bare, PANEL, "")), HONORIFIC, ""))
    tried = lists.select(key, piece).select(key, "at", name.alias("name")).where(F.size(F.split("name", r"\s+")) >= 2)
    known = tried.join(roster.select(F.col("name").alias("_name"), *(["canonical"] if "canonical" in roster.columns else [])), F.lower("name") == F.lower("_name"))
    person = F.coalesce("canonical", "_name") if "canonical" in roster.columns else F.col("_name")
    return known.select(key, "at", person.alias("witness"), last_name(person).alias("surname")).groupBy(key, "surname").agg(F.max_by("witness", "at").alias("witness"))


def forward_fill(rows: DataFrame, by: list[str], order: str, value: str, out: str) -> DataFrame:
    """rows with the last value that is not null so far; those before the first go."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(w)).where(F.col(out).isNotNull()).drop(*([value] if value != out else []))


def qa_blocks(rows: DataFrame, by: list[str], order: str, question: Column) -> DataFrame:
    """rows with is_question and block: a block opens where a question follows an answer."""
    w = Window.partitionBy(*by).orderBy(order)
    marked = rows.withColumn("is_question", question)
    opens = F.coalesce(F.col("is_question") & ~F.lag("is_question").over(w), F.lit(False)).cast("int")
    return marked.withColumn("_opens", opens).withColumn("block", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def witness_documents(blocks: DataFrame, by: list[str], order: str, witness: str, text: str, least_words: int = 250) -> DataFrame:
    """by, witness, document, n_words: for each witness the answers, each block's questions once before their first there.

    n_words counts the witness's own words; documents with fewer than least_words go. blocks is the result of qa_blocks.
    """
    questions = blocks.where("is_question").select(*by, "block", F.col(order).alias("_order"), F.col(text).alias("_text"))
    answers = blocks.where(~F.col("is_question") & F.col(witness).isNotNull())
    served = answers.select(*by, "block", witness).distinct().join(questions, [*by, "block"])
    parts = answers.select(*by, witness, "block", F.lit(1).alias("_kind"), F.col(order).alias("_order"), F.col(text).alias("_text")).unionByName(served.select(*by, witness, "block", F.lit(0).alias("_kind"), "_order", "_text"))
    texts = F.array_sort(F.collect_list(F.struct("block", "_kind", "_order", "_text")))
    words = F.sum(F.when(F.col("_kind") == 1, word_count(F.col("_text"))).otherwise(0))
    out = parts.groupBy(*by, witness).agg(F.array_join(F.transform(texts, lambda t: t["_text"]), "\n\n").alias("document"), words.alias("n_words"))
    return out.where(F.col("n_words") >= least_words)


def resolve_witness(rows: DataFrame, witnesses: DataFrame, label: str, members: DataFrame) -> DataFrame:
    """rows with the witness that a label's surname names; if a member shares the surname, the label needs an honorific.

    witnesses(surname, witness) and members(surname) are keyed by surname; others give a null witness.
    """
    own = rows.withColumn("surname", F.element_at(F.split(F.btrim(label), r"\s+"), -1)).join(witnesses, "surname", "left").join(members.select("surname", F.lit(True).alias("_shared")).distinct(), "surname", "left")
    titled = F.col(label).rlike(r"^(?:Sir|Dame|Dr|Professor|Lord|Lady|Mr|Mrs|Ms|Governor)\b")
    return own.withColumn("witness", F.when(F.col("_shared").isNull() | titled, F.col("witness"))).drop("surname", "_shared")

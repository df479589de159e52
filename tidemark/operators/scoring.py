"""Rosters, pools, judges, summaries and published output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import lexicon_net, lexicon_score


def canonical(rows: DataFrame, aliases: DataFrame, name: str) -> DataFrame:
    """rows with variant names replaced; aliases(variant, canonical) has one row for each variant."""
    return rows.join(aliases, rows[name] == aliases["variant"], "left").withColumn(name, F.coalesce("canonical", name)).drop("variant", "canonical")


def on_roster(rows: DataFrame, roster: DataFrame, name: str, status: str | None = None) -> DataFrame:
    """Rows whose name is on roster(name, status), of that status if given."""
    own = (roster if status is None else roster.where(F.col("status") == status)).select(F.col("name").alias("_name")).distinct()
    return rows.join(own, rows[name] == own["_name"], "left_semi")


def roster_payload(roster: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row: sorted current and former names, and the alias map. Both inputs are small reference tables."""
    of = lambda s: F.sort_array(F.collect_set(F.when(F.col("status") == s, F.col("name")))).alias(s)
    names = roster.agg(of("current"), of("former"))
    return names.crossJoin(aliases.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("variant", "canonical")))).alias("alias")))  # one row each


def pool(docs: DataFrame, since: str | None, until: str | None, member: Column) -> DataFrame:
    """Policy documents of members within inclusive dates; an unknown verdict is not policy."""
    out = docs.where(F.coalesce(F.col("is_policy"), F.lit(False)) & member)
    out = out.where(F.col("date") >= F.lit(since).cast("date")) if since else out
    return out.where(F.col("date") <= F.lit(until).cast("date")) if until else out


def retained(docs: DataFrame, keep: Column) -> DataFrame:
    """docs as stored: texts blank unless kept, without the redacted text."""
    return docs.withColumn("text", F.when(keep, F.col("text")).otherwise(F.lit(""))).drop("text_anon")


def lexicon_judge(pairs: DataFrame, a: str, b: str, key: Column) -> DataFrame:
    """pairs with winner A or B by net lexicon words, ties by the parity of a hash of key; confidence 0.5."""
    x, y = lexicon_net(F.col(a)), lexicon_net(F.col(b))
    tie = F.when(F.pmod(F.xxhash64(F.lit("tie"), key), F.lit(2)) == 0, "A").otherwise("B")
    return pairs.withColumn("winner", F.when(x > y, "A").when(x < y, "B").otherwise(tie)).withColumn("confidence", F.lit(0.5))


def model_judge(post, **how):
    """A judge of pairs by a model: prompts from both texts and macro contexts, replies read as verdicts; failures have no winner.

    post and how are those of sources.web.ask.
    """
    from tidemark.functions.replies import verdict
    from tidemark.functions.text import judge_prompt
    from tidemark.sources.web import ask

    def judge(pairs: DataFrame) -> DataFrame:
        asked = pairs.withColumn("_prompt", judge_prompt(F.col("a_text"), F.col("a_macro"), F.col("b_text"), F.col("b_macro")))
        got = ask(asked.select("a", "b", "_prompt"), "_prompt", post, **how).withColumn("_verdict", verdict(F.col("reply")))
        return got.select("a", "b", F.col("_verdict.winner").alias("winner"), F.col("_verdict.confidence").alias("confidence"))

    return judge


def model_direct(docs: DataFrame, text: str, post, **how) -> DataFrame:
    """docs with direct_score by a model where it is null; a failure leaves it null."""
    from tidemark.functions.replies import internal_score, signed_score
    from tidemark.functions.text import excerpt, score_prompt
    from tidemark.schema import COMMITTEE
    from tidemark.sources.web import ask

    macro = F.col("macro") if "macro" in docs.columns else F.lit(None).cast("string")
    whole = F.coalesce(F.col("source_type").isin(*COMMITTEE), F.lit(False))
    todo = docs.where(F.col("direct_score").isNull()).select("id", score_prompt(excerpt(F.col(text), 2000, whole), macro).alias("_prompt"))
    got = ask(todo, "_prompt", post, **how).select("id", F.round(internal_score(signed_score(F.col("reply"))), 2).alias("_score"))
    return docs.join(got, "id", "left").select(*(F.coalesce(c, "_score").alias(c) if c == "direct_score" else F.col(c) for c in docs.columns))


def translated(docs: DataFrame, text: str, key: str, language: str, post, most: int = 6000, **how) -> DataFrame:
    """docs with the texts of other languages than English put into English by a model, paragraph chunk by chunk, and `translated`.

    A document of which a chunk fails keeps its text.
    """
    from tidemark.functions.text import chunks
    from tidemark.sources.web import ask

    foreign = docs.where(F.coalesce(F.col(language), F.lit("en")) != "en")
    asked = ask(foreign.select(key, F.posexplode(chunks(F.col(text), most)).alias("_at", "_chunk")), "_chunk", post, **how)
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "reply"))), lambda x: x["reply"]), "\n\n")
    done = asked.groupBy(key).agg(F.when(F.count("error") == 0, parts).alias("_english"))
    return docs.drop("translated").join(done, key, "left").withColumn("translated", F.col("_english").isNotNull()).withColumn(text, F.coalesce("_english", text)).drop("_english")


def lexicon_direct(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn("direct_score", F.round(lexicon_score(F.col(text)), 2))


def two_stage(docs: DataFrame, exempt: Column, first, second) -> DataFrame:
    """docs with is_policy: true for exempt rows; others pass `first`, and those that it keeps `second`.

    first and second take and return a DataFrame, adding a boolean `verdict`. The paid calls run on filtered inputs, as
    a conditional expression would not stop them.
    """
    flag = lambda df, value: df.withColumn("is_policy", F.lit(value))
    one = first(docs.where(~exempt))
    two = second(one.where("verdict").drop("verdict"))
    kept = two.withColumnRenamed("verdict", "is_policy")
    return flag(docs.where(exempt), True).unionByName(flag(one.where(~F.col("verdict")).drop("verdict"), False)).unionByName(kept)


def summary(docs: DataFrame, date: str, speaker: str) -> DataFrame:
    return docs.agg(F.count("*").alias("n_docs"), F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count_distinct(speaker).alias("n_speakers"))


def coverage(ours: DataFrame, theirs: DataFrame, ours_date: str, theirs_date: str) -> DataFrame:
    """year, n_ours, n_theirs, thin: rows by year in two sources; thin where the other has more."""
    by = lambda df, d, n: df.groupBy(F.year(d).alias("year")).agg(F.count("*").alias(n))
    both = by(ours, ours_date, "n_ours").join(by(theirs, theirs_date, "n_theirs"), "year", "full_outer")
    return both.select("year", F.coalesce("n_ours", F.lit(0)).alias("n_ours"), F.coalesce("n_theirs", F.lit(0)).alias("n_theirs")).withColumn("thin", F.col("n_theirs") > F.col("n_ours"))


def published(docs: DataFrame) -> DataFrame:
    """Documents under their short output names, by date and id."""
    two = lambda c: F.round(c, 2)
    return docs.select(
        F.col("id"), F.col("date").alias("d"), two("mu").alias("m"), F.coalesce("mu_adj", two("mu")).alias("ma"), two("sigma").alias("s"), F.col("n_comparisons").alias("n"),
        two("direct_score").alias("ds"), F.coalesce("direct_adj", two("direct_score")).alias("dsa"), F.col("speaker").alias("a"), F.substring("title", 1, 160).alias("tt"), F.col("source_type").alias("st"), F.col("word_count").alias("wc"), F.col("institution").alias("inst"),
    ).orderBy("d", "id")


def overlay(points: DataFrame, catalogue: DataFrame) -> DataFrame:
    """series, label, unit, shape, data: each series' (d, v) points by date. catalogue(series, label, unit, shape)."""
    data = F.sort_array(F.collect_list(F.struct("d", "v"))).alias("data")
    return catalogue.join(points.groupBy("series").agg(data), "series", "left").withColumn("data", F.coalesce("data", F.array().cast("array<struct<d:date,v:double>>")))

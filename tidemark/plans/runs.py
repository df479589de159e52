"""Whole runs: scoring a corpus, adding to it, classifying, refreshing, the daily increment and the panel."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import NEVER_REDACTED, anonymiser
from tidemark.operators import corpus, dedup, panel, scoring, timeseries, tournament
from tidemark.schema import DOCUMENT
from tidemark.sources import files, web

#: Titles that stand before a redacted name.
TITLES = ("Baroness", "Chair", "Chairman", "Chief Economist", "Dame", "Deputy Governor", "Director", "Dr", "Dr.", "Executive Director", "Governor", "Lord", "Mr", "Mr.", "Mrs", "Mrs.", "Ms", "Ms.", "President", "Professor", "Sir", "Vice-President")
SCORES = ["mu", "mu_adj", "sigma", "n_comparisons", "direct_score", "direct_adj", "is_policy"]


def lexicon(pairs: DataFrame) -> DataFrame:
    return scoring.lexicon_judge(pairs, "a_text", "b_text", F.concat_ws("|", "a", "b"))


def adjusted(docs: DataFrame) -> DataFrame:
    """docs with both scores adjusted to their quarter."""
    quarter = F.date_trunc("quarter", F.col("date"))
    out = timeseries.era_adjust(docs.drop("mu_adj"), "mu", quarter, "mu_adj")
    return timeseries.era_adjust(out.drop("direct_adj"), "direct_score", quarter, "direct_adj").withColumns({c: F.round(c, 2) for c in ("mu_adj", "direct_adj")})


def redacted(docs: DataFrame, names: Sequence[str]) -> DataFrame:
    """docs with text_anon."""
    return docs.withColumn("text_anon", anonymiser(names, TITLES, NEVER_REDACTED)(F.col("text")))


def score_corpus(docs: DataFrame, log_path: str, per_document: int = 30, judge=None, text: str = "text", seed: int = 0, full_run: bool = False) -> DataFrame:
    """docs with pairwise and direct scores, each also adjusted to its quarter. The judge defaults to the lexicon."""
    ratings = tournament.run(docs, "id", text, judge or lexicon, log_path, appearances=per_document, seed=seed, full_run=full_run)
    out = tournament.with_ratings(docs.drop("mu", "sigma", "n_comparisons"), ratings, "id")
    return adjusted(scoring.lexicon_direct(out.drop("direct_score"), text))


def add_documents(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """existing and the incoming documents with new ids and addresses."""
    seen = existing.where("source_url <> ''").select("source_url")
    return dedup.merge_new(existing, incoming.join(seen, "source_url", "left_anti").select(*existing.columns), "id", F.col("date"), F.col("title"))


def refresh(existing: DataFrame, incoming: DataFrame, reports: bool, minutes: bool) -> DataFrame:
    """existing with what is refreshed made anew from incoming; scores of documents that keep their id are put back."""
    kept = corpus.before_refresh(existing, reports, minutes)
    merged = dedup.merge_new(kept, incoming.select(*existing.columns), "id", F.col("date"), F.col("title"))
    return dedup.restore(merged, existing, "id", SCORES)


def daily(existing: DataFrame, sources: Sequence[tuple[str, Callable[[], DataFrame]]], classify, log_path: str, member: Column, since: str, until: str, judge=None, per_document: int = 30) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """The corpus with what the sources have new, the scored pool, and the errors.

    Only new documents are classified and played. Whatever fails leaves its name in the errors, and the pool as it was
    is adjusted and given back, so that something can always be published.
    """
    found, failed = web.assemble(sources, "id", "date")
    whole = existing
    try:
        if found is not None:
            new = found.select(*existing.columns).join(existing.select("id"), "id", "left_anti").select(*existing.columns)
            whole = existing.unionByName(classify(new).select(*existing.columns))
        pool = scoring.pool(whole, since, until, member)
        names = [r["name"] for r in corpus.all_names(whole.select(F.col("speaker").alias("name"))).collect()]  # the roster, which makes the patterns
        ready = redacted(pool, names).withColumn("text_anon", F.coalesce("text_anon", "text"))
        return whole, score_corpus(ready, log_path, per_document, judge, "text_anon").drop("text_anon"), failed
    except Exception as e:
        failed["scoring"] = str(e)[:200]
        return existing, adjusted(scoring.pool(existing, since, until, member)), failed


def vote_panel(docs: DataFrame, votes: DataFrame, value: str = "ma", back: int = 42, least: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Panel rows (date, hawk, n_rows, vote), horizon tests and the regression of votes(date, vote) on the mean score of the days before."""
    meetings = corpus.first_of(votes, ["date"], "vote", "vote")
    rows = corpus.panel_rows(docs, meetings, value, back, least).join(meetings, "date").select("date", "hawk", "n_rows", "vote")
    return rows, corpus.horizon_tests(rows, "date", "hawk", "vote"), panel.least_squares(rows, "vote", ["hawk"])


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return files.read_corpus(spark, path)


def _conform(docs: DataFrame) -> DataFrame:
    """docs with all fields of the schema, null where they lack one."""
    own = docs.select(*(F.col(f.name).cast(f.dataType) if f.name in docs.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in DOCUMENT))
    from tidemark.functions.text import content_id, word_count

    return own.withColumn("id", F.coalesce("id", content_id(F.col("date"), F.col("speaker"), F.col("title"), F.col("source_url")))).withColumn("word_count", F.coalesce("word_count", word_count(F.col("text"))))


def main(args: list[str] | None = None) -> None:
    """python -m tidemark.plans.runs COMMAND ...; see --help of each."""
    top = argparse.ArgumentParser(prog="tidemark")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *names: str, **options) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=options.pop("help"))
        for n in names:
            p.add_argument(n)
        for o, kind in options.items():
            p.add_argument(f"--{o.replace('_', '-')}", **({"action": "store_true"} if kind is bool else {"default": kind, "type": type(kind) if kind is not None else str}))
        return p

    command("assemble", "out", "inputs", help="join JSONL sources (comma-separated, first wins) into a corpus", skip="")
    command("add", "corpus", "incoming", "out", help="add new documents to a corpus", refresh_reports=bool, refresh_minutes=bool)
    command("classify", "corpus", "out", help="give verdicts to documents without one, by the lexicon's prose test", since=None, recheck=bool, chunks=8)
    command("score", "corpus", "log", "out", help="rate, score and publish a corpus", since=None, until=None, appearances=30, full=bool)
    command("sample", "corpus", "log", "out", help="score a sample, leaving the corpus as it is", n=50, appearances=10, seed=0)
    command("daily", "corpus", "incoming", "log", "out", help="add, classify and score what is new, and publish", since="1997-01-01", until="2100-01-01", appearances=30)
    command("refetch", "corpus", "texts", "out", help="fill in missing texts from JSONL of source_url and text", scope="all")
    command("votes", "corpus", "rates", "code", "out", help="the series of votes in a corpus's minutes, held against a rate's CSV")
    command("panel", "published", "votes", help="regress votes on the published scores of the days before", days=42, least=3)
    command("composite", "minutes", "out", help="documents of staged minutes (JSONL of url, title, text)", roster="", committee="Committee", institution="")
    a = top.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "assemble":
        named = [(p, lambda p=p: _documents(spark, p)) for p in a.inputs.split(",")]
        docs, failed = web.assemble(named, "id", "date", a.skip.split(","))
        for name, error in failed.items():
            print(f"{name}: {error}", file=sys.stderr)
        if docs is not None:
            files.write_corpus(docs, a.out)
    elif a.command == "add":
        old, new = _documents(spark, a.corpus), _documents(spark, a.incoming)
        files.write_corpus(refresh(old, new, a.refresh_reports, a.refresh_minutes) if a.refresh_reports or a.refresh_minutes else add_documents(old, new), a.out)
    elif a.command == "classify":
        docs = _documents(spark, a.corpus)
        todo = corpus.to_classify(docs, a.since, recheck=a.recheck)
        passes = lambda d: d.withColumn("verdict", F.lit(True))
        done = corpus.classify_in_chunks(todo, "id", lambda d: corpus.classified(d, passes, passes), f"{a.out}-chunks", a.chunks)
        merged = done.select(*docs.columns).unionByName(docs.join(done.select("id"), "id", "left_anti").select(*docs.columns))
        corpus.costs(merged).show()
        files.write_corpus(merged, a.out)
    elif a.command in ("score", "sample"):
        docs = _documents(spark, a.corpus)
        pool = scoring.pool(docs, a.since, a.until, F.lit(True)) if a.command == "score" else corpus.sample(docs, "id", a.n, a.seed)
        scored = score_corpus(pool, a.log, a.appearances, full_run=a.command == "score" and a.full)
        scoring.published(scored).write.json(a.out)
        scored.orderBy(F.desc("mu_adj"), "id").limit(10).select("date", "speaker", "title", "mu_adj").show(truncate=60)
    elif a.command == "daily":
        passes = lambda d: d.withColumn("verdict", F.lit(True))
        old = _documents(spark, a.corpus)
        whole, scored, failed = daily(old, [("incoming", lambda: _documents(spark, a.incoming))], lambda d: corpus.classified(d, passes, passes), a.log, F.lit(True), a.since, a.until, per_document=a.appearances)
        for name, error in failed.items():
            print(f"{name}: {error}", file=sys.stderr)
        files.write_corpus(whole, f"{a.out}/corpus")
        scoring.published(scored).write.json(f"{a.out}/published")
    elif a.command == "refetch":
        docs, texts = _documents(spark, a.corpus), spark.read.schema("source_url string, text string").json(a.texts)
        todo = corpus.without_text(docs).select("source_url")
        files.write_corpus(corpus.with_texts(docs, texts.join(todo, "source_url", "left_semi")), a.out)
    elif a.command == "votes":
        from tidemark.operators import votes

        minutes = _documents(spark, a.corpus).where("source_type = 'mp_account'").select("date", "text").withColumn("_one", F.lit(1))
        rates = files.read_rates(spark, a.rates, a.code).withColumn("_one", F.lit(1))
        moved = timeseries.change_around(minutes, rates, ["_one"], "date", "ts", "value").withColumn("vote", votes.votes(F.col("text")))
        votes.vote_series(moved, "vote", "change_bp", "date").orderBy("date").write.json(a.out)
    elif a.command == "panel":
        scores = spark.read.schema("d date, ma double, st string").json(a.published).select(F.col("d").alias("date"), "ma", F.col("st").alias("source_type"))
        held = spark.read.schema("date date, value double").json(a.votes).select("date", F.col("value").alias("vote"))
        for part in vote_panel(scores, held, back=a.days, least=a.least):
            part.show()
    else:
        from tidemark.operators import reports

        minutes = spark.read.schema("url string, title string, text string").json(a.minutes)
        roster = spark.createDataFrame([(n.strip(),) for n in a.roster.split(",")], "name string")
        files.write_corpus(_conform(reports.minutes_records(minutes, roster, a.committee, a.institution)), a.out)


if __name__ == "__main__":
    main()

"""Choices among the documents of a corpus: scopes, refreshes, rosters, samples, counts and rows of extremes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import excerpt, is_prose
from tidemark.schema import COMMITTEE

#: Words of a title that make it an interview; types that no panel regression uses; types that need no verdict of a judge.
INTERVIEW = r"(?i)interview|q&a|q-a|in conversation|talks to|spoke to"
NO_PANEL = ("mp_statement", "mp_qa", "mp_account", "mp_report", "member_view")
SETTLED = (*COMMITTEE, "testimony", "member_view")


def is_committee(speaker: Column, source_type: Column, committee: str) -> Column:
    """Whether a document is the committee's own, by its speaker or its type."""
    return F.coalesce(speaker == committee, F.lit(False)) | F.coalesce(source_type.isin(*COMMITTEE), F.lit(False))


def type_of(title: Column) -> Column:
    """interview or speech, by the title."""
    return F.when(title.rlike(INTERVIEW), "interview").otherwise("speech")


def to_classify(docs: DataFrame, since: str | None = None, member: Column | None = None, recheck: bool = False) -> DataFrame:
    """Documents in scope without a verdict; with recheck, those that have a text."""
    out = docs.where(F.col("date") >= F.lit(since).cast("date")) if since else docs
    out = out.where(member) if member is not None else out
    return out.where(F.col("text") != "") if recheck else out.where(F.col("is_policy").isNull())


def before_refresh(docs: DataFrame, reports: bool = False, minutes: bool = False) -> DataFrame:
    """docs without what a refresh makes anew: reports and the policy summaries cut from them, or minutes and members' views."""
    gone = F.lit(False)
    if reports:
        cut_out = (F.col("source_type") == "mp_statement") & F.contains("title", F.lit("Monetary Policy Summary")) & F.contains("title", F.lit(" — "))
        gone = gone | (F.col("source_type") == "mp_report") | cut_out
    if minutes:
        gone = gone | F.col("source_type").isin("mp_account", "member_view")
    return docs.where(~F.coalesce(gone, F.lit(False)))


def for_panel(docs: DataFrame) -> DataFrame:
    """Documents of types that say something of a single speaker."""
    return docs.where(~F.col("source_type").isin(*NO_PANEL))


def first_of(rows: DataFrame, by: list[str], value: str, *order: str) -> DataFrame:
    """by, value: the first value that is not null of each group, in the given order."""
    kept = rows.where(F.col(value).isNotNull())
    return kept.groupBy(*by).agg(F.min_by(value, F.struct(*order)).alias(value))


def extremes(rows: DataFrame, value: str, *tie: str) -> DataFrame:
    """Two rows: side (`most`, `least`) and the row with the largest and the smallest value; ties go to the first in order of tie."""
    every = F.struct(*rows.columns)
    most = F.min_by(every, F.struct((-F.col(value)).alias("v"), *tie))
    least = F.min_by(every, F.struct(F.col(value).alias("v"), *tie))
    both = rows.where(F.col(value).isNotNull()).agg(F.array(F.struct(F.lit("most").alias("side"), most.alias("row")), F.struct(F.lit("least").alias("side"), least.alias("row"))).alias("both"))
    return both.select(F.inline("both")).where("row is not null").select("side", "row.*")


def most_frequent(rows: DataFrame, by: str, k: int) -> DataFrame:
    """by, n of the k most frequent values; ties in order of the value."""
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(k)


def all_names(*rosters: DataFrame, committee: str = "") -> DataFrame:
    """name: the distinct names of all rosters, in order, without empty ones and the committee's."""
    out = rosters[0].select("name")
    for r in rosters[1:]:
        out = out.unionByName(r.select("name"))
    return out.where((F.coalesce("name", F.lit("")) != "") & (F.col("name") != committee)).distinct().orderBy("name")


def sample(docs: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows chosen by a hash of the key, the same for a seed however the rows are stored."""
    return docs.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key)).cast("binary")), key).limit(n)


def costs(docs: DataFrame, appearances: int = 30, each: float = 0.0005) -> DataFrame:
    """One row: n, n_policy, keep_rate, n_committee, comparisons and cost of a tournament of the policy documents."""
    own = docs.agg(F.count("*").alias("n"), F.count_if(F.col("is_policy")).alias("n_policy"), F.count_if(F.col("source_type").isin(*COMMITTEE)).alias("n_committee"))
    games = F.col("n_policy") * (appearances // 2)
    return own.select("n", "n_policy", F.when(F.col("n") > 0, F.col("n_policy") / F.col("n")).alias("keep_rate"), "n_committee", games.alias("comparisons"), (games * each).alias("cost"))


def without_text(docs: DataFrame, member: Column | None = None) -> DataFrame:
    """Speeches and interviews that have an address and no text."""
    out = docs.where((F.coalesce("text", F.lit("")) == "") & (F.coalesce("source_url", F.lit("")) != "") & F.col("source_type").isin("speech", "interview"))
    return out if member is None else out.where(member)


def with_texts(docs: DataFrame, fetched: DataFrame) -> DataFrame:
    """docs with the texts of fetched(source_url, text) where they have none."""
    new = fetched.where(F.coalesce("text", F.lit("")) != "").groupBy("source_url").agg(F.min("text").alias("_text"))
    text = F.when(F.coalesce("text", F.lit("")) == "", F.coalesce("_text", "text")).otherwise(F.col("text")).alias("text")
    return docs.join(new, "source_url", "left").select(*(text if c == "text" else F.col(c) for c in docs.columns))


def classified(docs: DataFrame, first, second) -> DataFrame:
    """docs with is_policy: reports by whether they are prose, the committee's other documents, testimony and members' views true, the rest by two stages.

    first and second take and return a DataFrame, adding a boolean `verdict`; only what the first keeps meets the second.
    """
    from tidemark.operators.scoring import two_stage

    plain = docs.drop("is_policy")
    kind = F.coalesce("source_type", F.lit(""))
    reports = plain.where(kind == "mp_report").withColumn("is_policy", is_prose(F.col("text")))
    return reports.unionByName(two_stage(plain.where(kind != "mp_report"), kind.isin(*SETTLED), first, second))


def classify_in_chunks(docs: DataFrame, key: str, classify, path: str, chunks: int = 8) -> DataFrame:
    """docs classified chunk by chunk (chosen by a hash of key), each appended to path; chunks found there are not asked again.

    classify takes and returns a DataFrame. What has been paid for outlives a run that ends.
    """
    spark = docs.sparkSession
    for k in range(chunks):
        part = f"{path.rstrip('/')}/chunk={k}"
        try:
            spark.read.parquet(part).schema
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            classify(docs.where(F.pmod(F.xxhash64(key), F.lit(chunks)) == k)).write.mode("overwrite").parquet(part)
    return spark.read.parquet(path).drop("chunk")


def pair_context(pairs: DataFrame, docs: DataFrame, key: str, text: str, most: int = 2000) -> DataFrame:
    """pairs(a, b, ...) with a_text, a_macro, a_type and those of b, of docs(key, text, macro, source_type).

    Texts are cut to excerpts, but for the committee's own documents.
    """
    whole = F.col("source_type").isin(*COMMITTEE)
    own = docs.select(F.col(key).alias("_id"), excerpt(F.col(text), most, F.coalesce(whole, F.lit(False))).alias("_text"), F.coalesce("macro", F.lit("n/a")).alias("_macro"), F.col("source_type").alias("_type"))
    for side in ("a", "b"):
        pairs = pairs.join(own.select(F.col("_id").alias(side), *(F.col(f"_{c}").alias(f"{side}_{c}") for c in ("text", "macro", "type"))), side)
    return pairs


def panel_rows(docs: DataFrame, days: DataFrame, value: str, days_back: int = 42, least: int = 3) -> DataFrame:
    """date, hawk, n_rows: for each of days(date) the mean of value, rescaled to -10..10, of the documents of the days before; days of fewer than `least` go."""
    from tidemark.operators.timeseries import trailing_mean

    one = lambda df: df.withColumn("_all", F.lit(1))
    got = trailing_mean(one(days.select("date").distinct()), one(for_panel(docs).where(F.col(value).isNotNull()).select("date", value)), ["_all"], "date", "date", value, days_back)
    return got.where(F.col("n_rows") >= least).select("date", ((F.col("mean_value") - 50) / 5).alias("hawk"), "n_rows")


def horizon_tests(rows: DataFrame, date: str, x: str, y: str, horizons: tuple[int, ...] = (1, 2, 3), least: int = 20) -> DataFrame:
    """horizon, n, r, hit_rate: of x with y of h rows later; r of `least` rows or more, the hit rate of rows whose y is not 0."""
    from tidemark.operators.panel import leads

    full = leads(rows.dropna(subset=[x, y]).withColumn("_all", F.lit(1)), ["_all"], date, y, horizons)
    # One pass makes all horizons; the panel has a row a meeting.
    long = full.select(F.col(x).alias("x"), F.inline(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"lead_{h}").alias("y")) for h in horizons)))).where("y is not null")
    hit = F.avg(F.when(F.col("y") != 0, (F.signum("x") == F.signum("y")).cast("int")))
    return long.groupBy("horizon").agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"), hit.alias("hit_rate")).withColumn("r", F.when(F.col("n") >= least, F.col("r"))).orderBy("horizon")

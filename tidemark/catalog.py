"""Registered queries and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import dates, replies, text
from tidemark.operators import dedup, panel, scoring, timeseries, tournament, transcript
from tidemark.sources import web

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _net(column: str) -> str:
    count = lambda w: f"(length({column}) - length(replace({column}, '{w}', ''))) // {len(w)}"
    return f"(({' + '.join(map(count, text.HAWK))}) - ({' + '.join(map(count, text.DOVE))}))"


_SCORE = f"greatest(0.0, least(100.0, 50 + 2.5 * {_net('lower(text)')}))::DOUBLE"
#: Words of the invented prose of the test tables, for scores that vary on them.
UP, DOWN = ("tion", "the", "que"), ("ing", "and", "de")


@query("SELECT doc_id, substr(sha1(concat(lang, '|', source, '|', doc_id::VARCHAR, '|', text)), 1, 16) AS id, len(regexp_extract_all(text, '\\S+'))::INT AS words, substr(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), 1, 40) AS title_key FROM documents")
def doc_ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.content_id(F.col("lang"), F.col("source"), F.col("doc_id"), F.col("text")).alias("id"), text.word_count(F.col("text")).alias("words"), text.title_key(F.col("text")).alias("title_key"))


@query("SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY source, doc_id) AS r FROM documents) WHERE r = 1")
def dedup_keep_first(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("k", F.md5(F.col("text").cast("binary"))).select("doc_id", "lang", "source", "k")
    return dedup.keep_first(d, "k", F.col("source"), F.col("doc_id")).drop("k")


@query("WITH d AS (SELECT doc_id, source, md5(text) AS k FROM documents), e AS (SELECT * FROM d WHERE source IN ('src0', 'src1', 'src2')), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS r FROM d WHERE source NOT IN ('src0', 'src1', 'src2') AND k NOT IN (SELECT k FROM e)) SELECT doc_id, source FROM e UNION ALL SELECT doc_id, source FROM n WHERE r = 1")
def merge_existing_wins(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("k"))
    old = F.col("source").isin("src0", "src1", "src2")
    return dedup.merge_new(d.where(old), d.where(~old), "k", F.col("doc_id")).drop("k")


@query("WITH a AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS d, lower(o_orderpriority) AS t FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT o_custkey, o_orderdate::DATE AS d, lower(o_orderpriority) AS t FROM orders WHERE o_orderstatus <> 'O') SELECT o_orderkey FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.o_custkey = b.o_custkey AND (a.d = b.d OR (abs(date_diff('day', a.d, b.d)) <= 21 AND (contains(a.t, substr(b.t, 1, 20)) OR contains(b.t, substr(a.t, 1, 20))))))")
def fuzzy_interval_anti(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("d"), F.lower("o_orderpriority").alias("t"), "o_orderstatus")
    return dedup.fuzzy_new(o.where("o_orderstatus = 'O'"), o.where("o_orderstatus <> 'O'"), "o_custkey", "d", "t").select("o_orderkey")


@query("WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = (SELECT min(event_type) FROM events)), s AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = (SELECT max(event_type) FROM events) GROUP BY ALL) SELECT event_id, value AS v FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.ts >= s.ts")
def as_of_inclusive(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kinds = e.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    e = e.join(F.broadcast(kinds))  # one row
    return timeseries.as_of(e.where("event_type = lo").select("event_id", "user_id", "ts"), e.where("event_type = hi"), ["user_id"], "ts", "ts", "value", out="v").select("event_id", "v")


@query("WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = (SELECT min(event_type) FROM events)), s AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = (SELECT max(event_type) FROM events) GROUP BY ALL), b AS (SELECT p.*, s.value AS rate_before FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.ts > s.ts) SELECT event_id, rate_before, s.value AS rate_after FROM (SELECT *, ts + INTERVAL 10 DAY AS u FROM b) b ASOF LEFT JOIN s ON b.user_id = s.user_id AND b.u >= s.ts")
def as_of_pair(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    e = e.join(F.broadcast(e.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))))  # one row
    return timeseries.change_around(e.where("event_type = lo").select("event_id", "user_id", "ts"), e.where("event_type = hi"), ["user_id"], "ts", "ts", "value").select("event_id", "rate_before", "rate_after")


@query("WITH p AS (SELECT DISTINCT user_id, ts::DATE AS d FROM events) SELECT user_id, d, n_rows, mean_value FROM (SELECT p.user_id, p.d, count(e.value) AS n_rows, round(avg(e.value), 6) AS mean_value FROM p LEFT JOIN events e ON p.user_id = e.user_id AND e.ts::DATE >= p.d - 7 AND e.ts::DATE < p.d GROUP BY ALL) WHERE n_rows >= 3")
def trailing_window_mean(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("d", F.col("ts").cast("date"))
    out = timeseries.trailing_mean(e.select("user_id", "d").distinct(), e, ["user_id"], "d", "d", "value", 7).where("n_rows >= 3")
    return out.select("user_id", "d", "n_rows", F.round("mean_value", 6).alias("mean_value"))


@query("SELECT o_orderkey, round(o_totalprice - avg(o_totalprice) OVER (PARTITION BY date_trunc('quarter', o_orderdate)) + 50, 2) AS adj FROM orders")
def era_adjust(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    return timeseries.era_adjust(o, "o_totalprice", F.date_trunc("quarter", F.col("o_orderdate").cast("timestamp")), "adj").select("o_orderkey", F.round("adj", 2).alias("adj"))


@query("SELECT event_id, round(value - (SELECT avg(value) FROM events) + 50, 4) AS adj FROM events")
def recentre(spark, sf_dir):
    return timeseries.recentre(table(spark, sf_dir, "events"), "value", "adj").select("event_id", F.round("adj", 4).alias("adj"))


@query("WITH m AS (SELECT user_id, ts, max(floor(value / 25)) AS level FROM events GROUP BY ALL), w AS (SELECT *, lag(level) OVER o AS p, row_number() OVER o AS r, lead(ts) OVER o AS n FROM m WINDOW o AS (PARTITION BY user_id ORDER BY ts)) SELECT user_id, ts, level::BIGINT AS level FROM w WHERE r = 1 OR n IS NULL OR level IS DISTINCT FROM p")
def step_compress(spark, sf_dir):
    return timeseries.steps(table(spark, sf_dir, "events").withColumn("level", F.floor(F.col("value") / 25)), ["user_id"], "ts", "level")


@query("SELECT user_id, last_day(ts::DATE) AS month_end, max_by(value, struct_pack(a := ts, b := value)) AS value FROM events GROUP BY ALL")
def month_end_last(spark, sf_dir):
    return timeseries.month_end(table(spark, sf_dir, "events"), ["user_id"], "ts", "value")


@query("WITH l AS (SELECT user_id, max_by(value, struct_pack(a := ts, b := value)) AS value, max(ts) AS t FROM events GROUP BY ALL), u AS (SELECT max(ts) AS u FROM events) SELECT user_id, ts, value FROM events UNION ALL SELECT user_id, u AS ts, value FROM l, u WHERE t < u")
def carry_forward(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    end = F.lit(e.agg(F.max(F.col("ts").cast("string"))).first()[0])
    return timeseries.carry_forward(e, ["user_id"], "ts", "value", end.cast("timestamp_ntz"))


@query("SELECT DATE '1970-01-01' + (g * 7)::INT AS grid_day, round(sum(w * v) / sum(w), 6) AS smooth_value FROM (SELECT value AS v, unnest(generate_series(ceil((d - 135) / 7.0)::INT, floor((d + 135) / 7.0)::INT)) AS g, exp(-0.5 * ((g * 7 - d) / 45.0) ** 2) AS w FROM (SELECT value, date_diff('day', DATE '1970-01-01', ts::DATE) AS d FROM events)) GROUP BY ALL")
def kernel_smooth(spark, sf_dir):
    return timeseries.smoothed(table(spark, sf_dir, "events"), "ts", "value").select("grid_day", F.round("smooth_value", 6).alias("smooth_value"))


_BLOCKS = "WITH q AS (SELECT *, role <> 'assistant' AS is_question FROM conversations), o AS (SELECT *, coalesce(is_question AND NOT lag(is_question) OVER w, false)::INT AS opens FROM q WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), b AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS block FROM o)"


def _blocks(spark, sf_dir):
    return transcript.qa_blocks(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", F.col("role") != "assistant")


@query(f"{_BLOCKS} SELECT conv_id, turn, is_question, block FROM b")
def qa_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir).select("conv_id", "turn", "is_question", "block")


@query(f"""{_BLOCKS}, a AS (SELECT conv_id, role AS witness, block, 1 AS kind, turn, text FROM b WHERE NOT is_question), s AS (SELECT DISTINCT conv_id, witness, block FROM a),
p AS (SELECT * FROM a UNION ALL SELECT b.conv_id, s.witness, b.block, 0, b.turn, b.text FROM b JOIN s USING (conv_id, block) WHERE is_question)
SELECT conv_id, witness, md5(string_agg(text, chr(10) || chr(10) ORDER BY block, kind, turn, text)) AS document, sum(CASE WHEN kind = 1 THEN len(regexp_extract_all(text, '\\S+')) ELSE 0 END)::BIGINT AS n_words FROM p GROUP BY ALL HAVING n_words >= 40""")
def qa_docs(spark, sf_dir):
    out = transcript.witness_documents(_blocks(spark, sf_dir).withColumn("witness", F.col("role")), ["conv_id"], "turn", "witness", "text", 40)
    return out.withColumn("document", F.md5(F.col("document").cast("binary")))


@query("WITH l AS (SELECT *, CASE WHEN role <> 'user' THEN role || turn::VARCHAR END AS label FROM conversations) SELECT conv_id, turn, last_value(label IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS speaker FROM l QUALIFY speaker IS NOT NULL")
def forward_fill(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("label", F.when(F.col("role") != "user", F.concat("role", F.col("turn").cast("string"))))
    return transcript.forward_fill(c, ["conv_id"], "turn", "label", "speaker").select("conv_id", "turn", "speaker")


@query(f"SELECT doc_id, {_net('lower(text)')}::INT AS net, {_SCORE} AS score FROM documents")
def lexicon_score(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.lexicon_net(F.col("text")).cast("int").alias("net"), text.lexicon_score(F.col("text")).alias("score"))


def _varied(c):
    return text.lexicon_net(c, UP, DOWN) / F.greatest(F.lit(1), F.length(c))


_V = "((" + " + ".join(f"(length(t) - length(replace(t, '{w}', ''))) // {len(w)}" for w in UP) + ") - (" + " + ".join(f"(length(t) - length(replace(t, '{w}', ''))) // {len(w)}" for w in DOWN) + "))"


@query(f"WITH s AS (SELECT doc_id, source, {_V} / greatest(1, length(t)) AS v FROM (SELECT *, lower(text) AS t FROM documents)) SELECT doc_id, source, round(v - avg(v) OVER (PARTITION BY source) + 50, 8) AS adjusted FROM s ORDER BY v - avg(v) OVER (PARTITION BY source) DESC, doc_id LIMIT 10")
def source_adjusted_top(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", _varied(F.col("text")).alias("v"))
    return timeseries.era_adjust(d, "v", F.col("source"), "a", 0.0).orderBy(F.desc("a"), "doc_id").limit(10).select("doc_id", "source", F.round(F.col("a") + 50, 8).alias("adjusted"))


@query("SELECT doc_id, md5(CASE WHEN length(text) <= 2000 THEN text ELSE substr(text, 1, 800) || e || substr(text, ((length(text) - 400) // 2 + 1)::BIGINT, 400) || e || right(text, 800) END) AS judged, md5('TITLE: ' || source || chr(10) || chr(10) || CASE WHEN length(text) <= 7500 THEN text ELSE substr(text, 1, 2500) || f || substr(text, ((length(text) - 2500) // 2 + 1)::BIGINT, 2500) || f || right(text, 2500) END) AS classified FROM documents, (SELECT chr(10) || '[...]' || chr(10) AS e, chr(10) || chr(10) || '[…]' || chr(10) || chr(10) AS f)")
def excerpts(spark, sf_dir):
    digest = lambda c: F.md5(c.cast("binary"))
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", digest(text.excerpt(F.col("text"), 2000)).alias("judged"), digest(text.classifier_excerpt(F.col("source"), F.col("text"))).alias("classified"))


@query("WITH s AS (SELECT doc_id, substr(text, 1, 6000) AS t FROM documents), c AS (SELECT doc_id, len(regexp_extract_all(t, '\\p{Nd}')) AS d, len(regexp_extract_all(t, '\\p{L}')) AS l, len(regexp_extract_all(t, '[a-z]{3}[^.!?\\n]{50,}[.!?]')) AS n FROM s) SELECT doc_id, (l > 0 AND d <= 0.15 * (d + l) AND n >= 3) AS prose FROM c")
def prose_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.is_prose(F.col("text")).alias("prose"))


@query()
def anonymise(spark, sf_dir):
    hide = text.anonymiser(["Anna Thon", "Erik Reha"], ["Governor", "President", "Mr", "Mrs"])
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(hide(F.col("text")).cast("binary")).alias("redacted"))


@query(r"""SELECT page_id, len(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1)))::INT AS n_links, nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '') AS title FROM pages""")
def html_fields(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.size(text.links(F.col("html"))).alias("n_links"), F.nullif(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1), F.lit("")).alias("title"))


@query()
def page_turns(spark, sf_dir):
    return transcript.turns(table(spark, sf_dir, "pages"), "page_id", "html")


@query("WITH a AS (SELECT year(o_orderdate)::INT AS year, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL), b AS (SELECT year(o_orderdate)::INT AS year, count(*) AS n FROM orders WHERE o_orderstatus <> 'O' GROUP BY ALL) SELECT year, coalesce(a.n, 0) AS n_ours, coalesce(b.n, 0) AS n_theirs, coalesce(b.n, 0) > coalesce(a.n, 0) AS thin FROM a FULL JOIN b USING (year)")
def coverage_by_year(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return scoring.coverage(o.where("o_orderstatus = 'O'"), o.where("o_orderstatus <> 'O'"), "o_orderdate", "o_orderdate")


@query("SELECT count(*) AS n_docs, min(o_orderdate)::DATE AS first_date, max(o_orderdate)::DATE AS last_date, count(DISTINCT o_custkey) AS n_speakers FROM orders")
def meta_summary(spark, sf_dir):
    return scoring.summary(table(spark, sf_dir, "orders").withColumn("d", F.col("o_orderdate").cast("date")), "d", "o_custkey")


@query("SELECT source, count(*) AS n, count_if(toxic = 1)::BIGINT AS n_flagged, count_if(quality IS NULL)::BIGINT AS n_open FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def source_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("n_flagged"), F.count_if(F.col("quality").isNull()).alias("n_open"))


@query("(SELECT 'top' AS side, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10) UNION ALL (SELECT 'bottom', o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10)")
def top_bottom_k(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    side = lambda n, order: o.orderBy(order, "o_orderkey").limit(10).select(F.lit(n).alias("side"), "o_orderkey", "o_totalprice")
    return side("top", F.desc("o_totalprice")).unionByName(side("bottom", F.asc("o_totalprice")))


@query("WITH l AS (SELECT o_custkey, o_orderkey, o_totalprice AS v, o_totalprice - lag(o_totalprice) OVER w AS diff, lead(o_totalprice, 1) OVER w AS lead_1, lead(o_totalprice, 2) OVER w AS lead_2, lead(o_totalprice, 3) OVER w AS lead_3 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) SELECT o_orderkey, round(diff, 2) AS diff, lead_1, lead_2, lead_3 FROM l")
def lead_diff(spark, sf_dir):
    return panel.leads(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice").select("o_orderkey", F.round("diff", 2).alias("diff"), "lead_1", "lead_2", "lead_3")


@query("SELECT l_returnflag, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY ALL")
def panel_corr(spark, sf_dir):
    return panel.correlation(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]).withColumn("r", F.round("r", 6))


@query("SELECT count(*) AS n, round(avg((sign(l_quantity - 25) = sign(l_extendedprice - 25000))::INT), 8) AS hit_rate FROM lineitem")
def hit_rate(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") - 25).alias("x"), (F.col("l_extendedprice") - 25000).alias("y"))
    return panel.hit_rate(li, "x", "y").withColumn("hit_rate", F.round("hit_rate", 8))


@query("SELECT 'const' AS term, round(regr_intercept(l_extendedprice, l_quantity), 3) AS coef FROM lineitem UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 3) FROM lineitem")
def ols(spark, sf_dir):
    return panel.least_squares(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity"]).select("term", F.round("coef", 3).alias("coef"))


@query("SELECT y::INT AS year, m::INT AS month, CASE WHEN y <= 2000 THEN 'https://old.example/' ELSE 'https://example/' END || y || '/' || lower(monthname(make_date(y, m, 1))) AS url FROM generate_series(1997, 2005) a(y), generate_series(1, 12) b(m) WHERE (y, m) NOT IN (SELECT (year(o_orderdate), month(o_orderdate)) FROM orders)")
def gap_generation(spark, sf_dir):
    seen = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).distinct()
    return web.month_gaps(spark, seen, 1997, 2005, "https://example/{year}/{month}", "https://old.example/{year}/{month}")


def _log(spark, sf_dir):
    """A log of judged games between neighbouring documents of a source: the higher lexicon rate wins."""
    w = Window.partitionBy("source").orderBy("doc_id")
    d = table(spark, sf_dir, "documents").select("source", "doc_id", _varied(F.col("text")).alias("v"))
    p = d.select(F.col("source").alias("tournament"), F.col("doc_id").alias("seq"), F.col("doc_id").alias("a"), F.lead("doc_id").over(w).alias("b"), (F.col("v") > F.lead("v").over(w)).alias("up"))
    return p.where("b is not null").withColumn("winner", F.when(F.col("up"), "A").otherwise("B"))


@query("WITH p AS (SELECT doc_id AS a, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM documents) SELECT id, count(*) AS n FROM (SELECT unnest([a, b]) AS id FROM p WHERE b IS NOT NULL) GROUP BY ALL")
def appearances(spark, sf_dir):
    return tournament.appearances(_log(spark, sf_dir))


@query()
def replay_ratings(spark, sf_dir):
    return tournament.replay(_log(spark, sf_dir))


@query()
def pair_selection(spark, sf_dir):
    r = tournament.replay(_log(spark, sf_dir)).select("id", "mu", "sigma", "n")
    return tournament.select_pairs(r, 64, 1)


@query("WITH x AS (SELECT event_id, value / 10 AS c, CASE WHEN event_id % 3 > 0 THEN value / 20 END AS u, CASE WHEN event_id % 5 > 0 THEN value / 30 END AS g FROM events) SELECT event_id, concat_ws('; ', printf('Core CPI infl: %.1f%%', c), CASE WHEN u IS NOT NULL THEN printf('Unemployment: %.1f%%', u) END, CASE WHEN g IS NOT NULL THEN printf('GDP growth (YoY): %.1f%%', g) END) AS label FROM (SELECT event_id, floor(c) AS c, floor(u) AS u, floor(g) AS g FROM x)")
def macro_labels(spark, sf_dir):
    v, k = F.col("value"), F.col("event_id")
    whole = lambda c: F.floor(c).cast("double")
    return table(spark, sf_dir, "events").select("event_id", dates.macro_label(whole(v / 10), F.when(k % 3 > 0, whole(v / 20)), F.when(k % 5 > 0, whole(v / 30)), F.lit(None).cast("double")).alias("label"))


@query("SELECT event_id, greatest(-100.0, least(100.0, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE))) / 2 + 50 AS score FROM events")
def json_parse(spark, sf_dir):
    reply = F.replace(F.col("props"), F.lit('"k"'), F.lit('"score"'))
    return table(spark, sf_dir, "events").select("event_id", replies.internal_score(replies.signed_score(reply)).alias("score"))


@query("SELECT o_orderkey, printf('%d %s %d', day(o_orderdate), monthname(o_orderdate), year(o_orderdate)) AS written, o_orderdate::DATE AS d FROM orders")
def long_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "d MMMM yyyy").alias("written"))
    return o.withColumn("d", dates.long_date(F.concat(F.lit("Given on 31 February 1999, held "), "written", F.lit("."))))


@query("WITH c AS (SELECT c_name, c_nationkey FROM customer), r AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) SELECT count(*) AS n FROM c WHERE c_nationkey IN (SELECT n_nationkey FROM r)")
def roster_filter(spark, sf_dir):
    roster = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("name"), F.lit("current").alias("status"))
    return scoring.on_roster(table(spark, sf_dir, "customer"), roster, "c_nationkey", "current").agg(F.count("*").alias("n"))


@query("SELECT doc_id, (1 - quality)::BIGINT AS before, quality::BIGINT AS after FROM labels WHERE doc_id % 2 = 0 AND quality IS NOT NULL")
def verdict_flips(spark, sf_dir):
    after = table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", F.col("quality").cast("long").alias("q"))
    before = after.withColumn("q", F.when(F.col("doc_id") % 2 == 0, 1 - F.col("q")).otherwise(F.col("q")))
    return dedup.flips(before, after, "doc_id", "q")


from tidemark import catalog_records, catalog_series  # noqa: E402, F401  (they register their queries here)

"""Queries over series, votes and panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query, table
from tidemark.operators import corpus, panel, timeseries, votes


def _prefs(spark, sf_dir):
    """A vote for each order: its lines' quantities as preferences, and the rate's change."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list((F.floor(F.col("l_quantity") / 10) * 25).cast("int"))).alias("prefs"))
    return li.select("l_orderkey", F.struct(F.get("prefs", F.lit(0)).alias("decision_bp"), F.size("prefs").alias("n_members"), F.size("prefs").alias("observed_members"), F.col("prefs").alias("prefs_bp")).alias("vote"))


_PREFS = "WITH p AS (SELECT l_orderkey, (floor(l_quantity / 10) * 25)::INT AS v FROM lineitem), a AS (SELECT l_orderkey, min(v) AS decision, avg(v) / 25 AS mean, count(*) AS n, list(v) AS vs FROM p GROUP BY ALL)"


@query(f"{_PREFS} SELECT l_orderkey, decision / 25 AS decision, round(mean, 8) AS mean, round(len(list_filter(vs, lambda x: x > decision)) / n, 8) AS dissent FROM a")
def vote_scores(spark, sf_dir):
    return _prefs(spark, sf_dir).select("l_orderkey", F.inline(F.array(votes.vote_scores(F.col("vote"))))).select("l_orderkey", "decision", F.round("mean", 8).alias("mean"), F.round("dissent", 8).alias("dissent"))


@query(f"{_PREFS}, c AS (SELECT *, CASE l_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN decision + 1 WHEN 2 THEN decision + 50 ELSE 25 END AS change, l_orderkey % 5 = 0 AS unread FROM a) SELECT l_orderkey, CASE WHEN NOT unread AND (change IS NULL OR abs(decision - change) <= 1) THEN round(mean, 3) ELSE round(change / 25, 3) END AS value, CASE WHEN NOT unread AND (change IS NULL OR abs(decision - change) <= 1) THEN 'vote' WHEN NOT unread THEN 'mismatch' ELSE 'rate' END AS source FROM c WHERE NOT (unread AND change IS NULL)")
def vote_series(spark, sf_dir):
    k, d = F.col("l_orderkey"), F.col("vote.decision_bp")
    v = _prefs(spark, sf_dir).withColumn("change", F.when(k % 4 == 1, d + 1).when(k % 4 == 2, d + 50).when(k % 4 == 3, 25)).withColumn("vote", F.when(k % 5 != 0, F.col("vote")))
    return votes.vote_series(v, "vote", "change", "l_orderkey")


#: Minutes of each way that votes are worded, and the votes as read by hand: decision, members, preferences.
MINUTES = [
    ("The Committee voted by a majority of 8-1 to increase Bank Rate by 0.25 percentage points, to 1.75%. One member preferred to maintain Bank Rate at 1.5%.", (25, 9, [25] * 8 + [0])),
    ("At its meeting the MPC voted by a majority of 5–4 to reduce Bank Rate by 25 basis points, to 4%. Four members preferred to maintain Bank Rate at 4.25%.", (-25, 9, [-25] * 5 + [0] * 4)),
    ("The MPC voted by a majority of 7-2 to maintain Bank Rate at 5.25%. Two members preferred to increase Bank Rate by 0.25 percentage points, to 5.5%.", (0, 9, [0] * 7 + [25] * 2)),
    ("The MPC voted by a majority of 6-3 to maintain Bank Rate at 4.75%. Three members preferred to reduce Bank Rate to 4.5%.", (0, 9, [0] * 6 + [-25] * 3)),
    ("The Committee voted by a majority of 6-3 to maintain Bank Rate at 0.5%. Ian Grey, Michael Stone and Kristin Brook voted against the proposition, preferring to increase Bank Rate by 25 basis points.", (0, 9, [0] * 6 + [25] * 3)),
    ("The Governor invited members to vote on the proposition that the Bank's repo rate should be reduced by 25 basis points to 4.5%. Eight members of the Committee voted in favour. Dr Ann Low preferred to reduce the repo rate by 50 basis points.", (-25, 9, [-25] * 8 + [-50])),
    ("The following members of the Committee were present:\nAnn A\nBob B\nCarl C\nDora D\nEve E\nFay F\nGus G\nHal H\nIda I\nJo J was present as the Treasury representative.\nThe MPC voted unanimously to maintain Bank Rate at 0.5%.", (0, 9, [0] * 9)),
    ("Seven spoke. The Governor invited the Committee to vote on the proposition that Bank Rate should be maintained at 5%. Seven members of the Committee voted in favour of the proposition. Tim Hay and Andrew Wood voted against, preferring to increase Bank Rate by 25 basis points.", (0, 9, [0] * 7 + [25] * 2)),
    ("The Committee voted by a majority of 8-1 to increase Bank Rate by 0.25 percentage points, to 1.75%. Two members preferred to maintain Bank Rate at 1.5%.", None),
    ("Nothing was decided.", None),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}, {want[0]}, {want[1]}, '{','.join(map(str, want[2]))}')" if want else f"({k}, NULL, NULL, NULL)" for k, (_, want) in enumerate(MINUTES)) + ") t(k, decision_bp, observed_members, prefs)")
def vote_parse(spark, sf_dir):
    m = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(MINUTES)], "k int, t string").withColumn("v", votes.votes(F.col("t")))
    return m.select("k", "v.decision_bp", "v.observed_members", F.array_join("v.prefs_bp", ",").alias("prefs"))


@query("WITH f AS (SELECT user_id, ts, value FROM events WHERE ts > TIMESTAMP '2024-01-10 00:00:00'), l AS (SELECT user_id, max_by(value, struct_pack(a := ts, b := value)) AS value FROM events WHERE ts <= TIMESTAMP '2024-01-10 00:00:00' GROUP BY ALL) SELECT user_id, ts, value FROM f UNION ALL SELECT user_id, TIMESTAMP '2024-01-10 00:00:00', value FROM l")
def anchored_series(spark, sf_dir):
    return timeseries.anchor(table(spark, sf_dir, "events"), ["user_id"], "ts", "value", F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))


@query("WITH s AS (SELECT event_type, ts, max(value) AS value FROM events WHERE event_id % 3 = 0 GROUP BY ALL), p AS (SELECT event_id, event_type, ts FROM events WHERE event_id % 3 > 0) SELECT event_id, value AS v FROM p ASOF LEFT JOIN s ON p.event_type = s.event_type AND p.ts >= s.ts + INTERVAL 2 DAY")
def as_of_few_series(spark, sf_dir):
    """Few series over a long time, delayed by two days: dealt by stretches of time."""
    e = table(spark, sf_dir, "events")
    return timeseries.as_of(e.where("event_id % 3 > 0").select("event_id", "event_type", "ts"), e.where("event_id % 3 = 0"), ["event_type"], "ts", "ts", "value", out="v", lag_days=2, bucket_days=4).select("event_id", "v")


@query("WITH t AS (SELECT count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, avg(x) AS mx FROM (SELECT l_extendedprice AS y, l_quantity AS x FROM lineitem)), e AS (SELECT *, (syy - b * sxy) / (n - 2) AS s2 FROM t) SELECT 'const' AS term, round(a / sqrt(s2 * (1.0 / n + mx * mx / sxx)), 4) AS t FROM e UNION ALL SELECT 'l_quantity', round(b / sqrt(s2 / sxx), 4) FROM e")
def ols_t(spark, sf_dir):
    return panel.least_squares(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity"]).select("term", F.round("t", 4).alias("t"))


_MONTHLY = "WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS date, avg(o_totalprice) - 150000 AS x, median(o_totalprice) - 149000 AS y FROM orders GROUP BY ALL)"


def _monthly(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.trunc("o_orderdate", "month").alias("date")).agg((F.avg("o_totalprice") - 150000).alias("x"), (F.median("o_totalprice") - 149000).alias("y"))


@query(f"{_MONTHLY}, l AS (SELECT x, h.h AS horizon, CASE h.h WHEN 1 THEN lead(y, 1) OVER w WHEN 2 THEN lead(y, 2) OVER w ELSE lead(y, 3) OVER w END AS y FROM m, (VALUES (1), (2), (3)) h(h) WINDOW w AS (PARTITION BY h.h ORDER BY date)) SELECT horizon, count(*) AS n, round(CASE WHEN count(*) >= 20 THEN corr(x, y) END, 6) AS r, round(avg(CASE WHEN y <> 0 THEN (sign(x) = sign(y))::INT END), 8) AS hit_rate FROM l WHERE y IS NOT NULL GROUP BY ALL")
def panel_horizons(spark, sf_dir):
    return corpus.horizon_tests(_monthly(spark, sf_dir), "date", "x", "y").withColumns({"r": F.round("r", 6), "hit_rate": F.round("hit_rate", 8)})


@query("WITH d AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders WHERE o_orderstatus = 'P'), s AS (SELECT o_orderdate::DATE AS date, o_totalprice / 5000 AS m, ['speech', 'mp_report', 'interview', 'member_view'][(o_orderkey % 4 + 1)::INT] AS st FROM orders) SELECT d.date, round((avg(m) - 50) / 5, 4) AS hawk, count(*) AS n_rows FROM d JOIN s ON s.date >= d.date - 42 AND s.date < d.date WHERE st IN ('speech', 'interview') GROUP BY ALL HAVING count(*) >= 3")
def panel_of_scores(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("date", F.col("o_orderdate").cast("date"))
    kind = F.element_at(F.array(F.lit("speech"), F.lit("mp_report"), F.lit("interview"), F.lit("member_view")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    docs = o.select("date", (F.col("o_totalprice") / 5000).alias("m"), kind.alias("source_type"))
    return corpus.panel_rows(docs, o.where("o_orderstatus = 'P'"), "m").withColumn("hawk", F.round("hawk", 4))

"""Operators on small frames, and registered queries against SQL."""

import datetime as dt
import decimal
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.functions import dates, replies, text
from tidemark.operators import dedup, panel, timeseries, tournament, transcript, votes

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


def alike(value):
    """A value that compares equal across both engines: floats to nine places, times without zone."""
    if isinstance(value, float):
        return round(value, 9) + 0.0
    if isinstance(value, decimal.Decimal):
        return round(float(value), 9) + 0.0
    return value


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(alike(r[k]) for k in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


#: Queries whose rows at this scale are none for good reason.
MAY_BE_EMPTY = {"roster_names"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    want, got = duck.sql(catalog.ORACLE_SQL[name]), catalog.QUERIES[name](spark, SF)
    assert sorted(want.columns) == sorted(got.columns)
    rows = sorted_rows(got.columns, got.collect())
    assert rows == sorted_rows(want.columns, want.fetchall())
    assert rows or name in MAY_BE_EMPTY


def test_text(spark):
    c = F.col("t")
    assert one(spark, text.excerpt(c, 10), t="abcdefghijklmnopqrst") == "abcd\n[...]\njk\n[...]\nqrst"
    assert one(spark, text.body(c), t="x" * 100 + "\nReferences\nA, B") == "x" * 100
    assert one(spark, text.lexicon_score(c), t="Inflation hike") == 55.0
    assert one(spark, text.clean_pdf(c), t="infla-\ntion  is \n\n\n\nup") == "inflation is\n\nup"
    assert one(spark, text.chunks(c, 5), t="aa\n\nbb\n\ncccccc") == ["aa", "bb", "cccccc"]
    hide = text.anonymiser(["Jane Doe"], ["Governor"])
    assert one(spark, hide(c), t="Governor Smith met Jane Doe.\nQ from X: why\nQuantitative easing: yes") == "[OFFICIAL] met [OFFICIAL].\nREPORTER: why\nQuantitative easing: yes"


def test_replies_and_dates(spark):
    c = F.col("t")
    assert tuple(one(spark, replies.verdict(c), t='x {"winner": "b", "confidence": 2}')) == ("B", 1.0)
    assert tuple(one(spark, replies.verdict(c), t="After all")) == (None, 0.0)
    assert one(spark, replies.signed_score(c), t='{"score": "120"}') == 100.0
    assert one(spark, replies.policy(c), t='{"policy": "false"}') is False
    assert one(spark, dates.long_date(c), t="31 February 2020, then 3 march 2021") == dt.date(2021, 3, 3)


def test_dedup_and_series(spark):
    old = spark.createDataFrame([(1, "a")], "id long, v string")
    new = spark.createDataFrame([(1, "b"), (2, "c"), (2, "d")], "id long, v string")
    merged = dedup.merge_new(old, new, "id", F.col("v"))
    assert sorted(map(tuple, merged.collect())) == [(1, "a"), (2, "c")]
    assert sorted(map(tuple, dedup.merge_new(merged, new, "id", F.col("v")).collect())) == [(1, "a"), (2, "c")]
    day = lambda k: dt.date(2024, 1, k)
    probes = spark.createDataFrame([(1, day(1)), (2, day(5)), (3, day(9))], "id long, d date").withColumn("s", F.lit("x"))
    series = spark.createDataFrame([("x", day(5), 1.0), ("x", day(7), 2.0)], "s string, ts date, v double")
    get = lambda strict: {r["id"]: r["value"] for r in timeseries.as_of(probes, series, ["s"], "d", "ts", "v", strict).collect()}
    assert get(False) == {1: None, 2: 1.0, 3: 2.0} and get(True) == {1: None, 2: None, 3: 2.0}
    adjusted = timeseries.era_adjust(spark.createDataFrame([(1, 10.0), (1, 20.0), (2, None)], "p int, v double"), "v", F.col("p"), "a")
    assert sorted(r["a"] for r in adjusted.collect() if r["a"] is not None) == [45.0, 55.0]


def test_tournament(spark):
    w, l = tournament.update((50.0, 8.333), (50.0, 8.333))
    assert math.isclose(w[0], 54.2053, abs_tol=1e-4) and math.isclose(l[0], 45.7947, abs_tol=1e-4) and math.isclose(w[1], 7.1945, abs_tol=1e-4)
    log = spark.createDataFrame([(0, 0, "a", "b", "A"), (0, 1, "b", "c", "B"), (0, 2, "a", "c", None)], "tournament int, seq long, a string, b string, winner string")
    got = {r["id"]: r for r in tournament.replay(log).collect()}
    assert sum(r["n"] for r in got.values()) == 4 and got["a"]["mu"] > 50 > got["b"]["mu"]
    assert tournament.select_pairs(spark.createDataFrame([("a", 50.0, 8.0, 0)], "id string, mu double, sigma double, n long"), 8, 1).count() == 0


def test_votes():
    t = "The Committee voted by a majority of 8-1 to increase Bank Rate by 0.25 percentage points, to 1.75%. One member preferred to maintain Bank Rate at 1.5%."
    assert votes.parse_votes(t) == {"decision_bp": 25, "n_members": 9, "observed_members": 9, "prefs_bp": [25] * 8 + [0]}
    assert votes.parse_votes(t.replace("One member", "Two members")) is None and votes.parse_votes("nothing") is None


def test_transcript_and_ols(spark):
    page = spark.createDataFrame([(1, "<p>early</p><p><b>Dr Ann Low:</b> I say &amp; mean</p><p>more</p>")], "k int, h string")
    assert [(r["label"], r["text"]) for r in transcript.turns(page, "k", "h").orderBy("turn").collect()] == [("Dr Ann Low", "Dr Ann Low: I say & mean"), ("Dr Ann Low", "more")]
    rows = spark.createDataFrame([(float(k), 2.0 * k + 1 + (-1) ** k) for k in range(30)], "x double, y double")
    got = panel.least_squares(rows, "y", ["x"]).collect()
    assert [r["term"] for r in got] == ["const", "x"] and abs(got[1]["coef"] - 2) < 0.05 and got[1]["p"] < 1e-6
    assert abs(panel.student_p(2.0, 10) - 0.07338803) < 1e-6


def test_run_resumes_where_the_log_ends(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{k}", "inflation hike " * k) for k in range(8)], "id string, text string")
    log, asked = str(tmp_path / "log"), []

    def judge(pairs):
        asked.append(pairs.count())
        return pairs.withColumn("winner", F.when(F.length("a_text") > F.length("b_text"), "A").otherwise("B")).withColumn("confidence", F.lit(1.0))

    first = {r["id"]: r["mu"] for r in tournament.run(docs, "id", "text", judge, log, appearances=4, batch=4).collect()}
    rows = spark.read.schema(tournament.LOG_SHAPE).parquet(log).collect()
    assert len(rows) == sum(asked) == 16 and sorted(r["seq"] for r in rows) == list(range(16))
    more = docs.unionByName(spark.createDataFrame([("new", "cut cut")], "id string, text string"))
    again = tournament.run(more, "id", "text", judge, log, appearances=4, batch=4)
    rows = spark.read.schema(tournament.LOG_SHAPE).parquet(log).collect()
    played = {i for r in rows[:16] for i in (r["a"], r["b"])}
    assert sorted(r["seq"] for r in rows) == list(range(len(rows))) and len(rows) == 16 + 4 * (1 + 8 - len(played)) // 2
    kept = {r["id"]: r["mu"] for r in tournament.replay(spark.createDataFrame(rows, tournament.LOG_SHAPE)).collect()}
    assert all(math.isclose(r["mu"], kept.get(r["id"], 50.0), rel_tol=1e-9) for r in again.collect()) and first

    def silent(pairs):
        return pairs.withColumn("winner", F.lit(None).cast("string")).withColumn("confidence", F.lit(0.0))

    with pytest.raises(RuntimeError):
        tournament.run(docs, "id", "text", silent, str(tmp_path / "other"), appearances=4, max_failures=5)


def test_letter_spacing(spark):
    c, spaced = F.col("t"), "In order to m aintain p rice s tability "
    assert one(spark, text.unspace(c), t=spaced * 20) == "In order to maintain price stability " * 20
    assert one(spark, text.unspace(c), t=spaced) == spaced


def test_html_text_of_odd_pages(spark, tmp_path):
    cut = ["<title>Q &amp</title><p>x", "a &ampp b &am &copy &quotx &amp;amp; &amp;copy; &lt; &#39; &nbsp;", "&middot;&quot;<b\n>&copy;</b>&amp;", "<p>a\x0b b\u00a0 c\t\r\n\fd\u2028</p>", "<>a<", "", None]
    ends = [chr(k) + " a " + chr(k) for k in (*range(1, 33), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)]
    spark.createDataFrame(list(enumerate(cut + ends)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = catalog.QUERIES["html_text"](spark, str(tmp_path))
    assert sorted(got.collect()) == sorted(con.sql(catalog.ORACLE_SQL["html_text"]).fetchall())
    assert one(spark, text.strip_html(F.col("t")), t="<title>Q &ampp &lt;</title>\n&nbsp;") == "Q &p <"


def test_asking_waits_and_leaves_errors(spark):
    from tidemark.sources import web

    def post(prompt):
        return {"a": (200, "fine", None), "b": (400, "", None)}.get(prompt, (503, "", 0.0))

    got = {r["p"]: (r["reply"], r["error"]) for r in web.ask(spark.createDataFrame([("a",), ("b",), ("c",)], "p string"), "p", post, tries=2, at_once=1).collect()}
    assert got == {"a": ("fine", None), "b": (None, "status 400"), "c": (None, "status 503")}


def test_staging_loads_once(spark, tmp_path):
    from tidemark.sources import files

    calls = []

    def load(missing):
        calls.append(sorted(r["k"] for r in missing.collect()))
        return missing.withColumn("v", F.upper("k"))

    keys = spark.createDataFrame([("a",), ("b",)], "k string")
    path = str(tmp_path / "stage")
    assert files.staged(spark, keys, "k", path, load).count() == 2
    more = keys.unionByName(spark.createDataFrame([("c",)], "k string"))
    assert sorted(r["v"] for r in files.staged(spark, more, "k", path, load).collect()) == ["A", "B", "C"] and calls == [["a", "b"], ["c"]]

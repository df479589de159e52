"""Reports and minutes: contents pages, sections, members' views, links of an issue, and the records that come of them.

A text is an array of lines here. A heading opens a line, so sections are found among the line starts of the body, by
the place that each has in the squashed text; all of it is array functions and windows, without a Python function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import MONTHS
from tidemark.functions.text import clean_pdf, letter_spaced, squash, unspace, word_count
from tidemark.operators.transcript import forward_fill

#: Entries that are no section, as printed and squashed; a sub-section's number.
FURNITURE = r"(?i)^(?:contents|download|glossary|index|monetary policy at the bank|other information|page\s*\d+)"
FURNITURE_SQUASHED = "^(?:chartsandtables|contents|download|glossary|index|listofcharts|monetarypolicyatthebank|otherinformation|pressnotice|references)"
SUBSECTION = r"^\d+\s*\.\s*\d"
#: Pages searched, entries of a contents page at least, share of them that may run backwards; characters of a
#: heading that are compared and that it needs, and of a section; words of a member's view; characters of an excerpt that dates are read from.
PAGES, ENTRIES, BACKWARDS, KEY, SHORTEST_KEY, SECTION, VIEW = 10, 4, 0.25, 60, 6, 700, 60
#: Characters that minutes, annexes and transcripts, and remarks need.
MINUTES, ANNEX, REMARKS = 2000, 1500, 800


def contents_lines(page: Column) -> Column:
    """array<struct<title, page>> of a page read as a table of contents; a line without a number is carried to the next."""
    line = lambda x: F.btrim(x, F.lit(" \t\r\f\x0b"))
    start = F.struct(F.lit("").alias("carry"), F.array().cast("array<struct<title:string,page:int>>").alias("found"))

    def step(acc: Column, raw: Column) -> Column:
        own = line(raw)
        head, number = F.btrim(F.regexp_extract(own, r"^(.{4,150}?)[\s.]+((?:\d\s?){1,3})$", 1)), F.regexp_extract(own, r"^(.{4,150}?)[\s.]+((?:\d\s?){1,3})$", 2)
        title = F.regexp_replace(F.btrim(F.concat_ws(" ", F.nullif(acc["carry"], F.lit("")), head)), r"\s+", " ")
        kept = (F.length(title) >= 4) & ~title.rlike(FURNITURE) & ~squash(title).rlike(FURNITURE_SQUASHED)
        entry = F.struct(title.alias("title"), F.regexp_replace(number, r"\s", "").cast("int").alias("page"))
        carried = F.concat_ws(" ", F.nullif(acc["carry"], F.lit("")), own)
        fresh = (own == "") | own.rlike(FURNITURE)
        return F.struct(F.when(fresh | (number != ""), F.lit("")).otherwise(carried).alias("carry"), F.when(~fresh & (number != "") & kept, F.concat(acc["found"], F.array(entry))).otherwise(acc["found"]).alias("found"))

    return F.aggregate(F.split(page, "\n"), start, step, lambda acc: acc["found"])


def inversions(numbers: Column) -> Column:
    """How many numbers of an array are below the one before."""
    return F.size(F.filter(F.zip_with(F.slice(numbers, 2, F.greatest(F.size(numbers) - 1, F.lit(0))), numbers, lambda a, b: F.coalesce(a < b, F.lit(False))), lambda x: x))


def contents_page(pages: Column) -> Column:
    """struct<page, titles> of the page, of the first ten, that lists most titles in running order; null without one."""

    def reading(page: Column, at: Column) -> Column:
        found = contents_lines(page)
        return F.struct(found.alias("found"), at.alias("at"))

    def scored(x: Column) -> Column:
        numbers = F.transform(x["found"], lambda e: e["page"])
        titles = F.filter(F.transform(x["found"], lambda e: e["title"]), lambda t: ~t.rlike(SUBSECTION))
        good = (F.size(numbers) >= ENTRIES) & (inversions(numbers) <= BACKWARDS * F.size(numbers)) & (F.size(titles) > 0)
        return F.when(good, F.struct(F.size(titles).alias("n"), (-x["at"]).alias("back"), titles.alias("titles")))

    best = F.array_max(F.filter(F.transform(F.transform(F.slice(pages, 1, PAGES), reading), scored), lambda x: x.isNotNull()))
    return F.when(best.isNotNull(), F.struct((-best["back"]).alias("page"), best["titles"].alias("titles")))


def line_starts(body: Column) -> Column:
    """array<struct<pos, line>>: of the lines that open with a letter or digit, the place in the squashed body and the line's number."""
    start = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("line"), F.array().cast("array<struct<pos:int,line:int>>").alias("found"))

    def step(acc: Column, line: Column) -> Column:
        opens = line.rlike(r"^\s*[\p{L}\p{N}]")
        return F.struct((acc["pos"] + F.length(squash(line))).alias("pos"), (acc["line"] + 1).alias("line"), F.when(opens, F.concat(acc["found"], F.array(F.struct(acc["pos"].alias("pos"), acc["line"].alias("line"))))).otherwise(acc["found"]).alias("found"))

    return F.aggregate(F.split(body, "\n"), start, step, lambda acc: acc["found"])


def headings(body: Column, titles: Column) -> Column:
    """array<struct<line, title>>: the line that each title opens, each behind the one before; titles that open none are left out."""
    kind = "array<struct<line:int,title:string>>"
    # As the argument of a function of one element, the squashed body is made once a row, not once a title and line.
    own = F.array(F.struct(squash(body).alias("flat"), line_starts(body).alias("starts"), titles.alias("titles")))
    return F.get(F.transform(own, lambda x: _located(x["flat"], x["starts"], x["titles"], kind)), F.lit(0))


def _located(flat: Column, starts: Column, titles: Column, kind: str) -> Column:
    start = F.struct(F.lit(0).alias("cursor"), F.array().cast(kind).alias("found"))

    def step(acc: Column, title: Column) -> Column:
        key = F.substring(squash(title), 1, KEY)
        here = F.get(F.filter(starts, lambda s: (s["pos"] >= acc["cursor"]) & (F.substr(flat, s["pos"] + 1, F.length(key)) == key)), F.lit(0))
        hit = (F.length(key) >= SHORTEST_KEY) & here.isNotNull()
        return F.struct(F.when(hit, here["pos"] + F.length(key)).otherwise(acc["cursor"]).alias("cursor"), F.when(hit, F.concat(acc["found"], F.array(F.struct(here["line"].alias("line"), title.alias("title"))))).otherwise(acc["found"]).alias("found"))

    return F.aggregate(titles, start, step, lambda acc: acc["found"])


def sections(reports: DataFrame, key: str, pages: str, least: int = SECTION) -> DataFrame:
    """key, section, title, text: a report's sections by its own contents page, those of `least` characters or more.

    A section ends where the next begins. Where fewer than two headings are found, the whole report is one, untitled.
    """
    join = lambda c: F.array_join(c, "\n")
    trimmed = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    own = reports.select(key, F.col(pages).alias("_pages"), contents_page(F.col(pages)).alias("_contents"))
    rest = F.when(F.col("_contents").isNull(), F.col("_pages")).otherwise(F.slice("_pages", F.col("_contents.page") + 2, F.size("_pages")))
    own = own.select(key, "_contents", clean_pdf(join(F.col("_pages"))).alias("_whole"), clean_pdf(join(rest)).alias("_body"))
    own = own.withColumn("_spaced", letter_spaced(F.col("_body")))
    own = own.select(key, unspace(F.col("_whole")).alias("_whole"), unspace(F.col("_body"), F.col("_spaced")).alias("_body"), F.transform("_contents.titles", lambda t: unspace(t, F.col("_spaced"))).alias("_titles"))
    own = own.withColumn("_found", F.coalesce(headings(F.col("_body"), F.col("_titles")), F.array().cast("array<struct<line:int,title:string>>")))
    lines, found = F.split("_body", "\n"), F.col("_found")

    def part(h: Column, i: Column) -> Column:
        end = F.coalesce(F.get(found, i + 1)["line"], F.size(lines))
        return F.struct(h["title"].alias("title"), trimmed(join(F.slice(lines, h["line"] + 1, end - h["line"]))).alias("text"))

    parts = F.when(F.size(found) >= 2, F.transform(found, part)).otherwise(F.array(F.struct(F.lit("").alias("title"), F.col("_whole").alias("text"))))
    return own.select(key, F.posexplode(parts).alias("section", "_part")).select(key, "section", "_part.title", "_part.text").where(F.length("text") >= least)


#: How minutes head the members' views, name a group of votes, open a member's paragraph and number their own.
VIEWS_HEADING, VOTE_GROUP, NUMBERED = r"(?i)^\s*MPC members[’']?\s*views\s*$", r"(?i)^\s*Votes? to .{3,80}$", r"^\s*\d+\.(?:\s|$)"
MEMBER = r"^([A-Z][A-Za-z.'’-]*(?:\s+[A-Z][A-Za-z.'’-]*){1,3})\s*:\s+(?=[A-Z“\"])"


def member_views(minutes: DataFrame, key: str, text: str, roster: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, text) without the members' views, and (key, place, member, vote_group, view) of those on roster(name).

    The views run from their heading to the second numbered line after it, or the only one, or the end. A group's line
    holds for the members after it; a view ends at the next group or member and counts with 60 words or more. Without
    any view that counts, the text stays whole.
    """
    by = Window.partitionBy(key).orderBy("line")
    lines = minutes.select(key, F.posexplode(F.split(text, "\n")).alias("line", "own"))
    head = F.min(F.when(F.col("own").rlike(VIEWS_HEADING), F.col("line"))).over(Window.partitionBy(key))
    lines = lines.withColumn("_head", head)
    after = F.col("line") > F.col("_head")
    number = F.when(after & F.col("own").rlike(NUMBERED), F.col("line"))
    ends = F.array_sort(F.collect_list(number).over(Window.partitionBy(key)))
    lines = lines.withColumn("_end", F.coalesce(F.get(ends, F.lit(1)), F.get(ends, F.lit(0)), F.lit(1 << 30)))
    inside = lines.where("line > _head and line < _end")
    group = F.when(F.col("own").rlike(VOTE_GROUP), F.btrim("own"))
    person = F.nullif(F.regexp_extract("own", MEMBER, 1), F.lit(""))
    marked = inside.withColumn("_group", F.last(group, ignorenulls=True).over(by)).withColumn("_mark", F.when(group.isNotNull(), F.lit("")).otherwise(person)).withColumn("_place", F.when(F.col("_mark").isNotNull(), F.col("line")))
    placed = forward_fill(marked, [key], "line", "_place", "place").withColumn("_member", F.first("_mark").over(Window.partitionBy(key, "place").orderBy("line")))
    spoken = placed.where("_member <> ''").withColumn("_said", F.when(F.col("line") == F.col("place"), F.regexp_replace("own", MEMBER, "")).otherwise(F.col("own")))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "_said"))), lambda x: x["_said"]), "\n")
    views = spoken.groupBy(key, "place").agg(F.first("_member").alias("member"), F.first("_group").alias("vote_group"), F.regexp_replace(texts, r"(?U)^\s+|\s+$", "").alias("view"))
    views = views.join(roster.select(F.col("name").alias("member")).distinct(), "member", "left_semi").where(word_count(F.col("view")) >= VIEW).select(key, "place", "member", "vote_group", "view")
    split = views.select(key).distinct().withColumn("_split", F.lit(True))
    bounds = lines.groupBy(key).agg(F.min("_head").alias("_head"), F.min("_end").alias("_end"))
    every = F.split(text, "\n")
    before = F.regexp_replace(F.array_join(F.slice(every, 1, F.col("_head")), "\n"), r"(?U)\s+$", "")
    behind = F.regexp_replace(F.array_join(F.slice(every, F.col("_end") + 1, F.greatest(F.size(every) - F.col("_end"), F.lit(0))), "\n"), r"(?U)^\s+", "")
    left = F.regexp_replace(F.concat(before, F.lit("\n\n"), behind), r"(?U)^\s+|\s+$", "")
    kept = minutes.join(bounds, key, "left").join(split, key, "left").withColumn(text, F.when(F.col("_split"), left).otherwise(F.col(text)))
    return kept.select(*minutes.columns), views


#: How a meeting's day is stated, and the addresses of minutes and of report issues.
_MONTH = MONTHS.lower()
MEETING = rf"(?i)(?:held on|ending on)\s+(?:\d{{1,2}}\s+(?:and|&)\s+)?(\d{{1,2}}\s+(?:{MONTHS})\s+(?:19|20)\d{{2}})"
MINUTES_URLS = (rf"(?i)/minutes/(\d{{4}})/(?:[a-z]+/)?monetary-policy-committee-({_MONTH})-(\d{{4}})\b", rf"(?i)/monetary-policy-summary-and-minutes/(\d{{4}})/(?:mpc-)?({_MONTH})-?(\d{{4}})?\b")
REPORT_URL = rf"(?i)/(inflation-report|monetary-policy-report)/(\d{{4}})/({_MONTH})-(\d{{4}})/?$"


def _day(text: Column, pattern: str) -> Column:
    return F.try_to_date(F.initcap(F.regexp_replace(F.regexp_extract(text, pattern, 1), r"\s+", " ")), "d MMMM yyyy")


def _month(name: Column, year: Column) -> Column:
    return F.try_to_date(F.concat_ws(" ", F.lit("1"), F.initcap(F.lower(name)), year), "d MMMM yyyy")


def _some(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def minutes_url_month(url: Column) -> Column:
    """First day of the month that an address of minutes names; null for other addresses."""
    of = lambda p: F.when(url.rlike(p), _month(_some(url, p, 2), F.coalesce(_some(url, p, 3), _some(url, p, 1))))
    return F.coalesce(*(of(p) for p in MINUTES_URLS))


def minutes_date(title: Column, text: Column, url: Column) -> Column:
    """The meeting's day in the title, else in the first 3,000 characters, else any date in the first 1,500, else the address's month."""
    any_day = rf"(?i)\b(\d{{1,2}}\s+(?:{MONTHS})\s+(?:19|20)\d{{2}})\b"
    return F.coalesce(_day(title, MEETING), _day(F.substring(text, 1, 3000), MEETING), _day(F.substring(text, 1, 1500), any_day), minutes_url_month(url))


def report_date(pages: Column, html: Column, url: Column) -> Column:
    """The meeting's day in the first 12 pages, else any date in their first 2,000 characters, else the page's date of publication, else the address's month."""
    body = F.array_join(F.slice(pages, 1, 12), "\n")
    any_day = rf"(?i)\b(\d{{1,2}}\s+(?:{MONTHS})\s+(?:19|20)\d{{2}})\b"
    return F.coalesce(_day(body, MEETING), _day(F.substring(body, 1, 2000), any_day), F.try_to_date(F.regexp_extract(html, r'"datePublished"\s*:\s*"(\d{4}-\d{2}-\d{2})', 1)), _month(_some(url, REPORT_URL, 3), _some(url, REPORT_URL, 4)))


def issue_label(url: Column) -> Column:
    """`Monetary Policy Report May 2024` or `Inflation Report ...` of an issue's address; null for others."""
    family = F.when(F.lower(F.regexp_extract(url, REPORT_URL, 1)) == "monetary-policy-report", "Monetary Policy Report").otherwise("Inflation Report")
    return F.when(url.rlike(REPORT_URL), F.concat_ws(" ", family, F.initcap(F.lower(F.regexp_extract(url, REPORT_URL, 3))), F.regexp_extract(url, REPORT_URL, 4)))


def minutes_urls(urls: DataFrame, url: str = "url", start: int = 0, end: int = 0) -> DataFrame:
    """url, year of the addresses of either family of minutes within the years, in order."""
    year = F.coalesce(*(_some(F.col(url), p, 1) for p in MINUTES_URLS)).cast("int")
    return _listed(urls, url, year, start, end)


def report_urls(urls: DataFrame, url: str = "url", start: int = 0, end: int = 0) -> DataFrame:
    """url, year of the landing pages of report issues within the years, in order."""
    return _listed(urls, url, _some(F.col(url), REPORT_URL, 4).cast("int"), start, end)


def _listed(urls: DataFrame, url: str, year: Column, start: int, end: int) -> DataFrame:
    from tidemark.sources.files import year_bounds

    return year_bounds(urls.select(F.col(url).alias("url"), year.alias("year")).where("year is not null").distinct(), F.col("year"), start, end).orderBy("url")


#: Words in the file names of what is no document, of the press conference's transcript and of the remarks, and of the report.
SKIPPED, TRANSCRIPT, REMARKS_FILE = r"(?i)slides|chart|visual|data-annex|monetary-policy-summary-and-minutes", r"(?i)transcript", r"(?i)opening[-_]remarks"
MAIN = rf"(?i)(?:monetary-policy|inflation)-report|^(?:{_MONTH}|{'|'.join(m[:3] for m in _MONTH.split('|'))})(?:-?\d{{4}})?\.pdf$"


def link_kind(url: Column) -> Column:
    """transcript, remarks, skip, main or extra, by the file's name."""
    name = F.element_at(F.split(url, "/"), -1)
    return F.when(name.rlike(TRANSCRIPT), "transcript").when(name.rlike(REMARKS_FILE), "remarks").when(name.rlike(SKIPPED), "skip").when(name.rlike(MAIN), "main").otherwise("extra")


def minutes_records(minutes: DataFrame, roster: DataFrame, committee: str, institution: str) -> DataFrame:
    """Documents of minutes(url, title, text): the committee's account, and one for each member's view in it.

    Texts under 2,000 characters and those without a date give none.
    """
    own = minutes.select("url", "title", "text", minutes_date(F.col("title"), F.col("text"), F.col("url")).alias("date")).where((F.length("text") >= MINUTES) & F.col("date").isNotNull())
    named = F.when(F.coalesce("title", F.lit("")) == "", F.concat(F.lit("Minutes of the Monetary Policy Committee meeting, "), F.col("date").cast("string"))).otherwise(F.col("title"))
    kept, views = member_views(own, "url", "text", roster)
    record = lambda df, speaker, title, text, kind: df.select("date", speaker.alias("speaker"), F.substring(title, 1, 220).alias("title"), text.alias("text"), F.lit(kind).alias("source_type"), F.lit(institution).alias("institution"), F.col("url").alias("source_url"))
    account = record(kept, F.lit(committee), named, F.col("text"), "mp_account")
    view = F.concat(F.coalesce(F.concat("vote_group", F.lit("\n\n")), F.lit("")), F.col("view"))
    month = F.concat(F.lit("MPC minutes, individual vote rationale — "), F.date_format("date", "MMMM yyyy"))
    return account.unionByName(record(views.join(own.select("url", "date"), "url"), F.col("member"), month, view, "member_view"))


def report_records(issues: DataFrame, files: DataFrame, committee: str, institution: str, split: bool = True) -> DataFrame:
    """Documents of issues(url, html) and files(url, file, place, pages), the PDF files that each links, in order.

    The first main file gives the report, in sections or whole with the annexes behind it; the other files give a
    document each, of a transcript and of remarks the first. Short ones, and issues without a main file, transcript or
    remarks or without a date, give none.
    """
    from tidemark.functions.text import file_title

    kinds = files.withColumn("kind", link_kind(F.col("file"))).where("kind <> 'skip'")
    rank = F.row_number().over(Window.partitionBy("url", "kind").orderBy("place"))
    chosen = kinds.withColumn("_rank", rank).where("kind = 'extra' or _rank = 1").drop("_rank").withColumn("text", unspace(clean_pdf(F.array_join("pages", "\n"))))
    main = chosen.where("kind = 'main'").select("url", F.col("file").alias("main"), "pages")
    has = chosen.where("kind <> 'extra'").select("url").distinct()
    dated = issues.join(has, "url", "left_semi").join(main, "url", "left").withColumn("date", report_date(F.col("pages"), F.col("html"), F.col("url"))).withColumn("issue", issue_label(F.col("url"))).where("date is not null and issue is not null")
    named = lambda name: F.concat_ws(" — ", F.col("issue"), F.nullif(name, F.lit("")))
    kind = lambda name: F.when(name.rlike("(?i)^monetary policy summary"), "mp_statement").otherwise("mp_report")
    head = dated.select("url", "date", "issue")
    others = chosen.join(head, "url")
    extras = others.where((F.col("kind") == "extra") & (F.length("text") >= ANNEX))
    if split:
        report = sections(dated.where("pages is not null"), "url", "pages").join(dated.select("url", "date", "issue", "main"), "url").select("date", named(F.col("title")).alias("title"), "text", kind(F.col("title")).alias("source_type"), F.col("main").alias("source_url"))
        report = report.unionByName(extras.select("date", named(file_title(F.col("file"))).alias("title"), "text", F.lit("mp_report").alias("source_type"), F.col("file").alias("source_url")))
    else:
        annex = F.concat(F.lit("\n\n=== Annex: "), file_title(F.col("file")), F.lit(" ===\n\n"), F.col("text"))
        behind = extras.groupBy("url").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", annex.alias("a")))), lambda x: x["a"]), "").alias("_annexes"))
        whole = chosen.where("kind = 'main'").select("url", "file", "text").join(head, "url").join(behind, "url", "left")
        report = whole.select("date", F.col("issue").alias("title"), F.concat("text", F.coalesce("_annexes", F.lit(""))).alias("text"), F.lit("mp_report").alias("source_type"), F.col("file").alias("source_url")).where("text <> ''")
    said = others.where((F.col("kind") == "transcript") & (F.length("text") >= ANNEX)).select("date", named(F.lit("press conference transcript")).alias("title"), "text", F.lit("mp_qa").alias("source_type"), F.col("file").alias("source_url"))
    opened = others.where((F.col("kind") == "remarks") & (F.length("text") >= REMARKS)).select("date", named(F.lit("Governor's opening remarks")).alias("title"), "text", F.lit("mp_statement").alias("source_type"), F.col("file").alias("source_url"))
    rows = report.unionByName(said).unionByName(opened)
    return rows.select("date", F.lit(committee).alias("speaker"), F.substring("title", 1, 220).alias("title"), "text", "source_type", F.lit(institution).alias("institution"), "source_url")


def composite(minutes: DataFrame, issues: DataFrame, files: DataFrame, roster: DataFrame, committee: str, institution: str, seen: DataFrame | None = None, split: bool = True) -> DataFrame:
    """Documents of minutes and reports; with seen(source_url, title), only of minutes and issues that it lacks."""
    if seen is not None:
        minutes = minutes.join(seen.select(F.col("source_url").alias("url")).distinct(), "url", "left_anti")
        known = seen.select(F.element_at(F.split("title", " — "), 1).alias("_issue")).distinct()
        issues = issues.join(known, issue_label(F.col("url")) == F.col("_issue"), "left_anti")
    return minutes_records(minutes, roster, committee, institution).unionByName(report_records(issues, files, committee, institution, split))

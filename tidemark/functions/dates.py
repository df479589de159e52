"""Dates, periods, basis points and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
DATE = rf"(\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}})"


def long_date(text: Column) -> Column:
    """The first valid `D Month YYYY` in a text; null without one."""
    found = F.regexp_extract_all(text, F.lit(rf"(?i)\b{DATE}\b"), F.lit(1))
    dates = F.transform(found, lambda d: F.try_to_date(F.initcap(F.regexp_replace(d, r"\s+", " ")), "d MMMM yyyy"))
    return F.get(F.filter(dates, lambda d: d.isNotNull()), F.lit(0))


def document_date(text: Column, metadata: Column, url: Column) -> Column:
    """From the body's first 1,500 characters, else the metadata if the address's year agrees, else the address, else the metadata."""
    year, month = F.regexp_extract(url, r"/((?:19|20)\d\d)/", 1), F.regexp_extract(url, r"/(?:19|20)\d\d/([a-z]+)/", 1)
    own, stated = long_date(F.substring(text, 1, 1500)), F.try_to_date(metadata)
    of_month = F.try_to_date(F.concat_ws(" ", F.lit("1"), F.initcap(month), year), "d MMMM yyyy")
    return F.coalesce(own, F.when(F.year(stated).cast("string") == year, stated), of_month, F.try_to_date(F.concat(year, F.lit("-07-01"))), stated)


def period_start(year: Column, quarter: Column, month: Column) -> Column:
    """First day of the month, else of the quarter, else of the year."""
    return F.make_date(year.cast("int"), F.coalesce(month.cast("int"), quarter.cast("int") * 3 - 2, F.lit(1)), F.lit(1))


def basis_points(points: Column) -> Column:
    """Percentage points as whole basis points, half to even."""
    return F.bround(points * 100).cast("int")


def day_gap(a: Column, b: Column) -> Column:
    """Days between two dates; 999 if either is missing."""
    return F.coalesce(F.abs(F.datediff(a, b)), F.lit(999))


def macro_label(core_cpi: Column, unemployment: Column, gdp_growth: Column, vix: Column) -> Column:
    """Known figures with one decimal, in a fixed order; n/a without any."""
    # The labels.
    parts = (("Core CPI infl: %.1f%%", core_cpi), ("Unemployment: %.1f%%", unemployment), ("GDP growth (YoY): %.1f%%", gdp_growth), ("Equity vol (VIX): %.1f", vix))
    return F.coalesce(F.nullif(F.concat_ws("; ", *(F.when(c.isNotNull(), F.format_string(p, c)) for p, c in parts)), F.lit("")), F.lit("n/a"))

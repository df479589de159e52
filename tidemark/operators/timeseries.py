"""Dated operators: as-of joins, trailing windows, adjustment by period, steps and resampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(probes: DataFrame, series: DataFrame, by: Sequence[str], at: str, ts: str, value: str, strict: bool = False, out: str = "value", lag_days: int = 0, bucket_days: int = 32) -> DataFrame:
    """probes with the last value of the series at or before `at` (before it, if strict); null without one.

    Both sides are dealt by key and stretch of `bucket_days`, so a few series over a long time are many tasks; each
    stretch opens with the last value of those before, found on one row for each of them. No candidate pair is made.
    lag_days delays observations, as by the time to their publication.
    """
    fields = F.struct(*(F.col(c) for c in probes.columns))
    left = probes.select(*by, F.col(at).cast("timestamp").alias("_at"), F.lit(0 if strict else 1).alias("_side"), fields.alias("_row"), F.lit(None).cast(series.schema[value].dataType).alias("_v"))
    moved = F.col(ts).cast("timestamp") + F.make_interval(days=F.lit(lag_days)) if lag_days else F.col(ts).cast("timestamp")
    right = series.where(F.col(value).isNotNull()).select(*by, moved.alias("_at"), F.lit(1 if strict else 0).alias("_side"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    both = left.unionByName(right).withColumn("_stretch", F.floor(F.unix_seconds("_at") / (86400 * bucket_days)))
    ends = both.groupBy(*by, "_stretch").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct("_at", "_v"))).alias("_end"))
    carried = F.last("_end", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    opening = ends.withColumn("_v", carried).where("_v is not null").select(*by, F.lit(None).cast("timestamp").alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), "_v", "_stretch")
    w = Window.partitionBy(*by, "_stretch").orderBy("_at", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    return both.unionByName(opening).withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_row is not null").select("_row.*", F.col("_last").alias(out))


def change_around(probes: DataFrame, series: DataFrame, by: Sequence[str], at: str, ts: str, value: str, days: int = 10) -> DataFrame:
    """Basis-point change of a rate: the last value until `days` after, less the last before; null if either is missing."""
    before = as_of(probes, series, by, at, ts, value, strict=True, out="rate_before")
    shifted = before.withColumn("_until", F.col(at) + F.make_interval(days=F.lit(days)))
    both = as_of(shifted, series, by, "_until", ts, value, out="rate_after").drop("_until")
    return both.withColumn("change_bp", F.bround((F.col("rate_after") - F.col("rate_before")) * 100).cast("int"))


def trailing_mean(probes: DataFrame, rows: DataFrame, by: Sequence[str], at: str, day: str, value: str, days: int) -> DataFrame:
    """probes with mean_value and n_rows of the rows of at - days <= day < at.

    Rows are summed by day first, so the range frame runs over one row a day, however many rows a day has.
    """
    number = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date"))
    asked = probes.withColumn("_day", number(at))
    daily = rows.where(F.col(value).isNotNull()).groupBy(*by, number(day).alias("_day")).agg(F.sum(F.col(value).cast("double")).alias("_s"), F.count("*").alias("_n"))
    empty = asked.select(*by, "_day").distinct().withColumns({"_s": F.lit(None).cast("double"), "_n": F.lit(None).cast("long")})
    w = Window.partitionBy(*by).orderBy("_day").rangeBetween(-days, -1)
    both = daily.unionByName(empty).withColumn("_sum", F.sum("_s").over(w)).withColumn("n_rows", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    found = both.groupBy(*by, "_day").agg(F.first("_sum").alias("_sum"), F.first("n_rows").alias("n_rows")).withColumnsRenamed({c: f"_k{k}" for k, c in enumerate(by)} | {"_day": "_d"})
    match = asked["_day"].eqNullSafe(found["_d"])
    for k, c in enumerate(by):
        match = match & asked[c].eqNullSafe(found[f"_k{k}"])
    return asked.join(found, match, "left").select(*(asked[c] for c in probes.columns), F.when(F.col("n_rows") > 0, F.col("_sum") / F.col("n_rows")).alias("mean_value"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def era_adjust(rows: DataFrame, value: str, period, out: str, centre: float = 50.0) -> DataFrame:
    """value less its mean over the period, plus centre; a null stays null. A hot period is one mean, joined back.

    The mean is a two-phase aggregate and its side of the join is a row for each period, so no period's rows meet in one task.
    """
    keyed = rows.withColumn("_period", period)
    means = keyed.groupBy("_period").agg(F.avg(value).alias("_mean"))
    return keyed.join(means, keyed["_period"].eqNullSafe(means["_period"]), "left").select(*rows.columns, (F.col(value) - F.col("_mean") + centre).alias(out))


def recentre(rows: DataFrame, value: str, out: str, centre: float = 50.0) -> DataFrame:
    """value less the mean of all rows, plus centre."""
    mean = rows.agg(F.avg(value).alias("_mean"))
    return rows.crossJoin(F.broadcast(mean)).withColumn(out, F.col(value) - F.col("_mean") + centre).drop("_mean")  # one row


def steps(rows: DataFrame, by: Sequence[str], ts: str, value: str) -> DataFrame:
    """The first point of a series, those where the value changes, and the last; the last of equal times counts."""
    w = Window.partitionBy(*by).orderBy(ts)
    one = rows.groupBy(*by, ts).agg(F.max(value).alias(value))
    marked = one.withColumn("_before", F.lag(value).over(w)).withColumn("_first", F.row_number().over(w) == 1).withColumn("_last", F.lead(ts).over(w).isNull())
    return marked.where(F.col("_first") | F.col("_last") | ~F.col("_before").eqNullSafe(F.col(value))).select(*by, ts, value)


def month_end(rows: DataFrame, by: Sequence[str], ts: str, value: str) -> DataFrame:
    """The last value of each month, dated at its end; ties in time go to the larger value."""
    return rows.groupBy(*by, F.last_day(F.col(ts).cast("date")).alias("month_end")).agg(F.max_by(value, F.struct(ts, value)).alias("value"))


def carry_forward(rows: DataFrame, by: Sequence[str], ts: str, value: str, until) -> DataFrame:
    """rows and, for each series that ends before, its last value at `until`."""
    last = rows.groupBy(*by).agg(F.max_by(value, F.struct(ts, value)).alias(value), F.max(ts).alias("_ts")).where(F.col("_ts") < until)
    return rows.select(*by, ts, value).unionByName(last.select(*by, until.cast(rows.schema[ts].dataType).alias(ts), value))


def anchor(rows: DataFrame, by: Sequence[str], ts: str, value: str, start) -> DataFrame:
    """rows from `start` on, with each series' last earlier value at `start` if it has no point there."""
    early = rows.where(F.col(ts) <= start).groupBy(*by).agg(F.max_by(value, F.struct(ts, value)).alias(value))
    return rows.where(F.col(ts) > start).select(*by, ts, value).unionByName(early.select(*by, start.cast(rows.schema[ts].dataType).alias(ts), value))


def smoothed(rows: DataFrame, day: str, value: str, sigma: float = 45.0, grid_days: int = 7, reach: float = 3.0) -> DataFrame:
    """grid_day, smooth_value: a Gaussian mean every grid_days, of the rows within `reach` sigmas.

    Rows are first summed by day; each day then goes to the fixed number of grid points within reach.
    """
    days = rows.where(F.col(value).isNotNull()).groupBy(F.datediff(F.col(day).cast("date"), F.lit("1970-01-01").cast("date")).alias("_d")).agg(F.sum(value).alias("_s"), F.count("*").alias("_n"))
    far = int(sigma * reach)
    grid = F.sequence(F.ceil((F.col("_d") - far) / grid_days), F.floor((F.col("_d") + far) / grid_days))
    near = days.withColumn("_g", F.explode(grid)).withColumn("_w", F.exp(-0.5 * F.pow((F.col("_g") * grid_days - F.col("_d")) / sigma, 2)))
    return near.groupBy("_g").agg((F.sum(F.col("_w") * F.col("_s")) / F.sum(F.col("_w") * F.col("_n"))).alias("smooth_value")).select(F.date_add(F.lit("1970-01-01").cast("date"), (F.col("_g") * grid_days).cast("int")).alias("grid_day"), "smooth_value")

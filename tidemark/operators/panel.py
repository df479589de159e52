"""Panel statistics: leads, differences, correlation, hit rates and least squares."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def leads(rows: DataFrame, by: list[str], order: str, value: str, horizons: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """rows with lead_h of the next surviving rows, and diff from the one before."""
    w = Window.partitionBy(*by).orderBy(order)
    out = rows.withColumn("diff", F.col(value) - F.lag(value).over(w))
    return out.withColumns({f"lead_{h}": F.lead(value, h).over(w) for h in horizons})


def correlation(rows: DataFrame, x: str, y: str, by: list[str] | None = None, least: int = 20) -> DataFrame:
    """n and Pearson correlation of complete rows; null below `least` rows."""
    full = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return full.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.corr(x, y).alias("r")).withColumn("r", F.when(F.col("n") >= least, F.col("r")))


def hit_rate(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Share of complete rows whose signs agree."""
    full = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return full.agg(F.count("*").alias("n"), F.avg((F.signum(x) == F.signum(y)).cast("int")).alias("hit_rate"))


def least_squares(rows: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """term, coef, t, p with the constant first. The cross-products are one aggregate; only their small matrix is solved here.

    p is two-sided, from Student's t with n - k degrees of freedom.
    """
    import numpy as np

    names = ["const", *xs]
    col = {"const": F.lit(1.0)} | {c: F.col(c).cast("double") for c in (*xs, y)}
    full = rows.dropna(subset=[*xs, y])
    k = len(names)
    terms = [F.sum(col[a] * col[b]) for i, a in enumerate(names) for b in names[i:]] + [F.sum(col[a] * col[y]) for a in names] + [F.sum(col[y] * col[y]), F.count("*")]
    got = list(full.agg(*(t.alias(f"s{i}") for i, t in enumerate(terms))).first())
    n = got[-1]
    if n <= k:
        return rows.sparkSession.createDataFrame([], "term string, coef double, t double, p double")
    a = np.zeros((k, k))
    a[np.triu_indices(k)] = got[: k * (k + 1) // 2]
    a = a + np.triu(a, 1).T
    b, yy = np.array(got[k * (k + 1) // 2 : -2]), got[-2]
    inverse = np.linalg.pinv(a)
    coef = inverse @ b
    error = np.sqrt(np.maximum((yy - coef @ b) / (n - k) * np.diag(inverse), 0))
    t = np.divide(coef, error, out=np.full(k, np.nan), where=error > 0)
    return rows.sparkSession.createDataFrame([(m, float(c), float(s), student_p(float(s), n - k)) for m, c, s in zip(names, coef, t)], "term string, coef double, t double, p double")


def student_p(t: float, df: int) -> float:
    """Two-sided tail of Student's t, by the continued fraction of the incomplete beta function."""
    if math.isnan(t):
        return math.nan
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0

    def fraction(x, a, b):
        c, d, h = 1.0, 1 / (1 - (a + b) * x / (a + 1)), 0.0
        h = d
        for m in range(1, 300):
            for e in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 / (1 + e * d), 1 + e / c
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b

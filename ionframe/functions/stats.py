"""Aggregate statistics: correlations, angles, residuals, empirical distributions.

Functions take Columns and give Columns for groupBy().agg() or over a window; no function
divides without a guard, as ANSI mode raises on zero denominators.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import _with, carried, running
from .scalar import _c


def _moments(x, y):
    n = F.count(F.when(_c(x).isNotNull() & _c(y).isNotNull(), 1)).cast("double")
    return n, F.sum(_c(x)), F.sum(_c(y)), F.sum(_c(x) * _c(y)), F.sum(_c(x) * _c(x)), F.sum(_c(y) * _c(y))


def correlation(x, y, ridge: float = 0.0) -> Column:
    """Pearson correlation; null without variance (the ridge is added to both variances)."""
    n, sx, sy, sxy, sxx, syy = _moments(x, y)
    cov = sxy - F.try_divide(sx * sy, n)
    vx, vy = sxx - F.try_divide(sx * sx, n) + ridge, syy - F.try_divide(sy * sy, n) + ridge
    return F.try_divide(cov, F.sqrt(F.when(vx > 0, vx)) * F.sqrt(F.when(vy > 0, vy)))


def centred_correlation(x, y, ridge: float = 0.0) -> Column:
    """The same from centred sums: large values that hardly vary don't lose their variance to rounding."""
    both = _c(x).isNotNull() & _c(y).isNotNull()
    x, y = F.when(both, _c(x)), F.when(both, _c(y))
    n = F.count(x)
    vx, vy = F.var_pop(x) * n + ridge, F.var_pop(y) * n + ridge
    return F.try_divide(F.covar_pop(x, y) * n, F.sqrt(F.when(vx > 0, vx)) * F.sqrt(F.when(vy > 0, vy)))


def standardise(p, t, reliability) -> Column:
    """A share p of a total t over its binomial deviation, the reliability scaling the variance."""
    p, t = _c(p), _c(t)
    v = t * _c(reliability) * p * (1 - p)
    return F.try_divide(t * p, F.sqrt(F.when(v > 0, v)))


def cosine(x, y) -> Column:
    return F.try_divide(F.sum(_c(x) * _c(y)), F.sqrt(F.sum(_c(x) * _c(x))) * F.sqrt(F.sum(_c(y) * _c(y))))


def angle(cos) -> Column:
    """acos of a cosine as a share of a right angle."""
    return F.acos(F.least(F.greatest(_c(cos), F.lit(-1.0)), F.lit(1.0))) * 2 / F.pi()


def dot(a, b) -> Column:
    """Dot product of two array columns."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def array_cosine(a, b) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def least_squares_scale(x, y) -> Column:
    return F.try_divide(F.sum(_c(x) * _c(y)), F.sum(_c(x) * _c(x)))


def pearson_residual(p, yhat, reliability=None) -> Column:
    """(p - yhat)^2 / (yhat (1 - yhat) r), halved where the observation is larger."""
    p, y = _c(p), _c(yhat)
    r = F.lit(1.0) if reliability is None else _c(reliability)
    return F.try_divide(F.pow(p - y, F.lit(2)) * F.when(p > y, 0.5).otherwise(1.0), y * (1 - y) * r)


def deviance_term(y, mu, n, reliability=None) -> Column:
    """One observation's part of 2 n (y ln(y / mu) - ...) for shares y of a total n; 0 for y of 0."""
    r = F.lit(1.0) if reliability is None else _c(reliability)
    return F.when(_c(y) > 0, 2 * _c(n) * r * _c(y) * (F.ln(_c(y)) - F.ln(_c(mu)))).otherwise(0.0)


def binomial_tail(k, n, p) -> Column:
    """-log10 of the probability of k or more successes in n trials of chance p each.

    The tail is a regularised incomplete beta function, from its continued fraction in Arrow batches:
    exact for any n in a bounded number of steps, and in logarithms, so that small tails don't
    vanish.  k of 0 or less gives 0, k over n infinity; null in gives null out.
    """

    @F.pandas_udf("double")
    def batch(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([_tail(*v) if all(x == x and x is not None for x in v) else None for v in zip(k, n, p)], dtype="float64")

    return batch(_c(k).cast("double"), _c(n).cast("double"), _c(p).cast("double"))


def _tail(k: float, n: float, p: float) -> float:
    if k <= 0 or p >= 1:
        return 0.0
    if k > n or p <= 0:
        return math.inf
    a, b = k, n - k + 1
    front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(p) + b * math.log1p(-p)
    if p < (a + 1) / (a + b + 2):
        return max(0.0, -(front + math.log(_beta_fraction(a, b, p) / a)) / math.log(10))
    other = math.exp(front) * _beta_fraction(b, a, 1 - p) / b
    return max(0.0, -math.log1p(-min(other, 1 - 1e-16)) / math.log(10))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by forward recurrence."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value, m = d, 0
    while True:
        m += 1
        last = value
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + step * d, 1 + step / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(value - last) <= 1e-15 * abs(value) or m > 100_000:
            return value


def ecdf(df: DataFrame, value: str, by: list[str] | None = None, out: str = "ecdf") -> DataFrame:
    """df with the right-continuous empirical distribution at value, within groups by.

    Values are counted first, so ties cost one row; the counts of distinct values are ranged over,
    within each group too, and the running sum joins back, range by range.
    """
    if by:
        counts = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
        upto = running(counts, by, value, {"_upto": ("sum", F.col("_n"))})
        sizes = counts.groupBy(*by).agg(F.sum("_n").alias("_all"))
        table = _with(upto, sizes, by).select(*by, value, (F.col("_upto") / F.col("_all")).alias(out))
        return _with(df, table, [*by, value])
    return df.join(ecdf_table(df, value, out), value)


def ecdf_table(df: DataFrame, value: str, out: str = "ecdf", parts: int | None = None) -> DataFrame:
    """(value, ecdf) for the distinct values, without a window over all of them: values are
    dealt into ranges, running counts are made within each and the ranges' totals (one row
    each) are carried over."""
    spark = df.sparkSession
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # range_id is monotone in value, so the order of ranges is the order of values
    cuts = counts.agg(F.percentile_approx(value, [i / n for i in range(1, n)] or [0.5], 10_000).alias("_cuts"))
    dealt = counts.crossJoin(F.broadcast(cuts)).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value))))
    totals = dealt.groupBy("_range").agg(F.sum("_n").alias("_t"))
    # one row for each range, at most the number of shuffle partitions
    before = totals.select("_range", (F.sum("_t").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_t")).alias("_before"), F.sum("_t").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    within = F.sum("_n").over(Window.partitionBy("_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("_in", within).join(F.broadcast(before), "_range").select(value, ((F.col("_in") + F.col("_before")) / F.col("_all")).alias(out))


def step_lookup(points: DataFrame, x: str, y: str, at: DataFrame, q: str, by: list[str], default: float = 0.0, out: str = "value") -> DataFrame:
    """As-of lookup: for each row of at the y of the last point with x <= q in its group.

    Points and queries are ordered together and the last point is carried forward, range by
    range of a group.
    """
    cols = at.columns
    p = points.select(*by, F.col(x).alias("_at"), F.col(y).alias("_y"), F.lit(0).alias("_k"))
    a = at.withColumn("_at", F.col(q)).withColumn("_k", F.lit(1)).withColumn("_y", F.lit(None).cast("double"))
    both = a.unionByName(p, allowMissingColumns=True)
    out_rows = carried(both, by, "_at", "_k", "_y", "_last").where("_k = 1")
    return out_rows.withColumn(out, F.coalesce("_last", F.lit(default))).select(*cols, out)

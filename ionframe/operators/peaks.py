"""Peaks: selection, deduplication, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Ranks run from 10 down; a rank has 10 peaks (the first 9), rank 1 goes on to
# the 159th peak; peaks below the floor have rank 0.
RANK_FLOOR = 100.0
MASS_SHIFTS = ("Unmodified", "Ammonium")


def intensity_rank(peaks: DataFrame, scan: list[str], intensity: str, ties: list[str], floor: float = RANK_FLOOR) -> DataFrame:
    """peaks with rank: by descending intensity within a scan, ties by the given columns.

    Peaks after the ranks are used up have -1; peaks below the floor have 0, or -1 if the
    ranks were used up before them.
    """
    w = Window.partitionBy(*scan)
    j = F.row_number().over(w.orderBy(F.desc(intensity), *ties))
    high = F.count(F.when(F.col(intensity) >= floor, 1)).over(w)
    rank = (
        F.when(F.col(intensity) < floor, F.when(high >= 160, -1).otherwise(0))
        .when(j < 90, 10 - F.floor(j / 10)).when(j < 160, 1).otherwise(-1)
    )
    return peaks.withColumn("rank", rank.cast("int"))


def select_matches(scans: DataFrame, score: str, least: float, q: str | None = None, most_q: float | None = None, shift: str | None = None, shifts=MASS_SHIFTS) -> DataFrame:
    """Scans with a score of at least least, a q-value of at most most_q and a known mass shift."""
    out = scans.where(F.col(score) >= least)
    if q is not None and most_q is not None:
        out = out.where(F.col(q) <= most_q)
    return out if shift is None else out.where(F.col(shift).isin(*shifts))


def first_of_each(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a total order (dropDuplicates would take any)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first")


def without(df: DataFrame, listed: DataFrame, column: str) -> DataFrame:
    """Rows whose column is not in the list; null stays."""
    return df.join(listed.select(column).distinct(), column, "left_anti")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """df, or an error where it has no rows."""
    if df.isEmpty():
        raise ValueError(f"no rows: {what}")
    return df


def base_peak(df: DataFrame, scan: list[str], intensity: str, out: str = "relative") -> DataFrame:
    """Intensities relative to the scan's largest."""
    return df.withColumn(out, F.try_divide(F.col(intensity), F.max(intensity).over(Window.partitionBy(*scan))))


def best_of_each(df: DataFrame, by: list[str], value: str, key: str) -> DataFrame:
    """The key and value of the row with the largest value of each group; of equal ones that with the
    least key."""
    best = F.max(F.struct(F.col(value).alias("v"), (-F.col(key)).alias("k")))
    return df.groupBy(*by).agg(best.alias("_b")).select(*by, (-F.col("_b.k")).alias(key), F.col("_b.v").alias(value))

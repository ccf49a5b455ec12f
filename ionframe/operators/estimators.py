"""One-parameter estimators, histograms of relations and tallies by ion type.

All are aggregates of rows that are joined elsewhere; what they group by is a fixed or small
set of values (charges, buckets, ion types), so partial sums are made before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import wildcard

NOISE = "noise"
#: A random mass of the prior's estimate lies between this and the structure's own.
LEAST_MASS = 56.0


def offset_frequency(scans: DataFrame, by: list[str], explained: str, sites: str) -> DataFrame:
    """Explained sites over all sites of a series, and unexplained peaks over the empty mass
    space; a scan row also has peaks (their number) and sparsity (the size of that space)."""
    frequency = F.try_divide(F.sum(explained), F.sum(sites))
    unknown = F.try_divide(F.sum(F.col("peaks") - F.col(explained)), F.sum(F.col("sparsity") - F.col(sites)))
    return scans.groupBy(*by).agg(frequency.alias("offset_frequency"), unknown.alias("unknown_peak_rate"))


def prior_probability(fragments: DataFrame, structures: DataFrame, keys: list[str], mass: str, total: str, draw: Column, tolerance: float = 2e-5) -> DataFrame:
    """Fragments within tolerance of one random mass of their structure, over the structures.

    draw is a number from 0 to 1 for each structure row (F.rand with a seed, or a hash of its
    key, which a lost task draws again alike)."""
    at = structures.select(*keys, (LEAST_MASS + draw * (F.col(total) - LEAST_MASS)).alias("_at"))
    hit = F.abs(F.try_divide(F.col(mass) - F.col("_at"), F.col("_at"))) <= tolerance
    hits = at.join(fragments.select(*keys, mass), keys, "left").agg(F.count_if(hit).alias("hits"))
    n = structures.agg(F.count("*").alias("structures"))
    # one row each
    return hits.crossJoin(F.broadcast(n)).withColumn("prior", F.try_divide(F.col("hits"), F.col("structures")))


def without_noise(relations: DataFrame, series: str = "series") -> DataFrame:
    """Relations of peaks that are of a series; one without a series is noise too."""
    return relations.where(F.col(series) != NOISE)


def relation_histograms(relations: DataFrame, from_charge: str, to_charge: str, bucket: str) -> DataFrame:
    """Counts of relations by charge pair, by ratio bucket and by both, in one pass; kind tells
    which of them a row is of."""
    charges = [from_charge, to_charge]
    g = relations.groupingSets([[*charges], [bucket], [*charges, bucket]], *charges, bucket).agg(F.grouping_id().alias("_g"), F.count("*").alias("n"))
    kind = F.when(F.col("_g") == 1, "charges").when(F.col("_g") == 6, "ratio").otherwise("both")
    return g.select(kind.alias("kind"), *charges, bucket, "n")


def feature_partitions(relations: DataFrame, by: list[str], least: int = 10) -> DataFrame:
    """Combinations of the seven values of a specialised feature (precursor's mass ratio and mass
    rank, peak's rank, both charges, ratio bucket, ion type) with at least least relations."""
    return relations.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def ion_type_posterior(tallies: DataFrame, by: list[str], matches: str = "matches", totals: str = "totals") -> DataFrame:
    """a / (a + b) of each ion type: a is its matches over its total, b the other types' matches
    over their total.  tallies has one row for each of by and ion type."""
    w = Window.partitionBy(*by)
    a = F.col(matches) / F.greatest(F.col(totals), F.lit(1))
    b = F.try_divide(F.sum(matches).over(w) - F.col(matches), F.sum(totals).over(w) - F.col(totals))
    return tallies.withColumns({"probability": a, "posterior": F.try_divide(a, a + b)})


def in_ranks(rank, least, most) -> Column:
    """Whether a peak's rank lies in a feature's window; a null bound is none."""
    r, lo, hi = (c if isinstance(c, Column) else F.col(c) for c in (rank, least, most))
    return (lo.isNull() | (r >= lo)) & (hi.isNull() | (r <= hi))


def precursor_context(ratio, mass_rank, own_ratio, own_mass_rank) -> Column:
    """Whether a precursor's mass ratio and mass rank are those that a feature asks for."""
    return wildcard(ratio, own_ratio) & wildcard(mass_rank, own_mass_rank)


def bind(features: DataFrame, pairs: DataFrame, keys: list[str], columns=("from_charge", "to_charge", "intensity_ratio")) -> DataFrame:
    """Features bound to the different charges and ratio buckets that their pairs have."""
    seen = pairs.select(*keys, *columns).distinct()
    return features.drop(*columns).join(seen, keys)


def release(features: DataFrame, columns=("from_charge", "to_charge", "intensity_ratio")) -> DataFrame:
    """The features without bounds (null fits all), each once."""
    free = {c: F.lit(None).cast(features.schema[c].dataType) for c in columns}
    return features.withColumns(free).dropDuplicates()


def explained_by(matches: DataFrame, peak: list[str], ion_type: str) -> DataFrame:
    """The set of ion types that explain each peak (a closed list of types, so a short array)."""
    return matches.groupBy(*peak).agg(F.array_sort(F.collect_set(ion_type)).alias("ion_types"))


def reindexed(matches: DataFrame, peaks: DataFrame, scan: list[str], index: str, observed: str, mass: str, tolerance: float = 2e-5) -> DataFrame:
    """Matches with the peak (peak_index) of their scan whose mass is nearest the observed one,
    of those within tolerance; equally near: the lighter.  Null where there is none."""
    from .bandjoin import band_join

    m = matches.select(*scan, index, F.col(observed).alias("_observed"))
    p = peaks.select(*scan, F.col(mass).alias("_mass"), "peak_index")
    near = band_join(m, p, scan, F.col("_observed"), F.col("_mass"), tolerance)
    best = near.groupBy(*scan, index).agg(F.min(F.struct(F.abs(F.col("_observed") - F.col("_mass")).alias("d"), "_mass", "peak_index")).alias("b"))
    return matches.join(best.select(*scan, index, F.col("b.peak_index").alias("peak_index")), [*scan, index], "left")

"""Peak-relation statistics: rates of features on and off a series, their specialisation by
charges and intensity ratio, and the posterior that a peak is a fragment.

Relations are never stored: they are aggregated as they are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_COUNT = 10
LEAST_RATE = 1e-4
UNIT = 0.02


def offset_parameters(scans: DataFrame, by: list[str], sites: str, explained: str, peaks: str, mass: str, fragment_mass: str, tolerance: float = 2e-5) -> DataFrame:
    """alpha (explained sites), beta (unexplained peaks over the empty mass space), prior (share
    of the mass space within tolerance of a fragment) and gamma (chance that a peak is one).

    A scan row has its numbers of sites, explained sites and peaks, its mass and the sum of
    its fragments' masses.
    """
    alpha = F.try_divide(F.sum(explained), F.sum(sites))
    beta = F.try_divide(F.sum(F.col(peaks) - F.col(explained)), F.sum(F.col(mass) / UNIT - F.col(sites)))
    prior = F.try_divide(F.sum(F.col(fragment_mass) * (2 * tolerance)), F.sum(mass))
    out = scans.groupBy(*by).agg(alpha.alias("alpha"), beta.alias("beta"), prior.alias("prior"))
    return out.withColumn("gamma", explained_probability("alpha", "beta", "prior"))


def explained_probability(alpha, beta, prior) -> Column:
    a = F.col(prior) * F.col(alpha)
    return F.try_divide(a, a + (1 - F.col(prior)) * F.col(beta))


def rates(pairs: DataFrame, peaks: DataFrame, by: list[str], feature: str, on_pair: Column, on_peak: Column) -> DataFrame:
    """mu and nu of every feature: satisfied on the series over peaks on it, and the same off.

    pairs are the related peaks of every feature, on_pair tells that the first is on the
    series and the second explained; on_peak tells that a peak is on the series.
    """
    totals = peaks.groupBy(*by).agg(F.count_if(on_peak).alias("n_on"), F.count_if(~on_peak).alias("n_off")) if by else peaks.agg(F.count_if(on_peak).alias("n_on"), F.count_if(~on_peak).alias("n_off"))
    sums = pairs.groupBy(*by, feature).agg(F.count_if(on_pair).alias("on_count"), F.count_if(~on_pair).alias("off_count"))
    # one row without keys, else one for each cell and series
    out = sums.join(totals, by) if by else sums.crossJoin(F.broadcast(totals))
    return out.withColumns({"mu": F.col("on_count") / F.greatest("n_on", F.lit(1)), "nu": F.col("off_count") / F.greatest("n_off", F.lit(1))})


def specialise(pairs: DataFrame, totals: DataFrame, by: list[str], on_pair: Column, least: int = LEAST_COUNT) -> DataFrame:
    """Rates for each combination of charges and ratio bucket with at least least relations;
    totals has n_on and n_off in one row; more rows are an error, as pairs have no key to them."""
    if len(totals.limit(2).take(2)) > 1:
        raise ValueError("totals must have one row")
    h = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(on_pair).alias("on_count"), F.count_if(~on_pair).alias("off_count")).where(F.col("n") >= least)
    h = h.crossJoin(F.broadcast(totals))
    return h.withColumns({"mu": F.col("on_count") / F.greatest("n_on", F.lit(1)), "nu": F.col("off_count") / F.greatest("n_off", F.lit(1))})


def pivot_fits(fits: DataFrame, keys: list[str], key: Column, value: str = "mu", least: float = LEAST_RATE) -> DataFrame:
    """A map for each feature from its partition to its rate, of rates of at least least."""
    return fits.where(F.col(value) >= least).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key.alias("k"), F.col(value).alias("v"))))).alias("fits"))


def posterior(edges: DataFrame, peak: list[str], other: str, own: str, mu: str, nu: str, gamma: Column, ties: list) -> DataFrame:
    """Probability of each peak by its edges: of the edges to one neighbour that with the largest
    probability counts (ties: first in order), edges without a rate on the series not at all;
    mu and nu multiply over neighbours.

    An edge names its peak, the other one (own and other may be either way round).
    """
    e = edges.withColumn("_p", F.try_divide(gamma * F.col(mu), gamma * F.col(mu) + (1 - gamma) * F.col(nu)))
    e = e.withColumn("_lo", F.least(own, other)).withColumn("_hi", F.greatest(own, other)).withColumn("_g", gamma)
    # a struct's order: larger probability first, then the ties
    best = e.groupBy(*peak, "_lo", "_hi").agg(F.min(F.struct((-F.coalesce("_p", F.lit(0.0))).alias("p"), *ties, F.col(mu).alias("mu"), F.col(nu).alias("nu"), F.col("_g").alias("g"))).alias("s"))
    best = best.where("s.mu > 0")
    agg = best.groupBy(*peak).agg(F.product("s.mu").alias("a"), F.product("s.nu").alias("b"), F.max("s.g").alias("g"))
    return agg.select(*peak, F.try_divide(F.col("g") * F.col("a"), F.col("g") * F.col("a") + (1 - F.col("g")) * F.col("b")).alias("probability"))


def with_reliability(matches: DataFrame, scores: DataFrame, keys: list[str], base: float, unassigned: Column, missing: float, gamma: float = 0.5) -> DataFrame:
    """matches with reliability: their score from base to 1, and missing for the unassigned.  A
    peak without edges has the prior probability gamma."""
    j = matches.join(scores.select(*keys, "probability"), keys, "left")
    rel = F.coalesce("probability", F.lit(gamma)) * (1 - base) + base
    return j.withColumn("reliability", F.when(unassigned, F.lit(missing)).otherwise(rel)).drop("probability")


def divergence(models: DataFrame, by: list[str], observed: str, theoretical: str) -> DataFrame:
    """Sum of o (ln o - ln t) over the models of a group and their noise remainder, with a floor of 1e-6."""
    floor = lambda c: F.when(c == 0, 1e-6).otherwise(c)
    term = lambda o, t: floor(o) * (F.ln(floor(o)) - F.ln(floor(t)))
    noise = (1 - F.sum(observed), 1 - F.sum(theoretical))
    return models.groupBy(*by).agg((F.sum(term(F.col(observed), F.col(theoretical))) + term(*noise)).alias("divergence"))


def cell_rates(pairs: DataFrame, peaks: DataFrame, cell: list[str], by: list[str], feature: str, on_pair: Column, on_peak: Column, width: int = 10) -> DataFrame:
    """Rates of every feature for each cell over its own and its neighbouring charges.

    pairs and peaks carry their cell's columns and charge (precursor_charge).  They are counted
    by charge first; the few counts, not the rows, are then dealt to the neighbours."""
    from .cells import adjacent

    z = "precursor_charge"
    own = [*cell, z, *by]
    n = peaks.groupBy(*own).agg(F.count_if(on_peak).alias("n_on"), F.count_if(~on_peak).alias("n_off"))
    s = pairs.groupBy(*own, feature).agg(F.count_if(on_pair).alias("on_count"), F.count_if(~on_pair).alias("off_count"))
    near = adjacent(n.select(*cell, z).distinct(), width, z).withColumnsRenamed({z: "cell_charge", "neighbour_charge": z})

    def summed(t: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
        return near.join(t, [*cell, z]).groupBy(*cell, "cell_charge", *keys).agg(*(F.sum(v).alias(v) for v in values))

    out = summed(s, [*by, feature], ["on_count", "off_count"]).join(summed(n, by, ["n_on", "n_off"]), [*cell, "cell_charge", *by])
    return out.withColumns({"mu": F.col("on_count") / F.greatest("n_on", F.lit(1)), "nu": F.col("off_count") / F.greatest("n_off", F.lit(1))})


def looked_up(relations: DataFrame, fits: DataFrame, slot: list[str]) -> DataFrame:
    """Relations with the rates of their slot; those without a fit are left out."""
    return relations.join(fits, slot)

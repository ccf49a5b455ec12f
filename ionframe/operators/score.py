"""Scores and metrics of matched spectra, as aggregates over a spectrum's ions.

An ion row has series, size (glycosylation), intensity, share (of total), yhat, mass_error and
reliability (base..1); coverage, prior and the like are columns of the spectrum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.scalar import unpad

RIDGE = 1e-12
PEPTIDE_WEIGHT, GLYCAN_WEIGHT = 0.65, 0.35
# The fields of a score set in order.
SCORE_SET = ("glycopeptide_score", "peptide_score", "glycan_score", "glycan_coverage", "stub_util", "oxonium_util", "n_stub", "peptide_coverage", "total_util", "peptide_corr", "backbone_count", "glycan_corr", "peptide_rel", "glycan_rel", "partition_label")


def ion_term(intensity, mass_error, tolerance: float = 2e-5) -> Column:
    """log10 of the intensity, less for ions far from their mass."""
    return F.log10(F.col(intensity)) * (1 - F.pow(F.abs(F.col(mass_error) / tolerance), F.lit(4)))


def _known(c: Column, missing: float) -> Column:
    return F.coalesce(F.nanvl(c, F.lit(None).cast("double")), F.lit(missing))


def peptide_score(ions: DataFrame, spectrum: list[str], coverage: str, base: float = 0.5, weight: float = 1.0, glycosylated: bool = True) -> DataFrame:
    """(sum of ion terms weighted by reliability + correlation + reliabilities) * coverage ^ weight.
    Without glycosylated, such ions are left out of the sum but not of the correlation."""
    b = ions.where(F.col("series").isin("b", "y", "c", "z"))
    rel = unpad("reliability", base) if base < 1 else F.lit(1.0)
    counts = F.lit(True) if glycosylated else F.col("size") == 0
    corr = _known(stats.correlation("share", "yhat", RIDGE), -0.5)
    n = F.count("*")
    total = F.sum(F.when(counts, ion_term("intensity", "mass_error") * (rel + 1))) + (1 + corr) / 2 * 2 * F.log10(n.cast("double")) + F.sum(F.when(counts, rel))
    return b.groupBy(*spectrum).agg((total * F.pow(F.max(coverage), F.lit(weight))).alias("peptide_score"), corr.alias("peptide_corr"), n.alias("backbone_count"))


def glycan_score(ions: DataFrame, spectrum: list[str], coverage: str, peptide_coverage: str, prior: str | None = None, least_corr: float | None = None) -> DataFrame:
    """(sum of ion terms + correlation and reliabilities weighted by the significant ions and
    by the peptide coverage + prior) * coverage, 0 at least."""
    s = ions.where("series = 'stub_glycopeptide'")
    n = F.count("*")
    corr = F.when(n > 1, _known(stats.correlation("share", "yhat", RIDGE), -0.5)).otherwise(-0.5)
    corr01 = (1 + corr) / 2 if least_corr is None else F.greatest((1 + corr) / 2, F.lit(least_corr))
    big = F.count_if(F.col("size") > 1)
    part = (corr01 * big + F.sum("reliability") * big) * F.least(F.exp(F.max(peptide_coverage) * 3) - 1, F.lit(1.0))
    pri = F.when(F.max(coverage) > 0, F.max(prior)).otherwise(0.0) if prior else F.lit(0.0)
    score = F.greatest((F.sum(ion_term("intensity", "mass_error")) + part + pri) * F.max(coverage), F.lit(0.0))
    return s.groupBy(*spectrum).agg(score.alias("glycan_score"), corr.alias("glycan_corr"), n.alias("n_stub"))


def split_score(peptide, glycan, accuracy=None, signature=None, localisation=None) -> Column:
    """0.65 peptide + 0.35 glycan + the other terms; what is missing counts 0."""
    out = F.coalesce(F.col(peptide), F.lit(0.0)) * PEPTIDE_WEIGHT + F.coalesce(F.col(glycan), F.lit(0.0)) * GLYCAN_WEIGHT
    for extra in (accuracy, signature, localisation):
        if extra is not None:
            out = out + F.coalesce(F.col(extra), F.lit(0.0))
    return out


def score_set(spectra: DataFrame, keys: list[str]) -> DataFrame:
    """The fifteen fields of a score set as floats (counts and the label as integers)."""
    whole = {"n_stub", "backbone_count", "partition_label"}
    return spectra.select(*keys, *(F.col(c).cast("int" if c in whole else "float").alias(c) for c in SCORE_SET))


def residual_score(ions: DataFrame, spectrum: list[str], cdf: str, base: float = 0.5) -> DataFrame:
    """Sum of -log10(cdf + 1e-6) + log10(intensity) (reliability + 1); NaN counts 0."""
    term = _known(-F.log10(F.col(cdf) + 1e-6) + F.log10("intensity") * (unpad("reliability", base) + 1), 0.0)
    return ions.groupBy(*spectrum).agg(F.sum(term).alias("residual_score"))


def mixture_weights(fits: DataFrame, spectrum: list[str], residual: str, power: int = 4) -> DataFrame:
    """Weight of each fit for a spectrum: (1 / residual) ^ power over their sum and 1e-6 for
    each fit; a residual of 0 or NaN counts as 1, and a spectrum's only fit has weight 1."""
    w = Window.partitionBy(*spectrum)
    r = F.nanvl(F.coalesce(F.col(residual), F.lit(1.0)), F.lit(1.0))
    p = F.pow(1 / F.when(r == 0, 1.0).otherwise(r), F.lit(power))
    n = F.count("*").over(w)
    return fits.withColumn("weight", F.when(n == 1, 1.0).otherwise(F.try_divide(p, F.sum(p).over(w) + n * 1e-6)))


def mixture_apply(fits: DataFrame, spectrum: list[str], value: str, weight: str = "weight") -> DataFrame:
    return fits.groupBy(*spectrum).agg(F.sum(F.col(weight) * F.col(value)).alias(value))


def metrics(ions: DataFrame, spectrum: list[str]) -> DataFrame:
    """Correlations and spectral angles in all and by kind of ion, and mean reliabilities."""
    out = []
    for name, cond in (("total", F.lit(True)), ("peptide", F.col("series").isin("b", "y", "c", "z")), ("glycan", F.col("series") == "stub_glycopeptide")):
        x, y = F.when(cond, F.col("share")), F.when(cond, F.col("yhat"))
        out += [stats.correlation(x, y).alias(f"{name}_correlation"), stats.angle(stats.cosine(x, y)).alias(f"{name}_spectral_angle"), F.avg(F.when(cond, F.col("reliability"))).alias(f"{name}_reliability"), F.count_if(cond).alias(f"{name}_fragment_count")]
    return ions.groupBy(*spectrum).agg(*out)


def observed_expected(peptide: DataFrame, glycan: DataFrame) -> DataFrame:
    """The predicted points of both models as one table."""
    return peptide.unionByName(glycan, allowMissingColumns=True)


def weighted_correlation_score(r: Column) -> Column:
    """(r + 1) / 2 * 10, where an undefined correlation counts as -0.5."""
    return (_known(r, -0.5) + 1) / 2 * 10


def oxonium_ratios(matches: DataFrame, spectrum: list[str], name: str, intensity: str, reference: str = "HexNAc") -> DataFrame:
    """Intensities of oxonium ions over the reference ion's (null without it and where it is 0)."""
    ref = F.max(F.when(F.col(name) == reference, F.col(intensity))).over(Window.partitionBy(*spectrum))
    return matches.withColumn("ratio", F.try_divide(F.col(intensity), ref))


def oxonium_one_hot(bounds: dict[str, int], ions: list[str], ion: str) -> Column:
    """Sorted indices that an observation of ion sets: one of each bounded column's values
    (clipped), and the ion's own after them."""
    out, offset = [], 0
    for k in sorted(bounds):
        out.append((F.lit(offset) + F.least(F.col(k), F.lit(bounds[k]))).cast("int"))
        offset += bounds[k] + 1
    at = F.array_position(F.array(*map(F.lit, sorted(ions))), F.col(ion))
    return F.array_sort(F.array_compact(F.array(*out, F.when(at > 0, F.lit(offset) + at - 1).cast("int"))))


def of_series(ions: DataFrame, *series: str) -> DataFrame:
    """The predicted ions of some series; shares and predictions stay those of the spectrum."""
    return ions.where(F.col("series").isin(*series))


def predicted_points(ions: DataFrame, spectrum: list[str], mz: str, scaled: bool = True) -> DataFrame:
    """(spectrum, mz, predicted): predictions of the assigned ions, scaled to the observed
    intensities by least squares."""
    out = ions.where(F.col("series") != "unassigned")
    if not scaled:
        return out.select(*spectrum, mz, F.col("yhat").alias("predicted"))
    w = Window.partitionBy(*spectrum)
    scale = F.try_divide(F.sum(F.col("yhat") * F.col("intensity")).over(w), F.sum(F.col("yhat") * F.col("yhat")).over(w))
    return out.select(*spectrum, mz, (F.col("yhat") * scale).alias("predicted"))


def _residual_terms() -> Column:
    """Sum over ions of -log10(cdf + 1e-6), where NaN counts 0; cdf is a column of the ions."""
    return F.sum(_known(-F.log10(F.col("cdf") + 1e-6), 0.0))


def model_peptide_score(ions: DataFrame, spectrum: list[str], coverage: str) -> DataFrame:
    """The regression scorer's peptide part: (log intensities weighted by reliability + residuals
    + correlation) * coverage.  The correlation counts by the number of ions and from 3/4 up, as
    it is weak for backbones."""
    n = F.count("*")
    corr = (3 + _known(stats.correlation("share", "yhat", RIDGE), -0.5)) / 4 * 10 * F.ln(n.cast("double"))
    sums = F.sum(F.log10("intensity") * (F.col("reliability") + 1))
    return of_series(ions, "b", "y").groupBy(*spectrum).agg(((sums + _residual_terms() + corr) * F.max(coverage)).alias("peptide_score"))


def model_glycan_score(ions: DataFrame, spectrum: list[str], coverage: str, signature: str | None = None) -> DataFrame:
    """The regression scorer's glycan part: (log intensities + correlation of standardised shares +
    residuals) * coverage + signature ions, 0 at least.  ions also has total."""
    scale = lambda p: F.col("total") * F.col(p) / F.sqrt(F.col("total") * F.col("reliability") * F.col(p) * (1 - F.col(p)))
    stubs = of_series(ions, "stub_glycopeptide").withColumns({"_x": scale("share"), "_y": scale("yhat")})
    # one ion has no correlation
    r = F.when(F.count("*") > 1, _known(stats.centred_correlation("_x", "_y", RIDGE), -0.5)).otherwise(-0.5)
    corr = (1 + r) / 2 * 10
    sums = F.sum(F.log10("intensity") * (F.col("reliability") + 1))
    more = F.coalesce(F.max(signature), F.lit(0.0)) if signature else F.lit(0.0)
    return stubs.groupBy(*spectrum).agg(F.greatest((sums + corr + _residual_terms()) * F.max(coverage) + more, F.lit(0.0)).alias("glycan_score"))


WEIGHTINGS = ("correlation", "normalized_correlation", "correlation_distance", "normalized_correlation_distance")


def model_score(spectra: DataFrame, intensity: str, residual: str, coverage: str, accuracy: str, signature: str, weighting: str | None = None) -> Column:
    """The whole match: (-log10 of the intensities' binomial p + residual score + a weighting,
    if any, of 10 at most) * coverage + mass accuracy + signature ions.  A weighting names a
    column of spectra with that correlation."""
    if weighting is not None and weighting not in WEIGHTINGS:
        raise ValueError(f"unknown weighting {weighting}")
    own = -F.log10(F.col(intensity)) + F.col(residual)
    if weighting:
        own = own + weighted_correlation_score(spectra[weighting])
    return own * F.col(coverage) + F.coalesce(F.col(accuracy), F.lit(0.0)) + F.coalesce(F.col(signature), F.lit(0.0))


def mixture_score(scores: DataFrame, spectrum: list[str], residual: str, values: list[str], power: int = 4) -> DataFrame:
    """Scores of each fit (a row for spectrum and fit) as one row for each spectrum, by the fits'
    mixture weights."""
    w = mixture_weights(scores, spectrum, residual, power)
    return w.groupBy(*spectrum).agg(*(F.sum(F.col("weight") * F.col(v)).alias(v) for v in values))


#: Strategies by name: which parts a scorer adds.  Those of partitioned models choose the peptide's
#: and the glycan's model apart; no_glycosylated leaves glycosylated backbone ions out of sums.
STRATEGIES = {
    "regression": {"family": "model", "mixture": False, "partitioned": False, "glycosylated": True},
    "mixture": {"family": "model", "mixture": True, "partitioned": False, "glycosylated": True},
    "split": {"family": "split", "mixture": False, "partitioned": False, "glycosylated": True},
    "mixture_split": {"family": "split", "mixture": True, "partitioned": False, "glycosylated": True},
    "partial_split": {"family": "partial", "mixture": True, "partitioned": False, "glycosylated": True},
    "partitioned_partial_split": {"family": "partial", "mixture": False, "partitioned": True, "glycosylated": True},
    "no_glycosylated_partitioned_partial_split": {"family": "partial", "mixture": False, "partitioned": True, "glycosylated": False},
}
#: Longest peptide (its interval's upper end) that counts as short.
SHORT_PEPTIDE = 10


def strategy(length_hi: str, default: str, short: str | None = None) -> Column:
    """The strategy of a cell: short peptides may have one of their own; an unknown name is an error."""
    for name in (default, short or default):
        if name not in STRATEGIES:
            raise ValueError(f"unknown strategy {name}")
    return F.when(F.col(length_hi) <= SHORT_PEPTIDE, F.lit(short or default)).otherwise(F.lit(default))


def partial_parts(ions: DataFrame, spectrum: list[str], coverage: str, glycan_coverage: str, glycosylated: bool = True, prior: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The peptide and the glycan part.  Without glycosylated: such ions are left out, the
    coverage counts to the power 0.7, a weak glycan correlation counts 0.25, and a spectrum
    without a stub of two sugars has no glycan score; localisation is 0."""
    p = peptide_score(ions, spectrum, coverage, weight=1.0 if glycosylated else 0.7, glycosylated=glycosylated)
    with_pep = ions.withColumn("_pc", F.col(coverage))
    g = glycan_score(with_pep, spectrum, glycan_coverage, "_pc", prior, None if glycosylated else 0.25)
    if not glycosylated:
        big = of_series(ions, "stub_glycopeptide").groupBy(*spectrum).agg(F.max(F.col("size") > 1).alias("_big"))
        g = g.join(big, spectrum, "left").withColumn("glycan_score", F.when(F.col("_big"), F.col("glycan_score")).otherwise(0.0)).drop("_big")
    return p, g


def partial_split(ions: DataFrame, spectrum: list[str], coverage: str, glycan_coverage: str, glycosylated: bool = True, prior: str | None = None) -> DataFrame:
    """Peptide and glycan parts (see partial_parts) and their sum."""
    p, g = partial_parts(ions, spectrum, coverage, glycan_coverage, glycosylated, prior)
    return p.join(g, spectrum, "full_outer").withColumn("score", split_score("peptide_score", "glycan_score"))


def full_score_set(ions: DataFrame, spectrum: list[str], coverage: str, glycan_coverage: str, label: str, glycosylated: bool = True) -> DataFrame:
    """The fifteen fields of every spectrum as doubles (score_set casts them): scores, coverages,
    shares of the signal that stubs, oxonium ions and all matched ions have, counts,
    correlations, sums of reliabilities and the partition's label.  A spectrum without ions of a
    kind has score, count and reliability 0 for it, and its correlation is null."""
    parts = partial_split(ions.where("series <> 'oxonium_ion'"), spectrum, coverage, glycan_coverage, glycosylated)
    used = lambda c: F.coalesce(F.sum(F.when(c, F.col("intensity"))), F.lit(0.0)) / F.max("total")
    rel = lambda *s: F.coalesce(F.sum(F.when(F.col("series").isin(*s), F.col("reliability"))), F.lit(0.0))
    sums = ions.groupBy(*spectrum).agg(
        used(F.col("series") == "stub_glycopeptide").alias("stub_util"), used(F.col("series") == "oxonium_ion").alias("oxonium_util"), used(F.col("series") != "unassigned").alias("total_util"),
        F.max(coverage).alias("peptide_coverage"), F.max(glycan_coverage).alias("glycan_coverage"), rel("b", "y").alias("peptide_rel"), rel("stub_glycopeptide").alias("glycan_rel"), F.max(label).alias("partition_label"),
    )
    out = sums.join(parts.withColumnRenamed("score", "glycopeptide_score"), spectrum, "left")
    return out.fillna(0, ["glycopeptide_score", "peptide_score", "glycan_score", "n_stub", "backbone_count"]).select(*spectrum, *SCORE_SET)

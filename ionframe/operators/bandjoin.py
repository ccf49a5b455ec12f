"""Tolerance (band) joins: equality on keys plus a relative mass window.

Spark plans a bare range condition as a nested-loop or cartesian join.  Here masses are dealt
into buckets as wide as twice the tolerance on a logarithmic scale, so a partner lies in the
same or a neighbouring bucket, and the join is an equi-join on keys and bucket: it shuffles
both sides once by key and bucket (which also spreads a hot key over its buckets) and checks
the exact window on what meets.  Every left row has one bucket, so no pair comes twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ratio_bucket, wildcard

TOLERANCE = 2e-5
MOST_FEATURES = 1000


def _bucket(mass: Column, width) -> Column:
    return F.floor(F.ln(mass) / width).cast("long")


def band_join(left: DataFrame, right: DataFrame, keys: list[str], left_mass: Column, right_mass: Column, tolerance: float = TOLERANCE) -> DataFrame:
    """Pairs with equal keys and |(l - r) / r| <= tolerance.

    keys are names that both sides have; all other names must differ.  left_mass and
    right_mass are expressions over their own side; rows whose mass is not positive have no
    partner.
    """
    w = 2 * tolerance
    lft = left.withColumn("_l", left_mass).where("_l > 0").withColumn("_k", _bucket(F.col("_l"), w))
    rgt = right.withColumn("_r", right_mass).where("_r > 0").withColumn("_k", _bucket(F.col("_r"), w))
    # fragments are fewer than peaks, and peaks fewer than peaks by features: the right side goes to three buckets
    rgt = rgt.withColumn("_k", F.explode(F.array(F.col("_k") - 1, F.col("_k"), F.col("_k") + 1)))
    near = F.abs(F.try_divide(F.col("_l") - F.col("_r"), F.col("_r"))) <= tolerance
    return lft.join(rgt, [*keys, "_k"]).where(near).withColumn("mass_error", F.try_divide(F.col("_l") - F.col("_r"), F.col("_r"))).drop("_k", "_l", "_r")


def match_fragments(peaks: DataFrame, fragments: DataFrame, keys: list[str], peak_mass: str, fragment_mass: str, tolerance: float = TOLERANCE) -> DataFrame:
    """Peaks against theoretical fragments; the result is a set, so repeated rows are one."""
    return band_join(peaks, fragments, keys, F.col(peak_mass), F.col(fragment_mass), tolerance).dropDuplicates()


def offset_pairs(peaks: DataFrame, keys: list[str], mass: str, ident: list[str], offset, tolerance: float = TOLERANCE) -> DataFrame:
    """Ordered pairs of peaks a, b of one scan with a's mass plus offset near b's; a peak is not
    its own partner.  Columns of peaks come back as a_... and b_... ."""
    others = [c for c in peaks.columns if c not in keys]
    a = peaks.select(*keys, *(F.col(c).alias(f"a_{c}") for c in others))
    b = peaks.select(*keys, *(F.col(c).alias(f"b_{c}") for c in others))
    off = offset if isinstance(offset, Column) else F.lit(float(offset))
    same = None
    for c in ident:
        eq = F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
        same = eq if same is None else same & eq
    return band_join(a, b, keys, F.col(f"a_{mass}") + off, F.col(f"b_{mass}"), tolerance).where(~same)


def feature_pairs(peaks: DataFrame, features: DataFrame, keys: list[str], mass: str, ident: list[str], tolerance: float = TOLERANCE, residues: str | None = None) -> DataFrame:
    """offset_pairs for every row of features (name, offset, and optionally from_charge,
    to_charge, intensity_ratio, of which null fits all).  The catalogue is small by contract
    (a fixed list of relations): it is checked and becomes a literal that peaks are exploded by.

    residues names an array column of peaks: a has one that is not null, features with a residue are
    only those that it names, and b_on tells whether b's is not null.  What a peak can't take is then
    never copied.
    """
    listed = features.limit(MOST_FEATURES + 1).collect()
    if len(listed) > MOST_FEATURES:
        raise ValueError(f"a relation catalogue has at most {MOST_FEATURES} features")
    if not listed:
        listed = [None]
    kinds = features.schema
    literal = F.array(*(F.struct(*(F.lit(None if r is None else r[f.name]).cast(f.dataType).alias(f.name) for f in kinds)) for r in listed))
    others = [c for c in peaks.columns if c not in [*keys, residues]]
    own = [F.col(c).alias(f"a_{c}") for c in others]
    if residues is None:
        a = peaks.select(*keys, *own, F.explode(literal).alias("_f"))
        b = peaks.select(*keys, *(F.col(c).alias(f"b_{c}") for c in others))
    else:
        taken = F.filter(literal, lambda f: f["residue"].isNull() | F.array_contains(F.col(residues), f["residue"]))
        a = peaks.where(F.col(residues).isNotNull()).select(*keys, *own, F.explode(taken).alias("_f"))
        b = peaks.select(*keys, *(F.col(c).alias(f"b_{c}") for c in others), F.col(residues).isNotNull().alias("b_on"))
    a = a.select("*", "_f.*").drop("_f").where("offset is not null")
    same = None
    for c in ident:
        eq = F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
        same = eq if same is None else same & eq
    pairs = band_join(a, b, keys, F.col(f"a_{mass}") + F.col("offset"), F.col(f"b_{mass}"), tolerance).where(~same)
    # a feature may be bound to charges and to a bucket of the intensity ratio
    for name, value in (("from_charge", "a_charge"), ("to_charge", "b_charge")):
        if name in features.columns:
            pairs = pairs.where(wildcard(name, value))
    if "intensity_ratio" in features.columns:
        pairs = pairs.where(wildcard("intensity_ratio", ratio_bucket("a_intensity", "b_intensity")))
    return pairs


def complement_pairs(peaks: DataFrame, keys: list[str], mass: str, ident: list[str], total: str, offset: float = 0.0, tolerance: float = TOLERANCE) -> DataFrame:
    """Pairs with |a + b - (total + offset)| / (total + offset) < tolerance, of which b also lies
    within twice the tolerance of the mass that is missing; total is a column of the scan."""
    others = [c for c in peaks.columns if c not in [*keys, total]]
    target = F.col(total) + offset
    width = 2 * tolerance * target
    a = peaks.select(*keys, F.col(total), *(F.col(c).alias(f"a_{c}") for c in others)).withColumn("_probe", target - F.col(f"a_{mass}")).where("_probe > 0")
    a = a.withColumn("_k", F.floor(F.col("_probe") / width).cast("long")).withColumn("_k", F.explode(F.array(F.col("_k") - 1, F.col("_k"), F.col("_k") + 1))).withColumn("_target", target).drop(total)
    b = peaks.withColumn("_k", F.floor(F.col(mass) / width).cast("long")).select(*keys, "_k", *(F.col(c).alias(f"b_{c}") for c in others))
    same = None
    for c in ident:
        eq = F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
        same = eq if same is None else same & eq
    close = F.abs(F.try_divide(F.col(f"a_{mass}") + F.col(f"b_{mass}") - F.col("_target"), F.col("_target"))) < tolerance
    window = F.abs(F.try_divide(F.col(f"b_{mass}") - F.col("_probe"), F.col("_probe"))) <= 2 * tolerance
    return a.join(b, [*keys, "_k"]).where(close & window & ~same).drop("_k", "_probe", "_target")


def explained(pairs: DataFrame, matches: DataFrame, on: dict[str, str]) -> DataFrame:
    """pairs with the flag expected: the b-peak is explained by a fragment (a semi-join kept as a
    flag).  on maps columns of pairs to columns of matches."""
    m = matches.select(*(F.col(v).alias(k) for k, v in on.items())).distinct().withColumn("expected", F.lit(True))
    return pairs.join(m, list(on), "left").withColumn("expected", F.coalesce("expected", F.lit(False)))

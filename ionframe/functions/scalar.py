"""Scalar functions of the engine as Column expressions; all but erf compile into codegen.

Arguments are Columns (or names); null in gives null out unless said otherwise.  Ratios use
try_divide, so a zero denominator gives null and not an error.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Class numbers of residues (by one-letter code) and of fragment series.
RESIDUE_CLASSES = {"pro": "P", "gly": "G", "ser_thr": "ST", "leu_iso_val_ala": "LIVA", "asn": "N", "his": "H", "arg_lys": "RK", "x": ""}
SERIES = {"b": 0, "y": 1, "stub_glycopeptide": 2, "unassigned": 3}
# Left-closed cut points of the intensity ratio and the first bucket's number.
RATIO_CUTS, RATIO_FIRST = (5.0, 2.5, 1.7, 1.3, 1.0, 0.8, 0.6, 0.4, 0.2), -4
WILDCARD = 999
PROTON = 1.00727646677


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def neutral_mass(mz, charge) -> Column:
    return _c(mz) * _c(charge) - _c(charge) * F.lit(PROTON)


def relative_error(x, y) -> Column:
    """Signed (x - y) / y."""
    return F.try_divide(_c(x) - _c(y), _c(y))


def ratio_bucket(a, b) -> Column:
    """Bucket -4..5 of the ratio a / b; null where b is 0 or the ratio is negative."""
    r = F.try_divide(_c(a), _c(b))
    out = F.when(r >= RATIO_CUTS[0], RATIO_FIRST)
    for i, cut in enumerate(RATIO_CUTS[1:], 1):
        out = out.when(r >= cut, RATIO_FIRST + i)
    return out.when(r >= 0, RATIO_FIRST + len(RATIO_CUTS))


def wildcard(pattern, value) -> Column:
    """Whether value fits pattern; a null pattern (or the number 999) fits every value."""
    p = _c(pattern)
    return p.isNull() | (p == WILDCARD) | (p == _c(value))


def proton_mobility(basic, charge) -> Column:
    """mobile, partial or immobile by the number of basic residues; unknown charge is mobile."""
    k, z = _c(basic), _c(charge)
    return F.when(z.isNull() | (k < z), "mobile").when(k == z, "partial").otherwise("immobile")


def residue_class(residue) -> Column:
    """Class 0..7 of a one-letter residue; unknown letters are 7, null is null."""
    r = _c(residue)
    out = F.when(r.isNull(), F.lit(None).cast("int"))
    for i, letters in enumerate(RESIDUE_CLASSES.values()):
        if letters:
            out = out.when(r.isin(*letters), i)
    return out.otherwise(len(RESIDUE_CLASSES) - 1)


#: Classes that decide an amide bond, in order of precedence; the N-side goes first in each.
_BOND_ORDER = (0, 1, 2, 3, 4, 5)


def amide_bond(n_term, c_term) -> Column:
    """struct(n, c): the classes of the residues beside a bond, of which only the first of the
    precedence pro, gly, ser_thr, leu_iso_val_ala, asn, his is named and the other is x (7)."""
    n, c = residue_class(n_term), residue_class(c_term)
    x = F.lit(7)
    out = None
    for k in _BOND_ORDER:
        for cond, pair in ((n == k, (F.lit(k), x)), (c == k, (x, F.lit(k)))):
            value = F.struct(pair[0].alias("n"), pair[1].alias("c"))
            out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(F.struct(x.alias("n"), x.alias("c")))


def site_index(position, size, forward, n_side: bool) -> Column:
    """0-based residue beside a cleavage site; forward: the series counts from the N-terminus."""
    p, s = _c(position), _c(size)
    if n_side:
        return F.when(_c(forward), p - 1).otherwise(s - p - 1)
    return F.when(_c(forward), p).otherwise(s - p)


def centre_distance(index, size, cap: int = 10) -> Column:
    return F.least(F.abs(F.floor(_c(size) / 2) - _c(index)), F.lit(cap)).cast("int")


def logit(x) -> Column:
    return F.ln(F.try_divide(_c(x), 1 - _c(x)))


def inv_logit(x) -> Column:
    return 1 / (1 + F.exp(-_c(x)))


def pad(x, base) -> Column:
    """A reliability from 0..1 to base..1."""
    return _c(x) * (1 - _c(base)) + _c(base)


def unpad(x, base) -> Column:
    return F.try_divide(_c(x) - _c(base), 1 - _c(base))


def smoothstep(x, n: int = 1) -> Column:
    """Generalised smoothstep of order n on 0..1, from its polynomial of binomials."""
    from math import comb

    v = F.least(F.greatest(_c(x), F.lit(0.0)), F.lit(1.0))
    terms = [float(comb(n + k, k) * comb(2 * n + 1, n - k) * (-1) ** k) * F.pow(v, F.lit(n + k + 1)) for k in range(n + 1)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def normal_cdf_logistic(x) -> Column:
    """Logistic curve scaled to 0 at 0 and towards 1."""
    return 2 / (1 + F.exp(-_c(x))) - 1


def correlation_score(r, n) -> Column:
    """(1 + r) / 2 * 2 * log10(n)."""
    return (1 + _c(r)) / 2 * 2 * F.log10(_c(n).cast("double"))


def correlation_score_log(r, n) -> Column:
    """-ln(1 - r) * n; null for r of 1."""
    return -F.ln(1 - _c(r)) * _c(n)


def is_close(x, y, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(_c(x) - _c(y)) <= atol + rtol * F.abs(_c(y))


def partition_offset(from_charge, to_charge, ratio, max_charge: int) -> Column:
    """Slot of (from, to, ratio) in a flat table of ten ratio slots for each pair of charges 1..max_charge."""
    return ((_c(from_charge) - 1) * max_charge + (_c(to_charge) - 1)) * 10 + (_c(ratio) + 4)


# Whole units of mass at which the rank rises from 1.
MASS_UNIT, MASS_CUTS = 121.6, (9, 13, 17, 20)


def mass_rank(mass) -> Column:
    """Rank 1..5 of a peptide mass."""
    units = F.floor(_c(mass) / MASS_UNIT)
    out = F.when(units < MASS_CUTS[0], 1)
    for i, cut in enumerate(MASS_CUTS[1:], 2):
        out = out.when(units < cut, i)
    return out.when(units.isNotNull(), len(MASS_CUTS) + 1)


def mass_ratio_bin(glycan, peptide) -> Column:
    """Glycan to peptide mass ratio 0..5 in steps of 0.4 up to 2."""
    r = F.try_divide(_c(glycan), _c(peptide))
    return F.when(r < 0.4, 0).when(r < 0.8, 1).when(r < 1.2, 2).when(r < 1.6, 3).when(r < 2.0, 4).when(r.isNotNull(), 5)


def ion_type(key) -> Column:
    """b, c, y or z by a fragment key's first letter, else stub_ion if it names the peptide, else oxonium."""
    k = _c(key)
    return F.when(F.substring(k, 1, 1).isin("b", "c", "y", "z"), F.substring(k, 1, 1)).when(k.contains("pep"), "stub_ion").otherwise("oxonium")


def compact(*parts, sep: str = ":") -> Column:
    return F.concat_ws(sep, *(_c(p).cast("string") for p in parts))


def typecast(value) -> Column:
    """struct(kind, i, d, b, s): what an annotation's text holds, tried as integer, double,
    true/false and null before text.  Texts stay in s whatever their kind."""
    v = _c(value)
    t = F.lower(F.trim(v))
    i, d = F.trim(v).try_cast("bigint"), F.when(~t.rlike("[df]$"), F.trim(v).try_cast("double"))
    b = F.when(t == "true", True).when(t == "false", False)
    kind = F.when(v.isNull() | (t == "null"), "null").when(F.trim(v).rlike(r"^[+-]?\d+$") & i.isNotNull(), "int").when(d.isNotNull(), "double").when(b.isNotNull(), "bool").otherwise("str")
    return F.struct(kind.alias("kind"), F.when(kind == "int", i).alias("i"), F.when(kind.isin("int", "double"), d).alias("d"), b.alias("b"), v.alias("s"))


def activation(value) -> Column:
    """The activation method; missing or unknown ones are hcd."""
    v = _c(value)
    return F.when(v.isNull() | F.lower(v).startswith("unknown"), "hcd").otherwise(v)


def reverse_keeping_ends(residues) -> Column:
    """A decoy sequence: the residues between the first and the last in reverse order."""
    r = _c(residues)
    n = F.size(r)
    return F.when(n <= 3, r).otherwise(F.concat(F.slice(r, 1, 1), F.reverse(F.slice(r, F.lit(2), n - 2)), F.slice(r, n, F.lit(1))))


def labile_count(glycan: Column) -> Column:
    """Sialic acids of a composition (map of sugar to count)."""
    return sum((F.coalesce(F.try_element_at(glycan, F.lit(x)), F.lit(0)) for x in ("NeuAc", "NeuGc")), F.lit(0))


def fucose_count(glycan: Column) -> Column:
    """Deoxyhexoses of a composition."""
    return sum((F.coalesce(F.try_element_at(glycan, F.lit(x)), F.lit(0)) for x in ("Fuc", "dHex")), F.lit(0))


def glycan_size(glycan: Column) -> Column:
    """All sugars of a composition."""
    return F.aggregate(F.map_values(glycan), F.lit(0), lambda t, v: t + v)


def internal_size(glycan: Column) -> Column:
    """The sugars of a composition without its labile ones: the approximate size of its inside."""
    return glycan_size(glycan) - labile_count(glycan)


def erf(x) -> Column:
    """The error function, by batches in Python as Spark has none; null stays null."""

    @F.pandas_udf("double")
    def batch(v: pd.Series) -> pd.Series:
        return v.map(math.erf, na_action="ignore")

    return batch(_c(x).cast("double"))


def shifted_erf(x, shift: float = 0.0) -> Column:
    """A sigmoid from 0 to 1 about shift / 6."""
    return (erf(_c(x) * 6 - shift) + 1) / 2


def fit_slots(from_charge, to_charge, ratio, rate, max_charge: int) -> Column:
    """Aggregate: a map from a fit's offset to its rate; read it by partition_offset."""
    key = partition_offset(from_charge, to_charge, ratio, max_charge).cast("int")
    return F.map_from_entries(F.array_sort(F.collect_set(F.struct(key.alias("k"), _c(rate).alias("v")))))

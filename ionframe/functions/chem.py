"""Masses, fragments of structures, decoys, mass shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Monoisotopic masses.
RESIDUES = {
    "G": 57.02146372, "A": 71.03711379, "S": 87.03202841, "P": 97.05276385, "V": 99.06841391, "T": 101.04767847, "C": 103.00918448, "L": 113.08406398, "I": 113.08406398, "N": 114.04292744,
    "D": 115.02694303, "Q": 128.05857751, "K": 128.09496302, "E": 129.04259309, "M": 131.04048461, "H": 137.05891186, "F": 147.06841391, "R": 156.10111103, "Y": 163.06332853, "W": 186.07931295,
}
MODIFICATIONS = {"Carbamidomethyl": 57.02146372, "Oxidation": 15.99491462, "Deamidated": 0.98401559, "Gln->pyro-Glu": -17.02654910, "Phospho": 79.96633041, "Acetyl": 42.01056469}
SUGARS = {"Hex": 162.05282342, "HexNAc": 203.07937252, "Fuc": 146.05790880, "dHex": 146.05790880, "NeuAc": 291.09541652, "NeuGc": 307.09033114}
FUCOSES = ("Fuc", "dHex")
WATER, HYDROGEN = 18.01056469, 1.00782503
SHIFTS = {"Unmodified": 0.0, "Ammonium": 17.02654910, "Sodium": 21.98194425, "Potassium": 37.95588165}


def _lookup(table: dict[str, float], key: Column, default: float = 0.0) -> Column:
    """A fixed table as a map literal: one probe per row, no join."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, key), F.lit(default))


def residue_mass(r: Column) -> Column:
    """Mass of a residue struct (aa, mods) without its glycans."""
    return _lookup(RESIDUES, r["aa"]) + F.aggregate(r["mods"], F.lit(0.0), lambda t, m: t + _lookup(MODIFICATIONS, m))


def glycan_mass(glycan: Column) -> Column:
    return F.aggregate(F.map_entries(glycan), F.lit(0.0), lambda t, e: t + _lookup(SUGARS, e["key"]) * e["value"])


def backbone_fragments(structures: DataFrame) -> DataFrame:
    """b and y ions of each structure: series, position, name, mass, flank_n, flank_c, glycosylation_size
    (0: the bare peptide bond).  Prefix sums are array expressions of the residues."""
    s = structures.withColumn("_m", F.transform("residues", residue_mass)).withColumn("_n", F.size("residues"))
    e = s.where("_n > 1").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n") - 1)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, v: t + v)
    pre, post = total(F.slice("_m", F.lit(1), F.col("_i"))), total(F.slice("_m", F.col("_i") + 1, F.col("_n") - F.col("_i")))
    flanks = [F.get("residues", F.col("_i") - 1)["aa"].alias("flank_n"), F.get("residues", F.col("_i"))["aa"].alias("flank_c")]
    ions = F.array(
        F.struct(F.lit("b").alias("series"), F.col("_i").alias("position"), pre.alias("mass")),
        F.struct(F.lit("y").alias("series"), (F.col("_n") - F.col("_i")).alias("position"), (post + WATER).alias("mass")),
    )
    out = e.select("structure", *flanks, F.explode(ions).alias("f")).select("structure", "f.*", "flank_n", "flank_c")
    return out.withColumn("name", F.concat("series", F.col("position").cast("string"))).withColumn("glycosylation_size", F.lit(0))


def stub_fragments(structures: DataFrame) -> DataFrame:
    """Peptide + partial glycan ions: every sub-composition of the structure's glycan, by sugar
    an explode over 0..count; name is the composition's text, fucose its number of deoxyhexoses."""
    s = structures.withColumn("_pep", F.aggregate(F.transform("residues", residue_mass), F.lit(WATER), lambda t, v: t + v))
    out = s.select("structure", "glycan", "_pep", F.lit(0.0).alias("_g"), F.lit(0).alias("glycosylation_size"), F.lit(0).alias("fucose"), F.lit("peptide").alias("name"))
    for sugar, mass in SUGARS.items():
        count = F.coalesce(F.try_element_at("glycan", F.lit(sugar)), F.lit(0))
        out = out.withColumn("_k", F.explode(F.sequence(F.lit(0), count)))
        out = out.withColumns({"_g": F.col("_g") + F.col("_k") * mass, "glycosylation_size": F.col("glycosylation_size") + F.col("_k"), "fucose": F.col("fucose") + (F.col("_k") if sugar in FUCOSES else F.lit(0)), "name": F.when(F.col("_k") > 0, F.concat("name", F.lit(f"+{sugar}"), F.col("_k").cast("string"))).otherwise(F.col("name"))}).drop("_k")
    return out.select("structure", F.lit("stub_glycopeptide").alias("series"), F.lit(None).cast("int").alias("position"), (F.col("_pep") + F.col("_g")).alias("mass"), F.lit(None).cast("string").alias("flank_n"), F.lit(None).cast("string").alias("flank_c"), "name", "glycosylation_size", "fucose")


def all_products(fragments: DataFrame, matches: DataFrame, keys: list[str], charges: int = 5, dummy: float = 1.0) -> DataFrame:
    """Every fragment at charges 1..charges with its observed intensity, else dummy; repeats are one."""
    full = fragments.withColumn("charge", F.explode(F.sequence(F.lit(1), F.lit(charges))))
    seen = matches.groupBy(*keys, "charge").agg(F.max("intensity").alias("intensity"))
    return full.dropDuplicates([*keys, "charge"]).join(seen, [*keys, "charge"], "left").withColumn("intensity", F.coalesce("intensity", F.lit(dummy)))


def with_unassigned(products: DataFrame, structure: list[str], series: str = "series") -> DataFrame:
    """Products and one unassigned row (charge 0, no fragment) for each structure."""
    rest = products.select(*structure).distinct().withColumns({series: F.lit("unassigned"), "charge": F.lit(0)})
    return products.unionByName(rest, allowMissingColumns=True)


def delta_series(fragments: DataFrame, series_shift: str, delta: float) -> DataFrame:
    """A pseudo series of b-like fragments: their bare masses moved by delta, named by it.
    series_shift is the mass that the fragments' own series adds."""
    return fragments.withColumns({"mass": F.col("mass") - F.col(series_shift) + delta, "series": F.lit(str(delta)), "name": F.concat(F.lit(f"{delta}:"), F.col("position").cast("string"))})


#: Most that a decoy glycan's mass is moved by, either way.
DECOY_SHIFT = 30.0


def decoys(structures: DataFrame, peptide: bool = True, glycan: bool = False) -> DataFrame:
    """Decoys beside the targets: with peptide, the inner residues in reverse order; with glycan,
    the glycan's mass (glycan_shift) moved by an amount up to DECOY_SHIFT that depends on the
    structure alone, so that it is drawn alike wherever it is computed."""
    from .scalar import reverse_keeping_ends

    d = structures.withColumn("residues", reverse_keeping_ends("residues")) if peptide else structures
    out = structures.withColumn("decoy", F.lit(False)).unionByName(d.withColumn("structure", F.concat(F.lit("decoy:"), "structure")).withColumn("decoy", F.lit(True)))
    if not glycan:
        return out
    share = F.crc32(F.col("structure").cast("binary")) % 6001 / 3000 - 1
    return out.withColumn("glycan_shift", F.when(F.col("decoy"), share * DECOY_SHIFT).otherwise(0.0))


def unknown_shift(name: Column) -> Column:
    """Whether a shift (null: none) has a term whose name is not known."""
    known = F.array(*map(F.lit, SHIFTS))
    return F.coalesce(F.exists(F.split(name, r"\s+\+\s+"), lambda t: ~F.array_contains(known, F.trim(F.substring_index(t, "*", -1)))), F.lit(False))


def mass_shift(name: Column) -> Column:
    """Mass of a shift: a name, or a sum of n*name; an unknown name counts as unmodified (0)."""
    term = lambda t: F.when(t.contains("*"), F.trim(F.substring_index(t, "*", 1)).try_cast("double")).otherwise(1.0) * _lookup(SHIFTS, F.trim(F.substring_index(t, "*", -1)))
    return F.aggregate(F.split(name, r"\s+\+\s+"), F.lit(0.0), lambda s, t: s + F.coalesce(term(t), F.lit(0.0)))

"""Fragment encoders: one-hot (and count) feature vectors as arrays of set indices.

A block of a model is an expression that gives the index it sets, or null where it sets
none; a model is a list of blocks in a fixed order with their widths.  A count of c is the
index c times: whatever adds up the coefficients of the indices then multiplies by it.  Rows
carry n, c (residue classes), series (0 b, 1 y, 2 stub, 3 unassigned), charge (1..5), glyc
(size), and, for the larger models, fuc, labile, loss (sugars lost of the whole glycan),
loss_internal (of its internal part, see scalar.internal_size), comp (array of class counts),
near_n, near_c (classes at 1..depth) and dist.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARGES, CLASSES, BACKBONE, STUB_MAX, LOSSES, LABILE, FUCOSE = 5, 8, 2, 14, 29, 6, 6
_ZS = range(1, CHARGES + 1)


# Labels of the residue classes and fragment series in the names of features.
CLASS_LABELS = ("pro", "gly", "ser_thr", "leu_iso_val_ala", "asn", "his", "arg_lys", "x")
SERIES_LABELS = ("b", "y", "stub_glycopeptide")


def _named(pattern: str, *values) -> tuple[str, ...]:
    """The pattern for every combination of the values, the last value running fastest."""
    return tuple(pattern.format(*v) for v in itertools.product(*values))


@dataclass(frozen=True)
class Block:
    """A block's features by name, and the index that a row sets among them."""

    names: tuple[str, ...]
    indices: tuple  # Columns relative to the block
    counts: tuple = ()  # how often each is set, once by default
    ascending: bool = False  # several indices are in order

    @property
    def width(self) -> int:
        return len(self.names)


def _assigned() -> Column:
    return F.col("series") != 3


def _backbone() -> Column:
    return F.col("series") < 2


def _stub() -> Column:
    return F.col("series") == 2


def _z() -> Column:
    return F.least(F.col("charge"), F.lit(CHARGES)) - 1


def base() -> list[Block]:
    return [
        Block(_named("n-term {}", CLASS_LABELS), (F.col("n"),)),
        Block(_named("c-term {}", CLASS_LABELS), (F.col("c"),)),
        Block(_named("series {}", SERIES_LABELS), (F.when(_assigned(), F.col("series")),)),
        Block(("unassigned",), (F.when(~_assigned(), 0),)),
        Block(_named("charge {}", _ZS), (F.when(_backbone(), _z()),)),
        Block(_named("series {}:charge {}", SERIES_LABELS, _ZS), (F.when(_assigned(), F.col("series") * CHARGES + _z()),)),
        Block(_named("is_glycosylated {}", range(BACKBONE + 1)), (F.when(_backbone(), F.least(F.col("glyc"), F.lit(BACKBONE))),)),
    ]


def proline() -> list[Block]:
    pro = _backbone() & (F.col("c") == 0)
    return [
        Block(_named("charge {}:c-term pro", _ZS), (F.when(pro, _z()),)),
        Block(_named("series:c-term pro {}", SERIES_LABELS[:2]), (F.when(pro, F.col("series")),)),
        Block(_named("is_glycosylated:c-term pro {}", range(BACKBONE + 1)), (F.when(pro, F.least(F.col("glyc"), F.lit(BACKBONE))),)),
    ]


def composition() -> list[Block]:
    """The classes of the stub's sequence are set as often as comp counts them."""
    return [
        Block(_named("stub glycopeptide:is_glycosylated {}", range(STUB_MAX + 1)), (F.when(_stub(), F.least(F.col("glyc"), F.lit(STUB_MAX))),)),
        Block(_named("stub glycopeptide:composition {}", CLASS_LABELS), tuple(F.when(_stub(), k) for k in range(CLASSES)), tuple(F.get("comp", F.lit(k)) for k in range(CLASSES)), ascending=True),
    ]


def fucose() -> list[Block]:
    return [Block(_named("stub glycopeptide:charge {}:fucose {}", _ZS, range(FUCOSE + 1)), (F.when(_stub(), _z() * (FUCOSE + 1) + F.least(F.col("fuc"), F.lit(FUCOSE))),))]


def neighbours(depth: int) -> list[Block]:
    return [Block(_named(f"{side} {i + 1} {{}}", CLASS_LABELS), (F.when(_backbone(), F.get(col, F.lit(i))),)) for side, col in (("n-term -", "near_n"), ("c-term +", "near_c")) for i in range(depth)]


def distance(cap: int = 10) -> list[Block]:
    return [Block(tuple(f"cleavage site distance {d}:series {s!r}" for s in SERIES_LABELS[:2] for d in range(cap + 1)), (F.when(_backbone(), F.col("series") * (cap + 1) + F.least(F.col("dist"), F.lit(cap))),))]


def loss(size: str = "loss") -> list[Block]:
    return [Block(_named("stub glycopeptide:charge {}:glycan loss {}", _ZS, range(LOSSES)), (F.when(_stub(), _z() * LOSSES + F.least(F.col(size), F.lit(LOSSES - 1))),))]


def labile() -> list[Block]:
    return [Block(_named("stub glycopeptide:charge {}:labile monosaccharides {}", _ZS, range(LABILE + 1)), (F.when(_stub(), _z() * (LABILE + 1) + F.least(F.col("labile"), F.lit(LABILE))),))]


def cross() -> list[Block]:
    return [Block(_named("series {}:n-term {}:c-term {}", SERIES_LABELS[:2], CLASS_LABELS, CLASS_LABELS), (F.when(_backbone(), F.col("c") + CLASSES * F.col("n") + CLASSES * CLASSES * F.col("series")),))]


def _near(depth):
    return lambda: [*base(), *proline(), *composition(), *fucose(), *neighbours(depth)]


#: Models by name; a user's own model is one more entry.
MODELS = {
    "FragmentType": base,
    "ProlineSpecializingModel": lambda: [*base(), *proline()],
    "StubGlycopeptideCompositionModel": lambda: [*base(), *proline(), *composition()],
    "StubGlycopeptideFucosylationModel": lambda: [*base(), *proline(), *composition(), *fucose()],
    "NeighboringAminoAcidsModel": _near(1),
    "NeighboringAminoAcidsModelDepth2": _near(2),
    "NeighboringAminoAcidsModelDepth3": _near(3),
    "NeighboringAminoAcidsModelDepth4": _near(4),
    "CleavageSiteCenterDistanceModel": lambda: [*_near(2)(), *distance()],
    "StubChargeModel": lambda: [*_near(2)(), *loss()],
    "StubChargeModelApproximate": lambda: [*_near(2)(), *loss("loss_internal")],
    "LabileMonosaccharideAwareModel": lambda: [*_near(2)(), *loss(), *labile()],
    "LabileMonosaccharideAwareModelApproximate": lambda: [*_near(2)(), *loss("loss_internal"), *labile()],
    "AmideBondCrossproductModel": lambda: [*base(), *proline(), *composition(), *cross()],
}


def register(name: str, blocks) -> None:
    """Add a model: blocks is a callable that gives its list of blocks."""
    MODELS[name] = blocks


def width(model: str) -> int:
    return sum(b.width for b in MODELS[model]())


def feature_names(model: str) -> list[str]:
    return [n for b in MODELS[model]() for n in b.names]


def encode(blocks: list[Block]) -> Column:
    """The sorted indices that a row sets, those with a count as often as that."""
    parts, single, offset = [], [], 0
    for b in blocks:
        own = [(F.lit(offset) + i).cast("int") for i in b.indices]
        if b.counts:
            parts += [F.array(*single)] if single else []
            parts += [F.array_repeat(i, F.coalesce(c, F.lit(0)).cast("int")) for i, c in zip(own, b.counts)]
            single = []
        else:
            single += own
        offset += b.width
    parts += [F.array(*single)] if single else []
    found = F.array_compact(F.concat(*parts) if len(parts) > 1 else parts[0])
    # blocks follow each other, so their indices are in order unless a block's own are not
    return found if all(b.ascending or len(b.indices) == 1 for b in blocks) else F.array_sort(found)


def encode_model(model: str) -> Column:
    return encode(MODELS[model]())


def as_dict(model: str, indices: str = "idx") -> Column:
    """A map from the names of the features that a row sets to how often."""
    names = F.array(*map(F.lit, feature_names(model)))
    i = F.col(indices)
    return F.map_from_entries(F.transform(F.array_distinct(i), lambda k: F.struct(F.get(names, k).alias("k"), F.size(F.filter(i, lambda v: v == k)).alias("v"))))


def classify(series: str, charge: str, flank_n: str, flank_c: str, size: str) -> dict[str, Column]:
    """The encoders' columns n, c, series, charge and glyc of a peak and the fragment that explains
    it.  A null series is unassigned; one that has no code is an error."""
    from .scalar import amide_bond

    s = F.col(series)
    backbone = s.isin("b", "y")
    code = F.when(s == "b", 0).when(s == "y", 1).when(s == "stub_glycopeptide", 2).when(s.isNull() | (s == "unassigned"), 3)
    # cast to the type of the code: an error has none
    code = F.coalesce(code, F.raise_error(F.concat(F.lit("no code for series "), s)).cast("int"))
    bond = amide_bond(flank_n, flank_c)
    return {
        "n": F.when(backbone, bond["n"]), "c": F.when(backbone, bond["c"]), "series": code,
        "charge": F.when(code == 3, 0).otherwise(F.least(F.col(charge), F.lit(CHARGES))),
        "glyc": F.when(code == 3, 0).when(code == 2, F.least(F.col(size), F.lit(STUB_MAX))).otherwise(F.col(size)),
    }

"""The grid of partition cells: generation, assignment, routing and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The grid's dimensions; intervals include both ends.
LENGTHS = [(a, a + 5) for a in range(0, 50, 5)]
SIZES = [(a, a + 4) for a in range(1, 20, 4)]
ONE_SIZE = [(1, 25)]
CHARGES = (2, 3, 4, 5, 6)
MOBILITIES = ("mobile", "partial", "immobile")
TYPES, COUNTS = (1, 2, 3), (1, 2)
#: Most cells of a grid; a grid is broadcast, and a larger one is an error.
MOST_CELLS = 100_000


def grid(spark: SparkSession, lengths=LENGTHS, sizes=SIZES, charges=CHARGES, mobilities=MOBILITIES, types=TYPES, counts=COUNTS) -> DataFrame:
    """Every cell: length_lo, length_hi, size_lo, size_hi, charge, mobility, glycan_type, glycan_count."""
    n = len(lengths) * len(sizes) * len(charges) * len(mobilities) * len(types) * len(counts)
    if n > MOST_CELLS:
        raise ValueError(f"{n} cells; a grid has at most {MOST_CELLS}")

    # a cell's number gives its place in each dimension, so no dimension is joined
    dims = [("length", lengths), ("size", sizes), ("charge", charges), ("mobility", mobilities), ("glycan_type", types), ("glycan_count", counts)]
    out, stride = [], n
    for name, values in dims:
        stride //= len(values)
        at = (F.floor(F.col("id") / stride) % len(values)).cast("int")
        pick = lambda vs: F.get(F.array(*map(F.lit, vs)), at)
        if isinstance(values[0], tuple):
            out += [pick([v[0] for v in values]).alias(f"{name}_lo"), pick([v[1] for v in values]).alias(f"{name}_hi")]
        else:
            out.append(pick(values).alias(name))
    return spark.range(n).select(*out)


def first_interval(df: DataFrame, value: str, intervals: list[tuple[int, int]], lo: str, hi: str, nearest: bool = False) -> DataFrame:
    """df with the bounds of the first interval that holds value, both ends included, so a
    shared edge goes to the lower one.  Else null, or, if nearest, the interval whose middle is
    nearest (ties: the first).  The list is fixed, so this is an expression and not a join."""
    v = F.col(value)

    def pick(i: int) -> Column:
        out = None
        for iv in sorted(intervals):
            cond = v.between(*iv)
            out = F.when(cond, iv[i]) if out is None else out.when(cond, iv[i])
        if nearest:
            options = [F.struct(F.abs(v - (a + b) / 2).alias("d"), F.lit(k).alias("k"), F.lit((a, b)[i]).alias("e")) for k, (a, b) in enumerate(sorted(intervals))]
            out = out.otherwise(F.when(v.isNotNull(), F.least(*options)["e"] if len(options) > 1 else options[0]["e"]))
        return out

    return df.withColumn(lo, pick(0)).withColumn(hi, pick(1))


def nearest_key(values: DataFrame, cells: DataFrame, given: list[str], key: str, distance, order, value: str) -> DataFrame:
    """One level of routing as a table: (given columns, value, key), where key is the cells' key
    with the least distance to each of the values among the branches below the given columns;
    ties go to the first key in order.  A grid bounds the branches, and the values are the
    different ones of one column, so the table is small whatever the number of rows to route."""
    keys = F.collect_list(key).alias("_keys")
    branches = cells.select(*given, key).distinct()
    branches = branches.groupBy(*given).agg(keys) if given else branches.agg(keys)
    best = F.array_min(F.transform("_keys", lambda k: F.struct(distance(k, F.col(value)).alias("d"), order(k).alias("o"), k.alias("k"))))["k"]
    return branches.crossJoin(values.select(value).distinct()).select(*given, value, best.alias(key))


def nearest_route(values: DataFrame, models: DataFrame, key: str, place) -> DataFrame:
    """(key, to_key) for the different values of one column that makes the cell: the models' cell that is
    nearest by place (an expression of a key; an unknown place counts as the middle of the models'),
    ties to the first.  A cell that has a model is its own nearest."""
    middle = models.select(key).distinct().agg(F.percentile(place(F.col(key)), 0.5).alias("_middle"))
    own = values.select(F.col(key).alias("_own")).distinct().crossJoin(F.broadcast(middle))
    own = own.select(F.struct("_own", F.coalesce(place(F.col("_own")).cast("double"), "_middle").alias("at")).alias("_value"))
    far = lambda k, v: F.when(k == v["_own"], F.lit(-1.0)).otherwise(F.coalesce(F.abs(place(k) - v["at"]), F.lit(float("inf"))))
    return nearest_key(own, models, [], key, far, lambda k: k, "_value").select(F.col("_value._own").alias(key), F.col(key).alias(f"to_{key}"))


def mobility_order(m) -> Column:
    return F.when(m == "mobile", 0).when(m == "partial", 1).when(m == "immobile", 2)


def route(psms: DataFrame, cells: DataFrame) -> DataFrame:
    """Each PSM (length, size, charge, mobility, glycan_type, glycan_count) to a cell of those
    that exist: greedy by level, length, size, charge, mobility, then type and count.

    At each level the first interval or the equal key wins, else the nearest of the branches
    left.  Unknown charge takes the middle key.  A type that no branch has costs 1 more.  Keys are
    looked up for the different values of each level (few, whatever the number of PSMs), and
    the PSMs take theirs by a join for each level.
    """
    mid = lambda k, v: F.abs(v - (k["lo"] + k["hi"]) / 2)
    iv = cells.select(F.struct(F.col("length_lo").alias("lo"), F.col("length_hi").alias("hi")).alias("length_iv"), F.struct(F.col("size_lo").alias("lo"), F.col("size_hi").alias("hi")).alias("size_iv"), F.col("charge").alias("to_charge"), F.col("mobility").alias("to_mobility"), F.struct(F.col("glycan_type").alias("t"), F.col("glycan_count").alias("c")).alias("tc"))
    hit = lambda k, v: F.when(v.between(k["lo"], k["hi"]), -1.0).otherwise(mid(k, v))
    middle = F.lit(sorted(CHARGES)[len(CHARGES) // 2])
    levels = [
        ("length_iv", "length", hit, lambda k: k["lo"]), ("size_iv", "size", hit, lambda k: k["lo"]),
        ("to_charge", "charge", lambda k, v: F.abs(k - F.coalesce(v, middle)).cast("double"), lambda k: k),
        ("to_mobility", "mobility", lambda k, v: F.abs(mobility_order(k) - mobility_order(v)).cast("double"), lambda k: k),
        ("tc", "_tc", lambda k, v: F.abs(k["c"] - v["glycan_count"]) + F.when(k["t"] == v["glycan_type"], 0.0).otherwise(1.0), lambda k: k),
    ]
    # the different values of all levels in one row, made once
    own = psms.withColumn("_tc", F.struct("glycan_type", "glycan_count"))
    seen = own.agg(*(F.collect_set(F.struct(v)).alias(f"_all_{v}") for _, v, *_ in levels))
    out, given = own, []
    for key, value, distance, order in levels:
        values = seen.select(F.explode(f"_all_{value}").alias("_s")).select(F.col(f"_s.{value}").alias(value))
        table = nearest_key(values, iv, given, key, distance, order, value).withColumnsRenamed({c: f"_on_{c}" for c in [*given, value]})
        out = out.join(table, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in [*given, value]], "left").drop(*(f"_on_{c}" for c in [*given, value]))
        given = [*given, key]
    label = F.concat_ws(":", "length_iv.lo", "length_iv.hi", "size_iv.lo", "size_iv.hi", "to_charge", "to_mobility", "tc.t", "tc.c")
    return out.select(*psms.columns, label.alias("cell"))


def assign(psms: DataFrame, nearest: bool = False, sizes=SIZES) -> DataFrame:
    """PSMs with the first length and size intervals that hold them (training takes only exact
    cells, scoring the nearest as well); length_lo or size_lo is null where none does."""
    out = first_interval(psms, "length", LENGTHS, "length_lo", "length_hi", nearest)
    return first_interval(out, "size", sizes, "size_lo", "size_hi", nearest)


def holds(size: str = "size", labile: str | None = None) -> Column:
    """Whether a row's cell (length_lo .. glycan_count, prefixed cell_ where a PSM has the name)
    holds its PSM: both intervals with their ends, equal mobility, charge, type and count.  With
    labile, the size is that without labile sugars."""
    own = F.col(size) - (F.coalesce(F.col(labile), F.lit(0)) if labile else F.lit(0))
    ok = F.col("length").between(F.col("length_lo"), F.col("length_hi")) & own.between(F.col("size_lo"), F.col("size_hi"))
    for c in ("mobility", "charge", "glycan_type", "glycan_count"):
        ok = ok & (F.col(c) == F.col(f"cell_{c}"))
    return F.coalesce(ok, F.lit(False))


def level_values(size: str, labile: str) -> dict[str, Column]:
    """What a routing level over length, glycan size or sialylation looks at."""
    return {"length": F.col("length"), "size": F.col(size), "sialylated": F.coalesce(F.col(labile), F.lit(0))}


def partition(psms: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assigned, rejected): PSMs with the bounds of the cell that holds them, and those that no
    cell holds.  A PSM on the edge of two intervals goes to the lower one.  Cells are a grid
    (bounded by MOST_CELLS), so they are broadcast."""
    exact = ["mobility", "charge", "glycan_type", "glycan_count"]
    a = assign(psms)
    bounds = ["length_lo", "length_hi", "size_lo", "size_hi"]
    known = F.broadcast(cells.select(*bounds, *exact).distinct())
    return a.join(known, [*bounds, *exact], "left_semi"), a.join(known, [*bounds, *exact], "left_anti").drop(*bounds)


def members(assigned: DataFrame, spec: list[str]) -> DataFrame:
    """Each specification with the number of its members, in the order of the specification;
    the reverse map (a member's specification) is assigned itself."""
    return assigned.groupBy(*spec).agg(F.count("*").alias("members")).orderBy(*spec)


def adjacent(cells: DataFrame, width: int = 10, charge: str = "charge") -> DataFrame:
    """(cell's columns, neighbour_charge): a cell's own charge and those within width of it that
    lie strictly inside the grid's charges."""
    own = F.col(charge)
    inside = F.filter(F.sequence(F.lit(min(CHARGES) + 1), F.lit(max(CHARGES) - 1)), lambda c: (c != own) & (F.abs(c - own) <= width))
    return cells.withColumn("neighbour_charge", F.explode(F.concat(F.array(own), inside)))


def partition_key(cells: DataFrame, columns: list[str]) -> DataFrame:
    """A dense number from 0 of the distinct cells in order; more than a grid may have are an error."""
    keys = cells.select(*columns).distinct()
    if keys.limit(MOST_CELLS + 1).count() > MOST_CELLS:
        raise ValueError(f"there are more than {MOST_CELLS} different cells")
    return cells.join(F.broadcast(keys.withColumn("partition_key", F.dense_rank().over(Window.orderBy(*columns)) - 1)), columns)

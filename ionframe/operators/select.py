"""Model selection, cross-validation, decoys and false-discovery rates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefix import _small, running
from ..sources.tables import materialize

SEEDS = (0.1, 0.9)


def dominant_ratio(stubs: DataFrame, spectrum: list[str], size: str, intensity: str, total: str) -> DataFrame:
    """Size of the most intense stub (ties: the smaller size) over the total size."""
    best = F.max_by(F.col(size), F.struct(F.col(intensity), -F.col(size)))
    return stubs.groupBy(*spectrum).agg(F.try_divide(best.cast("double"), F.max(total).cast("double")).alias("ratio"))


def peptide_y(matches: DataFrame, spectrum: list[str], size: str, charge: str, intensity: str, total: str) -> DataFrame:
    """Sizes, charges and intensities of a spectrum's peptide-Y ions as arrays (by size, then
    charge; a spectrum has few), and the size of the most intense over the glycan's (0 without
    ions, null for a glycan of size 0).  Equal intensities: the smaller size."""
    stub = F.col("series") == "stub_glycopeptide"
    rows = F.array_sort(F.collect_list(F.when(stub, F.struct(F.col(size).alias("size"), F.col(charge).alias("charge"), F.col(intensity).alias("intensity")))))
    best = F.max(F.when(stub, F.struct(F.col(intensity).alias("i"), (-F.col(size)).alias("s"))))
    out = matches.groupBy(*spectrum).agg(rows.alias("_r"), best.alias("_b"), F.max(total).alias("_t"))
    ratio = F.when(F.col("_b").isNull(), 0.0).otherwise(F.try_divide(-F.col("_b.s"), F.col("_t")))
    return out.select(*spectrum, F.col("_r.size").alias("sizes"), F.col("_r.charge").alias("charges"), F.col("_r.intensity").alias("intensities"), ratio.alias("ratio"))


def structure_groups(psms: DataFrame, structure: str, ident: str) -> DataFrame:
    """PSMs with their structure's number of PSMs and their place in it: a group of any size is
    rows, not an array."""
    w = Window.partitionBy(structure)
    return psms.withColumns({"group_size": F.count("*").over(w), "place": F.row_number().over(w.orderBy(ident))})


def kmeans_1d(df: DataFrame, value: str, seeds=SEEDS, rounds: int = 50) -> list[float]:
    """Centres of a one-dimensional k-means from given seeds, ascending.  Each round is one
    aggregate of k sums; k is fixed."""
    centres = sorted(seeds)
    for _ in range(rounds):
        label = nearest_centre(F.col(value), centres)
        got = {r["k"]: r["m"] for r in df.where(F.col(value).isNotNull()).groupBy(label.alias("k")).agg(F.avg(value).alias("m")).collect()}
        new = sorted(got.get(i, c) for i, c in enumerate(centres))
        if np.allclose(new, centres, atol=1e-12, rtol=0):
            return new
        centres = new
    return centres


def nearest_centre(v: Column, centres: list[float]) -> Column:
    """Number of the nearest centre, ties to the first; -1 for null."""
    options = [F.struct(F.abs(v - c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]
    return F.when(v.isNull(), -1).otherwise(F.least(*options)["i"] if len(options) > 1 else F.lit(0))


def kmeans_cells(df: DataFrame, cell: list[str], value: str, cell_ddl: str, seeds=SEEDS, rounds: int = 50) -> DataFrame:
    """Centres for each cell at once: (cell, centres)."""

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        x, c = f[value].dropna().to_numpy(float), np.sort(np.array(seeds, float))
        for _ in range(rounds):
            own = np.abs(x[:, None] - c).argmin(1) if len(x) else np.empty(0, int)
            new = np.sort([x[own == i].mean() if (own == i).any() else c[i] for i in range(len(c))])
            if np.allclose(new, c, atol=1e-12, rtol=0):
                break
            c = new
        return pd.DataFrame([{k: f[k].iloc[0] for k in cell} | {"centres": c.tolist()}])

    return df.select(*cell, value).groupBy(*cell).applyInPandas(fit, f"{cell_ddl}, centres array<double>")


def choose_model(rows: DataFrame, models: DataFrame, keys: list[str], cluster: str) -> DataFrame:
    """rows with the model of their cluster, or, where there is none, that of the cell's lowest."""
    default = models.groupBy(*keys).agg(F.min(cluster).alias("_default"))
    known = models.select(*keys, F.col(cluster).alias("_known")).distinct()
    out = rows.join(known, [*(rows[k] == known[k] for k in keys), rows[cluster] == known["_known"]], "left").select(*(rows[c] for c in rows.columns), "_known")
    out = out.join(default, keys, "left").withColumn("model", F.coalesce("_known", "_default"))
    return out.drop("_known", "_default")


def folds(df: DataFrame, k: int, order: list, by: list[str], out: str = "fold") -> DataFrame:
    """Fold 1..k: contiguous blocks in the order given, the first n % k of them one larger."""
    return df.withColumn(out, F.ntile(k).over(Window.partitionBy(*by).orderBy(*order)))


def stratified_folds(df: DataFrame, k: int, structure: str, order: list, out: str = "fold", pool: Column | None = None) -> DataFrame:
    """Folds within each structure; structures with one row are pooled.

    The pool may be large: its rows are dealt by pool, else by a hash of their structure, into as many
    parts as there are shuffle partitions, each a block of its own.
    """
    n = F.count("*").over(Window.partitionBy(structure))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stratum = F.when(n > 1, F.col(structure).cast("string")).otherwise(F.concat(F.lit("single-"), (F.pmod(F.xxhash64(structure), F.lit(parts)) if pool is None else pool).cast("string")))
    return folds(df.withColumn("_stratum", stratum), k, order, ["_stratum"], out).drop("_stratum")


def train_test(df: DataFrame, fold: int, column: str = "fold") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(column) != fold), df.where(F.col(column) == fold)


def q_values(df: DataFrame, score: str, decoy: str, by: list[str]) -> DataFrame:
    """df with q: decoys over targets at or above a score, made monotone from below."""
    hit = F.coalesce(F.col(decoy), F.lit(False))
    d = running(df, by, score, {"_decoys": ("sum", hit.cast("long")), "_targets": ("sum", (~hit).cast("long"))}, descending=True)
    fdr = F.try_divide(F.col("_decoys").cast("double"), F.col("_targets").cast("double"))
    d = d.withColumn("_fdr", F.least(F.coalesce(fdr, F.lit(1.0)), F.lit(1.0))).drop("_decoys", "_targets")
    if not _small(df, by, None):
        # the second run reads its input several times, and the first one's plan in each
        d = materialize(d, "fdr")
    return running(d, by, score, {"q": ("min", F.col("_fdr"))}).drop("_fdr")


def svm_scores(df: DataFrame, features: list[str], label: str, out: str = "svm") -> DataFrame:
    """Scores of a linear support vector machine that tells targets (1) from decoys (0).  Rows with
    a feature or label that is null or NaN are not learned from; without all features their score is null."""
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    known = F.lit(True)
    for f in features:
        known = known & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    rows = df.withColumns({"_label": F.col(label).cast("double"), "_known": known, **{f"_x_{f}": F.when(known, F.col(f).cast("double")).otherwise(0.0) for f in features}})
    ready = VectorAssembler(inputCols=[f"_x_{f}" for f in features], outputCol="_f").transform(rows)
    model = LinearSVC(featuresCol="_f", labelCol="_label", maxIter=50, regParam=0.01, standardization=True).fit(ready.where("_known and _label is not null"))
    score = F.when(F.col("_known"), F.get(vector_to_array("rawPrediction"), F.lit(1)))
    return model.transform(ready).withColumn(out, score).select(*df.columns, out)


def _distance_sums(v: np.ndarray) -> np.ndarray:
    """The sum of distances to all values, for each value."""
    o = np.argsort(v, kind="stable")
    s, n = v[o], len(v)
    below = np.cumsum(s) - s
    out = np.empty(n)
    out[o] = (2 * np.arange(n) - n) * s + s.sum() - 2 * below
    return out


def _distance_products(u: np.ndarray, v: np.ndarray) -> float:
    """Sum of |u_i - u_j| |v_i - v_j| over all ordered pairs.

    With u in order a pair i < j has the product |(u_j - u_i)(v_j - v_i)|, of positive sign inside
    where v_i < v_j; the pairs of that kind are summed as in a merge sort from below, one width
    of runs at a time.
    """
    o = np.lexsort((v, u))
    u, v = u[o], v[o]
    n = len(u)
    # pairs with v_i >= v_j have a product <= 0, so |.| sums to 2 * (sum over v_i < v_j) - (sum over all)
    every = n * (u @ v) - u.sum() * v.sum()
    rank = np.unique(v, return_inverse=True)[1]
    at, rising, width = np.arange(n), 0.0, 1
    while width < n:
        block, right = at // (2 * width), at // width % 2 == 1
        # by block, then value; at equal values right halves first, so that only smaller ones lie before
        order = np.lexsort((~right, rank, block))
        b, r, x, y = block[order], right[order], u[order], v[order]
        start = np.searchsorted(b, b, side="left")
        left = ~r

        def before(w):
            c = np.concatenate(([0.0], np.cumsum(np.where(left, w, 0.0))))
            return c[:-1] - c[start]

        k, sx, sy, sxy = before(np.ones(n)), before(x), before(y), before(x * y)
        rising += float(np.where(r, k * x * y - x * sy - y * sx + sxy, 0.0).sum())
        width *= 2
    return 2 * (2 * rising - every)


def distance_correlation(df: DataFrame, by: list[str], x: str, y: str, by_ddl: str, shuffles: int = 0) -> DataFrame:
    """Distance correlation of each group, and with shuffles its permutation p-value, in
    O(n log n) time and O(n) memory for a group of n rows: no distance matrix is made."""

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values([x, y], kind="stable")
        u, v = f[x].to_numpy(float), f[y].to_numpy(float)
        # distances do not change with the origin; values near 0 lose least in the sums
        u, v = u - u.mean(), v - v.mean()
        du, dv = _distance_sums(u), _distance_sums(v)

        def dcov(p, q, dp, dq, products):
            n = len(p)
            return products / n**2 - 2 * (dp @ dq) / n**3 + dp.sum() * dq.sum() / n**4

        vx, vy = (dcov(w, w, d, d, 2 * len(w) * (w @ w) - 2 * w.sum() ** 2) for w, d in ((u, du), (v, dv)))

        def dcor(o):
            if not (np.ptp(u) > 0 and np.ptp(v) > 0):
                return np.nan
            return float(np.sqrt(max(0.0, dcov(u, v[o], du, dv[o], _distance_products(u, v[o]))) / np.sqrt(vx * vy)))

        r = dcor(np.arange(len(f)))
        rng, greater = np.random.default_rng(0), 0
        for _ in range(shuffles):
            greater += dcor(rng.permutation(len(f))) > r
        return pd.DataFrame([{k: f[k].iloc[0] for k in by} | {"dcor": r, "p": greater / shuffles if shuffles else np.nan}])

    return df.select(*by, x, y).groupBy(*by).applyInPandas(fit, f"{by_ddl}, dcor double, p double")

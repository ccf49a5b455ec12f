"""Multinomial intensity model of a cell: observations, fit, prediction.

A spectrum's ions share its signal by a softmax with a baseline category.  The fit is
Newton's method on the penalised likelihood (a ridge of 1), which needs every row in each
step: :func:`fit_cells` fits many cells side by side, a task each; :func:`fit_large` fits one
cell of any size by summing each step's gradient and Hessian (width x width numbers) over
partitions in a tree.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import dealt, discard, materialize

EPSILON, MOST_STEPS = 1e-8, 25
#: Rows (or sets of features) of which dense features are in memory at a time.
BLOCK_ROWS = 20_000


def observations(matches: DataFrame, totals: DataFrame, scan: list[str], peak: list[str], intensity: str, series: str, total: str = "total", unassigned: str = "unassigned", oxonium: str = "oxonium_ion", only: list[str] | None = None) -> DataFrame:
    """The rows of matches (one for each peak and fragment) without oxonium ions, and a row for
    each scan's unassigned signal.  A peak that several fragments explain counts once; the
    total is raised where matches exceed it.  only keeps some series (and always the
    unassigned row) and lowers the total by what goes.
    """
    once = matches.select(*scan, *peak, intensity).distinct().groupBy(*scan).agg(F.sum(intensity).alias("_matched"))
    dropped = matches.where(F.col(series) != oxonium)
    sums = totals.join(once, scan, "left").withColumn("_matched", F.coalesce("_matched", F.lit(0.0)))
    if only is not None:
        gone = dropped.where(~F.col(series).isin(*only)).groupBy(*scan).agg(F.sum(intensity).alias("_gone"))
        sums = sums.join(gone, scan, "left")
        dropped = dropped.where(F.col(series).isin(*only))
    gone = F.coalesce("_gone", F.lit(0.0)) if only is not None else F.lit(0.0)
    sums = sums.withColumn(total, F.greatest(F.col(total), F.col("_matched")) - gone).withColumn("_rest", F.greatest(F.col(total) + gone - F.col("_matched"), F.lit(0.0)))
    rows = dropped.join(sums.select(*scan, total), scan)
    # one row a scan: dealt by scan as matches are, so that what is written by scan has few files
    rest = dealt(sums.select(*scan, F.lit(unassigned).alias(series), F.col("_rest").alias(intensity), total), *scan)
    return rows.unionByName(rest, allowMissingColumns=True)


def part_observations(matches: DataFrame, totals: DataFrame, scan: list[str], peak: list[str], intensity: str, series: str, parts: dict[str, list[str]], total: str = "total", unassigned: str = "unassigned", oxonium: str = "oxonium_ion") -> DataFrame:
    """What observations gives for the series of each part (only), in one pass for all parts, which have
    no series in common: its rows with the part's name in column part."""
    once = matches.select(*scan, *peak, intensity).distinct().groupBy(*scan).agg(F.sum(intensity).alias("_matched"))
    own = F.coalesce(*(F.when(F.col(series).isin(*only), F.lit(p)) for p, only in parts.items()))
    dropped = matches.where(F.col(series) != oxonium)
    gone = dropped.groupBy(*scan).agg(*(F.sum(F.when(~F.col(series).isin(*only), F.col(intensity))).alias(f"_gone_{p}") for p, only in parts.items()))
    sums = totals.join(once, scan, "left").join(gone, scan, "left").withColumn("_matched", F.coalesce("_matched", F.lit(0.0)))
    whole = F.greatest(total, "_matched")
    sums = sums.select(*scan, F.greatest(whole - F.col("_matched"), F.lit(0.0)).alias("_rest"), *((whole - F.coalesce(f"_gone_{p}", F.lit(0.0))).alias(f"_total_{p}") for p in parts))
    named = [(F.lit(p), F.col(f"_total_{p}")) for p in parts]
    rows = dropped.withColumn("part", own).where("part is not null").join(sums.drop("_rest"), scan)
    rows = rows.withColumn(total, F.coalesce(*(F.when(F.col("part") == n, t) for n, t in named))).drop(*(f"_total_{p}" for p in parts))
    each = F.explode(F.array(*(F.struct(n.alias("part"), t.alias(total)) for n, t in named)))
    rest = dealt(sums.select(*scan, F.lit(unassigned).alias(series), F.col("_rest").alias(intensity), each.alias("_e")), *scan).select(*scan, series, intensity, "_e.*")
    return rows.unionByName(rest, allowMissingColumns=True)


def predict(rows: DataFrame, scan: list[str], indices: str, coef: str, out: str = "yhat") -> DataFrame:
    """exp(x b) / (1 + sum exp(x b)) over a scan's rows; indices are the features that a row sets."""
    eta = F.aggregate(indices, F.lit(0.0), lambda s, i: s + F.coalesce(F.get(coef, i), F.lit(0.0)))
    return softmax(rows.withColumn("_eta", eta), scan, "_eta", out).drop("_eta")


def softmax(rows: DataFrame, scan: list[str], eta: str, out: str = "yhat") -> DataFrame:
    """The same from the linear predictor; the largest exponent is taken out first."""
    w = Window.partitionBy(*scan)
    top = F.greatest(F.max(eta).over(w), F.lit(0.0))
    e = F.exp(F.col(eta) - top)
    return rows.withColumn(out, F.try_divide(e, F.exp(-top) + F.sum(e).over(w)))


def goodness_of_fit(rows: DataFrame, scan: list[str], share: str, yhat: str) -> DataFrame:
    """G statistic of a scan on the scale of percent, with the remainder to 100."""
    p, q = F.col(share) * 100, F.col(yhat) * 100
    rest = 100 - F.sum(p)
    term = F.sum(F.when(p > 0, p * (F.ln(p) - F.ln(q))).otherwise(0.0))
    tail = F.when(rest > 1e-9, rest * (F.ln(rest) - F.ln(100 - F.sum(q) + 1e-6))).otherwise(0.0)
    return rows.groupBy(*scan).agg((term + tail).alias("g"))


def _dense(indices, width: int) -> np.ndarray:
    x = np.zeros((len(indices), width))
    for i, own in enumerate(indices):
        for j in own:
            x[i, j] += 1.0
    return x


@dataclass
class Spectra:
    """The rows of many spectra, one spectrum after another: the features that a row sets (flat,
    with ends), where spectra start, shares, reliabilities, and each spectrum's total."""

    flat: np.ndarray
    ends: np.ndarray
    starts: np.ndarray
    y: np.ndarray
    r: np.ndarray
    n: np.ndarray

    def __len__(self) -> int:
        return len(self.n)

    @cached_property
    def patterns(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different sets of features that rows set: the features of all sets (flat), the set of
        each of those, and each row's set.  Encoders give few sets, however many rows there are."""
        begin = np.append(0, self.ends[:-1])
        size = self.ends - begin
        # sets are told apart by sums of a random number for each feature, and the outcome is checked
        numbers = np.random.default_rng(0).integers(0, 2**63, int(self.flat.max(initial=0)) + 1, dtype=np.uint64)
        sums = np.append(np.uint64(0), np.cumsum(numbers[self.flat]))
        _, first, own = np.unique(sums[self.ends] - sums[begin], return_index=True, return_inverse=True)
        like = np.repeat(begin[first][own] - begin, size) + np.arange(len(self.flat)) if (size == size[first][own]).all() else None
        if like is None or (self.flat != self.flat[like]).any():
            first = own = np.arange(len(self.ends))
        sizes = size[first]
        places = np.arange(sizes.sum()) + np.repeat(begin[first] - np.cumsum(sizes) + sizes, sizes)
        return self.flat[places], np.repeat(np.arange(len(first)), sizes), own

    def blocks(self):
        """(first and last spectrum, first and last row) of some whole spectra at a time."""
        bounds = np.append(self.starts, len(self.y))
        at = 0
        while at < len(self.n):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + BLOCK_ROWS, "right")) - 1)
            yield at, to, int(bounds[at]), int(bounds[to])
            at = to


def _step(spectra: Spectra, beta, width: int):
    """Sums over spectra: z and H of a step from beta (None: from the start), and the deviance there.

    Rows of one set of features have the same x, so what is a sum over rows of x is taken over sets;
    of a spectrum's mean x only the features that its rows set are added up.
    """
    if not len(spectra):
        return np.zeros(width), np.zeros((width, width)), 0.0
    features, of, own = spectra.patterns
    n_sets, y, r, starts, n = int(own.max()) + 1, spectra.y, spectra.r, spectra.starts, spectra.n
    size = np.diff(np.append(starts, len(y)))
    per_row = lambda v: np.repeat(v, size)
    add = lambda v: np.add.reduceat(v, starts)
    total = per_row(n)
    if beta is None:
        mu = (y * total + 0.5) / per_row(1 + n + 0.5 * size)
        eta = np.log(mu) - per_row(np.log1p(-add(mu)))
    else:
        eta = np.bincount(of, np.asarray(beta, float)[features], n_sets)[own]
        top = np.maximum(np.maximum.reduceat(eta, starts), 0.0)
        e = np.exp(eta - per_row(top))
        mu = e / per_row(np.exp(-top) + add(e))
    weighted_eta = r * mu * eta - mu * per_row(add(mu * eta))
    z = np.bincount(features, np.bincount(own, total * (y - mu + weighted_eta), n_sets)[of], width)
    h = np.zeros((width, width))
    weight = np.bincount(own, total * r * mu, n_sets)
    for at in range(0, n_sets, BLOCK_ROWS):
        lo, hi = np.searchsorted(of, (at, at + BLOCK_ROWS))
        sets = min(BLOCK_ROWS, n_sets - at)
        x = np.bincount((of[lo:hi] - at) * width + features[lo:hi], minlength=sets * width).reshape(sets, width)
        h += x.T @ (weight[at : at + sets, None] * x)
    ends = np.append(0, spectra.ends)
    for at, to, lo, hi in spectra.blocks():
        sizes = np.diff(ends[lo : hi + 1])
        place = np.repeat(np.repeat(np.arange(to - at) * width, size[at:to]), sizes) + spectra.flat[ends[lo] : ends[hi]]
        mean = np.bincount(place, np.repeat(mu[lo:hi], sizes), (to - at) * width).reshape(to - at, width)
        h -= mean.T @ (n[at:to, None] * mean)
    pos = y > 0
    dev = 2 * float((total[pos] * r[pos] * y[pos] * np.log(y[pos] / mu[pos])).sum())
    rest, left = 1 - add(y), 1 - add(mu) + 1e-6
    some = rest > 1e-12
    return z, h, dev + 2 * float((n[some] * rest[some] * np.log(rest[some] / left[some])).sum())


def newton(sums, steps: int = MOST_STEPS, epsilon: float = EPSILON) -> dict:
    """sums(beta) gives z, H and the deviance at beta (None: at the start).

    Without a finite deviance or with a singular system the result has no coefficients.
    converged tells whether the deviance settled within the steps.
    """
    beta, last, h, i, done = None, None, None, 0, False
    dev = np.nan
    for i in range(steps + 1):
        z, s, dev = sums(beta)
        if not np.isfinite(dev):
            return {"coef": None, "covariance": None, "deviance": float(dev), "iterations": i}
        done = last is not None and abs((dev - last) / (last or 1.0)) < epsilon
        if done or i == steps:
            break
        last = dev
        h = s + np.eye(len(z))
        try:
            lower = np.linalg.cholesky(h)
        except np.linalg.LinAlgError:
            return {"coef": None, "covariance": None, "deviance": float(dev), "iterations": i}
        beta = np.linalg.solve(lower.T, np.linalg.solve(lower, z))
        if not np.isfinite(beta).all():
            return {"coef": None, "covariance": None, "deviance": float(dev), "iterations": i}
    return {"coef": beta, "covariance": np.linalg.inv(h) if h is not None else None, "deviance": float(dev), "iterations": i, "converged": done}


def _spectra(frame: pd.DataFrame, scan: list[str]) -> Spectra:
    """The spectra with a positive total, in the order of their keys."""
    f = frame[frame["total"] > 0].sort_values(scan, kind="stable")
    keys = f[scan]
    new = (keys != keys.shift()).any(axis=1).to_numpy()
    starts = np.flatnonzero(new)
    lengths = f["idx"].map(len).to_numpy(np.int64)
    flat = np.concatenate([np.asarray(i, np.int64) for i in f["idx"]]) if len(f) else np.empty(0, np.int64)
    total = f["total"].to_numpy(float)
    return Spectra(flat, np.cumsum(lengths), starts, f["intensity"].to_numpy(float) / total, f["reliability"].to_numpy(float), total[starts])


FIT = "n_spectra long, n_rows long, coef array<double>, covariance array<double>, deviance double, dispersion double, iterations int, converged boolean"


def fit_cells(rows: DataFrame, cell: list[str], scan: list[str], width: int, cell_ddl: str) -> DataFrame:
    """One fit for each cell of rows (cell, scan, idx, intensity, total, reliability).

    A weighted fit that fails is tried once more without reliabilities; a cell for which that
    fails too has null coefficients and is not dropped.
    """

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        spectra = _spectra(frame, scan)
        got = newton(lambda b: _step(spectra, b, width)) if len(spectra) else {"coef": None, "covariance": None, "deviance": np.nan, "iterations": 0}
        if got["coef"] is None and len(spectra):
            plain = replace(spectra, r=np.ones_like(spectra.r))
            got = newton(lambda b: _step(plain, b, width))
        ok = got["coef"] is not None
        row = {c: frame[c].iloc[0] for c in cell} | {
            "n_spectra": len(spectra), "n_rows": len(frame), "coef": got["coef"].tolist() if ok else None, "covariance": got["covariance"].ravel().tolist() if ok else None,
            "deviance": got["deviance"], "dispersion": got["deviance"] / max(1, len(frame)), "iterations": got["iterations"], "converged": bool(got.get("converged")),
        }
        return pd.DataFrame([row])

    return rows.select(*cell, *scan, "idx", "intensity", "total", "reliability").groupBy(*cell).applyInPandas(fit, f"{cell_ddl}, {FIT}")


def fit_large(rows: DataFrame, scan: list[str], width: int, parts: int = 64) -> dict:
    """The same fit for one cell of any size.  rows are dealt by scan once (a written table
    keeps that between steps); each step sends the driver parts partial sums of width * (width + 1) + 1
    numbers.  parts is the number of pieces in which the rows fit workers' memory."""
    n = parts
    w = Window.partitionBy(*scan)
    dealt = materialize(rows.withColumn("_part", F.pmod(F.xxhash64(*scan), F.lit(n))).withColumn("total", F.max("total").over(w)), "glm-rows")

    def sums(beta):
        def part(f: pd.DataFrame) -> pd.DataFrame:
            z, h, dev = _step(_spectra(f, scan), beta, width)
            return pd.DataFrame({"s": [[*z, *h.ravel(), dev]]})

        added = dealt.groupBy("_part").applyInPandas(part, "s array<double>")
        total = np.sum([np.array(r.s) for r in added.collect()], axis=0)
        return total[:width], total[width:-1].reshape(width, width), float(total[-1])

    return newton(sums)


def intervals(fits: DataFrame, width: int) -> DataFrame:
    """(position, coef, se, z) of each coefficient of each fit: the Wald table."""
    e = fits.where("coef is not null").select("*", F.posexplode("coef").alias("position", "beta"))
    se = F.sqrt(F.get("covariance", F.col("position") * (width + 1)))
    return e.withColumn("se", se).withColumn("z", F.try_divide(F.col("beta"), F.col("se"))).drop("coef", "covariance")


#: Spectra whose observed and predicted shares correlate less are fitted again as mismatches.
MISMATCH = 0.5


def named_intervals(fits: DataFrame, names: list[str]) -> DataFrame:
    """The Wald table with each coefficient's name and its two-sided p-value."""
    from ..functions.scalar import erf

    label = F.get(F.array(*map(F.lit, names)), F.col("position"))
    return intervals(fits, len(names)).withColumns({"name": label, "p_value": 1 - erf(F.abs(F.col("z")) / 2**0.5)})


#: Most coefficients of all fits that are broadcast (64 MB of doubles): those of the cells of a grid.
BROADCAST_COEFFICIENTS = 8_000_000


def with_fits(rows: DataFrame, known: DataFrame, cell: list[str], scan: list[str]) -> DataFrame:
    """Rows with the coefficients (and what else known has) of their cell.

    Cells are few and one may hold a third of all rows, so rows are not dealt by cell: their fits are
    broadcast, or, if they are too many, rows are dealt by spectrum again before windows over spectra.
    """
    numbers = known.agg(F.sum(F.size("coef"))).first()[0] or 0
    if numbers <= BROADCAST_COEFFICIENTS:
        return rows.join(F.broadcast(known), cell)
    return dealt(rows.join(known, cell), *scan)


def correlations(rows: DataFrame, fits: DataFrame, cell: list[str], scan: list[str]) -> DataFrame:
    """(cell, scan, r) of observed and predicted shares under the cell's fit."""
    from ..functions import stats

    known = fits.where("coef is not null").select(*cell, "coef")
    p = predict(with_fits(rows, known, cell, scan), [*cell, *scan], "idx", "coef").withColumn("share", F.try_divide("intensity", "total"))
    return p.groupBy(*cell, *scan).agg(stats.correlation("share", "yhat").alias("r"))


def fit_with_mismatch(rows: DataFrame, cell: list[str], scan: list[str], width: int) -> DataFrame:
    """Two fits for each cell: of all its spectra (mismatch false), and of those that the first
    does not describe (mismatch true), where there are any.  Fits that fail are left out."""
    from .partitioned import fit_grouped

    first = fit_grouped(rows, cell, scan, width)
    r = correlations(rows, first, cell, scan)
    # the second fit reads its rows more than once: what chooses them is written
    bad = materialize(r.where((F.col("r") < MISMATCH) & ~F.isnan("r")).select(*cell, *scan), "mismatches")
    second = fit_grouped(rows.join(bad, [*cell, *scan], "left_semi"), cell, scan, width)
    discard(bad)
    both = first.withColumn("mismatch", F.lit(False)).unionByName(second.withColumn("mismatch", F.lit(True)))
    return both.where("coef is not null")


def scored_by_models(rows: DataFrame, models: DataFrame, cell: list[str], scan: list[str], routes: DataFrame | None = None) -> DataFrame:
    """Rows with the prediction (yhat) and partition_key of the model that scores them, and their share
    of the total.

    routes has each cell and, as to_<column>, the cell whose model scores it (cells.nearest_route): rows
    then have that cell, and all are scored.  Without it rows are routed already, and those of cells
    without a model are left out, as nothing scores them.
    """
    if routes is not None:
        # cells are those of a grid, so a table of them is small
        to = F.broadcast(routes.withColumnsRenamed({c: f"_of_{c}" for c in cell}))
        own = rows.join(to, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in cell])
        rows = own.drop(*cell, *(f"_of_{c}" for c in cell)).withColumnsRenamed({f"to_{c}": c for c in cell})
    known = models.select(*cell, "coef", "partition_key")
    return predict(with_fits(rows, known, cell, scan), scan, "idx", "coef").withColumn("share", F.try_divide("intensity", "total"))

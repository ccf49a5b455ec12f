"""Queries of encoders, the intensity model, scores, selectors and sources."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import chem, encode, stats
from ..operators import glm, partitioned, score, select
from . import views
from .registry import query
from .views import IONS, table

L = "bigint"


def _r(c, n=6):
    return F.round(c, n)


def _fragments(spark, d):
    li = table(spark, d, "lineitem")
    comp = F.array(*(F.when(F.col("l_partkey") % 8 == k, F.lit(k + 1)).otherwise(F.lit(k % 2)) for k in range(8)))
    series = F.expr("case l_returnflag when 'A' then 0 when 'N' then 1 else case when l_linestatus = 'F' and l_quantity > 45 then 3 else 2 end end")
    backbone = series < 2
    return li.select(
        F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("pk"), F.col("l_extendedprice").alias("intensity"), series.alias("series"),
        F.when(backbone, (F.col("l_partkey") % 8).cast("int")).alias("n"), F.when(backbone, (F.col("l_orderkey") % 8).cast("int")).alias("c"), F.col("l_linenumber").cast("int").alias("charge"),
        (F.col("l_quantity").cast("int") % 17).alias("glyc"), (F.col("l_quantity").cast("int") % 9).alias("fuc"), (F.col("l_partkey") % 8).cast("int").alias("labile"), (F.col("l_partkey") % 40).cast("int").alias("loss"), F.greatest((F.col("l_partkey") % 40 - F.col("l_partkey") % 8).cast("int"), F.lit(0)).alias("loss_internal"),
        comp.alias("comp"), F.array((F.col("l_suppkey") % 8).cast("int"), (F.col("l_suppkey") % 7).cast("int")).alias("near_n"), F.array((F.col("l_orderkey") % 7).cast("int"), (F.col("l_orderkey") % 5).cast("int")).alias("near_c"),
        (F.col("l_partkey") % 13).cast("int").alias("dist"),
    )


_FRAGMENTS = """f as (select l_orderkey as ok, l_linenumber as ln, l_partkey as pk, l_extendedprice as intensity, case l_returnflag when 'A' then 0 when 'N' then 1 else case when l_linestatus = 'F' and l_quantity > 45 then 3 else 2 end end as series,
 l_partkey % 8 as n, l_orderkey % 8 as c, least(l_linenumber, 5) - 1 as z, cast(l_quantity as int) % 17 as glyc, cast(l_quantity as int) % 9 as fuc, l_partkey % 8 as labile, l_partkey % 40 as loss, l_partkey % 8 as pc,
 l_suppkey % 8 as n1, l_suppkey % 7 as n2, l_orderkey % 7 as c1, l_orderkey % 5 as c2, l_partkey % 13 as dist from lineitem)"""

# SQL of each block's indices, relative to the block
_BLOCK_SQL = {
    "base": (43, ["case when series < 2 then n end", "case when series < 2 then 8 + c end", "case when series < 3 then 16 + series end", "case when series = 3 then 19 end", "case when series < 2 then 20 + z end", "case when series < 3 then 25 + series * 5 + z end", "case when series < 2 then 40 + least(glyc, 2) end"]),
    "proline": (10, ["case when series < 2 and c = 0 then z end", "case when series < 2 and c = 0 then 5 + series end", "case when series < 2 and c = 0 then 7 + least(glyc, 2) end"]),
    "composition": (23, ["case when series = 2 then least(glyc, 14) end", *(f"case when series = 2 and {n} <= case when pc = {k} then {k + 1} else {k % 2} end then {15 + k} end" for k in range(8) for n in range(1, k + 2))]),
    "fucose": (35, ["case when series = 2 then z * 7 + least(fuc, 6) end"]),
    "neighbours": (32, ["case when series < 2 then n1 end", "case when series < 2 then 8 + n2 end", "case when series < 2 then 16 + c1 end", "case when series < 2 then 24 + c2 end"]),
    "distance": (22, ["case when series < 2 then series * 11 + least(dist, 10) end"]),
    "loss": (145, ["case when series = 2 then z * 29 + least(loss, 28) end"]),
    "loss_internal": (145, ["case when series = 2 then z * 29 + least(greatest(loss - labile, 0), 28) end"]),
    "labile": (35, ["case when series = 2 then z * 7 + least(labile, 6) end"]),
    "cross": (128, ["case when series < 2 then c + 8 * n + 64 * series end"]),
}


def _encode_query(name: str, model: str, parts: list[str]):
    offset, terms = 0, []
    for p in parts:
        width, own = _BLOCK_SQL[p]
        terms += [f"{offset} + ({t})" for t in own]
        offset += width
    listed = f"list_sort(list_filter([{', '.join(terms)}], lambda x: x is not null))"
    sql = f"with {_FRAGMENTS} select ok, ln, pk, array_to_string({listed}, ',') as idx from f"

    @query(name, sql)
    def run(spark, d):
        return _fragments(spark, d).select("ok", "ln", "pk", F.array_join(encode.encode_model(model).cast("array<string>"), ",").alias("idx"))

    return run


_COMP = ["base", "proline", "composition"]
_NEAR = [*_COMP, "fucose", "neighbours"]
for _name, _model, _parts in (
    ("e_encode_base", "FragmentType", ["base"]), ("e_encode_proline", "ProlineSpecializingModel", ["base", "proline"]), ("e_encode_stub", "StubGlycopeptideCompositionModel", _COMP),
    ("e_encode_fucose", "StubGlycopeptideFucosylationModel", [*_COMP, "fucose"]), ("e_encode_neighbors", "NeighboringAminoAcidsModelDepth2", _NEAR), ("e_encode_distance", "CleavageSiteCenterDistanceModel", [*_NEAR, "distance"]),
    ("e_encode_charge_approximate", "StubChargeModelApproximate", [*_NEAR, "loss_internal"]), ("e_encode_labile_approximate", "LabileMonosaccharideAwareModelApproximate", [*_NEAR, "loss_internal", "labile"]),
    ("e_encode_charge", "StubChargeModel", [*_NEAR, "loss"]), ("e_encode_labile", "LabileMonosaccharideAwareModel", [*_NEAR, "loss", "labile"]), ("e_encode_cross", "AmideBondCrossproductModel", [*_COMP, "cross"]),
):
    _encode_query(_name, _model, _parts)


@query("g_softmax_predict", f"with {IONS} select scan, ln, sk, round(yhat, 6) as yhat from ions")
def g_softmax_predict(spark, d):
    return views.ions(spark, d).select("scan", "ln", "sk", _r("yhat").alias("yhat"))


@query("g_pearson_resid", f"with {IONS} select scan, round(sum(power(share - yhat, 2) * case when share > yhat then 0.5 else 1 end / (yhat * (1 - yhat) * reliability)), 5) as resid from ions group by 1")
def g_pearson_resid(spark, d):
    return views.ions(spark, d).groupBy("scan").agg(_r(F.sum(stats.pearson_residual("share", "yhat", "reliability")), 5).alias("resid"))


@query("g_deviance", f"with {IONS} select sk, round(sum(case when share > 0 then 2 * total * share * (ln(share) - ln(yhat)) else 0 end), 2) as dev from ions group by 1")
def g_deviance(spark, d):
    return views.ions(spark, d).groupBy("sk").agg(_r(F.sum(stats.deviance_term("share", "yhat", "total")), 2).alias("dev"))


@query("g_gof", f"""with {IONS}, s as (select scan, sum(share * 100 * (ln(share * 100) - ln(yhat * 100))) as t, 100 - sum(share) * 100 as rest, sum(yhat) * 100 as q from ions group by 1)
select scan, round(t + rest * (ln(rest) - ln(100 - q + 1e-6)), 4) as g from s""")
def g_gof(spark, d):
    return glm.goodness_of_fit(views.ions(spark, d), ["scan"], "share", "yhat").select("scan", _r("g", 4).alias("g"))


def model_rows(spark, d, model: str = "FragmentType"):
    """Encoded rows of all spectra by cell (priority of the order)."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("cell"))
    total = F.sum("intensity").over(Window.partitionBy("ok")) * 1.25
    f = _fragments(spark, d).withColumn("idx", encode.encode_model(model)).withColumn("total", total).withColumn("reliability", F.lit(1.0))
    return f.join(o, f["ok"] == o["o_orderkey"]).select("cell", F.col("ok").alias("scan"), "idx", "intensity", "total", "reliability")


@query("g_multinomial_fit")
def g_multinomial_fit(spark, d):
    """A fit for each cell (order priority); the largest gradient of the penalised likelihood tells how exact it is."""
    width = encode.width("FragmentType")
    fits = partitioned.fit_grouped(model_rows(spark, d), ["cell"], ["scan"], width)
    return fits.select("cell", "n_spectra", "n_rows", "converged", "iterations", _r("deviance", 2).alias("deviance"), _r(F.aggregate("coef", F.lit(0.0), lambda s, x: s + x), 4).alias("coef_sum"))


@query("g_wald_intervals")
def g_wald_intervals(spark, d):
    width = encode.width("FragmentType")
    fits = partitioned.fit_grouped(model_rows(spark, d), ["cell"], ["scan"], width)
    return glm.intervals(fits, width).select("cell", "position", _r("beta", 4).alias("beta"), _r("se", 4).alias("se"), _r("z", 3).alias("z"))


_SCORED = IONS + """, c as (select scan, max(0.2 + 0.1 * ln) as cov from ions group by 1), b as (select i.*, cov from ions i join c using (scan)),
pep as (select scan, count(*) as n, coalesce((sum(share * yhat) - sum(share) * sum(yhat) / count(*)) / (sqrt(sum(share * share) - sum(share) * sum(share) / count(*) + 1e-12) * sqrt(sum(yhat * yhat) - sum(yhat) * sum(yhat) / count(*) + 1e-12)), -0.5) as corr,
 sum(log10(intensity) * (1 - power(abs(mass_error / 2e-5), 4)) * ((reliability - 0.5) / 0.5 + 1)) as t, sum((reliability - 0.5) / 0.5) as rel, max(cov) as cov from b where series in ('b', 'y') group by 1),
gly as (select scan, count(*) as n, case when count(*) > 1 then coalesce((sum(share * yhat) - sum(share) * sum(yhat) / count(*)) / (sqrt(sum(share * share) - sum(share) * sum(share) / count(*) + 1e-12) * sqrt(sum(yhat * yhat) - sum(yhat) * sum(yhat) / count(*) + 1e-12)), -0.5) else -0.5 end as corr,
 sum(log10(intensity) * (1 - power(abs(mass_error / 2e-5), 4))) as t, sum(reliability) as rel, count(*) filter (where size > 1) as big, max(cov) as cov from b where series = 'stub_glycopeptide' group by 1),
ps as (select scan, n, (t + (1 + corr) / 2 * 2 * log10(n) + rel) * cov as peptide_score from pep),
gs as (select scan, n, greatest((t + ((1 + corr) / 2 * big + rel * big) * least(exp(cov * 3) - 1, 1)) * cov, 0) as glycan_score from gly)"""


def _scored(spark, d):
    i = views.ions(spark, d).withColumn("cov", F.max(0.2 + 0.1 * F.col("ln")).over(Window.partitionBy("scan")))
    p = score.peptide_score(i, ["scan"], "cov")
    g = score.glycan_score(i, ["scan"], "cov", "cov")
    return p.join(g, "scan", "full_outer")


@query("s_peptide_score", f"with {_SCORED} select scan, n as backbone_count, round(peptide_score, 3) as peptide_score from ps")
def s_peptide_score(spark, d):
    return _scored(spark, d).where("backbone_count is not null").select("scan", "backbone_count", _r("peptide_score", 3).alias("peptide_score"))


@query("s_glycan_score", f"with {_SCORED} select scan, n as n_stub, round(glycan_score, 3) as glycan_score from gs")
def s_glycan_score(spark, d):
    return _scored(spark, d).where("n_stub is not null").select("scan", "n_stub", _r("glycan_score", 3).alias("glycan_score"))


@query("s_split_score", f"with {_SCORED} select scan, round(coalesce(peptide_score, 0) * 0.65 + coalesce(glycan_score, 0) * 0.35, 3) as score from ps full join gs using (scan)")
def s_split_score(spark, d):
    return _scored(spark, d).select("scan", _r(score.split_score("peptide_score", "glycan_score"), 3).alias("score"))


@query("s_score_set", f"""with {_SCORED} select scan, cast(round(coalesce(peptide_score, 0) * 0.65 + coalesce(glycan_score, 0) * 0.35, 2) as varchar) as glycopeptide_score, cast(coalesce(gs.n, 0) as int) as n_stub, cast(coalesce(ps.n, 0) as int) as backbone_count from ps full join gs using (scan)""")
def s_score_set(spark, d):
    s = _scored(spark, d).withColumn("glycopeptide_score", score.split_score("peptide_score", "glycan_score"))
    zero = {c: F.lit(0.0) for c in score.SCORE_SET if c not in s.columns}
    s = score.score_set(s.withColumns(zero).fillna(0, ["n_stub", "backbone_count"]), ["scan"])
    exact = _scored(spark, d).select("scan", _r(score.split_score("peptide_score", "glycan_score"), 2).cast("string").alias("glycopeptide_score"))
    return s.select("scan", "n_stub", "backbone_count").join(exact, "scan")


@query("s_residual_score", f"""with {IONS} select scan, round(sum(-log10(yhat + 1e-6) + log10(intensity) * ((reliability - 0.5) / 0.5 + 1)), 3) as residual_score from ions group by 1""")
def s_residual_score(spark, d):
    return score.residual_score(views.ions(spark, d), ["scan"], "yhat").select("scan", _r("residual_score", 3).alias("residual_score"))


@query("m_metrics", f"""with {IONS} select sk, round((sum(share * yhat) - sum(share) * sum(yhat) / count(*)) / (sqrt(sum(share * share) - sum(share) * sum(share) / count(*)) * sqrt(sum(yhat * yhat) - sum(yhat) * sum(yhat) / count(*))), 5) as total_correlation,
 round(acos(sum(share * yhat) / (sqrt(sum(share * share)) * sqrt(sum(yhat * yhat)))) * 2 / pi(), 5) as total_spectral_angle, round(avg(reliability) filter (where series in ('b', 'y')), 5) as peptide_reliability,
 count(*) filter (where series = 'stub_glycopeptide') as glycan_fragment_count from ions group by 1""")
def m_metrics(spark, d):
    m = score.metrics(views.ions(spark, d), ["sk"])
    return m.select("sk", _r("total_correlation", 5).alias("total_correlation"), _r("total_spectral_angle", 5).alias("total_spectral_angle"), _r("peptide_reliability", 5).alias("peptide_reliability"), "glycan_fragment_count")


@query("k_dominant_ratio", """with s as (select l_orderkey as scan, cast(l_quantity as int) as size, l_extendedprice as i from lineitem where l_returnflag = 'R'),
r as (select *, row_number() over (partition by scan order by i desc, size) as r, max(size) over (partition by scan) as total from s) select scan, round(size * 1.0 / total, 6) as ratio from r where r = 1""")
def k_dominant_ratio(spark, d):
    s = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("scan"), F.col("l_quantity").cast("int").alias("size"), F.col("l_extendedprice").alias("i"))
    return select.dominant_ratio(s, ["scan"], "size", "i", "size").select("scan", _r("ratio").alias("ratio"))


@query("k_kmeans_selector", """with recursive v as (select l_returnflag, l_quantity / 50 as v, count(*) as n from lineitem group by all),
c(l_returnflag, step, lo, hi) as (select distinct l_returnflag, 0, 0.1::double, 0.9::double from v union all
  select c.l_returnflag, step + 1, coalesce(sum(v * n) filter (where abs(v - lo) <= abs(v - hi)) / sum(n) filter (where abs(v - lo) <= abs(v - hi)), any_value(lo)),
    coalesce(sum(v * n) filter (where abs(v - lo) > abs(v - hi)) / sum(n) filter (where abs(v - lo) > abs(v - hi)), any_value(hi))
  from c join v on v.l_returnflag = c.l_returnflag where step < 50 group by c.l_returnflag, step)
select l_returnflag, round(lo, 6) as low, round(hi, 6) as high from c where step = 50""")
def k_kmeans_selector(spark, d):
    """Two centres for each cell from the seeds 0.1 and 0.9."""
    v = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_quantity") / 50).alias("v"))
    c = partitioned.kmeans_by_histogram(v, ["l_returnflag"], "v")
    return c.select("l_returnflag", _r(F.col("centres")[0]).alias("low"), _r(F.col("centres")[1]).alias("high"))


@query("k_model_default", """with r as (select l_orderkey, l_linenumber, l_partkey, l_returnflag as cell, l_linenumber % 4 as k from lineitem), m(cell, k) as (values ('A', 0), ('A', 1), ('N', 2), ('N', 3), ('R', 1))
select l_orderkey, l_linenumber, l_partkey, cast(coalesce(m.k, d.k) as bigint) as model from r left join m on m.cell = r.cell and m.k = r.k left join (select cell, min(k) as k from m group by 1) d on d.cell = r.cell""")
def k_model_default(spark, d):
    r = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("cell"), (F.col("l_linenumber") % 4).alias("k"))
    m = spark.createDataFrame([("A", 0), ("A", 1), ("N", 2), ("N", 3), ("R", 1)], "cell string, k int")
    return select.choose_model(r, m, ["cell"], "k").select("l_orderkey", "l_linenumber", "l_partkey", F.col("model").cast(L).alias("model"))


@query("t_svm_scores")
def t_svm_scores(spark, d):
    o = table(spark, d, "orders")
    f = o.select("o_orderkey", (F.col("o_totalprice") / 1e5).alias("a"), (F.col("o_custkey") % 13 / 13.0).alias("b"), F.when(F.col("o_totalprice") + F.col("o_custkey") % 7 * 1e4 > 2.5e5, 1).otherwise(0).alias("target"))
    return select.svm_scores(f, ["a", "b"], "target").groupBy("target").agg(F.count("*").alias("n"), F.count_if(F.col("svm") > 0).alias("above"))


_MASSES = "map {" + ", ".join(f"'{a}': {m!r}" for a, m in chem.RESIDUES.items()) + "}"


@query("x_mass_offsets", f"""with {views.RESIDUES}, r as (select p_partkey, unnest(seq) as aa, generate_subscripts(seq, 1) as i from residues)
select p_partkey, i, round(coalesce({_MASSES}[aa], 0)::double, 5) as mass from r""")
def x_mass_offsets(spark, d):
    """The mass of every residue of every part; letters that are no residue weigh nothing."""
    e = views.residues(spark, d).select("p_partkey", F.posexplode("seq").alias("i", "aa"))
    r = e.withColumn("r", F.struct("aa", F.array().cast("array<string>").alias("mods")))
    return r.select("p_partkey", (F.col("i") + 1).cast(L).alias("i"), _r(chem.residue_mass(F.col("r")), 5).alias("mass"))


@query("r_windowed_rates", """select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) filter (where value >= 100) as on_count, count(*) filter (where value < 100) as off_count from events group by all""")
def r_windowed_rates(spark, d):
    from ..streaming.scoring import windowed_rates

    return windowed_rates(table(spark, d, "events"), "ts", ["event_type"], F.col("value") >= 100)

"""Queries of estimators, tallies, cell tests, whole-match scores, training drivers and codecs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import chem, encode, scalar, stats
from ..operators import cells, estimators, glm, partitioned, relations, score, select
from ..sources import codecs, mgf
from . import views
from .models import _SCORED, model_rows
from .registry import query
from .statistics import _PAIRS, _SCANS, _pairs, _scan_rows
from .joins import _BUCKET, _case
from .views import IONS, PSMS, RESIDUES, table

L = "bigint"


def _r(c, n=6):
    return F.round(c, n)


@query("a_offset_frequency", f"""with {_SCANS} select series, round(sum(explained) / sum(sites), 6) as offset_frequency,
 round(sum(peaks - explained) * 1e6 / sum(mass / 0.02 - sites), 4) as unknown_e6 from scans group by 1""")
def a_offset_frequency(spark, d):
    s = _scan_rows(spark, d).withColumn("sparsity", F.col("mass") / 0.02)
    out = estimators.offset_frequency(s, ["series"], "explained", "sites")
    return out.select("series", _r("offset_frequency").alias("offset_frequency"), _r(F.col("unknown_peak_rate") * 1e6, 4).alias("unknown_e6"))


@query("a_prior_probability", """with s as (select p_partkey, 56 + (p_partkey * 7919 % 1000) / 1000.0 * (p_retailprice * 10 - 56) as mid from part)
select count(*) filter (where abs((l_extendedprice - mid) / mid) <= 0.05) as hits, (select count(*) from part) as structures from s join lineitem on l_partkey = p_partkey""")
def a_prior_probability(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_retailprice") * 10).alias("total"))
    f = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_extendedprice").alias("mass"))
    draw = F.col("k") * 7919 % 1000 / 1000
    return estimators.prior_probability(f, p, ["k"], "mass", "total", draw, 0.05).select("hits", "structures")


@query("a_relation_histograms", f"""{_PAIRS}, b as (select fc, tc, cast({_BUCKET} as bigint) as bucket from pairs where sa <> 'R')
select case grouping_id(fc, tc, bucket) when 1 then 'charges' when 6 then 'ratio' else 'both' end as kind, fc, tc, bucket, count(*) as n from b group by grouping sets ((fc, tc), (bucket), (fc, tc, bucket))""")
def a_relation_histograms(spark, d):
    pairs, _ = _pairs(spark, d)
    named = pairs.withColumns({"bucket": F.col("bucket").cast(L), "series": F.when(F.col("sa") == "R", estimators.NOISE).otherwise(F.col("sa"))})
    return estimators.relation_histograms(estimators.without_noise(named), "fc", "tc", "bucket")


@query("a_feature_partitions", f"""{_PAIRS} select sa as ion_type, fc, tc, cast({_BUCKET} as bigint) as bucket, count(*) as n from pairs group by all having count(*) >= 10""")
def a_feature_partitions(spark, d):
    pairs, _ = _pairs(spark, d)
    named = pairs.withColumns({"bucket": F.col("bucket").cast(L), "ion_type": F.col("sa")})
    return estimators.feature_partitions(named, ["ion_type", "fc", "tc", "bucket"])


@query("a_ion_type_posterior", """with t as (select l_suppkey as f, l_returnflag as ion_type, count(*) filter (where l_discount > 0.05) as m, count(*) as t from lineitem group by all),
w as (select *, m / greatest(t, 1) as a, (sum(m) over (partition by f) - m) / nullif(sum(t) over (partition by f) - t, 0) as b from t)
select f, ion_type, round(a, 6) as probability, round(a / nullif(a + b, 0), 6) as posterior from w""")
def a_ion_type_posterior(spark, d):
    t = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("f"), F.col("l_returnflag").alias("ion_type")).agg(F.count_if(F.col("l_discount") > 0.05).alias("matches"), F.count("*").alias("totals"))
    out = estimators.ion_type_posterior(t, ["f"])
    return out.select("f", "ion_type", _r("probability").alias("probability"), _r("posterior").alias("posterior"))


@query("f_rank_window", """select l_orderkey, l_linenumber, l_partkey from lineitem where l_quantity >= 10 and l_quantity <= 30 and (l_suppkey % 5 = 0 or l_suppkey % 5 = l_orderkey % 5)""")
def f_rank_window(spark, d):
    f = table(spark, d, "lineitem").withColumns({"asked": F.when(F.col("l_suppkey") % 5 != 0, F.col("l_suppkey") % 5), "own": F.col("l_orderkey") % 5})
    near = estimators.in_ranks("l_quantity", F.lit(10), F.lit(30)) & estimators.precursor_context("asked", F.lit(None).cast("int"), "own", "own")
    return f.where(near).select("l_orderkey", "l_linenumber", "l_partkey")


@query("f_series_restrict", """with m as (select l_orderkey as scan, l_linenumber as peak, l_extendedprice as i, case l_returnflag when 'A' then 'b' when 'N' then 'y' else 'stub_glycopeptide' end as series from lineitem),
o as (select scan, sum(i) as matched, sum(case when series = 'stub_glycopeptide' then i else 0 end) as gone from (select distinct scan, peak, i, series from m) group by 1)
select o_orderkey as scan, round(greatest(o_totalprice, coalesce(matched, 0)) - coalesce(gone, 0), 2) as total from orders left join o on o_orderkey = scan""")
def f_series_restrict(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("scan"), F.col("l_linenumber").alias("peak"), F.col("l_extendedprice").alias("i"), F.expr("case l_returnflag when 'A' then 'b' when 'N' then 'y' else 'stub_glycopeptide' end").alias("series")).count().drop("count")
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("scan"), F.col("o_totalprice").alias("total"))
    out = glm.observations(li, t, ["scan"], ["peak", "series"], "i", "series", only=["b", "y"])
    return out.where("series = 'unassigned'").select("scan", _r("total", 2).alias("total"))


@query("f_bind_release", """select cast(count(distinct (l_returnflag, l_linenumber, l_suppkey % 3)) as bigint) as bound, cast(count(distinct l_returnflag) as bigint) as free from lineitem""")
def f_bind_release(spark, d):
    li = table(spark, d, "lineitem")
    p = li.select(F.col("l_returnflag").alias("name"), F.col("l_linenumber").alias("from_charge"), (F.col("l_suppkey") % 3).cast("int").alias("to_charge"), F.lit(0).alias("intensity_ratio"))
    f = p.select("name").distinct().withColumns({c: F.lit(None).cast("int") for c in ("from_charge", "to_charge", "intensity_ratio")})
    bound = estimators.bind(f, p, ["name"])
    return bound.agg(F.count("*").alias("bound")).crossJoin(estimators.release(bound).agg(F.count("*").alias("free")))


@query("j_explained_by", "select l_suppkey, l_linenumber, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') as ion_types from lineitem group by all")
def j_explained_by(spark, d):
    e = estimators.explained_by(table(spark, d, "lineitem"), ["l_suppkey", "l_linenumber"], "l_returnflag")
    return e.select("l_suppkey", "l_linenumber", F.array_join("ion_types", ",").alias("ion_types"))


@query("j_reindex", """with m as (select o_orderkey as scan, o_totalprice / 3 as x from orders), p as (select l_orderkey as scan, l_linenumber as i, l_extendedprice as mass, l_partkey from lineitem),
j as (select m.scan, i, row_number() over (partition by m.scan order by abs(x - mass), mass, i) as r from m join p on m.scan = p.scan and abs((x - mass) / mass) <= 0.2)
select scan, any_value(i) filter (where r = 1) as peak_index from (select m.scan, j.i, j.r from m left join j using (scan)) group by 1""")
def j_reindex(spark, d):
    m = table(spark, d, "orders").select(F.col("o_orderkey").alias("scan"), F.lit(0).alias("match"), (F.col("o_totalprice") / 3).alias("x"))
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("scan"), F.col("l_linenumber").alias("peak_index"), F.col("l_extendedprice").alias("mass"))
    return estimators.reindexed(m, p, ["scan"], "match", "x", "mass", 0.2).select("scan", "peak_index")


def _celled(spark, d):
    p = views.psms(spark, d).withColumn("labile", F.col("sk") % 2)
    # a third of the PSMs each meet a cell of another mobility, charge or type
    other = lambda k, own, value: F.when(F.col("ok") % 3 == k, value).otherwise(F.col(own))
    named = {"mobility": other(0, "mobility", F.lit("partial")), "charge": other(1, "charge", F.lit(3)), "glycan_type": other(2, "glycan_type", F.lit(2))}
    p = cells.assign(p, nearest=True)
    return p.withColumns({f"cell_{k}": v for k, v in named.items()} | {"cell_glycan_count": F.lit(1)})


_NEAR = {v: [f"coalesce({_case(v, iv, i)}, (select e from (select {('lo', 'hi')[i]} as e, abs({v} - (lo + hi) / 2.0) as q, lo from (values {', '.join(map(str, iv))}) t(lo, hi)) order by q, lo limit 1))" for i in (0, 1)] for v, iv in (("length", cells.LENGTHS), ("size", cells.SIZES))}


@query("x_cell_member", f"""with {PSMS}, c as (select *, {_NEAR['length'][0]} as a, {_NEAR['length'][1]} as b, {_NEAR['size'][0]} as e, {_NEAR['size'][1]} as f from psms)
select ok, ln, sk, coalesce(length between a and b and size - sk % 2 between e and f and glycan_count = 1
  and (ok % 3 <> 0 or mobility = 'partial') and (ok % 3 <> 1 or charge = 3) and (ok % 3 <> 2 or glycan_type = 2), false) as holds from c""")
def x_cell_member(spark, d):
    return _celled(spark, d).select("ok", "ln", "sk", cells.holds("size", "labile").alias("holds"))


_MEMBERS = f"""with {PSMS}, a as (select *, {_case('length', cells.LENGTHS, 0)} as length_lo, {_case('size', cells.SIZES, 0)} as size_lo,
 {_case('length', cells.LENGTHS, 0)} is not null and {_case('size', cells.SIZES, 0)} is not null and charge between 2 and 6 and glycan_type between 1 and 3 and glycan_count between 1 and 2 as fits from psms)"""


@query("j_cell_members", f"{_MEMBERS} select length_lo, size_lo, charge, mobility, glycan_type, glycan_count, count(*) as members from a where fits group by all")
def j_cell_members(spark, d):
    fits, _ = cells.partition(views.psms(spark, d), cells.grid(spark))
    return cells.members(fits, ["length_lo", "size_lo", "charge", "mobility", "glycan_type", "glycan_count"])


@query("j_cell_rejects", f"{_MEMBERS} select ok, ln, sk from a where not fits")
def j_cell_rejects(spark, d):
    _, rest = cells.partition(views.psms(spark, d), cells.grid(spark))
    return rest.select("ok", "ln", "sk")


@query("a_structure_groups", "select o_orderkey, count(*) over (partition by o_custkey) as group_size, row_number() over (partition by o_custkey order by o_orderkey) as place from orders")
def a_structure_groups(spark, d):
    return select.structure_groups(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey").select("o_orderkey", F.col("group_size").cast(L).alias("group_size"), F.col("place").cast(L).alias("place"))


@query("c_train_test", "select o_orderkey, o_orderkey % 3 = 1 as test from orders")
def c_train_test(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 3).alias("fold"))
    train, test = select.train_test(o, 1)
    return train.select("o_orderkey", F.lit(False).alias("test")).unionByName(test.select("o_orderkey", F.lit(True).alias("test")))


@query("k_peptide_y", f"""with {IONS}, s as (select scan, size, ln, intensity, row_number() over (partition by scan order by intensity desc, size) as r from ions where series = 'stub_glycopeptide')
select scan, count(s.size) as n, round(coalesce(max(case when r = 1 then s.size / 10.0 end), 0), 6) as ratio from (select distinct scan from ions) left join s using (scan) group by 1""")
def k_peptide_y(spark, d):
    i = views.ions(spark, d).withColumn("whole", F.lit(10))
    out = select.peptide_y(i, ["scan"], "size", "ln", "intensity", "whole")
    return out.select("scan", F.size("sizes").cast(L).alias("n"), _r(F.col("ratio").cast("double")).alias("ratio"))


@query("m_predicted_points", f"with {IONS} select scan, ln, sk, round(yhat * (sum(yhat * intensity) over (partition by scan) / sum(yhat * yhat) over (partition by scan)), 3) as predicted from ions")
def m_predicted_points(spark, d):
    i = views.ions(spark, d).withColumn("mz", F.struct("ln", "sk"))
    return score.predicted_points(i, ["scan"], "mz").select("scan", "mz.ln", "mz.sk", _r("predicted", 3).alias("predicted"))


@query("f_series_filter", f"with {IONS} select scan, count(*) as n, round(sum(yhat), 6) as yhat from ions where series in ('b', 'y') group by 1")
def f_series_filter(spark, d):
    return score.of_series(views.ions(spark, d), "b", "y").groupBy("scan").agg(F.count("*").alias("n"), _r(F.sum("yhat")).alias("yhat"))


def _cdf_ions(spark, d):
    return views.ions(spark, d).withColumns({"cdf": F.col("yhat"), "cov": 0.2 + 0.1 * F.col("size")})


def _corr_sql(x: str, y: str) -> str:
    return f"coalesce((sum({x} * {y}) - sum({x}) * sum({y}) / count(*)) / (sqrt(sum({x} * {x}) - sum({x}) * sum({x}) / count(*) + 1e-12) * sqrt(sum({y} * {y}) - sum({y}) * sum({y}) / count(*) + 1e-12)), -0.5)"


@query("s_model_peptide", f"""with {IONS} select scan, round((sum(log10(intensity) * (reliability + 1)) + sum(-log10(yhat + 1e-6)) + (3 + {_corr_sql('share', 'yhat')}) / 4 * 10 * ln(count(*))) * max(0.2 + 0.1 * size), 3) as peptide_score
from ions where series in ('b', 'y') group by 1""")
def s_model_peptide(spark, d):
    return score.model_peptide_score(_cdf_ions(spark, d), ["scan"], "cov").select("scan", _r("peptide_score", 3).alias("peptide_score"))


_CENTRED = "coalesce(covar_pop(x, y) * count(*) / (sqrt(var_pop(x) * count(*) + 1e-12) * sqrt(var_pop(y) * count(*) + 1e-12)), -0.5)"


@query("s_model_glycan", f"""with {IONS}, z as (select *, total * share / sqrt(total * reliability * share * (1 - share)) as x, total * yhat / sqrt(total * reliability * yhat * (1 - yhat)) as y from ions where series = 'stub_glycopeptide'),
g as (select scan, count(*) as n, sum(log10(intensity) * (reliability + 1)) + sum(-log10(yhat + 1e-6)) as s, case when count(*) > 1 then {_CENTRED} else -0.5 end as r, max(0.2 + 0.1 * size) as cov from z group by 1)
select scan, round(greatest((s + (1 + r) / 2 * 10) * cov, 0), 1) as glycan_score from g""")
def s_model_glycan(spark, d):
    """The correlation has centred sums and a ridge of 1e-12 on both: it is 0 where one side does not vary."""
    return score.model_glycan_score(_cdf_ions(spark, d), ["scan"], "cov").select("scan", _r("glycan_score", 1).alias("glycan_score"))


@query("s_model_score", f"""with {IONS}, s as (select scan, sum(-log10(yhat + 1e-6)) as residual, sum(share * yhat) as r, max(0.2 + 0.1 * size) as cov, count(*) as n, count(*) filter (where size > 1) as k, avg(share) as p from ions group by 1),
t as (select *, unnest(range(k, n + 1)) as j from s),
b as (select scan, any_value(residual) as residual, any_value(r) as r, any_value(cov) as cov, -log10(least(1, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(p) + (n - j) * ln(1 - p))))) as intensity from t group by 1)
select scan, round((intensity + residual + (r + 1) / 2 * 10) * cov + 0.5, 4) as score from b""")
def s_model_score(spark, d):
    """The whole match with its binomial term: ions of two sugars or more among all of the spectrum."""
    s = _cdf_ions(spark, d).groupBy("scan").agg(
        F.sum(-F.log10(F.col("cdf") + 1e-6)).alias("residual"), F.sum(F.col("share") * F.col("yhat")).alias("correlation"), F.max("cov").alias("cov"),
        F.count_if(F.col("size") > 1).alias("k"), F.count("*").alias("n"), F.avg("share").alias("chance"),
    )
    s = s.withColumns({"p": F.pow(F.lit(10.0), -stats.binomial_tail("k", "n", "chance")), "accuracy": F.lit(0.5), "signature": F.lit(None).cast("double")})
    return s.select("scan", _r(score.model_score(s, "p", "residual", "cov", "accuracy", "signature", "correlation"), 4).alias("score"))


@query("s_mixture_score", """with f as (select l_orderkey as scan, 0.1 + l_discount as r, l_quantity as p from lineitem),
w as (select *, case when count(*) over (partition by scan) = 1 then 1 else power(1 / r, 4) / (sum(power(1 / r, 4)) over (partition by scan) + count(*) over (partition by scan) * 1e-6) end as w from f)
select scan, round(sum(w * p), 4) as peptide_score from w group by 1""")
def s_mixture_score(spark, d):
    f = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("scan"), (0.1 + F.col("l_discount")).alias("r"), F.col("l_quantity").alias("peptide_score"))
    return score.mixture_score(f, ["scan"], "r", ["peptide_score"]).select("scan", _r("peptide_score", 4).alias("peptide_score"))


@query("s_partial_split_plain", f"""with {IONS}, b as (select *, 0.2 + 0.1 * size as cov from ions), a as (select scan, max(cov) as cov from b group by 1),
p as (select scan, count(*) as n, (sum(case when size = 0 then log10(intensity) * (1 - power(abs(mass_error / 2e-5), 4)) * ((reliability - 0.5) / 0.5 + 1) end) + (1 + {_corr_sql('share', 'yhat')}) * log10(count(*))
 + sum(case when size = 0 then (reliability - 0.5) / 0.5 end)) * power(max(cov), 0.7) as s from b where series in ('b', 'y') group by 1),
g as (select scan, count(*) as n, case when count(*) > 1 then {_corr_sql('share', 'yhat')} else -0.5 end as corr, sum(log10(intensity) * (1 - power(abs(mass_error / 2e-5), 4))) as t, sum(reliability) as rel, count(*) filter (where size > 1) as big, max(cov) as cov
  from b where series = 'stub_glycopeptide' group by 1)
select scan, p.n as backbone_count, round(s, 2) as peptide_score, g.n as n_stub,
  round(case when g.n is null then null when big > 0 then greatest((t + (greatest((1 + corr) / 2, 0.25) * big + rel * big) * least(exp(g.cov * 3) - 1, 1)) * g.cov, 0) else 0.0 end, 2) as glycan_score from a left join p using (scan) left join g using (scan)
where p.n is not null or g.n is not null""")
def s_partial_split_plain(spark, d):
    out = score.partial_split(_cdf_ions(spark, d), ["scan"], "cov", "cov", glycosylated=False)
    none = F.when(F.col("n_stub").isNotNull(), F.col("glycan_score"))
    return out.select("scan", "backbone_count", _r("peptide_score", 2).alias("peptide_score"), "n_stub", _r(none, 2).alias("glycan_score"))


@query("k_strategy", "select p_partkey, case when p_size <= 10 then 'partial_split' else 'no_glycosylated_partitioned_partial_split' end as strategy from part")
def k_strategy(spark, d):
    return table(spark, d, "part").select("p_partkey", score.strategy("p_size", "no_glycosylated_partitioned_partial_split", "partial_split").alias("strategy"))


@query("j_products_unassigned", """with m as (select distinct l_orderkey as k, l_linenumber as c from lineitem), p as (select distinct k, l_partkey % 7 as name from m join lineitem on l_orderkey = k)
select k, count(*) * 5 + 1 as n from p group by 1""")
def j_products_unassigned(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 7).alias("name"), F.col("l_linenumber").alias("charge"), F.col("l_extendedprice").alias("intensity"))
    p = chem.all_products(li.select("k", "name"), li, ["k", "name"]).withColumn("series", F.lit("stub_glycopeptide"))
    return chem.with_unassigned(p, ["k"]).groupBy("k").agg(F.count("*").alias("n"))


@query("x_delta_series", "select p_partkey, '17.5' as series, round(p_retailprice - 1.25 + 17.5, 6) as mass from part")
def x_delta_series(spark, d):
    f = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("mass"), F.lit(1.25).alias("shift"), F.lit("b").alias("series"), F.lit(1).alias("position"), F.lit("b1").alias("name"))
    return chem.delta_series(f, "shift", 17.5).select("p_partkey", "series", _r("mass").alias("mass"))


@query("x_decoys", f"""with {RESIDUES}, r as (select p_partkey, array_to_string(seq, '') as s from residues),
v as (select p_partkey, s, case when length(s) > 2 then s[1] || reverse(s[2:length(s) - 1]) || s[length(s)] else s end as q from r)
select p_partkey, false as decoy, s as sequence from v union all select p_partkey, true, q from v""")
def x_decoys(spark, d):
    s = views.residues(spark, d).select("p_partkey", F.col("seq").alias("residues"), F.col("p_partkey").cast("string").alias("structure"))
    return chem.decoys(s, glycan=True).select("p_partkey", "decoy", F.array_join("residues", "").alias("sequence"))


@query("x_erf")
def x_erf(spark, d):
    li = table(spark, d, "lineitem").select("l_discount").distinct()
    return li.select("l_discount", _r(scalar.erf("l_discount"), 9).alias("erf"), _r(scalar.shifted_erf("l_discount", 0.5), 9).alias("shifted"))


@query("x_fit_slots", """with f as (select distinct l_linenumber as fc, cast(l_quantity as int) % 5 + 1 as tc, cast(l_quantity as int) % 10 - 4 as ratio from lineitem)
select fc, count(*) as n, sum(((fc - 1) * 7 + tc - 1) * 10 + ratio + 4) as slots from f group by 1""")
def x_fit_slots(spark, d):
    q = F.col("l_quantity").cast("int")
    f = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("fc"), (q % 5 + 1).alias("tc"), (q % 10 - 4).alias("ratio"), F.lit(0.5).alias("mu"))
    m = f.groupBy("fc").agg(scalar.fit_slots("fc", "tc", "ratio", "mu", 7).alias("slots"))
    keys = F.map_keys("slots")
    return m.select("fc", F.size("slots").cast(L).alias("n"), F.aggregate(keys, F.lit(0).cast(L), lambda s, k: s + k).alias("slots"))


@query("e_feature_dict", """with r as (select l_orderkey, l_linenumber, l_partkey, case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as s, least(l_linenumber, 5) as z, cast(l_quantity as int) % 20 as g from lineitem)
select l_orderkey, l_linenumber, l_partkey, case when s = 2 then 'series stub_glycopeptide,series stub_glycopeptide:charge ' || z
  else 'n-term pro,c-term x,series ' || ['b', 'y'][s + 1] || ',charge ' || z || ',series ' || ['b', 'y'][s + 1] || ':charge ' || z || ',is_glycosylated ' || least(g, 2) end as names from r""")
def e_feature_dict(spark, d):
    """The names of all features that each row sets."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.expr("case l_returnflag when 'A' then 'b' when 'N' then 'y' else 'stub_glycopeptide' end").alias("kind"), F.lit("P").alias("flank_n"), F.lit("K").alias("flank_c"), (F.col("l_quantity").cast("int") % 20).alias("fsize"))
    coded = li.withColumns(encode.classify("kind", "l_linenumber", "flank_n", "flank_c", "fsize"))
    e = coded.withColumn("idx", encode.encode_model("FragmentType")).withColumn("named", encode.as_dict("FragmentType"))
    return e.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(F.map_keys("named"), ",").alias("names"))


@query("w_sorted_cells", "select p_brand, p_size, p_type, row_number() over (order by p_brand, p_size, p_type) as place from (select distinct p_brand, p_size, p_type from part)")
def w_sorted_cells(spark, d):
    """Cells (a grid bounds them) in the order of their specification."""
    c = cells.partition_key(table(spark, d, "part").select("p_brand", "p_size", "p_type").distinct(), ["p_brand", "p_size", "p_type"])
    return c.select("p_brand", "p_size", "p_type", (F.col("partition_key") + 1).cast(L).alias("place"))


@query("w_ascending_ranks", "select event_id, row_number() over (partition by user_id order by value, event_id) as place from events")
def w_ascending_ranks(spark, d):
    """Places by intensity from the smallest peak up, as the older rank has them."""
    w = Window.partitionBy("user_id").orderBy("value", "event_id")
    return table(spark, d, "events").select("event_id", F.row_number().over(w).cast(L).alias("place"))


@query("x_feature_codec", "select l_returnflag as name, l_linenumber as from_charge, count(*) as n from lineitem group by all")
def x_feature_codec(spark, d):
    """Features written as documents and read back keep their bounds and their number."""
    f = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("name"), F.lit("offset").alias("feature_type"), F.col("l_extendedprice").alias("offset"), F.col("l_linenumber").cast("int").alias("from_charge"))
    return codecs.features_from_json(codecs.features_to_json(f)).groupBy("name", F.col("from_charge").cast(L).alias("from_charge")).agg(F.count("*").alias("n"))


@query("x_scan_index", "select o_orderkey, case when o_orderkey % 4 = 3 then -1 else cast(o_orderkey % 1000 as int) end as scan_index from orders")
def x_scan_index(spark, d):
    o = table(spark, d, "orders")
    name = F.col("o_orderkey").cast("string")
    kind = F.col("o_orderkey") % 4
    file = F.lit("a.mgf").alias("source_file")
    known = o.where(kind != 3).select(file, F.when(kind == 2, F.concat(name, F.lit("."))).otherwise(name).alias("title"), (F.col("o_orderkey") % 1000).cast("int").alias("scan_index"))
    return mgf.scan_index(o.select("o_orderkey", file, name.alias("title")), known).select("o_orderkey", "scan_index")


@query("a_cell_rates", """with p as (select l_returnflag as cell, l_linenumber as z, l_linestatus as feature, l_discount > 0.05 as pair_on, l_tax > 0.03 as peak_on from lineitem),
c as (select distinct cell, z from p), n as (select cell, z as cell_charge, z as near from c union all select cell, z, k from c, (values (3), (4), (5)) t(k) where k <> z),
s as (select n.cell, cell_charge, feature, count(*) filter (where pair_on) as on_count from n join p on p.cell = n.cell and z = near group by all),
t as (select n.cell, cell_charge, count(*) filter (where peak_on) as n_on from n join p on p.cell = n.cell and z = near group by all)
select cell, cell_charge, feature, round(on_count / greatest(n_on, 1), 6) as mu from s join t using (cell, cell_charge)""")
def a_cell_rates(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("cell"), F.col("l_linenumber").alias("precursor_charge"), F.col("l_linestatus").alias("feature"), "l_discount", "l_tax")
    out = relations.cell_rates(p, p, ["cell"], [], "feature", F.col("l_discount") > 0.05, F.col("l_tax") > 0.03)
    return out.select("cell", "cell_charge", "feature", _r("mu").alias("mu"))


@query("g_fit_with_mismatch")
def g_fit_with_mismatch(spark, d):
    """Both fits of each cell; the rows are tested against the plain fit and its correlations."""
    out = glm.fit_with_mismatch(model_rows(spark, d), ["cell"], ["scan"], encode.width("FragmentType"))
    return out.select("cell", "mismatch", "n_spectra", "converged", _r("deviance", 2).alias("deviance"))


@query("g_wald_named")
def g_wald_named(spark, d):
    fits = partitioned.fit_grouped(model_rows(spark, d), ["cell"], ["scan"], encode.width("FragmentType"))
    return glm.named_intervals(fits, encode.feature_names("FragmentType")).select("cell", "name", _r("z", 3).alias("z"), _r("p_value", 4).alias("p_value"))


@query("m_routed_scores")
def m_routed_scores(spark, d):
    """Spectra scored by the model of their own cell, or, if it has none, of the cell of the nearest
    priority: correlation of shares and predictions, with the key of the model's cell."""
    rows = model_rows(spark, d)
    fits = partitioned.fit_grouped(rows, ["cell"], ["scan"], encode.width("FragmentType"))
    models = cells.partition_key(fits.where("coef is not null"), ["cell"])
    routes = cells.nearest_route(fits, models, "cell", lambda c: F.substring(c, 1, 1).try_cast("int"))
    s = glm.scored_by_models(rows, models, ["cell"], ["scan"], routes)
    return s.groupBy("scan", "partition_key").agg(F.count("*").alias("n"), _r(F.sum("yhat"), 4).alias("yhat"), _r(stats.correlation("share", "yhat"), 4).alias("correlation"))


@query("s_score_set_full", f"""with {_SCORED}, u as (select scan, sum(case when series = 'stub_glycopeptide' then intensity else 0 end) / max(total) as stub_util, sum(intensity) / max(total) as total_util, max(cov) as cover,
 sum(case when series in ('b', 'y') then reliability else 0 end) as prel, sum(case when series = 'stub_glycopeptide' then reliability else 0 end) as grel from b group by 1)
select scan, round(coalesce(peptide_score, 0) * 0.65 + coalesce(glycan_score, 0) * 0.35, 2) as glycopeptide_score, round(coalesce(peptide_score, 0), 2) as peptide_score, round(coalesce(glycan_score, 0), 2) as glycan_score,
 round(cover, 6) as glycan_coverage, round(stub_util, 6) as stub_util, 0.0::double as oxonium_util, coalesce(gs.n, 0) as n_stub, round(cover, 6) as peptide_coverage, round(total_util, 6) as total_util,
 round(pep.corr, 3) as peptide_corr, coalesce(ps.n, 0) as backbone_count, round(gly.corr, 3) as glycan_corr, round(prel, 6) as peptide_rel, round(grel, 6) as glycan_rel, scan % 7 as partition_label
from u left join ps using (scan) left join gs using (scan) left join pep using (scan) left join gly using (scan)""")
def s_score_set_full(spark, d):
    i = views.ions(spark, d).withColumn("cov", F.max(0.2 + 0.1 * F.col("ln")).over(Window.partitionBy("scan"))).withColumn("label", F.col("scan") % 7)
    s = score.full_score_set(i, ["scan"], "cov", "cov", "label")
    digits = {"glycopeptide_score": 2, "peptide_score": 2, "glycan_score": 2, "peptide_corr": 3, "glycan_corr": 3, "n_stub": None, "backbone_count": None, "partition_label": None}
    return s.select("scan", *(F.col(c) if digits.get(c, 6) is None else _r(c, digits.get(c, 6)).alias(c) for c in score.SCORE_SET))


@query("m_routed_evaluate", f"""with {PSMS}, m(mobility, k, c) as (values ('mobile', 0, [0.1, -0.2, 0.3, 0.4, 0.5]), ('partial', 1, [0.5, 0.4, -0.3, 0.2, 0.1])),
r as (select ok, ln, sk, k, mass, exp(c[ln % 3 + 1] + c[3 + size % 2 + 1]) as e from psms join m using (mobility))
select ok, ln, sk, k as partition_key, round(e / (1 + sum(e) over (partition by ok, k)), 6) as yhat from r""")
def m_routed_evaluate(spark, d):
    """PSMs scored by the model of their mobility; a cell without a model scores nothing."""
    models = spark.createDataFrame([("mobile", [0.1, -0.2, 0.3, 0.4, 0.5]), ("partial", [0.5, 0.4, -0.3, 0.2, 0.1])], "mobility string, coef array<double>")
    models = cells.partition_key(models, ["mobility"])
    rows = views.psms(spark, d).select("ok", "ln", "sk", "mobility", F.array((F.col("ln") % 3).cast("int"), (3 + F.col("size") % 2).cast("int")).alias("idx"), F.col("mass").alias("intensity"), F.lit(1e6).alias("total"))
    s = glm.scored_by_models(rows, models, ["mobility"], ["ok", "mobility"])
    return s.select("ok", "ln", "sk", F.col("partition_key").cast("int").alias("partition_key"), _r("yhat").alias("yhat"))

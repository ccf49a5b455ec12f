"""Queries of relation statistics, aggregates, correlations and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar, stats
from ..operators import relations, score, select
from . import views
from .joins import _BUCKET
from .registry import query
from .views import IONS, PEAKS, RANKED, RESIDUES, table

L = "bigint"


def _r(c, n=6):
    return F.round(c, n)


@query("a_bucket_counts", """select case grouping_id(o_orderpriority, o_orderstatus) when 1 then 'priority' when 2 then 'status' else 'both' end as bucket_of,
 o_orderpriority, o_orderstatus, count(distinct o_custkey) as n from orders group by grouping sets ((o_orderpriority), (o_orderstatus), (o_orderpriority, o_orderstatus))""")
def a_bucket_counts(spark, d):
    o = table(spark, d, "orders")
    g = o.groupingSets([["o_orderpriority"], ["o_orderstatus"], ["o_orderpriority", "o_orderstatus"]], "o_orderpriority", "o_orderstatus")
    out = g.agg(F.grouping_id().alias("g"), F.count_distinct("o_custkey").alias("n"))
    return out.select(F.when(F.col("g") == 1, "priority").when(F.col("g") == 2, "status").otherwise("both").alias("bucket_of"), "o_orderpriority", "o_orderstatus", "n")


_SCANS = """scans as (select l_suppkey as scan, l_returnflag as series, count(*) filter (where l_linenumber <= 4) as sites,
 count(*) filter (where l_linenumber <= 4 and l_discount > 0.04) as explained, count(*) as peaks, sum(l_extendedprice) as mass,
 sum(case when l_linenumber <= 4 then l_extendedprice / 100 else 0 end) as fmass from lineitem group by all)"""
_ALPHA = """sum(explained) * 1.0 / sum(sites) as alpha, sum(peaks - explained) / sum(mass / 0.02 - sites) as beta, sum(fmass * 4e-5) / sum(mass) as prior"""


def _scan_rows(spark, d):
    li = table(spark, d, "lineitem")
    site = F.col("l_linenumber") <= 4
    return li.groupBy(F.col("l_suppkey").alias("scan"), F.col("l_returnflag").alias("series")).agg(
        F.count_if(site).alias("sites"), F.count_if(site & (F.col("l_discount") > 0.04)).alias("explained"), F.count("*").alias("peaks"),
        F.sum("l_extendedprice").alias("mass"), F.sum(F.when(site, F.col("l_extendedprice") / 100).otherwise(0.0)).alias("fmass"),
    )


@query("a_offset_params", f"""with {_SCANS}, p as (select series, {_ALPHA} from scans group by 1)
select series, round(alpha, 8) as alpha, round(beta * 1e6, 6) as beta_e6, round(prior * 1e6, 6) as prior_e6, round(prior * alpha / (prior * alpha + (1 - prior) * beta), 6) as gamma from p""")
def a_offset_params(spark, d):
    p = relations.offset_parameters(_scan_rows(spark, d), ["series"], "sites", "explained", "peaks", "mass", "fmass")
    return p.select("series", _r("alpha", 8).alias("alpha"), _r(F.col("beta") * 1e6).alias("beta_e6"), _r(F.col("prior") * 1e6).alias("prior_e6"), _r("gamma").alias("gamma"))


_PAIRS = f"""with {RANKED}, pairs as (select a.scan, a.series as sa, b.series as sb, a.charge as fc, b.charge as tc, a.mass / b.mass as r
 from (select *, row_number() over (partition by scan order by mass, ok, ln) as k from ranked) a
 join (select *, row_number() over (partition by scan order by mass, ok, ln) as k from ranked) b on a.scan = b.scan and b.k = a.k + 7 where a.rank >= 1 and b.rank >= 1)"""


def _pairs(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("scan").orderBy("mass", "ok", "ln")
    p = views.ranked(spark, d)
    lead = lambda c: F.lead(c, 7).over(w)
    out = p.select("scan", F.col("series").alias("sa"), lead("series").alias("sb"), F.col("charge").alias("fc"), lead("charge").alias("tc"), "mass", lead("mass").alias("mb"), "rank", lead("rank").alias("rb"))
    return out.where("rank >= 1 and rb >= 1").withColumn("bucket", scalar.ratio_bucket("mass", "mb")), p.where("rank >= 1")


@query("a_on_off_rates", _PAIRS + """, t as (select scan, count(*) filter (where series = 'A') as n_on, count(*) filter (where series <> 'A') as n_off from ranked where rank >= 1 group by 1)
select scan, feature, on_count, off_count, round(on_count / greatest(n_on, 1), 6) as mu, round(off_count / greatest(n_off, 1), 6) as nu from (
 select scan, 'lag7' as feature, count(*) filter (where sa = 'A' and sb = 'A') as on_count, count(*) filter (where not (sa = 'A' and sb = 'A')) as off_count from pairs group by 1) join t using (scan)""")
def a_on_off_rates(spark, d):
    pairs, all_peaks = _pairs(spark, d)
    on = (F.col("sa") == "A") & (F.col("sb") == "A")
    out = relations.rates(pairs.withColumn("feature", F.lit("lag7")), all_peaks, ["scan"], "feature", on, F.col("series") == "A")
    return out.select("scan", "feature", "on_count", "off_count", _r("mu").alias("mu"), _r("nu").alias("nu"))


_SPECIAL = _PAIRS + f""", t as (select count(*) filter (where series = 'A') as n_on, count(*) filter (where series <> 'A') as n_off from ranked where rank >= 1),
h as (select fc, tc, cast({_BUCKET} as bigint) as bucket, count(*) as n, count(*) filter (where sa = 'A' and sb = 'A') as on_count from pairs group by all having count(*) >= 10),
s as (select fc, tc, bucket, n, on_count, n - on_count as off_count, on_count / greatest(n_on, 1) as mu, (n - on_count) / greatest(n_off, 1) as nu from h, t)"""


def _special(spark, d):
    pairs, all_peaks = _pairs(spark, d)
    totals = all_peaks.agg(F.count_if(F.col("series") == "A").alias("n_on"), F.count_if(F.col("series") != "A").alias("n_off"))
    return relations.specialise(pairs.withColumn("bucket", F.col("bucket").cast(L)), totals, ["fc", "tc", "bucket"], (F.col("sa") == "A") & (F.col("sb") == "A"))


@query("a_specialize", _SPECIAL + " select fc, tc, bucket, n, on_count, off_count, round(mu, 8) as mu, round(nu, 8) as nu from s")
def a_specialize(spark, d):
    return _special(spark, d).select("fc", "tc", "bucket", "n", "on_count", "off_count", _r("mu", 8).alias("mu"), _r("nu", 8).alias("nu"))


@query("a_fit_pivot", _SPECIAL + """ select fc, string_agg(tc || '/' || bucket || '=' || cast(round(mu * 1e6) as bigint), ',' order by tc || '/' || bucket) as fits from s where mu >= 1e-4 group by 1""")
def a_fit_pivot(spark, d):
    p = relations.pivot_fits(_special(spark, d), ["fc"], F.concat_ws("/", F.col("tc").cast("string"), F.col("bucket").cast("string")))
    entry = lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 1e6).cast(L).cast("string"))
    return p.select("fc", F.array_join(F.array_sort(F.transform(F.map_entries("fits"), entry)), ",").alias("fits"))


_EDGES = """e as (select l_suppkey as scan, l_partkey % 50 as own, l_orderkey % 60 as other, l_orderkey as ok, l_linenumber as ln, l_extendedprice as x,
 case when l_tax = 0.08 then 0 else 0.2 + l_tax end as mu, 0.1 + l_discount as nu from lineitem)"""


@query("a_posterior", f"""with {_EDGES}, b as (select *, row_number() over (partition by scan, own, least(own, other), greatest(own, other) order by -(0.3 * mu / (0.3 * mu + 0.7 * nu)), ok, ln, x) as r from e),
g as (select scan, own, product(mu) as a, product(nu) as b from b where r = 1 and mu > 0 group by all)
select scan, own, round(0.3 * a / (0.3 * a + 0.7 * b), 6) as probability from g""")
def a_posterior(spark, d):
    e = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("scan"), (F.col("l_partkey") % 50).alias("own"), (F.col("l_orderkey") % 60).alias("other"), F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), F.col("l_extendedprice").alias("x"),
        F.when(F.col("l_tax") == 0.08, 0.0).otherwise(0.2 + F.col("l_tax")).alias("mu"), (0.1 + F.col("l_discount")).alias("nu"),
    )
    p = relations.posterior(e, ["scan", "own"], "other", "own", "mu", "nu", F.lit(0.3), ["ok", "ln", "x"])
    return p.select("scan", "own", _r("probability").alias("probability"))


@query("a_reliability", f"""with {_EDGES}, s as (select scan, own, avg(mu) as p from e group by all)
select l_orderkey, l_linenumber, l_partkey, round(case when l_returnflag = 'R' then 0.5 else coalesce(p, 0.5) * 0.5 + 0.5 end, 6) as reliability
from lineitem left join s on scan = l_suppkey and own = l_partkey % 50""")
def a_reliability(spark, d):
    li = table(spark, d, "lineitem")
    e = li.select(F.col("l_suppkey").alias("scan"), (F.col("l_partkey") % 50).alias("own"), F.when(F.col("l_tax") == 0.08, 0.0).otherwise(0.2 + F.col("l_tax")).alias("mu"))
    s = e.groupBy("scan", "own").agg(F.avg("mu").alias("probability"))
    m = li.withColumns({"scan": F.col("l_suppkey"), "own": F.col("l_partkey") % 50})
    out = relations.with_reliability(m, s, ["scan", "own"], 0.5, F.col("l_returnflag") == "R", 0.5)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", _r("reliability").alias("reliability"))


@query("a_observations", """with m as (select l_orderkey as scan, l_partkey as peak, l_extendedprice as i, case l_returnflag when 'A' then 'b' when 'N' then 'y' else 'oxonium_ion' end as series from lineitem),
o as (select scan, sum(i) as matched from (select distinct scan, peak, i from m) group by 1), t as (select o_orderkey as scan, o_totalprice as total from orders),
u as (select t.scan, greatest(total, coalesce(matched, 0)) as total, coalesce(matched, 0) as matched from t left join o using (scan))
select scan, series, round(i / total, 6) as share from (select m.scan, series, i, total from m join u using (scan) where series <> 'oxonium_ion'
 union all select scan, 'unassigned', greatest(total - matched, 0), total from u)""")
def a_observations(spark, d):
    from ..operators.glm import observations

    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("scan"), F.col("l_partkey").alias("peak"), F.col("l_extendedprice").alias("i"), F.expr("case l_returnflag when 'A' then 'b' when 'N' then 'y' else 'oxonium_ion' end").alias("series"))
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("scan"), F.col("o_totalprice").alias("total"))
    return observations(m, t, ["scan"], ["peak"], "i", "series").select("scan", "series", _r(F.col("i") / F.col("total")).alias("share"))


_CLASS = "case when {0} = 'P' then 0 when {0} = 'G' then 1 when {0} in ('S', 'T') then 2 when {0} in ('L', 'I', 'V', 'A') then 3 when {0} = 'N' then 4 when {0} = 'H' then 5 when {0} in ('R', 'K') then 6 else 7 end"


@query("a_composition", f"with {RESIDUES}, e as (select p_partkey, unnest(seq) as aa from residues) select p_partkey, cast({_CLASS.format('aa')} as bigint) as class, count(*) as n from e group by all")
def a_composition(spark, d):
    e = views.residues(spark, d).select("p_partkey", F.explode("seq").alias("aa"))
    return e.groupBy("p_partkey", scalar.residue_class("aa").cast(L).alias("class")).agg(F.count("*").alias("n"))


@query("a_mobility_class", f"""with {RESIDUES}, k as (select *, len(list_filter(seq, lambda x: x in ('K', 'R', 'H'))) as k from residues)
select p_partkey, case when k < charge then 'mobile' when k = charge then 'partial' else 'immobile' end as mobility from k""")
def a_mobility_class(spark, d):
    k = F.size(F.filter("seq", lambda x: x.isin("K", "R", "H")))
    return views.residues(spark, d).select("p_partkey", scalar.proton_mobility(k, "charge").alias("mobility"))


@query("a_building_blocks", f"with {RESIDUES} select aa, count(*) as n from (select unnest(seq) as aa from residues) group by 1")
def a_building_blocks(spark, d):
    return views.residues(spark, d).select(F.explode("seq").alias("aa")).groupBy("aa").agg(F.count("*").alias("n"))


def _bond_sql(n: str, c: str) -> tuple[str, str]:
    a, b = _CLASS.format(n), _CLASS.format(c)
    left = "case " + " ".join(f"when ({a}) = {k} then {k} when ({b}) = {k} then 7" for k in range(6)) + " else 7 end"
    right = "case " + " ".join(f"when ({a}) = {k} then 7 when ({b}) = {k} then {k}" for k in range(6)) + " else 7 end"
    return left, right


_BN, _BC = _bond_sql("a", "b")


@query("x_amide_bonds", f"""with {RESIDUES}, e as (select seq[i] as a, seq[i + 1] as b from residues, (select unnest(range(1, 40)) as i) where i < len(seq))
select cast({_BN} as bigint) as n_class, cast({_BC} as bigint) as c_class, count(*) as n from e group by all""")
def x_amide_bonds(spark, d):
    e = views.residues(spark, d).select("seq", F.explode(F.sequence(F.lit(1), F.greatest(F.size("seq") - 1, F.lit(1)))).alias("i")).where(F.col("i") < F.size("seq"))
    b = scalar.amide_bond(F.get("seq", F.col("i") - 1), F.get("seq", F.col("i")))
    return e.select(b.alias("b")).groupBy(F.col("b.n").cast(L).alias("n_class"), F.col("b.c").cast(L).alias("c_class")).agg(F.count("*").alias("n"))


@query("x_site_index", """select p_size as size, cast(least(abs(floor(p_size / 2) - i), 10) as bigint) as distance, count(*) as n from (
 select p_size, case when p_partkey % 2 = 0 then p_partkey % p_size else p_size - p_partkey % p_size end as i from part) group by all""")
def x_site_index(spark, d):
    p = table(spark, d, "part")
    i = scalar.site_index(F.col("p_partkey") % F.col("p_size"), "p_size", F.col("p_partkey") % 2 == 0, n_side=False)
    return p.groupBy(F.col("p_size").alias("size"), scalar.centre_distance(i, "p_size").cast(L).alias("distance")).agg(F.count("*").alias("n"))


@query("x_typecast", r"""with v as (select unnest([o_orderpriority, cast(o_orderkey as varchar), cast(o_totalprice as varchar), case o_orderstatus when 'F' then 'True' when 'O' then 'null' else '1e3' end]) as v from orders)
select case when lower(trim(v)) = 'null' then 'null' when regexp_matches(trim(v), '^[+-]?\d+$') then 'int' when try_cast(trim(v) as double) is not null then 'double' when lower(trim(v)) in ('true', 'false') then 'bool' else 'str' end as kind,
 count(*) as n from v group by 1""")
def x_typecast(spark, d):
    o = table(spark, d, "orders")
    v = F.array(F.col("o_orderpriority"), F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string"), F.expr("case o_orderstatus when 'F' then 'True' when 'O' then 'null' else '1e3' end"))
    return o.select(F.explode(v).alias("v")).groupBy(scalar.typecast("v")["kind"].alias("kind")).agg(F.count("*").alias("n"))


@query("x_spec_compact", "select p_brand || ':' || p_size || ':' || p_type as spec, count(*) as n from part group by 1")
def x_spec_compact(spark, d):
    return table(spark, d, "part").groupBy(scalar.compact("p_brand", "p_size", "p_type").alias("spec")).agg(F.count("*").alias("n"))


@query("x_legacy_bins", """select cast(case when floor(m / 121.6) < 9 then 1 when floor(m / 121.6) < 13 then 2 when floor(m / 121.6) < 17 then 3 when floor(m / 121.6) < 20 then 4 else 5 end as bigint) as mass_rank,
 cast(case when r < 0.4 then 0 when r < 0.8 then 1 when r < 1.2 then 2 when r < 1.6 then 3 when r < 2 then 4 else 5 end as bigint) as ratio_bin, count(*) as n
from (select l_extendedprice / 30 as m, l_quantity * 0.06 / (1 + l_tax) as r from lineitem) group by all""")
def x_legacy_bins(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy(scalar.mass_rank(F.col("l_extendedprice") / 30).cast(L).alias("mass_rank"), scalar.mass_ratio_bin(F.col("l_quantity") * 0.06, 1 + F.col("l_tax")).cast(L).alias("ratio_bin")).agg(F.count("*").alias("n"))


@query("x_scalars", """select l_orderkey, l_linenumber, l_partkey, round(ln(x / (1 - x)), 6) as logit, round(1 / (1 + exp(-x)), 6) as inv_logit, round(3 * x * x - 2 * x * x * x, 6) as smooth, round(2 / (1 + exp(-x)) - 1, 6) as logistic,
 round((1 + x) * log10(l_quantity), 6) as score, round(-ln(1 - x) * l_quantity, 6) as score_log, cast(((l_linenumber - 1) * 7 + l_linenumber % 7) * 10 + 4 as bigint) as slot
from (select *, 0.1 + l_discount * 5 as x from lineitem)""")
def x_scalars(spark, d):
    x = table(spark, d, "lineitem").withColumn("x", 0.1 + F.col("l_discount") * 5)
    return x.select(
        "l_orderkey", "l_linenumber", "l_partkey", _r(scalar.logit("x")).alias("logit"), _r(scalar.inv_logit("x")).alias("inv_logit"), _r(scalar.smoothstep("x")).alias("smooth"), _r(scalar.normal_cdf_logistic("x")).alias("logistic"),
        _r(scalar.correlation_score("x", "l_quantity")).alias("score"), _r(scalar.correlation_score_log("x", "l_quantity")).alias("score_log"),
        scalar.partition_offset("l_linenumber", F.col("l_linenumber") % 7 + 1, F.lit(0), 7).cast(L).alias("slot"),
    )


_CORR = "(sum(x * y) - sum(x) * sum(y) / count(*)) / (sqrt(sum(x * x) - sum(x) * sum(x) / count(*) + {0}) * sqrt(sum(y * y) - sum(y) * sum(y) / count(*) + {0}))"


@query("s_corr", f"select l_returnflag, round({_CORR.format('0')}, 6) as r from (select l_returnflag, l_quantity as x, l_extendedprice as y from lineitem) group by 1")
def s_corr(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(_r(stats.correlation("l_quantity", "l_extendedprice")).alias("r"))


@query("s_corr_standardized", f"""with {IONS}, z as (select sk, total * share / sqrt(total * reliability * share * (1 - share)) as x, total * yhat / sqrt(total * reliability * yhat * (1 - yhat)) as y from ions)
select sk, round({_CORR.format('1e-12')}, 5) as r from z group by 1""")
def s_corr_standardized(spark, d):
    z = views.ions(spark, d).select("sk", stats.standardise("share", "total", "reliability").alias("x"), stats.standardise("yhat", "total", "reliability").alias("y"))
    return z.groupBy("sk").agg(_r(stats.correlation("x", "y", 1e-12), 5).alias("r"))


@query("s_cosine", """select a.vec_id, a.label, round(list_dot_product(a.embedding::double[], b.embedding::double[]) / (sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[]))), 5) as cosine
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def s_cosine(spark, d):
    e = table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", "label", _r(stats.array_cosine("embedding", "other"), 5).alias("cosine"))


@query("s_spectral_angle", f"with {IONS} select scan, round(acos(greatest(-1, least(1, sum(share * yhat) / (sqrt(sum(share * share)) * sqrt(sum(yhat * yhat)))))) * 2 / pi(), 4) as angle from ions group by 1")
def s_spectral_angle(spark, d):
    return views.ions(spark, d).groupBy("scan").agg(_r(stats.angle(stats.cosine("share", "yhat")), 4).alias("angle"))


@query("s_ls_scale", "select l_suppkey, round(sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity), 4) as scale from lineitem group by 1")
def s_ls_scale(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(_r(stats.least_squares_scale("l_quantity", "l_extendedprice"), 4).alias("scale"))


# the squared distance covariance is mean(dx dy) - 2 mean(row means' product) + product of means
@query("s_distcorr", """with x as (select l_suppkey as g, l_quantity as x, l_discount as y, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_extendedprice) as i from lineitem),
p as (select a.g, a.i, avg(abs(a.x - b.x)) as rx, avg(abs(a.y - b.y)) as ry, avg(abs(a.x - b.x) * abs(a.y - b.y)) as xy, avg((a.x - b.x) * (a.x - b.x)) as xx, avg((a.y - b.y) * (a.y - b.y)) as yy from x a join x b on a.g = b.g group by all),
c as (select g, avg(xy) - 2 * avg(rx * ry) + avg(rx) * avg(ry) as xy, avg(xx) - 2 * avg(rx * rx) + avg(rx) * avg(rx) as xx, avg(yy) - 2 * avg(ry * ry) + avg(ry) * avg(ry) as yy from p group by 1)
select g, round(sqrt(greatest(xy, 0) / sqrt(xx * yy)), 5) as dcor from c""")
def s_distcorr(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("g"), "l_quantity", "l_discount")
    return select.distance_correlation(x, ["g"], "l_quantity", "l_discount", "g long").select("g", _r("dcor", 5).alias("dcor"))


@query("s_nanmedian", "select event_type, round(median(case when value < 1 then null else value end), 4) as med from events group by 1")
def s_nanmedian(spark, d):
    v = F.nanvl(F.when(F.col("value") < 1, F.lit(float("nan"))).otherwise(F.col("value")), F.lit(None).cast("double"))
    return table(spark, d, "events").groupBy("event_type").agg(_r(F.median(v), 4).alias("med"))


@query("s_mixture_weights", """with f as (select l_orderkey as scan, l_linenumber as m, l_extendedprice, case when l_linenumber = 5 then 0 else l_quantity / 10 end as r from lineitem),
p as (select *, power(1 / case when r = 0 then 1 else r end, 4) as p, count(*) over (partition by scan) as n from f)
select scan, m, l_extendedprice, round(case when n = 1 then 1 else p / (sum(p) over (partition by scan) + n * 1e-6) end, 6) as weight from p""")
def s_mixture_weights(spark, d):
    f = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("scan"), F.col("l_linenumber").alias("m"), "l_extendedprice", F.when(F.col("l_linenumber") == 5, 0.0).otherwise(F.col("l_quantity") / 10).alias("r"))
    return score.mixture_weights(f, ["scan"], "r").select("scan", "m", "l_extendedprice", _r("weight").alias("weight"))


@query("d_divergence", """with m as (select l_suppkey as f, l_returnflag as s, avg(l_discount) * 2 as o, avg(l_tax) * 3 as t from lineitem group by all),
n as (select f, o, t from m union all select f, 1 - sum(o), 1 - sum(t) from m group by 1), z as (select f, case when o = 0 then 1e-6 else o end as o, case when t = 0 then 1e-6 else t end as t from n)
select f, round(sum(o * (ln(o) - ln(t))), 6) as divergence from z group by 1""")
def d_divergence(spark, d):
    m = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("f"), "l_returnflag").agg((F.avg("l_discount") * 2).alias("o"), (F.avg("l_tax") * 3).alias("t"))
    return relations.divergence(m, ["f"], "o", "t").select("f", _r("divergence").alias("divergence"))


@query("o_oxonium_norm", """select user_id, event_id, round(value / nullif(max(case when event_type = 'click' then value end) over (partition by user_id, event_id // 100), 0), 6) as ratio from events""")
def o_oxonium_norm(spark, d):
    """Values over the reference's; null without a reference and where it is 0."""
    e = table(spark, d, "events").withColumn("s", F.floor(F.col("event_id") / 100))
    return score.oxonium_ratios(e, ["user_id", "s"], "event_type", "value", "click").select("user_id", "event_id", _r("ratio").alias("ratio"))


@query("o_oxonium_onehot", """with k as (select event_id, event_type, list_sort([cast(least(user_id % 9, 5) as int), cast(6 + least(event_id % 4, 2) as int)]) as i from events)
select event_id, '[' || array_to_string(case when event_type in ('click', 'error', 'view') then i || [cast(9 + list_position(['click', 'error', 'view'], event_type) - 1 as int)] else i end, ', ') || ']' as idx from k""")
def o_oxonium_onehot(spark, d):
    """Every event; one of a kind that is no ion sets the bounded columns only."""
    e = table(spark, d, "events").withColumns({"Hex": F.col("user_id") % 9, "HexNAc": F.col("event_id") % 4})
    idx = score.oxonium_one_hot({"Hex": 5, "HexNAc": 2}, ["click", "error", "view"], "event_type")
    return e.select("event_id", F.concat(F.lit("["), F.array_join(idx.cast("array<string>"), ", "), F.lit("]")).alias("idx"))


@query("u_title_set_key", "with k as (select o_custkey, string_agg(distinct o_orderpriority, '|' order by o_orderpriority) as k from orders group by 1) select k, count(*) as n from k group by 1")
def u_title_set_key(spark, d):
    k = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("k"))
    return k.groupBy("k").agg(F.count("*").alias("n"))


@query("c_kfold", "select fold, event_type, count(*) as n from (select event_type, cast(ntile(5) over (partition by event_type order by event_id) as bigint) as fold from events) group by all")
def c_kfold(spark, d):
    f = select.folds(table(spark, d, "events"), 5, ["event_id"], ["event_type"])
    return f.groupBy(F.col("fold").cast(L).alias("fold"), "event_type").agg(F.count("*").alias("n"))


@query("c_kfold_stratified", """with n as (select *, count(*) over (partition by o_custkey) as n from orders),
f as (select o_orderkey, ntile(3) over (partition by case when n > 1 then cast(o_custkey as varchar) else 'single-' || (o_custkey % 8) end order by o_orderkey) as fold from n)
select o_orderkey, cast(fold as bigint) as fold from f""")
def c_kfold_stratified(spark, d):
    f = select.stratified_folds(table(spark, d, "orders"), 3, "o_custkey", ["o_orderkey"], pool=F.col("o_custkey") % 8)
    return f.select("o_orderkey", F.col("fold").cast(L).alias("fold"))


@query("t_decoy_fdr", """with s as (select o_orderkey, o_orderpriority as g, o_totalprice as s, o_custkey % 4 = 0 as decoy from orders),
f as (select *, least(sum(decoy::int) over w * 1.0 / nullif(sum((not decoy)::int) over w, 0), 1) as fdr from s window w as (partition by g order by s desc range between unbounded preceding and current row))
select o_orderkey, round(min(coalesce(fdr, 1)) over (partition by g order by s range between unbounded preceding and current row), 6) as q from f""")
def t_decoy_fdr(spark, d):
    s = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("g"), F.col("o_totalprice").alias("s"), (F.col("o_custkey") % 4 == 0).alias("decoy"))
    return select.q_values(s, "s", "decoy", ["g"]).select("o_orderkey", _r("q").alias("q"))

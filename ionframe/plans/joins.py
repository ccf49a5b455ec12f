"""Queries of filters, ranks, joins and routing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar, stats
from ..operators import bandjoin, cells, peaks, relations, search
from . import views
from .registry import query
from .views import PEAKS, PSMS, RANKED, table

L = "bigint"


@query("f_filter_dedupe", """
select o_custkey, o_orderpriority, o_orderkey, o_totalprice from (
  select *, row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate, o_orderkey) as r from orders
  where o_totalprice >= 50000 and o_totalprice <= 450000 and o_orderstatus in ('F', 'O')) where r = 1""")
def f_filter_dedupe(spark, d):
    o = peaks.select_matches(table(spark, d, "orders"), "o_totalprice", 50000, "o_totalprice", 450000, "o_orderstatus", ("F", "O"))
    return peaks.first_of_each(o, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")


@query("f_blacklist_anti", "select o_orderkey, o_custkey from orders o where not exists (select 1 from customer where c_acctbal < 0 and c_custkey = o_custkey)")
def f_blacklist_anti(spark, d):
    listed = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return peaks.without(table(spark, d, "orders"), listed, "o_custkey").select("o_orderkey", "o_custkey")


@query("f_base_peak", "select event_id, round(value / max(value) over (partition by user_id), 6) as relative from events")
def f_base_peak(spark, d):
    return peaks.base_peak(table(spark, d, "events"), ["user_id"], "value").select("event_id", F.round("relative", 6).alias("relative"))


@query("w_intensity_rank", """with j as (select *, row_number() over (partition by user_id order by value desc, event_id) as j,
  count(*) filter (where value >= 100) over (partition by user_id) as high from events)
select event_id, user_id, cast(case when value < 100 then (case when high >= 160 then -1 else 0 end)
  when j < 90 then 10 - floor(j / 10) when j < 160 then 1 else -1 end as bigint) as rank from j""")
def w_intensity_rank(spark, d):
    return peaks.intensity_rank(table(spark, d, "events"), ["user_id"], "value", ["event_id"]).select("event_id", "user_id", F.col("rank").cast(L).alias("rank"))


@query("w_intensity_rank_hist", f"with {RANKED} select scan, cast(rank as bigint) as rank, count(*) as n from ranked group by all")
def w_intensity_rank_hist(spark, d):
    return views.ranked(spark, d).groupBy("scan", F.col("rank").cast(L).alias("rank")).agg(F.count("*").alias("n"))


_BUCKET = """case when r >= 5 then -4 when r >= 2.5 then -3 when r >= 1.7 then -2 when r >= 1.3 then -1 when r >= 1 then 0 when r >= 0.8 then 1
  when r >= 0.6 then 2 when r >= 0.4 then 3 when r >= 0.2 then 4 when r >= 0 then 5 end"""


@query("x_ratio_bucket_hist", f"""with p as (select event_type, value, lag(value) over (partition by user_id order by ts, event_id) as prev from events),
r as (select event_type, value / nullif(prev, 0) as r from p where prev is not null)
select event_type, cast({_BUCKET} as bigint) as bucket, count(*) as n from r group by all""")
def x_ratio_bucket_hist(spark, d):
    """Buckets of the ratios of neighbouring values; the bucket is null where the earlier value is 0."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("prev", F.lag("value").over(w)).where("prev is not null")
    return e.groupBy("event_type", scalar.ratio_bucket("value", "prev").cast(L).alias("bucket")).agg(F.count("*").alias("n"))


@query("j_fragment_band", """select distinct l_orderkey, l_linenumber, p_partkey, round((m - p_retailprice) / p_retailprice * 1e6, 3) as ppm
from (select *, l_extendedprice / l_quantity as m from lineitem) join part on l_partkey % 7 = p_partkey % 7
where abs((m - p_retailprice) / p_retailprice) <= 2e-5""")
def j_fragment_band(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 7).alias("k"), F.try_divide("l_extendedprice", "l_quantity").alias("m"))
    p = table(spark, d, "part").select("p_partkey", "p_retailprice", (F.col("p_partkey") % 7).alias("k"))
    out = bandjoin.match_fragments(li, p, ["k"], "m", "p_retailprice")
    return out.select("l_orderkey", "l_linenumber", "p_partkey", F.round(F.col("mass_error") * 1e6, 3).alias("ppm")).distinct()


_PAIR = "not (a.ok = b.ok and a.ln = b.ln and a.mass = b.mass)"


@query("j_offset_selfjoin", f"""with {PEAKS} select a.scan, a.ok as a_ok, a.ln as a_ln, b.ok as b_ok, b.ln as b_ln, cast(round(a.mass * 100) as bigint) as a_cents
from peaks a join peaks b on a.scan = b.scan and abs((a.mass + 203.0794 - b.mass) / b.mass) <= 2e-5 and {_PAIR}""")
def j_offset_selfjoin(spark, d):
    p = views.peaks(spark, d).select("scan", "ok", "ln", "mass")
    return bandjoin.offset_pairs(p, ["scan"], "mass", ["ok", "ln", "mass"], 203.0794).select("scan", "a_ok", "a_ln", "b_ok", "b_ln", F.round(F.col("a_mass") * 100).cast(L).alias("a_cents"))


@query("j_complement", f"""with {PEAKS}, t as (select scan, max(mass) as total from peaks group by 1)
select a.scan, a.ok as a_ok, a.ln as a_ln, b.ok as b_ok, b.ln as b_ln from peaks a join peaks b on a.scan = b.scan and {_PAIR} join t on t.scan = a.scan
where total - a.mass > 0 and abs((a.mass + b.mass - total) / total) < 2e-5 and abs((b.mass - (total - a.mass)) / (total - a.mass)) <= 4e-5""")
def j_complement(spark, d):
    p = views.peaks(spark, d).select("scan", "ok", "ln", "mass")
    t = p.groupBy("scan").agg(F.max("mass").alias("total"))
    return bandjoin.complement_pairs(p.join(t, "scan"), ["scan"], "mass", ["ok", "ln", "mass"], "total").select("scan", "a_ok", "a_ln", "b_ok", "b_ln")


_FEATURES = [("HexNAc", 203.07937252), ("Hex", 162.05282342), ("Fuc", 146.0579088), ("G", 57.02146372)]
_FEATURE_SQL = "feat(name, off) as (values " + ", ".join(f"('{n}', {m}::double)" for n, m in _FEATURES) + ")"


@query("j_link_semi", f"""with {RANKED}, {_FEATURE_SQL}
select a.scan, f.name, count(*) as n, count(*) filter (where a.series = 'A' and exists (select 1 from ranked e where e.scan = b.scan and e.ok = b.ok and e.ln = b.ln and e.mass = b.mass and e.series = 'A')) as expected
from ranked a cross join feat f join ranked b on a.scan = b.scan and a.rank >= 1 and b.rank >= 1 and abs((a.mass + f.off - b.mass) / b.mass) <= 2e-5 and {_PAIR} group by all""")
def j_link_semi(spark, d):
    p = views.ranked(spark, d).where("rank >= 1").select("scan", "ok", "ln", "mass", "series")
    pairs = bandjoin.feature_pairs(p, spark.createDataFrame(_FEATURES, "name string, offset double"), ["scan"], "mass", ["ok", "ln", "mass"])
    known = p.where("series = 'A'")
    pairs = bandjoin.explained(pairs, known, {"scan": "scan", "b_ok": "ok", "b_ln": "ln", "b_mass": "mass"})
    return pairs.groupBy("scan", "name").agg(F.count("*").alias("n"), F.count_if((F.col("a_series") == "A") & F.col("expected")).alias("expected"))


_AA = "'G', 'A', 'S', 'P', 'V', 'T', 'C', 'L', 'N', 'D'"
_LINK_SQL = "link(name, kind, off, residue) as (values " + ", ".join(f"('{n}', '{k}', {m!r}::double, {'null' if r is None else repr(r)})" for n, k, m, r in [
    ("HexNAc", "offset", 203.07937252, None), *((b, "link", search.residue_mass(b), b.partition("(")[0]) for b in search.LINKS)]) + ")"
_FLANKED = f"m as (select scan, ok, ln, mass, series, [{_AA}][1 + ok % 10] as flank_n, [{_AA}][1 + ln] as flank_c from ranked where rank >= 1 and series <> 'R')"
_LINKED = f"""with {RANKED}, {_LINK_SQL}, {_FLANKED},
p as (select a.scan, a.ok as a_ok, a.ln as a_ln, a.mass as am, b.ok as b_ok, b.ln as b_ln, b.mass as bm, f.name, f.kind, f.residue from ranked a cross join link f join ranked b on a.scan = b.scan and a.rank >= 1 and b.rank >= 1
 and abs((a.mass + f.off - b.mass) / b.mass) <= 2e-5 and {_PAIR}),
v as (select * from p where kind = 'link' and exists (select 1 from m where m.scan = p.scan and m.ok = a_ok and m.ln = a_ln and m.mass = am and series = 'A' and (flank_n = residue or flank_c = residue))
 and exists (select 1 from m where m.scan = p.scan and m.ok = b_ok and m.ln = b_ln and m.mass = bm and series = 'A'))"""


def _linked(spark, d):
    p = views.ranked(spark, d).where("rank >= 1").select("scan", "ok", "ln", "mass", "series")
    aa = F.array(*(F.lit(x) for x in "GASPVTCLND"))
    m = p.where("series <> 'R'").withColumns({"flank_n": F.get(aa, (F.col("ok") % 10).cast("int")), "flank_c": F.get(aa, F.col("ln").cast("int"))})
    features = search.catalogue(spark, "b").where("kind = 'link' or name = 'HexNAc'")
    return p.drop("series"), m, features


@query("j_link_flank", f"{_LINKED} select scan, a_ok, a_ln, b_ok, b_ln, name from v")
def j_link_flank(spark, d):
    p, m, features = _linked(spark, d)
    ident = ["ok", "ln", "mass"]
    marked = search.beside(p, m.where("series = 'A'"), ["scan"], ident)
    out = bandjoin.feature_pairs(marked, features.where("kind = 'link'"), ["scan"], "mass", ident, residues="flanks").where("b_on")
    return out.select("scan", "a_ok", "a_ln", "b_ok", "b_ln", "name")


@query("j_series_search", f"""{_LINKED}, e as (select * from v union all select p.* from p where kind = 'offset' and exists (select 1 from m where m.scan = p.scan and m.ok = a_ok and m.ln = a_ln and m.mass = am and series = 'A')),
t as (select scan, name, a_ok as ok, a_ln as ln from e union all select scan, name, b_ok, b_ln from e)
select scan, ok, ln, name, count(*) as n from t group by all""")
def j_series_search(spark, d):
    p, m, features = _linked(spark, d)
    edges = search.series_edges(p, m, features, ["scan"], "mass", ["ok", "ln", "mass"], "A")
    return edges.groupBy("scan", "ok", "ln", "name").agg(F.count("*").alias("n"))


_LINK_SQL = ", ".join(f"('{b}', '{b.partition('(')[0]}', {search.residue_mass(b)!r}::double)" for b in search.LINKS)


@query("x_catalogue", f"""with {views.RESIDUES}, k(name, residue, mass) as (values {_LINK_SQL})
select p_partkey, name, round(mass, 6) as mass from residues join k on residue = seq[1]""")
def x_catalogue(spark, d):
    """The links of the catalogue that each part's first residue can make."""
    links = search.catalogue(spark, "b").where("kind = 'link'")
    first = views.residues(spark, d).select("p_partkey", F.get("seq", F.lit(0)).alias("residue"))
    return first.join(links, "residue").select("p_partkey", "name", F.round("offset", 6).alias("mass"))


@query("j_fit_lookup", """with f as (select l_linenumber as fc, cast(l_quantity as int) % 7 + 1 as tc, count(*) as n, round(avg(l_discount), 6) as mu from lineitem group by all having count(*) >= 10)
select l_orderkey % 100 as grp, count(*) as n, round(sum(mu), 4) as mu from lineitem join f on l_linenumber = fc and cast(l_partkey % 11 as int) + 1 = tc group by 1""")
def j_fit_lookup(spark, d):
    li = table(spark, d, "lineitem")
    f = li.groupBy(F.col("l_linenumber").alias("fc"), (F.col("l_quantity").cast("int") % 7 + 1).alias("tc")).agg(F.count("*").alias("n"), F.round(F.avg("l_discount"), 6).alias("mu")).where("n >= 10")
    x = li.select((F.col("l_orderkey") % 100).alias("grp"), F.col("l_linenumber").alias("fc"), ((F.col("l_partkey") % 11).cast("int") + 1).alias("tc"))
    return relations.looked_up(x, f.select("fc", "tc", "mu"), ["fc", "tc"]).groupBy("grp").agg(F.count("*").alias("n"), F.round(F.sum("mu"), 4).alias("mu"))


def _case(value: str, intervals, i: int) -> str:
    return "case " + " ".join(f"when {value} between {a} and {b} then {(a, b)[i]}" for a, b in intervals) + " end"


@query("j_cell_route", f"""with {PSMS} select cast({_case('length', cells.LENGTHS, 0)} as bigint) as length_lo, cast({_case('size', cells.SIZES, 0)} as bigint) as size_lo, charge, mobility, count(*) as n
from psms group by all""")
def j_cell_route(spark, d):
    p = cells.assign(views.psms(spark, d))
    return p.groupBy(F.col("length_lo").cast(L).alias("length_lo"), F.col("size_lo").cast(L).alias("size_lo"), "charge", "mobility").agg(F.count("*").alias("n"))


@query("j_cell_route_nearest", f"""with {PSMS}, s(lo, hi) as (values {', '.join(str(x) for x in cells.SIZES)}),
r as (select ok, ln, sk, mass, size, lo, row_number() over (partition by ok, ln, sk, mass order by case when size between lo and hi then -1 else abs(size - (lo + hi) / 2.0) end, lo) as r from psms, s)
select size, cast(lo as bigint) as size_lo, count(*) as n from r where r = 1 group by all""")
def j_cell_route_nearest(spark, d):
    p = cells.assign(views.psms(spark, d), nearest=True)
    return p.groupBy("size", F.col("size_lo").cast(L).alias("size_lo")).agg(F.count("*").alias("n"))


def _grid_subset(spark):
    g = cells.grid(spark)
    return g.where("(length_lo + size_lo + charge) % 3 = 0 and not (charge = 3 and mobility = 'partial') and glycan_count = 1 + length_lo % 2")


@query("j_cell_typecount", f"""with {PSMS}, lens(length_lo, length_hi) as (values {', '.join(str(x) for x in cells.LENGTHS)}), sizes(size_lo, size_hi) as (values {', '.join(str(x) for x in cells.SIZES)}),
ch(c_charge) as (values (2), (3), (4), (5), (6)), mob(c_mob, mo) as (values ('mobile', 0), ('partial', 1), ('immobile', 2)), ty(c_type) as (values (1), (2), (3)), co(c_count) as (values (1), (2)),
grid as (select * from lens, sizes, ch, mob, ty, co where (length_lo + size_lo + c_charge) % 3 = 0 and not (c_charge = 3 and c_mob = 'partial') and c_count = 1 + length_lo % 2),
q as (select distinct length, size, charge, mobility, glycan_type, glycan_count from psms),
l1 as (select *, row_number() over (partition by length, size, charge, mobility, glycan_type, glycan_count order by case when length between length_lo and length_hi then -1 else abs(length - (length_lo + length_hi) / 2.0) end, length_lo) as r from q, (select distinct length_lo, length_hi from grid)),
l2 as (select l1.* exclude (r), g.size_lo, g.size_hi, row_number() over (partition by length, size, charge, mobility, glycan_type, glycan_count order by case when size between size_lo and size_hi then -1 else abs(size - (size_lo + size_hi) / 2.0) end, size_lo) as r from l1 join (select distinct length_lo, size_lo, size_hi from grid) g using (length_lo) where r = 1),
l3 as (select l2.* exclude (r), g.c_charge, row_number() over (partition by length, size, charge, mobility, glycan_type, glycan_count order by abs(charge - c_charge), c_charge) as r from l2 join (select distinct length_lo, size_lo, c_charge from grid) g using (length_lo, size_lo) where r = 1),
l4 as (select l3.* exclude (r), g.c_mob, row_number() over (partition by length, size, charge, mobility, glycan_type, glycan_count order by abs(case mobility when 'mobile' then 0 when 'partial' then 1 else 2 end - mo), c_mob) as r from l3 join (select distinct length_lo, size_lo, c_charge, c_mob, mo from grid) g using (length_lo, size_lo, c_charge) where r = 1),
l5 as (select l4.* exclude (r), g.c_type, g.c_count, row_number() over (partition by length, size, charge, mobility, glycan_type, glycan_count order by abs(glycan_count - c_count) + case when glycan_type = c_type then 0 else 1 end, c_type, c_count) as r from l4 join grid g using (length_lo, size_lo, c_charge, c_mob) where r = 1)
select length_lo || ':' || l5.length_hi || ':' || size_lo || ':' || l5.size_hi || ':' || c_charge || ':' || c_mob || ':' || c_type || ':' || c_count as cell, count(*) as n
from psms join l5 using (length, size, charge, mobility, glycan_type, glycan_count) where r = 1 group by 1""")
def j_cell_typecount(spark, d):
    return cells.route(views.psms(spark, d), _grid_subset(spark)).groupBy("cell").agg(F.count("*").alias("n"))


@query("j_adjacent_cells", f"""with {PSMS}, c as (select mobility, charge, count(*) as n from psms where charge between 2 and 6 group by all)
select c.mobility, c.charge, cast(sum(o.n) as bigint) as n from c join c o on c.mobility = o.mobility and (o.charge = c.charge or o.charge in (3, 4, 5)) group by all""")
def j_adjacent_cells(spark, d):
    c = views.psms(spark, d).where(F.col("charge").between(2, 6)).groupBy("mobility", "charge").agg(F.count("*").alias("n"))
    near = cells.adjacent(c.select("mobility", "charge"))
    other = c.select("mobility", F.col("charge").alias("neighbour_charge"), "n")
    return near.join(other, ["mobility", "neighbour_charge"]).groupBy("mobility", "charge").agg(F.sum("n").alias("n"))


@query("j_all_products", """with f as (select p_partkey from part), o as (select l_partkey, l_linenumber, max(l_extendedprice) as i from lineitem group by all)
select p_partkey, charge, coalesce(i, 1.0) as intensity from f cross join (select unnest(range(1, 6)) as charge) left join o on l_partkey = p_partkey and l_linenumber = charge""")
def j_all_products(spark, d):
    from ..functions.chem import all_products

    f = table(spark, d, "part").select("p_partkey")
    m = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_linenumber").alias("charge"), F.col("l_extendedprice").alias("intensity"))
    return all_products(f, m, ["p_partkey"]).select("p_partkey", F.col("charge").cast(L).alias("charge"), "intensity")


@query("j_best_precursor", """select o_custkey, o_orderstatus, o_orderkey, o_totalprice as best from (
  select *, row_number() over (partition by o_custkey, o_orderstatus order by o_totalprice desc, o_orderkey) as r from orders) where r = 1""")
def j_best_precursor(spark, d):
    return peaks.best_of_each(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"], "o_totalprice", "o_orderkey").select("o_custkey", "o_orderstatus", "o_orderkey", F.col("o_totalprice").alias("best"))


@query("j_ecdf_asof", """with p as (select distinct event_type, value as x, cume_dist() over (partition by event_type order by value) as y from events)
select e.event_id, round(coalesce(p.y, 0), 6) as ecdf from events e asof left join p on e.event_type = p.event_type and e.value * 0.5 >= p.x""")
def j_ecdf_asof(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    points = stats.ecdf(e, "value", ["event_type"]).select("event_type", "value", "ecdf").distinct()
    out = stats.step_lookup(points, "value", "ecdf", e.withColumn("half", F.col("value") * 0.5).drop("value"), "half", ["event_type"], out="y")
    return out.select("event_id", F.round("y", 6).alias("ecdf"))


@query("w_ecdf", "select value, round(max(c), 6) as ecdf from (select value, cume_dist() over (order by value) as c from events) group by 1")
def w_ecdf(spark, d):
    return stats.ecdf_table(table(spark, d, "events"), "value").select("value", F.round("ecdf", 6).alias("ecdf"))


@query("w_partition_key", f"with {PSMS} select distinct charge, mobility, glycan_type, dense_rank() over (order by charge, mobility, glycan_type) - 1 as partition_key from psms")
def w_partition_key(spark, d):
    p = views.psms(spark, d).select("charge", "mobility", "glycan_type").distinct()
    return cells.partition_key(p, ["charge", "mobility", "glycan_type"]).select("charge", "mobility", "glycan_type", F.col("partition_key").cast(L).alias("partition_key"))


@query("x_grid", f"""with c as (select distinct l_linenumber as charge from lineitem), s as (select distinct p_size // 10 as lo from part)
select charge, lo as length_lo, {len(cells.SIZES) * 18}::bigint as cells, {sum(a for a, _ in cells.SIZES) * 18}::bigint as size_sum from c, s""")
def x_grid(spark, d):
    """A grid over the charges and lengths that the tables have."""
    charges = tuple(sorted(r[0] for r in table(spark, d, "lineitem").select("l_linenumber").distinct().collect()))
    lengths = [(r[0], r[0] + 1) for r in table(spark, d, "part").select(F.expr("p_size div 10").cast("int")).distinct().collect()]
    g = cells.grid(spark, lengths=lengths, charges=charges)
    return g.groupBy("charge", "length_lo").agg(F.count("*").alias("cells"), F.sum("size_lo").cast(L).alias("size_sum"))


@query("w_neighbour_residues", """with {0}, e as (select p_partkey, unnest(seq) as aa, generate_subscripts(seq, 1) as i from residues)
select p_partkey, i, aa, lag(aa, 2) over w as back2, lead(aa, 1) over w as next1 from e window w as (partition by p_partkey order by i)""".format(views.RESIDUES))
def w_neighbour_residues(spark, d):
    e = views.residues(spark, d).select("p_partkey", "seq", F.posexplode("seq").alias("i", "aa"))
    return e.select("p_partkey", (F.col("i") + 1).cast(L).alias("i"), "aa", F.get("seq", F.col("i") - 2).alias("back2"), F.get("seq", F.col("i") + 1).alias("next1"))

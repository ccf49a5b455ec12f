"""Queries on tables that hold what the given ones seldom do: values of 0, ions that do not vary."""

import math
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ionframe.functions import prefix, stats
from ionframe.operators import bandjoin, cells, glm, partitioned, relation_training, search, select, training
from ionframe.plans import registry, structures, views
from ionframe.sources import tables
from tests.conftest import DATA


def _rows(spark, folder, name, tables):
    """The query's rows and those of its SQL, in order."""
    c = duckdb.connect()
    for t, sql in tables.items():
        c.execute(f"copy ({sql}) to '{folder}/{t}.parquet' (format parquet)")
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = registry.queries()[name](spark, str(folder))
    rel = c.execute(f"select {', '.join(df.columns)} from ({registry.oracle_sql()[name]})").fetchall()
    order = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    return order(df.collect()), order(rel)


_EVENTS = "select * from (values (1, 1, 'click', 0.0, timestamp '2024-01-01 00:00:00'), (2, 1, 'view', 3.0, timestamp '2024-01-01 00:00:01'), (3, 1, 'click', 0.0, timestamp '2024-01-01 00:00:02'), (101, 1, 'click', 4.0, timestamp '2024-01-01 00:00:03'), (102, 1, 'view', 1.0, timestamp '2024-01-01 00:00:04'), (201, 2, 'view', 1.0, timestamp '2024-01-01 00:00:05')) e(event_id, user_id, event_type, value, ts)"


@pytest.mark.parametrize("name", ["o_oxonium_norm", "x_ratio_bucket_hist"])
def test_values_of_zero(spark, tmp_path, name):
    got, want = _rows(spark, tmp_path, name, {"events": f"select event_id::bigint as event_id, user_id::bigint as user_id, event_type, value::double as value, ts from ({_EVENTS})"})
    assert got == want and not any(isinstance(v, float) and not math.isfinite(v) for r in got for v in r)


def test_glycan_ions_that_do_not_vary(spark, tmp_path):
    li = """select 33647::bigint as l_orderkey, p::bigint as l_partkey, s::bigint as l_suppkey, n::bigint as l_linenumber, q::double as l_quantity, x::double as l_extendedprice, c::double as l_discount, t::double as l_tax, f as l_returnflag, 'O' as l_linestatus
    from (values (17388, 530, 2, 49.0, 90633.84, 0.10, 0.00, 'R'), (758, 948, 3, 7.0, 82011.17, 0.07, 0.02, 'N'), (10263, 556, 1, 34.0, 58722.58, 0.07, 0.00, 'N'), (6692, 425, 1, 34.0, 6510.19, 0.05, 0.00, 'R')) l(p, s, n, q, x, c, t, f)"""
    got, want = _rows(spark, tmp_path, "s_model_glycan", {"lineitem": li})
    assert got == want == [(33647, 11.7)]


def test_second_run_of_q_values_reads_a_table(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id", "id % 2 as g", "(id * 7919 % 1000) / 10.0 as s", "id % 3 = 0 as decoy")
    want = sorted(select.q_values(df, "s", "decoy", ["g"]).collect())
    monkeypatch.setattr(prefix, "LARGE", 100)
    out = select.q_values(df, "s", "decoy", ["g"])
    assert "/fdr-" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(out.collect()) == want
    # many cuts, found in two steps
    r = prefix.ranged(df, ["g"], "s", 37).groupBy("g", "_range").agg({"s": "min"}).orderBy("g", "_range").collect()
    assert len(r) > 60 and all(a["min(s)"] < b["min(s)"] for a, b in zip(r, r[1:]) if a.g == b.g)


def test_short_rows_are_dealt_before_long_ones_are_made(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert views.residues(spark, DATA).rdd.getNumPartitions() == n
    s = structures.part_structures(spark, DATA)
    assert training.fragments(s).rdd.getNumPartitions() in (n, 2 * n)


def test_ranked_peaks_take_more_tasks_as_they_grow(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS_OF_TASK", 500)
    rows = views.table(spark, DATA, "lineitem").count()
    assert views.ranked(spark, DATA).rdd.getNumPartitions() == -(-rows // 500)


def test_band_join_copies_the_right_side_only(spark):
    left, right = spark.range(50).selectExpr("id as k", "id * 1.0 as l"), spark.range(40).selectExpr("id as k", "id * 1.00001 as r")
    plan = bandjoin.band_join(left, right, ["k"], F.col("l"), F.col("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and plan.index("Generate explode") > plan.index(" AS l#")


def test_rows_are_not_dealt_by_the_cell_of_their_fit(spark, monkeypatch):
    fits = spark.createDataFrame([("x", [0.5, -0.25], 0), ("y", [0.0, 1.0], 1)], "cell string, coef array<double>, partition_key int")
    rows = spark.range(60).selectExpr("id div 3 as scan", "if(id div 3 % 5 = 0, 'y', 'x') as cell", "array(cast(id % 2 as int)) as idx", "cast(1 + id % 7 as double) as intensity", "20D as total")
    want = None
    for most in (glm.BROADCAST_COEFFICIENTS, 0):
        monkeypatch.setattr(glm, "BROADCAST_COEFFICIENTS", most)
        for p in (glm.scored_by_models(rows, fits, ["cell"], ["cell", "scan"]), glm.correlations(rows, fits, ["cell"], ["scan"])):
            plan = p._jdf.queryExecution().executedPlan().toString()
            windows = plan[: plan.index("Window")] + plan[plan.index("Window") :].partition("Join")[0]
            assert "hashpartitioning(scan" in windows or "hashpartitioning(cell#" in windows and ", scan#" in windows
            assert not most or "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        got = sorted((r.scan, round(r.yhat, 9)) for r in glm.scored_by_models(rows, fits, ["cell"], ["scan"]).collect())
        assert len(got) == 60 and want in (None, got)
        want = got


@pytest.mark.parametrize("shuffled", [False, True])
def test_step_over_sets_of_features_has_the_sums_over_rows(shuffled):
    rng = np.random.default_rng(3)
    sets = [[0, 3], [1, 3, 3], [2], []]
    size = rng.integers(1, 9, 40)
    own = rng.integers(0, 4, size.sum())
    idx = [sets[i] for i in own]
    if shuffled:  # equal sets in another order are sets of their own
        idx = [i[::-1] if k % 2 else i for k, i in enumerate(idx)]
    starts = np.cumsum(size) - size
    y = rng.random(len(own)) * (own != 2)
    n = np.add.reduceat(y, starts) + 1
    s = glm.Spectra(np.array([j for i in idx for j in i], np.int64), np.cumsum([len(i) for i in idx]), starts, y / np.repeat(n, size), 0.5 + rng.random(len(own)) / 2, n)
    features, of, mine = s.patterns
    assert len(set(mine)) == (len(own) if shuffled else 4)
    assert all(features[of == m].tolist() == i for m, i in zip(mine, idx))
    x = np.zeros((len(own), 5))
    for k, i in enumerate(idx):
        for j in i:
            x[k, j] += 1
    per = lambda v: np.repeat(v, size)
    for beta in (None, np.array([0.3, -0.2, 0.1, 0.4, 1.0])):
        z, h, dev = glm._step(s, beta, 5)
        if beta is None:
            mu = (s.y * per(n) + 0.5) / per(1 + n + 0.5 * size)
            eta = np.log(mu / per(1 - np.add.reduceat(mu, starts)))
        else:
            eta = x @ beta
            mu = np.exp(eta) / per(1 + np.add.reduceat(np.exp(eta), starts))
        mean = np.add.reduceat(mu[:, None] * x, starts)
        assert np.allclose(z, x.T @ (per(n) * (s.y - mu + s.r * mu * eta - mu * per(np.add.reduceat(mu * eta, starts)))))
        assert np.allclose(h, x.T @ ((per(n) * s.r * mu)[:, None] * x) - mean.T @ (n[:, None] * mean))
        seen = s.y > 0
        rest, left = 1 - np.add.reduceat(s.y, starts), 1 - np.add.reduceat(mu, starts) + 1e-6
        assert math.isclose(dev, 2 * (per(n) * s.r * s.y)[seen] @ np.log(s.y[seen] / mu[seen]) + 2 * (n * rest) @ np.log(rest / left))


def test_titles_of_shared_fits_are_not_dealt_by_cell(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS_OF_TASK", 100)
    df = spark.range(2000).selectExpr("if(id < 0, 'h', 'g') as cell", "cast(3 + id % 2 as int) as charge", "id div 2 as title")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = relation_training.shared_fits(df, ["cell"])
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and re.search(r"hashpartitioning\(cell#\d+, title#\d+L, 20\)", plan)
        assert sorted(map(tuple, got.collect())) == [("g", 3, 3), ("g", 4, 3)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_rows_of_all_parts_are_made_in_one_pass(spark):
    ddl = "scan int, peak_index int, intensity double, series string"
    matched = spark.createDataFrame([(1, 1, 5.0, "b"), (1, 1, 5.0, "stub_glycopeptide"), (1, 2, 3.0, "y"), (1, 3, 2.0, "oxonium_ion"), (1, 4, 7.0, None), (1, 5, 1.0, "c"), (2, 1, 4.0, "y"), (4, 1, 1.0, "b")], ddl)
    totals = spark.createDataFrame([(1, 30.0), (2, 1.0), (3, 2.0)], "scan int, total double")
    parts = {"peptide": ["b", "y"], "glycan": ["stub_glycopeptide"]}
    rows = lambda df: sorted(((r.scan, r.peak_index or 0, r.series, r.intensity, r.total) for r in df.collect()))
    got = glm.part_observations(matched, totals, ["scan"], ["peak_index"], "intensity", "series", parts)
    for part, only in parts.items():
        want = rows(glm.observations(matched, totals, ["scan"], ["peak_index"], "intensity", "series", only=only))
        assert len(want) > 3 and rows(got.where(F.col("part") == part)) == want


def test_rows_of_part_fits_are_written_once(spark, monkeypatch):
    seen, fit = [], partitioned.fit_grouped
    monkeypatch.setattr(partitioned, "fit_grouped", lambda rows, *a: (seen.append(rows._jdf.queryExecution().executedPlan().toString()), fit(rows, *a))[1])
    assert training.train_partitioned(spark, structures.spectra(spark, DATA)).count()
    assert "FileScan" in seen[0] and "Join" not in seen[0] and "Exchange" not in seen[0]


def test_steps_are_looked_up_in_groups_that_are_cut_into_ranges(spark, duck, monkeypatch):
    points = spark.range(400).selectExpr("id % 3 as g", "cast(id * 37 % 101 as double) as x", "cast(id as double) as y").groupBy("g", "x").agg(F.max("y").alias("y"))
    at = spark.range(900).selectExpr("id", "id % 4 as g", "id * 7 % 120 - 5.5 as q")
    want = sorted(stats.step_lookup(points, "x", "y", at, "q", ["g"]).collect())
    monkeypatch.setattr(prefix, "LARGE", 50)
    assert sorted(stats.step_lookup(points, "x", "y", at, "q", ["g"]).collect()) == want
    got = sorted(map(tuple, registry.queries()["j_ecdf_asof"](spark, DATA).collect()))
    assert got == sorted(duck.execute(registry.oracle_sql()["j_ecdf_asof"]).fetchall())


def test_spectra_of_cells_without_a_model_are_routed_to_the_nearest(spark, monkeypatch):
    fits = spark.createDataFrame([("2-HIGH", [0.5, -0.25], 0), ("5-LOW", [0.0, 1.0], 1)], "cell string, coef array<double>, partition_key int")
    own = spark.createDataFrame([("1-URGENT",), ("2-HIGH",), ("3-MEDIUM",), ("4-OTHER",), ("5-LOW",), (None,), ("none",)], "cell string")
    routes = cells.nearest_route(own, fits, "cell", lambda c: F.substring(c, 1, 1).try_cast("int"))
    assert dict(map(tuple, routes.collect())) == {"1-URGENT": "2-HIGH", "2-HIGH": "2-HIGH", "3-MEDIUM": "2-HIGH", "4-OTHER": "5-LOW", "5-LOW": "5-LOW", None: "2-HIGH", "none": "2-HIGH"}
    whole = {r.scan: r for r in registry.queries()["m_routed_scores"](spark, DATA).collect()}
    fit = partitioned.fit_grouped
    failed = lambda *a: fit(*a).withColumn("coef", F.when(F.col("cell") != "3-MEDIUM", F.col("coef")))
    monkeypatch.setattr(partitioned, "fit_grouped", failed)
    got = {r.scan: r for r in registry.queries()["m_routed_scores"](spark, DATA).collect()}
    assert got.keys() == whole.keys() and len(got) > 1000
    names = sorted(r[0] for r in views.table(spark, DATA, "orders").select("o_orderpriority").distinct().collect())
    keys = {r.o_orderkey: names.index(r.o_orderpriority) for r in views.table(spark, DATA, "orders").collect()}
    assert all(whole[s].partition_key == keys[s] and got[s].partition_key == (1 if keys[s] == 2 else keys[s] - (keys[s] > 2)) for s in got)
    assert all(r.correlation is None or -1.0001 <= r.correlation <= 1.0001 for r in got.values()) and sum(r.correlation is not None for r in got.values()) > 500


def test_matches_carry_their_features_and_are_dealt_by_spectrum_once(spark, tmp_path):
    model = "LabileMonosaccharideAwareModel"
    scans = tables.materialize(structures.spectra(spark, DATA).limit(60), "some-spectra")
    plain, own = training.matches(scans), training.matches(scans, model=model)
    assert own.drop(f"idx_{model}").exceptAll(plain.select(own.columns[:-1])).isEmpty() and own.count() == plain.count() > 1000
    cols = [*training.KEYS, "peak_index", "kind", "name", "intensity", "total", "reliability", "idx"]
    for kept in ({}, {"only": ["b", "y"]}, {"parts": training.PARTS}):
        names = cols + ["part"] * ("parts" in kept)
        want, got = (training.observed(scans, m, model, **kept).select(names) for m in (plain, own))
        assert got.count() == want.count() and got.exceptAll(want).isEmpty()
    # matches of another model's features are encoded anew
    assert "Exchange" in training.observed(scans, own, "FragmentType")._jdf.queryExecution().executedPlan().toString()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = training.observed(scans, own, model)._jdf.queryExecution().executedPlan().toString()
        assert "structure#" in plan and not re.search(r"hashpartitioning\(structure#\d+, name#\d+", plan)
        fits = spark.createDataFrame([(0, 100, 0, 100, 3, "mobile", 1, 1, [0.1] * 400, False)], ", ".join(f"{c} {'string' if c == 'mobility' else 'int'}" for c in training.SPEC) + ", coef array<double>, mismatch boolean")
        plan = training.predict(scans, fits, model, matched=own, mixture=True)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Window") >= 2 and "Exchange" not in plan[: plan.index("SortMergeJoin")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_best_relations_are_least_numbers(spark):
    fits = "map('Hex:1:1', struct(0.5D as mu, 0.1D as nu), 'Fuc:1:1', struct(0.5D as mu, 0.1D as nu), 'Hex:1:2', struct(0.5D as mu, 0D as nu))"
    known = spark.sql(f"select 0 as _c, 'b' as series, 0.25D as gamma, {fits} as fits union all select 0, 'y', null, null")
    gammas, places = relation_training._slot_order(known)
    assert {r._slot: r._places for r in places.collect()} == {"Hex:1:2": {"b": 1, "y": 3}, "Fuc:1:1": {"b": 2, "y": 1}, "Hex:1:1": {"b": 3, "y": 2}}
    rates = {r.series: (r.gamma, r._rates) for r in gammas.collect()}
    assert rates["b"][0] == 0.25 and rates["y"][0] is None and len(rates["y"][1]) == 3
    assert rates["b"][1] == pytest.approx([math.log(5e-324) - math.log(0.5), math.log(0.2), math.log(0.2)])
    plan = registry.queries()["m_reliability_scores"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "_fits" not in plan and "_places" in plan


@pytest.mark.parametrize("name", ["j_link_flank", "j_series_search"])
def test_links_are_chosen_before_peaks_are_copied(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    got = sorted(map(tuple, df.collect()))
    assert got == sorted(duck.execute(f"select {', '.join(df.columns)} from ({registry.oracle_sql()[name]})").fetchall())
    # flanks are joined below what copies peaks, and no join by the residue follows
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and plan.count("Generate explode(filter(") == 1
    assert "flanks" in plan[plan.index("Generate explode(filter(") :]


def test_links_of_peaks_without_residues_or_partners(spark):
    peaks = spark.createDataFrame([(1, 1, 100.0), (1, 2, 157.02146372), (1, 3, 171.03711379), (1, 4, 303.07937252), (1, 4, 303.07937252)], "scan int, id int, mass double")
    matches = spark.createDataFrame([(1, 1, "A", "G", None), (1, 1, "A", "A", "G"), (1, 3, "A", None, None), (1, 2, "B", "G", "G")], "scan int, id int, series string, flank_n string, flank_c string")
    features = search.catalogue(spark, "b").where("name in ('G', 'A', 'HexNAc')")
    got = sorted((r.a_id, r.b_id, r.name, r.id) for r in search.series_edges(peaks, matches, features, ["scan"], "mass", ["id"], "A").collect())
    # the partner of G is explained by another series only, and the repeated peak counts twice
    assert got == [(1, 3, "A", 1), (1, 3, "A", 3), (1, 4, "HexNAc", 1), (1, 4, "HexNAc", 1), (1, 4, "HexNAc", 4), (1, 4, "HexNAc", 4)]

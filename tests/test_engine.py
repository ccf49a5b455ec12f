"""Hand-made cases: cut points, ranks, precedence, intervals, joins, fits, sources."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionframe.functions import chem, encode, scalar, stats
from ionframe.operators import bandjoin, cells, glm, peaks, score, select, training
from ionframe.sources import codecs, mgf


def test_ratio_cut_points(spark):
    r = [5, 2.5, 1.7, 1.3, 1.0, 0.8, 0.6, 0.4, 0.2, 0.1]
    df = spark.createDataFrame([(float(x), 1.0) for x in r] + [(1.0, 0.0)], "a double, b double")
    assert [x.v for x in df.select(scalar.ratio_bucket("a", "b").alias("v")).collect()] == [-4, -3, -2, -1, 0, 1, 2, 3, 4, 5, None]


def test_rank_histogram(spark):
    df = spark.createDataFrame([(1, i, 100.0 + i) for i in range(198)] + [(2, i, 100.0 + i if i < 15 else 50.0) for i in range(20)], "s int, i int, x double")
    got = {(r.s, r["rank"]): r["count"] for r in peaks.intensity_rank(df, ["s"], "x", ["i"]).groupBy("s", "rank").count().collect()}
    assert {k: v for (s, k), v in got.items() if s == 1} == {10: 9, **{k: 10 for k in range(2, 10)}, 1: 70, -1: 39}
    assert {k: v for (s, k), v in got.items() if s == 2} == {10: 9, 9: 6, 0: 5}


def test_bond_precedence(spark):
    df = spark.createDataFrame([("P", "G"), ("G", "P"), ("K", "R"), ("A", "S"), ("N", "H"), (None, "P")], "n string, c string")
    assert [tuple(r.b) for r in df.select(scalar.amide_bond("n", "c").alias("b")).collect()] == [(0, 7), (7, 0), (7, 7), (7, 2), (4, 7), (7, 0)]


def test_typecast(spark):
    df = spark.createDataFrame([("12",), ("1.5",), ("True",), ("null",), ("None",), (None,), ("x",)], "v string")
    assert [r.k for r in df.select(scalar.typecast("v")["kind"].alias("k")).collect()] == ["int", "double", "bool", "null", "str", "null", "str"]


def test_model_widths():
    want = {"FragmentType": 43, "ProlineSpecializingModel": 53, "StubGlycopeptideCompositionModel": 76, "StubGlycopeptideFucosylationModel": 111, "NeighboringAminoAcidsModel": 127, "NeighboringAminoAcidsModelDepth2": 143, "NeighboringAminoAcidsModelDepth3": 159, "NeighboringAminoAcidsModelDepth4": 175, "CleavageSiteCenterDistanceModel": 165, "StubChargeModel": 288, "LabileMonosaccharideAwareModel": 323, "AmideBondCrossproductModel": 204}
    assert {m: encode.width(m) for m in want} == want
    assert len(encode.feature_names("StubChargeModel")) == 288


def test_band_join_is_the_theta_join(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.randint(0, 2), 500 * (1 + 1e-5 * rnd.randint(0, 40))) for i in range(150)] + [(900, 0, 0.0), (901, 1, -3.0), (902, 0, None)]
    p = spark.createDataFrame(rows, "id int, scan int, mass double")
    got = {(r.a_id, r.b_id) for r in bandjoin.offset_pairs(p, ["scan"], "mass", ["id"], 0.01).collect()}
    want = {(a[0], b[0]) for a, b in itertools.product(rows, rows) if a[0] != b[0] and a[1] == b[1] and a[2] and b[2] and b[2] > 0 and a[2] + 0.01 > 0 and abs((a[2] + 0.01 - b[2]) / b[2]) <= 2e-5}
    assert got == want and want


def test_feature_wildcards(spark):
    p = spark.createDataFrame([(1, 1, 500.0, 2, 10.0), (2, 1, 557.02146372, 1, 30.0), (3, 1, 557.0214637, 3, 5.0)], "id int, scan int, mass double, charge int, intensity double")
    f = spark.createDataFrame([("any", 57.02146372, None, None, 999), ("down", 57.02146372, 2, 1, None), ("weak", 57.02146372, None, None, -2)], "name string, offset double, from_charge int, to_charge int, intensity_ratio int")
    got = {(r.name, r.b_id) for r in bandjoin.feature_pairs(p, f, ["scan"], "mass", ["id"]).collect()}
    assert got == {("any", 2), ("any", 3), ("down", 2), ("weak", 3)}


def test_complement_join(spark):
    rows = [(i, 1, m, 1000.0) for i, m in enumerate([400.0, 600.0, 600.01, 600.05, 500.0, 500.004, 1000.0])]
    p = spark.createDataFrame(rows, "id int, scan int, mass double, total double")
    got = {(r.a_id, r.b_id) for r in bandjoin.complement_pairs(p, ["scan"], "mass", ["id"], "total").collect()}
    want = {(a[0], b[0]) for a, b in itertools.product(rows, rows) if a[0] != b[0] and 1000 - a[2] > 0 and abs(a[2] + b[2] - 1000) / 1000 < 2e-5 and abs(b[2] - (1000 - a[2])) / (1000 - a[2]) <= 4e-5}
    assert got == want and want


def test_intervals_and_routing(spark):
    df = spark.createDataFrame([(5, 1), (6, 5), (60, 25)], "length int, size int")
    assert [(r.length_lo, r.length_hi, r.size_lo) for r in cells.assign(df).collect()] == [(0, 5, 1), (5, 10, 1), (None, None, None)]
    assert [(r.length_lo, r.length_hi, r.size_lo) for r in cells.assign(df, nearest=True).collect()][2] == (45, 50, 17)
    assert cells.grid(spark).count() == 4500 and cells.grid(spark, sizes=cells.ONE_SIZE).count() == 900


def test_neighbour_cells(spark):
    df = spark.createDataFrame([(4,), (2,), (6,)], "charge int")
    got = {}
    for r in cells.adjacent(df).collect():
        got.setdefault(r.charge, set()).add(r.neighbour_charge)
    assert got == {4: {3, 4, 5}, 2: {2, 3, 4, 5}, 6: {6, 3, 4, 5}}


def test_missing_mobility_goes_to_the_first_key(spark):
    g = cells.grid(spark).where("mobility <> 'partial'")
    p = spark.createDataFrame([(7, 3, 3, "partial", 1, 1), (7, 3, None, "mobile", 3, 2)], "length int, size int, charge int, mobility string, glycan_type int, glycan_count int")
    assert [r.cell for r in cells.route(p, g).orderBy("mobility").collect()] == ["5:10:1:5:4:mobile:3:2", "5:10:1:5:3:immobile:1:1"]


def test_ecdf(spark):
    df = spark.createDataFrame([(3.0,), (3.0,), (1.0,), (4.0,)], "x double")
    assert {r.x: r.ecdf for r in stats.ecdf(df, "x").collect()} == {3.0: 0.75, 1.0: 0.25, 4.0: 1.0}
    at = spark.createDataFrame([("g", 3.0), ("g", 55.0), ("g", 0.5), ("g", 1.5)], "g string, q double")
    points = stats.ecdf_table(df, "x").withColumn("g", F.lit("g"))
    assert {r.q: r.value for r in stats.step_lookup(points, "x", "ecdf", at, "q", ["g"]).collect()} == {3.0: 0.75, 55.0: 1.0, 0.5: 0.0, 1.5: 0.25}


def test_correlation_without_variance_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert df.agg(stats.correlation("x", "y").alias("r")).first().r is None
    assert abs(df.agg(stats.correlation("x", "y", 1e-12).alias("r")).first().r) < 1e-6


def test_folds(spark):
    df = spark.range(10).withColumn("g", F.lit(1))
    assert sorted(r["count"] for r in select.folds(df, 3, ["id"], ["g"]).groupBy("fold").count().collect()) == [3, 3, 4]


def test_fit_has_no_gradient_and_large_fit_agrees(spark):
    rng = np.random.default_rng(3)
    rows = [("c", s, sorted({int(rng.integers(0, 4)), 4 + int(rng.integers(0, 3))}), float(rng.integers(1, 200)), 1000.0, 1.0) for s in range(40) for _ in range(4)]
    df = spark.createDataFrame(rows, "cell string, scan int, idx array<int>, intensity double, total double, reliability double")
    fit = glm.fit_cells(df, ["cell"], ["scan"], 7, "cell string").first()
    beta = np.array(fit.coef)
    grad = -beta
    for s in range(40):
        own = [r for r in rows if r[1] == s]
        x = glm._dense([r[2] for r in own], 7)
        mu = np.exp(x @ beta) / (1 + np.exp(x @ beta).sum())
        grad += 1000 * x.T @ (np.array([r[3] for r in own]) / 1000 - mu)
    assert fit.converged and np.abs(grad).max() < 1e-3
    large = glm.fit_large(df, ["scan"], 7)
    assert np.allclose(large["coef"], beta, atol=1e-8)


def test_failed_fit_is_kept(spark):
    df = spark.createDataFrame([("c", 1, [0], 0.0, 0.0, 1.0)], "cell string, scan int, idx array<int>, intensity double, total double, reliability double")
    r = glm.fit_cells(df, ["cell"], ["scan"], 2, "cell string").first()
    assert r.coef is None and not r.converged


def test_predictions_sum_below_one(spark):
    df = spark.createDataFrame([(1, 800.0), (1, 2.0), (2, -5.0)], "s int, eta double")
    assert all(0 <= r.t <= 1 for r in glm.softmax(df, ["s"], "eta").groupBy("s").agg(F.sum("yhat").alias("t")).collect())


def test_kmeans_and_selection(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.8,), (0.9,), (None,)], "v double")
    assert np.allclose(select.kmeans_1d(df, "v"), [0.15, 0.85])


def test_q_values(spark):
    df = spark.createDataFrame([("g", 5.0, False), ("g", 4.0, True), ("g", 3.0, False), ("g", 2.0, False)], "g string, s double, d boolean")
    assert {r.s: round(r.q, 4) for r in select.q_values(df, "s", "d", ["g"]).collect()} == {5.0: 0.0, 4.0: 0.3333, 3.0: 0.3333, 2.0: 0.3333}


MGF = """BEGIN IONS
TITLE=a.1
PEPMASS=914.5 792599.0
CHARGE=5+
RTINSECONDS=8090.5
STRUCTURE=N(N-Glycosylation)ITM(Oxidation)K{Hex:9; HexNAc:3}
MASS_SHIFT=Unmodified
MS2_SCORE=8.1
Q_VALUE=0.04
ACTIVATION_METHOD=hcd
ACTIVATION_METHOD=unknown dissociation
IS_HCD=True
BASE PEAK M/Z=3.5
120.08 8482.25 1
204.5 100.0 2
END IONS

BEGIN IONS
TITLE=a.2
PEPMASS=500.1
MS2_SCORE=3.0
Q_VALUE=0.5
MASS_SHIFT=Unmodified
300.0 5.0 1
END IONS
"""


def test_mgf_reader(spark, tmp_path):
    (tmp_path / "x.mgf").write_text(MGF)
    s = mgf.read_scans(spark, str(tmp_path)).orderBy("scan_index").collect()
    assert len(s) == 2 and s[0].title == "x.mgf.a.1" and s[0].precursor_charge == 5 and s[0].activation == "hcd" and s[0].precursor_intensity == 792599.0
    assert s[0].annotations == {"base peak m/z": "3.5"} and len(s[0].peaks) == 2 and s[1].precursor_charge is None
    p = mgf.peaks(mgf.read_scans(spark, str(tmp_path))).where("title = 'x.mgf.a.1'").orderBy("peak_index").collect()
    assert math.isclose(p[1].neutral_mass, 204.5 * 2 - 2 * scalar.PROTON)
    st = mgf.structures(mgf.read_scans(spark, str(tmp_path))).first()
    assert [r.aa for r in st.residues] == list("NITMK") and st.residues[3].mods == ["Oxidation"] and st.glycan == {"Hex": 9, "HexNAc": 3} and st.glycan_size == 12 and [tuple(g) for g in st.glycosylation] == [(0, 1)]
    kept = mgf.training_data(spark, str(tmp_path), 5.0, 0.05)
    assert [r.title for r in kept.collect()] == ["x.mgf.a.1"]
    with pytest.raises(ValueError):
        mgf.training_data(spark, str(tmp_path), 50.0, 0.05)
    mgf.write_scans(kept, str(tmp_path / "out"), ["precursor_charge"])
    back = mgf.read_scans(spark, str(tmp_path / "out" / "*")).first()
    assert back.structure == s[0].structure and len(back.peaks) == 2


def test_fragments_add_up(spark, tmp_path):
    (tmp_path / "x.mgf").write_text(MGF)
    st = mgf.structures(mgf.read_scans(spark, str(tmp_path)))
    f = {r.name: r.mass for r in chem.backbone_fragments(st).collect()}
    assert len(f) == 8 and math.isclose(f["b2"] + f["y3"], f["b1"] + f["y4"])
    assert chem.stub_fragments(st).count() == 40
    assert [r.residues[1].aa for r in chem.decoys(st).where("decoy").collect()] == ["M"]
    m = spark.createDataFrame([("Ammonium",), ("2*Sodium + Ammonium",), ("Nothing",)], "n string").select(chem.mass_shift(F.col("n")).alias("m")).collect()
    assert [round(r.m, 3) for r in m] == [17.027, 60.99, 0.0]


def test_model_documents(spark, tmp_path):
    a = np.arange(3.0)
    assert (codecs.text_to_array(codecs.array_to_text(a)) == a).all()
    assert codecs.unpack_scores(codecs.pack_scores(range(15))) == tuple(map(float, range(15)))
    spec = dict(peptide_length_range=[5, 10], glycan_size_range=[1, 5], charge=3, proton_mobility="mobile", glycan_type="n", glycan_count=1)
    fit = dict(coef=codecs.array_to_text(a), covariance_unscaled=None, hessian=None, deviance=1.5, dispersion=1.0, model_type="FragmentType", n_observations=3)
    (tmp_path / "m.json").write_text(json.dumps({"metadata": {}, "models": [[spec, fit]]}))
    m = codecs.read_models(spark, str(tmp_path / "m.json"))
    c = codecs.compile_models(m).first()
    assert c.coef == [0.0, 1.0, 2.0] and c.partition_key == 0 and c.charge == 3
    assert json.loads(codecs.model_document(codecs.strip_models(m), {"n": 1}))["models"][0][0] == spec


def test_score_guards(spark):
    ions = spark.createDataFrame([(1, "b", 0, 100.0, 0.1, 0.2, 1e-6, 0.75, 0.5)], "scan int, series string, size int, intensity double, share double, yhat double, mass_error double, reliability double, cov double")
    assert score.peptide_score(ions, ["scan"], "cov").first().backbone_count == 1
    assert score.glycan_score(ions, ["scan"], "cov", "cov").count() == 0


def test_streaming_counters(spark, tmp_path):
    from ionframe.streaming.scoring import score_batches, windowed_rates

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    e.limit(100).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = score_batches(stream, lambda b: b.groupBy("event_type").count(), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("count")).first()[0] == 100
    r = windowed_rates(stream, "ts", ["event_type"], F.col("value") >= 100).writeStream.format("memory").queryName("rates").outputMode("complete").start()
    r.processAllAvailable()
    r.stop()
    assert spark.sql("select sum(on_count + off_count) from rates").first()[0] == 100


def test_distance_correlation_of_any_group(spark):
    """Against whole distance matrices, of a group of more rows than one used to take as well."""
    rng = np.random.default_rng(3)
    groups = {1: (rng.normal(size=300), rng.normal(size=300)), 2: (rng.integers(0, 6, 200) * 1.0, rng.integers(0, 4, 200) * 0.1), 3: (np.ones(5), np.arange(5.0)), 4: (np.array([1.0]), np.array([2.0]))}
    x = rng.integers(0, 50, 5200) * 1.0
    groups[5] = (x, x * rng.integers(0, 3, 5200))
    df = spark.createDataFrame([(g, float(u), float(v)) for g, (us, vs) in groups.items() for u, v in zip(us, vs)], "g long, u double, v double")
    got = {r.g: r.dcor for r in select.distance_correlation(df, ["g"], "u", "v", "g long").collect()}
    for g, (u, v) in groups.items():
        a, b = (d - d.mean(0) - d.mean(1)[:, None] + d.mean() for d in (abs(w[:, None] - w) for w in (u, v)))
        if g in (3, 4):
            assert got[g] is None or math.isnan(got[g])
        else:
            assert got[g] == pytest.approx(math.sqrt((a * b).mean() / math.sqrt((a * a).mean() * (b * b).mean())), abs=1e-9)


def test_distcorr_of_all_suppliers(spark, duck):
    from ionframe.plans import registry
    from tests.conftest import DATA

    got = {r.g: r.dcor for r in registry.queries()["s_distcorr"](spark, DATA).collect()}
    assert set(got) == {g for (g,) in duck.sql("select distinct l_suppkey from lineitem").fetchall()}
    for g, dcor in duck.sql(registry.oracle_sql()["s_distcorr"]).fetchall():
        assert got[g] == pytest.approx(dcor, abs=1.1e-5, nan_ok=True)


@pytest.mark.parametrize("name, cut", [("a_posterior", " where l_linenumber <= 3"), ("a_reliability", " where l_linenumber <= 3"), ("j_all_products", " where p_size <= 10")])
def test_query_takes_whole_tables(spark, duck, name, cut):
    """Against the query's SQL without its row filter."""
    from ionframe.plans import registry
    from tests.conftest import DATA

    sql = registry.oracle_sql()[name].replace(cut, "")
    rel = duck.sql(sql)
    got = registry.queries()[name](spark, DATA).select(*rel.columns).collect()
    want = rel.fetchall()
    key = len(rel.columns) - 1
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got)), sorted(want)):
        assert g[:key] == w[:key] and g[key] == pytest.approx(w[key], abs=1.1e-6)


def test_too_many_cells_or_models_are_an_error(spark, monkeypatch):
    df = spark.range(3).selectExpr("id as a", "struct(id) as spec", "struct(id) as fit")
    monkeypatch.setattr(cells, "MOST_CELLS", 2)
    monkeypatch.setattr(codecs, "MOST_MODELS", 2, raising=False)
    with pytest.raises(ValueError):
        cells.partition_key(df, ["a"])
    with pytest.raises(ValueError):
        codecs.model_document(df, {})
    assert sorted(r.partition_key for r in cells.partition_key(df.where("a < 2"), ["a"]).collect()) == [0, 1]


def test_counts_of_a_composition(spark):
    from pyspark.sql import functions as F

    from ionframe.functions import scalar

    rows = [({"Hex": 5, "HexNAc": 4, "NeuAc": 2, "NeuGc": 1, "Fuc": 1, "dHex": 2},), ({"Hex": 3},), ({},)]
    g = F.col("g")
    got = spark.createDataFrame(rows, "g map<string,int>").select(scalar.labile_count(g), scalar.fucose_count(g), scalar.glycan_size(g), scalar.internal_size(g)).collect()
    assert [tuple(r) for r in got] == [(3, 3, 15, 12), (0, 0, 3, 3), (0, 0, 0, 0)]


def test_newton_tells_convergence():
    import numpy as np

    from ionframe.operators.glm import newton

    settle = lambda b: (np.zeros(2), np.eye(2), 5.0)
    assert newton(settle)["converged"]
    values = iter(range(1, 99))
    assert not newton(lambda b: (np.zeros(2), np.eye(2), float(next(values))), steps=3)["converged"]


def test_one_row_of_totals(spark):
    from pyspark.sql import functions as F

    from ionframe.operators import relations

    pairs = spark.createDataFrame([(1,)] * 12, "fc int")
    totals = spark.createDataFrame([(1, 2), (3, 4)], "n_on int, n_off int")
    with pytest.raises(ValueError):
        relations.specialise(pairs, totals, ["fc"], F.lit(True))


def test_specs_are_unique(spark):
    from ionframe.operators import search

    cells = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "charge int, mobility string")
    assert [tuple(r) for r in search.unique_specs(cells, ["charge", "mobility"]).collect()] == [(1, "a", 2)]


def test_erf_and_p_values(spark):
    x = [-1.5, 0.0, 0.3, 2.0]
    df = spark.createDataFrame([(v,) for v in [*x, None]], "x double")
    got = [r.v for r in df.select(scalar.erf("x").alias("v")).collect()]
    assert got == [math.erf(v) for v in x] + [None]
    fit = spark.createDataFrame([([1.0, 0.0], [0.25, 0.0, 0.0, 4.0])], "coef array<double>, covariance array<double>")
    rows = {r["name"]: r for r in glm.named_intervals(fit, ["a", "b"]).collect()}
    assert rows["a"].p_value == pytest.approx(math.erfc(2 / 2**0.5)) and rows["b"].p_value == 1.0


def test_feature_documents(spark):
    rows = [("x", "offset", 1.5, None, 2, None), ("y", "link", None, "K", None, 3)]
    f = spark.createDataFrame(rows, "name string, feature_type string, offset double, amino_acid string, from_charge int, to_charge int")
    back = codecs.features_from_json(codecs.features_to_json(f)).select(*f.columns)
    assert sorted(back.collect(), key=str) == sorted(f.collect(), key=str)
    for bad in ('{"feature_type": "other", "offset": 1}', '{"feature_type": "link"}', '{"offset": 1}'):
        with pytest.raises(Exception, match="no relation feature"):
            codecs.features_from_json(spark.createDataFrame([(bad,)], "document string")).collect()


def test_scan_index_of_repeated_titles(spark):
    scans = spark.createDataFrame([("f", "a", 4), ("f", "a", 2), ("f", "b.", 7), ("g", "c", 1)], "source_file string, title string, scan_index int")
    wanted = spark.createDataFrame([("f", "a"), ("f", "a"), ("f", "b"), ("f", "c"), ("f", None)], "source_file string, title string")
    assert sorted((str(r.title), r.scan_index) for r in mgf.scan_index(wanted, scans).collect()) == [("None", -1), ("a", 2), ("a", 2), ("b", 7), ("c", -1)]


def test_unknown_series_has_no_code(spark):
    df = spark.createDataFrame([("b", 2, "P", "K", 0), (None, 1, None, None, 0)], "s string, z int, l string, r string, k int")
    got = df.select(*(c.alias(n) for n, c in encode.classify("s", "z", "l", "r", "k").items())).collect()
    assert [(r.series, r.charge) for r in got] == [(0, 2), (3, 0)]
    with pytest.raises(Exception, match="no code for series"):
        spark.createDataFrame([("z", 2, "P", "K", 0)], "s string, z int, l string, r string, k int").select(*(c.alias(n) for n, c in encode.classify("s", "z", "l", "r", "k").items())).collect()


def test_partial_split_needs_a_big_stub(spark):
    rows = [(1, "stub_glycopeptide", 1, 50.0, 0.2, 0.2, 0.0, 1.0), (1, "b", 0, 80.0, 0.3, 0.2, 0.0, 0.5), (2, "stub_glycopeptide", 3, 50.0, 0.2, 0.2, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "scan int, series string, size int, intensity double, share double, yhat double, mass_error double, reliability double").withColumn("cov", F.lit(0.5))
    got = {r.scan: r.glycan_score for r in score.partial_split(df, ["scan"], "cov", "cov", glycosylated=False).collect()}
    assert got[1] == 0.0 and got[2] > 0


def test_mismatches_are_fitted_again(spark):
    """Most spectra peak at the first feature and a few at the second: these are the mismatches."""
    rng = random.Random(5)
    rows = []
    for s in range(40):
        strong = 0 if s < 34 else 1
        for k in range(3):
            rows.append(("c", s, [k], (60.0 if k == strong else 10.0) + rng.random(), 100.0, 1.0))
    df = spark.createDataFrame(rows, "cell string, scan int, idx array<int>, intensity double, total double, reliability double")
    got = {r.mismatch: r for r in glm.fit_with_mismatch(df, ["cell"], ["scan"], 3).collect()}
    assert got[False].n_spectra == 40 and got[True].n_spectra == 6
    assert np.argmax(got[False].coef) == 0 and np.argmax(got[True].coef) == 1


def test_train_and_evaluate(spark, tmp_path):
    """Spectra of one structure, made from its own fragments, are fitted and scored from MGF text;
    a spectrum of noise scores less, and one of another cell is routed to the only model."""
    structure = "AN(N-Glycosylation)STLKEGFR{Hex:3; HexNAc:2}"
    frame = spark.createDataFrame([("x", structure)], "title string, structure string")
    ions = sorted((f.mass, f.series, f.glycosylation_size) for f in training.fragments(mgf.structures(frame)).collect())
    rng, text = random.Random(3), []
    for k in range(30):
        peaks = [(m + scalar.PROTON, (900.0 if s == "y" else 300.0) * (1 + 0.1 * rng.random())) for m, s, _ in ions]
        if k == 29:
            peaks = [(m + 0.31, i) for m, i in peaks[:-2]] + peaks[-2:]
        lines = "\n".join(f"{m:.6f} {i:.3f} 1" for m, i in peaks)
        text.append(f"BEGIN IONS\nTITLE=s{k}\nPEPMASS=900.5 1000.0\nCHARGE={6 if k == 28 else 3}+\nSTRUCTURE={structure}\nMASS_SHIFT=Unmodified\nMS2_SCORE=9\nQ_VALUE=0.001\n{lines}\nEND IONS\n")
    (tmp_path / "t.mgf").write_text("\n".join(text))
    scans = mgf.training_data(spark, str(tmp_path), 5.0, 0.05)
    fits = training.train(spark, scans.where("precursor_charge = 3"))
    assert fits.where("not mismatch").count() == 1 and fits.first().charge == 3
    got = {r.title: r for r in training.evaluate(scans, fits).collect()}
    assert len(got) == 30
    clean, noise, other = got["t.mgf.s0"], got["t.mgf.s29"], got["t.mgf.s28"]
    assert clean.peptide_coverage == 1.0 and clean.glycan_coverage == 1.0 and clean.total_util == pytest.approx(1.0)
    assert noise.glycopeptide_score < clean.glycopeptide_score and noise.peptide_coverage < 1
    assert other.partition_label == clean.partition_label and other.peptide_coverage == 1.0

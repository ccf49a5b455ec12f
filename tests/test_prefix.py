"""Running values within groups against windows and plain Python."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ionframe.functions import prefix, stats
from ionframe.operators import select


@pytest.fixture(scope="module")
def rows(spark):
    """A group with most of the rows, ties, null keys and null values."""
    rng = random.Random(1)
    data = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([None, *range(40)]), rng.choice([None, 1, 2, 3]), k) for k in range(900)]
    return spark.createDataFrame(data, "g string, v int, x int, id int").withColumn("v", F.col("v").cast("double"))


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("parts", [1, 3, 16])
def test_running_equals_windows(rows, descending, parts):
    w = Window.partitionBy("g").orderBy(F.desc("v") if descending else F.asc("v")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    want = {r.id: (r.s, r.m) for r in rows.select("id", F.sum("x").over(w).alias("s"), F.min("x").over(w).alias("m")).collect()}
    got = prefix.running(rows, ["g"], "v", {"s": ("sum", F.col("x")), "m": ("min", F.col("x"))}, descending, parts)
    assert got.columns == [*rows.columns, "s", "m"]
    assert {r.id: (r.s, r.m) for r in got.collect()} == want


@pytest.mark.parametrize("parts", [1, 5, 30])
def test_carried_equals_a_window(rows, parts):
    w = Window.partitionBy("g").orderBy("v", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = {r.id: r.y for r in rows.select("id", F.last("x", ignorenulls=True).over(w).alias("y")).collect()}
    assert {r.id: r.y for r in prefix.carried(rows, ["g"], "v", "id", "x", "y", parts).collect()} == want


def test_a_group_is_dealt_over_ranges(rows):
    sizes = prefix.ranged(rows, ["g"], "v", 10).where("g = 'hot'").groupBy("_range").count().collect()
    assert len(sizes) >= 9 and max(r["count"] for r in sizes) < 150


def test_grouped_distribution_and_rates(spark, rows):
    known = rows.where("v is not null")
    w = Window.partitionBy("g").orderBy("v")
    want = {r.id: r.e for r in known.select("id", F.cume_dist().over(w).alias("e")).collect()}
    assert {r.id: r.ecdf for r in stats.ecdf(known, "v", ["g"]).collect()} == pytest.approx(want)
    scored = known.withColumn("d", F.col("x") == 1)
    got = select.q_values(scored, "v", "d", ["g"]).collect()
    assert len(got) == known.count()
    for g in ("hot", "a", None):
        own = [r for r in got if r.g == g]
        for r in own:
            fdr = [min(1.0, sum(bool(o.d) for o in own if o.v >= t) / max(1e-9, sum(not o.d for o in own if o.v >= t))) for t in {o.v for o in own if o.v <= r.v}]
            assert r.q == pytest.approx(min(fdr))


def test_support_vectors_keep_all_rows(spark):
    rng = random.Random(2)
    data = [(k, None if k % 4 == 0 else k % 2 + rng.random(), float("nan") if k == 7 else rng.random(), k % 2) for k in range(40)]
    df = spark.createDataFrame(data, "id int, a double, b double, y int")
    got = {r.id: r.svm for r in select.svm_scores(df, ["a", "b"], "y").collect()}
    assert len(got) == 40 and all((got[k] is None) == (k % 4 == 0 or k == 7) for k in got)
    known = [k for k in got if got[k] is not None]
    assert min(got[k] for k in known if k % 2) > max(got[k] for k in known if not k % 2)

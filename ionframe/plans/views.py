"""The driver's tables in the roles of the engine's data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import dealt, spread

IDENT = ["ok", "ln", "mass"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as peaks of scans: a supplier is a scan, a price a mass and an intensity."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("scan"), F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), F.col("l_extendedprice").alias("mass"), F.col("l_linenumber").alias("charge"), F.col("l_returnflag").alias("series"), F.col("l_quantity").alias("size"))


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.peaks import intensity_rank

    # the windows over scans, here and after, take this dealing as it is
    rows = table(spark, sf_dir, "lineitem").count()
    return intensity_rank(spread(peaks(spark, sf_dir), rows, "scan"), ["scan"], "mass", ["ok", "ln"])


#: SQL of the same, as common table expressions.
PEAKS = """peaks as (select l_suppkey as scan, l_orderkey as ok, l_linenumber as ln, l_extendedprice as mass, l_linenumber as charge,
  l_returnflag as series, l_quantity as size from lineitem)"""
RANKED = PEAKS + """, ranked0 as (select *, row_number() over (partition by scan order by mass desc, ok, ln) as j,
  count(*) filter (where mass >= 100) over (partition by scan) as high from peaks),
ranked as (select *, case when mass < 100 then (case when high >= 160 then -1 else 0 end) when j < 90 then 10 - floor(j / 10)
  when j < 160 then 1 else -1 end as rank from ranked0)"""


def psms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem joined with part as spectrum matches with the dimensions of the cell grid."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_partkey", "l_quantity")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    j = li.join(p, li["l_partkey"] == p["p_partkey"])
    return j.select(
        F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), F.col("l_suppkey").alias("sk"), F.col("l_extendedprice").alias("mass"),
        F.col("p_size").alias("length"), (F.col("l_quantity").cast("int") % 30).alias("size"), F.col("l_linenumber").alias("charge"),
        F.expr("case l_partkey % 3 when 0 then 'mobile' when 1 then 'partial' else 'immobile' end").alias("mobility"),
        (F.col("l_suppkey") % 4).cast("int").alias("glycan_type"), (F.col("l_orderkey") % 4).cast("int").alias("glycan_count"),
    )


PSMS = """psms as (select l_orderkey as ok, l_linenumber as ln, l_suppkey as sk, l_extendedprice as mass, p_size as length,
  cast(l_quantity as int) % 30 as size, l_linenumber as charge,
  case l_partkey % 3 when 0 then 'mobile' when 1 then 'partial' else 'immobile' end as mobility,
  cast(l_suppkey % 4 as int) as glycan_type, cast(l_orderkey % 4 as int) as glycan_count
  from lineitem join part on l_partkey = p_partkey)"""


def ions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted ions of spectra (an order is a spectrum) with literal coefficients."""
    from ..operators.glm import softmax

    li = table(spark, sf_dir, "lineitem")
    rows = li.select(
        F.col("l_orderkey").alias("scan"), F.col("l_linenumber").alias("ln"), F.col("l_suppkey").alias("sk"), F.col("l_extendedprice").alias("intensity"),
        F.expr("case l_returnflag when 'A' then 'b' when 'N' then 'y' else 'stub_glycopeptide' end").alias("series"), (F.col("l_quantity").cast("int") % 5).alias("size"),
        (F.col("l_discount") * 1e-4).alias("mass_error"), (0.5 + F.col("l_tax")).alias("reliability"),
        (0.3 * F.col("l_linenumber") - 0.02 * F.col("l_quantity") + F.when(F.col("l_returnflag") == "R", 0.5).otherwise(-0.25)).alias("eta"),
    )
    from pyspark.sql import Window

    total = F.sum("intensity").over(Window.partitionBy("scan")) * 1.25
    return softmax(rows, ["scan"], "eta").withColumn("total", total).withColumn("share", F.col("intensity") / F.col("total"))


IONS = """ions0 as (select l_orderkey as scan, l_linenumber as ln, l_suppkey as sk, l_extendedprice as intensity,
  case l_returnflag when 'A' then 'b' when 'N' then 'y' else 'stub_glycopeptide' end as series, cast(l_quantity as int) % 5 as size,
  l_discount * 1e-4 as mass_error, 0.5 + l_tax as reliability,
  0.3 * l_linenumber - 0.02 * l_quantity + case when l_returnflag = 'R' then 0.5 else -0.25 end as eta from lineitem),
ions as (select *, exp(eta) / (1 + sum(exp(eta)) over (partition by scan)) as yhat,
  sum(intensity) over (partition by scan) * 1.25 as total,
  intensity / (sum(intensity) over (partition by scan) * 1.25) as share from ions0)"""


def residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as peptides: the letters of their names in upper case are residues."""
    # a part is short and what is made of it long: parts are dealt to tasks before that, whatever the table's splits
    p = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), "p_partkey")
    return p.select("p_partkey", F.split(F.upper(F.regexp_replace("p_name", "[^A-Za-z]", "")), "").alias("seq"), F.col("p_size").alias("size"), (F.col("p_partkey") % 5 + 1).cast("int").alias("charge"))


RESIDUES = """residues as (select p_partkey, string_split(upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')), '') as seq,
  p_size as size, cast(p_partkey % 5 + 1 as int) as charge from part)"""

"""Model documents: JSON with base64 .npy arrays, slim and compiled tables, packed score sets."""

from __future__ import annotations

import base64
import io
import json
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPEC = "peptide_length_range array<int>, glycan_size_range array<int>, charge int, proton_mobility string, glycan_type string, glycan_count int"
SPEC_COLUMNS = [x.split()[0] for x in SPEC.split(", ")]
FIT = "coef string, covariance_unscaled string, hessian string, deviance double, dispersion double, model_type string, n_observations bigint"
_SCORE_SET = struct.Struct("=15f")


def array_to_text(a) -> str:
    out = io.BytesIO()
    np.save(out, np.asarray(a), allow_pickle=False)
    return base64.b64encode(out.getvalue()).decode()


def text_to_array(text: str) -> np.ndarray:
    return np.load(io.BytesIO(base64.b64decode(text)), allow_pickle=False)


def pack_scores(values) -> bytes:
    return _SCORE_SET.pack(*map(float, values))


def unpack_scores(data: bytes) -> tuple[float, ...]:
    return _SCORE_SET.unpack(data)


#: Most rows of a model table that go into one document.
MOST_MODELS = 100_000


def model_document(models: DataFrame, metadata: dict) -> str:
    """The JSON text of a model table (one row for each cell: spec and fit structs); a table has
    at most as many rows as the grid has cells."""
    rows = models.select(F.to_json("spec").alias("s"), F.to_json("fit").alias("f")).limit(MOST_MODELS + 1).collect()
    if len(rows) > MOST_MODELS:
        raise ValueError(f"a model table has more than {MOST_MODELS} rows")
    return json.dumps({"metadata": metadata, "models": [[json.loads(r.s), json.loads(r.f)] for r in rows]}, sort_keys=True, indent=2)


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """(spec, fit) rows of a model document, with or without its metadata wrapper."""
    text = spark.read.option("wholetext", True).text(path).select("value")
    pair = f"array<string>"
    listed = F.coalesce(F.get_json_object("value", "$.models"), F.col("value"))
    pairs = text.select(F.explode(F.from_json(listed, f"array<{pair}>")).alias("m"))
    fit = F.from_json(F.get("m", F.lit(1)), FIT)
    return pairs.select(F.from_json(F.get("m", F.lit(0)), SPEC).alias("spec"), fit.alias("fit"))


def strip_models(models: DataFrame, keep=("coef", "covariance_unscaled", "hessian")) -> DataFrame:
    """Models whose fit has no other arrays than the named ones."""
    return models.select("spec", F.struct(*(f"fit.{c}" for c in [*keep, "deviance", "dispersion", "model_type", "n_observations"])).alias("fit"))


def compile_models(models: DataFrame) -> DataFrame:
    """The table that scoring joins: the spec's columns, a dense key in the spec's order and the
    coefficients as numbers.  A grid bounds the rows of the window."""
    @F.pandas_udf("array<double>")
    def decode(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: text_to_array(t).ravel().astype(float).tolist(), na_action="ignore")

    m = models.select("spec.*", "fit.*")
    order = [F.to_json(c) if c.endswith("range") else c for c in SPEC_COLUMNS]
    return m.select(*SPEC_COLUMNS, (F.dense_rank().over(Window.orderBy(*order)) - 1).alias("partition_key"), decode("coef").alias("coef"), "dispersion", "model_type")


def write_metrics(metrics: DataFrame, path: str) -> None:
    """The thirteen aligned columns of a correlation run as one table."""
    names = ["scan_id", "correlation", "peptide_correlation", "glycan_correlation", "glycan_reliabilities", "peptide_reliabilities", "peptide_fragment_count", "glycan_fragment_count", "data_file", "glycopeptide", "partition_keys", "peptide_spectral_angle", "glycan_spectral_angle"]
    metrics.select(*names).write.parquet(path)


# The kinds of relation features that a document can name.
FEATURE_TYPES = ("offset", "link", "complement")
FEATURE = "name string, feature_type string, offset double, amino_acid string, tolerance double, intensity_ratio int, from_charge int, to_charge int, terminal string"


def features_to_json(features: DataFrame, out: str = "document") -> DataFrame:
    """A relation feature a row as a JSON document; nulls (wildcards) are left out."""
    names = [f.partition(" ")[0] for f in FEATURE.split(", ")]
    return features.select(F.to_json(F.struct(*(c for c in names if c in features.columns))).alias(out))


def features_from_json(documents: DataFrame, column: str = "document") -> DataFrame:
    """The features of documents by their type: a link needs its residue, the others an offset;
    an unknown type, or a document without what its type needs, is an error."""
    f = documents.select(F.from_json(column, FEATURE).alias("f")).select("f.*")
    known = F.col("feature_type").isin(*FEATURE_TYPES)
    whole = F.when(F.col("feature_type") == "link", F.col("amino_acid").isNotNull()).otherwise(F.col("offset").isNotNull())
    fine = F.coalesce(known & whole, F.lit(False))
    kind = F.when(fine, F.col("feature_type")).otherwise(F.raise_error(F.concat(F.lit("no relation feature of type "), F.coalesce("feature_type", F.lit("null")))))
    return f.withColumn("feature_type", kind)


# Names of the selectors in documents of partitioned fits.
SELECTORS: dict[str, str] = {"peptide": "NullModelSelector", "glycan": "KMeansModelSelector"}


def register_selector(part: str, name: str) -> None:
    """The selector that documents name for a part."""
    SELECTORS[part] = name


_FIT_FIELDS = "coef: array<double>, covariance: array<double>, deviance: double, dispersion: double, n_spectra: bigint, converged: boolean"
_PARTS = (
    f"struct<peptide_models: struct<selector_type: string, model_fit: struct<{_FIT_FIELDS}>>, "
    f"glycan_models: struct<selector_type: string, model_fits: map<string, struct<{_FIT_FIELDS}>>, kmeans_fit: struct<k: int, mus: array<double>>>>"
)


def split_fits_to_json(fits: DataFrame, spec: list[str], out: str = "document") -> DataFrame:
    """(spec, document): the fits of a cell's parts as one JSON document: the peptide's model, and
    the glycan's by cluster with the centres that choose among them."""
    names = [f.split(":")[0] for f in _FIT_FIELDS.split(", ")]
    one = F.struct(*names)
    glycan = F.startswith(F.col("part"), F.lit("glycan:"))
    by = fits.groupBy(*spec).agg(
        F.max(F.when(F.col("part") == "peptide", one)).alias("_p"), F.map_from_entries(F.array_sort(F.collect_list(F.when(glycan, F.struct(F.substring_index("part", ":", -1).alias("k"), one.alias("v")))))).alias("_g"), F.first("centres").alias("_c"))
    peptide = F.struct(F.lit(SELECTORS["peptide"]).alias("selector_type"), F.col("_p").alias("model_fit"))
    kmeans = F.struct(F.size("_c").alias("k"), F.col("_c").alias("mus"))
    return by.select(*spec, F.to_json(F.struct(peptide.alias("peptide_models"), F.struct(F.lit(SELECTORS["glycan"]).alias("selector_type"), F.col("_g").alias("model_fits"), kmeans.alias("kmeans_fit")).alias("glycan_models"))).alias(out))


def split_fits_from_json(documents: DataFrame, spec: list[str], column: str = "document") -> DataFrame:
    """The fits of parts that documents hold: spec, part, the fit's columns and centres.  A selector of
    another name than the registered ones is an error."""
    d = documents.select(*spec, F.from_json(column, _PARTS).alias("d"))
    fine = (F.col("d.peptide_models.selector_type") == SELECTORS["peptide"]) & (F.col("d.glycan_models.selector_type") == SELECTORS["glycan"])
    checked = F.when(fine, F.col("d")).otherwise(F.raise_error(F.concat(F.lit("no selector "), F.coalesce("d.peptide_models.selector_type", F.lit("null")), F.lit(" or "), F.coalesce("d.glycan_models.selector_type", F.lit("null")))))
    d = d.withColumn("d", checked)
    peptide = F.array(F.struct(F.lit("peptide").alias("part"), F.col("d.peptide_models.model_fit").alias("fit")))
    glycan = F.transform(F.map_entries("d.glycan_models.model_fits"), lambda e: F.struct(F.concat(F.lit("glycan:"), e["key"]).alias("part"), e["value"].alias("fit")))
    e = d.select(*spec, F.col("d.glycan_models.kmeans_fit.mus").alias("centres"), F.explode(F.concat(peptide, glycan)).alias("x"))
    return e.where("x.fit is not null").select(*spec, "x.part", "x.fit.*", "centres")


_RELATION = (
    "map<string, struct<series: string, error_tolerance: double, on_frequency: double, off_frequency: double, prior_probability_of_match: double, "
    "features: array<struct<slot: string, on_series: double, off_series: double>>>>"
)


def relations_to_json(models: DataFrame, spec: list[str], tolerance: float = 2e-5, out: str = "document") -> DataFrame:
    """(spec, document): the relation models of a cell as one JSON document by series."""
    features = F.transform(F.map_entries("fits"), lambda e: F.struct(e["key"].alias("slot"), e["value"]["mu"].alias("on_series"), e["value"]["nu"].alias("off_series")))
    one = F.struct("series", F.lit(tolerance).alias("error_tolerance"), F.col("alpha").alias("on_frequency"), F.col("beta").alias("off_frequency"), F.col("prior").alias("prior_probability_of_match"), features.alias("features"))
    return models.groupBy(*spec).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("series").alias("k"), one.alias("v"))))).alias("_m")).select(*spec, F.to_json("_m").alias(out))


def relations_from_json(documents: DataFrame, spec: list[str], column: str = "document") -> DataFrame:
    """The relation models that documents hold, with gamma from their rates."""
    from ..operators.relations import explained_probability

    e = documents.select(*spec, F.explode(F.from_json(column, _RELATION)).alias("k", "m")).select(*spec, "m.*")
    fits = F.map_from_entries(F.transform("features", lambda f: F.struct(f["slot"].alias("k"), F.struct(f["on_series"].alias("mu"), f["off_series"].alias("nu")).alias("v"))))
    out = e.select(*spec, "series", F.col("on_frequency").alias("alpha"), F.col("off_frequency").alias("beta"), F.col("prior_probability_of_match").alias("prior"), F.when(F.size("features") > 0, fits).alias("fits"))
    return out.withColumn("gamma", explained_probability("alpha", "beta", "prior"))

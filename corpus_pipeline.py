"""The corpus pipeline: five stages, each calling one operator of ionframe.llm.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame.  :func:`run` applies them to the documents of sf_dir; every stage's result is
written as Parquet and read again as the next one's docs.  The stages are: quality rules
(rejected documents go), quality classifier (rejected documents go), line dedup (repeated
lines go), SimHash near-dedup (one document of each group stays) and packing.

Any column may be null.  Null, empty and blank texts have no words, so the rules reject them;
later stages leave such texts, which a line stage can make, as they are (equal ones are one
group of near duplicates).  Texts of any length are taken whole.  Rows that repeat an id, or all
of a row, are documents of their own: of their equal lines one occurrence is kept, of their
near copies one row.  Ties go to the least doc_id, a null one last.  An empty table gives an
empty table.  Extra columns of any name are handed on unchanged, but for the last stage, which
returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionframe.llm import line_dedup, packing, quality_classifier, quality_rules, simhash_dedup
from ionframe.llm.common import materialize
from ionframe.llm.queries import tokenizer_path


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the cascade keeps; a null or empty text fails the base rule."""
    return quality_rules.keep_clean(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more, by a model trained on those left that have
    a label; without labels, or with one only, the bias decides on all (0.5 without any)."""
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; n_chars follows the text (null for a null one).
    Every row stays, also one whose text becomes empty."""
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: one row, the rows that repeat its id and text included."""
    return simhash_dedup.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, with their places in sequences."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("line_dedup", lines), ("simhash_near_dedup", near_duplicates), ("harmonic_packing", pack)]

#: SQL has no SimHash groups and no trained model: test_pipeline_by_brute_force holds run() against
#: plain Python over a table with copies, changed lines and rejected texts (the model is trained by
#: the operator's own trainer there).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}

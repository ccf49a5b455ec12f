"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where a local session doesn't set it, an error on
    a cluster, whose executors would each write to their own disk."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="ionframe-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


def bucketed(df: DataFrame, by: list[str], tag: str) -> DataFrame:
    """df written in the shared folder, in as many buckets of columns as there are shuffle partitions:
    what groups, joins or windows by them (or more) reads it without a shuffle.  df should be dealt by
    them, so that a task writes one bucket."""
    spark = df.sparkSession
    name = f"{tag.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortBy(*by).option("path", path).saveAsTable(name)
    table = spark.table(name)
    table.written_at, table.listed_as = path, name
    return table


#: Rows that spread gives a task, about.
ROWS_OF_TASK = 400_000


def spread(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df, of so many rows, dealt by columns over enough tasks that what each of them sorts stays of one
    size however large df is (never fewer than there are shuffle partitions)."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_OF_TASK)), *by)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df dealt by columns over as many tasks as there are shuffle partitions: for short rows of which
    long ones are made.  The number is given, so that it is not lowered to suit the short rows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize or bucketed wrote and that nothing reads any more: what was made of
    them has to be written itself."""
    for t in tables:
        path = getattr(t, "written_at", None)
        if path:
            jvm = t.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
            if getattr(t, "listed_as", None):
                t.sparkSession.sql(f"drop table if exists {t.listed_as}")

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of a text are its maximal runs of other characters than these.
SPACES = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where a local session names none (as in tests) a temporary one is set; on a cluster, whose
    executors would each write to their own disk, that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="ionframe-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: it cuts the lineage and
    survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize wrote and that nothing reads any more; what was made
    of them has to be written itself."""
    for t in tables:
        jvm, path = t.sparkSession._jvm, getattr(t, "written_at", None)
        if path:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def id_remainder(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def passage(text: Column, key: Column, chars: int) -> Column:
    """The text, or of a longer one so many characters from a place that a hash of the key gives:
    what training on a bounded sample reads of it."""
    last = F.greatest(F.char_length(text) - chars, F.lit(0))
    return F.substring(text, (F.pmod(F.xxhash64(key), last + 1) + 1).cast("int"), F.lit(chars))


def sample_by_hash(df: DataFrame, n: int, key: str) -> DataFrame:
    """At most n rows, the same for the same rows whatever their order or partitions."""
    return df.orderBy(F.xxhash64(key), key).limit(n)


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, component) for every node of an undirected graph given as edges (a, b) of
    longs; component is the least node of the group.  Self-loops and repeats are allowed,
    rows with a null end are dropped; isolated nodes are not in the result.

    Each round points every node at its least neighbour, jumps once along those pointers
    and contracts the graph, so that a group of n nodes takes O(log n) rounds.  Every
    round's tables are written to the shared folder; the driver sees counts only.
    """
    spark = edges.sparkSession
    live = materialize(_both_ways(edges.select("a", "b")), "cc-edges")
    maps: list[DataFrame] = []
    used: list[DataFrame] = []
    for _ in range(max_rounds):
        if live.isEmpty():
            break
        parent = live.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p"))
        parent = materialize(parent, "cc-parent")
        up = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        jumped = materialize(parent.join(up, "p").select("a", F.col("pp").alias("p")), "cc-map")
        maps.append(jumped)
        used += [live, parent]
        left = jumped.withColumnRenamed("p", "x")
        right = jumped.select(F.col("a").alias("b"), F.col("p").alias("y"))
        moved = live.where("a < b").join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        live = materialize(_both_ways(moved), "cc-edges")
    else:
        raise RuntimeError(f"groups did not converge in {max_rounds} rounds")
    if not maps:
        return spark.createDataFrame([], "node long, component long")
    out = maps[0].select(F.col("a").alias("node"), F.col("p").alias("component"))
    for m in maps[1:]:
        step = m.select(F.col("a").alias("component"), F.col("p").alias("next"))
        out = out.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    out = materialize(out, "cc")
    discard(*used, *maps, live)
    return out


def _both_ways(edges: DataFrame) -> DataFrame:
    one = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return one.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")

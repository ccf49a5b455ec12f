"""Harmonic packing of token sequences.

With capacity C a piece of length s lies in class k = C // s, and a bin of that class takes
exactly k pieces.  Documents are cut so that their pieces fit their class well: whole bins
first, then, while the rest of a document would waste more than 1/SLACK of its share C // k
of a bin, a piece of the next smaller share C // (k + 1).  There are fewer than 2 sqrt(C)
shares, so as many classes.

The pieces of a class are numbered without gathering them: rows are dealt into buckets by a
hash, counted by class and bucket, and a bucket's numbers start after those of the buckets
before it.  Piece number i goes to bin i // k at place i % k, so every worker fills its bins
by arithmetic.  A class's last bin may be incomplete.  Those left-over pieces are fewer than
k for each class, at most left_over() in all (21 297 for CAPACITY) whatever the input, so one task packs them by
best fit.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import LibraryEncoder, made
from .common import materialize

CAPACITY = 4096
SLACK = 64
END_ID = 2
#: Least number of buckets in which a class is numbered; more where the session shuffles wider.
BUCKETS = 256


def shares(capacity: int = CAPACITY) -> list[int]:
    """The lengths C // k, that is the classes, in descending order."""
    return sorted({capacity // k for k in range(1, capacity + 1)}, reverse=True)


def left_over(capacity: int = CAPACITY) -> int:
    """The bound of the pieces that one task packs."""
    return sum(capacity // s - 1 for s in shares(capacity))


def cut(n: int, capacity: int = CAPACITY, slack: int = SLACK) -> list[int]:
    """Lengths of the pieces of a document of n tokens."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if (capacity // k - rest) * slack > capacity // k:
            out.append(capacity // (k + 1))
            rest -= out[-1]
        else:
            out.append(rest)
            rest = 0
    return out


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, slack: int = SLACK) -> DataFrame:
    """A row for each piece of each document: its ids by the tokenizer file at path, then
    END_ID, cut; row tells repeated rows of a document apart.  Null text counts as empty."""

    def run(batches):
        e = made(LibraryEncoder, path)
        end = np.uint32(END_ID).tobytes()
        for b in batches:
            rows = []
            for doc, text, row in zip(*(b.column(i).to_pylist() for i in range(3))):
                ids = e.encode(text or "") + end
                n, at = len(ids) // 4, 0
                for size in cut(n, capacity, slack):
                    rows.append((doc, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), n, row))
                    at += size
            yield pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 6)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    return d.mapInArrow(run, _PIECES)


def _best_fit(capacity: int):
    def run(batches):
        given = list(batches)
        if not given:
            return
        p = pa.Table.from_batches(given)
        p = p.take(pc.sort_indices(p, sort_keys=[("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("row", "ascending")]))
        room = np.empty(len(p), np.int64)
        used = 0
        seq, offset = np.empty(len(p), np.int64), np.empty(len(p), np.int64)
        for i, size in enumerate(p["length"].to_pylist()):
            free = room[:used]
            fits = free >= size
            if fits.any():
                j = int(np.where(fits, free, capacity + 1).argmin())
            else:
                j, used = used, used + 1
                room[j] = capacity
            seq[i], offset[i] = j, capacity - room[j]
            room[j] -= size
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        yield pa.record_batch([*(p[n].combine_chunks() for n in names), pa.array(seq), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset; the offsets of a sequence have no gaps.

    Within a bin the pieces stand in the order of their numbers.  sequence_id is unique and
    not dense: left-over bins have the numbers from 0, a class's bins follow in steps.
    """
    buckets = max(BUCKETS, int(cut_pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    p = materialize(cut_pieces.withColumn("k", F.floor(F.lit(capacity) / F.col("length")).cast("long"))
                    .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "row"), F.lit(buckets))), "pieces")
    # a class has one share, so counting by share is counting by class
    counts = p.groupBy("k", "bucket").agg(F.count("*").alias("n"))
    in_class = Window.partitionBy("k")
    before = counts.select("k", "bucket", F.sum("n").over(in_class).alias("total"), (F.sum("n").over(in_class.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    own = Window.partitionBy("k", "bucket").orderBy("doc_id", "start", "row")
    numbered = p.withColumn("i", F.row_number().over(own) - 1).join(before, ["k", "bucket"])
    numbered = numbered.withColumn("i", F.col("i") + F.col("before")).withColumn("full", F.col("i") < F.col("total") - F.col("total") % F.col("k"))
    numbered = materialize(numbered.withColumn("bin", F.floor(F.col("i") / F.col("k")).cast("long")), "numbered")
    in_bin = Window.partitionBy("k", "bin").orderBy("i")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    full = numbered.where("full").withColumn("offset", F.sum("length").over(in_bin.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))
    full = full.select(*names, (F.lit(left_over(capacity) + 1) + F.col("bin") * (capacity + 1) + F.col("k")).alias("sequence_id"), "offset")
    # at most left_over(capacity) rows
    left = numbered.where("not full").select(*names, "row").repartition(1)
    left = left.mapInArrow(_best_fit(capacity), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return full.unionByName(left)


def pack_documents(docs: DataFrame, path: str) -> DataFrame:
    """Packs every row of docs (doc_id, text; other columns are ignored): repeated rows are
    packed each, null and empty texts have END_ID alone, an empty table gives no row."""
    return pack(pieces(docs, path))

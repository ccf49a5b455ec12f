"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has 64 bits, that is 8 positional bytes.  Two fingerprints that differ in at
most 3 bits differ in at most 3 bytes, so they share at least 8 - 3 = 5 positional bytes.
The index posts every *distinct* fingerprint under quadruples of positional bytes.  The 14
quadruples are the blocks of the Steiner system S(3, 4, 8): whichever three positions
differ, one block avoids them, hence a qualifying pair meets in a posting list.  In a
posting list each pair's shared positional bytes are tallied; only pairs that reach the
guaranteed minimum of 5 go on, and their bits are compared.  (Lists of single bytes would hold
1/256 of all documents each, so that tallying over them is quadratic.)

A long posting list is never compared as a whole.  It is dealt out again by one more piece
of the fingerprint, of which a qualifying pair must share one out of four (the remaining
four bytes; then quarters of the remaining 24 bits): at the last level at most 18 bits are
free, so that a list has at most 2**18 members however many documents there are.  A last
list of many members is not compared pair by pair: all its pairs share 5 bytes, and each
member's at most 988 neighbours within 3 of the 18 bits are looked up.  Only a spanning forest
of a list's links leaves a task, at most one edge for each member.

Equal fingerprints are one node, so a group of exact copies costs one index entry.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize

POSITIONS = 8
MAX_BITS = 3
SEED = 42
#: Members from which a posting list is dealt out by a further piece.
LONG_LIST = 512
#: Members from which a last list's neighbours are looked up.
CUBE_LIST = 4096
CUBE_BITS = 18
_M = np.uint64(0x0101010101010101)


def quadruples() -> list[tuple[int, ...]]:
    """The Steiner system S(3, 4, 8): quadruples of 3-bit numbers whose exclusive-or is 0."""
    return [q for q in itertools.combinations(range(POSITIONS), 4) if q[0] ^ q[1] ^ q[2] ^ q[3] == 0]


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The fingerprint as an unsigned integer; texts without a word have 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        h = np.fromiter((digest(g, SEED) for g in itertools.islice(grams, 1 << 16)), np.uint64)
        # byte j of lane k counts bit 8 j + k, for up to 255 shingles at once
        lanes = np.stack([(h >> np.uint64(k)) & _M for k in range(8)], axis=1)
        sums = np.add.reduceat(lanes, np.arange(0, len(h), 255), axis=0)
        counts += sums.view(np.uint8).reshape(-1, 8, 8).sum(axis=0, dtype=np.int64).T.ravel()
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches):
    for b in batches:
        f = np.array([fingerprint(t) for t in b.column(2).to_pylist()], np.uint64)
        yield pa.record_batch([b.column(0), b.column(1), pa.array(f.view(np.int64))], names=["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp): fp holds the 64 bits as a long."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").cast("binary").alias("text"))
    return d.mapInArrow(_fingerprints, "doc_id long, text_hash long, fp long")


def _linked(x: np.ndarray) -> np.ndarray:
    """Which differences x of two fingerprints are links: the shared positional bytes are
    tallied, and the bits of the pairs with enough of them are counted."""
    tally = (x.view(np.uint8).reshape(*x.shape, POSITIONS) == 0).sum(-1)
    out = tally >= POSITIONS - MAX_BITS
    out[out] = np.bitwise_count(x[out]) <= MAX_BITS
    return out


def _roots(f: np.ndarray) -> np.ndarray:
    """For each member of a posting list, the index of its group's first member."""
    m = len(f)
    root = np.full(m, -1)
    for i in range(m):
        if root[i] >= 0:
            continue
        root[i] = i
        front = [i]
        while front:
            rest = np.flatnonzero(root < 0)
            if not len(rest):
                break
            found = np.zeros(len(rest), bool)
            for lo in range(0, len(front), 64):
                found |= _linked(f[front[lo : lo + 64], None] ^ f[None, rest]).any(0)
            front = rest[found].tolist()
            root[front] = i
    return root


def _cube_roots(f: np.ndarray) -> np.ndarray:
    """The same for distinct members that differ in at most CUBE_BITS places."""
    free = int(np.bitwise_or.reduce(f ^ f[0]))
    places = [b for b in range(64) if free >> b & 1]
    if len(places) > CUBE_BITS:
        return _roots(f)
    at = np.zeros(len(f), np.int64)
    for i, b in enumerate(places):
        at |= ((f >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << i
    member = np.full(1 << len(places), -1)
    member[at] = np.arange(len(f))
    steps = [sum(1 << i for i in c) for n in range(1, MAX_BITS + 1) for c in itertools.combinations(range(len(places)), n)]
    root, before = np.arange(len(f)), None
    while before is None or (root != before).any():
        before = root.copy()
        for s in steps:
            near = member[at ^ s]
            has = near >= 0
            root[has] = np.minimum(root[has], root[near[has]])
        root = root[root]
    return root


def _links(last: bool):
    """Rows sorted by (key, sub) to edges; members of a long list come back with long_list set."""

    def run(batches):
        kept: list[np.ndarray] = []
        size, key, is_long = 0, None, False

        def edges(runs):
            two = np.array([f for f in runs if len(f) == 2], np.uint64).reshape(-1, 2)
            two = two[_linked(two[:, 0] ^ two[:, 1])]
            a, b = [two[:, 0]], [two[:, 1]]
            for f in runs:
                if len(f) == 2:
                    continue
                r = _cube_roots(f) if last and len(f) >= CUBE_LIST else _roots(f)
                own = np.flatnonzero(r != np.arange(len(f)))
                a.append(f[r[own]]), b.append(f[own])
            return np.concatenate(a), np.concatenate(b)

        def batch(a, b, key=0, is_long=False):
            n = len(a)
            return pa.record_batch([pa.array(np.full(n, key, np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(n, is_long))], names=["key", "a", "b", "long_list"])

        for rb in batches:
            k, s = (rb.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            f = np.ascontiguousarray(rb.column(2).to_numpy(zero_copy_only=False)).view(np.uint64)
            if not len(k):
                continue
            cut = np.flatnonzero((k[1:] != k[:-1]) | (s[1:] != s[:-1])) + 1
            starts = np.concatenate([[0], cut, [len(k)]])
            done, long_parts = [], []
            sizes = np.diff(starts)
            # single entries inside the batch have no partner; the first and last run may go on
            todo = sorted({0, len(sizes) - 1, *np.flatnonzero(sizes > 1).tolist()})
            for i in todo:
                lo, hi = starts[i], starts[i + 1]
                if (k[lo], s[lo]) != key:
                    if size > 1 and not is_long:
                        done.append(np.concatenate(kept))
                    kept, size, key, is_long = [], 0, (k[lo], s[lo]), False
                kept.append(f[lo:hi])
                size += hi - lo
                if not last and (is_long or size > LONG_LIST):
                    is_long = True
                    part = np.concatenate(kept)
                    long_parts.append((key[0], part))
                    kept = []
            if done:
                yield batch(*edges(done))
            for kk, part in long_parts:
                yield batch(part, part, kk, True)
        if size > 1 and not is_long:
            yield batch(*edges([np.concatenate(kept)]))

    return run


_LINKS = "key long, a long, b long, long_list boolean"


def _compare(index: DataFrame, last: bool = False) -> DataFrame:
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.select("key", "sub", "fp").repartition(n, "key", "sub").sortWithinPartitions("key", "sub", "fp")
    return dealt.mapInArrow(_links(last), _LINKS)


def _byte(fp, i):
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(0xFF))


def _index(distinct: DataFrame) -> DataFrame:
    keys = []
    for no, q in enumerate(quadruples()):
        key = F.lit(no)
        for i in q:
            key = F.shiftleft(key.cast("long"), 8).bitwiseOR(_byte(F.col("fp"), i))
        keys.append(key)
    return distinct.select(F.explode(F.array(*keys)).alias("key"), F.lit(0).cast("long").alias("sub"), "fp")


def _deeper(long_lists: DataFrame, level: int) -> DataFrame:
    """Deal the members of long lists by one more piece: level 1 by each of the four bytes
    outside the quadruple, level 2 by each quarter of the 24 bits that then are free."""
    quads = quadruples()
    out = None
    fp, key = F.col("a"), F.col("key")
    for no, q in enumerate(quads):
        free = [i for i in range(POSITIONS) if i not in q]
        subs = []
        for b in free:
            one = F.lit(b).cast("long") * 256 + _byte(fp, b)
            if level == 1:
                subs.append(one)
                continue
            rest = F.lit(0).cast("long")
            for i in (i for i in free if i != b):
                rest = F.shiftleft(rest, 8).bitwiseOR(_byte(fp, i))
            for c in range(4):
                subs.append((one * 4 + c) * 64 + F.shiftrightunsigned(rest, 6 * c).bitwiseAND(F.lit(63)))
        part = F.when(F.shiftrightunsigned(key, 32) == no, F.array(*subs))
        out = part if out is None else F.coalesce(out, part)
    return long_lists.select("key", F.explode(out).alias("sub"), fp.alias("fp")).distinct()


def fingerprint_groups(fps: DataFrame) -> DataFrame:
    """(fp, root) for the distinct fingerprints that have a link to another."""
    distinct = fps.select("fp").distinct()
    found = materialize(_compare(_index(distinct)), "simhash-links")
    edges = found.where("not long_list").select("a", "b")
    for level in (1, 2):
        long_lists = found.where("long_list").select("key", "a")
        if long_lists.isEmpty():
            break
        found = materialize(_compare(_deeper(long_lists, level), last=level == 2), "simhash-links")
        edges = edges.unionByName(found.where("not long_list").select("a", "b"))
    return connected_components(edges).select(F.col("node").alias("fp"), F.col("component").alias("root"))


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The fingerprints, and for each that occurs the component_id and the head of its group:
    the doc_id, text_hash and number of copies of the row that stays."""
    fps = materialize(fingerprints(docs), "simhash-fp")
    groups = fingerprint_groups(fps)
    rows = fps.groupBy("fp", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    head = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "n")).alias("head")
    rooted = rows.groupBy("fp").agg(head).join(groups, "fp", "left").select("fp", "head", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "simhash-roots")
    names = rooted.groupBy("root").agg(F.min("head").alias("head"))
    return fps, materialize(rooted.join(names.withColumnRenamed("head", "first"), "root").select("fp", "root", F.col("first").alias("head")), "simhash-labels")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs (doc_id, text, ...).

    component_id is the smallest doc_id that can be reached over links of at most 3 bits.
    Null and empty texts have the fingerprint 0 and are linked like any other.  Rows with a
    null doc_id are members of their group but never name it (null if all ids are null);
    repeated rows come back as often as they are there.  Other columns are ignored.
    """
    fps, labels = _grouped(docs)
    labels = labels.select("fp", F.col("head.doc_id").alias("component_id"))
    return fps.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group, with all its columns: that with the smallest doc_id (a null one
    only where no row has an id); of rows that repeat that id, the text with the least hash; of
    rows that repeat both, any one."""
    _, labels = _grouped(docs)
    heads = labels.select("root", "head").distinct().select(F.col("head.doc_id").alias("_id"), F.col("head.text_hash").alias("_hash"), F.col("head.n").alias("_n"))
    heads = materialize(heads, "simhash-heads")
    names = docs.columns
    d = docs.select(F.struct(*names).alias("_all"), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64(F.col("text").cast("string")).alias("_text_hash"))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash"))
    stay = d.join(heads.where("_n = 1"), same, "left_semi")
    again = heads.where("_n > 1")
    if not again.isEmpty():
        stay = stay.unionByName(d.join(again, same, "left_semi").dropDuplicates(["_doc", "_text_hash"]))
    return stay.select(*(F.col("_all")[n].alias(n) for n in names))

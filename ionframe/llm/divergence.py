"""Audit of how the words of sources differ, by iceberg prefix refinement.

Terms are counted for each language that are in at least MIN_DOCS of its documents.  Most of the
different terms of a large corpus are rare, so they are never counted whole: all terms are first cut
to a prefix of FIRST bytes, documents are counted by prefix, and prefixes in too few documents are
discarded with everything that begins with them.  What is left is extended to twice the length and
counted again, until only whole terms are left (a term's end counts as a byte of its own, so a term
and the longer ones that begin with it are told apart).  The length doubles, so the longest kept
term of b bytes takes about log2(b) rounds.

Each document is one row with its different terms, so the prefixes that one document has are made
different inside the row, and a task counts the documents of all its rows before anything is shuffled
(HELD prefixes at most at a time, then it passes its counts on).  Which prefixes are live is told to
the next round by a bitmap of SLOTS hash slots, whatever the data; a slot that two prefixes share lets
a prefix through that the count then discards, so the result doesn't depend on it.

Null text, language and source are ''.  Every row is a document of its own, repeated ones too.
Empty tables give empty results; ties of ranks go by the item's bytes; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

MIN_DOCS = 30
#: Bytes of the first prefixes.
FIRST = 4
#: Hash slots of a broadcast filter (bits, and numbers at most that the driver collects for it).
SLOTS = 1 << 22
#: Counts that a task holds before it passes them on.
HELD = 400_000
#: Sources of which a task holds sums.
GROUPS = 32
#: Languages of which a task keeps look-ups.
LANGUAGES = 8
#: Ranks of the terms that set a source apart.
TOP_TERMS = 50
#: Sources of a language up to which a task keeps one matrix of sums; beyond it a task passes on
#: the sums of every batch, BLOCK sources at a time.
MATRIX_SOURCES = 1024
BLOCK = 64
#: The end of a term, a byte that no term has.
_END = b"\n"
#: Letters in lower case, bytes of other characters as they are, the rest blank.
_LETTERS = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))


def document_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, terms, counts): one row for each document with its different terms, each with
    its end, in one binary value, and how often each occurs (little-endian unsigned 32-bit integers)."""

    def run(batches):
        for b in batches:
            terms, counts = [], []
            for text in b.column(2).to_pylist():
                found = Counter(text.encode("utf-8", "replace").translate(_LETTERS).split())
                terms.append(_END.join([*found, b""]))
                counts.append(np.fromiter(found.values(), "<u4", len(found)).tobytes())
            yield pa.record_batch([b.column(0), b.column(1), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], names=["lang", "source", "terms", "counts"])

    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*text).mapInArrow(run, "lang string, source string, terms binary, counts binary")


class _Alive(dict):
    """Whether a language's prefixes are in a filter, as looked up so far."""

    def __init__(self, bits: bytes, lang: str):
        super().__init__()
        self.bits, self.start = bits, zlib.crc32(lang.encode() + b"\0")

    def __missing__(self, prefix: bytes) -> bool:
        slot = zlib.crc32(prefix, self.start) % SLOTS
        if len(self) >= HELD:
            self.clear()
        self[prefix] = known = bool(self.bits[slot >> 3] >> (slot & 7) & 1)
        return known


def _known(alive: dict[str, _Alive], filters, lang: str) -> _Alive:
    """The look-ups of a language; a task keeps those of some languages."""
    if lang not in alive:
        if len(alive) >= LANGUAGES:
            alive.clear()
        alive[lang] = _Alive(filters.value, lang)
    return alive[lang]


def _filter(live: DataFrame, column: str) -> bytes:
    """The bitmap of the slots of live (lang, column)."""
    slot = F.crc32(F.concat(F.col("lang").cast("binary"), F.lit(b"\0"), F.col(column).cast("binary"))) % SLOTS
    slots = np.array([r[0] for r in live.select(slot.cast("int")).distinct().collect()], np.int64)
    bits = np.zeros(SLOTS, bool)
    bits[slots] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _rows(held: dict, names: list[str]) -> pa.RecordBatch:
    """(key's columns, term or prefix, n) of counters by key."""
    at = np.repeat(np.arange(len(held)), [len(c) for c in held.values()])
    columns = [pa.array([k[i] for k in held], pa.string()).take(pa.array(at)) for i in range(len(names) - 2)]
    columns += [pa.array([t for c in held.values() for t in c], pa.binary()), pa.array([n for c in held.values() for n in c.values()], pa.int64())]
    return pa.record_batch(columns, names=names)


def clustered_terms(docs: DataFrame) -> DataFrame:
    """document_terms as a written table in which the documents of a source lie together, so that a
    task meets few sources and adds up most of a term's occurrences itself.  A source that has more than
    a task's share of the documents is dealt over as many tasks as it has shares; there are fewer
    such sources than tasks, so that their table is broadcast."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    sizes = docs.select(*group).groupBy("lang", "source").agg(F.count("*").alias("_size"))
    share = max(1.0, docs.count() / n)
    large = sizes.where(F.col("_size") > share).select("lang", "source", F.ceil(F.col("_size") / F.lit(share)).alias("_pieces"))
    # by the row's number, as a source may hold a great many copies of one text
    terms = document_terms(docs).withColumn("_row", F.monotonically_increasing_id()).join(F.broadcast(large), ["lang", "source"], "left")
    terms = terms.withColumn("_piece", F.pmod(F.xxhash64("_row"), F.coalesce("_pieces", F.lit(1))))
    return materialize(terms.repartition(n, "lang", "source", "_piece").select("lang", "source", "terms", "counts"), "terms-docs")


def kept_terms(terms: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term): the terms that are in at least min_docs documents of their language."""
    spark = terms.sparkSession
    length, bits, found, used = FIRST, None, [], []
    while True:
        counted = _documents(terms, length, None if bits is None else spark.sparkContext.broadcast(bits))
        counted = counted.groupBy("lang", "prefix").agg(F.sum("n").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "prefix")
        counted = materialize(counted, "terms-level")
        used.append(counted)
        whole = F.substring("prefix", -1, 1) == F.lit(_END)
        found.append(counted.where(whole))
        live = counted.where(~whole)
        if live.isEmpty():
            break
        bits = _filter(live, "prefix")
        length *= 2
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    # a term that is over may come again, where its slot is that of a live prefix
    out = materialize(out.select("lang", F.expr("substring(prefix, 1, octet_length(prefix) - 1)").alias("term")).distinct(), "terms-kept")
    discard(*used)
    return out


def _documents(terms: DataFrame, length: int, filters) -> DataFrame:
    """(lang, prefix, n): partial counts of the documents that have a prefix of the length, or a whole
    shorter term, under a live prefix of half the length."""
    half = length // 2

    def run(batches):
        held: dict[tuple, Counter] = {}
        alive: dict[str, _Alive] = {}
        size = 0
        for b in batches:
            for lang, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = blob.splitlines(True)
                if filters is None:
                    prefixes = {t[:length] for t in own}
                else:
                    known = _known(alive, filters, lang)
                    prefixes = {t[:length] for t in own if known[t[:half]]}
                counter = held.setdefault((lang,), Counter())
                size -= len(counter)
                counter.update(prefixes)
                size += len(counter)
                if size >= HELD:
                    yield _rows(held, ["lang", "prefix", "n"])
                    held, size = {}, 0
        if held:
            yield _rows(held, ["lang", "prefix", "n"])

    return terms.select("lang", "terms").mapInArrow(run, "lang string, prefix binary, n long")


class _Numbers(dict):
    """Numbers of a language's terms from 1 on; those that a filter stops are 0."""

    def __init__(self, alive: _Alive):
        super().__init__()
        self.alive, self.names = alive, [b""]

    @property
    def size(self) -> int:
        return len(self.names)

    def __missing__(self, term: bytes) -> int:
        n = 0
        if self.alive[term]:
            n = len(self.names)
            self.names.append(term)
        self[term] = n
        return n


def _sums_of(held: dict, numbers: dict):
    """Batches of (lang, source, term, n) of the sums by number."""
    for (lang, source), added in held.items():
        at = np.flatnonzero(added[1:]) + 1
        names = pa.array(numbers[lang].names, pa.binary()).take(pa.array(at))
        yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array([source] * len(at), pa.string()), names, pa.array(added[at])], names=["lang", "source", "term", "n"])


def _occurrences(terms: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, term, n): partial counts of the terms that a filter of the kept ones lets through."""
    filters = terms.sparkSession.sparkContext.broadcast(_filter(kept, "term"))

    def run(batches):
        numbers: dict[str, _Numbers] = {}
        held: dict[tuple, np.ndarray] = {}
        for b in batches:
            for lang, source, blob, counts in zip(*(b.column(i).to_pylist() for i in range(4))):
                if len(held) >= GROUPS or (lang in numbers and len(numbers[lang]) >= HELD):
                    yield from _sums_of(held, numbers)
                    held, numbers = {}, {}
                if lang not in numbers:
                    numbers[lang] = _Numbers(_Alive(filters.value, lang))
                own = numbers[lang]
                at = np.fromiter(map(own.__getitem__, blob.split()), np.int64)
                added = held.get((lang, source))
                if added is None or len(added) < own.size:
                    wider = np.zeros(max(1024, 2 * own.size), np.int64)
                    wider[: 0 if added is None else len(added)] = 0 if added is None else added
                    held[lang, source] = added = wider
                # a document's terms differ, so no place comes twice but that of the others
                added[at] += np.frombuffer(counts, "<u4")
        yield from _sums_of(held, numbers)

    return terms.mapInArrow(run, "lang string, source string, term binary, n long")


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 kept)) in exact arithmetic, for any counts."""
    up = F.lit(1_000_000_000).cast("decimal(10,0)") * (count + 5).cast("decimal(20,0)")
    return 1 + F.call_function("div", up.cast("decimal(38,0)"), (total + 5 * kept).cast("decimal(38,0)"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of every source of every language.

    Part `pair` ranks the other sources of the language by the sum of differences of the kept
    terms' smoothed shares; part `term` the terms (to rank top) whose share in the source is above
    that in the language.
    """
    terms = clustered_terms(docs)
    kept = kept_terms(terms, min_docs)
    counts = _occurrences(terms, kept).groupBy("lang", "source", "term").agg(F.sum("n").alias("n")).join(kept, ["lang", "term"])
    counts = materialize(counts.select("lang", "source", "term", "n"), "terms-counts")

    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    groups = terms.select("lang", "source").groupBy("lang", "source").count().drop("count")
    groups = groups.join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"))
    zero = F.when(F.col("v") > 0, _share(F.lit(0), F.col("total"), F.col("v")))
    groups = materialize(groups.withColumn("zero", zero), "terms-groups")

    shares = counts.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("v")))
    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    totals = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.first("v").alias("v"))
    of_lang = whole.join(totals, "lang").select("lang", "term", _share(F.col("n"), F.col("total"), F.col("v")).alias("q"))
    over = shares.join(of_lang, ["lang", "term"]).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = over.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    other = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(other, "lang").where("source <> item")
    pairs = pairs.join(_distances(shares, groups), ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))

    out = materialize(pairs.unionByName(over), "terms-audit")
    discard(terms, kept, counts, groups)
    return out


def _distances(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of the pairs of sources, both ways: the sum of |p - q| over the
    kept terms of the language.  A term's row has the shares of all sources in order, so a task sums
    whole matrices of its terms; sums of tasks are added up by pair."""
    order = groups.where("v > 0").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "zero"))).alias("sources"))
    term = shares.groupBy("lang", "term").agg(F.map_from_entries(F.collect_list(F.struct("source", "p"))).alias("p"))
    dense = F.transform("sources", lambda s: F.coalesce(F.try_element_at("p", s["source"]), s["zero"]))
    rows = term.join(order, "lang").select("lang", dense.alias("p"))

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            shares_of = b.column(1)
            for lang in sorted(set(langs)):
                rows_of = shares_of.filter(pa.array(langs == lang))
                p = rows_of.flatten().to_numpy(zero_copy_only=False).reshape(len(rows_of), -1)
                n = p.shape[1]
                if n <= MATRIX_SOURCES:
                    sums.setdefault(lang, np.zeros((n, n), np.int64))
                for at in range(0, n, BLOCK):
                    block = np.stack([np.abs(p - p[:, [a]]).sum(0) for a in range(at, min(n, at + BLOCK))])
                    if n <= MATRIX_SOURCES:
                        sums[lang][at : at + BLOCK] += block
                    else:
                        yield _sums(lang, at, block)
        for lang, s in sums.items():
            yield _sums(lang, 0, s)

    added = rows.mapInArrow(run, "lang string, a int, b int, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    place = order.select("lang", F.posexplode("sources").alias("at", "s")).select("lang", "at", F.col("s.source").alias("name"))
    one = place.select("lang", F.col("at").alias("a"), F.col("name").alias("source"))
    two = place.select("lang", F.col("at").alias("b"), F.col("name").alias("item"))
    return added.where("a <> b").join(one, ["lang", "a"]).join(two, ["lang", "b"]).select("lang", "source", "item", "value")


def _sums(lang: str, at: int, block: np.ndarray) -> pa.RecordBatch:
    a, b = np.indices(block.shape, np.int32)
    return pa.record_batch([pa.array([lang] * block.size, pa.string()), pa.array(a.ravel() + np.int32(at)), pa.array(b.ravel()), pa.array(block.ravel())], names=["lang", "a", "b", "value"])

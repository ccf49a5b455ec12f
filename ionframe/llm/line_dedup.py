"""Fuzzy line deduplication in DataFrame expressions only.

Lines are normalised (lower case, runs of ASCII characters other than letters and digits to
one blank) and equal ones become one node, numbered where it is written.  A node has the
64-bit SimHash of its word pairs (each word with the next; the last alone): single words are
so common that unrelated lines would have near fingerprints, and the more so the more lines
there are.  Two nodes are linked if they are candidates and the edit similarity of their
normalised lines is at least SIMILARITY; of every connected group the first occurrence (least
doc_id, then line number) is kept.  Candidates are pairs

- whose fingerprints differ in at most MAX_BITS bits (one changed word moves more than that in
  most lines, so this index alone misses most fuzzy copies), or
- whose sketches agree in one triple of TRIPLES and whose fingerprints differ in at most
  WIDE_BITS bits; a sketch has nine minima of the word pairs' hashes, each equal in two lines
  with the probability of their word pairs' Jaccard index, or
- of at most SHORT_WORDS words that are equal after one word is taken out of one or both, or
- of at most SHORT_CHARS characters: all that edits of that similarity can link.

Fingerprints meet in pigeonhole blocks: the fingerprint is cut into b blocks, of which at most
MAX_BITS differ, so each choice of b - MAX_BITS blocks is an index key and a pair agrees on
one of them.  b is the least for which the keys have a few bits more than there are nodes to
tell apart, so that chance meetings stay in proportion to the input.

No bucket is expanded into all its pairs.  First each member is compared with the bucket's
first and with its neighbours in two orders; in buckets that hold several groups still, with
its neighbours of other groups in four more orders; then only members of one bucket that are
still in different groups are compared, in chunks of LONG_BUCKET members by LONG_BUCKET, each
pair of chunks on its own.  A pair that was skipped is in one group already, so no link
between groups is lost.

A line is known by its row (numbered where the lines are written, so equal rows differ) and
its place in the row's text.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, discard, materialize

MAX_BITS = 3
SIMILARITY = 0.8
#: Bits by which fingerprints of lines with a common triple may differ: unrelated ones differ
#: in 32 +- 4, lines with a Jaccard index of 0.45 in some 20.
WIDE_BITS = 26
#: The lines of the affine plane of nine points: any five points hold one.
TRIPLES = [(0, 1, 2), (3, 4, 5), (6, 7, 8), (0, 3, 6), (1, 4, 7), (2, 5, 8), (0, 4, 8), (1, 5, 6), (2, 3, 7), (0, 5, 7), (1, 3, 8), (2, 4, 6)]
SHORT_WORDS = 9
SHORT_CHARS = 14
#: Most places of candidate lines that are broadcast to the scan that fetches their texts
#: (some 40 bytes each); beyond it the texts are joined by a shuffle.
BROADCAST_PLACES = 500_000
#: Members of a chunk in which the members of a bucket are compared.
LONG_BUCKET = 1000
#: Characters of the longer line times most edits from which a pair that no script links is cut at
#: common words before an edit distance is computed; a piece's area beyond it is not computed either.
LONG_AREA = 4_000_000
#: Neighbouring words that have to be the same, and be once in either line, where lines are cut.
_ANCHOR = 3
#: Words that are counted together: the bytes of a counter hold so many without a sign bit.
_PART = 126
_ONES = 0x0101010101010101
#: A minimum of the sketch has so many bits; three lie in a long.
_SKETCH_BITS = 21
_FLIPS = [(0x9E3779B97F4A7C15 * (k + 1) % 2**64) - 2**63 for k in range(9)]


def _words(line: str) -> str:
    """SQL for a line's normalised words."""
    return rf"array_remove(split(lower({line}), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), '')"


#: SQL for 0: an expression with this fence in it is computed once, where it is named; merged into a
#: filter or into other expressions, it would be computed at every mention.
_FENCE = "cast(rand(0) as int)"


def _once(expr: str) -> str:
    """SQL for the array expr behind a fence."""
    return f"if({_FENCE} = 0, {expr}, null)"


def _majority_short() -> str:
    """SQL for the bits that are set in over half of n words, n being _PART at most: the bytes of
    a0..a7 are compared with half of n all at once."""
    # the top byte is compared apart: its sum could reach the sign bit
    low = _ONES & ~(1 << 56)
    return " | ".join(
        f"shiftleft((shiftrightunsigned((a{k} & {(1 << 56) - 1}L) + {low}L * (127 - n div 2), 7) & {low}L)"
        f" | if(2 * shiftrightunsigned(a{k}, 56) > n, {1 << 56}L, 0L), {k})"
        for k in range(8)
    )


def _documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text): the hash tells texts of one doc_id apart."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return d.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


_LINE = ["row", "doc_id", "text_hash", "pos", "k1", "k2", "short", "len", "n"]


def lines(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text_hash, pos, k1, k2, short, len, n, fp, s0, s1, s2) for every line that has a
    letter, digit or non-ASCII character; k1, k2 identify the normalised line, short is the line
    itself where it has at most SHORT_WORDS words, len and n are its numbers of characters and
    words, s0..s2 hold its sketch.  Lines are split at \\n, pos is from 0.

    The hash of a word pair adds one to the counters of its bits; eight counters lie in the bytes of a
    long, so a row of eight sums counts all 64 bits.  The sums are made where the words are
    (before the shuffle), in parts of _PART words.
    """
    return _whole_lines(_line_parts(docs))


def _line_parts(docs: DataFrame) -> DataFrame:
    # rows are numbered below the generator, which would number the lines
    d = _documents(docs).withColumn("row", F.monotonically_increasing_id())
    e = d.select("row", "doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = e.select("row", "doc_id", "text_hash", "pos", F.expr(_once(_words("line"))).alias("w")).where("size(w) > 0")
    # keys and size before the words are exploded: beside the generator they'd be computed for each word
    w = w.select("row", "doc_id", "text_hash", "pos", "w", *_keys("w"), F.when(F.size("w") <= SHORT_WORDS, F.array_join("w", " ")).alias("short"), F.char_length(F.array_join("w", " ")).alias("len"), F.size("w").alias("n"))
    x = w.select(*_LINE, "w", F.posexplode("w").alias("i", "word"))
    x = x.select(*_LINE, F.expr(f"i div {_PART}").alias("part"), F.xxhash64("word", F.get("w", F.col("i") + 1)).alias("h"))
    sums = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(_ONES))).alias(f"a{k}") for k in range(8)]
    least = [F.min(F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(c)), 64 - _SKETCH_BITS)).alias(f"q{k}") for k, c in enumerate(_FLIPS)]
    parts = x.groupBy(*_LINE, "part").agg(*sums, *least)
    # one pass: the counters stay only where a line has several parts
    is_short = F.col("n") <= _PART
    parts = parts.select(*_LINE, "part", F.when(is_short, F.expr(_majority_short())).alias("fp"), *(F.when(~is_short, F.col(f"a{k}")).alias(f"a{k}") for k in range(8)), *_packed())
    return materialize(parts, "line-parts")


def _whole_lines(parts: DataFrame) -> DataFrame:
    is_short = F.col("n") <= _PART
    short = parts.where(is_short).select(*_LINE, "fp", "s0", "s1", "s2")
    wide = [F.sum(F.expr(f"shiftrightunsigned(a{k}, {8 * j}) & 255L")).alias(f"b{8 * j + k}") for k in range(8) for j in range(8)]
    long = parts.where(~is_short).groupBy(*_LINE).agg(*wide, *(F.min(_unpacked(k)).alias(f"q{k}") for k in range(9)))
    long = long.select(*_LINE, F.expr(" | ".join(f"if(2 * b{b} > n, shiftleft(1L, {b}), 0L)" for b in range(64))).alias("fp"), *_packed())
    return short.unionByName(long)


def _packed():
    return [F.expr(" | ".join(f"shiftleft(q{3 * i + k}, {_SKETCH_BITS * k})" for k in range(3))).alias(f"s{i}") for i in range(3)]


def _unpacked(k: int):
    return F.shiftrightunsigned(f"s{k // 3}", _SKETCH_BITS * (k % 3)).bitwiseAND(F.lit((1 << _SKETCH_BITS) - 1))


def _keys(words: str):
    return F.expr(f"xxhash64({words})").alias("k1"), F.expr(f"xxhash64(1L, {words})").alias("k2")


def blocks(n: int) -> int:
    """How many blocks to cut fingerprints of n nodes into."""
    b = MAX_BITS + 2
    while b < 16 and (64 // b) * (b - MAX_BITS) < n.bit_length() + 3:
        b += 1
    return b


def _bits(key: str):
    """The most bits by which fingerprints under a key may differ; the key's low bits tell it."""
    return F.expr(f"case {key} & 3 when 0 then {MAX_BITS} when 1 then {WIDE_BITS} else 64 end")


def _key(kind: int, *cols):
    return F.xxhash64(*cols).bitwiseAND(F.lit(~3)).bitwiseOR(F.lit(kind))


def _index(nodes: DataFrame, b: int) -> DataFrame:
    edges = [64 * i // b for i in range(b + 1)]
    piece = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges[:-1], edges[1:])]
    keys = [_key(0, F.lit(no), *(piece[i] for i in chosen)) for no, chosen in enumerate(itertools.combinations(range(b), b - MAX_BITS))]
    keys += [_key(1, F.lit(-1 - no), *(_unpacked(k) for k in t)) for no, t in enumerate(TRIPLES)]
    return nodes.select(F.explode(F.array(*keys)).alias("key"), "node")


def _short_index(nodes: DataFrame) -> DataFrame:
    """Keys of the lines of few words or characters: what is left without one word, or after
    every choice of as many deletions as the similarity allows edits."""
    t = nodes.where("short is not null").select("node", F.col("short").alias("line"), F.split("short", " ").alias("words"))
    words = F.expr("array_append(transform(sequence(0, size(words) - 1), i -> xxhash64(-100L, concat(slice(words, 1, i), slice(words, i + 2, size(words))))), xxhash64(-100L, words))")
    drop = "flatten(transform({0}, v -> transform(sequence(1, greatest(1, char_length(v))), i -> concat(substring(v, 1, i - 1), substring(v, i + 1)))))"
    # up to 4 characters allow no edit, up to 9 one and up to 14 two
    t = t.withColumn("d0", F.when(F.char_length("line").between(5, SHORT_CHARS), F.array("line")))
    t = t.withColumn("d1", F.expr(f"array_distinct({drop.format('d0')})"))
    t = t.withColumn("d2", F.when(F.char_length("line") > 9, F.expr(f"array_distinct({drop.format('d1')})")))
    none = F.array().cast("array<string>")
    chars = F.concat(*(F.coalesce(F.col(c), none) for c in ("d0", "d1", "d2")))
    # without its only word every line would be the same
    keys = F.concat(F.when(F.size("words") > 1, words).otherwise(F.array().cast("array<long>")), F.transform(chars, lambda v: F.xxhash64(F.lit(-101), v)))
    return t.select(F.explode(F.array_distinct(F.transform(keys, lambda k: k.bitwiseAND(F.lit(~3)).bitwiseOR(F.lit(2))))).alias("key"), "node")


def _texts(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, words) of the wanted nodes, read again where they first occur."""
    places = nodes.join(wanted.distinct(), "node", "left_semi").select("node", "k1", "k2", "first.doc_id", "first.text_hash", "first.pos")
    places = materialize(places, "line-places")
    at = places.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("pos", "k1", "k2", "node")).alias("at"))
    at = at.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "at")
    if places.count() <= BROADCAST_PLACES:
        at = F.broadcast(at)
    t = _documents(docs).join(at, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")))
    t = t.select(F.split("text", "\n").alias("l"), F.explode("at").alias("p"))
    t = t.select("p.node", "p.k1", "p.k2", F.expr(_once(_words("get(l, p.pos)"))).alias("words")).where("xxhash64(words) = k1 and xxhash64(1L, words) = k2")
    # rows that are repeated give a text as often
    texts = materialize(t.select("node", "words").dropDuplicates(["node"]), "line-texts")
    discard(places)
    return texts


#: SQL for the length of one script of edits from the words x to y, which goes through both once
#: and at a difference puts in a word of y, takes out one of x or changes one to the other.
_SCRIPT = """aggregate(x, struct(0 as i, 0 as j, 0 as c), (a, v) -> case
    when get(y, a.j) = v then struct(a.i + 1 as i, a.j + 1 as j, a.c as c)
    when get(y, a.j + 1) = v then struct(a.i + 1 as i, a.j + 2 as j, a.c + char_length(get(y, a.j)) + 1 as c)
    when a.j >= size(y) or get(x, a.i + 1) = get(y, a.j) then struct(a.i + 1 as i, a.j as j, a.c + char_length(v) + 1 as c)
    else struct(a.i + 1 as i, a.j + 1 as j, a.c + levenshtein(v, get(y, a.j)) as c) end,
    a -> a.c + aggregate(slice(y, a.j + 1, greatest(size(y) - a.j, 0)), 0, (t, w) -> t + char_length(w) + 1))"""


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The written pairs (a, b) of nodes whose lines are similar enough; pairs are used up.

    Words that both lines begin and end with are taken off before the edit distance is
    computed, which does not change it.  A script of edits word by word is tried first: where
    it is short enough, so is the edit distance, which takes the square of the length to find.
    A long pair without such a script is held to the numbers of its letters and then cut at
    words that both lines have once; only what neither decides takes the square.
    """
    texts = _texts(pairs.select(F.explode(F.array("a", "b")).alias("node")), nodes, docs)
    j = pairs.join(texts.select(F.col("node").alias("a"), F.col("words").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("words").alias("y")), "b")
    length = "aggregate({0}, -1, (t, w) -> t + 1 + char_length(w))"
    fence = _FENCE  # behind each step
    same = "array_position(zip_with({0}, {1}, (v, w) -> v <=> w), false) - 1"
    j = j.withColumns({
        "most": F.expr(f"cast(floor({1 - SIMILARITY:.6f} * greatest({length.format('x')}, {length.format('y')}) + 1e-9) as int) + {fence}"),
        "p": F.expr(f"int({same.format('x', 'y')}) + {fence}"),
        "r": F.expr(f"int({same.format('reverse(x)', 'reverse(y)')}) + {fence}"),
    })
    j = j.withColumn("s", F.expr(f"least(r, least(size(x), size(y)) - p) + {fence}"))
    j = j.select("a", "b", "most", F.expr(fence).alias("fence"), *(F.expr(f"slice({c}, p + 1, size({c}) - p - s)").alias(c) for c in "xy"))
    j = j.withColumn("script", F.expr(f"{_SCRIPT} + {fence}"))
    exact = "levenshtein(array_join(x, ' '), array_join(y, ' '), most) >= 0"
    j = j.withColumn("large", F.expr(f"if(script > most and {_AREA} > {LONG_AREA}L, 1, 0) + {fence}"))
    j = j.withColumn("near", F.expr(f"if(script <= most or (large = 0 and {exact}), 1, 0) + {fence}"))
    # one pass finds both the near pairs and the long ones, whose words it keeps
    judged = materialize(j.where("near = 1 or large = 1").select("a", "b", "most", "near", *(F.when(F.col("large") == 1, F.col(c)).alias(c) for c in "xy")), "line-judged")
    discard(texts, pairs)
    edges = judged.where("near = 1").select("a", "b")
    long = judged.where("x is not null").select("a", "b", "most", "x", "y")
    if long.isEmpty():
        edges.written_at = judged.written_at
        return edges
    cut = _by_anchors(long.where(F.expr(_letters_apart("x", "y"))))
    edges = materialize(edges.unionByName(cut.where(F.expr(f"script <= most or {exact}")).select("a", "b")), "line-edges")
    discard(judged)
    return edges


#: SQL for what the edit distance of the words x and y takes, in steps.
_AREA = "most * aggregate(if(size(x) > size(y), x, y), 0L, (t, w) -> t + char_length(w) + 1)"


def _letters_apart(x: str, y: str) -> str:
    """SQL for whether the numbers of each letter and digit leave the lines near enough: an edit
    takes away one character at most, and brings one."""
    alphabet = "abcdefghijklmnopqrstuvwxyz0123456789"
    # the line is bound to t, or it would be joined for each letter
    one = f"transform(split('{alphabet}', ''), v -> char_length(t) - char_length(replace(t, v, '')))"
    counts = [f"transform(array(array_join({c}, ' ')), t -> {one})[0]" for c in (x, y)]
    sums = [f"aggregate(zip_with({p}, {q}, (v, w) -> greatest(v - w, 0)), 0, (t, v) -> t + v)" for p, q in (counts, counts[::-1])]
    return f"greatest({', '.join(sums)}) <= most"


def _by_anchors(long: DataFrame) -> DataFrame:
    """long with the length of a script of edits that goes through both lines from one anchor to
    the next: an anchor is a place of _ANCHOR words that are once in x and once in y, in one order
    with all other anchors.  Between them the edit distance is computed, or for a large piece
    bounded by its length.  All but that takes steps in proportion to the lines' words."""
    pair = ["a", "b"]

    def once(words: str, at: str) -> DataFrame:
        # word by word: a slice would copy all of the line for each place
        some = ", ".join(f"get({words}, i + {k})" for k in range(_ANCHOR))
        places = F.expr(f"transform(sequence(0, size({words}) - {_ANCHOR}), i -> xxhash64({some}))")
        w = long.where(f"size({words}) >= {_ANCHOR}").select(*pair, F.posexplode(places).alias(at, "h"))
        return w.groupBy(*pair, "h").agg(F.min(at).alias(at), F.count("*").alias("n")).where("n = 1").drop("n")

    met = once("x", "i").join(once("y", "j"), [*pair, "h"])
    in_order = Window.partitionBy(*pair).orderBy("i")
    # Spark goes through frames that begin with the partition once, through those that end with it for each row
    earlier = lambda order: Window.partitionBy(*pair).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumns({"low": F.coalesce(F.max("j").over(earlier(F.col("i"))), F.lit(-1)), "high": F.min("j").over(earlier(F.col("i").desc()))})
    met = met.where("low < j and (high is null or j < high)")
    # pieces between an anchor and the one before; those without words have no edits
    met = met.select(*pair, "i", "j", F.lag("i", 1, -1).over(in_order).alias("i0"), F.lag("j", 1, -1).over(in_order).alias("j0"))
    pieces = met.groupBy(*pair).agg(F.max("i").alias("i1"), F.max("j").alias("j1"), F.collect_list(F.when((F.col("i") - F.col("i0") > 1) | (F.col("j") - F.col("j0") > 1), F.struct("i0", "i", "j0", "j"))).alias("pieces"))
    whole = long.join(pieces, pair, "left")
    last = F.expr("struct(coalesce(i1, -1) as i0, size(x) as i, coalesce(j1, -1) as j0, size(y) as j)")
    none = F.expr("slice(array(struct(0 as i0, 0 as i, 0 as j0, 0 as j)), 1, 0)")
    whole = whole.withColumn("pieces", F.concat(F.coalesce("pieces", none), F.array(last)))
    # every word is taken with a blank behind it
    text = "if(p.{1} - p.{1}0 > 1, concat(array_join(transform(sequence(p.{1}0 + 1, p.{1} - 1), k -> get({0}, k)), ' '), ' '), '')"
    whole = whole.withColumn("pieces", F.expr(f"transform(pieces, p -> struct({text.format('x', 'i')} as x, {text.format('y', 'j')} as y))"))
    longest = "greatest(char_length(p.x), char_length(p.y))"
    cost = f"if(cast(char_length(p.x) as long) * char_length(p.y) > {LONG_AREA}L, {longest}, levenshtein(p.x, p.y))"
    return whole.select(*pair, "most", "x", "y", F.expr(f"aggregate(transform(pieces, p -> {cost}), 0L, (t, c) -> t + c) + cast(rand(0) as int)").alias("script"))


def _may_link():
    """Whether fingerprints are near enough for the key, and lengths for the similarity."""
    longer = F.greatest("na", "nb")
    near = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= _bits("key")
    return near & (longer - F.least("na", "nb") <= F.floor(F.lit(round(1 - SIMILARITY, 6)) * longer + 1e-9))


def _neighbours(members: DataFrame, orders: list, hub: bool) -> DataFrame:
    """The pairs of members (key, node, g, fp, ...) of different groups g that are neighbours
    in one of the bucket's orders (or, with hub, one of which is first in the first order) and
    whose fingerprints and lengths are near enough: a few pairs for each member."""
    me = F.struct("node", "g", "fp", "len")
    others = []
    for o in orders:
        w = Window.partitionBy("key").orderBy(*o, "node")
        others += [F.lag(me).over(w), *([F.first(me).over(w)] if hub and not others else [])]
    p = members.select("key", F.col("node").alias("a"), F.col("g").alias("ga"), F.col("fp").alias("fa"), F.col("len").alias("na"), F.array(*others).alias("o")).select("key", "a", "ga", "fa", "na", F.explode("o").alias("o"))
    p = p.select("key", "a", "ga", "fa", "na", F.col("o.node").alias("b"), F.col("o.g").alias("gb"), F.col("o.fp").alias("fb"), F.col("o.len").alias("nb")).where(F.col("b").isNotNull() & (F.col("ga") != F.col("gb")) & _may_link())
    return p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _mixed(met: DataFrame, groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """The members of buckets that hold several groups still, with the chunks to compare them in."""
    m = met.join(groups, "node", "left").select("key", "node", F.coalesce("component", "node").alias("g"))
    mixed = m.groupBy("key").agg(F.count("*").alias("size"), F.min("g").alias("lo"), F.max("g").alias("hi")).where("size > 2 and lo <> hi")
    return m.join(mixed.select("key", F.ceil(F.col("size") / LONG_BUCKET).cast("int").alias("chunks")), "key").join(nodes.select("node", "fp", "len", "s0", "s1", "s2"), "node")


def _late_pairs(mixed: DataFrame) -> DataFrame:
    """The near pairs of one bucket that lie in different groups, chunk by chunk."""
    m = mixed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("other", F.expr("sequence(0, chunks - 1)"))
    x = m.select("key", F.col("own").alias("i"), F.explode("other").alias("j"), F.col("node").alias("a"), F.col("g").alias("ga"), F.col("fp").alias("fa"), F.col("len").alias("na"))
    y = m.select("key", F.explode("other").alias("i"), F.col("own").alias("j"), F.col("node").alias("b"), F.col("g").alias("gb"), F.col("fp").alias("fb"), F.col("len").alias("nb"))
    return x.join(y, ["key", "i", "j"]).where((F.col("a") < F.col("b")) & (F.col("ga") != F.col("gb")) & _may_link()).select("a", "b").distinct()


def _joined(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """The groups (node, component) after edges (a, b) between their nodes or new ones: only groups
    that an edge meets are gone through again.  A component stays the least node of its group."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("g"))
    ends = materialize(ends, "line-ends")
    between = edges.join(ends.select(F.col("node").alias("a"), F.col("g").alias("ga")), "a").join(ends.select(F.col("node").alias("b"), F.col("g").alias("gb")), "b")
    step = connected_components(between.select(F.col("ga").alias("a"), F.col("gb").alias("b"))).select(F.col("node").alias("g"), F.col("component").alias("to"))
    new = ends.join(groups, "node", "left_anti")
    known = groups.select("node", F.col("component").alias("g")).unionByName(new)
    out = materialize(known.join(step, "g", "left").select("node", F.coalesce("to", "g").alias("component")), "line-joined")
    discard(ends, step)
    return out


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines, and (k1, k2, head) of those whose class has more than one occurrence."""
    parts = _line_parts(docs)
    # a line's first part names it
    found = parts.where("part = 0").select("row", "doc_id", "text_hash", "pos", "k1", "k2")
    nodes = _whole_lines(parts).groupBy("k1", "k2", "short", "len").agg(
        F.min(F.struct("doc_id", "pos", "row", "text_hash")).alias("first"), F.count("*").alias("n"), F.min("fp").alias("fp"), *(F.min(f"s{i}").alias(f"s{i}") for i in range(3)))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "line-nodes")
    # streaming functions of the sorted bucket; a bucket of one is dropped
    ordered = Window.partitionBy("key").orderBy("node")
    index = _index(nodes, blocks(nodes.count())).unionByName(_short_index(nodes))
    met = index.select("key", "node", F.lag("node").over(ordered).alias("prev"), F.lead("node").over(ordered).alias("next"))
    met = materialize(met.where("prev is not null or next is not null").select("key", "node"), "line-index")
    members = met.join(nodes.select("node", "fp", "len", F.col("node").alias("g")), "node")
    edges = _verified(materialize(_neighbours(members, [["fp"], []], hub=True), "line-pairs"), nodes, docs)
    groups = connected_components(edges)
    discard(edges)
    turned = F.expr("shiftleft(fp, 32) | shiftrightunsigned(fp, 32)")
    # once by neighbours in other orders, then whatever is in different groups still
    for orders in ([[turned], ["s0"], ["s1"], ["s2"]], None):
        mixed = _mixed(met, groups, nodes)
        late = materialize(_neighbours(mixed, orders, hub=False) if orders else _late_pairs(mixed), "line-late")
        if not late.isEmpty():
            more = _verified(late, nodes, docs)
            joined = _joined(groups, more)
            discard(more, groups)
            groups = joined
    discard(met)
    named = nodes.join(groups, "node", "left").select("k1", "k2", "first", "n", F.coalesce("component", "node").alias("g"))
    named = materialize(named, "line-groups")
    total = named.groupBy("g").agg(F.min("first").alias("head"), F.sum("n").alias("total")).where("total > 1").select("g", "head")
    heads = materialize(named.join(total, "g").select("k1", "k2", "head"), "line-heads")
    discard(nodes, named, groups)
    return found, heads


def _occurrences(found: DataFrame, heads: DataFrame) -> DataFrame:
    """Every line of a class with its head and whether it is that; a very common line is one
    key of the lines' side only, which Spark splits where it is too large for a task."""
    kept = (F.col("row") == F.col("head.row")) & (F.col("pos") == F.col("head.pos"))
    return found.join(heads, ["k1", "k2"]).select("row", "doc_id", "text_hash", "pos", "head", kept.alias("kept"))


def line_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, class_doc_id, class_line_no, kept) for every line whose class has
    more than one occurrence; the class is named by its first occurrence (least doc_id, then
    line number), the only one kept.

    Null and empty texts have no lines to compare; lines without a letter, digit or non-ASCII
    character are in no class.  A null doc_id is less than any other.  Rows that repeat a
    doc_id, or all of a row, are documents of their own: of their equal lines one is kept.
    """
    return _occurrences(*_classes(docs)).select("doc_id", F.col("pos").alias("line_no"), F.col("head.doc_id").alias("class_doc_id"), F.col("head.pos").alias("class_line_no"), "kept")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the lines of text that are not kept taken out; every row and column stays (a
    text can become empty), rows without such lines are unchanged.

    A row is known by its doc_id and text.  Of rows that repeat both, every line has a copy in
    the first of them, so the others (any, as rows have no order) keep only lines without a
    letter, digit or non-ASCII character.
    """
    found, heads = _classes(docs)
    own = ["doc_id", "text_hash"]
    rows = found.groupBy(*own).agg(F.min("row").alias("least"), F.max("row").alias("most"))
    again = materialize(rows.where("least <> most").select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")), "line-again")
    # a head is in the least row of its doc_id and line number; of equal rows that is the first
    gone = _occurrences(found, heads).where("not kept").groupBy("row", *own).agg(F.collect_set("pos").alias("gone"))
    first = rows.select(F.col("least").alias("row"))
    gone = materialize(gone.join(first, "row", "left_semi").select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), F.col("gone").alias("_gone")), "line-gone")
    names = docs.columns
    d = docs.select(F.struct(*names).alias("_all"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_text_hash"))
    same = F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_text_hash") == F.col("_hash"))
    left = F.expr("array_join(filter(split(_all.text, '\\n'), (l, i) -> not array_contains(_gone, i)), '\\n')")

    def shortened(rows: DataFrame, text) -> DataFrame:
        return rows.withColumn("_new", text).select(*(F.col("_new").alias(n) if n == "text" else F.col("_all")[n].alias(n) for n in names))

    text = F.when(F.col("_gone").isNull(), F.col("_all.text")).otherwise(left)
    if again.isEmpty():
        return shortened(d.join(gone, same, "left"), text)
    once = d.join(again, same, "left_anti")
    # the rows that are repeated, numbered where they are written
    many = materialize(d.join(again, same, "left_semi").withColumn("_row", F.monotonically_increasing_id()), "line-repeated")
    one = many.groupBy("_id", "_text_hash").agg(F.min("_row").alias("_row")).select("_row")
    others = F.expr(f"array_join(filter(split(_all.text, '\\n'), l -> size({_words('l')}) = 0), '\\n')")
    parts = once.unionByName(many.join(one, "_row", "left_semi").drop("_row")).join(gone, same, "left")
    return shortened(parts, text).unionByName(shortened(many.join(one, "_row", "left_anti"), others))

"""Runs of periodic words in texts, found in a grammar of the text.

A run is a stretch of words with smallest period q, of at least MIN_WORDS words and two periods,
that can't be extended with that period.  A text's words are compressed by Re-Pair: the most
frequent pair of symbols becomes a rule until no pair is left twice.  A run lies somewhere under
the lowest node of the derivation that holds it, and there it crosses the border between the node's
two parts.  So for each rule once (and for each node of a balanced tree over the symbols that are
left) the repetitions that cross its border are found, translated to all places where the rule is
derived, and of those with the same period the ones that lie in others are merged into them.

Repetitions over a border b: the word before (after) b recurs at a distance q, and the common
extensions of both places to the right and left, inside the node, add up to q at least.  Extensions
come from names of all blocks of 2^k words (equal names, equal words), so they are exact and take
O(log n) steps for all q at once.

Only stretches where six words recur at a distance of at most half the stretch are compressed.  A
run has six words in a row that recur after one period and each of its words is in such six, so
every run lies inside one such stretch: this leaves nothing out, whatever the text, and saves the
grammar for most texts.  A text is worked on as a whole in one task; memory is linear in its length
(names: times log2 of the longest stretch).
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 12
#: Words that recur in every run: MIN_WORDS - q of them for periods up to half of it, q beyond.
GRAM = MIN_WORDS // 2
#: Times that the stretches are narrowed; more would only make them tighter.
NARROW = 3
_MIX = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) ** 5) & (2**64 - 1) for i in range(GRAM)], np.uint64)


def split_words(text: str | None) -> list[bytes]:
    """The words of a text: bytes are split at the six ASCII white-space characters only."""
    return (text or "").encode("utf-8", "replace").split()


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the periodic tail that the id of every tenth document, by hash, gives."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def stretches(h: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of the parts of a sequence of word hashes that can hold runs."""
    todo, out = [(0, len(h), 0)], []
    while todo:
        lo, hi, times = todo.pop()
        n = hi - lo
        if n < MIN_WORDS:
            continue
        if times == NARROW:
            out.append((lo, hi))
            continue
        m = n - GRAM + 1
        g = h[lo : lo + m] * _MIX[0]
        for k in range(1, GRAM):
            g += h[lo + k : lo + k + m] * _MIX[k]
        s = np.sort(g)
        if not (s[1:] == s[:-1]).any():
            continue
        order = np.argsort(g, kind="stable")
        again = (g[order[1:]] == g[order[:-1]]) & (order[1:] - order[:-1] <= n // 2)
        starts = np.unique(np.concatenate([order[1:][again], order[:-1][again]]))
        if not len(starts):
            continue
        cut = np.flatnonzero(np.diff(starts) > GRAM)
        first, last = starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])] + GRAM
        same = len(first) == 1 and first[0] == 0 and last[0] == n
        todo += [(lo + a, lo + b, NARROW if same else times + 1) for a, b in zip(first.tolist(), last.tolist())]
    return sorted(out)


def re_pair(seq: list[int]) -> tuple[list[tuple[int, int]], list[int]]:
    """(rules, symbols): rule k stands for symbol max(seq) + 1 + k and is a pair of symbols made
    before; the symbols that are left have no pair twice.  Of equally frequent pairs the one seen
    first is taken, which keeps derivations of periodic text shallow."""
    n = len(seq)
    sym, after, before = list(seq), list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], list[int]] = {}
    count: dict[tuple[int, int], int] = {}

    def note(pair: tuple[int, int], at: int) -> None:
        seen = places.setdefault(pair, [])
        if pair[0] == pair[1] and seen and after[seen[-1]] == at:
            return  # of three equal symbols only the first two are a pair
        seen.append(at)
        count[pair] = len(seen)

    for i in range(n - 1):
        note((sym[i], sym[i + 1]), i)
    serial = 0
    heap: list[tuple[int, int, tuple[int, int]]] = []
    for pair, c in count.items():
        if c > 1:
            heap.append((-c, serial, pair))
            serial += 1
    heapq.heapify(heap)
    rules: list[tuple[int, int]] = []
    base = max(seq) + 1
    while heap:
        c, order, pair = heapq.heappop(heap)
        now = count[pair]
        if now < -c:
            if now > 1:
                heapq.heappush(heap, (-now, order, pair))
            continue
        a, b = pair
        left: list[int] = []
        taken = -1
        for i in places.pop(pair):
            if sym[i] == a and i != taken:
                j = after[i]
                if j < n and sym[j] == b:
                    left.append(i)
                    taken = j
        count[pair] = 0
        if len(left) < 2:
            continue
        new = base + len(rules)
        rules.append(pair)
        for i in left:
            j = after[i]
            h, k = before[i], after[j]
            if h >= 0 and (x := (sym[h], a)) in count:
                count[x] -= 1
            if k < n:
                if (x := (b, sym[k])) in count:
                    count[x] -= 1
                before[k] = i
            sym[i], sym[j] = new, -1
            after[i] = k
        fresh: dict[tuple[int, int], None] = {}
        for i in left:
            h, k = before[i], after[i]
            if h >= 0 and sym[h] != new:
                note((sym[h], new), h)
                fresh[sym[h], new] = None
            if k < n:
                note((new, sym[k]), i)
                fresh[new, sym[k]] = None
        for x in fresh:
            if count[x] > 1:
                heapq.heappush(heap, (-count[x], serial, x))
                serial += 1
    out, i = [], 0
    while i < n:
        out.append(sym[i])
        i = after[i]
    return rules, out


class Extensions:
    """Longest common extensions of places of a sequence, to the right and left."""

    def __init__(self, t: np.ndarray):
        self.names = [t]

    def _level(self, k: int) -> np.ndarray:
        while len(self.names) <= k:
            last, half = self.names[-1], 1 << (len(self.names) - 1)
            both = last[:-half] * (int(last.max()) + 1) + last[half:]
            self.names.append(np.unique(both, return_inverse=True)[1].astype(np.int64))
        return self.names[k]

    def right(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many words from x and y on are equal, up to limit (which keeps both inside)."""
        done = np.zeros(len(x), np.int64)
        for k in range(int(limit.max(initial=0)).bit_length() - 1, -1, -1):
            names = self._level(k)
            fits = done + (1 << k) <= limit
            i, j = np.where(fits, x + done, 0), np.where(fits, y + done, 0)
            done += (fits & (names[i] == names[j])) << k
        return done

    def left(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """The same for the words that end at x and y."""
        done = np.zeros(len(x), np.int64)
        for k in range(int(limit.max(initial=0)).bit_length() - 1, -1, -1):
            names = self._level(k)
            fits = done + (1 << k) <= limit
            i, j = np.where(fits, x - done - (1 << k) + 1, 0), np.where(fits, y - done - (1 << k) + 1, 0)
            done += (fits & (names[i] == names[j])) << k
        return done


def crossing(t: np.ndarray, ext: Extensions, lo: int, b: int, hi: int) -> np.ndarray:
    """(start, end, q) of the repetitions inside t[lo:hi] that hold both words beside b, as far as
    they reach inside; of those with one start and end the least q."""
    found = []
    # two words in a row at least recur, so besides the one at the border one next to it does
    j = b + np.flatnonzero(t[b:hi] == t[b - 1])
    if len(j):
        more = np.zeros(len(j), bool)
        if b - 2 >= lo:
            more |= t[j - 1] == t[b - 2]
        inside = j + 1 < hi
        more |= inside & (t[np.where(inside, j + 1, 0)] == t[b])
        j = j[more]
    if len(j):
        q = j - (b - 1)
        one = np.full(len(j), b)
        back, on = ext.left(one - 1, j, np.full(len(j), b - lo)), ext.right(one, j + 1, hi - (j + 1))
        ok = back + on >= np.maximum(q, MIN_WORDS - q)
        found.append(np.stack([b - back, j + 1 + on, q], 1)[ok])
    j = lo + np.flatnonzero(t[lo:b] == t[b])
    if len(j):
        more = np.zeros(len(j), bool)
        if b + 1 < hi:
            more |= t[j + 1] == t[b + 1]
        inside = j - 1 >= lo
        more |= inside & (t[np.where(inside, j - 1, 0)] == t[b - 1])
        j = j[more]
    if len(j):
        q = b - j
        one = np.full(len(j), b)
        back, on = ext.left(one - 1, j - 1, j - lo), ext.right(one, j, np.full(len(j), hi - b))
        ok = back + on >= np.maximum(q, MIN_WORDS - q)
        found.append(np.stack([j - back, b + on, q], 1)[ok])
    return least_periods(np.concatenate(found)) if found else np.zeros((0, 3), np.int64)


def least_periods(runs: np.ndarray) -> np.ndarray:
    """Of the rows (start, end, q) with one start and end the one of the least q."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    return runs[first]


def merge(runs: np.ndarray) -> np.ndarray:
    """Rows (start, end, q) without those that lie in another one of the same q."""
    if not len(runs):
        return runs
    runs = runs[np.lexsort((-runs[:, 1], runs[:, 0], runs[:, 2]))]
    group = np.cumsum(np.concatenate([[0], runs[1:, 2] != runs[:-1, 2]]))
    reach = runs[:, 1] + group * (int(runs[:, 1].max()) + 1)
    keep = np.ones(len(runs), bool)
    keep[1:] = reach[1:] > np.maximum.accumulate(reach)[:-1]
    return runs[keep]


def grammar_runs(t: np.ndarray) -> np.ndarray:
    """(start, end, q) of all runs of a sequence of word numbers (from 0 on, without gaps)."""
    rules, symbols = re_pair(t.tolist())
    base = int(t.max()) + 1
    length = [1] * base
    for y, z in rules:
        length.append(length[y] + length[z])
    ends = np.cumsum([length[s] for s in symbols])
    starts = ends - [length[s] for s in symbols]
    # places where each rule is derived, from the last made on
    places: list[list[np.ndarray]] = [[] for _ in rules]
    by = np.argsort(symbols, kind="stable")
    values, at = np.unique(np.array(symbols)[by], return_index=True)
    for s, p in zip(values.tolist(), np.split(starts[by], at[1:])):
        if s >= base:
            places[s - base].append(p)
    ext, found = Extensions(t), []
    for k in range(len(rules) - 1, -1, -1):
        at = np.concatenate(places[k]) if places[k] else np.zeros(0, np.int64)
        places[k] = []
        y, z = rules[k]
        if not len(at) or length[base + k] < MIN_WORDS:
            continue
        for part, shift in ((y, 0), (z, length[y])):
            if part >= base and length[part] >= MIN_WORDS:
                places[part - base].append(at + shift)
        lo = int(at[0])
        here = crossing(t, ext, lo, lo + length[y], lo + length[base + k])
        if len(here):
            moved = np.repeat(at - lo, len(here))
            found.append(np.tile(here, (len(at), 1)) + np.stack([moved, moved, np.zeros_like(moved)], 1))
    todo = [(0, len(symbols))]
    while todo:
        i, j = todo.pop()
        lo, hi = int(starts[i]), int(ends[j - 1])
        if j - i < 2 or hi - lo < MIN_WORDS:
            continue
        k = (i + j) // 2
        found.append(crossing(t, ext, lo, int(starts[k]), hi))
        todo += [(i, k), (k, j)]
    return least_periods(merge(np.concatenate(found))) if found else np.zeros((0, 3), np.int64)


def runs_of(words: list[bytes]) -> np.ndarray:
    """(start, end, q) of the runs of a text's words, by start and then q."""
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    found = []
    for lo, hi in stretches(h):
        numbers: dict[bytes, int] = {}
        t = np.array([numbers.setdefault(w, len(numbers)) for w in words[lo:hi]], np.int64)
        found.append(grammar_runs(t) + [lo, lo, 0])
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def kept_words(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def find_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, runs, collapsed) of every row: its runs as structs (start, length, period), and its
    text with one period left of each run, words joined by one blank.

    Null, empty and short texts have no runs; repeated rows come back as often as they are there, null ids as
    null; an empty table gives an empty one; other columns are ignored.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_runs, texts = [], []
            for text in b.column(1).to_pylist():
                words = split_words(text)
                runs = runs_of(words)
                all_runs.append([{"start": s, "length": e - s, "period": q} for s, e, q in runs.tolist()])
                texts.append(b" ".join(kept_words(words, runs)).decode())
            yield pa.record_batch([b.column(0), pa.array(all_runs, kind), pa.array(texts, pa.string())], names=["doc_id", "runs", "collapsed"])

    return _rows(docs).mapInArrow(run, "doc_id long, runs array<struct<start long, length long, period long>>, collapsed string")


def run_digests(docs: DataFrame) -> DataFrame:
    """One row for each document with its planted tail (see planted): n_runs, the longest run (ties:
    the smallest start, then period) with exponent_milli, and digests of all runs and of the
    collapsed text.  A null id has no planted tail; else rows are treated as in find_runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = planted(split_words(text), doc_id)
                runs = runs_of(words)
                listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs.tolist())
                best = min(((s - e, s, q) for s, e, q in runs.tolist()), default=None)
                top = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
                digests = [hashlib.sha256(x).hexdigest() for x in (listed.encode(), b" ".join(kept_words(words, runs)))]
                rows.append((doc_id, len(runs), *top, *digests))
            columns = list(zip(*rows)) or [[]] * 8
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 6 + [pa.string()] * 2)], names=names)

    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    return _rows(docs).mapInArrow(run, ", ".join(f"{c} {'string' if c.endswith('sha256') else 'long'}" for c in names))

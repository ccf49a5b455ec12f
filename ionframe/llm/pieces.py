"""SentencePiece encoding and decoding that keep the place of every piece in the original bytes.

A text is first normalised: from left to right the longest prefix that the model's compiled
character map knows is replaced, any other character stays; blanks become U+2581, one of which
is put in front where the model says so.  For every byte of the normalised text the place of the
original bytes that it came from is noted, so that each piece of the encoding is projected to a
span of the original text.  Then pieces are joined, best score first, and the leftmost of equals.
Characters without a piece become the pieces of their bytes, or the unknown id.

No piece of a vocabulary such as the public one goes on over the start of a word, so words (with
the blanks before them) are encoded one by one and kept; where a vocabulary has such pieces, or a
character map, the text is encoded as a whole.  Spans are of UTF-8 bytes, [start, end); the bytes
of one character without a piece are all at its start but for the last, which spans it.

Models of type BPE without user-defined or unused pieces are read; others are an error.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ChunkCache, made

BLANK = "▁"
_BLANK = BLANK.encode()
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Characters that end a chunk where no piece of the vocabulary holds them.
_BREAKS = "\n\t\r"
#: Words that each of the two generations of a worker's cache holds (some 350 bytes each).
CACHE = 300_000
#: Characters of a text that is joined without a heap, at most.
_SHORT = 40
_NEVER = float("inf")
#: Letters, and marks that mostly follow them.
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?)\"'"


def fields(data: bytes):
    """(number, value) of a serialised message: integers, bytes, or four or eight raw bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + n]
        at += n


class CharacterMap:
    """The compiled map of a model: a double-array trie of byte strings and their replacements."""

    def __init__(self, blob: bytes):
        n = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", n // 4, 4).tolist() if n else []
        self.texts = blob[4 + n :]

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest known string at a place, if there is one."""
        units = self.units
        if not units:
            return None
        node, found = self._offset(units[0]), None
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node] if node < len(units) else 0
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]


class Normaliser:
    """A model's normalisation of text, with the alignment of its bytes."""

    def __init__(self, spec: bytes):
        values = dict(fields(spec))
        self.map = CharacterMap(values.get(2, b""))
        self.dummy_prefix, self.squeeze, self.escape = (bool(values.get(k, 1)) for k in (3, 4, 5))
        self.blank = _BLANK if self.escape else b" "

    def __call__(self, text: str) -> tuple[bytes, list[int]]:
        """The normalised bytes and, for each of them and for the end, the place of the original."""
        data = text.encode("utf-8", "replace")
        out, origin, at, n = bytearray(), [], 0, len(data)

        def put(piece: bytes, place: int) -> None:
            out.extend(piece)
            origin.extend([place] * len(piece))

        def step() -> tuple[int, bytes]:
            hit = self.map.longest(data, at)
            if hit is not None:
                return hit
            width = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
            return width, data[at : at + width]

        if self.squeeze:
            while at < n:
                width, piece = step()
                if piece != b" ":
                    break
                at += width
        if at == n:
            return b"", [at]
        if self.dummy_prefix:
            put(self.blank, at)
        after_blank = self.squeeze
        while at < n:
            width, piece = step()
            if after_blank:
                piece = piece.lstrip(b" ")
            if piece:
                put(piece.replace(b" ", self.blank), at)
                after_blank = self.squeeze and piece.endswith(b" ")
            at += width
        if self.squeeze:
            while out.endswith(self.blank):
                at = origin[len(out) - len(self.blank)]
                del out[-len(self.blank) :], origin[-len(self.blank) :]
        origin.append(at)
        return bytes(out), origin


class Pieces:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = list(fields(f.read()))
        pieces = [dict(fields(v)) for k, v in model if k == 1]
        trainer = dict(next((v for k, v in ((k, fields(v)) for k, v in model if k == 2)), ()))
        self.normalise = Normaliser(next((v for k, v in model if k == 3), b""))
        self.names = [p.get(1, b"").decode() for p in pieces]
        self.kinds = [p.get(3, NORMAL) for p in pieces]
        if trainer.get(3, 1) != 2 or {USER_DEFINED, UNUSED} & set(self.kinds) or trainer.get(24, 0):
            raise ValueError("only BPE models without user-defined or unused pieces and with blanks as prefixes can be read")
        scores = [struct.unpack("<f", p[2])[0] if 2 in p else 0.0 for p in pieces]
        self.ids = {s: i for i, s in enumerate(self.names) if self.kinds[i] == NORMAL}
        self.cost = {s: -scores[i] for s, i in self.ids.items()}
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {int(s[3:5], 16): i for i, s in enumerate(self.names) if self.kinds[i] == BYTE}
        self.controls = {i for i, k in enumerate(self.kinds) if k == CONTROL}
        self.unknown_text = trainer.get(44, " ⁇ ".encode()).decode()
        self.surface = [self._surface(i) for i in range(len(self.names))]
        held = set("".join(self.ids))
        self.breaks = "".join(c for c in _BREAKS if c not in held)
        split = re.compile(f"[^{BLANK}]{BLANK}")
        plain = not self.normalise.map.units and self.normalise.dummy_prefix and not self.normalise.squeeze and self.normalise.escape
        #: whether words can be encoded one by one
        self.by_word = plain and not any(split.search(s) for s in self.ids)
        # characters that no piece has behind a letter: words are cut before them
        behind = set(re.findall(f"[{_LETTERS}](.)", "".join(s + "\n" for s in self.ids)))
        self.cuts = "".join(c for c in _MARKS if c not in behind)
        other = f"[^ {re.escape(self.breaks)}]"
        self.words = re.compile((f"[{re.escape(self.breaks)}]|" if self.breaks else "") + (f" *[{_LETTERS}]+(?=[{re.escape(self.cuts)}])|" if self.cuts else "") + f" +{other}*|{other}+")
        self.chunks = ChunkCache(self._chunk, CACHE)
        self.coded = ChunkCache(self._code)

    def _surface(self, i: int) -> bytes:
        kind, name = self.kinds[i], self.names[i]
        if kind == CONTROL:
            return b""
        if kind == UNKNOWN:
            return self.unknown_text.encode()
        return bytes([int(name[3:5], 16)]) if kind == BYTE else name.replace(BLANK, " ").encode()

    def join(self, text: str) -> list[str]:
        """The symbols that are left of a normalised text when no two neighbours make a piece."""
        if len(text) <= _SHORT:
            return self._join_short(text)
        symbols, n, cost = list(text), len(text), self.cost
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            both = text[i : i + 2]
            if both in cost:
                heap.append((cost[both], i, both))
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if symbols[i] is None or j >= n or symbols[i] + symbols[j] != both:
                continue
            symbols[i], symbols[j] = both, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                new = both + symbols[k]
                if new in cost:
                    heapq.heappush(heap, (cost[new], i, new))
            h = before[i]
            if h >= 0:
                new = symbols[h] + both
                if new in cost:
                    heapq.heappush(heap, (cost[new], h, new))
        return [s for s in symbols if s is not None]

    def _join_short(self, text: str) -> list[str]:
        """The same without a heap, which a word is too short for."""
        symbols, get = list(text), self.cost.get
        costs = [get(text[i : i + 2], _NEVER) for i in range(len(text) - 1)]
        while costs:
            best = min(costs)
            if best == _NEVER:
                break
            i = costs.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del costs[i]
            if i < len(costs):
                costs[i] = get(symbols[i] + symbols[i + 1], _NEVER)
            if i:
                costs[i - 1] = get(symbols[i - 1] + symbols[i], _NEVER)
        return symbols

    def _ids(self, symbols: list[str]) -> tuple[list[int], list[int]]:
        """Ids, and the bytes of the normalised text that each is given (those of a character
        without a piece go to the last of its bytes)."""
        ids, widths = [], []
        for s in symbols:
            i = self.ids.get(s)
            data = s.encode()
            if i is None and self.bytes:
                ids += [self.bytes[b] for b in data]
                widths += [0] * (len(data) - 1) + [len(data)]
            else:
                ids.append(self.unknown if i is None else i)
                widths.append(len(data))
        return ids, widths

    def _chunk(self, chunk: str) -> tuple[bytes, bytes]:
        """Ids and widths in the original text of a word and the blanks before it."""
        found = [self.coded[s] for s in self.join(chunk.replace(" ", BLANK))]
        return b"".join([i for i, _ in found]), b"".join([w for _, w in found])

    def _code(self, symbol: str) -> tuple[bytes, bytes]:
        """The same of a symbol; every U+2581 in it was a blank of one byte."""
        ids, widths = self._ids([symbol])
        widths[-1] -= 2 * symbol.count(BLANK)
        return np.array(ids, "<u4").tobytes(), np.array(widths, "<u4").tobytes()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, starts and ends of the pieces of a text."""
        if self.by_word and text and BLANK not in text:
            found = list(map(self.chunks.__getitem__, self.words.findall(" " + text)))
            ids = np.frombuffer(b"".join([x for x, _ in found]), "<u4")
            ends = np.cumsum(np.frombuffer(b"".join([x for _, x in found]), "<u4"), dtype=np.int64)
            # the blank put in front has no byte of its own
            starts = np.concatenate([[1], ends[:-1]]) - 1
            return ids, starts, ends - 1
        data, origin = self.normalise(text)
        ids, widths = self._ids(self.join(data.decode("utf-8")))
        if not self.bytes:
            ids, widths = self._merge_unknown(ids, widths)
        ends = np.cumsum(np.array(widths, np.int64))
        place = np.array(origin, np.int64)
        return np.array(ids, "<u4"), place[np.concatenate([[0], ends])[: len(ids)]], place[ends]

    def _merge_unknown(self, ids: list[int], widths: list[int]) -> tuple[list[int], list[int]]:
        """Unknown pieces that follow each other are one."""
        out: list[list[int]] = []
        for i, w in zip(ids, widths):
            if out and i == self.unknown == out[-1][0]:
                out[-1][1] += w
            else:
                out.append([i, w])
        return [i for i, _ in out], [w for _, w in out]

    def decode(self, ids) -> bytes:
        """The text of ids: blanks for U+2581, without the one put in front; bytes that are no
        UTF-8 become U+FFFD each, ids of control pieces nothing."""
        surface, kinds = self.surface, self.kinds
        parts = list(map(surface.__getitem__, ids))
        if self.normalise.dummy_prefix or self.normalise.squeeze:
            for k, i in enumerate(ids):
                if kinds[i] == NORMAL and self.names[i].startswith(BLANK):
                    parts[k] = parts[k][1:]
                if kinds[i] != CONTROL:
                    break
        if not self.controls.intersection(ids):
            data = b"".join(parts)
            try:
                data.decode()
                return data
            except UnicodeDecodeError:
                pass
        return self._repaired(ids, parts)

    def _repaired(self, ids, parts: list[bytes]) -> bytes:
        out, run = [], b""
        for i, p in [*zip(ids, parts), (None, b"")]:
            if i is not None and self.kinds[i] == BYTE:
                run += p
                continue
            while run:
                try:
                    good, bad = len(run), 0
                    run.decode()
                except UnicodeDecodeError as e:
                    good, bad = e.start, 1
                out += [run[:good], "�".encode() * bad]
                run = run[good + bad :]
            out.append(p)
        return b"".join(out)


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, starts, ends): the pieces of every row's text and their spans of its UTF-8
    bytes.  Null and empty texts have none; repeated rows come back as often as they are there;
    null ids stay null; an empty table gives an empty one; other columns are ignored."""

    def run(batches):
        p = made(Pieces, path)
        for b in batches:
            found = [p.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.record_batch(
                [
                    b.column(0),
                    pa.array([i.astype(np.int32) for i, _, _ in found], pa.list_(pa.int32())),
                    pa.array([s for _, s, _ in found], pa.list_(pa.int64())),
                    pa.array([e for _, _, e in found], pa.list_(pa.int64())),
                ],
                names=["doc_id", "ids", "starts", "ends"],
            )

    return _columns(docs).mapInArrow(run, "doc_id long, ids array<int>, starts array<long>, ends array<long>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): the text of each row's ids (null ids: null)."""

    def run(batches):
        p = made(Pieces, path)
        for b in batches:
            texts = [None if x is None else p.decode(x) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.binary())], names=["doc_id", "ids", "decoded"])

    rows = encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded binary").withColumn("decoded", F.col("decoded").cast("string"))


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, spans_crc32) in one pass, so that neither
    ids nor texts leave the worker that makes them; spans_crc32 is of the pieces' starts and then
    their ends as little-endian 64-bit integers.  Rows are treated as in encode_documents."""

    def run(batches):
        p = made(Pieces, path)
        numbers = [str(i) for i in range(len(p.names))]
        for b in batches:
            n, ids_sha, text_sha, spans = [], [], [], []
            for t in b.column(1).to_pylist():
                ids, starts, ends = p.encode(t or "")
                ids = ids.tolist()
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(numbers.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(p.decode(ids)).hexdigest())
                spans.append(zlib.crc32(ends.astype("<i8").tobytes(), zlib.crc32(starts.astype("<i8").tobytes())))
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(spans, pa.int64())]
            yield pa.record_batch(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"])

    return _columns(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long")

"""BPE encoding by dynamic programming over prefixes, and decoding.

Every prefix of a word has exactly one BPE encoding, so it has one last token.  The engine
stores just that token for each prefix.  An automaton over the vocabulary (suffix links as in
a suffix automaton) lists the tokens that end at a position; such a token t is the last one
of the prefix exactly if it is compatible with the last token p of the prefix before it:
encoding the text of p and t together gives p, t.  Following the stored tokens back from the
end emits the ids.  No merge loop runs over the text and the time is linear in the word.

Compatibility of (p, t) looks at the tokens that bordered each other while p and t were
built: a pair of them whose merge has a lower rank than the merges that replace them would
have joined across the border.  Answers are kept, as pairs recur.

Text is split as the tokenizer file says: special tokens, normalisation, pre-tokens, bytes.
Texts made of common Latin letters and punctuation are split by one regular expression here;
others go through the library's own normaliser and pre-tokeniser.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

_END = "\0"
_NEVER = 1 << 30
#: Chunks that each of the two generations of a worker's cache holds.
CACHE = 150_000


def _chars(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == kind)


_SPACE = r"\t-\r \x85\xa0"
#: Texts of these characters only are split here: Basic Latin, Latin-1 and Latin Extended-A,
#: but for separators that Python and the tokenizer's regular expressions see differently and
#: for U+0130 (its lower case has a combining mark), and common punctuation.
_PLAIN = re.compile(r"[^\x1c-\x1fİƀ-‏‖‗‛‟‡-‥‧-₫₭-\U0010ffff]*")
_PRETOKENS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_chars('L')}]+|[{_chars('N')}]|[^{_SPACE}{_chars('L')}{_chars('N')}]+")


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1
    characters for themselves, the others in order from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """The merges of a tokenizer file as tables: a token's parts and rank, spelling, length."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        suffix = model["end_of_word_suffix"]
        n = max([*ids.values(), *self.specials.values()]) + 1
        self.names = [""] * n
        for s, i in [*ids.items(), *self.specials.items()]:
            self.names[i] = s
        self.rank, self.left, self.right = [-1] * n, [-1] * n, [-1] * n
        spelling = [""] * n
        for c in byte_symbols():
            spelling[ids[c]] = c
            spelling[ids[c + suffix]] = c + _END
        self.merge: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(model["merges"]):
            x, y, z = ids[a], ids[b], ids[a + b]
            self.rank[z], self.left[z], self.right[z] = r, x, y
            spelling[z] = spelling[x] + spelling[y]
            self.merge[x, y] = r
        self.length = [len(s) for s in spelling]
        self.automaton = ahocorasick.Automaton()
        for i, s in enumerate(spelling):
            # a token whose parts would be torn apart when its own text is encoded never occurs
            if s and (self.rank[i] < 0 or self.apart(self.left[i], self.right[i], self.rank[i])):
                self.automaton.add_word(s, i)
        self.automaton.make_automaton()

    def apart(self, a: int, b: int, until: int = _NEVER) -> bool:
        """Whether no merge of a rank below until joins the neighbours a and b, or tokens
        that they are made of, across their border."""
        rank = self.rank
        after_a = after_b = until  # the ranks of the merges that replace a and b
        while True:
            q = self.merge.get((a, b), _NEVER)
            # of equal merges the leftmost is first: a's own comes before, b's after
            if q < after_a and (q <= after_b if after_b < until else q < until):
                return False
            if rank[a] > rank[b]:
                after_a, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                after_b, b = rank[b], self.left[b]
            else:
                return True


class Encoder:
    """Texts to ids for a byte-level BPE file with an end-of-word suffix."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.library = Tokenizer.from_file(path)
        self.special = re.compile("(" + "|".join(map(re.escape, self.vocabulary.specials)) + ")")
        self.symbols = {b: c for b, c in enumerate(byte_symbols())}
        self.fits: dict[tuple[int, int], bool] = {}
        self.chunks = ChunkCache(self.chunk)

    def word(self, symbols: str) -> list[int]:
        """The ids of one pre-token in byte symbols."""
        v, fits = self.vocabulary, self.fits
        s = symbols + _END
        last = [-1] * (len(s) + 1)
        length = v.length
        for end, token in v.automaton.iter(s):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length[token]
            if start:
                p = last[start]
                if p < 0:
                    continue
                ok = fits.get((p, token))
                if ok is None:
                    if len(fits) > 2_000_000:
                        fits.clear()
                    ok = fits[p, token] = v.apart(p, token)
                if not ok:
                    continue
            last[end] = token
        out, at = [], len(s)
        while at:
            out.append(last[at])
            at -= length[last[at]]
        return out[::-1]

    def chunk(self, chunk: str) -> bytes:
        """The ids of a chunk of plain lower-case text without white space, as bytes."""
        ids = []
        for w in _PRETOKENS.findall(chunk):
            ids += self.word(w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.symbols))
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if "<|" in text:
            specials = self.vocabulary.specials
            return b"".join(np.uint32(specials[p]).tobytes() if p in specials else self._plain(p) for p in self.special.split(text) if p)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text):
            return b"".join(map(self.chunks.__getitem__, text.lower().split()))
        normal = self.library.normalizer.normalize_str(text)
        words = (w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal))
        return np.array([i for w in words for i in self.word(w)], "<u4").tobytes()


class LibraryEncoder(Encoder):
    """The same with the library's own BPE model for the pre-tokens that are not in the cache."""

    def word(self, symbols: str) -> list[int]:
        return [t.id for t in self.library.model.tokenize(symbols)]


class ChunkCache(dict):
    """Results by chunk, of a bounded number: when full, the younger half becomes the older."""

    def __init__(self, make, size: int = CACHE):
        super().__init__()
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Decoder:
    """Ids to text: the tokens' names joined by blanks, as the library does without a decoder."""

    def __init__(self, path: str):
        self.names = [s.encode() for s in Vocabulary(path).names]

    def decode(self, ids: bytes) -> bytes:
        return b" ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_MADE: dict[tuple, object] = {}


def made(kind, path: str):
    """One object of the kind for each file and worker."""
    if (kind, path) not in _MADE:
        _MADE[kind, path] = kind(path)
    return _MADE[kind, path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): ids holds little-endian unsigned 32-bit integers.  Null and empty texts
    have none; repeated rows come back as often as they are there; other columns are ignored."""

    def run(batches):
        e = made(Encoder, path)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([e.encode(t or "") for t in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): the text of the ids (null ids: null)."""

    def run(batches):
        d = made(Decoder, path)
        for b in batches:
            texts = [None if x is None else d.decode(x) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary").withColumn("decoded", F.col("decoded").cast("string"))


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) in one pass, so that neither ids nor
    texts leave the worker that makes them."""

    def run(batches):
        e, d = made(Encoder, path), made(Decoder, path)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for t in b.column(1).to_pylist():
                ids = e.encode(t or "")
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(d.decode(ids)).hexdigest())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

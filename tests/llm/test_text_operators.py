"""SentencePiece encoding, source divergence and periodic runs against libraries and brute force."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from ionframe.llm import common, divergence, language_id, periodic_runs, pieces, quality_classifier
from ionframe.llm.queries import op11_piece_round_trip, op12_source_divergence, op13_periodic_runs, piece_model_path

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977} é{i % 13}" for i in range(60_000))
ODD = [
    (1, None, "a"), (2, "", "b"), (3, "   ", "c"), (4, LONG, "d"), (5, "same same", "e"), (5, "same same", "e"), (None, "no id ▁ 世😀", None), (7, "\n\t \x00\x1c", None), (8, "x" * 30_000, "f"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Awkward rows with columns named like those of the results."""
    rows = [(d, t, s, "zz", 1, 2.0) for d, t, s in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens string, term int, start double").selectExpr("*", "source as lang", "1 as p")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_model_path())


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


# ---------------------------------------------------------------- SentencePiece


def fuzz(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    alphabet = [*"ab c  \n\t\r1.2▁é世😀\x00\x1c,", "the ", "ing", "́", "�", " of", "<0x0A>", "<s>", "</s>", "<unk>"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40))) for _ in range(n)] + ["", " ", "  ", "▁", "\n"]


def test_pieces_equal_the_library(library):
    own = pieces.Pieces(piece_model_path())
    for text in fuzz(3000, 1):
        ids, starts, ends = own.encode(text)
        want = library.encode(text)
        assert ids.tolist() == want
        assert own.decode(want).decode() == library.decode(want)
        data, offsets = text.encode(), library.encode_as_offset_mapping(text)["offsets"]
        place = np.cumsum([0, *(len(c.encode()) for c in text)])
        # the library's mapping is in characters; bytes of one character are joined to it
        assert [(int(place[a]), int(place[b])) for a, b in offsets] == list(zip(starts.tolist(), ends.tolist()))
        assert b"".join(data[a:b] for a, b in zip(starts, ends)) == data


def test_pieces_of_whole_texts_and_by_word_agree(library):
    own, whole = pieces.Pieces(piece_model_path()), pieces.Pieces(piece_model_path())
    assert own.by_word
    whole.by_word = False
    for text in [*fuzz(500, 2), LONG[:5000]]:
        for a, b in zip(own.encode(text), whole.encode(text)):
            assert a.tolist() == b.tolist()


def test_decoding_of_any_ids(library):
    own, rng = pieces.Pieces(piece_model_path()), random.Random(3)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(262)]) for _ in range(rng.randrange(12))]
        assert own.decode(ids).decode() == library.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_character_map_and_alignment(rule, squeeze):
    """The longest-prefix normalisation by maps that the library has compiled."""
    want = sentencepiece.SentencePieceNormalizer(rule_name=rule, remove_extra_whitespaces=squeeze, add_dummy_prefix=True, escape_whitespaces=True)
    own = pieces.Normaliser(dict(pieces.fields(want.serialized_model_proto()))[3])
    rng = random.Random(4)
    alphabet = [*"aB ＡＢ　 ﬁ ½①é가\n\t​世ｶﾞ", "  "]
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(14)))
        normal, offsets = want.normalize(text, with_offsets=True)
        got, origin = own(text)
        assert got.decode() == normal
        if normal:
            place = np.cumsum([0, *(len(c.encode()) for c in text)]).tolist()
            at = np.cumsum([0, *(len(c.encode()) for c in normal)]).tolist()
            assert [place.index(origin[i]) for i in at] == list(offsets)


def test_other_models_are_an_error(tmp_path):
    with open(piece_model_path(), "rb") as f:
        data = f.read()
    path = tmp_path / "unigram.model"
    # a later trainer spec (field 2) whose model type (field 3) is 1
    trainer = next(v for k, v in pieces.fields(data) if k == 2)
    path.write_bytes(data.replace(trainer, trainer.replace(b"\x18\x02", b"\x18\x01", 1)))
    with pytest.raises(ValueError, match="only BPE"):
        pieces.Pieces(str(path))


def check_pieces(rows, docs, library):
    want = Counter()
    for d, text in docs:
        ids = library.encode(text or "")
        want[d, len(ids), sha(",".join(map(str, ids)).encode()), sha(library.decode(ids).encode() if ids else b"")] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want


def test_op11(spark, library):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_pieces(op11_piece_round_trip(spark, SF).collect(), docs, library)


def test_op11_odd_rows(spark, odd, library):
    check_pieces(pieces.round_trip_digests(odd, piece_model_path()).collect(), [(d, t) for d, t, _ in ODD], library)
    encoded = pieces.encode_documents(odd, piece_model_path())
    spans = {r.doc_id: list(zip(r.starts, r.ends)) for r in encoded.collect()}
    assert spans[1] == [] and b"".join("same same".encode()[a:b] for a, b in spans[5]) == b"same same"
    decoded = pieces.decode_documents(encoded, piece_model_path()).collect()
    assert Counter((r.doc_id, r.decoded) for r in decoded) == Counter((d, library.decode(library.encode(t or "")) if t else "") for d, t, _ in ODD)
    assert pieces.round_trip_digests(odd.limit(0), piece_model_path()).collect() == []


# ---------------------------------------------------------------- source divergence


def brute_audit(docs: list[tuple], min_docs: int, top: int) -> set:
    """Plain Python over (text, lang, source)."""
    import regex

    found, where = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = regex.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
        found[lang or "", source or ""].update(words)
        where[lang or ""].update(set(words))
    kept = {lang: sorted(t for t, n in c.items() if n >= min_docs) for lang, c in where.items()}

    def shares(lang, counts):
        total, v = sum(counts[t] for t in kept[lang]), len(kept[lang])
        return {t: 1 + Fraction(10**9 * (counts[t] + 5), total + 5 * v).__floor__() for t in kept[lang]}

    out = set()
    p = {g: shares(g[0], c) for g, c in found.items()}
    for lang in kept:
        every = sum((c for g, c in found.items() if g[0] == lang), Counter())
        q = shares(lang, every)
        for g in (g for g in found if g[0] == lang):
            pairs = [(sum(abs(p[g][t] - p[o][t]) for t in kept[lang]), o[1]) for o in found if o[0] == lang and o != g]
            terms = [(p[g][t] - q[t], t) for t in kept[lang] if found[g][t] and p[g][t] > q[t]]
            for part, rows in (("pair", pairs), ("term", terms)):
                for k, (value, item) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1].encode())), 1):
                    if part == "pair" or k <= top:
                        out.add((*g, part, item, value, k))
    return out


def audited(df) -> set:
    rows = df.collect()
    out = {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_op12(spark):
    docs = [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert audited(op12_source_divergence(spark, SF)) == brute_audit(docs, 30, 50)


@pytest.mark.parametrize("matrix", [1024, 1])
def test_op12_terms_of_any_length(spark, matrix, monkeypatch):
    """Terms that begin with each other, of many lengths, not ASCII; sources without kept terms."""
    monkeypatch.setattr(divergence, "MATRIX_SOURCES", matrix)
    rng = random.Random(6)
    terms = ["a", "ab", "abc", "abcd", "abcde", "Ä", "äö", "世", "世界", "x" * 70, "x" * 71, "É" * 40, "zz", "A\x7fb"]
    docs = [(" ".join(rng.choice(terms) for _ in range(rng.randrange(6))), rng.choice(["en", "de", None]), rng.choice(["s", "t", "u", None, "é"])) for _ in range(150)]
    docs += [("rare words", "fr", "s"), (None, "fr", "t"), ("", "it", "only"), *[("ab ab", "en", "hot")] * 100]
    df = spark.createDataFrame([(*d, 0, "q") for d in docs], "text string, lang string, source string, n int, term string")
    assert audited(divergence.audit(df, min_docs=5, top=3)) == brute_audit(docs, 5, 3)


def test_op12_odd_rows(spark, odd):
    assert audited(divergence.audit(odd, min_docs=2, top=5)) == brute_audit([(t, s, s) for _, t, s in ODD], 2, 5)
    assert divergence.audit(odd.limit(0)).collect() == []


def test_op12_exact_beyond_long(spark):
    row = spark.createDataFrame([(3 * 10**12, 7 * 10**13, 11)], "n long, total long, v long")
    share = row.select(divergence._share(F.col("n"), F.col("total"), F.col("v"))).first()[0]
    assert share == 1 + 10**9 * (3 * 10**12 + 5) // (7 * 10**13 + 55)


# ---------------------------------------------------------------- periodic runs


def brute_runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) by trying every period at every place."""
    n, least = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                least.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, m, q) for (s, m), q in least.items())


def brute_row(doc_id, text) -> tuple:
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    first = (None,) * 4 if top is None else (*top, 1000 * top[1] // top[2])
    listed = "".join("%d,%d,%d\n" % r for r in runs)
    return (doc_id, len(runs), *first, sha(listed.encode()), sha(" ".join(w for i, w in enumerate(words) if i not in gone).encode()))


def strange(rng) -> list[bytes]:
    k = rng.choice([1, 2, 2, 3, 5, 20])
    words = [rng.randrange(k) for _ in range(rng.randrange(100))]
    for _ in range(rng.randrange(4)):
        if words:
            a = rng.randrange(len(words))
            unit = words[a : a + rng.randrange(1, 20)]
            again = unit * rng.randrange(2, 8)
            at = rng.randrange(len(words) + 1)
            words[at:at] = again[: len(again) - rng.randrange(len(unit))]
    return [b"w%d" % w for w in words]


def test_runs_equal_brute_force():
    rng = random.Random(7)
    for _ in range(700):
        words = strange(rng)
        want = brute_runs(words)
        assert sorted((s, e - s, q) for s, e, q in periodic_runs.runs_of(words).tolist()) == want
        if words:  # without the narrowing to stretches
            numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
            whole = periodic_runs.grammar_runs(np.array([numbers[w] for w in words]))
            assert sorted((s, e - s, q) for s, e, q in whole.tolist()) == want


def test_runs_of_fibonacci_words():
    a, b = [b"a"], [b"b"]
    while len(b) < 1500:
        a, b = b, b + a
    assert sorted((s, e - s, q) for s, e, q in periodic_runs.runs_of(b).tolist()) == brute_runs(b)


def test_grammar_derives_its_text():
    rng = random.Random(8)
    for _ in range(200):
        seq = [rng.randrange(3) for _ in range(rng.randrange(1, 80))]
        rules, symbols = periodic_runs.re_pair(seq)
        base = max(seq) + 1

        def derive(s):
            return [s] if s < base else [x for part in rules[s - base] for x in derive(part)]

        assert [x for s in symbols for x in derive(s)] == seq
        assert all(max(r) < base + k for k, r in enumerate(rules))


def test_op13(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert Counter(map(tuple, op13_periodic_runs(spark, SF).collect())) == Counter(brute_row(d, t) for d, t in docs)


def test_op13_odd_rows(spark, odd):
    short = [(d, t) for d, t, _ in ODD if t is None or len(t) < 50_000]
    got = Counter(tuple(r) for r in periodic_runs.run_digests(odd).collect())
    assert all(got[brute_row(d, t)] == n for (d, t), n in Counter(short).items()) and sum(got.values()) == len(ODD)
    texts = {r.doc_id: r for r in periodic_runs.find_runs(odd).collect()}
    assert texts[1].collapsed == "" and texts[1].runs == []
    # the words come back after 2 * 977 * 13 words at the earliest
    assert [(r.start, r.length, r.period) for r in texts[4].runs] == [(0, 120_000, 2 * 977 * 13)]
    assert periodic_runs.run_digests(odd.limit(0)).collect() == [] and periodic_runs.find_runs(odd.limit(0)).collect() == []


def test_long_texts_end():
    rng = random.Random(9)
    unit = [b"%d" % rng.randrange(5000) for _ in range(40_000)]
    assert periodic_runs.runs_of(unit + unit + unit[:7]).tolist() == [[0, 80_007, 40_000]]
    assert periodic_runs.runs_of([b"x"] * 200_000).tolist() == [[0, 200_000, 1]]


# ---------------------------------------------------------------- models


def test_long_texts_are_trained_on(spark, monkeypatch):
    """A language, or a label, whose texts are all longer than the passage is learned."""
    monkeypatch.setattr(language_id, "TRAIN_CHARS", 200)
    monkeypatch.setattr(quality_classifier, "TRAIN_CHARS", 200)
    rng = random.Random(10)
    words = {"aa": "kapo lomi tesa rinu".split(), "bb": "zwuq xyrk vhjj qqwz".split()}
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(300)), lang, lang == "aa") for k, lang in enumerate(["aa", "bb"] * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, good boolean")
    got = language_id.identify(docs, language_id.fit(docs)).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {k: lang for k, _, lang, _ in rows}
    labels = docs.select("doc_id", F.col("good").cast("int").alias("quality"))
    assert all(r.predicted == int(rows[r.doc_id][3]) for r in quality_classifier.classify(docs, labels).collect())


def test_passage(spark):
    row = spark.createDataFrame([("é" * 30, 1), ("abc", 2), ("", 3), (None, 4), ("0123456789" * 9, 5)], "t string, k long")
    got = [r[0] for r in row.orderBy("k").select(common.passage(F.col("t"), F.col("k"), 20)).collect()]
    assert got[:4] == ["é" * 20, "abc", "", None] and len(got[4]) == 20 and got[4] in "0123456789" * 9


def test_language_prediction_by_brute_force():
    """Cosines of TF-IDF trigrams with the model's centroids, in plain Python."""
    rng = random.Random(11)
    texts = [(" ".join("".join(rng.choice(a) for _ in range(rng.randint(2, 7))) for _ in range(40))).encode() for a in ["abcde", "fghij", "acegi"] for _ in range(18)]
    model = language_id.train(texts, ["x"] * 18 + ["y"] * 18 + ["z"] * 18)
    langs, scores, rejected = model.predict(texts)
    for text, lang, score, out in zip(texts, langs, scores, rejected):
        padded, found = b" " + text.lower() + b" ", Counter()
        for i in range(len(padded) - 2):
            code = padded[i] << 16 | padded[i + 1] << 8 | padded[i + 2]
            found[code * 2654435761 % 2**32 >> 32 - language_id.DIM_BITS] += 1
        v = {k: math.log1p(n) * float(model.idf[k]) for k, n in found.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        best = {}
        for c, of in zip(model.centroids, model.language_of):
            cos = sum(x / norm * float(c[k]) for k, x in v.items())
            best[of] = max(best.get(of, -1.0), cos)
        top = max(best, key=best.get)
        assert model.languages[top] == lang
        assert score == pytest.approx(1 / sum(math.exp(language_id.SHARPNESS * (b - best[top])) for b in best.values()), rel=1e-3)
        assert out == (1 - best[top] > model.radius[top])


def test_quality_score_by_brute_force():
    """The average over words of the average weights of their word and n-gram buckets."""
    weights = np.random.default_rng(12).normal(0, 3, quality_classifier.BUCKETS)
    score = quality_classifier.Model(weights, 0.25).scorer()
    rng = random.Random(13)
    texts = [" ".join(rng.choice(["", "a", "of", "words", "wörter", "x" * 300, "same same", "zz"]) for _ in range(rng.randrange(12))) for _ in range(50)]
    for text in texts:
        words, total = text.encode().split(), 0.0
        for i, w in enumerate(words):
            marked = b"<" + w + b">"
            grams = [1 + zlib.crc32(w, 1) % (len(weights) - 1)]
            grams += [1 + zlib.crc32(marked[k : k + n], 2) % (len(weights) - 1) for n in (3, 4, 5) for k in range(len(marked) - n + 1)]
            total += sum(weights[g] for g in grams) / len(grams) + (weights[0] if i + 1 < len(words) and words[i + 1] == w else 0)
        z = 0.25 + (total / len(words) if words else 0)
        assert score(text.encode()) == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-9)

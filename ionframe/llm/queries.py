"""The queries opN_<name> over the driver's tables, and their SQL oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio_features, bpe, divergence, language_id, license_scan, line_dedup, packing, periodic_runs, pieces, quality_classifier, quality_rules, simhash_dedup, warc
from .common import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(_table(spark, sf_dir, "documents"))


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives lie in the folder that driver and executors share."""
    return warc.round_trip(_table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_rules.apply_rules(docs).select(*names)


#: DuckDB SQL of op4's rows.  char(9) to char(13) and the blank part the words.
OP4_SQL = r"""
with w as (
  select doc_id, coalesce(text, '') as text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents),
g as (
  select doc_id, text, words, lines, len(words) as n,
    list_transform(range(1, greatest(len(words) - 1, 1)), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) as grams
  from w),
u as (select row_number() over () as r, * from g),
e as (select r, unnest(grams) as gram, generate_subscripts(grams, 1) as p from u),
c as (select r, p, count(*) over (partition by r, gram) as c from e),
o as (select r, p, lag(p) over (partition by r order by p) as q from c where c > 1),
k as (select r, sum(least(3, p - coalesce(q, p - 3))) as n_rep from o group by r),
m as (
  select doc_id, text, n as n_words,
    coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
    len(lines) - len(list_distinct(lines)) as n_dup_lines,
    coalesce(n_rep, 0) as n_repeat_words
  from u left join k using (r))
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars,
  cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
  cast(n_repeat_words as bigint) as n_repeat_words,
  (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words
    or n_symbols > 0.1 * n_words
    or word_chars < 2 * n_words or word_chars > 20 * n_words
    or (n_dup_lines > 10 and 2 * n_dup_lines > length(text) - length(replace(text, chr(10), '')) + 1)
    or length(text) - length(replace(text, '!', '')) > 0.2 * n_words
    or len(regexp_extract_all(text, '\p{Lu}\p{Lu}')) > 0.3 * n_words
    or len(regexp_extract_all(text, '[0-9]')) > 0.3 * word_chars) as kept
from m
"""


def tokenizer_path() -> str:
    """The public vocabulary file that the queries use; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op6_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document's tensors the digest is returned (features gives them as clips), beside
    the spans of activity."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips_sha256", "spans"]
    stored = audio_features.store(_table(spark, sf_dir, "documents"))
    return audio_features.features(stored, keep_tensors=False).select(*names)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def piece_model_path() -> str:
    """The public SentencePiece model that the query uses; operators take any BPE model's path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op11_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip_digests(_table(spark, sf_dir, "documents"), piece_model_path())


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


#: DuckDB SQL of op12's rows: counts of all terms, without prefixes.
OP12_SQL = r"""
with d as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
  from documents),
w as (select r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term from w group by lang, term having count(distinct r) >= 30),
v as (select lang, count(*) as v from kept group by lang),
c as (select lang, source, term, count(*) as n from w join kept using (lang, term) group by all),
g as (
  select lang, source, coalesce(sum(n), 0)::hugeint as total
  from (select distinct lang, source from d) left join c using (lang, source) group by all),
p as (
  select g.lang, g.source, k.term, coalesce(n, 0) as n, (1 + 1000000000::hugeint * (coalesce(n, 0) + 5) // (total + 5 * v))::bigint as p
  from g join kept k on k.lang = g.lang join v on v.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
q as (
  select lang, term, (1 + 1000000000::hugeint * (sum(n) + 5) // (any_value(total) + 5 * any_value(v)))::bigint as q
  from p join (select lang, sum(total) as total from g group by lang) using (lang) join v using (lang) group by lang, term),
f as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p))::bigint as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
terms as (select lang, source, 'term' as part, term as item, p - q as value from p join q using (lang, term) where n > 0 and p > q),
u as (select * from pairs union all select * from terms)
select lang, source, part, item, value, rank from (
  select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from u)
where part = 'pair' or rank <= 50
"""


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_warc_round_trip": op2_warc_round_trip,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_license_scan": op5_license_scan,
    "op6_audio_features": op6_audio_features,
    "op7_language_id": op7_language_id,
    "op8_harmonic_packing": op8_harmonic_packing,
    "op9_bpe_round_trip": op9_bpe_round_trip,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_piece_round_trip": op11_piece_round_trip,
    "op12_source_divergence": op12_source_divergence,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES = {"op4_quality_rules": OP4_SQL, "op12_source_divergence": OP12_SQL}

"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Every rule is a boolean SQL expression that is true where it rejects a document.  On a
bounded sample each rule's time and share of rejections are measured; the cascade then asks
the rules in descending order of rejections per second, and a document that one rule rejects
is not shown to the next.  Rules are deterministic and joined by "or", so the order changes
the time and the rule that is named, never the verdict.  The base metrics are made for every
document, as they are results themselves, so the cascade saves only the rules' own work.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES

#: Rows on which costs and selectivities are estimated, and how they are drawn.
SAMPLE_ROWS, SAMPLE_SHARE, SAMPLE_SEED = 400, 0.05, 7
#: Longer sampled texts are left out of the estimate (never out of the cascade itself).
SAMPLE_CHARS = 100_000


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: str


#: Columns that the expressions can use: text (never null), words (array), and the metrics.
RULES = (
    Rule("symbols", "n_symbols > 0.1 * n_words"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule("repeated_lines", "n_dup_lines > 10 and 2 * n_dup_lines > length(text) - length(replace(text, '\\n', '')) + 1"),
    Rule("exclamations", "length(text) - length(replace(text, '!', '')) > 0.2 * n_words"),
    Rule("capitals", r"regexp_count(text, '\\p{Lu}\\p{Lu}') > 0.3 * n_words"),
    Rule("digits", "regexp_count(text, '[0-9]') > 0.3 * word_chars"),
)

#: Always 0.  The optimizer moves no filter below a projection that holds it; else a filter
#: on a result would be rewritten into a filter that computes every metric once more.
_FENCE_SQL = "cast(rand(0) as bigint)"


def metrics(docs: DataFrame) -> DataFrame:
    """docs (all its columns; text null counts as empty) with _text, _words and the base
    metrics n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long).

    n_repeat_words: every 3-word window is packed as hash and position into one long and the
    longs are sorted; neighbours of one hash are compared word for word.  If a comparison
    fails (two windows of one hash, as in texts of millions of words, whose positions leave
    few bits to it) the windows of that text are sorted by their words instead.
    """
    d = docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    d = d.withColumn("_words", F.expr(rf"array_remove(split(_text, '[{SPACES}]+'), '')".replace("\\", "\\\\")))
    d = d.withColumn("n_words", F.expr("cast(coalesce(size(_words), 0) as bigint)"))
    d = d.withColumns({
        "word_chars": F.expr("aggregate(_words, cast(0 as bigint), (a, w) -> a + char_length(w))"),
        "n_symbols": F.expr("cast(if(_text rlike '[#*$%&|<>]', char_length(_text) - char_length(translate(_text, '#*$%&|<>', '')), 0) as bigint)"),
        "_lines": F.expr(rf"case when instr(_text, char(10)) > 0 then filter(split(_text, char(10)), l -> l rlike '[^{SPACES}]') end".replace("\\", "\\\\")),
        "_bits": F.expr("coalesce(length(bin(n_words)), 1)"),
    })
    d = d.withColumn("n_dup_lines", F.expr("cast(coalesce(size(_lines) - size(array_distinct(_lines)), 0) as bigint)"))
    d = d.withColumn("_at", F.expr("""
        case when n_words < 3 then cast(array() as array<bigint>)
        else sort_array(transform(sequence(cast(0 as bigint), n_words - 3),
            i -> shiftleft(xxhash64(get(_words, int(i)), get(_words, int(i) + 1), get(_words, int(i) + 2)), _bits) | i)) end"""))
    d = d.withColumn("_mask", F.expr("shiftleft(cast(1 as bigint), _bits) - 1"))
    # positions in _at whose hash is that of the entry before
    d = d.withColumn("_same", F.expr("filter(sequence(1, greatest(size(_at) - 1, 1)), i -> shiftrightunsigned(get(_at, i) ^ get(_at, i - 1), _bits) = 0)"))
    here, before = "int(get(_at, i) & _mask)", "int(get(_at, i - 1) & _mask)"
    equal = " and ".join(f"get(_words, {here} + {k}) = get(_words, {before} + {k})" for k in range(3))
    starts = f"array_sort(array_union(transform(_same, i -> {here}), transform(_same, i -> {before})))"
    d = d.withColumn("_exact", F.expr(f"""
        case when not forall(_same, i -> {equal}) then sort_array(transform(sequence(0, int(n_words) - 3),
            p -> struct(get(_words, p) as a, get(_words, p + 1) as b, get(_words, p + 2) as c, p as p))) end"""))
    d = d.withColumn("_equal", F.expr("filter(sequence(1, size(_exact) - 1), i -> get(_exact, i).a = get(_exact, i - 1).a and get(_exact, i).b = get(_exact, i - 1).b and get(_exact, i).c = get(_exact, i - 1).c)"))
    slow = "array_sort(array_union(transform(_equal, i -> get(_exact, i).p), transform(_equal, i -> get(_exact, i - 1).p)))"
    d = d.withColumn("_starts", F.expr(f"case when size(_same) = 0 then cast(array() as array<int>) when _exact is null then {starts} else {slow} end"))
    d = d.withColumn("n_repeat_words", F.expr("""
        aggregate(_starts, struct(cast(0 as bigint) as n, -3 as last),
            (a, p) -> struct(a.n + least(3, p - a.last) as n, p as last), a -> a.n) + """ + _FENCE_SQL))
    return d.drop("_lines", "_bits", "_at", "_mask", "_same", "_exact", "_equal", "_starts")


BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def _named(rule: Rule) -> str:
    return rule.rejects.replace("(text", "(_text").replace("(words", "(_words")


def order_rules(docs: DataFrame, rules=RULES) -> list[Rule]:
    """The rules by rejections per second on a bounded sample, best first.

    The sample is drawn by Spark's seeded sampling and taken from as few partitions as give
    SAMPLE_ROWS rows (of tables too small for that, from the first rows).  An empty sample
    leaves the given order.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("text").cast("string").alias("text")).where(f"char_length(text) <= {SAMPLE_CHARS}")
    rows = texts.sample(SAMPLE_SHARE, SAMPLE_SEED).take(SAMPLE_ROWS) or texts.take(SAMPLE_ROWS)
    if not rows:
        return list(rules)
    sample = metrics(spark.createDataFrame([(r[0],) for r in rows], "text string").coalesce(1)).persist()
    try:
        sample.count()
        shown = sample.where(f"not ({BASE_FAILED})")

        def timed(condition: str) -> tuple[float, int]:
            best = float("inf")
            for _ in range(2):
                t = time.perf_counter()
                n = shown.selectExpr(f"count_if({condition})").first()[0]
                best = min(best, time.perf_counter() - t)
            return best, n

        idle, _ = timed("n_words < 0")
        rank = {}
        for r in rules:
            cost, n = timed(_named(r))
            rank[r.name] = n / max(cost - idle, 1e-4)
    finally:
        sample.unpersist()
    return sorted(rules, key=lambda r: -rank[r.name])


def apply_rules(docs: DataFrame, rules=RULES, ordered: bool = False) -> DataFrame:
    """docs with the base metrics, base_failed, kept and rejected_by (null where kept).

    Null and empty texts have no words, so they fail the base.  Every row comes back, also
    repeated ones, with all its columns; columns of docs that bear one of the new names are
    replaced.
    """
    new = ["_text", "_words", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"]
    d = docs.drop(*new)
    cascade = list(rules) if ordered else order_rules(d, rules)
    verdict = F.when(F.col("base_failed"), F.lit("base"))
    for r in cascade:
        verdict = verdict.when(F.expr(_named(r)), F.lit(r.name))
    out = metrics(d).withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("rejected_by", verdict)
    return out.withColumn("kept", F.col("rejected_by").isNull() & F.expr(f"{_FENCE_SQL} = 0")).drop("_text", "_words")


def keep_clean(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of docs that the cascade keeps, with all their columns, whatever their names."""
    names = docs.columns
    judged = apply_rules(docs.select(F.struct(*names).alias("_all"), F.col("text").alias("text")), rules)
    return judged.where("kept").select(*(F.col("_all")[n].alias(n) for n in names))

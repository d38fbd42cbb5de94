"""Quality rules as a short-circuit cascade, in built-in column functions only.

A rule is a condition on the text that rejects a document. Cost and selectivity of every rule are
measured on a bounded sample; the cascade then tries them by falling (share rejected / cost), so that an
expensive rule runs only where the cheaper ones let a document pass. The order decides the work, never the
verdict: a document is kept if no rule rejects it.

Defined results: a null or empty text has no words and is rejected as too short; repeated rows and ties get
equal verdicts; an empty table has an empty result; a null key is kept as it is; other columns of the
input are ignored or handed on.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlens.llm.shared import written

SPACE = r"[ \t-\r]+"
SYMBOLS = r"[#*$%&|<>]+"
#: Words in a window for repeats.
WINDOW = 8
#: Rows of the sample that cost and selectivity are measured on; the verdicts don't depend on it.
SAMPLE_ROWS = 2_000


def _let(value: Column, then) -> Column:
    """then(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def word_chars(words: Column) -> Column:
    return F.char_length(F.concat_ws("", words)).cast("long")


def symbols(text: Column) -> Column:
    return F.coalesce(F.char_length(text) - F.char_length(F.regexp_replace(text, SYMBOLS, "")), F.lit(0)).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(r"[^ \t-\r]"))


def lines(text: Column) -> Column:
    """Lines with a word."""
    return F.size(_lines(text)).cast("long")


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier one."""
    return _let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def repeat_words(words: Column) -> Column:
    """Words inside windows of eight words that occur twice or more in the text.

    Windows are hashed. A text whose hashes all differ is done; otherwise the hashes are sorted with their
    places, and the places next to an equal hash are the repeated windows.
    """
    first_to_last = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    hashes = F.transform(first_to_last, lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW))))

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    def repeated(pairs: Column) -> Column:
        same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
        places = F.transform(
            pairs, lambda p, i: F.when(same(p, F.get(pairs, i - 1)) | same(p, F.get(pairs, i + 1)), p["i"])
        )
        return _let(F.sort_array(F.array_compact(places)), covered)

    def count(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(F.sort_array(pairs), repeated))

    return F.when(F.size(words) < WINDOW + 1, F.lit(0)).otherwise(_let(hashes, count)).cast("long")


@dataclass(frozen=True)
class Rule:
    """`rejects` makes the condition from the text and its words."""

    name: str
    rejects: Callable[[Column, Column], Column]


STANDARD = (
    Rule("too_short", lambda text, words: F.size(words) < 20),
    Rule("odd_word_length", lambda text, words: (word_chars(words) > 20 * F.size(words)) | (word_chars(words) < 2 * F.size(words))),
    Rule("symbols", lambda text, words: 2 * symbols(text) > F.size(words)),
    Rule("dup_lines", lambda text, words: 2 * dup_lines(text) > lines(text)),
    Rule("repeats", lambda text, words: 100 * repeat_words(words) > 30 * F.size(words)),
)


def verdict(rules: Sequence[Rule], text: Column) -> Column:
    """True if no rule rejects; a rule is evaluated only where those before it let the row pass.

    The words are bound inside the expression, so that it stays one pass wherever Spark moves it.
    """
    whole = F.coalesce(text, F.lit(""))

    def tried(words: Column) -> Column:
        first, *rest = rules
        cases = F.when(first.rejects(whole, words), F.lit(False))
        return reduce(lambda cases, r: cases.when(r.rejects(whole, words), F.lit(False)), rest, cases).otherwise(F.lit(True))

    return _let(words_of(whole), tried)


def cascade_order(df: DataFrame, rules: Sequence[Rule] = STANDARD, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by falling rejection per cost, both measured on a seeded sample of at most `sample_rows`."""
    total = df.count()
    if not total:
        return list(rules)
    share = min(1.0, 1.2 * sample_rows / total)
    rows = df.select(text) if share == 1.0 else df.select(text).sample(share, seed=11)
    sample = written(rows.limit(sample_rows), "rule-sample")

    def seconds(rule: Rule) -> tuple[float, int]:
        begin = time.perf_counter()
        hits = sample.agg(F.count_if(~verdict([rule], F.col(text)))).first()[0]
        return time.perf_counter() - begin, hits

    nothing = Rule("nothing", lambda text, words: F.size(words) < 0)
    seconds(nothing)  # start-up is no rule's cost
    floor = seconds(nothing)[0]
    measured = {r.name: seconds(r) for r in rules}
    worth = {name: hits / max(cost - floor, 1e-3) for name, (cost, hits) in measured.items()}
    return sorted(rules, key=lambda r: -worth[r.name])


def passing(df: DataFrame, rules: Sequence[Rule] = STANDARD, text: str = "text") -> DataFrame:
    """The rows of `df` that no rule rejects."""
    return df.where(verdict(cascade_order(df, rules, text), F.col(text)))


def judged(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of every text, the base verdict, and the verdict of the cascade."""
    order = cascade_order(df, STANDARD, text)
    whole = F.coalesce(F.col(text), F.lit(""))

    def counts(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            word_chars(words).alias("word_chars"),
            symbols(whole).alias("n_symbols"),
            dup_lines(whole).alias("n_dup_lines"),
            repeat_words(words).alias("n_repeat_words"),
        )

    counted = df.select(
        key,
        _let(words_of(whole), counts).alias("_c"),
        verdict([r for r in order if r.name not in ("too_short", "repeats")], whole).alias("_passed"),
    ).select(key, "_c.*", "_passed")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("_passed")).alias("kept"),
    )

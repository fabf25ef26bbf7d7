"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

``measures`` adds the counts that the rules speak of, ``verdict`` compiles a rule table into one
boolean expression, ``apply_rules`` does both.

Defined results: a null or empty text has no words, so every count is 0 and it fails the base
rule; repeated rows are judged one by one; an empty table gives an empty result; columns of the
input other than the key and the text are dropped, so clashing names cannot arise.  Very long
texts stay within one row, as several arrays of their words, so a text has to fit into a task's memory
several times over; the only per-row sort is over 64-bit window hashes.

The rule on stop words knows the four languages listed below: it drops texts of 40 words or more in any
other language.  For a corpus with others, give ``apply_rules`` rules without it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podspark.llm.common import SPACES, ascii_lower, let, words_of

#: Frequent function words of the four languages.
STOP_WORDS = {
    "en": "the of and to in is that for it as was with be by on not he his from are this at have or an a".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il avec".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus es o".split(),
}
SYMBOLS = "#*$%&|<>"
WINDOW = 5


class Rule(NamedTuple):
    """``low`` <= measure <= ``high`` (None: open), for texts of at least ``min_words`` words."""

    measure: str
    low: float | None
    high: float | None
    min_words: int = 0


#: Production thresholds.
RULES = (
    Rule("n_words", 10, None),
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbol_ratio", None, 0.05),
    Rule("stop_ratio", 0.02, None, 40),
    Rule("dup_line_ratio", None, 0.40),
)


def _repeat_words(words: Column) -> Column:
    """Words inside 5-word windows that occur at least twice in the text, in n log n at most."""

    def positions(ordered: Column) -> Column:
        n = F.size(ordered)
        same = lambda i, x: F.coalesce(F.get(ordered, i)["h"] == x["h"], F.lit(False))
        return F.array_sort(
            F.transform(F.filter(ordered, lambda x, i: same(i - 1, x) | ((i + 1 < n) & same(i + 1, x))), lambda x: x["i"])
        )

    def covered(at: Column) -> Column:
        step = lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW)))
        return F.aggregate(F.transform(at, step), F.lit(0), lambda a, x: a + x)

    def count(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        exact = let(let(ordered, positions), covered)
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), exact).otherwise(F.lit(0))

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) > WINDOW, let(windows, count)).otherwise(F.lit(0))


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row with the key and every measure that rules can name."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.translate(x, SPACES, "") != "")
    stops = sorted({w for words in STOP_WORDS.values() for w in words})
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    plain = F.transform(F.split(ascii_lower(body), "[\x20\x09-\x0d.,;:!?()\"]+"), lambda w: w)
    counted = docs.select(
        F.col(key),
        F.length(F.translate(body, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("distinct"))).alias("lines"),
        F.size(F.filter(plain, lambda w: w.isin(stops))).alias("n_stop"),
        words_of(F.col(text)).alias("words"),
    ).select(
        key,
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.col("lines.all") - F.col("lines.distinct")).cast("long").alias("n_dup_lines"),
        F.col("lines.all").alias("n_lines"),
        _repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        "n_stop",
    )
    return counted.select(
        "*",
        ratio("word_chars", "n_words").alias("mean_word_chars"),
        ratio("n_symbols", "word_chars").alias("symbol_ratio"),
        ratio("n_stop", "n_words").alias("stop_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The rule table as one boolean expression over the columns of ``measures``."""
    ok = F.lit(True)
    for r in rules:
        holds = F.lit(True)
        if r.low is not None:
            holds &= F.col(r.measure) >= r.low
        if r.high is not None:
            holds &= F.col(r.measure) <= r.high
        ok &= holds | (F.col("n_words") < r.min_words) if r.min_words else holds
    return ok


def apply_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures plus ``base_failed`` and ``kept``."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measures(docs, key, text).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))

"""Quality rules: a threshold table compiled into one Spark projection.

Every figure is a built-in expression over the text, so a rule set of any size is one narrow
stage: no shuffle, no Python. Null and empty texts have no words: all figures 0, not kept.
Repeated rows are judged alike; the input's columns pass unless a figure bears their name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of the languages the rules serve.
STOP_WORDS = {
    "en": "the of and to a in is it that for was on with be as by are this at an or from not have",
    "de": "der die und in den von zu das mit auf sich des für ist im dem ein nicht eine als auch es an",
    "fr": "de la le et les des en un une du que est pour qui dans par pas au sur se plus ne ce il",
    "es": "de la que el en y los se del las por un no con una su es para al lo como más o pero",
}


@dataclass(frozen=True)
class Rule:
    """A text fails when ``figure`` is under ``low`` or over ``high``."""

    figure: str
    low: float | None = None
    high: float | None = None


#: Ratios are per word or per line; base_failed stands beside them.
RULES = (
    Rule("n_words", low=50),
    Rule("mean_word_chars", low=2.0, high=14.0),
    Rule("symbol_ratio", high=0.2),
    Rule("stop_ratio", low=0.02),
    Rule("dup_line_ratio", high=0.5),
    Rule("repeat_ratio", high=0.5),
    Rule("upper_ratio", high=0.6),
)

SPACE = r"[\x20\x09-\x0D]+"


def _bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside a three-word window that occurs twice or more in the text.

    Windows are told apart by two 64-bit hashes and sorted by them, then place; neighbours that agree are
    repeats. Their places, sorted again, cover ``min(3, gap)`` words each. No window's text is made.
    """

    def repeats(ordered: Column) -> Column:
        last = F.size(ordered) - 1
        same = lambda i, j: (ordered[i]["h"] == ordered[j]["h"]) & (ordered[i]["g"] == ordered[j]["g"])
        hits = F.filter(ordered, lambda x, i: same(F.greatest(i - 1, F.lit(0)), i) & (i > 0) | same(F.least(i + 1, last), i) & (i < last))
        return F.sort_array(F.transform(hits, lambda x: x["p"]))

    def covered(places: Column) -> Column:
        last = F.size(places) - 1
        gaps = F.transform(places, lambda p, i: F.when(i == last, F.lit(3)).otherwise(F.least(F.lit(3), places[F.least(i + 1, last)] - p)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, gap: total + gap)

    def windows(w: Column) -> Column:
        made = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), F.xxhash64(F.lit(1), w[i], w[i + 1], w[i + 2]).alias("g"), i.alias("p")),
        )
        return _bound(_bound(F.sort_array(made), repeats), covered)

    return _bound(words, lambda w: F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(windows(w)))


def figures(text: Column, words: Column, stop_words: list[str]) -> dict[str, Column]:
    """The base figures of a text, whose words are given, as expressions."""
    n = F.size(words).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, " \t\n\x0b\x0c\r", "")) > 0)
    return {
        "n_words": n,
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_lines": _bound(lines, F.size).cast("long"),
        "n_dup_lines": _bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _repeat_words(words),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(F.rtrim(w, F.lit(".,!?;:"))).isin(stop_words))).cast("long"),
        "n_upper": (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}", ""))).cast("long"),
    }


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", stop_words: dict[str, str] = STOP_WORDS) -> DataFrame:
    """``docs`` with the figures, ``base_failed``, ``failed_rules`` and ``kept``.

    ``base_failed``: under 50 words, or over half of them in repeated three-word windows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    split = F.filter(F.split(body, SPACE), lambda w: w != "")
    stops = sorted({w for words in stop_words.values() for w in words.split()})
    made = figures(body, F.col("__words"), stops)
    own = [c for c in docs.columns if c not in {*made, "base_failed", "kept", "failed_rules"}]
    measured = docs.select(*own, split.alias("__words")).select(*own, *[c.alias(k) for k, c in made.items()])
    per = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))
    value = {
        "mean_word_chars": per("word_chars", "n_words"),
        "symbol_ratio": per("n_symbols", "n_words"),
        "stop_ratio": per("n_stop_words", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "repeat_ratio": per("n_repeat_words", "n_words"),
        "upper_ratio": per("n_upper", "word_chars"),
    }
    broken = []
    for rule in rules:
        at = value.get(rule.figure, F.col(rule.figure))
        tests = [at < rule.low] * (rule.low is not None) + [at > rule.high] * (rule.high is not None)
        for test in tests:
            broken.append(F.when(test, F.lit(rule.figure)))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    failed = F.array_compact(F.array(*broken))
    return measured.withColumns({"base_failed": base, "failed_rules": failed}).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))

"""Quality rules: a table of thresholds compiled into one projection.

Every measure is a native column expression over the row's own text, so the
scan is followed by a projection alone: no shuffle, no user function.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrearly.llm.common import words

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "on", "with", "as",
    "der", "die", "und", "das", "von", "zu", "den", "mit", "ist", "des", "im", "ein",
    "de", "la", "le", "les", "et", "des", "un", "une", "du", "en", "que", "pour", "dans",
    "el", "los", "las", "y", "se", "del", "por", "con", "para", "una", "no",
)


@dataclass(frozen=True)
class Rule:
    """A text fails if ``measure`` lies outside [least, most]; None is no limit."""

    measure: str
    least: float | None = None
    most: float | None = None
    # The rule applies to texts of at least so many words and lines.
    min_words: int = 0
    min_lines: int = 0


# A share says nothing about a handful of words or lines, hence the minima.
RULES = (
    Rule("n_words", least=50, most=100_000),
    Rule("mean_word_length", least=2.5, most=10),
    Rule("symbol_ratio", most=0.1),
    Rule("exclamation_ratio", most=0.3, min_words=20),
    Rule("letter_ratio", least=0.7, min_words=20),
    Rule("upper_ratio", most=0.4, min_words=20),
    Rule("n_stop_words", least=2, min_words=50),
    Rule("dup_line_ratio", most=0.3, min_lines=5),
    Rule("bullet_line_ratio", most=0.9, min_lines=5),
    Rule("ellipsis_line_ratio", most=0.3, min_lines=5),
    Rule("repeat_ratio", most=0.5),
)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once."""
    return F.transform(F.array(value), then)[0]


def _repeated_words(w: Column) -> Column:
    """Words that lie in a three-word window found more than once.

    The windows are sorted with their positions, so equal ones are neighbours.
    Zips and the sort are whole-array functions; the one lambda that runs for
    every window compares neighbours and mostly ends at the first word. A
    repeated window at position p covers p..p+2: from one repeated window to
    the next it adds the distance between them, at most three words.
    """
    n = F.size(w) - 2
    windows = F.arrays_zip(
        F.slice(w, 1, n), F.slice(w, 2, n), F.slice(w, 3, n), F.sequence(F.lit(0), n - 1)
    )

    def neighbours(s: Column) -> Column:
        return F.filter(
            F.arrays_zip(F.slice(s, 1, n - 1), F.slice(s, 2, n - 1)),
            lambda p: (p["0"]["0"] == p["1"]["0"])
            & (p["0"]["1"] == p["1"]["1"])
            & (p["0"]["2"] == p["1"]["2"]),
        )

    def starts(twice: Column) -> Column:
        both = F.concat(
            F.transform(twice, lambda p: p["0"]["3"]), F.transform(twice, lambda p: p["1"]["3"])
        )
        return F.sort_array(F.array_distinct(both))

    def covered(p: Column) -> Column:
        return F.aggregate(
            p,
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda acc, i: F.struct(
                (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")
            ),
            lambda acc: acc["n"],
        )

    return F.when(
        F.size(w) >= 4,
        _let(
            F.sort_array(windows),
            lambda s: _let(neighbours(s), lambda twice: covered(starts(twice))),
        ),
    ).otherwise(F.lit(0))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column ``measures``: a struct of every count and ratio.

    A NULL text counts as an empty one and all its measures are 0. A column of
    ``docs`` with the same name is replaced. Rows never meet: repeated rows get
    equal results, and an empty table gives an empty one.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c != "measures"]
    t, w, lines = F.col("t"), F.col("w"), F.col("lines")
    n_words, n_lines = F.size(w), F.size(lines)

    def matched(pattern: str) -> Column:
        return F.length(t) - F.length(F.regexp_replace(t, pattern, ""))

    def lines_like(test: Callable[[Column], Column]) -> Column:
        return F.size(F.filter(lines, test))

    # Different ones, in lower case or capitalised.
    stop_words = [*dict.fromkeys(form for x in STOP_WORDS for form in (x, x.capitalize()))]
    counts = {
        "n_words": n_words,
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": matched(r"[#*$%&|<>]+"),
        "n_lines": n_lines,
        "n_dup_lines": n_lines - F.size(F.array_distinct(lines)),
        "n_repeat_words": _repeated_words(w),
        "n_stop_words": F.size(F.array_intersect(w, F.array(*map(F.lit, stop_words)))),
        "n_letters": matched(r"\p{L}+"),
        "n_upper": matched(r"\p{Lu}+"),
        "n_exclamations": matched(r"!+"),
        "n_bullet_lines": lines_like(lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•")),
        "n_ellipsis_lines": lines_like(
            lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…")
        ),
    }
    c = F.col("c")
    ratios = {
        "mean_word_length": _share(c["word_chars"], c["n_words"]),
        "symbol_ratio": _share(c["n_symbols"], c["n_words"]),
        "exclamation_ratio": _share(c["n_exclamations"], c["n_words"]),
        "letter_ratio": _share(c["n_letters"], c["word_chars"]),
        "upper_ratio": _share(c["n_upper"], c["word_chars"]),
        "dup_line_ratio": _share(c["n_dup_lines"], c["n_lines"]),
        "bullet_line_ratio": _share(c["n_bullet_lines"], c["n_lines"]),
        "ellipsis_line_ratio": _share(c["n_ellipsis_lines"], c["n_lines"]),
        "repeat_ratio": _share(c["n_repeat_words"], c["n_words"]),
    }
    return (
        docs.select(
            F.struct(*kept).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("t")
        )
        .select(
            "row", "t", words(t).alias("w"),
            F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        )
        .select("row", F.struct(*[v.cast("long").alias(k) for k, v in counts.items()]).alias("c"))
        .select("row.*", F.struct("c.*", *[v.alias(k) for k, v in ratios.items()]).alias("measures"))
    )


def verdict(rules: tuple[Rule, ...] = RULES, measured: str = "measures") -> Column:
    """The rules as one column: the names of those that fail, in table order."""
    m = F.col(measured)

    def fails(rule: Rule) -> Column:
        value = m[rule.measure]
        outside = [value < rule.least] * (rule.least is not None)
        outside += [value > rule.most] * (rule.most is not None)
        enough = (m["n_words"] >= rule.min_words) & (m["n_lines"] >= rule.min_lines)
        return reduce(Column.__or__, outside, F.lit(False)) & enough

    return F.filter(
        F.array(*[F.when(fails(r), F.lit(r.measure)) for r in rules]), lambda x: x.isNotNull()
    )


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with ``measures``, ``failed_rules`` and ``kept``.

    A text without a word fails the length rule. Ties do not occur: each text is
    judged by itself. Columns of these three names are replaced.
    """
    df = measures(docs.drop("failed_rules", "kept"), text)
    return df.withColumn("failed_rules", verdict(rules)).withColumn(
        "kept", F.size("failed_rules") == 0
    )

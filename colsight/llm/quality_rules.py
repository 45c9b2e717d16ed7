"""Quality rules: one table of thresholds, compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsight.llm.shared import boxed, let, quoted, unboxed, words

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "with",
    "der", "die", "und", "den", "das", "von", "mit", "ein", "zu", "im",
    "de", "la", "le", "et", "les", "des", "que", "un", "une", "du",
    "el", "en", "y", "los", "las", "se", "del", "al", "una", "por",
)


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low <= numerator / denominator <= high``; ``None`` leaves a side open."""

    name: str
    numerator: str
    denominator: str | None = None
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("n_words", "n_words", low=50),
    Rule("repeated_words", "n_repeat_words", "n_words", high=0.5),
    Rule("mean_word_length", "word_chars", "n_words", low=2.0, high=15.0),
    Rule("symbols_per_word", "n_symbols", "n_words", high=0.1),
    Rule("stop_words", "n_stop_words", "n_words", low=0.02),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.5),
)
BASE = ("n_words", "repeated_words")


def repeated_words(tokens: Column, width: int = 3) -> Column:
    """Words that lie in a window of ``width`` words which occurs twice or more in the array.

    Hashes only rule repetition out (most documents); what they let through is compared as words.
    Equal windows stand together in the sorted array, so a window repeats if a neighbour equals it.
    """
    starts = F.sequence(F.lit(1), F.size(tokens) - (width - 1))
    parts = lambda i: [F.element_at(tokens, (i + k).cast("int")) for k in range(width)]
    hashes = F.transform(starts, lambda i: F.xxhash64(*parts(i)))
    windows = F.sort_array(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *parts(i)).alias("w"), i.alias("i"))))

    def covered(places: Column) -> Column:
        # a window adds the words up to the next repeated window, at most its width
        until = lambda k: F.coalesce(F.get(places, k + 1) - F.get(places, k), F.lit(width))
        steps = F.transform(F.sequence(F.lit(0), F.size(places) - 1), lambda k: F.least(F.lit(width), until(k)))
        return F.when(F.size(places) > 0, F.aggregate(steps, F.lit(0), lambda a, b: a + b)).otherwise(0)

    def repeated(sorted_windows: Column) -> Column:
        same = lambda x, k: (F.get(sorted_windows, k - 1)["w"] == x["w"]) | (F.get(sorted_windows, k + 1)["w"] == x["w"])
        hits = F.filter(sorted_windows, lambda x, k: F.coalesce(F.when(k > 0, same(x, k)).otherwise(F.get(sorted_windows, k + 1)["w"] == x["w"]), F.lit(False)))
        return let(F.sort_array(F.transform(hits, lambda x: x["i"])), covered)

    some = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.size(tokens) <= width, 0).otherwise(F.when(some, let(windows, repeated)).otherwise(0)).cast("long")


def _line_counts(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda kept: F.struct(F.size(kept).alias("n"), F.size(F.array_distinct(kept)).alias("distinct")))


def measures(text: Column) -> Column:
    """The counts that rules refer to, as one struct of longs; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))

    def counted(tokens: Column) -> Column:
        stops = F.filter(tokens, lambda w: F.lower(w).isin(*STOP_WORDS))
        return F.struct(
            F.size(tokens).cast("long").alias("n_words"),
            F.char_length(F.array_join(tokens, "")).cast("long").alias("word_chars"),
            repeated_words(tokens).alias("n_repeat_words"),
            F.size(stops).cast("long").alias("n_stop_words"),
        )

    lines = _line_counts(text)
    return let(
        F.struct(let(words(text), counted).alias("w"), lines.alias("l")),
        lambda m: F.struct(
            *[m["w"][name].alias(name) for name in ("n_words", "word_chars", "n_repeat_words", "n_stop_words")],
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            m["l"]["n"].cast("long").alias("n_lines"),
            (m["l"]["n"] - m["l"]["distinct"]).cast("long").alias("n_dup_lines"),
        ),
    )


def broken(rule: Rule, counts: Column) -> Column:
    """Whether a document breaks a rule. Ratios are compared as products, and hold for no words at all."""
    top = counts[rule.numerator].cast("double")
    bottom = counts[rule.denominator] if rule.denominator else F.lit(1)
    failed = F.lit(False)
    if rule.low is not None:
        failed = failed | (top < rule.low * bottom)
    if rule.high is not None:
        failed = failed | (top > rule.high * bottom)
    return failed


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``measures`` (struct of counts), ``broken`` (names of the broken rules) and ``kept``.

    One projection of built-in functions over whole texts, without a shuffle. A null or empty text
    has no words and breaks the length rule. Repeated rows are judged alike; columns of the caller
    with the names of added ones are replaced.
    """
    # One-row explode: a filter on the verdict is not pushed below it, where it would compute the counts once per rule.
    counted = boxed(docs, counts=F.explode(F.array(measures(F.col(quoted(text))))))
    names = F.array(*[F.when(broken(rule, F.col("counts")), F.lit(rule.name)) for rule in rules])
    return unboxed(counted, docs.columns, measures=F.col("counts"), broken=F.array_compact(names)).withColumn(
        "kept", F.size("broken") == 0
    )

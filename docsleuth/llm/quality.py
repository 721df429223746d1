"""Quality rules as weak supervision: rules vote or abstain, and expectation-maximisation weighs them.

Each rule looks at one figure of a text and votes good (1), bad (0) or abstains (null). No rule decides: the
model says that a text is good with some prior probability, and that each rule's votes are right with a
probability of its own. Expectation-maximisation fits these from agreement alone,
and the posterior probability of good is the score. Its sufficient statistics are the counts of the distinct
vote patterns, at most 3 ** rules rows however large the corpus.

All work on texts is built-in expressions. Null and empty texts have no words and fail the base rules. Words
are cut at the six ASCII white space characters. Texts of any length are one row's arrays, sorted once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsleuth.llm.common import written

SPACE = r"[ \t-\r]+"
SPACES = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
MIN_WORDS = 50
REPEAT_PERCENT = 50
ROUNDS = 50
FIRST_ACCURACY, FIRST_PRIOR = 0.85, 0.8
#: Bounds that keep rules with few or one-sided votes from being argued away: every vote counts, and bad texts are never taken to be rare.
LEAST_ACCURACY, MOST_GOOD = 0.8, 0.9


def repeated_words(words: Column, n: Column) -> Column:
    """Words that stand in a window of three found at least twice, the first place included.

    Windows are sorted by hash and place; equal neighbours give the places of repeated windows, and each place
    covers as many words as lie before the next one, three at most.
    """
    places = F.sequence(F.lit(0), n - 3)
    keyed = F.sort_array(F.transform(places, lambda i: F.struct(F.xxhash64(words[i], words[i + 1], words[i + 2]).alias("h"), i.alias("i"))))
    kept = lambda s: F.sort_array(
        F.filter(F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"])), lambda i: i.isNotNull())
    )
    covered = lambda p: F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"].cast("long"))
    return F.when(n < 4, F.lit(0).cast("long")).otherwise(F.element_at(F.transform(F.array(keyed), lambda s: covered(kept(s))), 1))


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the further figures that the rules use."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("__id"), text.alias("__t"))
    rows = rows.withColumn("__w", F.filter(F.split("__t", SPACE), lambda w: w != ""))
    lines = F.filter(F.split("__t", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    rows = rows.select("__id", "__t", "__w", F.size("__w").alias("__n"), lines.alias("__l"))
    less = lambda chars: F.length("__t") - F.length(F.translate("__t", chars, ""))
    return rows.select(
        F.col("__id").alias(id_col),
        F.col("__n").cast("long").alias("n_words"),
        F.length(F.translate("__t", SPACES, "")).cast("long").alias("word_chars"),
        less(SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__w"), F.col("__n")).alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
        less("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_capitals"),
        less("0123456789").cast("long").alias("n_digits"),
        less(".").cast("long").alias("n_stops"),
        less("!").cast("long").alias("n_calls"),
        less(MARKS).cast("long").alias("n_marks"),
        F.size(F.array_distinct("__w")).cast("long").alias("n_distinct"),
    )


def _per(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def default_rules() -> dict[str, Column]:
    """A vote for each rule: 0 bad, 1 good, null abstains.

    A rule that looks for one fault says nothing when it finds none; the last three vote good, on figures that
    every kind of fault moves.
    """
    bad = lambda c: F.when(c, F.lit(0))
    good = lambda c: F.when(c, F.lit(1))
    mean = _per("word_chars", "n_words")
    return {
        "word_length": bad((mean < 2.5) | (mean > 12)),
        "symbols": bad(_per("n_symbols", "n_words") > 0.2),
        "symbol_share": bad(_per("n_symbols", "word_chars") > 0.04),
        "marks": bad(_per("n_marks", "word_chars") > 0.1),
        "duplicate_lines": bad(_per("n_dup_lines", "n_lines") > 0.3),
        "repetition": bad(_per("n_repeat_words", "n_words") > 0.3),
        "capitals": bad(_per("n_capitals", "word_chars") > 0.3),
        "digits": bad(_per("n_digits", "word_chars") > 0.2),
        "calls": bad(_per("n_calls", "n_words") > 0.2),
        "variety": bad(_per("n_distinct", "n_words") < 0.25),
        "no_sentences": bad((F.col("n_words") >= 100) & (_per("n_stops", "n_words") < 0.005)),
        "plain_marks": good((F.col("n_words") >= 20) & (_per("n_marks", "word_chars") < 0.06)),
        "prose": good((F.col("n_words") >= 20) & (_per("n_stops", "n_words") > 0.01) & (_per("n_symbols", "n_words") < 0.05) & (_per("n_capitals", "word_chars") < 0.15)),
        "fresh_words": good((F.col("n_words") >= 20) & (_per("n_distinct", "n_words") > 0.3) & (_per("n_repeat_words", "n_words") < 0.15) & (_per("n_symbols", "n_words") < 0.1)),
    }


def fit(patterns: list[tuple[tuple[int | None, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[float]]:
    """The share of good texts, and each rule's accuracy: how likely a vote of it is right.

    patterns are distinct votes with their counts. Abstaining tells nothing. Rules are taken to be right more
    often than not, which also keeps the two classes from being exchanged.
    """
    total = sum(n for _, n in patterns)
    prior, accuracy = FIRST_PRIOR, [FIRST_ACCURACY] * (len(patterns[0][0]) if patterns else 0)
    for _ in range(rounds * bool(total)):
        post = [posterior(p, prior, accuracy) for p, _ in patterns]
        prior = min(MOST_GOOD, max(0.5, sum(q * n for q, (_, n) in zip(post, patterns, strict=True)) / total))
        for i in range(len(accuracy)):  # maximisation, rule by rule
            seen = [(q if p[i] else 1 - q, n) for q, (p, n) in zip(post, patterns, strict=True) if p[i] is not None]
            # a few votes of the first guess, for rules that hardly ever vote
            right = (sum(q * n for q, n in seen) + 10 * FIRST_ACCURACY) / (sum(n for _, n in seen) + 10)
            accuracy[i] = min(0.99, max(LEAST_ACCURACY, right))
    return prior, accuracy


def posterior(votes: tuple[int | None, ...], prior: float, accuracy: list[float]) -> float:
    """The probability that a text with these votes is good."""
    z = math.log(prior / (1 - prior)) + sum((1 if v else -1) * math.log(a / (1 - a)) for v, a in zip(votes, accuracy, strict=True) if v is not None)
    return 1 / (1 + math.exp(-z))


def scored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=default_rules, rounds: int = ROUNDS, threshold: float = 0.5) -> DataFrame:
    """The measured figures, base_failed, quality (posterior probability of good) and kept: one row per input row.

    The figures are computed once and written to the shared folder; the vote patterns' counts, a bounded table,
    are all that reaches the driver.
    """
    figures = written(measured(df, id_col, text_col))
    votes = rules()
    cast = F.struct(*[F.coalesce(v.cast("int"), F.lit(-1)).alias(k) for k, v in votes.items()])
    counted = figures.groupBy(cast.alias("p")).count().collect()
    prior, accuracy = fit(sorted(((tuple(None if x < 0 else x for x in r["p"]), r["count"]) for r in counted), key=str), rounds)
    accuracy = accuracy or [FIRST_ACCURACY] * len(votes)  # no rows
    odds = F.lit(math.log(prior / (1 - prior)))
    for a, v in zip(accuracy, votes.values(), strict=True):
        odds = odds + F.coalesce((2 * v - 1) * math.log(a / (1 - a)), F.lit(0.0))
    quality = 1 / (1 + F.exp(-odds))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return figures.withColumn("base_failed", failed).withColumn("quality", quality).withColumn("kept", ~failed & (F.col("quality") >= threshold))

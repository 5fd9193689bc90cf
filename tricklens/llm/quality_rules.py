"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule votes 1 (good), -1 (bad) or 0 (abstains) from per-document counts.
All documents are first reduced to their vote patterns (at most 3^rules of
them, whatever the corpus size). Documents are taken to be good or of one of a few
kinds of bad ones (``KINDS``: marked up, repetitive, ill-formed), because a page of
symbols and a page that says one thing over and over fail different rules; within a kind, rules
vote independently. EM over the pattern counts, inside one SQL expression,
estimates the share of each kind and each rule's rate of good votes in it. The
posterior probability of "good" joins back to the documents and replaces
all-must-pass filtering: a rule that many sound documents fail loses
its weight, several good votes outweigh a bad one that is no mark of a kind.

No estimate is bounded. Each starts as ``SMOOTHING`` made-up votes, which a few
documents outweigh. Which class is called good is settled at the end: the one
whose rules vote good most often on average.

Defined results: a null or empty text has no words, so it fails the base
rules; repeated rows are judged each on its own; an empty table gives an empty
result; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tricklens.llm.common import NOT_SPACE_CLASS, let, private_names, stored, words

SYMBOLS = r"[^#*$%&|<>]+"
MIN_WORDS = 50
MAX_REPEAT_PCT = 50
MARK = r"[#*$%&|<>]"
ITERATIONS = 20
THRESHOLD = 0.5
RULES = ("symbols", "marked", "lines", "repeats", "variety", "lengths", "shouting", "endings")
# The rules that a kind of bad documents mainly fails, before the first step.
KINDS = (("symbols", "marked"), ("lines", "repeats", "variety"), ("lengths", "shouting", "endings"))
GOOD_SHARE = 0.8  # of all documents, before the first step; the kinds share the rest
SMOOTHING = 2.0  # made-up votes a rule and kind, and documents, that hold the start values
# Rates of good votes before the first step: in good documents, and in bad ones by rules of another and of their own kind.
IN_GOOD, IN_OTHER, IN_OWN = 0.95, 0.9, 0.4
START_SHARES = (GOOD_SHARE, *[(1 - GOOD_SHARE) / len(KINDS)] * len(KINDS))
START_RATES = tuple([(IN_GOOD,) * len(RULES), *[tuple(IN_OWN if r in kind else IN_OTHER for r in RULES) for kind in KINDS]])


def repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more (the first one included)."""
    none = F.lit(0).cast("long")

    def covered(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - 3)
        hashes = F.transform(places, lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

        def exact() -> Column:
            keyed = F.sort_array(F.transform(places, lambda i: F.struct(F.concat_ws(" ", w[i], w[i + 1], w[i + 2]).alias("k"), i.alias("i"))))

            def flagged(s: Column) -> Column:
                last = F.size(s) - 1
                twice = lambda x, j: ((j > 0) & (s[F.greatest(j - 1, F.lit(0))]["k"] == x["k"])) | (
                    (j < last) & (s[F.least(j + 1, last)]["k"] == x["k"])
                )
                return F.sort_array(F.transform(F.filter(s, twice), lambda x: x["i"]))

            def count(p: Column) -> Column:
                spans = F.zip_with(F.slice(p, 2, F.size(p)), F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(3)))
                return F.aggregate(spans, F.lit(3).cast("long"), lambda n, x: n + x)

            return let(let(keyed, flagged), lambda p: F.when(F.size(p) == 0, none).otherwise(count(p)))

        # Distinct hashes prove distinct windows; only then is the exact comparison left out.
        return F.when(F.size(F.array_distinct(hashes)) == F.size(w) - 2, none).otherwise(exact())

    return F.when(F.size(w) < 3, none).otherwise(let(w, covered))


def counts(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a struct column of the counts that the rules look at; and the column's name."""
    w, m = private_names(docs, "q_words", "q_counts")
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(NOT_SPACE_CLASS))
    with_words = docs.withColumn(w, words(F.col(text)))
    made = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, SYMBOLS, "")).cast("long").alias("n_symbols"),
        F.size(F.filter(w, lambda x: x.rlike(MARK))).cast("long").alias("n_marked"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col(w)).alias("n_repeat_words"),
        F.length(F.regexp_replace(t, "[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.size(F.filter(lines, lambda x: x.rlike(r"[.!?:;\"')\x{3002}\x{2026}]" + r"[\x20\x09-\x0D]*$"))).cast("long").alias("n_ended"),
    )
    return with_words.withColumn(m, made).drop(w), m


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PCT * m["n_words"])


def votes(m: Column) -> dict[str, Column]:
    """One vote per rule: 1 good, -1 bad, 0 abstains."""

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    n = m["n_words"]
    return {
        "symbols": vote(100 * m["n_symbols"] > 30 * n, 100 * m["n_symbols"] <= 5 * n),
        "marked": vote(100 * m["n_marked"] > 25 * n, 100 * m["n_marked"] <= 5 * n),
        "lines": vote(100 * m["n_dup_lines"] > 80 * m["n_lines"], (m["n_lines"] >= 3) & (m["n_dup_lines"] == 0)),
        "repeats": vote(100 * m["n_repeat_words"] > 30 * n, 100 * m["n_repeat_words"] <= 10 * n),
        # Distinct words grow about as the square root of all words.
        "variety": vote(m["n_distinct"] * m["n_distinct"] < 4 * n, m["n_distinct"] * m["n_distinct"] >= 20 * n),
        "lengths": vote((m["word_chars"] < 2 * n) | (m["word_chars"] > 14 * n), (m["word_chars"] >= 3 * n) & (m["word_chars"] <= 10 * n)),
        "shouting": vote(100 * m["n_upper"] > 40 * m["word_chars"], 100 * m["n_upper"] <= 15 * m["word_chars"]),
        "endings": vote((m["n_lines"] >= 4) & (100 * m["n_ended"] <= 20 * m["n_lines"]), 100 * m["n_ended"] >= 60 * m["n_lines"]),
    }


def _each(n: int) -> Column:
    return F.array(*[F.lit(k) for k in range(n)])


def _sum(values: Column, f) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + f(x))


def estimate(
    patterns: Column,
    shares: Sequence[float] = START_SHARES,
    rates: Sequence[Sequence[float]] = START_RATES,
    iterations: int = ITERATIONS,
) -> Column:
    """EM over an array of (v: array<int>, n: long): (shares, rates) after the last step.

    ``shares[c]`` is the share of class c, ``rates[c][r]`` how often rule r
    votes good, where it votes, in class c. Every step is products and sums.
    """
    classes, rules = len(rates), len(rates[0])
    first_shares = F.array(*[F.lit(float(x)) for x in shares])
    first_rates = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in rates])

    def step(state: Column, _: Column) -> Column:
        weighed = F.transform(
            patterns,
            lambda p: F.struct(p["v"].alias("v"), p["n"].cast("double").alias("n"), posterior(p["v"], state, classes, rules).alias("q")),
        )

        def maximise(e: Column) -> Column:
            def rate(c: Column, r: Column) -> Column:
                agree = _sum(e, lambda x: F.when(x["v"][r] == 1, x["n"] * x["q"][c]).otherwise(0.0))
                spoke = _sum(e, lambda x: F.when(x["v"][r] != 0, x["n"] * x["q"][c]).otherwise(0.0))
                return (agree + SMOOTHING * first_rates[c][r]) / (spoke + SMOOTHING)

            held = lambda c: _sum(e, lambda x: x["n"] * x["q"][c]) + SMOOTHING * first_shares[c]
            return F.struct(
                F.transform(_each(classes), lambda c: held(c) / (_sum(e, lambda x: x["n"]) + SMOOTHING)).alias("shares"),
                F.transform(_each(classes), lambda c: F.transform(_each(rules), lambda r: rate(c, r))).alias("rates"),
            )

        return let(weighed, maximise)

    start = F.struct(first_shares.alias("shares"), first_rates.alias("rates"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, step)


def posterior(v: Column, state: Column, classes: int, rules: int) -> Column:
    """The probability of each class, given the votes."""

    def joint(c: Column) -> Column:
        chance = lambda r: F.when(v[r] == 1, state["rates"][c][r]).when(v[r] == -1, 1.0 - state["rates"][c][r]).otherwise(1.0)
        return F.aggregate(_each(rules), state["shares"][c], lambda p, r: p * chance(r))

    return let(F.transform(_each(classes), joint), lambda j: F.transform(j, lambda x: x / _sum(j, lambda y: y)))


def good_class(state: Column) -> Column:
    """The class whose rules vote good most often on average (the first of equals)."""
    means = F.transform(state["rates"], lambda row: _sum(row, lambda x: x))
    return let(means, lambda a: (F.array_position(a, F.array_max(a)) - 1).cast("int"))


def pattern_posteriors(voted: DataFrame, pattern: str) -> DataFrame:
    """One row (v, quality) per vote pattern that occurs: at most 3^rules rows."""
    tally = voted.groupBy(F.col(pattern).alias("v")).agg(F.count("*").alias("n"))
    one_row = tally.agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("patterns")).where(F.size("patterns") > 0)
    solved = one_row.select("patterns", estimate(F.col("patterns")).alias("state"))
    each = solved.select(F.explode("patterns").alias("p"), "state", good_class(F.col("state")).alias("good"))
    return each.select(F.col("p.v").alias("v"), posterior(F.col("p.v"), F.col("state"), len(START_RATES), len(RULES))[F.col("good")].alias("quality"))


def judged(docs: DataFrame, text: str = "text", store=None) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the columns counts, quality, base_failed and kept; the dict has their (unclashing) names.

    ``store`` may write the counted table so that the counts are made once;
    without it they are made in both passes and nothing is written.
    """
    counted, m = counts(docs, text)
    counted = store(counted) if store else counted
    v, q, failed, kept = private_names(counted, "q_votes", "quality", "base_failed", "kept")
    votes_of = votes(F.col(m))
    voted = counted.withColumn(v, F.array(*[votes_of[r] for r in RULES]))
    # At most 3^8 = 6,561 rows of about 100 bytes, whatever the input: a proven bound for the broadcast.
    quality = F.broadcast(pattern_posteriors(voted, v).withColumnsRenamed({"v": f"{v}_p", "quality": q}))
    out = voted.join(quality, F.col(v) == F.col(f"{v}_p"), "left").drop(f"{v}_p", v)
    out = out.withColumn(failed, base_failed(F.col(m)))
    out = out.withColumn(kept, ~F.col(failed) & (F.col(q) >= THRESHOLD))
    return out, {"counts": m, "quality": q, "base_failed": failed, "kept": kept}


def keep_good(docs: DataFrame, text: str = "text", store=lambda df: stored(df, "quality-counts")) -> DataFrame:
    """The documents that the rules keep, with their own columns; counted once, into the table that ``store`` writes."""
    out, names = judged(docs, text, store)
    return out.where(F.col(names["kept"])).select(*docs.columns)

"""The counting shortcuts equal plain left-to-right literal counts on arbitrary text.

Random strings over the characters of card tokens (so tokens, near-tokens and
overlaps occur often) are counted in Spark and by Python's ``str.count``
(non-overlapping, left to right: the same semantics as a regex findAll of a
plain word).
"""

from __future__ import annotations

import random

from tricklens.functions.hand import figures_of_suit, rank_counts, suit_counts
from tricklens.functions.tokens import count_tokens
from tricklens.model import FIGURE_RANKS, SUITS

PIECES = ["1", "2", "3", "4", "11", "14", "_", "of_", "of", "_of_", '"', ",", "[", "]"] + list(SUITS) + ["spade", "s"]


def random_texts(n: int, seed: int = 7) -> list[str]:
    rng = random.Random(seed)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return texts + ['["11_of_spades""12_of_spades","111_of_hearts","14_of_clubsspades"]', ""]


def test_hand_counts_equal_literal_counts(spark):
    texts = random_texts(3000)
    df = spark.createDataFrame([(i, t, rng_suit) for i, (t, rng_suit) in enumerate(zip(texts, list(SUITS) * 750 + ["x", "x"]))],
                               "id int, cards string, tarnib string")
    counts = {**rank_counts("cards"), **suit_counts("cards", "tarnib")}
    exprs = [f"{e} AS {k}" for k, e in counts.items()]
    staged = df.selectExpr("id", "cards", "tarnib", *exprs)
    rows = staged.selectExpr(
        "id", "cards", "tarnib", *[f"{figures_of_suit('figure_suits', s)} AS fig_{s}" for s in SUITS],
        *[f"n{r}" for r in FIGURE_RANKS], *[f"len_{s}" for s in SUITS], "trumps",
    ).collect()
    for row in rows:
        text = row.cards
        for rank in FIGURE_RANKS:
            assert row[f"n{rank}"] == text.count(rank), (text, rank)
        for suit in SUITS:
            assert row[f"len_{suit}"] == text.count(f"of_{suit}"), (text, suit)
            want = sum(text.count(f"{rank}_of_{suit}") for rank in FIGURE_RANKS)
            assert row[f"fig_{suit}"] == want, (text, suit)
        assert row.trumps == text.count(row.tarnib), (text, row.tarnib)


def test_alternation_count_equals_sum_of_counts(spark):
    texts = random_texts(2000, seed=11)
    groups = [["11_of_spades", "12_of_spades", "13_of_spades", "14_of_spades"], ["of_hearts", "of_clubs"], ["spades", "s"]]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.selectExpr("t", *[f"{count_tokens('t', g)} AS g{i}" for i, g in enumerate(groups)]).collect()
    for row in rows:
        for i, g in enumerate(groups):
            assert row[f"g{i}"] == sum(row.t.count(tok) for tok in g), (row.t, g)

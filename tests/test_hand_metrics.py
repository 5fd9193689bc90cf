"""The twelve hand features on the original unit-test hands, plus their edge cases."""

from __future__ import annotations

import pytest

from hands import V1, V2, V3, V4, bids
from tricklens.functions.hand import hand_metrics, trump_picker
from tricklens.functions.tokens import count_token, count_tokens
from tricklens.model import Rules


def metrics(spark, cards, tarnib="diamonds", bid=None, seat=1, partner=None, rules=Rules()):
    df = spark.createDataFrame(
        [(cards, tarnib, bid if bid is not None else bids(2), partner)],
        "cards string, tarnib string, bids string, partner string",
    )
    exprs = hand_metrics("cards", "tarnib", "bids", seat, "partner" if partner is not None else None, rules)
    return df.selectExpr(*[f"{e} AS {k}" for k, e in exprs.items()]).first().asDict()


def test_figures_count(spark):
    assert metrics(spark, V1)["figures_count"] == 5


def test_suits_over_five_cards(spark):
    assert metrics(spark, V2)["suits_over_five_cards"] == 1


def test_suits_with_over_one_figure(spark):
    assert metrics(spark, V3)["suits_with_over_one_figures"] == 3


def test_team_figures(spark):
    assert metrics(spark, V3, partner=V3)["team_figures_count"] == 16


def test_over_two_aces(spark):
    assert metrics(spark, V3)["over_two_aces_count"] == 1


def test_figure_score(spark):
    assert metrics(spark, V3)["figures_score"] == 24


def test_less_than_two_figures(spark):
    assert metrics(spark, V4)["rounds_with_less_than_two_figures"] == 1
    assert metrics(spark, V3)["rounds_with_less_than_two_figures"] == 0


def test_trump_figures(spark):
    assert metrics(spark, V3, tarnib="diamonds")["tarnib_figures_count"] == 3


@pytest.mark.parametrize(
    "tarnib,bidder,expected", [("diamonds", 2, 1), ("diamonds", 1, 0), ("spades", 2, 0)]
)
def test_over_three_of_partners_trump(spark, tarnib, bidder, expected):
    assert metrics(spark, V3, tarnib=tarnib, bid=bids(bidder), seat=1)["over_3_partner_tarnib_count"] == expected


@pytest.mark.parametrize(
    "tarnib,bidder,expected", [("diamonds", 2, 1), ("diamonds", 1, 0), ("spades", 2, 0)]
)
def test_over_three_of_enemies_trump(spark, tarnib, bidder, expected):
    # enemies {1, 3} are the enemies of seat 2
    assert metrics(spark, V3, tarnib=tarnib, bid=bids(bidder), seat=2)["over_3_enemy_tarnib_count"] == expected


@pytest.mark.parametrize("bidder,expected", [(2, 1), (1, 0)])
def test_partner_picked(spark, bidder, expected):
    assert metrics(spark, V3, bid=bids(bidder), seat=1)["has_partner_picked_tarnib_count"] == expected


@pytest.mark.parametrize("bidder,expected", [(2, 1), (1, 0)])
def test_enemy_picked(spark, bidder, expected):
    assert metrics(spark, V3, bid=bids(bidder), seat=2)["has_enemy_picked_tarnib_count"] == expected


# Values of all metrics on the four hands (FIXTURES.md section 2).
EXPECTED = {
    "V1": (V1, 5, 17, 0, 2, 1, 0, 1),
    "V2": (V2, 7, 22, 1, 3, 1, 0, 3),
    "V3": (V3, 8, 24, 1, 3, 1, 0, 3),
    "V4": (V4, 1, 2, 0, 0, 0, 1, 1),
}


@pytest.mark.parametrize("name", list(EXPECTED))
def test_fixture_table(spark, name):
    cards, fig, score, over5, over1fig, aces, under2, diamond_figs = EXPECTED[name]
    m = metrics(spark, cards, tarnib="diamonds")
    assert (
        m["figures_count"],
        m["figures_score"],
        m["suits_over_five_cards"],
        m["suits_with_over_one_figures"],
        m["over_two_aces_count"],
        m["rounds_with_less_than_two_figures"],
        m["tarnib_figures_count"],
    ) == (fig, score, over5, over1fig, aces, under2, diamond_figs)


def test_picker_is_positional(spark):
    texts = [bids(10), bids(-1), '{"current_bidder":2 }', "", "5", None, bids(3)]
    df = spark.createDataFrame([(t,) for t in texts], "b string")
    got = [r[0] for r in df.selectExpr(f"{trump_picker('b')} AS p").collect()]
    # 10 -> '0' -> seat 1; -1 -> '1' -> seat 2; space / empty / one char / null -> null
    assert got == [1, 2, None, None, None, None, 4]


def test_seat_four_partner_quirk(spark):
    # original topology tests seat 4 against seat 1 (bidder 0), not its partner seat 2 (bidder 1)
    assert metrics(spark, V3, bid=bids(0), seat=4)["has_partner_picked_tarnib_count"] == 1
    assert metrics(spark, V3, bid=bids(1), seat=4)["has_partner_picked_tarnib_count"] == 0
    corrected = Rules(topology="corrected")
    assert metrics(spark, V3, bid=bids(0), seat=4, rules=corrected)["has_partner_picked_tarnib_count"] == 0
    assert metrics(spark, V3, bid=bids(1), seat=4, rules=corrected)["has_partner_picked_tarnib_count"] == 1


def test_unreadable_bid_gives_null(spark):
    m = metrics(spark, V3, bid='{"current_bidder":2 }', seat=1)
    for k in (
        "has_partner_picked_tarnib_count",
        "has_enemy_picked_tarnib_count",
        "over_3_partner_tarnib_count",
        "over_3_enemy_tarnib_count",
    ):
        assert m[k] is None
    assert m["figures_count"] == 8


def test_null_hand_gives_null_metrics(spark):
    m = metrics(spark, None, bid=bids(1), seat=1)
    assert m["figures_count"] is None and m["suits_over_five_cards"] is None
    # condition false: the hand is never looked at
    assert m["over_3_partner_tarnib_count"] == 0
    m = metrics(spark, None, bid=bids(2), seat=1)
    assert m["over_3_partner_tarnib_count"] is None


def test_null_trump_counts_null_text(spark):
    # a missing trump is put into the card pattern as the word 'null'
    assert metrics(spark, V3, tarnib=None)["tarnib_figures_count"] == 0
    assert metrics(spark, '["11_of_null","12_of_null"]', tarnib=None)["tarnib_figures_count"] == 2
    assert metrics(spark, V3, tarnib=None, bid=bids(2), seat=1)["over_3_partner_tarnib_count"] is None


def test_empty_trump_matches_everywhere(spark):
    # an empty pattern matches at every position, so "more than 3 trumps" holds
    assert metrics(spark, V3, tarnib="", bid=bids(2), seat=1)["over_3_partner_tarnib_count"] == 1


def test_bare_suit_word_counts_as_trump(spark):
    cards = '["2_of_spades","3_of_spades","4_of_spades","spades"]'
    m = metrics(spark, cards, tarnib="spades", bid=bids(2), seat=1)
    assert m["over_3_partner_tarnib_count"] == 1  # 4 "spades"
    assert m["suits_over_five_cards"] == 0  # 3 "of_spades"


def test_strict_thresholds(spark):
    five = '["2_of_clubs","3_of_clubs","4_of_clubs","5_of_clubs","6_of_clubs"]'
    six = five[:-1] + ',"7_of_clubs"]'
    assert metrics(spark, five)["suits_over_five_cards"] == 0
    assert metrics(spark, six)["suits_over_five_cards"] == 1
    two_aces = '["14_of_clubs","14_of_spades"]'
    assert metrics(spark, two_aces)["over_two_aces_count"] == 0
    assert metrics(spark, two_aces)["rounds_with_less_than_two_figures"] == 0
    assert metrics(spark, '["14_of_clubs"]')["rounds_with_less_than_two_figures"] == 1


def test_token_counts_match_python(spark):
    texts = ["aaaa", "abab", "11111", "", None, "x_of_spades of_spades", "thethe The", "éthe€the√x", "ü11ü111"]
    tokens = ["aa", "ab", "11", "of_spades", "the", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    exprs = [f"{count_token('t', tok)} AS c{i}" for i, tok in enumerate(tokens)]
    exprs.append(f"{count_tokens('t', ['the', 'The'])} AS n_both")
    rows = df.selectExpr(*exprs).collect()
    for text, row in zip(texts, rows):
        for i, tok in enumerate(tokens):
            assert row[f"c{i}"] == (None if text is None else text.count(tok))
        assert row["n_both"] == (None if text is None else text.count("the") + text.count("The"))


def test_overlapping_tokens_fall_back_to_sums():
    # 'aa' overlaps itself and 'ab' shares characters with 'ba': no single regex pass
    assert "regexp_count" not in count_tokens("t", ["ab", "ba"])
    assert "regexp_count" in count_tokens("t", [f"1{r}_of_spades" for r in "1234"])


def test_trump_text_is_matched_literally(spark):
    # a trump text with regex metacharacters is a literal word here (documented difference)
    cards = '["2_of_spades","3_of_spades","4_of_spades","5_of_spades"]'
    assert metrics(spark, cards, tarnib="sp.des", bid=bids(2), seat=1)["over_3_partner_tarnib_count"] == 0
    assert metrics(spark, cards + "sp.des" * 4, tarnib="sp.des", bid=bids(2), seat=1)["over_3_partner_tarnib_count"] == 1


def test_strict_mode_fails_where_the_original_throws(spark):
    strict = Rules(strict=True)
    assert metrics(spark, V3, bid=bids(2), rules=strict)["figures_count"] == 8
    for cards, bid in [(None, bids(2)), (V3, '{"current_bidder":2 }')]:
        with pytest.raises(Exception, match="kept round"):
            metrics(spark, cards, bid=bid, rules=strict)
    # seat 1 picked itself: neither the partner nor the enemy condition holds, so a missing trump is never looked at
    m = metrics(spark, V3, tarnib=None, bid=bids(0), seat=1, rules=strict)
    assert m["over_3_partner_tarnib_count"] == 0 and m["over_3_enemy_tarnib_count"] == 0
    # an enemy (seat 2) picked: the enemy test needs the trump count
    with pytest.raises(Exception, match="kept round"):
        metrics(spark, V3, tarnib=None, bid=bids(1), seat=1, rules=strict)

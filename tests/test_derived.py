"""The rounds derived from ``orders``: legal deals, thousands of them, and the awkward records among them."""

from __future__ import annotations

import json

from tricklens.plans.queries import rounds
from tricklens.sources.derived import QUIRKS

SF = "/root/testdata/sf0.001"


def hit(name, key):
    modulus, remainder = QUIRKS[name]
    return key % modulus == remainder


def test_every_plain_round_is_a_full_deal(spark):
    plain = 0
    for r in rounds(spark, SF).collect():
        if not any(hit(n, r.round_id) for n in ("missing_comma", "ten_cards", "fourteen_cards", "null_hand")):
            hands = [json.loads(r[f"player_{s}_cards"]) for s in range(1, 5)]
            assert [len(h) for h in hands] == [13] * 4 and len({c for h in hands for c in h}) == 52
            plain += 1
    assert plain > 1000


def test_deals_depend_on_the_whole_key(spark):
    r = rounds(spark, SF)
    assert r.select("player_1_cards", "player_2_cards", "player_3_cards", "player_4_cards").distinct().count() > 0.95 * min(r.count(), 2704)


def test_awkward_records(spark):
    rows = {row.round_id: row for row in rounds(spark, SF).collect()}
    first = lambda name: next(rows[k] for k in sorted(rows) if k and hit(name, k))
    broken = next(rows[k] for k in sorted(rows) if hit("missing_comma", k) and '_of_hearts""' in rows[k].player_1_cards)
    assert broken.player_1_cards.count("_of_") == 13
    assert first("ten_cards").player_2_cards.count("_of_") == 10
    assert first("fourteen_cards").player_3_cards.count("_of_") == 14
    assert first("null_hand").player_4_cards is None
    assert first("null_trump").tarnib is None and first("other_trump").tarnib == "notrump"
    assert next(rows[k] for k in sorted(rows) if hit("empty_trump", k) and not hit("null_trump", k)).tarnib == ""
    assert ":10" in first("bidder_ten").bids_data and ":-1" in first("bidder_minus_one").bids_data
    assert first("space_before_brace").bids_data.endswith(" }") and first("null_bid").bids_data is None
    assert first("float_score").team_1_score.endswith(".0") and first("unreadable_score").team_1_score == "n/a"
    assert any(r.player_4 and r.player_4.lower() == "n" and "north" in [str(r[f"player_{s}"]).lower() for s in (1, 2, 3)] for r in rows.values())

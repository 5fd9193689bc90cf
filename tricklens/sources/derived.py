"""Card rounds derived from the ``orders`` table, for tests and benchmarks.

The driver's tables hold no card rounds, so rounds are derived row by row
from ``o_orderkey`` with integer arithmetic that any SQL engine evaluates the
same way (the DuckDB oracle repeats it). With ``r = o_orderkey``, the card in
seat ``h`` (0..3), slot ``s`` (0..12) is

    p = (((1 + r % 52) * (13h + s + 1)) % 53 - 1 + r div 52) % 52
    rank = 2 + p % 13, suit = SUITS[p div 13]

(53 is prime, so the 52 products are distinct): 2,704 different deals. Some
keys get the awkward records that decide correctness (``QUIRKS``): a person
in two seats, hands that are no JSON or hold 10 or 14 cards, null hands,
null, empty or other trumps, bidders 10 and -1, unreadable bids, scores as
text. The derivation is a narrow projection: no shuffle, so it scales with
the orders table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tricklens.model import SUITS

# Fixed values of the derivation (the oracle SQL uses the same).
NAMES = ("north", "east", "south", "west")
BIDS_PREFIX = '{"bids":[-1,7,-1,-1],"current_bidder":'
# Which keys get which awkward record: modulus and remainder of the key.
QUIRKS = {
    "second_seat": (19, 0),  # seat 4 plays under the alias of a person who may sit elsewhere too
    "missing_comma": (23, 0),  # seat 1: after every card of hearts
    "ten_cards": (29, 0),  # seat 2
    "fourteen_cards": (31, 0),  # seat 3
    "null_hand": (37, 0),  # seat 4
    "null_trump": (41, 0),
    "empty_trump": (43, 0),
    "other_trump": (47, 0),
    "bidder_ten": (13, 0),
    "bidder_minus_one": (11, 5),
    "space_before_brace": (15, 7),
    "null_bid": (59, 0),
    "float_score": (6, 1),
    "unreadable_score": (25, 24),
}


def quirk(name: str, key: str) -> str:
    modulus, remainder = QUIRKS[name]
    return f"{key} % {modulus} = {remainder}"


def _suit_expr(index_sql: str) -> str:
    suits = ", ".join(f"'{s}'" for s in SUITS)
    return f"element_at(array({suits}), CAST({index_sql} AS INT) + 1)"


# Card text of deck position p (0..51): rank 2 + p % 13 of suit SUITS[p div 13].
DECK = tuple(f"{2 + p % 13}_of_{SUITS[p // 13]}" for p in range(52))
_DECK_SQL = "array(" + ", ".join(f"'{c}'" for c in DECK) + ")"


def _position_sql(key: str, seat: int, slot: int) -> str:
    k = 13 * seat + slot + 1
    return f"CAST((((1 + {key} % 52) * {k}) % 53 - 1 + {key} div 52) % 52 AS INT)"


def hand_sql(key: str, seat: int) -> str:
    """The hand of one seat: 13 deck positions looked up in ``DECK``, joined as a JSON list text.

    The lookup is a lambda, which keeps the projection out of fused code: Spark
    then compiles it in methods that are small enough for the JIT.
    """
    cards = f"transform(array({', '.join(_position_sql(key, seat, s) for s in range(13))}), p -> {_DECK_SQL}[p])"
    if seat == 1:
        cards = f"slice({cards}, 1, CASE WHEN {quirk('ten_cards', key)} THEN 10 ELSE 13 END)"
    hand = f"concat('[\"', array_join({cards}, '\",\"'), '\"]')"
    if seat == 0:
        return f"CASE WHEN {quirk('missing_comma', key)} THEN replace({hand}, '_of_hearts\",', '_of_hearts\"') ELSE {hand} END"
    if seat == 2:
        return f"CASE WHEN {quirk('fourteen_cards', key)} THEN replace({hand}, ']', ',\"14_of_spades\"]') ELSE {hand} END"
    if seat == 3:
        return f"CASE WHEN NOT ({quirk('null_hand', key)}) THEN {hand} END"
    return hand


def player_sql(key: str, seat: int) -> str:
    names = ", ".join(f"'{n}'" for n in (*NAMES, *map(str.upper, NAMES)))
    upper = f"CASE WHEN {key} % 3 = 0 THEN {len(NAMES)} ELSE 0 END"
    null_first = f"WHEN {key} % 101 = 0 THEN NULL " if seat == 2 else ""
    second = f"WHEN {quirk('second_seat', key)} THEN CASE WHEN {key} % 3 = 0 THEN 'N' ELSE 'n' END " if seat == 3 else ""
    return (
        f"CASE {null_first}WHEN {key} % 17 = 0 AND {key} % 4 = {seat} THEN 'guest' {second}"
        f"ELSE element_at(array({names}), CAST(({key} + {seat}) % 4 + {upper} AS INT) + 1) END"
    )


def round_exprs(key: str = "o_orderkey") -> list[str]:
    """The round record of one order key, as SQL expressions."""
    exprs = [
        f"{key} AS round_id",
        f"CASE WHEN {quirk('unreadable_score', key)} THEN 'n/a' ELSE concat(CAST({key} % 14 AS STRING), "
        f"CASE WHEN {quirk('float_score', key)} THEN '.0' ELSE '' END) END AS team_1_score",
        f"CAST(13 - {key} % 14 - CASE WHEN {key} % 10 = 0 THEN 1 ELSE 0 END AS STRING) AS team_2_score",
    ]
    exprs += [f"{player_sql(key, h)} AS player_{h + 1}" for h in range(4)]
    exprs += [f"{hand_sql(key, h)} AS player_{h + 1}_cards" for h in range(4)]
    exprs += [
        f"CASE WHEN {quirk('null_trump', key)} THEN NULL WHEN {quirk('empty_trump', key)} THEN '' "
        f"WHEN {quirk('other_trump', key)} THEN 'notrump' ELSE {_suit_expr(f'({key} div 4) % 4')} END AS tarnib",
        f"CASE WHEN NOT ({quirk('null_bid', key)}) THEN concat('{BIDS_PREFIX}', CASE WHEN {quirk('bidder_ten', key)} THEN '10' "
        f"WHEN {quirk('bidder_minus_one', key)} THEN '-1' ELSE CAST(({key} div 5) % 4 AS STRING) END, "
        f"CASE WHEN {quirk('space_before_brace', key)} THEN ' }}' ELSE '}}' END) END AS bids_data",
    ]
    return exprs


def derive_rounds(orders: DataFrame, key: str = "o_orderkey") -> DataFrame:
    """One round per order: ``round_id`` plus the twelve round columns."""
    return orders.selectExpr(*round_exprs(key))

"""Test hands: the four distinct hands of the original unit tests, rebuilt from rank lists.

Each hand is the text of a list of quoted card tokens. ``glued`` names the
card after which the comma is missing (the original test strings are not
valid JSON there), which the counting must not care about.
"""

from __future__ import annotations


def hand(cards: list[str], glued: str | None = None) -> str:
    parts = []
    for i, card in enumerate(cards):
        parts.append(f'"{card}"')
        if i < len(cards) - 1:
            parts.append("" if card == glued else ",")
    return "[" + "".join(parts) + "]"


def suits(spades=(), hearts=(), diamonds=(), clubs=()) -> list[str]:
    out = []
    for suit, ranks in (("hearts", hearts), ("spades", spades), ("diamonds", diamonds), ("clubs", clubs)):
        out += [f"{r}_of_{suit}" for r in ranks]
    return out


V1 = hand(suits(spades=(14, 13, 7, 2), hearts=(10, 2), diamonds=(14, 10, 8, 3), clubs=(14, 12, 8)))
V2 = hand(
    suits(spades=(14, 13), hearts=(10, 2), diamonds=(14, 13, 12, 10, 8, 3), clubs=(14, 12, 8)),
    glued="13_of_diamonds",
)
V3 = hand(
    suits(spades=(14, 13, 12), hearts=(10, 2), diamonds=(14, 13, 12, 10, 8, 3), clubs=(14, 12, 8)),
    glued="13_of_diamonds",
)
V4 = hand(suits(spades=(10,), hearts=(10, 2), diamonds=(12, 10, 8, 3), clubs=(10, 10, 8)), glued="10_of_spades")


def bids(current_bidder: int | str) -> str:
    return '{"bids":[-1,7,-1,-1],"current_bidder":' + str(current_bidder) + "}"

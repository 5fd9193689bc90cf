"""Data model of a four-seat, trump-suit card round and the parameters of the summary.

Everything here is plain Python data; the Spark work lives in ``functions``,
``operators`` and ``plans``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. They must equal the original job's for equal results.
# ---------------------------------------------------------------------------
# Suit words as they appear in card tokens "<rank>_of_<suit>".
SUITS = ("spades", "hearts", "clubs", "diamonds")
# Figure ranks: 11 = jack, 12 = queen, 13 = king, 14 = ace (the ace is a figure).
FIGURE_RANKS = ("11", "12", "13", "14")
# Figure score weights: jack 1, queen 2, king 3, ace 4.
FIGURE_WEIGHTS = {"11": 1, "12": 2, "13": 3, "14": 4}
ACE_RANK = "14"
# A round is complete when the two team scores (tricks) add up to this.
TRICKS_PER_ROUND = 13
# Strict thresholds: more than 5 cards of a suit, more than 1 figure in a suit,
# more than 2 aces, more than 3 trumps held, fewer than 2 figures.
SUIT_LENGTH_OVER = 5
SUIT_FIGURES_OVER = 1
ACES_OVER = 2
TRUMPS_OVER = 3
FIGURES_UNDER = 2
# Seats 1..4; teams are seats {1, 3} and {2, 4}.
SEATS = (1, 2, 3, 4)
# Partner whose hand is added for the team figure count.
HAND_PARTNER = {1: 3, 2: 4, 3: 1, 4: 2}
# Seat whose trump pick counts as "partner picked", as the original job tests it:
# seat 4 is tested against seat 1, not its partner 2.
PICK_PARTNER_ORIGINAL = {1: 3, 2: 4, 3: 1, 4: 1}
PICK_PARTNER_CORRECTED = {1: 3, 2: 4, 3: 1, 4: 2}
# Per-person metrics, in the column-group order of the summary.
METRICS = (
    "figures_count",
    "figures_score",
    "tarnib_figures_count",
    "over_3_enemy_tarnib_count",
    "has_enemy_picked_tarnib_count",
    "over_3_partner_tarnib_count",
    "has_partner_picked_tarnib_count",
    "team_figures_count",
    "rounds_with_less_than_two_figures",
    "over_two_aces_count",
    "suits_over_five_cards",
    "suits_with_over_one_figures",
)
TOTAL_ROUNDS = "total_rounds_played"
# ---------------------------------------------------------------------------

# Input columns of a round record. Scores are read as text and cast with
# try_cast, so "7", 7 and 7.0 all work; hands and bids are text and are
# searched as text, never parsed.
ROUND_COLUMNS = (
    "team_1_score",
    "team_2_score",
    "player_1",
    "player_2",
    "player_3",
    "player_4",
    "player_1_cards",
    "player_2_cards",
    "player_3_cards",
    "player_4_cards",
    "tarnib",
    "bids_data",
)

ROUNDS_SCHEMA = T.StructType(
    [T.StructField("round_id", T.LongType(), True)]
    + [T.StructField(c, T.StringType(), True) for c in ROUND_COLUMNS]
)


def player_col(seat: int) -> str:
    return f"player_{seat}"


def cards_col(seat: int) -> str:
    return f"player_{seat}_cards"


@dataclass(frozen=True)
class Roster:
    """People to report on, each with the lower-case aliases they play under.

    A seat belongs to a person when ``lower(player_N)`` equals one of the
    person's aliases. An alias may belong to one person only.
    """

    people: tuple[tuple[str, tuple[str, ...]], ...]

    def __post_init__(self) -> None:
        seen: dict[str, str] = {}
        names = [p for p, _ in self.people]
        if len(set(names)) != len(names):
            raise ValueError(f"duplicate person in roster: {names}")
        for person, aliases in self.people:
            if not aliases:
                raise ValueError(f"person {person!r} has no alias")
            for alias in aliases:
                if alias in seen and seen[alias] != person:
                    raise ValueError(f"alias {alias!r} is listed for {seen[alias]!r} and {person!r}")
                seen[alias] = person

    @classmethod
    def of(cls, mapping: Mapping[str, Iterable[str] | str]) -> Roster:
        people = []
        for person, aliases in mapping.items():
            alias_list = (aliases,) if isinstance(aliases, str) else tuple(aliases)
            people.append((person, alias_list))
        return cls(tuple(people))

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(p for p, _ in self.people)

    @property
    def aliases(self) -> tuple[str, ...]:
        return tuple(a for _, aliases in self.people for a in aliases)

    @property
    def alias_to_person(self) -> dict[str, str]:
        return {a: p for p, aliases in self.people for a in aliases}


@dataclass(frozen=True)
class Rules:
    """Thresholds, weights and seat topology; defaults reproduce the original job."""

    tricks_per_round: int = TRICKS_PER_ROUND
    figure_weights: Mapping[str, int] = field(default_factory=lambda: dict(FIGURE_WEIGHTS))
    suit_length_over: int = SUIT_LENGTH_OVER
    suit_figures_over: int = SUIT_FIGURES_OVER
    aces_over: int = ACES_OVER
    trumps_over: int = TRUMPS_OVER
    figures_under: int = FIGURES_UNDER
    topology: str = "original"  # "original" (seat 4 tested against seat 1) or "corrected"
    # strict: a missing hand, an unreadable bid or a missing trump that a
    # metric needs fails the job (as the original does) instead of giving null.
    strict: bool = False

    @property
    def pick_partner(self) -> dict[int, int]:
        if self.topology == "original":
            return dict(PICK_PARTNER_ORIGINAL)
        if self.topology == "corrected":
            return dict(PICK_PARTNER_CORRECTED)
        raise ValueError(f"unknown topology {self.topology!r}")


def summary_columns(roster: Roster, column_order: Sequence[str] | None = None) -> list[str]:
    """The one-row summary's columns: the round count, then each metric for every person.

    ``column_order`` must be a permutation of them.
    """
    columns = [TOTAL_ROUNDS] + [f"{person}_{metric}" for metric in METRICS for person in roster.names]
    if column_order is None:
        return columns
    if sorted(column_order) != sorted(columns):
        wrong = sorted(set(column_order) ^ set(columns)) or "repeated columns"
        raise ValueError(f"column_order must name each of the {len(columns)} summary columns once: {wrong}")
    return list(column_order)


# Roster of the derived test rounds (see sources.derived); one person has a
# second alias that the derived data never uses, to exercise alias lists.
COMPASS_ROSTER = Roster.of(
    {"north": ("north", "n"), "east": ("east",), "south": ("south",), "west": ("west",)}
)

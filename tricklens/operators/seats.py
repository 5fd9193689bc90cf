"""Round (wide, one column group per seat) -> seat table (long, one row per seat).

Three narrow projections, no shuffle:

1. per round: trump picker, the person of each seat, and the figure-rank
   counts of all four hands (needed across seats for the team count);
2. ``inline`` into four seat rows, each carrying its hand text, its rank
   counts and its partner's figure count (no second scan of the partner's hand);
3. per seat row: suit counts and trumps, then the features.

Each hand is scanned once per token class. Catalyst cannot prune fields of
the structs built for ``inline``, so the table is built for the requested
metrics only: a metric of the bid alone never touches the hands.

No generated method comes near the JIT's limit of 8,000 bytes (a longer one is
only ever interpreted, which halved the speed): persons are resolved and figures
per suit counted in lambdas, which ends the fused code there, and rank counts travel as one array a hand.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tricklens.functions.hand import figures, metric_errors, rank_counts, seat_metrics, suit_counts, trump_picker
from tricklens.model import FIGURE_RANKS, HAND_PARTNER, METRICS, SEATS, SUITS, Roster, Rules, cards_col, player_col
from tricklens.operators.attribution import is_first_seat, person_of


def ranks_in(array: str) -> dict[str, str]:
    """The figure-rank counts (``n11`` ..) held in an array column."""
    return {f"n{r}": f"{array}[{k}]" for k, r in enumerate(FIGURE_RANKS)}


# Base inputs of each metric: rank counts of the own hand, the partner's
# figures, the figure suits, the suit lengths, trumps held, the picker.
METRIC_INPUTS = {
    "figures_count": {"ranks"},
    "figures_score": {"ranks"},
    "tarnib_figures_count": {"figure_suits", "trump_figures_other"},
    "team_figures_count": {"ranks", "partner_figures"},
    "rounds_with_less_than_two_figures": {"ranks"},
    "over_two_aces_count": {"ranks"},
    "suits_over_five_cards": {"lengths"},
    "suits_with_over_one_figures": {"figure_suits"},
    "has_partner_picked_tarnib_count": {"picker"},
    "has_enemy_picked_tarnib_count": {"picker"},
    "over_3_partner_tarnib_count": {"picker", "trumps"},
    "over_3_enemy_tarnib_count": {"picker", "trumps"},
}
_SUIT_INPUTS = {
    "figure_suits": ["figure_suits"],
    "lengths": [f"len_{s}" for s in SUITS],
    "trumps": ["trumps"],
    "trump_figures_other": ["trump_figures_other"],
}


def seat_table(
    rounds: DataFrame,
    roster: Roster | None,
    rules: Rules = Rules(),
    metrics: Sequence[str] = METRICS,
    errors: bool = False,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Long seat table: ``round_id, seat, player, person, is_first_seat`` and the requested metrics.

    ``person`` is the roster person of the seat's player (null if none, or
    when no roster is given); without a roster, columns ``_person_1`` ..
    ``_person_4`` of ``rounds`` are used when present (``roster_join``).
    ``is_first_seat`` is true on the lowest seat a person holds in the round.
    With ``errors``, a column of that name lists the metrics that the seat's
    record does not tell, with the reason, as data. ``carry`` names further
    columns of ``rounds`` to keep in every seat row.
    """
    need = set().union(*(METRIC_INPUTS[m] for m in metrics))
    if errors:  # a missing hand shows in its rank counts, a missing trump in the trumps held
        need |= {"ranks", "partner_figures", "trumps"}
    with_ranks = bool(need & {"ranks", "partner_figures"})
    suit_inputs = [c for key, cols in _SUIT_INPUTS.items() if key in need for c in cols]

    round_id = "round_id" if "round_id" in rounds.columns else "CAST(NULL AS BIGINT)"
    persons = [f"_person_{s}" for s in SEATS]
    # persons resolved upstream (operators.roster_join) when no roster object is given
    resolved = roster is None and all(p in rounds.columns for p in persons)
    per_round = [f"{round_id} AS round_id", *carry, "tarnib", f"{trump_picker('bids_data')} AS _picker"]
    if resolved:
        per_round.append(f"array({', '.join(persons)}) AS _persons")
    elif roster:
        # One rule for all seats: the code does not grow with the roster times the seats.
        players = ", ".join(player_col(seat) for seat in SEATS)
        per_round.append(f"transform(array({players}), p -> {person_of('p', roster)}) AS _persons")
    else:
        per_round.append("CAST(NULL AS ARRAY<STRING>) AS _persons")
    for seat in SEATS:
        per_round.append(f"{player_col(seat)} AS _player_{seat}")
        if suit_inputs:
            per_round.append(f"{cards_col(seat)} AS _cards_{seat}")
        if with_ranks:
            per_round.append(f"array({', '.join(rank_counts(cards_col(seat)).values())}) AS _ranks_{seat}")
    wide = rounds.selectExpr(*per_round)

    structs = []
    for seat in SEATS:
        partner = HAND_PARTNER[seat]
        fields = [
            f"'seat', {seat}",
            f"'player', _player_{seat}",
            f"'person', _persons[{seat - 1}]",
            f"'is_first_seat', {is_first_seat('_persons', seat)}",
        ]
        if suit_inputs:
            fields.append(f"'cards', _cards_{seat}")
        if with_ranks:
            fields += [f"'ranks', _ranks_{seat}", f"'partner_ranks', _ranks_{partner}"]
        structs.append(f"named_struct({', '.join(fields)})")
    seats = wide.selectExpr("round_id", *carry, "tarnib", "_picker", f"inline(array({', '.join(structs)}))")

    carried = ["round_id", *carry, "seat", "player", "person", "is_first_seat", "tarnib", "_picker"]
    if with_ranks:
        carried += ["ranks", "partner_ranks"]
    counts = suit_counts("cards", "tarnib")
    counted = seats.selectExpr(*carried, *[f"{counts[name]} AS {name}" for name in suit_inputs])
    counted_as = {name: name for name in counts} | ranks_in("ranks")
    exprs = seat_metrics("seat", "_picker", "tarnib", figures(ranks_in("partner_ranks")), rules, counted_as)
    told = [metric_errors("seat", "_picker", figures(ranks_in("partner_ranks")), rules, counted_as, metrics) + " AS errors"] if errors else []
    return counted.selectExpr(
        "round_id",
        *carry,
        "seat",
        "player",
        "person",
        "is_first_seat",
        *[f"CAST({exprs[m]} AS BIGINT) AS {m}" for m in metrics],
        *told,
    )


def first_seat_only(seats: DataFrame) -> DataFrame:
    """Keep each person's lowest seat in a round (a person in two seats counts once)."""
    return seats.filter("is_first_seat")


def round_errors(seats: DataFrame) -> DataFrame:
    """(round_id, seat, person, metric, reason) of the metrics that counted seats could not tell (``seat_table(errors=True)``)."""
    return first_seat_only(seats).selectExpr("round_id", "seat", "person", "inline(errors)")

"""Hand and bidding features of one seat, as Spark SQL expressions.

A hand is the text of a list of card tokens ``"<rank>_of_<suit>"``; it is
searched as text (it need not be valid JSON, may hold duplicates or any
number of cards). Features are built in two steps so that each token class
is counted once per hand:

* ``rank_counts`` / ``suit_counts``: base counts of one hand;
* ``seat_metrics``: the twelve features, as arithmetic over those counts.

The expressions take the seat as an SQL expression too, so one projection
serves all four seats of the long seat table.
"""

from __future__ import annotations

from collections.abc import Sequence

from tricklens.functions.tokens import (
    alternation,
    count_token,
    count_token_expr,
    digit_from_end,
    flag,
    groups_over,
    in_list,
)
from tricklens.model import ACE_RANK, FIGURE_RANKS, METRICS, SEATS, SUITS, Rules


def trump_picker(bids: str) -> str:
    """1-based seat that picked the trump suit.

    The bid text ends with ``"current_bidder":<d>}``; the 0-based digit is the
    second character from the end. Null when that character is not a digit.
    """
    return f"({digit_from_end(bids, 2)} + 1)"


def pattern_suit(tarnib: str) -> str:
    """Trump text as put into a card pattern; a missing trump reads as 'null'."""
    return f"coalesce({tarnib}, 'null')"


def rank_counts(cards: str) -> dict[str, str]:
    """Occurrences of each figure rank (``n11`` .. ``n14``) in a hand."""
    return {f"n{rank}": count_token(cards, rank) for rank in FIGURE_RANKS}


def figure_suits(cards: str) -> str:
    """Suit word of every figure token ``1[1-4]_of_<suit>`` in the hand, in order (array).

    One regular-expression pass finds exactly the occurrences that sixteen
    literal counts would: the sixteen tokens are plain words and no two
    occurrences can share a character, so a left-to-right scan for their
    alternation misses none and counts none twice.
    """
    ranks = alternation(list(FIGURE_RANKS))
    return f"regexp_extract_all({cards}, '(?:{ranks})_of_({'|'.join(SUITS)})', 1)"


def figures_of_suit(figure_suits_col: str, suit: str) -> str:
    """Figures of one suit from the ``figure_suits`` array (null when the hand is null)."""
    return f"array_size(filter({figure_suits_col}, s -> s = '{suit}'))"


def suit_counts(cards: str, tarnib: str) -> dict[str, str]:
    """Figure suits (``figure_suits``), cards per suit (``len_<suit>``), trumps held, odd-trump figures."""
    counts: dict[str, str] = {"figure_suits": figure_suits(cards)}
    for suit in SUITS:
        counts[f"len_{suit}"] = count_token(cards, f"of_{suit}")
    counts["trumps"] = count_token_expr(cards, tarnib)
    suit = pattern_suit(tarnib)
    # Trump figures come from the per-suit counts when the trump is a suit
    # word; any other trump text is counted directly (rare path).
    other = " + ".join(_count_nonempty(cards, f"concat('{rank}_of_', {suit})") for rank in FIGURE_RANKS)
    counts["trump_figures_other"] = f"(CASE WHEN NOT {in_list(suit, SUITS)} THEN {other} END)"
    return counts


def _count_nonempty(text: str, token: str) -> str:
    """``count_token_expr`` for a token expression that is never empty."""
    return f"((octet_length({text}) - octet_length(replace({text}, {token}, ''))) div octet_length({token}))"


def figures(n: dict[str, str] | None = None, prefix: str = "") -> str:
    """Figure count from rank counts (by name ``<prefix>n11`` .. or given expressions)."""
    if n is None:
        n = {f"n{r}": f"{prefix}n{r}" for r in FIGURE_RANKS}
    return "(" + " + ".join(n[f"n{r}"] for r in FIGURE_RANKS) + ")"


def _seat_lookup(seat: str, values: dict[int, int]) -> str:
    """Per-seat constant: a literal when the seat is known, else an array lookup by seat."""
    if seat.isdigit():
        return str(values[int(seat)])
    return f"element_at(array({', '.join(str(values[s]) for s in SEATS)}), {seat})"


def _base_counts() -> dict[str, str]:
    """The base counts as columns of their own names."""
    names = [f"n{r}" for r in FIGURE_RANKS] + [f"len_{s}" for s in SUITS]
    return {k: k for k in names + ["figure_suits", "trumps", "trump_figures_other"]}


def _enemy_picked(seat: str, picker: str) -> str:
    """The picker sits on the other team: seats 1..4 of the other parity."""
    return f"({picker} BETWEEN 1 AND 4 AND {picker} % 2 != {seat} % 2)"


def seat_metrics(
    seat: str,
    picker: str,
    tarnib: str,
    partner_figures: str,
    rules: Rules = Rules(),
    c: dict[str, str] | None = None,
) -> dict[str, str]:
    """The twelve per-seat features over base counts ``c`` (default: columns named as the counts)."""
    c = _base_counts() if c is None else c
    c = {**c, **{f"fig_{s}": figures_of_suit(c["figure_suits"], s) for s in SUITS}}
    fig = figures(c)
    suit = pattern_suit(tarnib)
    trump_figures = (
        f"(CASE {suit} " + " ".join(f"WHEN '{s}' THEN {c[f'fig_{s}']}" for s in SUITS)
        + f" ELSE {c['trump_figures_other']} END)"
    )
    partner_picked = f"({picker} = {_seat_lookup(seat, rules.pick_partner)})"
    enemy_picked = _enemy_picked(seat, picker)
    many_trumps = f"({c['trumps']} > {rules.trumps_over})"
    score = " + ".join(f"{c[f'n{r}']} * {w}" for r, w in rules.figure_weights.items())
    metrics = {
        "figures_count": fig,
        "figures_score": f"({score})",
        "tarnib_figures_count": trump_figures,
        "team_figures_count": f"({fig} + {partner_figures})",
        "rounds_with_less_than_two_figures": flag(f"{fig} < {rules.figures_under}"),
        "over_two_aces_count": flag(f"{c[f'n{ACE_RANK}']} > {rules.aces_over}"),
        "suits_over_five_cards": groups_over([c[f"len_{s}"] for s in SUITS], rules.suit_length_over),
        "suits_with_over_one_figures": groups_over([c[f"fig_{s}"] for s in SUITS], rules.suit_figures_over),
        "has_partner_picked_tarnib_count": flag(partner_picked),
        "has_enemy_picked_tarnib_count": flag(enemy_picked),
        # The trump count is only looked at when the condition holds; an
        # unreadable bid gives null rather than false.
        "over_3_partner_tarnib_count": flag(
            f"CASE WHEN {picker} IS NULL THEN NULL WHEN {partner_picked} THEN {many_trumps} ELSE FALSE END"
        ),
        "over_3_enemy_tarnib_count": flag(
            f"CASE WHEN {picker} IS NULL THEN NULL WHEN {enemy_picked} THEN {many_trumps} ELSE FALSE END"
        ),
    }
    if rules.strict:
        metrics = _strict(metrics, metric_checks(c, picker, partner_figures, partner_picked, enemy_picked))
    return metrics


def metric_checks(
    c: dict[str, str], picker: str, partner_figures: str, partner_picked: str, enemy_picked: str
) -> dict[str, list[tuple[str, str]]]:
    """Per metric, the conditions under which the original job throws, each with its reason; the first that holds counts."""
    hand = (f"{c['n11']} IS NULL", "missing hand")
    bid = (f"{picker} IS NULL", "unreadable bid")
    trumps = f"{c['trumps']} IS NULL"
    other = {
        "team_figures_count": [hand, (f"{partner_figures} IS NULL", "missing partner hand")],
        "has_partner_picked_tarnib_count": [bid],
        "has_enemy_picked_tarnib_count": [bid],
        "over_3_partner_tarnib_count": [bid, (f"{partner_picked} AND {trumps}", "missing hand or trump")],
        "over_3_enemy_tarnib_count": [bid, (f"{enemy_picked} AND {trumps}", "missing hand or trump")],
    }
    return {metric: other.get(metric, [hand]) for metric in METRICS}


def _strict(metrics: dict[str, str], checks: dict[str, list[tuple[str, str]]]) -> dict[str, str]:
    """Fail with an error where the original job throws, instead of returning null."""
    out = {}
    for name, expr in metrics.items():
        branches = " ".join(f"WHEN {cond} THEN raise_error('{msg} in a kept round')" for cond, msg in checks[name])
        out[name] = f"(CASE {branches} ELSE {expr} END)"
    return out


def metric_errors(
    seat: str, picker: str, partner_figures: str, rules: Rules = Rules(), c: dict[str, str] | None = None, metrics: Sequence[str] = METRICS
) -> str:
    """The metrics of a seat that cannot be read, as an array of (metric, reason); empty where all can."""
    c = _base_counts() if c is None else c
    picked = (f"({picker} = {_seat_lookup(seat, rules.pick_partner)})", _enemy_picked(seat, picker))
    checks = metric_checks(c, picker, partner_figures, *picked)
    each = [
        "CASE " + " ".join(f"WHEN {cond} THEN named_struct('metric', '{m}', 'reason', '{why}')" for cond, why in checks[m]) + " END" for m in metrics
    ]
    return f"filter(array({', '.join(each)}), e -> e IS NOT NULL)"


def hand_metrics(
    cards: str,
    tarnib: str,
    bids: str,
    seat: int | str,
    partner_cards: str | None = None,
    rules: Rules = Rules(),
) -> dict[str, str]:
    """All twelve features of one hand straight from text expressions (inlined counts).

    For one-off use and unit tests; the table operators compute each base
    count once and reuse it instead.
    """
    c = {**rank_counts(cards), **suit_counts(cards, tarnib)}
    partner = figures(rank_counts(partner_cards)) if partner_cards is not None else "0"
    return seat_metrics(str(seat), trump_picker(bids), tarnib, partner, rules, c)

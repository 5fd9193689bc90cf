"""The round summary as one logical plan: one scan, row-local work, two tiny aggregations.

    rounds ─► complete rounds ─► roster rounds ─► seat table (counts once per hand)
           ─► first seat per person ─► per-person partial sums ─► one wide row

The only exchanges are the per-person aggregation (tasks x persons rows) and
the one-row layout; both stay tiny at any input size. The ``*_table``
variants resolve persons through a roster table instead (see
``operators.roster_join``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tricklens.model import Roster, Rules
from tricklens.operators.aggregates import career_summary, person_partials, person_totals
from tricklens.operators.filters import complete_rounds, roster_rounds
from tricklens.operators.roster_join import roster_table_rounds
from tricklens.operators.seats import first_seat_only, seat_table


def kept_rounds(rounds: DataFrame, roster: Roster, rules: Rules = Rules()) -> DataFrame:
    return roster_rounds(complete_rounds(rounds, rules), roster)


def roster_seats(rounds: DataFrame, roster: Roster, rules: Rules = Rules()) -> DataFrame:
    """Seat table of the kept rounds."""
    return seat_table(kept_rounds(rounds, roster, rules), roster, rules)


def totals_by_person(rounds: DataFrame, roster: Roster, rules: Rules = Rules()) -> DataFrame:
    return person_totals(first_seat_only(roster_seats(rounds, roster, rules)))


def summarize(
    rounds: DataFrame,
    roster: Roster,
    rules: Rules = Rules(),
    column_order: Sequence[str] | None = None,
) -> DataFrame:
    """The one-row summary: rounds played and every metric total for every roster person."""
    partials = person_partials(first_seat_only(roster_seats(rounds, roster, rules)))
    return career_summary(partials, roster, column_order)


def table_roster_seats(
    rounds: DataFrame, roster: DataFrame, rules: Rules = Rules()
) -> DataFrame:
    """Seat table of the kept rounds, persons resolved by joining a roster table (``alias, person``)."""
    kept = roster_table_rounds(complete_rounds(rounds, rules), roster)
    return seat_table(kept, None, rules)


def totals_by_person_table(
    rounds: DataFrame, roster: DataFrame, rules: Rules = Rules()
) -> DataFrame:
    """Per-person totals for a roster of any size (long form)."""
    return person_totals(first_seat_only(table_roster_seats(rounds, roster, rules)))


def summarize_table(
    rounds: DataFrame,
    roster: DataFrame,
    people: Sequence[str],
    rules: Rules = Rules(),
    column_order: Sequence[str] | None = None,
) -> DataFrame:
    """One-row summary for the listed ``people``, persons resolved through a roster table."""
    partials = person_partials(first_seat_only(table_roster_seats(rounds, roster, rules)))
    return career_summary(partials, people, column_order)

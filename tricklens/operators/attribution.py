"""Seat -> person attribution: the first matching seat supplies a person's value."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tricklens.functions.tokens import first_match, in_list, sql_string
from tricklens.model import METRICS, Roster


def person_of(player: str, roster: Roster) -> str:
    """SQL: roster person a player name belongs to (lower-cased alias match), else null."""
    lowered = f"lower({player})"
    return first_match([(in_list(lowered, aliases), sql_string(person)) for person, aliases in roster.people])


def is_first_seat(persons: str, seat: int) -> str:
    """SQL: the person in ``seat`` (1-based) of the array ``persons`` is not null and holds no lower seat."""
    return f"coalesce(array_position({persons}, {persons}[{seat - 1}]) = {seat}, false)"


def attribution(seats: DataFrame) -> DataFrame:
    """One row per round and person present: the person's twelve values from their first seat.

    ``seats`` is the long seat table of ``operators.seats.seat_table``. A
    person sitting in two seats of one round counts once, from the lower seat.
    """
    return seats.filter("is_first_seat").select("round_id", "person", "seat", *METRICS)

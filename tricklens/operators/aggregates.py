"""Aggregations: per-person totals, the one-row summary, and their general forms.

All are partial/final aggregations: each task combines its rows map-side
into one row per group, so the shuffle carries (tasks x groups) small rows
however large or skewed the input is; a person holding a third of all rows
costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tricklens.functions.tokens import sql_string
from tricklens.model import METRICS, TOTAL_ROUNDS, Roster, summary_columns

_SEAT1 = "_seat_1_rows"


def person_partials(seats: DataFrame) -> DataFrame:
    """Per-person sums of the twelve metrics over first-seat rows, plus round counts.

    ``_seat_1_rows`` counts the person's rounds in seat 1; summed over all
    persons it is the number of rounds (seat 1 is always a first seat).
    """
    return seats.groupBy("person").agg(
        F.expr("count(1) AS rounds_played"),
        F.expr(f"count_if(seat = 1) AS {_SEAT1}"),
        *[F.expr(f"sum({m}) AS {m}") for m in METRICS],
    )


def person_totals(seats: DataFrame) -> DataFrame:
    """``person, rounds_played`` and the twelve metric totals; any number of persons."""
    return person_partials(seats).drop(_SEAT1)


def career_summary(
    partials: DataFrame, roster: Roster | Sequence[str], column_order: Sequence[str] | None = None
) -> DataFrame:
    """One row: rounds played, then ``<person>_<metric>`` for every roster person.

    A person who played no round has null totals; the round count is 0 on an
    empty input. Input is ``person_partials`` (one row per person), so this is
    a tiny global aggregate.
    """
    names = roster.names if isinstance(roster, Roster) else tuple(roster)
    cells = [f"coalesce(sum({_SEAT1}), CAST(0 AS BIGINT)) AS {TOTAL_ROUNDS}"]
    for metric in METRICS:
        for person in names:
            cells.append(
                f"sum(CASE WHEN person = {sql_string(person)} THEN {metric} END) AS `{person}_{metric}`"
            )
    order = summary_columns(Roster.of({n: [n] for n in names}), column_order)
    return partials.selectExpr(*cells).select(*[f"`{c}`" for c in order])


def wide_totals(df: DataFrame, key: str, keys: Sequence[str], value: str, prefix: str = "") -> DataFrame:
    """One row with ``sum(value)`` per listed key value as its own column (null for an absent key).

    Conditional sums in a single global aggregate: one pass, no pivot
    discovery job, and the column set is fixed by ``keys``.
    """
    return df.selectExpr(
        *[f"sum(CASE WHEN {key} = {sql_string(k)} THEN {value} END) AS `{prefix}{k}`" for k in keys]
    )


def sum_all_with_count(df: DataFrame, columns: Sequence[str], count_name: str = "row_count") -> DataFrame:
    """Sum of every listed column (same names) and the row count, in one aggregate."""
    return df.selectExpr(*[f"sum({c}) AS {c}" for c in columns], f"count(1) AS {count_name}")

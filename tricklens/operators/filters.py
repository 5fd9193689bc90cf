"""Row filters: complete rounds, rounds between roster players, and their general forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tricklens.functions.tokens import in_list
from tricklens.model import SEATS, Roster, Rules, player_col


def sum_equals_sql(columns: Sequence[str], value: float) -> str:
    """SQL: the columns add up to ``value``; a missing or unreadable value gives null (row dropped).

    Values are read with ``try_cast(... AS DOUBLE)`` so numbers stored as
    integers, decimals or text all compare the same way.
    """
    total = " + ".join(f"try_cast({c} AS DOUBLE)" for c in columns)
    return f"({total} = {value})"


def sum_equals(df: DataFrame, columns: Sequence[str], value: float) -> DataFrame:
    return df.filter(sum_equals_sql(columns, value))


def complete_rounds(rounds: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Rounds played to the end: the two team scores add up to the tricks per round."""
    return sum_equals(rounds, ["team_1_score", "team_2_score"], rules.tricks_per_round)


def all_in_sql(columns: Sequence[str], values: Sequence[str], lower: bool = True) -> str:
    """SQL: every column (lower-cased) is one of ``values``; a null fails.

    The explicit ``IS NOT NULL`` changes nothing (a null already fails the
    ``IN``) but, unlike ``lower(c) IN (...)``, it reaches the file scan.
    """
    return "(" + " AND ".join(
        f"{c} IS NOT NULL AND {in_list(f'lower({c})' if lower else c, values)}" for c in columns
    ) + ")"


def all_in(df: DataFrame, columns: Sequence[str], values: Sequence[str], lower: bool = True) -> DataFrame:
    return df.filter(all_in_sql(columns, values, lower))


def roster_rounds(rounds: DataFrame, roster: Roster) -> DataFrame:
    """Rounds where all four seats are taken by roster players (by alias, case-insensitive)."""
    return all_in(rounds, [player_col(s) for s in SEATS], roster.aliases)

"""Token counts over text, weights and thresholds, as Spark SQL expressions.

Every builder returns SQL expression text over column names or other SQL
expressions, so a whole stage is handed to Spark in one ``selectExpr`` (one
call into the JVM, parsed there) and runs as generated JVM code. ``col``
wraps the same text as a ``Column``.

Counting is by text, never by parsing: a token is counted wherever it
occurs, left to right, without overlaps, which is what a regular-expression
``findAll`` gives for a pattern with no special characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLAIN = re.compile(r"^[A-Za-z0-9_]+$")


def sql_string(value: str) -> str:
    """A Spark SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def count_token(text: str, token: str) -> str:
    """Occurrences of the literal ``token`` in the string expression ``text`` (bigint).

    ``(octet_length(text) - octet_length(replace(text, token, ''))) div
    octet_length(token)``: one search pass, no regex engine. Removing an
    occurrence removes exactly the token's bytes, so the byte difference is
    exact for any text, and a string's byte length is known without a scan
    (its character length is not). An empty token matches at every
    character position (``length + 1``), as an empty pattern does. Null
    text gives null.
    """
    if token == "":
        return f"(length({text}) + 1)"
    size = len(token.encode("utf-8"))
    return f"((octet_length({text}) - octet_length(replace({text}, {sql_string(token)}, ''))) div {size})"


def count_token_expr(text: str, token: str) -> str:
    """Like ``count_token`` for a token that is itself an SQL expression (e.g. a column)."""
    return (
        f"(CASE WHEN octet_length({token}) = 0 THEN length({text}) + 1 "
        f"ELSE (octet_length({text}) - octet_length(replace({text}, {token}, ''))) div octet_length({token}) END)"
    )


def _overlap(a: str, b: str) -> bool:
    """True when an occurrence of ``a`` and one of ``b`` can share characters."""
    if a != b and (a in b or b in a):
        return True
    for k in range(1, min(len(a), len(b))):
        if a[-k:] == b[:k] or b[-k:] == a[:k]:
            return True
    return False


def count_tokens(text: str, tokens: Iterable[str]) -> str:
    """Total occurrences of several literal tokens.

    When the tokens are plain words that can never overlap one another, the
    total is one regular-expression pass (``regexp_count`` with an
    alternation), which finds exactly the same occurrences; otherwise it is
    the sum of single-token counts.
    """
    tokens = list(tokens)
    if not tokens:
        return "0"
    if len(tokens) == 1:
        return count_token(text, tokens[0])
    disjoint = all(not _overlap(a, b) for i, a in enumerate(tokens) for b in tokens[i:])
    if disjoint and all(_PLAIN.match(t) for t in tokens):
        return f"regexp_count({text}, {sql_string(alternation(tokens))})"
    return "(" + " + ".join(count_token(text, t) for t in tokens) + ")"


def alternation(tokens: Sequence[str]) -> str:
    """Regex for "any of tokens"; equal-length tokens differing in one place use a class (1[1234]_of_x)."""
    if len({len(t) for t in tokens}) == 1:
        diff = [i for i in range(len(tokens[0])) if len({t[i] for t in tokens}) > 1]
        if len(diff) == 1:
            i = diff[0]
            chars = "".join(sorted({t[i] for t in tokens}))
            if len(chars) == len(tokens):
                return tokens[0][:i] + "[" + chars + "]" + tokens[0][i + 1:]
    return "|".join(tokens)


def weighted_tokens(text: str, weights: Mapping[str, int]) -> str:
    """Sum of ``weight * count`` over tokens (e.g. jack 1, queen 2, king 3, ace 4)."""
    return "(" + " + ".join(f"{count_token(text, tok)} * {w}" for tok, w in weights.items()) + ")"


def flag(condition: str) -> str:
    """Boolean -> 1/0 (null stays null)."""
    return f"CAST(({condition}) AS INT)"


def groups_over(counts: Sequence[str], threshold: int) -> str:
    """How many of the given per-group counts exceed ``threshold`` (strictly)."""
    return "(" + " + ".join(flag(f"{c} > {threshold}") for c in counts) + ")"


def token_groups_over(text: str, groups: Sequence[Sequence[str]], threshold: int) -> str:
    """How many token groups occur more than ``threshold`` times in ``text``."""
    return groups_over([count_tokens(text, g) for g in groups], threshold)


def digit_from_end(text: str, position: int = 2) -> str:
    """The character ``position`` places from the end, read as a digit (int).

    Null when the text is null, shorter than ``position``, or the character
    is not a digit. Positional on purpose: the text is not parsed.
    """
    return (
        f"(CASE WHEN length({text}) >= {position} "
        f"THEN try_cast(substring({text}, length({text}) - {position - 1}, 1) AS INT) END)"
    )


def first_match(branches: Sequence[tuple[str, str]]) -> str:
    """Value of the first branch whose condition holds; null when none does (no ELSE)."""
    return "(CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in branches) + " END)"


def in_list(expr: str, values: Iterable[str]) -> str:
    return f"({expr} IN ({', '.join(sql_string(v) for v in values)}))"


def col(sql: str) -> Column:
    """Wrap SQL expression text as a Column."""
    return F.expr(sql)

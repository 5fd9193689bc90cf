"""Occurrences of many tokens in one pass over each text.

One regular expression with a lookahead stops at every character where a token
starts and captures the longest one that does; shorter tokens that start there
are its prefixes and count with it. Tokens may therefore overlap one another
in any way. Only a token that can overlap itself ("aa", "abab") is counted
differently by place than left to right without overlaps: such tokens
take the exact pass of ``tokens.count_token`` each.

The occurrences leave the text as rows (group, token, count) that are summed
map-side, so a group that holds a third of all texts is one row per task and token.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tricklens.functions.tokens import count_token, in_list, sql_string

_SPECIAL = re.compile(r"([\\^$.|?*+()\[\]{}])")


def overlaps_itself(token: str) -> bool:
    """Whether two occurrences of the token can share characters (a proper prefix is also a suffix)."""
    return any(token[:k] == token[-k:] for k in range(1, len(token)))


def _trie(tokens: Sequence[str]) -> str:
    """A regex for the longest of the tokens at a place; common beginnings are tried once."""
    branches: dict[str, list[str]] = {}
    for t in tokens:
        if t:
            branches.setdefault(t[0], []).append(t[1:])
    parts = []
    for first, rests in sorted(branches.items()):
        rest = _trie([r for r in rests if r])
        optional = "?" if "" in rests and rest else ""
        parts.append(_SPECIAL.sub(r"\\\1", first) + (f"(?:{rest}){optional}" if rest else ""))
    return "|".join(parts)


def token_totals(df: DataFrame, keys: Sequence[str], text: str, tokens: Sequence[str], prefix: str = "n_") -> DataFrame:
    """``keys`` and, per token, its occurrences in the texts of the group (null if all of them are null)."""
    tokens = list(dict.fromkeys(tokens))
    alone = [t for t in tokens if not t or overlaps_itself(t)]
    together = [t for t in tokens if t not in alone]
    own = [f"{count_token(text, t)} AS _own_{k}" for k, t in enumerate(alone)]
    # The class of first characters spares most places the alternatives.
    starts = "".join(sorted({_SPECIAL.sub(r"\\\1", t[0]).replace("-", "\\-").replace("&", "\\&") for t in together}))
    hits = f"regexp_extract_all({text}, {sql_string(f'(?=[{starts}])(?=({_trie(together)}))')}, 1)" if together else f"CASE WHEN {text} IS NOT NULL THEN array() END"
    names = [f"_key_{k}" for k in range(len(keys))]
    found = df.selectExpr(*[f"{key} AS {name}" for key, name in zip(keys, names)], f"{hits} AS _hits", *own)
    # One row more per text that has some: it carries the counts taken alone, and holds groups without any token.
    rows = found.selectExpr(*names, "_hits IS NULL AS _null", *[f"_own_{k}" for k in range(len(alone))], "explode(concat(array(''), coalesce(_hits, array()))) AS _hit")
    counted = rows.groupBy(*names, "_hit", "_null").agg(
        F.count("*").alias("_n"), *[F.expr(f"sum(CASE WHEN _hit = '' THEN _own_{k} END) AS _own_{k}") for k in range(len(alone))]
    )

    def total(token: str) -> str:
        if token in alone:
            return f"sum(_own_{alone.index(token)})"
        holding = [t for t in together if t.startswith(token)]
        return f"sum(CASE WHEN _null THEN NULL WHEN {in_list('_hit', holding)} THEN _n ELSE 0 END)"

    return counted.groupBy(*[F.col(n).alias(k) for n, k in zip(names, keys)]).agg(*[F.expr(total(t)).alias(f"{prefix}{t}") for t in tokens])

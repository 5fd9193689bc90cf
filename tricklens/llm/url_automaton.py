"""URL filters: all glob rules in one bit-parallel automaton, run over each canonical URL.

Every rule is compiled to globs over ``host + path + ?query``, and every glob to
a run of bits: bit 0 says "nothing read yet", bit j "the first j characters of
the glob are read". The runs of all globs lie one after the other in as many
64-bit words as they need. One character of a URL moves all globs at once,

    state = (state << 1, carries included) & accepts[character]  |  state & stays[character]

where ``accepts`` has the bits whose glob character it is and ``stays`` the
bits that a star lets wait. A glob fits if its last bit is set at the URL's end.
Glob characters: ``*`` any run without a slash, ``**`` any run, ``?`` one
character but a slash, ``\\`` takes the next one as it is.

Site rules (host, path) fit their host and all subdomains where the URL's path
starts with theirs; the longest rule wins, of equally long ones a block. URLs
that no site rule fits are judged by the globs in the same way (longest by
characters that are no wildcard), and by ``default`` where none fits.

The rules are a parameter and travel with the tasks: a task holds their masks
and ``ROWS_AT_ONCE`` states of (bits of all rules / 64) words; URLs are read to
their ends, however long. No row moves between tasks.

Defined results: a null URL or one without ``://`` has an empty host, path and
query, which globs that fit the empty text alone fit; repeated rows are judged
each on its own; an empty table gives an empty result; other columns pass
through, and the columns added get unclashing names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tricklens.llm.common import private_names

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SITE_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
GLOBS = (
    ("block", "*spam-*/**"),
    ("block", "*cheap-*/**"),
    ("block", "*casino*/**"),
    ("block", "*-bets*/**"),
    ("block", "**/login**"),
    ("block", "**/wp-admin/**"),
    ("block", "**/cart/**"),
    ("block", "**.exe"),
    ("block", "**.zip"),
    ("block", r"**\?**session*=**"),
    ("allow", "*.edu/**"),
    ("allow", "m.*/en/??.html"),
)
DEFAULT = "allow"
ROWS_AT_ONCE = 1 << 14
FEW = 8  # URLs that outlast all others of their batch are ended one by one, on Python's long integers
ONE_SEGMENT, ANYTHING = 1, 2
ADDED = ("host", "path", "rule", "glob", "verdict")


@dataclass(frozen=True)
class Rule:
    """One line of a rule list: its name in results, its verdict, its length, and the globs any of which makes it fit."""

    name: str
    verdict: str
    length: int
    globs: tuple[str, ...]


def quoted(text: str) -> str:
    return "".join("\\" + c if c in "*?\\" else c for c in text)


def site_rule(verdict: str, host: str, path: str) -> Rule:
    if not host or any(c in host for c in "/?#") or any(c in path for c in "?#") or not (path == "" or path.startswith("/")):
        raise ValueError(f"a site rule is a host and a path from its slash on, without query: {host!r} {path!r}")
    ends = [quoted(path) + "**"] if path else ["", "/**", r"\?**"]
    return Rule(host + path, verdict, len(host + path), tuple(sub + quoted(host) + end for sub in ("", "*.") for end in ends))


def glob_rule(verdict: str, glob: str) -> Rule:
    return Rule(glob, verdict, sum(kind is not None for kind, _ in steps_of(glob)), (glob,))


def steps_of(glob: str) -> list[tuple[str | None, int]]:
    """The characters to be read, each with the star before it (0, ONE_SEGMENT, ANYTHING); last (None, star at the end).

    ``?`` is the empty string here.
    """
    out, star, i = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            wide = glob[i : i + 2] == "**"
            star, i = max(star, ANYTHING if wide else ONE_SEGMENT), i + 1 + wide
            continue
        if c == "\\" and i + 1 < len(glob):
            i, c = i + 1, glob[i + 1]
        elif c == "?":
            c = ""
        out.append((c, star))
        star, i = 0, i + 1
    return [*out, (None, star)]


class Automaton:
    """The masks of many globs, packed into 64-bit words."""

    def __init__(self, globs: Sequence[str]):
        steps = [steps_of(g) for g in globs]
        alphabet = sorted({c for s in steps for c, _ in s if c} | {"/"})
        # Class 0 holds all characters that no glob names.
        self.alphabet = np.array([ord(c) for c in alphabet], np.uint32)
        width = sum(len(s) for s in steps)
        self.words = max(1, -(-width // 64))
        accepts, stays, start = [0] * (len(alphabet) + 1), [0] * (len(alphabet) + 1), 0
        slash, ends, at = alphabet.index("/") + 1, [], 0
        for s in steps:
            start |= 1 << at
            for j, (c, star) in enumerate(s):
                for k in range(len(accepts)):
                    if star == ANYTHING or (star == ONE_SEGMENT and k != slash):
                        stays[k] |= 1 << (at + j)
                    if c is not None and (k == alphabet.index(c) + 1 if c else k != slash):
                        accepts[k] |= 1 << (at + j + 1)
            at += len(s)
            ends.append(at - 1)
        self.long = (accepts, stays)
        self.accepts, self.stays, self.start = self.packed(accepts), self.packed(stays), self.packed([start])[0]
        self.end_word, self.end_bit = np.array(ends, np.int64) // 64, np.array(ends, np.uint64) % np.uint64(64)

    def packed(self, numbers: Sequence[int]) -> np.ndarray:
        return np.frombuffer(b"".join(n.to_bytes(8 * self.words, "little") for n in numbers), "<u8").reshape(len(numbers), self.words)

    def classes(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        place = np.searchsorted(self.alphabet, codes)
        known = self.alphabet[np.minimum(place, len(self.alphabet) - 1)] == codes
        return np.where(known, place + 1, 0)

    def fits(self, texts: Sequence[str]) -> np.ndarray:
        """(texts, globs) booleans: which globs fit each whole text."""
        rows = max(1, ROWS_AT_ONCE // self.words)
        parts = [self._fits(texts[i : i + rows]) for i in range(0, len(texts), rows)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.end_word)), bool)

    def _fits(self, texts: Sequence[str]) -> np.ndarray:
        sizes = np.array([len(t) for t in texts])
        order = np.argsort(-sizes, kind="stable")
        lengths, offsets = sizes[order], np.concatenate([[0], np.cumsum(sizes)[:-1]])[order]
        classes = self.classes("".join(texts))
        state = np.repeat(self.start[None, :], len(texts), axis=0)
        at, active = 0, int((lengths > 0).sum())
        while active > FEW or (active and lengths[0] - at <= 64):
            now = classes[offsets[:active] + at]
            old = state[:active]
            new = old << np.uint64(1)
            new[:, 1:] |= old[:, :-1] >> np.uint64(63)
            state[:active] = (new & self.accepts[now]) | (old & self.stays[now])
            at += 1
            active = int(np.searchsorted(-lengths, -at, "left"))
        accepts, stays = self.long
        for row in range(active):
            s, begin = int.from_bytes(state[row].tobytes(), "little"), offsets[row]
            for k in classes[begin + at : begin + lengths[row]].tolist():
                s = (s << 1) & accepts[k] | s & stays[k]
            state[row] = self.packed([s])[0]
        found = (state[:, self.end_word] >> self.end_bit) & np.uint64(1) == 1
        out = np.empty_like(found)
        out[order] = found
        return out


def best_first(rules: Sequence[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: (-r.length, r.verdict != "block", r.name))


class Judge:
    """First fitting rule of each list, best first, for many URLs at once."""

    def __init__(self, sites: Sequence[Rule], globs: Sequence[Rule], default: str):
        self.rules, self.n_sites, self.default = [*best_first(sites), *best_first(globs)], len(sites), default
        self.owner = np.array([i for i, r in enumerate(self.rules) for _ in r.globs], np.int64)
        self.automaton = Automaton([g for r in self.rules for g in r.globs])

    def __call__(self, urls: Sequence[str]) -> pd.DataFrame:
        fits = self.automaton.fits(urls)

        def first(lo: int, hi: int) -> np.ndarray:
            of = np.flatnonzero((self.owner >= lo) & (self.owner < hi))
            if not len(of):
                return np.full(len(urls), -1)
            part = fits[:, of]
            return np.where(part.any(axis=1), self.owner[of[part.argmax(axis=1)]], -1)

        site, glob = first(0, self.n_sites), first(self.n_sites, len(self.rules))
        names = np.array([*[r.name for r in self.rules], None], object)
        verdicts = np.array([*[r.verdict for r in self.rules], self.default], object)
        return pd.DataFrame({"rule": names[site], "glob": names[glob], "verdict": verdicts[np.where(site >= 0, site, glob)]})


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, query with its question mark) of a URL; all empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    path = F.regexp_extract(after, r"^[^?#]*", 0)
    query = F.regexp_extract(F.substring(after, F.length(path) + 1, F.length(after)), r"^\?[^#]*", 0)
    return F.translate(host, UPPER, LOWER), path, query


def judged(
    pages: DataFrame,
    url: str = "url",
    sites: Sequence[tuple[str, str, str]] = SITE_RULES,
    globs: Sequence[tuple[str, str]] = GLOBS,
    default: str = DEFAULT,
) -> tuple[DataFrame, dict[str, str]]:
    """``pages`` with host, path, rule (the site rule that decided, or null), glob and verdict; the dict has their (unclashing) names."""
    compiled = Judge([site_rule(*r) for r in sites], [glob_rule(*g) for g in globs], default)

    @F.pandas_udf("rule string, glob string, verdict string")
    def judge(urls: pd.Series) -> pd.DataFrame:
        return compiled(urls.tolist())

    *added, found, whole = private_names(pages, *ADDED, "url_found", "url_canonical")
    names = dict(zip(ADDED, added))
    host, path, query = url_parts(F.col(url))
    parted = pages.withColumns({names["host"]: host, names["path"]: path, whole: F.concat(host, path, query)}).withColumn(found, judge(F.col(whole)))
    out = parted.withColumns({names[c]: F.col(found)[c] for c in ("rule", "glob", "verdict")}).drop(found, whole)
    return out, names


def allowed(pages: DataFrame, url: str = "url", **rules) -> DataFrame:
    """The pages that the rules let through, with their own columns."""
    out, names = judged(pages, url, **rules)
    return out.where(F.col(names["verdict"]) == "allow").select(*pages.columns)

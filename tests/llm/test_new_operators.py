"""URL filters, spelling variants and hard negatives against brute force and on rows made to be awkward."""

from __future__ import annotations

import collections
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tricklens.llm import chunk_variants, cover_tree, queries, url_automaton
from tricklens.llm.common import stored

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def keep(df):
    return stored(df, "test")


# --- URL filters -------------------------------------------------------------


def as_regex(glob):
    out, i = "", 0
    while i < len(glob):
        if glob[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return re.compile(out, re.S)


def test_all_globs_at_once_equal_one_regex_each():
    rng = random.Random(3)
    parts = ["a", "b", "/", ".", "é", "😀", "*", "**", "?", "\\*", "\\?", "ab"]
    globs = ["", "*", "**", "?", "a***b", "\\"] + ["".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(120)]
    texts = ["", "/", "😀"] + ["".join(rng.choices(["a", "b", "/", ".", "é", "😀", "*", "?", "z", "\n"], k=rng.randint(0, 12))) for _ in range(400)]
    texts += ["a" * 3000 + "/b", "a/" * 2500]  # these outlast the others
    automaton = url_automaton.Automaton(globs)
    assert automaton.words > 5  # globs lie across the edges of words
    want = np.array([[as_regex(g).fullmatch(t) is not None for g in globs] for t in texts])
    assert (automaton.fits(texts) == want).all() and want.sum() > 500
    assert automaton.fits([]).shape == (0, len(globs))


def judged_plainly(url, sites, globs, default):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    query = re.match(r"(\?[^#]*)?", rest[len(host) + len(path) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(h + p), v == "block", h + p, v) for v, h, p in sites if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = sorted(fit, key=lambda x: (-x[0], not x[1], x[2]))[:1]
    fit = [(len(re.sub(r"\*|\\(.)", r"\1", g)), v == "block", g, v) for v, g in globs if as_regex(g).fullmatch(host + path + query)]
    glob = sorted(fit, key=lambda x: (-x[0], not x[1], x[2]))[:1]
    return host, path, best[0][2] if best else None, glob[0][2] if glob else None, (best or glob or [(default,)])[0][-1]


URLS = [
    None, "", "no scheme", "://", "http://", "http://ORG", "http://org/", "https://a.org/x", "http://xorg/", "http://example.org/es/1", "http://a.example.org/en/1?x#y",
    "http://example.org/en/2", "http://w.com/fr/", "http://w.com/FR/", "http://w.com/de", "http://w.com/de/?q", "http://w.com?x=/fr/", "http://w.com#/fr/",
    "http://É.com/fr/ü", "http://u:p@h.com:80/fr/", "http://a.edu/x", "http://x/login", "http://m.x/en/ab.html", "ftp://x/y.exe", "http://x/?session_id=1",
    "http://x/?q#session=", "http://a://b.org/c", "http://" + "a" * 5000 + ".org/" + "b" * 5000, "http://q.com\n/fr/", "http://org?x", "http://sub.bare.io", "http://bare.io?z",
    "http://bare.io/z", "http://xbare.io/z", "http://notbare.io",
]


def test_urls_against_plain_rules(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string").withColumns({c: F.lit("old") for c in ("host", "Rule", "url_found")})
    extra = (*url_automaton.SITE_RULES, ("block", "bare.io", ""), ("allow", "q.com\n", "/"))
    for sites in (url_automaton.SITE_RULES, extra, ()):
        out, names = url_automaton.judged(df, sites=sites)
        assert set(df.columns) < set(out.columns)
        for r in out.collect():
            got = tuple(r[names[c]] for c in ("host", "path", "rule", "glob", "verdict"))
            assert got == judged_plainly(r.url, sites, url_automaton.GLOBS, "allow"), r.url
            assert r.host == "old" and r.Rule == "old"
    assert url_automaton.allowed(df).columns == df.columns
    assert url_automaton.judged(df.limit(0))[0].count() == 0
    assert {r[0] for r in url_automaton.judged(df, sites=(), globs=(), default="block")[0].select("verdict").collect()} == {"block"}
    with pytest.raises(ValueError):
        url_automaton.site_rule("block", "a/b", "/")


def test_url_query_judges_every_page(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    out = {r.page_id: r for r in queries.op11_url_automaton(spark, SF).collect()}
    assert len(out) == len(pages)
    for p in pages:
        r = out[p.page_id]
        assert (r.host, r.path, r.rule, r.glob, r.verdict) == judged_plainly(p.url, url_automaton.SITE_RULES, url_automaton.GLOBS, "allow")


# --- spelling variants -------------------------------------------------------


def counted_plainly(docs, garble):
    n = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if garble and h % garble == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def variants_plainly(words):
    out = {}
    for w, n in words.items():
        near = [x for x in words if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form = best if best and words[best] >= 2 * n else None
        out[w] = [form, None, n, len(near), words[form] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w][1] = root
    return {w: tuple(x) for w, x in out.items()}


def got_variants(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_runs_and_garbling(spark):
    docs = [(1, "Hello HELLO hello, ÀÉÈéè ÀÉÈéè ÀÉÈéè hallo"), (2, None), (3, ""), (None, "hello nulls nulls nulls"), (4, "a×b÷c a×b÷c a×b÷c"), (5, "x" * 50_000)]
    docs += [(5, "twice twice"), (5, "twice twice")] + [(i, "world wordy words " * 3) for i in range(100, 160)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"word": F.lit("w"), "n": F.lit(1), "run": F.lit(2)})
    for garble in (None, 97, 5, 1):
        assert {r.word: r.n for r in chunk_variants.word_counts(df, garble=garble).collect()} == counted_plainly(docs, garble)
    assert "a×b÷c" in counted_plainly(docs, None)
    empty = chunk_variants.variants(chunk_variants.word_counts(df.limit(0)), keep)
    assert empty.count() == 0 and empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]


@pytest.mark.parametrize("block", [1024, 3])
def test_variants_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(chunk_variants, "BLOCK", block)
    rng = random.Random(7)
    words = {"".join(rng.choices("abé", k=rng.choice([5, 5, 6, 6, 7, 8, 9]))): rng.choice([3, 3, 4, 7, 8, 20, 100]) for _ in range(500)}
    words |= {"stemstemstem" + "".join(rng.choices("abc", k=2)): 3 for _ in range(9)} | {"aaaaaa": 1000, "aaaaa": 500, "aaaaaaa": 2000, "x" * 9000: 5, "x" * 9001: 50}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = variants_plainly(words)
    assert got_variants(chunk_variants.variants(df, keep)) == want
    assert max(v[3] for v in want.values()) > 10 and sum(v[1] != w and v[1] != v[0] for w, v in want.items()) > 20


def test_variant_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    words = counted_plainly(docs, 97)
    by_hole = collections.defaultdict(set)
    for w in words:
        for i in range(len(w)):
            by_hole[w[:i], w[i + 1 :]].add(w)
    got = got_variants(queries.op12_chunk_variants(spark, SF))
    assert {w: v[2] for w, v in got.items()} == words
    for w, (form, root, n, n_near, form_n) in got.items():
        near = {x for i in range(len(w)) for x in by_hole[w[:i], w[i + 1 :]]} | {x for i in range(len(w)) if (x := w[:i] + w[i + 1 :]) in words}
        near |= {x for i in range(len(w) + 1) for x in by_hole[w[:i], w[i:]]}
        near.discard(w)
        assert n_near == len(near) and (form is None or (form in near and form_n == max(words[x] for x in near) >= 2 * n))


# --- hard negatives ----------------------------------------------------------


def mined_plainly(rows, positives=5, negatives=5, low=80, high=100):
    use = {
        (i, g, tuple(math.floor(256 * x) for x in v))
        for i, g, v in rows
        if i is not None and g is not None and v is not None and all(x is not None and math.isfinite(256 * x) for x in v)
    }
    clamp = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    out = []
    for i, g, v in use:
        if i % 100:
            continue
        scored = [(-clamp(sum(x * y for x, y in zip(v, w))), j, h) for j, h, w in use if j != i and len(w) == len(v)]
        for p, j, _ in sorted(x for x in scored if x[2] == g)[:positives]:
            hard = sorted(x for x in scored if x[2] != g and low * -p <= 100 * -x[0] <= high * -p)
            out += [(i, j, k + 1, m, -p, -s) for k, (s, m, _) in enumerate(hard[:negatives])]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(i, g, v, 1, "x") for i, g, v in rows], "vec_id long, label int, embedding array<double>, v int, score string")
    out = cover_tree.hard_negatives(cover_tree.usable(df), F.col("vec_id") % 100 == 0, keep, **options)
    return sorted(tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("sizes", [(1 << 16, 1 << 14, 48), (150, 4, 4)])
def test_hard_negatives_against_all_rows(spark, monkeypatch, sizes):
    for name, size in zip(("SHARD_ROWS", "ANCHOR_ROWS", "LEAF"), sizes):
        monkeypatch.setattr(cover_tree, name, size)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    rows = [(i, int(rng.integers(4)), (centres[rng.integers(6)] + rng.normal(size=8) * rng.choice([0.02, 0.3])).tolist()) for i in range(0, 1500, 2)]
    rows += [(10_000 + i, i % 3, centres[0].tolist()) for i in range(0, 300, 1)]  # copies, under three labels
    rows += [(100, 0, rows[0][2]), (100, 1, rows[1][2]), rows[0], rows[0], (None, 1, rows[0][2]), (200, None, rows[0][2]), (300, 1, None)]
    rows += [(400, 1, [math.nan] * 8), (401, 1, [math.inf] + [0.0] * 7), (402, 1, [None] + [0.0] * 7), (20_000, 9, rows[0][2]), (20_100, 1, [0.0] * 8), (20_200, 1, [])]
    rows += [(20_300, 1, [1.0, 2.0]), (20_301, 1, [1.0, 2.0]), (20_302, 2, [1.0, 1.9]), (20_303, 2, [-1.0, -2.0]), (20_201, 1, []), (20_202, 2, [])]
    want = mined_plainly(rows)
    assert mined(spark, rows) == want and len(want) > 200
    assert mined(spark, rows, positives=2, negatives=9, low_percent=50) == mined_plainly(rows, 2, 9, 50)
    assert mined(spark, rows[:1]) == [] and mined(spark, [(1, 2, [1.0])]) == []


def test_hard_negatives_of_any_size(spark):
    """Components whose products no double holds, and some beyond a long."""
    big, huge = 2.0**40 + 1, 1e200
    rows = [(0, 1, [big, 3.0]), (1, 1, [big, 1.0]), (2, 2, [big, 0.5]), (3, 2, [big - 1, 9.0]), (4, 2, [1.0, 1.0]), (100, 1, [huge, 0.0]), (101, 2, [huge, 1.0]), (102, 1, [1e307, 0.0])]
    assert mined(spark, rows) == mined_plainly(rows)


def test_bounds_hold_and_skip():
    rng = np.random.default_rng(4)
    v = np.floor(256 * (rng.normal(size=(30, 16))[rng.integers(30, size=4000)] + 0.05 * rng.normal(size=(4000, 16))))
    tree = cover_tree.CoverTree(v)
    below = lambda n: [tree.rows[n]] if tree.rows[n] is not None else [r for c in tree.children[n] for r in below(c)]
    assert sorted(np.concatenate(below(0)).tolist()) == list(range(4000))
    for q in v[:20]:
        for node, (low, high) in enumerate(zip(*tree.bounds(q))):
            scores = v[np.concatenate(below(node))] @ q
            assert low <= scores.min() and scores.max() <= high
    search = cover_tree.Search(cover_tree.Shard(np.arange(4000), np.ones(4000, int), v), 0, v[0])
    assert search.best([1], 5) == sorted(((int(s), i) for i, s in enumerate(v @ v[0]) if i), key=lambda x: (-x[0], x[1]))[:5]
    assert len(search.kept_scores) < 0.2 * sum(r is not None for r in tree.rows)

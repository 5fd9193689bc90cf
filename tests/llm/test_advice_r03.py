"""Cases of the third review that the earlier tests could not notice."""

from __future__ import annotations

import math
import os
import re
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

from tricklens.llm import apportion, blob_ledger, coordinate_join, disclosure, host_paths, queries  # noqa: E402
from tricklens.llm.common import stored  # noqa: E402
from tricklens.sources.scratch import fresh_path  # noqa: E402


def keep(df):
    return stored(df, "test")


# --- personal data: one definition -------------------------------------------


def spans_plainly(docs, alpha=0.75, support=2):
    base = {i: brute.personal(t) for i, t in docs}
    terms = {
        i: [m for m in re.finditer(r"[^\W_]+", t or "") if not any(s < m.end() and m.start() < e for _, s, e in base[i])] for i, t in docs
    }
    holds = {i: {"email:" + t[s:e].lower() if k == "email" else k + ":" + re.sub(r"[^0-9.]", "", t[s:e]) for k, s, e in base[i]} for i, t in docs}
    n, out = len(docs), {}
    has = {i: {w.lower() for w in re.findall(r"[^\W_]+", t or "")} for i, t in docs}
    for i, t in docs:
        marked = []
        for m in terms[i] if base[i] else ():
            w = m[0].lower()
            for entity in holds[i]:
                n_e = sum(entity in h for h in holds.values())
                n_te = sum(entity in holds[j] and any(x[0].lower() == w for x in terms[j]) for j, _ in docs)
                n_t = sum(w in h for h in has.values())
                if n_te >= support and n_e < n and math.log(n * n_te / (n_t * n_e)) >= alpha * math.log(n / n_e):
                    marked.append(("term", m.start(), m.end()))
                    break
        out[i] = base[i] + marked
    return out


def test_spans_cover_whole_documents(spark):
    """The registered query's spans: a name 200 code points from its address, wherever it stands, and nothing of other documents."""
    common = "the quick report was sent by mail to all of the staff on monday "
    docs = [(i, f"Zebulon wrote. {common * 3}ZEBULON again. {common * 3} zeb@site.example") for i in range(3)]
    docs += [(10 + i, common * 2) for i in range(30)] + [(99, "zebulon without an address stays"), (100, f"once only {common} one@other.example")]
    docs += [(200 + i, f"Call Ada{i % 2} Byron, +1 (017) 555-7713. {common} 10.0.0.{i % 2}") for i in range(4)] + [(300, None), (301, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: [(x.kind, x.s, x.e) for x in r.spans] for r in disclosure.spans_of(df, "text", keep).collect()}
    want = spans_plainly(docs)
    assert got == want
    assert [k for k, _, _ in got[0]].count("term") >= 2 and got[0][1][1] == 0 and got[99] == [] and got[10] == []


# --- page extraction: the whole article ---------------------------------------


def texts_of(spark, pages, host="h"):
    df = spark.createDataFrame([(i, f"http://{host}/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in host_paths.extracted(df).collect()}


def test_article_keeps_what_is_named_like_boilerplate(spark):
    parts = [
        '<table><tr class="header"><td>Year<td>Sum</tr><tr><td>1<td>2</table>', '<table><tr><th class="header">Head<th>B</tr></table>', '<p id="discussion">said</p>',
        '<div id="discussion"><h2>Discussion</h2>All of it</div>', '<ul><li id="search">Search trees</ul>', '<p class="social-studies">Social</p>',
        "<p>Where <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds</p>", '<div class="entry-header"><h3>Sub</h3></div><p id="related">r',
    ]
    pages = [f"<body><nav><a>Menu</a></nav><article><h1>T</h1><p>{'long text ' * 9}</p>{x}</article><footer>f</footer></body>" for x in parts]
    out = texts_of(spark, pages)
    for i, page in enumerate(pages):
        assert out[i] == brute.article_text(page), parts[i]
    assert out[6].endswith("Where x=1 holds") and out[3].endswith("Discussion\n\nAll of it") and "Year" in out[0]
    # The same where the template has no <article>.
    plain = [p.replace("<article>", '<div class="story">').replace("</article>", "</div>") for p in pages]
    assert list(texts_of(spark, plain).values()) == list(out.values())


def test_boilerplate_boxes_go(spark):
    gone = [
        '<div class="share">Share</div>', '<div class="ad">Buy</div>', '<p class="ad">Buy</p>', '<div id="comments"><p>Nice!</p></div>', '<ul class="comment-list"><li>Nice!</ul>',
        "<form>Name</form>", '<div hidden>x</div>', '<div role="navigation">n</div>', '<div class="cookie-notice">We use</div>', "<svg><text>t</text></svg>", "<aside>a</aside>",
    ]
    pages = [f"<body><article><h1>T</h1><p>{'long text ' * 9}</p>{x}<p>end</p></article></body>" for x in gone]
    assert set(texts_of(spark, pages).values()) == {"T\n\n" + " ".join(["long text"] * 9) + "\n\nend"}
    outside = '<body><div id="discussion"><p>d</p></div><p id="search">s</p>' + f"<h1>T</h1><p>{'long text ' * 9}</p></body>"
    assert texts_of(spark, [outside])[0] == "T\n\n" + " ".join(["long text"] * 9)


def test_broken_tags_as_html_reads_them(spark):
    pages = [
        '<p>zero</p><p title="x>one</p>', '<p>zero</p><p title="x>one</p><p class="y">two</p>', '<a " <p>y', "<p title=don't>a's</p><p>b", "<p>zero<b", "<p>1 < 2 and <3</p>",
        "<p title='a>b'>c</p>", '<p title = "a>b" x>c</p>', "<p =\"x>\">c</p>",
    ]
    assert list(texts_of(spark, pages).values()) == ["zero", "zero\n\ntwo", "y", "a's\n\nb", "zero", "1 < 2 and <3", "c", "c", "c"]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_pages_against_a_tree_walk(spark, sf):
    path = f"/root/testdata/{sf}"
    if not os.path.isdir(path):
        pytest.skip("driver test data not present")
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{path}/pages.parquet").collect()}
    out = {r.page_id: (r.text, r.n_chars) for r in queries.op2_host_paths(spark, path).collect()}
    assert out == {i: (t := brute.article_text(p), len(t)) for i, p in pages.items()}


def test_only_odd_pages_of_a_hot_host_are_joined(spark, monkeypatch):
    """A host of 40 templates: pages under its first 16 paths never meet the list of all paths, the others find theirs."""
    seen = []
    late = host_paths.late_paths
    monkeypatch.setattr(host_paths, "late_paths", lambda odd, tally: (seen.append(odd.count()), late(odd, tally))[1])
    story = lambda k, n: f'<div class="t{chr(97 + k // 26)}{chr(97 + k % 26)}"><h1>S</h1><p>{"word " * n}</p></div>'
    sizes = {k: 3 + 2 * (40 - k) for k in range(40)}
    pages = [f"<body>{story(k, 30)}</body>" for k, n in sizes.items() for _ in range(n)]
    teaser = f'<div class="teaser"><p>{"tease " * 200}</p></div>'
    pages += [f"<body>{teaser}{story(k, 9)}</body>" for k in (0, 39)]
    out = texts_of(spark, pages, "hot.example")
    n_first = sum(sorted(sizes.values())[-host_paths.RANKED :])
    assert seen[0] < len(pages) - n_first  # distinct pages, one of each later template at least
    assert set(out.values()) == {"S\n\n" + " ".join(["word"] * 30), "S\n\n" + " ".join(["word"] * 9)}


# --- rows that share an id but not the text ------------------------------------


def test_unlike_texts_of_one_id_are_documents_of_their_own(spark):
    words = [f"w{i}" for i in range(60)]
    a, b = " ".join(words), " ".join(f"v{i}" for i in range(50))
    rows = [(3, a, "x"), (5, a + " more", "x"), (5, b, "y"), (5, b, "y"), (9, b + " end", "z"), (11, "alone here", "z"), (None, "no id", "z"), (None, "no id either", "z"), (None, "no id", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, near_node string")
    out = sorted(((r.doc_id, r.text, r.near_node) for r in coordinate_join.first_of_each(df).collect()), key=str)
    assert out == sorted([(3, a, "x"), (5, b, "y"), (11, "alone here", "z"), (None, "no id", "z"), (None, "no id either", "z")], key=str)
    # A group whose first true id is among the repeated ones.
    rows = [(1, b, "x"), (1, a, "x"), (2, a + " more", "x"), (4, "else", "x")]
    out = coordinate_join.first_of_each(spark.createDataFrame(rows, df.schema)).collect()
    assert sorted((r.doc_id, r.text) for r in out) == sorted([(1, a), (1, b), (4, "else")])


def test_no_text_moves_for_repeated_ids_elsewhere(spark, monkeypatch):
    """Only rows of repeated ids are compared by text."""
    sizes = []
    real = coordinate_join.stored
    monkeypatch.setattr(coordinate_join, "stored", lambda df, name: (out := real(df, name), sizes.append((name, out.count())))[0])
    df = spark.createDataFrame([(i, f"text number {i} of many words here") for i in range(300)] + [(7, "another text")], "doc_id long, text string")
    assert coordinate_join.first_of_each(df).count() == 301
    assert ("repeated-documents", 2) in sizes


def test_mix_keeps_rows_of_one_id_apart(spark):
    texts = [" ".join(f"{chr(97 + k)}{i}" for i in range(200 + 37 * k)) for k in range(6)]
    df = spark.createDataFrame([(1, t, s) for t in texts[:3] for s in ("s1", "s2")] + [(2, texts[3], "s1"), (3, texts[4], None), (3, texts[5], None)], "doc_id long, text string, source string")
    plan = apportion.mixed(df, store=keep)
    taken = sum(r.taken for r in plan.collect())
    out = apportion.mix(df, store=keep).collect()
    assert sum(len(r.text.split()) for r in out) == taken
    for r in out:  # every part is made of one text's words, in order
        source = next(t for t in texts if r.text.split()[0] in t.split())
        assert set(r.text.split()) <= set(source.split())
    again = sorted(((r.doc_id, r.source, r.text) for r in apportion.mix(df.repartition(7), store=keep).collect()), key=str)
    assert again == sorted(((r.doc_id, r.source, r.text) for r in out), key=str)


def test_findings_of_a_blob_in_many_places(spark):
    text = "password = hunter2hunter2"
    df = spark.createDataFrame([(i, text) for i in range(500)] + [(1000, "clean"), (None, text)], "doc_id long, text string")
    out = blob_ledger.scan_versions(df, F.col("doc_id"), F.col("text"), fresh_path(spark, "ledger")).collect()
    assert len(out) == 502 and sum(len(r.found) for r in out) == 501

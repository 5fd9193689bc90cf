"""Components that grow link by link, and how few tables the near-duplicate search writes for them."""

from __future__ import annotations

import random

from tricklens.llm import components, coordinate_join


def plainly(links):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        p, q = root(a), root(b)
        up[max(p, q)] = min(p, q)
    return {x: root(x) for x in list(up)}


def test_grown_is_components_of_all_links(spark):
    rng = random.Random(2)
    goes = [[tuple(rng.sample(range(90), 2)) for _ in range(n)] for n in (25, 30, 0, 12)]
    goes += [[(i + 1, i) for i in range(200, 230)], [(5, 215)], [(5, 215), (215, 5), (300, 301)]]
    found, every = None, []
    for links in goes:
        every += links
        found = components.grown(found, spark.createDataFrame(links, "a long, b long"))
        rows = [tuple(r) for r in found.collect()]
        assert len(rows) == len(dict(rows)) and dict(rows) == plainly(every)
    assert components.grown(None, spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_are_walked_once(spark, monkeypatch):
    """Before, each of the three times that components were needed walked all links again: 53 tables here."""
    rng = random.Random(6)
    docs = []
    for group in range(12):
        words = [f"w{rng.randrange(500)}" for _ in range(80)]
        for i in range(8):
            words = words[:]
            words[rng.randrange(len(words))] = f"x{group}{i}"
            docs.append((len(docs), " ".join(words)))
    written = []
    for module in (components, coordinate_join):
        plain = module.stored
        monkeypatch.setattr(module, "stored", lambda df, name, plain=plain: (written.append(name), plain(df, name))[1])
    out = coordinate_join.near_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.component_id for r in out if r.doc_id % 8 < 2} == {8 * g for g in range(12)}
    assert len(written) <= 28

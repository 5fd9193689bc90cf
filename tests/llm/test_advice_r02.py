"""Cases of the second review that the earlier tests could not notice."""

from __future__ import annotations

import os
import random
import sys
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

from tricklens.llm import disclosure, host_paths, queries, record_files, sorted_passes  # noqa: E402
from tricklens.llm.common import stored  # noqa: E402

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def keep(df):
    return stored(df, "test")


def test_addresses_with_zero_octets(spark):
    """Parts 0, 00 and 000 are valid; random addresses hold them as often as others."""
    rng = random.Random(11)
    parts = ["0", "00", "000", "10.0.0.1", "255", "0255", "256", "00256", ".", ".", ".", " ", "x", "7"]
    rows = [(0, "10.0.0.1"), (1, "at 192.168.0.1, 127.0.0.1 and 0.0.0.0"), (2, "00.000.0.00"), (3, "1.2.3.256")]
    rows += [(4 + i, "".join(rng.choices(parts, k=rng.randint(0, 40)))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = disclosure.spans_of(df, "text", keep).select("doc_id", F.filter("spans", lambda x: x["rank"] < 4).alias("base")).collect()
    got = {r.doc_id: brute.spelled((x.kind, x.s, x.e) for x in r.base) for r in out}
    assert got == {i: brute.spelled(brute.personal(t)) for i, t in rows}
    assert got[0] == "ip:0:8" and got[1].count("ip:") == 3 and got[2] == "ip:0:11" and got[3] == ""


def main_texts(spark, pages):
    df = spark.createDataFrame([(i, "http://h/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in host_paths.extracted(df).collect()}


def test_words_in_other_attributes_drop_nothing(spark):
    """'hidden' and 'id' count as whole attribute names only; headings and sections of the article keep their text."""
    attributes = (
        'style="overflow:hidden"', 'aria-hidden="false"', "data-hidden", 'title="hidden gem"', 'data-id="search-3"', "data-class='ad'", 'title="id=comments"',
        'title="a hidden b" id=x', 'title=" hidden "',
    )
    pages = [f"<body><article {a}><h1>Head</h1><div {a}><p {a}>{'text ' * 20}</p></div></article></body>" for a in attributes]
    inner = '<h2 id="related-work">Related work</h2><p>one</p><section id="social-impact"><p>two</p></section><section class="x" id="discussion"><h3>D</h3>three</section>'
    pages += [f"<body><article><h1>T</h1>{inner}</article></body>", f'<body><div class="story"><h1>T</h1><p>{"long " * 60}</p>{inner}</div></body>']
    out = main_texts(spark, pages)
    assert [out[i] for i in range(len(attributes))] == ["Head\n\n" + " ".join(["text"] * 20)] * len(attributes)
    assert out[len(attributes)] == "T\n\nRelated work\n\none\n\ntwo\n\nD\n\nthree"
    assert out[len(attributes) + 1] == "T\n\n" + " ".join(["long"] * 60) + "\n\nRelated work\n\none\n\ntwo\n\nD\n\nthree"


def test_hidden_parts_and_boilerplate_still_go(spark):
    parts = ("<div hidden>no</div>", "<div HIDDEN=''>no</div>", "<div aria-hidden='true'>no</div>", "<div class=x hidden/>no</div>", "<div id=comments>no</div>", '<p role="navigation">no</p>')
    aside = '<section class="comments"><p>no</p></section>'
    out = main_texts(spark, [f"<body>{aside}<article><p>yes {'word ' * 20}</p>{p}</article>{aside}</body>" for p in parts])
    assert set(out.values()) == {"yes " + " ".join(["word"] * 20)}


def test_sections_of_the_body_named_like_boilerplate_go(spark):
    out = main_texts(spark, ['<body><h1>A</h1><p>one two</p><section id="comments"><p>no</p></section></body>'])
    assert out[0] == "A\n\none two"


def test_a_path_of_any_rank_is_found(spark):
    """A page whose template ranks far behind is read by its template's container, as its other pages voted."""
    body = '<body><div class="story-{k}x"><p>{t}</p></div><div class="teaser-{k}x"><p>{u}</p></div></body>'
    names = ["".join(chr(97 + int(c)) for c in f"{k:03d}") for k in range(40)]
    pages = []
    for k, name in enumerate(names):
        pages += [body.format(k=name, t=f"story {name} {i} " * 30, u="more") for i in range(44 - k)]
        pages.append(body.format(k=name, t="short story", u="buy this " * 60))
    pages.append(pages[-1])
    out = main_texts(spark, pages)
    odd = [i for i, p in enumerate(pages) if "short story" in p]
    assert len(odd) == 41 and {out[i] for i in odd} == {"short story"}
    assert all(out[i].startswith("story ") for i in range(len(pages)) if i not in odd)
    assert host_paths.own_paths(host_paths.blocks(pages[0])) >= {"body", "body/div.story-aaax", "body/div.teaser-aaax"}


def test_record_files_encode_as_the_plain_library_call(spark, tmp_path):
    tokenizer = Tokenizer.from_file(BYTES)
    rows = [(0, "a <|endoftext|> b"), (1, "plain text"), (2, "<|endoftext|>"), (3, "x<|endoftext|><|endoftext|>y  z <|endoftext"), (4, None), (5, "plain text |> b")]
    folder = str(tmp_path)
    os.mkdir(f"{folder}/documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(f"file://{folder}/documents.parquet")
    start = 0
    for r, (i, text) in zip(sorted(queries.op7_record_files(spark, f"file://{folder}").collect(), key=lambda r: r.doc_id), rows):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert record_files.token_encoder(BYTES, False)[0](["a <|endoftext|> b"])[0].tolist() == [64, 220, 50256, 275]


def test_disclosing_terms_far_from_the_address(spark):
    """A name at the head and an address at the end: every mention of the name goes, common words and other documents stay."""
    common = "the quick report was sent by mail to all of the staff on monday "
    docs = [(i, f"Zebulon wrote. {common * 3}zebulon again. {common * 3} zeb@site.example") for i in range(3)]
    docs += [(10 + i, common * 2) for i in range(40)] + [(99, "zebulon without an address stays"), (100, f"once only {common} one@other.example")]
    docs.append((None, docs[0][1]))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r.doc_id: r.text for r in disclosure.sanitised(df, "text", keep).collect()}
    for i in (0, 1, 2, None):
        assert "zebulon" not in out[i].lower() and out[i].startswith("[NAME]") and out[i].count(common.strip()) == 6 and out[i].endswith("[EMAIL]")
    assert out[99] == "zebulon without an address stays" and out[10] == common * 2 and out[100] == f"once only {common} [EMAIL]"


def test_near_vectors_of_a_narrow_cone(spark, monkeypatch):
    """Vectors of one label at cosine 0.94 to each other need more passes than evenly spread ones; all planted pairs at 0.981 are found."""
    ran, keyed = [], sorted_passes.keyed
    monkeypatch.setattr(sorted_passes, "keyed", lambda first, passes, *rest: (ran.append(passes), keyed(first, passes, *rest))[1])
    rng = np.random.default_rng(3)
    n, dim, planted = 1500, 64, 100
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    near = unit(np.sqrt(0.94) * unit(rng.standard_normal(dim)) + np.sqrt(0.06) * unit(rng.standard_normal((n, dim))))
    aside = rng.standard_normal((planted, dim))
    aside = unit(aside - (aside * near[:planted]).sum(axis=1, keepdims=True) * near[:planted])
    vectors = np.concatenate([near, 0.981 * near[:planted] + np.sqrt(1 - 0.981**2) * aside])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    out = sorted_passes.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), window=8).collect()
    links = vectors @ vectors.T >= 0.98
    assert {r.vec_id: r.n_links for r in out} == {i: int(k) - 1 for i, k in enumerate(links.sum(axis=1))}
    assert sum(ran) > 2 * sorted_passes.passes_for(len(rows), 0.98, 8, sorted_passes.MISS)

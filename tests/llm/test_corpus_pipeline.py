"""The pipeline's stages, each on what its predecessor kept, against brute force."""

from __future__ import annotations

import os
import sys

import numpy as np
import public_tokenizers
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402

from tricklens.llm.common import stored, table  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_every_stage(spark):
    import sentencepiece

    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near-duplicates", "personal data", "source mixture", "token ids"]
    docs = table(spark, SF, "documents")
    steps = [docs.collect()]
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(stored(stage(spark, frames[-1], SF), "test-stage"))
        steps.append(frames[-1].collect())
    for f in frames[:-1]:
        assert f.columns == docs.columns
    start, good, first, private, mix, ids = steps

    failed = {r.doc_id for r in start if brute.quality_counts(r.text)["base_failed"]}
    clean = {r.doc_id for r in table(spark, SF, "labels").where("quality = 1").collect()} - failed
    assert not failed & {r.doc_id for r in good} and clean <= {r.doc_id for r in good}

    groups = brute.near_documents([(r.doc_id, r.text) for r in good])
    assert {r.doc_id for r in first} == {i for i, (_, c) in groups.items() if i == c}

    before = {r.doc_id: r.text for r in first}
    assert set(before) == {r.doc_id for r in private}
    for r in private:
        assert not brute.personal(r.text) and r.n_chars == len(r.text)
        assert brute.personal(before[r.doc_id]) or r.text == before[r.doc_id]

    whole = {r.doc_id: r for r in private}
    taken, sizes = {}, {}
    for r in private:
        sizes[r.source] = sizes.get(r.source, 0) + len(brute.WORD.findall(r.text))
    for r in mix:
        n = len(brute.WORD.findall(r.text))
        taken[r.source] = taken.get(r.source, 0) + n
        assert 0 < n <= len(brute.WORD.findall(whole[r.doc_id].text)) and r.source == whole[r.doc_id].source
    for s, target in brute.mix_targets(sizes).items():
        assert abs(taken.get(s, 0) - target) <= 128 + 0.01 * target

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((r.doc_id, np.array(sp.encode(r.text, add_eos=True), "<i4").tobytes()) for r in mix)
    assert sorted((r.doc_id, bytes(r.ids)) for r in ids) == want

"""The chunks between sure breaks that op7's encoder remembers: exact, and few."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tricklens.llm import record_files

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [
    "word", "Don't", "we'll", "x'really", "''s", "!'s", "'", "é", "ñandú", "×", "÷", " ", "\x85", " ", " ", "　", " ", " ", "à", "Å", "漢字", "😀", "٣",
    " ", "  ", "   ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x1f", "\x00", "\x7f", ",", ".", "...", "(", ")", "\"", "_", "-", "#$%", "7", "2024", "3a", "a3", "²", "</s>", "<|endoftext|>",
]


@pytest.mark.parametrize("as_text", [False, True])
def test_ids_are_the_librarys(as_text, monkeypatch):
    tokenizer = Tokenizer.from_file(BYTES)
    tokenizer.encode_special_tokens = as_text
    rng = random.Random(3)
    texts = ["", "a", " ", "é", "é a", "  a", "a  b", "à b\x85 c  d"] + ["".join(rng.choices(PARTS, k=rng.randint(1, 40))) for _ in range(4000)]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for memo in (record_files.MEMO, 20):  # 20: nearly nothing is remembered
        monkeypatch.setattr(record_files, "MEMO", memo)
        encode, _ = record_files.new_encoder(BYTES, as_text)
        for step in (len(texts), 7):
            got = [ids.tolist() for lo in range(0, len(texts), step) for ids in encode(texts[lo : lo + step])]
            assert got == want
    assert encode([]) == []


def test_a_word_is_encoded_once_whatever_mark_follows(monkeypatch):
    """Before, a word with each mark after it went to the tokenizer anew."""
    sent = []

    class Counting:
        def __init__(self, inner):
            self.__dict__["inner"] = inner

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def encode_batch_fast(self, texts, **options):
            sent.extend(texts)
            return self.inner.encode_batch_fast(texts, **options)

        encode_batch = encode_batch_fast

    real = Tokenizer.from_file(BYTES)
    monkeypatch.setattr("tokenizers.Tokenizer", type("Given", (), {"from_file": staticmethod(lambda path: Counting(real))}))
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdeé", k=8)) + "z" for _ in range(300)]
    texts = [" ".join(w + mark for w in words) for mark in ("", ",", ".", ";", ":", "!", "?", ")", '"', "7")]
    encode, _ = record_files.new_encoder(BYTES)
    assert [ids.tolist() for ids in encode(texts)] == [e.ids for e in real.encode_batch(texts, add_special_tokens=False)]
    assert sum(map(len, sent)) < 2 * sum(len(w) + 1 for w in words)


def test_rows_are_encoded_in_bounded_goes(monkeypatch):
    monkeypatch.setattr(record_files, "GO", 10)
    sizes = [0, 4, 6, 1, 25, 0, 10, 3]
    goes = list(record_files.gos(np.cumsum(sizes)))
    assert [i for lo, hi in goes for i in range(lo, hi)] == list(range(len(sizes)))
    assert all(sum(sizes[lo:hi]) <= 10 or hi == lo + 1 for lo, hi in goes) and len(goes) == 5
    assert list(record_files.gos(np.array([], np.int64))) == []

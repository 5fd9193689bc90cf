"""Blocks of anchors that go through cover trees together, against all scores; packed vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from tricklens.llm import cover_tree


def first(scores, ids, k):
    return sorted(zip((-scores).tolist(), ids.tolist()))[:k]


def table(rng, n, kind):
    """(ids, labels, vectors): spread out, in clusters with ties, of many rare labels, or longer than single precision holds."""
    ids, labels = rng.permutation(n).astype(np.int64), rng.integers(4, size=n)
    ids[: n // 50] = ids[n // 2 : n // 2 + n // 50]  # several rows of one id
    v = rng.normal(size=(n, 12))
    if kind == "clusters":
        v = rng.normal(size=(20, 12))[rng.integers(20, size=n)] + rng.choice([0.0, 0.02], size=(n, 1)) * v
    if kind == "rare labels":
        labels = np.where(rng.random(n) < 0.5, rng.integers(n // 5, size=n), n)
    if kind == "signs":
        v = np.sign(v[:, :3])  # a few scores, nearly all of them ties
    return ids, labels.astype(np.int64), np.floor((4000 if kind == "long" else 256 if kind != "signs" else 1) * v)


@pytest.mark.parametrize("kind", ["even", "clusters", "rare labels", "signs", "long"])
def test_blocks_against_all_scores(monkeypatch, kind):
    monkeypatch.setattr(cover_tree, "SEARCH_ROWS", 64)
    monkeypatch.setattr(cover_tree, "LEAF", 32)
    monkeypatch.setattr(cover_tree, "PRODUCT_ROWS", 48)
    rng = np.random.default_rng(7)
    ids, labels, v = table(rng, 3000, kind)
    anchors = np.sort(rng.choice(3000, 150, replace=False))
    anchors = anchors[np.argsort(labels[anchors], kind="stable")]
    own, of, q = ids[anchors], labels[anchors], v[anchors].copy()
    if kind == "even":
        q[3] *= 2.0**34  # its sums need Python's integers
    shards = [cover_tree.Shard(ids[s], labels[s], v[s]) for s in (slice(0, 1300), slice(1300, 1310), slice(1310, 3000))]
    none = np.zeros((150, 1), np.int64)
    same = cover_tree.Searches(own, of, q, none + cover_tree.LONG[0], none + cover_tree.LONG[1], 5)
    top = (np.sort(q @ v.T, axis=1)[:, [-1, -4, -60, -1500]] * 0.999).astype(np.int64)
    low = np.where(top > 0, top * 4 // 5, top)
    low[:, 3] = np.where(rng.random(150) < 0.5, top[:, 3] + 1, low[:, 3])  # some windows that take nothing
    other = cover_tree.Searches(own, of, q, low, top, 3)
    for shard in shards:
        same.same_labels(shard)
        other.other_labels(shard)
    for r in range(150):
        scores = np.array(cover_tree.products(v, q[r]))
        mine = (labels == of[r]) & (ids != own[r])
        assert list(zip((-same.scores[r, 0, : same.n[r, 0]]).tolist(), same.ids[r, 0].tolist())) == first(scores[mine], ids[mine], 5)
        for w in range(4):
            in_window = (labels != of[r]) & (ids != own[r]) & (scores >= low[r, w]) & (scores <= top[r, w])
            assert list(zip((-other.scores[r, w, : other.n[r, w]]).tolist(), other.ids[r, w].tolist())) == first(scores[in_window], ids[in_window], 3)
    # A leaf is met by all anchors that go down the tree together, not by one after the other.
    leaves = sum(r is not None for s in shards for _, _, tree in s.trees.values() for r in tree.rows)
    assert 0 < len(other.met) + len(shards) <= 3 * leaves + len(shards)


def test_huge_anchors_meet_zero_vectors():
    shard = cover_tree.Shard(np.arange(300), np.ones(300, int), np.zeros((300, 4)))
    assert cover_tree.Search(shard, 7, np.array([1e200, 0.0, 0.0, 0.0])).best([1], 3) == [(0, 0), (0, 1), (0, 2)]


def test_packed_vectors_come_back():
    rows = [[1.0, -2.0], [3.0, 32767.0], [], [5.0], [2.0**60, -1.0], [-32768.0, 7.0]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array(rows, pa.list_(pa.float64()))], names=["vec_id", "v"])
    found = {}
    for given in (batch.slice(0, 4), batch.slice(4), batch.slice(1, 3)):
        for part in cover_tree.packing(iter([given])):
            for piece in (part, part.slice(part.num_rows - 1)):
                found |= dict(zip(piece["vec_id"].to_pylist(), cover_tree.vectors_of([piece]).tolist()))
    assert found == dict(enumerate(rows))

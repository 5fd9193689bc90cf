"""The parts of a sorted pass against plain versions of them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest

from tricklens.llm import sorted_passes as sp

NAMES = ["pass", "label", "dim", "key", "node", "sketch"]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def sorted_rows(rng, passes: int, dims=(8, 16)) -> tuple[list[tuple], dict]:
    vectors = {}
    for dim in dims:
        for label in ("a", "b"):
            centres = unit(rng.standard_normal((12, dim)))
            for v in unit(np.repeat(centres, 15, axis=0) + 0.05 * rng.standard_normal((180, dim))):
                vectors[len(vectors)] = (label, v)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([l for l, _ in vectors.values()]), pa.array(list(vectors)), pa.array([v.tobytes() for _, v in vectors.values()], pa.binary())], ["label", "node", "unit"]
    )
    rows = [r for b in sp.keyed(0, passes, 5)(iter([batch])) for r in zip(*(b.column(c).to_pylist() for c in NAMES))]
    return sorted(rows, key=lambda r: (r[0], r[2], r[1], r[3], r[4])), vectors


def roots(n: int, pairs) -> list[int]:
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("size", [1, 7, 64, 500, 10_000])
def test_windows_do_not_depend_on_batches(size):
    """The same links come from any batches: those of all pairs within the window, unsure ones told by their vectors."""
    rows, vectors = sorted_rows(np.random.default_rng(1), 2)
    if size == 1:
        rows = rows[:300]
    kinds = (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + size]), kinds)], NAMES) for i in range(0, len(rows), size)]
    empty = pa.RecordBatch.from_arrays([pa.array([], k) for k in kinds], NAMES)
    out = [r for b in sp.neighbours(0.98, 8, 5)(iter([empty, *batches])) for r in zip(*(b.column(c).to_pylist() for c in ("a", "b", "sure", "miss")))]
    near = lambda a, b: vectors[a][1] @ vectors[b][1] >= 0.98
    want = [(r[4], s[4]) for i, r in enumerate(rows) for s in rows[i + 1 : i + 9] if r[:3] == s[:3] and near(r[4], s[4])]
    got = [(a, b) for a, b, sure, _ in out if b is not None and (sure or near(a, b))]
    assert want and roots(len(vectors), got) == roots(len(vectors), want)
    told = [(a, miss) for a, b, _, miss in out if b is None]
    assert len(told) <= len(rows) and all(miss <= 0 for _, miss in told)


def test_equal_keys_at_the_edges_tell_nothing():
    """Rows of a group that a partition's edge may cut, on both sides, do not count as seen."""
    rows, _ = sorted_rows(np.random.default_rng(2), 1, (16,))
    rows = [r for r in rows if r[1] == "a"][:10]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], NAMES)
    out = [r for b in sp.neighbours(0.98, 16, 5)(iter([batch])) for r in zip(b.column("b").to_pylist(), b.column("miss").to_pylist())]
    assert not [miss for b, miss in out if b is None]


def test_sketches_stay_within_their_error():
    rng = np.random.default_rng(3)
    for dim in (1, 3, 64, 1024):
        a = unit(rng.standard_normal((300, dim)))
        b = unit(a + 0.1 * rng.standard_normal((300, dim)) / math.sqrt(dim))
        sketch = lambda x: (np.rint(x * sp.STEPS).astype(np.int16).astype(np.float32) / sp.STEPS)
        assert (np.abs((sketch(a) * sketch(b)).sum(axis=1) - (a * b).sum(axis=1)) <= sp.sketch_error(dim)).all()


def test_shared_bits():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a, bits = int(rng.integers(-(2**63), 2**63 - 1)), int(rng.integers(0, 65))
        b = a if bits == 64 else (a ^ (1 << (63 - bits))) if bits else ~a
        b = b - 2**64 if b >= 2**63 else b + 2**64 if b < -(2**63) else b
        spelled = [format(x & (2**64 - 1), "064b") for x in (a, b)]
        want = next((i for i in range(64) if spelled[0][i] != spelled[1][i]), 64)
        assert sp.shared_bits(np.array([a]), np.array([b]))[0] == want


def test_found_chance_is_that_of_random_neighbours():
    """The chance told is the share of random vectors at the threshold that lie between the window's ends."""
    rng = np.random.default_rng(5)
    dim, ahead, behind, threshold = 32, 6, 3, 0.98
    planes = sp.planes_of(5, dim, 0)
    for _ in range(3):
        v = unit(rng.standard_normal(dim))
        aside = rng.standard_normal((40_000, dim))
        u = threshold * v + math.sqrt(1 - threshold**2) * unit(aside - (aside @ v)[:, None] * v)
        key = lambda x: np.packbits(x @ planes > 0, axis=-1).view(">i8").ravel().astype(np.int64)
        own, keys = key(v), key(u)
        shared = sp.shared_bits(np.full(len(keys), own[0]), keys)
        want = np.where(keys >= own[0], shared >= ahead, shared >= behind).mean()
        got = sp.found_chance(v[None], planes, threshold, own, np.array([ahead]), np.array([behind]))[0]
        assert abs(got - want) < 0.03

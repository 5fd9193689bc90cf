"""Hard negatives by cover trees over norm-augmented candidates.

Scores are inner products. Candidates get one coordinate more,
sqrt(R^2 - |x|^2), so that all lie on a sphere of radius R (the longest
candidate's length), and queries a zero there: inner products stay, and the
angle between a query and a candidate decides. Each shard of candidates is
covered level by level: a node keeps its centre as first child's centre, further centres
are the points farthest from those taken, until half the node's radius covers
its points (or ``FANOUT`` centres are taken, fewer where few rows are left). Every node stores the true radius
that covers its points, so for a query q and a node at angle t with angular radius u
all its scores lie between |q| R cos(t + u) and |q| R cos(t - u).

A search wants the best ``k`` scores inside a window [low, high], for each of
many anchors and windows at once. The anchors go down a tree together: nodes outside
all their windows or below what they have found are skipped, the leaves
left are met in order of their upper bounds by those anchors that still need them, and
verified exactly, as one product of matrices (in single precision where
that holds every sum exactly). Bounds are widened by ``SLACK`` so that
rounding never skips a node that counts. What is found goes along from shard to shard.

Spark deals the candidates to slots by a hash of their id and meets every
slot with every block of anchors (a stated query set against all rows, in
blocks): once for the positives, once with the windows that these give. A task
holds one block (at most about ``ANCHOR_ROWS`` anchors) and takes it through the
slot's candidates shard by shard (``SHARD_ROWS`` rows); only its best k of a window leave it. Of candidates
with the same label and vector only the k + 1 smallest ids can ever be among
the best k, so the others leave before the shuffle (they stay anchors);
a vector that fills a third of the table costs no more than any other.

Defined results: rows with a null id, label or vector, or a null or non-finite
component take no part, nor do those that scaling makes infinite; rows that repeat an id, label and vector count once,
other rows of one id each count, and a row never meets rows of its own id;
vectors meet only those of their own length; an anchor without other rows of
its label has no rows; an empty table gives an empty result. Scores are exact;
one beyond a long counts as the nearest long. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS, ANCHOR_ROWS = 1 << 16, 1 << 18
SLOT_SHARDS = 16  # shards that one task takes its anchors through, at most
SLOTS_PER_CORE = 3
LEAST_ROWS = 512  # a slot below this is not worth a task
SEARCH_ROWS = 2048  # anchors that go down a tree together
FANOUT, LEAF = 32, 256
PRODUCT_ROWS = 256  # a matrix product has this many rows at a time, where it can; odd numbers are slower
SLACK = 1e-6
EXACT, EXACT_SINGLE = 2.0**53, 2.0**24
LONG = (-(2**63), 2**63 - 1)
POSITIVES, NEGATIVES = 5, 5  # per anchor; per anchor and positive
LOW_PERCENT, HIGH_PERCENT = 80, 100  # of the positive's score


def usable(rows: DataFrame, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, each once; ``v`` holds floor(scale * x) of the components, as doubles."""
    whole = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()
    scaled = F.transform(F.col(vector), lambda c: c.cast("double") * scale)
    rows = rows.where(whole).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), scaled.alias("x"))
    rows = rows.where(~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    # A double from 2^53 on is whole already; floor() would make a long of it.
    floored = F.transform("x", lambda c: F.when(F.abs(c) >= EXACT, c).otherwise(F.floor(F.when(F.abs(c) < EXACT, c)).cast("double")))
    return rows.select("vec_id", "label", floored.alias("v")).distinct()


class CoverTree:
    """Levels of nodes over the rows of ``v``: a centre, the radius that covers the node's rows, children or a leaf's rows."""

    def __init__(self, v: np.ndarray):
        norms = np.einsum("ij,ij->i", v, v)
        self.sphere = float(np.sqrt(norms.max(initial=0.0)))
        self.largest = float(np.abs(v).max(initial=0.0))
        single = max(1.0, self.sphere) ** 2 <= EXACT_SINGLE
        kept = v.astype(np.float32) if single else v  # sums of products are exact in either
        lift = np.sqrt(np.maximum(self.sphere**2 - norms, 0.0))
        centre, radius, self.children, self.rows = [], [], [], []
        open_nodes = [(np.arange(len(v)), None)]
        while open_nodes:
            rows, parent = open_nodes.pop()
            node = len(centre)
            own = (kept[rows], norms[rows], lift[rows])
            nearest = self._away(*own, 0)
            centre.append(rows[0])
            radius.append(nearest.max(initial=0.0))
            self.children.append([])
            leaf = len(rows) <= LEAF or radius[node] == 0.0
            self.rows.append(rows if leaf else None)
            if parent is not None:
                self.children[parent].append(node)
            if not leaf:
                open_nodes += [(part, node) for part in self._split(own, rows, nearest)]
        leaves = [r for r in self.rows if r is not None]
        #: The rows leaf by leaf, and where each leaf begins.
        self.order, self.begins = np.concatenate(leaves), np.zeros(len(centre), np.int64)
        self.begins[[n for n, r in enumerate(self.rows) if r is not None]] = np.cumsum([0, *map(len, leaves[:-1])])
        self.v = kept[self.order]
        self.centres, self.centre_rows = v[centre], np.array(centre)
        chord = np.array(radius) / (2 * self.sphere) if self.sphere else np.zeros(len(radius))
        self.angle = 2 * np.arcsin(np.minimum(chord, 1.0))

    @staticmethod
    def _away(v: np.ndarray, norms: np.ndarray, lift: np.ndarray, row: int) -> np.ndarray:
        """How far all rows lie from one of them on the sphere."""
        apart = norms + norms[row] - 2.0 * (v @ v[row]).astype(np.float64)
        return np.sqrt(np.maximum(apart, 0.0) + (lift - lift[row]) ** 2)

    @staticmethod
    def _split(own: tuple[np.ndarray, np.ndarray, np.ndarray], rows: np.ndarray, nearest: np.ndarray) -> list[np.ndarray]:
        """The rows of each child, its centre first: the farthest row becomes a centre until half the radius covers all."""
        goal, owner, centres = nearest.max() / 2, np.zeros(len(rows), np.int64), [0]
        most = min(FANOUT, 2 * -(-len(rows) // LEAF))
        while len(centres) < most and nearest.max() > goal:
            far = int(nearest.argmax())
            away = CoverTree._away(*own, far)
            owner[away < nearest] = len(centres)
            owner[far] = len(centres)
            nearest = np.minimum(nearest, away)
            centres.append(far)
        parts = []
        for k, c in enumerate(centres):
            mine = np.flatnonzero(owner == k)
            parts.append(rows[np.concatenate([[c], mine[mine != c]])])
        return parts

    def bounds_of(self, nodes: Sequence[int] | slice, queries: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(low, high) that hold all scores of the rows of each of ``nodes``, and its centre's score, for each query."""
        scores, most = self.centres[nodes] @ queries.T, lengths * self.sphere
        cos = np.clip(scores / np.where(most > 0.0, most, 1.0), -1.0, 1.0)
        sin = np.sqrt(1.0 - cos * cos)
        cos_u, sin_u = np.cos(self.angle[nodes])[:, None], np.sin(self.angle[nodes])[:, None]
        low = np.where(cos < -cos_u, -1.0, cos * cos_u - sin * sin_u) - SLACK
        high = np.where(cos > cos_u, 1.0, cos * cos_u + sin * sin_u) + SLACK
        return most * low, most * high, scores

    def bounds(self, q: np.ndarray) -> tuple[list[float], list[float]]:
        """Per node, (low, high) that hold all scores of its rows."""
        low, high, _ = self.bounds_of(slice(None), q[None, :], np.sqrt(q @ q)[None])
        return low[:, 0].tolist(), high[:, 0].tolist()


class Shard:
    """The candidates of one shard: a tree per label, searched together."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray):
        self.trees, rare = {}, []
        order = np.lexsort((ids, labels))
        cuts = np.flatnonzero(np.diff(labels[order])) + 1
        for own in np.split(order, cuts) if len(order) else []:
            label, vectors = int(labels[own[0]]), v[own].astype(np.float64, copy=False)
            # Rows too long for exact float products are not covered but verified on Python's integers.
            tree = CoverTree(vectors) if exact(vectors, vectors) else None
            self.trees[label] = (ids[own], vectors, tree) if tree is None else (ids[own[tree.order]], None, tree)
            if tree is not None and len(own) <= LEAF // 2:
                rare.append(label)
        #: Labels of few rows, side by side: (labels, ids and label of each row, vectors) of some of them.
        self.bundles = []
        many = len(rare) > 1 and len({self.trees[x][2].v.dtype for x in rare}) == 1
        sizes = np.cumsum([len(self.trees[x][0]) for x in rare]) // LEAF if many else []
        for k in np.unique(sizes):
            some = [x for x, size in zip(rare, sizes) if size == k]
            parts = [self.trees[x] for x in some]
            whose = np.repeat(some, [len(ids) for ids, _, _ in parts])
            self.bundles.append((some, np.concatenate([ids for ids, _, _ in parts]), whose, np.concatenate([t.v for _, _, t in parts])))


class Searches:
    """A block of anchors, the windows of each, and the first ``k`` (score, id) that every window has met so far.

    ``low`` and ``high``: anchors x windows; a window whose low is above its
    high takes nothing. Anchors never meet rows of their own id.
    """

    def __init__(self, own: np.ndarray, labels: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        self.own, self.labels, self.low, self.high, self.k = own, labels, low, high, k
        self.largest = np.abs(q).max(axis=1, initial=0.0)
        self.q = q.astype(np.float32, copy=False) if self.largest.max(initial=0.0) <= EXACT_SINGLE else q
        with np.errstate(over="ignore"):  # anchors that long meet rows on Python's integers
            self.lengths = np.sqrt(np.einsum("ij,ij->i", q, q, dtype=np.float64))
        self.floor = low.copy()  # what lies below cannot be among the first k
        self.n = np.zeros(low.shape, np.int64)
        self.scores, self.ids = np.full((*low.shape, k), LONG[0]), np.full((*low.shape, k), LONG[1])
        self.news: list[tuple] = []  # what note() was told
        self.waiting = 0
        self.room = np.empty(0, np.float32)
        self.met: list[tuple[int, int]] = []  # (label, leaf)

    def needs(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per anchor: the least score that counts, and the id from which that score itself does not."""
        open_ = self.low[at] <= self.high[at]
        least = np.where(open_, self.floor[at], LONG[1])
        need = least.min(axis=1)
        last = np.where(self.n[at] == self.k, self.ids[at, :, -1], LONG[1])
        sure = np.where(self.n[at] == self.k, self.scores[at, :, -1], LONG[0]) >= least
        beyond = np.where(least > need[:, None], LONG[0], np.where(sure, last, LONG[1]))
        return need, beyond.max(axis=1)

    def lift(self, at: np.ndarray, scores: np.ndarray, hidden: np.ndarray) -> None:
        """Raises the floors to the k-th of these scores; ``hidden`` ones do not count."""
        if scores.shape[1] < self.k:
            return
        for w in range(self.low.shape[1]):
            inside = np.where(hidden | (scores > self.high[at, w, None]), -np.inf, scores)
            kth = np.partition(inside, -self.k, axis=1)[:, -self.k].astype(np.float64)
            good = kth > self.floor[at, w]
            self.floor[at[good], w] = kth[good].astype(np.int64)

    def take(self, at: np.ndarray, scores: np.ndarray, least: np.ndarray, ids: np.ndarray, whose: np.ndarray | None) -> None:
        """Notes of the scores (anchors x rows) those that some window may need."""
        hits = scores >= least[:, None]
        if np.count_nonzero(hits) <= 8 * self.k * len(at):
            a, c = np.nonzero(hits)
            self.note(at[a], scores[a, c], ids[c], None if whose is None else whose[c])
            return
        # Each window's own bounds are worth their passes.
        hidden = ids[None, :] == self.own[at][:, None]
        if whose is not None:
            hidden |= whose[None, :] == self.labels[at][:, None]
        short = (self.n[at] < self.k).any(axis=1)
        if short.any():
            self.lift(at[short], scores[short], hidden[short])
        for w in range(self.low.shape[1]):
            low, high = (x[at, w, None].astype(scores.dtype) for x in (self.floor, self.high))
            a, c = np.nonzero((scores >= low) & (scores <= high) & ~hidden)
            self.note(at[a], scores[a, c], ids[c], None, w)

    def note(self, a: np.ndarray, scores: np.ndarray, ids: np.ndarray, whose: np.ndarray | None = None, window: int | None = None) -> None:
        self.news.append((a, scores, ids, whose, window))
        self.waiting += len(a)

    def wanted(self, a: np.ndarray, scores: np.ndarray, ids: np.ndarray, whose: np.ndarray | None, window: int | None) -> tuple[np.ndarray, ...]:
        """(anchor's window, score, id) of what counts among the noted."""
        scores, kept = scores.astype(np.int64, copy=False)[:, None], slice(None) if window is None else slice(window, window + 1)
        floor, high, n, last, last_id = self.floor[a, kept], self.high[a, kept], self.n[a, kept], self.scores[a, kept, -1], self.ids[a, kept, -1]
        keep = (scores >= floor) & (scores <= high) & ((n < self.k) | (scores > last) | ((scores == last) & (ids[:, None] < last_id)))
        keep &= (ids != self.own[a])[:, None]
        if whose is not None:
            keep &= (whose != self.labels[a])[:, None]
        i, w = np.nonzero(keep)
        return a[i] * self.low.shape[1] + w + (window or 0), scores[i, 0], ids[i]

    def settle(self) -> None:
        """Puts what was noted among the first ``k``."""
        if not self.news:
            return
        news, self.news, self.waiting = self.news, [], 0
        key, scores, ids = (np.concatenate(x) for x in zip(*(self.wanted(*x) for x in together(news))))
        keys, key = np.unique(key, return_inverse=True)
        n, all_scores, all_ids = self.n.reshape(-1), self.scores.reshape(-1, self.k), self.ids.reshape(-1, self.k)
        old = np.arange(self.k) < n[keys][:, None]
        key = np.concatenate([np.nonzero(old)[0], key])
        scores, ids = np.concatenate([all_scores[keys][old], scores]), np.concatenate([all_ids[keys][old], ids])
        order = np.lexsort((ids, ~scores, key))
        key, scores, ids = key[order], scores[order], ids[order]
        counts = np.bincount(key, minlength=len(keys))
        rank = np.arange(len(key)) - np.repeat(np.cumsum(counts) - counts, counts)
        first = rank < self.k
        key, rank = keys[key[first]], rank[first]
        all_scores[key, rank], all_ids[key, rank] = scores[first], ids[first]
        n[keys] = np.minimum(counts, self.k)
        floor, full = self.floor.reshape(-1), keys[n[keys] == self.k]
        floor[full] = np.maximum(floor[full], all_scores[full, -1])

    def verify(self, at: np.ndarray, queries: np.ndarray, need: tuple[np.ndarray, np.ndarray], v: np.ndarray, ids: np.ndarray, whose: np.ndarray | None = None) -> None:
        """Meets the anchors ``at`` with the rows of a leaf."""
        if self.room.dtype != queries.dtype or self.room.size < len(at) * len(v):
            self.room = np.empty(max(len(at) * len(v), SEARCH_ROWS * PRODUCT_ROWS), queries.dtype)
        scores = np.matmul(queries, v.T, out=self.room[: len(at) * len(v)].reshape(len(at), len(v)))
        least = (need[0] + ((ids.min() > need[1]) & (need[0] < LONG[1]))).astype(scores.dtype)
        hit = np.flatnonzero(scores.max(axis=1) >= least)
        if len(hit):
            self.take(at[hit], scores if len(hit) == len(at) else scores[hit], least[hit], ids, whose)

    def inexact(self, at: np.ndarray, v_largest: float) -> np.ndarray:
        """Whether float64 sums of products with rows of such components may be inexact."""
        with np.errstate(over="ignore"):
            return self.largest[at] * v_largest * max(1, self.q.shape[1]) >= EXACT

    def queries(self, at: np.ndarray, v_largest: float, v_length: float) -> np.ndarray:
        """The anchors' vectors, in single precision where it holds all sums with such rows exactly."""
        longest = max(1.0, float(self.lengths[at].max(initial=0.0))) * max(1.0, v_length)
        single = longest <= EXACT_SINGLE and self.largest[at].max(initial=0.0) <= EXACT_SINGLE and v_largest <= EXACT_SINGLE
        return self.q[at].astype(np.float32 if single else np.float64, copy=False)

    def through(self, at: np.ndarray, label: int, ids: np.ndarray, v: np.ndarray | None, tree: CoverTree | None) -> None:
        """Takes the anchors ``at`` through the tree of a label."""
        slow = np.ones(len(at), bool) if tree is None else ~np.isfinite(self.lengths[at]) | self.inexact(at, tree.largest)
        for a in at[slow].tolist():
            scores = np.array([min(max(s, LONG[0]), LONG[1]) for s in products(v if tree is None else tree.v, self.q[a])], np.int64)
            self.note(np.full(len(ids), a), scores, ids)
            self.settle()
        at = at[~slow]
        if not len(at):
            return
        lengths, exactly = self.lengths[at], self.q[at].astype(np.float64, copy=False)
        need, cap = self.needs(at), np.where(self.low[at] <= self.high[at], self.high[at], LONG[0]).max(axis=1).astype(np.float64)
        nodes, leaves, highs, centre_scores = [0], [], [], []
        while nodes:
            low, high, scores = tree.bounds_of(nodes, exactly, lengths)
            high[low > cap] = -np.inf
            wanted, below = (high >= need[0].astype(np.float64)).any(axis=1), []
            for i, node in enumerate(nodes):
                if wanted[i] and tree.rows[node] is None:
                    below += tree.children[node]
                elif wanted[i]:
                    leaves.append(node)
                    highs.append(high[i])
                    centre_scores.append(scores[i])
            nodes = below
        new = (self.n[at] == 0).all(axis=1)
        if len(leaves) > self.k and new.any():
            centre_ids = ids[tree.begins[leaves]]  # the centre is a leaf's first row
            self.lift(at[new], np.column_stack([x[new] for x in centre_scores]), centre_ids[None, :] == self.own[at[new]][:, None])
            need = self.needs(at)
        queries = self.queries(at, tree.largest, tree.sphere)
        rows = tree.v.astype(queries.dtype, copy=False)
        pile = np.empty(0, np.int64)  # rows of leaves that nearly all need, for products of PRODUCT_ROWS

        def meet(own: np.ndarray, active: np.ndarray | None = None) -> None:
            nonlocal need
            if active is None:
                self.verify(at, queries, need, rows[own], ids[own])
            else:
                self.verify(at[active], queries[active], (need[0][active], need[1][active]), rows[own], ids[own])
            if self.waiting >= len(at):
                self.settle()
                need = self.needs(at)

        for i in np.argsort([-h.mean() for h in highs], kind="stable").tolist() if leaves else []:
            active = np.flatnonzero(highs[i] >= need[0])
            if not len(active):
                continue
            own = np.arange(tree.begins[leaves[i]], tree.begins[leaves[i]] + len(tree.rows[leaves[i]]))
            self.met.append((label, leaves[i]))
            if 10 * len(active) < 9 * len(at):
                meet(own, active)
                continue
            pile = np.concatenate([pile, own])
            while len(pile) >= PRODUCT_ROWS:
                meet(pile[:PRODUCT_ROWS])
                pile = pile[PRODUCT_ROWS:]
        if len(pile):
            meet(pile)
        self.settle()

    def same_labels(self, shard: Shard) -> None:
        """Takes each anchor through the tree of its label; anchors stand in order of their labels."""
        for part in np.split(np.arange(len(self.labels)), np.flatnonzero(np.diff(self.labels)) + 1):
            if len(part) and int(self.labels[part[0]]) in shard.trees:
                label = int(self.labels[part[0]])
                for begin in range(0, len(part), SEARCH_ROWS):
                    self.through(part[begin : begin + SEARCH_ROWS], label, *shard.trees[label])

    def other_labels(self, shard: Shard) -> None:
        """Takes each anchor through the trees of the other labels."""
        for begin in range(0, len(self.labels), SEARCH_ROWS):
            at = np.arange(begin, min(begin + SEARCH_ROWS, len(self.labels)))
            bundled: set[int] = set()
            for labels, ids, whose, v in shard.bundles:
                largest, length = (max(getattr(shard.trees[x][2], name) for x in labels) for name in ("largest", "sphere"))
                if not (self.inexact(at, largest) | ~np.isfinite(self.lengths[at])).any():
                    queries = self.queries(at, largest, length)
                    self.verify(at, queries, self.needs(at), v.astype(queries.dtype, copy=False), ids, whose)
                    self.settle()
                    bundled |= set(labels)
            for label, tree in shard.trees.items():
                if label not in bundled:
                    others = at[self.labels[at] != label]
                    if len(others):
                        self.through(others, label, *tree)


def together(news: list[tuple]) -> Iterator[tuple]:
    """The small notes that are alike, joined."""
    plain = [x for x in news if x[3] is None and x[4] is None]
    if plain:
        yield tuple(np.concatenate([x[i] for x in plain]) for i in range(3)) + (None, None)
    yield from (x for x in news if x[3] is not None or x[4] is not None)


class Search:
    """One anchor's searches in a shard."""

    def __init__(self, shard: Shard, own_id: int, q: np.ndarray):
        self.shard, self.own_id, self.q = shard, own_id, q
        self.kept_scores: set[tuple[int, int]] = set()  # (label, leaf) of the leaves that were verified

    def best(self, labels: Iterable[int], k: int, low: int = LONG[0], high: int = LONG[1]) -> list[tuple[int, int]]:
        """The first ``k`` (score, id) of the labels' rows with low <= score <= high, by score, then smaller id."""
        own, window = np.array([self.own_id]), (np.array([[low]]), np.array([[high]]))
        search = Searches(own, np.zeros(1, np.int64), self.q[None, :], *window, k)
        for label in labels:
            search.through(np.zeros(1, np.int64), label, *self.shard.trees[label])
        self.kept_scores |= set(search.met)
        return list(zip(search.scores[0, 0, : search.n[0, 0]].tolist(), search.ids[0, 0, : search.n[0, 0]].tolist()))


def exact(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether float64 sums of products of the rows are exact integers."""
    return float(np.abs(a).max(initial=0.0)) * float(np.abs(b).max(initial=0.0)) * max(1, a.shape[1]) < EXACT


def products(v: np.ndarray, q: np.ndarray) -> list[int]:
    """Inner products on Python's integers, for components of any size."""
    whole = [int(x) for x in q]
    return [sum(int(x) * y for x, y in zip(row, whole)) for row in v]


def matrix(vectors: pa.ListArray) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64, copy=False).reshape(len(vectors), -1) if len(flat) else np.zeros((len(vectors), 0))


def packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``v`` of each row as bytes, ``width`` bytes a component: the shortest type that holds all of a batch's vectors of that length."""
    for batch in batches:
        sizes = pc.list_value_length(batch["v"]).to_numpy()
        for size in np.unique(sizes).tolist():
            rows = batch.filter(pa.array(sizes == size))
            v = matrix(rows["v"])
            kind = np.int16 if (np.abs(v) < 2**15).all() else np.float64
            ends = np.arange(len(v) + 1) * (size * np.dtype(kind).itemsize)
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(v), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(v.astype(kind).tobytes())])
            given = {"v": packed.cast(pa.binary()), "dimensions": pa.array(np.full(len(v), size, np.int32)), "width": pa.array(np.full(len(v), np.dtype(kind).itemsize, np.int32))}
            names = [n for n in rows.schema.names if n != "v"]
            yield pa.RecordBatch.from_arrays([*(rows[n] for n in names), *given.values()], names=[*names, *given])


def packed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``v`` as bytes, and with its number of ``dimensions`` and each one's ``width``."""
    kinds = [f"{n} {kind}" for n, kind in rows.dtypes if n != "v"]
    return rows.mapInArrow(packing, ", ".join([*kinds, "v binary", "dimensions int", "width int"]))


def column(batches: Sequence[pa.RecordBatch], name: str) -> np.ndarray:
    return np.concatenate([b[name].to_numpy(zero_copy_only=False) for b in batches])


def vectors_of(batches: Sequence[pa.RecordBatch]) -> np.ndarray:
    """The vectors of ``packed`` rows of one number of dimensions, as floats that hold them; those of one batch have one width."""
    out = []
    for b in batches:
        wide, kind = b["dimensions"][0].as_py(), {2: np.int16, 8: np.float64}[b["width"][0].as_py()]
        own = b["v"]
        begin = np.frombuffer(own.buffers()[1], np.int64 if pa.types.is_large_binary(own.type) else np.int32)[own.offset] if wide else 0
        flat = np.frombuffer(own.buffers()[2], np.uint8)[begin : begin + len(own) * wide * np.dtype(kind).itemsize] if wide else np.empty(0, np.uint8)
        out.append(flat.view(kind).reshape(len(own), wide).astype(np.float32 if kind is np.int16 else np.float64))
    return np.concatenate(out)


def runs(batches: Iterable[pa.RecordBatch], names: Sequence[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Neighbouring rows of one batch with the same values of ``names``, and these values."""
    for batch in batches:
        if batch.num_rows:
            keys = np.column_stack([batch[n].to_numpy() for n in names])
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for begin, end in pairwise([0, *cuts.tolist(), batch.num_rows]):
                yield tuple(keys[begin].tolist()), batch.slice(begin, end - begin)


def meeting(begin: Callable[[list[pa.RecordBatch]], tuple], schema: pa.Schema, shard_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task of a slot: its block's anchors come first, then candidates, met shard by shard.

    ``begin`` makes of the anchors what takes one shard, and what gives the results in the end.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, anchors, waiting, rows, act = None, [], [], 0, None
        np.matmul(np.ones((1024, 64), np.float32), np.ones((64, 1024), np.float32))  # until a larger product was made, OpenBLAS takes up to 1.7 times as long for small ones

        def shard() -> None:
            nonlocal waiting, rows
            if waiting:
                act[0](Shard(column(waiting, "vec_id"), column(waiting, "label"), vectors_of(waiting)))
            waiting, rows = [], 0

        def results() -> Iterator[pa.RecordBatch]:
            if act:
                shard()
                for columns in act[1]():
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

        for (*key, kind, _), batch in runs(batches, ["slot", "dimensions", "kind", "width"]):
            if key != at:
                yield from results()
                at, anchors, act = key, [], None
            if kind == 0:
                anchors.append(batch)
                continue
            if anchors:
                act, anchors = begin(anchors), []
            while act and batch.num_rows:
                waiting.append(batch.slice(0, shard_rows - rows))
                batch = batch.slice(waiting[-1].num_rows)
                rows += waiting[-1].num_rows
                if rows == shard_rows:
                    shard()
        yield from results()

    return task


def met(candidates: DataFrame, anchors: DataFrame, slots: int, blocks: int, begin, names: Sequence[str]) -> DataFrame:
    """Every slot of the candidates with every block of the anchors, each pair in a task of its own."""
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    given = "array<struct<vec_id:bigint,score:bigint>>"
    own = F.col("positives") if "positives" in anchors.columns else F.lit(None).cast(given)
    names_of = ["vec_id", "label", "v", "dimensions", "width"]
    left = candidates.select(F.lit(1).alias("kind"), *names_of, F.lit(None).cast("long").alias("anchor_row"), F.lit(None).cast(given).alias("positives"), dealt("vec_id", slots).alias("s"), each(blocks).alias("b"))
    right = anchors.select(F.lit(0).alias("kind"), *names_of, "anchor_row", own.alias("positives"), dealt("anchor_row", blocks).alias("b"), each(slots).alias("s"))
    rows = left.unionByName(right).withColumn("slot", (F.col("s") * blocks + F.col("b")).cast("int")).drop("s", "b")
    rows = rows.repartitionById(slots * blocks, F.col("slot")).sortWithinPartitions("slot", "dimensions", "kind", "width")
    schema = pa.schema([(n, pa.int64()) for n in names])
    return rows.mapInArrow(meeting(begin, schema, SHARD_ROWS), ", ".join(f"{n} long" for n in names))


def windows(positives: Sequence[pa.ListArray], low_percent: int, high_percent: int) -> tuple[np.ndarray, ...]:
    """Per anchor, its positives' ids and scores, and the window that each gives: anchors x positives, low above high where there is none."""
    sizes = np.concatenate([pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in positives])
    flat = [x.flatten() for x in positives]
    shape = (len(sizes), int(sizes.max(initial=0)))
    there = np.arange(shape[1]) < sizes[:, None]
    ids, scores = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
    low, high = np.full(shape, LONG[1]), np.full(shape, LONG[0])
    ids[there], scores[there] = (np.concatenate([x.field(n).to_numpy() for x in flat]) for n in ("vec_id", "score"))
    ends = [(-(-low_percent * p // 100), high_percent * p // 100) for p in scores[there].tolist()]
    given = [(max(a, LONG[0]), min(b, LONG[1])) if a <= b and a <= LONG[1] and b >= LONG[0] else (LONG[1], LONG[0]) for a, b in ends]
    if given:
        low[there], high[there] = np.array(given, np.int64).T
    return ids, scores, low, high


def ranked(found: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """The first ``k`` rows of each key by score, then smaller id, with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame,
    is_anchor,
    store,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low_percent: int = LOW_PERCENT,
    high_percent: int = HIGH_PERCENT,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``usable`` rows; ``store`` writes and rereads a table.

    For each anchor and each of its first ``positives`` rows of the same
    label: the first ``negatives`` rows of other labels whose scores lie
    between ``low_percent`` and ``high_percent`` of the positive's score.
    """
    anchors = store(packed(rows.where(is_anchor).withColumn("anchor_row", F.monotonically_increasing_id())))
    # The anchor itself may be among them, hence one more. The hash, an equal vector's too, lets Spark sort without comparing vectors.
    copies = Window.partitionBy("hash", "label", "v").orderBy("vec_id")
    first = F.row_number().over(copies)
    candidates = rows.withColumn("hash", F.xxhash64("label", "v")).withColumn("copy", first).where(F.col("copy") <= max(positives, negatives) + 1)
    candidates = store(packed(candidates.drop("copy", "hash")))
    n = candidates.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    slots = max(-(-n // (SLOT_SHARDS * SHARD_ROWS)), min(SLOTS_PER_CORE * cores, -(-n // LEAST_ROWS)), 1)
    blocks = max(-(-anchors.count() // ANCHOR_ROWS), 1)

    def start(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
        order = np.argsort(column(batches, "label"), kind="stable")
        return order, *(column(batches, n)[order] for n in ("anchor_row", "vec_id", "label")), vectors_of(batches)[order]

    def same_label(batches: list[pa.RecordBatch]) -> tuple:
        _, rows, own, labels, q = start(batches)
        ends = (np.full((len(rows), 1), x) for x in LONG)
        searches = Searches(own, labels, q, *ends, positives)

        def found() -> Iterator[tuple]:
            for begin in range(0, len(rows), SEARCH_ROWS):
                part = slice(begin, begin + SEARCH_ROWS)
                a, _, k = np.nonzero(np.arange(positives) < searches.n[part, :, None])
                yield rows[part][a], searches.ids[part][a, 0, k], searches.scores[part][a, 0, k]

        return searches.same_labels, found

    def other_labels(batches: list[pa.RecordBatch]) -> tuple:
        order, rows, own, labels, q = start(batches)
        ids, scores, low, high = (x[order] for x in windows([b["positives"] for b in batches], low_percent, high_percent))
        searches = Searches(own, labels, q, low, high, negatives)

        def found() -> Iterator[tuple]:
            for begin in range(0, len(rows), SEARCH_ROWS):
                part = slice(begin, begin + SEARCH_ROWS)
                a, w, k = np.nonzero(np.arange(negatives) < searches.n[part, :, None])
                yield rows[part][a], ids[part][a, w], scores[part][a, w], searches.ids[part][a, w, k], searches.scores[part][a, w, k]

        return searches.other_labels, found

    near = ranked(met(candidates, anchors, slots, blocks, same_label, ["anchor_row", "vec_id", "score"]), ["anchor_row"], positives)
    given = near.groupBy(F.col("anchor_row").alias("of")).agg(F.collect_list(F.struct("vec_id", "score")).alias("positives"))
    asking = store(anchors.join(given, F.col("anchor_row") == F.col("of")).drop("of"))
    names = ["anchor_row", "positive_id", "positive_score", "vec_id", "score"]
    hard = ranked(met(candidates, asking, slots, blocks, other_labels, names), ["anchor_row", "positive_id", "positive_score"], negatives)
    names = anchors.select(F.col("anchor_row").alias("of"), F.col("vec_id").alias("anchor_id"))
    return hard.join(names, F.col("anchor_row") == F.col("of")).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )

"""Near-duplicate vectors by sorted projection passes.

In each pass every vector gets a key of concatenated random-hyperplane bits.
Keys are ordered by (pass, label, key), and each vector is compared with its
neighbours in a bounded window. What travels in the sort is the key, the id and
a sketch: components rounded to 16 bits, a quarter of the vector. A sketch's
error is bounded, so it settles all pairs but those within the bound of the
threshold; these few fetch their vectors once and are compared exactly, in
double precision. Pairs of a window are united where they are found; the links
of all passes are united into components. Every link lies within a component,
so each component's vectors are then compared with each other, in blocks and in
double precision, and only counts leave a block: windows decide what connects,
no cap decides how many links count.

The number of passes follows from the data. The first passes suit vectors that
spread evenly. Beside its links, every vector then tells per pass how many key
bits part it from the vectors at its window's two ends, and with which chance a
vector at the threshold, in a random direction, shares these bits under that
pass's own planes. Labels go on until every vector's chance to be missed is
under ``MISS``, and until two batches in a row unite nothing new. A side of a
window that ends within the vector's own component, or at a partition's edge,
tells nothing and counts as the other side does; if both do, the pass counts as
the vector's others; if all passes do, the second condition alone decides.
Partitions hold at least ``EDGE`` windows where there are as many rows, so an
edge cuts few of them. It stays a chance, not a proof: linked vectors may lie
otherwise.

Equal vectors are one class, compared once and counted as often as they occur.

Defined results: a null label, and a vector that is null, zero, or holds null
or non-finite components, links with nothing (0 links, its own component, kept);
vectors of other lengths never link; repeated rows are copies; rows that share
an id are one vector of the graph; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tricklens.llm.common import stored
from tricklens.llm.components import components

THRESHOLD = 0.98
WINDOW = 64  # neighbours compared on the following side
KEY_BITS = 64  # a key is one long
STEPS = 32_767  # a sketch's steps from 0 to 1
EDGE = 64  # windows a partition of sorted rows holds at least
SORTED_ROWS = 1 << 18  # rows it holds at most, about
MISS = 1e-7
SEED = 20
BLOCK = 1024  # vectors on a side of a counting block
QUIET = 2  # batches in a row that must unite nothing new
NORMAL_LOG = np.log([0.5 * math.erfc(-z / 10_000 / math.sqrt(2)) for z in range(60_001)])


def unit_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label, class digest and unit vector (float64 bytes); both null where nothing can link."""
    for batch in batches:
        units, digests = [], []
        for label, vector in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            unit = None
            if label is not None and vector and None not in vector:
                v = np.array(vector, np.float64)
                # Scaled by the largest component first, so that no square overflows or vanishes.
                top = np.abs(v).max()
                if np.isfinite(v).all() and top > 0:
                    v = v / top
                    unit = (v / math.sqrt(float(v @ v))).tobytes()
            units.append(unit)
            digests.append(unit and hashlib.blake2b(f"{label}|".encode() + unit, digest_size=16).digest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1).cast(pa.string()), pa.array(digests, pa.binary()), pa.array(units, pa.binary())], ["vec_id", "label", "class", "unit"]
        )


def passes_for(largest: int, threshold: float, window: int, miss: float) -> int:
    """First passes: enough if the vectors of the largest label spread evenly."""
    bits = max(1.0, math.log2(max(2, largest) / window) + 1)
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    # One neighbour in ten may sit behind a partition's edge.
    return max(4, math.ceil(math.log(miss) / math.log(1 - 0.9 * agree)))


def planes_of(seed: int, dim: int, p: int) -> np.ndarray:
    return np.random.default_rng([seed, dim, p]).standard_normal((dim, KEY_BITS))


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    """Equally long binary values as the rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def keyed(first: int, passes: int, seed: int):
    """A row per vector and pass: its place in the order, and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.divide(pc.binary_length(batch.column("unit")), 8).to_numpy(zero_copy_only=False)
            for dim in np.unique(size):
                part = batch.take(pa.array(np.flatnonzero(size == dim)))
                X = matrix(part.column("unit"), np.float64)
                sketch = pa.array([row.tobytes() for row in np.rint(X * STEPS).astype(np.int16)], pa.binary())
                for p in range(first, first + passes):
                    key = np.packbits(X @ planes_of(seed, int(dim), p) > 0, axis=1).view(">i8").ravel().astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(X), p, np.int32)), part.column("label"), pa.array(np.full(len(X), dim, np.int32)),
                         pa.array(key), part.column("node"), sketch],
                        ["pass", "label", "dim", "key", "node", "sketch"],
                    )

    return run


def sketch_error(dim: int) -> float:
    """How far the product of two sketches, in single precision, may be from that of their vectors at most."""
    rounding = 0.5 / STEPS * math.sqrt(dim)  # of one unit vector
    return 2 * rounding + rounding**2 + (dim + 2) * 2.0**-22


def shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading bits that two keys share."""
    x = (a ^ b).view(np.uint64)
    high, low = (x >> np.uint64(32)).astype(np.float64), (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, 32 - np.frexp(high)[1], 64 - np.frexp(low)[1])


def found_chance(unit: np.ndarray, planes: np.ndarray, threshold: float, key: np.ndarray, ahead: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Chance that a vector at the threshold from each row, in a random direction, lies in the row's window.

    It does if it shares at least ``ahead`` key bits with the row and follows it,
    or at least ``behind`` and precedes it; the first bit that differs says which.
    """
    dim, n_bits = planes.shape
    margin = np.minimum(np.abs(unit @ planes) / np.sqrt((planes**2).sum(axis=0)), 1.0)
    spread = np.sqrt(np.maximum((1 - margin**2) * (1 - threshold**2) / max(1, dim - 1), 1e-300))
    # The normal distribution function, by a table: 1e-4 is far finer than needed.
    agree = NORMAL_LOG[(np.minimum(threshold * margin / spread, 6.0) * 10_000).astype(np.int64)]
    shares = np.exp(np.concatenate([np.zeros((len(unit), 1)), np.cumsum(agree, axis=1)], axis=1))
    parts_at = shares[:, :-1] - shares[:, 1:]
    follows = np.unpackbits(key.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1) == 0
    follows[:, 0] = ~follows[:, 0]  # keys are sorted as signed numbers
    seen = np.arange(n_bits) >= np.where(follows, ahead[:, None], behind[:, None])
    return np.where(seen, parts_at, 0.0).sum(axis=1) + shares[:, -1]


def united(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest of ``n`` rows that each row reaches over the pairs (i, j)."""
    up = np.arange(n)
    while (apart := up[i] != up[j]).any():
        a, b = up[i[apart]], up[j[apart]]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up = up[up]
    return up


def neighbours(threshold: float, window: int, seed: int):
    """Rows (a, b, sure, miss): links that unite all sure pairs of sorted rows, at most one a row; pairs that only their vectors
    can tell, where no sure ones unite them (sure false); and for each vector the logarithm of its chance to be missed by this
    pass (b null), where its windows end at vectors not united with it."""

    def close(group: np.ndarray, X: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of a group within the window at or near the threshold, and their product: each block of rows meets itself and the next."""
        n, dim = X.shape
        blocks = -(-n // window)
        padded = np.zeros(((blocks + 1) * window, dim), np.float32)
        padded[:n] = X
        padded = padded.reshape(blocks + 1, window, dim)
        both = np.concatenate([padded[:-1], padded[1:]], axis=1)
        product = padded[:-1] @ both.transpose(0, 2, 1)
        block, row, other = np.nonzero(product >= threshold - sketch_error(dim))
        i, j = block * window + row, block * window + other
        keep = (j > i) & (j <= i + window) & (j < n)
        keep[keep] = group[i[keep]] == group[j[keep]]
        return i[keep], j[keep], product[block[keep], row[keep], other[keep]]

    def misses(passes, group, key, X, up, rows, open_start: bool, open_end: bool) -> tuple[np.ndarray, np.ndarray]:
        """Those of ``rows`` whose windows tell something, and the logarithm of their chance to be missed."""
        n = len(group)
        told, bits = [], []
        for step, edge, cut in ((window, n - 1, open_end), (-window, 0, open_start)):
            end = np.clip(rows + step, 0, n - 1)
            beyond = end != rows + step
            same = group[rows] == group[end]
            # Where the rows end before the window does, all of the group is in it, if the group ends here too.
            told.append(np.where(beyond, (not cut) | (group[rows] != group[edge]), ~same | (up[rows] != up[end])))
            bits.append(np.where(same & ~beyond, shared_bits(key[rows], key[end]) + 1, 0))
        # A side that tells nothing counts as the other one does.
        ahead, behind = np.where(told[0], bits[0], bits[1]), np.where(told[1], bits[1], bits[0])
        some = told[0] | told[1]
        rows, ahead, behind = rows[some], ahead[some], behind[some]
        chance = np.zeros(len(rows))
        for p in np.unique(passes[rows]):
            own = passes[rows] == p
            planes = planes_of(seed, X.shape[1], int(p)).astype(np.float32)
            chance[own] = found_chance(X[rows[own]], planes, threshold, key[rows[own]], ahead[own], behind[own])
        # Passes that tell nothing as an edge cuts the window count as the others do, so what they may lose is taken off all.
        chance = np.minimum(chance * (1 - 2 / EDGE), 1 - 1e-12)
        return rows, np.log1p(-chance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last rows, neighbours of the next ones
        told_to = 0  # rows of ``held`` that have told their chance
        open_start = True  # the rows' first group may begin in the partition before
        last_group, n_groups = None, 0

        def done(open_end: bool, last: bool) -> pa.RecordBatch:
            nonlocal held, told_to, open_start
            passes, group, key, node, sketch = held
            X = sketch.astype(np.float32) / STEPS
            i, j, product = close(group, X)
            sure = product >= threshold + sketch_error(X.shape[1])
            up = united(len(node), i[sure], j[sure])
            moved = np.flatnonzero(up != np.arange(len(up)))
            unsure = ~sure & (up[i] != up[j])
            to = len(node) if last else max(told_to, len(node) - window)
            rows, miss = misses(passes, group, key, X, up, np.arange(told_to, to), open_start, open_end)
            start = max(0, to - window)
            if start:
                open_start = False
            told_to, held = to - start, None if last else tuple(c[start:] for c in held)
            nothing = lambda m: pa.nulls(m, pa.int64())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([node[moved], node[i[unsure]], node[rows]])),
                    pa.concat_arrays([pa.array(node[up[moved]]), pa.array(node[j[unsure]]), nothing(len(rows))]),
                    pa.array(np.concatenate([np.ones(len(moved), bool), np.zeros(unsure.sum() + len(rows), bool)])),
                    pa.concat_arrays([pa.nulls(len(moved) + int(unsure.sum()), pa.float64()), pa.array(miss)]),
                ],
                ["a", "b", "sure", "miss"],
            )

        for batch in batches:
            if not len(batch):
                continue
            columns = [batch.column(c) for c in ("pass", "dim", "label")]
            change = np.zeros(len(batch), bool)
            for c in columns:
                change[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            change[0] = last_group is not None and last_group != tuple(c[0].as_py() for c in columns)
            last_group = tuple(c[-1].as_py() for c in columns)
            group = n_groups + np.cumsum(change)
            n_groups = int(group[-1])
            passes, dim, key, node = (batch.column(c).to_numpy() for c in ("pass", "dim", "key", "node"))
            bounds = [0, *(np.flatnonzero(dim[1:] != dim[:-1]) + 1), len(batch)]
            for lo, hi in zip(bounds, bounds[1:]):  # one vector length at a time
                sketch = matrix(batch.column("sketch")[lo:hi], np.int16)
                if held is not None and held[4].shape[1] != sketch.shape[1]:
                    yield done(open_end=False, last=True)
                    told_to, open_start = 0, False
                more = (passes[lo:hi], group[lo:hi], key[lo:hi], node[lo:hi], sketch)
                held = more if held is None else tuple(np.concatenate(c) for c in zip(held, more))
                yield done(open_end=True, last=False)
        if held is not None:
            yield done(open_end=True, last=True)

    return run


def at_threshold(threshold: float):
    """Pairs (a, b) whose vectors link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("a_unit").to_pylist(), batch.column("b_unit").to_pylist())
            near = [float(np.frombuffer(x, np.float64) @ np.frombuffer(y, np.float64)) >= threshold for x, y in pairs]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return run


def counted(threshold: float):
    """Links of each vector within one counting block: (node, n), copies counted as often as they occur."""

    def run(rows: pa.Table) -> pa.Table:
        side, node, copies = (rows.column(c).to_numpy() for c in ("side", "node", "copies"))
        units = rows.column("unit").to_pylist()
        total = np.zeros(len(node), np.int64)
        size = np.array([len(u) for u in units])
        for dim in np.unique(size):
            at = [np.flatnonzero((size == dim) & (side == s)) for s in (0, 1)]
            X = [np.frombuffer(b"".join(units[i] for i in a), np.float64).reshape(-1, dim // 8) for a in at]
            if len(at[1]):
                near = X[0] @ X[1].T >= threshold
                total[at[0]] += near @ copies[at[1]]
                total[at[1]] += copies[at[0]] @ near
            else:
                near = X[0] @ X[0].T >= threshold
                np.fill_diagonal(near, True)
                total[at[0]] += near @ copies[at[0]]
        return pa.table({"node": pa.array(node, pa.int64()), "n": pa.array(total, pa.int64())})

    return run


def connected(classes: DataFrame, passes: int, threshold: float, window: int, miss: float, seed: int) -> DataFrame:
    """(node, component) of all classes with a link: batches of passes until no label needs more."""
    open_rows, first, found, edges, chances, quiet = classes, 0, None, None, None, None
    n_open = classes.count()
    widest = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    unit_of = lambda c: classes.select(F.col("node").alias(c), F.col("unit").alias(f"{c}_unit"))
    while True:
        n_rows = n_open * passes
        n_parts = max(math.ceil(n_rows / SORTED_ROWS), min(widest, math.ceil(n_rows / (EDGE * window))), 1)
        sorted_rows = (
            open_rows.select("label", "node", "unit")
            .mapInArrow(keyed(first, passes, seed), "pass int, label string, dim int, key long, node long, sketch binary")
            .repartitionByRange(n_parts, "pass", "dim", "label", "key")
            .sortWithinPartitions("pass", "dim", "label", "key", "node")
        )
        told = stored(sorted_rows.mapInArrow(neighbours(threshold, window, seed), "a long, b long, sure boolean, miss double"), "passes")
        links = told.where(F.col("sure")).select("a", "b")
        unsure = told.where(~F.col("sure") & F.col("b").isNotNull()).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        links = links.unionByName(unsure.join(unit_of("a"), "a").join(unit_of("b"), "b").mapInArrow(at_threshold(threshold), "a long, b long"))
        new = told.where(F.col("b").isNull()).groupBy(F.col("a").alias("node")).agg(F.sum("miss").alias("miss"), F.count("*").alias("told"))
        if found is None:
            fresh = links
        else:  # only what joins two components is new
            place = lambda c: found.select(F.col("node").alias(f"{c}_node"), F.col("component").alias(f"{c}_in"))
            fresh = links.join(place("a"), F.col("a") == F.col("a_node"), "left").join(place("b"), F.col("b") == F.col("b_node"), "left")
            fresh = fresh.select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b")).where("a <> b")
        fresh = stored(fresh.distinct(), "new-links")
        edges = fresh if edges is None else edges.unionByName(fresh)
        found = components(edges)
        both = new if chances is None else chances.unionByName(new).groupBy("node").agg(F.sum("miss").alias("miss"), F.sum("told").alias("told"))
        chances = stored(both, "miss-chances")
        first += passes
        united = fresh.select(F.col("a").alias("node")).distinct().join(classes.select("node", "label"), "node").select("label").distinct()
        worst = classes.select("node", "label").join(chances, "node", "left").groupBy("label")
        worst = worst.agg(F.max(F.col("miss") / F.col("told") * first).alias("worst"), F.count("*").alias("n"))
        state = worst.join(united.withColumn("new", F.lit(True)), "label", "left")
        if quiet is not None:
            state = quiet.select("label", F.col("still").alias("before")).join(state, "label")
        else:
            state = state.withColumn("before", F.lit(0))
        # The first batch unites something in any case that matters, so it counts as quiet only if it united nothing.
        state = state.withColumn("still", F.when(F.col("new"), 0).otherwise(F.col("before") + 1))
        todo = (F.col("worst") > math.log(miss)) | (F.col("still") < QUIET)
        quiet = stored(state.where(todo).select("label", "still", "worst", "n"), "open-labels")
        need = quiet.agg(F.count("*").alias("n"), F.max("worst").alias("worst"), F.sum("n").alias("rows")).first()
        if not need.n:
            return found
        # As many more as the worst vector lacks at its rate so far, but at most as many as there were, then measured anew.
        lacks = first * math.log(miss) / need.worst - first if need.worst is not None and need.worst < 0 else first
        passes = max(4, min(first, math.ceil(lacks)))
        n_open = need.rows
        open_rows = classes.join(quiet.select("label"), "label", "left_semi").select(*classes.columns)


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, miss: float = MISS, seed: int = SEED) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    rows = stored(rows.mapInArrow(unit_vectors, "vec_id long, label string, class binary, unit binary"), "unit-vectors")
    usable = rows.where(F.col("class").isNotNull() & F.col("vec_id").isNotNull())
    classes = stored(
        usable.groupBy("class").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("unit").alias("unit")),
        "vector-classes",
    )
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    passes = passes_for(largest, threshold, window, miss)
    found = connected(classes, passes, threshold, window, miss, seed)
    members = stored(classes.join(found, "node").select("component", "node", "copies", "unit"), "vector-components")
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    dealt = members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # A vector of block k meets all blocks once: as the first side of (k, j) for j >= k, as the second of (i, k) for i < k.
    meets = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.struct(
            F.least(j, F.col("block")).alias("i"), F.greatest(j, F.col("block")).alias("j"), F.when(j < F.col("block"), 1).otherwise(0).alias("side")
        ),
    )
    blocks = dealt.select("component", "node", "copies", "unit", F.explode(meets).alias("m")).select("component", "m.i", "m.j", "m.side", "node", "copies", "unit")
    counts = blocks.groupBy("component", "i", "j").applyInArrow(counted(threshold), "node long, n long")
    totals = counts.groupBy("node").agg(F.sum("n").alias("n"))
    per_class = classes.join(totals, "node", "left").join(found, "node", "left")
    per_class = per_class.select(
        "class", F.coalesce("n", "copies").alias("with_copies"), F.coalesce("component", "node").alias("component")
    )
    out = rows.select("vec_id", "class").join(stored(per_class, "vector-links"), "class", "left")
    linked = F.col("vec_id").isNotNull() & F.col("with_copies").isNotNull()
    out = out.select(
        "vec_id",
        F.when(linked, F.col("with_copies") - 1).otherwise(0).cast("long").alias("n_links"),
        F.when(linked, F.col("component")).otherwise(F.col("vec_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

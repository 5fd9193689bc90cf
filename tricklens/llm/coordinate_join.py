"""Near-duplicate documents by an inverted join over MinHash coordinates.

A document's signature has ``COORDINATES`` minima of its 5-word shingle
hashes. It is posted under each (coordinate, value) pair. Two documents at the
similarity threshold collide in at least ``matches`` coordinates but for a
chance under ``MISS``; so, by prefix and skip merging, each document leaves out
its ``matches - 1`` longest posting lists (ordered by length, then pair) and
any partner still shares one of the rest. Lists of one document go at once.

Documents with equal shingle sets are one class and take part once. Within a
list, pairs are not enumerated: first, for a few rounds, each document meets
only its list's representative, and verified links are united into
components. What remains are lists with several components; in these, the
documents outside the list's largest component meet all others, in blocks of
bounded size, where collisions are counted over whole signatures and pairs
with ``matches`` or more are confirmed on their full shingle sets. A pair is
looked at in the first of the coordinates that its documents share, and links
leave a block only if they unite something. So no link between components is
lost, and a large group of copies costs little more than its size.

Shingles are compared by 64-bit hashes, classes by 128-bit digests of them.

Defined results: a null text or one without words has no shingles and links
with nothing; fewer than five words are one shingle; repeated rows are copies;
rows that share an id are one document of the graph; a null id links with
nothing; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tricklens.llm.common import private_names, stored
from tricklens.llm.components import grown

SHINGLE = 5
SIMILARITY_PCT = 75
COORDINATES = 64
MISS = 1e-6
ROUNDS = 2  # of meeting a list's representative
BLOCK = 1024  # documents on a side of a block
SEED = 11
MEMO = 1_000_000  # word hashes a task remembers before it starts afresh
FLAT = 1 << 20  # shingles put through the coordinates at once


def least_matches(coordinates: int, similarity_pct: int, miss: float) -> int:
    """The most collisions that a pair at the threshold has but for a chance of ``miss``."""
    p, below = similarity_pct / 100, 0.0
    for k in range(coordinates + 1):
        below += math.comb(coordinates, k) * p**k * (1 - p) ** (coordinates - k)
        if below > miss:
            return max(1, k)
    return coordinates


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the MurmurHash3 finaliser)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingler():
    """text -> sorted distinct 64-bit hashes of its shingles."""
    import xxhash

    class Hashes(dict):
        def __missing__(self, word):
            if len(self) > MEMO:
                self.clear()
            self[word] = h = xxhash.xxh64_intdigest(word)
            return h

    hashes, find = Hashes(), re.compile(rb"[^ \t-\r]+").findall
    odd = np.random.default_rng(SEED).integers(1, 1 << 62, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def shingles(text: str | None) -> np.ndarray:
        words = find((text or "").encode().lower())  # bytes.lower() changes A-Z only
        if len(words) < SHINGLE:
            return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
        h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
        n = len(h) - SHINGLE + 1
        total = h[:n] * odd[0]
        for i in range(1, SHINGLE):
            total += h[i : i + n] * odd[i]
        return np.unique(mixed(total))

    return shingles


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """One row of ``coordinates`` 32-bit minima per (non-empty) set."""
    rng = np.random.default_rng(SEED + 1)
    a = rng.integers(1, 1 << 62, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, coordinates, dtype=np.uint64)
    out = np.empty((len(sets), coordinates), np.uint32)
    lo = 0
    while lo < len(sets):
        hi, size = lo, 0
        while hi < len(sets) and (hi == lo or size + len(sets[hi]) <= FLAT):
            size += len(sets[hi])
            hi += 1
        flat = np.concatenate(sets[lo:hi])
        starts = np.cumsum([0, *[len(s) for s in sets[lo : hi - 1]]])
        for k in range(coordinates):
            out[lo:hi, k] = np.minimum.reduceat((flat * a[k] + b[k]) >> np.uint64(32), starts)
        lo = hi
    return out


def class_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signed(coordinates: int):
    kinds = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("class", pa.binary()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = shingler()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                sets = [shingles(t.as_py()) for t in part.column(1)]
                some = [s for s in sets if len(s)]
                sig = iter(signatures(some, coordinates))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) if len(s) else None for s in sets], pa.binary()),
                     pa.array([next(sig).tobytes() if len(s) else None for s in sets], pa.binary())],
                    schema=kinds,
                )

    return run


def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """class and sorted shingle hashes of each text."""
    shingles = shingler()
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            sets = [shingles(t.as_py()) for t in batch.column(0).slice(lo, 256)]
            sets = [s for s in sets if len(s)]
            yield pa.RecordBatch.from_pydict({"class": pa.array([class_of(s) for s in sets], pa.binary()), "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})


def posted(coordinates: int):
    """Signatures to postings: (node, pair), the pair being coordinate and value in one long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = np.arange(coordinates, dtype=np.int64) << 32
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, coordinates)
            node = np.repeat(batch.column("node").to_numpy(), coordinates)
            yield pa.RecordBatch.from_pydict({"node": pa.array(node), "pair": pa.array((sig.astype(np.int64) | high).ravel())})

    return run


def similar(a, b, pct: int) -> bool:
    shared = len(a & b)
    return 100 * shared >= pct * (len(a) + len(b) - shared)


def confirmed(matches: int, pct: int):
    """Keeps the pairs (a, b) with enough collisions and similar full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            rows = zip(*(batch.column(c).to_pylist() for c in ("a", "b", "sig_a", "sig_b", "shingles_a", "shingles_b")))
            for x, y, sig_x, sig_y, set_x, set_y in rows:
                if np.count_nonzero(np.frombuffer(sig_x, np.uint32) == np.frombuffer(sig_y, np.uint32)) < matches:
                    continue
                p, q = np.frombuffer(set_x, np.uint64), np.frombuffer(set_y, np.uint64)
                shared = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * shared >= pct * (len(p) + len(q) - shared):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def block_pairs(rows: pa.Table, matches: int, coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (x, y) of the block's pairs to confirm: x outside the list's main component, y any of another component.

    Of all lists that hold both, only that of the first shared coordinate looks at a pair;
    two outsiders meet from both sides, so the smaller node's side does.
    """
    outside, node, comp, mask, pair = (rows.column(c).to_numpy() for c in ("outside", "node", "comp", "mask", "pair"))
    sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint32).reshape(-1, coordinates)
    coordinate = int(pair[0]) >> 32
    xs, ys = np.flatnonzero(outside == 1), np.flatnonzero(outside == 0)
    bits = np.uint64(1) << np.arange(coordinates, dtype=np.uint64)
    mask = mask.view(np.uint64)
    y_outside = comp[ys] != rows.column("main").to_numpy()[ys]
    found_x, found_y = [], []
    for x in xs:
        same = sig[ys] == sig[x]
        ok = (same.sum(1) >= matches) & (comp[ys] != comp[x]) & (~y_outside | (node[ys] > node[x]))
        at = np.flatnonzero(ok)
        if len(at):
            shared = (same[at] * bits).sum(1, dtype=np.uint64) & mask[x] & mask[ys[at]]
            first = shared & (~shared + np.uint64(1))
            at = at[first == bits[coordinate]]
            found_x += [x] * len(at)
            found_y += ys[at].tolist()
    return np.array(found_x, np.int64), np.array(found_y, np.int64)


def flagged(matches: int, coordinates: int):
    """The rows of a block that have a pair to confirm."""

    def run(rows: pa.Table) -> pa.Table:
        x, y = block_pairs(rows, matches, coordinates)
        return rows.take(pa.array(np.unique(np.concatenate([x, y]))))

    return run


def united(matches: int, coordinates: int, pct: int):
    """Confirmed links of a block that unite components not yet united in it."""

    def run(rows: pa.Table) -> pa.Table:
        x, y = block_pairs(rows, matches, coordinates)
        node, comp = rows.column("node").to_numpy(), rows.column("comp").to_pylist()
        data = rows.column("shingles").to_pylist()
        sets: dict[int, frozenset] = {}
        up: dict[int, int] = {}

        def root(c):
            while up.get(c, c) != c:
                c = up[c]
            return c

        def of(i):
            if i not in sets:
                sets[i] = frozenset(np.frombuffer(data[i], np.uint64).tolist())
            return sets[i]

        a, b = [], []
        for i, j in zip(x.tolist(), y.tolist()):
            p, q = root(comp[i]), root(comp[j])
            if p != q and similar(of(i), of(j), pct):
                up[max(p, q)] = min(p, q)
                a.append(node[i])
                b.append(node[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def placed(postings: DataFrame, found: DataFrame | None) -> DataFrame:
    """``postings`` with each document's component so far (``found``: node, component)."""
    if found is None:
        return postings.withColumn("comp", F.col("node"))
    found = found.withColumnsRenamed({"node": "c_node"})
    return postings.join(found, F.col("node") == F.col("c_node"), "left").withColumn("comp", F.coalesce("component", "node")).drop("c_node", "component")


def near_documents(
    docs: DataFrame, text: str = "text", coordinates: int = COORDINATES, pct: int = SIMILARITY_PCT, miss: float = MISS, rounds: int = ROUNDS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    if coordinates > 64:
        raise ValueError("at most 64 coordinates: a document's kept lists are one long of bits")
    matches = least_matches(coordinates, pct, miss)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = stored(texts.mapInArrow(signed(coordinates), "doc_id long, n long, class binary, sig binary"), "signatures")
    usable = rows.where(F.col("class").isNotNull() & F.col("doc_id").isNotNull())
    classes = stored(usable.groupBy("class").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig")), "classes")

    # Posting lists of two or more; each document leaves out its longest, all but ``matches - 1`` collisions' worth.
    postings = classes.select("node", "sig").mapInArrow(posted(coordinates), "node long, pair long")
    lists = postings.groupBy("pair").agg(F.count("*").alias("length")).where(F.col("length") > 1)
    shared = postings.join(lists.withColumnRenamed("pair", "l_pair"), F.col("pair") == F.col("l_pair"))
    ordered = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("length", "pair"))).alias("own"))  # at most 64 a document
    kept = F.slice("own", 1, F.size("own") - (matches - 1))["pair"]
    prefix = ordered.where(F.size("own") >= matches).select("node", kept.alias("pairs"))
    one_bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(p, 32).cast("int"))
    mask = F.aggregate("pairs", F.lit(0).cast("long"), lambda m, p: m.bitwiseOR(one_bit(p)))
    prefix = stored(prefix.select("node", "pairs", mask.alias("mask")), "prefixes")
    posts = prefix.select("node", F.explode("pairs").alias("pair"))
    met = posts.groupBy("pair").agg(F.count("*").alias("length")).where(F.col("length") > 1).select(F.col("pair").alias("m_pair"))
    posts = stored(posts.join(met, F.col("pair") == F.col("m_pair"), "left_semi"), "postings")

    # Signatures and full sets of the documents that still share a list.
    asked = posts.select("node").distinct()
    asked = stored(asked.join(classes, "node").join(prefix.select("node", "mask"), "node"), "candidates")
    wanted = texts.join(asked.select("node").hint("shuffle_hash"), F.col("doc_id") == F.col("node"), "left_semi")
    sets = wanted.select("text").mapInArrow(full_sets, "class binary, shingles binary").dropDuplicates(["class"])
    sets = stored(sets.join(asked, "class").select("node", "sig", "mask", "shingles"), "shingle-sets")

    found: DataFrame | None = None
    for r in range(rounds):
        now = stored(placed(posts, found), "postings")
        chance = F.xxhash64(F.lit(r), F.col("node"))
        heads = now.groupBy("pair").agg(F.min(F.struct(chance.alias("x"), F.col("node").alias("node"), F.col("comp").alias("comp"))).alias("head"))
        heads = heads.select(F.col("pair").alias("h_pair"), F.col("head.node").alias("head"), F.col("head.comp").alias("head_comp"))
        pairs = now.join(heads, (F.col("pair") == F.col("h_pair")) & (F.col("comp") != F.col("head_comp")))
        pairs = pairs.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()
        side = lambda s: sets.select(*[F.col(c).alias(f"{c}_{s}") for c in ("node", "sig", "shingles")])
        both = pairs.join(side("a"), F.col("a") == F.col("node_a")).join(side("b"), F.col("b") == F.col("node_b"))
        both = both.select("a", "b", "sig_a", "sig_b", "shingles_a", "shingles_b")
        found = grown(found, stored(both.mapInArrow(confirmed(matches, pct), "a long, b long"), "links"))

    # Lists that still hold several components: the documents outside the main one meet all, in blocks.
    now = stored(placed(posts, found), "postings")
    parts = now.groupBy("pair", "comp").agg(F.count("*").alias("size"))
    several = parts.groupBy("pair").agg(
        F.count("*").alias("comps"), F.sum("size").alias("all"), F.max(F.struct("size", "comp")).alias("top")
    ).where(F.col("comps") > 1)
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    several = several.select(
        F.col("pair").alias("s_pair"), F.col("top.comp").alias("main"), blocks(F.col("all")).alias("n_all"), blocks(F.col("all") - F.col("top.size")).alias("n_out")
    )
    mixed_lists = now.join(several, F.col("pair") == F.col("s_pair")).drop("s_pair")
    place = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    as_any = F.transform(F.sequence(F.lit(0), F.col("n_out") - 1), lambda i: F.struct(i.alias("i"), place(F.col("n_all")).alias("j"), F.lit(0).alias("outside")))
    as_out = F.transform(F.sequence(F.lit(0), F.col("n_all") - 1), lambda j: F.struct(place(F.col("n_out")).alias("i"), j.alias("j"), F.lit(1).alias("outside")))
    dealt = F.when(F.col("comp") != F.col("main"), F.concat(as_any, as_out)).otherwise(as_any)
    dealt = mixed_lists.select("pair", "node", "comp", "main", F.explode(dealt).alias("m")).select("pair", "m.i", "m.j", "m.outside", "node", "comp", "main")
    with_sig = dealt.join(asked.select(F.col("node").alias("a_node"), "sig", "mask"), F.col("node") == F.col("a_node")).drop("a_node")
    fields = "pair long, i int, j int, outside int, node long, comp long, main long, sig binary, mask long"
    hits = stored(with_sig.groupBy("pair", "i", "j").applyInArrow(flagged(matches, coordinates), fields), "block-rows")
    with_sets = hits.join(sets.select(F.col("node").alias("x_node"), "shingles"), F.col("node") == F.col("x_node")).drop("x_node")
    found = grown(found, stored(with_sets.groupBy("pair", "i", "j").applyInArrow(united(matches, coordinates, pct), "a long, b long"), "links"))

    ends = placed(classes.select("class", "node"), found).select(F.col("class").alias("e_class"), "comp")
    out = rows.join(stored(ends, "document-components"), F.col("class") == F.col("e_class"), "left")
    component = F.when(F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("comp", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def first_of_each(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents of ``docs`` that are the first of their group, with their own columns.

    Of rows that repeat an id and its text, one stays; rows that share an id
    but not the text are documents of their own. Only ids travel; the texts
    meet the list of kept ids once, and only rows of repeated ids are compared by text.
    """
    repeated = docs.groupBy(F.col("doc_id").alias("twice")).count().where("count > 1").select("twice")
    repeated = stored(repeated, "repeated-ids")
    if repeated.isEmpty():
        kept = stored(near_documents(docs, text).where("kept").select(F.col("doc_id").alias("kept_id")), "kept-documents")
        return docs.join(kept.hint("shuffle_hash"), docs["doc_id"].cast("long").eqNullSafe(F.col("kept_id")), "left_semi")
    same = docs["doc_id"].eqNullSafe(F.col("twice"))
    node, real = private_names(docs, "near_node", "near_id")
    top = docs.agg(F.max(F.col("doc_id").cast("long"))).first()[0] or 0
    several = docs.join(repeated, same, "left_semi").dropDuplicates(["doc_id", text])
    # Written, so that the numbers stay what they are; beyond all ids, so that they clash with none.
    several = stored(several.withColumn(node, F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id() + F.lit(top) + 1)), "repeated-documents")
    single = docs.join(repeated, same, "left_anti").withColumn(node, F.col("doc_id").cast("long"))
    names = lambda df: df.select(F.col(node).alias("doc_id"), F.col("doc_id").cast("long").alias(real), F.col(text).alias("text"))
    every = names(single).unionByName(names(several))
    found = near_documents(every.select("doc_id", "text")).select(F.col("doc_id").alias(node), "component_id")
    ids = several.select(F.col(node).alias("several_node"), F.col("doc_id").cast("long").alias("several_id"))
    by_id = found.join(ids, F.col(node) == F.col("several_node"), "left").withColumn(real, F.coalesce("several_id", node))
    # The first of a group is the one of the smallest true id.
    best = by_id.where(F.col(node).isNotNull()).groupBy("component_id").agg(F.min(F.struct(real, node)).alias("first"))
    kept = stored(best.select(F.col("first")[node].alias("kept_node")).unionByName(best.sparkSession.createDataFrame([(None,)], "kept_node long")), "kept-documents")
    chosen = lambda df: df.join(kept.hint("shuffle_hash"), F.col(node).eqNullSafe(F.col("kept_node")), "left_semi").select(*docs.columns)
    return chosen(single).unionByName(chosen(several))

"""SentencePiece encoding and decoding through a table of distinct marked words.

Where no piece can cross a whitespace marker, a text's segmentation is the
concatenation of its chunks' (a run of markers and the word after it). Each
task cuts its texts into blocks of bounded size and writes, per block, its
distinct chunks (packed by hash bucket) and every document as the positions of
its chunks in the block's list. The buckets of all blocks form the table of
distinct chunks: a bucket's rows meet in one task, which segments each chunk
once and answers every block's list in order. A block's ids and documents meet
again by block, and ids take their places by position. No text is shuffled,
and a word but once a block.

The lists and the positions come from two passes over the same texts, each
cheaper than writing both down and reading them back. A block is named by a
digest of all it holds, so two passes that cut differently (an input whose
rows change order between reads) end in an error, not in wrong ids; write
such an input to a table first.

Models whose pieces may cross markers, or that change white space, are
encoded document by document instead.

Defined results: a null or empty text has the end id alone; repeated rows are
encoded each; a very long text is a block of its own; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKERS = " ▁"
BLOCK_CHARS = 32_000_000  # a block closes at this many characters; one text is never divided
BUCKETS = 256  # parts of the table of distinct chunks: raise with the vocabulary
TABLE_CHUNKS = 1_000_000  # chunks of a bucket held at once; a larger bucket segments some again, with the same ids
ENCODED = "doc_id long, ids binary, decoded string"  # ids: little-endian int32


def separable(model: str) -> bool:
    """Whether chunks can be segmented apart: no piece holds a marker after another character, and text is kept as it is."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(model, "rb") as f:
        proto.ParseFromString(f.read())
    norm, trained = proto.normalizer_spec, proto.trainer_spec
    plain = norm.name == "identity" and not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces
    user_defined = any(p.type == 4 for p in proto.pieces)
    crossing = any("▁" in p.piece.lstrip("▁") for p in proto.pieces)
    known_marker = any(p.piece == "▁" for p in proto.pieces)
    return plain and known_marker and not user_defined and not crossing and not trained.treat_whitespace_as_suffix


def processor(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def ids_and_text(sp, ids: np.ndarray) -> tuple[bytes, str]:
    return ids.astype("<i4").tobytes(), sp.decode(ids.tolist())


def encoded(
    docs: DataFrame, model: str, text: str = "text", finish: Callable = ids_and_text, schema: str = ENCODED, block_chars: int = BLOCK_CHARS, buckets: int = BUCKETS
) -> DataFrame:
    """One row per document: its id and what ``finish(processor, ids)`` makes of all its ids, end id included.

    ``model`` is a path that every executor can open. ``schema`` names doc_id
    first, then the columns that ``finish`` returns.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    result = arrow_schema(docs, schema)
    if not separable(model):
        return texts.mapInArrow(whole_texts(model, finish, result), schema)
    listed = texts.mapInArrow(cut_blocks(block_chars, buckets, LISTS), "block long, bucket int, packed binary, at binary")
    together = listed.repartition(F.col("bucket")).sortWithinPartitions("bucket", "block")
    lists = together.mapInArrow(segment(model), "list_block long, at binary, lengths binary, ids binary")
    rows = texts.mapInArrow(cut_blocks(block_chars, buckets, ROWS), "block long, doc_id long, places binary")
    return rows.groupBy("block").cogroup(lists.groupBy("list_block")).applyInArrow(assemble(model, finish, result), schema)


def squeezed(numbers: np.ndarray) -> bytes:
    """Small integers, compressed byte plane by byte plane."""
    return zlib.compress(np.ascontiguousarray(numbers, "<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def expanded(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<i4").ravel()


def packed(chunks: list[str]) -> bytes:
    lengths = squeezed(np.fromiter(map(len, chunks), "<i4", len(chunks)))
    return len(lengths).to_bytes(4, "little") + lengths + zlib.compress("".join(chunks).encode(), 1)


def unpacked(data: bytes) -> list[str]:
    cut = 4 + int.from_bytes(data[:4], "little")
    ends = np.cumsum(expanded(data[4:cut])).tolist()
    text = zlib.decompress(data[cut:]).decode()
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def arrow_schema(docs: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)


LISTS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("packed", pa.binary()), ("at", pa.binary())])
ROWS = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("places", pa.binary())])


def cut_blocks(block_chars: int, buckets: int, wanted: pa.Schema):
    """Texts to blocks: the blocks' lists of chunks, or the documents as positions in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(f"[{MARKERS}]+[^{MARKERS}]*").findall

        class Places(dict):
            def __missing__(self, chunk):
                self[chunk] = at = len(self)
                return at

        def closed(places: Places, ids: list, found: list) -> Iterator[pa.RecordBatch]:
            # Places count chunks in order of first use, so the chunks in that order and the places say all.
            content = hashlib.blake2b(repr(ids).encode(), digest_size=8)
            content.update("\n".join(places).encode())
            for f in found:
                content.update(f)
            block = int.from_bytes(content.digest(), "little", signed=True)
            if wanted is ROWS:
                rows = [(block, d, f) for d, f in zip(ids, found)]
            else:
                chunks = sorted(places)  # neighbours share their beginnings, so they pack well
                bucket_of = np.fromiter((zlib.crc32(c.encode()) % buckets for c in chunks), np.int32, len(chunks))
                order = np.argsort(bucket_of, kind="stable")
                rows = []
                for part in np.split(order, np.flatnonzero(np.diff(bucket_of[order])) + 1) if chunks else []:
                    own = [chunks[i] for i in part]
                    at = squeezed(np.fromiter(map(places.__getitem__, own), "<i4", len(own)))
                    rows.append((block, int(bucket_of[part[0]]), packed(own), at))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), wanted)], schema=wanted)

        places, ids, found, size = Places(), [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                chunks = find(" " + text) if text else []
                found.append(squeezed(np.fromiter(map(places.__getitem__, chunks), "<i4", len(chunks))))
                ids.append(doc_id)
                size += len(text)
                if size >= block_chars:
                    yield from closed(places, ids, found)
                    places, ids, found, size = Places(), [], [], 0
        if ids:
            yield from closed(places, ids, found)

    return run


def segment(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(model)
        table: dict[str, list[int]] = {}
        bucket = None
        for batch in batches:
            out = ([], [], [], [])
            for block, own, data, at in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "packed", "at"))):
                if own != bucket or len(table) > TABLE_CHUNKS:
                    table, bucket = {}, own
                chunks = unpacked(data)
                new = [c for c in chunks if c not in table]
                # The library puts the first marker back; a lone marker would be empty text to it.
                table.update(zip(new, sp.encode([c[1:] for c in new], num_threads=1)))
                ids = [table[c] if len(c) > 1 else [sp.piece_to_id("▁")] for c in chunks]
                for column, value in zip(out, (block, at, squeezed(np.fromiter(map(len, ids), "<i4", len(ids))), squeezed(np.array([i for x in ids for i in x], "<i4")))):
                    column.append(value)
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["list_block", "at", "lengths", "ids"])

    return run


def assemble(model: str, finish: Callable, result: pa.Schema):
    def run(rows: pa.Table, lists: pa.Table) -> pa.Table:
        sp = processor(model)
        end = np.array([sp.eos_id()], "<i4")
        flat, starts, lengths = np.zeros(0, "<i4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if lists.num_rows:
            at, n, flat = (np.concatenate([expanded(x) for x in lists.column(c).to_pylist()]) for c in ("at", "lengths", "ids"))
            lengths, starts = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
            lengths[at], starts[at] = n, np.cumsum(n) - n  # by position in the block's list
        out = []
        for doc_id, places in zip(rows.column("doc_id").to_pylist(), rows.column("places").to_pylist()):
            place = expanded(places)
            if len(place) and place.max() >= len(lengths):
                raise RuntimeError("the two passes over the texts cut different blocks: write the input to a table first")
            n = lengths[place]
            # The i-th id of a document is at its chunk's start plus its place within the chunk.
            first = np.repeat(starts[place] - (np.cumsum(n) - n), n)
            out.append((doc_id, *finish(sp, np.concatenate([flat[first + np.arange(len(first))], end]))))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(result), result)], schema=result)

    return run


def whole_texts(model: str, finish: Callable, result: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                every = sp.encode(part.column(1).to_pylist(), add_eos=True, num_threads=1)
                out = [(d, *finish(sp, np.array(i, "<i4"))) for d, i in zip(part.column(0).to_pylist(), every)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), result)], schema=result)

    return run

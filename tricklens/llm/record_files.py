"""Token ids as length-delimited binary records with masked checksums and a separate offset index.

A shard file is a sequence of frames: length (u64), masked CRC-32 of the
length (u32), payload, masked CRC-32 of the payload (u32), all little-endian.
The mask rotates the checksum right by 15 bits and adds 0xA282EAD8, so that a
checksum of data that holds checksums stays sound. A payload is one document:
flag (u8: 1 if its id is null), id (i64), width of an id in bytes (u8), count
(u32), ids. Beside each shard lies its index: the u64 offsets of all frames
and the file's end, so that readers can fetch records in any order.

Documents are range-partitioned by id; each partition is written as one shard
in ascending order, so shard order then record order is corpus order. File
names are unique to the writing attempt and only the manifest names the files
that count: a retried or lost task leaves at most an unnamed file.

Defined results: a null or empty text has the end id alone; a null id comes
first; rows that repeat an id are ordered by text; an empty table has no
shards; other columns are not read.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tricklens.llm.common import stored, worker_state
from tricklens.sources.scratch import fresh_path

MASK_DELTA = 0xA282EAD8
RUN = 200  # new chunks encoded as one text
GO = 1 << 23  # bytes of text encoded in one go: the more, the fewer chunks to look up
MEMO = 1_500_000  # chunks a worker remembers: bounds its memory, not its results
# Unicode's white space, as the tokenizer's pattern \s has it.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
MANIFEST = "shard int, path string, n_docs long, n_tokens long"


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked_crc(head)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(data: memoryview) -> memoryview:
    """The payload of one whole frame; raises ValueError if a checksum or the length is wrong."""
    (n,), (head_crc,) = struct.unpack_from("<Q", data), struct.unpack_from("<I", data, 8)
    if masked_crc(bytes(data[:8])) != head_crc or len(data) != n + 16:
        raise ValueError("record length is damaged")
    payload = data[12 : 12 + n]
    if masked_crc(bytes(payload)) != struct.unpack_from("<I", data, 12 + n)[0]:
        raise ValueError("record payload is damaged")
    return payload


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    return struct.pack("<BqBI", doc_id is None, doc_id or 0, ids.itemsize, len(ids)) + ids.tobytes()


def unpack(payload: memoryview) -> tuple[int | None, np.ndarray]:
    null, doc_id, width, n = struct.unpack_from("<BqBI", payload)
    return None if null else doc_id, np.frombuffer(payload, f"<u{width}", n, struct.calcsize("<BqBI"))


def open_fs(uri: str):
    """The pyarrow file system and path of a Hadoop-style URI (shared storage: file, hdfs, s3, gs, abfs)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if re.match(r"[a-z0-9]+://", uri) else "file://" + re.sub(r"^file:/*", "/", uri))


def splittable(tokenizer_json: str) -> bool:
    """Whether a text may be cut where white space begins: a plain byte-level pattern and no normaliser."""
    import json

    with open(tokenizer_json, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    return not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)


TWO_BACK = np.uint8(32)


def cut_tables() -> tuple[bytes, bytes]:
    """Of each byte, one bit per kind of break: as the last byte before it, as the first byte after it.

    1: white space after what is no white space; 2: a printable ASCII mark after an ASCII letter or digit; 4 and 8: an
    ASCII digit after a letter, and the reverse; 16: an ASCII letter or digit after a mark, but for the apostrophe,
    which begins the pattern's contractions. TWO_BACK: as 1, with the first byte of a character of two bytes that is
    no white space standing two bytes back.
    """
    before, after = bytearray(256), bytearray(256)
    ends = {chr(i).encode()[-1] for i in range(0x3001) if re.match(f"[{WHITE}]", chr(i))}  # may end white space
    for i in range(256):
        c = chr(i) if i < 128 else ""
        letter, digit, mark = c.isalpha(), c.isdigit(), "!" <= c <= "~" and not c.isalnum()
        before[i] = (i not in ends) | (letter or digit) << 1 | letter << 2 | digit << 3 | (mark and c != "'") << 4
        before[i] |= int(TWO_BACK) * (0xC3 <= i <= 0xDF)
        after[i] = (c != "" and c in "\t\n\v\f\r ") | mark << 1 | digit << 2 | letter << 3 | (letter or digit) << 4
        after[i] |= int(TWO_BACK) * (after[i] & 1)
    return bytes(before), bytes(after)


BEFORE, AFTER = cut_tables()


def chunked(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The chunks of all texts, end to end, and the place of each text's first chunk (and one past the last).

    The pattern surely breaks at every cut; a break that is not sure, as beside letters beyond ASCII, is left out,
    which makes a longer chunk and no other result.
    """
    data = b"".join(texts)
    bounds = np.cumsum([0, *map(len, texts)])
    cut = np.zeros(len(data) + 1, bool)
    before, after = (np.frombuffer(data.translate(kinds), np.uint8) for kinds in (BEFORE, AFTER))
    cut[1:-1] = (before[:-1] & after[1:] & ~TWO_BACK) != 0
    cut[2:-1] |= (before[:-2] & after[2:] & TWO_BACK) != 0
    cut[bounds] = True
    offsets = np.flatnonzero(cut)
    chunks = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return chunks, np.searchsorted(offsets, bounds)


def laid_out(values: pa.Array) -> tuple[np.ndarray, bytes]:
    """The offsets and the bytes of a large_binary array that was made whole."""
    if not len(values):
        return np.zeros(1, np.int64), b""
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64, len(values) + 1)
    return at, data.to_pybytes()[: at[-1]] if data else b""


def token_encoder(tokenizer_json: str, special_as_text: bool = False):
    """The worker's encoder of this tokenizer, with what it remembers from earlier tasks."""
    state, key = worker_state(), ("encoder", tokenizer_json, special_as_text)
    if key not in state:
        state[key] = new_encoder(tokenizer_json, special_as_text)
    return state[key]


def new_encoder(tokenizer_json: str, special_as_text: bool = False):
    """list of texts -> list of ids, exactly as the tokenizers library encodes each whole text with ``add_special_tokens=False``.

    ``special_as_text`` is the library's ``encode_special_tokens``, which it leaves off: with it, the string of
    a special token inside a text is ordinary text; without it, the string is that token.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_json)
    tokenizer.encode_special_tokens = special_as_text
    size = tokenizer.get_vocab_size()
    dtype = "<u2" if size <= 1 << 16 else "<u4"
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values() if t.content and not (special_as_text and t.special)]
    if not splittable(tokenizer_json) or any(re.search(f"[{WHITE}]", a) for a in added):
        return lambda texts: [np.array(e.ids, dtype) for e in tokenizer.encode_batch(texts, add_special_tokens=False)], dtype
    # What lies between two sure breaks of the pattern is encoded once and remembered. A byte-level token has one
    # character per byte, which tells a run's chunks apart again.
    memo: dict[bytes, bytes] = {}
    # The library first cuts a text at the strings of added tokens: texts that hold one are encoded whole.
    holds_added = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
    white = frozenset(chr(i) for i in range(0x3001) if re.match(f"[{WHITE}]", chr(i)))
    n_bytes = np.array([len(tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)
    encode_all = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)  # fast: without offsets

    def encoded_alone(new: list[bytes]) -> list[bytes]:
        # In a run, every chunk begins with white space and ends without; the few others are encoded apart.
        out: list = [b""] * len(new)
        said = [c.decode() for c in new]
        others = [i for i, t in enumerate(said) if t[0] not in white or t[-1] in white]
        for i, e in zip(others, encode_all([said[i] for i in others], add_special_tokens=False)):
            out[i] = np.array(e.ids, dtype).tobytes()
        apart = set(others)
        runs = [i for i in range(len(new)) if i not in apart]
        parts = [runs[lo : lo + RUN] for lo in range(0, len(runs), RUN)]
        for part, e in zip(parts, encode_all(["".join([said[i] for i in p]) for p in parts], add_special_tokens=False)):
            ids = np.array(e.ids, dtype)
            ends = np.cumsum([len(new[i]) for i in part])
            cuts = ((np.searchsorted(np.cumsum(n_bytes[ids]), ends) + 1) * ids.itemsize).tolist()
            data = ids.tobytes()
            for i, lo, hi in zip(part, [0, *cuts], cuts):
                out[i] = data[lo:hi]
        return out

    def encode(texts: list[str]) -> list[np.ndarray]:
        whole = {i: np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype) for i, t in enumerate(texts) if holds_added(t)}
        chunks, first = chunked([b"" if i in whole else t.encode() for i, t in enumerate(texts)])
        coded = chunks.dictionary_encode()
        at, data = laid_out(coded.dictionary)
        distinct = [data[lo:hi] for lo, hi in zip(at.tolist(), at[1:].tolist())]
        known = list(map(memo.get, distinct))
        missing = [i for i, k in enumerate(known) if k is None]
        new = [distinct[i] for i in missing]
        for i, k in zip(missing, encoded := encoded_alone(new)):
            known[i] = k
        if len(memo) + len(new) <= MEMO:  # full: what came first, the frequent chunks, stays
            memo.update(zip(new, encoded))
        # Arrow lays the ids of all chunks end to end.
        at, data = laid_out(pa.array(known, pa.large_binary()).take(coded.indices))
        ids, ends = np.frombuffer(data, dtype), (at[first] // np.dtype(dtype).itemsize).tolist()
        return [whole[i] if i in whole else ids[lo:hi] for i, (lo, hi) in enumerate(zip(ends, ends[1:]))]

    return encode, dtype


def gos(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows to encode in one go, of up to GO bytes (or a single row), from the running sums of the rows' bytes."""
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + GO, "right")))
        yield lo, hi
        lo = hi


def write_records(docs: DataFrame, tokenizer_json: str, end_id: int, text: str = "text", folder: str | None = None, special_as_text: bool = False) -> DataFrame:
    """Writes shards and their indexes; returns the stored manifest (shard, path, n_docs, n_tokens)."""
    folder = folder or fresh_path(docs.sparkSession, "token-records")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = texts.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, dtype = token_encoder(tokenizer_json, special_as_text)
        end = np.array([end_id], dtype)
        shard = TaskContext.get().partitionId()
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        name = f"shard-{shard:07d}-{uuid.uuid4().hex}"
        out, offsets, at, n_tokens = None, [], 0, 0
        for batch in batches:
            if out is None and batch.num_rows:
                out = fs.open_output_stream(f"{base}/{name}.records")
            sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy().astype(np.int64))
            for part in (batch.slice(lo, hi - lo) for lo, hi in gos(sizes)):
                for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                    data = frame(pack(doc_id, np.concatenate([ids, end])))
                    out.write(data)
                    offsets.append(at)
                    at += len(data)
                    n_tokens += len(ids) + 1
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{base}/{name}.index") as index:
                index.write(np.array([*offsets, at], "<u8").tobytes())
            row = {"shard": [shard], "path": [f"{folder}/{name}"], "n_docs": [len(offsets)], "n_tokens": [n_tokens]}
            yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return stored(ordered.mapInArrow(run, MANIFEST), "token-manifest")


def read_shard(path: str, order: np.ndarray | None = None, chunk: int = 1 << 23) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of a shard's records, in file order, or in the given order of record numbers."""
    fs, base = open_fs(path)
    with fs.open_input_stream(f"{base}.index") as f:
        offsets = np.frombuffer(f.read(), "<u8").astype(np.int64)
    with fs.open_input_file(f"{base}.records") as f:
        if order is not None:
            for i in order:
                yield unpack(unframe(memoryview(f.read_at(int(offsets[i + 1] - offsets[i]), int(offsets[i])))))
            return
        first, n = 0, len(offsets) - 1
        while first < n:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + chunk, "right")) - 1)
            data = memoryview(f.read_at(int(offsets[last] - offsets[first]), int(offsets[first])))
            for i in range(first, last):
                yield unpack(unframe(data[offsets[i] - offsets[first] : offsets[i + 1] - offsets[first]]))
            first = last


def read_records(manifest: DataFrame) -> DataFrame:
    """One row per record of the manifest's shards: doc_id, start (tokens before it in corpus order), n_tokens, ids_crc32."""
    by_shard = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row per file, not per document
    placed = manifest.select("shard", "path", F.coalesce(F.sum("n_tokens").over(by_shard), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
                out = ([], [], [], [])
                for doc_id, ids in read_shard(path):
                    for column, value in zip(out, (doc_id, before, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))):
                        column.append(value)
                    before += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # A file is a unit of work: one partition each (the manifest has a row per file).
    spread = placed.repartition(max(1, manifest.count()), F.col("shard"))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")

"""Packing documents into fixed-length sequences along a space-filling curve.

A document's token counts, hashed to FEATURES slots and scaled to length one, are projected to DIMS
orthogonal directions; the cell that the projection falls in has a place on a Hilbert curve. Documents
are range-sorted by that place, in rows of at most PIECE ids, so each task holds a contiguous stretch of the curve
and about as many ids as any other, whatever the documents' lengths, and packed in order: sequences are cut from the stream of ids, neighbours on the curve share sequences, and no
sequence but a task's last ones has room left. The rest of a task's stream is cut at powers of two,
which need no padding.

Defined cases: null and empty texts have only the end id; copies of a document lie side by side, in
order of id, then of a hash of the ids; rows may repeat an id, and each row's pieces are then told apart by their
sequence; rows alike in id and text may share sequences in any order of their pieces; an empty table gives an empty result; documents longer than a sequence span several.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.llm._shared import materialise, partitions, text_or_empty

LENGTH, END = 2048, 1
FEATURES, DIMS, BITS, PIECE = 256, 3, 16, 4096


def directions(features: int = FEATURES, dims: int = DIMS) -> np.ndarray:
    """Orthonormal rows, the same everywhere."""
    return np.linalg.qr(np.random.default_rng(7).standard_normal((features, dims)))[0].T


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows) with ``bits`` bits a coordinate.

    From the highest bit down, each coordinate either inverts or exchanges the lower bits of the first
    one, which turns the cube that the point lies in; the Gray code of the turned bits, read across the
    coordinates, is the place (Skilling, 2004).
    """
    x = np.array(cells, np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for k in range(dims):
            on = (x[k] >> level) & 1 == 1
            swap = np.where(on, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if k:
                x[k] ^= swap
    for k in range(1, dims):
        x[k] ^= x[k - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for k in range(dims):
            key = (key << 1) | ((x[k] >> level) & 1)
    return key


def curve_places(vectors: np.ndarray) -> np.ndarray:
    """Hilbert keys of hashed count vectors."""
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(norm > 0, norm, 1)
    cells = np.clip(((unit @ directions(vectors.shape[1]).T + 1) * 2 ** (BITS - 1)).astype(np.int64), 0, 2**BITS - 1)
    return hilbert_keys(cells)


@cache
def _press() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=1)


@cache
def _unpress() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def shrink(ids: bytes) -> bytes:
    """Ids for the shuffle: byte planes under zstandard."""
    flat = np.frombuffer(ids, np.uint8).reshape(-1, 4)
    used = 4 if flat[:, 3].any() else 3 if flat[:, 2].any() else 2
    return bytes([used]) + _press().compress(np.ascontiguousarray(flat[:, :used].T).tobytes())


def expand(data: bytes) -> np.ndarray:
    used = data[0]
    low = np.frombuffer(_unpress().decompress(data[1:]), np.uint8).reshape(used, -1)
    flat = np.zeros((low.shape[1], 4), np.uint8)
    flat[:, :used] = low.T
    return flat.view("<u4").ravel()


class Stream:
    """Cuts a stream of documents into sequences; gives (doc_id, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, length: int, first: int):
        self.length, self.sequence, self.used, self.held = length, first, 0, []

    def _close(self):
        at, out = 0, []
        for doc_id, start, ids, total in self.held:
            out.append((doc_id, start, ids.tobytes(), total, self.sequence, at))
            at += len(ids)
        self.sequence, self.used, self.held = self.sequence + 1, 0, []
        return out

    def add(self, doc_id, ids: np.ndarray, start: int, total: int):
        """Ids of a document of ``total`` ids from ``start`` on."""
        at = 0
        while at < len(ids):
            part = ids[at : at + self.length - self.used]
            self.held.append((doc_id, start + at, part, total))
            self.used += len(part)
            at += len(part)
            if self.used == self.length:
                yield from self._close()

    def end(self):
        """The last, part-filled sequence as sequences of the powers of two that make up its size."""
        left, rest = self.held, self.used
        self.used, self.held = 0, []
        while rest:
            room = 1 << (rest.bit_length() - 1)
            rest -= room
            while room:
                doc_id, start, ids, total = left.pop(0)
                self.held.append((doc_id, start, ids[:room], total))
                if len(ids) > room:
                    left.insert(0, (doc_id, start + room, ids[room:], total))
                room -= min(room, len(ids))
            yield from self._close()


def _batches(rows, schema, weight):
    """Record batches of about 4 MB from tuples."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if size > 1 << 22 or len(held) >= 8192:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def encode(docs: DataFrame, vocabulary: str | None = None, end: int = END, memory: int = tokens.CACHE) -> DataFrame:
    """``doc_id, place, tie, start, total, ids``: each document's place on the curve, a hash and the number of its ids, and its ids, shrunk, PIECE a row."""
    vocabulary = vocabulary or tokens.default_path()
    names = ("doc_id", "place", "tie", "start", "total", "ids")
    schema = pa.schema([(c, pa.binary() if c == "ids" else pa.int64()) for c in names])

    def run(batches):
        encode, tail = tokens.encoder(vocabulary, memory).encode, np.array([end], "<u4").tobytes()
        for batch in batches:
            doc_ids, vectors, rows, size = batch.column(0).to_pylist(), [], [], 0

            def flush():
                places = curve_places(np.array(vectors, np.float64)).tolist()
                columns = zip(*((d, places[k], *rest) for k, d, *rest in rows), strict=True)
                return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

            for doc_id, text in zip(doc_ids, tokens.as_bytes(batch.column(1)), strict=True):
                ids = encode(text) + tail
                flat = np.frombuffer(ids, "<u4")
                slots = (flat[:-1] * np.uint32(2654435761)) >> np.uint32(24)
                tie = xxhash.xxh64_intdigest(ids) >> 1
                for start in range(0, len(flat), PIECE):
                    rows.append((len(vectors), doc_id, tie, start, len(flat), shrink(ids[4 * start : 4 * (start + PIECE)])))
                    size += len(rows[-1][-1])
                vectors.append(np.bincount(slots, minlength=FEATURES))
                size += 8 * FEATURES
                if size > 1 << 23:
                    yield flush()
                    vectors, rows, size = [], [], 0
            if rows:
                yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id LONG, place LONG, tie LONG, start LONG, total LONG, ids BINARY")


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None, end: int = END, memory: int = tokens.CACHE) -> DataFrame:
    """One row per piece: doc_id, start, ids, doc_tokens, sequence_id, offset.

    ``ids`` are little-endian unsigned 32-bit integers. A sequence is all pieces of a ``sequence_id``
    in order of ``offset``. ``memory``: how many chunks' ids a worker remembers.
    """
    # Written first, as range partitioning reads its input twice.
    coded = materialise(encode(docs, vocabulary, end, memory), "encoded", codec="none")
    schema = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    )

    def run(batches):
        from pyspark import TaskContext

        stream = Stream(length, TaskContext.get().partitionId() << 40)

        def pieces():
            for batch in batches:
                for doc_id, start, total, ids in zip(*batch.columns, strict=True):
                    yield from stream.add(doc_id.as_py(), expand(ids.as_py()), start.as_py(), total.as_py())
            yield from stream.end()

        yield from _batches(pieces(), schema, lambda row: len(row[2]))

    order = ("place", "doc_id", "tie", "start")
    ordered = coded.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return ordered.select("doc_id", "start", "total", "ids").mapInArrow(run, "doc_id LONG, start LONG, ids BINARY, doc_tokens LONG, sequence_id LONG, offset LONG")

"""Token-id files in bit-plane or byte-plane segments.

A segment holds the ids of whole documents, in blocks of a fixed number of ids. Each block is transposed
into planes (plane k has bit k, or byte k, of every id), each plane is compressed by zstandard, and a
chunk index gives every plane's place, so a reader decompresses only the blocks it needs. Layout, all
little-endian:

    magic "BPS1" | u8 bits per plane (1 or 8) | 3 zero bytes | u32 block size | u32 documents | u64 ids
    | u32 bytes of the document table | document table | chunk index | planes

Document table: zstandard of u8 null flags, i64 ids, u64 lengths. Chunk index: for each block and plane
a u32 length; 0 stands for a plane of zero bits. Segments are rows of a Parquet table (shard, segment,
n_docs, n_ids, payload), written by Spark's committer: a lost executor's attempt leaves nothing behind.

Defined cases: null and empty texts have only the end id; documents are in order of id, null ids
first, equal ids in order of a hash of the text and then of the text; a document longer than a segment
gets a segment of its own; an empty table makes an empty table of segments.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.llm._shared import partitions, scratch_path, text_or_empty

MAGIC, HEAD = b"BPS1", struct.Struct("<4sBxxxIIQI")
BLOCK, SEGMENT = 1 << 16, 1 << 20
END = 2
SEGMENTS = "shard INT, segment INT, n_docs INT, n_ids LONG, payload BINARY"


def split_planes(ids: np.ndarray, bits: int) -> list[bytes]:
    """Planes of one block from the lowest on; an all-zero plane is empty."""
    flat = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    top = int(ids.max(initial=0)).bit_length()
    if bits == 8:
        return [flat[:, k].tobytes() if 8 * k < top else b"" for k in range(4)]
    spread = np.unpackbits(flat[:, : max(1, (top + 7) // 8)], axis=1, bitorder="little")
    return [np.packbits(spread[:, k]).tobytes() if k < top else b"" for k in range(32)]


def join_planes(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    if bits == 8:
        flat = np.zeros((n, 4), np.uint8)
        for k, plane in enumerate(planes):
            if plane:
                flat[:, k] = np.frombuffer(plane, np.uint8)
        return flat.view("<u4").ravel()
    ids = np.zeros(n, "<u4")
    for k, plane in enumerate(planes):
        if plane:
            ids |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n).astype("<u4") << np.uint32(k)
    return ids


def pack_segment(doc_ids: list, ids: list[bytes], bits: int = 8, block: int = BLOCK, level: int = 1) -> bytes:
    press = zstandard.ZstdCompressor(level=level).compress
    flat = np.frombuffer(b"".join(ids), "<u4")
    table = press(
        np.array([d is None for d in doc_ids], np.uint8).tobytes()
        + np.array([d or 0 for d in doc_ids], "<i8").tobytes()
        + np.array([len(x) // 4 for x in ids], "<u8").tobytes()
    )
    planes = [press(p) if p else b"" for k in range(0, len(flat), block) for p in split_planes(flat[k : k + block], bits)]
    head = HEAD.pack(MAGIC, bits, block, len(doc_ids), len(flat), len(table))
    return b"".join([head, table, np.array([len(p) for p in planes], "<u4").tobytes(), *planes])


class Segment:
    """A reader of one segment: whole documents or any range of ids."""

    def __init__(self, payload: bytes):
        magic, self.bits, self.block, n_docs, self.n_ids, n_table = HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a plane segment")
        self.payload, self.unpress = payload, zstandard.ZstdDecompressor().decompress
        at = HEAD.size + n_table
        table = self.unpress(payload[HEAD.size : at], max_output_size=17 * n_docs + 1)
        null = np.frombuffer(table, np.uint8, n_docs)
        self.doc_ids = [None if z else d for z, d in zip(null, np.frombuffer(table, "<i8", n_docs, n_docs).tolist(), strict=True)]
        self.lengths = np.frombuffer(table, "<u8", n_docs, 9 * n_docs).astype(np.int64)
        self.planes = 32 // self.bits
        blocks = -(-self.n_ids // self.block)
        sizes = np.frombuffer(payload, "<u4", blocks * self.planes, at).astype(np.int64)
        self.ends = at + 4 * sizes.size + np.cumsum(sizes)
        self.sizes = sizes

    def read_block(self, k: int) -> np.ndarray:
        n = min(self.block, self.n_ids - k * self.block)
        most = n * self.bits // 8 + 8
        own = range(k * self.planes, (k + 1) * self.planes)
        parts = [self.payload[self.ends[i] - self.sizes[i] : self.ends[i]] for i in own]
        return join_planes([self.unpress(p, max_output_size=most) if p else b"" for p in parts], n, self.bits)

    def read(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        whole = np.concatenate([self.read_block(k) for k in range(first, last + 1)])
        return whole[start - first * self.block : stop - first * self.block]

    def documents(self):
        """(doc_id, first id's place in the segment, ids as bytes) of each document, block by block."""
        held, base, block, at = [], 0, 0, 0
        have = 0
        for doc_id, n in zip(self.doc_ids, self.lengths.tolist(), strict=True):
            while have < n:
                held.append(self.read_block(block))
                have += len(held[-1])
                block += 1
            flat = np.concatenate(held) if len(held) > 1 else held[0] if held else np.zeros(0, "<u4")
            yield doc_id, at, flat[:n].tobytes()
            held, have, at = [flat[n:]], have - n, at + n


def write(docs: DataFrame, path: str, vocabulary: str | None = None, bits: int = 8, end: int = END, shards: int | None = None) -> None:
    """Encode every text of ``docs(doc_id, text)`` and write the segments to ``path``."""
    vocabulary = vocabulary or tokens.default_path()

    def segments(batches):
        from pyspark import TaskContext

        shard, encode = TaskContext.get().partitionId(), tokens.encoder(vocabulary).encode
        tail, segment = np.array([end], "<u4").tobytes(), 0
        doc_ids, ids, size = [], [], 0

        def flush():
            return pa.RecordBatch.from_pydict(
                {"shard": [shard], "segment": [segment], "n_docs": [len(ids)], "n_ids": [size // 4], "payload": [pack_segment(doc_ids, ids, bits)]},
                schema=pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("payload", pa.binary())]),
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), tokens.as_bytes(batch.column(1)), strict=True):
                own = encode(text) + tail
                if ids and size + len(own) > 4 * SEGMENT:
                    yield flush()
                    doc_ids, ids, size, segment = [], [], 0, segment + 1
                doc_ids.append(doc_id)
                ids.append(own)
                size += len(own)
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(shards or partitions(docs.sparkSession), F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie, "text")
    ordered.mapInArrow(segments, SEGMENTS).write.option("compression", "none").parquet(path)


def read(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(``doc_id, shard, segment, place, ids`` of every document; ``shard, segment, base``: ids before a segment).

    ``ids`` are little-endian unsigned 32-bit integers.
    """

    def documents(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("segment", pa.int32()), ("place", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for shard, segment, payload in zip(*(batch.column(k) for k in range(3)), strict=True):
                rows, size = [], 0
                for doc_id, at, ids in Segment(payload.as_py()).documents():
                    rows.append((doc_id, shard.as_py(), segment.as_py(), at, ids))
                    size += len(ids)
                    if size > 1 << 22 or len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.schema(SEGMENTS).parquet(path)
    index = files.select("shard", "segment", "n_ids")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = (
        index.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
        .select("shard", before(Window.partitionBy(F.lit(0)).orderBy("shard")).alias("base"))
    )
    inside = index.select("shard", "segment", before(Window.partitionBy("shard").orderBy("segment")).alias("first"))
    starts = inside.join(shards, "shard").select("shard", "segment", (F.col("base") + F.col("first")).alias("base"))
    rows = files.select("shard", "segment", "payload").mapInArrow(documents, "doc_id LONG, shard INT, segment INT, place LONG, ids BINARY")
    return rows, starts


#: Segments whose starts are broadcast: 16 bytes each, so 16 MB at most.
BROADCAST_SEGMENTS = 1_000_000


def read_documents(spark, path: str) -> DataFrame:
    """``doc_id, start, ids``."""
    rows, starts = read(spark, path)
    if spark.read.schema(SEGMENTS).parquet(path).count() <= BROADCAST_SEGMENTS:
        starts = F.broadcast(starts)
    return rows.join(starts, ["shard", "segment"]).select("doc_id", (F.col("base") + F.col("place")).alias("start"), "ids")


def new_path(spark) -> str:
    return scratch_path(spark, "planes")

"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint's bit is 1 if it is set in over half the hashes of the text's word shingles, repeats
included. Fingerprints within RADIUS bits are linked. Bits are given non-zero vectors of RADIUS + 1 bits;
table v (a non-zero vector too) keeps the bits whose vector has odd overlap with v. RADIUS vectors never
span the space, so for any two fingerprints within the radius some table keeps none of the bits in which
they differ: they meet there (Pagh, 2016). No pair is missed.

Only distinct fingerprints enter the tables. A bucket of up to BUCKET of them is compared within one task,
which gives a spanning forest of its links and never all pairs. A larger bucket, which only a dense cluster
makes, is dealt into tiles of about BUCKET, and each pair of its tiles is a task: quadratic in that bucket
alone, in bounded memory, and spread over all tasks.

Defined cases: a null text counts as empty; a text without words has fingerprint 0, linked like any other;
one with fewer words than a shingle is hashed whole; rows with equal ids are separate members of their
class; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import attach, materialise, partitions, text_or_empty
from tidemark.llm.components import components, forest
from tidemark.llm.tokens import as_bytes

SHINGLE, RADIUS, SEED = 3, 3, 42
BUCKET = 2048
SPREAD = 1 << 19
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def majority(hashes: np.ndarray) -> int:
    """The 64 majority bits of 64-bit hashes."""
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    if len(lanes) < 1024:
        ones = np.unpackbits(lanes, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int(np.packbits(2 * ones > len(lanes), bitorder="little").view("<u8")[0])


def shingles(words: list[bytes], size: int):
    if len(words) < size:
        return [b" ".join(words)]
    return map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    count = max(1, len(words) - size + 1)
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles(words, size), repeat(SEED)), np.uint64, count))


def fingerprints(docs: DataFrame, size: int = SHINGLE, *more: str) -> DataFrame:
    """``doc_id, fp`` of every row, and the columns ``more`` (integers); ``fp`` as a signed integer of the same bits."""

    def run(batches):
        schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "fp", *more)])
        for batch in batches:
            fps = np.array([fingerprint(t, size) for t in as_bytes(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), *batch.columns[2:]], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), *(F.col(c).cast("long").alias(c) for c in more))
    return rows.mapInArrow(run, ", ".join(f"`{c}` LONG" for c in ("doc_id", "fp", *more)))


def cover(free: list[int], radius: int) -> list[int]:
    """The bits that each table keeps, as masks, for differences within the bits ``free``."""
    tables = (1 << (radius + 1)) - 1
    best = []
    for step in range(1, tables):  # any choice of vectors is complete; take one whose tables keep many bits each
        vector = {bit: k * step % tables + 1 for k, bit in enumerate(free)}
        masks = [sum(1 << bit for bit in free if (vector[bit] & v).bit_count() & 1) for v in range(1, tables + 1)]
        best = max(best, masks, key=lambda m: min((x.bit_count() for x in m), default=-1))
    return best


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which of ``a`` (rows) and ``b`` (columns) differ in at most ``radius`` bits; by blocks, to bound memory."""
    blocks = [np.bitwise_count(a[k : k + 256, None] ^ b[None, :]) <= radius for k in range(0, len(a), 256)]
    return np.concatenate(blocks) if blocks else np.zeros((0, len(b)), bool)


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """``a, b``: links that join the same distinct fingerprints of ``fps(fp)`` as all links within ``radius``."""

    def compare(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            found = []
            for left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = np.array(left, np.int64)
                columns = np.array(right, np.int64) if right else rows
                found += forest(near(rows.view(np.uint64), columns.view(np.uint64), radius), rows, columns)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=schema)

    masks = cover(list(range(64)), radius)
    tables = F.array(*[F.struct(F.lit(k).alias("path"), F.lit(_signed(m)).alias("mask")) for k, m in enumerate(masks)])
    # Each row becomes as many as there are tables; a task makes about SPREAD of them.
    rows = fps.repartition(max(partitions(fps.sparkSession), -(-fps.count() * len(masks) // SPREAD)), "fp")
    keyed = rows.select("fp", F.explode(tables).alias("t")).select("fp", F.col("t.path").alias("path"), F.col("fp").bitwiseAND(F.col("t.mask")).alias("key"))
    buckets = materialise(
        keyed.groupBy("path", "key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        .filter((F.col("n") > 2) | ((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))),
        "buckets",
    )
    members = materialise(keyed.join(buckets.filter("n > 2").select("path", "key", "n"), ["path", "key"]).select("path", "key", "n", "fp"), "members")
    small = members.filter(F.col("n") <= bucket).groupBy("path", "key").agg(F.collect_list("fp").alias("left"))
    tiles = F.ceil(F.col("n") / bucket).cast("int")
    large = members.filter(F.col("n") > bucket).withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("fp"), "tiles").cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: F.struct(F.least("tile", k).alias("i"), F.greatest("tile", k).alias("j")))
    dealt = large.select("path", "key", "fp", "tile", F.explode(others).alias("p")).groupBy("path", "key", "p.i", "p.j")
    pairs = dealt.agg(F.collect_list(F.when(F.col("tile") == F.col("p.i"), F.col("fp"))).alias("left"), F.collect_list(F.when(F.col("tile") != F.col("p.i"), F.col("fp"))).alias("right"))
    # Written, so that a table of one dense cluster is spread by its pairs of tiles.
    pairs = materialise(pairs.filter("size(left) > 0").select("left", "right"), "tiles")
    sides = small.select("left", F.array().cast("array<bigint>").alias("right")).unionByName(pairs)
    return buckets.filter("n = 2").select("a", "b").unionByName(sides.mapInArrow(compare, "a LONG, b LONG"))


def classes(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id (the smallest doc_id that links reach), kept."""
    rows = materialise(fingerprints(docs, size), "fingerprints")
    return group(rows, radius).drop("component").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def group(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """A written table ``rows(doc_id, fp, ...)`` with each row's component and ``component_id``."""
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct_fps")
    found = components(links(distinct.select("fp"), radius))
    own = materialise(
        distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "n", F.coalesce("component", "fp").alias("component")), "members"
    )
    least = materialise(own.groupBy("component").agg(F.min("first").alias("component_id")), "least")
    table = materialise(own.join(least, "component").select("fp", "component", "component_id", "n"), "classes")
    return attach(rows, "fp", table, "n")


def deduplicate(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component: that with the smallest id, then the smallest text hash.

    Rows alike in id and text are one decision.
    """
    rows = materialise(fingerprints(named(docs), size, "mark"), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first")
    keep = group(rows, radius).groupBy("component").agg(first)
    return staying(docs, keep)

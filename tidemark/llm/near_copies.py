"""Near copies by the overlap of five-word shingles, no pair missed and each link checked exactly.

Two texts are linked if their sets of word shingles have a Jaccard overlap of 0.8 or more. Covering SimHash finds
most copies first: what its tables connect is checked on the sets. Fingerprints reach only about half of the
pairs at 0.8, so a prefix filter finds the rest: if each set is put in one order, the rarest shingles first, two
sets that overlap by 0.8 share one of the first n / 5 + 1 of their n shingles (their prefixes). The place of the first one
shared bounds what they have in common, and so does what both prefixes hold; only pairs that may still reach 0.8 are
compared as whole sets. That is exact for any order. Rarity is read from a table of counters of all
shingles' hashes (SLOTS bytes, sent to the executors), so passages that many texts share come last and make
no candidates; where counters mislead, only time is lost.

Texts with equal sets are one node. In a shingle's bucket some CENTERS nodes, drawn by hash, are compared with the
others; then, with the components of the links found so far, what is left in a bucket are pairs of different
components. ROUNDS rounds go on so, unless there are at most FEW pairs a node left; after that all that are left and in
reach of each other are compared. So no candidate is left out unless it already is connected, a bucket of fewer than
2 * CENTERS nodes is done at once, and a bucket of near copies costs as many comparisons as it has members, times CENTERS.
Two nodes whose last shared shingles before a bucket's are the same one meet in that one's bucket already, at earlier
places; so near copies meet once a run of shingles in which their prefixes agree, not once a shingle. In the last round
a map of BITS bits of each set is looked at while pairs are made: each bit that one has alone stands for a shingle that the other lacks.

Defined cases: as in ``simhash``; texts without words are alike; one with fewer words than a shingle is one
shingle. Sets are of 64-bit hashes.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm._shared import attach, discard, materialise, named, release_shuffles, staying
from tidemark.llm.components import components
from tidemark.llm.simhash import SEED, majority, shingles
from tidemark.llm.tokens import as_bytes

SHINGLE, CENTERS, ROUNDS, FEW = 5, 8, 2, 4
#: Counters of shingles, a power of two; and in how many rows a task sends its own.
SLOTS, PARTS = 1 << 20, 64
#: Bits of a set's map, a power of two and a multiple of 64.
BITS = 512
#: Sets that a task makes at once.
ROWS = 512
#: Texts that are looked up by a broadcast of their names, some 10 MB; beyond it texts are shuffled.
BROADCAST = 100_000
#: An overlap of s or more: (1 + s) * common >= s * (sizes), in whole numbers for 0.8.
_COMMON, _SIZES = 9, 4


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    words = text.lower().split()
    count = max(1, len(words) - size + 1)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles(words, size), repeat(SEED)), np.uint64, count))


def slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - (SLOTS.bit_length() - 1))).astype(np.int64)


def prefix(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The rarest n / 5 + 1 shingles of a set, rarest first, as numbers in order of rarity and then of hash."""
    ranks = (levels[slots(hashes)].astype(np.uint64) << np.uint64(56)) | (hashes >> np.uint64(8))
    return np.sort(ranks)[: len(hashes) // 5 + 1]


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """A set's map: for each of BITS ranges of hashes, whether the set has one there."""
    own = np.zeros(BITS, np.uint8)
    own[(hashes >> np.uint64(64 - (BITS.bit_length() - 1))).astype(np.int64)] = 1
    return np.packbits(own).view(np.int64)


def maps_allow(bits_a: str, size_a: str, bits_b: str, size_b: str) -> Column:
    """Whether sets of these sizes can overlap by 0.8, by their maps."""
    alone = lambda x, y: sum(F.bit_count(F.col(x)[k].bitwiseAND(F.bitwise_not(F.col(y)[k]))) for k in range(BITS // 64))
    a, b = F.col(size_a), F.col(size_b)
    return _COMMON * F.least(a - alone(bits_a, bits_b), b - alone(bits_b, bits_a)) >= _SIZES * (a + b)


def alike(a: str, b: str) -> Column:
    """Whether two sets (arrays without repeats) overlap by 0.8."""
    return _COMMON * F.size(F.array_intersect(a, b)) >= _SIZES * (F.size(a) + F.size(b))


def rarity(docs: DataFrame) -> np.ndarray:
    """For each slot the logarithm of its number of shingles in ``docs(text)``, in halves; summed on the executors."""
    width = SLOTS // PARTS

    def rows(counts):
        for k in range(PARTS):
            yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "counts": pa.array([counts[k * width : (k + 1) * width].tobytes()], pa.binary())})

    def count(batches):
        total, held, size = np.zeros(SLOTS, np.int64), [], 0
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                held.append(slots(shingle_set(text)))
                size += len(held[-1])
                if size > SLOTS:
                    total += np.bincount(np.concatenate(held), minlength=SLOTS)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=SLOTS)
        if total.any():
            yield from rows(total.astype("<i4") if total.max() < 1 << 31 else total.astype("<i8"))

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = raw.as_py()
                own = np.frombuffer(data, "<i4" if len(data) == 4 * width else "<i8")
                sums[k] = sums[k] + own if k in sums else own.astype(np.int64)
        for k, total in sums.items():
            level = np.rint(2 * np.log2(total + 1.0)).astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "counts": pa.array([level], pa.binary())})

    schema = "part INT, counts BINARY"
    own = docs.select("text").mapInArrow(count, schema)
    levels = np.zeros((PARTS, width), np.uint8)
    for row in own.repartition(PARTS, "part").mapInArrow(add, schema).collect():  # SLOTS bytes, whatever the corpus
        levels[row.part] = np.frombuffer(bytes(row.counts), np.uint8)
    return levels.ravel()


def _signatures(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """``doc_id, mark, node, size, fp, keys, bits`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches):
        for batch in batches:
            nodes, sizes, fps, keys, maps = [], [], [], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for text in as_bytes(batch.column(1)):
                own = shingle_set(text)
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                sizes.append(len(own))
                fps.append(majority(own))
                keys.append(prefix(own, shared.value))
                maps.append(bitmap(own))
            ends = np.cumsum([len(k) for k in keys]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys).view(np.int64)))
            node, fp = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, fps))
            bits = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(sizes) + 1) * (BITS // 64), BITS // 64, dtype=np.int32)), pa.array(np.concatenate(maps)))
            columns = [batch.column(0), batch.column(2), node, pa.array(sizes, pa.int64()), fp, lists, bits]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "node", "size", "fp", "keys", "bits"])

    return docs.mapInArrow(run, "doc_id LONG, mark LONG, node LONG, size LONG, fp LONG, keys ARRAY<LONG>, bits ARRAY<LONG>")


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, hashes`` of ``nodes(node, first)``, from the text of the row that ``first`` names."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):  # sets are longer than their texts: a few at a time
                part = batch.slice(k, ROWS)
                sets = [shingle_set(t) for t in as_bytes(part.column(1))]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["node", "hashes"])

    wanted = nodes.select("node", F.col("first.doc_id").alias("id"), F.col("first.mark").alias("own"))
    rows = docs.join(wanted, (F.col("mark") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("id")))
    return rows.select("node", "text").mapInArrow(run, "node LONG, hashes ARRAY<LONG>")


def close(a: str | Column, b: str | Column) -> Column:
    """Whether sets of these sizes can overlap by 0.8."""
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def in_reach(size_a, at_a, size_b, at_b) -> Column:
    """Whether sets of these sizes can, if their first shared shingle stands at these places in the order."""
    a, b = F.col(size_a), F.col(size_b)
    return close(a, b) & (_COMMON * F.least(a - F.col(at_a), b - F.col(at_b)) >= _SIZES * (a + b))


def prefixes_allow(keys_a: str, size_a: str, keys_b: str, size_b: str) -> Column:
    """Whether sets of these sizes can overlap by 0.8, by their prefixes.

    Up to the rank at which the first prefix ends, both say all there is; beyond it the rest of the smaller set may be shared.
    """
    last = F.least(F.element_at(keys_a, -1), F.element_at(keys_b, -1))
    within = lambda c: F.filter(c, lambda k: k <= last)
    a, b = F.col(size_a), F.col(size_b)
    most = F.size(F.array_intersect(within(keys_a), within(keys_b))) + F.least(a - F.size(within(keys_a)), b - F.size(within(keys_b)))
    return _COMMON * most >= _SIZES * (a + b)


def beside(pairs: DataFrame, rows: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """``pairs(a, b)`` with ``columns`` of ``rows(node, ...)`` for a and for b; many pairs may share one ``a``. And a table to discard."""
    own = rows.join(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), F.col("node") == F.col("a"))
    table = materialise(own.select("a", "n", *(F.col(c).alias(f"{c}_a") for c in columns)), "firsts")
    second = rows.select(F.col("node").alias("b"), *(F.col(c).alias(f"{c}_b") for c in columns))
    return attach(pairs, "a", table, "n").join(second, "b"), table


class Links:
    """Links found so far between nodes of ``distinct(node, size, fp, keys, bits, first)``, and the sets read for them.

    ``found(node, component)`` are the components of the links so far: at most one row a node, however many links there were.
    """

    def __init__(self, docs: DataFrame, distinct: DataFrame, repeated: bool):
        """``repeated``: whether rows of ``docs`` are alike in id and text."""
        self.docs, self.distinct, self.repeated = docs, distinct, repeated
        self.sets = self.found = None

    def check(self, pairs: DataFrame) -> None:
        """Add those of ``pairs(a, b)`` whose sets are alike."""
        every = materialise(pairs.distinct(), "pairs")
        likely, firsts = beside(every, self.distinct, "size", "keys")
        pairs = materialise(likely.filter(prefixes_allow("keys_a", "size_a", "keys_b", "size_b")).select("a", "b"), "likely_pairs")
        discard(every, firsts)
        nodes = pairs.select(F.col("a").alias("node")).distinct().unionByName(pairs.select(F.col("b").alias("node")).distinct()).distinct()
        if self.sets is not None:
            nodes = nodes.join(self.sets.select("node"), "node", "left_anti")
        nodes = materialise(nodes, "nodes")
        small = F.broadcast if nodes.count() <= BROADCAST else lambda table: table
        more = _sets(self.docs, small(self.distinct.select("node", "first").join(small(nodes), "node")))
        more = materialise(more.dropDuplicates(["node"]) if self.repeated else more, "sets")
        self.sets = more if self.sets is None else self.sets.unionByName(more)
        whole, firsts = beside(pairs, self.sets, "hashes")
        good = materialise(whole.filter(alike("hashes_a", "hashes_b")).select("a", "b"), "near")
        before, known = self.found, good
        if before is not None:
            known = good.unionByName(before.select(F.col("component").alias("a"), F.col("node").alias("b")))
        self.found = components(known)
        discard(pairs, nodes, firsts, good, *([] if before is None else [before]))
        release_shuffles(self.docs.sparkSession)


def by_fingerprint(links: Links) -> None:
    """Pairs that covering SimHash connects."""
    nodes = links.distinct.select("node", "size", "fp")
    first = materialise(nodes.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("low"), F.count(F.lit(1)).alias("n")), "fingerprints")
    same = attach(materialise(nodes, "own_fingerprints"), "fp", first, "n").select(F.col("low").alias("x"), F.struct("node", "size").alias("y"))
    low = lambda c: first.select(F.col("fp").alias(c), F.col("low").alias("x" if c == "a" else "y"))
    near = materialise(simhash.links(first.select("fp")), "near_fingerprints").join(low("a"), "a").join(low("b"), "b").select("x", "y")
    pairs = same.unionByName(near).filter((F.col("x.node") != F.col("y.node")) & close("x.size", "y.size"))
    links.check(pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))


def by_prefix(links: Links) -> None:
    """Pairs that share one of their rarest shingles and are in reach of each other."""
    # Size and place in one number, as this is the longest table.
    keyed = links.distinct.select("node", "size", F.posexplode("keys").alias("at", "key")).select("key", "node", (F.shiftleft("size", 32) + F.col("at")).alias("sized"))
    shared = materialise(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "shared")
    own = keyed.join(shared, "key").select("key", "node", F.shiftright("sized", 32).alias("size"), F.col("sized").bitwiseAND(0xFFFFFFFF).alias("at"))
    # The shared shingle before this one in the node's order.
    left = materialise(own.withColumn("before", F.lag("key").over(Window.partitionBy("node").orderBy("at"))), "members")
    discard(shared)
    release_shuffles(left.sparkSession)
    most = FEW * links.distinct.count()
    for k in range(ROUNDS + 1):
        own = left.join(links.found, "node", "left").select("key", "node", "size", "at", "before", F.coalesce("component", "node").alias("component"))
        before, left = left, materialise(own, "left")
        discard(before)
        parts = left.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
        open_ = parts.groupBy("key").agg(F.sum("n").alias("n"), ((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("pairs"))
        open_ = materialise(open_.filter("pairs > 0"), "open")
        total = open_.agg(F.sum("pairs")).first()[0]
        if not total:
            return discard(left, open_)
        step = F.when(F.lit(total <= most or k == ROUNDS), 1).otherwise(F.greatest(F.lit(1), F.floor(F.col("n") / CENTERS)))
        before, left = left, materialise(attach(left, "key", open_.select("key", step.alias("step"), "n"), "n").filter("step IS NOT NULL"), "left")
        discard(before, open_)
        # The same nodes in all buckets at first, so few pairs; then others in each, so that what is left meets many.
        center = F.pmod(F.xxhash64("node", F.col("key") if k else F.lit(0)), "step") == 0
        rows, columns = left, ("node", "size", "at", "before", "component")
        if k == ROUNDS:
            rows, columns = left.join(links.distinct.select("node", "bits"), "node"), (*columns, "bits")
        a, b = (own.select("key", *(F.col(c).alias(f"{c}_{x}") for c in columns)) for own, x in ((rows.filter(center), "a"), (rows, "b")))
        differ = (F.col("node_a") != F.col("node_b")) & (F.col("component_a") != F.col("component_b"))
        new = F.coalesce(F.col("before_a") != F.col("before_b"), F.lit(True))
        reach = in_reach("size_a", "at_a", "size_b", "at_b")
        if k == ROUNDS:  # both ways in one row
            reach = (F.col("node_a") < F.col("node_b")) & reach & maps_allow("bits_a", "size_a", "bits_b", "size_b")
        pairs = a.join(b, "key").filter(differ & new & reach)
        links.check(pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")))
        before, left = left, materialise(left.filter(~center).select("key", "node", "size", "at", "before"), "left")
        discard(before)


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component: that with the smallest id, then the smallest text hash.

    Rows alike in id and text are one decision.
    """
    own = named(docs)
    rows = materialise(_signatures(own, rarity(own)), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first")
    sets = rows.groupBy("node").agg(F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("bits").alias("bits"), first)
    distinct = materialise(sets, "distinct_sets")
    repeated = bool(rows.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count())
    discard(rows)
    release_shuffles(docs.sparkSession)
    links = Links(own, distinct, repeated)
    by_fingerprint(links)
    by_prefix(links)
    whole = distinct.select("node", "first").join(links.found, "node", "left").select("first", F.coalesce("component", "node").alias("component"))
    return staying(docs, whole.groupBy("component").agg(F.min("first").alias("first")))
